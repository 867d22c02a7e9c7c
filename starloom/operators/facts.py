"""Facts: as-of resolution, date spines, running balances and milestones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.columns import date_key, money
from starloom.operators.clean import _free


def asof_join(facts: DataFrame, versions: DataFrame, on: dict[str, str], at: str, bring: list[str], start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """``facts`` with ``bring`` of the version that held at ``at``: start <= at < end. Unmatched facts stay, with nulls.

    The equality on the key keeps this a hash or sort-merge join with the range as a residual, so a hot
    key splits as any skewed join does.
    """
    keys = {k: f"asof_{v}" for k, v in on.items()}
    (lo, hi) = _free(facts, "asof_from", "asof_to")
    right = versions.select(*[F.col(v).alias(keys[k]) for k, v in on.items()], F.col(start).alias(lo), F.col(end).alias(hi), *bring)
    condition = (F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))
    for k in on:
        condition = (F.col(k) == F.col(keys[k])) & condition
    return facts.join(right, condition, "left").select(*facts.columns, *bring)


def date_spine(entities: DataFrame, span: DataFrame, opened: str, closed: str, day: str = "full_date") -> DataFrame:
    """One row per entity and day that it was open within the one-row frame (lo, hi).

    The day of closing is outside. A null start or end is the span's. Each row makes its own days,
    so no range join is needed; the span is one row and is broadcast.
    """
    own = entities.crossJoin(F.broadcast(span))
    first = F.greatest(F.coalesce(F.col(opened), F.col("lo")), F.col("lo"))
    last = F.least(F.coalesce(F.date_sub(closed, 1), F.col("hi")), F.col("hi"))
    ranged = own.withColumns({"spine_from": first, "spine_to": last}).where("spine_from <= spine_to")
    return ranged.select(*entities.columns, F.explode(F.sequence("spine_from", "spine_to")).alias(day))


def daily_movements(events: DataFrame, entity: str, at: str, amount: str, counted: Column) -> DataFrame:
    """Per entity and day: net movement, and debits, credits and number of the ``counted`` events."""
    value = F.col(amount)
    return events.groupBy(entity, date_key(F.to_date(at)).alias("date_key")).agg(
        F.sum(value).alias("movement"),
        F.sum(F.when(counted & (value < 0), value).otherwise(0)).alias("debit_amount"),
        F.sum(F.when(counted & (value >= 0), value).otherwise(0)).alias("credit_amount"),
        F.count_if(counted).cast("int").alias("txn_count"),
    )


def periodic_snapshot(spine: DataFrame, movements: DataFrame, entity: str, kind: str = "decimal(18,2)") -> DataFrame:
    """A spine (entity, date_key, ...) with opening and closing balances; quiet days carry the balance on."""
    joined = spine.join(movements, [entity, "date_key"], "left")
    amounts = {c: money(F.col(c), kind) for c in ("movement", "debit_amount", "credit_amount")}
    daily = joined.withColumns(amounts | {"txn_count": F.coalesce("txn_count", F.lit(0)).cast("int")})
    run = Window.partitionBy(entity).orderBy("date_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    daily = daily.withColumn("closing_balance", F.sum("movement").over(run).cast(kind))
    return daily.withColumn("opening_balance", (F.col("closing_balance") - F.col("movement")).cast(kind))


def accumulating_snapshot(entities: DataFrame, events: DataFrame, entity: str, at: str, amount: str, counted: Column, opened: str, closed: str, as_of: Column, kind: str = "decimal(18,2)") -> DataFrame:
    """One row per entity with its milestones so far; a null milestone has not happened.

    Only ``counted`` events are activity, while lifetime_amount sums all. ``as_of`` stands for today
    where an entity is still open, so reruns agree.
    """
    day = F.when(counted, F.to_date(at))
    activity = events.groupBy(entity).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count_if(counted).cast("int").alias("txn_count"), F.sum(amount).alias("lifetime_amount"))
    joined = entities.join(activity, entity, "left")
    return joined.select(
        *entities.columns,
        date_key(opened).alias("opened_date_key"),
        date_key("first_day").alias("first_txn_date_key"),
        date_key("last_day").alias("last_txn_date_key"),
        date_key(closed).alias("closed_date_key"),
        F.datediff("first_day", opened).alias("days_to_first_txn"),
        F.datediff(F.coalesce(F.col(closed), as_of), opened).alias("days_open"),
        F.coalesce("txn_count", F.lit(0)).cast("int").alias("txn_count"),
        money(F.col("lifetime_amount"), kind).alias("lifetime_amount"),
    )
