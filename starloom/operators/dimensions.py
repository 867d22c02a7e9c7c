"""Dimensions: surrogate keys, placeholder and inferred members, categories and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.columns import UNKNOWN, beginning, date_key, forever, surrogate_key, title_of, unknown_key


def literal_row(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row in ``df``'s columns and types; columns without a value are null."""
    one = df.sparkSession.range(1)
    return one.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])


def placeholder_member(dim: DataFrame, key: str, named: dict[str, Column] | None = None, now: Column | None = None) -> DataFrame:
    """The member for facts that cannot be resolved: every text attribute is UNKNOWN, unless ``named`` gives
    another value; it is valid at every instant and marked as no real one."""
    texts = {f.name: F.lit(UNKNOWN) for f in dim.schema if f.dataType.simpleString() == "string"}
    values = texts | {key: unknown_key(), "is_placeholder": F.lit(True), "is_current": F.lit(True)} | (named or {})
    if "effective_from" in dim.columns:
        kind = dim.schema["effective_from"].dataType.simpleString()
        values |= {"effective_from": beginning(kind), "effective_to": forever(kind)}
    return literal_row(dim, values | ({"updated_at": now} if now is not None else {}))


def versioned_dimension(versions: DataFrame, key: str, business_key: list[str], now: Column | None = None) -> DataFrame:
    """Versions with a key of (business key, effective_from), and the placeholder member."""
    real = versions.select(surrogate_key(*business_key, "effective_from").alias(key), "*", F.lit(False).alias("is_placeholder"))
    return real.unionByName(placeholder_member(real, key, now=now))


def inferred_members(dim: DataFrame, facts: DataFrame, column: str, unknown: tuple[str, ...] | None = None) -> DataFrame:
    """Distinct fact keys that the dimension lacks, as rows of its columns marked is_inferred; nulls infer nothing.

    Columns in ``unknown``, by default all text attributes as in the placeholder, are UNKNOWN, so that reports
    group them; all others are null.
    """
    if unknown is None:
        unknown = tuple(f.name for f in dim.schema if f.dataType.simpleString() == "string")
    keys = facts.select(column).where(F.col(column).isNotNull()).distinct()
    missing = keys.join(dim.select(column), column, "left_anti")
    fill = [F.lit(True) if f.name == "is_inferred" else F.lit(UNKNOWN) if f.name in unknown else F.lit(None) for f in dim.schema]
    return missing.select(*[(F.col(column) if f.name == column else v).cast(f.dataType).alias(f.name) for f, v in zip(dim.schema, fill, strict=True)])


def keyed_dimension(rows: DataFrame, key: str, business_key: list[str], facts: DataFrame | None = None, unknown: tuple[str, ...] | None = None) -> DataFrame:
    """Current rows with a key of the business key, and inferred members for fact keys that have not arrived.

    An inferred member has the key that the real one will have, so facts need no change when it comes.
    """
    real = rows.withColumn("is_inferred", F.lit(False))
    every = real if facts is None else real.unionByName(inferred_members(real, facts, business_key[0], unknown))
    return every.select(surrogate_key(*business_key).alias(key), "*")


def category_dimension(codes: DataFrame, code: str, key: str, name: str) -> DataFrame:
    """One member per distinct code found in the data."""
    return codes.select(code).distinct().select(surrogate_key(code).alias(key), code, title_of(F.col(code)).alias(name))


def bounds(*dates: tuple[DataFrame, str, str]) -> DataFrame:
    """lo, hi: the least first and greatest last day of (frame, first column, last column); nulls are skipped."""
    parts = None
    for df, first, last in dates:
        one = df.agg(F.min(F.to_date(first)).alias("lo"), F.max(F.to_date(last)).alias("hi"))
        parts = one if parts is None else parts.union(one)
    return parts.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def date_dimension(span: DataFrame) -> DataFrame:
    """One row per calendar day of the one-row frame (lo, hi)."""
    days = span.where("lo <= hi").select(F.explode(F.sequence("lo", "hi")).alias("full_date"))
    return days.select(
        date_key("full_date").alias("date_key"),
        "full_date",
        F.dayofmonth("full_date").alias("day_of_month"),
        F.month("full_date").alias("month_number"),
        F.date_format("full_date", "MMMM").alias("month_name"),
        F.quarter("full_date").alias("quarter"),
        F.year("full_date").alias("year_number"),
        F.dayofweek("full_date").isin(1, 7).alias("is_weekend"),
    )
