"""Integrity checks. Each returns a one-row or few-row frame of counts in which zero faults is the pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.columns import differs, fingerprint
from starloom.operators.history import overlaps
from starloom.spec import Spec


def grain(df: DataFrame, key: list[str]) -> DataFrame:
    """rows, keys, repeated: rows beyond the first of each key. One shuffle, combined before it."""
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))


def orphans(fact: DataFrame, column: str, dim: DataFrame, target: str) -> DataFrame:
    """orphan, missing: non-null keys without a member, and null keys. Keys are counted once before the join."""
    keys = fact.groupBy(F.col(column).alias("fact_key")).agg(F.count(F.lit(1)).alias("n"))
    known = dim.select(F.col(target).alias("dim_key")).distinct()
    joined = keys.join(known, F.col("fact_key") == F.col("dim_key"), "left")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return joined.agg(count(F.col("fact_key").isNotNull() & F.col("dim_key").isNull()).alias("orphan"), count(F.col("fact_key").isNull()).alias("missing"))


def relationship_checks(spec: Spec, fact: DataFrame, tables: dict[str, DataFrame], targets: dict[str, str] | None = None) -> DataFrame:
    """orphans() for every declared relationship of a spec, one row each."""
    out = None
    for link in spec.relationships:
        one = orphans(fact, link.column, tables[link.to], (targets or {}).get(link.column, link.column))
        row = one.select(F.lit(spec.name).alias("spec"), F.lit(link.column).alias("column"), F.lit(link.to).alias("to"), "orphan", "missing")
        out = row if out is None else out.union(row)
    return out


def ranges(versions: DataFrame, key: list[str]) -> DataFrame:
    """overlaps, gaps, inverted: faults of version ranges."""
    after = F.lead("effective_from").over(Window.partitionBy(*key).orderBy("effective_from", "effective_to"))
    faults = overlaps(F.col("after"))
    return versions.withColumn("after", after).agg(*[F.count_if(c).alias(n) for n, c in faults.items()])


def current_rows(versions: DataFrame, key: list[str], deletions: DataFrame | None = None) -> DataFrame:
    """several, none, unexplained: keys with more than one current row, without one, and without one although not deleted."""
    counts = versions.groupBy(*key).agg(F.sum(F.col("is_current").cast("int")).alias("n"))
    gone = counts if deletions is None else counts.join(deletions.select(*key, F.lit(True).alias("deleted")), key, "left")
    reason = F.lit(False) if deletions is None else F.coalesce("deleted", F.lit(False))
    return gone.agg(F.count_if(F.col("n") > 1).alias("several"), F.count_if(F.col("n") == 0).alias("none"), F.count_if((F.col("n") == 0) & ~reason).alias("unexplained"))


def same_day_versions(versions: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """days: pairs of key and day on which more than one version opened."""
    days = versions.groupBy(*key, F.to_date(sequence).alias("day")).count().where("count > 1")
    return days.agg(F.count(F.lit(1)).alias("days"))


def version_profile(versions: DataFrame, key: list[str]) -> DataFrame:
    """keys, least, greatest, mean: versions per key."""
    counts = versions.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("keys"), F.min("n").alias("least"), F.max("n").alias("greatest"), F.round(F.avg("n"), 6).alias("mean"))


def idle_versions(versions: DataFrame, key: list[str], tracked: list[str]) -> DataFrame:
    """idle: versions that change nothing against the one before them."""
    order = Window.partitionBy(*key).orderBy("effective_from")
    marked = versions.withColumns({"nth": F.row_number().over(order)} | {f"was_{c}": F.lag(c).over(order) for c in tracked})
    same = ~differs(tracked, {c: F.col(f"was_{c}") for c in tracked})
    return marked.agg(F.count_if((F.col("nth") > 1) & same).alias("idle"))


def keys_lost(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """lost, added: keys of one layer that the other lacks, either way."""
    side = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(1))
    both = side(before, "b").join(side(after, "a"), key, "full")
    return both.agg(F.count_if(F.col("a").isNull()).alias("lost"), F.count_if(F.col("b").isNull()).alias("added"))


def column_faults(df: DataFrame, spec: Spec) -> list[str]:
    """Columns whose type is not the declared one, and surrogate keys below gold."""
    kinds = dict(df.dtypes)
    found = [f"{a.name}: {kinds.get(a.name)}" for a in spec.attributes if kinds.get(a.name, "").replace("timestamp_ntz", "timestamp") != a.data_type.simpleString()]
    return found + [f"{c}: surrogate key below gold" for c in df.columns if spec.layer != "gold" and c.endswith("_sk")]


def resolved_in_time(facts: DataFrame, versions: DataFrame, key: str, at: str) -> DataFrame:
    """outside, historic: facts beyond the range of the version they point to, and facts on versions that are no longer current."""
    right = versions.select(F.col(key), "effective_from", "effective_to", "is_current")
    joined = facts.select(key, at).join(right, key)
    inside = (F.col(at) >= F.col("effective_from")) & (F.col(at) < F.col("effective_to"))
    return joined.agg(F.count_if(~inside).alias("outside"), F.count_if(~F.col("is_current")).alias("historic"))


def reconcile(left: DataFrame, right: DataFrame, on: list[str], measures: list[str], tolerance: float = 0.01) -> DataFrame:
    """One row per key whose sums differ by more than ``tolerance`` between two frames, absent as zero."""
    sums = lambda df, p: df.groupBy(*on).agg(*[F.sum(m).alias(f"{p}_{m}") for m in measures])
    both = sums(left, "left").join(sums(right, "right"), on, "full")
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    faults = [F.abs(value(f"left_{m}") - value(f"right_{m}")) > tolerance for m in measures]
    return both.where(F.array_contains(F.array(*faults), True))


def outside_life(snapshot: DataFrame, entities: DataFrame, key: str, opened: str, closed: str) -> DataFrame:
    """early, late: days of a snapshot before an entity opened, and from its closing on."""
    day = F.to_date(F.col("date_key").cast("string"), "yyyyMMdd")
    joined = snapshot.select(key, day.alias("day")).join(entities.select(key, opened, closed), key)
    return joined.agg(F.count_if(F.col("day") < F.col(opened)).alias("early"), F.count_if(F.col("day") >= F.col(closed)).alias("late"))


def milestones(facts: DataFrame, ordered: list[str], horizon: Column | None = None) -> DataFrame:
    """disordered, beyond: rows whose known milestones are out of order, and those closed after the horizon."""
    wrong = [F.coalesce(F.col(a) > F.col(b), F.lit(False)) for a, b in zip(ordered, ordered[1:], strict=False)]
    late = F.lit(False) if horizon is None else F.coalesce(F.col(ordered[-1]) > horizon, F.lit(False))
    return facts.agg(F.count_if(F.array_contains(F.array(*wrong), True)).alias("disordered"), F.count_if(late).alias("beyond"))


def populations(df: DataFrame, **kinds: Column) -> DataFrame:
    """How many rows are of each stated kind."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in kinds.items()])


def batch_totals(bronze: DataFrame, batch: str = "_batch_id") -> DataFrame:
    return bronze.groupBy(batch).agg(F.count(F.lit(1)).alias("rows")).orderBy(batch)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One number for a whole table, the same for any order of its rows and columns: 52 bits of each row's MD5, summed up."""
    small = F.conv(F.substring(F.md5(fingerprint(*sorted(df.columns))), 1, 13), 16, 10).cast("decimal(18,0)")
    return df.agg((F.coalesce(F.sum(small), F.lit(0)) % F.lit(10**13).cast("decimal(18,0)")).cast("long").alias("fingerprint"))
