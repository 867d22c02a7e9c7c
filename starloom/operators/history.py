"""Versioned history: timelines rebuilt from all landed rows, and deletions read from snapshot absence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.columns import beginning, differs, forever
from starloom.operators.clean import _free, latest_rows
from starloom.operators.upsert import close_versions, replace_keys
from starloom.spec import Spec

MOST_DELETED = 0.10


class EmptySnapshot(ValueError):
    """A full snapshot without rows: reading it as a deletion of everything is refused."""


class MassDeletion(ValueError):
    """More of the open keys would be closed than the stated share."""


def timeline(history: DataFrame, key: list[str], sequence: str, tracked: list[str]) -> DataFrame:
    """One row per version: ``history``'s columns with effective_from, effective_to and is_current.

    Order of arrival does not matter. One row per (key, sequence) survives, the least of all other
    columns; a row opens a version if any tracked column is distinct from the row before it, and
    other columns keep the value they had then. Ranges are half-open and contiguous; the first opens
    at the beginning of time. A null sequence sorts first. One shuffle by key serves every step.
    """
    seq = history.schema[sequence].dataType.simpleString()
    rest = [c for c in history.columns if c not in (*key, sequence)]
    one = latest_rows(history.repartition(*key), [*key, sequence], sequence, [*tracked, *[c for c in rest if c not in tracked]])
    order = Window.partitionBy(*key).orderBy(F.col(sequence).asc_nulls_first())
    nth, *before = _free(one, "nth", *[f"before_{c}" for c in tracked])
    marked = one.withColumns({nth: F.row_number().over(order)} | {b: F.lag(c).over(order) for b, c in zip(before, tracked, strict=True)})
    opened = marked.where((F.col(nth) == 1) | differs(tracked, {c: F.col(b) for c, b in zip(tracked, before, strict=True)}))
    later = F.lead(sequence).over(order)
    return opened.select(
        *history.columns,
        F.when(F.col(nth) == 1, beginning(seq)).otherwise(F.col(sequence)).alias("effective_from"),
        F.coalesce(later, forever(seq)).alias("effective_to"),
        later.isNull().alias("is_current"),
    )


def rebuild_timeline(history: DataFrame, spec: Spec) -> DataFrame:
    """timeline() of a spec's attributes."""
    return timeline(history.select(*spec.columns), list(spec.business_key), spec.sequence_by, spec.tracked)


def snapshot_deletions(landed: DataFrame, key: list[str], batch: str = "_batch_id", kind: str = "timestamp") -> DataFrame:
    """key, deleted_ts: keys missing from all batches after some batch, deleted as of the next one.

    A gap that ends is no deletion, and one batch proves none. The list of batches stays a frame
    of one row a batch, so nothing passes through the driver.
    """
    last = landed.groupBy(*key).agg(F.max(batch).alias("last_batch"))
    batches = landed.select(F.col(batch).alias("last_batch")).distinct()
    follows = batches.withColumn("next_batch", F.lead("last_batch").over(Window.orderBy("last_batch"))).where("next_batch is not null")
    return last.join(follows, "last_batch").select(*key, F.col("next_batch").cast(kind).alias("deleted_ts"))


def refuse_empty(incoming: DataFrame, spec: Spec) -> DataFrame:
    """``incoming``, or EmptySnapshot where absence means deletion and there is no row."""
    if spec.absence_means_deletion and incoming.isEmpty():
        raise EmptySnapshot(f"{spec.name}: a snapshot without rows would delete every key")
    return incoming


def closure_split(versions: DataFrame, deletions: DataFrame, key: list[str]) -> DataFrame:
    """applied, refused: deletions that close a current version, and those that would end it before it began."""
    joined = versions.where("is_current").join(deletions, key)
    fits = F.col("effective_from") < F.col("deleted_ts")
    return joined.agg(F.count_if(fits).alias("applied"), F.count_if(~fits).alias("refused"))


def guard_deletions(versions: DataFrame, deletions: DataFrame, key: list[str], most: float = MOST_DELETED, only_new: bool = False) -> float:
    """The share of open keys that deletions take; MassDeletion above ``most``.

    By default all derived deletions count, over keys that are open now; ``only_new`` counts those
    that would close something.
    """
    current = versions.where("is_current").select(*key, F.lit(1).alias("open"))
    both = current.join(deletions.select(*key, F.lit(1).alias("gone")), key, "left" if only_new else "full")
    n, of = both.agg(F.count("gone"), F.count("open")).first()
    share = n / of if of else 0.0
    if share > most:
        raise MassDeletion(f"{n} of {of} open keys would be closed, above {most:.0%}")
    return share


def apply_deletions(versions: DataFrame, deletions: DataFrame, key: list[str]) -> DataFrame:
    """close_versions(): ranges are never inverted, because later openings refuse the closure."""
    return close_versions(versions, deletions, key)


def rebuild_all(landed: DataFrame, spec: Spec, batch: str = "_batch_id") -> DataFrame:
    """The whole versioned table as a pure function of everything that has landed."""
    key, kind = list(spec.business_key), landed.schema[spec.sequence_by].dataType.simpleString()
    versions = rebuild_timeline(landed, spec)
    if not spec.absence_means_deletion:
        return versions
    return apply_deletions(versions, snapshot_deletions(landed, key, batch, kind), key)


def advance(stored: DataFrame, landed: DataFrame, spec: Spec, batch_id: object, batch: str = "_batch_id") -> DataFrame:
    """The versioned table after one more batch: the timelines of its keys are rebuilt from all landed rows.

    Keys that are missing at the end are rebuilt too, because the batch may move the instant of their
    deletion. The result is one frame, to be published once, and equals rebuild_all() for any order
    of landing and processing.
    """
    key, kind = list(spec.business_key), landed.schema[spec.sequence_by].dataType.simpleString()
    affected = landed.where(F.col(batch) == F.lit(batch_id)).select(*key)
    if spec.absence_means_deletion:
        gone = snapshot_deletions(landed, key, batch, kind)
        affected = affected.union(gone.select(*key))
    affected = affected.distinct()
    rebuilt = rebuild_timeline(landed.join(affected, key, "left_semi"), spec)
    if spec.absence_means_deletion:
        rebuilt = apply_deletions(rebuilt, gone, key)
    return replace_keys(stored, rebuilt, affected, key)


def overlaps(next_from: Column) -> dict[str, Column]:
    """Faults between a version and the one that follows it."""
    return {"overlaps": next_from < F.col("effective_to"), "gaps": (next_from > F.col("effective_to")), "inverted": F.col("effective_to") <= F.col("effective_from")}
