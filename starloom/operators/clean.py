"""Coercion and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.spec import Spec


def coerce(df: DataFrame, spec: Spec, *also: str) -> DataFrame:
    """The declared attributes in their declared types, and columns ``also``; text that does not fit its type becomes null."""
    return df.select(*[F.col(a.name).try_cast(a.data_type).alias(a.name) for a in spec.attributes], *also)


def latest_rows(df: DataFrame, key: list[str], sequence: str, tiebreak: list[str] | None = None) -> DataFrame:
    """One row per key: the greatest sequence value, ties by the least of all other columns in order.

    A total order over the whole row makes the winner the same whatever the partitioning. Null
    sequence values lose; null keys are one group.
    """
    rest = tiebreak if tiebreak is not None else [c for c in df.columns if c not in (*key, sequence)]
    order = Window.partitionBy(*key).orderBy(F.col(sequence).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in rest])
    (rank,) = _free(df, "rank_in_key")
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)


def deduplicate(df: DataFrame, spec: Spec) -> DataFrame:
    """latest_rows() by the spec's key and sequence over its attributes."""
    own = [c for c in spec.columns if c not in (*spec.business_key, spec.sequence_by)]
    return latest_rows(df, list(spec.business_key), spec.sequence_by, own)


def exact_rows(df: DataFrame) -> DataFrame:
    """Each distinct row once."""
    return df.dropDuplicates()


def _free(df: DataFrame, *names: str) -> list[str]:
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out
