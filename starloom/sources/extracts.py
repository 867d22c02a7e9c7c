"""Reading dated extracts: declared columns by name as text, the rest kept as JSON, lineage beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.spec import Spec


class MissingColumns(ValueError):
    """An extract without a declared column."""


def read_extract(spark: SparkSession, spec: Spec, path: str, batch_id: str, now: Column | None = None) -> DataFrame:
    """The extract at ``path`` as bronze rows.

    Declared columns are taken by name, so the order in the file is free, and stay text. Undeclared
    ones are kept in _rescued_data. A declared column that is missing is an error. Any path that
    Spark can read will do.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = [c for c in spec.columns if c not in raw.columns]
    if missing:
        raise MissingColumns(f"{spec.name}: {path} lacks {', '.join(missing)}")
    extra = [c for c in raw.columns if c not in spec.columns]
    rescued = F.to_json(F.struct(*[F.col(f"`{c}`") for c in extra])) if extra else F.lit(None).cast("string")
    return raw.select(
        *[F.col(f"`{c}`").cast("string").alias(c) for c in spec.columns],
        (F.current_timestamp() if now is None else now).alias("_ingest_ts"),
        F.lit(path).alias("_source_file"),
        F.lit(batch_id).alias("_batch_id"),
        rescued.alias("_rescued_data"),
    )


def batch_of(bronze: DataFrame, batch_id: str) -> DataFrame:
    """One batch; a partition filter where the table is partitioned by _batch_id."""
    return bronze.where(F.col("_batch_id") == batch_id)


def integers(spark: SparkSession, n: int, modulus: int) -> DataFrame:
    """bucket: 0 to n - 1 modulo ``modulus``, to prove that a session works."""
    return spark.range(n).select((F.col("id") % modulus).alias("bucket"))
