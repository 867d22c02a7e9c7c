"""Storage and batching helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one side of a join may hold at most to be broadcast.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where the setting is missing, only a local session gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="starloom-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there.

    The table outlives lost executors; the caller's folder policy removes it after the job.
    """
    path = f"{shared_dir(df.sparkSession)}/starloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage: only then does Spark delete the shuffle files of finished steps.

    For steps whose shuffle is of the order of the input, so that disks hold one of them at a time.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, bytes_per_row: int, rows: int) -> DataFrame:
    """``df``, marked for broadcast only if its measured ``rows`` stay within BROADCAST_BYTES."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names near ``names`` that do not clash (in any case) with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of whole rows of about ``max_bytes`` of text; no row is split or dropped."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, begin = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(begin, i - begin)
                total, begin = 0, i
            total += int(n)
        yield batch.slice(begin)
