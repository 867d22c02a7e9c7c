"""Exact dedup in two passes with a Bloom filter, in DataFrame functions only.

The filter is cut to slices of 2**_SLICE bits; a hash sets two places of one slice. It always has about
BITS_PER_ROW bits a row: a filter within the bound is broadcast, a larger one is joined slice by slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm import _shared
from starloom.llm._shared import fresh, materialize

BITS_PER_ROW, _SLICE = 16, 15


def normalised(text: Column) -> Column:
    """The text with every run of 0x20 and 0x09-0x0D as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _slices_for(rows: int) -> int:
    return max(2, -(-rows * BITS_PER_ROW >> _SLICE))


def _slice(h: Column, slices: int) -> Column:
    return h.bitwiseAND(F.lit((1 << 34) - 1)) % F.lit(slices)


def _bits(h: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << _SLICE) - 1)) for shift in (34, 49)]


def bloom_filter(hashes: DataFrame, rows: int, repeated: bool) -> tuple[DataFrame, int]:
    """slice, bits of the column ``h``, and the number of slices; with ``repeated`` only places that two or more rows set."""
    slices = _slices_for(rows)
    placed = hashes.select(_slice(F.col("h"), slices).alias("slice"), F.explode(F.array(*_bits(F.col("h")))).alias("bit"))
    if repeated:
        placed = placed.groupBy("slice", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return materialize(placed.groupBy("slice").agg(F.bitmap_construct_agg(F.col("bit")).alias("bits"))), slices


def _fits(slices: int) -> bool:
    """Whether a filter is within the bound for broadcasts."""
    return (slices << _SLICE) // 8 <= _shared.BROADCAST_BYTES


def probed(df: DataFrame, hash_col: str, filter_: DataFrame, slices: int, flag: str) -> DataFrame:
    """``df`` with ``flag``: whether both places of the row's hash are set. No row moves where the filter is broadcast."""
    own = df.columns
    slice_, data = fresh(df, "slice", "bits")
    named = filter_.withColumnsRenamed({"slice": slice_, "bits": data})
    df = df.join(F.broadcast(named) if _fits(slices) else named, _slice(F.col(hash_col), slices) == F.col(slice_), "left")
    tests = []
    for bit in _bits(F.col(hash_col)):
        byte = F.conv(F.hex(F.substring(F.col(data), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        tests.append(F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False)))
    return df.select(*own, (tests[0] & tests[1]).alias(flag))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    sha = F.sha2(normalised(F.col(text_col)), 256)
    return materialize(docs.select(F.col(id_col).alias("doc_id"), sha.alias("text_sha256")).withColumn("h", F.xxhash64("text_sha256")))


def _groups(flagged: DataFrame) -> DataFrame:
    return materialize(flagged.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.first("h").alias("h")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Texts are equal if identical after white-space runs become one space. First pass: hash every
    text, and build the Bloom filter of hashes that may repeat; two places of a few bytes a row are counted,
    with partial sums. Second pass: rows outside the filter are unique and pass straight through; only the
    others, repeats and some 2 % of the rest, are grouped by their SHA-256. A filter above the bound for
    broadcasts is joined by slice: then ids and hashes move once, texts never.

    Null counts as empty; very long texts are hashed whole. The smallest doc_id of a group stays; rows that
    share that id share the verdict. A null id stays only in a group without ids. Other columns are not
    read, whatever their names; an empty table gives no rows.
    """
    hashed = _hashed(docs, id_col, text_col)
    filter_, slices = bloom_filter(hashed, hashed.count(), True)
    judged = probed(hashed, "h", filter_, slices, "maybe")
    maybe = judged.where("maybe")
    alone = judged.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    together = maybe.drop("h").join(_groups(maybe).drop("h"), "text_sha256")
    return alone.union(together.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that exact_duplicates() does not keep: whole rows, all columns.

    The same two passes on ids and hashes find the groups of two or more; a Bloom filter of these alone
    then lets the whole rows of all other texts pass straight through, and only possible members of groups
    shuffle. If even that filter is above the bound for broadcasts, all rows meet the groups by hash.

    Null counts as empty, very long texts are hashed whole, and rows that share the kept id stay together. A
    null id stays only in a group without ids. Names never clash with the columns; an empty table stays empty.
    """
    hashed = _hashed(docs, id_col, text_col)
    filter_, slices = bloom_filter(hashed, hashed.count(), True)
    groups = materialize(_groups(probed(hashed, "h", filter_, slices, "maybe").where("maybe")).where("group_size > 1"))
    sha, h, flag, keep, size = fresh(docs, "exact_sha", "exact_hash", "exact_maybe", "exact_keep", "exact_size")
    wide = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)), 256)).withColumn(h, F.xxhash64(sha))
    named = groups.select(F.col("text_sha256").alias(f"{sha}_"), F.col("keep_id").alias(keep))
    rows = groups.count()
    if not _fits(_slices_for(rows)):
        joined = wide.join(named, F.col(sha) == F.col(f"{sha}_"), "left")
        return joined.where(F.col(f"{sha}_").isNull() | F.col(id_col).eqNullSafe(F.col(keep))).select(*docs.columns)
    marked = probed(wide, h, *bloom_filter(groups, rows, False), flag)
    member = marked.where(flag).join(named, F.col(sha) == F.col(f"{sha}_"), "left")
    member = member.where(F.col(f"{sha}_").isNull() | F.col(id_col).eqNullSafe(F.col(keep)))
    return marked.where(~F.col(flag)).select(*docs.columns).union(member.select(*docs.columns))
