"""What the two operators on repeated word runs share: minimiser rows, lists by text, spans and kept words.

A run of ``window`` words holds at least one minimiser phrase, chosen by content alone, so equal runs
have it at the same place. A place in a text is ``loc``: 31 bits that tell texts of one doc_id apart, then the
word's number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm._shared import small, text_slices
from starloom.llm._words import Words, minimisers, split_words

LOW = 0xFFFFFFFF


def places(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: its text and its place in that text."""
    text = np.repeat(np.arange(len(words.offsets) - 1), words.counts)
    return text, np.arange(len(text)) - words.offsets[text]


def tag_of(loc: Column) -> Column:
    return F.shiftright(loc, 32)


def tagged_texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, text, tag: 31 bits that tell texts of one doc_id apart, or 0 throughout if no id repeats; and each text of a known doc_id once."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    repeats = lambda df, *key: not df.where("doc_id is not null").groupBy(*key).count().where("count > 1").isEmpty()
    if not repeats(rows, "doc_id"):
        tagged = rows.withColumn("tag", F.lit(0).cast("long"))
        return tagged, tagged.where("doc_id is not null")
    tagged = rows.withColumn("tag", F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)))
    known = tagged.where("doc_id is not null")
    return tagged, known.dropDuplicates(["doc_id", "tag"]) if repeats(tagged, "doc_id", "tag") else known


def minimiser_rows(known: DataFrame, window: int, phrase: int) -> DataFrame:
    """key, doc_id, loc: every minimiser phrase of every text."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("loc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            words = split_words(batch.column("text"))
            at, keys = minimisers(words, phrase, window - phrase + 1)
            text, place = places(words)
            text, place = text[at], place[at]
            locs = (batch.column("tag").to_numpy()[text] << 32) | place
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(batch.column("doc_id").to_numpy()[text]), pa.array(locs)], schema=schema)

    return known.select("doc_id", "tag", "text").mapInArrow(run, "key long, doc_id long, loc long")


def with_lists(tagged: DataFrame, lists: DataFrame, column: str, bytes_each: int = 8, how: str = "left") -> DataFrame:
    """``tagged`` with each text's list; the lists are broadcast only if their measured size allows it."""
    size = lists.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(column)).alias("m")).first()
    renamed = lists.withColumnsRenamed({"doc_id": "l_id", "tag": "l_tag"})
    named = small(renamed, 1, 32 * size["n"] + bytes_each * (size["m"] or 0))
    return tagged.join(named, (F.col("doc_id") == F.col("l_id")) & (F.col("tag") == F.col("l_tag")), how).drop("l_id", "l_tag")


def merged_spans(spans: DataFrame) -> DataFrame:
    """doc_id, tag, spans: of rows (doc_id, tag, start, length), the spans of each text as (start << 32 | words), those that touch as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            x, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((x, row))
            x, row = x[order], row[order]
            # Rows lie far apart on one axis, so that one running maximum serves all of them.
            lo = (x >> 32) + (row << 33)
            reach = np.maximum.accumulate(lo + (x & LOW)) if len(x) else lo
            first = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]])) if len(x) else np.zeros(0, np.int64)
            last = np.concatenate([first[1:], [len(x)]]).astype(np.int64)[: len(first)] - 1
            out = ((x[first] >> 32) << 32) | (reach[last] - lo[first])
            at = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(sizes)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.ListArray.from_arrays(pa.array(at), pa.array(out))], names=["doc_id", "tag", "spans"])

    packed = spans.select("doc_id", "tag", F.shiftleft("start", 32).bitwiseOR(F.col("length")).alias("span"))
    return packed.groupBy("doc_id", "tag").agg(F.collect_set("span").alias("spans")).mapInArrow(run, "doc_id long, tag long, spans array<long>")


def covered(words: Words, lists: pa.ListArray) -> np.ndarray:
    """For each word, whether some span of its text covers it."""
    spans = lists.flatten().to_numpy()
    base = np.repeat(words.offsets[:-1], lists.value_lengths().fill_null(0).to_numpy())
    marks = np.zeros(len(words.starts) + 1, np.int32)
    lo = base + (spans >> 32)
    np.add.at(marks, lo, 1)
    np.add.at(marks, lo + (spans & LOW), -1)
    return np.cumsum(marks)[:-1] > 0


def joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of each text's kept words joined by one space."""
    text = np.repeat(np.arange(len(words.offsets) - 1), words.counts)[keep]
    starts, ends = words.starts[keep], words.ends[keep]
    more = np.concatenate([text[1:] == text[:-1], [False]]) if len(text) else np.zeros(0, bool)
    data = words.data.copy()
    data[ends[more]] = 0x20
    marks = np.zeros(len(data) + 2, np.int8)
    marks[starts] += 1
    np.subtract.at(marks, ends + more, 1)
    sizes = np.bincount(text, weights=ends - starts + more, minlength=len(words.offsets) - 1).astype(np.int64)
    return data[np.cumsum(marks, dtype=np.int8)[: len(data)].astype(bool)], np.concatenate([[0], np.cumsum(sizes)])
