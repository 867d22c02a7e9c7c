"""Best-fit packing of tokenised documents, certified by dual-feasible-function bounds."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm._shared import materialize, text_slices

#: The word pattern of byte-level BPE, and what tells plain texts, which two libraries cut alike.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RARE = re.compile("[^\x00-\u2fff]")
#: Texts this long go to the reference library, whose cost does not depend on the shape of words.
_LONG = 1 << 20


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer of the file, and a faster library with the same vocabulary where that is possible."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    exact = Tokenizer.from_file(path)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    if not plain or any(x.get(k) for x in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return exact, None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return exact, tiktoken.Encoding("of_file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(text: str, path: str) -> np.ndarray:
    """Token ids of one whole text, as the tokenizer of the file gives them without special tokens added."""
    exact, fast = _tokenizer(path)
    if fast is not None and len(text) < _LONG and not _RARE.search(text):
        return np.asarray(fast.encode(text, allowed_special="all"), np.uint32)
    return np.asarray(exact.encode(text, add_special_tokens=False).ids, np.uint32)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 2 << 20):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or "", path), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), *[ids[a:b].astype(np.int32)] * with_ids))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing of ``sizes`` needs at least, by dual feasible functions, in whole numbers.

    Threshold functions count items above capacity - e as one bin each, drop those below e and keep
    the rest; rounding functions take x to floor((k + 1) x / capacity) / k where that is not whole.
    """
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    mass, number = np.concatenate([[0], np.cumsum(count * x)]), np.concatenate([[0], np.cumsum(count)])
    e = np.arange(0, capacity // 2 + 1)
    big = number[-1] - number[capacity - e + 1]
    middle = mass[capacity - e + 1] - mass[e]
    best = int(np.max(-(-(big * capacity + middle) // capacity)))
    for k in range(1, 41):
        y = (k + 1) * x
        value = np.where(y % capacity == 0, x * k, capacity * (y // capacity))
        best = max(best, int(-(-int((count * value).sum()) // (capacity * k))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: largest first, each into the fullest bin that still holds it."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, made = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some &= ~(1 << room)
        else:
            room, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            free[left].append(b)
            some |= 1 << left
    return bins, offsets


def _pack_group(capacity: int, names: list[str]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        sizes = table.column("length").to_numpy()
        bins, offsets = best_fit_decreasing(sizes, capacity)
        used = np.bincount(bins, weights=sizes).astype(np.int64)
        certified = len(used) == lower_bound(sizes, capacity)
        out = table.select(names)
        for name, value in (("bin", bins), ("offset", offsets), ("settled", (used == capacity)[bins] | certified), ("group", np.full(len(sizes), key[0].as_py()))):
            out = out.append_column(name, pa.array(value))
        return out

    return run


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, group_rows: int = 100_000, rounds: int = 4, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): one row per piece.

    Each row's text becomes token ids and ``end_id``. Only longer documents than ``capacity`` are cut,
    into pieces of ``capacity`` ids of which the first may be shorter. Whole pieces are sequences of
    their own; the others are dealt at random to groups of about ``group_rows``, each packed by
    best-fit decreasing. A group that uses as many sequences as a dual-feasible bound proves
    necessary is final, and so are full sequences. Groups with a gap pool what their open sequences
    hold, exchange it and pack again, while that frees sequences, at most ``rounds`` times.

    Null and empty texts give the one id ``end_id``. Rows that repeat a doc_id, and null ids, are
    packed row by row. Other columns are not read; an empty table gives no rows.
    """
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialize(rows.mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), kinds).withColumn("row", F.monotonically_increasing_id()))
    names = [c for c in pieces.columns if c != "row"]
    done = [pieces.where(F.col("length") == capacity).select(*names, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    pool = pieces.where(F.col("length") < capacity)
    kinds = pool.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", bin long, offset long, settled boolean, group long"
    packer, size, bins, last = _pack_group(capacity, [*names, "row"]), pool.count(), None, None
    for turn in range(rounds):
        groups = max(1, -(-size // group_rows))
        dealt = pool.select(*names, "row", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)).alias("group"))
        packed = materialize(dealt.groupBy("group").applyInArrow(packer, kinds))
        packed = packed.withColumn("sequence_id", F.lit(turn) * (1 << 54) + F.col("group") * (1 << 27) + F.col("bin"))
        kept = F.when(~F.col("settled"), F.col("sequence_id"))
        found = packed.agg(F.countDistinct("sequence_id").alias("all"), F.countDistinct(kept).alias("bins"), F.count(kept).alias("rows")).first()
        if last is not None and found["all"] >= bins:
            break
        done.append(packed.where("settled").select(*names, "sequence_id", "offset"))
        last, bins, size = packed.where("not settled"), found["bins"], found["rows"]
        if not size or groups == 1:
            break
        pool = last
    out = last.select(*names, "sequence_id", "offset")
    for part in done:
        out = out.union(part)
    return out
