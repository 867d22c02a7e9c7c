"""Substring dedup by relative Lempel-Ziv parsing against blocks of earlier documents.

1. Each minimiser phrase of a window has a first document. Its surroundings there are reference text, in
   the block of 2**BLOCK_BITS ids that the document belongs to; where the phrase occurs in a later
   document, its surroundings are a request to that block. So a document meets every block that
   can hold an earlier copy of what it has, and no other.
2. A block's references are indexed by a suffix array; requests are factored greedily: the longest
   factor that the block's earlier documents hold, then the next one behind it. Factors of ``window``
   words or more are duplicate spans, and so are windows across factor boundaries that the index holds.
3. A window that its block does not hold, although the block has its phrase, is open: a document between
   the first one and this one may hold it. Open windows meet by their 128-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm._repeats import LOW, covered, joined, merged_spans, minimiser_rows, tag_of, tagged_texts, with_lists
from starloom.llm._shared import materialize, release, small, text_slices
from starloom.llm._words import mix, phrases, split_words

#: Bits of an id within its block; requested phrases that one task compares with a block's references at most; words of a
#: piece of text, of which longer ones are cut, overlapping; and words that one index holds, if pieces allow.
BLOCK_BITS, TASK_PHRASES, PIECE_WORDS, INDEX_WORDS = 4, 1 << 13, 1 << 16, 1 << 18
_SEEDS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _pieces(window: int, phrase: int, piece_words: int):
    """Reference and requested stretches of words around the listed phrases, one row each."""
    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("asks", pa.bool_()), ("start", pa.int64()), ("words", pa.binary()), ("places", pa.binary())])
    margin = window - phrase

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            words = split_words(batch.column("text"))
            lists = batch.column("hits")
            flat = lists.flatten()
            place, ref, parts = (flat.field(k).to_numpy() for k in range(3))
            text = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            ids = batch.column("doc_id").to_numpy()
            asks, block = ref != ids[text], ref >> BLOCK_BITS
            order = np.lexsort((place, asks, block, text))
            place, text, block, asks, parts = (x[order] for x in (place, text, block, asks, parts))
            lo = np.maximum(place - margin, 0)
            hi = np.minimum(place + window, words.counts[text])
            if not len(place):
                continue
            apart = (text[1:] != text[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1]) | (lo[1:] > hi[:-1])
            # Pieces end after piece_words at the next phrase; phrases have their whole surroundings in their piece.
            group = np.concatenate([[0], np.cumsum(apart)])
            begins = np.flatnonzero(np.concatenate([[True], apart]))
            within = (lo - lo[begins][group]) // piece_words
            cut = np.concatenate([[True], apart | (within[1:] != within[:-1])])
            first = np.flatnonzero(cut)
            last = np.concatenate([first[1:], [len(place)]]) - 1
            tags = batch.column("tag").to_numpy()
            dealt = mix(mix(ids[text[first]].astype(np.uint64)) ^ lo[first].astype(np.uint64)) % parts[first].astype(np.uint64)
            out: list[list] = [[] for _ in schema]
            for a, b, part in zip(first.tolist(), last.tolist(), dealt.tolist(), strict=True):
                i, base = text[a], words.offsets[text[a]]
                data = words.hashes[base + lo[a] : base + hi[b]].tobytes()
                own = (place[a : b + 1] - lo[a]).astype(np.int32).tobytes() if asks[a] else b""
                for p in [part] if asks[a] else range(parts[a]):
                    for column, value in zip(out, (block[a], p, ids[i], tags[i], asks[a], lo[a], data, own), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


class Index:
    """A suffix array of reference and requested words, with the ranks of each doubling, for longest common prefixes."""

    def __init__(self, tokens: np.ndarray, longest: int):
        self.size = len(tokens)
        rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
        self.levels, width = [rank.astype(np.int32)], 1
        while width <= longest and rank.max(initial=0) + 1 < self.size:
            after = np.zeros(self.size, np.int64)
            after[:-width] = rank[width:] + 1
            rank = np.unique(rank * (self.size + 1) + after, return_inverse=True)[1]
            self.levels.append(rank.astype(np.int32))
            width *= 2
        self.order = np.argsort(rank)
        self.place = np.empty(self.size, np.int64)
        self.place[self.order] = np.arange(self.size)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``x`` and ``y`` have in common; 0 where ``y`` is negative."""
        total = np.zeros(len(x), np.int64)
        live = np.flatnonzero(y >= 0)
        for level in range(len(self.levels) - 1, -1, -1):
            a, b = x[live] + total[live], y[live] + total[live]
            inside = np.maximum(a, b) < self.size
            same = inside.copy()
            same[inside] = self.levels[level][a[inside]] == self.levels[level][b[inside]]
            total[live[same]] += 1 << level
        return total

    def longest(self, asked: np.ndarray, known: np.ndarray) -> np.ndarray:
        """For suffixes at ``asked``, the longest prefix that begins at a place marked in ``known``."""
        marks = known[self.order]
        at = np.where(marks, np.arange(self.size), -1)
        before = np.maximum.accumulate(at)
        after = np.minimum.accumulate(np.where(marks, np.arange(self.size), self.size)[::-1])[::-1]
        here = self.place[asked]
        pick = lambda i, ok: np.where(ok, self.order[np.clip(i, 0, self.size - 1)], -1)
        return np.maximum(self.common(asked, pick(before[here], before[here] >= 0)), self.common(asked, pick(after[here], after[here] < self.size)))


def greedy_factors(length: np.ndarray, begin: int, end: int, least: int) -> list[tuple[int, int]]:
    """The factors of at least ``least`` words of a parse from ``begin``: always the longest one, then on behind it."""
    out, steps = [], length[begin:end].tolist()
    at, n = 0, end - begin
    while at < n:
        step = steps[at]
        if step >= least:
            out.append((begin + at, step))
        at += step or 1
    return out


def _factored(window: int, phrase: int, index_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def solved(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(r["words"]) // 8 for r in rows])
        # A mark that occurs once ends each piece, so no match runs into the next.
        base = np.concatenate([[0], np.cumsum(sizes + 1)])
        raw = np.empty(base[-1], np.uint64)
        for r, a, n in zip(rows, base[:-1], sizes, strict=True):
            raw[a : a + n] = np.frombuffer(r["words"], np.uint64)
        piece = np.repeat(np.arange(len(rows)), sizes + 1)
        ends = base[1:] - 1
        raw[ends] = mix(np.arange(len(rows), dtype=np.uint64) + np.uint64(1))
        group = np.array([r["group"] for r in rows], np.uint64)
        tokens = mix(raw ^ mix(group[piece] + np.uint64(77)))
        asks = np.array([r["asks"] for r in rows])
        docs = np.array([r["doc_id"] for r in rows], np.int64)
        blocks = np.array([r["block"] for r in rows], np.int64)
        index = Index(tokens, int(sizes.max()) + 1)
        word = np.ones(len(raw), bool)
        word[ends] = False
        known, wanted = word & ~asks[piece], word & asks[piece]
        length = np.zeros(len(raw), np.int64)
        # Documents beyond the block are later than all of it; the others may only use earlier ones.
        inner, nth = asks & (docs >> BLOCK_BITS == blocks), docs & ((1 << BLOCK_BITS) - 1)
        outer = np.flatnonzero(wanted & ~inner[piece])
        length[outer] = index.longest(outer, known)
        for n in np.unique(nth[inner]):
            own = np.flatnonzero(wanted & (inner & (nth == n))[piece])
            length[own] = index.longest(own, known & (nth[piece] < n))
        own_phrase, h1, h2 = phrases(raw, phrase), *[phrases(raw, window, s) for s in _SEEDS]
        out: list[list[np.ndarray]] = [[], [], []]
        for k in np.flatnonzero(asks).tolist():
            a, b = int(base[k]), int(ends[k])
            if b - a < window:
                continue
            factors = greedy_factors(length, a, b, window)
            inside = np.zeros(b - a, bool)
            for s, n in factors:
                inside[s - a : s - a + n - window + 1] = True
            starts = np.arange(a, b - window + 1)
            fits = length[starts] >= window
            across = starts[fits & ~inside[: len(starts)]]
            runs = np.flatnonzero(np.concatenate([[True], across[1:] != across[:-1] + 1])) if len(across) else across
            sizes_ = np.diff(np.concatenate([runs, [len(across)]]))
            out[0].append(np.array([(k, s, n) for s, n in factors] + [(k, s, window + n - 1) for s, n in zip(across[runs].tolist(), sizes_.tolist(), strict=True)], np.int64).reshape(-1, 3))
            # A window is judged where its own phrase, the first of the least, is asked for.
            choices = np.lib.stride_tricks.sliding_window_view(own_phrase[a : b - phrase + 1], window - phrase + 1)
            least = choices.argmin(axis=1) + np.arange(len(choices))
            asked = np.zeros(b - a, bool)
            asked[np.frombuffer(rows[k]["places"], np.int32)] = True
            open_ = starts[~fits & asked[least]]
            out[1].append(np.full(len(open_), k))
            out[2].append(open_)
        spans = np.concatenate([np.zeros((0, 3), np.int64), *out[0]])
        k, at = (np.concatenate([np.zeros(0, np.int64), *x]) for x in out[1:])
        tags, first = (np.array([r[c] for r in rows], np.int64) for c in ("tag", "start"))
        none = pa.nulls(len(spans), pa.int64())
        s = spans[:, 0]
        yield pa.RecordBatch.from_arrays([pa.array(docs[s]), pa.array(tags[s]), pa.array(first[s] + spans[:, 1] - base[s]), pa.array(spans[:, 2]), none, none], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array(docs[k]), pa.array(tags[k]), pa.array(first[k] + at - base[k]), pa.array(np.full(len(k), window)), pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        key, total, number, asked = None, 0, 0, False
        begin = 0
        for batch in batches:
            for row in batch.to_pylist():
                if (row["block"], row["part"]) != key:
                    if not asked:
                        total -= sum(len(r["words"]) // 8 for r in held[begin:])
                        del held[begin:]
                    if total >= index_words:
                        yield from solved(held)
                        held, total = [], 0
                    key, number, asked, begin = (row["block"], row["part"]), number + 1, False, len(held)
                row["group"] = number
                asked = asked or row["asks"]
                total += len(row["words"]) // 8
                held.append(row)
        if not asked:
            del held[begin:]
        if held:
            yield from solved(held)

    return run


def find_repeats(known: DataFrame, window: int, phrase: int) -> DataFrame:
    """doc_id, tag, spans: per text that has any, the windows that also start in a document with a smaller doc_id (see merged_spans())."""
    spark = known.sparkSession
    rows = minimiser_rows(known, window, phrase)
    firsts = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("last")).where("ref < last").select("key", "ref"))
    release(spark)
    found = rows.join(firsts, "key").select("doc_id", tag_of(F.col("loc")).alias("tag"), F.col("loc").bitwiseAND(F.lit(LOW)).alias("place"), "ref")
    lists = found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("place", "ref")).alias("hits"))
    lists = materialize(lists)
    release(spark)
    block = F.shiftright("ref", BLOCK_BITS)
    loads = lists.select("doc_id", F.explode("hits.ref").alias("ref")).where("ref <> doc_id").groupBy(block.alias("l_block")).agg(F.ceil(F.count(F.lit(1)) / TASK_PHRASES).cast("int").alias("l_parts"))
    return _spans(known, lists, materialize(loads.where("l_parts > 1")), window, phrase)


def _spans(known: DataFrame, lists: DataFrame, loads: DataFrame, window: int, phrase: int) -> DataFrame:
    spark = known.sparkSession
    if not loads.isEmpty():
        hits = lists.select("doc_id", "tag", F.inline("hits")).join(small(loads, 24, loads.count()), F.shiftright("ref", BLOCK_BITS) == F.col("l_block"), "left")
        hits = hits.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("place", "ref", F.coalesce("l_parts", F.lit(1)).alias("parts"))).alias("hits"))
        lists = materialize(hits)
    else:
        lists = lists.withColumn("hits", F.transform("hits", lambda h: F.struct(h["place"].alias("place"), h["ref"].alias("ref"), F.lit(1).alias("parts"))))
    # Lists of hits grow with the texts, so both are dealt by document at every size.
    listed = lists.withColumnsRenamed({"doc_id": "l_id", "tag": "l_tag"})
    wide = known.join(listed, (F.col("doc_id") == F.col("l_id")) & (F.col("tag") == F.col("l_tag"))).select("doc_id", "tag", "text", "hits")
    pieces = wide.mapInArrow(_pieces(window, phrase, PIECE_WORDS), "block long, part int, doc_id long, tag long, asks boolean, start long, words binary, places binary")
    dealt = pieces.repartition("block", "part").sortWithinPartitions("block", "part")
    parsed = materialize(dealt.mapInArrow(_factored(window, phrase, INDEX_WORDS), "doc_id long, tag long, start long, length long, h1 long, h2 long"))
    release(spark)
    open_ = parsed.where("h1 is not null")
    best = materialize(open_.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").drop("last"))
    late = open_.join(small(best, 32, best.count()), ["h1", "h2"]).where("least < doc_id")
    spans = parsed.where("h1 is null").select("doc_id", "tag", "start", "length").union(late.select("doc_id", "tag", "start", "length"))
    spans = materialize(merged_spans(spans))
    release(spark)
    return spans


def _cleaned(with_text: bool):
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept_text", pa.string())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            words = split_words(batch.column("text"), hashed=False)
            gone = covered(words, batch.column("spans"))
            data, at = joined(words, ~gone)
            raw = [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            removed = pa.array([int(gone[a:b].sum()) for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)], pa.int64())
            columns = [batch.column("doc_id"), pa.array(words.counts), removed, pa.array([hashlib.sha256(x).hexdigest() for x in raw])]
            if with_text:
                columns.append(pa.array([x.decode() for x in raw], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def remove_repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text): one row per row of ``docs``.

    A word goes if a run of ``window`` words that covers it also starts in a document with a
    smaller doc_id; runs are judged on the input. Method: relative Lempel-Ziv. Documents are factored
    greedily against each indexed block of earlier documents that has one of their phrases; factors of
    ``window`` words or more, and windows across factor boundaries, are duplicate spans, and windows that
    a block leaves open are compared by 128-bit hashes (see this module's text). Words are compared
    by 64-bit hashes.

    Null, empty and short texts lose nothing; very long ones are parsed whole, in overlapping pieces. Rows with
    a null doc_id keep all words and are no reference. Rows that share a doc_id are judged each by its
    own text and never against each other; rows that repeat both give equal rows. Other columns are not
    read, whatever their names; an empty table gives no rows.
    """
    tagged, known = tagged_texts(docs, id_col, text_col)
    spans = find_repeats(known, window, window // 2 + 1)
    wide = with_lists(tagged, spans, "spans")
    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return wide.select("doc_id", "text", "spans").mapInArrow(_cleaned(with_text), kinds)
