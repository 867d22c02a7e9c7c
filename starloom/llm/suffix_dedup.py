"""Dedup of long passages by a sparse suffix array over minimiser positions.

1. Retained suffixes begin at minimiser phrases that occur more than once.
2. Along each text, touching phrases chain up. A suffix is ordered by its phrase and the chains to its
   right and left; in that order neighbours that agree are equal on every window around the phrase, so only
   the first of them goes on.
3. The others are sorted by phrase and the words that follow. Neighbours are compared: the lengths of
   their common prefixes cut the order into intervals, one set of intervals for each number of words to
   the right. Within an interval suffixes are extended to the left by as many words as a window still
   needs, and the first place of each extension is what the others repeat.
4. A phrase with too many suffixes for one task is dealt to several; the first places that each of these
   finds meet once more by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm._repeats import covered, joined, merged_spans, minimiser_rows, tag_of, tagged_texts, with_lists
from starloom.llm._shared import materialize, release, small, text_slices
from starloom.llm._words import mix, split_words

#: Suffixes with contexts that a task is meant to hold, and of one phrase.
TASK_ROWS, PHRASE_ROWS = 40_000, 20_000
_CHAIN, _LEFT, _SPLIT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def chains(keys: np.ndarray, gaps: np.ndarray, joint: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in text order: a hash of the (gap, phrase) that follow until ``reach`` words are gone through,
    and whether the chain got that far. ``joint`` says whether a suffix and the next touch, ``gaps`` how far apart they are."""
    n = len(keys)
    out, total, at = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.arange(n)
    broken, active = np.zeros(n, bool), np.arange(n)
    while len(active):
        here = at[active]
        on = np.zeros(len(active), bool)
        inner = here < n - 1
        on[inner] = joint[here[inner]]
        broken[active[~on]] = True
        active, here = active[on], here[on]
        total[active] += gaps[here]
        at[active] = here + 1
        out[active] = mix(out[active] * _CHAIN ^ keys[here + 1] ^ mix(gaps[here].astype(np.uint64)))
        active = active[total[active] < reach]
    return out, ~broken


def _chained(phrase: int, reach: int):
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("loc", pa.int64()), ("right", pa.int64()), ("left", pa.int64()), ("late", pa.bool_())])

    def emit(keys: np.ndarray, ids: np.ndarray, locs: np.ndarray) -> pa.RecordBatch:
        names = keys.view(np.uint64)
        gaps = np.diff(locs)
        joint = (ids[1:] == ids[:-1]) & (gaps <= phrase)
        right, far = chains(names, gaps, joint, reach)
        left, back = chains(names[::-1], gaps[::-1], joint[::-1], reach)
        own = mix(ids.astype(np.uint64) * _CHAIN ^ mix(locs.astype(np.uint64)))
        right, left = np.where(far, right, own), np.where(back[::-1], left[::-1], mix(own ^ _LEFT))
        # What agrees with an earlier one of these rows is settled here, so that a frequent suffix costs one row a batch.
        order = np.lexsort((locs, ids, left, right, names))
        late = np.zeros(len(keys), bool)
        late[order[1:]] = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in (names, right, left)])
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids), pa.array(locs), pa.array(right.view(np.int64)), pa.array(left.view(np.int64)), pa.array(late)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("key", "doc_id", "loc")]
            columns = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            texts = np.stack([columns[1], columns[2] >> 32])
            cuts = np.flatnonzero((texts[:, 1:] != texts[:, :-1]).any(axis=0)) + 1
            cut = int(cuts[-1]) if len(cuts) else 0
            held = [c[cut:] for c in columns]
            if cut:
                yield emit(*[c[:cut] for c in columns])
        if held is not None and len(held[0]):
            yield emit(*held)

    return run


def _contexts(phrase: int, reach: int):
    schema = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("doc_id", pa.int64()), ("loc", pa.int64()), ("context", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            words = split_words(batch.column("text"))
            lists = batch.column("places")
            flat = lists.flatten()
            place, key, part, parts = (flat.field(k).to_numpy() for k in range(4))
            text = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            begin, end = words.offsets[text], words.offsets[text + 1]
            for first in range(0, len(place), 1 << 15):
                cut = slice(first, first + (1 << 15))
                at = (begin + place)[cut, None]
                where = np.concatenate([at + phrase + np.arange(reach), at - 1 - np.arange(reach)], axis=1)
                inside = (where >= begin[cut, None]) & (where < end[cut, None])
                near = np.where(inside, words.hashes[np.where(inside, where, 0)], np.uint64(0)).astype(">u8")
                n, width = near.shape
                data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width * 8, width * 8, dtype=np.int32)), pa.py_buffer(near.tobytes())])
                ids, tags = (batch.column(c).to_numpy()[text[cut]] for c in ("doc_id", "tag"))
                yield pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.array(part[cut], pa.int32()), pa.array(parts[cut], pa.int32()), pa.array(ids), pa.array((tags << 32) | place[cut]), data], schema=schema)

    return run


def _intervals(reach: int):
    """Late windows of sorted suffixes: the offsets, as bits, at which an earlier suffix begins the same window."""
    schema = pa.schema([("doc_id", pa.int64()), ("loc", pa.int64()), ("mask", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def resolved(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, part, parts, ids, locs = (table.column(c).to_numpy() for c in ("key", "part", "parts", "doc_id", "loc"))
        n = len(key)
        near = np.frombuffer(b"".join(table.column("context").to_pylist()), ">u8").astype(np.uint64).reshape(n, 2 * reach)
        right, left = near[:, :reach], near[:, reach:]
        follows = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
        common = np.concatenate([right[1:] == right[:-1], np.zeros((n - 1, 1), bool)], axis=1).argmin(axis=1)
        ahead = np.concatenate([right != 0, np.zeros((n, 1), bool)], axis=1).argmin(axis=1)
        behind = np.concatenate([left != 0, np.zeros((n, 1), bool)], axis=1).argmin(axis=1)
        rank = np.empty(n, np.int64)
        rank[np.lexsort((locs, ids))] = np.arange(n)
        split = parts > 1
        # Hashes of each number of words to the right, for what other tasks must see too.
        ahead_hash = [np.zeros(n, np.uint64)]
        for r in range(reach if split.any() else 0):
            ahead_hash.append(mix(ahead_hash[-1] * _CHAIN ^ right[:, r]))
        mask, behind_hash = np.zeros(n, np.int64), np.zeros(n, np.uint64)
        for offset in range(reach + 1):
            if offset:
                behind_hash = mix(behind_hash * _LEFT ^ left[:, offset - 1])
            ahead_by = reach - offset
            cut = np.concatenate([[True], ~follows | (common < ahead_by)])
            whole = (behind >= offset) & (ahead >= ahead_by)
            alone = cut & np.concatenate([cut[1:], [True]])
            some = np.flatnonzero(whole & (~alone | split))
            if not len(some):
                continue
            interval = np.cumsum(cut)[some].astype(np.uint64)
            group = mix(interval * _CHAIN ^ behind_hash[some])
            order = np.argsort(group, kind="stable")
            begins = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
            least = np.empty(len(some), np.int64)
            least[order] = np.repeat(np.minimum.reduceat(rank[some][order], begins), np.diff(np.concatenate([begins, [len(some)]])))
            late = rank[some] > least
            mask[some[late]] |= np.int64(1) << np.int64(offset)
            first = some[~late & split[some]]
            if len(first):
                h = [mix(mix(key[first].astype(np.uint64) ^ seed) ^ mix(ahead_hash[ahead_by][first] + np.uint64(offset)) * seed ^ behind_hash[first]) for seed in (_SPLIT, _CHAIN)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(locs[first]), pa.array(np.full(len(first), np.int64(1) << np.int64(offset))), *[pa.array(x.view(np.int64)) for x in h]], schema=schema)
        found = np.flatnonzero(mask)
        none = pa.nulls(len(found), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(locs[found]), pa.array(mask[found]), none, none], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, part = batch.column("key").to_numpy(), batch.column("part").to_numpy()
            if rows >= 1 << 14:
                before = held[-1]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
                new[0] = key[0] != before.column("key")[-1].as_py() or part[0] != before.column("part")[-1].as_py()
                if new.any():
                    at = int(new.argmax())
                    if at:
                        held.append(batch.slice(0, at))
                    yield from resolved(pa.Table.from_batches(held))
                    held, rows = [], 0
                    batch = batch.slice(at)
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield from resolved(pa.Table.from_batches(held))

    return run


def _starts(reach: int, window: int):
    """Spans of the windows that masks name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            locs, mask = batch.column("loc").to_numpy(), batch.column("mask").to_numpy()
            # Neighbouring offsets make one span: from the highest of a run of bits to the lowest.
            bits = (mask[:, None] >> np.arange(reach + 2)) & 1
            before = np.concatenate([np.zeros((len(mask), 1), np.int64), bits[:, :-1]], axis=1)
            row, lowest = np.nonzero((bits == 1) & (before == 0))
            _, past = np.nonzero((bits == 0) & (before == 1))
            start = (locs[row] & 0xFFFFFFFF) - (past - 1)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("doc_id").to_numpy()[row]), pa.array(locs[row] >> 32), pa.array(start), pa.array(window + past - 1 - lowest)], names=["doc_id", "tag", "start", "length"])

    return run


def find_repeats(known: DataFrame, window: int, phrase: int) -> DataFrame:
    """doc_id, tag, spans: per text that has any, the windows that also start at an earlier place (see merged_spans())."""
    reach = window - phrase
    if not phrase > reach >= 1 or reach > 60:
        raise ValueError("neighbouring phrases must touch and offsets fit a mask: phrase > window - phrase, of 1 to 60")
    spark = known.sparkSession
    rows = minimiser_rows(known, window, phrase)
    often = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    release(spark)
    found = rows.join(small(often, 16, often.count()), "key", "left_semi")
    found = found.repartition("doc_id", tag_of(F.col("loc"))).sortWithinPartitions("doc_id", "loc")
    ordered = found.mapInArrow(_chained(phrase, reach), "key long, doc_id long, loc long, right long, left long, late boolean")
    ordered = materialize(ordered)
    release(spark)
    late = ordered.where("late").select("doc_id", "loc")
    nth = F.row_number().over(Window.partitionBy("key", "right", "left").orderBy("doc_id", "loc"))
    ordered = materialize(ordered.where("not late").withColumn("first", nth == 1).select("key", "doc_id", "loc", "first"))
    release(spark)
    every = F.lit((1 << (reach + 1)) - 1)
    late = late.union(ordered.where("not first").select("doc_id", "loc")).withColumn("mask", every)
    open_ = materialize(ordered.where("first").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / PHRASE_ROWS).cast("int")
    wanted = ordered.where("first").join(small(open_, 24, open_.count()), "key").select("doc_id", tag_of(F.col("loc")).alias("tag"), F.col("loc").bitwiseAND(F.lit(0xFFFFFFFF)).alias("place"), "key", F.pmod(F.xxhash64("doc_id", "loc"), parts).cast("int").alias("part"), parts.alias("parts"))
    lists = materialize(wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("place", "key", "part", "parts")).alias("places")))
    size = lists.agg(F.sum(F.size("places"))).first()[0] or 0
    wide = with_lists(known, lists, "places", 24, "inner")
    suffixes = wide.select("doc_id", "tag", "text", "places").mapInArrow(_contexts(phrase, reach), "key long, part int, parts int, doc_id long, loc long, context binary")
    # Ranges of the order: phrases are hashes, so equal ranges of them hold like numbers of phrases.
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_ROWS))
    bucket = F.floor((F.col("key") / float(1 << 64) + 0.5) * ranges)
    array = suffixes.repartition(ranges, bucket, "part").sortWithinPartitions("key", "part", "context")
    sorted_ = materialize(array.mapInArrow(_intervals(reach), "doc_id long, loc long, mask long, h1 long, h2 long"))
    release(spark)
    firsts = sorted_.where("h1 is not null")
    best = firsts.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "loc")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = firsts.join(best, ["h1", "h2"]).where(F.struct("doc_id", "loc") > F.col("best")).select("doc_id", "loc", "mask")
    windows = late.union(sorted_.where("h1 is null").select("doc_id", "loc", "mask")).union(again)
    spans = materialize(merged_spans(windows.mapInArrow(_starts(reach, window), "doc_id long, tag long, start long, length long")))
    release(spark)
    return spans


def _phrase(words: int) -> int:
    """More than half a passage, so that neighbouring phrases touch; and so much that offsets fit a mask."""
    return max(words // 2 + 1, words - 60)


def _passages(with_text: bool):
    fields = [("doc_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("text_words", pa.int64())]
    schema = pa.schema(fields + [("passage", pa.string())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            words = split_words(batch.column("text"), hashed=False)
            gone = covered(words, batch.column("spans"))
            text = np.repeat(np.arange(batch.num_rows), words.counts)
            edge = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
            begin = np.flatnonzero(gone & (edge | ~np.concatenate([[False], gone[:-1]])))
            last = np.flatnonzero(gone & np.concatenate([edge[1:] | ~gone[1:], [True]])) if len(text) else begin
            own = text[begin]
            columns = [pa.array(batch.column("doc_id").to_numpy()[own]), pa.array(begin - words.offsets[own]), pa.array(last + 1 - begin), pa.array(words.counts[own])]
            if with_text:
                columns.append(pa.array([words.data[words.starts[a] : words.ends[b]].tobytes().decode() for a, b in zip(begin, last, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50, with_text: bool = False) -> DataFrame:
    """doc_id, start_word, n_words, text_words (and passage): one row per repeated stretch of a document.

    A stretch is a longest run of words each of which lies in a passage of ``words`` words that also
    starts at an earlier place: in a document with a smaller doc_id, or further ahead in the same text.
    The first place of a passage has no row. Method: a sparse suffix array. Suffixes at minimiser
    phrases of words // 2 + 1 words are kept, sorted, compared with their neighbours and extended left and
    right (see this module's text). A passage holds one such phrase at least, so none is missed; words
    are compared by 64-bit hashes.

    Null, empty and short texts have no rows; a null doc_id takes no part. Texts that share a doc_id come
    in the order of 31 bits of their xxHash64; rows that repeat both are one document and give equal rows.
    Very long texts are read in full. Other columns are not read, whatever their names; an empty table gives no rows.
    """
    tagged, known = tagged_texts(docs, id_col, text_col)
    wide = with_lists(tagged, find_repeats(known, words, _phrase(words)), "spans", how="inner")
    kinds = "doc_id long, start_word long, n_words long, text_words long" + ", passage string" * with_text
    return wide.select("doc_id", "text", "spans").mapInArrow(_passages(with_text), kinds)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        words = split_words(batch.column("text"), hashed=False)
        data, at = joined(words, ~covered(words, batch.column("spans")))
        texts = [data[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(texts, pa.string())], names=["doc_id", "tag", "kept_text"])


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50) -> DataFrame:
    """doc_id, kept_text: one row per row of ``docs``, without its repeated stretches, kept words joined by one space.

    Stretches as in repeated_passages(). Null and empty texts give an empty text; a null doc_id keeps all
    its words; repeated rows give equal rows; other columns are not read; an empty table gives no rows.
    """
    tagged, known = tagged_texts(docs, id_col, text_col)
    wide = with_lists(tagged, find_repeats(known, words, _phrase(words)), "spans")
    return wide.mapInArrow(_kept, "doc_id long, tag long, kept_text string").drop("tag")
