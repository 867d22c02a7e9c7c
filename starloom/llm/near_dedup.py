"""MinHash near-dedup with b-bit signatures, confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm._shared import fresh, materialize, release, small, text_slices
from starloom.llm._words import Words, mix, phrases, split_words, starts_of_windows
from starloom.llm.components import components

#: Signature: 64 bands of 8 minima; of each minimum the 2 low bits are kept, 32 to a long.
BANDS, ROWS, BITS = 64, 8, 2
HASHES = BANDS * ROWS
LONGS = HASHES * BITS // 64
_ODD = mix(np.arange(1, HASHES + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_ADD = mix(np.arange(1001, HASHES + 1001, dtype=np.uint64)).astype(np.uint32)
_EVEN_BITS = 0x5555555555555555
#: Members, and their shingles, on either side of a tile; columns of a product of shingle sets.
TILE, TILE_SHINGLES, COLUMNS = 256, 1 << 20, 4096


def shingle_sets(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every shingle of each text, and each text's first place among them.

    A text with fewer than ``length`` words has its whole sequence as one shingle; one
    without words has none.
    """
    h, counts = phrases(words.hashes, length), words.counts
    keep = starts_of_windows(words.offsets, length)
    short = np.flatnonzero((counts > 0) & (counts < length))
    keep[words.offsets[short]] = True
    for i in short:
        h[words.offsets[i]] = phrases(words.hashes[words.offsets[i] : words.offsets[i + 1]], int(counts[i]), seed=int(counts[i]) * 2 + 12345)[0]
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[words.offsets]


def _signatures(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n_shingles", pa.int64()), ("sum_1", pa.int64()), ("sum_2", pa.int64()), ("packed", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            h, at = shingle_sets(split_words(batch.column("text"), lower=True), length)
            n = batch.num_rows
            sizes, sums = np.zeros(n, np.int64), np.zeros((2, n), np.uint64)
            low = np.zeros((n, HASHES), np.uint32)
            for i in range(n):
                own = np.sort(h[at[i] : at[i + 1]])
                if len(own):
                    own = own[np.concatenate([[True], own[1:] != own[:-1]])]
                    sizes[i] = len(own)
                    sums[:, i] = [np.add.reduce(mix(own ^ np.uint64(seed))) for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            full = np.flatnonzero(sizes)
            for begin in range(0, len(full), 256):
                part = full[begin : begin + 256]
                lo, hi = at[part[0]], at[part[-1] + 1]
                x = (h[lo:hi] >> np.uint64(32)).astype(np.uint32)
                for p in range(HASHES):
                    low[part, p] = np.minimum.reduceat(x * _ODD[p] + _ADD[p], at[part] - lo)
            wide = low.reshape(n, BANDS, ROWS).astype(np.uint64)
            keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)) * np.uint64(0x9E3779B97F4A7C15)
            for r in range(ROWS):
                keys = mix(keys ^ wide[:, :, r]) * np.uint64(0x2545F4914F6CDD1D)
            lanes = (low & np.uint32(3)).astype(np.uint64).reshape(n, LONGS, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(BITS))
            packed = np.bitwise_or.reduce(lanes, axis=2)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).view(np.int64).ravel())) for m in (packed, keys)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(sizes), *[pa.array(x.view(np.int64)) for x in sums], *lists], schema=schema)

    return run


def estimated(left: list[Column], right: list[Column]) -> Column:
    """Jaccard similarity from packed 2-bit minima: equal lanes by bit count, corrected for chance collisions."""
    unequal = [F.bit_count(((x := a.bitwiseXOR(b)).bitwiseOR(F.shiftright(x, 1))).bitwiseAND(F.lit(_EVEN_BITS))) for a, b in zip(left, right, strict=True)]
    same = F.lit(1.0) - reduce(lambda p, q: p + q, unequal) / F.lit(float(HASHES))
    chance = 1 / 2**BITS
    return (same - F.lit(chance)) / F.lit(1 - chance)


def least_estimate(threshold: float, sigmas: float = 5) -> float:
    """The estimate that a pair at ``threshold`` undercuts with a probability below 1e-6."""
    chance = 1 / 2**BITS
    same = chance + (1 - chance) * threshold
    return (same - sigmas * math.sqrt(same * (1 - same) / HASHES) - chance) / (1 - chance)


def estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """estimated() for all rows of ``x`` against all rows of ``y``."""
    unequal = np.zeros((len(x), len(y)), np.int32)
    for k in range(x.shape[1]):
        differ = x[:, k, None] ^ y[:, k]
        unequal += np.bitwise_count((differ | (differ >> np.uint64(1))) & np.uint64(_EVEN_BITS))
    chance = 1 / 2**BITS
    return (1 - unequal / HASHES - chance) / (1 - chance)


def _groups_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, across batches, one table at a time."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if (now := tuple(marks[begin])) != key and held:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def _resolve(length: int, percent: int, least: float):
    """Links between components within a tile: estimates first, then what they leave on full sets, all at once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    names = ("cls", "root", "asks", "answers", "main")

    def links(table: pa.Table) -> list[tuple[int, int]]:
        cls, root, asks, answers, main = (table.column(c).to_numpy() for c in names)
        packed = table.column("packed").combine_chunks().flatten().to_numpy().reshape(len(cls), -1).view(np.uint64)
        x, y = np.flatnonzero(asks), np.flatnonzero(answers)
        # Of two that ask, the one with the smaller class does; components are apart until a link joins them.
        pairs = (root[x][:, None] != root[y]) & (main[y] | (cls[x][:, None] < cls[y]))
        pairs &= estimates(packed[x], packed[y]) >= least
        x, pairs = x[keep := pairs.any(axis=1)], pairs[keep]
        y, pairs = y[keep := pairs.any(axis=0)], pairs[:, keep]
        if not len(x):
            return []
        h, at = shingle_sets(split_words(table.column("text").combine_chunks(), lower=True), length)
        left, right = ([np.unique(h[at[i] : at[i + 1]]) for i in side] for side in (x, y))
        both = shared(left, right)
        union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right]) - both
        i, j = np.nonzero(pairs & (100 * both >= percent * union))
        owner: dict[int, int] = {}

        def find(r: int) -> int:
            while (up := owner.get(r, r)) != r:
                owner[r] = owner.get(up, up)
                r = up
            return r

        out = []
        _, first = np.unique(np.stack([root[x[i]], root[y[j]]]), axis=1, return_index=True)
        for a, b in zip(x[i[first]].tolist(), y[j[first]].tolist(), strict=True):
            p, q = find(int(root[a])), find(int(root[b]))
            if p != q:
                owner[max(p, q)] = min(p, q)
                out.append((int(cls[a]), int(cls[b])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups_of(batches, ("cluster", "p", "q")):
            if found := links(table):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=schema)

    return run


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all ``left`` with all ``right`` sets: products of 0/1 matrices, some columns at a time."""
    sides = []
    for sets in (left, right):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        sides.append((np.concatenate(sets), row))
    common = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.int64)
    placed = []
    for values, row in sides:
        column = np.searchsorted(common, values)
        inside = column < len(common)
        inside[inside] = common[column[inside]] == values[inside]
        order = np.argsort(column[inside], kind="stable")
        placed.append((column[inside][order], row[inside][order]))
    for begin in range(0, len(common), COLUMNS):
        dense = []
        for (column, row), n in zip(placed, (len(left), len(right)), strict=True):
            lo, hi = np.searchsorted(column, [begin, begin + COLUMNS])
            m = np.zeros((n, min(COLUMNS, len(common) - begin)), np.float32)
            m[row[lo:hi], column[lo:hi] - begin] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def near_enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * |intersection| >= percent * |union|; an empty set has no neighbour."""
    if not len(x) or not len(y):
        return False
    at = np.searchsorted(x, y)
    both = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(length: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text_b", 2 << 20):
            encoded = batch.column("text_a").dictionary_encode() if batch.num_rows > 1 else pa.array([batch.column("text_a")[0].as_py()]).dictionary_encode()
            left = shingle_sets(split_words(encoded.dictionary, lower=True), length)
            right = shingle_sets(split_words(batch.column("text_b"), lower=True), length)
            which, known, linked = encoded.indices.to_numpy(zero_copy_only=False), {}, np.zeros(batch.num_rows, bool)
            for i, j in enumerate(which):
                if j not in known:
                    known[j] = np.unique(left[0][left[1][j] : left[1][j + 1]])
                linked[i] = near_enough(known[j], np.unique(right[0][right[1][i] : right[1][i + 1]]), percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=schema).filter(pa.array(linked))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document.

    Documents are linked where 100 * |intersection| >= percent * |union| of their sets of
    ``length``-word shingles (A-Z lower-cased), and component_id is the smallest doc_id that
    links reach. Method: b-bit MinHash. Copies with the same set (two 64-bit sums and the size agree)
    form one class; classes meet in 64 bands of 8 minima (a pair at 0.8 escapes all bands with a
    probability of 8e-6, at 0.85 of 2e-9); the estimate from packed 2-bit minima drops pairs five
    deviations below the threshold; what remains is confirmed on full sets. First each class is compared
    with the one bucket centre that it meets most often. Then only buckets matter whose members
    components still hold apart. Chains of such buckets form clusters, and clusters of any size are cut to
    tiles: TILE members that are not in the cluster's largest component against TILE of all. A
    tile's task estimates its pairs, confirms what is left and names no more links than join its components.
    So no link between components is lost, members of the largest component are never compared among
    themselves, and no task holds more than a tile.

    Null or empty texts, or ones without words, have no shingles and stand alone; very long ones are read
    whole. Rows that repeat a doc_id are judged by their own texts; ``kept`` is doc_id = component_id, so
    they share that verdict if in one component. A null doc_id is never kept in a component with
    other ids, and its component_id is null where it stands alone (kept is then true). Other
    columns are not read, whatever their names. No rows give no rows.
    """
    return _judged(docs, id_col, text_col, length, percent).drop("tag")


def _judged(docs: DataFrame, id_col: str, text_col: str, length: int, percent: int) -> DataFrame:
    """near_duplicates() with the hash of each row's text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tagged = rows.withColumn("tag", F.xxhash64("text"))
    signed = materialize(tagged.mapInArrow(_signatures(length), "doc_id long, tag long, n_shingles long, sum_1 long, sum_2 long, packed array<long>, bands array<long>"))
    same = ["sum_1", "sum_2", "n_shingles"]
    classes = signed.where("n_shingles > 0").groupBy(*same).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "packed", "bands")).alias("first"))
    classes = materialize(classes.select(*same, "first.*", F.monotonically_increasing_id().alias("cls")))
    placed = classes.select("cls", F.explode("bands").alias("band"))
    # Buckets are counted with partial sums, and only members of those that hold several are looked at again.
    heads = materialize(placed.groupBy("band").agg(F.min("cls").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    release(docs.sparkSession)
    met = materialize(placed.join(small(heads, 24, heads.count()), "band"))
    stars = met.where("a <> cls").groupBy("cls").agg(F.mode("a", True).alias("a")).select("a", F.col("cls").alias("b"))
    sign = lambda name, side: classes.select(F.col("cls").alias(name), *[F.col("packed")[i].alias(f"{side}{i}") for i in range(LONGS)])
    left, right = ([F.col(f"{side}{i}") for i in range(LONGS)] for side in "xy")
    near = estimated(left, right) >= F.lit(least_estimate(percent / 100))
    stars = materialize(stars.join(sign("a", "x"), "a").join(sign("b", "y"), "b").where(near).select("a", "b"))
    links = _linked(stars, classes, tagged, length, percent)
    roots = components(links)
    more = _linked_apart(_clusters(met, roots), classes, tagged, length, percent)
    rooted = classes.select(*same, "cls", "doc_id").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    if not more.isEmpty():
        # What joins components has them as its nodes, so the links within them are not gone through again.
        ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab"]
        joins = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        higher = components(joins.distinct())
        rooted = rooted.join(higher.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left").withColumn("root", F.coalesce("higher", "root"))
    rooted = materialize(rooted.select(*same, "root", "doc_id"))
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("least"))
    owner = rooted.select(*[F.col(c).alias(f"c_{c}") for c in same], "root").join(ids, "root").drop("root")
    joined = signed.select("doc_id", "tag", *same).join(owner, [F.col(c) == F.col(f"c_{c}") for c in same], "left")
    alone = F.col("n_shingles") == 0
    return joined.select("doc_id", "tag", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _clusters(met: DataFrame, roots: DataFrame) -> DataFrame:
    """cls, root, cluster: members of the buckets in which ``roots`` hold some apart, and the chain of such buckets that they belong to."""
    placed = materialize(met.select("cls", "band").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "band", F.coalesce("root", "cls").alias("root")))
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band", "low")
    apart = materialize(placed.join(mixed, "band").select("cls", "root", "low").distinct())
    # Each root holds on to the least it meets, and the others it meets to that one: the same chains by far fewer edges.
    pairs = apart.select("low", "root").distinct()
    least = pairs.groupBy("root").agg(F.min("low").alias("least"))
    edges = pairs.join(least, "root").select(F.col("least").alias("a"), F.col("low").alias("b")).union(least.select("least", "root"))
    chains = components(edges.distinct())
    return materialize(apart.select("cls", "root").distinct().join(chains.select(F.col("node").alias("root"), F.col("root").alias("cluster")), "root"))


def _linked_apart(members: DataFrame, classes: DataFrame, tagged: DataFrame, length: int, percent: int) -> DataFrame:
    """Links (a, b) that join what is apart within clusters, tile by tile."""
    weighed = materialize(members.join(classes.select("cls", F.col("n_shingles").alias("shingles")), "cls"))
    sizes = weighed.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("shingles"))
    parts = lambda n, s: F.greatest(F.ceil(n / TILE), F.ceil(s / TILE_SHINGLES))
    largest = F.max(F.struct("n", "shingles", F.col("root").alias("of")))
    plan = sizes.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), largest.alias("main"))
    plan = plan.select("cluster", F.col("main.of").alias("main_root"), parts(F.col("n") - F.col("main.n"), F.col("shingles") - F.col("main.shingles")).alias("ps"), parts(F.col("n"), F.col("shingles")).alias("qs"))
    dealt = weighed.join(plan, "cluster").withColumn("main", F.col("root") == F.col("main_root"))
    own_p, own_q = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("ps")), F.pmod(F.xxhash64("cls", F.lit(2)), F.col("qs"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    asking = dealt.where(~F.col("main")).select("cluster", "cls", "root", "main", own_p.alias("p"), F.explode(upto("qs")).alias("q"), F.lit(True).alias("asks"), F.lit(False).alias("answers"))
    answering = dealt.select("cluster", "cls", "root", "main", F.explode(upto("ps")).alias("p"), own_q.alias("q"), F.lit(False).alias("asks"), F.lit(True).alias("answers"))
    tiles = asking.union(answering).groupBy("cluster", "p", "q", "cls", "root", "main").agg(F.bool_or("asks").alias("asks"), F.bool_or("answers").alias("answers"))
    texts = _texts(members.select("cls"), classes, tagged)
    rows = materialize(tiles).join(texts, "cls").join(classes.select("cls", "packed"), "cls")
    rows = rows.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q", "cls")
    rows = rows.select("cluster", "p", "q", "cls", "root", "asks", "answers", "main", "packed", "text")
    return materialize(rows.mapInArrow(_resolve(length, percent, least_estimate(percent / 100)), "a long, b long"))


def _texts(wanted: DataFrame, classes: DataFrame, tagged: DataFrame) -> DataFrame:
    """cls, text: one whole text of each wanted class."""
    wanted = materialize(wanted.distinct().join(classes.select("cls", "doc_id", "tag"), "cls"))
    key = [F.col("w_id").eqNullSafe(F.col("doc_id")), F.col("w_tag") == F.col("tag")]
    named = small(wanted.select("cls", F.col("doc_id").alias("w_id"), F.col("tag").alias("w_tag")), 24, wanted.count())
    return materialize(tagged.join(named, key).groupBy("cls").agg(F.first("text").alias("text")))


def _linked(pairs: DataFrame, classes: DataFrame, tagged: DataFrame, length: int, percent: int) -> DataFrame:
    """Those of the class pairs whose representatives' full sets are near enough."""
    texts = _texts(pairs.select("a").distinct().union(pairs.select("b").distinct()).withColumnRenamed("a", "cls"), classes, tagged)
    found = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    return materialize(found.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(length, percent), "a long, b long"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group kept, the one with the smallest id; all its columns and whole texts.

    Groups as in near_duplicates(): null and empty texts stand alone and stay, very long ones are read whole.
    Rows are judged by id and text: those that repeat the kept id and are in its group stay, and a row
    with a null id goes where its group has an id. Columns keep their names; an empty table stays empty.
    """
    key, tag = fresh(docs, "near_id", "near_tag")
    verdict = _judged(docs, id_col, text_col, length, percent)
    gone = materialize(verdict.where(~F.col("kept")).select(F.col("doc_id").alias(key), F.col("tag").alias(tag)).distinct())
    named = small(gone, 24, gone.count())
    same = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(tag))
    return docs.join(named, same, "left_anti")
