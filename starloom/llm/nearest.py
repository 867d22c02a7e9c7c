"""Nearest neighbours by a block matrix join of int8 tiles with error bounds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm._shared import materialize

#: Rows of a block, and terms of a product that single precision adds up without rounding: 1024 * 127 ** 2 < 2 ** 24.
QUERY_ROWS, ROWS, EXACT_TERMS = 1024, 4096, 1024
_PAIRS = 1 << 16


def _packed(id_col: str, vector_col: str, block_rows: int):
    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("codes", pa.binary()), ("scales", pa.binary())])

    def block(dim: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, x = (np.concatenate(p) for p in zip(*parts, strict=True))
        scale = np.abs(x).max(axis=1) / 127
        codes = np.rint(x / scale[:, None]).astype(np.int8)
        values = [dim, ids.tobytes(), x.tobytes(), codes.tobytes(), scale.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column(id_col)), pc.is_valid(batch.column(vector_col))))
            lists = batch.column(vector_col)
            sizes = lists.value_lengths().to_numpy()
            flat = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy()
            at = np.concatenate([[0], np.cumsum(sizes)])
            ids = batch.column(id_col).to_numpy()
            for dim in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == dim)
                x = flat[at[rows][:, None] + np.arange(dim)]
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                for begin in range(0, int(good.sum()), block_rows):
                    part = np.flatnonzero(good)[begin : begin + block_rows]
                    held.setdefault(dim, []).append((ids[rows[part]], x[part]))
                if sum(len(p[0]) for p in held.get(dim, ())) >= block_rows:
                    yield block(dim, held.pop(dim))
        for dim, parts in held.items():
            yield block(dim, parts)

    return run


class _Block:
    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(len(self.ids), -1)
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(self.x.shape).astype(np.float32)
        self.scale = np.frombuffer(row["scales"], np.float64)
        near = self.codes * self.scale[:, None]
        self.lost = np.sqrt(np.square(self.x - near).sum(axis=1))
        self.near, self.size = np.sqrt(np.square(near).sum(axis=1)), np.sqrt(np.square(self.x).sum(axis=1))


def products(a: _Block, b: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of the codes, to scale, and bounds of their errors (Cauchy-Schwarz on what quantising lost)."""
    total = np.zeros((len(a.ids), len(b.ids)))
    for k in range(0, a.codes.shape[1], EXACT_TERMS):
        total += a.codes[:, k : k + EXACT_TERMS] @ b.codes[:, k : k + EXACT_TERMS].T
    total *= a.scale[:, None]
    total *= b.scale
    bound = np.outer(a.near, b.lost)
    bound += np.outer(a.lost, b.size)
    bound += 1e-9 * np.outer(a.size, b.size)
    return total, bound


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, the same for equal rows wherever they stand."""
    return (x * y).sum(axis=1)


class _Heaps:
    """The best ``k`` of each query so far: largest score first, ties to the smaller id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k, self.best = queries, k, [[] for _ in queries]
        self.floor = np.full(len(queries), -np.inf)

    def add(self, a: _Block, b: _Block) -> None:
        near, bound = products(a, b)
        near[a.ids[:, None] == b.ids] = -np.inf
        low = near - bound
        if low.shape[1] > self.k:
            low = np.partition(low, low.shape[1] - self.k, axis=1)[:, low.shape[1] - self.k :]
            floor = np.maximum(self.floor, low.min(axis=1))
        else:
            floor = self.floor
        rows, columns = np.nonzero(near + bound >= floor[:, None])
        keep = np.isfinite(near[rows, columns])
        rows, columns = rows[keep], columns[keep]
        for begin in range(0, len(rows), _PAIRS):
            r, c = rows[begin : begin + _PAIRS], columns[begin : begin + _PAIRS]
            scores = exact(a.x[r], b.x[c])
            for q, s, v in zip(r.tolist(), scores.tolist(), (-b.ids[c]).tolist(), strict=True):
                if len(heap := self.best[q]) < self.k:
                    heapq.heappush(heap, (s, v))
                elif (s, v) > heap[0]:
                    heapq.heapreplace(heap, (s, v))
        self.floor = np.array([h[0][0] if len(h) == self.k else -np.inf for h in self.best])


def _searched(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, query, heaps = None, None, None

        def out():
            for begin in range(0, len(heaps.queries), 256):
                found = [(q, -v, s) for q, h in zip(heaps.queries[begin : begin + 256].tolist(), heaps.best[begin : begin + 256], strict=True) for s, v in h]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["q_no"] != number:
                    if heaps is not None:
                        yield from out()
                    number, query = row["q_no"], _Block({n: row[f"q_{n}"] for n in ("ids", "vectors", "codes", "scales")})
                    heaps = _Heaps(query.ids, k)
                heaps.add(query, _Block(row))
        if heaps is not None:
            yield from out()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each of ``queries`` the ``k`` rows of ``vectors`` with the largest inner product.

    Exact, in double precision on the original vectors; ties go to the smaller id, and a query is never
    its own neighbour. Method: block matrix join. Rows are packed into blocks with int8 codes; each
    block of queries meets each block of rows once, the code product of that tile and its bounds
    rule out all pairs that cannot be among the best, the others are computed in full, and heaps
    merge the tiles of a task, then a window those of all tasks.

    Rows with a null id, or a vector that is null, empty, zero or holds null or non-finite components,
    take no part. Only vectors of equal length meet, of any length. Rows that repeat an id are one query and one
    candidate with several vectors, of which the best pair counts, so no vec_id is listed twice. Other columns
    are not read, whatever their names; without rows or queries there are none.
    """
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    kinds = "dim int, ids binary, vectors binary, codes binary, scales binary"
    asked = pick(queries).dropDuplicates()
    n = asked.count()
    blocks = asked.repartition(max(1, -(-n // QUERY_ROWS))).mapInArrow(_packed("id", "vector", QUERY_ROWS), kinds)
    blocks = materialize(blocks.withColumn("q_no", F.monotonically_increasing_id()).withColumnsRenamed({c: f"q_{c}" for c in ("dim", "ids", "vectors", "codes", "scales")}))
    rows = materialize(pick(vectors).mapInArrow(_packed("id", "vector", ROWS), kinds).withColumn("no", F.monotonically_increasing_id()))
    # A stated query set against all rows, block by block: each block of rows is dealt to every block of queries of its length.
    numbers = blocks.groupBy("q_dim").agg(F.collect_list("q_no").alias("numbers"))
    dealt = rows.join(numbers, F.col("dim") == F.col("q_dim")).drop("q_dim").withColumn("to", F.explode("numbers")).drop("numbers")
    tiles = dealt.join(blocks, F.col("to") == F.col("q_no")).drop("to", "q_dim")
    runs = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = tiles.withColumn("slot", F.pmod("no", F.lit(runs))).repartition("q_no", "slot").sortWithinPartitions("q_no")
    # Where ids repeat, so many rows hold k different ids at least; each counts once, by its best row.
    repeats = pick(vectors).where("id is not null").groupBy("id").count().agg(F.max("count")).first()[0] or 1
    found = tiles.drop("dim", "no", "slot").mapInArrow(_searched(k * repeats), "query_id long, vec_id long, score double")
    if repeats > 1 or asked.select("id").distinct().count() < n:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
