"""Nearest neighbours by a block matrix join on int8 tiles.

A vector is quantised twice: to int8 with a scale of its own, and what that
leaves to int8 again.  Only these, two bytes a component, are packed into blocks
and shuffled; groups of query blocks meet groups of candidate blocks.  A tile's
int8 product gives every inner product with a bound on its error; pairs whose
upper bound reaches the query's k-th best lower bound are bounded again, more
tightly, with the second int8 vectors.  What still may be among a query's k best
is computed from the original vectors in double precision, summed in the order
of the components, and merged into the query's k best, first per task and then
over all.  The bounds are proven (Cauchy-Schwarz on the quantisation residues),
so the result is exact, not approximate.

Ties on the score go to the smaller id.  Of candidates with one and the same
vector only the k + 1 smallest ids can be among anyone's k nearest, so only
those are kept, combined before the shuffle.  Defined cases: vectors that are
null, empty, all zero or hold a null or non-finite component take no part,
neither do null ids; vectors of different lengths are no candidates of each
other; repeated rows count once, and no row with the query's id is its
candidate; with fewer than k candidates all are returned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import forget, written

STRIP = 256  # queries whose product with a block is held at once
HELD = 2_000_000  # pairs that a block of queries holds before those out of reach are dropped
SLACK = 1e-9  # for the rounding of the bounds themselves, relative to the norms
BLOCK_SCHEMA = "dim int, block long, rows binary"
PAIRS = "query_id long, q long, vec_id long, c long, low double, high double"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def row_type(dim: int) -> np.dtype:
    """A quantised vector: its row's number and id, two int8 vectors with their scales, and the norms that bound their errors."""
    return np.dtype([("row", "<i8"), ("id", "<i8"), ("scale", "<f8", 2), ("norm", "<f8"), ("back", "<f8", 2), ("left", "<f8", 2), ("int8", "i1", (2, dim))])


def quantise(row: np.ndarray, id: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows of ``row_type``; ``back`` are the norms of what one and what both int8 vectors stand for, ``left`` those of the residues."""
    out = np.zeros(len(x), dtype=row_type(x.shape[1]))
    out["row"], out["id"], out["norm"] = row, id, norms(x)
    back = np.zeros_like(x)
    for i in range(2):
        left = x - back
        scale = np.abs(left).max(axis=1) / 127
        scale[scale == 0] = 1
        out["int8"][:, i] = np.rint(left / scale[:, None])
        out["scale"][:, i] = scale
        back = back + out["int8"][:, i] * scale[:, None]
        out["back"][:, i], out["left"][:, i] = norms(back), norms(x - back)
    return out


def restored(v: np.ndarray) -> np.ndarray:
    """What both int8 vectors stand for."""
    return v["int8"][:, 0] * v["scale"][:, 0, None] + v["int8"][:, 1] * v["scale"][:, 1, None]


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, components added one after the other."""
    return np.cumsum(a * b, axis=1)[:, -1] if len(a) else np.empty(0)


class Bounds:
    """The pairs of a block of queries that may be among the k best so far, with bounds on their scores."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.least = np.full((len(queries), k), -np.inf)  # the k best lower bounds, ascending
        self.found: list[tuple[np.ndarray, ...]] = []
        self.held, self.limit = 0, HELD

    def meet(self, c: np.ndarray) -> None:
        q = self.q
        wide = np.float32 if c["int8"].shape[2] <= 1040 else np.float64  # in which the integer sums are exact
        c8 = c["int8"][:, 0].astype(wide).T
        for a in range(0, len(q), STRIP):
            s = slice(a, a + STRIP)
            about = (q["int8"][s, 0].astype(wide) @ c8).astype(np.float64) * (q["scale"][s, 0, None] * c["scale"][:, 0])
            error = q["back"][s, 0, None] * c["left"][:, 0] + q["left"][s, 0, None] * c["norm"] + SLACK * q["norm"][s, None] * c["norm"]
            about[q["id"][s, None] == c["id"]] = -np.inf
            least = self.least[s, 0]
            if len(c) >= self.k:
                least = np.maximum(least, np.partition(about - error, len(c) - self.k, axis=1)[:, len(c) - self.k])
            rows, cols = np.nonzero((about + error >= least[:, None]) & (about > -np.inf))
            for b in np.split(np.arange(len(rows)), range(200_000, len(rows), 200_000)):
                self._keep(rows[b] + a, c[cols[b]])

    def _keep(self, rows: np.ndarray, c: np.ndarray) -> None:
        q = self.q[rows]
        about = np.einsum("ij,ij->i", restored(q), restored(c))
        error = q["back"][:, 1] * c["left"][:, 1] + q["left"][:, 1] * c["norm"] + SLACK * q["norm"] * c["norm"]
        self._raise(rows, about - error)
        self.found.append((rows, c["id"], c["row"], about - error, about + error))
        self.held += len(rows)
        if self.held > self.limit:
            self._drop()

    def _raise(self, rows: np.ndarray, low: np.ndarray) -> None:
        touched = np.unique(rows)
        of = np.concatenate([np.repeat(touched, self.k), rows])
        every = np.concatenate([self.least[touched].ravel(), low])
        order = np.lexsort((every, of))
        last = np.searchsorted(of[order], touched, side="right")
        self.least[touched] = every[order][last[:, None] + np.arange(-self.k, 0)]

    def _drop(self) -> None:
        parts = [np.concatenate(x) for x in zip(*self.found)]
        stays = parts[4] >= self.least[parts[0], 0]
        self.found = [tuple(p[stays] for p in parts)]
        self.held = int(stays.sum())
        self.limit = max(HELD, 2 * self.held)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.found:
            return
        self._drop()
        rows, ids, numbers, low, high = self.found[0]
        for a in range(0, len(rows), 100_000):
            s = slice(a, a + 100_000)
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(self.q["id"][rows[s]]), "q": pa.array(self.q["row"][rows[s]]), "vec_id": pa.array(ids[s]), "c": pa.array(numbers[s]), "low": pa.array(low[s]), "high": pa.array(high[s])})


def _matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the rows of each vector length in a batch."""
    lists = batch.column(column)
    length = np.diff(lists.offsets.to_numpy())
    flat, begin = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(length) - length
    for dim in np.unique(length).tolist():
        of = np.flatnonzero(length == dim)
        yield of, flat[begin[of][:, None] + np.arange(dim)]


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Quantises (row, id, vector) rows and packs them into blocks of at most ``size`` rows of one length."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, {}

        def emit(dim: int, full: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows = np.concatenate(held.pop(dim))
            while len(rows) >= size or len(rows) and not full:
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "block": [number], "rows": pa.array([rows[:size].tobytes()], pa.binary())})
                number += 1
                rows = rows[size:]
            if len(rows):
                held[dim] = [rows]

        for batch in batches:
            row, ids = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for of, matrix in _matrices(batch, 2):
                dim = matrix.shape[1]
                held.setdefault(dim, []).append(quantise(row[of], ids[of], matrix))
                if sum(map(len, held[dim])) >= size:
                    yield from emit(dim, True)
        for dim in list(held):
            yield from emit(dim, False)

    return vectors.select("row", "id", "vector").mapInArrow(pack, BLOCK_SCHEMA)


def nearest(table: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product for each query row."""
    spark = table.sparkSession
    v = F.col(f"`{vector}`")
    rows = table.where(F.col(f"`{id}`").isNotNull() & usable(v)).select(F.col(f"`{id}`").cast("long").alias("id"), v.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    same = W.partitionBy("vector").orderBy("id")
    candidates = written(rows.select("id", "vector").withColumn("place", F.dense_rank().over(same)).where(F.col("place") <= k + 1).select("id", "vector").distinct().withColumn("row", F.monotonically_increasing_id()), "candidates")
    queries = written(rows.where("asks").select("id", "vector").distinct().withColumn("row", F.monotonically_increasing_id()), "queries")
    size = int(min(16384, max(1024, candidates.count() // 48)))  # rows of a block: tiles for many tasks, yet few copies of each block
    c, q = written(blocks(candidates, size), "blocks"), written(blocks(queries, size), "blocks")
    # query blocks in groups of about four, candidate blocks in as many groups as give every core two tiles
    n_q, n_c = q.count(), c.count()
    g = max(1, -(-n_q // 4))
    h = max(1, min(n_c, -(-2 * spark.sparkContext.defaultParallelism // g)))
    group = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tiles_c = c.select("dim", group(h).alias("h"), F.col("rows").alias("c"), every(g).alias("g"))
    tiles_q = q.select("dim", "block", group(g).alias("g"), F.col("rows").alias("q"), every(h).alias("h"))
    tiles = tiles_c.join(tiles_q, ["dim", "g", "h"]).sortWithinPartitions("dim", "g", "h", "block").select("dim", "g", "h", "block", "q", "c")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(j)[i].as_py() for j in range(4))
                kind = row_type(key[0])
                if key != held:
                    if bounds is not None:
                        yield from bounds.rows()
                    held, bounds = key, Bounds(np.frombuffer(batch.column(4)[i].as_py(), dtype=kind), k)
                bounds.meet(np.frombuffer(batch.column(5)[i].as_py(), dtype=kind))
        if bounds is not None:
            yield from bounds.rows()

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for (of, a), (_, b) in zip(_matrices(batch, 2), _matrices(batch, 3)):
                scores[of] = exact(a, b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["query_id", "vec_id", "score"])

    pairs = written(tiles.mapInArrow(search, PAIRS), "pairs")
    by_low = W.partitionBy("q").orderBy(F.desc("low"))
    least = pairs.withColumn("place", F.row_number().over(by_low)).where(F.col("place") <= k).groupBy("q").agg(F.count("*").alias("n"), F.min("low").alias("least"))
    open_pairs = pairs.join(least, "q").where((F.col("n") < k) | (F.col("high") >= F.col("least")))
    full = open_pairs.join(candidates.select(F.col("row").alias("c"), F.col("vector").alias("cv")), "c").join(queries.select(F.col("row").alias("q"), F.col("vector").alias("qv")), "q")
    found = full.select("query_id", "vec_id", "qv", "cv").mapInArrow(score, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    forget(spark, candidates, queries, c, q, pairs)
    return found
