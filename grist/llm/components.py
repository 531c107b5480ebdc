"""Connected components by alternating large-star and small-star contraction.

Tasks first contract what edges they hold, about LOCAL each, to stars; where one
task holds all of them that is the result.  Otherwise rounds follow, every step
of which is a grouped minimum (combined before the shuffle) and a join that
adaptive execution can split, so a hub with a third of all edges is no single
task's work.  Each step's table is written to the shared folder, hence no
lineage grows and a lost executor repeats one step only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, written

LOCAL = 250_000  # edges that one task contracts, about 200 bytes each


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) edges to (node, least node reached) for every node but the least ones."""
    root: dict = {}

    def find(x):
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    rows = [(x, find(x)) for x in root]
    rows = [r for r in rows if r[0] != r[1]]
    for i in range(0, len(rows), 100_000):
        part = rows[i : i + 100_000]
        yield pa.RecordBatch.from_pydict({"u": pa.array([r[0] for r in part], kind), "v": pa.array([r[1] for r in part], kind)})


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node that can be reached.

    Edges have no direction; nulls, loops and repeated edges are ignored.  No edges give an empty table.
    """
    spark = edges.sparkSession
    a, b = F.col(a), F.col(b)
    given = written(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "edges")
    tasks = -(-given.count() // LOCAL)
    now = written(given.coalesce(max(1, tasks)).mapInArrow(_contract, given.schema), "stars")
    forget(spark, given)
    state = _fingerprint(now) if tasks > 1 else (0,)
    while state[0]:  # each round shortens paths; a round that changes nothing is the last
        # large star: each node hands the least of its neighbourhood to its larger neighbours
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: each node hands the least of its smaller neighbours to the others of them
        least2 = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least2.select("u", F.col("m").alias("v"))).distinct()
        small = written(small, "small")
        before, state = state, _fingerprint(small)
        forget(spark, now, least, large, least2)
        now = small
        if state == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
