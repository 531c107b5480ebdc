"""N-gram Jaccard join by grouped prefixes.

Each text is the set of its distinct word k-shingles.  Two texts link when
``den * |intersection| >= num * |union|``.  The join is exact and works on
*classes* (texts with equal sets), so copies are never paired:

1. Shingle frequencies are counted into hashed buckets (their number follows
   the input, 16 MB at most); rare shingles come first in the global order.
2. Each class keeps the prefix of its ordered set that any partner must share
   a shingle with, and a parity bitmap whose Hamming distance never exceeds
   the symmetric difference, hence can only reject pairs that don't link.
3. Classes of equal prefix and size form a group.  Groups are posted under
   the shingles of their prefix, with the shingle's place in it.
4. Each posting list first holds every member against one leader, the leader's
   set being sent once per block of members; links make components.
5. Only pairs of different components remain in question.  Lists that still
   span several components are cut by size class, since only neighbouring
   classes can link, and each class into blocks of bounded size.  A pair of
   blocks is a tile.  A tile is filtered by sizes, by the places of the shared
   shingle (at a pair's first common shingle, what follows it must hold the
   whole overlap) and by short bitmaps, and gives the *members* that still have
   a partner, never pairs; equal member sets of different tiles are one.  Those
   members are filtered by their whole bitmaps, then by their sets, which a
   union-find over the tile's components ends early.  So a tile of m members
   gives m - 1 links at most, and no link between components is lost.

``jaccard_links`` lists all links between classes instead of a spanning set.

Defined cases: null, empty and word-less texts have size 0 and are their own
component; rows repeated under one id share a class or not like any others; a
null id is ignored when the smallest id of a component is taken, and a
component of null ids only has a null id.  Case folding is A-Z only.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import forget, release, written
from .words import NOT_SPACE, U64, Words, shingle_sets, slices

SLICE = 500_000  # characters of text that are hashed at once
TILE = 1024  # members of a posting list in one block
CHUNK = 1 << 14  # frequency buckets in one row
MOST_BITS = 24  # of a frequency bucket's number
BROADCAST_ROWS = 250_000  # keys of 4 bytes, about 8 MB as a hash table
SKETCH = 64  # bytes at most that a posting carries of its bitmap
PAIRS = 1 << 16  # pairs that are filtered at once
EXACT_BITS = 4096  # of the bitmaps beside whole sets


def _sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    for a, b in slices([0 if t is None else len(t) for t in texts], SLICE):
        yield from shingle_sets(Words(texts[a:b], NOT_SPACE), k)


def bucket_counts(texts: Iterable[list[str | None]], k: int, bits: int) -> np.ndarray:
    """How many shingles fall into each of 2**bits buckets; a slice costs what it holds, not what there are buckets."""
    total, one = np.zeros(1 << bits, dtype=np.uint32), np.uint32(1)
    for some in texts:
        for a, b in slices([0 if t is None else len(t) for t in some], SLICE):
            for s in shingle_sets(Words(some[a:b], NOT_SPACE), k):
                np.add.at(total, (s >> U64(64 - bits)).astype(np.int64), one)
    return total


def bucket_ranks(docs: DataFrame, text: str, k: int, bits: int) -> np.ndarray:
    """Frequency rank (logarithmic, one byte) of each of 2**bits shingle buckets, counted over all texts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = bucket_counts((b.column(0).to_pylist() for b in batches), k, bits)
        parts = np.minimum(total, 65535).astype(np.uint16).reshape(-1, min(CHUNK, 1 << bits))
        for i in np.flatnonzero(parts.any(axis=1)).tolist():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([i], pa.int32()), "counts": pa.array([parts[i].tobytes()], pa.binary())})

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(raw, dtype=np.uint16).astype(np.uint64)
        for i, v in sums.items():
            rank = np.minimum(255, np.log2(v.astype(np.float64) + 1) * 6).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([i], pa.int32()), "counts": pa.array([rank.tobytes()], pa.binary())})

    schema = "chunk int, counts binary"
    ranks = np.zeros(1 << bits, dtype=np.uint8).reshape(-1, min(CHUNK, 1 << bits))
    for row in docs.select(text).mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).toLocalIterator():
        ranks[row.chunk] = np.frombuffer(row.counts, dtype=np.uint8)
    return ranks.ravel()


def _bitmap(h: np.ndarray, size: int | None = None) -> np.ndarray:
    size = size or 1 << max(8, math.ceil(math.log2(2 * len(h))))
    return np.packbits(np.bincount((h & U64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little")


def _fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The last axis folded to ``size`` bytes by exclusive or."""
    while bitmap.shape[-1] > size:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] ^ bitmap[..., half:]
    return bitmap


def _least_partner(num: int, den: int) -> int:
    """The smallest set that can link with a set other than itself."""
    n = 1
    while num * (n + 1) > den * n:
        n += 1
    return n


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


SIGNED = "doc_id long, th long, n int, s1 long, s2 long, prefix array<int>, bitmap binary"


def signatures(docs: DataFrame, id: str, text: str, k: int, num: int, den: int, ranks, bits: int) -> DataFrame:
    """SIGNED per row; s1 and s2 identify the set, th the text; prefix has 32 bits of each shingle."""
    least = _least_partner(num, den)

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        order = ranks.value
        for batch in batches:
            n, s1, s2, prefix, bitmap = [], [], [], [], []
            for s in _sets(batch.column(1).to_pylist(), k):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    s1.append(int(s.sum(dtype=U64).astype(np.int64)))
                    s2.append(int(np.bitwise_xor.reduce(s * (s | U64(1)), initial=U64(len(s))).astype(np.int64)))
                if len(s) < least:
                    prefix.append(np.empty(0, dtype=np.int32))
                    bitmap.append(b"")
                    continue
                key = order[(s >> U64(64 - bits)).astype(np.int64)].astype(U64) << U64(56) | s >> U64(8)
                p = len(s) - -(-num * len(s) // den) + 1
                first = np.argpartition(key, p - 1)[:p] if p < len(s) else np.arange(len(s))
                first = first[np.argsort(key[first])]
                prefix.append((s[first] & U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
                bitmap.append(_bitmap(s).tobytes())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "th": batch.column(2), "n": pa.array(n, pa.int32()), "s1": pa.array(s1, pa.int64()), "s2": pa.array(s2, pa.int64()),
                "prefix": _lists(prefix, pa.int32()), "bitmap": pa.array(bitmap, pa.binary()),
            })

    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("th"))
    return rows.mapInArrow(sign, SIGNED)


def _whole_tiles(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows and the places where tiles (runs of equal values in the first ``keys`` columns) begin, no tile cut in two."""
    carry: list[pa.RecordBatch] = []

    def begins(table: pa.Table) -> np.ndarray:
        change = np.ones(table.num_rows, dtype=bool)
        change[1:] = False
        for i in range(keys):
            column = table.column(i).to_numpy()
            change[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        carry.append(batch)
        if all(carry[0].column(i)[0].as_py() == batch.column(i)[-1].as_py() for i in range(keys)):
            continue
        table = pa.Table.from_batches(carry)
        begin = begins(table)
        yield table.slice(0, begin[-1]), begin[:-1]
        carry = table.slice(begin[-1]).combine_chunks().to_batches()
    if carry:
        yield (table := pa.Table.from_batches(carry)), begins(table)


def _pairs(n: np.ndarray, comp: np.ndarray, num: int, den: int, rest: np.ndarray | None = None, half: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of rows sorted by n whose sizes, components, halves and what follows the shared shingle allow a link."""
    m = len(n)
    end = np.searchsorted(n, n * den // num, side="right")
    step = max(1, PAIRS // m)
    for a in range(0, m - 1, step):
        b, last = min(m, a + step), int(end[min(m, a + step) - 1])
        i, j = np.arange(a, b)[:, None], np.arange(a + 1, last)[None, :]
        if not j.size:
            continue
        ok = (j > i) & (j < end[a:b, None]) & (comp[a:b, None] != comp[None, a + 1 : last])
        if half is not None:
            ok &= half[a:b, None] != half[None, a + 1 : last]
        if rest is not None:
            ok &= np.minimum(rest[a:b, None], rest[None, a + 1 : last]) * (num + den) >= (n[a:b, None] + n[None, a + 1 : last]) * num
        x, y = np.nonzero(ok)
        if len(x):
            yield x + a, y + a + 1


def _close(p: np.ndarray, q: np.ndarray, total: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which rows of two bitmap matrices are near enough for a link between sets of ``total`` shingles together."""
    apart = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64)
    return apart * (den + num) <= total * (den - num)


def _partnered(n: np.ndarray, comp: np.ndarray, bitmaps: list[bytes], num: int, den: int, rest: np.ndarray | None = None, half: np.ndarray | None = None) -> np.ndarray:
    """Which rows, sorted by n, have a partner as far as their bitmaps say."""
    marked = np.zeros(len(n), dtype=bool)
    size = np.array([len(b) for b in bitmaps])
    level = {s: np.flatnonzero(size == s) for s in np.unique(size).tolist()}
    place = np.zeros(len(n), dtype=np.int64)
    for rows in level.values():
        place[rows] = np.arange(len(rows))
    whole = {s: np.frombuffer(b"".join(bitmaps[i] for i in rows.tolist()), dtype=np.uint8).reshape(len(rows), s) for s, rows in level.items()}
    folded: dict[tuple[int, int], np.ndarray] = {}
    for i, j in _pairs(n, comp, num, den, rest, half):
        new = ~(marked[i] & marked[j])
        i, j = i[new], j[new]
        for s in np.unique(np.minimum(size[i], size[j])).tolist():
            for t in np.unique(np.maximum(size[i], size[j])).tolist():
                at = np.flatnonzero((np.minimum(size[i], size[j]) == s) & (np.maximum(size[i], size[j]) == t))
                for c in np.split(at, range(max(1, (4 << 20) // s), len(at), max(1, (4 << 20) // s))):
                    if not len(c):
                        continue
                    x, y = (i[c], j[c]) if size[i[c[0]]] <= size[j[c[0]]] else (j[c], i[c])
                    if (t, s) not in folded:
                        folded[t, s] = np.ascontiguousarray(_fold(whole[t], s)).view(np.uint64)
                        folded[s, s] = whole[s].view(np.uint64)
                    ok = _close(folded[s, s][place[x]], folded[t, s][place[y]], n[x] + n[y], num, den)
                    marked[x[ok]] = marked[y[ok]] = True
    return marked


FEW = 16  # members of a tile that is filtered together with others


def _partnered_few(begin: np.ndarray, size: np.ndarray, n: np.ndarray, comp: np.ndarray, bitmaps: list[bytes], num: int, den: int, rest: np.ndarray, half: np.ndarray, split: np.ndarray) -> np.ndarray:
    """``_partnered`` for all tiles of at most FEW members at once: their first members are held against the second, and so on."""
    few = np.flatnonzero((size > 1) & (size <= FEW))
    of = np.repeat(few, size[few])
    marked = np.zeros(len(n), dtype=bool)
    if not len(of):
        return marked
    rows = np.repeat(begin[few] - np.cumsum(size[few]) + size[few], size[few]) + np.arange(len(of))
    left = begin[of] + size[of] - rows
    length = np.array([len(bitmaps[i]) for i in rows.tolist()])
    place = np.zeros(len(n), dtype=np.int64)
    place[rows] = np.arange(len(rows))
    short = length.min()
    folded = np.stack([_fold(np.frombuffer(bitmaps[i], dtype=np.uint8), short) for i in rows.tolist()]).view(np.uint64)
    full = np.zeros((len(rows), length.max()), dtype=np.uint8)
    for at, i in enumerate(rows.tolist()):
        full[at, : length[at]] = np.frombuffer(bitmaps[i], dtype=np.uint8)
    full = full.view(np.uint64)
    for step in range(1, int(size[few].max())):
        i = rows[left > step]
        j = i + step
        ok = (n[j] * num <= n[i] * den) & (comp[i] != comp[j]) & ((split[i] == 0) | (half[i] != half[j])) & ~(marked[i] & marked[j])
        ok &= np.minimum(rest[i], rest[j]) * (num + den) >= (n[i] + n[j]) * num
        i, j = i[ok], j[ok]
        near = _close(folded[place[i]], folded[place[j]], n[i] + n[j], num, den)
        i, j = i[near], j[near]
        even = length[place[i]] == length[place[j]]
        near = ~even | _close(full[place[i]], full[place[j]], n[i] + n[j], num, den)
        marked[i[near]] = marked[j[near]] = True
    return marked


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(x).to_numpy().astype(np.int64) for x in names]


def _filter_tiles(num: int, den: int, keys: int):
    """Per tile the members that still have a partner, ascending; rows come sorted by the keys and n."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in _whole_tiles(batches, keys):
            size = np.diff(begin, append=table.num_rows)
            n, comp, node = _numbers(table, "n", "comp", "node")
            bitmaps = table.column("bitmap").to_pylist()
            marked, most, more = np.zeros(len(n), dtype=bool), 1, None
            if "rest" in table.column_names:
                most, more = FEW, _numbers(table, "rest", "half", "split")
                marked = _partnered_few(begin, size, n, comp, bitmaps, num, den, *more)
            for t in np.flatnonzero(size > most).tolist():
                at = slice(int(begin[t]), int(begin[t] + size[t]))
                rest = half = None
                if more:
                    rest, half = more[0][at], more[1][at] if more[2][at][0] else None
                marked[at] = _partnered(n[at], comp[at], bitmaps[at], num, den, rest, half)
            at = np.flatnonzero(marked)
            if len(at):
                tile, found = np.searchsorted(begin, at, side="right"), node[at]
                order = np.lexsort((found, tile))
                tile, found = tile[order], found[order]
                new = np.ones(len(found), dtype=bool)
                new[1:] = (tile[1:] != tile[:-1]) | (found[1:] != found[:-1])
                tile, found = tile[new], found[new]
                yield pa.RecordBatch.from_pydict({"members": _lists(np.split(found, np.flatnonzero(np.diff(tile)) + 1), pa.int64())})

    return run


def _overlap(p: np.ndarray, q: np.ndarray) -> int:
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    return int((q[np.minimum(at, len(q) - 1)] == p).sum())


def _links(p: np.ndarray, q: np.ndarray, num: int, den: int) -> bool:
    both = _overlap(p, q)
    return den * both >= num * (len(p) + len(q) - both)


class Verifier:
    """Links of one tile's members, which come in order of their sizes; of each pair of components one link only, unless all are asked for."""

    def __init__(self, num: int, den: int, every: bool):
        self.num, self.den, self.every = num, den, every
        self.node: list[int] = []
        self.set: list[np.ndarray] = []
        self.n, self.comp = np.zeros(64, dtype=np.int64), np.zeros(64, dtype=np.int64)
        self.bits = np.zeros((64, EXACT_BITS // 64), dtype=np.uint64)
        self.begin, self.root = 0, {}

    def add(self, node: int, comp: int, s: np.ndarray) -> list[tuple[int, int]]:
        while (up := self.root.get(comp, comp)) != comp:
            comp = up
        n, e = len(s), len(self.node)
        if e == len(self.n):
            self.n, self.comp = np.concatenate([self.n, np.zeros_like(self.n)]), np.concatenate([self.comp, np.zeros_like(self.comp)])
            self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
        while self.begin < e and self.n[self.begin] * self.den < n * self.num:  # too small for all that follow
            self.set[self.begin] = np.empty(0, dtype=U64)
            self.begin += 1
        bits = _bitmap(s, EXACT_BITS).view(np.uint64)
        at = self.begin + np.flatnonzero(self.comp[self.begin : e] != comp)
        at = at[_close(self.bits[at], bits, self.n[at] + n, self.num, self.den)]
        found = []
        for i in at.tolist():
            if self.comp[i] != comp and _links(self.set[i], s, self.num, self.den):
                found.append((self.node[i], node))
                if not self.every:
                    old = int(self.comp[i])
                    self.root[old] = comp
                    self.comp[self.begin : e][self.comp[self.begin : e] == old] = comp
        self.node.append(node)
        self.set.append(s)
        self.n[e], self.comp[e], self.bits[e] = n, comp, bits
        return found


def _verify_tiles(k: int, num: int, den: int, every: bool):
    """(tile, node, comp, text), sorted by tile and size, to links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, verifier = None, None
        for batch in batches:
            tile, node, comp, texts = (c.to_pylist() for c in batch.columns)
            found: list[tuple[int, int]] = []
            for i, s in enumerate(_sets(texts, k)):
                if tile[i] != held or verifier is None:
                    held, verifier = tile[i], Verifier(num, den, every)
                found += verifier.add(node[i], comp[i], s)
            yield _pair_batch(found)

    return run


def _filter_stars(num: int, den: int):
    """(lead, part, follows, node, n, bitmap), each leader before its followers, to the followers that may link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader: tuple[int, int, np.ndarray] | None = None
        for batch in batches:
            lead, follows, node, n, bitmap = (batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))
            found = []
            for i, raw in enumerate(bitmap):
                bits = np.frombuffer(raw, dtype=np.uint8)
                if not follows[i]:
                    leader = (node[i], n[i], bits)
                    continue
                size = min(len(bits), len(leader[2]))
                apart = int(np.bitwise_count(_fold(bits, size) ^ _fold(leader[2], size)).sum())
                if apart * (den + num) <= (n[i] + leader[1]) * (den - num):
                    found.append((lead[i], node[i]))
            yield _pair_batch(found)

    return run


def _verify_stars(k: int, num: int, den: int):
    """(lead, part, follows, node, n, text), each leader before its followers, to links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = None
        for batch in batches:
            follows, lead, node, texts = (batch.column(i).to_pylist() for i in (2, 0, 3, 5))
            found = []
            for i, s in enumerate(_sets(texts, k)):
                if not follows[i]:
                    leader = s
                elif _links(leader, s, num, den):
                    found.append((lead[i], node[i]))
            yield _pair_batch(found)

    return run


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


class Join:
    """One run of the join: its parameters and its tables in the shared folder."""

    def __init__(self, docs: DataFrame, id: str, text: str, k: int, num: int, den: int):
        if not 0 < num < den:
            raise ValueError("the similarity must lie between 0 and 1")
        self.docs, self.id, self.text, self.k, self.num, self.den = docs, id, text, k, num, den
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(written(df, name))
        return self.tables[-1]

    def drop(self) -> None:
        forget(self.docs.sparkSession, *self.tables)
        self.tables.clear()

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """The signed rows, and a row per class."""
        spark, text = self.docs.sparkSession, F.col(f"`{self.text}`").alias("text")
        bits = min(MOST_BITS, max(12, math.ceil(math.log2(max(1, self.docs.count()) * 2))))
        ranks = spark.sparkContext.broadcast(bucket_ranks(self.docs.select(text), "text", self.k, bits))
        signed = self.keep(signatures(self.docs, self.id, self.text, self.k, self.num, self.den, ranks, bits), "signed")
        ranks.unpersist()
        first = [F.any_value(c).alias(c) for c in ("prefix", "bitmap")]
        classes = signed.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.min("th").alias("th"), *first)
        return signed, self.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def postings(self, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(tok, pos, lead, n, copies) of the lists that can hold a link, and (node, lead, n, prefix) of the classes that follow a group's lead."""
        small = classes.select("node", "n", "copies", "prefix").where("size(prefix) > 0")
        groups = self.keep(small.groupBy("n", "prefix").agg(F.max_by("node", F.struct("copies", "node")).alias("lead"), F.sum("copies").alias("copies"), F.count("*").alias("members")), "groups")
        within = self.keep(small.join(groups.where("members > 1").select("n", "prefix", "lead"), ["n", "prefix"]).where("node <> lead").select("node", "lead", "n", "prefix"), "within")
        token = groups.select(F.posexplode("prefix").alias("pos", "tok"), "lead", "n", "copies")
        # at a pair's first common shingle, what follows it in the smaller set holds the whole overlap
        several = self.keep(token.groupBy("tok").agg(F.count("*").alias("size"), F.max(self.early()).alias("early")).where("size > 1 and early").select("tok"), "several")
        few = several.count() <= BROADCAST_ROWS
        posted = token.join(F.broadcast(several) if few else several, "tok", "left_semi").select("tok", "pos", "lead", "n", "copies")
        return self.keep(posted, "posted"), within

    def early(self) -> Column:
        """Whether a set can be the smaller one of a pair whose first common shingle stands at ``pos``."""
        return F.expr(f"(n - pos) * {self.num + self.den} >= 2 * n * {self.num}")

    def sides(self, pairs: DataFrame) -> DataFrame:
        """(lead, part, follows, node): followers in parts of bounded size, the leader before each part."""
        parts = pairs.groupBy("lead").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
        dealt = pairs.join(parts, "lead").select("lead", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("follows"), "node")
        leads = parts.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("follows"), F.col("lead").alias("node"))
        return dealt.unionByName(leads)

    def with_text(self, rows: DataFrame, classes: DataFrame) -> DataFrame:
        """``rows`` with the text of each row's ``node``; only texts that are asked for are moved."""
        keyed = self.keep(rows.join(classes.select("node", "th"), "node"), "keyed")
        wanted = self.keep(keyed.select("th").distinct(), "wanted")
        small = wanted.count() <= BROADCAST_ROWS
        hashed = self.docs.select(F.xxhash64(F.col(f"`{self.text}`")).alias("th"), F.col(f"`{self.text}`").alias("text"))
        texts = self.keep(hashed.join(F.broadcast(wanted) if small else wanted, "th", "left_semi").groupBy("th").agg(F.any_value("text").alias("text")), "texts")
        return keyed.join(texts, "th")

    def star_links(self, posted: DataFrame, within: DataFrame, classes: DataFrame) -> DataFrame:
        """Links (a, b) of members with the leaders of their lists."""
        leaders = self.keep(posted.groupBy("tok").agg(F.max_by(F.struct("lead", "n"), F.struct("copies", "lead")).alias("leader")), "leaders")
        fits = f"least(n, leader.n) * {self.den} >= greatest(n, leader.n) * {self.num}"
        stars = posted.join(leaders, "tok").where("lead <> leader.lead").where(fits).select(F.col("lead").alias("node"), F.col("leader.lead").alias("lead"))
        stars = self.keep(stars.unionByName(within.select("node", "lead")).distinct(), "stars")
        dealt = self.sides(stars).join(classes.select("node", "n", "bitmap"), "node").select("lead", "part", "follows", "node", "n", "bitmap")
        order = ["lead", "part", "follows"]
        near = dealt.repartition("lead", "part").sortWithinPartitions(*order).mapInArrow(_filter_stars(self.num, self.den), "a long, b long")
        near = self.keep(near.select(F.col("a").alias("lead"), F.col("b").alias("node")), "near")
        full = self.with_text(self.sides(near), classes).select("lead", "part", "follows", "node", F.lit(0).alias("n"), "text")
        return self.keep(full.repartition("lead", "part").sortWithinPartitions(*order).mapInArrow(_verify_stars(self.k, self.num, self.den), "a long, b long"), "links")

    def entries(self, posted: DataFrame, within: DataFrame, placed: DataFrame) -> DataFrame:
        """Members of lists that span components, once per tile: (tok, lo, hi, t1, t2, n, node, comp, rest, half, split)."""
        members = posted.select("tok", "pos", F.col("lead").alias("node"))
        followers = within.select("node", "lead")
        members = members.unionByName(posted.select("tok", "pos", "lead").join(followers, "lead").select("tok", "pos", "node"))
        # a group alone in its lists may have members in several components
        alone = within.select("lead", F.element_at("prefix", 1).alias("tok")).distinct().join(posted.select("tok").distinct(), "tok", "left_anti")
        alone = alone.join(followers, "lead").select("tok", "node").unionByName(alone.select("tok", F.col("lead").alias("node"))).select("tok", F.lit(0).alias("pos"), "node")
        ratio = math.log(self.den / self.num * (1 + 1e-9))  # sets that link are of one size class or of neighbouring ones
        spans = members.unionByName(alone).join(placed, "node").withColumn("cls", F.floor(F.log("n") / ratio).cast("int"))
        spans = self.keep(spans, "spans")
        made = spans.groupBy("tok", "cls").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max(self.early()).alias("early"))
        made = self.keep(made, "sizes")
        same = made.where("early and c0 <> c1").select("tok", "cls", F.col("cls").alias("lo"), F.col("cls").alias("hi"), F.col("blocks").alias("own"), F.col("blocks").alias("other"))
        above = made.select("tok", (F.col("cls") - 1).alias("cls"), F.col("blocks").alias("more"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
        both = made.where("early").join(above, ["tok", "cls"]).where("c0 <> d0 or c0 <> c1 or d0 <> d1")
        low = both.select("tok", "cls", F.col("cls").alias("lo"), (F.col("cls") + 1).alias("hi"), F.col("blocks").alias("own"), F.col("more").alias("other"))
        high = both.select("tok", (F.col("cls") + 1).alias("cls"), F.col("cls").alias("lo"), (F.col("cls") + 1).alias("hi"), F.col("more").alias("own"), F.col("blocks").alias("other"))
        roles = self.keep(same.unionByName(low).unionByName(high), "roles")
        dealt = spans.join(roles, ["tok", "cls"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))
        dealt = dealt.withColumn("against", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
        first = F.when(F.col("lo") == F.col("hi"), F.least("block", "against")).when(F.col("cls") == F.col("lo"), F.col("block")).otherwise(F.col("against"))
        second = F.when(F.col("lo") == F.col("hi"), F.greatest("block", "against")).when(F.col("cls") == F.col("lo"), F.col("against")).otherwise(F.col("block"))
        dealt = dealt.select("tok", "lo", "hi", first.alias("t1"), second.alias("t2"), "n", "node", "comp", (F.col("n") - F.col("pos")).alias("rest"), "cls", "block")
        half = F.when(F.col("lo") == F.col("hi"), F.col("block") == F.col("t1")).otherwise(F.col("cls") == F.col("lo")).cast("int")
        split = ((F.col("lo") < F.col("hi")) | (F.col("t1") < F.col("t2"))).cast("int")
        return dealt.withColumn("half", half).withColumn("split", split).drop("cls", "block")

    def tile_links(self, entries: DataFrame, placed: DataFrame, classes: DataFrame, every: bool) -> DataFrame:
        """Links (a, b) between the components that meet in a tile."""
        keys = ["tok", "lo", "hi", "t1", "t2"]
        short = SKETCH

        def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cut = [_fold(np.frombuffer(b, dtype=np.uint8), short).tobytes() for b in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.binary())], names=["node", "bitmap"])

        sketches = classes.where("size(prefix) > 0").select("node", "bitmap").mapInArrow(sketch, "node long, bitmap binary")
        tiles = entries.join(sketches, "node").select(*keys, "n", "node", "comp", "rest", "half", "split", "bitmap")
        tiles = tiles.repartition(*keys).sortWithinPartitions(*keys, "n", "node").mapInArrow(_filter_tiles(self.num, self.den, len(keys)), "members array<long>")
        for bitmap in (True, False):
            tiles = self.keep(tiles.distinct().withColumn("tile", F.monotonically_increasing_id()), "tiles")
            rows = tiles.select("tile", F.explode("members").alias("node")).join(placed, "node")
            if bitmap:
                rows = rows.join(classes.select("node", "bitmap"), "node").select("tile", "n", "node", "comp", "bitmap")
                tiles = rows.repartition("tile").sortWithinPartitions("tile", "n", "node").mapInArrow(_filter_tiles(self.num, self.den, 1), "members array<long>")
        full = self.with_text(rows, classes).select("tile", "n", "node", "comp", "text")
        full = full.repartition("tile").sortWithinPartitions("tile", "n", "node").select("tile", "node", "comp", "text")
        return self.keep(full.mapInArrow(_verify_tiles(self.k, self.num, self.den, every), "a long, b long"), "links")


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash) per row: the smallest id that links lead to from it, and Spark's xxhash64 of its text."""
    join = Join(docs, id, text, k, num, den)
    signed, classes = join.classes()
    posted, within = join.postings(classes)
    links = join.star_links(posted, within, classes)
    parts = connected_components(links)
    placed = join.keep(classes.where("size(prefix) > 0").select("node", "n").join(parts, "node", "left").select("node", "n", F.coalesce("component", "node").alias("comp")), "placed")
    more = join.tile_links(join.entries(posted, within, placed), placed, classes, False)
    parts = connected_components(links.unionByName(more))
    named = classes.join(parts, "node", "left").select("s1", "s2", "least_id", F.coalesce("component", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    result = join.keep(named.join(least, "comp").select("s1", "s2", "component_id"), "named")
    out = ["doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("th").alias("text_hash")]
    found = signed.where("n > 0").join(result, ["s1", "s2"], "left").select(*out)
    found = written(found.unionByName(signed.where("n = 0").withColumn("component_id", F.col("doc_id")).select(*out)), "components")
    join.drop()
    return found


def jaccard_links(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, num: int = 8, den: int = 10) -> tuple[DataFrame, DataFrame]:
    """All links between different shingle sets, and who has them.

    (class_a, class_b), class_a < class_b, and (doc_id, n_shingles, class_id, n_links): n_links counts the
    other rows that a row links with, copies included.  Rows of size 0 have no class and no links.
    """
    join = Join(docs, id, text, k, num, den)
    signed, classes = join.classes()
    posted, within = join.postings(classes)
    placed = join.keep(classes.where("size(prefix) > 0").select("node", "n", F.col("node").alias("comp")), "placed")
    found = join.tile_links(join.entries(posted, within, placed), placed, classes, True)
    links = written(found.select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b")).distinct(), "class-links")
    both = links.unionByName(links.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    others = both.join(classes.select(F.col("node").alias("class_b"), "copies"), "class_b").groupBy("class_a").agg(F.sum("copies").alias("others"))
    counted = classes.select("s1", "s2", "node", "copies").join(others.withColumnRenamed("class_a", "node"), "node", "left")
    counted = counted.select("s1", "s2", F.col("node").alias("class_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = ["doc_id", F.col("n").cast("long").alias("n_shingles"), "class_id", "n_links"]
    rows = signed.where("n > 0").join(counted, ["s1", "s2"], "left").select(*out)
    rows = written(rows.unionByName(signed.where("n = 0").withColumn("class_id", F.lit(None).cast("long")).withColumn("n_links", F.lit(0).cast("long")).select(*out)), "members")
    join.drop()
    return links, rows
