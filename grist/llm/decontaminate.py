"""Benchmark decontamination with a distributed positional inverted index.

The index holds every term of the training texts.  It is sharded by document: a
shard, one row of a Parquet table in the shared folder, has the ascending term
hashes, the sizes of their posting lists, and the lists (word positions in the
shard), one after the other; numbers are stored byte by byte, lowest bytes
first, so that the high bytes compress to nothing.  Postings of a term thus never meet in one task,
however frequent it is, no posting is shuffled, and the index serves any test set.

Test texts are cut into windows of consecutive words and searched in passes of
at most about PASS_TERMS words, each sent to all tasks; equal texts are searched
once, and a text longer than SEGMENT words is cut with an overlap that keeps all
windows.  In a shard the list of a window's rarest term there, moved by the
term's offset, is intersected with the lists of the others, from the rarest on,
for all windows at once.  Proximity matches ask for all terms of a window, in
any order, within a span.

Terms are 64-bit hashes of lower-cased (A-Z) words.  Null and word-less texts
have no words; an item of fewer words than the window is one window; repeated
items and rows are treated as any other; a document row is known by its place
in the index, so repeated or null ids are kept apart.  Items with a null id
match, and count as the string ``null`` in the digest.  Without items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, release, written
from .words import ALNUM, U64, Words, slices

SHARD = 1_000_000  # characters of text in one shard at most (or one text)
PASS_TERMS = 1 << 20  # words of test texts searched in one pass, about 12 bytes each
SEGMENT = 1 << 16  # words of a test text in one row
PLACES = 1 << 20  # places of rarest terms that are looked at at once
INDEX = "shard long, ids array<long>, hashes array<long>, words array<long>, terms binary, sizes binary, places binary"
HITS = "shard long, doc int, runs array<struct<start:long,end:long>>, starts array<long>, found array<long>, near array<long>"


def planes(numbers: np.ndarray) -> bytes:
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def of_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def index_shards(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The INDEX of all texts: a row per shard."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release()
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts, hashes = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            for a, b in slices([len(t or "") for t in texts], SHARD):
                w = Words(texts[a:b], ALNUM)
                order = np.argsort(w.hash, kind="stable")
                terms = w.hash[order]
                begin = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])[: len(terms)])
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([shard], pa.int64()),
                    "ids": pa.array([ids[a:b].to_pylist()], pa.list_(pa.int64())),
                    "hashes": pa.array([hashes[a:b].to_pylist()], pa.list_(pa.int64())),
                    "words": pa.array([np.diff(w.first)], pa.list_(pa.int64())),
                    "terms": pa.array([terms[begin].astype("<u8").tobytes()], pa.binary()),
                    "sizes": pa.array([planes(np.diff(begin, append=len(terms)))], pa.binary()),
                    "places": pa.array([planes(order)], pa.binary()),
                })
                shard += 1

    rows = docs.select(F.col(f"`{id}`").cast("long"), F.col(f"`{text}`"), F.xxhash64(F.col(f"`{text}`")))
    return rows.mapInArrow(build, INDEX)


class Windows:
    """The windows of one pass: runs of ``length`` terms from ``start`` on in ``sequence``, which numbers the terms of ``vocabulary``."""

    def __init__(self, segments: Iterable[tuple[int, bytes]], size: int):
        rows = [(number, np.frombuffer(raw, dtype="<u8").astype(U64)) for number, raw in segments]
        self.size = size
        terms = np.concatenate([np.empty(0, dtype=U64), *[t for _, t in rows]])
        self.vocabulary, sequence = np.unique(terms, return_inverse=True)
        self.sequence = sequence.astype(np.int32)
        at, start, length, owner = 0, [], [], []
        for number, t in rows:
            n = max(1, len(t) - size + 1)
            start.append(np.arange(at, at + n, dtype=np.int64))
            length.append(np.full(n, min(size, len(t)), dtype=np.int64))
            owner.append(np.full(n, number, dtype=np.int64))
            at += len(t)
        none = np.empty(0, dtype=np.int64)
        self.start, self.length, self.owner = (np.concatenate([none, *x]) for x in (start, length, owner))


class Shard:
    """The posting lists of one shard."""

    def __init__(self, words: np.ndarray, terms: bytes, sizes: bytes, places: bytes):
        self.first = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
        self.terms, self.sizes, self.places = np.frombuffer(terms, dtype="<u8"), of_planes(sizes), of_planes(places)
        self.begin = np.cumsum(self.sizes) - self.sizes
        #: (term, place) of all postings, ascending
        self.keys = np.repeat(np.arange(len(self.terms)), self.sizes) << 32 | self.places

    def lists_of(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each term's list here, and the list's size (0 if there is none)."""
        if not len(self.terms):
            return np.zeros(len(vocabulary), dtype=np.int64), np.zeros(len(vocabulary), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, vocabulary), len(self.terms) - 1)
        return at, np.where(self.terms[at] == vocabulary, self.sizes[at], 0)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1

    def within(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a list has a place from ``low`` to ``high``."""
        at = np.searchsorted(self.keys, term << 32 | low)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= (term << 32 | high))

    def between(self, term: int, low: int, high: int) -> np.ndarray:
        a, b = np.searchsorted(self.keys, [term << 32 | low, (term << 32 | high) + 1])
        return self.keys[a:b] & 0xFFFFFFFF


def search(shard: Shard, w: Windows, span: int | None = None) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(window, place) of exact matches, the place being the first word's, and of near matches, where it is the rarest word's."""
    none = np.empty(0, dtype=np.int64)
    exact, close = ([none], [none]), ([none], [none])
    number, size = shard.lists_of(w.vocabulary)
    if not len(w.start) or not len(shard.keys):
        return (none, none), (none, none)
    offsets = np.arange(w.size)
    spread = np.minimum(w.start[:, None] + offsets, len(w.sequence) - 1)
    absent = offsets >= w.length[:, None]
    sizes = np.where(absent, np.iinfo(np.int64).max, size[w.sequence[spread]])
    live = np.flatnonzero(sizes.min(axis=1) > 0)
    order = np.argsort(sizes[live], axis=1, kind="stable")  # offsets, from the rarest term on
    rarest = sizes[live, order[:, 0]] if len(live) else none
    part = (np.cumsum(rarest) - 1) // PLACES
    for a, b in zip(*(lambda cut: (cut[:-1], cut[1:]))([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(live)])):
        if a == b:
            continue
        # every place of each window's rarest term
        row = np.repeat(np.arange(a, b), rarest[a:b])
        step = np.arange(len(row)) - np.repeat(np.cumsum(rarest[a:b]) - rarest[a:b], rarest[a:b])
        of = lambda row, k: number[w.sequence[spread[live[row], order[row, k]]]]  # noqa: B023, E731  the list of a window's k-th rarest term
        place = shard.places[shard.begin[of(row, 0)] + step]
        doc = shard.document(place)
        start = place - order[row, 0]
        fits = (start >= shard.first[doc]) & (start + w.length[live[row]] <= shard.first[doc + 1])
        hit, begin = row[fits], start[fits]
        for k in range(1, w.size):
            if not len(hit):
                break
            want = begin + order[hit, k]
            ok = (order[hit, k] >= w.length[live[hit]]) | shard.within(of(hit, k), want, want)
            hit, begin = hit[ok], begin[ok]
        exact[0].append(live[hit])
        exact[1].append(begin)
        if span:
            low, high = np.maximum(place - span + 1, shard.first[doc]), np.minimum(place + span - 1, shard.first[doc + 1] - 1)
            for k in range(1, w.size):
                if not len(row):
                    break
                ok = (order[row, k] >= w.length[live[row]]) | shard.within(of(row, k), low, high)
                row, place, low, high = row[ok], place[ok], low[ok], high[ok]
            ok = np.zeros(len(row), dtype=bool)
            for i in range(len(row)):
                lists = [shard.between(int(of(row[i : i + 1], k)[0]), int(low[i]), int(high[i])) for k in range(1, int(w.length[live[row[i]]]))]
                ok[i] = together(int(place[i]), int(low[i]), int(high[i]), lists, span)
            close[0].append(live[row[ok]])
            close[1].append(place[ok])
    return tuple(np.concatenate(x) for x in exact), tuple(np.concatenate(x) for x in close)


def together(place: int, low: int, high: int, lists: list[np.ndarray], span: int) -> bool:
    """Whether a run of ``span`` words holds ``place`` and a place of each list."""
    covered = np.full(place - low + 1, 0)  # by the run's first word, from low to place
    for places in lists:
        has = np.zeros(len(covered) + 1, dtype=np.int64)
        for p in places.tolist():
            a, b = max(low, p - span + 1), min(place, p)
            if a <= b:
                has[a - low] += 1
                has[b - low + 1] -= 1
        covered += np.cumsum(has)[:-1] > 0
    return bool((covered == len(lists)).any())


def runs_of(start: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """The spans (start, length), put together where they touch, as (start, end)."""
    out: list[tuple[int, int]] = []
    for a, n in sorted(set(zip(start.tolist(), length.tolist()))):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], a + n))
        else:
            out.append((a, a + n))
    return out


def matches(index: DataFrame, windows, span: int | None = None) -> DataFrame:
    """HITS of one pass: per document with a match the runs of words that are hit, the matches' first words, and the numbers of the texts found and nearly found."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        w = windows.value
        for batch in batches:
            for i in range(batch.num_rows):
                number, words, terms, sizes, places = (batch.column(k)[i].as_py() for k in range(5))
                shard = Shard(np.array(words, dtype=np.int64), terms, sizes, places)
                (hit, start), (close, place) = search(shard, w, span)
                doc, near = shard.document(start), shard.document(place)
                rows = []
                for d in np.unique(np.concatenate([doc, near])).tolist():
                    of, by = np.flatnonzero(doc == d), np.flatnonzero(near == d)
                    begin = start[of] - shard.first[d]
                    rows.append((d, [{"start": a, "end": b} for a, b in runs_of(begin, w.length[hit[of]])], np.unique(begin), np.unique(w.owner[hit[of]]), np.unique(w.owner[close[by]])))
                if rows:
                    kinds = (pa.int32(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), *[pa.list_(pa.int64())] * 3)
                    columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), *columns], names=["shard", "doc", "runs", "starts", "found", "near"])

    return index.select("shard", "words", "terms", "sizes", "places").mapInArrow(run, HITS)


def segments(texts: DataFrame, size: int) -> DataFrame:
    """(number, piece, n, terms) of (number, text): the words' hashes, in pieces of at most SEGMENT words that share ``size`` - 1 words."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms = Words([text], ALNUM).hash
                for piece, a in enumerate(range(0, max(1, len(terms) - size + 1), SEGMENT - size + 1)):
                    if len(terms):
                        rows.append((number, piece, len(terms[a : a + SEGMENT]), terms[a : a + SEGMENT].astype("<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["number", "piece", "n", "terms"])

    return texts.select("number", "text").mapInArrow(cut, "number long, piece int, n long, terms binary")


def contamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, span: int | None = None) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash (Spark's
    xxhash64), starts, items, near_items (with ``span``: items with a window all of whose words are in a run
    of that many words).
    """
    spark = docs.sparkSession
    tables = [index := written(index_shards(docs, id, text), "index")]
    items = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{item_text}`").alias("item text")).where("`item text` is not null")
    tables.append(texts := written(items.select("item text").distinct().select(F.monotonically_increasing_id().alias("number"), F.col("item text").alias("text")), "texts"))
    tables.append(cut := written(segments(texts, window), "segments"))
    passes = -(-(cut.agg(F.sum("n")).first()[0] or 0) // PASS_TERMS)
    parts = []
    for i in range(passes):
        some = cut.where(F.pmod(F.xxhash64("number", "piece"), F.lit(passes)) == i).select("number", "terms")
        windows = spark.sparkContext.broadcast(Windows(((r.number, r.terms) for r in some.toLocalIterator()), window))  # bounded by PASS_TERMS
        parts.append(written(matches(index, windows, span), "hits"))
        windows.unpersist()
    tables += parts
    hits = parts[0] if parts else spark.createDataFrame([], HITS)
    for more in parts[1:]:
        hits = hits.unionByName(more)
    named = items.join(texts.withColumnRenamed("text", "item text"), "item text").select("number", "item")

    def names(column: str) -> DataFrame:
        each = hits.select("shard", "doc", F.explode(column).alias("number")).join(named, "number")
        return each.groupBy("shard", "doc").agg(F.sort_array(F.collect_set("item")).alias(column))

    ordered = F.sort_array(F.flatten(F.collect_list("runs")))
    covered = "aggregate(runs, struct(0L as n, 0L as end), (s, r) -> struct(s.n + greatest(0L, r.end - greatest(r.start, s.end)) as n, greatest(s.end, r.end) as end), s -> s.n)"
    merged = hits.groupBy("shard", "doc").agg(ordered.alias("runs"), F.array_distinct(F.sort_array(F.flatten(F.collect_list("starts")))).alias("starts"))
    merged = merged.select("shard", "doc", F.expr(covered).alias("n_hit"), "starts")
    rows = index.select("shard", F.posexplode(F.arrays_zip("ids", "hashes", "words")).alias("doc", "row")).select("shard", "doc", F.col("row.ids").alias("doc_id"), F.col("row.hashes").alias("text_hash"), F.col("row.words").alias("n_words"))
    for more in (merged, names("found"), *([names("near")] if span else [])):
        rows = rows.join(more, ["shard", "doc"], "left")
    empty = F.expr("cast(array() as array<string>)")
    found = F.coalesce("found", empty)
    near = F.coalesce("near", empty) if span else empty
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    out = rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(found, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        "text_hash", F.coalesce("starts", F.expr("cast(array() as array<bigint>)")).alias("starts"), found.alias("items"), near.alias("near_items"),
    )
    out = written(out, "contamination")
    forget(spark, *tables)
    return out
