"""Language identification by a linear-chain conditional random field over words.

Each word has hashed character n-gram features, affix features (n-grams that
touch a word's edge) and a lexicon feature (the whole word).  Feature weights
and label transitions are learned together by gradient ascent on the sequence
likelihood; forward-backward gives each word's label probabilities, so a text
that switches language is labelled word by word.  A text's language is the
label with the largest mean probability over its words.

The model is fitted on the driver on a sample of at most about
``sample_per_label`` distinct texts a label, whole, chosen by a hash of their
text; the bound does not grow with the table.  Prediction reads whole texts.

Defined cases: null, empty and letterless texts are ``und`` with score 0; rows
with a null label are never learned from; without any labelled text everything
is ``und``; equal probabilities go to the label that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import release
from .words import U64, mix, slices

WORD = re.compile(r"[^\W\d_]+")
SLICE = 300_000  # characters labelled at once
CHUNK = 256  # positions of a chain that are scanned one by one
CACHED = 100_000  # words
FEATURE_BITS = 18


def words_of(text: str | None) -> list[str]:
    found = WORD.findall(text.lower()) if text else []
    return found if any(any(map(str.isalpha, w)) for w in found) else []


def features(words: Sequence[str], bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words, one after the other, and where each word's begin."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(U64)
    length = np.array([len(w) + 2 for w in words], dtype=np.int64)
    word = np.repeat(np.arange(len(words)), length)
    edge = (code == 2) | (code == 3)
    owner, value = [], []
    rolled = np.zeros(len(code), dtype=U64)
    power = 1
    whole = np.zeros(len(words), dtype=U64)
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            k = len(code) - n + 1
            if k <= 0:
                break
            rolled = rolled[:k] * U64(0x100000001B3) + code[n - 1 :]
            inside = word[:k] == word[n - 1 :]
            if n == 1:
                inside &= ~edge
            elif n == 4:  # affixes of three letters only
                inside &= edge[:k] | edge[n - 1 :]
            at = np.flatnonzero(inside)
            owner.append(word[at])
            value.append(mix(rolled[at] + U64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
        begin = np.cumsum(length) - length
        place = (np.arange(len(code)) - np.repeat(begin, length)).astype(U64)
        whole = np.add.reduceat(mix(code * U64(0x9E3779B97F4A7C15) + place), begin) if len(words) else whole
    owner.append(np.arange(len(words)))
    value.append(mix(whole))
    owner, value = np.concatenate(owner), np.concatenate(value)
    order = np.argsort(owner, kind="stable")
    return (value[order] & U64((1 << bits) - 1)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(words)))


class Chain:
    """Forward-backward over many sequences laid end to end; a start resets the chain.

    The scan runs over blocks of CHUNK positions at once: products of the
    blocks' transfer matrices first, then the blocks in turn, then within them.
    """

    def __init__(self, emission: np.ndarray, starts: np.ndarray, transition: np.ndarray, initial: np.ndarray):
        n, k = emission.shape
        self.n, self.k, c = n, k, max(1, -(-n // CHUNK))
        e = np.ones((c * CHUNK, k))
        e[:n] = np.exp(emission - emission.max(axis=1, keepdims=True))
        reset = np.zeros(c * CHUNK, dtype=bool)
        reset[starts] = reset[n:] = True  # what fills the last block is cut off
        self.reset = reset[:n]
        a, first = np.exp(transition - transition.max()), np.exp(initial - initial.max())
        e, r = np.ascontiguousarray(e.reshape(c, CHUNK, k).swapaxes(0, 1)), reset.reshape(c, CHUNK).T
        at_reset = [np.flatnonzero(x) for x in r]
        ones, repeated = np.ones((k, 1)), e[:, :, None, :]
        forward, product = np.empty_like(e), np.broadcast_to(np.eye(k), (c, k, k)).copy()
        for t in range(CHUNK):
            moved = (product.reshape(-1, k) @ a).reshape(c, k, k)
            if len(i := at_reset[t]):
                moved[i] = product[i].sum(axis=2, keepdims=True) * first
            product = moved * repeated[t]
            if t % 8 == 7:
                product /= (product.reshape(c, -1) @ np.ones((k * k, 1)))[:, :, None]
        before, after = np.empty((c, k)), np.empty((c, k))
        v = np.full(k, 1 / k)
        for i in range(c):
            before[i] = v
            v = v @ product[i]
            v /= v.sum()
        v = np.ones(k)
        for i in range(c - 1, -1, -1):
            after[i] = v
            v = product[i] @ v
            v /= v.sum()
        v = before
        for t in range(CHUNK):
            moved = v @ a
            if len(i := at_reset[t]):
                moved[i] = v[i].sum(axis=1, keepdims=True) * first
            v = moved * e[t]
            v /= v @ ones
            forward[t] = v
        backward, v = np.empty_like(e), after
        for t in range(CHUNK - 1, -1, -1):
            backward[t] = v
            w = v * e[t]
            v = w @ a.T
            if len(i := at_reset[t]):
                v[i] = (w[i] @ first)[:, None]
            v /= v @ ones
        forward, backward, e = (x.swapaxes(0, 1) for x in (forward, backward, e))
        self.forward, self.backward = forward.reshape(-1, k)[:n], backward.reshape(-1, k)[:n]
        self.e, self.a = e.reshape(-1, k)[:n], a
        self.marginal = self.forward * self.backward
        self.marginal /= self.marginal.sum(axis=1, keepdims=True)

    def transitions(self) -> np.ndarray:
        """Expected number of each label pair at neighbouring positions of a sequence."""
        at = np.flatnonzero(~self.reset[1:]) + 1
        left, right = self.forward[at - 1], self.e[at] * self.backward[at]
        weight = 1 / np.einsum("ni,ij,nj->n", left, self.a, right)
        return np.einsum("ni,nj->ij", left * weight[:, None], right) * self.a


class Model:
    """Learned labels, feature weights, transitions; ``emissions`` caches words."""

    def __init__(self, labels: list[str], weights: np.ndarray, transition: np.ndarray, initial: np.ndarray):
        self.labels, self.weights, self.transition, self.initial = labels, weights, transition, initial

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("labels", "weights", "transition", "initial")}

    def emissions(self, words: Sequence[str]) -> np.ndarray:
        ids, begin = features(words)
        return np.add.reduceat(self.weights[ids], begin, axis=0)

    def _rows(self, texts_words: list[list[str]]) -> np.ndarray:
        index, table, used = self.__dict__.setdefault("_cache", ({}, np.empty((0, len(self.labels)), dtype=np.float32), 0))
        if used > CACHED:
            index, table, used = {}, table, 0
        new = list(set(chain.from_iterable(texts_words)).difference(index))
        if new:
            if used + len(new) > len(table):
                table = np.concatenate([table[:used], np.empty((len(new) + used, table.shape[1]), dtype=np.float32)])
            table[used : used + len(new)] = self.emissions(new)
            index.update(zip(new, range(used, used + len(new))))
            used += len(new)
        self._cache = (index, table, used)
        return table[np.fromiter(map(index.__getitem__, chain.from_iterable(texts_words)), dtype=np.int64)]

    def marginals(self, texts_words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of all words, and where each text's begin (and the last ends)."""
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in texts_words])]).astype(np.int64)
        if bounds[-1] == 0:
            return np.empty((0, len(self.labels))), bounds
        starts = bounds[:-1][np.diff(bounds) > 0]
        return Chain(self._rows(texts_words), starts, self.transition, self.initial).marginal, bounds

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.labels:
            return [("und", 0.0)] * len(texts)
        out: list[tuple[str, float]] = []
        for lo, hi in slices([len(t or "") for t in texts], SLICE):
            words = [words_of(t) for t in texts[lo:hi]]
            p, bounds = self.marginals(words)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if a == b:
                    out.append(("und", 0.0))
                else:
                    mean = p[a:b].mean(axis=0)
                    best = int(mean.argmax())
                    out.append((self.labels[best], min(1.0, float(mean[best]))))
        return out

    def label_words(self, text: str | None) -> list[tuple[str, str, float]]:
        """(word, label, probability) for each word of one text."""
        words = words_of(text)
        if not words or not self.labels:
            return [(w, "und", 0.0) for w in words]
        p, _ = self.marginals([words])
        best = p.argmax(axis=1)
        return [(w, self.labels[i], float(q[i])) for w, i, q in zip(words, best, p)]


def fit(examples: Iterable[tuple[str | None, str]], rounds: int = 20, rate: float = 0.3, decay: float = 1e-5, joined: int = 8) -> Model:
    """Learns from (text, label); runs of ``joined`` texts make one sequence, so that label changes occur in it."""
    rows = sorted({(t, label) for t, label in examples if t and words_of(t)}, key=lambda r: int(mix(np.array([hash_of(r[0])], dtype=U64))[0]))
    labels = sorted({label for _, label in rows})
    k = len(labels)
    weights = np.zeros((1 << FEATURE_BITS, k), dtype=np.float32)
    transition, initial = np.zeros((k, k)), np.zeros(k)
    if k < 2:
        return Model(labels, weights, transition, initial)
    words = [words_of(t) for t, _ in rows]
    index: dict[str, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for ws in words for w in ws])
    gold = np.repeat([labels.index(label) for _, label in rows], [len(w) for w in words])
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])[:-1][::joined]
    flat, begin = features(list(index))
    size = np.diff(begin, append=len(flat))
    used, place = np.unique(flat, return_inverse=True)
    w = np.zeros((len(used), k))
    after = np.ones(len(ids), dtype=bool)
    after[starts] = False
    at = np.flatnonzero(after)
    seen = np.bincount(gold[at - 1] * k + gold[at], minlength=k * k).reshape(k, k)
    opened = np.bincount(gold[starts], minlength=k)
    steps = [np.zeros_like(w), np.zeros_like(transition), np.zeros_like(initial)]
    for _ in range(rounds):
        emission = np.add.reduceat(w[place], begin, axis=0)
        now = Chain(emission[ids], starts, transition, initial)
        wrong = -now.marginal
        wrong[np.arange(len(ids)), gold] += 1
        per_word = np.stack([np.bincount(ids, weights=wrong[:, j], minlength=len(index)) for j in range(k)], axis=1)
        g = np.stack([np.bincount(place, weights=np.repeat(per_word[:, j], size), minlength=len(used)) for j in range(k)], axis=1)
        grads = [g - decay * len(ids) * w, seen - now.transitions() - decay * len(ids) * transition, opened - now.marginal[starts].sum(axis=0)]
        for value, grad, step in zip((w, transition, initial), grads, steps):
            step += grad**2
            value += rate * grad / np.sqrt(step + 1e-8)
    weights[used] = w
    return Model(labels, weights, transition, initial)


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


def sample(labelled: DataFrame, text: str, label: str, per_label: int) -> list[tuple[str, str]]:
    """Distinct (text, label) rows, about ``per_label`` for each label, chosen by the text's hash."""
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").cast("string").alias("label")).where("text is not null and label is not null")
    rows = rows.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).collect()}  # one row a label
    if not counts:
        return []
    limit = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, int(min(1.0, per_label / max(n, 1)) * (1 << 40)))])
    picked = rows.where(F.col("h") < limit[F.col("label")]).groupBy("h", "label").agg(F.any_value("text").alias("text"))
    return [(r.text, r.label) for r in picked.toLocalIterator()]


def predict(df: DataFrame, model: Model, text: str = "text", keep: Sequence[str | Column] = ()) -> DataFrame:
    """The kept columns with lang_pred and score of each row's whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # fixed size: 2**FEATURE_BITS rows of weights
    kept = df.select(*keep, F.col(f"`{text}`").alias("text to label"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = shared.value.predict(batch.column(batch.num_columns - 1).to_pylist())
            columns = [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lang_pred", "score"])
        shared.value.__dict__.pop("_cache", None)  # the worker may serve other steps next

    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(run, schema)


def identify(docs: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", label: str = "lang", keep: Sequence[str | Column] | None = None, sample_per_label: int = 150) -> DataFrame:
    """Fits on the rows where ``learn`` holds and predicts every row: the kept columns (default: the id), lang_pred, score."""
    model = fit(sample(docs.where(learn), text, label, sample_per_label))
    return predict(docs, model, text, keep if keep is not None else [F.col(f"`{id}`")])


def held_out(id: Column) -> Column:
    """Whether crc32 of the id's decimal text leaves 2 on division by 4; a null id does not."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
