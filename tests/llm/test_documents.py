import collections
import hashlib
import random
import re

import numpy as np
import pytest

from grist.llm import decontaminate, langid, mixture, ngram_join
from grist.llm.components import connected_components
from grist.llm.words import ALNUM, NOT_SPACE, Words, shingle_sets

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_words():
    texts = ["Ab c\t\u00e9\u00c9 x", None, "", "  ", "ab c", "c ab", "a" * 70_000]
    w = Words(texts, NOT_SPACE)
    assert np.diff(w.first).tolist() == [4, 0, 0, 0, 2, 2, 1]
    h = lambda i: w.hash[w.first[i] : w.first[i + 1]].tolist()
    assert h(0)[:2] == h(4) == h(5)[::-1] and len(set(w.hash.tolist())) == 5
    assert Words(["x-Y1 \u00e9!z"], ALNUM).count(0) == 4
    sets = shingle_sets(Words(["a b c d", "a b", "b a", "", "a b c d e d c b a b c d"], NOT_SPACE), 3)
    assert [len(s) for s in sets] == [2, 1, 1, 0, 8] and sets[1].tolist() != sets[2].tolist() and set(sets[0].tolist()) <= set(sets[4].tolist())


def test_components(spark):
    edges = [(i, i + 1) for i in range(50, 70)] + [(7, i) for i in range(100, 200)] + [(1, 2), (2, 1), (3, 3), (None, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 50 for i in range(50, 71)}, **{i: 7 for i in [7, *range(100, 200)]}, 1: 1, 2: 1}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def brute_groups(docs, k, num, den):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)].append(d)
    return sorted((d is None, d or 0, len(sets[i]), min(least[find(i)], default=-1) if sets[i] else d) for i, (d, _) in enumerate(docs))


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 8, 10), (1, 1, 2)])
def test_jaccard_against_brute_force(spark, k, num, den, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 8)
    rng = random.Random(k)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 30
    common = [rng.choice(words) for _ in range(14)]
    docs = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([2, 12, 60, 200]))]
        for _ in range(rng.choice([1, 2, 9])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append((len(docs), " ".join(text + (common if rng.random() < 0.3 else []))))
    docs += [(1000, None), (1001, ""), (1002, " \t"), (1003, docs[0][1].upper()), (1003, docs[0][1])]
    df = spark.createDataFrame([(*d, 1, "p") for d in docs], "doc_id long, text string, n int, prefix string").repartition(3)
    got = ngram_join.jaccard_components(df, k=k, num=num, den=den).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == brute_groups(docs, k, num, den)


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (2, 1, 2)])
def test_jaccard_links_against_brute_force(spark, k, num, den, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 4)
    monkeypatch.setattr(ngram_join, "FEW", 3)
    monkeypatch.setattr(ngram_join, "PAIRS", 40)
    rng = random.Random(k)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([1, 8, 40, 90]))]
        for _ in range(rng.choice([1, 3, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append((len(docs), " ".join(text)))
    docs += [(900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    links, members = ngram_join.jaccard_links(df, k=k, num=num, den=den)
    sets = {}
    for i, t in docs:
        w = (t or "").split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    linked = lambda a, b: bool(a) and den * len(a & b) >= num * len(a | b)
    rows = {r.doc_id: r for r in members.collect()}
    assert {i: r.n_links for i, r in rows.items()} == {i: sum(linked(sets[i], sets[j]) for j in sets if j != i) for i in sets}
    of = {r.class_id: sets[i] for i, r in rows.items() if r.class_id is not None}
    got = {(r.class_a, r.class_b) for r in links.collect()}
    assert got == {(a, b) for a in of for b in of if a < b and linked(of[a], of[b])} and len(of) == len({s for s in sets.values() if s})


def test_tile_filters_agree(monkeypatch):
    """Members are kept alike by the filter of many small tiles, that of one tile, and pair by pair; none that links is lost."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    rows, want = [], {}
    for tile in range(60):
        base = rng.integers(0, 2**63, int(rng.choice([12, 60, 300])), dtype=np.int64).astype(np.uint64)
        sets = []
        for _ in range(int(rng.choice([1, 2, 5, 16, 17, 40]))):
            s = base.copy()
            change = int(rng.choice([0, 1, len(base) // 12, len(base) // 2]))
            s[:change] = rng.integers(0, 2**63, change, dtype=np.int64).astype(np.uint64)
            sets.append(np.unique(s[: len(s) - int(rng.integers(0, 3))]))
        sets.sort(key=len)
        for s in sets:
            node = len(rows)
            rows.append((tile, len(s), int(rng.integers(0, 40)), node, len(s), 0, 0, ngram_join._bitmap(s).tobytes()))
            want.setdefault(tile, []).append((node, s))
    names = ["tile", "n", "comp", "node", "rest", "half", "split", "bitmap"]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(len(names))], names=names)
    found = []
    for few, pairs in ((16, 1 << 16), (1, 50), (1000, 1 << 16)):
        monkeypatch.setattr(ngram_join, "FEW", few)
        monkeypatch.setattr(ngram_join, "PAIRS", pairs)
        out = [m for part in (batch, ) for b in ngram_join._filter_tiles(8, 10, 1)(iter([part[:7], part[7:300], part[300:]])) for m in b.column(0).to_pylist()]
        found.append({n for m in out for n in m})
    linked = {x for members in want.values() for x, s in members for y, r in members if x != y and rows[x][2] != rows[y][2] and ngram_join._links(s, r, 8, 10)}
    assert found[0] >= found[1] and found[2] >= found[1] and all(linked <= f for f in found) and linked and len(found[1]) < len(rows)


def test_bucket_counts_cost_what_a_slice_holds():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    total = ngram_join.bucket_counts(([f"a{i} b{i} c{i} d{i}" for i in range(200)] for _ in range(100)), 3, 26)
    assert total.sum() == 40_000 and (total == 0).sum() > (1 << 26) - 500
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400 << 10  # kB


def test_jaccard_tiles_give_few_links():
    """A clique of near copies in different components gives a spanning set of links only."""
    base = np.arange(1, 201, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    v = ngram_join.Verifier(8, 10, False)
    found = []
    for i in range(300):
        s = base.copy()
        s[i % 200] += np.uint64(i + 1)
        found += v.add(i, 1000 + i, np.unique(s))
    assert len(found) == 299


def test_jaccard_odd_tables(spark, odd_docs, no_docs):
    rows = ngram_join.jaccard_components(odd_docs).collect()
    assert len(rows) == 8 and {r.component_id for r in rows if r.doc_id == 2} == {2} and sum(r.component_id == 1 for r in rows) == 3
    assert ngram_join.jaccard_components(no_docs).count() == 0


def brute_hits(docs, items, size):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[j : j + size])].add("null" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for j in range(len(w)):
            for n in range(1, size + 1):
                if n <= len(w) - j and (key := tuple(w[j : j + n])) in windows:
                    found |= windows[key]
                    hit |= set(range(j, j + n))
        out.append((d, len(w), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return sorted(out, key=str)


def test_decontamination_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD", 3000)
    monkeypatch.setattr(decontaminate, "SEGMENT", 14)  # a text in several pieces
    monkeypatch.setattr(decontaminate, "PASS_TERMS", 100)  # several passes over the index
    monkeypatch.setattr(decontaminate, "PLACES", 50)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["the"] * 30
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 9, 10, 25])))) for i in range(30)] + [(None, "w1 w2"), (7, None), (8, "The, W3!")]
    docs = []
    for i in range(80):
        text = [rng.choice(words) for _ in range(rng.choice([0, 5, 50, 300]))]
        for _ in range(rng.choice([0, 1, 2])):
            t = rng.choice(items)[1] or ""
            at = rng.randrange(len(text) + 1)
            text[at:at] = t.upper().split()
        docs.append((rng.choice([i, i, 3, None]), ", ".join(text)))
    docs.append((500, None))
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_words int").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(d, b, window=10).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.items_sha256) for r in got), key=str) == brute_hits(docs, items, 10)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r.items) for r in got)


def test_decontamination_odd_tables(spark, odd_docs, no_docs):
    b = spark.createDataFrame([(1, "sat on the mat and then it slept all day")], "item_id long, text string")
    got = decontaminate.contamination(odd_docs, b, span=12).collect()
    assert sum(r.contaminated for r in got) == 2 and len(got) == 8 and all(list(r.near_items) == ["1"] for r in got if r.contaminated)
    assert decontaminate.contamination(no_docs, b).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(odd_docs, b.limit(0)).collect())
    assert decontaminate.of_planes(decontaminate.planes(np.array([3, 600, (1 << 32) - 1]))).tolist() == [3, 600, (1 << 32) - 1]


def brute_near(docs, items, size, span):
    """Items of each text with a window all of whose words are in a run of ``span`` words."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    out = []
    for d, t in docs:
        w, found = words(t), set()
        for i, x in items:
            terms = words(x)
            windows = [set(terms[j : j + size]) for j in range(max(1, len(terms) - size + 1))] if terms else []
            if any(win <= set(w[s : s + span]) for win in windows for s in range(len(w))):
                found.add(str(i))
        out.append((d, sorted(found)))
    return sorted(out)


def test_near_matches_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD", 1000)
    monkeypatch.setattr(decontaminate, "PASS_TERMS", 60)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(14)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 4, 5, 7])))) for i in range(25)] + [(25, "w1 w1 w2 w1")]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 20, 60])))) for i in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    w = decontaminate.Windows([(i, decontaminate.Words([t], decontaminate.ALNUM).hash.astype("<u8").tobytes()) for i, t in items if t], 4)
    words_of = decontaminate.Words([t for _, t in docs], decontaminate.ALNUM)
    order = np.argsort(words_of.hash, kind="stable")
    terms, begin = np.unique(words_of.hash[order], return_index=True)
    shard = decontaminate.Shard(np.diff(words_of.first), terms.astype("<u8").tobytes(), decontaminate.planes(np.diff(begin, append=len(order))), decontaminate.planes(order))
    every = [x.tolist() for pair in decontaminate.search(shard, w, 8) for x in pair]
    monkeypatch.setattr(decontaminate, "PLACES", 30)  # places in many parts
    assert [x.tolist() for pair in decontaminate.search(shard, w, 8) for x in pair] == every and len(every[0])
    for span in (5, 8):
        got = decontaminate.contamination(d, b, window=4, span=span).collect()
        assert sorted((r.doc_id, list(r.near_items)) for r in got) == brute_near(docs, items, 4, span)
        assert all(set(r["items"]) <= set(r.near_items) for r in got) and any(set(r["items"]) < set(r.near_items) for r in got)


def test_chain_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    emission, a, first = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    starts = np.array([0, 3])
    chain = langid.Chain(emission, starts, a, first)
    p = np.zeros((5, 3))
    pairs = np.zeros((3, 3))
    for lo, hi in ((0, 3), (3, 5)):
        total, one, two = 0.0, np.zeros((hi - lo, 3)), np.zeros((3, 3))
        for path in product(range(3), repeat=hi - lo):
            s = np.exp(first[path[0]] + sum(emission[lo + i, y] for i, y in enumerate(path)) + sum(a[x, y] for x, y in zip(path, path[1:])))
            total += s
            for i, y in enumerate(path):
                one[i, y] += s
            for x, y in zip(path, path[1:]):
                two[x, y] += s
        p[lo:hi] = one / total
        pairs += two / total
    assert np.allclose(chain.marginal, p) and np.allclose(chain.transitions(), pairs)
    many = rng.normal(size=(1000, 3))
    cut = np.array([0, 300, 999])
    got = langid.Chain(many, cut, a, first).marginal
    for lo, hi in zip(cut, [*cut[1:], 1000]):
        assert np.allclose(got[lo:hi], langid.Chain(many[lo:hi], np.array([0]), a, first).marginal)


def test_language_of_words_and_texts(spark, odd_docs, no_docs):
    en, de = "the cat and this house with that thing", "der hund und das haus mit einem baum"
    rng = random.Random(1)
    some = lambda t: " ".join(rng.choice(t.split()) for _ in range(30))
    rows = [(i, some(en) if i % 2 else some(de), "en" if i % 2 else "de") for i in range(200)]
    model = langid.fit([(t, label) for _, t, label in rows])
    assert [label for _, label, _ in model.label_words("the cat und der hund mit this thing")] == ["en", "en", "de", "de", "de", "de", "en", "en"]
    assert model.predict([None, "", "1 2 !", "²"]) == [("und", 0.0)] * 4 and langid.fit([]).predict(["x"]) == [("und", 0.0)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, score string")
    held = langid.held_out(df["doc_id"])
    got = langid.identify(df, ~held, keep=["doc_id", "lang", held.alias("held_out")]).collect()
    assert all(r.lang == r.lang_pred and 0.5 < r.score <= 1 for r in got) and 20 < sum(r.held_out for r in got) < 80
    odd = langid.identify(odd_docs, ~langid.held_out(odd_docs["doc_id"])).collect()
    assert len(odd) == 8 and sum(r.lang_pred == "und" for r in odd) == 3
    assert langid.identify(no_docs, ~langid.held_out(no_docs["doc_id"])).count() == 0


def brute_copies(docs, targets):
    """Whole epochs and the part of one more permutation, by the definition."""
    out = collections.Counter()
    for source, target in targets.items():
        own = [(d, t) for d, s, t in docs if s == source]
        n = sum(t for _, t in own)
        epochs, rest = (target // n, target % n) if n else (1, 0)
        u = lambda d: int(hashlib.md5(f"1|rest|{d}".encode()).hexdigest()[:13], 16)
        at = 0
        for d, t in sorted(own, key=lambda x: u(x[0])):
            out[d] += epochs + (at < rest)
            at += t
    return +out


def test_mixture(spark, monkeypatch, no_docs, odd_docs):
    monkeypatch.setattr(mixture, "BUCKET", 4)
    rng = random.Random(2)
    docs = [(i, rng.choice(["a"] * 12 + ["b", "b", "c", None]), rng.randint(0, 40)) for i in range(600)]
    df = spark.createDataFrame([(d, s, " ".join(["w"] * t), "q") for d, s, t in docs], "doc_id long, source string, text string, epoch string")
    rows = mixture.mix(df, repeats=2.0, block_tokens=500).collect()
    n = collections.Counter()
    for _, s, t in docs:
        n[s] += t
    p = {s: x / sum(n.values()) for s, x in n.items()}
    lo, hi = 0.0, 1.0
    for _ in range(48):
        a = (lo + hi) / 2
        lo, hi = (lo, a) if max(x ** (a - 1) for x in p.values()) <= 2 * min(x ** (a - 1) for x in p.values()) else (a, hi)
    power = {s: x**hi for s, x in p.items()}
    whole = max(n[s] / power[s] for s in n)
    targets = {s: int(np.ceil(round(power[s] * whole, 6))) for s in n}
    assert collections.Counter(r.doc_id for r in rows) == brute_copies(docs, targets)
    assert max(targets[s] / n[s] for s in n) == pytest.approx(2, rel=0.01) and all(targets[s] >= n[s] for s in n)
    share = collections.defaultdict(collections.Counter)
    for r in rows:
        share[r.block][r.source] += r.n_tokens
    assert len(share) == -(-sum(targets.values()) // 500)
    cut = mixture.mix(df, entropy=1.0, budget=3000).collect()
    assert 2900 < sum(r.n_tokens for r in cut) < 3300
    assert mixture.mix(no_docs, repeats=2.0).count() == 0 and mixture.mix(odd_docs, repeats=2.0).count() == 8


def test_exponent(spark):
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.1,)], "p double")
    a = mixture.exponent(shares, entropy=1.0)
    w = np.array([0.7, 0.2, 0.1]) ** a
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(1.0, abs=1e-6)
    assert mixture.exponent(shares, entropy=0.1) == 1.0 and mixture.exponent(shares, entropy=5.0) == 0.0 and mixture.exponent(shares, repeats=100.0) == 0.0
    with pytest.raises(ValueError):
        mixture.exponent(shares)
