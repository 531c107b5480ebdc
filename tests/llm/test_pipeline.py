import collections
import os
import zlib

import pytest
from test_documents import brute_copies, brute_groups, brute_hits

import corpus_pipeline
from grist.llm import langid, mixture
from grist.llm.tokens import PieceEncoder, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    from grist.llm.shared import written

    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        out.append(docs.collect())
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language id", "n-gram jaccard join", "decontamination", "mixing", "token output"]
    assert all(tuple(s[0].asDict()) == corpus_pipeline.COLUMNS for s in stages[:-1])


def test_language_stage(stages):
    """The same model, fitted on every learnable text (fewer than the bound), judges each text alone."""
    rows = stages[0]
    learn = {(r.text, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    model = langid.fit(learn)
    want = [r.doc_id for r in rows for (label, score), in [model.predict([r.text])] if label != "und" and score >= corpus_pipeline.LEAST_SCORE]
    assert sorted(want) == sorted(r.doc_id for r in stages[1]) and len(want) > 0.95 * len(rows)


def test_duplicates_stage(stages):
    groups = brute_groups([(r.doc_id, r.text) for r in stages[1]], 5, 8, 10)
    assert sorted(d for _, d, _, least in groups if d == least) == sorted(r.doc_id for r in stages[2]) and len(stages[2]) < len(stages[1])


def test_decontamination_stage(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [d for d, _, hit, _ in brute_hits([(r.doc_id, r.text) for r in stages[2]], items, 10) if not hit]
    assert sorted(clean) == sorted(r.doc_id for r in stages[3]) and len(clean) < len(stages[2])


def test_mixing_stage(spark, stages):
    import re

    docs = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in stages[3]]
    sizes = collections.Counter()
    for _, s, t in docs:
        sizes[s] += t
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, n long, docs long")
    targets = {r.source: r.target for r in mixture.targets(df, repeats=corpus_pipeline.REPEATS).collect()}
    assert collections.Counter(r.doc_id for r in stages[4]) == brute_copies(docs, targets) and {r.doc_id for r in stages[4]} == {r.doc_id for r in stages[3]}


def test_token_stage(stages):
    rows = sorted(stages[4], key=lambda r: r.doc_id)
    e = PieceEncoder(tokenizer_path())
    ids = e.encode([r.text for r in rows])
    want = [(r.doc_id, len(i) // 4 + 1, zlib.crc32(i + b"\0\0\0\0")) for r, i in zip(rows, ids)]
    got = sorted(stages[5], key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == want
    assert [r.start for r in got] == [sum(w[1] for w in want[:i]) for i in range(len(want))]


def test_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text), (1, text), (2, text), (3, "all other words that nobody else has in a text of this kind"), (4, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    kept = corpus_pipeline.near_duplicates(spark, df, SF)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4] and tuple(kept.columns) == corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def odd_table(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977} and the other{i % 31}" for i in range(30_000))
    rows = [(1, "the first text of this table is about the cat", "en", "web"), (1, "the first text of this table is about the cat", "en", "web"), (2, "", "en", None), (3, None, None, "web"), (None, "a text that has no id at all and no source", "en", None)]
    rows += [(4, long, "la", "books"), (5, "12 34 !!", None, "web"), (1, "another text under the very same id", None, "books"), (6, "der Hund und die Katze sind in dem Haus", "de", "web"), (None, "a text that has no id at all and no source", "en", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, th string, n int, bucket int, block string, place int, component_id string, shard string, key string, tie int, text_hash string, score string"
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", 1, 2, "y", 3, "z", "s", "k", 4, "h", "q") for r in rows], schema).repartition(3)


def test_stages_on_odd_rows(spark, odd_table):
    rows = collections.Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in odd_table.collect())
    texts = collections.Counter((k[0], k[1]) for k, n in rows.items() for _ in range(n))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_table, SF)
        got = collections.Counter(tuple(r) for r in out.collect())
        assert tuple(out.columns) == corpus_pipeline.COLUMNS and set(got) <= set(rows), name
        if name == "language id":
            assert got <= rows and not any(k[1] in (None, "", "12 34 !!") for k in got)
        elif name == "n-gram jaccard join":
            assert set(got.values()) == {1} and {k[:2] for k in got} == {k[:2] for k in rows}  # each text once
        elif name == "decontamination":
            assert got == rows
        else:
            assert all(got[k] >= n for k, n in rows.items())
    found = corpus_pipeline.token_shards(spark, odd_table, SF).collect()
    e = PieceEncoder(tokenizer_path())
    want = collections.Counter((i, len(e.encode([t])[0]) // 4 + 1) for (i, t), n in texts.items() for _ in range(n))
    assert collections.Counter((r.doc_id, r.n_tokens) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_stages_on_an_empty_table(spark, odd_table):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_table.limit(0), SF)
        assert out.count() == 0 and tuple(out.columns) == corpus_pipeline.COLUMNS
    assert corpus_pipeline.token_shards(spark, odd_table.limit(0), SF).count() == 0
