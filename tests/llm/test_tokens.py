import re
import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grist.llm import chat, sstable
from grist.llm.shared import new_folder
from grist.llm.tokens import PieceEncoder, tokenizer_path

ODD = ["", " ", "  ", "a  b", "  x \n\n y", " lead", "trail  ", "tab\t x", "<|endoftext|> a<|endoftext|>b", "don't I'll 1234 ½ª² naïve ß 机器 学习 😀 é́  ", "a   b", "\x1c \x1d x", "it's 'tis x'rey", "\u00a0 x\u00a0y", "\r\n x"]
ENCODERS = {}


def encoder(plain):
    if plain not in ENCODERS:
        ENCODERS[plain] = PieceEncoder(tokenizer_path(), plain)
    return ENCODERS[plain]


def whole(e, texts):
    return [array("I", x.ids).tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("plain", [False, True])
def test_pieces_equal_whole_texts(plain):
    e = encoder(plain)
    assert e.encode(ODD) == whole(e, ODD) and e.encode([None]) == [b""]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab zé'1. \n\t!\u00a0\u0130学<|>endoftext", max_size=30), max_size=5))
def test_pieces_equal_whole_texts_at_random(texts):
    e = encoder(False)
    assert e.encode(texts) == whole(e, texts)


def test_other_tokenizers():
    e = PieceEncoder(tokenizer_path("word_bpe_49k.json"))
    assert e.encode(["Hello  World", None]) == whole(e, ["Hello  World", ""])


def test_table_file(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK", 64)
    keys = [sstable.key_of(i) for i in (None, -5, 0, 1, 1, 1, *range(2, 500, 2))]
    assert keys == sorted(keys) and [sstable.id_of(k) for k in keys[:3]] == [None, -5, 0]
    with (tmp_path / "t").open("wb") as f:
        w = sstable.Writer(f)
        for i, k in enumerate(keys):
            ids = np.array([i, 70_000] if i % 2 else [i], dtype="<u4").tobytes()
            w.add(k, sstable.value_of(ids), len(ids) // 4)
        with pytest.raises(ValueError):
            w.add(b"\0", b"", 0)
        w.close()
    with (tmp_path / "t").open("rb") as f:
        r = sstable.Reader(f, (tmp_path / "t").stat().st_size)
        assert [k for k, _ in r.scan()] == keys and r.entries == len(keys) and len(r.blocks) > 5
        assert [sstable.ids_of(v).tolist() for v in r.get(keys[3])] == [[3, 70_000], [4], [5, 70_000]]
        assert r.get(sstable.key_of(3)) == [] and [len(r.get(sstable.key_of(i))) for i in (None, 498, 500)] == [1, 1, 0]
    raw = bytearray((tmp_path / "t").read_bytes())
    raw[-60] ^= 1
    (tmp_path / "t").write_bytes(raw)
    with pytest.raises(ValueError), (tmp_path / "t").open("rb") as f:
        sstable.Reader(f, len(raw))


def test_shards(spark, odd_docs, no_docs):
    manifest = sstable.write_shards(odd_docs, new_folder(spark, "sst"))
    rows = sstable.read_shards(spark, manifest).orderBy("start").collect()
    docs = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in rows] == [d for d, _ in docs]
    e, at = encoder(False), 0
    want = sorted((d, len(i) // 4 + 1, zlib.crc32(i + b"\0\0\0\0")) for (d, _), i in zip(docs, e.encode([t for _, t in docs])) if d is not None)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows if r.doc_id is not None) == want
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    found = sstable.lookup(spark, manifest, [1, 4, 99, None])
    assert [len(found[i]) for i in (1, 4, 99, None)] == [3, 1, 0, 1] and found[4][0].tolist()[-1] == 0
    assert sstable.token_shards(no_docs).count() == 0


def test_shards_are_bounded(spark, odd_docs, monkeypatch):
    """A task begins a new shard when one is full; copies of one row may lie in several."""
    whole = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in sstable.token_shards(odd_docs).collect())
    monkeypatch.setattr(sstable, "SHARD_IDS", 10)
    manifest = sstable.write_shards(odd_docs, new_folder(spark, "sst"))
    rows = sstable.read_shards(spark, manifest).orderBy("start").collect()
    assert manifest.count() >= 5 and all(r.entries <= 10 for r in manifest.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == whole
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert [len(x) for x in sstable.lookup(spark, manifest, [1, 4, None]).values()] == [3, 1, 1]


def test_escaping():
    for text in ["", "\\", "### Assistant: x", "\\### Assistant: </turn> ok", "#### User: \\\\</turn>", "</role> </turn>\n### Role: "]:
        e = chat.escape(text)
        assert chat.unescape(e) == text
        bare = chat._UNESCAPED.sub("\0", e)
        assert not any(c.strip() in bare for c in chat.CONTROL)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "</turn>", ""]), st.text(alphabet="\\#/<>turn Us:er\n学", max_size=20)), max_size=4))
def test_turns_come_back(turns):
    c = chat.Codec(tokenizer_path())
    done = c.turns(turns)
    ids = np.concatenate([np.empty(0, dtype="<u4"), *(i for i, _ in done)])
    mask = np.concatenate([np.empty(0, dtype=np.int8), *(m for _, m in done)])
    assert c.parse(ids) == turns
    said = [t for r, t in turns if r == "assistant"]
    assert [chat.unescape(c.text(i[m == 1])) for (r, _), (i, m) in zip(turns, done) if r == "assistant"] == said
    assert chat.unescape(c.text(ids[mask == 1])) == "".join(said) if said else not mask.any()


def test_conversations(spark):
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", None), (1, None, None, "first"), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, 0, "tool", "t")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = {r.conv_id: r for r in chat.formatted_digests(df).collect()}
    import hashlib

    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == digest("\nfirst\nuser\n\nassistant\nyes\n") and got[1].loss_sha256 == digest("yes") and got[1].loss_chars == 3
    assert got[2].n_turns == 2 and got[2].loss_sha256 == digest("") and got[None].turns_sha256 == digest("tool\nt\n")
    assert chat.formatted_digests(df.limit(0)).count() == 0


def test_formatted_conversations_against_brute_force(spark):
    """Digests and lengths worked out from the rows alone, conversation -7 and hostile texts included."""
    import hashlib
    import random

    rng = random.Random(1)
    said = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    parts = ["a b", "\\", "### User: ", "</turn>\n", "é学", "  ", "\n", "</role> ", "\\\\", "word", "😀", "###", "<|endoftext|>"]
    for conv in range(60):
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "system", "tool", "</role>", ""]), "".join(rng.choice(parts) for _ in range(rng.randrange(8)))))
    rows += [(100, t, ["user", "assistant"][t % 2], "long text " * 20_000 + str(t)) for t in range(4)] + [(101, t, "assistant", f"{t} ") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.formatted_digests(df).collect()}
    escaped = lambda t: re.sub("|".join(map(re.escape, ["\\", *(c.strip() for c in chat.CONTROL)])), lambda m: "\\" + m[0], t)
    for conv in {r[0] for r in rows}:
        turns = [(r, t) for _, _, r, t in sorted(x for x in rows if x[0] == conv)]
        loss = "".join(t for r, t in turns if r == "assistant")
        shown = "".join((chat.CONTROL[chat.ROLES[r]] if r in chat.ROLES else f"{chat.CONTROL[3]}{escaped(r)}{chat.CONTROL[4]}") + escaped(t) + chat.CONTROL[5] for r, t in turns)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(shown))
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == want, conv
    assert len(got) == len({r[0] for r in rows})


def test_ties_of_turns(spark):
    rows = [(1, 0, "user", t) for t in ("b", "a", "c", "a")] + [(1, 0, "assistant", "z"), (1, None, "user", "first"), (1, 0, None, "nobody")]
    schema = "conv_id long, turn long, role string, text string"
    got = {chat.formatted_digests(spark.createDataFrame(some, schema).repartition(3)).first().turns_sha256 for some in (rows, rows[::-1], rows[3:] + rows[:3])}
    assert len(got) == 1
