import base64
import hashlib
import html
import io
import random
import re
import time

import numpy as np
import pytest

from grist.llm import ann, html_text, urls, warc
from grist.llm.shared import new_folder

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def test_rules(spark):
    cases = {
        "http://A.example.NET/en/1": ("allow", "example.net/en/"), "http://a.example.net/de/": ("block", "net/"), "x://net": ("allow", None), "http://badnet/": ("allow", None), "https://example.com/de/x?y#z": ("block", "example.com/de/"),
        "https://notexample.com/de/": ("allow", None), "http://b.org/fr/": ("allow", "org/fr/"), "no scheme": ("allow", None), "": ("allow", None), None: ("allow", None), "http://a.net?q=/": ("allow", None),
    }
    df = spark.createDataFrame([(i, u, None, "z", 1) for i, u in enumerate(cases)], "page_id long, url string, html string, host string, key int")
    got = {r.page_id: r for r in urls.judge(df, RULES).collect()}
    for i, (u, want) in enumerate(cases.items()):
        assert (got[i].verdict, got[i].rule) == want, u
    assert (got[0].host, got[0].path) == ("a.example.net", "/en/1") and (got[7].host, got[7].path) == ("", "") and got[10].path == ""
    assert urls.judge(df.limit(0), RULES).count() == 0


def test_aliases(spark):
    link = lambda u: f"<head><link href='{u}' rel=canonical></head>"
    pages = [
        (1, "http://a.com/x", link("http://spam.net/x")), (2, "http://b.com/y?p=1#f", '<meta http-equiv="refresh" content="0; URL=http://a.com/x">'), (3, "http://c.com/z", link("/q")), (4, "http://c.com/q", None),
        (5, "http://e.com/1", link("http://www.example.net/en/1")), (6, "http://f.com/1", link("http://e.com/1")), (7, "http://g.net/1", link("http://f.com/1")), (8, "http://r.com/", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    moved = spark.createDataFrame([("http://r.com/", "https://b.com/y?p=1"), (None, "x")], "source string, target string")
    got = {r.page_id: r.verdict for r in urls.judge(df, RULES, redirects=moved).collect()}
    # 1, 2 and 8 are aliases of a blocked address; 5 and 6 of an allowed one, although 7, blocked by its own rule, is too
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block"}



def test_links_in_heads_only():
    link = "<link rel=canonical href=http://x.net/1>"
    of = lambda head: urls.links_of("http://a.com/d/p?q=1", head)
    assert of(f"<html><head><title>{link}</title><!-- {link} --><script>{link}</script>") == [] and of(f"<p>text</p>{link}") == [] and of(f"words {link}") == [] and of(f"</head>{link}") == []
    assert of("<LINK HREF='../e?x=1&amp;y=2' REL='next CANONICAL'>") == ["http://a.com/e?x=1&y=2"] and of("<link rel=canonical href='//b.org/z'>") == ["http://b.org/z"]
    assert of("<base href='http://c.com/k/'><link rel=canonical href=m><meta http-equiv=Refresh content='3; url=/n'>") == ["http://c.com/k/m", "http://c.com/n"]
    assert of("<link rel=canonical href='http://[bad'><link rel=canonical><meta http-equiv=refresh content=5>") == [] and of("") == of("<") == []


def brute_verdicts(pages, rules, edges):
    """(page_id, rule, verdict) with every rule tried on every url, and aliases by search."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def parts(u):
        if u is None or "://" not in u:
            return "", "", ""
        rest = u.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        after = rest[len(host) :]
        host = host.translate(low)
        return host, re.match("[^?#]*", after)[0], host + re.match("[^#]*", after)[0]

    def rule_of(u):
        host, path, _ = parts(u)
        fits = [(len(h + p), a == "allow", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else (None, None)

    near = {}
    for a, b in edges:
        a, b = parts(a)[2], parts(b)[2]
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = []
    for i, u in pages:
        rule, verdict = rule_of(u)
        if verdict is None:
            seen, todo = set(), [parts(u)[2]]
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen.add(k)
                    todo += near.get(k, ())
            by = {rule_of("http://" + k)[1] for k in seen} if parts(u)[2] in near else set()
            verdict = "allow" if "allow" in by or "block" not in by else "block"
        out.append((i, rule, verdict))
    return sorted(out)


def test_many_rules_and_aliases_against_brute_force(spark):
    rng = random.Random(3)
    hosts = [f"{a}{b}.{c}" for a in ("", "www.", "x.y.") for b in ("one", "two", "three", "Four") for c in ("com", "net", "co.uk")]
    path = lambda: "/" + "/".join(rng.choice("abc") for _ in range(rng.randrange(5)))
    rules = list({(h.lower(), p): (rng.choice(["allow", "block"]), h.lower(), p) for h, p in ((rng.choice([*hosts, "com", "net", "uk"]), path()) for _ in range(8000))}.values())
    rules += [("block" if rules[0][0] == "allow" else "allow", *rules[0][1:])] + [("block", f"many{i}.org", f"/{i}") for i in range(5000)]
    pages, edges = [], []
    for i in range(400):
        u = rng.choice([None, "no scheme", *[f"http://{rng.choice(hosts + ['free.org', 'other.org', f'many{i}.org'])}{path()}{rng.choice(['', '?q=1', '#f', str(i)])}"] * 12])
        html = None
        if u and "://" in u and rng.random() < 0.5:
            target = f"http://{rng.choice([*hosts, 'free.org', 'else.org'])}{path()}"
            edges.append((u, target))
            html = rng.choice(['<head><link rel="canonical" href="{}"></head>', "<meta http-equiv=refresh content='0;url={}'><body>", "<html><head><title>t</title><link rel=canonical href={}>"]).format(target)
        pages.append((i, u, html))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    table = spark.createDataFrame(rules, "action string, host string, path string")
    want = brute_verdicts([p[:2] for p in pages], rules, edges)
    for given in (rules, table):
        assert sorted((r.page_id, r.rule, r.verdict) for r in urls.judge(df, given).collect()) == want
    few = rules[:40]
    want = brute_verdicts([p[:2] for p in pages], few, edges)
    assert sorted((r.page_id, r.rule, r.verdict) for r in urls.judge(df, few).collect()) == want
    assert sorted((r.page_id, r.rule, r.verdict) for r in urls.judge(df, spark.createDataFrame(few, table.schema)).collect()) == want


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body class="no-sidebar">
<header><a href=/>Site of the things that we all like to read about here</a></header><nav><ul><li><a href=1>One</a></li></ul></nav>
<div class="ad">Buy the thing that is the best of all the things in the world now</div><article><header><h1>Head &amp; line</h1></header><p><b>The first
  of&nbsp;the blocks<br>is here.<p>Short.<div class="ad-box">the advert that is in the article and that is of no use to us</div><p>A <a href=2>link</a> in the text that is not all of it, as it was.</p>
<ul class=related><li><a href=3>More of the same that we have here</a></li></ul></article>
<section id="comments"><p>I am of the view that this is a comment and that it is not the article.</p></section><form><p>Give us your name and all of the other things that you have.</p></form><footer>&copy; the site and all that is on it, as it was and as it will be"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line The first of the blocks is here. Short. A link in the text that is not all of it, as it was."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<") == html_text.main_text("<p") == ""
    assert html_text.main_text("<article><h1>x</h1><p>Yes.") == "x Yes." and html_text.main_text("<article><p>a &lt;b&gt; &#233;&am") == "a <b> é&am"
    assert html_text.main_text("<article>" + "<div>" * 3000 + "deep") == "deep"
    words = "the words of this text are what they were and that is all there is"
    assert html_text.main_text(f"<article class='post sidebar-right'><p>{words}</article><article class=comment><p>{words}") == words
    assert html_text.main_text(f"<nav>a</nav><h1>Head</h1><p>{words}</p><p>End.</p><footer>f</footer>") == f"Head {words} End."


def test_rules_without_marks():
    run = "the words of this text are what they were and that is all there is to it"
    page = f"<body><div><a href=1>Home</a> <a href=2>The page of the things that are here and there</a></div><h1>Title</h1><p>{run}</p><p>So.</p><p>{run}</p><div>Qwe rty uio pas dfg hjk lzx cvb nmq wer tyu</div><div>x</div></body>"
    assert html_text.main_text(page) == f"Title {run} So. {run}"
    blocks = html_text.blocks_of(page)
    html_text.classify(blocks)
    assert [b.label for b in blocks if b.text in (run, "So.")] == [True] * 3 and not any(b.label for b in blocks if b.text in ("x",) or b.text.startswith(("Home", "Qwe")))


def test_articles_are_found_first():
    words = "the words of this text are what they were and that is all there is"
    for around in ("layout has-sidebar", "no-sidebar wide", "sidebar", "page sidebar-right", "with-ads"):
        assert html_text.main_text(f'<div class="{around}"><article><p>{words}</p></article></div>') == words, around
    aside = '<div class="related"><article><p>More that is of the same and that you are to read</p></article></div>'
    assert html_text.main_text(f'<div class="layout">{aside}<article><p>{words}</p></article></div>') == words
    assert html_text.main_text(f'<main><p>{words}</p><p>{words}</p><article class="card"><p>See this.</p></article></main>') == f"{words} {words} See this."
    assert html_text.main_text(f"<main><p>Teaser.</p><article><p>{words}</p></article></main>") == words
    assert html_text.main_text('<article><p class="social-history">Short life.</p><p><a href=1>All of this is one link</a></p></article>') == "Short life. All of this is one link"
    menu = "<ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul>"
    assert html_text.main_text(f"<article>{menu}<p>{words}<ul><li><a>Source</a></ul></article>") == f"{words} Source"
    assert html_text.main_text("<p>Hello world.</p>") == "Hello world." and html_text.main_text("<p>...</p>") == ""


@pytest.mark.parametrize(
    "sentence",
    [
        "Это обычный длинный абзац без всяких ссылок и без каких либо особых слов в нём совсем", "这是一个没有标记文章的中文段落它由很多汉字组成但是中间没有空格所以只能按字数计算长度", "これは印のない文章の段落で長い日本語の文がひとつだけ入っています",
        "이것은 표시가 없는 글의 긴 문단이며 여러 낱말로 이루어져 있고 링크는 하나도 없습니다", "นี่คือย่อหน้ายาวของข้อความภาษาไทยที่ไม่มีช่องว่างระหว่างคำและไม่มีลิงก์", "Αυτή είναι μια μεγάλη παράγραφος χωρίς συνδέσμους και χωρίς ιδιαίτερες λέξεις μέσα της",
        "To jest zwykły długi akapit bez odnośników oraz bez słów które ktoś mógłby uznać za szczególne",
    ],
)
def test_scripts(sentence):
    assert html_text.main_text(f"<nav><a>x</a></nav><div class=menu>{sentence}</div><p>{sentence}.</p><p>{sentence}!</p><footer>{sentence}</footer>") == f"{sentence}. {sentence}!"


def test_generated_pages():
    """Pages put together of known parts: what belongs to the article comes out whole, in order, and nothing else."""
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "and", "is", "casa", "Haus", "über", "gr&uuml;n", "a&amp;b", "x &lt; y", "tïme", "Слово", "数"])
    plain = lambda t: " ".join(html.unescape(t).split())
    for _ in range(300):
        out, article = [], []
        names = ["ad", "ad-box", "sidebar", "sidebar-left", "comments", "comment-list", "cookie-banner", "newsletter", "share-buttons", "relatedPosts", "site-header"]
        run = lambda n: " ".join(word() for _ in range(n))
        for _ in range(rng.randrange(1, 12)):
            n = rng.choice([1, 3, 12, 60])
            kind = rng.choice(["p", "h2", "div", "blockquote", "pre", "li", "noise", "noise"])
            if kind == "noise":
                name = rng.choice(names)
                out.append(rng.choice([f'<div class="x {name}"><p>{run(n)}</p></div>', f"<nav><ul><li><a href=1>{run(n)}</a></ul></nav>", f"<script>{run(n)}<p></script>", f"<form>{run(n)}</form>", f"<!-- {run(n)} -->", f"<aside><p>{run(n)}</aside>", f'<div id="{name}">{run(n)}</div>']))
            else:
                text = run(n)
                inner = text if rng.random() < 0.5 else text.replace(" ", rng.choice([" ", "\n\t ", "&nbsp;", " <b></b>"]), 2)
                out.append(f"<{kind} class='{rng.choice(['', 'lead', 'has-ads', 'social-history'])}'>{inner}</{kind}>")
                article.append(plain(re.sub("<[^>]*>", "", inner)))
        around = rng.choice(["layout", "has-sidebar", "page", "main"])
        page = f"<html><head><title>{run(3)}</title></head><body><header><h1>{run(5)}</h1></header><div class='{around}'><article>{''.join(out)}</article></div><section id=comments><p>{run(30)}</section><footer>{run(20)}</footer>"
        assert html_text.main_text(page) == " ".join(article), page


def test_html_time_is_linear():
    for page in ("<div>" * 100_000 + "</p>" * 100_000 + "deep", "<div><table><tr><td>" * 20_000 + "</div>" * 50_000 + "</table>" * 20_000, "<a" * 200_000, "<div class='" + "ad " * 200_000 + "'>"):
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 20


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, None, None, "t"), (None, "v", "", "t")], "page_id long, url string, html string, text string")
    rows = html_text.extract(df).collect()
    assert len(rows) == 3 and sorted(r.n_chars for r in rows)[:2] == [0, 0] and all(r.n_chars == len(r.text) for r in rows)
    assert html_text.extract(df.limit(0)).count() == 0


def test_warc_reader():
    big = b"x" * 300_000 + "é".encode()
    raw = warc.record(1, "http://a/\r\nb c", big) + warc.record(None, None, b"") + warc.record(3, "u", big, revisits=1)
    rows = list(warc.read_records(io.BytesIO(raw), payloads=True))
    assert [r["type"] for r in rows] == ["response", "response", "revisit"] and rows[0]["payload"] == big and rows[1]["payload"] == b"" and rows[2]["payload"] == b""
    assert [r["payload_bytes"] for r in rows] == [len(big), 0, len(big)] and rows[2]["payload_digest"] == rows[0]["payload_digest"] and rows[2]["refers_to"] == "urn:x-page:1"
    assert "\n" not in rows[0]["url"] and rows[1]["url"] is None

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(7)

    assert [r["id"] for r in warc.read_records(Slow(raw))] == [r["id"] for r in rows]
    for bad in (raw[:-5], raw[:100], b"junk", raw[:40] + b"\0" + raw[41:]):
        with pytest.raises(warc.Damaged):
            list(warc.read_records(io.BytesIO(bad)))
    import gzip

    changed = gzip.decompress(warc.record(1, "u", b"hello")).replace(b"hello", b"hallo")
    with pytest.raises(warc.Damaged):
        list(warc.read_records(io.BytesIO(gzip.compress(changed))))


def test_archives(spark):
    rows = [(5, "a", "same"), (2, "b", "same"), (9, None, "same"), (3, "c", None), (4, "d", ""), (7, "e", "other é"), (None, "f", "same"), (None, "g", "lone")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.archived(df).collect()
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = {5: ("same", 2), 2: ("same", None), 9: ("same", 2), 3: ("", None), 4: ("", 3), 7: ("other é", None)}
    assert len(got) == 8
    for r in got:
        if r.page_id is not None:
            text, refers = want[r.page_id]
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(text.encode()), sha(text), "revisit" if refers else "response", refers)
    assert sorted(r.record_type for r in got if r.page_id is None) == ["response", "revisit"]
    assert all(r.record_type == "response" for r in warc.archived(df, least=5).collect() if r.page_id != None)  # noqa: E711
    assert warc.archived(df.limit(0)).count() == 0
    assert warc.write_archives(df, new_folder(spark, "warc")).count() >= 1


def brute_nearest(rows, k):
    clean = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            clean[i, tuple(np.float64(np.float32(x)) for x in v)] = None
    out = {}
    for q, a in clean:
        if q % 20 == 0:
            scored = sorted((-np.cumsum(np.array(a) * np.array(b))[-1], i) for i, b in clean if i != q and len(a) == len(b))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return {q: x for q, x in out.items() if x}


@pytest.mark.parametrize("k", [3, 20])
def test_nearest_against_brute_force(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 380)] + [(i, rows[0][1]) for i in range(380, 400)]
    rows += [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [1.0, None] + [0.0] * 6), (480, [1.0, 2.0]), (481, [3.0, 1.0]), (None, [1.0] * 8), (3, rows[3][1]), (500, [])]
    rows += [(501, (np.array(rows[20][1]) * 1e30).tolist()), (502, [1e-30] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    got = {}
    for r in ann.nearest(df, df["vec_id"] % 20 == 0, k=k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r["rank"]
    want = brute_nearest(rows, k)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)
    assert ann.nearest(df.limit(0), df["vec_id"] % 20 == 0).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(200, 16)) * 10 ** rng.uniform(-3, 3, (200, 1)), rng.normal(size=(200, 16))
    row = np.arange(200)
    qa, qb = ann.quantise(row, row, a), ann.quantise(row, row, b)
    first = (qa["int8"][:, 0].astype(float) @ qb["int8"][:, 0].T.astype(float)) * np.outer(qa["scale"][:, 0], qb["scale"][:, 0])
    second = ann.restored(qa) @ ann.restored(qb).T
    for i, about in enumerate((first, second)):
        bound = np.outer(qa["back"][:, i], qb["left"][:, i]) + np.outer(qa["left"][:, i], qb["norm"]) + 1e-9 * np.outer(qa["norm"], qb["norm"])
        assert (np.abs(about - a @ b.T) <= bound).all()
    assert (np.abs(second - a @ b.T) <= 1e-3 * np.outer(qa["norm"], qb["norm"])).all()


def test_bounds_drop_what_is_out_of_reach(monkeypatch):
    monkeypatch.setattr(ann, "HELD", 50)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 32))
    row = np.arange(500)
    bounds = ann.Bounds(ann.quantise(row[:5], row[:5], x[:5]), 4)
    for a in range(0, 500, 100):
        bounds.meet(ann.quantise(row[a : a + 100], row[a : a + 100], x[a : a + 100]))
    got = {}
    for batch in bounds.rows():
        for q, c in zip(batch.column("query_id").to_pylist(), batch.column("vec_id").to_pylist()):
            got.setdefault(q, set()).add(c)
    scores = x[:5] @ x.T
    for q in range(5):
        scores[q, q] = -np.inf
        assert set(np.argsort(-scores[q])[:4].tolist()) <= got[q] and len(got[q]) < 20
