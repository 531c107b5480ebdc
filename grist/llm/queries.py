"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, html_text, langid, mixture, ngram_join, sstable, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # whole texts go to Python workers in batches of this size
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (action, host, path) of the url filter.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: No source is repeated more than this many times; no document is left out.
REPEATS = 2.0
BLOCK_TOKENS = 1 << 20
#: A benchmark window is near where a run of this many words holds all its words in any order.
NEAR_SPAN = 20


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.formatted_digests(rows.unionByName(more))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_shards(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = langid.held_out(F.col("doc_id"))
    found = langid.identify(docs, learn=~held_out, keep=["doc_id", held_out.alias("held_out")])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.mix(_table(spark, sf_dir, "documents"), repeats=REPEATS, block_tokens=BLOCK_TOKENS)
    return mixed.select("doc_id", "source", "n_tokens", "epoch", "block")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), span=NEAR_SPAN)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.size("near_items").cast("long").alias("n_near_items"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(_table(spark, sf_dir, "pages"), least=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_url_filter, op3_token_shards, op4_language_id, op5_nearest, op6_mixture, op7_ngram_jaccard, op8_warc, op9_decontamination, op10_html_text)}
#: ASCII letters for translate(): the queries lower-case A-Z only.
LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: The same results in SQL for DuckDB; tokenizer output, the language model and main text are beyond SQL.
ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": r"""
WITH RECURSIVE u AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS after FROM u),
p AS (SELECT page_id, url, regexp_extract(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>|<noscript\b.*?</noscript\s*>', '', 'g'), '(?is)^(.*?)(?:</head\b|<body\b|\z)', 1) AS html, host, regexp_extract(after, '^[^?#]*') AS path, host || regexp_extract(after, '^[^#]*') AS key FROM split),
tags AS (SELECT key, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS tag FROM p WHERE key <> ''),
links AS (SELECT key AS a, regexp_extract(tag, '(?is)\shref\s*=\s*["'']?([^"''\s>]*)', 1) AS href FROM tags WHERE regexp_matches(tag, '(?is)\srel\s*=\s*["'']?canonical["''\s>/]')),
targets AS (SELECT a, substr(href, instr(href, '://') + 3) AS rest FROM links WHERE instr(href, '://') > 0),
edges AS (SELECT DISTINCT a, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^#]*') AS b FROM targets),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON r.y = e.a),
rules(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
addresses AS (SELECT key, host, path FROM p UNION SELECT y, regexp_extract(y, '^[^/?#]*'), regexp_extract(substr(y, length(regexp_extract(y, '^[^/?#]*')) + 1), '^[^?#]*') FROM reach),
fits AS (SELECT a.key, r.rhost || r.rpath AS rule, r.action, row_number() OVER (PARTITION BY a.key ORDER BY length(r.rhost || r.rpath) DESC, r.action, r.rhost || r.rpath DESC) AS n
  FROM (SELECT DISTINCT key, host, path FROM addresses) a JOIN rules r ON (a.host = r.rhost OR ends_with(a.host, '.' || r.rhost)) AND starts_with(a.path, r.rpath)),
alias AS (SELECT x AS key, CASE WHEN bool_or(f.action = 'allow') THEN 'allow' WHEN bool_or(f.action = 'block') THEN 'block' END AS verdict FROM reach LEFT JOIN (SELECT * FROM fits WHERE n = 1) f ON f.key = reach.y GROUP BY x)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, alias.verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM fits WHERE n = 1) f ON f.key = p.key LEFT JOIN alias ON alias.key = p.key
""",
    "op6_mixture": rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS n, count(*) AS docs FROM d GROUP BY source),
shares AS (SELECT source, n, docs, n / greatest(sum(n) OVER (), 1)::DOUBLE AS p FROM s),
ends AS (SELECT min(p) AS least, max(p) AS most FROM shares WHERE p > 0),
bisect(i, lo, hi) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN kept THEN lo ELSE mid END, CASE WHEN kept THEN mid ELSE hi END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, pow(least, (lo + hi) / 2 - 1) <= {REPEATS} * pow(most, (lo + hi) / 2 - 1) AS kept FROM bisect, ends WHERE i < 48)),
a AS (SELECT CASE WHEN pow(least, -1::DOUBLE) <= {REPEATS} * pow(most, -1::DOUBLE) THEN 0 ELSE (SELECT hi FROM bisect WHERE i = 48) END AS a FROM ends),
powered AS (SELECT *, CASE WHEN p > 0 THEN pow(p, (SELECT a FROM a)) ELSE 0 END AS power FROM shares),
plan AS (SELECT source, n, CASE WHEN n > 0 THEN ceil(round(power * (SELECT max(n / power) FROM powered WHERE p > 0), 6)) ELSE 0 END::BIGINT AS target FROM powered),
epochs AS (SELECT *, CASE WHEN n > 0 THEN target // n ELSE 1 END AS epochs, CASE WHEN n > 0 THEN target % n ELSE 0 END AS rest FROM plan),
placed AS (SELECT d.*, e.n, e.target, e.epochs, e.rest, ('0x' || substr(md5('1|rest|' || d.doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
  FROM d JOIN epochs e ON d.source IS NOT DISTINCT FROM e.source),
drawn AS (SELECT *, rest > 0 AND sum(n_tokens) OVER (PARTITION BY source ORDER BY u, doc_id) - n_tokens < rest AS extra FROM placed),
copies AS (SELECT *, unnest(range(epochs + extra::INT)) AS epoch FROM drawn),
own AS (SELECT *, CASE WHEN epoch = epochs THEN u ELSE ('0x' || substr(md5('1|' || epoch || '|' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496 END AS o FROM copies),
size AS (SELECT greatest(1, ceil(sum(target) / {BLOCK_TOKENS})) AS blocks FROM plan)
SELECT doc_id, source, n_tokens, epoch::INT AS epoch, least(floor(CASE WHEN target > 0 THEN (epoch + o) * n / target ELSE o END * blocks), blocks - 1)::BIGINT AS block FROM own, size
""",
    "op5_nearest": """
WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
""",
    "op7_ngram_jaccard": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOW}), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i : i + 2], ' ') FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, x AS y FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON r.y = e.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.y, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.x = d.doc_id
""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first, sha1(h) AS hex FROM p),
b AS (SELECT page_id, h, first, array_to_string(list_transform(string_split(hex, ''), lambda c: lpad(bin(('0x' || c)::INT), 4, '0')), '') AS bits FROM f)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN first = page_id OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM b
""",
    "op9_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOW}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {LOW}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest([array_to_string(w[i : i + least(len(w), 10) - 1], ' ') FOR i IN range(1, greatest(len(w) - 8, 2))]) AS s FROM b WHERE len(w) > 0),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k),
hits AS (SELECT p.doc_id, p.i, p.k, wins.item_id FROM places p JOIN wins ON wins.k = p.k AND wins.s = array_to_string(p.w[p.i : p.i + p.k - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS l FROM hits GROUP BY 1),
bags AS (SELECT DISTINCT item_id, list_sort(list_distinct(w[i : i + least(len(w), 10) - 1])) AS t FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
occ AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM d),
freq AS (SELECT term, count(*) AS f FROM occ GROUP BY 1),
rare AS (SELECT item_id, t, arg_min(term, f) AS term FROM (SELECT item_id, t, unnest(t) AS term FROM bags) LEFT JOIN freq USING (term) GROUP BY 1, 2 HAVING count(f) = count(*)),
cand AS (SELECT DISTINCT o.doc_id, r.item_id, r.t, o.p, d.w FROM rare r JOIN occ o USING (term) JOIN d ON d.doc_id = o.doc_id WHERE list_has_all(d.w[greatest(1, o.p - {NEAR_SPAN - 1}) : o.p + {NEAR_SPAN - 1}], r.t)),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM cand WHERE len(list_filter(range(p - {NEAR_SPAN - 1}, p + 1), lambda s: list_has_all(w[greatest(1, s) : s + {NEAR_SPAN - 1}], t))) > 0 GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near_items
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id LEFT JOIN near ON near.doc_id = d.doc_id
""",
}
