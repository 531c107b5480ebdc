"""URL filters with redirect equivalence.

A rule is (action, host, path): it fits its host and all subdomains if the
url's path starts with the rule's; the longest fitting rule decides.  Urls that
redirect to each other or name one canonical address are aliases: connected
components over those edges.  A url without a rule takes its component's
decision: allow if any alias is explicitly allowed, else block if any is
blocked, else allow.  A rule of its own always comes first, so an explicit
allow is never overridden by an alias's block.

Up to FEW rules are one expression; more are a table, joined on the hosts above a
url's host and on as much of its path as some rule of that host asks for, so the
number of rules has no limit.

Canonical links and refreshes count in a page's head only, outside comments,
scripts and other raw text; what stands in the body, readers' text included, is
no statement of the page's.

Defined cases: null urls and urls without ``://`` have empty host and path, fit
no rule, have no aliases and are allowed; of two fitting rules of one length
allow wins; repeated pages are judged alike; an edge to an address that is no
page still carries that address's decision.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .html_text import TOKEN
from .shared import forget, written

FEW = 64  # rules that are part of the plan

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(df: DataFrame, url: str, keep: Sequence[str]) -> DataFrame:
    """The kept columns with host, path and key (host, path and query) of a url; all empty where there is no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    df = df.select(*keep, F.col(url).alias("url part"), at.alias("at"))
    df = df.select(*keep, F.expr("if(at > 0, substring(`url part`, at + 3), '')").alias("rest"))
    df = df.select(*keep, "rest", F.regexp_extract("rest", r"^[^/?#]*", 0).alias("raw"))
    df = df.select(*keep, F.translate("raw", UPPER, LOWER).alias("host"), F.expr("substring(rest, length(raw) + 1)").alias("after"))
    return df.select(*keep, "host", F.regexp_extract("after", r"^[^?#]*", 0).alias("path"), F.concat("host", F.regexp_extract("after", r"^[^#]*", 0)).alias("key"))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The deciding rule as struct<rule, action>, null if none fits."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1] + r[2])):  # the last that fits wins
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) for those distinct (host, path) of ``urls`` that a rule (action, rhost, rpath) fits."""
    addresses = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = rules.groupBy("rhost").agg(F.collect_set(F.length("rpath")).alias("lengths"))
    asked = addresses.select("host", "path", F.explode(F.array_distinct(above)).alias("rhost")).join(lengths, "rhost")
    asked = asked.select("host", "path", "rhost", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    asked = asked.select("host", "path", "rhost", F.expr("substring(path, 1, n)").alias("rpath"))
    fits = asked.join(rules, ["rhost", "rpath"])
    rule = F.concat("rhost", "rpath")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("action") == "allow").alias("allows"), rule.alias("rule"), F.col("action").alias("action"))).alias("best")
    return fits.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.action")


def with_rule(df: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """``df``, which has host and path, with the deciding rule as ``fit``: struct<rule, action>, null if none fits."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= FEW:
            return df.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
        rules = df.sparkSession.createDataFrame([tuple(r) for r in rules], "action string, rhost string, rpath string")
    found = ruled(df, rules.toDF("action", "rhost", "rpath").distinct()).select("host", "path", F.struct("rule", "action").alias("fit"))
    return df.join(found, ["host", "path"], "left")


# Elements that a head may hold; anything else begins the body.
HEAD_TAGS = frozenset("html head meta link base basefont bgsound".split())
ATTRIBUTES = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
REFRESH = re.compile(r"""^[\s\d.]*[;,\s]\s*url\s*=\s*["']?([^"']*)""", re.I)


def links_of(source: str, head: str) -> list[str]:
    """Absolute addresses of a head's canonical links and refreshes."""
    found, base, at = [], source, 0
    for m in TOKEN.finditer(head):
        if head[at : m.start()].strip():
            break
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag not in HEAD_TAGS or m["close"] and tag == "head":
            break
        attrs: dict[str, str] = {}
        for a in ATTRIBUTES.finditer(m["attrs"] or ""):
            attrs.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or "").strip())
        try:
            if tag == "base" and base == source:
                base = urljoin(source, attrs.get("href", ""))
            elif tag == "link" and "canonical" in attrs.get("rel", "").lower().split() and attrs.get("href"):
                found.append(urljoin(base, attrs["href"]))
            elif tag == "meta" and attrs.get("http-equiv", "").lower() == "refresh" and (to := REFRESH.match(attrs.get("content", ""))) and to[1].strip():
                found.append(urljoin(base, to[1].strip()))
        except ValueError:  # no address
            continue
    return found


def page_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(source, target) urls: canonical links and refresh redirects in the heads of pages, made absolute."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(u, t) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in links_of(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["source", "target"])

    # only heads go to Python
    head = F.regexp_extract(F.col(f"`{html}`"), r"(?is)^.*?(?=</head\b|<body\b|\z)", 0)
    heads = pages.where(F.instr(F.col(f"`{url}`"), "://") > 0).select(F.col(f"`{url}`").alias("source"), head.alias("head")).where(F.col("head").rlike(r"(?i)canonical|refresh"))
    return heads.mapInArrow(run, "source string, target string")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, id: str = "page_id", url: str = "url", html: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) per page row.

    ``rules`` are (action, host, path), as a list or a table of any size; ``redirects`` may add (source, target) urls.
    """
    spark = pages.sparkSession
    edges = page_edges(pages, url, html) if html else spark.createDataFrame([], "source string, target string")
    if redirects is not None:
        edges = edges.unionByName(redirects.select("source", "target"))
    edges = with_parts(edges, "source", ["target"]).select("target", F.col("key").alias("a"))
    edges = with_parts(edges, "target", ["a"]).select("a", F.col("key").alias("b")).where("a <> '' and b <> '' and a <> b")
    nodes = connected_components(edges)
    named = with_rule(with_parts(nodes.withColumn("url", F.concat(F.lit("http://"), "node")), "url", ["component"]), rules).withColumn("action", F.col("fit.action"))
    decided = written(named.groupBy("component").agg(F.max(F.when(F.col("action") == "allow", 2).when(F.col("action") == "block", 1).otherwise(0)).alias("d")).where("d > 0"), "decided")
    aliases = written(nodes.join(decided, "component").select(F.col("node").alias("key"), F.when(F.col("d") == 2, "allow").otherwise("block").alias("by_alias")), "aliases")
    forget(spark, decided)

    own = with_parts(pages.select(F.col(f"`{id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url")), "url", ["page_id"])
    joined = with_rule(own, rules).join(aliases, "key", "left")
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.action", "by_alias", F.lit("allow")).alias("verdict"))
