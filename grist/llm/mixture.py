"""Mixing sources to target weights by temperature, with DataFrame operations only.

Source token shares p are raised to an exponent a and normalised:
w = p**a / sum(p**a).  The exponent is found by bisection between 0 (uniform)
and 1 (as they come): the largest a whose entropy reaches a target, or whose
largest repetition (drawn tokens over own tokens, relative to the least
repeated source) stays in a limit is the smallest a that keeps it.  Four
levels of the bisection are evaluated in one aggregation over the sources.

Weights become tokens of a budget.  Each source is read in permutations of its
documents, one per epoch: the whole epochs that fit, then the documents whose
tokens begin before the budget's end in one further permutation.  Copies are
spread evenly over blocks of the output, so every block has the mixture; order
within a block is by hash.

A hot source is no single task's work: prefix sums over a permutation run
within buckets of about ``BUCKET`` documents, over bucket sums, and over sums of
groups of buckets.  Defined cases: a null source is a source of its own; null
texts have 0 tokens and come along in each whole epoch; a source without tokens
gets one epoch; repeated rows are read as often as they occur and lie together;
rows without an id are placed by a hash of their source, tokens and kept columns;
an empty table gives an empty mixture.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

BUCKET = 512  # documents of a source in one bucket, on average
LEVELS = 4  # of bisection in one job
ROUNDS = 12


def words(text: Column) -> Column:
    """Words of a text as its tokens: runs of anything but white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the keys: 52 bits of an md5 digest."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def exponent(shares: DataFrame, entropy: float | None = None, repeats: float | None = None) -> float:
    """The exponent for sources (p): the largest with at least ``entropy`` nats, or the smallest with at most ``repeats``."""
    if (entropy is None) == (repeats is None):
        raise ValueError("give either an entropy or a repetition limit")
    p = F.col("p")

    def met(candidates: list[float]) -> list[bool]:
        columns = []
        for i, a in enumerate(candidates):
            if entropy is not None:
                z, t = F.sum(F.pow(p, a)), F.sum(F.pow(p, a) * a * F.log(p))
                columns.append((F.log(z) - t / z >= entropy).alias(f"m{i}"))
            else:  # w / p is the repetition, least for the largest source
                columns.append((F.max(F.pow(p, a - 1)) <= repeats * F.min(F.pow(p, a - 1))).alias(f"m{i}"))
        return [bool(x) for x in shares.where("p > 0").agg(*columns).first()]

    rising = repeats is not None  # the limit is kept from some exponent on
    if met([1.0])[0] and not rising:
        return 1.0
    if rising and met([0.0])[0]:
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        parts = 1 << LEVELS
        mids = [lo + (hi - lo) * i / parts for i in range(1, parts)]
        ok = met(mids)
        a, b = 0, parts
        for _ in range(LEVELS):
            m = (a + b) // 2
            if ok[m - 1] == rising:
                b = m
            else:
                a = m
        lo, hi = lo + (hi - lo) * a / parts, lo + (hi - lo) * b / parts
    return hi if rising else lo


def targets(sizes: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: int | None = None) -> DataFrame:
    """(source, n, docs, p, weight, target): tokens that each source shall give.

    Without a budget it is the least that reads every source once as a whole.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shares = sizes.withColumn("p", F.col("n") / F.lit(max(total, 1)).cast("long"))
    a = exponent(shares, entropy, repeats) if total else 1.0
    powered = shares.withColumn("power", F.when(F.col("p") > 0, F.pow("p", F.lit(a))).otherwise(0.0))
    z, least = powered.agg(F.sum("power"), F.max(F.when(F.col("p") > 0, F.col("n") / F.col("power")))).first()
    z, least = z or 1.0, least or 0.0
    # weight * budget >= n for all sources from budget = z * max(n / power) on
    whole = float(budget) if budget is not None else least * z
    share = F.col("power") / F.lit(z)
    exact = F.round(share * F.lit(whole), 6)
    return powered.select("source", "n", "docs", "p", share.alias("weight"), F.when(F.col("n") > 0, F.ceil(exact)).otherwise(0).cast("long").alias("target"))


def _before(df: DataFrame, keys: list[str], order: list[str], value: str) -> Column:
    return F.coalesce(F.sum(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def mix(docs: DataFrame, id: str = "doc_id", source: str = "source", tokens: Column | None = None, entropy: float | None = None, repeats: float | None = None, budget: int | None = None, block_tokens: int = 1 << 20, seed: int = 1, keep: list[str] | None = None) -> DataFrame:
    """The mixture: kept columns (default: id, source) with n_tokens, epoch, block and place, a row per copy.

    ``place`` orders rows within a block.
    """
    keep = [id, source] if keep is None else keep
    n_tokens = tokens if tokens is not None else words(F.col("text"))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{source}`").alias("mix source"), F.col(f"`{id}`").cast("long").alias("mix id"), n_tokens.alias("n_tokens"))
    stand_in = F.concat(F.lit("null "), F.xxhash64("mix source", "n_tokens", *[F.col(f"`{c}`") for c in keep]).cast("string"))
    rows = rows.withColumn("mix key", F.coalesce(F.col("mix id").cast("string"), stand_in))
    slim = written(rows.select("mix source", "mix id", "mix key", "n_tokens"), "slim")  # texts are read once for their counts
    if set(keep) <= {id, source}:
        rows = slim.select(*[F.col("mix id" if c == id else "mix source").alias(c) for c in keep], "mix source", "mix id", "mix key", "n_tokens")
    sizes = written(slim.select(F.col("mix source").alias("source"), "n_tokens").groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")), "sizes")
    plan = targets(sizes, entropy, repeats, budget)
    plan = plan.withColumn("epochs", F.when(F.col("n") > 0, F.floor(F.col("target") / F.greatest("n", F.lit(1)))).otherwise(1).cast("int")).withColumn("rest", F.when(F.col("n") > 0, F.col("target") - F.col("epochs") * F.col("n")).otherwise(0))
    plan = written(plan.select(F.col("source").alias("plan source"), "n", "docs", "target", "epochs", "rest", F.ceil(F.col("docs") / BUCKET).cast("long").alias("buckets")), "plan")

    def planned(df: DataFrame) -> DataFrame:
        return df.join(plan, F.col("mix source").eqNullSafe(F.col("plan source"))).withColumn("u", uniform(seed, F.lit("rest"), F.col("mix key")))

    joined = planned(slim).withColumn("bucket", F.floor(F.col("u") * F.col("buckets"))).withColumn("group", F.floor(F.col("bucket") / BUCKET))
    # where each bucket of the last permutation begins: sums within groups of buckets, then of groups
    sums = written(joined.groupBy(F.col("mix source").alias("s"), F.col("group").alias("g"), F.col("bucket").alias("b")).agg(F.sum("n_tokens").alias("t"), F.max("rest").alias("rest")), "buckets")
    groups = sums.groupBy("s", "g").agg(F.sum("t").alias("t"))
    groups = groups.select(F.col("s").alias("gs"), F.col("g").alias("gg"), _before(groups, ["s"], ["g"], "t").alias("base"))
    begins = sums.withColumn("inner", _before(sums, ["s", "g"], ["b"], "t")).join(groups, F.col("s").eqNullSafe(F.col("gs")) & (F.col("g") == F.col("gg")))
    begins = written(begins.select("s", "b", "t", (F.col("base") + F.col("inner")).alias("begin"), "rest"), "begins")
    # whole buckets before the end are taken, the one that holds it is cut row by row
    cut = begins.where("begin < rest and begin + t >= rest").select("s", "b", "begin", "rest")
    edge = joined.select(F.col("mix source").alias("es"), F.col("bucket").alias("eb"), "u", F.col("mix id").alias("ei"), "n_tokens")
    edge = edge.join(F.broadcast(cut) if cut.count() <= 100_000 else cut, F.col("es").eqNullSafe(F.col("s")) & (F.col("eb") == F.col("b")))
    inside = F.col("begin") + F.coalesce(F.sum("n_tokens").over(W.partitionBy("es", "eb").orderBy("u", "ei").rangeBetween(W.unboundedPreceding, W.currentRow)) - F.sum("n_tokens").over(W.partitionBy("es", "eb", "u", "ei")), F.lit(0))
    last = edge.select("es", "u", "ei", inside.alias("at"), "rest").where("at < rest").groupBy("es").agg(F.max("u").alias("last_u"), F.max(F.struct("u", "ei")).alias("last"))
    bound = written(plan.join(last, F.col("plan source").eqNullSafe(F.col("es")), "left").select(F.col("plan source").alias("bound source"), F.col("last_u")), "bound")

    # a row per copy, placed by its share of the source's stream
    out = planned(rows).join(bound, F.col("mix source").eqNullSafe(F.col("bound source")), "left")
    extra = (F.col("rest") > 0) & (F.col("u") <= F.coalesce(F.col("last_u"), F.lit(-1.0)))
    copies = F.col("epochs") + F.when(extra, 1).otherwise(0)
    total = plan.agg(F.sum(F.greatest("target", F.lit(0)))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_tokens))
    out = out.where(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), copies - 1)))
    own = F.when(F.col("epoch") == F.col("epochs"), F.col("u")).otherwise(uniform(seed, F.col("epoch"), F.col("mix key")))
    share = F.when(F.col("target") > 0, (F.col("epoch") + own) * F.col("n") / F.col("target")).otherwise(own)
    block = F.least(F.floor(share * n_blocks), F.lit(n_blocks - 1)).cast("long")
    return out.select(*[F.col(f"`{c}`") for c in keep], "n_tokens", F.col("epoch").cast("int").alias("epoch"), block.alias("block"), uniform(seed + 1, F.col("epoch"), F.col("mix source"), F.col("mix key")).alias("place"))
