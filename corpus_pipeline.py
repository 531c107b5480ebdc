"""The corpus pipeline: STAGES over ``documents``, each stage on what its predecessor kept.

Rows are told apart by id and text, so that of rows that share an id only those
that a decision is about are affected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grist.llm import decontaminate, langid, mixture, ngram_join, sstable
from grist.llm.queries import BLOCK_TOKENS, REPEATS
from grist.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text goes if no language has this mean probability over its words, or if it has no letters.
LEAST_SCORE = 0.4
#: Near duplicates: shingles of five words, Jaccard similarity of 0.8.
SHINGLE, NUM, DEN = 5, 8, 10
BROADCAST_ROWS = 250_000  # of two numbers each


def _batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose (doc_id, text_hash) is in ``gone``."""
    gone = written(gone.select(F.col("doc_id").alias("gone id"), F.col("text_hash").alias("gone hash")).distinct(), "gone")
    small = gone.count() <= BROADCAST_ROWS
    same = docs["doc_id"].eqNullSafe(F.col("gone id")) & (F.xxhash64(docs["text"]) == F.col("gone hash"))
    return docs.join(F.broadcast(gone) if small else gone, same, "left_anti")


def _of(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` joined to (doc_id, text_hash) rows; null ids are equal."""
    rows = rows.select(F.col("doc_id").alias("row id"), F.col("text_hash").alias("row hash"))
    return docs.join(rows, docs["doc_id"].eqNullSafe(F.col("row id")) & (F.xxhash64(docs["text"]) == F.col("row hash")), how)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts that no learned language fits."""
    _batches(spark)
    found = langid.identify(docs, learn=~langid.held_out(F.col("doc_id")), keep=COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked texts, once."""
    _batches(spark)
    docs = docs.select(*COLUMNS)
    found = ngram_join.jaccard_components(docs, k=SHINGLE, num=NUM, den=DEN)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = _without(docs, found.where(~stays))
    repeated = written(found.where(stays).groupBy("doc_id", "text_hash").count().where("count > 1"), "repeated")
    if repeated.isEmpty():
        return kept
    return _without(kept, repeated).unionByName(_of(kept, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item.

    Near matches decide nothing here: a clean document may well hold a window's words in another order.
    """
    _batches(spark)
    docs = docs.select(*COLUMNS)
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources so that shares follow the tempered weights, in blocks of the mixture."""
    mixed = mixture.mix(docs, repeats=REPEATS, block_tokens=BLOCK_TOKENS, keep=list(COLUMNS))
    return mixed.repartitionByRange("block", "place").sortWithinPartitions("block", "place").select(*COLUMNS)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids to sorted-string-table shards and returns what they hold."""
    _batches(spark)
    return sstable.token_shards(docs)


STAGES = [
    ("language id", language),
    ("n-gram jaccard join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token output", token_shards),
]
#: The first stage's model and the token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
