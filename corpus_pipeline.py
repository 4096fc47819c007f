"""A training-data pipeline over documents: five stages, each by one of the corpus operators.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns
the columns of docs; the last returns ids and digests. Between stages the data are written.
Rows with null texts and null ids pass the filters: they are not toxic, near copies or
contaminated as far as can be told.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.llm import decontaminate, forced_bpe, line_dedup, shingle_join, toxicity
from blockwright.llm.common import durable, sent, table
from blockwright.llm.queries import fold, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more go. Labels of two thirds of the documents teach the score."""
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    scored = toxicity.score_toxicity(marked, table(spark, sf_dir, "labels"), lambda c: fold(c, 3) != 1, keep=("mark",))
    bad = durable(scored.where("predicted = 1").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__mark"))
    return docs.join(sent(bad), same, "left_anti").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go; a document whose lines all go stays with an empty text."""
    cleaned = line_dedup.dedup_lines(docs, counts=False)
    return cleaned.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays. Rows of one id with different texts are documents of their own; rows with null ids stay."""
    mark = F.xxhash64("text")
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", mark.alias("mark")))
    components = durable(shingle_join.shingle_components(docs.select(key.alias("key"), "text"), id_col="key").where("key IS NOT NULL"))
    copies = components.where("component_id <> key").select(F.col("key.doc_id").alias("__id"), F.col("key.mark").alias("__mark")).distinct()
    kept = docs.join(sent(copies), (F.col("doc_id") == F.col("__id")) & (mark == F.col("__mark")), "left_anti")
    if components.groupBy("key").count().where("count > 1").limit(1).count():  # repeated rows
        kept = kept.where("doc_id IS NULL").unionByName(kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]))
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if a twentieth of their words or more stand in windows of benchmark items."""
    named = {c: f"kept_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # whatever they are called
    found = decontaminate.contamination(docs.withColumnsRenamed(named), table(spark, sf_dir, "benchmark"), keep=("text", *named.values()))
    return found.where("NOT contaminated").select(*[F.col(named.get(c, c)).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and the digest of the text they decode to."""
    return forced_bpe.digests(forced_bpe.encode_decode(docs, vocabulary("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]
#: Learned scores and merges by rank are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
