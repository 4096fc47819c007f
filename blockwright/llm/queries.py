"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.llm import conversation, decontaminate, forced_bpe, hmm_score, line_dedup, prefix_counts, secret_scan, sharding, shingle_join, spelling, suffix_dedup, toxicity, vector_dedup
from blockwright.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_components(table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 512)


#: Bytes of a shard in the sharding query.
SHARD_BYTES = 1 << 20


def fold(id_col: str, k: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(k))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda c: fold(c, 3) != 1)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.shingle_components(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op4_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = hmm_score.score_texts(table(spark, sf_dir, "documents"), fold("doc_id", 5) != 1)
    held_out = F.coalesce(fold("doc_id", 5) == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forced_bpe.digests(forced_bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair_conversations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vector_dedup": op1_vector_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_hmm_score": op4_hmm_score,
    "op5_bpe": op5_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_decontaminate": op7_decontaminate,
    "op8_shards": op8_shards,
    "op9_shingle_join": op9_shingle_join,
    "op10_line_dedup": op10_line_dedup,
    "op11_secrets": op11_secrets,
    "op12_spelling": op12_spelling,
    "op13_conversation": op13_conversation,
}
ORACLES: dict[str, str] = {
    "op7_decontaminate": decontaminate.SQL,
    "op8_shards": sharding.sql(SHARD_BYTES),
    "op12_spelling": spelling.SQL,
    "op13_conversation": conversation.sql(),
}
