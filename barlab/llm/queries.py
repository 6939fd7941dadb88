"""Registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm import decontaminate, html, lines, near, negatives, pack, pii, quality, ranked, rules, shard, sql, toxicity, vectors
from barlab.llm.common import read


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold ten-word windows of benchmark items."""
    return decontaminate.leak_digest(decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; the counts and base_sha256 cover the base spans, ``spans`` all of them."""
    found = pii.find_pii(read(spark, sf_dir, "documents"))
    counts = [F.col(f"base.{kind}").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_added")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 2048 tokens."""
    return pack.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose templates recur in others."""
    return lines.drop_templates(read(spark, sf_dir, "documents")).select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_dropped")


def op5_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies and number of links of every document."""
    return near.join_near(read(spark, sf_dir, "documents")).drop("component", "text_hash")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(read(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of the rule cascade for every document."""
    return rules.judge(read(spark, sf_dir, "documents")).drop("rejected_by")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of equal row counts."""
    placed = shard.shard(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, by positives."""
    return negatives.mine(read(spark, sf_dir, "embeddings"))


def op12_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and survivors of near-duplicate vectors."""
    return vectors.link(read(spark, sf_dir, "embeddings"))


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return ranked.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_pii, op3_pack, op4_lines, op5_near, op6_html, op7_toxicity, op8_rules, op9_quality, op10_shard, op11_negatives, op12_vectors, op13_ranked)}
ORACLES = {k: v for k, v in sql.ORACLES.items() if k in QUERIES}
