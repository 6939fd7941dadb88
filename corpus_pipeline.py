"""Cleaning pipeline over ``documents``: toxic documents go, recurring lines go, one of each group of near copies stays,
documents with benchmark passages go, and the rest is packed into token sequences.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of ``docs``. Rows with nulls, repeated rows and empty tables are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm import decontaminate, lines, near, pack, toxicity
from barlab.llm.common import read, written
from barlab.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier, fitted on the labels of ``docs``, does not reject. Without labels of both classes it scores
    the base rate; null and empty texts stay."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that recur in others; n_chars, where there is one, follows a text that lost lines. A null text stays
    null, and a text that loses all of its lines stays as an empty one."""
    cut = lines.drop_templates(docs.select("doc_id", "text", F.struct("*").alias("whole")))
    new = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("whole.n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new.get(c, F.col("whole")[c]).alias(c) for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id of every group of near copies. Texts without words are copies of each other."""
    return near.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a passage of the benchmark; null and empty texts stay."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their sequences and places; a null text is an empty one."""
    return pack.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_recurring_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]
#: SQL cannot express the classifier and the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces; the documents between two stages are a table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
