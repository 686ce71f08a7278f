"""A corpus pipeline of five stages over ``documents``; every stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolens.llm import bpe
from radiolens.llm.catalog import MIX, PATTERN, SIMHASH, TOXIC, VOCABULARY
from radiolens.llm.common import Stages, table
from radiolens.llm.lines import dedup_lines
from radiolens.llm.mixing import mixed_documents
from radiolens.llm.simhash import one_of_each
from radiolens.llm.toxicity import score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), score="toxicity score")
    return scored.where(F.col("toxicity score") < TOXIC).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the lines of windows that occurred before; ``n_chars`` follows the text."""
    left = dedup_lines(docs, long_words=50, removed="lines removed")
    n = F.when(F.col("lines removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n).select(docs.columns)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; among them, one of those left without text."""
    return one_of_each(docs, **SIMHASH)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes as often as the mix takes it."""
    return mixed_documents(docs, **MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its token ids (packed unsigned 32-bit), their number, and whether decoding gives the text back."""
    rows = bpe.round_trip(docs, **VOCABULARY, **PATTERN)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return rows.select("doc_id", "lang", "source", bpe.n_tokens("ids").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("toxicity", toxicity), ("lines", lines), ("simhash", simhash), ("mix", mix), ("encode", encode)]

#: The learned toxicity score is not expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn; each result is written to the shared folder and read again."""
    stages = Stages(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stages.write(stage(spark, docs, sf_dir), f"corpus-{name}")
        if before is not None:
            stages.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
