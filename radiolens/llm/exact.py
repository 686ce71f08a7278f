"""Exact duplicates: 128-bit content hash, bytes compared inside a hash group, one row stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolens.llm.common import ascii_lower


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "min") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after lower-casing A-Z. Groups are formed by the 128-bit hash *and*
    the text itself, so two texts with one hash stay apart; copies collapse before the shuffle. The row with
    the smallest (``keep="min"``) or largest id stays. Rows then find their group by 384 bits of digests, a
    join without texts in which Spark splits a group that holds much of the table.

    NULL text: the empty text. NULL ids count in ``group_size`` but never stay beside a row that has an id; in a group without
    any id ``keep_id`` is NULL and nothing is kept. Rows that repeat an id and text are one document: all of
    them are kept or none. Empty table: no rows. Other columns are ignored.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(key).alias("doc_id"), ascii_lower(F.col(text)).alias("norm"))
    rows = rows.select("doc_id", "norm", F.unhex(F.md5("norm")).alias("h"))
    groups = rows.groupBy("h", "norm").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    slim = rows.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"))
    return slim.join(groups, ["h", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        "text_sha256",
    )
