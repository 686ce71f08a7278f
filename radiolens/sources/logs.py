"""Log readers: every value arrives as text, numbers are made by the cleaning operators."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiolens.functions.numbers import number

# Encodings in the order they are tried (every byte is valid in latin1, so nothing
# after it is ever reached), and the names Spark has for them; a byte-order mark is cut off later.
ENCODINGS = ("utf-8", "utf-8-sig", "latin1", "cp1252")
SPARK_NAMES = {"utf-8-sig": "utf-8", "latin1": "iso-8859-1"}
# Columns of the LTE log and of the UMTS log.
LTE_COLUMNS = ("time", "pci", "band", "rsrp", "rsrq", "rlc_dl")
UMTS_HEADER = (
    "Time", "Band (active)", "Channel number (active)", "Scrambling code (active)", "RSCP (active)",
    "Ec/N0 (active)", "RSCP (detected)", "Scrambling code (detected)",
)


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def broken_files(spark: SparkSession, path: str) -> list[str]:
    """Files of ``path`` that are not valid UTF-8; lines are tested where they are read."""
    lines = spark.read.text(path).where(~F.is_valid_utf8("value"))
    return [_plain(r[0]) for r in lines.select(F.col("_metadata.file_path").alias("file")).distinct().collect()]


def all_files(spark: SparkSession, path: str) -> list[str]:
    """The files that a read of ``path`` would read."""
    return [_plain(f) for f in spark.read.text(path).inputFiles()]


def _plain(uri: str) -> str:
    """One form of a file's name: no escapes, one slash behind the scheme of local files."""
    return re.sub("^file:/+", "file:/", unquote(uri))


def read_log(
    spark: SparkSession, path: str, sep: str = ";", encodings: Sequence[str] = ENCODINGS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Delimited text with a header, all columns as text.

    The encoding is found for each file: UTF-8 where every line is valid, else latin1. Give ``columns``
    to skip reading the header first; give one encoding to skip the test. A byte-order mark is removed
    from the header. Columns are matched by place, as in one read of the whole path.
    """

    def read(paths: str | list[str], encoding: str) -> DataFrame:
        encoding = SPARK_NAMES.get(encoding, encoding)
        reader = spark.read.option("sep", sep).option("encoding", encoding).option("header", True)
        if columns:
            return reader.schema(_text_schema(columns)).csv(paths)
        frame = reader.option("inferSchema", False).csv(paths)
        return frame.toDF(*[c.lstrip("\ufeff") for c in frame.columns])

    if len(encodings) == 1:
        return read(path, encodings[0])
    broken = set(broken_files(spark, path))
    if not broken:
        return read(path, "utf-8")
    valid = [f for f in all_files(spark, path) if f not in broken]
    latin = read(sorted(broken), "latin1")
    return read(valid, "utf-8").union(latin) if valid else latin


def read_lte_log(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """LTE log: six columns renamed by position, values numeric, missing as NULL."""
    raw = (
        spark.read.option("sep", sep).option("header", header).option("enforceSchema", True)
        .schema(_text_schema(LTE_COLUMNS)).csv(path)
    )
    return raw.withColumns({c: number(c) for c in ("pci", "rsrp", "rsrq", "rlc_dl")})


def missing_columns(df: DataFrame, expected: Sequence[str]) -> list[str]:
    return [c for c in expected if c not in df.columns]


def validate_columns(df: DataFrame, expected: Sequence[str] = UMTS_HEADER) -> DataFrame:
    """``df`` itself, or an error that names the missing columns, before any job runs."""
    missing = missing_columns(df, expected)
    if missing:
        raise ValueError(f"Missing expected columns: {missing}")
    return df


def parse_device_log(
    df: DataFrame, numeric: Sequence[str], text: Sequence[str] = ()
) -> DataFrame:
    """Trim header names and text, take the number out of values such as ``-99 dBm``."""
    trimmed = df.toDF(*[c.strip() for c in df.columns])
    value = {c: F.regexp_extract(F.col(f"`{c}`"), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double") for c in numeric}
    return trimmed.withColumns({**value, **{c: F.trim(F.col(f"`{c}`")) for c in text}})
