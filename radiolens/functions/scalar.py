"""Row-level functions: time parts, codes, confidence and probability text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolens.functions.numbers import flag

# Hours of the day that count as peak.
PEAK_HOURS = (7, 8, 9, 17, 18, 19, 20)
# Class code -> name of the quality-of-service model.
QOS_CLASSES = {0: "Acceptable", 1: "Assez bien", 2: "Mauvaise", 3: "Tres bonne"}
# Lowest confidence (percent) of the bands.
CONFIDENCE_BANDS = (("high", 85.0), ("medium", 70.0))


def time_parts(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns(
        {"hour": F.hour(column), "minute": F.minute(column), "second": F.second(column)}
    )


def is_peak_hour(df: DataFrame, column: str, out: str = "is_peak_hour") -> DataFrame:
    return df.withColumn(out, flag(F.hour(column).isin(*PEAK_HOURS)))


def alphabetical_codes(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """(value, code): 0-based alphabetical codes of the distinct non-null values.

    Numbered in one window over a row per category; no job runs when the plan is made.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    place = F.row_number().over(Window.orderBy(column)) - 1
    return values.withColumn(out or f"{column}_enc", place.cast("bigint"))


def encode_alphabetical(
    df: DataFrame, column: str, out: str | None = None, codes: DataFrame | None = None
) -> DataFrame:
    """Category codes in alphabetical order, NULL -> -1.

    The dimension of distinct values is joined; Spark broadcasts it only when it is small. Give
    ``codes`` (from ``alphabetical_codes``) where ``df`` is dear to compute twice.
    """
    out = out or f"{column}_enc"
    codes = alphabetical_codes(df, column, out) if codes is None else codes
    codes = codes.toDF("_value", out)
    joined = df.join(codes, F.col(column) == F.col("_value"), "left").drop("_value")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(-1)).cast("int"))


def decode_label(
    df: DataFrame, column: str, mapping: Mapping[int, str] = QOS_CLASSES, out: str = "label"
) -> DataFrame:
    """Code to class name; text that is no code, and unknown codes, stay as they are."""
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    text = F.col(column).cast("string")
    whole = text.try_cast("double")
    code = F.when(whole == F.floor(whole), whole.try_cast("int"))
    return df.withColumn(out, F.coalesce(F.try_element_at(table, code), text))


def confidence_of(probs: Column) -> Column:
    return F.round(F.array_max(F.map_values(probs)) * 100, 2)


def confidence_pct(df: DataFrame, probs: str, out: str = "confidence") -> DataFrame:
    return df.withColumn(out, confidence_of(F.col(probs)))


def confidence_band(df: DataFrame, column: str, out: str = "confidence_band") -> DataFrame:
    value = F.coalesce(F.col(column), F.lit(0.0))
    (top, top_cut), (mid, mid_cut) = CONFIDENCE_BANDS
    band = F.when(value >= top_cut, top).when(value >= mid_cut, mid).otherwise("low")
    return df.withColumn(out, band)


def percent_text(entries: Column, decimals: int) -> Column:
    """``label: 12.34%, ...`` of an array of (key, value) structs."""
    return F.array_join(
        F.transform(
            entries, lambda e: F.format_string(f"%s: %.{decimals}f%%", e["key"], e["value"] * 100)
        ),
        ", ",
    )


def format_probabilities(
    df: DataFrame, probs: str, decimals: int = 2, missing: str = "N/A", out: str = "probability_text"
) -> DataFrame:
    filled = F.coalesce(F.size(F.col(probs)), F.lit(0)) > 0
    text = percent_text(F.map_entries(F.col(probs)), decimals)
    return df.withColumn(out, F.when(filled, text).otherwise(missing))


def top_entries(probs: Column, n: int) -> Column:
    """The ``n`` likeliest (key, value) pairs; equal values keep the order of the map."""
    placed = F.transform(
        F.map_entries(probs),
        lambda e, i: F.struct((-e["value"]).alias("rank"), i.alias("at"), e["key"].alias("key"),
                              e["value"].alias("value")),
    )
    return F.transform(
        F.slice(F.array_sort(placed), 1, n),
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")),
    )


def top_probabilities(df: DataFrame, probs: str, n: int = 2, out: str = "top") -> DataFrame:
    return df.withColumn(out, top_entries(F.col(probs), n))
