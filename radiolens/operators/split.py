"""Splits, folds, imputation, scaling and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolens.functions.numbers import number
from radiolens.plans.ordered import LogOrder, position
from radiolens.plans.quantiles import exact_quantiles


def rank_by_time(df: DataFrame, order: LogOrder, out: str = "place") -> DataFrame:
    """0-based place of every row in the log, from one distributed sort."""
    return position(df, order, out)


def time_split(df: DataFrame, order: LogOrder, cuts: Sequence[float] = (0.70, 0.85)) -> DataFrame:
    """``split`` by time rank: first 70 % train, next 15 % validation, last 15 % test."""
    total = df.agg(F.count(F.lit(1))).scalar()
    placed = position(df, order, "_place")
    ends = [F.floor(total * F.lit(c)) for c in cuts]
    split = (
        F.when(F.col("_place") < ends[0], "train")
        .when(F.col("_place") < ends[1], "validation")
        .otherwise("test")
    )
    return placed.withColumn("split", split).drop("_place")


def _shuffled_place(df: DataFrame, label: str, id: str, seed: int, plan: str) -> DataFrame:
    """Place of each row among the rows of its class in a seeded hash order."""
    hashed = df.withColumn("_hash", F.xxhash64(F.col(id), F.lit(seed)))
    order = LogOrder(by=("_hash", id), keys=(label,), plan=plan)
    return position(hashed, order, "_place").drop("_hash")


def stratified_split(
    df: DataFrame, label: str, id: str, test: float = 0.2, seed: int = 42, plan: str = "chunked"
) -> DataFrame:
    """``split`` train/test with the same share of every class, exact to one row."""
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_size"))
    placed = _shuffled_place(df, label, id, seed, plan)
    joined = placed.join(sizes, F.col(label).eqNullSafe(F.col("_label")), "inner")
    taken = F.floor(F.col("_size") * test + 0.5)
    split = F.when(F.col("_place") < taken, "test").otherwise("train")
    return joined.withColumn("split", split).drop("_place", "_size", "_label")


def stratified_folds(
    df: DataFrame, label: str, id: str, k: int = 5, seed: int = 42, plan: str = "chunked"
) -> DataFrame:
    """``fold`` 0..k-1, every class spread evenly over the folds."""
    placed = _shuffled_place(df, label, id, seed, plan)
    return placed.withColumn("fold", (F.col("_place") % k).cast("int")).drop("_place")


def impute_median(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL to the exact median of the training rows; a column without any value stays NULL."""
    medians = exact_quantiles(train, columns, [0.5])
    table = medians.agg(  # one entry per column
        F.map_from_entries(F.collect_list(F.struct("column", "value")))
    ).scalar()
    filled = df.withColumn("_medians", table)
    return filled.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.try_element_at("_medians", F.lit(c))) for c in columns}
    ).drop("_medians")


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(number(c), F.lit(0.0)) for c in columns})


def feature_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population std per feature, as the scaler sees them."""
    rows = [
        F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"))
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def standard_scale(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population std of the training rows; a constant column is only centred.

    One aggregation of ``train`` feeds the projection as a scalar subquery; no second shuffle.
    """
    stats = train.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
        ).alias("s")
    ).scalar()
    scaled = df.withColumn("_stats", stats)

    def scale(c: str):
        spread = F.col(f"_stats.s_{c}")
        return (F.col(c) - F.col(f"_stats.m_{c}")) / F.when(spread > 0, spread).otherwise(1.0)

    return scaled.withColumns({c: scale(c) for c in columns}).drop("_stats")


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weight ``n / (classes * n_class)`` on every row."""
    counts = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.struct(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).alias("t")).scalar()
    table = counts.select("_label", (totals["n"] / (totals["k"] * F.col("_n"))).alias(out))
    return df.join(table, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")
