"""Per-cell aggregates and actions; every one combines before its shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Action texts.
HANDOVER = "HANDOVER RECOMMENDED - interference + neighbor"
INTERFERENCE = "INTERFERENCE - check antenna/frequency"
OPTIMIZE = "HANDOVER OPTIMIZATION - adjust params"
NO_ACTION = "OK - no action"


def cell_aggregates(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Mean, min, max and sample std (0 for a single row) per cell, and its row count."""
    aggs: list[Column] = []
    for c in columns:
        aggs += [
            F.avg(c).alias(f"{c}_cell_mean"),
            F.min(c).alias(f"{c}_cell_min"),
            F.max(c).alias(f"{c}_cell_max"),
            F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_cell_std"),
        ]
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*aggs, F.count(F.lit(1)).alias("n_samples_cell"))
    )


def attach_cell_stats(df: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Left join on the cell code; a row without a code matches nothing."""
    return df.join(stats, key, "left")


def cell_stats(df: DataFrame, key: str = "psc", n: int = 100) -> DataFrame:
    """Per-cell mean/std/count to three decimals, the ``n`` largest cells."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.round(F.avg("rscp"), 3).alias("rscp_mean"),
            F.round(F.stddev_samp("rscp"), 3).alias("rscp_std"),
            F.count("rscp").alias("n_samples"),
            F.round(F.avg("ecn0"), 3).alias("ecn0_mean"),
            F.round(F.stddev_samp("ecn0"), 3).alias("ecn0_std"),
        )
        .orderBy(F.desc("n_samples"), key)
        .limit(n)
    )


def cell_recommendations(
    df: DataFrame, key: str = "psc", int_cut: float = 0.5, ho_cut: float = 0.3
) -> DataFrame:
    """Interference and handover rate per cell and the action they call for."""
    rates = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.avg("interference").alias("int_rate"), F.avg("handover_needed").alias("ho_rate"))
    )
    action = (
        F.when(
            F.col("int_rate") > int_cut,
            F.when(F.col("ho_rate") > ho_cut, HANDOVER).otherwise(INTERFERENCE),
        )
        .when(F.col("ho_rate") > 0.5, OPTIMIZE)
        .otherwise(NO_ACTION)
    )
    return rates.select(
        key,
        F.bround("int_rate", 3).alias("interference_rate"),
        F.bround("ho_rate", 3).alias("handover_rate"),
        action.alias("recommendation"),
    ).orderBy(F.desc("interference_rate"), key)


def cell_alert_counts(recs: DataFrame, cut: float = 0.1) -> DataFrame:
    return recs.agg(
        F.count_if(F.col("interference_rate") > cut).alias("interference_cells"),
        F.count_if(F.col("handover_rate") > cut).alias("handover_cells"),
        F.count_if(F.col("recommendation") == HANDOVER).alias("handover_advised"),
    )


def top_n_cells(df: DataFrame, by: str, n: int, key: str = "psc") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(by), key).limit(n)
