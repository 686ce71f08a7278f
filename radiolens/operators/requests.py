"""Checks on prediction requests held as maps or text columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolens.functions.numbers import number

# Keys of a quality-of-service request.
QOS_KEYS = ("rsrp", "rsrq", "rlc_downlink_throughput", "band", "physical_cell_identity")
# Accepted (min, max) of the 20 coverage features.
BOUNDS = {
    "rsrp": (-140.0, -40.0),
    "rsrq": (-30.0, 0.0),
    "rlc_dl": (0.0, 10000.0),
    "pci": (0.0, 503.0),
    "band_enc": (0.0, 10.0),
    "hour": (0.0, 23.0),
    "minute": (0.0, 59.0),
    "second": (0.0, 59.0),
    **{f"rsrq_{f}": (-30.0, 0.0) for f in ("lag1", "lag2", "roll3", "roll5")},
    **{f"rlc_dl_{f}": (0.0, 10000.0) for f in ("lag1", "lag2", "roll3", "roll5")},
    **{f"rsrp_{f}": (-140.0, -40.0) for f in ("lag1", "lag2", "roll3", "roll5")},
}


def route_task(
    df: DataFrame, features_map: str, required: Sequence[str] = QOS_KEYS, out: str = "task"
) -> DataFrame:
    """``qos`` when the request carries all quality keys, else ``coverage``."""
    lacking = F.array_except(F.array(*[F.lit(k) for k in required]), F.map_keys(features_map))
    return df.withColumn(out, F.when(F.size(lacking) == 0, "qos").otherwise("coverage"))


def check_features(df: DataFrame, features_map: str, required: Sequence[str]) -> DataFrame:
    """Missing and surplus feature names of every request, and whether it is accepted."""
    wanted = F.array(*[F.lit(k) for k in required])
    given = F.map_keys(features_map)
    return df.withColumns(
        {"missing": F.array_except(wanted, given), "extra": F.array_except(given, wanted)}
    ).withColumn("accepted", (F.size("missing") == 0) & (F.size("extra") == 0))


def coerce_inputs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Blank -> 0; text that is no finite number -> NULL and its name into ``invalid``."""

    def value(name):
        blank = F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) == ""
        return F.when(blank, F.lit(0.0)).otherwise(number(name))

    bad = F.array(*[F.when(value(c).isNull(), F.lit(c)) for c in columns])
    return df.withColumn("invalid", F.array_compact(bad)).withColumns({c: value(c) for c in columns})


def range_audit(df: DataFrame, bounds: Mapping[str, tuple[float, float]] = BOUNDS) -> DataFrame:
    """Values and violations per feature, from a single aggregation over the rows."""
    aggs = []
    for name, (lo, hi) in bounds.items():
        aggs.append(
            F.struct(
                F.lit(name).alias("feature"),
                F.count(name).alias("n"),
                F.count_if(F.col(name) < lo).alias("below"),
                F.count_if(F.col(name) > hi).alias("above"),
            )
        )
    return df.agg(F.array(*aggs).alias("_rows")).select(F.inline("_rows"))


def bounds_from_stats(stats: DataFrame, spread: float = 3.0) -> DataFrame:
    """Fallback bounds of features without fixed ones: mean -/+ ``spread`` standard deviations."""
    return stats.select(
        "feature",
        (F.col("mean") - F.col("std") * spread).alias("lo"),
        (F.col("mean") + F.col("std") * spread).alias("hi"),
    )
