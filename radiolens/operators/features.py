"""Time-series features: row frames over a ``LogOrder``, all of one set from one window pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from radiolens.functions.numbers import ratio
from radiolens.functions.scalar import alphabetical_codes, encode_alphabetical, time_parts
from radiolens.operators.cells import attach_cell_stats, cell_aggregates
from radiolens.operators.clean import coverage_zone, neighbor_flags, signal_gap
from radiolens.plans.ordered import LogOrder, windowed

# The feature sets of the UMTS and of the coverage models.
UMTS_FEATURES = (
    "rscp", "ecn0", "delta_rscp", "has_neighbor", "psc_rscp_mean", "psc_ecn0_mean", "rscp_vs_mean",
    "ecn0_vs_mean", "rscp_rmean_5", "ecn0_rmean_5", "rscp_rmean_10", "ecn0_rmean_10",
    "ecn0_rstd_5", "rscp_diff", "ecn0_diff",
)
COVERAGE_VALUES = ("rsrp", "rsrq", "rlc_dl")
COVERAGE_FEATURES = (
    *COVERAGE_VALUES, "pci", "band_enc", "hour", "minute", "second",
    *[f"{c}_{f}" for c in COVERAGE_VALUES for f in ("lag1", "lag2", "roll3", "roll5")],
)


def _frame(spec: WindowSpec, n: int) -> WindowSpec:
    return spec.rowsBetween(-(n - 1), 0)


def in_cell(order: LogOrder, value: Column, otherwise: Column | None = None) -> Column:
    """Rows whose key is NULL belong to no cell: they get ``otherwise`` (default NULL)."""
    if not order.keys:
        return value
    known = F.col(order.keys[0]).isNotNull()
    for key in order.keys[1:]:
        known = known & F.col(key).isNotNull()
    guarded = F.when(known, value)
    return guarded if otherwise is None else guarded.otherwise(otherwise)


def rolling_mean(column: str, n: int, spec: WindowSpec, order: LogOrder) -> Column:
    return in_cell(order, F.avg(column).over(_frame(spec, n)))


def rolling_std(column: str, n: int, spec: WindowSpec, order: LogOrder) -> Column:
    spread = F.coalesce(F.stddev_samp(column).over(_frame(spec, n)), F.lit(0.0))
    return in_cell(order, spread, F.lit(0.0))


def difference(column: str, spec: WindowSpec, order: LogOrder) -> Column:
    step = F.coalesce(F.col(column) - F.lag(column, 1).over(spec), F.lit(0.0))
    return in_cell(order, step, F.lit(0.0))


def lags(df: DataFrame, columns: Sequence[str], order: LogOrder, ks: Sequence[int] = (1, 2)) -> DataFrame:
    return windowed(
        df, order, max(ks),
        lambda w: {f"{c}_lag{k}": in_cell(order, F.lag(c, k).over(w)) for c in columns for k in ks},
    )


def _rolling_means(df, columns, order, ns, name):
    return windowed(
        df, order, max(ns) - 1,
        lambda w: {name.format(c=c, n=n): rolling_mean(c, n, w, order) for c in columns for n in ns},
    )


def rolling_mean_global(
    df: DataFrame, columns: Sequence[str], order: LogOrder, ns: Sequence[int] = (3, 5)
) -> DataFrame:
    """Rolling means along the whole log (no key)."""
    return _rolling_means(df, columns, replace(order, keys=()), ns, "{c}_roll{n}")


def rolling_mean_cell(
    df: DataFrame, columns: Sequence[str], order: LogOrder, ns: Sequence[int] = (5, 10)
) -> DataFrame:
    return _rolling_means(df, columns, order, ns, "{c}_rmean_{n}")


def rolling_mean_cell_3(df: DataFrame, columns: Sequence[str], order: LogOrder) -> DataFrame:
    return _rolling_means(df, columns, order, (3,), "{c}_roll_mean")


def rolling_std_cell(
    df: DataFrame, columns: Sequence[str], order: LogOrder, n: int = 5, name: str = "{c}_rstd_{n}"
) -> DataFrame:
    return windowed(
        df, order, n - 1,
        lambda w: {name.format(c=c, n=n): rolling_std(c, n, w, order) for c in columns},
    )


def first_difference(
    df: DataFrame, columns: Sequence[str], order: LogOrder, name: str = "{c}_diff"
) -> DataFrame:
    return windowed(
        df, order, 1, lambda w: {name.format(c=c): difference(c, w, order) for c in columns}
    )


def cell_mean_transform(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Mean of the cell on every row, and the row's deviation from it.

    A full-cell frame would hold a hot cell in one task, so the means are aggregated (combining
    before the shuffle) and joined back; Spark broadcasts them when they are small.
    """
    means = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_cell")).agg(
        *[F.avg(c).alias(f"{key}_{c}_mean") for c in columns]
    )
    joined = df.join(means, F.col(key) == F.col("_cell"), "left").drop("_cell")
    return joined.withColumns({f"{c}_vs_mean": F.col(c) - F.col(f"{key}_{c}_mean") for c in columns})


def umts_features(df: DataFrame, order: LogOrder, key: str = "psc") -> DataFrame:
    """The 15-feature UMTS set: gap and neighbor, cell means, rolling 5/10, volatility, steps."""

    def build(w: WindowSpec) -> dict[str, Column]:
        rolls = {
            f"{c}_rmean_{n}": rolling_mean(c, n, w, order) for n in (5, 10) for c in ("rscp", "ecn0")
        }
        steps = {f"{c}_diff": difference(c, w, order) for c in ("rscp", "ecn0")}
        return {**rolls, "ecn0_rstd_5": rolling_std("ecn0", 5, w, order), **steps}

    base = signal_gap(df).withColumn("has_neighbor", F.col("rscp_det").isNotNull().cast("int"))
    return cell_mean_transform(windowed(base, order, 9, build), key, ("rscp", "ecn0"))


def umts_features_notebook(df: DataFrame, order: LogOrder, key: str = "psc") -> DataFrame:
    """The 32-feature UMTS set: gaps, rolling 3, first steps, per-cell aggregates, quality ratio."""

    def build(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for c in ("rscp", "ecn0"):
            out[f"{c}_roll_mean"] = rolling_mean(c, 3, w, order)
            out[f"{c}_roll_std"] = rolling_std(c, 3, w, order)
            out[f"{c}_diff1"] = difference(c, w, order)
        return out

    base = neighbor_flags(signal_gap(df, fill=None), code=key).drop("has_neighbor")
    rolled = windowed(base, order, 2, build)
    joined = attach_cell_stats(rolled, cell_aggregates(df, key, ("rscp", "ecn0")), key)
    return joined.withColumn("rscp_quality_ratio", ratio(F.col("rscp"), F.col("rscp_det")))


def coverage_features(
    df: DataFrame, order: LogOrder, time: str = "ts", drop_first: bool = True, bands: DataFrame | None = None
) -> DataFrame:
    """Zone, time parts, band code, lags 1-2 and rolling means 3/5 of the three radio values.

    ``order`` without keys follows the whole log; with a session key lags stay inside the session.
    ``bands``: the log whose bands are numbered, where ``df`` is dear to compute twice (NULL -> -1).
    """

    def build(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for c in COVERAGE_VALUES:
            out |= {f"{c}_lag{k}": in_cell(order, F.lag(c, k).over(w)) for k in (1, 2)}
            out |= {f"{c}_roll{n}": rolling_mean(c, n, w, order) for n in (3, 5)}
        return out

    codes = None if bands is None else alphabetical_codes(bands, "band")
    rows = encode_alphabetical(time_parts(coverage_zone(df), time), "band", codes=codes)
    rows = windowed(rows, order, 4, build)
    return rows.dropna() if drop_first else rows


def qos_features(
    df: DataFrame, order: LogOrder, time: str = "ts",
    columns: Sequence[str] = ("rsrp", "rsrq", "rlc_dl"),
) -> DataFrame:
    """Seconds, gap to the previous sample, rolling 5 mean and std; one row alone gives
    mean = value, std = 0 and gap = 0."""

    def build(w: WindowSpec) -> dict[str, Column]:
        out = {
            "time_delta_s": F.coalesce(
                F.col("time_seconds") - F.lag("time_seconds", 1).over(w), F.lit(0)
            ).cast("double")
        }
        for c in columns:
            out[f"{c}_roll_mean_5"] = rolling_mean(c, 5, w, order)
            out[f"{c}_roll_std_5"] = rolling_std(c, 5, w, order)
        return out

    timed = df.withColumn("time_seconds", F.unix_timestamp(F.col(time).cast("timestamp")))
    return windowed(timed, order, 4, build)
