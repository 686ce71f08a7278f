"""Audits and distributions: the numbers behind the exploration charts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolens.operators.clean import ZONE_ORDER
from radiolens.plans.ordered import LogOrder, windowed
from radiolens.plans.quantiles import exact_quantiles, quantile_columns


def _rows_from_one(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """One aggregation pass whose struct results become rows."""
    return df.agg(F.array(*structs).alias("_rows")).select(F.inline("_rows"))


def dataset_info(df: DataFrame) -> DataFrame:
    """Rows, columns, type and missing values, one row per column."""
    width = len(df.columns)
    return _rows_from_one(
        df,
        [
            F.struct(
                F.lit(name).alias("column"),
                F.lit(dtype).alias("dtype"),
                F.count(F.lit(1)).alias("n_rows"),
                F.lit(width).alias("n_columns"),
                F.count_if(F.col(name).isNull()).alias("missing"),
            )
            for name, dtype in df.dtypes
        ],
    )


def audit_missing(df: DataFrame) -> DataFrame:
    return _rows_from_one(
        df,
        [
            F.struct(
                F.lit(name).alias("column"),
                F.lit(dtype).alias("dtype"),
                F.count_if(F.col(name).isNull()).alias("missing_count"),
                F.round(F.avg(F.col(name).isNull().cast("int")) * 100, 2).alias("missing_pct"),
            )
            for name, dtype in df.dtypes
        ],
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first copy; grouping by all columns treats nulls as equal."""
    copies = df.groupBy(*df.columns).agg((F.count(F.lit(1)) - 1).alias("_extra"))
    return copies.agg(F.coalesce(F.sum("_extra"), F.lit(0)).alias("duplicate_rows"))


def describe_all(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, unique, top, freq, mean, std, min, quartiles, max per column.

    Distinct values are counted once for all columns; quartiles come by radix selection.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    numeric = [c for c in columns if types[c] in ("double", "float", "int", "bigint", "smallint")]
    texts = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    counts = (
        df.select(F.inline(texts)).where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    # the smallest text among the most frequent ones: min over (-n, value)
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col("value")))
    common = counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        first["value"].alias("top"), (-first["n"]).alias("freq"),
    )
    if not numeric:
        return common
    moments = _rows_from_one(
        df,
        [
            F.struct(
                F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"),
            )
            for c in numeric
        ],
    )
    quartiles = exact_quantiles(df, numeric, (0.25, 0.5, 0.75)).groupBy("column").agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
            for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))
        ]
    )
    return common.join(moments, "column", "left").join(quartiles, "column", "left")


def value_counts(df: DataFrame, columns: Sequence[str], n: int | None = None) -> DataFrame:
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.orderBy(F.desc("n"), *columns)
    return ranked if n is None else ranked.limit(n)


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("pct", F.round(F.col("n") / total * 100, 1))


def label_rates(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Mean, positives, negatives and imbalance of every binary label."""
    rows = []
    for name in labels:
        pos, n = F.sum(F.col(name).cast("bigint")), F.count(name)
        rows.append(
            F.struct(
                F.lit(name).alias("label"),
                F.avg(name).alias("rate"),
                pos.alias("positives"),
                (n - pos).alias("negatives"),
                ((n - pos) / F.greatest(pos, F.lit(1))).alias("imbalance"),
            )
        )
    return _rows_from_one(df, rows)


def class_profile(
    df: DataFrame, zone: str = "coverage_zone", columns: Sequence[str] = ("rsrp", "rsrq", "rlc_dl")
) -> DataFrame:
    """Mean of each value per zone to one decimal, zones best first."""
    place = F.array_position(F.array(*[F.lit(z) for z in ZONE_ORDER]), F.col(zone)).cast("int")
    means = df.groupBy(zone).agg(*[F.round(F.avg(c), 1).alias(f"{c}_mean") for c in columns])
    return means.withColumn("place", place).orderBy("place")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation, all pairs from one aggregation."""
    upper = _rows_from_one(
        df,
        [
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r"))
            for a, b in combinations(columns, 2)
        ]
        + [
            F.struct(
                F.lit(c).alias("a"), F.lit(c).alias("b"),
                F.when(F.stddev_pop(c) > 0, F.lit(1.0)).alias("r"),
            )
            for c in columns
        ],
    )
    mirror = upper.where(F.col("a") != F.col("b")).select(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    return upper.unionByName(mirror)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts of equal-width bins between min and max; the last bin includes the maximum."""
    known = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"))
    edges = known.agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi")).alias("e")).scalar()
    lo, hi = edges["lo"], edges["hi"]
    at = F.floor((F.col("_v") - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins)
    # a constant column sits in the middle of a range of width one around it
    placed = known.withColumn("bin", F.least(F.coalesce(at, F.lit(bins // 2)), F.lit(bins - 1)).cast("int"))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def box_stats(df: DataFrame, column: str, by: str) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 IQR, and the outlier count, per class."""
    boxes = quantile_columns(df, column, QUARTILES, [by]).withColumnRenamed(by, "_by")
    reach = (F.col("q75") - F.col("q25")) * 1.5
    known = df.select(by, F.col(column).cast("double").alias("value")).where(F.col("value").isNotNull())
    joined = known.join(boxes, F.col(by).eqNullSafe(F.col("_by")), "inner")
    inside = F.col("value").between(F.col("q25") - reach, F.col("q75") + reach)
    return joined.groupBy(by, "q25", "median", "q75").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.count_if(~inside).alias("outliers"),
    )


def violin_stats(preds: DataFrame, probs: str, y_true: str) -> DataFrame:
    """Spread of the probability given to the true class, per true class."""
    own = preds.select(
        F.col(y_true).alias("true_class"), F.col(probs)[F.col(y_true)].alias("p")
    ).where(F.col("p").isNotNull())
    spread = quantile_columns(own, "p", {"lo": 0.0, **QUARTILES, "hi": 1.0}, ["true_class"])
    sizes = own.groupBy(F.col("true_class").alias("_c")).agg(F.count(F.lit(1)).alias("n"))
    return spread.join(sizes, F.col("true_class").eqNullSafe(F.col("_c")), "inner").drop("_c")


KDE_BINS = 1024


def binned(df: DataFrame, column: str, by: str, lo: Column, width: Column, bins: int) -> DataFrame:
    """(by, bin, n): each value shared linearly between the two bin centres around it; at most ``bins`` rows a class."""
    known = df.where(F.col(column).isNotNull())
    at = F.coalesce(F.try_divide(F.col(column).cast("double") - lo, width), F.lit(0.0))
    placed = known.select(by, F.least(F.floor(at), F.lit(bins - 2)).cast("int").alias("_bin"), at.alias("_at"))
    share = F.col("_at") - F.col("_bin")
    both = F.array(F.struct(F.col("_bin").alias("bin"), (1 - share).alias("n")), F.struct((F.col("_bin") + 1).alias("bin"), share.alias("n")))
    return placed.select(by, F.inline(both)).groupBy(by, "bin").agg(F.sum("n").alias("n"))


def kde(df: DataFrame, column: str, by: str, points: int = 100, bins: int = KDE_BINS) -> DataFrame:
    """Gaussian density per class on a common grid, Scott bandwidth ``std * n^(-1/5)``.

    Values are binned linearly at ``bins`` points between minimum and maximum first, so the kernel sum
    takes bins x points steps a class, however many distinct values there are.
    """
    stats = df.where(F.col(column).isNotNull()).groupBy(F.col(by).alias("_by")).agg(
        F.count(F.lit(1)).alias("size"),
        (F.stddev_samp(column) * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("width"),
    )
    span = df.agg(
        F.struct(F.min(F.col(column).cast("double")).alias("lo"),
                 F.max(F.col(column).cast("double")).alias("hi")).alias("s")
    ).scalar()
    lo, step = span["lo"], (span["hi"] - span["lo"]) / (points - 1)
    width = (span["hi"] - span["lo"]) / (bins - 1)
    counted = binned(df, column, by, lo, width, bins).withColumn("value", lo + F.col("bin") * width)
    grid = counted.join(stats, F.col(by).eqNullSafe(F.col("_by")), "inner").where(
        F.col("width") > 0
    ).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = lo + F.col("point") * step
    z = (at - F.col("value")) / F.col("width")
    kernel = F.col("n") * F.exp(z * z * -0.5) / (
        F.col("size") * F.col("width") * F.sqrt(F.lit(2.0) * F.pi())
    )
    return grid.select(by, "point", at.alias("x"), kernel.alias("k")).groupBy(by, "point").agg(
        F.max("x").alias("x"), F.sum("k").alias("density")
    )


def violin_density(preds: DataFrame, probs: str, y_true: str, points: int = 50, bins: int = KDE_BINS) -> DataFrame:
    """The density half of a violin: of the probability given to the true class, per true class."""
    own = preds.select(F.col(y_true).alias("true_class"), F.col(probs)[F.col(y_true)].alias("p"))
    return kde(own, "p", "true_class", points, bins)


def stability_pairs(df: DataFrame, column: str, by: str, order: LogOrder) -> DataFrame:
    """How a value relates to the one before it, per class: pairs, correlation, mean step."""
    paired = windowed(df, order, 1, lambda w: {"_before": F.lag(column, 1).over(w)})
    return paired.where(F.col("_before").isNotNull()).groupBy(by).agg(
        F.count(column).alias("pairs"),
        F.corr("_before", column).alias("r"),
        F.avg(F.abs(F.col(column) - F.col("_before"))).alias("mean_step"),
    )


def top_risky_cells(preds: DataFrame, n: int = 10, key: str = "psc") -> DataFrame:
    return (
        preds.where((F.col("y_pred") == 1) & F.col(key).isNotNull())
        .groupBy(key).agg(F.count(F.lit(1)).alias("alarms"))
        .orderBy(F.desc("alarms"), key).limit(n)
    )


def error_type(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    return (
        F.when((F.col(y_true) == 1) & (F.col(y_pred) == 0), "FN")
        .when((F.col(y_true) == 0) & (F.col(y_pred) == 1), "FP")
        .otherwise("OK")
    )


def error_counts(preds: DataFrame, task: str = "task") -> DataFrame:
    return preds.groupBy(task, error_type().alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def error_summary(preds: DataFrame, n: int = 10, key: str = "psc") -> DataFrame:
    """One row per task: false alarms, misses and the map of its ``n`` most alarming cells.

    The map is built from at most ``n`` rows per task, picked after counting per cell.
    """
    from pyspark.sql import Window

    errors = preds.groupBy("task").agg(
        F.count_if(error_type() == "FP").alias("false_positives"),
        F.count_if(error_type() == "FN").alias("false_negatives"),
    )
    cells = preds.where((F.col("y_pred") == 1) & F.col(key).isNotNull()).groupBy("task", key).agg(
        F.count(F.lit(1)).alias("alarms")
    )
    place = F.row_number().over(Window.partitionBy("task").orderBy(F.desc("alarms"), key))
    risky = (
        cells.withColumn("_place", place).where(F.col("_place") <= n)
        .groupBy("task")
        .agg(F.array_sort(F.collect_list(F.struct("_place", key, "alarms"))).alias("_top"))
        .select("task", F.map_from_entries(
            F.transform("_top", lambda e: F.struct(e[key], e["alarms"]))).alias("top_risky_cells"))
    )
    return errors.join(risky, "task", "left")
