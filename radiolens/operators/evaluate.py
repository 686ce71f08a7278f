"""Metrics on prediction tables (y_true, y_pred, y_proba), grouped by any columns.

Curve metrics count rows per distinct score before any ordering, so the ordered part works on
scores, not rows, and uses the chunked running sum when there are many of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolens.operators.explore import error_type
from radiolens.plans.ordered import LogOrder, running_total

# Threshold grids (0.15 up to below 0.80 by 0.05; 19 steps from 0.05 to 0.95).
SCAN_THRESHOLDS = tuple(0.15 + i * 0.05 for i in range(13))
SEARCH_THRESHOLDS = tuple(0.05 + i * ((0.95 - 0.05) / 18) for i in range(18)) + (0.95,)
# Verdicts on the errors of a model, in order of precedence.
MORE_MISSES = "WARNING: More FNs than TPs"
MORE_ALARMS = "WARNING: More FPs than TPs"
NO_MISSES = "Excellent: zero missed detections"
ACCEPTABLE = "Acceptable"


def safe(num: Column, den: Column) -> Column:
    """Ratio that is 0 where it is undefined."""
    return F.coalesce(F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0))), F.lit(0.0))


def _counts() -> list[Column]:
    hit, said = F.col("y_true") == 1, F.col("y_pred") == 1
    return [
        F.count_if(hit & said).alias("tp"), F.count_if(~hit & said).alias("fp"),
        F.count_if(~hit & ~said).alias("tn"), F.count_if(hit & ~said).alias("fn"),
    ]


def _rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    return {
        "accuracy": safe(tp + tn, tp + fp + tn + fn),
        "precision": safe(tp, tp + fp),
        "recall": safe(tp, tp + fn),
        "f1": safe(tp * 2, tp * 2 + fp + fn),
    }


def confusion_matrix(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per (true, predicted) over all classes that occur, zero cells included."""
    counted = preds.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    both = counted.select(*by, F.explode(F.array("y_true", "y_pred")).alias("c"))
    classes = both.groupBy(*by).agg(F.collect_set("c").alias("_classes"))  # one entry per class
    grid = classes.select(*by, "_classes", F.explode("_classes").alias("y_true")).select(
        *by, "y_true", F.explode("_classes").alias("y_pred")
    )
    return grid.join(counted, [*by, "y_true", "y_pred"], "left").fillna(0, ["n"])


def binary_metrics(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counted = preds.groupBy(*by).agg(*_counts())
    return counted.withColumns(_rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def classification_report(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    cells = preds.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(
        *by, "n",
        F.inline(F.array(
            F.struct(F.col("y_true").cast("string").alias("class"), F.lit("true").alias("side"),
                     (F.col("y_true") == F.col("y_pred")).alias("hit")),
            F.struct(F.col("y_pred").cast("string").alias("class"), F.lit("pred").alias("side"),
                     F.lit(False).alias("hit")),
        )),
    )
    n = F.col("n")
    per_class = sides.groupBy(*by, "class").agg(
        F.sum(F.when(F.col("hit"), n).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("side") == "true", n).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("side") == "pred", n).otherwise(0)).alias("said"),
    )
    scored = per_class.select(
        *by, "class", "tp",
        safe(F.col("tp"), F.col("said")).alias("precision"),
        safe(F.col("tp"), F.col("support")).alias("recall"),
        safe(F.col("tp") * 2, F.col("support") + F.col("said")).alias("f1"),
        "support",
    )

    def weighted(c: str) -> Column:
        return safe(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)

    accuracy = safe(F.sum("tp"), F.sum("support"))
    total = F.sum("support").alias("support")
    names = ("precision", "recall", "f1")
    parts = [
        scored.drop("tp"),
        scored.groupBy(*by).agg(F.lit("accuracy").alias("class"), *[accuracy.alias(c) for c in names], total),
        scored.groupBy(*by).agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names], total),
        scored.groupBy(*by).agg(F.lit("weighted avg").alias("class"), *[weighted(c) for c in names], total),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _score_counts(preds: DataFrame, by: Sequence[str], plan: str) -> tuple[DataFrame, list[str]]:
    """Rows per score with running positives and negatives from the highest score down."""
    keys = [*by, "_all"]  # a constant key, for the plain plan without ``by``
    counted = (
        preds.where(F.col("y_proba").isNotNull())
        .groupBy(*by, F.lit(0).alias("_all"), (-F.col("y_proba")).alias("_down"))
        .agg(
            F.sum(F.col("y_true").cast("bigint")).alias("pos"),
            F.sum(1 - F.col("y_true").cast("bigint")).alias("neg"),
        )
    )
    order = LogOrder(by=("_down",), keys=tuple(keys), plan=plan)
    return running_total(counted, order, {"tp": "pos", "fp": "neg"}), keys


def _roc_area() -> Column:
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return F.try_divide(area.cast("double"), F.nullif(pairs, F.lit(0.0)))


def _pr_area() -> Column:
    before_tp = F.col("tp") - F.col("pos")
    before = before_tp + F.col("fp") - F.col("neg")
    last = F.when(before == 0, F.lit(1.0)).otherwise(F.try_divide(before_tp, before))
    here = F.col("tp") / (F.col("tp") + F.col("fp"))
    area, total = F.sum(F.col("pos") * (here + last) / 2), F.sum("pos")
    return F.when((total > 0) & (F.sum("neg") > 0), F.try_divide(area, total))


def curve_areas(preds: DataFrame, by: Sequence[str] = (), plan: str = "chunked") -> DataFrame:
    """Both areas from one pass over the score counts."""
    ranked, keys = _score_counts(preds, by, plan)
    areas = [_roc_area().alias("roc_auc"), _pr_area().alias("pr_auc")]
    return ranked.groupBy(*keys).agg(*areas).drop("_all")


def roc_auc(preds: DataFrame, by: Sequence[str] = (), plan: str = "chunked") -> DataFrame:
    """Area under the ROC curve, ties counted half; NULL where only one class occurs."""
    return curve_areas(preds, by, plan).drop("pr_auc")


def pr_auc(preds: DataFrame, by: Sequence[str] = (), plan: str = "chunked") -> DataFrame:
    """Trapezoid area under the precision-recall curve that starts at recall 0, precision 1."""
    return curve_areas(preds, by, plan).drop("roc_auc")


def roc_curve(preds: DataFrame, by: Sequence[str] = (), plan: str = "chunked") -> DataFrame:
    """Every point of the curve, the origin (no threshold) included."""
    ranked, keys = _score_counts(preds, by, plan)
    totals = ranked.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    points = ranked.join(totals, keys, "inner").select(
        *by, (-F.col("_down")).alias("threshold"),
        safe(F.col("fp"), F.col("N")).alias("fpr"), safe(F.col("tp"), F.col("P")).alias("tpr"),
    )
    origin = totals.select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def roc_auc_ovr_weighted(preds: DataFrame, probs: str, by: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest area per class of a probability map, averaged by class support."""
    long = preds.select(
        *by, F.col("y_true").alias("_true"), F.explode(probs).alias("class", "y_proba")
    ).select(*by, "class", "y_proba", (F.col("_true") == F.col("class")).cast("int").alias("y_true"))
    areas = roc_auc(long, [*by, "class"])
    support = long.groupBy(*by, "class").agg(F.sum("y_true").alias("support"))
    return areas.join(support, [*by, "class"], "inner").groupBy(*by).agg(
        safe(F.sum(F.col("roc_auc") * F.col("support")), F.sum("support")).alias("roc_auc")
    )


def _scan(preds: DataFrame, thresholds: Sequence[float], by: Sequence[str]) -> DataFrame:
    """tp, fp, fn, tn per threshold from one aggregation; rows are not repeated per threshold."""
    hit = F.col("y_true") == 1
    cells = []
    for t in thresholds:
        said = F.col("y_proba") >= F.lit(float(t))
        cells.append(F.struct(
            F.lit(float(t)).alias("threshold"),
            F.count_if(hit & said).alias("tp"), F.count_if(~hit & said).alias("fp"),
            F.count_if(~hit & ~said).alias("tn"), F.count_if(hit & ~said).alias("fn"),
        ))
    return preds.groupBy(*by).agg(F.array(*cells).alias("_rows")).select(*by, F.inline("_rows"))


def threshold_scan(
    preds: DataFrame, thresholds: Sequence[float] = SCAN_THRESHOLDS, by: Sequence[str] = ()
) -> DataFrame:
    rates = _rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    return _scan(preds, thresholds, by).select(
        *by, F.round("threshold", 2).alias("threshold"),
        *[F.round(rates[c], 4).alias(c) for c in ("recall", "precision", "f1")],
    )


def optimize_threshold(
    preds: DataFrame, metric: str = "recall", thresholds: Sequence[float] = SEARCH_THRESHOLDS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Best threshold by ``recall``, ``f1`` or recall plus precision; the lowest of equals wins."""
    rates = _rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    value = rates[metric] if metric in ("recall", "f1") else rates["recall"] + rates["precision"]
    scanned = _scan(preds, thresholds, by).withColumn("best_score", F.round(value, 12))
    rank = F.struct(F.col("best_score"), -F.col("threshold"))
    return scanned.groupBy(*by).agg(
        F.max_by("threshold", rank).alias("threshold"), F.max("best_score").alias("best_score")
    )


def error_rates(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counted = preds.groupBy(*by).agg(*_counts())
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    verdict = (
        F.when(fn > tp, MORE_MISSES).when(fp > tp, MORE_ALARMS).when(fn == 0, NO_MISSES).otherwise(ACCEPTABLE)
    )
    return counted.withColumns({
        "miss_rate": F.round(F.try_divide(fn, F.nullif(tp + fn, F.lit(0))), 4),
        "false_alarm_rate": F.round(F.try_divide(fp, F.nullif(fp + tn, F.lit(0))), 4),
        "verdict": verdict,
    })


def error_rows(preds: DataFrame, order: Sequence[str], n: int = 20) -> DataFrame:
    return preds.withColumn("error_type", error_type()).where(F.col("error_type") != "OK").orderBy(*order).limit(n)


METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")


def evaluate(preds: DataFrame, by: Sequence[str] = ("task", "model")) -> DataFrame:
    """All metrics of every group in one table."""
    by = list(by)
    return binary_metrics(preds, by).join(curve_areas(preds, by), by, "inner")


def fold_means(preds: DataFrame, by: Sequence[str] = ("task", "model"), fold: str = "fold") -> DataFrame:
    """Mean over folds of the out-of-fold metrics; population std for recall and AUC."""
    by = list(by)
    folds = binary_metrics(preds, [*by, fold]).join(roc_auc(preds, [*by, fold]), [*by, fold], "inner")
    means = [F.avg(c).alias(f"cv_{c}") for c in ("accuracy", "precision", "recall", "f1", "roc_auc")]
    spreads = [F.stddev_pop(c).alias(f"cv_{c}_std") for c in ("recall", "roc_auc")]
    return folds.groupBy(*by).agg(*means, *spreads)


def compare_models(metrics: DataFrame, decimals: int = 4) -> DataFrame:
    """Comparison table: every metric rounded, best F1 first inside a task."""
    doubles = [c for c, t in metrics.dtypes if t == "double"]
    table = metrics.withColumns({c: F.round(F.col(c), decimals) for c in doubles})
    return table.orderBy("task", F.desc_nulls_last("f1"), "model")
