"""Choosing the best model per task from a comparison table (one row per task and model)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from radiolens.operators.asof import best_model_join

# Weights of the selection score and the order criteria per kind of task.
WEIGHTS = {"recall": 0.40, "roc_auc": 0.30, "f1": 0.20, "cv_roc_auc": 0.10}
BALANCED = ("f1", "roc_auc")
RECALL_FIRST = ("recall", "pr_auc", "f1")
# Reasons given for a choice.
BALANCED_REASON = "Selected for best operational balance and strongest metric profile on the holdout test set."
RECALL_REASON = (
    "Selected for highest recall-oriented detection performance with strong PR-AUC / F1 and stable CV behavior."
)
MODEL_REASONS = {
    "LogisticRegression": "Linear, interpretable — features capture the pattern linearly",
    "RandomForest": "Handles non-linearities, robust to outliers",
    "GradientBoosting": "Strongest predictor for complex non-linear patterns",
}


def select_weighted(
    comparison: DataFrame, weights: Mapping[str, float] = WEIGHTS, place: str = "place"
) -> DataFrame:
    """Highest weighted score of the rounded metrics; the first row of equals (by ``place``) wins."""
    score = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    best = Window.partitionBy("task").orderBy(F.desc_nulls_last("score"), place)
    ranked = comparison.withColumn("score", F.round(score, 10)).withColumn("_n", F.row_number().over(best))
    return ranked.where(F.col("_n") == 1).select("task", "model", "score")


def select_lexicographic(
    comparison: DataFrame,
    order_by_task: Mapping[str, Sequence[str]],
    default: Sequence[str] = RECALL_FIRST,
    place: str = "place",
) -> DataFrame:
    """Best row per task by its own list of metrics, missing metrics last."""
    width = max(len(c) for c in [*order_by_task.values(), default])
    ranks = []
    for i in range(width):
        pick = F.col(default[i]) if i < len(default) else F.lit(None).cast("double")
        for task, names in order_by_task.items():
            own = F.col(names[i]) if i < len(names) else F.lit(None).cast("double")
            pick = F.when(F.col("task") == task, own).otherwise(pick)
        ranks.append(F.desc_nulls_last(pick))
    best = Window.partitionBy("task").orderBy(*ranks, place)
    ranked = comparison.withColumn("_n", F.row_number().over(best))
    return ranked.where(F.col("_n") == 1).select("task", "model")


def justify_selection(
    comparison: DataFrame, selection: DataFrame, balanced_tasks: Sequence[str] = ("qos_degradee",)
) -> DataFrame:
    reason = F.when(F.col("task").isin(*balanced_tasks), BALANCED_REASON).otherwise(RECALL_REASON)
    table = F.create_map(*[F.lit(x) for pair in MODEL_REASONS.items() for x in pair])
    chosen = best_model_join(comparison, selection)
    return chosen.withColumns({"reason": reason, "model_reason": F.try_element_at(table, F.col("model"))})


def final_summary(
    n_rows: DataFrame, comparison: DataFrame, selection: DataFrame, rates: DataFrame, importances: DataFrame,
    n_features: int, drivers: int = 3,
) -> DataFrame:
    """Rows, features, imbalance, winner with its metrics and its strongest drivers, per task.

    ``importances`` has one row per (task, model, feature); only the ``drivers`` first are listed.
    """
    winner = best_model_join(comparison, selection)
    own = best_model_join(importances, selection)
    place = F.row_number().over(Window.partitionBy("task").orderBy(F.desc("importance"), "feature"))
    tops = (
        own.withColumn("_n", place).where(F.col("_n") <= drivers)
        .groupBy("task")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "feature"))),
                                      lambda e: e["feature"]), ", ").alias("top_drivers"))
    )
    total = n_rows.agg(F.count(F.lit(1))).scalar()
    imbalance = rates.select(F.col("label").alias("task"), "positives", "negatives", "imbalance")
    return (
        winner.join(imbalance, "task", "left").join(tops, "task", "left")
        .withColumns({"n_rows": total, "n_features": F.lit(n_features)})
    )


def top_features(importances: DataFrame, n: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """Strongest ``n`` features with rank, top-quartile flag and cumulative share.

    The windows run over features of one model (a bounded list), never over rows of a log.
    """
    group = Window.partitionBy(*by)
    ranked = group.orderBy(F.desc("importance"), "feature")
    return (
        importances.withColumns({
            "rank": F.row_number().over(ranked),
            "share": F.sum("importance").over(ranked.rowsBetween(Window.unboundedPreceding, 0))
            / F.sum("importance").over(group),
            "top_quartile": F.col("importance") >= F.expr("percentile(importance, 0.75)").over(group),
        })
        .withColumns({"within_80": F.col("share") <= 0.80, "within_90": F.col("share") <= 0.90})
        .where(F.col("rank") <= n)
    )
