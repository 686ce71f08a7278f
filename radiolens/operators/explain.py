"""Feature importance of fitted models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolens.operators.resample import feature_array
from radiolens.plans.ordered import LogOrder, position
from radiolens.plans.shuffle import permuted
from radiolens.plans.stage import materialize


def feature_importance(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """(feature, importance): tree importances, or absolute coefficients of a linear model."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(name, abs(float(v))) for name, v in zip(features, values.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double")


def _f1(hit: Column, wrong: Column) -> Column:
    return F.coalesce(F.try_divide(hit * 2, hit * 2 + wrong), F.lit(0.0)).alias("f1")


def _scored(frame: DataFrame, by: Sequence[str]) -> DataFrame:
    """F1 of the rows (y, prediction) by the columns ``by``."""
    hit, said = F.col("y") == 1, F.col("prediction") == 1
    return frame.groupBy(*by).agg(_f1(F.count_if(hit & said), F.count_if(hit != said)))


def _linear(classifier: Model) -> bool:
    return isinstance(classifier, LogisticRegressionModel) and classifier.numClasses == 2 and not classifier.isDefined("thresholds")


def _counted(paired: DataFrame, classifier: LogisticRegressionModel, features: Sequence[str]) -> DataFrame:
    """(feature, repeat, hit, wrong) of a regression on pairs (y, repeat, margin, x0.., o0..).

    A shuffled column moves the margin by its own term alone, so no vector is made for a pair and feature.
    """
    weights, start, cut, names = classifier.coefficients.toArray(), classifier.intercept, _cut(classifier), list(features)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), 0, 2), np.int64)  # feature, repeat, hits and mistakes
        for b in batches:
            column = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
            repeat, margin, y = column["repeat"], column["margin"], column["y"] == 1
            if b.num_rows and repeat.max() >= total.shape[1]:
                total = np.pad(total, ((0, 0), (0, repeat.max() + 1 - total.shape[1]), (0, 0)))
            odd = np.flatnonzero(~np.isfinite(margin))
            for i, w in enumerate(weights):
                moved = margin + w * (column[f"o{i}"] - column[f"x{i}"])
                if len(odd):  # a term that is no number cannot be taken off again
                    rows = np.stack([column[f"{'o' if j == i else 'x'}{j}"][odd] for j in range(len(weights))], axis=1)
                    moved[odd] = rows @ weights + start
                said = moved > cut
                total[i, :, 0] += np.bincount(repeat[y & said], minlength=total.shape[1])
                total[i, :, 1] += np.bincount(repeat[y != said], minlength=total.shape[1])
        at, turn = (v.ravel() for v in np.indices(total.shape[:2]))
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array([names[i] for i in at], pa.string()), "repeat": pa.array(turn, pa.int32()),
            "hit": total[:, :, 0].ravel(), "wrong": total[:, :, 1].ravel()})

    sums = paired.mapInArrow(counted, "feature string, repeat int, hit long, wrong long").groupBy("feature", "repeat")
    return sums.agg(F.sum("hit").alias("hit"), F.sum("wrong").alias("wrong")).where(F.col("repeat") > 0)


def _cut(classifier: LogisticRegressionModel) -> float:
    share = classifier.getThreshold()
    return -np.inf if share == 0 else np.inf if share == 1 else float(np.log(share / (1 - share)))


def permutation_importance(
    model: PipelineModel, df: DataFrame, features: Sequence[str], label: str = "y_true", id: str = "event_id",
    repeats: int = 10, seed: int = 42,
) -> DataFrame:
    """(feature, importance, spread): mean fall of F1 when one column is shuffled.

    The rows are numbered once. In every repeat a seeded permutation of the numbers says from which row
    a row takes the shuffled value; all columns share it. One join gives the donors of all repeats and one
    aggregation the F1 of every (feature, repeat). A logistic regression of two classes is scored by margins that move by
    one term, other models by a vector for each pair and feature.
    """
    classifier, n = model.stages[-1], len(features)
    base = df.select(F.col(id).alias("id"), F.col(label).cast("int").alias("y"), feature_array(features).alias("x"))
    placed = position(base, LogOrder(by=("id",)), "place")
    linear = _linear(classifier)
    if linear:
        missing = F.raise_error(F.lit("a feature is missing")).cast("double")
        values = {f"x{i}": F.coalesce(F.get("x", F.lit(i)), missing) for i in range(n)}
        terms = [F.col(f"x{i}") * F.lit(float(w)) for i, w in enumerate(classifier.coefficients.toArray())]
        margin = reduce(lambda a, b: a + b, terms) + F.lit(float(classifier.intercept))
        placed = placed.withColumns(values).drop("x").withColumn("margin", margin)
    placed = materialize(placed)
    total = placed.agg(F.count(F.lit(1)).alias("n")).scalar()
    given = {f"x{i}": f"o{i}" for i in range(n)} if linear else {"x": "other"}
    numbered = placed.select(total.alias("_total"), F.col("place").alias("_from"), *[F.col(c).alias(o) for c, o in given.items()])
    donors = numbered.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn(
        "place", permuted(F.col("_from"), F.col("_total"), F.xxhash64("repeat", F.lit(seed)))).drop("_from", "_total")
    paired = placed.join(donors, "place", "inner")
    if linear:
        whole = placed.select("y", (F.col("margin") > _cut(classifier)).cast("double").alias("prediction"))
        before = _scored(whole, []).scalar()
        pairs = paired.select("y", "repeat", "margin", *given, *given.values())
        after = _counted(pairs, classifier, features).select("feature", "repeat", _f1(F.col("hit"), F.col("wrong")))
    else:
        columns = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("feature")) for i, c in enumerate(features)])
        swapped = paired.select("y", "x", "other", "repeat", F.inline(columns)).select(
            "y", "repeat", "feature",
            array_to_vector(F.transform("x", lambda v, i: F.when(i == F.col("at"), F.get("other", i)).otherwise(v))).alias("features"),
        )
        before = _scored(classifier.transform(placed.select("y", array_to_vector("x").alias("features"))), []).scalar()
        after = _scored(classifier.transform(swapped), ["feature", "repeat"])
    falls = after.withColumn("fall", before - F.col("f1"))
    return falls.groupBy("feature").agg(F.avg("fall").alias("importance"), F.stddev_pop("fall").alias("spread"))
