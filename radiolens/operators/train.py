"""Training of the coverage, UMTS and handover classifiers with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolens.functions.scalar import encode_alphabetical
from radiolens.operators.ensemble import ClassForest, OneVsRestEnsemble, TreeEnsemble
from radiolens.operators.evaluate import fold_means, optimize_threshold
from radiolens.operators.resample import smote, smote_folds, smote_tomek
from radiolens.operators.split import class_weights, feature_stats, impute_median, standard_scale
from radiolens.plans import lockstep
from radiolens.plans.quantiles import exact_quantiles
from radiolens.plans.stage import materialize, settle

UMTS_TASKS = {"qos_degradee": "f1", "congestion_probable": "recall", "panne_probable": "recall"}
HANDOVER_TASKS = ("interference", "handover_needed")
THREADS = 4
BINS = 32  # of a feature, in trees of all folds
ZONE_BINS = 256  # of a feature, in the forest of the zones, whose borders lie between two values of one feature
SHALLOW = 8  # depth up to which the forest of the zones is grown by passes that count whole levels
#: Rows of a partition in the fit of a large forest, which keeps a draw count for every tree beside each row.
FIT_ROWS = 50_000


@dataclass(frozen=True)
class TreeSizes:
    """Sizes of the tree models; the defaults are the ones the results are meant for."""

    coverage_rounds: int = 400
    coverage_depth: int = 5
    umts_trees: int = 300
    umts_depth: int = 30  # trees are not limited by the rule set; this is the most that Spark allows
    umts_rounds: int = 100
    handover_trees: int = 200
    handover_rounds: int = 200


@dataclass
class Fitted:
    """Predictions of every (task, model) and the models themselves."""

    predictions: DataFrame
    models: dict[tuple[str, str], PipelineModel] = field(default_factory=dict)
    thresholds: DataFrame | None = None


def assembled(features: Sequence[str], classifier: Estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), classifier])


def medians_of(train: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """A median per feature, as ``impute_median`` fills it in."""
    return {r["column"]: r["value"] for r in exact_quantiles(train, features, [0.5]).collect()}


def whole_pipeline(
    train: DataFrame, features: Sequence[str], model: PipelineModel, medians: Mapping[str, float] | None = None
) -> PipelineModel:
    """Filling, scaling and ``model`` as one pipeline to store: it scores cleaned rows as they are.

    Mean and spread come from ``train`` after filling. The rows keep their columns; scaled copies of the
    features are added.
    """
    medians = medians or {}

    def number(x: float) -> str:
        return f"cast('{float(x)!r}' as double)"

    filled = {c: f"coalesce(cast(`{c}` as double), {number(medians[c])})" if c in medians else f"cast(`{c}` as double)" for c in features}
    rows = train.select(*[F.expr(x).alias(c) for c, x in filled.items()])
    stats = {r["feature"]: (r["mean"], r["std"]) for r in feature_stats(rows, features).collect()}  # a row per feature
    scaled = ", ".join(f"({filled[c]} - {number(m)}) / {number(s if s > 0 else 1.0)} as `scaled_{c}`" for c, (m, s) in stats.items())
    return PipelineModel(stages=[
        SQLTransformer(statement=f"select *, {scaled} from __THIS__"),
        VectorAssembler(inputCols=[f"scaled_{c}" for c in features], outputCol="features"),
        model.stages[-1],
    ])


def umts_models(n_rows: int, sizes: TreeSizes = TreeSizes(), seed: int = 42) -> dict[str, Estimator]:
    """Balanced logistic regression, forest and boosting with their default step."""
    common = {"labelCol": "y_true", "featuresCol": "features"}
    return {
        "LogisticRegression": LogisticRegression(
            maxIter=2000, regParam=1.0 / max(n_rows, 1), standardization=False, weightCol="weight", **common),
        "RandomForest": RandomForestClassifier(
            numTrees=sizes.umts_trees, maxDepth=sizes.umts_depth, weightCol="weight", seed=seed, **common),
        "GradientBoosting": GBTClassifier(
            maxIter=sizes.umts_rounds, maxDepth=3, stepSize=0.1, seed=seed, **common),
    }


def handover_models(n_rows: int, sizes: TreeSizes = TreeSizes(), seed: int = 42) -> dict[str, Estimator]:
    common = {"labelCol": "y_true", "featuresCol": "features"}
    return {
        "LogisticRegression": LogisticRegression(
            maxIter=1000, regParam=1.0 / max(n_rows, 1), standardization=False, **common),
        "RandomForest": RandomForestClassifier(
            numTrees=sizes.handover_trees, maxDepth=12, minInstancesPerNode=2, seed=seed, **common),
        "GradientBoosting": GBTClassifier(
            maxIter=sizes.handover_rounds, maxDepth=5, stepSize=0.1, minInstancesPerNode=2, subsamplingRate=0.8,
            seed=seed, **common),
    }


def fit_tasks(matrix: DataFrame, features: Sequence[str], model: Estimator) -> PipelineModel:
    """``model`` fitted to ``matrix`` (y_true 0/1, features, key and, where it asks for one, a weight for each class).

    Boosted trees are grown by passes over packed bins, trees of a forest by tasks that share them; regressions, and forests
    over ``lockstep.HELD`` rows, are fitted by Spark ML.
    """
    tree = isinstance(model, RandomForestClassifier) and matrix.count() <= lockstep.HELD
    boosted = isinstance(model, GBTClassifier) and not model.isDefined("weightCol")
    if not (tree or boosted):
        return assembled(features, model).fit(matrix)
    table = matrix.withColumn("mask", F.lit(1).cast("bigint"))
    # a little above a value, so that a row scaled anew falls into the bin it had
    borders = [b + 1e-9 * np.maximum(1, np.abs(b)) for b in lockstep.bin_borders(table, features, BINS)]
    if boosted:
        how = lockstep.Boosting(
            model.getMaxIter(), model.getMaxDepth(), model.getStepSize(), model.getSubsamplingRate(),
            model.getMinInstancesPerNode(), BINS, model.getSeed())
        fitted = TreeEnsemble.boosted(borders, lockstep.boost(table, features, 1, borders, how)[0])
    else:
        weights = {}
        if model.isDefined("weightCol"):
            weights = {int(r[0]): r[1] for r in matrix.groupBy("y_true").agg(F.max(model.getWeightCol())).collect()}  # a row per class
        how = lockstep.Forest(
            model.getNumTrees(), model.getMaxDepth(), model.getMinInstancesPerNode(), BINS, model.getSeed(),
            (weights.get(0, 1.0), weights.get(1, 1.0)))
        fitted = TreeEnsemble(borders, lockstep.forest(table, features, borders, how))
    return PipelineModel(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), fitted])


def side_by_side(spark: SparkSession, jobs: Sequence[Callable]) -> list:
    """Independent fits side by side: each one alone leaves executors idle between its stages."""
    with ThreadPoolExecutor(THREADS) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]]


def positive_probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("y_proba", vector_to_array("probability")[1])


def train_coverage(
    train: DataFrame, features: Sequence[str], label: str = "coverage_zone", id: str = "event_id",
    sizes: TreeSizes = TreeSizes(), seed: int = 42, k: int = 4, rebalance: bool = True,
) -> tuple[PipelineModel, list[str]]:
    """Boosted trees for the zones, one against the rest; returns the model and its class names.

    Rows are scaled, oversampled and cleaned at the boundary, then weighted by class; the model scales the
    rows it is given.
    """
    labels = sorted(r[0] for r in train.select(label).distinct().collect())  # the zones
    plain = train.select(id, label, *features)
    rows = scaled = standard_scale(plain, plain, features)
    if rebalance:
        rows = settle(lambda: smote_tomek(scaled, features, label, id, k, seed))
    key = F.xxhash64("parent", "turn") if rebalance else F.xxhash64(id)
    if rebalance:
        rows = rows.drop("neighbor")
    coded = encode_alphabetical(rows.withColumns({"key": key, "mask": F.lit(1).cast("bigint")}), label, "y_true")
    matrix = materialize(class_weights(coded, "y_true").select(F.col("y_true").cast("double"), "weight", "key", "mask", *features))
    return whole_pipeline(plain, features, one_vs_rest(matrix, features, sizes, seed)), labels


def one_vs_rest(matrix: DataFrame, features: Sequence[str], sizes: TreeSizes = TreeSizes(), seed: int = 42) -> PipelineModel:
    """Boosted trees of every class (y_true 0.., weight of its class, key, mask, features) against the rest, grown side by side."""
    weights = {int(r[0]): r[1] for r in matrix.groupBy("y_true").agg(F.max("weight")).collect()}  # a row per class
    borders = [b + 1e-9 * np.maximum(1, np.abs(b)) for b in lockstep.bin_borders(matrix, features, BINS)]
    how = lockstep.Boosting(
        sizes.coverage_rounds, sizes.coverage_depth, step=0.08, share=0.75, least=3, bins=BINS, seed=seed, asked=0.75, worth=0.15,
        weights=tuple(weights.get(i, 0.0) for i in range(max(weights, default=-1) + 1)))
    trees = lockstep.boost(matrix, features, len(how.weights), borders, how)
    model = OneVsRestEnsemble([TreeEnsemble.boosted(borders, t) for t in trees])
    return PipelineModel(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), model])


def spread_evenly(matrix: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """Rows in partitions of about ``most``; up to so many rows stay as they are.

    A join with classes parts the rows by class, so a common class would be one task's work in every pass of a fit.
    """
    rows = matrix.count()
    if rows <= most:
        return matrix
    return matrix.repartition(max(matrix.rdd.getNumPartitions(), rows // most + 1))


def train_coverage_forest(
    train: DataFrame, features: Sequence[str], label: str = "coverage_zone", sizes: TreeSizes = TreeSizes(), seed: int = 42,
    id: str = "event_id",
) -> tuple[PipelineModel, list[str]]:
    """The same task with a forest, whose class probabilities need no normalising; deep trees are fitted by Spark ML."""
    labels = sorted(r[0] for r in train.select(label).distinct().collect())
    if sizes.coverage_depth > SHALLOW:
        coded = encode_alphabetical(train.select(label, *features), label, "y_true")
        forest = RandomForestClassifier(
            numTrees=sizes.umts_trees, maxDepth=sizes.coverage_depth, labelCol="y_true", weightCol="weight", seed=seed)
        return assembled(features, forest).fit(spread_evenly(materialize(class_weights(coded, "y_true")))), labels
    key = F.xxhash64(*([id] if id in train.columns else []), *features)
    coded = encode_alphabetical(train.select(label, key.alias("key"), *features), label, "y_true")
    matrix = materialize(class_weights(coded, "y_true").select(F.col("y_true").cast("double"), "weight", "key", F.lit(1).cast("bigint").alias("mask"), *features))
    weights = {int(r[0]): r[1] for r in matrix.groupBy("y_true").agg(F.max("weight")).collect()}  # a row per class
    borders = lockstep.middles(matrix, features, lockstep.bin_borders(matrix, features, ZONE_BINS))
    how = lockstep.Forest(
        sizes.umts_trees, sizes.coverage_depth, least=1, bins=ZONE_BINS, seed=seed, weights=tuple(weights.get(i, 0.0) for i in range(len(labels))))
    forest = ClassForest(borders, lockstep.class_forest(matrix, features, borders, how), len(labels))
    return PipelineModel(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), forest]), labels


def train_umts_tasks(
    rows: DataFrame, features: Sequence[str], tasks: Mapping[str, str] = UMTS_TASKS, id: str = "event_id",
    keep: Sequence[str] = ("ts", "psc"), sizes: TreeSizes = TreeSizes(), seed: int = 42,
) -> Fitted:
    """Three models per task on time-split rows (column ``split``).

    Medians and scale come from the training rows; the decision threshold of each model is searched
    on the validation rows by the metric of its task and applied to the test rows.
    """
    keep = [c for c in keep if c not in features]
    train = rows.where(F.col("split") == "train")
    medians = medians_of(train, features)
    filled = materialize(impute_median(train, rows, features).select(id, *keep, "split", *tasks, *features))
    ready = materialize(standard_scale(filled.where(F.col("split") == "train"), filled, features))
    fit_rows = ready.where(F.col("split") == "train")
    n_rows = fit_rows.count()
    jobs, names = [], []
    for task in tasks:
        matrix = class_weights(fit_rows.withColumns({"y_true": F.col(task).cast("double"), "key": F.xxhash64(id)}), "y_true")
        for name, model in umts_models(n_rows, sizes, seed).items():
            names.append((task, name))
            jobs.append(lambda m=model, x=matrix: fit_tasks(x, features, m))
    models = dict(zip(names, side_by_side(rows.sparkSession, jobs)))
    unseen = ready.where(F.col("split") != "train")
    parts = [
        positive_probability(model.transform(unseen)).select(
            F.lit(task).alias("task"), F.lit(name).alias("model"), id, *keep, "split",
            F.col(task).alias("y_true"), "y_proba")
        for (task, name), model in models.items()
    ]
    scored = materialize(reduce(lambda a, b: a.unionByName(b), parts))
    held = scored.where(F.col("split") == "validation")
    searched = [
        optimize_threshold(held.where(F.col("task").isin([t for t, m in tasks.items() if m == metric])), metric,
                           by=["task", "model"])
        for metric in sorted(set(tasks.values()))
    ]
    thresholds = materialize(reduce(lambda a, b: a.unionByName(b), searched))
    test = scored.where(F.col("split") == "test").drop("split").join(thresholds, ["task", "model"], "inner")
    predictions = test.withColumn("y_pred", (F.col("y_proba") >= F.col("threshold")).cast("int")).drop("best_score")
    stored = {name: whole_pipeline(train, features, model, medians) for name, model in models.items()}
    return Fitted(predictions, stored, thresholds)


def oversampled(rows: DataFrame, features: Sequence[str], id: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Training rows (y_true, key, features) with the minority class filled up."""
    made = smote(rows, features, "y_true", id, k, seed)
    return materialize(made.select("y_true", F.xxhash64("parent", "turn").alias("key"), *features))


def train_handover_tasks(
    rows: DataFrame, features: Sequence[str], tasks: Sequence[str] = HANDOVER_TASKS, id: str = "event_id",
    keep: Sequence[str] = ("psc",), sizes: TreeSizes = TreeSizes(), seed: int = 42, rebalance: bool = True,
) -> Fitted:
    """Three models per task on a stratified split per task (columns ``split_<task>``).

    Feature values and label of a row stay together in every split.
    """
    jobs, names, tests, trains = [], [], {}, {}
    for task in tasks:
        own = rows.withColumn("y_true", F.col(task).cast("double"))
        trains[task] = train = own.where(F.col(f"split_{task}") == "train")
        scaled = materialize(standard_scale(train, own, features).select(
            id, *keep, F.col(f"split_{task}").alias("split"), "y_true", *features))
        part = scaled.where(F.col("split") == "train")
        matrix = oversampled(part, features, id, seed=seed) if rebalance else part.withColumn("key", F.xxhash64(id))
        tests[task] = scaled.where(F.col("split") == "test")
        for name, model in handover_models(matrix.count(), sizes, seed).items():
            names.append((task, name))
            jobs.append(lambda m=model, x=matrix: fit_tasks(x, features, m))
    models = dict(zip(names, side_by_side(rows.sparkSession, jobs)))
    parts = [
        positive_probability(model.transform(tests[task])).select(
            F.lit(task).alias("task"), F.lit(name).alias("model"), id, *keep, F.col("y_true").cast("int").alias("y_true"),
            "y_proba", F.col("prediction").cast("int").alias("y_pred"))
        for (task, name), model in models.items()
    ]
    stored = {(task, name): whole_pipeline(trains[task], features, model) for (task, name), model in models.items()}
    return Fitted(materialize(reduce(lambda a, b: a.unionByName(b), parts)), stored)


def fold_table(
    rows: DataFrame, features: Sequence[str], k: int, id: str, rebalance: bool = True, seed: int = 42, near: int = 5,
) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows (y_true, fold, made_for, mask, key, features..) that all folds train on, and each fold's mean and spread.

    Features are in units of the whole table's spread, in which oversampling measures distances; labels take no part in
    that. The means and spreads are those of a fold's training rows: sums per fold, the left-out fold subtracted.
    """
    scaled = materialize(standard_scale(rows, rows, features).select(id, "y_true", "fold", *features))
    table = scaled.select("y_true", "fold", F.lit(None).cast("int").alias("made_for"), F.xxhash64(id).alias("key"), *features)
    if rebalance:
        made = smote_folds(scaled, features, "y_true", id, "fold", k, near, seed)
        key = F.xxhash64("parent", "turn", "made_for")
        table = table.unionByName(made.select("y_true", F.lit(None).cast("int").alias("fold"), "made_for", key.alias("key"), *features))
    table = materialize(table.withColumn("mask", lockstep.bit_mask(F.col("fold"), F.col("made_for"), k).cast("bigint")))
    sums = [F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in features for n, f in (("s", F.sum), ("q", lambda c: F.sum(F.col(c) * F.col(c))))]]
    parts = np.zeros((k, 1 + 2 * len(features)))
    for r in scaled.groupBy("fold").agg(*sums).collect():  # a row per fold
        parts[r[0]] = [float(x or 0) for x in r[1:]]
    training = parts.sum(axis=0) - parts
    n = np.maximum(training[:, :1], 1)
    mean = training[:, 1::2] / n
    spread = np.sqrt(np.maximum(training[:, 2::2] / n - mean**2, 0))
    return table, mean, np.where(spread > 1e-12, spread, 1.0)


def out_of_fold(
    rows: DataFrame, features: Sequence[str], estimators: Mapping[str, Estimator], k: int = 5, id: str = "event_id",
    rebalance: bool = False, seed: int = 42,
) -> DataFrame:
    """(model, id, fold, y_true, y_proba, y_pred): every row scored by the models that did not see its ``fold``.

    With ``rebalance`` the oversampling stays inside each fold's training rows, and scaling is fitted there as well.
    Logistic regressions and boosted trees of all folds are fitted together, pass by pass over one table; forests too,
    tree by tree in tasks, while a task can hold the table. Other estimators are fitted one fold at a time.
    """
    table, mean, spread = fold_table(rows, features, k, id, rebalance, seed)
    stats = {r["feature"]: (r["mean"], r["std"]) for r in feature_stats(rows, features).collect()}  # a row per feature
    held = rows.select(
        id, "fold", F.col("y_true").cast("int").alias("y_true"),
        *[((F.col(c).cast("double") - stats[c][0]) / (stats[c][1] if stats[c][1] > 0 else 1.0)).alias(c) for c in features])
    held = materialize(held)
    borders = lockstep.bin_borders(table, features, BINS)
    bounded = table.count() <= lockstep.HELD
    parts, jobs, slow = [], [], []
    for name, model in estimators.items():
        if isinstance(model, LogisticRegression) and not model.isDefined("weightCol"):
            beta = lockstep.newton(table, features, k, model.getRegParam(), scale=(mean, spread))
            score = lambda x, i, b=beta: ((x - mean[i]) / spread[i]) @ b[i][:-1] + b[i][-1]
            parts.append(_scored(held, features, id, score).withColumn("model", F.lit(name)))
        elif isinstance(model, GBTClassifier) and not model.isDefined("weightCol"):
            how = lockstep.Boosting(
                model.getMaxIter(), model.getMaxDepth(), model.getStepSize(), model.getSubsamplingRate(),
                model.getMinInstancesPerNode(), BINS, model.getSeed())
            trees = lockstep.boost(table, features, k, borders, how)
            score = lambda x, i, t=trees, b=borders: 2 * t[i].margins(lockstep.binned(x, b))
            parts.append(_scored(held, features, id, score).withColumn("model", F.lit(name)))
        elif isinstance(model, RandomForestClassifier) and not model.isDefined("weightCol") and bounded:
            how = lockstep.Forest(model.getNumTrees(), model.getMaxDepth(), model.getMinInstancesPerNode(), BINS, model.getSeed())
            shares = lockstep.forest_scores(table, held, features, k, borders, id, how)
            parts.append(shares.withColumns(
                {"y_pred": (F.col("y_proba") > 0.5).cast("int"), "model": F.lit(name)}))
        else:
            slow += [(name, i) for i in range(k)]
            jobs += [lambda m=model, i=i: assembled(features, m).fit(_training(table, i)) for i in range(k)]
    for (name, i), fitted in zip(slow, side_by_side(rows.sparkSession, jobs)):
        scored = positive_probability(fitted.transform(held.where(F.col("fold") == i)))
        parts.append(scored.select(id, "fold", "y_true", "y_proba", F.col("prediction").cast("int").alias("y_pred"), F.lit(name).alias("model")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _training(table: DataFrame, i: int) -> DataFrame:
    own = table.where(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0)
    return own.repartition(max(table.rdd.getNumPartitions(), table.sparkSession.sparkContext.defaultParallelism), "key")


def _scored(held: DataFrame, features: Sequence[str], id: str, score: Callable) -> DataFrame:
    """Probabilities from the margins that ``score`` gives rows of a fold."""
    names, kind = list(features), dict(held.dtypes)[id]

    def scored(batches):
        for b in batches:
            x, fold = b[names].to_numpy(np.float64), b["fold"].to_numpy()
            margin = np.zeros(len(b))
            for i in np.unique(fold):
                margin[fold == i] = score(x[fold == i], int(i))
            p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
            yield b[[id, "fold", "y_true"]].assign(y_proba=p, y_pred=(p > 0.5).astype("int32"))

    return held.mapInPandas(scored, f"{id} {kind}, fold int, y_true int, y_proba double, y_pred int")


def cross_validate(
    rows: DataFrame, features: Sequence[str], estimators: Mapping[str, Estimator], task: str, k: int = 5,
    id: str = "event_id", rebalance: bool = False,
) -> DataFrame:
    """Mean fold metrics per model (std for recall and area)."""
    scored = out_of_fold(rows, features, estimators, k, id, rebalance)
    return fold_means(materialize(scored.withColumn("task", F.lit(task))))
