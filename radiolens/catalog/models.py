"""Splits, resampling, training, scoring and explanation."""

from __future__ import annotations

from pyspark.sql import functions as F

from radiolens.catalog.base import CELL, LOG, check, rounded
from radiolens.catalog.joins import COVERAGE_SQL, coverage_rows
from radiolens.catalog.windows import CONGESTION_SQL, LABELED_SQL, QOS_SQL, frame, labeled
from radiolens.functions import scalar
from radiolens.operators import explain, features, labels, resample, rules, score, split, train
from radiolens.operators.features import COVERAGE_FEATURES, UMTS_FEATURES
from radiolens.plans.stage import materialize, scratch_path
from radiolens.sources import store

@check("time_split", """
with r as (select event_id, row_number() over (order by ts, event_id) - 1 as i, count(*) over () as n from umts)
select event_id, case when i < floor(n * 0.70::double) then 'train' when i < floor(n * 0.85::double) then 'validation'
  else 'test' end as split from r""", ("umts",))
def _(t):
    return split.time_split(t.umts, LOG).select("event_id", "split")


SIZES = "with " + LABELED_SQL + ", c as (select interference, count(*) as n from labeled group by 1), "


@check("stratified_split", SIZES + """
t as (select interference, floor(n * 0.2::double + 0.5)::bigint as k, n from c)
select interference, 'test' as split, k as n from t union all select interference, 'train', n - k from t""", ("umts",))
def _(t):
    """Rows per class and side: exact shares."""
    rows = split.stratified_split(labeled(t), "interference", "event_id")
    return rows.groupBy("interference", "split").agg(F.count(F.lit(1)).alias("n"))


@check("stratified_split_chunked", SIZES + """
t as (select interference, floor(n * 0.2::double + 0.5)::bigint as k, n from c)
select interference, 'test' as split, k as n from t union all select interference, 'train', n - k from t""", ("umts",))
def _(t):
    rows = split.stratified_split(labeled(t), "interference", "event_id", plan="chunked")
    return rows.groupBy("interference", "split").agg(F.count(F.lit(1)).alias("n"))


@check("stratified_folds", SIZES + """f as (select unnest(range(5))::int as fold)
select interference, fold, n // 5 + case when fold < n % 5 then 1 else 0 end as n from c, f""", ("umts",))
def _(t):
    rows = split.stratified_folds(labeled(t), "interference", "event_id")
    return rows.groupBy("interference", "fold").agg(F.count(F.lit(1)).alias("n"))


@check("impute_median", """
with m as (select quantile_cont(rscp_det, 0.5) as a, quantile_cont(psc_det::double, 0.5) as b from umts where event_id % 4 > 0)
select event_id, round(coalesce(rscp_det, a), 6) as rscp_det, coalesce(psc_det::double, b) as psc_det from umts, m""", ("umts",))
def _(t):
    train_rows = t.umts.where(F.col("event_id") % 4 > 0)
    rows = split.impute_median(train_rows, t.umts, ["rscp_det", "psc_det"]).select("event_id", "rscp_det", "psc_det")
    return rounded(rows, "rscp_det")


@check("fill_zero", "select event_id, coalesce(rscp_det, 0.0)::double as rscp_det, coalesce(psc_det, 0)::double as psc_det from umts",
       ("umts",))
def _(t):
    return split.fill_zero(t.umts, ["rscp_det", "psc_det"]).select("event_id", "rscp_det", "psc_det")


@check("standard_scale", """
with s as (select avg(rscp) as m1, stddev_pop(rscp) as s1, avg(ecn0) as m2, stddev_pop(ecn0) as s2 from umts where event_id % 4 > 0)
select event_id, round((rscp - m1) / s1, 6) + 0.0 as rscp, round((ecn0 - m2) / s2, 6) + 0.0 as ecn0, 0.0::double as flat from umts, s""",
       ("umts",))
def _(t):
    rows = t.umts.withColumn("flat", F.lit(7.0))
    scaled = split.standard_scale(rows.where(F.col("event_id") % 4 > 0), rows, ["rscp", "ecn0", "flat"])
    return rounded(scaled.select("event_id", "rscp", "ecn0", "flat"))


@check("feature_stats", "\nunion all\n".join(
    f"select '{c}' as feature, round(avg({c}), 6) as mean, round(stddev_pop({c}), 6) as std from umts" for c in ("rscp", "ecn0", "k")),
       ("umts",))
def _(t):
    return rounded(split.feature_stats(t.umts, ["rscp", "ecn0", "k"]))


@check("class_weights", """
with c as (select label, count(*) as n from embeddings group by label)
select vec_id, label, round((select sum(n) from c) / ((select count(*) from c) * n), 6) as weight from embeddings join c using (label)""")
def _(t):
    return rounded(split.class_weights(t.embeddings.select("vec_id", "label"), "label"))


def numeric_rows(t):
    """Labeled rows with whole-number features, so that distances are exact in any engine."""
    return labeled(t).select("event_id", "interference", (F.round(F.col("rscp") * 100)).alias("a"),
                             (F.col("ecn0") * 100).alias("b"), (F.col("k") * 10).cast("double").alias("c"))


@check("smote", "with " + LABELED_SQL + """, n as (select interference, count(*) as n from labeled group by 1)
select interference, (select max(n) from n) as rows, (select max(n) from n) - n as synthetic, 0::bigint as outside from n""", ("umts",))
def _(t):
    """Every class as large as the largest; no synthetic row outside the box of its parents."""
    base = numeric_rows(t)
    rows = materialize(resample.smote(base, ["a", "b", "c"], "interference", "event_id"))
    ends = base.select(F.col("event_id").alias("id"), F.array("a", "b", "c").alias("v"))
    made = rows.where(F.col("turn") > 0)
    boxed = made.join(ends.withColumnsRenamed({"id": "parent", "v": "p"}), "parent").join(
        ends.withColumnsRenamed({"id": "neighbor", "v": "q"}), "neighbor")
    inside = [
        F.col(c).between(F.least(F.get("p", F.lit(i)), F.get("q", F.lit(i))) - 1e-6,
                         F.greatest(F.get("p", F.lit(i)), F.get("q", F.lit(i))) + 1e-6) for i, c in enumerate("abc")]
    outside = boxed.groupBy("interference").agg(F.count_if(~(inside[0] & inside[1] & inside[2])).alias("outside"))
    sizes = rows.groupBy("interference").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("turn") > 0).alias("synthetic"))
    return sizes.join(outside, "interference", "left").fillna(0, ["outside"])


TOMEK = "with " + LABELED_SQL + """,
v as (select event_id, interference, round(rscp * 100) as a, ecn0 * 100 as b, (k * 10)::double as c from labeled),
d as (select x.event_id, min({'d': (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c), 'i': y.event_id}) as m
  from v x join v y on x.event_id <> y.event_id group by x.event_id),
n as (select event_id, m.i as neighbor from d),
p as (select n.event_id from n join n as o on o.event_id = n.neighbor and o.neighbor = n.event_id
  join v x on x.event_id = n.event_id join v y on y.event_id = n.neighbor where x.interference <> y.interference)
"""


@check("tomek_links", TOMEK + "select event_id, interference from v where event_id not in (select event_id from p)", ("umts",))
def _(t):
    return resample.tomek_links(numeric_rows(t), ["a", "b", "c"], "interference", "event_id").select("event_id", "interference")


@check("resample_effect", "with " + LABELED_SQL + """, n as (select interference, count(*) as n from labeled group by 1)
select interference, 'before' as stage, n from n union all select interference, 'after', (select max(n) from n) from n""", ("umts",))
def _(t):
    base = numeric_rows(t)
    return resample.resample_effect(base, resample.smote(base, ["a", "b", "c"], "interference", "event_id"), "interference")


COVERED = COVERAGE_SQL.rsplit("select event_id, coverage_zone", 1)[0] + """,
covered as (select event_id from w where rsrp_lag2 is not null and rsrq_lag2 is not null and rlc_dl_lag2 is not null)
"""
COVERED_ZONES = COVERED + ", zones as (select coverage_zone from w join covered using (event_id)) "


def coverage_table(t):
    return materialize(coverage_rows(t).select("event_id", "coverage_zone", *COVERAGE_FEATURES))


def coverage_model(t):
    return train.train_coverage_forest(coverage_table(t), COVERAGE_FEATURES)


def found_share(least: float):
    """Whether at least this share of a zone's rows is predicted as that zone."""
    return F.avg((F.col("predicted_class") == F.col("coverage_zone")).cast("int")) >= least


@check("train_coverage", COVERED_ZONES + """select coverage_zone, floor(n * 0.2::double + 0.5)::bigint as n, true as known, true as sure
  from (select coverage_zone, count(*) as n from zones group by 1)""", ("lte_raw",))
def _(t):
    """Boosted one-vs-rest on scaled and rebalanced rows: every test row of a zone gets a zone, with a confidence."""
    rows = materialize(split.stratified_split(coverage_table(t), "coverage_zone", "event_id"))
    model, names = train.train_coverage(rows.where("split = 'train'"), COVERAGE_FEATURES)
    scored = score.score(model, rows.where("split = 'test'"), names)
    return scored.groupBy("coverage_zone").agg(
        F.count(F.lit(1)).alias("n"), F.every(F.col("predicted_class").isin(names)).alias("known"),
        F.every(F.col("confidence").between(100 / len(names) - 0.01, 100)).alias("sure"))


# The 32 features of the UMTS tasks.
NOTEBOOK_FEATURES = (
    "band", "uarfcn", "psc", "rscp", "ecn0", "rscp_det", "psc_det", "hour", "minute", "second", "is_peak_hour", "delta_rscp", "delta_sc", "signal_gap_abs", "active_detected_close",
    "active_detected_far", "rscp_roll_mean", "rscp_roll_std", "rscp_diff1", "ecn0_roll_mean", "ecn0_roll_std",
    "ecn0_diff1", "rscp_cell_mean", "rscp_cell_min", "rscp_cell_max", "rscp_cell_std", "ecn0_cell_mean",
    "ecn0_cell_min", "ecn0_cell_max", "ecn0_cell_std", "n_samples_cell", "rscp_quality_ratio",
)


def umts_table(t):
    """Labeled rows of the three UMTS tasks with the notebook features, split by time."""
    order = CELL
    rows = labels.label_outage(labels.label_congestion(labels.label_qos_degraded(t.umts), order), order)
    rows = scalar.is_peak_hour(scalar.time_parts(rows, "ts"), "ts")
    # the fixture has no band and channel; they follow from the cell
    rows = rows.withColumns({"band": F.col("psc") % 3 + 1, "uarfcn": F.col("psc") % 7 * 25 + 10562})
    return split.time_split(features.umts_features_notebook(rows, order), LOG)


UMTS_LABELS = f"""
st as (select *, coalesce(rscp - lag(rscp) over (partition by psc order by ts, event_id), 0) as step,
    row_number() over (order by ts, event_id) - 1 as i, count(*) over () as total from umts),
lb as (select event_id, case when i < floor(total * 0.70::double) then 'train' when i < floor(total * 0.85::double) then 'validation' else 'test' end as split,
  {QOS_SQL} as qos_degradee, {CONGESTION_SQL} as congestion_probable,
  case when sum(case when rscp <= -110 or step <= -15 or ecn0 <= -15 then 1 else 0 end) over {frame(3)} >= 3 then 1 else 0 end as panne_probable
  from st),
tl as (select 'qos_degradee' as task, split, qos_degradee as y from lb union all select 'congestion_probable', split, congestion_probable from lb
  union all select 'panne_probable', split, panne_probable from lb),
ms as (select unnest(['LogisticRegression', 'RandomForest', 'GradientBoosting']) as model)
"""


@check("train_umts_tasks", "with " + UMTS_LABELS + """
select task, model, count(*) as n, sum(y)::bigint as positives, true as scored, true as applied, true as unscaled
from tl, ms where split = 'test' group by task, model""", ("umts",))
def _(t):
    """Rows and positives of each task and model on the test rows; every probability lies in [0, 1], the
    threshold is applied, and the whole stored and loaded pipeline gives the same probabilities from cleaned rows.
    """
    table = materialize(umts_table(t))
    fitted = train.train_umts_tasks(table, NOTEBOOK_FEATURES)
    gaps = {}
    for (task, name), model in fitted.models.items():
        path = scratch_path(t.spark, "model")
        store.save_model(model, {"features": list(NOTEBOOK_FEATURES)}, t.spark, path)
        again = train.positive_probability(store.load_model(t.spark, path)[0].transform(table.where("split = 'test'")))
        own = fitted.predictions.where((F.col("task") == task) & (F.col("model") == name)).select("event_id", F.col("y_proba").alias("p"))
        far = again.join(own, "event_id").where(F.abs(F.col("p") - F.col("y_proba")) > 1e-9)
        gaps[task, name] = far.isEmpty()
    same = t.spark.createDataFrame([(*k, v) for k, v in gaps.items()], "task string, model string, unscaled boolean")
    return fitted.predictions.groupBy("task", "model").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y_true").cast("bigint")).alias("positives"),
        F.every(F.col("y_proba").between(0, 1)).alias("scored"),
        F.every(F.col("y_pred") == (F.col("y_proba") >= F.col("threshold")).cast("int")).alias("applied"),
    ).join(same, ["task", "model"])


def handover_table(t):
    rows = labeled(t).drop("delta_rscp", "has_neighbor", "delta_sc", "signal_gap_abs", "active_detected_close", "active_detected_far")
    table = features.umts_features(rows, CELL)
    table = split.fill_zero(table, UMTS_FEATURES)
    for task in train.HANDOVER_TASKS:
        table = split.stratified_split(table, task, "event_id").withColumnRenamed("split", f"split_{task}")
    return materialize(table)


HANDOVER = "with " + LABELED_SQL + """,
tl as (select 'interference' as task, interference as y from labeled union all select 'handover_needed', handover_needed from labeled),
sz as (select task, y, count(*) as n from tl group by all),
ms as (select unnest(['LogisticRegression', 'RandomForest', 'GradientBoosting']) as model)
"""


@check("train_handover_tasks", HANDOVER + """
select task, model, sum(floor(n * 0.2::double + 0.5))::bigint as n, sum(case when y = 1 then floor(n * 0.2::double + 0.5) else 0 end)::bigint as positives,
  true as counted from sz, ms group by task, model""", ("umts",))
def _(t):
    """Test rows and positives of each task and model; the four counts of the evaluation add up to them."""
    from radiolens.operators.evaluate import evaluate

    fitted = train.train_handover_tasks(handover_table(t), UMTS_FEATURES)
    sizes = fitted.predictions.groupBy("task", "model").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y_true").cast("bigint")).alias("positives"))
    table = evaluate(fitted.predictions).join(sizes, ["task", "model"])
    right = (F.col("tp") + F.col("fn") == F.col("positives")) & (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn") == F.col("n"))
    return table.select("task", "model", "n", "positives", right.alias("counted"))


@check("cross_validate", HANDOVER + """select task, model, true as bounded, true as spread, true as learned from (select distinct task from tl), ms""", ("umts",))
def _(t):
    """Five folds of the three models on both tasks, scaled and oversampled inside the folds: means lie in [0, 1], and
    every model ranks and finds far better than chance (an area of 0.8, a recall of 0.6) on rows that it has not seen."""
    table = handover_table(t)

    def one(task):
        rows = table.withColumn("y_true", F.col(task).cast("double"))
        rows = materialize(split.stratified_folds(rows, task, "event_id"))
        return train.cross_validate(rows, UMTS_FEATURES, train.handover_models(rows.count()), task, rebalance=True)

    parts = train.side_by_side(t.spark, [lambda task=task: one(task) for task in train.HANDOVER_TASKS])
    rows = parts[0].unionByName(parts[1])
    bounded = [F.col(f"cv_{c}").between(0, 1) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")]
    return rows.select("task", "model", (bounded[0] & bounded[1] & bounded[2] & bounded[3] & bounded[4]).alias("bounded"),
                       (F.col("cv_recall_std").between(0, 0.5) & F.col("cv_roc_auc_std").between(0, 0.5)).alias("spread"),
                       ((F.col("cv_roc_auc") >= 0.8) & (F.col("cv_recall") >= 0.6)).alias("learned"))


@check("score", COVERED + "select event_id, 1.0::double as total, true as likeliest, true as sure from covered", ("lte_raw",))
def _(t):
    """Every row scored: probabilities sum to one, the class is the likeliest, the confidence its share."""
    model, names = coverage_model(t)
    rows = score.score(model, coverage_table(t), names)
    values = F.map_values("probabilities")
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    top = F.array_max(values)
    return rows.select(
        "event_id", F.round(total, 6).alias("total"),
        (F.element_at("probabilities", F.col("predicted_class")) == top).alias("likeliest"),
        (F.abs(F.col("confidence") - top * 100) <= 0.005001).alias("sure"))


def stored_and_loaded(t):
    model, names = coverage_model(t)
    path = scratch_path(t.spark, "model")
    store.save_model(model, {"features": list(COVERAGE_FEATURES), "labels": names}, t.spark, path)
    return model, names, *store.load_model(t.spark, path)


@check("save_model", COVERED + "select count(*) as n, 0.0::double as gap, 0::bigint as changed from covered", ("lte_raw",))
def _(t):
    """Stored and loaded: the scores of both do not differ on any row."""
    model, names, loaded, meta = stored_and_loaded(t)
    rows = coverage_table(t)
    first = score.score(model, rows, names).select("event_id", F.col("confidence").alias("a"), F.col("predicted_class").alias("x"))
    again = score.score(loaded, rows, meta["labels"]).select("event_id", F.col("confidence").alias("b"), F.col("predicted_class").alias("y"))
    return first.join(again, "event_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("gap"), F.count_if(F.col("x") != F.col("y")).alias("changed"))


@check("load_model", COVERED_ZONES + "select coverage_zone, count(*) as n, true as learned, true as sure from zones group by coverage_zone", ("lte_raw",))
def _(t):
    """Scores of every row by a model that was stored and loaded: of each zone it finds 95 % of the rows or more."""
    _, _, loaded, meta = stored_and_loaded(t)
    rows = score.score(loaded, coverage_table(t), meta["labels"])
    return rows.groupBy("coverage_zone").agg(
        F.count(F.lit(1)).alias("n"), found_share(0.95).alias("learned"), F.every(F.col("confidence").between(0, 100)).alias("sure"))


@check("validation_vectors", COVERED + f"""select unnest({[*['coverage'] * 4, *['qos'] * 4]}) as kind,
  unnest({[s[0] for s in (*score.COVERAGE_SAMPLES, *score.QOS_SAMPLES)]}) as expected, true as known, true as sure, true as compared,
  unnest([true, true, true, true, null, null, null, null]) as met from (select 1 from covered limit 1)""", ("lte_raw",))
def _(t):
    """The known rows of both kinds, each with a class of its model: those of coverage get the expected zone, the
    quality model learns the guideline's classes."""
    rows = coverage_table(t)
    model, names = coverage_model(t)
    guided = rules.qos_guideline_class(rows)
    quality, classes = train.train_coverage_forest(guided, score.QOS_FEATURES, label="qos_class")
    parts = []
    for kind, m, samples, labels_ in (
        ("coverage", model, score.coverage_samples(t.spark), names), ("qos", quality, score.qos_samples(t.spark), classes)):
        table = score.validation_vectors(m, samples, labels_)
        parts.append(table.select(
            F.lit(kind).alias("kind"), "expected", F.col("got").isin(labels_).alias("known"), F.col("confidence").between(0, 100).alias("sure"),
            (F.col("matches") == (F.col("got") == F.col("expected"))).alias("compared"),
            (F.col("matches") if kind == "coverage" else F.lit(None).cast("boolean")).alias("met")))
    return parts[0].unionByName(parts[1])


@check("feature_importance", COVERED + f"""select {len(COVERAGE_FEATURES) + 1} as features, 1.0::double as total, 0.0::double as least, 0.0::double as flat
  from covered having count(*) > 0""", ("lte_raw",))
def _(t):
    """One share per feature, none negative, in sum one; a constant column has none."""
    rows = coverage_table(t).withColumn("flat", F.lit(1.0))
    model, _ = train.train_coverage_forest(rows, (*COVERAGE_FEATURES, "flat"))
    table = explain.feature_importance(t.spark, model, (*COVERAGE_FEATURES, "flat"))
    return table.agg(F.count(F.lit(1)).cast("int").alias("features"), F.round(F.sum("importance"), 6).alias("total"),
                     F.least(F.min("importance"), F.lit(0.0)).alias("least"), F.max(F.when(F.col("feature") == "flat", F.col("importance"))).alias("flat"))


@check("permutation_importance", "with " + LABELED_SQL + f"""select unnest({[*UMTS_FEATURES, 'flat', 'noise']}) as feature, unnest({[False] * len(UMTS_FEATURES) + [True, False]}) as flat,
  unnest({[c == "ecn0_rmean_5" for c in UMTS_FEATURES] + [False, False]}) as leads, true as bounded from (select 1 from labeled limit 1)""", ("umts",))
def _(t):
    """Ten shuffles of every feature. The label counts poor quality in frames of five rows: the mean of such a
    frame costs most F1, a tenth at least; noise costs less than a hundredth, a constant column none at all."""
    rows = handover_table(t).withColumn("y_true", F.col("interference").cast("double"))
    rows = rows.withColumns({"flat": F.lit(0.0), "noise": F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000.0})
    names = (*UMTS_FEATURES, "flat", "noise")
    scaled = materialize(split.standard_scale(rows, rows, names).select("event_id", "y_true", *names))
    estimator = train.handover_models(scaled.count())["LogisticRegression"]
    model = train.assembled(names, estimator).fit(scaled)
    falls = materialize(explain.permutation_importance(model, scaled, names))
    most = falls.agg(F.max("importance")).scalar()
    still = (F.col("importance") == 0) & (F.col("spread") == 0)
    leads = (F.col("importance") == most) & (F.col("importance") >= 0.1)
    bound = F.when(F.col("feature") == "noise", 0.01).otherwise(1.0)
    return falls.select("feature", ((F.col("feature") == "flat") & still).alias("flat"), leads.alias("leads"), (F.abs("importance") <= bound).alias("bounded"))
