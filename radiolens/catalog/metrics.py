"""Evaluation and selection on prediction tables derived from the log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from radiolens.catalog.aggregates import PRED, predictions
from radiolens.catalog.base import check, rounded
from radiolens.operators import asof, evaluate, explore, selection
from radiolens.operators.evaluate import SCAN_THRESHOLDS, SEARCH_THRESHOLDS
from radiolens.plans.stage import materialize
from radiolens.sources.documents import union_results

# three "models" with different scores for the same rows, as a comparison needs them
MODELS = {
    "LogisticRegression": ("(k % 12) / 12.0", lambda: (F.col("k") % 12) / 12.0),
    "RandomForest": ("(k % 12 + psc % 5) / 16.0", lambda: (F.col("k") % 12 + F.col("psc") % 5) / 16.0),
    "GradientBoosting": ("(psc % 5 * 3 + k % 4) / 16.0", lambda: (F.col("psc") % 5 * 3 + F.col("k") % 4) / 16.0),
}


def model_predictions(t):
    """One pass over the log: the models are an array on each row."""
    each = F.array(*[
        F.struct(F.lit(name).alias("model"), F.lit(place).alias("place"), score().cast("double").alias("y_proba"))
        for place, (name, (_, score)) in enumerate(MODELS.items())
    ])
    rows = predictions(t).drop("y_proba", "y_pred").select("*", F.inline(each))
    return rows.withColumns({"fold": (F.col("event_id") % 5).cast("int"), "y_pred": (F.col("y_proba") >= 0.5).cast("int")})


MODEL_PRED = "with " + PRED + ",\nmp as (" + "\nunion all\n".join(
    f"select event_id, ts, psc, task, y_true, '{name}' as model, {i} as place, cast({sql} as double) as y_proba, "
    f"case when cast({sql} as double) >= 0.5 then 1 else 0 end as y_pred, cast(event_id % 5 as int) as fold from preds"
    for i, (name, (sql, _)) in enumerate(MODELS.items())) + ")\n"

COUNTS = """count(*) filter (y_true = 1 and y_pred = 1) as tp, count(*) filter (y_true = 0 and y_pred = 1) as fp,
  count(*) filter (y_true = 0 and y_pred = 0) as tn, count(*) filter (y_true = 1 and y_pred = 0) as fn"""


def rates_sql(prefix: str = "") -> str:
    return """coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0) as accuracy,
  coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1"""


def auc_ctes(src: str, by: str, name: str) -> str:
    return f"""
{name}_c as (select {by}, y_proba, sum(y_true) as pos, sum(1 - y_true) as neg from {src} where y_proba is not null group by all),
{name}_r as (select *, sum(pos) over (partition by {by} order by y_proba desc) as ctp,
   sum(neg) over (partition by {by} order by y_proba desc) as cfp from {name}_c),
{name} as (select {by}, (sum(neg * (ctp - pos / 2)) / nullif(sum(pos) * sum(neg), 0))::double as roc_auc,
   case when sum(pos) > 0 and sum(neg) > 0 then (sum(pos * (ctp / (ctp + cfp) +
     case when ctp - pos + cfp - neg = 0 then 1 else (ctp - pos) / nullif(ctp - pos + cfp - neg, 0) end) / 2) / nullif(sum(pos), 0))::double end as pr_auc
   from {name}_r group by {by})"""


EVAL = MODEL_PRED + ", cnt as (select task, model, place, " + COUNTS + " from mp group by all)," + auc_ctes(
    "mp", "task, model", "area") + ",\n" + f"""
met as (select *, {rates_sql()} from cnt join area using (task, model)),
fcnt as (select task, model, fold, {COUNTS} from mp group by all),""" + auc_ctes("mp", "task, model, fold", "farea") + f""",
fmet as (select *, {rates_sql()} from fcnt join farea using (task, model, fold)),
cv as (select task, model, avg(accuracy) as cv_accuracy, avg(precision) as cv_precision, avg(recall) as cv_recall,
   avg(f1) as cv_f1, avg(roc_auc) as cv_roc_auc, stddev_pop(recall) as cv_recall_std, stddev_pop(roc_auc) as cv_roc_auc_std
   from fmet group by all),
comp as (select task, model, place, tp, fp, tn, fn, """ + ", ".join(
    f"round({c}, 4) as {c}" for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "cv_accuracy",
                                      "cv_precision", "cv_recall", "cv_f1", "cv_roc_auc", "cv_recall_std", "cv_roc_auc_std")
) + " from met join cv using (task, model))\n"


def comparison(t):
    preds = materialize(model_predictions(t).select("task", "model", "fold", "y_true", "y_proba", "y_pred"))  # read four times
    places = F.element_at(F.create_map(*[x for i, m in enumerate(MODELS) for x in (F.lit(m), F.lit(i))]), F.col("model"))
    table = evaluate.evaluate(preds).join(evaluate.fold_means(preds), ["task", "model"], "inner")
    return evaluate.compare_models(table.withColumn("place", places))


@check("union_results", MODEL_PRED + "select task, model, count(*) as n, round(sum(y_proba), 6) as total from mp group by all",
       ("scored",))
def _(t):
    preds = model_predictions(t)
    parts = [preds.where(F.col("model") == name) for name in MODELS]
    rows = union_results(*parts).groupBy("task", "model").agg(F.count(F.lit(1)).alias("n"), F.sum("y_proba").alias("total"))
    return rounded(rows)


@check("confusion_matrix", "with " + PRED + """,
g as (select t.task, a.c as y_true, b.c as y_pred from (select distinct task from preds) t, (values (0), (1)) a(c), (values (0), (1)) b(c)),
n as (select task, y_true, y_pred, count(*) as n from preds group by all)
select g.*, coalesce(n.n, 0) as n from g left join n using (task, y_true, y_pred)""", ("scored",))
def _(t):
    return evaluate.confusion_matrix(predictions(t), ["task"])


@check("binary_metrics", "with " + PRED + f""", c as (select task, {COUNTS} from preds group by task)
select task, tp, fp, tn, fn, """ + ", ".join(f"round({x}, 6) as {x}" for x in ("accuracy", "precision", "recall", "f1"))
       + f" from (select *, {rates_sql()} from c)", ("scored",))
def _(t):
    return rounded(evaluate.binary_metrics(predictions(t), ["task"]))


@check("classification_report", "with " + PRED + """,
cl as (select unnest([0, 1]) as c),
m as (select c::varchar as class, count(*) filter (y_true = c) as support, count(*) filter (y_pred = c) as said,
   count(*) filter (y_true = c and y_pred = c) as tp from preds, cl group by c),
s as (select class, tp, support, coalesce(tp / nullif(said, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall,
   coalesce(2 * tp / nullif(support + said, 0), 0) as f1 from m),
u as (select class, precision, recall, f1, support::bigint as support from s union all
  select 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support)::bigint from s union all
  select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::bigint from s union all
  select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support)::bigint from s)
select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from u""", ("scored",))
def _(t):
    return rounded(evaluate.classification_report(predictions(t)))


@check("roc_auc", "with " + PRED + "," + auc_ctes("preds", "psc", "area") + "select psc, round(roc_auc, 6) as roc_auc from area",
       ("scored",))
def _(t):
    return rounded(evaluate.roc_auc(predictions(t), ["psc"]))


@check("roc_auc_total", "with " + PRED + ", p as (select *, 0 as g from preds)," + auc_ctes("p", "g", "area")
       + "select round(roc_auc, 6) as roc_auc from area", ("scored",))
def _(t):
    """No grouping, with the chunked running sum of large score tables."""
    return rounded(evaluate.roc_auc(t.scored, plan="chunked"))


@check("pr_auc", "with " + PRED + "," + auc_ctes("preds", "task", "area") + "select task, round(pr_auc, 6) as pr_auc from area",
       ("scored",))
def _(t):
    return rounded(evaluate.pr_auc(predictions(t), ["task"]))


@check("roc_auc_ovr_weighted", "with " + PRED + """,
l as (select 'pos' as class, y_proba, y_true from preds union all select 'neg', 1 - y_proba, 1 - y_true from preds),
""" + auc_ctes("l", "class", "area").strip() + """,
n as (select class, sum(y_true) as support from l group by class)
select round(sum(roc_auc * support) / sum(support), 6) as roc_auc from area join n using (class)""", ("scored",))
def _(t):
    preds = t.scored.select(
        F.when(F.col("y_true") == 1, "pos").otherwise("neg").alias("y_true"),
        F.create_map(F.lit("pos"), "y_proba", F.lit("neg"), 1 - F.col("y_proba")).alias("probs"),
    )
    return rounded(evaluate.roc_auc_ovr_weighted(preds, "probs"))


@check("roc_curve", "with " + PRED + "," + auc_ctes("preds", "task", "area") + """,
t as (select task, sum(pos) as p, sum(neg) as n from area_c group by task)
select task, y_proba as threshold, round(cfp / n, 6) as fpr, round(ctp / p, 6) as tpr from area_r join t using (task)
union all select task, null, 0.0::double, 0.0::double from t""", ("scored",))
def _(t):
    return rounded(evaluate.roc_curve(predictions(t), ["task"]), "fpr", "tpr")


def scan_ctes(thresholds) -> str:
    values = ", ".join(f"('{x!r}'::double)" for x in map(float, thresholds))
    return f"""th(threshold) as (values {values}),
sc as (select task, threshold, count(*) filter (y_true = 1 and y_proba >= threshold) as tp,
  count(*) filter (y_true = 0 and y_proba >= threshold) as fp, count(*) filter (y_true = 0 and y_proba < threshold) as tn,
  count(*) filter (y_true = 1 and y_proba < threshold) as fn from preds, th group by all),
sr as (select *, {rates_sql()} from sc)"""


@check("threshold_scan", "with " + PRED + "," + scan_ctes(SCAN_THRESHOLDS) + """
select task, round(threshold, 2) as threshold, round(recall, 4) as recall, round(precision, 4) as precision,
  round(f1, 4) as f1 from sr""", ("scored",))
def _(t):
    return evaluate.threshold_scan(predictions(t), by=["task"])


@check("optimize_threshold", "with " + PRED + "," + scan_ctes(SEARCH_THRESHOLDS) + """,
r as (select task, 'recall' as metric, threshold, round(recall, 12) as best_score from sr union all
  select task, 'f1', threshold, round(f1, 12) from sr union all
  select task, 'sum', threshold, round(recall + precision, 12) from sr),
b as (select *, row_number() over (partition by task, metric order by best_score desc, threshold) as n from r)
select task, metric, round(threshold, 6) as threshold, round(best_score, 6) as best_score from b where n = 1""", ("scored",))
def _(t):
    parts = [evaluate.optimize_threshold(predictions(t), m, by=["task"]).withColumn("metric", F.lit(m))
             for m in ("recall", "f1", "sum")]
    return rounded(reduce(lambda a, b: a.unionByName(b), parts))


@check("error_rates", "with " + PRED + f""", c as (select task, {COUNTS} from preds group by task)
select *, round(fn / nullif(tp + fn, 0), 4) as miss_rate, round(fp / nullif(fp + tn, 0), 4) as false_alarm_rate,
  case when fn > tp then '{evaluate.MORE_MISSES}' when fp > tp then '{evaluate.MORE_ALARMS}'
       when fn = 0 then '{evaluate.NO_MISSES}' else '{evaluate.ACCEPTABLE}' end as verdict from c""", ("scored",))
def _(t):
    return evaluate.error_rates(predictions(t), ["task"])


@check("error_rows", "with " + PRED + """
select event_id, psc, y_true, y_pred, y_proba, case when y_true = 1 then 'FN' else 'FP' end as error_type
from preds where y_true <> y_pred order by ts, event_id limit 20""", ("scored",))
def _(t):
    rows = evaluate.error_rows(predictions(t), ["ts", "event_id"])
    return rows.select("event_id", "psc", "y_true", "y_pred", "y_proba", "error_type")


@check("compare_models", EVAL + "select * from comp", ("scored",))
def _(t):
    return comparison(t)


WEIGHTED = "round(0.0 + recall * 0.4 + roc_auc * 0.3 + f1 * 0.2 + cv_roc_auc * 0.1, 10)::double"
CHOSEN = EVAL + f""", rk as (select *, {WEIGHTED} as score from comp),
sel as (select * from (select *, row_number() over (partition by task order by score desc nulls last, place) as n from rk) where n = 1)
"""


@check("select_weighted", CHOSEN + "select task, model, round(score, 6) as score from sel", ("scored",))
def _(t):
    return rounded(selection.select_weighted(comparison(t)))


LEX = EVAL + """, sel as (select * from (select *, row_number() over (partition by task order by
  case when task = 'interference' then f1 else recall end desc nulls last,
  case when task = 'interference' then roc_auc else pr_auc end desc nulls last,
  case when task = 'interference' then null else f1 end desc nulls last, place) as n from comp) where n = 1)
"""


@check("select_lexicographic", LEX + "select task, model from sel", ("scored",))
def _(t):
    return selection.select_lexicographic(comparison(t), {"interference": selection.BALANCED})


@check("best_model_join", CHOSEN + "select comp.* from comp join sel using (task, model)", ("scored",))
def _(t):
    table = comparison(t)
    return asof.best_model_join(table, selection.select_weighted(table))


@check("justify_selection", LEX + f"""select task, model, recall, precision, f1, roc_auc, pr_auc,
  case when task = 'interference' then '{selection.BALANCED_REASON}' else '{selection.RECALL_REASON}' end as reason
  from sel""", ("scored",))
def _(t):
    table = comparison(t)
    chosen = selection.select_lexicographic(table, {"interference": selection.BALANCED})
    rows = selection.justify_selection(table, chosen, ["interference"])
    return rows.select("task", "model", "recall", "precision", "f1", "roc_auc", "pr_auc", "reason")


FEATURES = ("rscp", "ecn0", "rscp_det", "psc_det", "k", "psc")


def importance_rows(t):
    """Strength of each feature per task and model: |correlation| of the feature with the score."""
    joined = t.umts.select("event_id", "rscp", "ecn0", "rscp_det", "psc_det").join(
        model_predictions(t), "event_id", "inner")
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.round(F.abs(F.corr(c, "y_proba")), 6).alias("importance")) for c in FEATURES
    ])
    return joined.groupBy("task", "model").agg(rows.alias("_r")).select("task", "model", F.inline("_r"))


IMP = ", imp as (" + "\nunion all\n".join(
    f"select task, model, '{c}' as feature, round(abs(corr({c}, y_proba)), 6) as importance from mpf group by task, model"
    for c in FEATURES) + ")\n"
MPF = ", mpf as (select mp.*, u.rscp, u.ecn0, u.rscp_det, u.psc_det, u.k from mp join umts u using (event_id))"


@check("top_features", MODEL_PRED + MPF + IMP + """,
r as (select *, row_number() over w as rank, sum(importance) over w / sum(importance) over (partition by task, model) as share,
  importance >= quantile_cont(importance, 0.75) over (partition by task, model) as top_quartile
  from imp window w as (partition by task, model order by importance desc, feature))
select task, model, feature, importance, rank::int as rank, round(share, 6) as share, top_quartile, share <= 0.8 as within_80,
  share <= 0.9 as within_90 from r where rank <= 4""", ("scored", "umts"))
def _(t):
    rows = importance_rows(t)
    rows = rows.withColumn("importance", F.coalesce("importance", F.lit(0.0)))
    return rounded(selection.top_features(rows, 4, ["task", "model"]), "share")


@check("final_summary", CHOSEN + MPF + IMP + """,
tops as (select task, string_agg(feature, ', ' order by importance desc, feature) as top_drivers from (
  select imp.*, row_number() over (partition by imp.task order by importance desc, feature) as n
  from imp join sel using (task, model)) where n <= 3 group by task),
bal as (select task, sum(y_true)::bigint as positives, (count(*) - sum(y_true))::bigint as negatives,
  round((count(*) - sum(y_true)) / greatest(sum(y_true), 1), 6) as imbalance from preds group by task)
select sel.task, sel.model, sel.recall, sel.f1, sel.roc_auc, positives, negatives, imbalance, top_drivers,
  (select count(*) from scored) as n_rows, 6 as n_features
from sel join bal using (task) join tops using (task)""", ("scored", "umts"))
def _(t):
    table = comparison(t)
    chosen = selection.select_weighted(table)
    preds = predictions(t)
    rates = explore_rates(preds)
    rows = selection.final_summary(t.scored, table, chosen, rates, importance_rows(t), len(FEATURES))
    rows = rows.select("task", "model", "recall", "f1", "roc_auc", "positives", "negatives", "imbalance",
                       "top_drivers", "n_rows", "n_features")
    return rounded(rows, "imbalance")


def explore_rates(preds):
    wide = preds.select(*[
        F.when(F.col("task") == task, F.col("y_true")).alias(task) for task in ("interference", "handover")
    ])
    return explore.label_rates(wide, ["interference", "handover"])
