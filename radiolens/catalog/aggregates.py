"""Audits, distributions and per-cell aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from radiolens.catalog.base import CELL, LOG, check, rounded
from radiolens.catalog.joins import COVERAGE_SQL, coverage_rows
from radiolens.catalog.windows import LABELED_SQL, labeled, recommend_sql
from radiolens.operators import cells, clean, explore

LINE_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int"}


def union_sql(columns, row) -> str:
    return "\nunion all\n".join(row(c, d) for c, d in columns)


UMTS_TYPES = [("event_id", "bigint"), ("psc", "int"), ("rscp", "double"), ("ecn0", "double"), ("k", "int"),
              ("rscp_det", "double"), ("psc_det", "int")]


@check("dataset_info", union_sql(UMTS_TYPES, lambda c, d: f"""select '{c}' as "column", '{d}' as dtype,
  count(*) as n_rows, 7 as n_columns, count(*) filter ({c} is null) as missing from umts"""), ("umts",))
def _(t):
    return explore.dataset_info(t.umts.drop("ts"))


@check("audit_missing", union_sql(UMTS_TYPES, lambda c, d: f"""select '{c}' as "column", '{d}' as dtype,
  count(*) filter ({c} is null) as missing_count,
  round(avg(case when {c} is null then 1 else 0 end) * 100, 2) as missing_pct from umts"""), ("umts",))
def _(t):
    return explore.audit_missing(t.umts.drop("ts"))


@check("duplicate_count", """select (count(*) - (select count(*) from (select distinct * from umts_raw)))::bigint
  as duplicate_rows from umts_raw""", ("umts_raw",))
def _(t):
    return explore.duplicate_count(t.umts_raw)


def describe_sql(columns: list[str], texts: list[str], src: str) -> str:
    parts = []
    for c in [*columns, *texts]:
        nums = (f"avg({c}) as mean, stddev_samp({c}) as std, min({c})::double as min, max({c})::double as max, "
                f"quantile_cont({c}::double, 0.25) as q25, quantile_cont({c}::double, 0.5) as q50, "
                f"quantile_cont({c}::double, 0.75) as q75") if c in columns else (
            "null::double as mean, null::double as std, null::double as min, null::double as max, "
            "null::double as q25, null::double as q50, null::double as q75")
        top = (f"(select {c}::varchar from {src} where {c} is not null group by 1 "
               f"order by count(*) desc, 1 limit 1)")
        freq = f"(select count(*) from {src} where {c} is not null group by {c} order by 1 desc limit 1)"
        parts.append(f"""select '{c}' as "column", count({c}) as count, count(distinct {c}) as "unique",
          {top} as top, {freq} as freq, {nums} from {src}""")
    body = "\nunion all\n".join(parts)
    return (f"""with d as ({body}) select "column", count, "unique", top, freq, round(mean, 6) as mean,
      round(std, 6) as std, min, max, round(q25, 6) as q25, round(q50, 6) as q50, round(q75, 6) as q75 from d""")


@check("describe_all", describe_sql(["l_orderkey", "l_quantity", "l_linenumber"], ["l_returnflag", "l_linestatus"],
                                    "lineitem"))
def _(t):
    rows = explore.describe_all(t.lineitem, ["l_orderkey", "l_quantity", "l_linenumber", "l_returnflag", "l_linestatus"])
    return rounded(rows, "mean", "std", "q25", "q50", "q75")


@check("value_counts", """select o_orderpriority, o_orderstatus, count(*) as n from orders group by all
  order by n desc, 1, 2 limit 10""")
def _(t):
    return explore.value_counts(t.orders, ["o_orderpriority", "o_orderstatus"], 10)


@check("class_distribution", """select coverage_zone, count(*) as n, round(count(*) / sum(count(*)) over () * 100, 1)
  as pct from (select case when rsrp >= -80 then 'Tres bonne' when rsrp >= -90 then 'Bonne'
  when rsrp >= -100 then 'Moyenne' else 'Mauvaise' end as coverage_zone from lte_raw where rsrp is not null)
  group by coverage_zone""", ("lte_raw",))
def _(t):
    radio, _ = clean.split_streams(t.lte_raw)
    return explore.class_distribution(clean.coverage_zone(radio), "coverage_zone")


@check("label_rates", "with " + LABELED_SQL + ", " + "\n" + """u as (
  select 'interference' as label, interference as v from labeled union all
  select 'handover_needed', handover_needed from labeled)
select label, round(avg(v), 6) as rate, sum(v)::bigint as positives, (count(*) - sum(v))::bigint as negatives,
  round((count(*) - sum(v)) / greatest(sum(v), 1), 6) as imbalance from u group by label""", ("umts",))
def _(t):
    return rounded(explore.label_rates(labeled(t), ["interference", "handover_needed"]))


@check("class_profile", COVERAGE_SQL.rsplit("select event_id, coverage_zone", 1)[0] + """
select coverage_zone, round(avg(rsrp), 1) as rsrp_mean, round(avg(rsrq), 1) as rsrq_mean,
  round(avg(rlc_dl), 1) as rlc_dl_mean, case coverage_zone when 'Tres bonne' then 1 when 'Bonne' then 2
  when 'Moyenne' then 3 else 4 end as place
from w where rsrp_lag2 is not null and rsrq_lag2 is not null and rlc_dl_lag2 is not null group by coverage_zone""",
       ("lte_raw",))
def _(t):
    return explore.class_profile(coverage_rows(t))


AGGS = [f"{c}_cell_{f}" for c in ("rscp", "ecn0") for f in ("mean", "min", "max", "std")]


@check("cell_aggregates", """select psc, count(*) as n_samples_cell, """ + ", ".join(
    f"round(avg({c}), 6) as {c}_cell_mean, min({c}) as {c}_cell_min, max({c}) as {c}_cell_max, "
    f"round(coalesce(stddev_samp({c}), 0), 6) as {c}_cell_std" for c in ("rscp", "ecn0")) + """
from umts where psc is not null group by psc""", ("umts",))
def _(t):
    return rounded(cells.cell_aggregates(t.umts, "psc", ("rscp", "ecn0")))


STATS_SQL = """select psc, round(avg(rscp), 3) as rscp_mean, round(stddev_samp(rscp), 3) as rscp_std,
  count(rscp) as n_samples, round(avg(ecn0), 3) as ecn0_mean, round(stddev_samp(ecn0), 3) as ecn0_std
  from umts where psc is not null group by psc"""


@check("cell_stats", STATS_SQL + " order by n_samples desc, psc limit 100", ("umts",))
def _(t):
    return cells.cell_stats(t.umts)


@check("cell_alert_counts", "with " + LABELED_SQL + ", " + recommend_sql("labeled") + f"""
select count(*) filter (interference_rate > 0.1) as interference_cells,
  count(*) filter (handover_rate > 0.1) as handover_cells,
  count(*) filter (recommendation = '{cells.HANDOVER}') as handover_advised from recs""", ("umts",))
def _(t):
    return cells.cell_alert_counts(cells.cell_recommendations(labeled(t)))


CORR = ["psc", "rscp", "ecn0", "k", "rscp_det", "psc_det"]


@check("correlation_matrix", "\nunion all\n".join(
    f"select '{a}' as a, '{b}' as b, " + ("1.0::double" if a == b else f"round(corr({a}, {b}), 6) + 0.0") + " as r from umts"
    + (" having count(*) > 0" if a == b else "")
    for a in CORR for b in CORR), ("umts",))
def _(t):
    return rounded(explore.correlation_matrix(t.umts, CORR))


@check("histogram", """
with e as (select min(rscp) as lo, max(rscp) as hi from umts)
select least(floor((rscp - lo) / (hi - lo) * 50), 49)::int as bin, count(*) as n from umts, e
where rscp is not null group by 1""", ("umts",))
def _(t):
    return explore.histogram(t.umts, "rscp", 50)


ZONED = """
z as (select event_id, session_id, ts, rsrp, rsrq, case when rsrp >= -80 then 'Tres bonne' when rsrp >= -90 then 'Bonne'
  when rsrp >= -100 then 'Moyenne' else 'Mauvaise' end as coverage_zone from lte_raw where rsrp is not null)
"""


def zoned(t):
    radio, _ = clean.split_streams(t.lte_raw)
    return clean.coverage_zone(radio)


@check("box_stats", "with " + ZONED + """,
q as (select coverage_zone, quantile_cont(rsrp, 0.25) as q25, quantile_cont(rsrp, 0.5) as median,
        quantile_cont(rsrp, 0.75) as q75 from z group by coverage_zone)
select coverage_zone, round(q25, 6) as q25, round(median, 6) as median, round(q75, 6) as q75,
  min(rsrp) filter (rsrp between q25 - (q75 - q25) * 1.5 and q75 + (q75 - q25) * 1.5) as whisker_lo,
  max(rsrp) filter (rsrp between q25 - (q75 - q25) * 1.5 and q75 + (q75 - q25) * 1.5) as whisker_hi,
  count(*) filter (not (rsrp between q25 - (q75 - q25) * 1.5 and q75 + (q75 - q25) * 1.5)) as outliers
from z join q using (coverage_zone) group by coverage_zone, q.q25, q.median, q.q75""", ("lte_raw",))
def _(t):
    return rounded(explore.box_stats(zoned(t), "rsrp", "coverage_zone"))


def violin_predictions(t):
    return t.scored.select(
        F.when(F.col("y_true") == 1, "pos").otherwise("neg").alias("y_true"),
        F.create_map(F.lit("pos"), "y_proba", F.lit("neg"), 1 - F.col("y_proba")).alias("probs"),
    )


@check("violin_stats", """
with p as (select case when y_true = 1 then 'pos' else 'neg' end as true_class,
             case when y_true = 1 then y_proba else 1 - y_proba end as p from scored)
select true_class, count(*) as n, min(p) as lo, round(quantile_cont(p, 0.25), 6) as q25,
  round(quantile_cont(p, 0.5), 6) as median, round(quantile_cont(p, 0.75), 6) as q75, max(p) as hi
from p group by true_class""", ("scored",))
def _(t):
    return rounded(explore.violin_stats(violin_predictions(t), "probs", "y_true"))


def kde_sql(rows: str, value: str, by: str, points: int, bins: int = explore.KDE_BINS) -> str:
    """Linear binning, then the kernel sum."""
    return f"""
s as (select {by}, count({value}) as n, stddev_samp({value}) * pow(count({value}), -0.2) as w from {rows} group by {by}),
e as (select min({value})::double as lo, (max({value}) - min({value}))::double / {points - 1} as step,
   (max({value}) - min({value}))::double / {bins - 1} as width from {rows}),
a as (select {by}, ({value} - lo) / width as pos from {rows}, e where {value} is not null),
b as (select {by}, least(floor(pos), {bins - 2}) as bin, pos from a),
v as (select {by}, bin, sum(m) as m from (select {by}, bin, 1 - (pos - bin) as m from b union all select {by}, bin + 1, pos - bin from b) group by all),
g as (select i::int as point, lo + i * step as x from e, range({points}) as r(i))
select {by}, point, round(max(x), 6) as x,
  round(sum(m * exp(-0.5 * pow((x - (lo + bin * width)) / w, 2)) / (n * w * sqrt(2 * pi()))), 6) + 0.0 as density
from v join s using ({by}), g, e group by {by}, point"""


@check("kde", "with " + ZONED + "," + kde_sql("z", "rsrp", "coverage_zone", 40), ("lte_raw",))
def _(t):
    return rounded(explore.kde(zoned(t), "rsrp", "coverage_zone", 40))


@check("violin_density", """
with p as (select case when y_true = 1 then 'pos' else 'neg' end as true_class,
             case when y_true = 1 then y_proba else 1 - y_proba end as p from scored),""" + kde_sql("p", "p", "true_class", 50), ("scored",))
def _(t):
    return rounded(explore.violin_density(violin_predictions(t), "probs", "y_true"))


@check("stability_pairs", "with " + ZONED + """,
p as (select *, lag(rsrp) over (order by ts, event_id) as before from z)
select coverage_zone, count(*) as pairs, round(corr(before, rsrp), 6) + 0.0 as r,
  round(avg(abs(rsrp - before)), 6) as mean_step from p where before is not null group by coverage_zone""",
       ("lte_raw",))
def _(t):
    return rounded(explore.stability_pairs(zoned(t), "rsrp", "coverage_zone", LOG))


def predictions(t):
    return t.scored.withColumns({
        "y_pred": (F.col("y_proba") >= 0.5).cast("int"),
        "task": F.when(F.col("k") % 2 == 0, "interference").otherwise("handover"),
    })


PRED = """
preds as (select *, case when y_proba >= 0.5 then 1 else 0 end as y_pred,
  case when k % 2 = 0 then 'interference' else 'handover' end as task from scored)
"""
RISKY_SQL = """select psc, count(*) as alarms from preds where y_pred = 1 group by psc order by alarms desc, psc limit 10"""


@check("top_risky_cells", "with " + PRED + RISKY_SQL, ("scored",))
def _(t):
    return explore.top_risky_cells(predictions(t))


ERROR_TYPE = "case when y_true = 1 and y_pred = 0 then 'FN' when y_true = 0 and y_pred = 1 then 'FP' else 'OK' end"


@check("error_counts", "with " + PRED + f"select task, {ERROR_TYPE} as error_type, count(*) as n from preds group by all",
       ("scored",))
def _(t):
    return explore.error_counts(predictions(t))


@check("error_summary", "with " + PRED + f""",
c as (select task, psc, count(*) as alarms from preds where y_pred = 1 group by all),
r as (select *, row_number() over (partition by task order by alarms desc, psc) as place from c),
m as (select task, string_agg(psc || ':' || alarms, ',' order by place) as top_risky_cells from r where place <= 10 group by task),
e as (select task, count(*) filter ({ERROR_TYPE} = 'FP') as false_positives,
   count(*) filter ({ERROR_TYPE} = 'FN') as false_negatives from preds group by task)
select * from e left join m using (task)""", ("scored",))
def _(t):
    rows = explore.error_summary(predictions(t))
    text = F.array_join(F.transform(F.map_entries("top_risky_cells"),
                                    lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return rows.withColumn("top_risky_cells", text)
