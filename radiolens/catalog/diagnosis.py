"""Engineering rules."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from radiolens.catalog.base import CELL, SESSION, check, rounded
from radiolens.catalog.windows import LABELED_SQL, frame, labeled, persist_sql
from radiolens.operators import rules


def band_sql(c, bands):
    (first, cut), *mid, (last, _) = bands
    return (f"case when {c} > {cut} then '{first}' " + " ".join(f"when {c} >= {low} then '{n}'" for n, low in mid)
            + f" when {c} is not null then '{last}' end")


@check("rscp_band", f"select event_id, {band_sql('rscp', rules.RSCP_BANDS)} as rscp_band from umts", ("umts",))
def _(t):
    return rules.rscp_band(t.umts).select("event_id", "rscp_band")


@check("ecn0_band", f"select event_id, {band_sql('ecn0', rules.ECN0_BANDS)} as ecn0_band from umts", ("umts",))
def _(t):
    return rules.ecn0_band(t.umts).select("event_id", "ecn0_band")


@check("radio_diagnosis", """select event_id, case
  when rscp > -80 and ecn0 > -5 then 'Optimal' when rscp > -80 and ecn0 >= -10 then 'Good' when rscp > -80 then 'Interference'
  when rscp >= -90 and ecn0 > -5 then 'Good coverage' when rscp >= -90 and ecn0 >= -10 then 'Fair'
  when rscp >= -90 then 'Interference + coverage mix'
  when ecn0 > -5 then 'Rare' when ecn0 >= -10 then 'Unclassified' else 'Coverage hole' end as diagnosis from umts""", ("umts",))
def _(t):
    return rules.radio_diagnosis(t.umts).select("event_id", "diagnosis")


@check("qos_guideline_class", """
with g as (select event_id,
  case when rsrp > -80 then 0 when rsrp >= -95 then 1 when rsrp >= -105 then 2 when rsrp is not null then 3 end as a,
  case when rsrq > -7 then 0 when rsrq >= -11 then 1 when rsrq >= -15 then 2 when rsrq is not null then 3 end as b,
  case when rlc_dl > 20 then 0 when rlc_dl >= 5 then 1 when rlc_dl >= 1 then 2 when rlc_dl is not null then 3 end as c from lte_raw)
select event_id, ['Tres bonne', 'Acceptable', 'Assez bien', 'Mauvaise'][greatest(a, b, c) + 1] as qos_class from g""", ("lte_raw",))
def _(t):
    return rules.qos_guideline_class(t.lte_raw).select("event_id", "qos_class")


@check("persistent_interference", persist_sql("ecn0 < -10", 10, 5, "persistent_interference"), ("umts",))
def _(t):
    return rules.persistent_interference(t.umts, CELL).select("event_id", "persistent_interference")


def drop_sql(seconds: int) -> str:
    return f"""
with m as (select *, max(rscp) over (partition by psc order by ts range between interval {seconds} seconds preceding and current row) as peak from umts)
select event_id, case when peak - rscp > 5 then 1 else 0 end as rscp_drop from m"""


# the fixture's samples are minutes apart per cell, so the frames are an hour and 3 hours here
@check("rscp_drop", drop_sql(10800), ("umts",))
def _(t):
    return rules.rscp_drop(t.umts, 5.0, 10800).select("event_id", "rscp_drop")


@check("rscp_drop_fast", drop_sql(3600), ("umts",))
def _(t):
    return rules.rscp_drop(t.umts, 5.0, 3600).select("event_id", "rscp_drop")


@check("fast_fading", """
with l as (select event_id, rscp, lag(rscp) over w as before, (epoch_us(ts) - epoch_us(lag(ts) over w)) / 1000000 as s
  from umts window w as (partition by psc order by ts, event_id))
select event_id, case when (before - rscp) / nullif(s, 0) > 0.05 then 1 else 0 end as fast_fading from l""", ("umts",))
def _(t):
    return rules.fast_fading(t.umts, CELL, 0.05).select("event_id", "fast_fading")


def volatile_sql(n, cut):
    return (f"select event_id, case when round(coalesce(stddev_samp(ecn0) over {frame(n)}, 0), 9) > {cut} "
            f"then 1 else 0 end as volatile from umts")


@check("volatile_channel", volatile_sql(20, 3), ("umts",))
def _(t):
    return rules.volatile_channel(t.umts, CELL).select("event_id", "volatile")


@check("volatile_channel_short", volatile_sql(5, 2), ("umts",))
def _(t):
    return rules.volatile_channel(t.umts, replace(CELL, chunk_rows=61), 5, 2.0).select("event_id", "volatile")


@check("interference_share", """select psc, count(*) as samples, round(avg(case when ecn0 < -10 then 1 else 0 end), 6) as share
  from umts group by psc having avg(case when ecn0 < -10 then 1 else 0 end) > 0.05""", ("umts",))
def _(t):
    return rounded(rules.interference_share(t.umts))


@check("pilot_pollution_share", """select psc, count(*) as samples, round(avg(case when abs(rscp - rscp_det) < 5 then 1 else 0 end), 6)
  as share from umts group by psc having avg(case when abs(rscp - rscp_det) < 5 then 1 else 0 end) > 0.20""", ("umts",))
def _(t):
    return rounded(rules.pilot_pollution_share(t.umts))


ALARM_SQL = """
with o as (select *, case when {cond} then 1 else 0 end as c from umts),
s as (select *, case when c = 1 and coalesce(lag(c) over (partition by psc order by ts, event_id), 0) = 0 then 1 else 0 end as st from o),
r as (select *, sum(st) over (partition by psc order by ts, event_id rows unbounded preceding) as run from s)
select psc, run::bigint as run, count(*) as samples, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 as duration_s
from r where c = 1 group by psc, run having (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 > {seconds}"""


@check("duration_alarms", ALARM_SQL.format(cond="ecn0 < -14", seconds=60), ("umts",))
def _(t):
    return rules.duration_alarms(t.umts, F.col("ecn0") < -14, 60, CELL).select("psc", "run", "samples", "duration_s")


@check("duration_alarms_weak", ALARM_SQL.format(cond="rscp < -75", seconds=120), ("umts",))
def _(t):
    """The weaker level of the fixture, with the chunked plan of large logs."""
    split = replace(CELL, chunk_rows=61)
    return rules.duration_alarms(t.umts, F.col("rscp") < -75, 120, split).select("psc", "run", "samples", "duration_s")


@check("ping_pong", """
with c as (select *, (pci % 3)::int as cell, lag((pci % 3)::int) over (partition by session_id order by ts, event_id) as before,
  row_number() over (partition by session_id order by ts, event_id) as n from lte_raw),
v as (select * from c where n = 1 or cell <> before),
b as (select *, lag(cell, 1) over w as via, lag(cell, 2) over w as back_to from v window w as (partition by session_id order by ts, event_id))
select session_id, event_id, cell, via from b where back_to = cell""", ("lte_raw",))
def _(t):
    return rules.ping_pong(t.lte_raw.withColumn("cell", (F.col("pci") % 3).cast("int")), SESSION, "cell")


@check("weekly_top_cells", "with " + LABELED_SQL + """,
r as (select strftime(date_trunc('week', ts), '%Y-%m-%d') as week, psc, avg(interference) as rate, count(*) as samples
  from labeled group by all),
p as (select *, row_number() over (partition by week order by rate desc, psc)::int as place from r)
select week, psc, round(rate, 6) as rate, samples, place from p where place <= 3""", ("umts",))
def _(t):
    return rounded(rules.weekly_top_cells(labeled(t), 3)).withColumn("week", F.col("week").cast("string"))


def kpis(t):
    pairs = F.array(
        F.struct(F.lit("dch_bler").alias("kpi"), (F.col("k") % 20).cast("double").alias("value")),
        F.struct(F.lit("call_drop_rate").alias("kpi"), (F.col("k") % 5).cast("double").alias("value")),
        F.struct(F.lit("rtwp_dbm").alias("kpi"), (-95.0 - F.col("psc") % 12).alias("value")),
        F.struct(F.lit("unknown").alias("kpi"), F.col("rscp").alias("value")),
    )
    return t.umts.select("event_id", F.inline(pairs))


@check("kpi_band", "with th(kpi, band, lo, hi) as (values " + ", ".join(
    f"('{k}', '{b}', {'null' if lo is None else lo}, {'null' if hi is None else hi})" for k, b, lo, hi in rules.KPI_BANDS) + """),
v as (select event_id, 'dch_bler' as kpi, (k % 20)::double as value from umts union all
  select event_id, 'call_drop_rate', (k % 5)::double from umts union all
  select event_id, 'rtwp_dbm', (-95.0 - psc % 12)::double from umts union all select event_id, 'unknown', rscp from umts)
select event_id, v.kpi, value, band from v left join th on v.kpi = th.kpi and (lo is null or value >= lo) and (hi is null or value < hi)""",
       ("umts",))
def _(t):
    rows = kpis(t)
    return rules.kpi_band(rows, rules.kpi_bands(rows))
