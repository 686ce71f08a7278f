"""Joins, and the LTE coverage features that start from one."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from radiolens.catalog.base import CELL, LOG, SESSION, SHORT, check, rounded
from radiolens.operators import asof, cells, clean, features

TOLERANCE = 7200.0  # the fixture's samples are minutes apart

ASOF_SQL = """
with l as (select * exclude (rlc_dl) from lte_raw where rsrp is not null),
r as (select event_id as rid, ts as rts, session_id as rs, rlc_dl from lte_raw where rlc_dl is not null),
j as (
  select l.event_id, r.rlc_dl,
         row_number() over (partition by l.event_id
           order by abs(epoch_us(ts) - epoch_us(rts)),
                    case when rts > ts then 1 else 0 end,
                    case when rts > ts then rid else -rid end) as rn
  from l join r on l.session_id = r.rs and abs(epoch_us(ts) - epoch_us(rts)) <= 7200000000)
"""
ASOF_GLOBAL_SQL = """
with l as (select event_id, ts from lte_raw where rsrp is not null),
r as (select event_id as rid, ts as rts, rlc_dl from lte_raw where rlc_dl is not null),
p as (select l.event_id, l.ts, r.rlc_dl, r.rts from l asof join r on l.ts >= r.rts),
f as (select l.event_id, r.rlc_dl, r.rts from l asof join r on l.ts < r.rts),
j as (select l.event_id, l.ts, p.rlc_dl as prlc, f.rlc_dl as frlc,
        epoch_us(l.ts) - epoch_us(p.rts) as pd, epoch_us(f.rts) - epoch_us(l.ts) as fd
      from l left join p on l.event_id = p.event_id left join f on l.event_id = f.event_id)
select event_id, case when pd <= 600000000 and not coalesce(fd < pd, false) then prlc
                      when fd <= 600000000 then frlc end as rlc_dl from j
"""


def merged(t):
    radio, throughput = clean.split_streams(t.lte_raw)
    right = throughput.select("session_id", "ts", "event_id", "rlc_dl")
    return asof.asof_nearest(radio, right, "ts", TOLERANCE, by=["session_id"])


@check("asof_nearest", ASOF_SQL + """select l.event_id, j.rlc_dl from l
  left join j on l.event_id = j.event_id and j.rn = 1""", ("lte_raw",))
def _(t):
    return merged(t).select("event_id", "rlc_dl")


@check("asof_nearest_keyless", ASOF_GLOBAL_SQL, ("lte_raw",))
def _(t):
    """No key at all: the merged log is split into chunks, not sent to one task."""
    radio, throughput = clean.split_streams(t.lte_raw)
    right = throughput.select("ts", "event_id", "rlc_dl")
    return asof.asof_nearest(radio.select("event_id", "ts"), right, "ts", 600.0, chunk_rows=SHORT).drop("ts")


@check("asof_join_clean", ASOF_SQL + """select distinct l.* exclude (ts), j.rlc_dl from l
  join j on l.event_id = j.event_id and j.rn = 1
  where l.ts is not null and band is not null and rsrq is not null""", ("lte_raw",))
def _(t):
    radio, throughput = clean.split_streams(t.lte_raw)
    right = throughput.select("session_id", "ts", "event_id", "rlc_dl")
    return asof.asof_join_clean(radio, right, "ts", TOLERANCE, by=["session_id"]).drop("ts")


COVERAGE_SQL = ASOF_SQL + """,
m as (select l.*, j.rlc_dl from l join j on l.event_id = j.event_id and j.rn = 1),
w as (select *, case when rsrp >= -80 then 'Tres bonne' when rsrp >= -90 then 'Bonne'
           when rsrp >= -100 then 'Moyenne' else 'Mauvaise' end as coverage_zone,
         hour(ts)::int as hour, minute(ts)::int as minute, second(ts)::int as second,
         (dense_rank() over (order by band) - 1)::int as band_enc,
""" + ",\n".join(
    f"""lag({c}, 1) over s as {c}_lag1, lag({c}, 2) over s as {c}_lag2,
    avg({c}) over (s rows between 2 preceding and current row) as {c}_roll3,
    avg({c}) over (s rows between 4 preceding and current row) as {c}_roll5"""
    for c in features.COVERAGE_VALUES
) + """
  from m window s as (partition by session_id order by ts, event_id))
select event_id, coverage_zone, hour, minute, second, band_enc, """ + ", ".join(
    f"round({c}_{f}, 6) + 0.0 as {c}_{f}"
    for c in features.COVERAGE_VALUES for f in ("lag1", "lag2", "roll3", "roll5")
) + """
from w where rsrp_lag2 is not null and rsrq_lag2 is not null and rlc_dl_lag2 is not null"""
COVERAGE_COLUMNS = [
    "event_id", "coverage_zone", *[c for c in features.COVERAGE_FEATURES
                                   if c not in (*features.COVERAGE_VALUES, "pci")],
]


def coverage_rows(t, order=SESSION):
    """Merged, featured LTE rows; the plan is fixed from the merged log before any join."""
    rows = merged(t)
    radio, _ = clean.split_streams(t.lte_raw)
    return features.coverage_features(rows.dropna().dropDuplicates(), order, bands=radio)


@check("coverage_features", COVERAGE_SQL, ("lte_raw",))
def _(t):
    return rounded(coverage_rows(t).select(*COVERAGE_COLUMNS))


@check("coverage_features_keyless", COVERAGE_SQL.replace("(partition by session_id order by", "(order by"),
       ("lte_raw",))
def _(t):
    """One log without sessions: lags and means run along the whole log, chunk by chunk."""
    return rounded(coverage_rows(t, replace(LOG, chunk_rows=SHORT)).select(*COVERAGE_COLUMNS))


@check("attach_cell_stats", """
with a as (select psc, avg(rscp) as rscp_cell_mean, min(rscp) as rscp_cell_min, max(rscp) as rscp_cell_max,
  coalesce(stddev_samp(rscp), 0) as rscp_cell_std, count(*) as n_samples_cell from umts group by psc)
select event_id, round(rscp_cell_mean, 6) as rscp_cell_mean, rscp_cell_min, rscp_cell_max,
  round(rscp_cell_std, 6) as rscp_cell_std, n_samples_cell from umts left join a using (psc)""", ("umts",))
def _(t):
    umts = t.umts
    rows = cells.attach_cell_stats(umts, cells.cell_aggregates(umts, "psc", ["rscp"]), "psc")
    return rounded(rows.select("event_id", "rscp_cell_mean", "rscp_cell_min", "rscp_cell_max",
                               "rscp_cell_std", "n_samples_cell"))


@check("cell_mean_transform", """
select event_id, round(avg(rscp) over (partition by psc), 6) as psc_rscp_mean,
  round(avg(ecn0) over (partition by psc), 6) as psc_ecn0_mean,
  round(rscp - avg(rscp) over (partition by psc), 6) + 0.0 as rscp_vs_mean,
  round(ecn0 - avg(ecn0) over (partition by psc), 6) + 0.0 as ecn0_vs_mean from umts""", ("umts",))
def _(t):
    rows = features.cell_mean_transform(t.umts, "psc", ("rscp", "ecn0"))
    return rounded(rows.select("event_id", "psc_rscp_mean", "psc_ecn0_mean", "rscp_vs_mean", "ecn0_vs_mean"))
