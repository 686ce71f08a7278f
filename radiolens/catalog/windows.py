"""Ordered windows, labels, and the flagship per-cell action."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from radiolens.catalog.base import CELL, LOG, SESSION, check, rounded
from radiolens.catalog.cleaning import CLEAN_SQL, cleaned
from radiolens.operators import cells, features, labels, split

S = "(partition by psc order by ts, event_id rows between {n} preceding and current row)"
SMALL = 61  # chunk length below that of a cell


def frame(n: int) -> str:
    return S.format(n=n - 1)


def means_sql(names: dict[str, tuple[str, int]], over: str = S) -> str:
    cols = ", ".join(
        f"round(avg({c}) over {over.format(n=n - 1)}, 6) + 0.0 as {out}" for out, (c, n) in names.items()
    )
    return f"select event_id, {cols} from umts"


GLOBAL = "(order by ts, event_id rows between {n} preceding and current row)"


@check("lags", """select event_id, lag(rscp, 1) over w as rscp_lag1, lag(rscp, 2) over w as rscp_lag2,
  lag(ecn0, 1) over w as ecn0_lag1, lag(ecn0, 2) over w as ecn0_lag2
  from umts window w as (order by ts, event_id)""", ("umts",))
def _(t):
    rows = features.lags(t.umts, ["rscp", "ecn0"], LOG)
    return rows.select("event_id", "rscp_lag1", "rscp_lag2", "ecn0_lag1", "ecn0_lag2")


@check("rolling_mean_global", means_sql(
    {"rscp_roll3": ("rscp", 3), "rscp_roll5": ("rscp", 5), "ecn0_roll3": ("ecn0", 3), "ecn0_roll5": ("ecn0", 5)},
    GLOBAL), ("umts",))
def _(t):
    rows = features.rolling_mean_global(t.umts, ["rscp", "ecn0"], LOG)
    return rounded(rows.select("event_id", "rscp_roll3", "rscp_roll5", "ecn0_roll3", "ecn0_roll5"))


CELL_MEANS = {f"{c}_rmean_{n}": (c, n) for c in ("rscp", "ecn0") for n in (5, 10)}


@check("rolling_mean_cell", means_sql(CELL_MEANS), ("umts",))
def _(t):
    rows = features.rolling_mean_cell(t.umts, ["rscp", "ecn0"], CELL)
    return rounded(rows.select("event_id", *CELL_MEANS))


@check("rolling_mean_cell_chunked", means_sql(CELL_MEANS), ("umts",))
def _(t):
    """Chunks shorter than most cells, so that every cell is split and needs its halo."""
    rows = features.rolling_mean_cell(t.umts, ["rscp", "ecn0"], replace(CELL, chunk_rows=SMALL))
    return rounded(rows.select("event_id", *CELL_MEANS))


@check("rolling_mean_cell_3", means_sql({"rscp_roll_mean": ("rscp", 3), "ecn0_roll_mean": ("ecn0", 3)}), ("umts",))
def _(t):
    rows = features.rolling_mean_cell_3(t.umts, ["rscp", "ecn0"], CELL)
    return rounded(rows.select("event_id", "rscp_roll_mean", "ecn0_roll_mean"))


@check("rolling_std_cell", f"""select event_id, round(coalesce(stddev_samp(rscp) over {frame(5)}, 0), 6) as rscp_rstd_5,
  round(coalesce(stddev_samp(ecn0) over {frame(5)}, 0), 6) as ecn0_rstd_5 from umts""", ("umts",))
def _(t):
    rows = features.rolling_std_cell(t.umts, ["rscp", "ecn0"], CELL, 5)
    return rounded(rows.select("event_id", "rscp_rstd_5", "ecn0_rstd_5"))


@check("first_difference", """select event_id, round(coalesce(rscp - lag(rscp) over w, 0), 6) + 0.0 as rscp_diff,
  coalesce(ecn0 - lag(ecn0) over w, 0.0) + 0.0 as ecn0_diff
  from umts window w as (partition by psc order by ts, event_id)""", ("umts",))
def _(t):
    rows = features.first_difference(t.umts, ["rscp", "ecn0"], CELL)
    return rounded(rows.select("event_id", "rscp_diff", "ecn0_diff"))


def set_a_sql(src: str, time: str) -> str:
    def over(n):
        return f"(partition by psc order by {time}, event_id rows between {n - 1} preceding and current row)"

    cols = [
        "round(coalesce(rscp - rscp_det, 0), 6) + 0.0 as delta_rscp",
        "case when rscp_det is null then 0 else 1 end as has_neighbor",
        *[f"round(avg({c}) over (partition by psc), 6) as psc_{c}_mean" for c in ("rscp", "ecn0")],
        *[f"round({c} - avg({c}) over (partition by psc), 6) + 0.0 as {c}_vs_mean" for c in ("rscp", "ecn0")],
        *[f"round(avg({c}) over {over(n)}, 6) as {c}_rmean_{n}" for n in (5, 10) for c in ("rscp", "ecn0")],
        f"round(coalesce(stddev_samp(ecn0) over {over(5)}, 0), 6) as ecn0_rstd_5",
        *[f"round(coalesce({c} - lag({c}) over (partition by psc order by {time}, event_id), 0), 6) + 0.0 as {c}_diff"
          for c in ("rscp", "ecn0")],
    ]
    return f"select event_id, rscp, ecn0, {', '.join(cols)} from {src}"


@check("umts_features", set_a_sql("umts", "ts"), ("umts",))
def _(t):
    return rounded(features.umts_features(t.umts, CELL).select("event_id", *features.UMTS_FEATURES))


SET_B = ["delta_rscp", "delta_sc", "signal_gap_abs", "active_detected_close", "active_detected_far",
         *[f"{c}_{f}" for c in ("rscp", "ecn0") for f in ("roll_mean", "roll_std", "diff1")],
         *[f"{c}_cell_{f}" for c in ("rscp", "ecn0") for f in ("mean", "min", "max", "std")],
         "n_samples_cell", "rscp_quality_ratio"]


def set_b_sql() -> str:
    cols = [
        "round(rscp - rscp_det, 6) + 0.0 as delta_rscp", "abs(psc - psc_det) as delta_sc",
        "round(abs(rscp - rscp_det), 6) as signal_gap_abs",
        "case when abs(rscp - rscp_det) <= 5 then 1 else 0 end as active_detected_close",
        "case when abs(rscp - rscp_det) >= 15 then 1 else 0 end as active_detected_far",
        "round(rscp / nullif(rscp_det, 0), 6) as rscp_quality_ratio",
        "count(*) over (partition by psc) as n_samples_cell",
    ]
    for c in ("rscp", "ecn0"):
        cols += [
            f"round(avg({c}) over {frame(3)}, 6) as {c}_roll_mean",
            f"round(coalesce(stddev_samp({c}) over {frame(3)}, 0), 6) as {c}_roll_std",
            f"round(coalesce({c} - lag({c}) over (partition by psc order by ts, event_id), 0), 6) + 0.0 as {c}_diff1",
            f"round(avg({c}) over (partition by psc), 6) as {c}_cell_mean",
            f"min({c}) over (partition by psc) as {c}_cell_min", f"max({c}) over (partition by psc) as {c}_cell_max",
            f"round(coalesce(stddev_samp({c}) over (partition by psc), 0), 6) as {c}_cell_std",
        ]
    return f"select event_id, {', '.join(cols)} from umts"


@check("umts_features_notebook", set_b_sql(), ("umts",))
def _(t):
    return rounded(features.umts_features_notebook(t.umts, CELL).select("event_id", *SET_B))


@check("qos_features", """
with l as (select * exclude (rlc_dl) from lte_raw where rsrp is not null),
r as (select event_id as rid, ts as rts, session_id as rs, rlc_dl from lte_raw where rlc_dl is not null),
j as (select l.event_id, r.rlc_dl, row_number() over (partition by l.event_id
    order by abs(epoch_us(ts) - epoch_us(rts)), case when rts > ts then 1 else 0 end, case when rts > ts then rid else -rid end) as rn
  from l join r on l.session_id = r.rs and abs(epoch_us(ts) - epoch_us(rts)) <= 7200000000),
m as (select l.*, j.rlc_dl from l left join j on l.event_id = j.event_id and j.rn = 1)
select event_id, epoch(date_trunc('second', ts))::bigint as time_seconds,
  coalesce(epoch(date_trunc('second', ts))::bigint - lag(epoch(date_trunc('second', ts))::bigint)
    over (partition by session_id order by ts, event_id), 0)::double as time_delta_s,
""" + ", ".join(
    f"round(avg({c}) over f, 6) as {c}_roll_mean_5, round(coalesce(stddev_samp({c}) over f, 0), 6) as {c}_roll_std_5"
    for c in ("rsrp", "rsrq", "rlc_dl")) + """
from m window f as (partition by session_id order by ts, event_id rows between 4 preceding and current row)""",
       ("lte_raw",))
def _(t):
    """On the merged rows, so that throughput has a history too."""
    from radiolens.catalog.joins import merged

    rows = features.qos_features(merged(t), SESSION)
    return rounded(rows.select("event_id", "time_seconds", "time_delta_s", *[
        f"{c}_roll_{f}_5" for c in ("rsrp", "rsrq", "rlc_dl") for f in ("mean", "std")]))


def persist_sql(cond: str, n: int, k: int, out: str) -> str:
    return (f"select event_id, case when sum(case when {cond} then 1 else 0 end) over {frame(n)} >= {k} "
            f"then 1 else 0 end as {out} from umts")


HO_SQL = "coalesce(rscp - rscp_det, 0) < 5 and rscp_det is not null and ecn0 < -10"


@check("persist", persist_sql("ecn0 < -10", 10, 5, "persistent"), ("umts",))
def _(t):
    return labels.persist(t.umts, F.col("ecn0") < -10, 10, 5, CELL).select("event_id", "persistent")


@check("label_interference", persist_sql("ecn0 < -10", 5, 3, "interference"), ("umts",))
def _(t):
    return labels.label_interference(t.umts, CELL).select("event_id", "interference")


def with_gap(df):
    from radiolens.operators.clean import neighbor_flags, signal_gap

    return neighbor_flags(signal_gap(df))


@check("label_handover_needed", persist_sql(HO_SQL, 4, 2, "handover_needed"), ("umts",))
def _(t):
    return labels.label_handover_needed(with_gap(t.umts), CELL).select("event_id", "handover_needed")


QOS_SQL = "case when rscp < -95 or ecn0 < -12 then 1 else 0 end"


@check("label_qos_degraded", f"select event_id, {QOS_SQL} as qos_degradee from umts", ("umts",))
def _(t):
    return labels.label_qos_degraded(t.umts).select("event_id", "qos_degradee")


CONGESTION_SQL = f"""case when sum(case when rscp > -90 and ecn0 < -14 then 1 else 0 end) over {frame(3)} >= 3
  or coalesce(abs(rscp - rscp_det) <= 8 and ecn0 < -13, false) then 1 else 0 end"""


@check("label_congestion", f"select event_id, {CONGESTION_SQL} as congestion_probable from umts", ("umts",))
def _(t):
    return labels.label_congestion(t.umts, CELL).select("event_id", "congestion_probable")


@check("label_outage", f"""
with d as (select *, coalesce(rscp - lag(rscp) over (partition by psc order by ts, event_id), 0) as step from umts)
select event_id, case when sum(case when rscp <= -110 or step <= -15 or ecn0 <= -15 then 1 else 0 end)
  over {frame(3)} >= 3 then 1 else 0 end as panne_probable from d""", ("umts",))
def _(t):
    return labels.label_outage(t.umts, CELL).select("event_id", "panne_probable")


@check("rank_by_time", "select event_id, row_number() over (order by ts, event_id) - 1 as place from umts", ("umts",))
def _(t):
    return split.rank_by_time(t.umts, LOG).select("event_id", "place")


LABELED_SQL = f"""
labeled as (select *,
  case when sum(case when ecn0 < -10 then 1 else 0 end) over {frame(5)} >= 3 then 1 else 0 end as interference,
  case when sum(case when {HO_SQL} then 1 else 0 end) over {frame(4)} >= 2 then 1 else 0 end as handover_needed
  from umts)
"""


def labeled(t):
    return labels.label_umts(with_gap(t.umts), CELL)


def recommend_sql(src: str) -> str:
    return f"""
r as (select psc, avg(interference) as i, avg(handover_needed) as h from {src} where psc is not null group by psc),
recs as (select psc, round_even(i, 3) as interference_rate, round_even(h, 3) as handover_rate,
  case when i > 0.5 then case when h > 0.3 then '{cells.HANDOVER}' else '{cells.INTERFERENCE}' end
       when h > 0.5 then '{cells.OPTIMIZE}' else '{cells.NO_ACTION}' end as recommendation from r)
"""


FLAGSHIP_SQL = "with " + CLEAN_SQL + ", " + LABELED_SQL.replace("from umts)", "from cleaned)").replace(
    "order by ts,", "order by time,") + ", " + recommend_sql("labeled") + "select * from recs"


@check("cell_recommendations", FLAGSHIP_SQL, ("umts_raw",))
def flagship(t):
    """Raw text log to an action per cell: clean, gap, persistence labels, rates, decision."""
    order = replace(CELL, by=("time", "event_id"))
    rows = cleaned(t)
    return cells.cell_recommendations(labels.label_umts(with_gap(rows), order))
