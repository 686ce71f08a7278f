"""Projections, filters and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from radiolens.catalog.base import LOG, check, rounded
from radiolens.functions.numbers import scalar_math
from radiolens.operators import clean, features, requests

SHORT = {
    "time_s": "time", "psc_s": "psc", "rscp_s": "rscp", "ecn0_s": "ecn0",
    "rscp_det_s": "rscp_det", "psc_det_s": "psc_det",
}
NUM = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def sql_number(text: str) -> str:
    return f"case when regexp_matches(trim({text}), {NUM}) then try_cast(trim({text}) as double) end"


def sql_first(text: str) -> str:
    return f"case when {text} like '%,%' then trim(split_part({text}, ',', 1)) else {text} end"


CLEAN_SQL = f"""
n as (
  select distinct event_id, try_cast(time_s as timestamp) as time, k,
         {sql_number(sql_first('psc_s'))} as psc, {sql_number(sql_first('rscp_s'))} as rscp,
         {sql_number(sql_first('ecn0_s'))} as ecn0, {sql_number(sql_first('rscp_det_s'))} as rscp_det,
         {sql_number(sql_first('psc_det_s'))} as psc_det
  from umts_raw),
cleaned as (
  select event_id, time, k, psc, rscp_det, psc_det,
         case when rscp is not null then greatest(-120.0, least(-25.0, rscp)) end::double as rscp,
         case when ecn0 is not null then greatest(-30.0, least(5.0, ecn0)) end::double as ecn0
  from n where time is not null and psc is not null and rscp is not null and ecn0 is not null)
"""


def cleaned(t):
    return clean.clean_umts(clean.rename_columns(t.umts_raw, SHORT))


@check("rename_columns", """select event_id, k, time_s as time, psc_s as psc, rscp_s as rscp,
  ecn0_s as ecn0, rscp_det_s as rscp_det, psc_det_s as psc_det from umts_raw""", ("umts_raw",))
def _(t):
    return clean.rename_columns(t.umts_raw, SHORT)


@check("drop_blank_rows", """
with b as (select event_id, case when k % 7 = 0 then '  ' else rscp_s end as rscp_s,
                  case when k % 14 = 0 then '' else ecn0_s end as ecn0_s from umts_raw)
select * from b where not (coalesce(trim(rscp_s) = '', false) and coalesce(trim(ecn0_s) = '', false))
""", ("umts_raw",))
def _(t):
    rows = t.umts_raw.select(
        "event_id",
        F.when(F.col("k") % 7 == 0, "  ").otherwise(F.col("rscp_s")).alias("rscp_s"),
        F.when(F.col("k") % 14 == 0, "").otherwise(F.col("ecn0_s")).alias("ecn0_s"),
    )
    return clean.drop_blank_rows(rows, ["rscp_s", "ecn0_s"])


@check("first_of_multi", f"select event_id, {sql_first('rscp_s')} as rscp_s from umts_raw", ("umts_raw",))
def _(t):
    return clean.first_of_multi(t.umts_raw.select("event_id", "rscp_s"), ["rscp_s"])


WIDE = """case k % 29 when 3 then '1e100' when 4 then '-2.5E-120' when 5 then '1e400' when 6 then '1e' else rscp_s end"""


@check("to_numeric", f"""with w as (select event_id, {WIDE} as rscp_s, psc_det_s, k * 1e150::double as k from umts_raw)
select event_id, case when abs({sql_number('rscp_s')}) < 'infinity'::double then {sql_number('rscp_s')} end as rscp_s,
  {sql_number('psc_det_s')} as psc_det_s, k from w""", ("umts_raw",))
def _(t):
    """Text with any exponent (what overflows is missing), and a column of doubles, which stays as it is."""
    rows = t.umts_raw.select("event_id", F.expr(WIDE).alias("rscp_s"), "psc_det_s", (F.col("k") * F.lit(1e150)).alias("k"))
    return clean.to_numeric(rows, ["rscp_s", "psc_det_s", "k"])


@check("parse_time_of_day", r"""
with s as (select event_id, regexp_extract(case when k % 9 = 0 then 'bad' else 'at ' || time_s end,
             '[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\.[0-9]{1,6}') as t from umts_raw)
select event_id, strftime(try_cast('1970-01-01 ' || nullif(t, '') as timestamp), '%Y-%m-%d %H:%M:%S.%f') as time
from s""", ("umts_raw",))
def _(t):
    text = F.when(F.col("k") % 9 == 0, "bad").otherwise(F.concat(F.lit("at "), "time_s"))
    rows = clean.parse_time_of_day(t.umts_raw.select("event_id", text.alias("time")), "time")
    return rows.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@check("parse_timestamp", """
select event_id, strftime(try_cast(case when k % 9 = 0 then 'n/a' when k % 9 = 1
         then replace(left(time_s, 19), ' ', 'T') else time_s end as timestamp), '%Y-%m-%d %H:%M:%S.%f') as time
from umts_raw""", ("umts_raw",))
def _(t):
    text = (
        F.when(F.col("k") % 9 == 0, "n/a")
        .when(F.col("k") % 9 == 1, F.replace(F.left("time_s", F.lit(19)), F.lit(" "), F.lit("T")))
        .otherwise(F.col("time_s"))
    )
    rows = clean.parse_timestamp(t.umts_raw.select("event_id", text.alias("time")), "time")
    return rows.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@check("drop_missing", "select * exclude (ts) from umts where rscp_det is not null and psc_det is not null",
       ("umts",))
def _(t):
    return clean.drop_missing(t.umts.drop("ts"), ["rscp_det", "psc_det"])


@check("drop_duplicate_rows", "select distinct * from umts_raw", ("umts_raw",))
def _(t):
    return clean.drop_duplicate_rows(t.umts_raw)


@check("clip", """select event_id, case when rscp_det is not null
  then greatest(-90.0, least(-60.0, rscp_det)) end::double as rscp_det from umts""", ("umts",))
def _(t):
    return clean.clip(t.umts.select("event_id", "rscp_det"), "rscp_det", -90.0, -60.0)


@check("split_streams", """
select event_id, 'radio' as stream, rsrp as reading from lte_raw where rsrp is not null and ts is not null
union all
select event_id, 'throughput', rlc_dl from lte_raw where rlc_dl is not null and ts is not null
""", ("lte_raw",))
def _(t):
    radio, throughput = clean.split_streams(t.lte_raw)
    return radio.select("event_id", F.lit("radio").alias("stream"), F.col("rsrp").alias("reading")).unionByName(
        throughput.select("event_id", F.lit("throughput").alias("stream"), F.col("rlc_dl").alias("reading"))
    )


@check("clean_umts", "with " + CLEAN_SQL + """
select * replace (strftime(time, '%Y-%m-%d %H:%M:%S.%f') as time) from cleaned""", ("umts_raw",))
def _(t):
    return cleaned(t).withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@check("clean_umts_notebook", f"""
with n as (select distinct event_id, try_cast(time_s as timestamp) as time, {sql_number('psc_s')} as sc_act,
  {sql_number('rscp_s')} as rscp_act, {sql_number('ecn0_s')} as ecn0_act, {sql_number('rscp_det_s')} as rscp_det,
  {sql_number('psc_det_s')} as sc_det, k from umts_raw)
select * exclude (time), hour(time)::int as hour, minute(time)::int as minute, second(time)::int as second,
  case when hour(time) in (7, 8, 9, 17, 18, 19, 20) then 1 else 0 end as is_peak_hour from n""", ("umts_raw",))
def _(t):
    names = {"time_s": "time", "psc_s": "sc_act", "rscp_s": "rscp_act", "ecn0_s": "ecn0_act",
             "rscp_det_s": "rscp_det", "psc_det_s": "sc_det"}
    return clean.clean_umts_notebook(clean.rename_columns(t.umts_raw, names)).drop("time")


@check("signal_gap", """select event_id, round(coalesce(rscp - rscp_det, 0.0), 6) as delta_rscp,
  round(rscp - rscp_det, 6) as delta_rscp_or_null from umts""", ("umts",))
def _(t):
    rows = clean.signal_gap(clean.signal_gap(t.umts), fill=None, out="delta_rscp_or_null")
    return rounded(rows.select("event_id", "delta_rscp", "delta_rscp_or_null"))


@check("neighbor_flags", """select event_id, case when rscp_det is null then 0 else 1 end as has_neighbor,
  abs(psc - psc_det) as delta_sc, round(abs(rscp - rscp_det), 6) as signal_gap_abs,
  case when abs(rscp - rscp_det) <= 5 then 1 else 0 end as active_detected_close,
  case when abs(rscp - rscp_det) >= 15 then 1 else 0 end as active_detected_far from umts""", ("umts",))
def _(t):
    rows = clean.neighbor_flags(t.umts)
    return rounded(rows.select("event_id", "has_neighbor", "delta_sc", "signal_gap_abs",
                               "active_detected_close", "active_detected_far"))


@check("quality_ratio", """select event_id, round(rscp / nullif(case when k % 5 = 0 then 0.0 else rscp_det end, 0), 6)
  as rscp_quality_ratio from umts""", ("umts",))
def _(t):
    zeroed = t.umts.withColumn("rscp_det", F.when(F.col("k") % 5 == 0, 0.0).otherwise(F.col("rscp_det")))
    return rounded(clean.quality_ratio(zeroed).select("event_id", "rscp_quality_ratio"))


@check("coverage_zone", """select event_id, rsrp, case when rsrp >= -80 then 'Tres bonne' when rsrp >= -90 then 'Bonne'
  when rsrp >= -100 then 'Moyenne' else 'Mauvaise' end as coverage_zone from lte_raw where rsrp is not null""",
       ("lte_raw",))
def _(t):
    radio, _ = clean.split_streams(t.lte_raw)
    return clean.coverage_zone(radio.select("event_id", "rsrp"))


def feature_maps(t):
    """Requests with all, some or foreign keys, built from the log."""
    full = ["rsrp", "rsrq", "rlc_downlink_throughput", "band", "physical_cell_identity"]
    keys = (
        F.when(F.col("k") % 3 == 0, F.array(*[F.lit(x) for x in full]))
        .when(F.col("k") % 3 == 1, F.array(*[F.lit(x) for x in full[:3]]))
        .otherwise(F.array(*[F.lit(x) for x in [*full, "extra"]]))
    )
    return t.umts.select(
        "event_id", F.map_from_arrays(keys, F.transform(keys, lambda x: F.col("rscp"))).alias("features")
    )


@check("route_task", """select event_id, case when k % 3 = 1 then 'coverage' else 'qos' end as task from umts""",
       ("umts",))
def _(t):
    return requests.route_task(feature_maps(t), "features").select("event_id", "task")


@check("check_features", """select event_id,
  case when k % 3 = 1 then 'band,physical_cell_identity' else '' end as missing,
  case when k % 3 = 2 then 'extra' else '' end as extra, k % 3 = 0 as accepted from umts""", ("umts",))
def _(t):
    rows = requests.check_features(feature_maps(t), "features", requests.QOS_KEYS)
    return rows.select(
        "event_id", F.array_join("missing", ",").alias("missing"),
        F.array_join("extra", ",").alias("extra"), "accepted",
    )


@check("coerce_inputs", f"""select event_id,
  case when coalesce(trim(rscp_s), '') = '' then 0.0 else {sql_number('rscp_s')} end as rscp_s,
  case when coalesce(trim(psc_det_s), '') = '' then 0.0 else {sql_number('psc_det_s')} end as psc_det_s,
  case when coalesce(trim(rscp_s), '') <> '' and {sql_number('rscp_s')} is null then 'rscp_s' else '' end as invalid
from umts_raw""", ("umts_raw",))
def _(t):
    rows = requests.coerce_inputs(t.umts_raw.select("event_id", "rscp_s", "psc_det_s"), ["rscp_s", "psc_det_s"])
    return rows.withColumn("invalid", F.array_join("invalid", ","))


def _bound(name: str) -> str:
    lo, hi = requests.BOUNDS[name]
    return f"select '{name}' as feature, {name}::double as x, {lo}::double as lo, {hi}::double as hi from g"


HISTORY = ", ".join(
    f"lag({c}, {k}) over w as {c}_lag{k}" for c in ("rsrp", "rsrq", "rlc_dl") for k in (1, 2)
) + ", " + ", ".join(
    f"avg({c}) over (w rows between {n - 1} preceding and current row) as {c}_roll{n}" for c in ("rsrp", "rsrq", "rlc_dl") for n in (3, 5)
)


@check("range_audit", f"""
with g as (select *, case when band is null then -1 else dense_rank() over (order by band nulls last) - 1 end as band_enc,
  hour(ts) as hour, minute(ts) as minute, second(ts) as second, {HISTORY} from lte_raw window w as (order by ts, event_id)),
v as ({" union all ".join(map(_bound, requests.BOUNDS))})
select feature, count(x) as n, count(*) filter (x < lo) as below, count(*) filter (x > hi) as above
from v group by feature""", ("lte_raw",))
def _(t):
    """All 20 bounds over the coverage features of the raw log."""
    return requests.range_audit(features.coverage_features(t.lte_raw, LOG, drop_first=False))


@check("scalar_math", """select event_id, abs(rscp) as level, greatest(-20.0, least(-5.0, ecn0))::double as quality,
  round(rscp / ecn0, 6) as per_db from umts""", ("umts",))
def _(t):
    from radiolens.functions.numbers import bounded, ratio

    rows = scalar_math(t.umts, {
        "level": F.abs("rscp"), "quality": bounded("ecn0", -20.0, -5.0),
        "per_db": ratio(F.col("rscp"), F.col("ecn0")),
    })
    return rounded(rows.select("event_id", "level", "quality", "per_db"), "per_db")
