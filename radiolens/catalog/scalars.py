"""Row functions, sorting and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from radiolens.catalog.base import check, rounded
from radiolens.functions import scalar
from radiolens.functions.numbers import round_n
from radiolens.operators import cells
from radiolens.operators.clean import sort_log
from radiolens.plans.stage import materialize


@check("time_parts", "select event_id, hour(ts)::int as hour, minute(ts)::int as minute, second(ts)::int as second from umts",
       ("umts",))
def _(t):
    return scalar.time_parts(t.umts, "ts").select("event_id", "hour", "minute", "second")


@check("is_peak_hour", """select event_id, case when hour(ts) in (7, 8, 9, 17, 18, 19, 20) and k % 9 > 0 then 1 else 0 end
  as is_peak_hour from umts""", ("umts",))
def _(t):
    rows = t.umts.withColumn("ts", F.when(F.col("k") % 9 > 0, F.col("ts")))
    return scalar.is_peak_hour(rows, "ts").select("event_id", "is_peak_hour")


@check("encode_alphabetical", """select event_id, band, case when band is null then -1
  else (dense_rank() over (order by band) - 1)::int end as band_enc from lte_raw""", ("lte_raw",))
def _(t):
    return scalar.encode_alphabetical(t.lte_raw, "band").select("event_id", "band", "band_enc")


@check("decode_label", """select event_id, case k % 6 when 0 then 'Acceptable' when 1 then 'Assez bien'
  when 2 then 'Mauvaise' when 3 then 'Tres bonne' when 4 then '4' else 'other' end as label from umts""", ("umts",))
def _(t):
    code = F.when(F.col("k") % 6 < 5, (F.col("k") % 6).cast("string")).otherwise("other")
    return scalar.decode_label(t.umts.select("event_id", code.alias("code")), "code").select("event_id", "label")


def probabilities(t):
    """Three-class probability maps derived from the log."""
    a, b = F.col("k") % 7 + 1, F.col("psc") % 5 + 1
    c = F.col("k") % 3 + 1
    total = (a + b + c).cast("double")
    return t.umts.select("event_id", "k", "psc", F.when(F.col("k") % 11 > 0, F.map_from_arrays(
        F.array(F.lit("Bonne"), F.lit("Mauvaise"), F.lit("Moyenne")), F.array(a / total, b / total, c / total)
    )).alias("probs"))


P = """
p as (select event_id, k, psc, (k % 7 + 1) / (k % 7 + psc % 5 + k % 3 + 3)::double as p1,
  (psc % 5 + 1) / (k % 7 + psc % 5 + k % 3 + 3)::double as p2,
  (k % 3 + 1) / (k % 7 + psc % 5 + k % 3 + 3)::double as p3 from umts)
"""


@check("confidence_pct", "with " + P + """select event_id, case when k % 11 > 0 then round(greatest(p1, p2, p3) * 100, 2) end
  as confidence from p""", ("umts",))
def _(t):
    return scalar.confidence_pct(probabilities(t), "probs").select("event_id", "confidence")


@check("confidence_band", "with " + P + """, c as (select event_id, case when k % 11 > 0 then greatest(p1, p2, p3) * 130 end as c from p)
select event_id, case when coalesce(c, 0) >= 85 then 'high' when coalesce(c, 0) >= 70 then 'medium' else 'low' end
  as confidence_band from c""", ("umts",))
def _(t):
    rows = probabilities(t).withColumn("c", F.array_max(F.map_values("probs")) * 130)
    return scalar.confidence_band(rows, "c").select("event_id", "confidence_band")


@check("format_probabilities", "with " + P + """select event_id, case when k % 11 > 0 then
  printf('Bonne: %.2f%%, Mauvaise: %.2f%%, Moyenne: %.2f%%', round(p1 * 100, 2), round(p2 * 100, 2), round(p3 * 100, 2))
  else 'N/A' end as probability_text from p""", ("umts",))
def _(t):
    return scalar.format_probabilities(probabilities(t), "probs").select("event_id", "probability_text")


@check("top_probabilities", "with " + P + """,
e as (select event_id, 'Bonne' as label, p1 as p, 0 as i from p where k % 11 > 0 union all
  select event_id, 'Mauvaise', p2, 1 from p where k % 11 > 0 union all select event_id, 'Moyenne', p3, 2 from p where k % 11 > 0),
r as (select *, row_number() over (partition by event_id order by p desc, i) as n from e)
select event_id, n::int as place, label, round(p, 6) as p from r where n <= 2""", ("umts",))
def _(t):
    rows = scalar.top_probabilities(probabilities(t), "probs", 2)
    out = rows.select("event_id", F.posexplode("top").alias("place", "e")).select(
        "event_id", (F.col("place") + 1).alias("place"), F.col("e.key").alias("label"), F.col("e.value").alias("p"))
    return rounded(out)


@check("round_n", """select event_id, round_even(rscp * 8, 0) / 8 as rscp_8, round_even(k / 2.0::double, 0) as half_k,
  round_even(k / 8.0::double, 2) as eighth_k from umts""", ("umts",))
def _(t):
    """All rows; every second ``half_k`` and ``eighth_k`` lies on a half and goes to the even neighbor."""
    rows = t.umts.select("event_id", (F.col("rscp") * 8).alias("rscp_8"), (F.col("k") / 2).alias("half_k"), (F.col("k") / 8).alias("eighth_k"))
    rows = round_n(round_n(rows, ["rscp_8", "half_k"], 0), ["eighth_k"], 2)
    return rows.withColumn("rscp_8", F.col("rscp_8") / 8)


@check("sort_log", """select event_id, psc, row_number() over (order by psc, ts, event_id) - 1 as place
  from umts""", ("umts",))
def _(t):
    """By cell, then time; the place is read off the sorted rows as they stand, partition after partition."""
    rows = sort_log(t.umts, ["psc", "ts", "event_id"]).select("event_id", "psc", F.monotonically_increasing_id().alias("_at"))
    rows = materialize(rows.withColumn("_part", F.shiftright("_at", 33)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = rows.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(starts, "_part").select("event_id", "psc", place.alias("place"))


@check("top_n_cells", """select psc, count(*) as n, round(avg(ecn0), 6) as ecn0_mean from umts group by psc
  order by n desc, psc limit 10""", ("umts",))
def _(t):
    grouped = t.umts.groupBy("psc").agg(F.count(F.lit(1)).alias("n"), F.avg("ecn0").alias("ecn0_mean"))
    return rounded(cells.top_n_cells(grouped, "n", 10))
