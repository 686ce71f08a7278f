"""Streams drained into tables: the events arrive in time order, four batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from radiolens.catalog.base import check, rounded
from radiolens.catalog.models import COVERED, coverage_table
from radiolens.catalog.windows import HO_SQL, frame
from radiolens.plans.stage import scratch_path
from radiolens.streaming import live

BATCHES = 4
FILES = 4  # a batch


def arriving(t, frame_, name: str):
    """Write ``frame_`` as files that arrive in time order and read them as a stream.

    Two late batches without rows of the log (negative event ids, cell -1) move the watermark past it.
    """
    path = scratch_path(t.spark, name)
    span = t.events.agg(F.struct(F.unix_micros(F.min("ts")).alias("lo"), F.unix_micros(F.max("ts")).alias("hi")).alias("s")).scalar()
    part = F.least(F.floor((F.unix_micros("ts") - span["lo"]) / (span["hi"] - span["lo"] + 1) * BATCHES), F.lit(BATCHES - 1))
    for i in range(BATCHES):  # one after another: a file stream orders its files by their time
        frame_.where(part == i).repartition(FILES).write.mode("append").parquet(path)
    for i in (1, 2):
        late = {"ts": F.timestamp_micros(span["hi"] + i * 3 * 3_600_000_000), "event_id": -F.col("event_id") - 10 * i, "psc": F.lit(-1)}
        last = frame_.limit(FILES).withColumns({c: x.cast(frame_.schema[c].dataType) for c, x in late.items() if c in frame_.columns})
        last.repartition(FILES).write.mode("append").parquet(path)
    return t.spark.readStream.schema(frame_.schema).option("maxFilesPerTrigger", FILES).parquet(path)


FEATURE_SQL = f"""
with f as (select event_id, psc,
  round(avg(rscp) over {frame(5)}, 6) as rscp_rmean_5, round(avg(rscp) over {frame(10)}, 6) as rscp_rmean_10,
  round(avg(ecn0) over {frame(5)}, 6) as ecn0_rmean_5, round(avg(ecn0) over {frame(10)}, 6) as ecn0_rmean_10,
  round(coalesce(stddev_samp(ecn0) over {frame(5)}, 0), 6) as ecn0_rstd_5,
  round(coalesce(rscp - lag(rscp) over (partition by psc order by ts, event_id), 0), 6) + 0.0 as rscp_diff,
  coalesce(ecn0 - lag(ecn0) over (partition by psc order by ts, event_id), 0.0) + 0.0 as ecn0_diff,
  case when sum(case when ecn0 < -10 then 1 else 0 end) over {frame(5)} >= 3 then 1 else 0 end as interference,
  case when sum(case when {HO_SQL} then 1 else 0 end) over {frame(4)} >= 2 then 1 else 0 end as handover_needed
  from (select * replace (case when k % 31 = 0 then null else psc end as psc) from umts))
select event_id, psc, {", ".join(f"case when psc is not null then {c} end as {c}" for c in ("rscp_rmean_5", "rscp_rmean_10", "ecn0_rmean_5", "ecn0_rmean_10"))},
  {", ".join(f"case when psc is not null then {c} else 0 end as {c}" for c in ("ecn0_rstd_5", "rscp_diff", "ecn0_diff", "interference", "handover_needed"))}
from f"""


@check("stream_features", FEATURE_SQL, ("umts",))
def _(t):
    """Every row of the log, those without a cell too."""
    rows = t.umts.withColumn("psc", F.when(F.col("k") % 31 > 0, F.col("psc")))
    with live.rocksdb(t.spark):
        rows = live.drain(live.stream_features(arriving(t, rows, "umts-arriving")), scratch_path(t.spark, "features"))
    return rounded(rows.where(F.col("event_id") >= 0).drop("ts"))


@check("stream_cell_stats", """
with w as (select time_bucket(interval 15 minutes, ts, timestamp '2000-01-01') as ws, psc, count(rscp) as n_samples,
  round(avg(rscp), 6) as rscp_mean, round(stddev_samp(rscp), 6) as rscp_std, round(avg(ecn0), 6) as ecn0_mean,
  round(stddev_samp(ecn0), 6) as ecn0_std from umts group by all)
select strftime(ws, '%Y-%m-%d %H:%M:%S') as window_start, psc, n_samples, rscp_mean, rscp_std, ecn0_mean, ecn0_std
from w""", ("umts",))
def _(t):
    rows = live.drain(live.stream_cell_stats(arriving(t, t.umts, "umts-arriving")), scratch_path(t.spark, "stats"))
    return rounded(rows.where(F.col("psc") >= 0).drop("window_end")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@check("stream_dedup", "select distinct event_id, psc_s, rscp_s, k from umts_raw", ("umts_raw",))
def _(t):
    stamped = t.umts_raw.withColumn("ts", F.to_timestamp("time_s"))
    rows = live.drain(live.stream_dedup(arriving(t, stamped, "raw-arriving"), ["event_id"]), scratch_path(t.spark, "unique"))
    return rows.where(F.col("event_id") >= 0).select("event_id", "psc_s", "rscp_s", "k")


@check("stream_score", COVERED + "select event_id, true as same, true as sure from covered", ("lte_raw",))
def _(t):
    """Scores in flight by a model fitted on the stored rows equal those of the stored rows."""
    from radiolens.operators.score import score
    from radiolens.operators.features import COVERAGE_FEATURES
    from radiolens.operators.train import train_coverage_forest

    rows = coverage_table(t)
    model, labels = train_coverage_forest(rows, COVERAGE_FEATURES)
    path = scratch_path(t.spark, "features-arriving")
    rows.write.parquet(path)
    stream = t.spark.readStream.schema(rows.schema).parquet(path)
    flown = live.drain(live.stream_score(model, stream, labels), scratch_path(t.spark, "scores"))
    stored = score(model, rows, labels).select("event_id", F.col("predicted_class").alias("c"), F.col("confidence").alias("p"))
    return flown.join(stored, "event_id").select(
        "event_id", (F.col("predicted_class") == F.col("c")).alias("same"), (F.col("confidence") == F.col("p")).alias("sure"))
