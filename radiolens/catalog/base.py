"""Shared views over the given tables, written once for Spark and for the SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolens.plans.ordered import LogOrder

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS = {
    "umts": """
with b as (
  select event_id, ts, user_id, event_type, value,
         cast(user_id % 25 as int) as psc,
         cast(regexp_extract(props, '([0-9]+)', 1) as int) as k
  from {events}),
a as (
  select *,
         cast(round(greatest(-120.0, -55.0 - value / 3.0), 2) as double) as rscp,
         cast(-2 - (k % 12) - (psc % 5) as double) as ecn0
  from b)
select event_id, ts, psc, rscp, ecn0, k,
       case when psc % 4 = 0 or event_type in ('view', 'click', 'purchase')
            then cast(round(rscp + (k % 21) - case when psc % 4 = 0 then 4 else 14 end, 2) as double) end as rscp_det,
       case when psc % 4 = 0 or event_type in ('view', 'click', 'purchase')
            then cast((user_id * 7 + k) % 512 as int) end as psc_det
from a""",
    "umts_raw": """
with r as (
  select event_id, cast(ts as string) as time_s, cast(psc as string) as psc_s,
         case when k % 23 = 0 then null
              when k % 17 = 0 then 'n/a'
              when k % 10 = 0 then cast(rscp as string) || ', ' || cast(rscp - 3 as string)
              else ' ' || cast(rscp as string) || ' ' end as rscp_s,
         cast(ecn0 as string) as ecn0_s,
         cast(rscp_det as string) as rscp_det_s,
         cast(psc_det as string) as psc_det_s,
         k
  from {umts})
select * from r
union all
select * from r where k % 13 = 0""",
    "lte_raw": """
select event_id, ts, cast(user_id % 25 as int) as session_id,
       cast(user_id % 504 as int) as pci,
       case when event_type <> 'purchase' then
         case user_id % 3 when 0 then 'LTE800' when 1 then 'LTE1800' else 'LTE2600' end end as band,
       case when event_type <> 'purchase' then cast(round(-70.0 - value / 3.0, 2) as double) end as rsrp,
       case when event_type <> 'purchase' then cast(-3 - (event_id % 18) as double) end as rsrq,
       case when event_type = 'purchase' then cast(round(value / 5.0, 2) as double) end as rlc_dl
from {events}""",
    "scored": """
select event_id, ts, psc, k,
       case when sum(case when ecn0 < -10 then 1 else 0 end)
                 over (partition by psc order by ts, event_id rows between 4 preceding and current row) >= 3
            then 1 else 0 end as y_true,
       cast((k % 12 + psc % 5) / 16.0 as double) as y_proba
from {umts}""",
}
NEEDS = {"umts": ("events",), "umts_raw": ("umts",), "lte_raw": ("events",), "scored": ("umts",)}

# Checks run with the library's chunks; those named "chunked" or "keyless" with chunks far below the row count.
SHORT = 997
CELL = LogOrder(by=("ts", "event_id"), keys=("psc",))
SESSION = LogOrder(by=("ts", "event_id"), keys=("session_id",))
LOG = LogOrder(by=("ts", "event_id"))


class Tables:
    """The given tables and the views on them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            frame = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            if name == "events":  # stored without a zone; micros and hours need one
                frame = frame.withColumn("ts", F.col("ts").cast("timestamp"))
            return frame
        if name in VIEWS and name != "scored":
            return self.spark.sql(VIEWS[name], **{n: getattr(self, n) for n in NEEDS[name]})
        raise AttributeError(name)

    @cached_property
    def scored(self) -> DataFrame:
        """Deterministic predictions; the rule label comes from the library's own ordered scan."""
        from radiolens.operators.labels import label_interference

        rows = label_interference(self.umts, CELL)
        return rows.select(
            "event_id", "ts", "psc", "k", F.col("interference").alias("y_true"),
            ((F.col("k") % 12 + F.col("psc") % 5) / 16.0).cast("double").alias("y_proba"),
        )


@dataclass(frozen=True)
class Check:
    run: Callable[[Tables], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}


def with_views(body: str, views: tuple[str, ...]) -> str:
    """Put the needed view definitions in front of ``body`` as common table expressions."""
    names: list[str] = []

    def need(name: str) -> None:
        for inner in NEEDS[name]:
            if inner in VIEWS:
                need(inner)
        if name not in names:
            names.append(name)

    for view in views:
        need(view)
    plain = {n: n for n in (*TABLES, *VIEWS)}
    heads = [f"{n} as ({VIEWS[n].format(**plain)})" for n in names]
    body = body.strip()
    if not heads:
        return body
    if body.lower().startswith("with "):
        return "with " + ",\n".join(heads) + ",\n" + body[5:]
    return "with " + ",\n".join(heads) + "\n" + body


def check(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query under ``name``; ``views`` are the shared views its SQL refers to."""

    def register(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        assert name not in CHECKS, name
        CHECKS[name] = Check(run, with_views(sql, views) if sql else None)
        return run

    return register


def rounded(df: DataFrame, *names: str, n: int = 6) -> DataFrame:
    """Doubles to ``n`` decimals: sums may differ in the last bit between engines."""
    picked = names or tuple(c for c, t in df.dtypes if t == "double")
    return df.withColumns({c: F.round(F.col(c), n) + F.lit(0.0) for c in picked})
