"""As-of join: nearest row in time within a tolerance.

Bucketing the time and joining buckets pairs every left with every right row of a bucket, which is
quadratic where a bucket is hot.  Both logs are merged into one ordered log instead; the nearest
throughput row before and after each radio row is carried along it (``plans.ordered.carry``), so
the work is linear in the rows and hot keys are split into chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolens.plans.ordered import LogOrder, carry


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    on: str,
    tolerance_s: float,
    by: Sequence[str] = (),
    tie: str = "event_id",
    plan: str = "chunked",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Left rows with the columns of the nearest right row, NULL where none is near enough.

    The tolerance is inclusive; at equal distance the earlier row wins.  Among right rows of the
    same time the last one (by ``tie``) is taken on the past side, the first one on the future side.
    """
    values = [c for c in right.columns if c not in (on, tie, *by)]
    payload = F.struct(F.col(on).alias("_at"), *[F.col(c) for c in values])
    lefts = left.select("*", F.lit(1).alias("_side"), F.lit(None).alias("_hit"))
    rights = right.select(*by, on, tie, F.lit(0).alias("_side"), payload.alias("_hit"))
    merged = lefts.unionByName(rights, allowMissingColumns=True)
    extra = {} if chunk_rows is None else {"chunk_rows": chunk_rows}
    order = LogOrder(by=(on, "_side", tie), keys=tuple(by), plan=plan, **extra)
    near = carry(merged, order, "_hit", {"_past": True, "_next": False}).where(F.col("_side") == 1)

    def gap(column):
        return F.abs(F.unix_micros(F.col(f"{column}._at")) - F.unix_micros(on))

    def within(column):
        return F.coalesce(gap(column) <= int(tolerance_s * 1_000_000), F.lit(False))

    past_wins = within("_past") & ~F.coalesce(gap("_next") < gap("_past"), F.lit(False))
    best = F.when(past_wins, F.col("_past")).when(within("_next"), F.col("_next"))
    return near.withColumn("_best", best).select(
        *left.columns, *[F.col(f"_best.{c}").alias(c) for c in values]
    )


def asof_join_clean(
    left: DataFrame, right: DataFrame, on: str, tolerance_s: float, by: Sequence[str] = (),
    tie: str = "event_id", **plan,
) -> DataFrame:
    """As-of join, rows without a partner (or any other NULL) dropped, copies dropped."""
    return asof_nearest(left, right, on, tolerance_s, by, tie, **plan).dropna().dropDuplicates()


def best_model_join(comparison: DataFrame, selection: DataFrame) -> DataFrame:
    """Comparison rows of the selected model of each task."""
    return comparison.join(selection.select("task", "model"), ["task", "model"], "inner")
