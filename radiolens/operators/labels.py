"""Rule labels with persistence: a condition counts when it holds often enough in recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolens.functions.numbers import flag
from radiolens.operators.features import difference, in_cell
from radiolens.plans.ordered import LogOrder, prepared, windowed


def _persistent(cond: Column, n: int, k: int, spec, order: LogOrder) -> Column:
    hits = F.sum(flag(cond)).over(spec.rowsBetween(-(n - 1), 0))
    return in_cell(order, (hits >= k).cast("int"), F.lit(0))


def persist(
    df: DataFrame, cond: Column, n: int, k: int, order: LogOrder, out: str = "persistent"
) -> DataFrame:
    """1 where ``cond`` held in at least ``k`` of the last ``n`` rows of the key."""
    return windowed(df, order, n - 1, lambda w: {out: _persistent(cond, n, k, w, order)})


def label_interference(
    df: DataFrame, order: LogOrder, cut: float = -10.0, n: int = 5, k: int = 3
) -> DataFrame:
    return persist(df, F.col("ecn0") < cut, n, k, order, "interference")


def label_handover_needed(
    df: DataFrame, order: LogOrder, gap: float = 5.0, cut: float = -10.0, n: int = 4, k: int = 2
) -> DataFrame:
    """Needs ``delta_rscp`` and ``has_neighbor`` of the feature set."""
    cond = (F.col("delta_rscp") < gap) & (F.col("has_neighbor") == 1) & (F.col("ecn0") < cut)
    return persist(df, cond, n, k, order, "handover_needed")


def label_umts(df: DataFrame, order: LogOrder) -> DataFrame:
    """Both UMTS labels from one window pass."""
    bad = F.col("ecn0") < -10.0
    handover = (F.col("delta_rscp") < 5.0) & (F.col("has_neighbor") == 1) & bad
    return windowed(
        df, order, 4,
        lambda w: {
            "interference": _persistent(bad, 5, 3, w, order),
            "handover_needed": _persistent(handover, 4, 2, w, order),
        },
    )


def label_qos_degraded(df: DataFrame, rscp: float = -95.0, ecn0: float = -12.0) -> DataFrame:
    poor = F.coalesce(F.col("rscp") < rscp, F.lit(False)) | F.coalesce(
        F.col("ecn0") < ecn0, F.lit(False)
    )
    return df.withColumn("qos_degradee", poor.cast("int"))


def label_congestion(df: DataFrame, order: LogOrder, n: int = 3) -> DataFrame:
    """Good level with poor quality for ``n`` rows, or an ambiguous neighbor with poor quality now."""
    streak = (F.col("rscp") > -90.0) & (F.col("ecn0") < -14.0)
    context = flag(
        (F.abs(F.col("rscp") - F.col("rscp_det")) <= 8.0) & (F.col("ecn0") < -13.0)
    )
    return windowed(
        df, order, n - 1,
        lambda w: {
            "congestion_probable": F.greatest(_persistent(streak, n, n, w, order), context)
        },
    )


def label_outage(df: DataFrame, order: LogOrder, n: int = 3) -> DataFrame:
    """Very low level, a sharp drop or very poor quality in each of the last ``n`` rows."""
    stepped = windowed(prepared(df, order), order, 1, lambda w: {"_drop": difference("rscp", w, order)})

    def at(predicate: Column) -> Column:
        return F.coalesce(predicate, F.lit(False))

    severe = at(F.col("rscp") <= -110.0) | at(F.col("_drop") <= -15.0) | at(F.col("ecn0") <= -15.0)
    labeled = persist(stepped, severe, n, n, order, "panne_probable").drop("_drop")
    return labeled if order.index in df.columns else labeled.drop(order.index)
