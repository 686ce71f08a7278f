"""Engineering rules on radio logs: bands, diagnoses, time-based alarms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolens.functions.numbers import flag
from radiolens.operators.features import in_cell, rolling_std
from radiolens.operators.labels import persist
from radiolens.plans.ordered import LogOrder, carry, prepared, running_total, windowed

# Lower bounds of the level and quality bands ("above" for the first one).
RSCP_BANDS = (("Excellent", -75.0), ("Good", -85.0), ("Fair", -95.0), ("Poor", -110.0), ("Critical", None))
ECN0_BANDS = (("Excellent", -5.0), ("Good", -10.0), ("Degraded", -14.0), ("Poor", -18.0), ("Critical", None))
# Diagnosis by level (> -80, -80..-90, < -90) and quality (> -5, -5..-10, < -10).
DIAGNOSES = (
    ("Optimal", "Good", "Interference"),
    ("Good coverage", "Fair", "Interference + coverage mix"),
    ("Rare", "Unclassified", "Coverage hole"),
)
# Quality classes and the lower bounds of RSRP, RSRQ and throughput (best to third).
GUIDE_CLASSES = ("Tres bonne", "Acceptable", "Assez bien", "Mauvaise")
GUIDE_CUTS = {"rsrp": (-80.0, -95.0, -105.0), "rsrq": (-7.0, -11.0, -15.0), "rlc_dl": (20.0, 5.0, 1.0)}
# Fixed values: (kpi, band, from inclusive, to exclusive) in percent, dBm or milliseconds.
KPI_BANDS = (
    ("dch_bler", "target", None, 10.0), ("dch_bler", "alert", 10.0, 15.0), ("dch_bler", "critical", 15.0, None),
    ("hs_dsch_bler", "target", None, 15.0), ("hs_dsch_bler", "alert", 15.0, 25.0),
    ("hs_dsch_bler", "critical", 25.0, None),
    ("hsdpa_user_mbps", "poor", None, 1.0), ("hsdpa_user_mbps", "acceptable", 1.0, 2.0),
    ("hsdpa_user_mbps", "good", 2.0, None),
    ("hsdpa_cqi", "poor", None, 15.0), ("hsdpa_cqi", "acceptable", 15.0, 20.0), ("hsdpa_cqi", "good", 20.0, None),
    ("uplink_bler", "good", None, 10.0), ("uplink_bler", "acceptable", 10.0, 20.0), ("uplink_bler", "poor", 20.0, None),
    ("soft_ho_success", "critical", None, 95.0), ("soft_ho_success", "alert", 95.0, 99.0),
    ("soft_ho_success", "target", 99.0, None),
    ("hard_ho_success", "critical", None, 90.0), ("hard_ho_success", "alert", 90.0, 98.0),
    ("hard_ho_success", "target", 98.0, None),
    ("ho_preparation_ms", "target", None, 200.0), ("ho_preparation_ms", "alert", 200.0, 500.0),
    ("ho_preparation_ms", "critical", 500.0, None),
    ("ping_pong_rate", "target", None, 2.0), ("ping_pong_rate", "alert", 2.0, 5.0),
    ("ping_pong_rate", "critical", 5.0, None),
    ("active_set_size", "target", None, 3.0), ("active_set_size", "alert", 3.0, 4.0),
    ("active_set_size", "critical", 4.0, None),
    ("rtwp_dbm", "normal", None, -102.0), ("rtwp_dbm", "high load", -102.0, -98.0), ("rtwp_dbm", "congested", -98.0, None),
    ("call_setup_success", "critical", None, 95.0), ("call_setup_success", "alert", 95.0, 98.0),
    ("call_setup_success", "target", 98.0, None),
    ("call_drop_rate", "target", None, 2.0), ("call_drop_rate", "alert", 2.0, 3.0),
    ("call_drop_rate", "critical", 3.0, None),
)


def _banded(value: Column, bands: Sequence[tuple[str, float | None]]) -> Column:
    first, cut = bands[0]
    out = F.when(value > cut, first)
    for name, low in bands[1:-1]:
        out = out.when(value >= low, name)
    return out.when(value.isNotNull(), bands[-1][0])


def rscp_band(df: DataFrame, column: str = "rscp", out: str = "rscp_band") -> DataFrame:
    return df.withColumn(out, _banded(F.col(column), RSCP_BANDS))


def ecn0_band(df: DataFrame, column: str = "ecn0", out: str = "ecn0_band") -> DataFrame:
    return df.withColumn(out, _banded(F.col(column), ECN0_BANDS))


def radio_diagnosis(
    df: DataFrame, rscp: str = "rscp", ecn0: str = "ecn0", out: str = "diagnosis"
) -> DataFrame:
    def quality(names: Sequence[str]) -> Column:
        q = F.col(ecn0)
        return F.when(q > -5, names[0]).when(q >= -10, names[1]).when(q.isNotNull(), names[2])

    level = F.col(rscp)
    diagnosis = (
        F.when(level > -80, quality(DIAGNOSES[0]))
        .when(level >= -90, quality(DIAGNOSES[1]))
        .when(level.isNotNull(), quality(DIAGNOSES[2]))
    )
    return df.withColumn(out, diagnosis)


def qos_guideline_class(
    df: DataFrame, rsrp: str = "rsrp", rsrq: str = "rsrq", rlc: str = "rlc_dl", out: str = "qos_class"
) -> DataFrame:
    """Worst class of the three values; missing values do not count."""

    def grade(column: str, cuts: Sequence[float]) -> Column:
        v = F.col(column)
        return F.when(v > cuts[0], 0).when(v >= cuts[1], 1).when(v >= cuts[2], 2).when(v.isNotNull(), 3)

    worst = F.greatest(*[grade(c, cuts) for c, cuts in zip((rsrp, rsrq, rlc), GUIDE_CUTS.values())])
    return df.withColumn(out, F.try_element_at(F.array(*[F.lit(c) for c in GUIDE_CLASSES]), worst + 1))


def persistent_interference(
    df: DataFrame, order: LogOrder, n: int = 10, k: int = 5, cut: float = -10.0
) -> DataFrame:
    return persist(df, F.col("ecn0") < cut, n, k, order, "persistent_interference")


def trailing_max(df: DataFrame, key: str, value: str, seconds: float, time: str = "ts") -> DataFrame:
    """(key, at, peak): maximum over the ``seconds`` before each instant of each key, inclusive.

    Equal instants are combined first.  Time is cut into tiles as long as the frame, so a frame is
    the tail of one tile and the head of the next; both come from running maxima.  No frame is
    rescanned per row, and a tile holds at most one row per microsecond, however hot the key is.
    """
    span = int(seconds * 1_000_000)
    peaks = (
        df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
        .groupBy(key, F.unix_micros(F.col(time)).alias("at"))
        .agg(F.max(value).alias("_v"))
        .withColumn("_tile", F.floor(F.col("at") / span))
    )
    moved = peaks.select(
        key, (F.col("at") + span).alias("at"), (F.col("_tile") + 1).alias("_tile"),
        F.lit(None).cast("double").alias("_v"), F.col("_v").alias("_old"), F.lit(0).alias("_side"),
    )
    both = peaks.withColumns({"_old": F.lit(None).cast("double"), "_side": F.lit(1)}).unionByName(moved)
    tile = Window.partitionBy(key, "_tile")
    upto = (Window.unboundedPreceding, Window.currentRow)
    head = F.max("_v").over(tile.orderBy("at", "_side").rowsBetween(*upto))
    tail = F.max("_old").over(tile.orderBy(F.desc("at"), "_side").rowsBetween(*upto))
    return (
        both.withColumn("peak", F.greatest(head, tail))
        .where(F.col("_side") == 1)
        .select(key, "at", "peak")
    )


def rscp_drop(
    df: DataFrame, db: float = 5.0, seconds: float = 30.0, key: str = "psc", value: str = "rscp",
    time: str = "ts", out: str = "rscp_drop",
) -> DataFrame:
    """1 where the level is more than ``db`` below its maximum of the last ``seconds``."""
    peaks = trailing_max(df, key, value, seconds, time).withColumnRenamed(key, "_key")
    rows = df.withColumn("_at", F.unix_micros(F.col(time)))
    joined = rows.join(peaks, (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("at")), "left")
    dropped = flag(F.col("peak") - F.col(value) > db)
    return joined.withColumn(out, dropped).drop("_key", "_at", "at", "peak")


def fast_fading(
    df: DataFrame, order: LogOrder, db_per_s: float = 2.0, value: str = "rscp", time: str = "ts"
) -> DataFrame:
    """1 where the level fell faster than ``db_per_s`` since the previous row."""

    def build(w):
        seconds = (F.unix_micros(time) - F.lag(F.unix_micros(time), 1).over(w)) / 1_000_000
        fall = F.lag(value, 1).over(w) - F.col(value)
        rate = F.try_divide(fall, F.nullif(seconds, F.lit(0.0)))
        return {"fast_fading": in_cell(order, flag(rate > db_per_s), F.lit(0))}

    return windowed(df, order, 1, build)


def volatile_channel(
    df: DataFrame, order: LogOrder, n: int = 20, cut: float = 3.0, value: str = "ecn0"
) -> DataFrame:
    """1 where the rolling std of the last ``n`` rows exceeds ``cut``.

    Rounded first: a std that equals the cut must not exceed it by its last bit.
    """
    return windowed(
        df, order, n - 1, lambda w: {"volatile": flag(F.round(rolling_std(value, n, w, order), 9) > cut)}
    )


def _cell_share(df: DataFrame, predicate: Column, share: float, key: str) -> DataFrame:
    return (
        df.where(F.col(key).isNotNull()).groupBy(key)
        .agg(F.count(F.lit(1)).alias("samples"), F.avg(flag(predicate)).alias("share"))
        .where(F.col("share") > share)
    )


def interference_share(df: DataFrame, share: float = 0.05, cut: float = -10.0, key: str = "psc") -> DataFrame:
    return _cell_share(df, F.col("ecn0") < cut, share, key)


def pilot_pollution_share(df: DataFrame, share: float = 0.20, db: float = 5.0, key: str = "psc") -> DataFrame:
    return _cell_share(df, F.abs(F.col("rscp") - F.col("rscp_det")) < db, share, key)


def duration_alarms(
    df: DataFrame, cond: Column, seconds: float, order: LogOrder, time: str = "ts"
) -> DataFrame:
    """Runs of rows of one key where ``cond`` holds throughout, lasting more than ``seconds``."""
    on = prepared(df.withColumn("_on", flag(cond)), order)
    starts = windowed(
        on, order, 1,
        lambda w: {"_begins": F.when((F.col("_on") == 1) & (F.coalesce(F.lag("_on", 1).over(w), F.lit(0)) == 0), 1)
                   .otherwise(0)},
    )
    numbered = running_total(starts, order, {"run": "_begins"})
    keys = list(order.keys)
    return (
        numbered.where(F.col("_on") == 1)
        .groupBy(*keys, "run")
        .agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count(F.lit(1)).alias("samples"))
        .withColumn("duration_s", (F.unix_micros("ended") - F.unix_micros("started")) / 1_000_000)
        .where(F.col("duration_s") > seconds)
    )


def ping_pong(df: DataFrame, order: LogOrder, cell: str = "pci", id: str = "event_id") -> DataFrame:
    """Serving changes that return to the cell before: A -> B -> A."""
    # the cell before last is the one left at the change before: noted on the row after that change and carried on
    def last_two(w):
        one, two = F.lag(cell, 1).over(w), F.lag(cell, 2).over(w)
        return {
            "via": one,
            "_changed": F.lag(F.lit(True), 1).over(w).isNotNull() & ~F.col(cell).eqNullSafe(one),
            "_came": F.when(F.lag(F.lit(True), 2).over(w).isNotNull() & ~one.eqNullSafe(two), F.struct(two.alias("cell"))),
        }

    told = windowed(df, order, 2, last_two).where(F.col("_changed") | F.col("_came").isNotNull())
    carried = carry(told, order, "_came", {"_left": True})
    back = carried.where(F.col("_changed") & (F.col("_left")["cell"] == F.col(cell)))
    return back.select(*order.keys, id, cell, "via")


def weekly_top_cells(
    df: DataFrame, n: int = 10, label: str = "interference", key: str = "psc", time: str = "ts"
) -> DataFrame:
    """Cells with the highest label rate of each week; the window runs over aggregated cells."""
    rates = (
        df.where(F.col(key).isNotNull())
        .groupBy(F.date_trunc("week", time).cast("date").alias("week"), key)
        .agg(F.avg(label).alias("rate"), F.count(F.lit(1)).alias("samples"))
    )
    place = F.row_number().over(Window.partitionBy("week").orderBy(F.desc("rate"), key))
    return rates.withColumn("place", place).where(F.col("place") <= n)


def kpi_bands(df: DataFrame, bands: Sequence[tuple] = KPI_BANDS) -> DataFrame:
    """The band table as rows (a fixed, small table)."""
    return df.sparkSession.createDataFrame(list(bands), "kpi string, band string, lo double, hi double")


def kpi_band(df: DataFrame, thresholds: DataFrame, kpi: str = "kpi", value: str = "value") -> DataFrame:
    """Band of each (kpi, value) row: equi-join on the kpi name, then its interval."""
    t = thresholds.withColumnRenamed("kpi", "_kpi")
    inside = (F.col("lo").isNull() | (F.col(value) >= F.col("lo"))) & (
        F.col("hi").isNull() | (F.col(value) < F.col("hi"))
    )
    matched = df.join(t, (F.col(kpi) == F.col("_kpi")) & inside, "left")
    return matched.drop("_kpi", "lo", "hi")
