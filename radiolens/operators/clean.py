"""Cleaning of UMTS and LTE logs: one projection chain, no Python in the row path."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolens.functions.numbers import bounded, flag, number, ratio
from radiolens.plans.once import evaluated_once

# Log header -> short name, in two naming schemes.
UMTS_NAMES = {
    "Time": "time",
    "Band (active)": "band",
    "Channel number (active)": "uarfcn",
    "Scrambling code (active)": "psc",
    "RSCP (active)": "rscp",
    "Ec/N0 (active)": "ecn0",
    "RSCP (detected)": "rscp_det",
    "Scrambling code (detected)": "psc_det",
}
UMTS_NAMES_NOTEBOOK = {
    "Time": "time",
    "Band (active)": "band_act",
    "Channel number (active)": "ch_act",
    "Scrambling code (active)": "sc_act",
    "RSCP (active)": "rscp_act",
    "Ec/N0 (active)": "ecn0_act",
    "RSCP (detected)": "rscp_det",
    "Scrambling code (detected)": "sc_det",
}
RSCP_RANGE = (-120.0, -25.0)
ECN0_RANGE = (-30.0, 5.0)
# Lowest RSRP in dBm of each coverage zone, best first; below all of them: the last.
ZONES = (("Tres bonne", -80.0), ("Bonne", -90.0), ("Moyenne", -100.0))
WORST_ZONE = "Mauvaise"
ZONE_ORDER = ("Tres bonne", "Bonne", "Moyenne", "Mauvaise")

FIRST_ENTRY = r"(?s)^\s*([^,]*?)\s*,.*$"
TIME_OF_DAY = r"[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\.[0-9]{1,6}"


def rename_columns(df: DataFrame, names: Mapping[str, str] = UMTS_NAMES) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop_blank_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows whose every cell is white space; a NULL cell is not blank text."""
    cells = F.array(*[F.col(c).cast("string") for c in (columns or df.columns)])
    blank = F.forall(cells, lambda c: F.coalesce(F.trim(c) == "", F.lit(False)))
    return df.where(~blank)


def first_of_multi(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the serving (first) entry of comma-separated cells."""

    def first(name: str) -> Column:
        # one reference to the text: filters pushed below evaluate it again
        return F.regexp_replace(F.col(name).cast("string"), FIRST_ENTRY, "$1")

    return df.withColumns({c: first(c) for c in columns})


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: number(c) for c in columns})


def parse_time_of_day(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """First ``H:M:S.fraction`` found anywhere in the text, on 1970-01-01; else NULL."""
    found = F.nullif(F.regexp_extract(F.col(column), TIME_OF_DAY, 0), F.lit(""))
    stamp = F.concat(F.lit("1970-01-01 "), found).try_cast("timestamp")
    return df.withColumn(out or column, stamp)


def parse_timestamp(
    df: DataFrame, column: str, formats: Sequence[str] | None = None, out: str | None = None
) -> DataFrame:
    """Free-form time stamp; the first format that parses wins, bad text gives NULL."""
    text = F.trim(F.col(column).cast("string"))
    if formats:
        stamp = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    else:
        stamp = text.try_cast("timestamp")
    return df.withColumn(out or column, stamp)


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(subset) if subset else None)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Full-row duplicates, nulls equal. Copies collapse on the map side before the shuffle."""
    return df.dropDuplicates()


def clip(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    return df.withColumn(column, bounded(column, lo, hi))


def sort_log(df: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Global order by time, or by cell then time; end ``keys`` with a row id to make it total."""
    return df.orderBy(*keys)


def split_streams(
    df: DataFrame, left_value: str = "rsrp", right_value: str = "rlc_dl", time: str = "ts"
) -> tuple[DataFrame, DataFrame]:
    """Radio rows and throughput rows of one interleaved log, both with a time."""
    timed = df.where(F.col(time).isNotNull())
    return (
        timed.where(F.col(left_value).isNotNull()).drop(right_value),
        timed.where(F.col(right_value).isNotNull()),
    )


def clean_umts(
    df: DataFrame,
    time: str = "time",
    numeric: Sequence[str] = ("uarfcn", "psc", "rscp", "ecn0", "rscp_det", "psc_det"),
    multi: Sequence[str] = ("band", "uarfcn", "psc", "rscp", "ecn0", "psc_det", "rscp_det"),
    time_of_day: bool = False,
) -> DataFrame:
    """Multi-values, numbers, time, required cells, copies, plausible ranges.

    Blank rows need no filter of their own here: they lack the required cells.
    """
    multi = [c for c in multi if c in df.columns]
    numeric = [c for c in numeric if c in df.columns]
    parse = parse_time_of_day if time_of_day else parse_timestamp
    rows = parse(to_numeric(first_of_multi(df, multi), numeric), time)
    rows = drop_duplicate_rows(drop_missing(evaluated_once(rows), [time, "psc", "rscp", "ecn0"]))
    return clip(clip(rows, "rscp", *RSCP_RANGE), "ecn0", *ECN0_RANGE)


def clean_umts_notebook(
    df: DataFrame,
    time: str = "time",
    numeric: Sequence[str] = (
        "band_act", "ch_act", "sc_act", "rscp_act", "ecn0_act", "rscp_det", "sc_det",
    ),
) -> DataFrame:
    """Variant without clipping or required cells; adds the time parts and the peak-hour flag.

    Row order is not stored: operators that need one take it from a ``LogOrder``.
    """
    from radiolens.functions.scalar import is_peak_hour, time_parts

    numeric = [c for c in numeric if c in df.columns]
    rows = drop_duplicate_rows(to_numeric(parse_timestamp(df, time), numeric))
    return is_peak_hour(time_parts(rows, time), time)


def signal_gap(
    df: DataFrame, active: str = "rscp", detected: str = "rscp_det", fill: float | None = 0.0,
    out: str = "delta_rscp",
) -> DataFrame:
    """Active minus detected level; without a detected cell ``fill`` (or NULL)."""
    gap = F.col(active) - F.col(detected)
    return df.withColumn(out, gap if fill is None else F.coalesce(gap, F.lit(fill)))


def neighbor_flags(
    df: DataFrame,
    close: float = 5.0,
    far: float = 15.0,
    active: str = "rscp",
    detected: str = "rscp_det",
    code: str = "psc",
    code_detected: str = "psc_det",
) -> DataFrame:
    gap = F.abs(F.col(active) - F.col(detected))
    return df.withColumns(
        {
            "has_neighbor": F.col(detected).isNotNull().cast("int"),
            "delta_sc": F.abs(F.col(code) - F.col(code_detected)),
            "signal_gap_abs": gap,
            "active_detected_close": flag(gap <= close),
            "active_detected_far": flag(gap >= far),
        }
    )


def quality_ratio(
    df: DataFrame, num: str = "rscp", den: str = "rscp_det", out: str = "rscp_quality_ratio"
) -> DataFrame:
    return df.withColumn(out, ratio(F.col(num), F.col(den)))


def zone_of(column: Column | str, cuts: Sequence[float] = (-80.0, -90.0, -100.0)) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    names = [name for name, _ in ZONES]
    zone = F.when(col >= cuts[0], names[0])
    for name, cut in zip(names[1:], cuts[1:]):
        zone = zone.when(col >= cut, name)
    return zone.otherwise(WORST_ZONE)


def coverage_zone(
    df: DataFrame, column: str = "rsrp", cuts: Sequence[float] = (-80.0, -90.0, -100.0),
    out: str = "coverage_zone",
) -> DataFrame:
    return df.withColumn(out, zone_of(column, cuts))
