"""Number and text helpers that keep "missing" as NULL (never NaN) and never raise under ANSI."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A finite decimal number between optional blanks; "5d", "nan", "0x1" and the like are not numbers.
NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$"
NUMERIC = "^(double|float|tinyint|smallint|int|bigint|decimal)"


def number(column: Column | str) -> Column:
    """Text or a number to double; anything that is not a finite number becomes NULL.

    The type is known when the plan is made, so only one branch is left: a numeric column never
    becomes text. The text appears once in the expression: filters on the result are pushed below the
    projection and evaluate it again there, so it has to stay cheap.
    """
    col = F.col(column) if isinstance(column, str) else column
    parsed = F.regexp_extract(col.cast("string"), NUMBER, 1).try_cast("double")
    finite_ = F.get(F.filter(F.array(parsed), lambda x: F.abs(x) < float("inf")), F.lit(0))
    return F.when(F.typeof(col).rlike(NUMERIC), finite(col.try_cast("double"))).otherwise(finite_)


def finite(column: Column | str) -> Column:
    """NaN and infinities of a double column to NULL."""
    col = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(col) & (F.abs(col) < float("inf")), col)


def flag(predicate: Column) -> Column:
    """Predicate to 0/1 with unknown counted as 0."""
    return F.coalesce(predicate, F.lit(False)).cast("int")


def bounded(column: Column | str, lo: float, hi: float) -> Column:
    """Clip; NULL stays NULL (``greatest``/``least`` alone would skip it)."""
    col = F.col(column) if isinstance(column, str) else column
    return F.when(col.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), col)))


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0)))


def round_n(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """To ``n`` decimals, halves to the even neighbor."""
    return df.withColumns({c: F.bround(F.col(c), n) for c in columns})


def scalar_math(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Named column expressions such as ``abs``, clip and ratios, all in one projection."""
    return df.withColumns(exprs)
