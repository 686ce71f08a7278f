"""Ordered scans over a log without ever giving a whole key, or the whole log, to one task.

A cell, a session or a class may hold a third of all rows, and some scans have no key at all.
``Window.partitionBy(key)`` would put such a group into a single task.  Every operator that needs
row order therefore goes through this module. The log is cut into chunks along its order, and each
chunk receives what it needs from the chunks before it:

* a partial sum (``running_total``, ``position``) or the last value seen (``carry``): any borders
  do, so they come from a sample of the whole order tuple, the chunk is found in them by binary
  search inside a column expression, and the rows are shuffled once;
* the last few rows (``windowed``): chunks must hold enough rows, so one range sort numbers the rows
  and the number cuts the log into chunks of equal row count whatever the key distribution is.

The number of chunks follows from the number of rows alone, one for every ``chunk_rows`` of them, without an
upper limit; a log of one chunk has nothing to hand on. ``plan="keyed"`` asks for a plain window per
key, for logs whose keys are known to be small.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from radiolens.plans.stage import materialize

HOME = "_log_home"
CHUNK = "_log_chunk"
BORDERS = "_log_borders"
CHUNK_ROWS = 1 << 18
SAMPLED = 32  # rows of the sample for each chunk


@dataclass(frozen=True)
class LogOrder:
    """A total order inside each key: ``by`` must end in a column that breaks every tie."""

    by: tuple[str, ...]
    keys: tuple[str, ...] = ()
    plan: str = "chunked"  # chunked | keyed
    chunk_rows: int = CHUNK_ROWS

    def splits(self, df: DataFrame) -> bool:
        return self.plan == "chunked" or not self.keys or self.index in df.columns

    @property
    def index(self) -> str:
        """Name of the row number; it tells the order, so no other order can mistake it for its own."""
        return "_log_index_" + "_".join([*self.keys, "by", *self.by])

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.by)


def index_log(df: DataFrame, order: LogOrder) -> DataFrame:
    """Number the rows 0..n-1 in (keys, by) order.

    The range sort splits hot keys by the order columns.  The sorted rows are written out because
    the numbers come from partition positions: a recomputed sort could cut partitions elsewhere.
    Only one count per partition reaches the driver.
    """
    if order.index in df.columns:
        return df
    slot, part, start = "_log_slot", "_log_part", "_log_start"
    placed = materialize(
        df.sort(*order.keys, *order.by).withColumn(slot, F.monotonically_increasing_id())
    ).withColumn(part, F.shiftright(slot, 33).cast("int"))
    counts = sorted((r[part], r["count"]) for r in placed.groupBy(part).count().collect())
    starts = [0, *accumulate(n for _, n in counts)]
    offsets = df.sparkSession.createDataFrame(
        [(p, s) for (p, _), s in zip(counts, starts)], f"{part} int, {start} bigint"
    )
    offset_in_part = F.col(slot).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(offsets), part)  # one row per partition
        .withColumn(order.index, F.col(start) + offset_in_part)
        .drop(slot, part, start)
    )


def prepared(df: DataFrame, order: LogOrder) -> DataFrame:
    """Number the rows now if ``order`` is going to split them, so that several operators in a row
    share one sort; drop ``order.index`` after the last of them."""
    return index_log(df, order) if order.splits(df) else df


def _chunked(df: DataFrame, order: LogOrder) -> tuple[DataFrame, tuple[str, ...]] | None:
    """``df`` with its chunk, which never falls along the order of a key, and the order columns inside it; None for one chunk.

    A row is in the sample by a hash of its key and order columns, so the borders do not depend on partitions. Rows that
    share the first order columns, NULL ones too, are parted by the others. One task sorts the sample, 32 tuples a chunk.
    """
    if order.index in df.columns:
        return df.withColumn(CHUNK, F.floor(F.col(order.index) / order.chunk_rows)), (order.index,)
    rows = df.count()
    chunks = rows // order.chunk_rows + 1
    if chunks == 1:
        return None
    spread = F.pmod(F.xxhash64(*order.keys, *order.by), F.lit(1 << 40))
    place = F.struct(*order.by)
    taken = df.where(spread < int(min(1.0, SAMPLED * chunks / rows) * (1 << 40)))
    ordered = taken.agg(F.sort_array(F.collect_list(place)).alias("s"))
    at = F.sequence(F.lit(1), F.lit(chunks - 1))
    borders = ordered.select(
        F.filter(F.transform(at, lambda i: F.get("s", F.floor(i * F.size("s") / chunks).cast("int"))), lambda b: b.isNotNull())
    ).scalar()

    def halved(span: Column, _: Column) -> Column:
        middle = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        left = place < F.get(BORDERS, middle)
        return F.when(span["lo"] >= span["hi"], span).when(
            left, F.struct(span["lo"].alias("lo"), middle.alias("hi"))
        ).otherwise(F.struct((middle + 1).alias("lo"), span["hi"].alias("hi")))

    whole = F.struct(F.lit(0).alias("lo"), F.size(BORDERS).alias("hi"))
    steps = F.sequence(F.lit(0), F.lit(chunks.bit_length()))
    chunk = F.aggregate(steps, whole, halved, lambda span: span["lo"].cast("bigint"))
    return df.withColumn(BORDERS, borders).withColumn(CHUNK, chunk).drop(BORDERS), order.by


def _drop_index(result: DataFrame, source: DataFrame, order: LogOrder) -> DataFrame:
    return result if order.index in source.columns else result.drop(order.index)


def _match(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Equi-join on ``names`` where nulls are equal; the right copies of the names are dropped."""
    renamed = right.withColumnsRenamed({n: f"_r_{n}" for n in names})
    condition = [left[n].eqNullSafe(renamed[f"_r_{n}"]) for n in names]
    return left.join(renamed, condition, how).drop(*[f"_r_{n}" for n in names])


def windowed(
    df: DataFrame, order: LogOrder, back: int, build: Callable[[WindowSpec], dict[str, Column]]
) -> DataFrame:
    """Add window columns whose frames reach at most ``back`` rows before the current row."""
    if not order.splits(df):
        return df.withColumns(build(order.window()))
    rows = max(order.chunk_rows, back, 1)
    home = F.floor(F.col(order.index) / rows)
    tail = F.col(order.index) % rows >= rows - back
    spread = (
        index_log(df, order)
        .withColumn(HOME, home)
        .withColumn(
            CHUNK,
            F.explode(
                F.when(tail, F.array(HOME, F.col(HOME) + 1)).otherwise(F.array(HOME))
            ),
        )
    )
    spec = Window.partitionBy(*order.keys, CHUNK).orderBy(order.index)
    result = spread.withColumns(build(spec)).where(F.col(CHUNK) == F.col(HOME))
    return _drop_index(result.drop(CHUNK, HOME), df, order)


def position(df: DataFrame, order: LogOrder, out: str) -> DataFrame:
    """0-based place of each row inside its key."""
    if not order.splits(df):
        return df.withColumn(out, (F.row_number().over(order.window()) - 1).cast("bigint"))
    counted = running_total(df.withColumn("_log_one", F.lit(1)), order, {out: "_log_one"})
    return counted.drop("_log_one").withColumn(out, F.col(out) - 1)


def running_total(df: DataFrame, order: LogOrder, totals: dict[str, str]) -> DataFrame:
    """Add ``out = sum(column)`` from the start of the key to the current row, inclusive."""
    upto = (Window.unboundedPreceding, Window.currentRow)
    cut = _chunked(df, order) if order.splits(df) else None
    if cut is None:
        spec = order.window().rowsBetween(*upto)
        return df.withColumns({out: F.sum(c).over(spec) for out, c in totals.items()})
    names = [*order.keys, CHUNK]
    chunked, by = cut
    parts = chunked.groupBy(*names).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in totals.items()])
    before = Window.partitionBy(*order.keys).orderBy(CHUNK).rowsBetween(  # a row per chunk
        Window.unboundedPreceding, -1
    )
    parts = parts.withColumns({f"_t_{o}": F.sum(f"_t_{o}").over(before) for o in totals})
    spec = Window.partitionBy(*names).orderBy(*by).rowsBetween(*upto)
    local = chunked.withColumns({o: F.sum(c).over(spec) for o, c in totals.items()})
    joined = _match(local, parts, names, "inner")
    summed = joined.withColumns(
        {o: F.col(o) + F.coalesce(F.col(f"_t_{o}"), F.lit(0)) for o in totals}
    )
    return summed.drop(CHUNK, *[f"_t_{o}" for o in totals])


def carry(df: DataFrame, order: LogOrder, column: str, out: dict[str, bool]) -> DataFrame:
    """Nearest non-null ``column`` at or before the row (``True``) or at or after it (``False``).

    Looking ahead is a look back in reversed order: a frame that ends at the last row would be
    evaluated again for every row.
    """

    def seen(keys: list[str], by: list[str], back: bool, upto: int) -> Column:
        spec = Window.partitionBy(*keys).orderBy(*[F.asc(c) if back else F.desc(c) for c in by])
        return F.last(column, ignorenulls=True).over(
            spec.rowsBetween(Window.unboundedPreceding, upto)
        )

    cut = _chunked(df, order) if order.splits(df) else None
    if cut is None:
        keys, by = list(order.keys), list(order.by)
        return df.withColumns({o: seen(keys, by, b, 0) for o, b in out.items()})
    names = [*order.keys, CHUNK]
    chunked, by = cut
    known = F.when(F.col(column).isNotNull(), F.struct(*by))
    outside = None
    for back in sorted(set(out.values())):
        edge = F.max_by(column, known) if back else F.min_by(column, known)
        edges = chunked.groupBy(*names).agg(edge.alias(column))
        edges = edges.select(
            *names, seen(list(order.keys), [CHUNK], back, -1).alias(f"_out_{int(back)}")
        )
        outside = edges if outside is None else _match(outside, edges, names, "inner")
    local = chunked.withColumns({o: seen(names, list(by), b, 0) for o, b in out.items()})
    joined = _match(local, outside, names, "inner")
    filled = joined.withColumns(
        {o: F.coalesce(F.col(o), F.col(f"_out_{int(b)}")) for o, b in out.items()}
    )
    return filled.drop(CHUNK, "_out_0", "_out_1")
