"""Shards by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to n - 1 by their content alone, so neither files nor partitions nor a lost executor change a
number. A keyed Feistel network then permutes the numbers: it works on pairs (left, right) with left < a, right < b
and a * b the least such product not below n, both sides changed in turn by a hash of the other. A number that falls
beyond n walks on along its cycle until it is back inside. The permuted number p gives shard ``p mod shards`` and
slot ``p div shards``: shards differ by one row at most, their slots have no gap, the order inside a
shard is a shuffle of the whole, and both ``place`` and ``number_at`` are computable for any row alone.

Everything is DataFrame functions. How far a number may have to walk is not assumed: the few pairs beyond n are
walked first (fewer than a, the root of n), and the plan has as many steps as the longest of their walks.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolens.llm.common import Stages

ROUNDS = 8
#: Rows of a bucket that is numbered by one sort, and copies of one row that are numbered as one piece.
BUCKET, PIECE = 100_000, 10_000


def _sides(n: int) -> tuple[int, int]:
    a = max(isqrt(max(n - 1, 0)) + 1, 1)
    return a, max(-(-n // a), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _network(x: Column, n: int, seed: int, back: bool) -> Column:
    """``x`` put through the Feistel network once, or back; one expression, so a filter on the result stays small."""
    a, b = _sides(n)
    sign = -1 if back else 1

    def turned(side: Column, other: Column, i: Column, size: int) -> Column:
        turn = F.pmod(F.xxhash64(F.lit(seed).cast("long"), i, other), F.lit(size).cast("long"))
        return F.pmod(side + sign * turn, F.lit(size).cast("long"))

    def one(pair: Column, i: Column) -> Column:
        left, right = pair["left"], pair["right"]
        return F.when(i % 2 == 0, F.struct(turned(left, right, i, a).alias("left"), right.alias("right"))).otherwise(
            F.struct(left.alias("left"), turned(right, left, i, b).alias("right")))

    begin = F.struct(F.call_function("div", x, F.lit(b).cast("long")).alias("left"), (x % F.lit(b).cast("long")).alias("right"))
    rounds = reversed(range(ROUNDS)) if back else range(ROUNDS)
    return F.aggregate(F.array(*map(F.lit, rounds)), begin, one, lambda pair: pair["left"] * b + pair["right"])


def _walked(x: Column, n: int, seed: int, back: bool, steps: int) -> Column:
    """Up to ``steps`` passes: the first one, then one as long as the number is not below ``n``."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), x,
        lambda at, i: F.when((i == 1) | (at >= n), _network(at, n, seed, back)).otherwise(at))


def steps_needed(spark: SparkSession, n: int, seed: int, back: bool = False) -> int:
    """Passes of the network after which every number below n is below n again.

    Walked are the numbers from n to a * b that are entered from below n; there are fewer than a of them.
    """
    a, b = _sides(n)
    entered = spark.range(n, a * b).where(_network(F.col("id"), n, seed, not back) < n)
    steps = 1
    while not entered.isEmpty():
        entered = entered.select(_network(F.col("id"), n, seed, back).alias("id")).where(F.col("id") >= n)
        steps += 1
    return steps


def permuted(spark: SparkSession, x: Column, n: int, seed: int, back: bool = False) -> Column:
    """The numbers of a long column (0 to n - 1) permuted, or permuted back."""
    return _walked(x, n, seed, back, steps_needed(spark, n, seed, back))


def place(df: DataFrame, number: str, n: int, shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long) of the row numbers in ``number``; columns so named are replaced."""
    df = df.drop(*[c for c in ("shard", "slot") if c != number])
    (spot,) = fresh(df, "permuted")
    df = df.withColumn(spot, permuted(df.sparkSession, F.col(number).cast("long"), n, seed))
    return df.withColumns({"shard": (F.col(spot) % shards).cast("int"), "slot": F.expr(f"`{spot}` div {shards}")}).drop(spot)


def number_at(df: DataFrame, n: int, shards: int, seed: int = 0, number: str = "number") -> DataFrame:
    """The way back: ``df`` with the row ``number`` that stands at its ``shard`` and ``slot``."""
    spot = F.col("slot").cast("long") * shards + F.col("shard")
    return df.withColumn(number, permuted(df.sparkSession, spot, n, seed, back=True))


def number_rows(rows: DataFrame, number: str, stages: Stages) -> tuple[DataFrame, int]:
    """``rows`` with numbers 0 to n - 1 that depend on the rows' content only, and n.

    Equal rows are counted first, so one row that repeats without end is neither one group nor one
    task: its copies are cut into pieces, and the pieces are spread like other rows. The hash of a row (and piece) gives
    its bucket and its order there; the sizes of the buckets before it are added. One task adds up the sizes of
    buckets, a row for every 100,000 rows.
    """
    copies, piece, spot, bucket, upto, before = fresh(rows, "copies", "piece", "spot", "bucket", "upto", "before")
    counted = stages.write(rows.groupBy(*rows.columns).agg(F.count("*").alias(copies)), "numbered")
    n = counted.agg(F.sum(copies)).first()[0] or 0
    pieces = counted.withColumn(piece, F.explode(F.expr(f"sequence(0, (`{copies}` - 1) div {PIECE})")))
    pieces = pieces.withColumn(copies, F.least(F.lit(PIECE), F.col(copies) - F.col(piece) * PIECE))
    pieces = pieces.withColumn(spot, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns], F.col(piece)))
    pieces = pieces.withColumn(bucket, F.pmod(F.col(spot), F.lit(n // BUCKET + 1)))
    order = ", ".join(f"`{c}`" for c in [spot, piece, *rows.columns])
    sizes = pieces.groupBy(bucket).agg(F.sum(copies).alias(before))
    sizes = sizes.select(bucket, F.expr(f"sum(`{before}`) over (order by `{bucket}`) - `{before}`").alias(before))
    inside = F.expr(f"sum(`{copies}`) over (partition by `{bucket}` order by {order} rows unbounded preceding)")
    placed = pieces.withColumn(upto, inside).join(sizes, bucket)
    first = f"`{before}` + `{upto}` - `{copies}`"
    numbers = F.expr(f"explode(sequence({first}, `{before}` + `{upto}` - 1))")
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns], numbers.alias(number)), n


def shard_rows(rows: DataFrame, shards: int, seed: int = 0, stages: Stages | None = None) -> DataFrame:
    """``rows`` with ``shard`` (int, 0 to ``shards`` - 1) and ``slot`` (long, from 0 without a gap).

    The shards' sizes differ by one row at most. Reruns agree, whatever files or partitions the rows come from; another
    ``seed`` is another shuffle, another row another one too. NULLs are values like others. Equal rows
    get a place each. Columns named ``shard`` or ``slot`` are replaced; more shards than rows: some stay
    empty; empty table: no rows. Pass only the columns that the result needs: all of them are shuffled.
    """
    stages = stages or Stages(rows.sparkSession)
    rows = rows.drop("shard", "slot")
    (number,) = fresh(rows, "number")
    numbered, n = number_rows(rows, number, stages)
    return place(numbered, number, n, shards, seed).drop(number)


def write_shards(sharded: DataFrame, path: str, files: int = 1) -> None:
    """One folder for each shard, its rows in the order of slots; ``files`` tasks write them, a shard may be cut."""
    ordered = sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
