"""Mixing sources to target weights with hash thresholds; DataFrame functions only.

Every document has a 60-bit hash of its id. A source's budget is met by the documents below a threshold in
hash space: words are summed by source and bucket of the hash, the bucket that holds the budget's end is
found from running sums over at most 4,096 buckets, and only the rows of that bucket are summed again by the
next 12 bits. No document is sorted; the last step filters by the thresholds. Budgets are nested: what a
smaller budget takes, a larger one takes too, so a second copy is only taken of documents taken once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolens.llm.common import Stages, word_count

BITS, LEVELS = 12, 5
END = 1 << (BITS * LEVELS)


def spot(key: Column) -> Column:
    """The place of a document in hash space: 60 bits of the MD5 of its id (NULL: of the empty string)."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long")


def cyclic_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(source, weight): ``weights`` in turn to the distinct sources by code point, NULL last."""
    ranks = Window.orderBy(F.col("source").isNull(), "source")  # a row per source
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(ranks) - 1) % len(weights) + 1)
    return sources.select("source").distinct().select("source", turn.alias("weight"))


def targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): ``share`` of all sizes by weight, at most ``most`` times a source.

    Resharing the excess until none is above ends at target = min(cap, weight x level). With sources in
    order of cap by weight, the level is the largest of what the sources from each one on could share.
    """
    up = Window.orderBy("full_at", F.col("source").isNull(), "source")  # a row per source
    before, every = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = sizes.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("full_at", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / heavy)
    rows = rows.withColumn("level", F.max("level").over(every))
    return rows.select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def _crossing(hist: DataFrame) -> DataFrame:
    """From (source, tier, budget, below, bucket, words): the bucket that holds the budget's end."""
    run = Window.partitionBy("source", "tier").orderBy("bucket")
    after = F.col("below") + F.sum("words").over(run)
    rows = hist.withColumn("after", after).withColumn("before", F.col("after") - F.col("words"))
    return rows.where("before <= budget and budget < after")


def thresholds(slim: DataFrame, weights: DataFrame, share: float, most: float, stages: Stages) -> DataFrame:
    """(source, source_size, target, limits): copy i is taken of documents whose hash is below limits[i].

    ``slim``: a written table (source, spot, size). The document in which a budget ends is taken if that
    comes nearer to the budget. Documents with one hash (one id) are taken together.
    """
    hist = stages.write(
        slim.groupBy("source", F.shiftright("spot", BITS * (LEVELS - 1)).alias("bucket")).agg(F.sum("size").alias("words")),
        "mixhist",
    )
    sizes = hist.groupBy("source").agg(F.sum("words").alias("source_size"))
    given = weights.select(F.col("source").alias("s"), "weight")
    sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goals = stages.write(targets(sizes, share, most), "mixgoals")

    tiers = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1))).alias("tier")
    rest = F.col("target") - F.col("tier") * F.col("source_size")
    budgets = goals.select("source", "source_size", "target", tiers).select(
        F.col("source").alias("s"), "tier", F.greatest(F.lit(0.0), F.least(rest, F.col("source_size").cast("double"))).alias("budget")
    )
    first = hist.join(budgets, F.col("source").eqNullSafe(F.col("s"))).withColumn("below", F.lit(0).cast("long"))
    found = stages.write(_crossing(first).select("source", "tier", "budget", F.col("before").alias("below"), "bucket"), "mixedge")
    edge = None
    for level in range(1, LEVELS):
        at = found.select(F.col("source").alias("s"), "tier", "budget", "below", "bucket")
        coarse = F.shiftright("spot", BITS * (LEVELS - level))
        same = F.col("source").eqNullSafe(F.col("s")) & (coarse == F.col("bucket"))
        if edge is not None:
            same = same & (F.col("t") == F.col("tier"))
        rows = slim if edge is None else edge.withColumnRenamed("tier", "t")
        within = rows.join(at, same).select("source", "tier", "budget", "below", "spot", "size")
        inner = stages.write(within, "mixedge")
        finer = F.shiftright("spot", BITS * (LEVELS - level - 1)).alias("bucket")
        fine = inner.groupBy("source", "tier", "budget", "below", finer).agg(F.sum("size").alias("words"))
        last = stages.write(
            _crossing(fine).select("source", "tier", "budget", F.col("before").alias("below"), "bucket", "words"), "mixedge"
        )
        stages.drop(found, *([edge] if edge is not None else []))
        edge, found = inner.select("source", "tier", "spot", "size"), last
        stages.paths[id(edge)] = (edge, stages.paths.pop(id(inner))[1])
    nearer = F.col("below") * 2 + F.col("words") <= F.col("budget") * 2
    ends = found.select(
        F.col("source").alias("es"), F.col("tier").alias("et"), (F.col("bucket") + nearer.cast("long")).alias("end")
    )
    joined = budgets.join(ends, F.col("s").eqNullSafe(F.col("es")) & (F.col("tier") == F.col("et")), "left")
    full = F.when(F.col("budget") > 0, F.lit(END)).otherwise(F.lit(0))  # no end inside the source: all of it or none
    limits = joined.groupBy("s").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("tier", F.coalesce("end", full).alias("end")))), lambda x: x["end"]).alias("limits")
    )
    out = stages.write(goals.join(limits, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mixlimits")
    stages.drop(hist, goals, found, edge)
    return out


def mix_sources(
    docs: DataFrame, weights: Sequence[float] | DataFrame, share: float = 1.0, most: float = 2.0, text: str = "text",
    key: str = "doc_id", source: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    ``weights``: numbers given in turn to the sources by code point, NULL last, or a table (source, weight)
    of positive weights; sources without a weight are not in the mix. ``copies`` is how often the mix takes
    a document, at most ``ceil(most)``; ``taken`` is copies x size.

    NULL text: size 0. NULL source: a source of its own. NULL id: hashed as the empty string. Rows that
    repeat an id are taken together. A source of size 0 has target 0 and is not taken. Empty table: no rows.
    Reruns agree, since the hash sees only the id. Other columns are ignored.
    """
    limits, slim, _ = _plan(docs, weights, share, most, text, key, source)
    return _copies(slim, limits).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] | DataFrame, share: float = 1.0, most: float = 2.0, text: str = "text",
    key: str = "doc_id", source: str = "source",
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mix_sources`` takes it, with their columns.

    Documents without any word are taken like others below the threshold; they cost nothing.
    """
    limits, slim, stages = _plan(docs, weights, share, most, text, key, source)
    stages.drop(slim)
    rows = docs.select(F.struct("*").alias("doc"), spot(F.col(key)).alias("spot"), F.col(source).alias("source"))
    rows = _copies(rows, limits).where("copies > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def _plan(docs, weights, share, most, text, key, source):
    stages = Stages(docs.sparkSession)
    slim = stages.write(
        docs.select(
            F.col(key).alias("doc_id"), F.col(source).alias("source"), spot(F.col(key)).alias("spot"),
            word_count(F.col(text)).alias("size"),
        ),
        "mix",
    )
    if not isinstance(weights, DataFrame):
        weights = cyclic_weights(slim, weights)
    return thresholds(slim, weights, share, most, stages), slim, stages


def _copies(rows: DataFrame, limits: DataFrame) -> DataFrame:
    taken = F.size(F.filter("limits", lambda end: F.col("spot") < end))
    joined = rows.join(limits.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return joined.withColumn("copies", taken.cast("int")).drop("s")
