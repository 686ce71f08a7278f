"""Embedding near-duplicates by a pivot-permutation index.

A bounded sample of vectors serves as pivots. Every vector is described by its nearest pivots in order, and
stands in the inverted list of each of them. Two vectors of one list are linked if they share enough pivots
and their cosine is large enough; the cosines of a tile are one product and come first. A pair that meets in several lists is counted in the list
of its smallest shared pivot only. Tasks return link counts and spanning links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolens.llm.common import Stages, components
from radiolens.llm.simhash import link

#: One pivot for so many distinct vectors, at least and at most so many.
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 32, 64, 4096
APART = 0.8  # pivots are no nearer to one another (cosine), so a large group of near copies has few
NEAREST, SHARED = 6, 2  # pivots of a vector, at least (see nearest_of); pivots that candidates share
LIST_ROWS = 50_000  # rows from which a list is cut into blocks
TILE = 1024  # rows multiplied at a time
PAIRS = 1 << 17  # pairs whose pivots are compared at a time


def nearest_of(pivots: int) -> int:
    """Pivots of a vector: more where there are more to choose from, or near vectors would share too few."""
    return max(NEAREST, (pivots - 1).bit_length() - 1)


def payload(values) -> bytes | None:
    """A vector's bytes as doubles; None if it has no direction or a component that is no finite number."""
    if values is None:
        return None
    v = np.asarray(values, dtype=np.float64)
    if not len(v) or not np.isfinite(v).all() or not v.any():
        return None
    single = v.astype(np.float32)
    return single.tobytes() + b"f" if (single == v).all() else v.tobytes() + b"d"


def units(packed, width: int) -> np.ndarray:
    """Unit vectors in double precision; shorter ones are filled up with zeros."""
    out = np.zeros((len(packed), width))
    for row, x in zip(out, packed):
        v = np.frombuffer(x, dtype=np.float32 if x[-1:] == b"f" else np.float64, count=(len(x) - 1) // (4 if x[-1:] == b"f" else 8))
        row[: len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that no square overflows
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def thinned(candidates: np.ndarray, apart: float, most: int) -> np.ndarray:
    """The first candidates that are not within ``apart`` of an earlier one."""
    kept = np.empty((min(most, len(candidates)), candidates.shape[1]))
    n = 0
    for v in candidates:
        if n < len(kept) and (n == 0 or (kept[:n] @ v).max() < apart):
            kept[n] = v
            n += 1
    return kept[:n]


def compare(a: pd.DataFrame, b: pd.DataFrame | None, pivot: int, width: int, least: float, shared: int) -> pd.DataFrame:
    """(gid, n, root) of the linked rows of one list (``b`` None) or of two of its blocks."""
    rows = a if b is None else pd.concat([a, b], ignore_index=True)
    cut = len(rows) if b is None else len(a)
    v, p = units(rows["v"].to_numpy(), width), np.array(rows["pivots"].tolist(), dtype=np.int32)
    copies, n, root = rows["copies"].to_numpy(), np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
    for s in range(0, cut, TILE):
        for t in range(s if b is None else cut, len(rows), TILE):
            left, right = slice(s, min(s + TILE, cut)), slice(t, t + TILE)
            near = v[left] @ v[right].T >= least
            if s == t:
                near = np.triu(near, 1)
            every = np.nonzero(near)
            for at in range(0, len(every[0]), PAIRS):
                i, j = (x[at : at + PAIRS] for x in every)
                i, j = i + s, j + t
                hits = (p[i][:, :, None] == p[j][:, None, :]).any(axis=2)
                both = np.where(hits, p[i], np.iinfo(np.int32).max).min(axis=1)
                own = (hits.sum(axis=1) >= shared) & (both == pivot)
                i, j = i[own], j[own]
                n += np.bincount(i, copies[j], len(rows)).astype(np.int64) + np.bincount(j, copies[i], len(rows)).astype(np.int64)
                link(root, i, j)
    found = n > 0
    gid = rows["gid"].to_numpy()
    return pd.DataFrame({"gid": gid[found], "n": n[found], "root": gid[root[found]]})


def vector_groups(
    vectors: DataFrame, least: float = 0.9, vector: str = "embedding", key: str = "vec_id", nearest: int | None = None,
    shared: int = SHARED, list_rows: int = LIST_ROWS,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``n_links``: other rows whose cosine (double precision) is ``least`` or more, as far as the index finds
    them; equal vectors count each other and are searched as one. ``component_id``: the smallest vec_id
    reachable by links, itself included. ``kept``: the row bears its component's id.

    Vectors that are NULL, empty, zero, or hold NULL or non-finite components link with nothing. Shorter
    vectors count as filled up with zeros. Rows without an id link with nothing, have no component and are
    not kept. Rows that repeat an id are the same node. Empty table: no rows. Other columns are ignored.

    Pivots: ``n / PER_PIVOT`` of the distinct vectors, within documented bounds, so lists keep their size
    as the table grows until the upper bound. ``nearest``: pivots of a vector, by ``nearest_of`` if not given;
    they grow with the logarithm of the pivots, which keeps the recall. A longer list is cut into blocks and its pairs of blocks are
    separate tasks. Every vector is indexed and nothing is capped.
    """
    spark = vectors.sparkSession
    stages = Stages(spark)

    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        return values.map(payload)

    slim = vectors.select(F.col(key).alias("vec_id"), packed(F.col(vector)).alias("v"))
    slim = slim.withColumn("v", F.when(F.col("vec_id").isNotNull(), F.col("v")))
    slim = stages.write(slim.withColumn("h", F.unhex(F.md5("v"))), "vectors")
    groups = slim.where("v is not null").groupBy("h").agg(
        F.any_value("v").alias("v"), F.count("*").cast("long").alias("copies"), F.min("vec_id").alias("first")
    )
    groups = stages.write(groups.withColumn("gid", F.monotonically_increasing_id()), "distinct")
    total, width = groups.agg(F.count("*"), F.max(F.octet_length("v"))).first()
    if not total:
        return slim.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    wanted = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, total // PER_PIVOT)))
    sample = [bytes(r.v) for r in groups.select("v", "h").orderBy("h").limit(2 * wanted).collect()]
    width = (width - 1) // 4  # of the longest vector, or more
    held = spark.sparkContext.broadcast(thinned(units(sample, width), APART, wanted))
    count = min(nearest or nearest_of(len(held.value)), len(held.value))
    enough = min(shared, count)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots = held.value
        for frame in batches:
            near = np.empty((len(frame), count), dtype=np.int32)
            for at in range(0, len(frame), TILE):
                some = units(frame["v"].iloc[at : at + TILE].to_numpy(), width) @ pivots.T
                top = np.argpartition(-some, count - 1, axis=1)[:, :count]
                order = np.argsort(-np.take_along_axis(some, top, axis=1), axis=1, kind="stable")
                near[at : at + TILE] = np.take_along_axis(top, order, axis=1)
            yield frame.assign(pivots=list(near))

    kinds = "gid long, copies long, v binary, pivots array<int>"
    described = groups.select("gid", "copies", "v").mapInPandas(describe, kinds)
    described = stages.write(described, "described")
    lists = described.select("*", F.explode("pivots").alias("pivot"))
    sizes = lists.groupBy("pivot").count().select("pivot", F.ceil(F.col("count") / list_rows).cast("int").alias("blocks"))
    sizes = F.broadcast(sizes)  # a row per pivot
    own = F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int")
    lists = lists.join(sizes, "pivot").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    lists = lists.select("*", other).select(
        "gid", "copies", "v", "pivots", "pivot", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj")
    )

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        pivot, i, j = (int(frame[c].iloc[0]) for c in ("pivot", "bi", "bj"))
        frame = frame.sort_values("gid", ignore_index=True)
        if i == j:
            return compare(frame, None, pivot, width, least, enough)
        return compare(frame[frame["own"] == i].reset_index(drop=True), frame[frame["own"] == j].reset_index(drop=True), pivot, width, least, enough)

    links = stages.write(lists.groupBy("pivot", "bi", "bj").applyInPandas(search, "gid long, n long, root long"), "links")
    labels = components(links.select(F.col("gid").alias("a"), F.col("root").alias("b")), stages)
    counts = links.groupBy("gid").agg(F.sum("n").alias("n"))
    nodes = groups.select("gid", "h", "copies", "first").join(counts, "gid", "left")
    nodes = nodes.join(labels, F.col("gid") == F.col("node"), "left")
    nodes = stages.write(nodes.select("h", "copies", "first", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "gid").alias("root")), "nodes")
    names = nodes.groupBy("root").agg(F.min("first").alias("component"))
    named = stages.write(nodes.join(names, "root").select("h", (F.col("copies") - 1 + F.col("n")).alias("n"), "component"), "names")
    stages.drop(groups, described, links, nodes)
    component = F.coalesce("component", "vec_id")
    return slim.select("vec_id", "h").join(named, "h", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
