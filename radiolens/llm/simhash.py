"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a binary trie self-join.

Two fingerprints that differ in at most 3 bits agree on one of four 16-bit blocks. Each distinct
fingerprint is therefore rotated four times; rows with the same rotation and first block form a cell, a
subtree of the trie paired with itself. A pair of nodes is traversed together: both step to a child, the
differing bits are added up, and the pair is given up beyond the budget. A cell with many rows is split
before it reaches a task: its node pair is replaced by the pairs of the nodes eight bits below that stay
within the budget, and so on until every cell is small. Tasks return spanning links, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolens.llm.common import Stages, components

SEED = 42
STEP = 8  # bits by which a large cell is split
CELL_ROWS = 20_000  # rows from which a cell is split
TASK_ROWS = 100_000  # rows that share a task, about
FRONT = 1_000_000  # node pairs expanded at a time


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bits that are set in over half the shingles' hashes; no words: zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, SEED) for x in parts], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text in slices
        some = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a (signed) long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, shingle) for x in texts], dtype=np.uint64).view(np.int64))

    return of(text.cast("string"))


def as_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def cells_of(prints: DataFrame, budget: int) -> DataFrame:
    """Distinct fingerprints (fp) as rows of cells: rotation, two nodes (a, b) of ``bits`` bits, side.

    Side 0: the row is in both nodes (a = b); 1: in a; 2: in b. ``diff``: differing bits above.
    """
    blocks = budget + 1
    width = 64 // blocks
    turn = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("r")
    rows = prints.select("fp", turn)
    shifted = [F.col("fp")] + [
        F.shiftleft("fp", width * i).bitwiseOR(F.shiftrightunsigned("fp", 64 - width * i)) for i in range(1, blocks)
    ]
    rows = rows.withColumn("v", F.element_at(F.array(*shifted), F.col("r") + 1))
    node = F.shiftrightunsigned("v", 64 - width)
    return rows.select(
        "fp", "v", "r", F.lit(width).alias("bits"), node.alias("a"), node.alias("b"), F.lit(0).alias("diff"), F.lit(0).alias("side")
    )


CELL = ["r", "bits", "a", "b"]


def split_cells(rows: DataFrame, budget: int) -> DataFrame:
    """Each cell replaced by the pairs of nodes ``STEP`` bits below that stay within the budget."""
    own = F.expr(f"cast(shiftrightunsigned(v, 64 - bits - {STEP}) & {(1 << STEP) - 1} as int)")
    other = F.expr(
        f"filter(sequence(0, {(1 << STEP) - 1}), q -> bit_count(own ^ q) + diff <= {budget})"
    )
    rows = rows.withColumn("own", own).select("*", F.explode(other).alias("q"))
    down = lambda node, part: F.shiftleft(node, STEP).bitwiseOR(F.col(part).cast("long"))
    first = (F.col("side") == 1) | ((F.col("side") == 0) & (F.col("own") <= F.col("q")))
    return rows.select(
        "fp", "v", "r", (F.col("bits") + STEP).alias("bits"),
        F.when(first, down("a", "own")).otherwise(down("a", "q")).alias("a"),
        F.when(first, down("b", "q")).otherwise(down("b", "own")).alias("b"),
        (F.col("diff") + F.bit_count(F.col("own").bitwiseXOR(F.col("q")))).cast("int").alias("diff"),
        F.when((F.col("side") == 0) & (F.col("own") == F.col("q")), 0).when(first, 1).otherwise(2).cast("int").alias("side"),
    )


def link(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j in ``root``, where every set points to its smallest member."""
    while len(i):
        a, b = root[i], root[j]
        far = a != b
        i, j, a, b = i[far], j[far], a[far], b[far]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def traverse(v: np.ndarray, fronts: list[tuple], budget: int, root: np.ndarray) -> None:
    """Walk node pairs down the trie over ``v`` and join linked rows in ``root``.

    ``v``: values, ascending inside every node. ``fronts``: (depth, from 1, to 1, from 2, to 2, diff) with
    arrays of half-open row ranges. Fronts are cut so that a bounded number of pairs is open.
    """
    ones = np.zeros((64, 0)) if not len(v) else None
    counts: dict[int, np.ndarray] = {}

    def below(depth: int) -> np.ndarray:  # running count of rows whose next bit is set
        if depth not in counts:
            bit = (v >> np.uint64(63 - depth)) & np.uint64(1)
            counts[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        return counts[depth]

    stack = [] if ones is not None else list(fronts)
    while stack:
        depth, s1, e1, s2, e2, diff = stack.pop()
        if len(s1) > FRONT:
            for half in np.array_split(np.arange(len(s1)), -(-len(s1) // FRONT)):
                stack.append((depth, s1[half], e1[half], s2[half], e2[half], diff[half]))
            continue
        same = (s1 == s2) & (e1 == e2)
        single = (e1 - s1 == 1) & (e2 - s2 == 1)
        leaf = single & ~same
        if leaf.any():
            i, j = s1[leaf], s2[leaf]
            near = np.bitwise_count(v[i] ^ v[j]) <= budget
            link(root, i[near], j[near])
        sure = ~single & (diff + (64 - depth) <= budget)  # whatever follows, the budget holds
        for a, b, c, d in zip(s1[sure], e1[sure], s2[sure], e2[sure]):
            every = np.concatenate([np.arange(a, b), np.arange(c, d)])
            link(root, np.full(len(every), a), every)
        go = ~single & ~sure
        if not go.any():
            continue
        s1, e1, s2, e2, diff, same = s1[go], e1[go], s2[go], e2[go], diff[go], same[go]
        c = below(depth)
        m1, m2 = e1 - (c[e1] - c[s1]), e2 - (c[e2] - c[s2])
        crossed = ~same
        parts = [
            (s1, m1, s2, m2, diff), (m1, e1, m2, e2, diff), (s1, m1, m2, e2, diff + 1),
            (m1[crossed], e1[crossed], s2[crossed], m2[crossed], diff[crossed] + 1),
        ]
        n = [np.concatenate(x) for x in zip(*parts)]
        open_ = (n[1] > n[0]) & (n[3] > n[2]) & (n[4] <= budget)
        if open_.any():
            stack.append((depth + 1, *[x[open_] for x in n]))


def links_of(frame: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Spanning links (a, b) of the cells in ``frame``."""
    frame = frame.assign(side=np.where(frame["side"] == 2, 1, 0), u=frame["v"].to_numpy().view(np.uint64))
    frame = frame.sort_values([*CELL, "side", "u"], ignore_index=True)
    v, root = frame["u"].to_numpy(), np.arange(len(frame))
    starts = np.flatnonzero(np.concatenate([[True], (frame[CELL].diff().iloc[1:] != 0).any(axis=1)]))
    ends = np.concatenate([starts[1:], [len(frame)]])
    second = np.concatenate([[0], np.cumsum(frame["side"].to_numpy())])
    middle = ends - (second[ends] - second[starts])
    self_ = frame["a"].to_numpy()[starts] == frame["b"].to_numpy()[starts]
    s2, e1, e2 = np.where(self_, starts, middle), np.where(self_, ends, middle), ends
    bits, diff = frame["bits"].to_numpy()[starts], frame["diff"].to_numpy()[starts].astype(np.int64)
    full = (e1 > starts) & (e2 > s2)
    fronts = []
    for depth in np.unique(bits):
        own = full & (bits == depth)
        fronts.append((int(depth), starts[own], e1[own], s2[own], e2[own], diff[own]))
    traverse(v, fronts, budget, root)
    linked = root != np.arange(len(root))
    fp = frame["fp"].to_numpy()
    return pd.DataFrame({"a": fp[linked], "b": fp[root[linked]]}).query("a != b")


def linked_fingerprints(prints: DataFrame, stages: Stages, budget: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``budget`` bits; ``prints``: distinct (fp)."""
    rows, done = stages.write(cells_of(prints, budget), "cells"), []
    width = 64 // (budget + 1)
    for bits in range(width, 64 - STEP + 1, STEP):
        counts = rows.groupBy(*CELL).count().where(F.col("count") > cell_rows).select(*CELL)
        large = stages.write(counts, "largecells")
        if large.isEmpty():
            stages.drop(large)
            break
        done.append(rows.join(large, CELL, "left_anti").select(rows.columns))
        rows = stages.write(split_cells(rows.join(large, CELL, "left_semi").select(rows.columns), budget), "cells")
    for part in done:
        rows = rows.unionByName(part)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    sharded = rows.withColumn("task", F.pmod(F.xxhash64(*CELL), F.lit(tasks)))
    return sharded.groupBy("task").applyInPandas(lambda frame: links_of(frame, budget), "a long, b long")


def simhash_groups(
    docs: DataFrame, shingle: int = 5, budget: int = 3, text: str = "text", key: str = "doc_id", cell_rows: int = CELL_ROWS
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer words than ``shingle`` is
    one shingle, a text without words has fingerprint zero and is linked like any other. The component is
    the smallest doc_id reachable by links of at most ``budget`` differing bits, itself included.

    NULL text: no words. NULL ids never name a component beside an id. Repeated rows share all they have.
    Equal fingerprints are joined as one, so copies are never paired. Empty table: no rows. Other columns
    are ignored.
    """
    stages = Stages(docs.sparkSession)
    slim = stages.write(docs.select(F.col(key).alias("doc_id"), fingerprints(F.col(text), shingle).alias("fp")), "prints")
    prints = slim.groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = linked_fingerprints(prints.select("fp"), stages, budget, cell_rows)
    labels = components(edges, stages)
    rooted = prints.join(labels, prints["fp"] == labels["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root")
    )
    rooted = stages.write(rooted, "roots")
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stages.write(rooted.join(names, "root").select("fp", "component_id"), "names")
    stages.drop(rooted)
    return slim.join(named, "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, budget: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents whose id names their component, with their columns. Documents without an id all stay."""
    groups = simhash_groups(docs, shingle, budget, text, key)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept id"))
    named = docs.join(kept, docs[key] == kept["kept id"], "left_semi")
    return named.unionByName(docs.where(docs[key].isNull()))
