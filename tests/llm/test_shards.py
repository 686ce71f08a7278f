import struct
import zlib
from collections import Counter
from math import isqrt

import pytest
import xxhash
from pyspark.sql import functions as F

from radiolens.llm.catalog import QUERIES
from radiolens.llm.common import Stages
from radiolens.llm.shards import PIECE, ROUNDS, number_at, number_rows, permuted, place, shard_rows, steps_needed, write_shards
from tests.llm.conftest import DATA


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_hash(seed, i, x):
    """The hash of (long, int, long): each one seeds the next."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", seed), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<i", i), h)
    return signed(xxhash.xxh64_intdigest(struct.pack("<q", x), h))


def plain_walk(x, n, seed):
    a = isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for i in range(ROUNDS):
            if i % 2 == 0:
                left = (left + plain_hash(seed, i, right)) % a
            else:
                right = (right + plain_hash(seed, i, left)) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 3, 17, 1009])
def test_permutation(spark, n):
    for seed in (7,):
        got = spark.range(n).withColumn("x", permuted(spark, F.col("id"), n, seed))
        want = {i: plain_walk(i, n, seed) for i in range(n)}
        assert {r.id: r.x for r in got.collect()} == want and sorted(want.values()) == list(range(n))
        again = got.withColumn("y", permuted(spark, F.col("x"), n, seed, back=True))
        assert all(r.id == r.y for r in again.collect())


def test_walks_are_counted(spark):
    """Some size has walks of more than one step, and the plan has the steps of the longest."""
    many = {n: steps_needed(spark, n, 3) for n in (3, 17, 1000)}
    assert max(many.values()) > 1
    for n, steps in many.items():
        assert steps <= 2 * isqrt(n) + 2


def test_places_are_computable(spark):
    placed = place(spark.range(1000).withColumnRenamed("id", "i"), "i", 1000, 16, 5)
    assert all(r.i == r.number for r in number_at(placed, 1000, 16, 5).collect())
    assert number_at(placed.where("shard = 3 and slot = 40"), 1000, 16, 5).count() == 1


def law(rows, shards):
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(shards)}
    assert all(x == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_rows_of_any_kind(spark, docs_of):
    docs = docs_of([(None, None), (1, ""), (1, ""), (2, "a"), (None, None), (3, "a" * 100_000)] + [(i, "t") for i in range(50)])
    docs = docs.selectExpr("*", "9 as shard", "1 as copies", "2 as number", "3 as `feistel left`", "4 as PERMUTED", "array(1) as `a b`")
    rows = shard_rows(docs, 4).collect()
    law(rows, 4)
    assert Counter((r.doc_id, r.text, r.copies, r.number) for r in rows) == Counter((r.doc_id, r.text, 1, 2) for r in docs.collect())
    law(shard_rows(docs.limit(2), 4).collect(), 4)
    assert shard_rows(docs.limit(0), 4).collect() == []


def test_one_row_many_times(spark):
    """A third of the rows are one and the same: numbered in pieces, all numbers taken once."""
    rows = spark.range(40_000).selectExpr("id as doc_id").union(spark.range(2 * PIECE + 17).selectExpr("-1L"))
    numbered, n = number_rows(rows, "number", Stages(spark))
    got = numbered.collect()
    assert n == 40_000 + 2 * PIECE + 17 and sorted(r.number for r in got) == list(range(n))
    law(shard_rows(rows, 16).collect(), 16)


def test_reruns_agree(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "cast(id % 7 as string) as text")
    first = shard_rows(rows.repartition(3), 16, 1)
    second = shard_rows(rows.orderBy("text").repartition(11, "text"), 16, 1)
    other = shard_rows(rows, 16, 2)
    first, second, other = ({r.doc_id: (r.shard, r.slot) for r in df.collect()} for df in (first, second, other))
    assert first == second != other
    near = sum(first[i][0] == first[i + 1][0] for i in range(2999))
    assert near < 2 * 2999 / 16  # neighbours do not stay together


def test_written_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    write_shards(shard_rows(spark.range(500), 4), path, 3)
    rows = spark.read.parquet(path).collect()
    law(rows, 4)
    assert sorted(r.id for r in rows) == list(range(500))


def test_query(spark, documents):
    rows = QUERIES["op12_feistel_shards"](spark, DATA).collect()
    law(rows, 16)
    want = {r.doc_id: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in documents.collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == want and len(rows) == len(want)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    # shard and slot of every row from the definition
    def spot(r):
        h = xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)
        for x in (r.size, r.text_crc32, 0):
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        return signed(h)

    for number, r in enumerate(sorted(rows, key=spot)):  # one bucket here
        p = plain_walk(number, len(rows), 42)
        assert (r.shard, r.slot) == (p % 16, p // 16)
