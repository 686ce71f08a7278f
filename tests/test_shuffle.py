import numpy as np
import pytest
from pyspark.sql import functions as F

from radiolens.plans.shuffle import _hashed, permuted


@pytest.mark.parametrize("n", [1, 2, 3, 10, 17, 26, 901, 40_000])
def test_true_permutations_that_differ(spark, n):
    """Every number once in each of ten repeats; the repeats are no shifts of each other."""
    table = spark.range(n).select("id", *[permuted(F.col("id"), F.lit(n).cast("long"), F.lit(s)).alias(f"s{s}") for s in range(10)])
    rows = table.orderBy("id").collect()
    orders = [[r[f"s{s}"] for r in rows] for s in range(10)]
    assert all(sorted(o) == list(range(n)) for o in orders)
    if n > 900:
        for a, b in zip(orders, orders[1:]):
            same = sum(x == y for x, y in zip(a, b))
            steps = len({(x - y) % n for x, y in zip(a, b)})
            assert same < 20 and steps > n / 2


def test_hash_is_that_of_spark(spark):
    rows = spark.range(200).select(F.xxhash64("id").alias("low"), F.xxhash64("id", F.lit(3)).alias("seed"))
    got = rows.select("low", "seed", F.xxhash64("low", "seed", F.lit(2))).collect()
    low, seed, wanted = (np.array([r[i] for r in got], np.int64) for i in range(3))
    assert (_hashed(low, seed, 2) == wanted).all()
