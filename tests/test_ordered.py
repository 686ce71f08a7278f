"""Chunked plans equal the plain ones, whatever the chunk length and the key distribution."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from radiolens.operators.features import first_difference, lags, rolling_mean_cell, rolling_std_cell
from radiolens.plans.ordered import LogOrder, carry, index_log, position, running_total
from radiolens.plans.quantiles import exact_quantiles

BY = ("t", "id")


def log(seed: int, n: int = 400) -> pd.DataFrame:
    """A third of the rows in one cell, some rows without a cell, ties in time, missing values."""
    rng = np.random.default_rng(seed)
    cell = np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 12, n).astype(float))
    cell[rng.random(n) < 0.05] = np.nan
    v = rng.integers(-100, 100, n) / 4.0
    v[rng.random(n) < 0.1] = np.nan
    return pd.DataFrame({"id": np.arange(n), "t": rng.integers(0, n // 3, n), "cell": cell, "v": v})


def frame(spark, pdf):
    rows = [tuple(None if pd.isna(x) else (int(x) if c in ("id", "t", "cell") else float(x)) for c, x in r.items())
            for r in pdf.to_dict("records")]
    return spark.createDataFrame(rows, "id bigint, t bigint, cell bigint, v double").repartition(5)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select("id", *columns).collect()), key=lambda r: r[0])


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            assert (p is None) == (q is None) and (p is None or p == pytest.approx(q, abs=1e-9)), (x, y)


few = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@few
@given(seed=st.integers(0, 99), chunk=st.integers(10, 150))
def test_windows_chunked(spark, seed, chunk):
    df = frame(spark, log(seed))
    plain = LogOrder(BY, ("cell",), plan="keyed")
    split = LogOrder(BY, ("cell",), plan="chunked", chunk_rows=chunk)

    def all_of(order):
        out = rolling_std_cell(rolling_mean_cell(lags(df, ["v"], order), ["v"], order), ["v"], order)
        return rows(first_difference(out, ["v"], order), "v_lag1", "v_lag2", "v_rmean_5", "v_rmean_10", "v_rstd_5", "v_diff")

    same(all_of(plain), all_of(split))


@few
@given(seed=st.integers(0, 99), chunk=st.integers(10, 150))
def test_scans_chunked(spark, seed, chunk):
    df = frame(spark, log(seed)).withColumn("one", F.lit(1))
    plain = LogOrder(BY, ("cell",), plan="keyed")
    split = LogOrder(BY, ("cell",), plan="chunked", chunk_rows=chunk)
    for op in (
        lambda o: rows(position(df, o, "p"), "p"),
        lambda o: rows(running_total(df, o, {"s": "one"}), "s"),
        lambda o: rows(carry(df, o, "v", {"before": True, "after": False}), "before", "after"),
    ):
        same(op(plain), op(split))


def test_keyless_equals_pandas(spark):
    pdf = log(5)
    order = LogOrder(BY, chunk_rows=37)
    got = rows(lags(frame(spark, pdf), ["v"], order), "v_lag1")
    want = pdf.sort_values(["t", "id"])
    want["v_lag1"] = want["v"].shift(1)
    want = [(int(i), None if pd.isna(x) else x) for i, x in sorted(zip(want["id"], want["v_lag1"]))]
    same(got, want)


def test_rolling_equals_pandas_and_null_cells(spark):
    pdf = log(6)
    got = rows(rolling_mean_cell(frame(spark, pdf), ["v"], LogOrder(BY, ("cell",)), (5,)), "v_rmean_5")
    ordered = pdf.sort_values(["cell", "t", "id"])
    ordered["m"] = ordered.groupby("cell")["v"].transform(lambda x: x.rolling(5, min_periods=1).mean())
    want = [(int(i), None if pd.isna(x) else x) for i, x in sorted(zip(ordered["id"], ordered["m"]))]
    same(got, want)


def test_index_is_dense_and_reused(spark):
    order = LogOrder(BY, ("cell",), chunk_rows=50)
    indexed = index_log(frame(spark, log(7)), order)
    places = sorted(r[0] for r in indexed.select(order.index).collect())
    assert places == list(range(400))
    again = lags(indexed, ["v"], order)  # keeps the numbering for the next operator
    assert order.index in again.columns and again.count() == 400
    other = LogOrder(("v", "id"), chunk_rows=50)  # another order does not take the numbers for its own
    assert rows(position(indexed, other, "p"), "p") == rows(position(frame(spark, log(7)), other, "p"), "p")


def test_no_key_goes_into_one_partition(spark):
    """The plan of a keyless window hashes by chunk and never collects into a single partition."""
    plan = lags(frame(spark, log(8)), ["v"], LogOrder(BY, chunk_rows=37))._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


@few
@given(seed=st.integers(0, 99))
def test_quantiles_equal_numpy(spark, seed):
    pdf = log(seed)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    for plan in ("keyed", "chunked"):
        got = {(r["cell"], r["prob"]): r["value"]
               for r in exact_quantiles(frame(spark, pdf), ["v"], probs, ["cell"], plan).collect()}
        for cell, part in pdf.dropna(subset=["v"]).groupby("cell", dropna=False):
            for p in probs:
                key = None if pd.isna(cell) else int(cell)
                assert got[(key, p)] == pytest.approx(np.quantile(part["v"], p), abs=1e-9)


def test_chunks_of_ties(spark):
    """One time for nearly all rows, NULL for others: chunks are cut by the id, none above twice the mean."""
    from radiolens.plans.ordered import CHUNK, _chunked

    n = 400_000
    df = spark.range(n).selectExpr("id", "case when id % 10 = 0 then null when id % 10 < 9 then 5 else id end as t")
    cut, by = _chunked(df, LogOrder(("t", "id"), chunk_rows=10_000))
    sizes = cut.groupBy(CHUNK).count().collect()
    assert by == ("t", "id") and len(sizes) == n // 10_000 + 1
    assert max(r["count"] for r in sizes) <= 2 * n / len(sizes)
    edges = cut.groupBy(CHUNK).agg(F.min(F.struct("t", "id")).alias("a"), F.max(F.struct("t", "id")).alias("b")).orderBy(CHUNK).collect()
    key = lambda x: (x.t is not None, x.t or 0, x.id)
    assert all(key(p.b) < key(q.a) for p, q in zip(edges, edges[1:]))
    order = LogOrder(("t", "id"), chunk_rows=10_000)
    placed = position(df, order, "place")
    assert placed.agg(F.min("place"), F.max("place"), F.count_distinct("place")).first() == (0, n - 1, n)


def test_number_of_chunks_follows_the_rows(spark):
    from radiolens.plans.ordered import CHUNK, _chunked

    for n, size in ((100, 101), (100, 7), (5, 1)):
        cut = _chunked(spark.range(n).selectExpr("id", "id as t"), LogOrder(("t", "id"), chunk_rows=size))
        assert (cut is None) == (n < size)
        if cut:
            assert cut[0].select(CHUNK).distinct().count() <= n // size + 1
