"""Splits, neighbors, resampling, fits, explanation and streams."""

import dataclasses
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from radiolens.operators import explain, resample, retrieve, score, split, train
from radiolens.plans import lockstep
from radiolens.plans.neighbors import knn_join, self_knn
from radiolens.plans.stage import scratch_path
from radiolens.sources import store
from radiolens.streaming import live

T0 = dt.datetime(2024, 1, 1)


def points(n=160, copies=60, seed=0):
    """A third of the rows are copies of one vector; many ties."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, (n, 3)).astype(float)
    x[rng.permutation(n)[:copies]] = [4.0, 4.0, 4.0]
    return x


def brute(q, base, k, skip_self):
    out = {}
    for i, a in enumerate(q):
        d = np.sqrt(((base - a) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(len(base)), d)) if not (skip_self and j == i)]
        out[i] = [(int(j), round(float(d[j]), 9)) for j in order[:k]]
    return out


def collected(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["id"], []).append((r["distance"], r["neighbor"]))
    return {i: [(n, round(d, 9)) for d, n in sorted(v)] for i, v in got.items()}


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id bigint, vector array<double>")


def test_self_knn_is_exact(spark):
    x = points()
    assert collected(self_knn(vectors(spark, x), 4, leaf_rows=16)) == brute(x, x, 4, True)


def test_knn_join_is_exact(spark):
    q, base = points(40, 5, 1), points(150, 50, 2)
    assert collected(knn_join(vectors(spark, q), vectors(spark, base), 3, leaf_rows=16)) == brute(q, base, 3, False)


def labeled(spark, x, y):
    rows = [(i, int(c), *map(float, v)) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id bigint, y int, a double, b double, c double")


def test_smote_balances_inside_the_boxes(spark):
    x = points(120, 30, 3)
    y = np.array([0] * 90 + [1] * 25 + [2] * 5)
    df = labeled(spark, x, y)
    rows = resample.smote(df, ["a", "b", "c"], "y", "id", k=4, seed=1).collect()
    assert {c: sum(r["y"] == c for r in rows) for c in (0, 1, 2)} == {0: 90, 1: 90, 2: 90}
    for r in rows:
        if r["turn"]:
            assert y[r["parent"]] == y[r["neighbor"]] == r["y"]
            p, q = x[r["parent"]], x[r["neighbor"]]
            at = np.array([r["a"], r["b"], r["c"]])
            assert np.all(at >= np.minimum(p, q) - 1e-9) and np.all(at <= np.maximum(p, q) + 1e-9)
    again = resample.smote(df.repartition(7), ["a", "b", "c"], "y", "id", k=4, seed=1).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_tomek_brute_force(spark):
    x = points(90, 20, 4)
    y = np.random.default_rng(5).integers(0, 2, 90)
    near = {i: v[0][0] for i, v in brute(x, x, 1, True).items()}
    linked = {i for i, j in near.items() if near[j] == i and y[i] != y[j]}
    kept = {r["id"] for r in resample.tomek_links(labeled(spark, x, y), ["a", "b", "c"], "y", "id", leaf_rows=16).collect()}
    assert linked and kept == set(range(90)) - linked


def test_split_shares_and_seed(spark):
    df = spark.range(1003).withColumn("y", F.when(F.col("id") % 9 == 0, 1).otherwise(0))
    one = split.stratified_split(df, "y", "id", seed=1)
    sizes = {(r["y"], r["split"]): r["count"] for r in one.groupBy("y", "split").count().collect()}
    assert sizes == {(0, "test"): 178, (0, "train"): 713, (1, "test"): 22, (1, "train"): 90}

    def test_ids(frame):
        return {r["id"] for r in frame.where("split = 'test'").collect()}

    assert test_ids(one) == test_ids(split.stratified_split(df.repartition(3), "y", "id", seed=1, plan="chunked"))
    assert test_ids(one) != test_ids(split.stratified_split(df, "y", "id", seed=2))


def test_impute_keeps_all_null_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (4.0, None)], "a double, b double")
    got = split.impute_median(df, df, ["a", "b"]).collect()
    assert sorted(r["a"] for r in got) == [1.0, 2.5, 4.0] and all(r["b"] is None for r in got)


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.2 * rng.normal(size=400) > 0.6).astype(int)
    rows = [(i, int(c), float(c), *map(float, v)) for i, (v, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "event_id bigint, y int, y_true double, a double, b double, c double")
    df = split.stratified_folds(df, "y", "event_id", 3)
    model = train.handover_models(400, train.TreeSizes(handover_trees=5))["RandomForest"]
    return df, model


def test_out_of_fold_covers_each_row_once(spark, fitted):
    df, model = fitted
    rows = train.out_of_fold(df, ["a", "b", "c"], {"RandomForest": model}, 3, rebalance=True).collect()
    assert sorted(r["event_id"] for r in rows) == list(range(400))
    table = train.cross_validate(df, ["a", "b", "c"], {"RandomForest": model}, "t", 3)
    assert table.first()["cv_roc_auc"] > 0.9


def test_score_and_importance(spark, fitted):
    df, model = fitted
    pipe = train.assembled(["a", "b", "c"], model).fit(df)
    rows = score.score(pipe, df, ["no", "yes"]).collect()
    for r in rows:
        assert sum(r["probabilities"].values()) == pytest.approx(1.0)
        assert r["confidence"] == pytest.approx(100 * max(r["probabilities"].values()), abs=0.01)
    importance = {r["feature"]: r["importance"] for r in explain.feature_importance(spark, pipe, ["a", "b", "c"]).collect()}
    assert max(importance, key=importance.get) == "a"
    permuted = {r["feature"]: r["importance"]
                for r in explain.permutation_importance(pipe, df, ["a", "b", "c"], repeats=3).collect()}
    assert permuted["a"] > 0.3 and abs(permuted["b"]) < 0.2 and set(permuted) == {"a", "b", "c"}


def test_margins_of_a_regression_fall_as_its_vectors(spark, fitted, monkeypatch):
    """Moving margins and scoring a vector for each pair and feature give the same falls, an endless value included."""
    df, _ = fitted
    df = df.withColumn("flat", F.lit(1.0))
    names = ["a", "b", "flat", "c"]
    pipe = train.assembled(names, train.handover_models(400)["LogisticRegression"]).fit(df)
    odd = df.withColumn("b", F.when(F.col("event_id") % 50 == 0, float("inf")).otherwise(F.col("b")))
    scored = []
    monkeypatch.setattr(explain, "array_to_vector", lambda x, f=explain.array_to_vector: scored.append(x) or f(x))
    for share in (0.5, 0.3):
        pipe.stages[-1].setThreshold(share)
        for rows in (df, odd):
            scored.clear()
            moved = sorted(map(tuple, explain.permutation_importance(pipe, rows, names, repeats=3).collect()))
            assert not scored
            with monkeypatch.context() as m:
                m.setattr(explain, "_linear", lambda _: False)
                whole = sorted(map(tuple, explain.permutation_importance(pipe, rows, names, repeats=3).collect()))
            assert [r[0] for r in moved] == sorted(names) and moved[0][1] > 0.2
            assert [v for r in moved for v in r[1:]] == pytest.approx([v for r in whole for v in r[1:]], abs=1e-12)
            assert ("flat", 0.0, 0.0) in moved


def test_rows_of_a_large_fit_are_spread_evenly(spark):
    """However the rows lie, no partition of a fit holds much more than its share; a small table stays as it is."""
    rows = spark.range(1000).withColumn("x", F.col("id") % 7).coalesce(1)
    sizes = train.spread_evenly(rows, 100).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) == 11 and max(r["count"] for r in sizes) < 150 and sum(r["count"] for r in sizes) == 1000
    assert train.spread_evenly(rows, 1000) is rows


def test_umts_tasks(spark, fitted):
    df, _ = fitted
    df = df.withColumns({"qos_degradee": F.col("y"), "split": F.when(F.col("event_id") < 280, "train")
                         .when(F.col("event_id") < 340, "validation").otherwise("test")})
    sizes = train.TreeSizes(umts_trees=5, umts_depth=5, umts_rounds=3)
    got = train.train_umts_tasks(df, ["a", "b", "c"], {"qos_degradee": "f1"}, keep=(), sizes=sizes)
    assert got.predictions.groupBy("task", "model").count().collect()[0]["count"] == 60
    assert got.thresholds.count() == 3 and len(got.models) == 3


def test_tree_fits_of_tasks_are_shared_stored_and_explained(spark, fitted, monkeypatch):
    """No tree is fitted by the library one stage at a time; a stored model scores as before and knows what it looked at."""
    df, _ = fitted
    table = df.withColumns({"key": F.xxhash64("event_id"), "weight": F.when(F.col("y") == 1, 2.0).otherwise(0.7)})
    sizes = train.TreeSizes(umts_trees=20, umts_depth=30, umts_rounds=20, handover_trees=20, handover_rounds=20)
    models = {**{f"u{n}": m for n, m in train.umts_models(400, sizes).items()}, **train.handover_models(400, sizes)}
    monkeypatch.setattr(train, "assembled", None)
    monkeypatch.setattr(lockstep, "SMALL", 0)
    for name in ("uRandomForest", "uGradientBoosting", "RandomForest", "GradientBoosting"):
        pipe = train.fit_tasks(table, ["a", "b", "c"], models[name])
        whole = train.whole_pipeline(df, ["a", "b", "c"], pipe)
        path = scratch_path(spark, "model")
        store.save_model(whole, {}, spark, path)
        again = store.load_model(spark, path)[0]
        own, other = (train.positive_probability(m.transform(df)).orderBy("event_id").toPandas() for m in (whole, again))
        assert (own["y_proba"] == other["y_proba"]).all() and own["y_proba"].between(0, 1).all()
        scored = train.positive_probability(pipe.transform(df)).toPandas()
        assert ((scored["y_proba"] > 0.5) == (scored["y"] == 1)).mean() > 0.9 and ((scored["y_proba"] > 0.5) == scored["prediction"]).all()
        found = {r["feature"]: r["importance"] for r in explain.feature_importance(spark, again, ["a", "b", "c"]).collect()}
        assert sum(found.values()) == pytest.approx(1) and max(found, key=found.get) == "a"


def test_nodes_in_parts_and_weights(monkeypatch):
    """Nodes of a level taken in parts make the same tree; weighting a class as often as repeating its rows does."""
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 32, (600, 4)).astype(np.uint8), rng.integers(0, 2, 600).astype(float)
    how = lockstep.Forest(depth=10, least=1)
    grow = lambda w, h: lockstep._tree(x, y, w, h, np.random.default_rng(1))
    whole = grow(np.ones(600), how)
    monkeypatch.setattr(lockstep, "NODES", 3)
    assert all((a == b).all() for a, b in zip(whole, grow(np.ones(600), how)))
    weighted, repeated = grow(np.ones(600), dataclasses.replace(how, weights=(1.0, 3.0))), grow(np.where(y == 1, 3.0, 1.0), how)
    assert all(np.allclose(a, b) for a, b in zip(weighted, repeated))


def test_boosted_probabilities_sum_to_one(spark, fitted):
    df, _ = fitted
    named = df.withColumn("coverage_zone", F.when(F.col("c") > 1, "C").when(F.col("y") == 1, "A").otherwise("B"))
    model, names = train.train_coverage(
        named, ["a", "b", "c"], sizes=train.TreeSizes(coverage_rounds=2, coverage_depth=2), rebalance=False)
    assert names == ["A", "B", "C"]
    for r in score.score(model, named.limit(20), names).collect():
        assert sum(r["probabilities"].values()) == pytest.approx(1.0)
        assert r["predicted_class"] == max(r["probabilities"], key=r["probabilities"].get)


def test_stored_zone_trees_score_as_before(spark, fitted):
    df, _ = fitted
    named = df.withColumn("coverage_zone", F.when(F.col("c") > 1, "C").when(F.col("y") == 1, "A").otherwise("B"))
    sizes = train.TreeSizes(coverage_rounds=5, coverage_depth=2)
    model, names = train.train_coverage(named, ["a", "b", "c"], sizes=sizes, rebalance=True)
    path = scratch_path(spark, "zones")
    store.save_model(model, {}, spark, path)
    again = store.load_model(spark, path)[0]
    own, other = (score.score(m, named, names).orderBy("event_id").toPandas() for m in (model, again))
    assert (own["predicted_class"] == other["predicted_class"]).all() and (own["confidence"] == other["confidence"]).all()
    assert (own["predicted_class"] == own["coverage_zone"]).mean() > 0.85 and own["predicted_class"].nunique() == 3


def test_embed_and_topk_plans_agree(spark):
    docs = spark.createDataFrame([(i, f"cell {i % 7} drop {i % 5} neighbor word{i}") for i in range(60)], "chunk_id bigint, text string")
    model = retrieve.embedder(docs, 64)
    base = retrieve.embed(docs, model).drop("text")
    asked = retrieve.embed(spark.createDataFrame([(1, "cell 3 drop"), (2, "neighbor word11")], "query_id bigint, text string"), model)
    near = {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["score"], 6)) for r in retrieve.cosine_topk(asked, base, 4).collect()}
    far = {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["score"], 6)) for r in retrieve.cosine_topk(asked, base, 4, block_rows=7).collect()}
    assert len(near) == 8 and near[(2, 1)][0] == 11
    assert {k: v[1] for k, v in near.items()} == pytest.approx({k: v[1] for k, v in far.items()}, abs=1e-5)
    assert retrieve.cosine_topk(asked, base.limit(3), 5).count() == 6


def test_chunks_keep_whole_texts(spark):
    text = " ".join(f"w{i}" for i in range(1001))
    df = spark.createDataFrame([("a/x.md", text), ("b/x.md", ""), ("b/y.md", " one two\n")], "source string, text string")
    rows = retrieve.chunk_ids(retrieve.chunk_words(df)).orderBy("source", "chunk").collect()
    assert [r["chunk_id"] for r in rows] == ["a/x_0", "a/x_1", "a/x_2", "b/y_0"]
    assert rows[2]["text"].split() == [f"w{i}" for i in range(900, 1001)] and rows[3]["text"] == "one two"


def test_stream_late_rows_are_dropped(spark):
    """A row behind the watermark is not emitted; the others equal the batch result."""
    path = scratch_path(spark, "arriving")
    schema = "event_id bigint, ts timestamp, psc int, rscp double, ecn0 double, rscp_det double"

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    put([(i, T0 + dt.timedelta(minutes=i), 1, -80.0 - i, -11.0, None) for i in range(0, 120, 2)])
    put([(i, T0 + dt.timedelta(minutes=i), 1, -80.0 - i, -11.0, None) for i in range(121, 400, 2)])
    put([(999, T0, 1, -50.0, -1.0, None)] + [(i, T0 + dt.timedelta(minutes=i), 1, -70.0, -5.0, -72.0) for i in range(401, 700)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    with live.rocksdb(spark):
        rows = live.drain(live.stream_features(stream, watermark="10 minutes"), scratch_path(spark, "out")).collect()
    got = {r["event_id"]: r for r in rows}
    assert 999 not in got and max(got) >= 680
    line = pd.DataFrame([(r["event_id"], r["rscp_rmean_5"], r["interference"]) for r in rows]).sort_values(0)
    values = [-80.0 - i if i < 400 else -70.0 for i in line[0]]
    assert np.allclose(line[1], pd.Series(values).rolling(5, min_periods=1).mean())
