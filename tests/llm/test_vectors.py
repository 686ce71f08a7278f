import numpy as np
import pytest

from radiolens.llm import vectors
from radiolens.llm.vectors import vector_groups
from tests.llm.test_simhash import groups

SCHEMA = "vec_id long, embedding array<double>, label int, gid int, v int, h int, n int, pivot int"


def brute(rows, least=0.9):
    """Links by all pairs: {vec_id: links}, pairs."""
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    width = max((len(v) for _, v in good), default=0)
    unit = np.array([np.pad(v / np.linalg.norm(v), (0, width - len(v))) for _, v in good]).reshape(len(good), width)
    near = unit @ unit.T >= least
    ids = [i for i, _ in good]
    return {i: int(r.sum()) - 1 for i, r in zip(ids, near)}, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)))]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3, 4, 5) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("list_rows", [50_000, 40])
def test_recall_and_no_false_link(spark, list_rows):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 32))
    many = base[0] + 0.1 * rng.normal(size=(300, 32))  # a large group of near copies
    near = base[100:200] + 0.35 * rng.normal(size=(100, 32)) * rng.random((100, 1))
    data = [*base, *many, *near, *base[:5], *base[:3] * 7, *[base[9]] * 40]
    rows = [(int(i) * 3, v.tolist()) for i, v in enumerate(data)]
    want, pairs = brute(rows)
    out = {r.vec_id: r for r in vector_groups(frame(spark, rows), list_rows=list_rows).collect()}
    assert set(out) == set(want)
    assert all(out[i].n_links <= n for i, n in want.items())
    assert sum(r.n_links for r in out.values()) >= 0.97 * sum(want.values())
    name = groups(want, pairs)
    assert sum(out[i].component_id == name[i] for i in name) >= 0.99 * len(name)
    assert all(r.kept == (r.component_id == r.vec_id) for r in out.values())


@pytest.mark.parametrize("at", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_tables(spark, at):
    vectors = spark.read.parquet(f"/root/testdata/{at}/embeddings.parquet")
    want, pairs = brute([(r.vec_id, list(r.embedding)) for r in vectors.collect()])
    out = {r.vec_id: r for r in vector_groups(vectors).collect()}
    assert sum(r.n_links for r in out.values()) >= 0.99 * sum(want.values()) and all(out[i].n_links <= n for i, n in want.items())
    name = groups(want, pairs)
    assert sum(out[i].component_id == name[i] for i in name) >= 0.99 * len(name)


@pytest.mark.parametrize(("pivots", "low"), [(1024, 0.90), (4096, 0.90), (4096, 0.95)])
def test_recall_of_planted_pairs_with_many_pivots(spark, monkeypatch, pivots, low):
    """As many pivots as a large table has; each planted pair has a cosine from ``low`` to 0.01 above."""
    monkeypatch.setattr(vectors, "LEAST_PIVOTS", pivots)
    rng = np.random.default_rng(pivots)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, c = unit(rng.normal(size=(8000, 64))), rng.uniform(low, low + 0.01, size=(2000, 1))
    aside = rng.normal(size=(2000, 64))
    aside = unit(aside - (aside * a[:2000]).sum(axis=1, keepdims=True) * a[:2000])
    rows = [(i, v.tolist()) for i, v in enumerate([*a, *(c * a[:2000] + np.sqrt(1 - c * c) * aside)])]
    want, _ = brute(rows)
    out = {r.vec_id: r.n_links for r in vector_groups(frame(spark, rows)).collect()}
    assert all(out[i] <= n for i, n in want.items())
    recall = sum(out.values()) / sum(want.values())
    print(pivots, low, recall)
    assert recall >= 0.98


def test_vectors_without_direction(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]),
            (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (9, [1e300, 0.0]), (9, [1e300, 0.0]), (10, [0.0, 1.0])]
    out = sorted(map(tuple, vector_groups(frame(spark, rows)).collect()), key=str)
    linked = [(1, 3, 1, True), (2, 3, 1, False), (9, 3, 1, False), (9, 3, 1, False)]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 10)]
    assert out == sorted([*linked, *alone, (None, 0, None, False)], key=str)


def test_empty(spark):
    assert vector_groups(frame(spark, [])).count() == 0
    assert [tuple(r) for r in vector_groups(frame(spark, [(3, None)])).collect()] == [(3, 0, 3, True)]
