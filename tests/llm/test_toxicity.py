import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiolens.llm import toxicity
from radiolens.llm.toxicity import fit_machine, held_out, score_toxicity, sigmoid


def ask(machine, terms):
    places = [[machine.place[s] for s in t if s in machine.place] for t in terms]
    rows = np.repeat(np.arange(len(terms)), [len(p) for p in places])
    return sigmoid(machine.logits(rows, np.array([x for p in places for x in p], dtype=np.int64), len(terms)))


def test_logits_are_a_factorization_machine():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(0.3, np.arange(6), rng.normal(size=6), rng.normal(size=(6, 3)))
    here = [0, 2, 5]
    want = 0.3 + sum(m.weights[i] for i in here) + sum(m.factors[i] @ m.factors[j] for i in here for j in here if i < j)
    assert m.logits(np.zeros(3, int), np.array(here), 1)[0] == pytest.approx(want)


def test_pairs_that_no_sum_of_weights_can_tell():
    rng = np.random.default_rng(2)
    terms, y = [], []
    for _ in range(2000):  # one alone is harmless, both are not, and neither is not either
        a, b = rng.random(2) < [0.5, 0.5]
        terms.append(np.array([10] * int(a) + [20] * int(b) + [30 + int(rng.integers(5))]))
        y.append(float(a == b) if rng.random() < 0.97 else float(a != b))
    m = fit_machine(terms, np.array(y), z=-1.0)
    p = ask(m, [[10, 20, 30], [10, 30], [20, 30], [30]])
    assert p[0] > 0.8 and p[3] > 0.8 and p[1] < 0.2 and p[2] < 0.2


def make(docs_of, n=600):
    words = [f"w{i}" for i in range(60)]
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words, 30))
        bad = i % 7 == 0
        rows.append((i, text + (" You IDIOT" if bad and i % 2 else " idiot thing" if bad else "")))
        labels.append((i, int(bad)))
    return rows, labels


def test_learns_and_keeps_rows(spark, docs_of):
    rows, labels = make(docs_of)
    rows += [(None, "idiot"), (9000, None), (9001, ""), (9002, "calm words"), (9002, "calm words"), (9003, "an idiot " + "w1 " * 100_000)]
    known = spark.createDataFrame([*labels, (9000, None), (None, 1)], "doc_id long, toxic int")
    docs = docs_of(rows)
    out = score_toxicity(docs, known)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
        assert (r.score >= 0.3) == ("idiot" in (r.text or "").lower())


def test_held_out_labels_are_not_learned_from(spark, docs_of):
    rows, labels = make(docs_of)
    assert {r.doc_id for r in docs_of(rows).where(held_out(F.col("doc_id"))).collect()} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    scores = [
        {r.doc_id: r.score for r in score_toxicity(docs_of(rows), spark.createDataFrame(x, "doc_id long, toxic int")).collect()}
        for x in (labels, other)
    ]
    assert scores[0] == scores[1]


def test_no_labels_and_no_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in score_toxicity(docs_of([(1, "idiot")]), none).collect()] == [0.0]
    assert score_toxicity(docs_of([]), none).count() == 0


def test_held_out_accuracy_on_the_given_tables(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    out = score_toxicity(docs, labels).join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("score", "toxic").collect()
    right = sum((r.score >= 0.3) == (r.toxic == 1) for r in out)
    assert right / len(out) > 0.9
