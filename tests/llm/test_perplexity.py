import math
from collections import Counter, defaultdict

import pytest

from radiolens.llm.perplexity import UNIFORM, score_quality
from tests.llm.conftest import DATA


def model(texts, order):
    """Interpolated modified Kneser-Ney over bytes, written from the definition."""
    counts = [None] * (order + 1)
    counts[order] = Counter()
    for t in texts:
        padded = b"\0" * (order - 1) + t
        counts[order].update(padded[i : i + order] for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, after = [None] * (order + 1), [None] * (order + 1)
    for k in range(1, order + 1):
        n = Counter(counts[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        discounts[k] = [0] + [min(i, max(0, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] and n[1] else i / 2 for i in (1, 2, 3)]
        after[k] = defaultdict(list)
        for g, c in counts[k].items():
            after[k][g[:-1]].append(c)

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else UNIFORM
        own = after[k].get(g[:-1])
        if not own:
            return lower
        d = discounts[k]
        spare = sum(d[min(c, 3)] for c in own)
        c = counts[k][g]
        return (max(0, c - d[min(c, 3)]) * (c > 0) + spare * lower) / sum(own)

    return p


def perplexity(p, text, order):
    padded = b"\0" * (order - 1) + text
    return math.exp(-sum(math.log(p(padded[i : i + order])) for i in range(len(text))) / len(text))


@pytest.mark.parametrize("shard_rows", [4_000_000, 200])
def test_against_the_definition(spark, docs_of, shard_rows):
    rows = [(i, f"the {'cat dog cow'.split()[i % 3]} sat on the {'mat hat'.split()[i % 2]} é {i % 4}") for i in range(40)]
    rows += [(100, "zzz qqq ### the"), (101, ""), (102, None), (103, "the"), (None, "the cat"), (7, rows[7][1]), (104, "cat " * 30_000)]
    trusted = spark.createDataFrame([(i,) for i in range(0, 40, 2)] + [(None,), (500,)], "doc_id long")
    out = score_quality(docs_of(rows), trusted, 0.9, 1.0, shard_rows=shard_rows).collect()
    assert len(out) == len(rows)
    p = model([t.encode() for i, t in rows if i is not None and i < 40 and i % 2 == 0], 4)
    texts = {(i, len((t or "").encode())): (t or "").encode() for i, t in rows}
    for r in out:
        text = texts[r.doc_id, r.n_bytes]
        if not text:
            assert r.perplexity is None and not r.kept
            continue
        if len(text) < 1000:
            assert r.perplexity == pytest.approx(perplexity(p, text, 4), rel=1e-9)
        assert r.kept == (r.perplexity <= r.threshold)
    inside = sorted(r.perplexity for r in out if r.doc_id is not None and r.doc_id < 40 and r.doc_id % 2 == 0)
    assert inside[17] <= out[0].threshold <= inside[18] * 1.01


def test_languages(spark, docs_of):
    docs = docs_of([(1, "some text"), (2, "some other text"), (3, "text"), (4, "x")]).selectExpr(
        "doc_id", "text", "case doc_id when 3 then null when 4 then 'xx' else 'en' end as lang", "1 as n", "2 as code"
    )
    trusted = spark.createDataFrame([(1,), (3,)], "doc_id long")
    out = {r.doc_id: r for r in score_quality(docs, trusted).collect()}
    assert out[3].lang is None and out[3].perplexity > 0
    assert out[4].perplexity is None and out[4].threshold is None and out[4].kept
    assert out[1].threshold == out[2].threshold != out[3].threshold
    assert score_quality(docs.limit(0), trusted).count() == 0
    assert all(r.kept and r.perplexity is None for r in score_quality(docs, trusted.limit(0)).collect())


def test_probabilities_sum_to_one():
    p = model([b"abracadabra", b"banana", b"bandana"], 3)
    for context in (b"\0\0", b"an", b"zz", b"ab"):
        assert sum(p(context + bytes([c])) for c in range(256)) == pytest.approx(1)


def test_junk_goes_and_clean_text_stays(spark):
    at = DATA.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    out = score_quality(docs, labels.where("quality = 1")).join(labels, "doc_id").groupBy("quality").agg({"*": "count", "kept": "count_if"})
    share = {r[0]: r["count_if(kept)"] / r["count(1)"] for r in out.collect()}
    assert share[1] >= 0.985 and share[0] <= 0.5
