import hashlib

import duckdb
import pytest

from radiolens.llm.catalog import QUERIES, SQL
from radiolens.llm.exact import exact_duplicates
from radiolens.llm.mixing import mix_sources, mixed_documents
from tests.llm.conftest import DATA
from tools.verify import normal

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    frame = QUERIES[name](spark, DATA)
    rows = [tuple(r[c] for c in frame.columns) for r in frame.collect()]
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(frame.columns)
    assert normal(rows, frame.columns) == normal(want.fetchall(), names)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(docs_of, keep):
    rows = [(1, "Ab"), (2, "aB"), (3, "Äb"), (4, "äb"), (5, None), (6, ""), (7, "x" * 200_000), (8, "X" * 200_000), (None, "ab"),
            (None, "alone"), (2, "aB")]
    out = exact_duplicates(docs_of(rows), keep=keep).collect()
    assert len(out) == len(rows)
    norm = {(i, hashlib.sha256((t or "").translate(LOW).encode()).hexdigest()) for i, t in rows}
    assert {(r.doc_id, r.text_sha256) for r in out} == norm
    pick = min if keep == "min" else max
    by = {}
    for i, t in rows:
        by.setdefault(hashlib.sha256((t or "").translate(LOW).encode()).hexdigest(), []).append(i)
    for r in out:
        ids = [i for i in by[r.text_sha256] if i is not None]
        assert r.group_size == len(by[r.text_sha256])
        assert r.keep_id == (pick(ids) if ids else None)
        assert r.kept == (r.doc_id is not None and r.doc_id == r.keep_id)


def test_exact_empty(docs_of):
    assert exact_duplicates(docs_of([])).count() == 0


def spot(i):
    return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)


def brute_mix(rows, weights, share, most):
    size = [len((t or "").split()) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    target, left, open_ = {}, share * sum(size), set(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > most * total[s]}
        for s in over or open_:
            target[s] = most * total[s] if over else weight[s] * level
            left -= target[s] if over else 0
        open_ -= over or open_
    copies = [0] * len(rows)
    for s in sources:
        for tier in range(2):
            budget = max(0, min(target[s] - tier * total[s], total[s]))
            below = 0
            own = [k for k, r in enumerate(rows) if r[2] == s]
            for at in sorted({spot(rows[k][0]) for k in own}):
                here = [k for k in own if spot(rows[k][0]) == at]
                n = sum(size[k] for k in here)
                if budget > 0 and (below + n / 2 <= budget or budget >= total[s]):
                    for k in here:
                        copies[k] += 1
                below += n
    return size, target, total, copies


@pytest.mark.parametrize("share", [0.3, 1.5, 1.9])
def test_mix_against_brute_force(docs_of, share):
    rows = [(i, "w " * (i * 7 % 23), ["b", "a", None, "é", "Z"][(i * i) % 5]) for i in range(300)]
    rows += [(None, "no id", "a"), (None, None, "b"), (7, "again " * 5, "a"), (7, "again " * 5, "a"), (999, "word " * 3000, "a"), (1000, None, "only empty")]
    out = mix_sources(docs_of(rows), (3, 1, 2), share, 2.0).collect()
    size, target, total, copies = brute_mix(rows, (3, 1, 2), share, 2.0)
    want = sorted(((r[0], r[2], n, c) for r, n, c in zip(rows, size, copies) if n), key=str)
    assert sorted(((r.doc_id, r.source, r["size"], r.copies) for r in out if r["size"]), key=str) == want
    assert len(out) == len(rows)
    for r in out:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == total[r.source]
        assert r.taken == r.copies * r["size"]


def test_mixed_documents_repeat_rows(docs_of):
    docs = docs_of([(i, "w " * (i % 9), "ab"[i % 2]) for i in range(60)])
    copies = {r.doc_id: r.copies for r in mix_sources(docs, (3, 1, 2), 1.5, 2.0).collect()}
    out = mixed_documents(docs, (3, 1, 2), 1.5, 2.0)
    assert out.columns == docs.columns
    found = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert found == {k: v for k, v in copies.items() if v}


def test_mix_given_weights_and_empty(spark, docs_of):
    docs = docs_of([(i, "w w", "ab"[i % 2]) for i in range(40)])
    weights = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    out = mix_sources(docs, weights, 0.5, 2.0).collect()
    assert {r.source for r in out} == {"a"}
    assert mix_sources(docs_of([]), (3, 1, 2), 1.5, 2.0).count() == 0
    assert mixed_documents(docs_of([]), (3, 1, 2), 1.5, 2.0).count() == 0
