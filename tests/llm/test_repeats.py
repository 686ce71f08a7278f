import hashlib
import random
import re
import zlib

import pytest

from radiolens.llm.catalog import QUERIES, repeating
from radiolens.llm.repeats import WaveletTree, find_periods, letters_of, longest_run, periodic_runs
from tests.llm.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6):
    """Every period, every maximal stretch; a stretch keeps its smallest period."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def told(doc_id, text):
    """A row of the query, from its definition."""
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = [
        hashlib.sha256(x.encode()).hexdigest()
        for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))
    ]
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, *digest)


def test_wavelet_tree():
    import numpy as np

    rng = np.random.default_rng(1)
    values = rng.permutation(300)
    tree = WaveletTree(values, 9)
    lo = rng.integers(0, 300, 200)
    hi = np.minimum(lo + rng.integers(1, 60, 200), 300)
    limit = rng.integers(0, 600, 200)
    assert tree.below(lo, hi, limit).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(lo, hi, limit)]
    k = (hi - lo) // 2
    assert tree.smallest(lo, hi, k).tolist() == [int(np.sort(values[a:b])[i]) for a, b, i in zip(lo, hi, k)]


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_of_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            letters, words = rng.choice([1, 2, 3, 10]), []
            while len(words) < rng.randrange(0, 140):
                if rng.random() < 0.5:
                    part = [rng.randrange(letters) for _ in range(rng.randrange(1, 16))] * rng.randrange(1, 9)
                    part *= rng.choice([1, 1, 3])
                    words += part[: rng.randrange(1, len(part) + 1)]
                else:
                    words.append(rng.randrange(letters))
            texts.append([str(x).encode() for x in words])
        found = find_periods(*letters_of(texts)).tolist()
        for i, words in enumerate(texts):
            assert [tuple(r[1:]) for r in found if r[0] == i] == brute(words)


def test_fibonacci_and_long_texts():
    """Words with very many near repeats, a single letter, and a period of thousands of words."""
    a, b = ["a"], ["a", "b"]
    while len(b) < 4000:
        a, b = b, b + a
    rng = random.Random(3)
    long = [str(rng.randrange(5)) for _ in range(3000)] * 5
    for words in (b, ["x"] * 5000, (b[:700] * 6)[:4100], [w for x in b[:600] for w in x * 7]):
        coded = [[w.encode() for w in words]]
        assert [tuple(r[1:]) for r in find_periods(*letters_of(coded)).tolist()] == brute(words)
    assert (0, 15000, 3000) in [tuple(r[1:]) for r in find_periods(*letters_of([[w.encode() for w in long]])).tolist()]


def test_edges(spark, docs_of):
    """NULL, empty and blank texts, repeated rows, spaces that are not white space here, clashing columns."""
    texts = [None, "", " \n\t", "a " * 5, "a " * 6, "a " * 6, "a b c " * 4, "x\x1cy " * 9, "é ü " * 40 + "end"]
    docs = docs_of([(None if i == 5 else i, t) for i, t in enumerate(texts)]).selectExpr("*", "7 as runs", "8 as collapsed")
    rows = periodic_runs(docs).collect()
    assert len(rows) == len(texts) and rows[0].fp == 1
    for r in rows:
        words = WORD.findall(r.text or "")
        assert [tuple(x) for x in r.runs] == brute(words)
    assert {r.collapsed for r in rows if r.doc_id in (4, 6)} == {"a", "a b c"}
    assert periodic_runs(docs.limit(0)).collect() == []


def test_longest_run(spark):
    rows = spark.createDataFrame([([(5, 8, 2), (1, 8, 2), (1, 8, 1)],), ([],)], "runs array<struct<start: bigint, length: bigint, period: bigint>>")
    got = [r[0] for r in rows.select(longest_run(rows["runs"])).collect()]
    assert tuple(got[0]) == (1, 8, 1) and got[1] is None


def test_query_equals_its_definition(spark, documents, docs_of):
    got = sorted(map(tuple, QUERIES["op11_periodic_runs"](spark, DATA).collect()))
    assert got == sorted(told(r.doc_id, r.text) for r in documents.collect())
    changed = repeating(docs_of([(None, "a b"), (12, None)])).collect()
    assert sorted(map(tuple, changed), key=str) == sorted([(None, "a b"), (12, None)], key=str)
