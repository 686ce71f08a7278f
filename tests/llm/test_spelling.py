import random
import re
import zlib
from collections import Counter

import pytest

from radiolens.llm.catalog import QUERIES
from radiolens.llm.spelling import Acceptor, count_words, near_words, spelling_variants, worn_words
from tests.llm.conftest import DATA

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=2):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(rows)


def plain_counts(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in RUN.findall((text or "").translate(LOW)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def random_words(seed, letters, shortest, longest, n):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(shortest, longest + 1))): rng.randrange(1, 50) for _ in range(n)}


def test_machine():
    for seed in range(40):
        words = sorted(random_words(seed, "ab", 1, 7, 40))
        machine = Acceptor()
        initial = machine.add(words)
        got = sorted(tuple(sorted(p)) for p in machine.near(initial, True))
        assert got == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))
        assert len(machine.arcs) <= sum(map(len, words)) + 1
    machine = Acceptor()
    machine.add(["ax", "bx", "cx"])
    assert len(machine.arcs) == 3  # minimal: the three words share all but the first arc


@pytest.mark.parametrize("most", [1000, 7, 1])
def test_against_all_pairs(spark, most):
    """Also where every part is too large and is cut down to single edits."""
    counts = random_words(most, "abc", 1, 8, 250 if most > 1 else 40) | {"prefix" + w + "suffix": n for w, n in random_words(5, "abcé", 0, 3, 60).items()}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = [(r.word, r.near, r.near_n) for r in near_words(words, most=most).collect()]
    assert sorted(pairs) == sorted((a, b, counts[b]) for a in counts for b in counts if one_edit(a, b))
    got = sorted((tuple(r) for r in spelling_variants(words, most=most).collect()))
    assert got == brute(counts)


def test_chains_ties_and_odd_rows(spark):
    rows = [("aaaaa", 100), ("aaaab", 40), ("aaabb", 12), ("aabbb", 4), ("abbbb", 1), ("zzzzz", 9), ("zzzzy", 18), ("zzzzx", 18)]
    odd = [(None, 4), ("", 4), ("zzzzz", None), ("q" * 3000, 3), ("q" * 3001, 9)]
    words = spark.createDataFrame([(w, n, 1, 2) for w, n in rows + odd], "word string, n long, half int, label int")
    got = {r.word: r for r in spelling_variants(words).collect()}
    assert len(got) == len(rows) + 2
    assert got["abbbb"].root == "aaaaa" and got["abbbb"].form == "aabbb" and got["aaaaa"].form is None
    assert got["zzzzz"].form == "zzzzx" and got["zzzzx"].n_near == 2
    assert got["q" * 3000].form == "q" * 3001
    assert spelling_variants(words.limit(0)).collect() == []


def test_tokens(spark, docs_of):
    docs = docs_of([(None, "Hello hello"), (1, None), (2, ""), (3, "éÉ×÷ ñandÚ x1y"), (3, "éÉ×÷ ñandÚ x1y")] + [(i, "Wonderful Words") for i in range(300)])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = worn_words(docs, r"[A-Za-zÀ-ÿ]+", 97)
    assert {r.word: r.n for r in count_words(got).collect()} == plain_counts(rows)


def test_query(spark, documents):
    counts = plain_counts([(r.doc_id, r.text) for r in documents.collect()])
    got = sorted(tuple(r) for r in QUERIES["op13_spelling_variants"](spark, DATA).collect())
    assert got == brute(counts) and any(r[1] for r in got)
