import hashlib
import re

import pytest

from radiolens.llm import private
from radiolens.llm.catalog import QUERIES
from radiolens.llm.private import base_spans, find_private
from tests.llm.conftest import DATA

RAW = {
    1: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    2: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    3: r"[0-9]([\x20-]?[0-9])+",
    4: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for label, pattern in RAW.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            ok = {
                1: True, 2: label == 2 and all(int(x) <= 255 for x in m[0].split(".")) if label == 2 else True,
                3: 16 <= len(digits) <= 19 and sum(x // 10 + x % 10 for x in doubled) % 10 == 0, 4: 8 <= len(digits) <= 15,
            }[label]
            if ok:
                out.append((label, *m.span()))
    return out


CASES = [
    "", "a@b.c@d.e x@y a.b%+-@c-d.e.f. @x.y z@@q.r a@b@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4 9.9.9. 1..2.3.4.5 ..1.2.3.4",
    "4539 1488 0343 6467 4539148803436467x 4539-1488-0343-6467 1234567890123456 00000000000000000000", "4111 1111 1111 1111 22 4 1",
    "+1 (017) 555-7713. +1((((( +12345678 ++4420 7946 0958 +123 +1234567890123456 +49.30.123456-", "é😀 jo@x.org 😀 10.0.0.1", "a" * 3000 + "@" + "b" * 3000 + ".c" * 400,
    "1" * 5000 + " " + "1." * 3000, "+" * 2000 + "1" + " " * 2000, "x@y." + "z" * 2000 + "@" * 50,
]


@pytest.mark.parametrize("text", CASES, ids=range(len(CASES)))
def test_base_spans_equal_plain_patterns(text):
    assert base_spans(text) == brute(text)


def test_long_texts_stay_linear():
    for text in ("1" * 400_000, "a" * 400_000 + "@", "a." * 200_000 + "@", "1." * 200_000, "+1" + "(" * 400_000, "@" * 400_000):
        base_spans(text)


def test_query_against_brute_force(spark, documents):
    out = {r.doc_id: r for r in QUERIES["op10_personal_data"](spark, DATA).collect()}
    rows = documents.collect()
    assert len(out) == len(rows)
    for r in rows:
        got, want = out[r.doc_id], brute(r.text)
        names = [f"{private.KINDS[k - 1]}:{a}:{b}" for k, a, b in want]
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [sum(k == i for k, *_ in want) for i in (1, 2, 3, 4)]
        assert got.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert set(names) <= set(got.spans.split(","))


def test_repeated_mentions_are_found(spark, docs_of):
    """A number without its country code and an address without its domain's end, far from the full ones."""
    filler = "and some words in between " * 40
    full = [(i, f"write jo.{i}@mail{i % 7}.example.com or call +1 ({i:03d}) 555-{7000 + i} soon " + filler + f"call 555-{7000 + i} again") for i in range(200)]
    plain = [(1000 + i, f"there were {i} of {i * 7} things in {1900 + i} and 3.{i} more") for i in range(200)]
    alone = (5000, "call +1 (017) 555-9999 or else " + filler + "then again 555-9999 please, in 1999")
    rows = {r.doc_id: r for r in find_private(docs_of([*full, *plain, alone])).collect()}
    text = alone[1]
    at = text.index("555-9999", 40)
    added = [(s.kind, s.start, s.end) for s in rows[5000].spans if not s.base]
    assert added == [("phone", at, at + 8)]
    assert all(not rows[i].spans for i, _ in plain)
    base = [(s.kind, s.start, s.end) for s in rows[5].spans if s.base]
    assert base == [(private.KINDS[k - 1], a, b) for k, a, b in brute(full[5][1])]


def test_a_hundred_mentions_are_found_at_any_distance(spark, docs_of):
    filler = " and some words in between " * 3
    full = [(i, f"call +1 ({i:03d}) 555-{7000 + i} soon{filler}call 555-{7000 + i} again") for i in range(200)]
    plain = [(1000 + i, f"there were {i} of {i * 7} things in {1900 + i} and 3.{i} more") for i in range(200)]
    first, last = "call +1 (017) 555-9999 please", " then 555-9999 of" + filler
    texts = {5000: first + filler + last * 100, 5001: last * 50 + first + filler + last * 50, 5002: last * 100 + first}
    rows = {r.doc_id: r for r in find_private(docs_of([*full, *plain, *texts.items()])).collect()}
    for i, text in texts.items():
        want = {m.start() for m in re.finditer("(?<=then )555-9999", text)}
        assert len(want) == 100
        assert {s.start for s in rows[i].spans if s.kind == "phone" and not s.base} == want
    assert all(not rows[i].spans for i, _ in plain)


def test_message_passing_on_a_tree_is_exact():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    field = private.Field(rng.normal(size=(private.SLOTS, 5)), rng.normal(size=(4, 5, 5)))
    field.pair += field.pair.transpose(0, 2, 1)
    graph = private.Graph("tel 123-4567 x 99 y 123-4567 1.2", [])
    own = field.unary[np.array(graph.features)].sum(axis=1)
    graph.edges = np.array([(0, 1, 0), (0, 2, 1), (2, 3, 0)])
    want = np.zeros((4, 5))
    for ls in itertools.product(range(5), repeat=4):
        weight = np.exp(sum(own[i, k] for i, k in enumerate(ls)) + sum(field.pair[k, ls[a], ls[b]] for a, b, k in graph.edges))
        for i, k in enumerate(ls):
            want[i, k] += weight
    assert field.marginals(graph, rounds=200) == pytest.approx(want / want.sum(axis=1, keepdims=True), abs=1e-2)


def test_nulls_repeats_and_columns(docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "a@b.cd"), (3, "a@b.cd"), (3, "a@b.cd"), (4, "no such thing")]).selectExpr("*", "1 as spans", "2 as base")
    out = find_private(docs)
    assert out.columns == docs.columns
    assert sorted(len(r.spans) for r in out.collect()) == [0, 0, 0, 1, 1, 1]
    assert find_private(docs_of([])).count() == 0
    assert find_private(docs_of([(1, "none")])).first().spans == []
