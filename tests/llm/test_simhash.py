import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash

from radiolens.llm import simhash
from radiolens.llm.common import Stages, components
from radiolens.llm.simhash import fingerprint, one_of_each, simhash_groups


def plain_print(text, n):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(ids, edges):
    name = {i: i for i in ids}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        name[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "ONE two", "a b c", "É é A a", "x " * 999, "no break \x0b y z q"])
def test_fingerprint(text):
    assert fingerprint(text, 3) == plain_print(text, 3)


def near(rng, n):
    values = [rng.getrandbits(64) for _ in range(n)]
    for v in values[: n // 2]:
        for _ in range(3):
            values.append(v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    return [0, 1, (1 << 64) - 1, (1 << 64) - 8, *values]


@pytest.mark.parametrize("cell_rows", [simhash.CELL_ROWS, 3])
def test_trie_join_equals_all_pairs(spark, cell_rows):
    values = sorted(set(near(random.Random(4), 250)))
    close = {(a, b) for a, b in combinations(values, 2) if (a ^ b).bit_count() <= 3}
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    stages = Stages(spark)
    out = simhash.linked_fingerprints(frame, stages, 3, cell_rows).collect()
    mask = (1 << 64) - 1
    found = {(min(r.a & mask, r.b & mask), max(r.a & mask, r.b & mask)) for r in out}
    assert groups(values, found) == groups(values, close)


def test_one_hot_cell():
    rng = random.Random(5)
    values = np.array([sum(1 << b for b in rng.sample(range(40), rng.randrange(0, 4))) for _ in range(3000)], dtype=np.uint64)
    values = np.unique(values)
    frame = pd.DataFrame({"fp": values.view(np.int64), "v": values.view(np.int64), "r": 0, "bits": 16, "a": 0, "b": 0, "diff": 0, "side": 0})
    old, simhash.FRONT = simhash.FRONT, 5000
    try:
        out = simhash.links_of(frame, 3)
    finally:
        simhash.FRONT = old
    assert len(out) == len(values) - 1  # all reach zero


def test_components_against_union(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(6000, 6200)] + [(3, 3)]
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.component for r in components(frame, Stages(spark)).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert found == {k: v for k, v in groups({x for e in edges for x in e}, edges).items() if k in linked}
    assert components(frame.limit(0), Stages(spark)).count() == 0


def test_groups_against_brute_force(spark, documents):
    rows = documents.collect()
    prints = {r.doc_id: plain_print(r.text, 3) for r in rows}
    close = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = groups(prints, close)
    out = simhash_groups(documents, 3).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in out} == {(i, f"{p:016x}", want[i]) for i, p in prints.items()}
    kept = {r.doc_id for r in one_of_each(documents, 3).select("doc_id").collect()}
    assert kept == set(want.values())


def test_edges_of_the_contract(docs_of):
    text = "some words that make a text " * 9
    docs = docs_of([(5, text), (3, text.upper()), (None, text), (8, None), (9, ""), (9, ""), (None, "quite another text of its own " * 3)])
    out = simhash_groups(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in out) == [(-1, -1), (-1, 3), (3, 3), (5, 3), (8, 8), (9, 8), (9, 8)]
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 3, 8]
    assert simhash_groups(docs_of([])).count() == 0
