from itertools import combinations

import pytest

import corpus_pipeline as pipeline
from radiolens.llm.toxicity import score_toxicity
from tests.llm.conftest import DATA
from tests.llm.test_exact_mixing import brute_mix
from tests.llm.test_lines import brute
from tests.llm.test_simhash import groups, plain_print


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and result as rows."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, DATA).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs.collect(), after.collect())
        docs = after
    return out


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_shape(stages):
    assert list(stages) == ["toxicity", "lines", "simhash", "mix", "encode"]
    for name in list(stages)[:-1]:
        assert stages[name][1][0].__fields__ == COLUMNS


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    calm = {r.doc_id for r in score_toxicity(docs, labels).where("score < 0.3").collect()}
    assert {tuple(r) for r in after} == {tuple(r) for r in before if r.doc_id in calm}


def test_lines(stages):
    before, after = stages["lines"]
    texts, counts = brute([(r.doc_id, r.text) for r in before], 50)
    want = [(r.doc_id, t := texts[False, r.doc_id, r.text], r.lang, r.source, len(t)) for r in before]
    assert sorted(map(tuple, after)) == sorted(want)
    assert any(counts.values())


def test_simhash(stages):
    before, after = stages["simhash"]
    prints = {r.doc_id: plain_print(r.text, 3) for r in before}
    name = groups(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if name[r.doc_id] == r.doc_id)


def test_mix(stages):
    before, after = stages["mix"]
    *_, copies = brute_mix([(r.doc_id, r.text, r.source) for r in before], (3, 1, 2), 1.5, 2.0)
    want = [tuple(r) for r, n in zip(before, copies) for _ in range(n) if r.text]
    assert sorted(tuple(r) for r in after if r.text) == sorted(want)


def test_encode_and_run(spark, stages):
    before, after = stages["encode"]
    assert len(before) == len(after) and all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in after)
    whole = pipeline.run(spark, DATA).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, after))


def test_odd_documents(spark, stages):
    """NULLs, repeated rows and a table without rows pass through every stage."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "a b", "en", None, 3), (7, None, None, "s", None), (7, None, None, "s", None)], docs.schema)
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES:
        out, none = stage(spark, odd, DATA), stage(spark, empty, DATA)
        assert none.count() == 0 and none.columns == out.columns
        rows = [tuple(r) for r in out.collect()]
        if name != "encode":
            assert out.columns == COLUMNS and set(rows) <= {tuple(r) for r in odd.collect()}
            assert any(r[1] == "a b" for r in rows) or name in ("mix", "simhash")
        else:
            assert len(rows) == 4
