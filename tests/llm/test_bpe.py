import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from radiolens.llm import bpe
from radiolens.llm.catalog import QUERIES
from tests.llm.conftest import DATA

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(FILE, "rb") as file:
        return bpe.read_ranks(file.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def naive(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_by_rank_then_place():
    """Random ranks, also such that a merge makes pairs of a lower rank than its own."""
    rng = random.Random(1)
    for _ in range(300):
        letters = [b"a", b"b", b"c"]
        tokens = set(letters)
        while len(tokens) < 40:
            tokens.add(rng.choice(sorted(tokens)) + rng.choice(sorted(tokens)))
        order = sorted(tokens)
        rng.shuffle(order)
        ranks = {t: r * rng.choice([1, 300]) + i for i, (t, r) in enumerate(zip(order, range(len(order))))}
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 60)))
        assert bpe.encode_piece(piece, ranks) == ([ranks[piece]] if piece in ranks else naive(piece, ranks))


TEXTS = [
    "", "Hello world", "  a  b\n\n c\t", "don't we'll I'M", "é" * 50, "日本語テキスト 12345 🙂🙂", "<|endoftext|> x", "a" * 5000,
    "ab" * 4000, "".join(random.Random(2).choice("abcdeé1 ") for _ in range(4000)), "\x00\x01  x", "thethethe" * 700,
]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_codec_equals_library(library, text):
    with open(FILE, "rb") as file:
        codec = bpe.Codec(file.read(), public_tokenizers.PATTERN)
    ids = codec.encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_pretoken_of_a_million_bytes(library):
    text = "".join(random.Random(3).choice("abcdefgh") for _ in range(300_000))
    with open(FILE, "rb") as file:
        codec = bpe.Codec(file.read(), public_tokenizers.PATTERN)
    assert codec.decode(codec.encode(text)) == text.encode()


def test_query_against_library(spark, documents, library):
    out = {r.doc_id: r for r in QUERIES["op2_byte_bpe"](spark, DATA).collect()}
    rows = documents.collect()
    assert len(out) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text)
        got = out[r.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_nulls_repeats_and_columns(docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "x y"), (3, "x y"), (3, "x y")]).selectExpr("*", "'old' as ids")
    out = bpe.decode(bpe.encode(docs, FILE, public_tokenizers.PATTERN), FILE)
    assert [c for c in out.columns if c != "decoded"] == docs.columns
    rows = out.collect()
    assert sorted(bytes(r.decoded).decode() for r in rows) == ["", "", "x y", "x y", "x y"]
    assert bpe.encode(docs_of([]), FILE, public_tokenizers.PATTERN).count() == 0


def test_little_memory_and_one_pass(spark, library, ranks, monkeypatch, documents):
    """A codec that forgets all the time, and both ways in one pass, give the library's ids."""
    monkeypatch.setattr(bpe, "REMEMBERED", 2000)
    with open(FILE, "rb") as file:
        codec = bpe.Codec(file.read(), public_tokenizers.PATTERN)
    for text in TEXTS * 2:
        ids = codec.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode_ordinary(text)
    assert codec.held < 2000 + 300 * max(len(set(codec.pieces(t))) for t in TEXTS)
    rows = bpe.round_trip(documents.limit(20), FILE, public_tokenizers.PATTERN).collect()
    for r in rows:
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == library.encode_ordinary(r.text)
        assert r.decoded == r.text.encode()
