"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary file.

Merges of one pre-token are driven by a hierarchical-bitmap rank queue: each merge rank has a bucket of
positions in a linked list of parts, a bitmap over ranks (words of 256 ranks, and a word over words) says which
buckets hold something, and find-first-set gives the lowest rank. Entries are never removed when a
neighbour merges; a popped entry whose pair has changed is stale and skipped. A pre-token of n bytes costs
O(n log n), so a text without any white space is no special case.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from hashlib import md5
from heapq import heappop, heappush
from struct import pack
from types import ModuleType

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pre-tokens up to this many characters are remembered by a worker process, those met last, in so many bytes at most.
SHORT, REMEMBERED = 64, 160 << 20
#: Bytes of an entry beside its pre-token and ids.
ENTRY = 200
#: Ranks in a word of the bitmap: Python's integers make two levels enough.
SHIFT = 8
LOW = (1 << SHIFT) - 1


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: while any neighbouring pair has a rank, the lowest, leftmost one merges.

    The queue: ``buckets`` of positions (a heap where a rank has several), ``words`` of ``1 << SHIFT`` bits
    for the buckets that hold something, ``top`` for the words that do. It is written out here, since a
    call for each entry would cost more than the entry.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    end, before, wanted = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n  # parts start at their list position
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    top = live = 0  # live: positions whose pair has a rank
    fresh = [(i, rank) for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
    while True:
        for at, rank in fresh:
            wanted[at] = rank
            live += 1
            if rank in buckets:
                heappush(buckets[rank], at)
            else:
                buckets[rank] = [at]
                word = rank >> SHIFT
                if word in words:
                    words[word] |= 1 << (rank & LOW)
                else:
                    words[word] = 1 << (rank & LOW)
                    top |= 1 << word
        if not live:
            break  # what is still queued is stale
        while True:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = word << SHIFT | ((bits & -bits).bit_length() - 1)
            held = buckets[rank]
            left = heappop(held)
            if not held:
                del buckets[rank]
                bits &= bits - 1
                if bits:
                    words[word] = bits
                else:
                    del words[word]
                    top &= top - 1
            if wanted[left] == rank:
                break
        right = end[left]
        stop = end[left] = end[right]
        wanted[left] = -1
        live -= 1
        if wanted[right] >= 0:
            wanted[right] = -1
            live -= 1
        fresh = []
        if stop < n:
            before[stop] = left
            rank = get(piece[left : end[stop]])
            if rank is not None:
                fresh.append((left, rank))
        first = before[left]
        if first >= 0:
            if wanted[first] >= 0:
                wanted[first] = -1
                live -= 1
            rank = get(piece[first:stop])
            if rank is not None:
                fresh.append((first, rank))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """A rank file: on each line a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


class Codec:
    """Encodes texts to ids as packed little-endian unsigned 32-bit integers, and such ids to bytes."""

    def __init__(self, lines: bytes, pattern: str):
        self.ranks = read_ranks(lines)
        self.pieces = regex.compile(pattern).findall
        self.tokens = tokens_of(self.ranks)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0  # bytes of ``known``; it becomes ``older`` at half of what may be remembered

    def encode(self, text: str) -> bytes:
        """Packed ids; the pre-tokens of a text are looked up together, those not met before are merged."""
        pieces = self.pieces(text)
        if self.held > REMEMBERED // 2:
            self.known, self.older, self.held = {}, self.known, 0
        known = self.known
        new = set(pieces).difference(known)
        for piece in new:
            found = self.older.get(piece)
            if found is None:
                ids = encode_piece(piece.encode(), self.ranks)
                found = pack(f"<{len(ids)}I", *ids)
            known[piece] = found
            self.held += ENTRY + len(piece) + len(found)
        packed = b"".join(map(known.__getitem__, pieces))
        for piece in new:
            if len(piece) > SHORT:
                self.held -= ENTRY + len(piece) + len(known.pop(piece))
        return packed

    def decode(self, ids: bytes) -> bytes:
        return join_tokens(ids, self.tokens)


def tokens_of(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def join_tokens(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _vocabulary(docs: DataFrame, vocabulary: str, pattern: str):
    """A function that gives a task the codec of its worker process.

    The rank file is read where the driver runs and broadcast, bounded by the vocabulary's size. A codec outlives the
    task, so what it has merged once is known to the next task of the worker; it stands among the process's
    modules because this package need not be installed there.
    """
    with open(vocabulary, "rb") as file:
        lines = file.read()
    name = (md5(lines).hexdigest(), pattern)
    held = docs.sparkSession.sparkContext.broadcast(lines)

    def codec() -> Codec:
        kept = sys.modules.setdefault("radiolens_codecs", ModuleType("radiolens_codecs")).__dict__
        if name not in kept:
            kept[name] = Codec(held.value, pattern)
        return kept[name]

    return codec


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a binary column ``ids``: the whole text as packed little-endian unsigned 32-bit ids.

    ``pattern`` cuts the text into pre-tokens, each is merged separately; strings of special tokens are
    ordinary text. NULL and empty texts: no ids. One row for each input row, repeated rows included; all
    other columns stay, one with the name of ``ids`` is replaced.
    """
    codec = _vocabulary(docs, vocabulary, pattern)

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = codec()
        for texts in batches:
            yield pd.Series([one.encode(x) if x else b"" for x in texts], dtype=object)

    return docs.withColumn(ids, encoded(F.col(text).cast("string")))


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with a binary column ``decoded``: the bytes of the ids. NULL or no ids: no bytes."""
    codec = _vocabulary(docs, vocabulary, "")

    @F.pandas_udf("binary")
    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = codec()
        for packed in batches:
            yield pd.Series([one.decode(x) if x else b"" for x in packed], dtype=object)

    return docs.withColumn(decoded, bytes_of(F.col(ids)))


def round_trip(
    docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """``encode`` and then ``decode`` of its ids in one pass: a task needs one worker and one codec for both."""
    codec = _vocabulary(docs, vocabulary, pattern)

    @F.pandas_udf("struct<ids: binary, decoded: binary>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = codec()
        for texts in batches:
            packed = [one.encode(x) if x else b"" for x in texts]
            yield pd.DataFrame({"ids": packed, "decoded": [one.decode(x) for x in packed]}, dtype=object)

    held = "ids and bytes of the text"
    done = docs.withColumn(held, both(F.col(text).cast("string")))
    return done.withColumns({ids: F.col(held)["ids"], decoded: F.col(held)["decoded"]}).drop(held)


def n_tokens(ids: str = "ids") -> Column:
    return (F.octet_length(ids) / 4).cast("long")
