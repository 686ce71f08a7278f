"""Seeded permutations of row numbers, computed row by row: no sort, no table of places."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
_A, _B, _C, _D, _E = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def _finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * _B
    h = (h ^ h >> np.uint64(29)) * _C
    return h ^ h >> np.uint64(32)


def _hashed(low: np.ndarray, seed: np.ndarray, turn: int) -> np.ndarray:
    """Spark's ``xxhash64`` of two bigints and an int, each column's hash being the seed of the next."""
    h = np.full(len(low), 42, np.uint64)
    for value in (low, seed):
        h = h + _E + np.uint64(8) ^ _turned(value.view(np.uint64) * _B, 31) * _A
        h = _finished(_turned(h, 27) * _A + _D)
    h = h + _E + np.uint64(4) ^ np.uint64(turn) * _A
    return _finished(_turned(h, 23) * _B + _C).view(np.int64)


def _mixed(x: np.ndarray, base: np.ndarray, seed: np.ndarray) -> np.ndarray:
    high, low = x // base, x % base
    with np.errstate(over="ignore"):
        for i in range(ROUNDS):
            high, low = low, (high + _hashed(low, seed, i) % base) % base
    return high * base + low


def _walked(place: pd.Series, n: pd.Series, seed: pd.Series) -> pd.Series:
    size, seeds = n.to_numpy(np.int64), seed.to_numpy(np.int64)
    base = np.ceil(np.sqrt(size.astype(np.float64))).astype(np.int64)
    x = _mixed(place.to_numpy(np.int64), base, seeds)
    away = np.flatnonzero(x >= size)
    while len(away):
        x[away] = _mixed(x[away], base[away], seeds[away])
        away = away[x[away] >= size[away]]
    return pd.Series(x)


def permuted(place: Column, n: Column, seed: Column) -> Column:
    """A number from 0 to ``n - 1`` for each ``place`` in that range, all different for one ``seed``.

    A Feistel network mixes the two digits of the place in base ceil(sqrt(n)), which names a few places
    more than there are rows; one beyond the range is sent on until it falls inside (cycle walking). There are
    at most 2 sqrt(n) + 1 such places, and each walk comes home because the network only exchanges places.
    """
    return F.pandas_udf(_walked, "long")(place.cast("long"), n.cast("long"), seed.cast("long"))
