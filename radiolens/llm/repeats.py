"""Periodic runs of words by internal pattern matching.

A run is a stretch of words that repeats with some smallest period q over at least ``max(least, 4 * q)`` words and
cannot be made longer. For each power of two L the text is cut into blocks of L words. A run of a period
in [L, 2L) covers at least 4L words, so it holds a block whole, together with the copy of that block one period on. The copy
begins in the window of L places that starts L places after the block, so it is enough to ask, for each block, where its words occur in
that window. The occurrences of L words inside a window of L places make one arithmetic progression, and
one question each for its first, second and last place is enough to know it:

* the places at which the words of a block occur are an interval of the suffix array, known from the rank that prefix
  doubling gives the block;
* the smallest place of an interval that is not before a given one is a range successor in a wavelet tree over the
  suffix array.

One or two occurrences are candidate periods as they are. Three or more lie in a stretch of a shorter period d; the block
lies in one too, and both stretches end inside the run, one period apart, so the distance of their ends is the
only candidate. So a block has at most two candidates, a text of n words O(n), and each is verified by extending it
both ways with the ranks of the doubling.

All texts of a batch are worked on at once as one array, in which words of different texts are different
letters, so nothing reaches over the end of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text worked on at once; a longer text is worked on alone.
BYTES = 1 << 21

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class SuffixRanks:
    """The suffix array of several texts by prefix doubling, as far as blocks of ``most`` words need it.

    ``starts[k][i]`` is where the suffixes begin, in the suffix array, that share the first 2**k words of
    suffix i, ``sizes[k][i]`` their number. Only classes of two or more are refined.
    """

    def __init__(self, letters: np.ndarray, most: int):
        n = len(letters)
        order = np.argsort(letters, kind="stable")
        start, size = _classes(letters[order], 0)
        rank, count = np.empty(n + 1, np.int64), np.empty(n, np.int64)
        rank[order], count[order] = start, size
        rank[n] = -1
        self.order, self.starts, self.sizes = order, [rank[:n].copy()], [count.copy()]
        step = 1
        while step < most:
            active = np.flatnonzero(count[order] > 1)  # places in the suffix array; classes stay together
            if not len(active):
                break
            at = order[active]
            behind = rank[np.minimum(at + step, n)]
            again = np.lexsort((behind, rank[at]))
            at, behind = at[again], behind[again]
            own = rank[at]
            new = np.empty(len(at), bool)
            new[0] = True
            new[1:] = (own[1:] != own[:-1]) | (behind[1:] != behind[:-1])
            first = np.flatnonzero(new)
            length = np.diff(np.append(first, len(at)))
            order[active] = at
            rank, count = rank.copy(), count.copy()
            rank[at], count[at] = np.repeat(active[first], length), np.repeat(length, length)
            self.starts.append(rank[:n])
            self.sizes.append(count)
            step *= 2

    def common(self, a: np.ndarray, b: np.ndarray, ahead: bool) -> np.ndarray:
        """How many words from a and b on (or back from a and b, those included) are the same."""
        n, got = len(self.order), np.zeros(len(a), np.int64)
        top = len(self.starts) - 1
        going = np.arange(len(a))
        for k in [top, *range(top, -1, -1)]:
            rank, step, again = self.starts[k], 1 << k, k == top
            look = going
            while len(look):
                if ahead:
                    x, y = a[look] + got[look], b[look] + got[look]
                    inside = (x < n) & (y < n)
                else:
                    x, y = a[look] - got[look] - step + 1, b[look] - got[look] - step + 1
                    inside = (x >= 0) & (y >= 0)
                look, x, y = look[inside], x[inside], y[inside]
                look = look[rank[x] == rank[y]]
                got[look] += step
                if not again:
                    break
        return got


def _classes(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the stretch of equal neighbours each value stands in."""
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
    length = np.diff(np.append(first, len(values)))
    return np.repeat(base + first, length), np.repeat(length, length)


class WaveletTree:
    """Range successor over an array of whole numbers: levels of bits, the highest first, zeros before ones."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros, self.before = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1 == 1
            self.before.append(np.concatenate(([0], np.cumsum(~bit))))  # zeros before each place
            self.zeros.append(int(self.before[-1][-1]))
            values = np.concatenate((values[~bit], values[bit]))

    def below(self, lo: np.ndarray, hi: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many of values[lo:hi] are below ``limit``."""
        found = np.zeros(len(lo), np.int64)
        over = limit >= 1 << self.bits
        found[over] = (hi - lo)[over]
        at = np.flatnonzero(~over & (limit > 0))
        lo, hi, limit = lo[at], hi[at], limit[at]
        for level, before, zeros in zip(range(self.bits - 1, -1, -1), self.before, self.zeros):
            a, b = before[lo], before[hi]
            one = (limit >> level) & 1 == 1
            found[at[one]] += (b - a)[one]
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - b, b)
            left = hi > lo
            if not left.all():
                at, lo, hi, limit = at[left], lo[left], hi[left], limit[left]
        return found

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of values[lo:hi]."""
        value = np.zeros(len(lo), np.int64)
        for before, zeros in zip(self.before, self.zeros):
            a, b = before[lo], before[hi]
            one = k >= b - a
            value = value << 1 | one
            k = np.where(one, k - (b - a), k)
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - b, b)
        return value


def find_periods(letters: np.ndarray, lengths: np.ndarray, least: int = 6) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period.

    ``letters`` holds the texts one after another, ``lengths`` their sizes; no letter stands in two texts.
    """
    none = np.empty((0, 4), np.int64)
    longest = int(lengths.max(initial=0))
    if longest < least:
        return none
    begin = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(letters)) - begin[text]
    ranks = SuffixRanks(letters, max(longest // 4, 2))
    if len(ranks.sizes) < 2:
        return none
    # only suffixes that share their first two words with another one can answer; the tree holds their places in their texts
    held = ranks.sizes[1][ranks.order] > 1
    if not held.any():
        return none
    slot = np.cumsum(held) - held
    tree = WaveletTree(place[ranks.order[held]], longest.bit_length())
    ends = begin + lengths
    found = []
    for k in range(1, len(ranks.starts)):
        size = 1 << k
        block = np.flatnonzero((ranks.sizes[k] > 1) & (place % size == 0) & (place + 2 * size <= lengths[text]))
        if not len(block):
            continue
        lo = slot[ranks.starts[k][block]]
        hi = lo + ranks.sizes[k][block]
        here = place[block]
        early = here + (1 if size == 2 else size)  # the first level looks for periods 1 to 3
        skip = tree.below(lo, hi, early)
        count = tree.below(lo, hi, here + 2 * size) - skip
        some = count > 0
        block, lo, hi, here, skip, count = (x[some] for x in (block, lo, hi, here, skip, count))
        if not len(block):
            continue
        first = tree.smallest(lo, hi, skip) - here
        found.append((block, first))
        two = count > 1
        if size == 2:
            for more in (1, 2):
                two = count > more
                found.append((block[two], (tree.smallest(lo[two], hi[two], skip[two] + more) - here[two])))
            continue
        second = tree.smallest(lo[two], hi[two], skip[two] + 1) - here[two]
        pair = count[two] == 2
        found.append((block[two][pair], second[pair]))
        at, near, step = block[two][~pair], first[two][~pair], (second - first[two])[~pair]
        # stretches of period ``step`` around the block and around the progression, and how far apart they end
        gap = near + ranks.common(at + near, at + near + step, True) - ranks.common(at, at + step, True)
        good = ((gap - near) % step == 0) & (gap >= size) & (gap < 2 * size)
        found.append((at[good], gap[good]))
    if not found:
        return none
    at, period = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    stop = at + period + ranks.common(at, at + period, True)
    start = at - ranks.common(at - 1, at + period - 1, False)
    good = (stop - start >= np.maximum(least, 4 * period)) & (stop <= ends[text[at]])
    rows = np.stack((text[at[good]], place[start[good]], (stop - start)[good], period[good]), axis=1)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    if not len(rows):
        return none
    # one stretch, one run: a multiple of its period has the same borders
    rows = rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def letters_of(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the words of several texts, another number for each text, and the texts' sizes."""
    known: dict[bytes, int] = {}
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), np.int64, int(lengths.sum()))
    return codes + np.repeat(np.arange(len(words)) * len(known), lengths), lengths


def _groups(texts: list[bytes]) -> Iterator[list[int]]:
    """Texts of like length together, up to ``BYTES`` bytes."""
    group, size = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        if group and size + len(texts[i]) > BYTES:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(texts[i])
    if group:
        yield group


def _solve(texts: list[str | None], least: int) -> pd.DataFrame:
    raw = [(x or "").encode() for x in texts]
    runs: list[list[dict]] = [[] for _ in raw]
    left = [""] * len(raw)
    for group in _groups(raw):
        words = [raw[i].split() for i in group]  # at \x20 and \x09-\x0D, as bytes are split
        found = find_periods(*letters_of(words), least)
        mine = dict(zip(found[np.append(True, np.diff(found[:, 0]) > 0), 0].tolist() if len(found) else [],
                        np.split(found[:, 1:], np.flatnonzero(np.diff(found[:, 0])) + 1)))
        for at, (i, ws) in enumerate(zip(group, words)):
            if at in mine:
                rows = mine[at].tolist()
                runs[i] = [dict(start=s, length=n, period=q) for s, n, q in rows]
                kept = np.ones(len(ws), bool)
                for s, n, q in rows:
                    kept[s + q : s + n] = False
                ws = [w for w, k in zip(ws, kept.tolist()) if k]
            left[i] = b" ".join(ws).decode()
    return pd.DataFrame({"runs": runs, "collapsed": left})


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 6, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with its periodic runs and the text without their repetitions.

    ``runs``: an array of (start, length, period), numbered in words from 0, by start and period. ``collapsed``: the
    words, joined by one blank, less those that stand in a run after its first period.

    NULL and empty texts: no runs and an empty text. One row for each input row, repeated rows included; all
    other columns stay, those named as the new ones are replaced. A text is one task's work, whole, in memory that is
    proportional to its words times the logarithm of its repeats; texts of a batch are worked on together.
    """

    @F.pandas_udf(f"struct<runs: {RUNS}, collapsed: string>")
    def solved(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield _solve(texts.tolist(), least)

    held = "periodic runs of the text"
    done = docs.withColumn(held, solved(F.col(text).cast("string")))
    return done.withColumns({runs: F.col(held)["runs"], collapsed: F.col(held)["collapsed"]}).drop(held)


def longest_run(runs: Column) -> Column:
    """The run of greatest length; ties go to the smallest start, then period. NULL where there is none."""
    keys = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    top = F.array_max(keys)
    return F.when(top.isNotNull(), F.struct(
        (-top["start"]).alias("start"), top["length"].alias("length"), (-top["period"]).alias("period")))
