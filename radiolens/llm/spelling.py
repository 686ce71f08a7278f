"""Spelling variants by composition of finite-state machines.

Two words are near if one inserted, deleted or replaced character makes one the other, that is, if the machine
A o E o A accepts the pair: the minimised acceptor A of the vocabulary, a transducer E of one edit, and A again. A state of
that machine is a pair of states of A and whether the edit has been made; before it both are one state, after it
both must accept the same rest.

The machine is cut by its initial states, so that no task sees the vocabulary whole. Two near words of at least m
characters share their first m div 2 or their last m div 2 characters. A word therefore goes to the states
after its first half, and after its last half read backwards, and the edit is looked for behind them. A part that is too
large for one task is cut again by the arcs of its initial state: both words read the same next character (an initial
state one further on), or the edit is made right there (words that agree on the rest). Each pair is accepted in one
part only: the edit is taken at the first difference, and the backward parts leave pairs that share the first half.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolens.llm.common import Stages, ascii_lower

#: Words of one part, and of the parts that a task gets together.
PART = 20_000
#: What names a part: read backwards, characters shared at least, edit only at its start, characters read, those characters.
PART_KEY = ("back", "half", "here", "depth", "label")


class Acceptor:
    """Minimal acyclic acceptor; equal states are one, also those of words added from different initial states."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.known: dict[tuple, int] = {}
        self.shared: dict[tuple[int, int], list[str]] = {}

    def _state(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, *arcs.items())
        if key not in self.known:
            self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return self.known[key]

    def add(self, words: Iterable[str]) -> int:
        """The initial state that accepts ``words``, which come sorted and without repeats."""
        path: list[list] = [[False, {}]]  # states of the last word, still open
        letters: list[str] = []

        def close(depth: int) -> None:
            while len(letters) > depth:
                state = self._state(*path.pop())
                path[-1][1][letters.pop()] = state

        for word in words:
            same = 0
            while same < len(letters) and same < len(word) and letters[same] == word[same]:
                same += 1
            close(same)
            for c in word[same:]:
                letters.append(c)
                path.append([False, {}])
            path[-1][0] = True
        close(0)
        return self._state(*path[0])

    def common(self, p: int, q: int) -> list[str]:
        """What both states accept."""
        key = (p, q) if p < q else (q, p)
        if key not in self.shared:
            found, open_ = [], [(*key, "")]
            while open_:
                a, b, read = open_.pop()
                if self.final[a] and self.final[b]:
                    found.append(read)
                one, other = self.arcs[a], self.arcs[b]
                open_ += [(one[c], other[c], read + c) for c in one.keys() & other.keys()]
            self.shared[key] = found
        return self.shared[key]

    def edits(self, state: int) -> Iterator[tuple[str, str]]:
        """Pairs accepted from ``state`` whose first characters differ."""
        arcs = list(self.arcs[state].items())
        for i, (c, p) in enumerate(arcs):
            for d, q in arcs[i + 1 :]:
                for rest in self.common(p, q):
                    yield c + rest, d + rest
            for rest in self.common(p, state):
                if not rest.startswith(c):
                    yield rest, c + rest

    def near(self, initial: int, deeper: bool) -> Iterator[tuple[str, str]]:
        """All pairs accepted from ``initial``; without ``deeper``, those with the edit right there."""
        here: dict[int, list[tuple[str, str]]] = {}
        open_ = [(initial, "")]
        while open_:
            state, read = open_.pop()
            if state not in here:
                here[state] = list(self.edits(state))
            for a, b in here[state]:
                yield read + a, read + b
            if deeper:
                open_ += [(to, read + c) for c, to in self.arcs[state].items() if self.arcs[to]]


def _accepted(rows: pd.DataFrame) -> pd.DataFrame:
    """The pairs of some parts, each with its sizes: (word, near, near_n), both ways."""
    machine, out, parts = Acceptor(), [], {}
    for back, half, here, depth, label, word, n in zip(*(rows[c].tolist() for c in (*PART_KEY, "word", "n"))):
        parts.setdefault((back, half, here, depth, label), {})[word[::-1] if back else word] = (word, n)
    for (back, half, here, depth, _), words in parts.items():
        start = next(iter(words))[:depth]
        initial = machine.add(w[depth:] for w in sorted(words))
        for a, b in machine.near(initial, not here):
            (a, n), (b, m) = words[start + a], words[start + b]
            if min(len(a), len(b)) // 2 == half and not (back and a[:half] == b[:half]):
                out += [(a, b, m), (b, a, n)]
    return pd.DataFrame(out, columns=["word", "near", "near_n"])


def _parts(words: DataFrame, stages: Stages, most: int) -> DataFrame:
    """Words with their parts: ``depth`` characters are read before the edit may come; none is over ``most`` words."""
    halves = words.withColumn("half", F.explode(F.array_distinct(F.expr("array(length(word) div 2, (length(word) - 1) div 2)"))))
    rows = halves.withColumn("back", F.explode(F.array(F.lit(False), F.lit(True))))
    read = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    rows = rows.select("word", "n", "half", "back", read.alias("read"), F.col("half").alias("depth"), F.lit(False).alias("here"))
    rows = rows.withColumn("half", F.col("half").cast("int")).withColumn("depth", F.col("depth").cast("int"))
    rows = rows.withColumn("label", F.expr("substr(read, 1, depth)"))
    done, now = None, stages.write(rows, "parts")
    while True:
        large = now.where("not here").groupBy(*PART_KEY).count().where(F.col("count") > most).drop("count")
        large = stages.write(large, "large")
        if large.isEmpty():
            return now if done is None else done.unionByName(now)
        fine = now.join(large, list(PART_KEY), "left_anti")
        done = fine if done is None else done.unionByName(fine)
        hot = now.join(large, list(PART_KEY), "left_semi")
        on = hot.where("length(read) > depth").withColumn("depth", F.col("depth") + 1)
        on = on.withColumn("label", F.expr("substr(read, 1, depth)"))
        rest = F.expr("array_distinct(array(substr(read, depth + 1), substr(read, least(depth + 2, length(read) + 1))))")
        here = hot.withColumn("rest", F.explode(F.when(F.expr("length(read) > depth"), rest).otherwise(F.array(F.lit("")))))
        here = here.withColumn("here", F.lit(True)).withColumn("label", F.concat("label", F.lit("\n"), "rest")).drop("rest")
        now = stages.write(on.unionByName(here.select(*on.columns)), "parts")


def near_words(words: DataFrame, stages: Stages | None = None, most: int = PART) -> DataFrame:
    """(word, near, near_n): every pair of near words of ``words`` (word, n), both ways, each once.

    Words are not NULL, not empty, without line ends, and do not repeat. A part of ``most`` words or less is one machine's; larger ones are cut.
    """
    stages = stages or Stages(words.sparkSession)
    parts = _parts(words, stages, most)
    buckets = parts.count() // most + 1
    spread = parts.withColumn("bucket", F.pmod(F.xxhash64(*PART_KEY), F.lit(buckets)))
    kinds = {f.name: f.dataType.simpleString() for f in words.schema}
    schema = f"word string, near string, near_n {kinds['n']}"
    return spread.drop("read").groupBy("bucket").applyInPandas(_accepted, schema)


def count_words(tokens: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): the tokens (column ``word``) of at least ``shortest`` characters that occur ``least`` times."""
    counted = tokens.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def spelling_variants(words: DataFrame, ratio: float = 2, stages: Stages | None = None, most: int = PART) -> DataFrame:
    """One row per word of ``words`` (word, n): word, form, root, n, n_near, form_n.

    ``form``: the near word of largest n, the first in code-point order among equals, if its n is at least ``ratio`` times the
    word's; else NULL. ``root``: the last word when forms are followed, which ends since n grows; the
    word itself without a form. NULL and empty words are left out; a word that repeats counts with the sum of its n. Other
    columns are ignored; an empty table gives no rows.
    """
    stages = stages or Stages(words.sparkSession)
    words = words.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").alias("n"))
    words = stages.write(words, "words")
    near = near_words(words, stages, most).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.join(near, "word", "left")
    good = -F.col("best.less") >= ratio * F.col("n")
    found = stages.write(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")), "forms")
    ends = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("end"))
        then = ends.join(further, "root", "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved"))
        then = stages.write(then, "roots")
        ends = then.drop("moved")
        if then.where("moved").isEmpty():
            break
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def worn_words(docs: DataFrame, run: str, every: int) -> DataFrame:
    """The lower-cased runs of letters of every text (column ``word``), some with a character lost.

    Lost is one of ``length`` characters where the CRC-32 of id, colon and run is divisible by ``every``, at its
    remainder by the length; a NULL id is written as nothing.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(run), F.lit(0))).alias("run"))
    told = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")
    hashed = runs.select("run", F.crc32(F.encode(told, "UTF-8")).alias("h"))
    at = "cast(h % length(run) as int)"
    return hashed.select(F.expr(
        f"case when h % {every} = 0 then concat(substr(run, 1, {at}), substr(run, {at} + 2)) else run end").alias("word"))
