"""Toxicity scores by a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their beginnings (inflected and compound forms share one). A
linear weight per term and the inner product of two terms' factors give the log-odds, so a pair, such as an
insult with the mention of a group, can weigh more or less than its parts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolens.llm.common import whole

SLOTS = 1 << 20  # hashed terms
BEGINNINGS = (3, 4, 5)
#: A labelled sample of at most so many rows fits the model.
TRAIN_ROWS = 20_000
REMEMBERED = 300_000  # words whose terms a task remembers

words_of = re.compile(r"\w+").findall


def held_out(key: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(4)) == 2


def word_slots(word: str) -> list[int]:
    """The slots of a word and of its beginnings, which are marked so that they differ from words."""
    terms = [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % SLOTS for x in terms]


def slots_of(text: str | None) -> list[int]:
    words = set(words_of(text.lower())) if text else ()
    return sorted({s for w in words for s in word_slots(w)})


def term_slots(text: Column) -> Column:
    """The distinct slots of a whole text."""

    @F.pandas_udf("array<int>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(slots_of)

    return of(text)


class Machine:
    """Bias, and for some slots a weight and factors; every other slot counts nothing."""

    def __init__(self, bias: float, slots: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors
        self.place = {int(s): i for i, s in enumerate(slots)}

    def logits(self, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of ``n`` texts; text ``rows[i]`` holds the term at ``places[i]``."""
        linear = np.bincount(rows, self.weights[places], n)
        pairs = np.zeros(n)
        for factor in self.factors.T:
            picked = factor[places]
            pairs += np.bincount(rows, picked, n) ** 2 - np.bincount(rows, picked**2, n)
        return self.bias + linear + pairs / 2


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def telling(terms: list[np.ndarray], y: np.ndarray, z: float, least: int) -> np.ndarray:
    """Slots whose share of texts differs between the labels by over ``z`` standard errors."""
    n1, n0 = y.sum(), (1 - y).sum()
    a, both = np.zeros(SLOTS), np.zeros(SLOTS, dtype=np.int64)
    for t, label in zip(terms, y):  # the slots of a text are distinct
        both[t] += 1
        a[t] += label
    share = both / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (a / n1 - (both - a) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    return np.flatnonzero((both >= least) & (np.abs(score) > z))


def fit_machine(
    terms: list[np.ndarray], y: np.ndarray, factors: int = 4, z: float = 4.0, least: int = 3, rounds: int = 300,
    rate: float = 0.1, decay: float = 1e-4, seed: int = 42,
) -> Machine:
    """Adagrad on the logistic loss over all rows; the same rows in the same order give the same model."""
    terms = [np.asarray(t, dtype=np.int32) for t in terms]
    kept = telling(terms, y, z, least) if 0 < y.sum() < len(y) else np.zeros(0, np.int64)
    at = np.full(SLOTS, -1)
    at[kept] = np.arange(len(kept))
    places = [here[here >= 0] for here in (at[t] for t in terms)]  # few of a text's terms are left
    rows = np.repeat(np.arange(len(terms)), [len(p) for p in places])
    places = np.concatenate(places) if places else np.zeros(0, np.int64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    m = Machine(float(np.log(share / (1 - share))), kept, np.zeros(len(kept)), np.random.default_rng(seed).normal(0, 0.01, (len(kept), factors)))
    sums = [1e-8, np.full(len(kept), 1e-8), np.full((len(kept), factors), 1e-8)]
    for _ in range(rounds if len(kept) else 0):
        error = (sigmoid(m.logits(rows, places, len(y))) - y) / len(y)
        grads = [error.sum(), np.bincount(places, error[rows], len(kept)) + decay * m.weights / len(y), np.empty_like(m.factors)]
        for k in range(factors):
            v = m.factors[:, k]
            total = np.bincount(rows, v[places], len(y))
            grads[2][:, k] = np.bincount(places, error[rows] * (total[rows] - v[places]), len(kept)) + decay * v / len(y)
        for s, g in zip(range(3), grads):
            sums[s] = sums[s] + g * g
        m.bias -= rate * grads[0] / np.sqrt(sums[0])
        m.weights -= rate * grads[1] / np.sqrt(sums[1])
        m.factors -= rate * grads[2] / np.sqrt(sums[2])
    return m


def learn(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, rows: int) -> Machine | None:
    """A machine fitted in one task on at most ``rows`` labelled rows, those of the smallest hashes.

    The sampled ids are a broadcast of that bound, so no text is shuffled. Of several labels of one id the
    largest counts. None without labelled rows.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("known")).agg(F.max(label).alias("y"))
    known = known.where(~held_out(F.col("known"))).orderBy(F.xxhash64("known"), "known").limit(rows)
    found = docs.select(F.col(key).alias("known"), F.col(text).cast("string").alias("words")).join(F.broadcast(known), "known")
    found = found.select("y", F.xxhash64("known", "words").alias("rank"), term_slots(F.col("words")).alias("terms"))
    sample = found.orderBy("rank", "y", "terms").limit(rows)  # ids may repeat

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "y"], kind="stable")
        m = fit_machine(list(frame["terms"]), (frame["y"].to_numpy() == 1).astype(float))
        slots = np.array(list(m.place), dtype=np.int64)
        return pd.DataFrame({"bias": [m.bias], "slots": [slots.tobytes()], "weights": [m.weights.tobytes()], "factors": [m.factors.tobytes()]})

    fitted = sample.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit, "bias double, slots binary, weights binary, factors binary").collect()
    if not fitted:
        return None
    slots = np.frombuffer(fitted[0].slots, dtype=np.int64)
    weights = np.frombuffer(fitted[0].weights)
    return Machine(fitted[0].bias, slots, weights, np.frombuffer(fitted[0].factors).reshape(len(slots), -1) if len(slots) else np.zeros((0, 1)))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
    rows: int = TRAIN_ROWS, score: str = "score",
) -> DataFrame:
    """``docs`` with ``score``, the chance that a text is toxic, from its words alone.

    The model (at most ``SLOTS`` terms, whose size bounds its broadcast) is learned from ``labels`` (key,
    label) outside the held-out rows. NULL and empty texts get the score of a text without known terms.
    Without any labelled row every score is 0. One row for each input row, repeated rows included; other
    columns stay, one with the name of ``score`` is replaced.
    """
    model = learn(docs, labels, text, key, label, rows)
    if model is None:
        return docs.withColumn(score, F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine, known = held.value, {}
        for texts in batches:
            places, ends = [], []
            for text in texts:
                here = set()
                for word in set(words_of(text.lower())) if text else ():
                    found = known.get(word)
                    if found is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        found = known[word] = tuple(machine.place[s] for s in word_slots(word) if s in machine.place)
                    if found:
                        here.update(found)
                places += here
                ends.append(len(here))
            rows = np.repeat(np.arange(len(ends)), ends)
            yield pd.Series(sigmoid(machine.logits(rows, np.array(places, dtype=np.int64), len(ends))))

    return docs.withColumn(score, of(whole(F.col(text))))
