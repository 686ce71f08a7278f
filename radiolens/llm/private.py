"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The patterns give base spans, which always stay. The field has a node for every token with a digit or an @;
neighbouring tokens share a chain potential, and tokens that repeat or resemble one another anywhere in the
document (the same token, the same last seven digits, the same name before an @) share a skip potential with
one of them, the hub: one inside a base span if there is any, so every mention is one step from it.
Base spans fix their tokens' labels; loopy message passing carries them to the other mentions. Weights are
learned by pseudo-likelihood from the base spans of a bounded sample, from features that do not contain the
patterns' own checks; a token outside all spans that resembles one inside has no known label and is left out.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolens.llm.common import whole

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: none
CHAIN, SAME, DIGITS, NAME = range(4)  # kinds of edges
SLOTS = 1 << 12  # hashed features
MOST_ROUNDS = 1000  # of message passing, where loops keep it from settling
#: At most so many documents, and of these at most so many tokens, fit the weights.
TRAIN_DOCS, TRAIN_TOKENS = 5_000, 50_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
NOT_DIGIT = re.compile(r"[^0-9]+").sub
TOKEN = re.compile(r"\S+").finditer
TELLING = re.compile(r"[0-9@]").search


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, each @ looked at once: a local part is the whole run of its characters."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        else:
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(label, start, end) by kind and start; matches that fail a check are dropped, not retried."""
    found = [(1, *x) for x in emails(text)] if "@" in text else []
    for m in IP(text) if "." in text else ():
        if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split(".")):
            found.append((2, m.start(), m.end()))
    for m in CARD(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := NOT_DIGIT("", m[0])) <= 19 and luhn(digits):
            found.append((3, m.start(), m.end()))
    for m in PHONE(text) if "+" in text else ():
        if 8 <= len(NOT_DIGIT("", m[0])) <= 15:
            found.append((4, m.start(), m.end()))
    return found


def shape(token: str) -> str:
    """Runs of digits with their length, runs of letters as one letter, other characters as they are."""
    out = re.sub(r"[^\W\d_]+", "a", token[:80])
    return re.sub(r"[0-9]+", lambda m: f"9{len(m[0])}" if len(m[0]) < 20 else "9+", out)


def slot(*parts: object) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) % SLOTS


class Graph:
    """Nodes (tokens with a digit or @), their features, edges, and the labels of base spans."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]):
        self.text = text
        tokens = list(TOKEN(text))
        self.nodes = [k for k, m in enumerate(tokens) if TELLING(m[0])]
        self.bounds = [self.core(tokens[k]) for k in self.nodes]
        around = lambda k: shape(tokens[k][0]) if 0 <= k < len(tokens) else ""
        self.features, keys = [], [[], [], []]
        for k in self.nodes:
            core = tokens[k][0].strip(".,;:!?\"'()[]{}<>#$%&*|")
            digits = NOT_DIGIT("", core)
            before = tokens[k - 1][0].strip(".,;:!?\"'()[]").lower() if k else ""
            self.features.append([
                slot("bias"), slot("shape", shape(core)), slot("digits", min(len(digits), 20), "@" in core), slot("dots", core.count(".")),
                slot("plus", tokens[k][0][:1] == "+", "(" in tokens[k][0]), slot("left", around(k - 1)), slot("right", around(k + 1)), slot("word", before),
            ])
            keys[0].append("".join(filter(str.isalnum, core)).lower())
            keys[1].append(digits[-7:] if len(digits) >= 7 else "")
            keys[2].append(core.split("@")[0].lower() if core.find("@") >= 4 else "")
        self.fixed = np.zeros(len(self.nodes), dtype=np.int64)
        starts = [tokens[k].start() for k in self.nodes]
        for label, start, end in spans:
            first = bisect_left(starts, start)
            if first and tokens[self.nodes[first - 1]].end() > start:
                first -= 1
            while first < len(starts) and starts[first] < end:
                self.fixed[first] = label
                first += 1
        edges = [(i, i + 1, CHAIN) for i in range(len(self.nodes) - 1) if self.nodes[i + 1] == self.nodes[i] + 1]
        for kind, own in zip((SAME, DIGITS, NAME), keys):
            mentions: dict[str, list[int]] = {}
            for i, key in enumerate(own):
                if key:
                    mentions.setdefault(key, []).append(i)
            for of_key in mentions.values():
                hub = next((i for i in of_key if self.fixed[i]), of_key[0])
                edges += [(hub, i, kind) for i in of_key if i != hub]
        self.edges = np.array(edges, dtype=np.int64).reshape(-1, 3)

    def tied_only(self) -> np.ndarray:
        """Nodes outside base spans that a skip edge ties to one inside: not known to be none."""
        a, b, kind = self.edges[self.edges[:, 2] >= SAME].T
        tied = np.zeros(len(self.nodes), dtype=bool)
        np.logical_or.at(tied, a, self.fixed[b] > 0)
        np.logical_or.at(tied, b, self.fixed[a] > 0)
        return tied & (self.fixed == 0)

    @staticmethod
    def core(m: re.Match) -> tuple[int, int]:
        """A token's bounds without punctuation around it; an opening bracket or plus before a digit stays."""
        token = m[0]
        left = len(token) - len(token.lstrip(".,;:!?\"'[]{}<>#$%&*|)-"))
        right = len(token.rstrip(".,;:!?\"'([]{}<>#$%&*|-"))
        return m.start() + left, m.start() + max(left, right)


class Field:
    """Weights of features and of the four kinds of edges; edge weights are symmetric in the labels."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def marginals(self, graph: Graph, rounds: int = MOST_ROUNDS, damp: float = 0.5) -> np.ndarray:
        """Label probabilities of the nodes by damped sum-product message passing in log space, until no message moves."""
        own = self.unary[np.array(graph.features)].sum(axis=1)
        fixed = graph.fixed > 0
        own[fixed] = -50.0
        own[fixed, graph.fixed[fixed]] = 0.0
        a, b, kind = graph.edges.T
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        potential = self.pair[np.concatenate([kind, kind])]
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        sent = np.zeros((len(source), LABELS))
        for _ in range(rounds if len(a) else 0):
            belief = own.copy()
            np.add.at(belief, target, sent)
            free = belief[source] - sent[back]
            joint = free[:, :, None] + potential
            top = joint.max(axis=1, keepdims=True)
            new = np.log(np.exp(joint - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - sent).max()
            sent = damp * sent + (1 - damp) * new
            if moved < 1e-3:
                break
        belief = own.copy()
        np.add.at(belief, target, sent)
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)


def added_spans(text: str, spans: list[tuple[int, int, int]], field: Field, least: float) -> list[tuple[int, int, int]]:
    """Spans of tokens that the field labels with probability ``least`` or more and no base span touches."""
    graph = Graph(text, spans)
    if not graph.nodes or not (graph.fixed == 0).any():
        return []
    p = field.marginals(graph)
    best = p[:, 1:].argmax(axis=1) + 1
    found: list[tuple[int, int, int]] = []
    last = -2
    for i in np.flatnonzero((graph.fixed == 0) & (p[:, 1:].max(axis=1) >= least)):
        start, end = graph.bounds[i]
        if start >= end:
            continue
        label = int(best[i])
        if found and last == i - 1 and graph.nodes[i] == graph.nodes[last] + 1 and found[-1][0] == label:
            start = found.pop()[1]  # neighbouring tokens of one kind are one span
        found.append((label, start, end))
        last = i
    return found


def fit_field(
    features: list[list[int]], y: np.ndarray, near: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-3
) -> Field:
    """Pseudo-likelihood: each node's label given its features and ``near``, the counts of neighbours' labels by kind of edge.

    The prior expects tokens tied by a skip edge to agree.
    """
    n = len(y)
    if not n:
        features = np.zeros((0, 1))
    prior = np.zeros((4, LABELS, LABELS))
    prior[SAME:] = 2 * np.eye(LABELS)
    unary, pair = np.zeros((SLOTS, LABELS)), prior.copy()
    f, want = np.array(features, dtype=np.int64), np.eye(LABELS)[y]
    s1, s2 = np.full_like(unary, 1e-8), np.full_like(pair, 1e-8)
    for _ in range(rounds if n else 0):
        score = unary[f].sum(axis=1) + np.einsum("nkm,kml->nl", near, pair)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - want) / n
        g1 = np.stack([np.bincount(f.ravel(), np.repeat(error[:, k], f.shape[1]), SLOTS) for k in range(LABELS)], axis=1) + decay * unary / n
        g2 = np.einsum("nkm,nl->kml", near, error)
        g2 = (g2 + g2.transpose(0, 2, 1)) / 2 + decay * (pair - prior) / n
        s1, s2 = s1 + g1 * g1, s2 + g2 * g2
        unary, pair = unary - rate * g1 / np.sqrt(s1), pair - rate * g2 / np.sqrt(s2)
    return Field(unary, pair)


def learn(docs: DataFrame, text: str, key: str, most_docs: int, most_tokens: int) -> Field:
    """A field fitted in one task on the tokens of at most ``most_docs`` documents, those of the smallest hashes."""
    rows = docs.select(whole(F.col(text)).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("rank"))
    rows = rows.where(F.col("text").rlike("[0-9@]"))
    end = rows.select("rank").orderBy("rank").limit(most_docs).agg(F.max("rank")).first()[0]
    if end is None:
        return fit_field([], np.zeros(0, np.int64), np.zeros((0, 4, LABELS)))

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for rank, text in zip(frame["rank"], frame["text"]):
                graph = Graph(text, base_spans(text))
                near = np.zeros((len(graph.nodes), 4, LABELS))
                open_ = graph.tied_only()
                for a, b, kind in graph.edges:
                    near[a, kind, graph.fixed[b]] += not open_[b]
                    near[b, kind, graph.fixed[a]] += not open_[a]
                out += [(rank, i, graph.features[i], int(graph.fixed[i]), near[i].ravel().tolist()) for i in np.flatnonzero(~open_)]
            yield pd.DataFrame(out, columns=["rank", "i", "f", "y", "near"])

    found = rows.where(F.col("rank") <= end).mapInPandas(tokens, "rank long, i int, f array<int>, y int, near array<double>")
    sample = found.orderBy(F.xxhash64("rank", "i"), "rank", "i").limit(most_tokens)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "i"], kind="stable")
        near = np.array(frame["near"].tolist()).reshape(-1, 4, LABELS)
        m = fit_field(frame["f"].tolist(), frame["y"].to_numpy().astype(np.int64), near)
        return pd.DataFrame({"unary": [m.unary.tobytes()], "pair": [m.pair.tobytes()]})

    fitted = sample.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit, "unary binary, pair binary").collect()
    return Field(np.frombuffer(fitted[0].unary).reshape(SLOTS, LABELS), np.frombuffer(fitted[0].pair).reshape(4, LABELS, LABELS))


def find_private(
    docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.8, spans: str = "spans",
    most_docs: int = TRAIN_DOCS, most_tokens: int = TRAIN_TOKENS,
) -> DataFrame:
    """``docs`` with ``spans``: an array of (kind, start, end, base), by kind as in ``KINDS``, then start.

    Places count code points, ends are exclusive. ``base`` spans come from the patterns; the others are
    tokens that the field labels with probability ``least`` or more; they touch no base span.

    NULL and empty texts: no spans. One row for each input row, repeated rows included; other columns stay,
    one with the name of ``spans`` is replaced. A table without a digit or @ gets no spans.
    """
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, text, key, most_docs, most_tokens))

    @F.pandas_udf("label array<int>, start array<int>, end array<int>, base array<boolean>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        field = held.value
        for texts in batches:
            out = []
            for x in texts:
                found: list[tuple] = []
                if x and TELLING(x):
                    base = base_spans(x)
                    found = [(*s, True) for s in base]
                    found += [(*s, False) for s in added_spans(x, base, field, least)]
                    found.sort()
                out.append([list(c) for c in zip(*found)] or [[]] * 4)
            yield pd.DataFrame(out, columns=["label", "start", "end", "base"])

    found = of(whole(F.col(text)))
    rows = docs.withColumn("found spans", found)
    each = F.arrays_zip(*[F.col(f"found spans.{c}").alias(c) for c in ("label", "start", "end", "base")])
    named = F.transform(
        each, lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["label"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))
    )
    return rows.withColumn(spans, named).drop("found spans")


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
