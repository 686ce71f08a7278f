"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The n-grams are of UTF-8 bytes, so one model form serves every language; an n-gram is a number, its context
the number without the last byte. Counts are summed over all trusted texts of a language. The n-grams that
occur anywhere in the corpus are joined with the counts, contexts and lower-order probabilities, order by
order, in joins that are sharded by language and n-gram. The resulting log probabilities are looked up by
the texts in shards of bounded size. A text stays if its perplexity is within a quantile of the trusted
texts of its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolens.llm.common import Stages, whole

ORDER = 4
CHUNK_BYTES = 1 << 20  # of text counted at a time
FLUSH = 4_000_000  # distinct n-grams that a task holds before it hands them on
SHARD_ROWS = 2_000_000  # n-grams in one broadcast shard
BINS = 1000  # thresholds are exact to this part of a log perplexity
UNIFORM = 1 / 256


def ngrams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, owner): the n-gram that ends in each byte of each text; zero bytes stand before a text."""
    gap = b"\0" * (order - 1)
    joined = np.frombuffer(gap + gap.join(texts), dtype=np.uint8).astype(np.int64)
    codes = np.zeros(len(joined), dtype=np.int64)
    for k in range(order):
        codes[k:] |= joined[: len(joined) - k] << (8 * k)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + order - 1) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    places = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return codes[places], owner


def chunks(frame: pd.DataFrame) -> Iterator[tuple[str, list[int], list[bytes]]]:
    """(language, rows, texts) of a bounded number of bytes, or of one text."""
    for lang, rows in frame.reset_index(drop=True).groupby("lang", sort=False).groups.items():
        held, texts, size = [], [], 0
        for i in rows:
            text = frame["text"].iloc[i].encode("utf-8", "surrogatepass")
            if texts and size + len(text) > CHUNK_BYTES:
                yield lang, held, texts
                held, texts, size = [], [], 0
            held.append(i)
            texts.append(text)
            size += len(text)
        if texts:
            yield lang, held, texts


def counted(order: int):
    """Tasks' partial counts (lang, code, n)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for lang, (codes, n) in held.items():
                yield pd.DataFrame({"lang": lang, "code": codes, "n": n})
            held.clear()

        for frame in batches:
            for lang, _, texts in chunks(frame):
                codes, n = np.unique(ngrams(texts, order)[0], return_counts=True)
                if lang in held:
                    codes, place = np.unique(np.concatenate([held[lang][0], codes]), return_inverse=True)
                    n = np.bincount(place, np.concatenate([held[lang][1], n])).astype(np.int64)
                held[lang] = codes, n
            if sum(len(c) for c, _ in held.values()) > FLUSH:
                yield from flush()
        yield from flush()

    return of


def _texts(docs: DataFrame, text: str, lang: str) -> list[Column]:
    return [F.coalesce(F.col(lang).cast("string"), F.lit("\0")).alias("lang"), whole(F.col(text)).alias("text")]


def count_tables(first: DataFrame, order: int, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """(counts, contexts) of all orders from the counts of the highest.

    Below the highest order an n-gram counts as often as different bytes precede it. A context holds its
    total and its discounts, already times the numbers of n-grams they were taken from.
    """
    levels, now = [first.select(F.lit(order).alias("k"), "lang", "code", "n")], first
    for k in range(order - 1, 0, -1):
        now = now.groupBy("lang", F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("code")).agg(F.count("*").alias("n"))
        levels.append(now.select(F.lit(k).alias("k"), "lang", "code", "n"))
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.union(level)
    counts = stages.write(counts, "counts")
    ones = [F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(i: int) -> Column:
        usual = F.lit(i) - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
        plain = F.least(F.lit(i), F.greatest(F.lit(0.0), usual))
        full = (F.col(f"n{i}") > 0) & (F.col("n1") > 0)
        return F.when(full, plain).otherwise(F.lit(i / 2)).alias(f"d{i}")  # too little text to estimate it

    discounts = counts.groupBy("k", "lang").agg(*ones).select("k", "lang", *[discount(i) for i in (1, 2, 3)])
    discounts = stages.write(discounts, "discounts")  # a row per language and order
    many = [F.sum((F.col("n") == 1).cast("long")).alias("m1"), F.sum((F.col("n") == 2).cast("long")).alias("m2"), F.sum((F.col("n") > 2).cast("long")).alias("m3")]
    contexts = counts.groupBy("k", "lang", F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("total"), *many)
    contexts = contexts.join(discounts, ["k", "lang"]).select(
        "k", "lang", "context", "total", "d1", "d2", "d3", (F.expr("m1 * d1 + m2 * d2 + m3 * d3")).alias("spare")
    )
    contexts = stages.write(contexts, "contexts")
    stages.drop(discounts)
    return counts, contexts


def log_probabilities(asked: DataFrame, counts: DataFrame, contexts: DataFrame, order: int) -> DataFrame:
    """(lang, code, logp) of the distinct n-grams ``asked`` (lang, code), lowest order first."""
    p = None
    for k in range(1, order + 1):
        mask = F.lit((1 << 8 * k) - 1)
        rows = asked.select("lang", F.col("code").bitwiseAND(mask).alias("code"))
        rows = (rows.distinct() if k < order else rows).withColumn("context", F.shiftright("code", 8))
        rows = rows.join(counts.where(F.col("k") == k).select("lang", "code", "n"), ["lang", "code"], "left")
        rows = rows.join(contexts.where(F.col("k") == k).drop("k"), ["lang", "context"], "left")
        lower: Column = F.lit(UNIFORM)
        if p is not None:
            rows = rows.withColumn("low", F.col("code").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
            rows = rows.join(p.withColumnRenamed("code", "low"), ["lang", "low"])
            lower = F.col("p_low")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = F.coalesce(F.greatest(F.lit(0.0), F.col("n") - cut), F.lit(0.0))
        mixed = F.when(F.col("total") > 0, (own + F.col("spare") * lower) / F.col("total")).otherwise(lower)
        p = rows.select("lang", "code", mixed.alias("p_low"))
    return p.select("lang", "code", F.log("p_low").alias("logp"))


def _lookups(table: DataFrame, order: int, shard_rows: int) -> list:
    """For each shard of the table a function of (lang, text): the sum over the n-grams it holds."""
    spark = table.sparkSession
    shards = max(1, -(-table.count() // shard_rows))
    out = []
    for shard in range(shards):
        part = table.where(F.pmod(F.xxhash64("lang", "code"), F.lit(shards)) == shard)
        rows = part.select("lang", "code", "logp").toArrow()  # at most about SHARD_ROWS rows
        names = rows["lang"].combine_chunks().dictionary_encode()
        which, code, logp = names.indices.to_numpy(), rows["code"].to_numpy(), rows["logp"].to_numpy()
        held = {}
        for i, lang in enumerate(names.dictionary.to_pylist()):
            own = np.flatnonzero(which == i)
            own = own[np.argsort(code[own])]
            held[lang] = code[own], logp[own]
        del rows, names, which, code, logp
        sent = spark.sparkContext.broadcast(held)

        def looked_up(sent=sent):
            @F.pandas_udf("double")
            def of(langs: pd.Series, texts: pd.Series) -> pd.Series:
                sums = np.zeros(len(texts))
                for lang, rows, some in chunks(pd.DataFrame({"lang": langs, "text": texts})):
                    if lang not in sent.value:
                        continue
                    known, logp = sent.value[lang]
                    codes, owner = ngrams(some, order)
                    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                    value = np.where(known[at] == codes, logp[at], 0.0)
                    sums[rows] = np.bincount(owner, value, len(some))
                return pd.Series(sums)

            return of

        out.append(looked_up())
    return out


def score_quality(
    docs: DataFrame, trusted: DataFrame, quantile: float = 0.99, slack: float = 1.05, text: str = "text", key: str = "doc_id",
    lang: str = "lang", order: int = ORDER, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per document: doc_id, lang, n_bytes, perplexity (a byte), threshold, kept.

    ``trusted``: ids (key) of the texts that the model learns from. ``threshold`` is ``slack`` times the
    perplexity that a share of ``quantile`` of the trusted texts of the language stay within.

    NULL and empty texts have no perplexity and are not kept. A NULL language is a language. In a language
    without trusted text there is neither perplexity nor threshold, and texts that are not empty are kept.
    Repeated rows are scored alike, and count as often as they stand among the trusted ones. NULL ids are
    never trusted. Empty table: no rows. Other columns are ignored.

    Text moves once, to meet the trusted ids; counts are summed in tasks before they move.
    """
    stages = Stages(docs.sparkSession)
    good = trusted.where(F.col(key).isNotNull()).select(F.col(key).alias("good")).distinct()
    # one plan at every size: texts meet the ids in a merge join, however few ids there are
    learned = docs.join(good.hint("merge"), F.col(key) == F.col("good")).select(*_texts(docs, text, lang))
    counts = learned.mapInPandas(counted(order), "lang string, code long, n long")
    first = stages.write(counts.groupBy("lang", "code").agg(F.sum("n").alias("n")), "ngrams")
    counts, contexts = count_tables(first, order, stages)
    every = docs.select(*_texts(docs, text, lang)).mapInPandas(counted(order), "lang string, code long, n long")
    asked = every.select("lang", "code").distinct().join(first.select("lang").distinct(), "lang", "left_semi")
    asked = stages.write(asked, "asked")
    table = stages.write(log_probabilities(asked, counts, contexts, order), "logp")
    stages.drop(first, counts, contexts, asked)

    rows = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("own"), *_texts(docs, text, lang))
    sums = [of(F.col("lang"), F.col("text")) for of in _lookups(table, order, shard_rows)]
    rows = rows.select("doc_id", "own", "lang", F.octet_length("text").cast("long").alias("n_bytes"), sum(sums[1:], sums[0]).alias("logp"))
    rows = stages.write(rows, "scores")
    known = table.select("lang").distinct()
    entropy = -F.col("logp") / F.col("n_bytes")
    bins = rows.where("n_bytes > 0").join(good, F.col("doc_id") == F.col("good"), "left_semi")
    bins = bins.groupBy("lang", F.floor(entropy * BINS).alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("lang").orderBy("bin")  # at most 256 * BINS bins a language
    bins = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    ends = bins.where(F.col("upto") >= F.col("all") * F.lit(quantile)).groupBy("lang").agg(F.min("bin").alias("end"))
    ends = stages.write(known.join(ends, "lang", "left").select("lang", (F.exp((F.col("end") + 1) / BINS) * slack).alias("threshold"), F.lit(1).alias("there")), "ends")
    stages.drop(table)
    rows = rows.join(ends, "lang", "left")
    perplexity = F.when((F.col("n_bytes") > 0) & F.col("there").isNotNull(), F.exp(entropy))
    rows = rows.select("doc_id", F.col("own").alias("lang"), "n_bytes", perplexity.alias("perplexity"), "threshold")
    within = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return rows.withColumn("kept", (F.col("n_bytes") > 0) & within)
