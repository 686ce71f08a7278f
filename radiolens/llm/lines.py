"""Line deduplication by overlapping windows of three lines; DataFrame functions only.

Every run of three consecutive lines is hashed to 128 bits. A hash that occurs more than once is a repeated
window; its first occurrence, by id and place, stays, and the lines that any later occurrence covers go. A
run of one or two lines with more than ``long_words`` words counts as a window too: it holds as much as
three usual lines. Windows are whole lines: a passage that begins or ends inside a line is not found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolens.llm.common import whole

LINES = 3


def lines_of(text: Column) -> Column:
    """The lines of a text; every line break cuts, so joining by line breaks gives the text back."""
    return F.split(whole(text), "\n")


def spaced_words(line: Column) -> Column:
    """Words of a line by its single spaces."""
    bare = F.trim(line)
    return F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1)


def windows(docs: DataFrame, long_words: int, text: str, key: str) -> DataFrame:
    """(h, at: (no_id, doc_id, version, start, last)): a row for each window of non-blank lines.

    ``version`` is a hash of the text, so rows that repeat an id with another text are told apart. Starts
    and ends are positions among all lines; blank lines inside a window do not count.
    """
    numbered = F.transform(lines_of(F.col(text)), lambda x, i: F.struct(F.trim(x).alias("line"), i.alias("at")))
    held = F.filter(numbered, lambda x: x["line"] != "")
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(whole(F.col(text))).alias("version"), held.alias("held"))
    rows = rows.where(F.size("held") > 0)
    later = [F.slice("held", i + 1, F.size("held")).alias(f"l{i}") for i in range(LINES)]
    runs = rows.select("doc_id", "version", F.explode(F.arrays_zip(*later)).alias("l"))
    line = [F.col(f"l.l{i}.line") for i in range(LINES)]
    words = [spaced_words(x) for x in line]
    sizes = []
    for n in range(1, LINES + 1):
        there = line[n - 1].isNotNull()
        if n < LINES:
            there = there & (sum(words[1:n], words[0]) > long_words)
        hashed = F.unhex(F.md5(F.concat_ws("\n", *line[:n])))
        sizes.append(F.when(there, F.struct(hashed.alias("h"), F.col(f"l.l{n - 1}.at").alias("last"))))
    each = runs.select("doc_id", "version", F.col("l.l0.at").alias("start"), F.explode(F.array_compact(F.array(*sizes))).alias("w"))
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version", "start", "w.last")
    return each.select("w.h", at.alias("at"))


def later_windows(found: DataFrame) -> DataFrame:
    """(no_id, doc_id, version, from, last): what later occurrences of repeated windows cover.

    A window that repeats inside one document by overlapping its own first occurrence covers only what
    lies behind that occurrence.
    """
    again = found.groupBy("h").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")
    rows = found.join(again, "h").where("at > first")
    same = F.col("at.doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at.version") == F.col("first.version"))
    start = F.when(same, F.greatest("at.start", F.col("first.last") + 1)).otherwise(F.col("at.start"))
    return rows.select("at.no_id", "at.doc_id", "at.version", start.alias("from"), "at.last").where("from <= last")


def dedup_lines(
    docs: DataFrame, long_words: int = 50, text: str = "text", key: str = "doc_id", removed: str = "n_removed"
) -> DataFrame:
    """``docs`` with ``text`` less the lines that later windows cover, and ``removed``: their number.

    Lines are compared without spaces around them. Blank lines belong to no window; those between covered
    lines go with them, all others stay. The order is by id, then text hash, then place; NULL ids come
    last. Texts with fewer than three lines and at most ``long_words`` words never change. NULL text stays
    NULL. Rows that repeat an id and text are one document and change alike: neither is later than the
    other. Empty table: no rows. All other columns stay; one with the name of ``removed`` is replaced.

    A very common window is pre-aggregated when its first occurrence is sought and split by the skew join
    when its later ones are; a document gathers only places of its own lines.
    """
    covers = later_windows(windows(docs, long_words, text, key))
    covered = covers.select("no_id", "doc_id", "version", F.explode(F.sequence("from", "last")).alias("line")).distinct()
    gone = covered.groupBy("no_id", "doc_id", "version").agg(F.collect_list("line").alias("x gone"))
    gone = gone.select(F.col("no_id").alias("x no"), F.col("doc_id").alias("x id"), F.col("version").alias("x version"), "x gone")
    same = (
        (F.xxhash64(whole(docs[text])) == F.col("x version"))
        & docs[key].eqNullSafe(F.col("x id"))
        & (docs[key].isNull() == F.col("x no"))
    )
    rows = docs.join(gone, same, "left").withColumn("x lines", F.when(F.col("x gone").isNotNull(), lines_of(docs[text])))
    stay = F.array_except(F.sequence(F.lit(0), F.size("x lines") - 1), "x gone")
    left = F.array_join(F.transform(stay, lambda i: F.get("x lines", i)), "\n")
    new = F.when(F.col("x gone").isNull(), docs[text]).otherwise(left)
    n = F.when(F.col("x gone").isNull(), 0).otherwise(F.size("x gone")).cast("long")
    columns = [new.alias(text) if c == text else docs[c] for c in docs.columns if c != removed]
    return rows.select(*columns, n.alias(removed))
