"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolens.llm import bpe
from radiolens.llm.common import WORD, table, whole
from radiolens.llm.exact import exact_duplicates
from radiolens.llm.lines import dedup_lines
from radiolens.llm.mixing import mix_sources
from radiolens.llm.pages import main_text
from radiolens.llm.perplexity import score_quality
from radiolens.llm.private import KINDS, find_private, written
from radiolens.llm.repeats import longest_run, periodic_runs
from radiolens.llm.shards import shard_rows
from radiolens.llm.simhash import simhash_groups
from radiolens.llm.spelling import count_words, spelling_variants, worn_words
from radiolens.llm.toxicity import held_out, score_toxicity
from radiolens.llm.vectors import vector_groups

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VOCABULARY = dict(vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"))
PATTERN = dict(pattern=public_tokenizers.PATTERN)
TOXIC = 0.3
MIX = dict(weights=(3, 1, 2), share=1.5, most=2.0)


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


@query(
    "op1_mix_sources",
    r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as spot
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (
  select *, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as weight,
         source_size * 2.0::double as cap
  from s),
l as (
  select *, (sum(source_size) over () * 1.5::double
             - coalesce(sum(cap) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0))
            / (sum(weight) over ()
             - coalesce(sum(weight) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0)) as level
  from w),
t as (select source, source_size, least(cap, weight * max(level) over ()) as target from l),
r as (
  select d.doc_id, d.size, t.source_size, t.target,
         sum(d.size) over (partition by d.source order by d.spot range unbounded preceding) as upto,
         sum(d.size) over (partition by d.source, d.spot) as own
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (size * (case when 2 * (upto - own) + own <= 2 * least(target, source_size) then 1 else 0 end
              + case when 2 * (upto - own) + own <= 2 * (target - source_size) then 1 else 0 end))::bigint as taken
from r""",
)
def _mix(spark, sf_dir):
    rows = mix_sources(table(spark, sf_dir, "documents"), **MIX)
    return rows.select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op6_exact_duplicates",
    """
with t as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as n
  from documents)
select doc_id, max(doc_id) over (partition by n) as keep_id, count(*) over (partition by n) as group_size,
       coalesce(doc_id = max(doc_id) over (partition by n), false) as kept, sha256(n) as text_sha256
from t""",
)
def _exact(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


@query("op2_byte_bpe")
def _bpe(spark, sf_dir):
    rows = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), **VOCABULARY, **PATTERN)
    return rows.select(
        "doc_id", bpe.n_tokens("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


SIMHASH = dict(shingle=3, budget=3)


@query("op7_simhash")
def _simhash(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"), **SIMHASH)


LINE_SQL = r"""
with recursive k as (select doc_id, text, string_split(text, chr(10)) as l from documents where text is not null),
u as (select doc_id, unnest(l) as raw, unnest(range(len(l))) as i from k),
n as (
  select doc_id, i, trim(raw, ' ') as t, row_number() over (partition by doc_id order by i) as p
  from u where trim(raw, ' ') <> ''),
m as (
  select *, len(t) - len(replace(t, ' ', '')) + 1 as words,
         lead(t) over v as t2, lead(t, 2) over v as t3, lead(i) over v as i2, lead(i, 2) over v as i3,
         lead(len(t) - len(replace(t, ' ', '')) + 1) over v as words2
  from n window v as (partition by doc_id order by i)),
w as (
  select doc_id, i as start, i as last, t as body from m where words > 50
  union all
  select doc_id, i, i2, t || chr(10) || t2 from m where t2 is not null and words + words2 > 50
  union all
  select doc_id, i, i3, t || chr(10) || t2 || chr(10) || t3 from m where t3 is not null),
f as (
  select *, min((doc_id, start, last)) over (partition by body) as first, count(*) over (partition by body) as n from w),
c as (
  select doc_id, case when doc_id = first[1] then greatest(start, first[3] + 1) else start end as from_, last
  from f where n > 1 and (doc_id, start, last) > first),
g as (select distinct doc_id, unnest(range(from_, last + 1)) as i from c where from_ <= last),
r as (
  select u.doc_id, string_agg(raw, chr(10) order by u.i) filter (where g.i is null) as text, count(g.i) as n_removed
  from u left join g on u.doc_id = g.doc_id and u.i = g.i group by u.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(r.text, '') end as text, coalesce(n_removed, 0) as n_removed
from documents d left join r using (doc_id)"""


@query("op9_line_dedup", LINE_SQL)
def _lines(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents"), long_words=50).select("doc_id", "text", "n_removed")


@query("op8_toxicity")
def _toxicity(spark, sf_dir):
    rows = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted")
    )


@query("op10_personal_data")
def _private(spark, sf_dir):
    rows = find_private(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = rows.withColumn("base", F.filter("spans", lambda s: s["base"]))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query("op4_vector_groups")
def _vectors(spark, sf_dir):
    return vector_groups(table(spark, sf_dir, "embeddings"), least=0.9)


@query("op3_main_text")
def _pages(spark, sf_dir):
    rows = main_text(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op5_quality")
def _quality(spark, sf_dir):
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return score_quality(table(spark, sf_dir, "documents"), trusted, quantile=0.99, slack=1.05)


def repeating(docs: DataFrame) -> DataFrame:
    """One document in ten, by the CRC-32 of its id, with its words from a place on repeating the first few of them."""
    docs = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    g = F.floor(F.col("h") / 10)
    words = docs.where("h % 10 = 0").withColumn("w", F.regexp_extract_all(whole(F.col("text")), F.lit(WORD), F.lit(0)))
    words = words.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
    words = words.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    tail = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)")
    told = F.when(F.col("n") > 0, F.array_join(F.concat(F.expr("slice(w, 1, a)"), tail), " "))
    same = docs.where("h % 10 <> 0 or h is null").select("doc_id", "text")
    return same.union(words.select("doc_id", told.alias("text")))


@query("op11_periodic_runs")
def _runs(spark, sf_dir):
    rows = periodic_runs(repeating(table(spark, sf_dir, "documents")), least=6)
    rows = rows.withColumn("longest", longest_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start", "longest.length", "longest.period",
        F.floor(1000 * F.col("longest.length") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_feistel_shards")
def _shards(spark, sf_dir):
    text = whole(F.col("text")).cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(rows, 16, seed=42).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op13_spelling_variants")
def _spelling(spark, sf_dir):
    tokens = worn_words(table(spark, sf_dir, "documents"), run=r"[A-Za-z\u00C0-\u00FF]+", every=97)
    return spelling_variants(count_words(tokens, shortest=5, least=3), ratio=2)
