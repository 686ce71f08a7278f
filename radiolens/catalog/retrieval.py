"""Chunks, vectors, nearest chunks and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from radiolens.catalog.base import check, rounded
from radiolens.functions.scalar import QOS_CLASSES
from radiolens.operators import cells, retrieve
from radiolens.operators.retrieve import CLOSING, NO_DOCUMENTS, NO_PREDICTION
from radiolens.plans.stage import materialize, scratch_path
from radiolens.sources import documents

SPACES = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
CHUNKS = f"""
w as (select doc_id, source, list_filter(regexp_split_to_array(text, '{SPACES}'), lambda x: x <> '') as words from documents),
s as (select *, unnest(range(0, len(words), 450)) as start from w where len(words) > 0),
chunks as (select doc_id, source, (start // 450)::int as chunk,
  array_to_string(list_slice(words, start + 1, start + 500), ' ') as text from s)
"""


def chunks(t):
    return retrieve.chunk_words(t.documents.select("doc_id", "source", "text"))


@check("chunk_words", "with " + CHUNKS + "select * from chunks")
def _(t):
    return chunks(t)


@check("chunk_ids", "with " + CHUNKS + """select source || '/' || doc_id || '.md' as source, chunk,
  source || '/' || doc_id || '_' || chunk as chunk_id, text from chunks""")
def _(t):
    rows = chunks(t).withColumn("source", F.concat("source", F.lit("/"), "doc_id", F.lit(".md")))
    return retrieve.chunk_ids(rows).drop("doc_id")


@check("embed", "with " + CHUNKS + "select doc_id, chunk, 256 as dims, 1.0::double as norm from chunks")
def _(t):
    """A vector for every chunk, of the asked size and of unit length."""
    rows = retrieve.embed(retrieve.chunk_ids(chunks(t)))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.select("doc_id", "chunk", F.size("embedding").alias("dims"), F.round(norm, 3).alias("norm"))


def vectors(t):
    """Every vector asks and is found; one of 97 is a zero vector."""
    zero = F.transform("embedding", lambda x: x * 0)
    rows = t.embeddings.withColumn("embedding", F.when(F.col("vec_id") % 97 == 0, zero).otherwise(F.col("embedding")))
    return rows.select(F.col("vec_id").alias("query_id"), "embedding"), rows.select(F.col("vec_id").alias("chunk_id"), "embedding")


TOPK = """
c as (select q.vec_id as query_id, v.vec_id as chunk_id, case when q.vec_id % 97 = 0 or v.vec_id % 97 = 0 then 0.0::double
   else list_cosine_similarity(q.embedding::double[], v.embedding::double[]) end as score
   from embeddings q, embeddings v),
hits as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from c)
   where rank <= {k})
"""


@check("cosine_topk", "with " + TOPK.format(k=5) + "select query_id, chunk_id, round(score, 6) as score, rank from hits")
def _(t):
    asked, base = vectors(t)
    return rounded(retrieve.cosine_topk(asked, base, 5))


@check("cosine_topk_join", "with " + TOPK.format(k=5) + "select query_id, chunk_id, round(score, 6) as score, rank from hits")
def _(t):
    """The same rows from many small blocks."""
    asked, base = vectors(t)
    return rounded(retrieve.cosine_topk(asked, base, 5, block_rows=97))


LABELS = tuple(QOS_CLASSES.values())


def questions(t):
    """User turns as questions; two of three carry a prediction."""
    p = (F.col("conv_id") % 7 + 1) / 10.0
    has = F.col("conv_id") % 3 > 0
    return t.conversations.where(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.col("text").alias("question"),
        F.when(has, F.when(F.col("conv_id") % 2 == 0, "qos").otherwise("coverage")).alias("prediction_type"),
        F.when(has & (F.col("conv_id") % 5 > 0), F.lit("Mauvaise")).alias("predicted_class"),
        F.when(has & (F.col("conv_id") % 4 > 0), p * 100).alias("confidence"),
        F.when(has, F.create_map(F.lit("Mauvaise"), p, F.lit("Tres bonne"), (1 - p) / 4, F.lit("Acceptable"), (1 - p) / 2))
        .alias("probabilities"),
    )


Q = """
q as (select conv_id * 1000 + turn as query_id, conv_id, text as question, ((conv_id % 7 + 1) / 10.0)::double as p,
  case when conv_id % 3 > 0 then case when conv_id % 2 = 0 then 'qos' else 'coverage' end end as kind,
  case when conv_id % 3 > 0 and conv_id % 5 > 0 then 'Mauvaise' end as label,
  case when conv_id % 3 > 0 and conv_id % 4 > 0 then ((conv_id % 7 + 1) / 10.0)::double * 100 end as conf
  from conversations where role = 'user')
"""


@check("enrich_query", "with " + Q + """,
o as (select query_id, 'Mauvaise' as l, p as v, 0 as i from q where kind is not null union all
  select query_id, 'Tres bonne', (1 - p) / 4, 1 from q where kind is not null union all
  select query_id, 'Acceptable', (1 - p) / 2, 2 from q where kind is not null),
r as (select *, row_number() over (partition by query_id order by v desc, i) as n from o),
tp as (select query_id, ' Probabilities: ' || string_agg(l || ': ' || printf('%.1f', round(v * 100, 4)) || '%', ', ' order by n) as tail
  from r where n <= 2 group by query_id)
select q.query_id, case when label is not null then 'Coverage class ' || label ||
    case when conf is not null then ' (confidence: ' || printf('%.1f', conf) || '%)' else '' end || '. ' || question
  when kind is not null then kind || ' analysis. ' || question else question end || coalesce(tail, '') as enriched
from q left join tp using (query_id)""")
def _(t):
    return retrieve.enrich_query(questions(t)).select("query_id", "enriched")


def hits(t):
    """Nearest texts of every query vector, with the document of the same number as content."""
    asked, base = vectors(t)
    near = retrieve.cosine_topk(asked, base, 3)
    texts = t.documents.select(F.col("doc_id").alias("chunk_id"), "text", "source", F.lit("telecom_doc").alias("type"))
    return retrieve.hits_with_content(near, texts)


CONTEXT = TOPK.format(k=3).strip() + """,
ctx as (select query_id, string_agg('Source: ' || d.source || chr(10) || substring(d.text, 1, 500), chr(10) || chr(10) order by rank)
  as context from hits join documents d on d.doc_id = hits.chunk_id group by query_id)
"""


@check("build_context", "with " + CONTEXT + "select * from ctx")
def _(t):
    return retrieve.build_context(hits(t))


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@check("build_prompts", "with " + Q.strip() + "," + CONTEXT + f"""
select q.query_id, case when kind is null then {sql_text(NO_PREDICTION)} else '**Current ' || case when kind = 'qos' then 'QoS' else 'Coverage' end
   || ' Prediction:**' || chr(10) || '- Predicted Class: ' || coalesce(label, 'N/A') || chr(10) || '- Confidence: ' ||
   coalesce(printf('%.2f', conf) || '%', 'N/A') || chr(10) || '- Probabilities: ' ||
   printf('Mauvaise: %.2f', p * 100) || '%, ' || printf('Tres bonne: %.2f', (1 - p) / 4 * 100) || '%, ' ||
   printf('Acceptable: %.2f', (1 - p) / 2 * 100) || '%' || chr(10) || chr(10) end
  || '**User Question:** ' || question || chr(10) || chr(10) || '**Relevant Documentation:**' || chr(10) ||
  coalesce(context, {sql_text(NO_DOCUMENTS)}) || chr(10) || chr(10) || {sql_text(CLOSING)} as prompt
from q left join ctx on ctx.query_id = q.query_id""")
def _(t):
    return retrieve.build_prompts(questions(t), retrieve.build_context(hits(t)))


HEAD_SQL = f"""case when kind is null then {sql_text(NO_PREDICTION)} else '**Current ' || case when kind = 'qos' then 'QoS' else 'Coverage' end
   || ' Prediction:**' || chr(10) || '- Predicted Class: ' || coalesce(label, 'N/A') || chr(10) || '- Confidence: ' ||
   coalesce(printf('%.2f', conf) || '%', 'N/A') || chr(10) || '- Probabilities: ' ||
   printf('Mauvaise: %.2f', p * 100) || '%, ' || printf('Tres bonne: %.2f', (1 - p) / 4 * 100) || '%, ' ||
   printf('Acceptable: %.2f', (1 - p) / 2 * 100) || '%' || chr(10) || chr(10) end || '**User Question:** ' || question"""


@check("answer_prompts", "with " + Q + f"""select query_id, {HEAD_SQL} as head, 3 as sources, true as ended, 0 as foreign_texts from q""")
def _(t):
    """From question to prompt over the chunks of all documents, the cell table among them.

    Every prompt has its question in front, three sources that stand in the corpus with their texts, and the closing.
    """
    table = documents.table_to_document(
        cells.cell_stats(t.umts), ["psc"], "Cell table", "results/cells.csv", "result_table")
    corpus = documents.union_documents(typed(t), table).withColumn("chunk", F.coalesce("chunk", F.lit(0)))
    corpus = corpus.withColumn("source", F.concat_ws("/", "source", F.concat("doc_id", F.lit(".md"))))
    corpus = materialize(retrieve.chunk_ids(corpus).select("chunk_id", "source", "type", "text"))
    rows = retrieve.answer_prompts(questions(t), corpus)
    parts = F.split("prompt", "\n\n\\*\\*Relevant Documentation:\\*\\*\n")
    rows = materialize(rows.select("query_id", parts[0].alias("head"), parts[1].alias("tail"), F.endswith("prompt", F.lit("\n\n" + CLOSING)).alias("ended")))
    found = rows.select("query_id", F.explode(F.filter(F.split("tail", "(^|\n\n)Source: "), lambda x: x != "")).alias("hit"))
    source = F.substring_index("hit", "\n", 1)
    text = F.trim(F.regexp_replace(F.substr("hit", F.length(source) + 2), F.lit("\n\n" + CLOSING), F.lit("")))
    named = found.select("query_id", source.alias("source"), F.substring(text, 1, 100).alias("begin"))
    known = corpus.select("source", F.substring(F.trim("text"), 1, 100).alias("begin")).distinct()
    strange = named.join(known, ["source", "begin"], "left_anti").groupBy("query_id").count().withColumnRenamed("count", "strange")
    sources = named.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("sources"))
    return rows.join(sources, "query_id", "left").join(strange, "query_id", "left").select(
        "query_id", "head", F.coalesce("sources", F.lit(0)).alias("sources"), "ended", F.coalesce(F.col("strange").cast("int"), F.lit(0)).alias("foreign_texts"))


@check("build_prompts_plain", "with " + Q + """
select query_id, case when kind is null then '' else 'Prediction context:' || chr(10) || '- Type: ' || kind || chr(10) ||
  coalesce('- Predicted Class: ' || label || chr(10), '') || coalesce('- Confidence: ' || printf('%.2f', conf) || '%' || chr(10), '') ||
  '- Probabilities: ' || printf('Mauvaise: %.2f', p * 100) || '%, ' || printf('Tres bonne: %.2f', (1 - p) / 4 * 100) || '%, ' ||
   printf('Acceptable: %.2f', (1 - p) / 2 * 100) || '%' || chr(10) end
  || chr(10) || 'User question: ' || question as prompt from q""")
def _(t):
    return retrieve.build_prompts_plain(questions(t)).select("query_id", "prompt")


STATUS = "with " + CHUNKS + "select 'telecom_doc' as type, source, count(*) as chunks from chunks group by source"


def typed(t):
    return chunks(t).withColumn("type", F.lit("telecom_doc"))


@check("corpus_status", STATUS)
def _(t):
    return retrieve.corpus_status(typed(t))


@check("rebuild_index", STATUS)
def _(t):
    """Built once; the second call finds the stored table, the forced one writes it again."""
    path = scratch_path(t.spark, "index")
    retrieve.rebuild_index(typed(t), path)
    retrieve.rebuild_index(typed(t).limit(0), path)
    return retrieve.corpus_status(retrieve.rebuild_index(typed(t), path, force=True))
