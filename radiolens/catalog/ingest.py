"""Sources and sinks: files are written from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from radiolens.catalog.base import CELL, check, rounded
from radiolens.catalog.windows import labeled, recommend_sql, LABELED_SQL
from radiolens.operators import cells
from radiolens.plans.stage import scratch_path
from radiolens.sources import documents, logs, store

RAW_NAMES = ["event_id", "Time", "Scrambling code (active)", "RSCP (active)", "Ec/N0 (active)", "RSCP (detected)",
             "Scrambling code (detected)", "k"]


@check("read_log", """select event_id::varchar as event_id, time_s, psc_s, trim(rscp_s) || case when rscp_s = 'n/a' then ' très' else '' end
  as rscp_s, ecn0_s, rscp_det_s, psc_det_s from umts_raw""", ("umts_raw",))
def _(t):
    """A folder with files in UTF-8 and files in latin1, both with accents."""
    path = scratch_path(t.spark, "umts-csv")
    rows = t.umts_raw.withColumn("rscp_s", F.when(F.col("rscp_s") == "n/a", "n/a très").otherwise(F.col("rscp_s"))).toDF(*RAW_NAMES)
    for encoding, odd in (("utf-8", 0), ("iso-8859-1", 1)):
        half = rows.where(F.col("event_id") % 2 == odd)
        half.write.mode("append").option("sep", ";").option("header", True).option("encoding", encoding).csv(path)
    raw = logs.read_log(t.spark, path)
    out = raw.toDF("event_id", "time_s", "psc_s", "rscp_s", "ecn0_s", "rscp_det_s", "psc_det_s", "k").drop("k")
    return out.withColumn("rscp_s", F.trim("rscp_s"))


@check("read_lte_log", """select strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as time, pci::double as pci, band, rsrp, rsrq, rlc_dl
  from lte_raw""", ("lte_raw",))
def _(t):
    path = scratch_path(t.spark, "lte-csv")
    t.lte_raw.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Time"), F.col("pci").alias("PCI"),
        F.col("band").alias("Band"), F.col("rsrp").alias("RSRP"), F.col("rsrq").alias("RSRQ"), F.col("rlc_dl").alias("RLC_DL"),
    ).write.option("header", True).csv(path)
    return logs.read_lte_log(t.spark, path)


@check("validate_columns", """select c.expected, c.expected in ('event_id', 'psc', 'rscp', 'ecn0') as present, n.n
  from (values ('event_id'), ('psc'), ('rscp'), ('ecn0'), ('bler')) c(expected), (select count(*) as n from umts) n""", ("umts",))
def _(t):
    expected = ["event_id", "psc", "rscp", "ecn0", "bler"]
    missing = logs.missing_columns(t.umts, expected)
    counted = logs.validate_columns(t.umts, [c for c in expected if c not in missing]).agg(F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.struct(F.lit(c).alias("expected"), F.lit(c not in missing).alias("present")) for c in expected])
    return counted.select("n", F.inline(rows))


@check("parse_device_log", """select event_id, rsrp, rsrq, (event_id % 40)::double as "Downlink(Mbps)", 'op' || (pci % 3) as "Network provi."
  from lte_raw""", ("lte_raw",))
def _(t):
    device = t.lte_raw.select(
        "event_id",
        F.concat(F.col("rsrp").cast("string"), F.lit(" dBm")).alias("rsrp"),
        F.concat(F.col("rsrq").cast("string"), F.lit(" dB")).alias(" rsrq"),
        F.concat(F.col("event_id") % 40, F.lit(" Mbps")).alias("Downlink(Mbps)"),
        F.concat(F.lit(" op"), F.col("pci") % 3, F.lit(" ")).alias("Network provi. "),
    )
    return logs.parse_device_log(device, ["rsrp", "rsrq", "Downlink(Mbps)"], ["Network provi."])


def notebooks(t):
    """Notebook documents built from the text tables: markdown and code cells, lines or one string."""
    lines = F.split("text", "\n")
    cells_of = F.array(
        F.struct(F.lit("code").alias("cell_type"), F.to_json(F.array(F.lit("x = 1"))).alias("source")),
        F.struct(F.lit("markdown").alias("cell_type"), F.to_json(lines).alias("source")),
        F.struct(F.lit("markdown").alias("cell_type"), F.lit('["short"]').alias("source")),
    )
    # source must be raw JSON, not a quoted string, so the document is put together as text
    cell_json = F.array_join(F.transform(cells_of, lambda c: F.concat(
        F.lit('{"cell_type":"'), c["cell_type"], F.lit('","source":'), c["source"], F.lit("}"))), ",")
    return t.documents.select(
        F.concat(F.lit("nb"), "doc_id", F.lit(".ipynb")).alias("source"),
        F.concat(F.lit('{"cells":['), cell_json, F.lit("]}")).alias("text"),
    )


@check("notebook_markdown", r"""
with l as (select doc_id, array_to_string(string_split(text, chr(10)), ' ') as j from documents)
select 'notebook/nb' || doc_id || '.ipynb#cell0' as source, 'notebook_insight' as type, substring(j, 1, 1000) as text
from l where length(j) > 100""")
def _(t):
    return documents.notebook_markdown(notebooks(t))


TABLE_DOC = """
lines as (select row_number() over (order by interference_rate desc, psc) as n,
  psc || ' | ' || interference_rate || ' | ' || handover_rate || ' | ' || recommendation as line from recs)
select 'project/cell_recommendations' as source, 'cell_analysis' as type,
  'Cell Recommendations (top 20):' || chr(10) || 'psc | interference_rate | handover_rate | recommendation' || chr(10) ||
  (select string_agg(line, chr(10) order by n) from lines where n <= 20) as text
"""


@check("table_to_document", "with " + LABELED_SQL + ", " + recommend_sql("labeled").strip() + "," + TABLE_DOC, ("umts",))
def _(t):
    recs = cells.cell_recommendations(labeled(t))
    return documents.table_to_document(
        recs, [F.desc("interference_rate"), "psc"], "Cell Recommendations (top 20):",
        "project/cell_recommendations", "cell_analysis")


@check("sample_rows", "select event_id, psc, rscp, ecn0 from umts order by ts, event_id limit 100", ("umts",))
def _(t):
    return store.sample_rows(t.umts, ["ts", "event_id"], 100).select("event_id", "psc", "rscp", "ecn0")


STAGED = "with " + LABELED_SQL + """select psc, count(*) as n, sum(interference)::bigint as alarms from labeled group by psc"""


@check("write_stage", STAGED, ("umts",))
def _(t):
    """Write the labeled rows partitioned by cell, read them back, aggregate."""
    root = scratch_path(t.spark, "stage")
    path = store.write_stage(labeled(t), root, "labeled", ["psc"])
    return t.spark.read.parquet(path).groupBy("psc").agg(
        F.count(F.lit(1)).alias("n"), F.sum("interference").alias("alarms"))


@check("read_or_compute", "with " + LABELED_SQL + ", " + recommend_sql("labeled") + "select * from recs", ("umts",))
def _(t):
    root = scratch_path(t.spark, "cells")
    store.read_or_compute(t.spark, root, "cell_recommendations", lambda: cells.cell_recommendations(labeled(t)))

    def never():
        raise AssertionError("the stored table must be used")

    return store.read_or_compute(t.spark, root, "cell_recommendations", never)


@check("read_documents", """select doc_id, 'telecom_doc' as type, text || chr(10) as text from documents""")
def _(t):
    """One file per document in a folder tree; the relative path names the document."""
    path = scratch_path(t.spark, "documents")
    documents.write_documents(t.documents, path, "doc_id")
    rows = documents.read_documents(t.spark, path, "*.txt")
    number = F.regexp_extract("source", r"^knowledge_base/(?:.*/)?doc_id=(\d+)[./]", 1).cast("bigint")
    return rows.select(number.alias("doc_id"), "type", "text")


@check("union_documents", r"""
with l as (select doc_id, array_to_string(string_split(text, chr(10)), ' ') as j from documents)
select source, 'telecom_doc' as type, text, doc_id from documents
union all
select 'notebook/nb' || doc_id || '.ipynb#cell0', 'notebook_insight', substring(j, 1, 1000), null from l where length(j) > 100""")
def _(t):
    docs = t.documents.select("source", F.lit("telecom_doc").alias("type"), "text", "doc_id")
    return documents.union_documents(docs, documents.notebook_markdown(notebooks(t)))
