"""Page documents, prompts by route, model calls through hooks, and the store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import answer as A
from tessera.operators import hooks, pages
from tessera.operators import index as I
from tessera.operators.durable import shared_folder
from tessera.plans.base import Plans
from tessera.plans.q_retrieve import EMBEDDED, STATS, docs, written_vector
from tessera.sources import views as V

PLANS = Plans()
queries, oracle_sql, add = PLANS.queries, PLANS.oracle_sql, PLANS.add


def sheet_pages(spark, d):
    """Pages of datasheets: customers are documents, orders their pages."""
    o = F.col("o_orderkey")
    kind = o % 3
    return V.table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("doc"), F.concat(F.lit("Sheet "), F.col("o_custkey").cast("string")).alias("title"), o.cast("int").alias("page"),
        F.when(kind == 0, F.repeat(F.lit("t"), 600)).otherwise("short").alias("text"), F.when(kind == 1, 60).otherwise(3).alias("lines"), F.lit(0.1).alias("image_ratio"),
        F.when(kind == 2, F.concat(F.lit("scan "), o.cast("string"))).alias("scanned"), F.when(kind == 1, F.concat(F.lit("table "), o.cast("string"))).alias("described"),
    )


@add("S17_datasheet_document", """
WITH p AS (SELECT o_custkey::VARCHAR AS doc, o_orderkey AS page, CASE o_orderkey % 3 WHEN 0 THEN repeat('t', 600) WHEN 1 THEN 'table ' || o_orderkey ELSE 'scan ' || o_orderkey END AS body, CASE WHEN o_orderkey % 3 = 2 THEN 'scan ' || o_orderkey END AS scan FROM orders)
SELECT doc, md5('# Sheet ' || doc || chr(10) || chr(10) || string_agg('## Page ' || page || chr(10) || chr(10) || body || chr(10), chr(10) ORDER BY page) ||
  coalesce(chr(10) || '---' || chr(10) || chr(10) || '## OCR Fidelity Appendix' || chr(10) || chr(10) || string_agg('### Page ' || page || ' OCR' || chr(10) || chr(10) || scan || chr(10), chr(10) ORDER BY page) FILTER (WHERE scan IS NOT NULL), '')) AS digest FROM p GROUP BY 1
""")
def s17(spark, d):
    return pages.datasheet_documents(sheet_pages(spark, d)).select("doc", F.md5("content").alias("digest"))


@add("S18_schematic_document", None)
def s18(spark, d):
    rows = V.hw_pages(spark, d).select((F.col("page_id") % 50).cast("string").alias("doc"), F.lit("Board").alias("title"), F.col("page_id").cast("int").alias("page"), "text", F.lit(0).alias("lines"), F.lit(0.0).alias("image_ratio"), F.col("text").alias("scanned"), F.lit(None).cast("string").alias("described"), F.lit("p1").alias("project"))
    return pages.schematic_documents(rows).select("doc", "page_count", F.md5("content").alias("digest"))


@add("T10_signal_blocks", None)
def t10(spark, d):
    return pages.with_fields(V.hw_pages(spark, d), F.col("text")).select("page_id", pages.signal_summary().alias("summary"))


@add("S14_image_captions", "SELECT 'f' || (o_orderkey % 100) AS file, o_orderkey AS index, CASE WHEN o_orderkey % 100 < 40 THEN 'caption ' || (o_orderkey % 100) END AS caption FROM orders")
def s14(spark, d):
    n = (F.col("o_orderkey") % 100).cast("string")
    images = V.table(spark, d, "orders").select(F.concat(F.lit("f"), n).alias("file"), F.col("o_orderkey").alias("index"))
    said = spark.range(40).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), F.concat(F.lit("caption "), F.col("id").cast("string")).alias("caption"))
    return pages.with_descriptions(images, said)


@add("S22_index_store", f"""
WITH {V.KB_DOCS}, {STATS}, live AS (SELECT doc_id FROM kb_docs WHERE doc_id % 7 <> 3)
SELECT token, count(*)::BIGINT AS df, sum(tf)::BIGINT AS tf, sum(length)::BIGINT AS chars FROM posts JOIN sizes USING (doc_id) JOIN live USING (doc_id) GROUP BY 1
""")
def s22(spark, d):
    """Two index versions: all documents, then some changed and some gone; postings read back by token,
    with the frequencies that went from version to version."""
    rows = docs(spark, d).withColumns({"index_text": F.col("content"), "target_file": F.col("chunk_key").cast("string")})
    prints = rows.select("target_file", F.lit(0.0).alias("source_mtime"), F.col("pos").alias("source_size"))
    store = I.Store(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    store.save(rows, prints)
    gone, again = F.col("target_file").cast("long") % 7 == 3, F.col("target_file").cast("long") % 7 == 5
    store.save(rows.filter(again), prints.filter(again), store.load("manifest").filter(~gone & ~again))
    posts = store.load("totals").select("token", "tf", "chars")
    return posts.join(store.load("tokens").select("token", "df"), "token").select("token", "df", "tf", "chars")


@add("G10_classification", "SELECT conv_id, turn, CASE WHEN contains(coalesce(text, ''), 'th') THEN 'debug' ELSE 'wiki' END AS task FROM conversations")
def g10(spark, d):
    rows = V.table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"))

    def model(prompts: list[str]) -> list[str]:
        return ["Debug." if "th" in p.partition("Question: ")[2] else "?" for p in prompts]

    return A.classified(rows, model).select("conv_id", "turn", "task")


@add("G15_prompts", f"""
SELECT o_orderkey AS qid, CASE o_orderkey % 3 WHEN 0 THEN replace(replace('{A.TRANSLATION.replace(chr(10), "' || chr(10) || '")}', '{{{{history}}}}', 'h'), '{{{{question}}}}', 'q' || o_orderkey) WHEN 1 THEN 'ctx / q' || o_orderkey END AS prompt FROM orders
""")
def g15(spark, d):
    o = F.col("o_orderkey")
    route = F.when(o % 3 == 0, "translation").when(o % 3 == 1, "prepared").otherwise("insufficient")
    return V.table(spark, d, "orders").select(o.alias("qid"), A.prompt_for(route, F.concat(F.lit("q"), o.cast("string")), F.lit("h"), F.lit("ctx"), "{{context}} / {{question}}").alias("prompt"))


@add("R01_query_embedding", f"WITH {V.QUESTIONS}, {EMBEDDED.format(key='qid', text='query', rows='questions')} SELECT qid, vector, 1.0::DOUBLE AS norm FROM embedded")
def r01(spark, d):
    units = I.unit_vectors(hooks.embedded(V.questions(spark, d), "query"))
    return units.select("qid", written_vector().alias("vector"), F.round(F.aggregate("unit", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))
