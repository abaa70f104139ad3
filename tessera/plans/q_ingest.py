"""Paths, dispatch, validation, page assembly, images and the sync plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import ingest as N
from tessera.operators import reply
from tessera.operators import sync as Y
from tessera.plans.base import Plans
from tessera.sources import views as V

PLANS = Plans()
queries, oracle_sql, add = PLANS.queries, PLANS.oracle_sql, PLANS.add


def paths(spark, d):
    """(doc_id, path): good paths and, every seventh, bad ones."""
    i = F.col("doc_id") % 7
    bad = F.when(i == 0, F.concat(F.lit("global/.d"), F.col("doc_id").cast("string"))).when(i == 1, "prj1/b1/x.md").when(i == 2, F.concat(F.lit("prj1/b1/misc/d"), F.col("doc_id").cast("string"), F.lit(".pdf")))
    return V.kb_docs(spark, d).select("doc_id", F.coalesce(bad, F.col("path")).alias("path"))


PATHS = """paths AS (SELECT doc_id, project, build, document_type, doc_id % 7 AS m, CASE doc_id % 7 WHEN 0 THEN 'global/.d' || doc_id WHEN 1 THEN 'prj1/b1/x.md' WHEN 2 THEN 'prj1/b1/misc/d' || doc_id || '.pdf' ELSE path END AS path FROM kb_docs)"""


@add("S02_path_metadata", f"""
WITH {V.KB_DOCS}, {PATHS} SELECT doc_id, CASE WHEN m > 2 THEN project END AS project, CASE WHEN m > 2 THEN build END AS build, CASE WHEN m > 2 THEN document_type END AS document_type, CASE WHEN m > 2 THEN 'd' || doc_id END AS title,
  CASE m WHEN 0 THEN 'hidden file' WHEN 1 THEN 'unexpected layout' WHEN 2 THEN 'unknown type folder' END AS reason FROM paths
""")
def s02(spark, d):
    return N.path_metadata(paths(spark, d)).select("doc_id", "project", "build", "document_type", "title", "reason")


@add("S01_raw_scan", f"WITH {V.KB_DOCS}, {PATHS} SELECT path, 'markdown' AS parser FROM paths WHERE m > 2")
def s01(spark, d):
    return N.supported(paths(spark, d))[0].select("path", "parser")


@add("S25_skip_report", f"WITH {V.KB_DOCS}, {PATHS} SELECT path, CASE m WHEN 1 THEN 'unexpected layout' ELSE 'unknown type folder' END AS reason FROM paths WHERE m IN (1, 2)")
def s25(spark, d):
    return N.supported(paths(spark, d))[1]


@add("S03_source_label", f"WITH {V.KB_DOCS} SELECT doc_id, 'data/raw/' || path AS source_file FROM kb_docs")
def s03(spark, d):
    return V.kb_docs(spark, d).select("doc_id", N.source_label(F.col("path")).alias("source_file"))


ENDINGS = [".md", ".PDF", ".xlsx", ".docx", ".doc", ".numbers", ".bin"]


@add("S04_parser_dispatch", f"""
WITH {V.KB_DOCS} SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'markdown' WHEN 1 THEN CASE document_type WHEN 'schematic' THEN 'schematic_pdf' WHEN 'datasheet' THEN 'datasheet_pdf' ELSE 'prose_pdf' END
  WHEN 2 THEN 'excel' WHEN 3 THEN 'docx' WHEN 4 THEN 'doc' WHEN 5 THEN 'iwork' END AS parser FROM kb_docs
""")
def s04(spark, d):
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % 7 + 1).cast("int"))
    return V.kb_docs(spark, d).select("doc_id", N.parser_kind(F.concat(F.lit("a/f"), ending), F.col("document_type")).alias("parser"))


@add("K15_mirror_path", """
SELECT doc_id, 'p/b/f' || doc_id || (['.md','.md','.md','.md','.md','.md','.bin'])[doc_id % 7 + 1] AS mirror, 'p/b/images/f' || doc_id AS images FROM documents
""")
def k15(spark, d):
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % 7 + 1).cast("int"))
    path = F.concat(F.lit("p/b/f"), F.col("doc_id").cast("string"), ending)
    return V.table(spark, d, "documents").select("doc_id", N.mirror_path(path).alias("mirror"), N.image_folder(path).alias("images"))


@add("S06_sheet_table", """
SELECT o_custkey AS doc, string_agg('## Sheet: s' || n || chr(10) || chr(10) || '| k | v\\|w |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderkey || ' |  |', chr(10) || chr(10) ORDER BY n) AS content
FROM (SELECT *, o_orderkey AS n FROM orders WHERE o_orderkey % 5 <> 0) GROUP BY 1
""")
def s06(spark, d):
    rows = F.array(F.array(F.lit("k"), F.lit("v|w")), F.array(F.lit(" "), F.lit("")), F.array(F.col("o_orderkey").cast("string")))
    empty = F.array(F.array(F.lit("")))
    sheets = V.table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("sheet_no"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("sheet"), F.when(F.col("o_orderkey") % 5 == 0, empty).otherwise(rows).alias("rows"))
    return N.sheet_markdown(sheets)


@add("S09_page_choice", """
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN a < 40 AND (b >= 40 OR b > a) THEN b ELSE a END::INTEGER AS chars FROM (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity::INTEGER AS a, (l_partkey % 60) AS b FROM lineitem)
""")
def s09(spark, d):
    native, scanned = F.repeat(F.lit("n"), F.col("l_quantity").cast("int")), F.repeat(F.lit("s"), (F.col("l_partkey") % 60).cast("int"))
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.length(N.chosen_page_text(native, scanned)).alias("chars"))


IMAGES = """images AS (SELECT o_custkey AS doc, (o_orderkey % 9)::INTEGER AS page, o_orderkey AS index, (o_orderkey % 400)::INTEGER AS width, (o_orderkey % 300)::INTEGER AS height, (o_orderkey % 4)::VARCHAR AS hash FROM orders)"""


def images(spark, d):
    o = F.col("o_orderkey")
    return V.table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), (o % 9).cast("int").alias("page"), o.alias("index"), (o % 400).cast("int").alias("width"), (o % 300).cast("int").alias("height"), (o % 4).cast("string").alias("hash"))


@add("S12_largest_images", f"WITH {IMAGES} SELECT doc, page, index FROM images WHERE width * height >= 10000 QUALIFY row_number() OVER (PARTITION BY doc, page ORDER BY width * height DESC, index) <= 5")
def s12(spark, d):
    return N.largest_images(images(spark, d)).select("doc", "page", "index")


@add("S13_distinct_images", f"WITH {IMAGES} SELECT doc, hash, min(page) AS page, arg_min(index, page * 10000000000 + index) AS index FROM images GROUP BY doc, hash HAVING count(DISTINCT page) <= 3")
def s13(spark, d):
    return N.distinct_images(images(spark, d))


@add("S15_page_assembly", """
SELECT o_custkey AS doc, '# Doc ' || o_custkey || chr(10) || chr(10) || string_agg('## Page ' || o_orderkey || chr(10) || chr(10) || o_orderpriority || chr(10) || chr(10) || '![x' || o_orderkey || '.png](i/x' || o_orderkey || '.png)', chr(10) || chr(10) ORDER BY o_orderkey) || chr(10) AS content FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1
""")
def s15(spark, d):
    picture = F.concat(F.lit("i/x"), F.col("o_orderkey").cast("string"), F.lit(".png"))
    blank = F.col("o_orderkey") % 3 == 0
    pages = V.table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.concat(F.lit("Doc "), F.col("o_custkey").cast("string")).alias("title"), F.col("o_orderkey").alias("page"), F.when(blank, " \n").otherwise(F.concat("o_orderpriority", F.lit("  \n\n\n"))).alias("text"), F.when(~blank, F.array(picture)).alias("images"))
    return N.assembled_pages(pages)


@add("T12_page_merge", """
SELECT o_custkey AS doc, count(*)::BIGINT AS page_count, string_agg(o_orderpriority, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY o_orderkey) AS content FROM orders GROUP BY 1
""")
def t12(spark, d):
    pages = V.table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), F.concat(F.lit("\n"), "o_orderpriority").alias("text"), F.array("o_orderstatus").alias("nets"), F.array("o_orderpriority").alias("interfaces"))
    return N.merged_schematic(pages).select("doc", "page_count", "content")


@add("T11_fidelity_appendix", None)
def t11(spark, d):
    once = N.with_appendix(F.lit("report"), F.col("text"))
    return V.hw_pages(spark, d).select("page_id", N.with_appendix(once, F.col("text")).alias("report"))


@add("S19_model_payload", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN 'N' || p_partkey ELSE 'N' || p_partkey || ',B' END AS nets FROM part
""")
def s19(spark, d):
    i = F.col("p_partkey").cast("string")
    full = F.concat(F.lit('{"components": ["U1"], "nets": ["N'), i, F.lit('", "B"], "interfaces": []}'))
    reply = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("```json\n"), full, F.lit("\n```"))).when(F.col("p_partkey") % 3 == 1, full).otherwise(F.concat(F.lit('{"components": ["U1"], "nets": ["N'), i, F.lit('", "trunc')))
    return V.table(spark, d, "part").select("p_partkey", F.array_join(N.model_payload(reply)["nets"], ",").alias("nets"))


@add("S21_mirror_scan", f"WITH {V.KB_DOCS} SELECT doc_id, path, CASE WHEN doc_id % 4 = 0 THEN '' ELSE document_type END AS document_type FROM kb_docs")
def s21(spark, d):
    docs = V.kb_docs(spark, d)
    sidecar = docs.filter("doc_id % 4 <> 0").select("path", F.to_json(F.struct("project", "build", "document_type")).alias("json"))
    parsed = docs.select("doc_id", "path").join(sidecar, "path", "left").withColumn("m", N.metadata_from_json(F.coalesce("json", F.lit("{}"))))
    return parsed.select("doc_id", "path", F.col("m.document_type").alias("document_type"))


RAW = "raw AS (SELECT path, (doc_id % 97)::DOUBLE AS mtime, doc_id AS size, doc_id FROM kb_docs WHERE doc_id % 7 <> 0)"
PROCESSED = "processed AS (SELECT path, (doc_id % 97)::DOUBLE AS mtime, doc_id + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS size, doc_id % 5 <> 0 AS has_sidecar FROM kb_docs WHERE doc_id % 13 <> 0)"


def raw(spark, d):
    return V.kb_docs(spark, d).filter("doc_id % 7 <> 0").select("path", (F.col("doc_id") % 97).cast("double").alias("mtime"), F.col("doc_id").alias("size"))


def processed(spark, d):
    i = F.col("doc_id")
    return V.kb_docs(spark, d).filter("doc_id % 13 <> 0").select("path", (i % 97).cast("double").alias("mtime"), (i + F.when(i % 11 == 0, 1).otherwise(0)).alias("size"), (i % 5 != 0).alias("has_sidecar"))


@add("K03_needs_ingest", f"WITH {V.KB_DOCS}, {RAW}, {PROCESSED} SELECT raw.path, NOT coalesce(has_sidecar AND raw.mtime = processed.mtime AND raw.size = processed.size, FALSE) AS ingest FROM raw LEFT JOIN processed USING (path)")
def k03(spark, d):
    return Y.needs_ingest(raw(spark, d), processed(spark, d))


@add("K04_orphans", f"WITH {V.KB_DOCS}, {RAW}, {PROCESSED} SELECT path FROM processed WHERE starts_with(path, 'prj1/') AND path NOT IN (SELECT path FROM raw)")
def k04(spark, d):
    return Y.orphans(processed(spark, d), raw(spark, d), "prj1/").select("path")


def snapshots(spark, d):
    rename = {"path": "target_file", "mtime": "source_mtime", "size": "source_size"}
    return raw(spark, d).withColumnsRenamed(rename), processed(spark, d).withColumnsRenamed(rename)


@add("K05_update_plan", f"""
WITH {V.KB_DOCS}, {RAW}, {PROCESSED} SELECT coalesce(raw.path, processed.path) AS target_file, CASE WHEN raw.path IS NULL THEN 'removed' WHEN raw.mtime = processed.mtime AND raw.size = processed.size THEN 'unchanged' ELSE 'index' END AS action
FROM raw FULL JOIN processed ON raw.path = processed.path
""")
def k05(spark, d):
    return Y.update_plan(*snapshots(spark, d))


@add("K06_incremental_merge", f"""
WITH {V.KB_DOCS}, {RAW}, {PROCESSED}, plan AS (SELECT coalesce(raw.path, processed.path) AS path, CASE WHEN raw.path IS NULL THEN 'removed' WHEN raw.mtime = processed.mtime AND raw.size = processed.size THEN 'unchanged' ELSE 'index' END AS action FROM raw FULL JOIN processed ON raw.path = processed.path)
SELECT path AS target_file, CASE action WHEN 'unchanged' THEN 'old' ELSE 'new' END AS origin FROM plan WHERE action <> 'removed'
""")
def k06(spark, d):
    current, stored = snapshots(spark, d)
    plan = Y.update_plan(current, stored)
    fresh = current.join(plan.filter("action = 'index'"), "target_file", "left_semi").select("target_file", F.lit("new").alias("origin"))
    return Y.merged_index(stored.select("target_file", F.lit("old").alias("origin")), plan, fresh)


@add("K10_metadata_json", f"WITH {V.KB_DOCS} SELECT doc_id, project, document_type = 'schematic' AS has_nets, 0 AS page FROM kb_docs")
def k10(spark, d):
    rows = V.kb_docs(spark, d).select("doc_id", "project", "build", "document_type", F.lit("t").alias("title"), F.lit("s").alias("source_file"), F.lit("").alias("target_file"), F.array(F.lit("N1")).alias("nets"))
    back = rows.select("doc_id", N.metadata_from_json(N.metadata_json(rows)).alias("m"))
    return back.select("doc_id", F.col("m.project").alias("project"), F.col("m.nets").isNotNull().alias("has_nets"), F.col("m.page").alias("page"))


@add("K11_metadata_rules", f"WITH {V.KB_DOCS} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'title missing' ELSE '' END || CASE WHEN doc_id % 15 = 0 THEN ',' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN 'page negative' ELSE '' END AS broken FROM kb_docs")
def k11(spark, d):
    i = F.col("doc_id")
    rows = V.kb_docs(spark, d).select("doc_id", "project", "build", "document_type", F.when(i % 5 != 0, "t").alias("title"), F.lit("s").alias("source_file"), F.when(i % 3 == 0, -1).otherwise(1).alias("page"))
    return N.violations(rows).select("doc_id", F.array_join("broken", ",").alias("broken"))


@add("K12_keyword_merge", f"WITH {V.KB_DOCS} SELECT doc_id, array_to_string(list_sort(list_distinct([build, project, 'a', 'z'])), ' ') AS keywords FROM kb_docs")
def k12(spark, d):
    return V.kb_docs(spark, d).select("doc_id", F.array_join(X.merged_keywords(F.array("build", F.lit("z")), F.array("project", F.lit("a"), "build")), " ").alias("keywords"))


@add("K14_fingerprints", f"WITH {V.KB_DOCS}, {RAW} SELECT path AS target_file, mtime AS source_mtime, size AS source_size FROM raw")
def k14(spark, d):
    return snapshots(spark, d)[0]


@add("K16_orphan_images", f"WITH {V.KB_DOCS} SELECT path AS target_file FROM kb_docs WHERE doc_id % 3 = 0")
def k16(spark, d):
    docs = V.kb_docs(spark, d)
    return Y.cascade_removed(docs.select(F.col("path").alias("target_file")), docs.filter("doc_id % 3 <> 0").select(F.col("path").alias("target_file")))


REPLIED = """replied AS (
  SELECT page_id, page_id % 4 AS form, CASE WHEN page_id % 4 = 1 THEN substr(text, 1, 40) ELSE text END AS markdown FROM hw_pages
)"""


@add("S19_reply", f"""
WITH {V.HW_PAGES}, {REPLIED}
SELECT page_id, markdown, CASE WHEN form IN (0, 2) THEN 'C7,U' || page_id ELSE array_to_string(list_sort(list_distinct(regexp_extract_all(markdown, '(?i)\\b([UCRLDQXJFETSW]\\d+[A-Z]?)\\b', 1))), ',') END AS components,
  CASE WHEN form IN (0, 2) THEN 'N_' || page_id ELSE '' END AS nets
FROM replied
""")
def s19_reply(spark, d):
    """Replies whole, broken off, with a comment of lists, and fenced."""
    n, text, form = F.col("page_id").cast("string"), F.col("text"), F.col("page_id") % 4
    lists = {"major_components": F.array(F.concat(F.lit("U"), n), F.lit("C7")), "nets": F.array(F.concat(F.lit("N_"), n)), "interfaces": F.array(F.lit("I2C"))}
    whole = F.to_json(F.struct(text.alias("markdown"), *(v.alias(k) for k, v in lists.items())))
    cut = F.concat(F.lit('{"markdown": "'), F.replace(F.substring(text, 1, 40), F.lit("\n"), F.lit("\\n")))
    meta = F.concat(text, F.lit("\n<!-- x:major_components=U"), n, F.lit(", C7;nets=N_"), n, F.lit(";interfaces=I2C -->"))
    said = F.when(form == 0, whole).when(form == 1, cut).when(form == 2, meta).otherwise(F.concat(F.lit("```markdown\n"), text, F.lit("\n```")))
    rows = reply.with_parsed(V.hw_pages(spark, d).select("page_id", said.alias("reply")), "reply")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return rows.select("page_id", "parsed.markdown", joined(F.col("parsed.major_components")).alias("components"), joined(F.col("parsed.nets")).alias("nets"))
