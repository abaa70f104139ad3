"""Chunking over web pages as Markdown and over prose."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import chunk as C
from tessera.plans.base import Plans
from tessera.sources import views as V

PLANS = Plans()
queries, oracle_sql, add = PLANS.queries, PLANS.oracle_sql, PLANS.add

STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
LINES = f"""raw_lines AS (SELECT page_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT page_id, string_split(content, chr(10)) AS l FROM markdown_docs)),
fenced AS (SELECT *, starts_with({STRIP.format('line')}, '```') AS fence FROM raw_lines),
lines AS (SELECT *, NOT fence AND sum(fence::INTEGER) OVER (PARTITION BY page_id ORDER BY line_no) % 2 = 1 AS inside FROM fenced)"""
SECTIONS = f"""marked AS (SELECT *, NOT fence AND NOT inside AND regexp_matches(line, '^(#{{1,2}})\\s+(.+)$') AS head FROM lines),
numbered AS (SELECT *, sum(head::INTEGER) OVER (PARTITION BY page_id ORDER BY line_no) AS section FROM marked),
sections AS (SELECT page_id, section::INTEGER AS section, {STRIP.format("string_agg(line, chr(10) ORDER BY line_no)")} AS text,
  coalesce(max({STRIP.format("regexp_extract(line, '^(#{1,2})\\s+(.+)$', 2)")}) FILTER (WHERE head), '') AS heading FROM numbered GROUP BY 1, 2)"""


def kb(spark, d):
    docs = V.kb_docs(spark, d)
    return docs.select(F.col("path").alias("target_file"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("stem"), F.lit("note").alias("document_type"), "content")


@add("C01_fence_scan", f"WITH {V.MARKDOWN_DOCS}, {LINES} SELECT page_id, count(*) FILTER (WHERE NOT fence AND NOT inside)::BIGINT AS open_lines, count(*) FILTER (WHERE inside)::BIGINT AS inside FROM lines GROUP BY 1")
def c01(spark, d):
    rows = C.lines(V.markdown_docs(spark, d), "page_id")
    return rows.groupBy("page_id").agg(F.count_if(~F.col("fence") & ~F.col("inside")).alias("open_lines"), F.count_if("inside").alias("inside"))


@add("C02_document_title", f"""
WITH {V.MARKDOWN_DOCS}, {LINES}, heads AS (SELECT page_id, arg_min(line, line_no) AS line FROM lines WHERE NOT fence AND NOT inside AND regexp_matches(line, '^#+\\s+') GROUP BY 1)
SELECT page_id, CASE WHEN regexp_matches(line, '^#\\s+') THEN {STRIP.format("regexp_extract(line, '^#{1,6}\\s+(.+)$', 1)")} ELSE '' END AS title FROM heads
""")
def c02(spark, d):
    return C.first_title(C.lines(V.markdown_docs(spark, d), "page_id"), "page_id")


@add("C03_heading_sections", f"WITH {V.MARKDOWN_DOCS}, {LINES}, {SECTIONS} SELECT page_id, section, heading, text FROM sections WHERE text <> ''")
def c03(spark, d):
    return C.sections(C.lines(V.markdown_docs(spark, d), "page_id"), "page_id")


@add("C04_subsections", f"""
WITH {V.MARKDOWN_DOCS}, {LINES}, {SECTIONS.replace("'^(#{1,2})\\s+(.+)$', 2", "'^###\\s+(.+)$', 1").replace("'^(#{1,2})\\s+(.+)$'", "'^###\\s+(.+)$'")}
SELECT page_id, section, heading, text FROM sections WHERE text <> ''
""")
def c04(spark, d):
    return C.sections(C.lines(V.markdown_docs(spark, d), "page_id"), "page_id", C.SUBHEADING)


@add("C06_schematic_pages", f"""
WITH {V.MARKDOWN_DOCS}, parts AS (SELECT page_id, list_filter(list_transform(string_split_regex(content, '\\n\\s*---\\s*\\n'), lambda p: {STRIP.format('p')}), lambda p: p <> '') AS p FROM markdown_docs)
SELECT page_id, unnest(range(1, len(p) + 1))::INTEGER AS page, unnest(p) AS text FROM parts
""")
def c06(spark, d):
    return C.schematic_pages(V.markdown_docs(spark, d), "page_id")


PARTS = """parts AS (SELECT k, page, seq, min(text) AS text FROM (SELECT l_orderkey AS k, l_linenumber % 2 AS page, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS seq,
  CASE WHEN l_quantity < 20 THEN 'bit ' || l_partkey WHEN l_quantity < 25 THEN '## H ' || l_partkey ELSE repeat('long text ', 6) || l_suppkey END AS text FROM lineitem) GROUP BY 1, 2, 3)"""


@add("C08_small_merge", f"""
WITH {PARTS}, kept AS (SELECT *, length(text) >= 50 OR regexp_matches(text, '(?m)^(#{{1,2}})\\s+(.+)$') OR row_number() OVER (PARTITION BY k, page ORDER BY seq) = 1 AS starts FROM parts),
islands AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY k, page ORDER BY seq) AS island FROM kept)
SELECT k, page, min(seq) AS seq, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text FROM islands GROUP BY k, page, island
""")
def c08(spark, d):
    q = F.col("l_quantity")
    text = F.when(q < 20, F.concat(F.lit("bit "), F.col("l_partkey").cast("string"))).when(q < 25, F.concat(F.lit("## H "), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.repeat(F.lit("long text "), 6), F.col("l_suppkey").cast("string")))
    rows = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 2).alias("page"), (F.col("l_linenumber") * 1000000000000 + F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("seq"), text.alias("text"))
    return C.merge_small(rows.groupBy("k", "page", "seq").agg(F.min("text").alias("text")), "k")


@add("C09_rule_lines", f"WITH {V.MARKDOWN_DOCS} SELECT page_id, {STRIP.format('array_to_string(list_filter(string_split(content, chr(10)), lambda x: ' + STRIP.format('x') + " <> '---'), chr(10))")} AS text FROM markdown_docs")
def c09(spark, d):
    return V.markdown_docs(spark, d).select("page_id", X.without_rules(F.col("content")).alias("text"))


@add("C11_prose_windows", f"WITH {V.KB_DOCS}, {V.PROSE_CHUNKS} SELECT path AS target_file, chunk_id, content FROM prose_chunks WHERE content <> ''")
def c11(spark, d):
    return C.chunk_documents(kb(spark, d)).select("target_file", "chunk_id", "content")


def made_docs(spark, d, content, kind="note"):
    """One document for each part, with a content made from its number."""
    k = F.col("p_partkey").cast("string")
    return V.table(spark, d, "part").select(k.alias("target_file"), F.lit("d").alias("stem"), F.lit(kind).alias("document_type"), content(F.col("p_partkey"), k).alias("content"))


@add("C05_lead_merge", """
WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || 'short' ELSE chr(10) || repeat('long lead ', 9) || 'end' END AS lead FROM part), h AS (SELECT k, '## Part ' || k || lead AS head FROM p)
SELECT k::VARCHAR AS target_file, 'd__part-' || k || '__preamble' AS chunk_id, head AS content FROM h WHERE k % 3 = 2
UNION ALL SELECT k::VARCHAR, 'd__part-' || k || '__one', CASE WHEN k % 3 = 2 THEN '' ELSE head || chr(10) || chr(10) END || '### One' || chr(10) || 'alpha ' || k FROM h
UNION ALL SELECT k::VARCHAR, 'd__part-' || k || '__two', '### Two' || chr(10) || 'beta' FROM h
""")
def c05(spark, d):
    def content(k, name):
        lead = F.when(k % 3 == 0, "").when(k % 3 == 1, "\nshort").otherwise("\n" + "long lead " * 9 + "end")
        return F.concat(F.lit("## Part "), name, lead, F.lit("\n### One\nalpha "), name, F.lit("\n### Two\nbeta"))

    return C.chunk_documents(made_docs(spark, d, content)).select("target_file", "chunk_id", "content")


@add("C07_schematic_sections", """
WITH p AS (SELECT p_partkey::VARCHAR AS k, repeat('lead text ', 6) || p_partkey AS lead, 'end of the page ' || p_partkey AS tail FROM part)
SELECT k AS target_file, 'd__p001' AS chunk_id, 1 AS page, lead AS content FROM p
UNION ALL SELECT k, 'd__p001__power-' || k, 1, '## Power ' || k || chr(10) || 'rails' FROM p
UNION ALL SELECT k, 'd__p002__debug', 2, '## Debug' || chr(10) || '```' FROM p
UNION ALL SELECT k, 'd__p002__fenced-' || k, 2, '## Fenced ' || k || chr(10) || '```' || chr(10) || tail FROM p
""")
def c07(spark, d):
    """Pages of schematics part at second-level headings, inside fences too."""
    def content(k, name):
        return F.concat(F.lit("lead text " * 6), name, F.lit("\n## Power "), name, F.lit("\nrails\n\n---\n\n## Debug\n```\n## Fenced "), name, F.lit("\n```\nend of the page "), name)

    return C.chunk_documents(made_docs(spark, d, content, "schematic")).select("target_file", "chunk_id", "page", "content")


BLOCKS = """p AS (SELECT p_partkey::VARCHAR AS k, p_partkey % 2 = 0 AS small, repeat('a', (200 + p_partkey % 700)::INTEGER) AS a, '```' || chr(10) || repeat('c', (CASE WHEN p_partkey % 2 = 0 THEN 300 ELSE 1600 END)::INTEGER) || chr(10) || '```' AS f, repeat('b', (1000 + p_partkey % 400)::INTEGER) AS b FROM part)"""


def block_docs(spark, d):
    """Prose, a fenced block of 308 or 1608 characters, and more prose than fits beside them."""
    def content(k, _):
        fence = F.concat(F.lit("\n\n```\n"), F.repeat(F.lit("c"), F.when(k % 2 == 0, 300).otherwise(1600)), F.lit("\n```\n\n"))
        return F.concat(F.repeat(F.lit("a"), (200 + k % 700).cast("int")), fence, F.repeat(F.lit("b"), (1000 + k % 400).cast("int")))

    return made_docs(spark, d, content)


@add("C10_atomic_blocks", f"WITH {BLOCKS} SELECT k AS target_file, length(f)::INTEGER AS n FROM p")
def c10(spark, d):
    """Fenced blocks stay whole: the chunk that holds one has all of it."""
    made = C.chunk_documents(block_docs(spark, d)).filter(F.contains("content", F.lit("```")))
    return made.select("target_file", F.length(F.regexp_extract("content", r"(?s)```.*```", 0)).alias("n"))


@add("C12_block_packing", f"""
WITH {BLOCKS} SELECT k AS target_file, 'd__body' AS chunk_id, CASE WHEN small THEN a || chr(10) || chr(10) || f ELSE a END AS content FROM p
UNION ALL SELECT k, 'd__body__w01', CASE WHEN small THEN b ELSE f END FROM p UNION ALL SELECT k, 'd__body__w02', b FROM p WHERE NOT small
""")
def c12(spark, d):
    return C.chunk_documents(block_docs(spark, d)).select("target_file", "chunk_id", "content")


@add("C14_heading_path", f"""
WITH {V.KB_DOCS} SELECT doc_id, CASE WHEN project = build THEN project ELSE project || ' › ' || build END || ' › ' || document_type AS path FROM kb_docs
""")
def c14(spark, d):
    return V.kb_docs(spark, d).select("doc_id", X.heading_path(F.array(F.col("project"), F.lit(" "), F.concat("build", F.lit(" ")), F.lit(""), F.col("document_type"), F.col("document_type"))).alias("path"))


@add("C16_excerpts", f"""
WITH {V.KB_DOCS}, {V.PROSE_CHUNKS} SELECT chunk_id, CASE WHEN length(content) <= 200 THEN content ELSE regexp_replace(substr(content, 1, 200), '\\s+$', '') || '…' END AS excerpt FROM prose_chunks
""")
def c16(spark, d):
    return V.prose_chunks(spark, d).select("chunk_id", C.excerpts(F.col("content")).alias("excerpt"))


@add("C17_index_text", f"WITH {V.KB_DOCS}, {V.PROSE_CHUNKS} SELECT chunk_id, md5(CASE WHEN seq % 2 = 0 THEN project || ' › ' || build || chr(10) || chr(10) || content ELSE content END) AS digest FROM prose_chunks")
def c17(spark, d):
    path = F.when(F.col("seq") % 2 == 0, F.concat_ws(" › ", "project", "build")).otherwise("")
    return V.prose_chunks(spark, d).select("chunk_id", F.md5(X.index_text(path, F.col("content"))).alias("digest"))


@add("C18_corpus_chunks", f"WITH {V.KB_DOCS}, {V.PROSE_CHUNKS} SELECT path AS target_file, count(*)::BIGINT AS chunks, sum(length(content))::BIGINT AS chars FROM prose_chunks WHERE content <> '' GROUP BY 1")
def c18(spark, d):
    return C.chunk_documents(kb(spark, d)).groupBy("target_file").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))


@add("C13_section_driver", None)
def c13(spark, d):
    docs = V.markdown_docs(spark, d).select(F.col("page_id").cast("string").alias("target_file"), F.lit("p").alias("stem"), F.when(F.col("page_id") % 3 == 0, "schematic").otherwise("note").alias("document_type"), "content")
    return C.chunk_documents(docs)


@add("C19_section_expand", f"""
WITH {V.KB_DOCS}, {V.PROSE_CHUNKS}, hits AS (SELECT doc_id % 50 AS qid, chunk_id, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id * 7919 % 1009, chunk_id) AS rank FROM prose_chunks),
asked AS (SELECT qid, regexp_replace(chunk_id, '__w\\d+$', '') AS section, min(rank) AS first FROM hits GROUP BY 1, 2),
whole AS (SELECT regexp_replace(chunk_id, '__w\\d+$', '') AS section, string_agg(content, chr(10) || chr(10) ORDER BY chunk_id) FILTER (WHERE content <> '') AS content FROM prose_chunks GROUP BY 1)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY first)::INTEGER AS rank, section, md5(content) AS digest FROM asked JOIN whole USING (section)
""")
def c19(spark, d):
    from pyspark.sql import Window

    chunks = V.prose_chunks(spark, d)
    order = Window.partitionBy("qid").orderBy(F.col("doc_id") * 7919 % 1009, "chunk_id")
    hits = chunks.withColumn("qid", F.col("doc_id") % 50).withColumn("rank", F.row_number().over(order)).select("qid", "rank", "chunk_id")
    return C.expand_sections(hits, chunks).select("qid", "rank", "section", F.md5("content").alias("digest"))
