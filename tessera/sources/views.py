"""The provided tables read as a knowledge base, and the same in SQL.

The tables hold prose, pages, chats and orders; the model wants documents with a project, a build
and a type, chunks, questions, conversations and snapshots.  Each view has a SQL twin so that a
query over it can be checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ["datasheet", "schematic", "sop", "note", "report"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kb_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, project, build, document_type, path, content)."""
    i = F.col("doc_id")
    third = F.floor(i / 3) % 4
    project = F.when(i % 10 == 0, "global").otherwise(F.concat(F.lit("prj"), (i % 3).cast("string")))
    build = F.when(i % 10 == 0, "global").when(third == 0, "common").otherwise(F.concat(F.lit("b"), third.cast("string")))
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.floor(i / 10) % 5 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", project.alias("project"), build.alias("build"), kind.alias("document_type"), F.coalesce("text", F.lit("")).alias("content"))
    folder = F.when(F.col("project") == "global", F.concat_ws("/", F.lit("global"), "document_type")).otherwise(F.concat_ws("/", "project", "build", "document_type"))
    return docs.withColumn("path", F.concat(folder, F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md")))


KB_DOCS = """kb_docs AS (
  SELECT *, (CASE WHEN project = 'global' THEN 'global/' || document_type ELSE project || '/' || build || '/' || document_type END) || '/d' || doc_id || '.md' AS path
  FROM (SELECT doc_id,
    CASE WHEN doc_id % 10 = 0 THEN 'global' ELSE 'prj' || (doc_id % 3) END AS project,
    CASE WHEN doc_id % 10 = 0 THEN 'global' WHEN (doc_id // 3) % 4 = 0 THEN 'common' ELSE 'b' || ((doc_id // 3) % 4) END AS build,
    (['datasheet','schematic','sop','note','report'])[(doc_id // 10) % 5 + 1] AS document_type, coalesce(text, '') AS content FROM documents)
)"""


def hw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, text): pages like text read off schematics, made from parts."""
    k = F.col("p_partkey")
    n = k.cast("string")
    label = F.when(k % 3 == 0, "DISPLAY&SENSOR").when(k % 3 == 1, "POWER / INPUT").otherwise("MAIN BOARD MCU")
    lines = [
        label, F.concat(F.lit("LCD_D"), (k % 16).cast("string"), F.lit(" LCD__SCL T_CS I2C1_SDA")), F.concat(F.lit("NLLCD0D"), (k % 20).cast("string"), F.lit(" POWER_EN")),
        F.concat(F.lit("U"), (k % 900).cast("string"), F.lit(" R"), (k % 50).cast("string"), F.lit(" C7 VCC3V3 GND")), F.lit("REVISION"),
        F.when(k % 2 == 0, "AUDIO & CODEC").otherwise("ok"),
        F.concat(F.lit("TPS"), (k + 10000).cast("string"), F.lit(" "), (k % 9).cast("string"), F.lit(".3V 5 mV "), (k % 700).cast("string"), F.lit(" mA SOT-223 i2c usb MIN VDD_IO max")),
    ]
    return table(spark, sf_dir, "part").select(k.alias("page_id"), F.concat_ws("\n", *lines).alias("text"))


HW_PAGES = """hw_pages AS (
  SELECT p_partkey AS page_id, concat_ws(chr(10),
    CASE p_partkey % 3 WHEN 0 THEN 'DISPLAY&SENSOR' WHEN 1 THEN 'POWER / INPUT' ELSE 'MAIN BOARD MCU' END,
    'LCD_D' || (p_partkey % 16) || ' LCD__SCL T_CS I2C1_SDA', 'NLLCD0D' || (p_partkey % 20) || ' POWER_EN',
    'U' || (p_partkey % 900) || ' R' || (p_partkey % 50) || ' C7 VCC3V3 GND', 'REVISION', CASE WHEN p_partkey % 2 = 0 THEN 'AUDIO & CODEC' ELSE 'ok' END,
    'TPS' || (p_partkey + 10000) || ' ' || (p_partkey % 9) || '.3V 5 mV ' || (p_partkey % 700) || ' mA SOT-223 i2c usb MIN VDD_IO max') AS text FROM part
)"""


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, content): pages as Markdown with headings, items and paragraphs."""
    html = F.regexp_replace("html", r"(?s)<(style|script|head)[^>]*>.*?</(style|script|head)>", "")
    html = F.regexp_replace(html, r"<h1[^>]*>", "\n# ")
    html = F.regexp_replace(html, r"<b>", "\n## ")
    html = F.regexp_replace(html, r"<li[^>]*>", "\n- ")
    html = F.regexp_replace(html, r"</(p|h1|b)>", "\n\n")
    html = F.regexp_replace(html, r"<[^>]*>", "")
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(html, F.lit("")).alias("content"))


PAGE_MARKDOWN = r"""page_markdown AS (
  SELECT page_id, coalesce(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(html, '(?s)<(style|script|head)[^>]*>.*?</(style|script|head)>', '', 'g'), '<h1[^>]*>', chr(10) || '# ', 'g'), '<b>', chr(10) || '## ', 'g'),
    '<li[^>]*>', chr(10) || '- ', 'g'), '</(p|h1|b)>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g'), '') AS content FROM pages
)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, content)."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))


TURNS = "turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS content FROM conversations)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, query): the benchmark passages as questions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


QUESTIONS = "questions AS (SELECT item_id AS qid, text AS query FROM benchmark)"


def prose_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, project, build, document_type, seq, chunk_id, content): documents in plain windows
    (their texts have no blank lines, so windows fall at fixed places)."""
    docs = kb_docs(spark, sf_dir).withColumn("content", F.regexp_replace("content", r"^\s+|\s+$", ""))
    n = F.length("content")
    count = F.when(n <= 1500, 1).otherwise(F.ceil((n - 100) / 1400)).cast("int")
    cut = docs.filter("content <> ''").withColumn("seq", F.explode(F.sequence(F.lit(0), count - 1)))
    suffix = F.when(F.col("seq") == 0, "").otherwise(F.concat(F.lit("__w"), F.when(F.col("seq") < 10, F.concat(F.lit("0"), F.col("seq").cast("string"))).otherwise(F.col("seq").cast("string"))))
    piece = F.regexp_replace(F.substring("content", F.col("seq") * 1400 + 1, F.lit(1500)), r"^\s+|\s+$", "")
    return cut.select("doc_id", "project", "build", "document_type", "path", "seq", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("__body"), suffix).alias("chunk_id"), piece.alias("content"))


PROSE_CHUNKS = r"""prose_chunks AS (
  SELECT doc_id, project, build, document_type, path, seq::INTEGER AS seq,
    'd' || doc_id || '__body' || CASE WHEN seq = 0 THEN '' ELSE '__w' || CASE WHEN seq < 10 THEN '0' ELSE '' END || seq END AS chunk_id,
    regexp_replace(substr(content, seq * 1400 + 1, 1500), '^\s+|\s+$', '', 'g') AS content
  FROM (SELECT *, unnest(range(CASE WHEN length(content) <= 1500 THEN 1 ELSE ceil((length(content) - 100) / 1400)::BIGINT END)) AS seq
    FROM (SELECT doc_id, project, build, document_type, path, regexp_replace(content, '^\s+|\s+$', '', 'g') AS content FROM kb_docs) WHERE content <> '')
)"""


#: Appended to pages so that fences, rules and third-level headings occur.
TAIL = "\n```sh\n# not a heading\n```\n## Notes\nshort\n\n---\n\n### Sub part\nmore text here\n### Next\nend"


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, content): pages as Markdown, every other one with the tail."""
    pages = page_markdown(spark, sf_dir)
    return pages.select("page_id", F.concat("content", F.when(F.col("page_id") % 2 == 0, TAIL).otherwise("")).alias("content"))


MARKDOWN_DOCS = PAGE_MARKDOWN + ", markdown_docs AS (SELECT page_id, content || CASE WHEN page_id % 2 = 0 THEN '" + TAIL.replace("\n", "' || chr(10) || '") + "' ELSE '' END AS content FROM page_markdown)"
