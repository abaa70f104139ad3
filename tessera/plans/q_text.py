"""Text functions over documents, part-derived schematic pages, web pages and chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import hooks
from tessera.plans.base import Plans
from tessera.sources import views as V

PLANS = Plans()
queries, oracle_sql = PLANS.queries, PLANS.oracle_sql
add = PLANS.add


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_any(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, '" + w.replace("'", "''") + "')" for w in words) + ")"


#: Patterns of RE2 take the case flag as an option.
def sql_all(text: str, pattern: str, group: int = 0) -> str:
    flag = ", 'i'" if pattern.startswith("(?i)") else ""
    return f"regexp_extract_all({text}, '{pattern.removeprefix('(?i)')}', {group}{flag})"


@add("T01_keywords", f"""
WITH {V.HW_PAGES}, found AS (
  SELECT page_id, unnest({sql_all('text', X.PART, 1)}) AS k, 'part' AS kind FROM hw_pages
  UNION ALL SELECT page_id, regexp_replace(upper(v), '\\s+', '', 'g'), 'v' FROM (SELECT page_id, unnest({sql_all('text', X.VOLTAGE)}) AS v FROM hw_pages)
  UNION ALL SELECT page_id, replace(regexp_replace(v, '\\s+', '', 'g'), 'µ', 'u'), 'a' FROM (SELECT page_id, unnest({sql_all('text', X.CURRENT)}) AS v FROM hw_pages)
  UNION ALL SELECT page_id, upper(unnest({sql_all('text', X.PROTOCOL, 1)})), 'p' FROM hw_pages
  UNION ALL SELECT page_id, upper(unnest({sql_all('text', X.PACKAGE, 1)})), 'k' FROM hw_pages
), kept AS (
  SELECT DISTINCT page_id, k FROM found WHERE (kind <> 'part' OR length(k) >= 4) AND NOT list_contains({sql_list(X.NOISE_WORDS)}, k)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(k) DESC, k) AS n FROM kept)
SELECT page_id, string_agg(k, ' ' ORDER BY n) AS keywords, count(*)::INTEGER AS n_keywords FROM ranked WHERE n <= 50 GROUP BY page_id
""")
def t01(spark, d):
    kw = X.keywords(F.col("text"))
    return V.hw_pages(spark, d).select("page_id", kw.alias("k")).select("page_id", F.array_join("k", " ").alias("keywords"), F.size("k").alias("n_keywords"))


@add("T02_ocr_underscores", f"WITH {V.HW_PAGES} SELECT page_id, regexp_replace(text, '\\b([A-Z][A-Z0-9]{{1,15}})__', '\\1_', 'g') AS text FROM hw_pages")
def t02(spark, d):
    return V.hw_pages(spark, d).select("page_id", X.single_underscores(F.col("text")).alias("text"))


@add("T03_recovered_nets", f"""
WITH {V.HW_PAGES}, clean AS (SELECT page_id, regexp_replace(text, '\\b([A-Z][A-Z0-9]{{1,15}})__', '\\1_', 'g') AS text FROM hw_pages),
known AS (
  SELECT DISTINCT page_id, upper(unnest({sql_all('text', X.CLEAN_PREFIX, 1)})) AS p FROM clean
  UNION SELECT page_id, upper(split_part(n, '_', 1)) FROM (SELECT page_id, unnest({sql_all('text', X.NAMED_NET, 1)}) AS n FROM clean)
), noisy AS (
  SELECT page_id, upper(regexp_extract(m, '{X.DATA_NET.removeprefix("(?i)")}', 1, 'i')) AS raw, regexp_extract(m, '{X.DATA_NET.removeprefix("(?i)")}', 2, 'i')::INTEGER AS i
  FROM (SELECT page_id, unnest({sql_all('text', X.DATA_NET)}) AS m FROM clean)
), named AS (
  SELECT DISTINCT page_id, coalesce((SELECT arg_min(p, length(p)) FROM known WHERE known.page_id = noisy.page_id AND length(p) >= 2 AND suffix(raw, p)), raw) || '_D' || i AS net FROM noisy WHERE i <= 15
)
SELECT page_id, string_agg(net, ' ' ORDER BY net) AS nets FROM named GROUP BY page_id
""")
def t03(spark, d):
    found = F.array_sort(X.recovered_nets(F.col("text")))
    return V.hw_pages(spark, d).select("page_id", found.alias("n")).filter(F.size("n") > 0).select("page_id", F.array_join("n", " ").alias("nets"))


@add("T04_nets", None)
def t04(spark, d):
    return V.hw_pages(spark, d).select("page_id", F.array_join(X.nets(F.col("text")), " ").alias("nets"))


@add("T05_components", f"""
WITH {V.HW_PAGES} SELECT page_id, array_to_string(list_distinct({sql_all('text', X.COMPONENT, 1)}).list_sort(), ' ') AS components,
  array_to_string(list_filter(list_distinct({sql_all('text', X.COMPONENT, 1)}), lambda c: starts_with(c, 'U')).list_sort(), ' ') AS major FROM hw_pages
""")
def t05(spark, d):
    text = F.col("text")
    return V.hw_pages(spark, d).select("page_id", F.array_join(F.array_sort(X.components(text)), " ").alias("components"), F.array_join(F.array_sort(X.major_components(text)), " ").alias("major"))


@add("T06_module_labels", f"""
WITH {V.HW_PAGES}, lines AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line FROM hw_pages)
SELECT page_id, line AS label FROM lines WHERE length(line) <= 48 AND regexp_full_match(line, '[A-Z][A-Z0-9 &/+-]{{2,48}}')
  AND NOT list_contains({sql_list(X.NO_MODULES)}, line) AND (contains(line, '&') OR contains(line, '/') OR (contains(line, ' ') AND length(line) >= 8))
""")
def t06(spark, d):
    return V.hw_pages(spark, d).select("page_id", F.explode(X.module_labels(F.col("text"))).alias("label"))


@add("T07_interfaces", None)
def t07(spark, d):
    return V.hw_pages(spark, d).select("page_id", F.array_join(X.interfaces(F.col("text")), "|").alias("interfaces"))


@add("T08_nets_by_prefix", f"""
WITH {V.HW_PAGES}, nets AS (SELECT DISTINCT page_id, unnest({sql_all('text', X.NAMED_NET, 1)}) AS net FROM hw_pages)
SELECT page_id, upper(split_part(net, '_', 1)) AS prefix, string_agg(net, ' ' ORDER BY upper(net)) AS nets, count(*)::BIGINT AS n FROM nets GROUP BY 1, 2
""")
def t08(spark, d):
    named = F.array_distinct(F.regexp_extract_all("text", F.lit(X.NAMED_NET), F.lit(1)))
    rows = V.hw_pages(spark, d).select("page_id", F.explode(named).alias("net")).withColumn("prefix", F.upper(F.substring_index("net", "_", 1)))
    return rows.groupBy("page_id", "prefix").agg(F.array_join(X.by_upper(F.collect_list("net")), " ").alias("nets"), F.count("*").alias("n"))


@add("T09_module_nets", None)
def t09(spark, d):
    text = F.col("text")
    rows = V.hw_pages(spark, d).select("page_id", "text", X.nets(text).alias("nets"), X.module_labels(text).alias("labels"))
    zones = rows.select("page_id", F.explode(X.module_zones(F.col("labels"), F.col("nets"), text)).alias("z"))
    return zones.select("page_id", F.col("z.label").alias("label"), F.array_join("z.nets", " ").alias("nets"))


@add("T13_token_estimate", f"""
WITH {V.KB_DOCS} SELECT doc_id, (CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, trunc(c / 1.2::DOUBLE + (length(content) - c) / 4::DOUBLE)) END)::INTEGER AS tokens
FROM (SELECT *, length(regexp_replace(content, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) AS c FROM kb_docs)
""")
def t13(spark, d):
    return V.kb_docs(spark, d).select("doc_id", X.token_estimate(F.col("content")).alias("tokens"))


REWRITE = f"((length(content) < 60 AND {sql_any('lower(content)', X.FOLLOW_UPS)}) OR length(content) < 20)"


@add("T14_needs_rewrite", f"WITH {V.TURNS} SELECT conv_id, turn, (turn > 0 AND {REWRITE}) AS rewrite FROM turns WHERE role = 'user'")
def t14(spark, d):
    return V.turns(spark, d).filter("role = 'user'").select("conv_id", "turn", X.needs_rewrite(F.col("content"), F.col("turn") > 0).alias("rewrite"))


@add("T15_needs_history", f"WITH {V.TURNS} SELECT conv_id, turn, (turn > 0 AND (conv_id % 5 = 0 OR turn % 3 = 0 OR {REWRITE})) AS history FROM turns WHERE role = 'user'")
def t15(spark, d):
    task = F.when(F.col("conv_id") % 5 == 0, "translate")
    query = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("about "), "content")).otherwise(F.col("content"))
    need = X.needs_history(F.col("content"), F.col("turn") > 0, F.col("turn") > 0, task, query)
    return V.turns(spark, d).filter("role = 'user'").select("conv_id", "turn", need.alias("history"))


@add("T17_task_label", """
WITH raw AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '"Debug."' WHEN 1 THEN 'task: design_review' || chr(10) || 'wiki' WHEN 2 THEN 'none' ELSE ' FA!' END AS reply FROM conversations)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'debug' WHEN 1 THEN 'design_review' WHEN 3 THEN 'fa' END AS task FROM raw
""")
def t17(spark, d):
    r = F.col("turn") % 4
    reply = F.when(r == 0, '"Debug."').when(r == 1, "task: design_review\nwiki").when(r == 2, "none").otherwise(" FA!")
    return V.table(spark, d, "conversations").select("conv_id", "turn", X.task_label(reply).alias("task"))


@add("T18_prepare_output", f"""
WITH {V.TURNS} SELECT conv_id, turn, CASE WHEN q = '' THEN content ELSE q END AS query, 'wiki' AS task, CASE WHEN conv_id % 2 = 0 THEN NULL ELSE 'prj1' END AS product
FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(split_part(regexp_replace(content, '^\\s+', ''), chr(10), 1), '^\\s+|\\s+$', '', 'g'), '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g') AS q FROM turns)
""")
def t18(spark, d):
    reply = F.concat(F.lit("QUERY: "), "content", F.lit("\ntask: Wiki\nPRODUCT: "), F.when(F.col("conv_id") % 2 == 0, "none").otherwise("prj1"))
    rows = V.turns(spark, d).withColumn("reply", reply)
    raw = F.col("reply")
    return rows.select("conv_id", "turn", X.retrieval_query(raw, F.col("content")).alias("query"), X.task_label(X.labelled_line(raw, "TASK")).alias("task"), X.optional_field(X.labelled_line(raw, "PRODUCT")).alias("product"))


IMAGE_TEXT = "concat('![fig ', page_id::VARCHAR, '](images/p', page_id::VARCHAR, '.png) and ![x](#top) ', '![y](\"https://e.org/', (page_id % 7)::VARCHAR, '.png\")')"


@add("T19_image_refs", f"""
SELECT page_id, 'images/p' || page_id || '.png|https://e.org/' || (page_id % 7) || '.png' AS refs FROM (SELECT page_id, {IMAGE_TEXT} FROM pages)
""")
def t19(spark, d):
    i = F.col("page_id").cast("string")
    text = F.concat(F.lit("![fig "), i, F.lit("](images/p"), i, F.lit('.png) and ![x](#top) ![y]("https://e.org/'), (F.col("page_id") % 7).cast("string"), F.lit('.png")'))
    return V.table(spark, d, "pages").select("page_id", F.array_join(X.image_refs(text), "|").alias("refs"))


@add("T20_section_fragment", f"""
WITH {V.KB_DOCS}, {V.PROSE_CHUNKS} SELECT doc_id, seq, CASE WHEN regexp_replace(regexp_extract(chunk_id, '^[^_]*__(.*)$', 1), '__w\\d+$', '') = '' THEN '' ELSE '#' || regexp_replace(regexp_extract(chunk_id, '^[^_]*__(.*)$', 1), '__w\\d+$', '') END AS fragment FROM prose_chunks
""")
def t20(spark, d):
    return V.prose_chunks(spark, d).select("doc_id", "seq", X.section_fragment(F.col("chunk_id")).alias("fragment"))


@add("T21_source_urls", f"WITH {V.KB_DOCS} SELECT doc_id, 'http://localhost:8000/v1/sources/' || replace(replace(path, 'prj', 'p%20rj'), '.md', '%2B.md') || '#body' AS url FROM kb_docs")
def t21(spark, d):
    path = F.replace(F.replace("path", F.lit("prj"), F.lit("p rj")), F.lit(".md"), F.lit("+.md"))
    return V.kb_docs(spark, d).select("doc_id", X.source_url("http://localhost:8000", path, F.lit("d__body__w01")).alias("url"))


@add("T22_asset_paths", f"""
WITH {V.KB_DOCS} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN project || '/images/a.png' WHEN 1 THEN NULL ELSE project || '/' || build || '/images/b.png' END AS asset FROM kb_docs
""")
def t22(spark, d):
    ref = F.when(F.col("doc_id") % 3 == 0, "../images/a.png").when(F.col("doc_id") % 3 == 1, "../../../x.png").otherwise("./images/b.png")
    return V.kb_docs(spark, d).select("doc_id", X.asset_path(F.concat_ws("/", "project", "build"), ref).alias("asset"))


@add("T23_elapsed", """
SELECT event_id, CASE WHEN s < 60 THEN printf('%.1f', s) || ' 秒' ELSE (floor(s / 60)::BIGINT)::VARCHAR || ' 分 ' || printf('%.1f', s - floor(s / 60) * 60) || ' 秒' END AS elapsed
FROM (SELECT event_id, (event_id % 1500) / 8.0::DOUBLE + 0.03 AS s FROM events)
""")
def t23(spark, d):
    s = (F.col("event_id") % 1500) / F.lit(8.0) + F.lit(0.03)
    return V.table(spark, d, "events").select("event_id", X.elapsed(s).alias("elapsed"))


@add("T24_stream_pieces", f"""
WITH {V.TURNS} SELECT conv_id, turn, i::INTEGER AS piece, substr(content, i * 200 + 1, 200) AS text FROM (SELECT *, unnest(range(ceil(length(content) / 200)::BIGINT)) AS i FROM turns)
""")
def t24(spark, d):
    return V.turns(spark, d).select("conv_id", "turn", F.posexplode(X.pieces(F.col("content"))).alias("piece", "text"))


@add("T25_auxiliary", """
SELECT conv_id, turn, conv_id % 3 = 0 AND turn % 2 = 0 AS auxiliary FROM conversations
""")
def t25(spark, d):
    head = F.when(F.col("conv_id") % 3 == 0, " ### Task:\nGenerate 1-3 broad TAGS\n").otherwise("Task:\n")
    body = F.when(F.col("turn") % 2 == 0, "<chat_history>x</chat_history>").otherwise("nothing")
    return V.table(spark, d, "conversations").select("conv_id", "turn", X.is_auxiliary(F.concat(head, body)).alias("auxiliary"))


@add("T26_path_match", f"""
WITH {V.KB_DOCS} SELECT doc_id, doc_id % 4 <> 2 AS same FROM kb_docs
""")
def t26(spark, d):
    r = F.col("doc_id") % 4
    tail = F.regexp_replace("path", r"\.md$", "")
    given = F.when(r == 0, F.concat(F.lit("/abs/data/raw/"), "path")).when(r == 1, F.concat(F.lit("data\\processed\\x\\"), F.concat_ws("\\", "document_type", F.element_at(F.split(tail, "/"), -1)), F.lit(".pdf")))
    given = given.when(r == 2, F.lit("data/raw/other/none.md")).otherwise(F.concat(F.lit("data/processed/"), "path"))
    return V.kb_docs(spark, d).select("doc_id", X.path_matches(F.concat(F.lit("data/raw/"), "path"), given).alias("same"))


@add("T27_fact_match", """
WITH facts AS (SELECT item_id, regexp_replace(lower(text), '\\s+', '', 'g') AS fact FROM benchmark), n AS (SELECT count(*) AS n FROM benchmark)
SELECT doc_id, item_id, contains(regexp_replace(lower(text), '\\s+', '', 'g'), fact) AS found FROM documents, n JOIN facts ON item_id = doc_id % n WHERE text IS NOT NULL
""")
def t27(spark, d):
    """Every document against one fact of the benchmark."""
    facts = V.table(spark, d, "benchmark").select("item_id", F.col("text").alias("fact"))
    docs = V.table(spark, d, "documents").filter("text is not null").select("doc_id", "text", (F.col("doc_id") % facts.count()).alias("item_id"))
    return docs.join(facts, "item_id").select("doc_id", "item_id", X.fact_in(F.col("fact"), F.col("text")).alias("found"))


@add("T28_preview", f"""
WITH {V.TURNS} SELECT conv_id, turn, CASE WHEN length(c) <= 240 THEN c ELSE substr(c, 1, 237) || '...' END AS preview
FROM (SELECT *, regexp_replace(regexp_replace(content, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS c FROM turns)
""")
def t28(spark, d):
    return V.turns(spark, d).select("conv_id", "turn", X.preview(F.col("content")).alias("preview"))


@add("T29_refusal", """
SELECT conv_id, turn, (turn % 3 = 0 OR conv_id % 4 = 1) AS refusal FROM conversations
""")
def t29(spark, d):
    answer = F.when(F.col("turn") % 3 == 0, "Sorry, Insufficient CONTEXT here").otherwise("Use pin 4 [1]")
    return V.table(spark, d, "conversations").select("conv_id", "turn", X.is_refusal(answer, F.col("conv_id") % 4 == 1).alias("refusal"))


@add("T31_ordered_distinct", """
SELECT p_partkey, (p_brand || '|' || p_type || CASE WHEN p_size::VARCHAR <> '' THEN '|' || p_size ELSE '' END) AS merged FROM part
""")
def t31(spark, d):
    values = F.array(F.concat(F.lit(" "), "p_brand"), F.lit("  "), "p_type", "p_brand", F.col("p_size").cast("string"), F.concat("p_type", F.lit("\n")))
    return V.table(spark, d, "part").select("p_partkey", F.array_join(X.ordered_distinct(values), "|").alias("merged"))


@add("T32_heading_level", f"""
WITH {V.PAGE_MARKDOWN} SELECT page_id, length(regexp_extract(head, '^(#+)\\s+', 1))::INTEGER AS level, trim(regexp_extract(head, '^#{{1,2}}\\s+(.+)$', 1)) AS heading
FROM (SELECT page_id, regexp_extract(content, '(?s)^\\s*([^\\n]*[^\\s])', 1) AS head FROM (SELECT page_id, regexp_extract(ltrim(content, E' \\n\\t\\r'), '^[^\\n]*', 0) AS content FROM page_markdown))
""")
def t32(spark, d):
    return V.page_markdown(spark, d).select("page_id", X.heading_level(F.col("content")).alias("level"), X.section_heading(F.col("content")).alias("heading"))


@add("T33_phase_timing", """
SELECT event_id, round(event_id % 50 / 10.0, 1)::DOUBLE AS retrieval, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE round(event_id % 90 / 10.0, 1)::DOUBLE END AS generation FROM events
""")
def t33(spark, d):
    first = F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 50 / 10 + F.col("event_id") % 90 / 10)
    retrieval = F.col("event_id") % 50 / 10
    return V.table(spark, d, "events").select("event_id", F.round(retrieval, 1).alias("retrieval"), F.round(F.coalesce(first - retrieval, F.lit(0.0)), 1).alias("generation"))


@add("K02_filename_slug", """
SELECT p_partkey, regexp_replace(regexp_replace(replace(lower(p_name || '  (v1.0)/' || p_brand), ' ', '_'), '[^\\p{L}\\p{N}_\\-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part
""")
def k02(spark, d):
    return V.table(spark, d, "part").select("p_partkey", X.filename_slug(F.concat("p_name", F.lit("  (v1.0)/"), "p_brand")).alias("slug"))


@add("C15_heading_slug", """
SELECT doc_id, regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\\p{L}\\p{N}_\\-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents WHERE text IS NOT NULL
""")
def c15(spark, d):
    return V.table(spark, d, "documents").filter("text is not null").select("doc_id", X.slug(F.split_part("text", F.lit("\n"), F.lit(1))).alias("slug"))


@add("S05_markdown_parse", """
SELECT doc_id, sha256(regexp_replace(replace(text, chr(10), chr(13) || chr(10)), '\\r\\n?', chr(10), 'g').rtrim(E' \\n\\t\\r\\v\\f') || chr(10)) AS digest FROM documents WHERE text IS NOT NULL
""")
def s05(spark, d):
    raw = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    return V.table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2(X.plain_markdown(raw), 256).alias("digest"))


@add("S10_page_text", f"""
WITH {V.PAGE_MARKDOWN} SELECT page_id, regexp_replace(regexp_replace(regexp_replace(content, '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM page_markdown
""")
def s10(spark, d):
    return V.page_markdown(spark, d).select("page_id", X.page_text(F.col("content")).alias("text"))


@add("S11_ocr_language", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'eng+chi_sim' ELSE 'eng' END AS language FROM documents WHERE text IS NOT NULL
""")
def s11(spark, d):
    added = F.repeat(F.lit("电源接口电路设计说明书面"), (F.length("text") / 100 + 1).cast("int"))
    mixed = F.when(F.col("doc_id") % 4 == 0, F.concat("text", added)).otherwise(F.col("text"))
    return V.table(spark, d, "documents").filter("text is not null").select("doc_id", X.ocr_language(mixed).alias("language"))


@add("S16_page_class", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 50 THEN 'TABLE' WHEN l_discount * 10 >= 0.6 AND l_partkey % 800 < 200 THEN 'GRAPH' WHEN l_partkey % 800 >= 500 AND l_quantity < 20 THEN 'TEXT' ELSE 'MIXED' END AS kind FROM lineitem
""")
def s16(spark, d):
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.page_kind(F.col("l_partkey") % 800, F.col("l_quantity"), F.col("l_discount") * 10).alias("kind"))


@add("S28_script_language", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'eng' ELSE 'eng+chi_sim' END AS language FROM nation")
def s28(spark, d):
    script = F.when(F.col("n_nationkey") % 3 == 0, "Latin").when(F.col("n_nationkey") % 3 == 1, "Han")
    return V.table(spark, d, "nation").select("n_nationkey", X.script_language(script).alias("language"))


@add("X01_tokens", "SELECT t AS token, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_&]+')) AS t FROM documents) GROUP BY 1")
def x01(spark, d):
    return V.table(spark, d, "documents").select(F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@add("R08_query_excerpt", None)
def r08(spark, d):
    words = X.boost_tokens(F.lit("the pin interface andthe erth"))
    return V.kb_docs(spark, d).select("doc_id", hooks.focused_excerpt(F.col("content"), words).alias("excerpt"))


BOOST = "list_filter(list_distinct(list_transform(regexp_extract_all(query, '[\\p{L}\\p{N}_&]+'), lambda t: lower(t))), lambda t: length(t) >= 2 AND NOT list_contains(" + sql_list(X.STOP_TOKENS) + ", t))"


@add("R09_boost_tokens", f"WITH {V.QUESTIONS} SELECT qid, len(t)::INTEGER AS n, array_to_string(list_sort(t), ' ') AS tokens FROM (SELECT qid, {BOOST} AS t FROM questions)")
def r09(spark, d):
    t = X.boost_tokens(F.col("query"))
    return V.questions(spark, d).select("qid", t.alias("t")).select("qid", F.size("t").alias("n"), F.array_join(F.array_sort(F.transform("t", F.lower)), " ").alias("tokens"))


@add("F14_pin_intent", f"""
WITH {V.HW_PAGES} SELECT page_id, page_id % 3 <> 1 AS pin_query FROM hw_pages
""")
def f14(spark, d):
    q = F.when(F.col("page_id") % 3 == 0, "LCD的引脚有哪些").when(F.col("page_id") % 3 == 1, "What drives the LCD").otherwise("spin of the RMII block pins")
    return V.hw_pages(spark, d).select("page_id", X.is_pin_query(q).alias("pin_query"))
