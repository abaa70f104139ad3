"""Conversations, prompts, citations, routes and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import answer as A
from tessera.operators import conversation as C
from tessera.operators import evaluate as E
from tessera.operators import hooks
from tessera.plans.base import Plans
from tessera.plans.q_text import sql_any
from tessera.sources import views as V

PLANS = Plans()
queries, oracle_sql, add = PLANS.queries, PLANS.oracle_sql, PLANS.add

S = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
LAST = f"last AS (SELECT conv_id, max(turn) AS turn, {S.format('arg_max(content, turn)')} AS question FROM turns WHERE role = 'user' AND {S.format('content')} <> '' GROUP BY 1)"
HISTORY = f"history AS (SELECT turns.conv_id, turns.turn, role, {S.format('content')} AS content FROM turns JOIN last ON turns.conv_id = last.conv_id AND turns.turn < last.turn WHERE role IN ('user', 'assistant') AND {S.format('content')} <> '')"
RECENT = "recent AS (SELECT *, CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END AS label FROM history QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {n})"


@add("G01_last_question", f"WITH {V.TURNS}, {LAST} SELECT conv_id, turn, question FROM last")
def g01(spark, d):
    return C.last_question(V.turns(spark, d))


@add("G02_history", f"WITH {V.TURNS}, {LAST}, {HISTORY} SELECT conv_id, turn, role, content FROM history")
def g02(spark, d):
    return C.history(V.turns(spark, d))


@add("T16_rewrite_history", f"""
WITH {V.TURNS}, {LAST}, {HISTORY}, {RECENT.format(n=4)} SELECT conv_id, string_agg('[' || label || ']: ' || CASE WHEN role = 'assistant' AND length(content) > 300 THEN substr(content, 1, 300) || '...' ELSE content END, chr(10) ORDER BY turn) AS history FROM recent GROUP BY 1
""")
def t16(spark, d):
    return C.rewrite_history(C.history(V.turns(spark, d)))


@add("G03_history_block", f"""
WITH {V.TURNS}, {LAST}, {HISTORY}, {RECENT.format(n=6)}, made AS (SELECT conv_id, string_agg('[' || label || ']:' || chr(10) || CASE WHEN length(content) > 400 THEN substr(content, 1, 400) || '…(truncated)' ELSE content END, chr(10) || chr(10) ORDER BY turn) AS history FROM recent GROUP BY 1)
SELECT conv_id, coalesce(history, '(none)') AS history FROM (SELECT DISTINCT conv_id FROM turns) LEFT JOIN made USING (conv_id)
""")
def g03(spark, d):
    turns = V.turns(spark, d)
    return C.answer_history(C.history(turns), turns, cut=400)


#: Three documents in a row are the hits of one question, so that every document is one.
HITS = f"""hits AS (SELECT doc_id // 3 AS qid, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id)::INTEGER AS rank, doc_id, project, build, 'data/raw/' || path AS source_file, (doc_id % 3)::INTEGER AS page, 'd' || doc_id || '__body' AS chunk_id,
  CASE WHEN doc_id % 2 = 0 THEN 'H › ' || doc_id ELSE '' END AS heading_path, content FROM kb_docs)"""


def hits(spark, d):
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("qid").orderBy("doc_id"))
    i = F.col("doc_id").cast("string")
    rows = V.kb_docs(spark, d).withColumn("qid", F.floor(F.col("doc_id") / 3)).withColumn("rank", order)
    return rows.select("qid", "rank", "doc_id", "project", "build", F.concat(F.lit("data/raw/"), "path").alias("source_file"), (F.col("doc_id") % 3).cast("int").alias("page"), F.concat(F.lit("d"), i, F.lit("__body")).alias("chunk_id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("H › "), i)).otherwise("").alias("heading_path"), "content", F.lit("").alias("target_file"))


LABEL = "CASE WHEN project = 'global' THEN 'global' WHEN build = 'common' THEN 'project_common' ELSE 'build' END"


@add("G04_context_blocks", f"""
WITH {V.KB_DOCS}, {HITS} SELECT qid, md5(string_agg('[' || rank || '] scope=' || {LABEL} || ' project=' || project || ' build=' || build || ' source=' || source_file || ' page=' || page || ' chunk_id=' || chunk_id || CASE WHEN heading_path <> '' THEN ' section=' || heading_path ELSE '' END || chr(10) || {S.format('content')}, chr(10) || chr(10) ORDER BY rank)) AS digest FROM hits GROUP BY 1
""")
def g04(spark, d):
    return A.context_blocks(hits(spark, d)).select("qid", F.md5("context").alias("digest"))


@add("G05_citations", f"""
WITH {V.KB_DOCS}, {HITS} SELECT qid, count(*)::INTEGER AS n, string_agg('http://localhost:8000/v1/sources/' || replace(source_file, 'data/raw/', '') || '#body', ' ' ORDER BY rank) AS urls,
  string_agg(CASE WHEN page > 0 THEN 'http://localhost:8000/v1/assets/' || regexp_replace(replace(source_file, 'data/raw/', ''), '[^/]*$', '') || 'images/d' || doc_id || '/d' || doc_id || '_p' || page || '_page.png' ELSE '-' END, ' ' ORDER BY rank) AS images FROM hits GROUP BY 1
""")
def g05(spark, d):
    c = A.citations(hits(spark, d))
    return c.select("qid", F.size("citations").alias("n"), F.array_join(F.transform("citations", lambda x: x["url"]), " ").alias("urls"), F.array_join(F.transform("citations", lambda x: F.coalesce(F.get(x["images"], 0), F.lit("-"))), " ").alias("images"))


@add("G06_source_chips", f"WITH {V.KB_DOCS}, {HITS} SELECT qid, rank, '[' || rank || '] d' || doc_id || '.md' AS name FROM hits")
def g06(spark, d):
    return hits(spark, d).select("qid", "rank", A.source_name(F.col("rank"), F.col("source_file"), F.col("chunk_id")).alias("name"))


@add("G07_image_block", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN '' ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**相关截图 / Referenced Diagrams**' || chr(10) || chr(10) ||
  '![\\[1\\] a.png](https://e/a.png?x=1)' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '![\\[2\\] p' || p_partkey || '.png](https://e/p' || p_partkey || '.png)' || chr(10) ELSE '' END END AS block FROM part
""")
def g07(spark, d):
    i = F.col("p_partkey").cast("string")
    images = F.array(F.array(F.lit("https://e/a.png?x=1")), F.array(F.lit("https://e/a.png?x=1"), F.concat(F.lit("https://e/p"), i, F.lit(".png"))))
    said = F.when(F.col("p_partkey") % 3 == 0, "see [2] and [1], [9]").when(F.col("p_partkey") % 3 == 1, "only [1][1]").otherwise("nothing")
    return V.table(spark, d, "part").select("p_partkey", A.image_block(said, images).alias("block"))


@add("G08_prompt", f"WITH {V.TURNS}, {LAST} SELECT conv_id, 'R: rules' || chr(10) || 'C: ctx ' || question || chr(10) || 'Q: ' || question AS prompt FROM last")
def g08(spark, d):
    template = F.lit("R: {{scope_rules}}\nC: {{context}}\nQ: {{question}}\n")
    return C.last_question(V.turns(spark, d)).select("conv_id", A.rendered(template, scope_rules=F.lit("rules"), context=F.lit("ctx {{question}}"), question=F.col("question")).alias("prompt"))


@add("G09_rewrite_guard", f"WITH {V.TURNS} SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR 4 * length(content) + 30 <= 5 * length(content) AND turn % 3 = 1 THEN CASE turn % 3 WHEN 0 THEN content ELSE repeat('x', 4 * length(content) + 30) END ELSE content END AS query FROM turns WHERE content <> '' AND content = trim(content)")
def g09(spark, d):
    r = F.col("turn") % 3
    reply = F.when(r == 0, "  ").when(r == 1, F.repeat(F.lit("x"), 4 * F.length("content") + 30)).otherwise(F.repeat(F.col("content"), F.lit(9)))
    return V.turns(spark, d).filter("content <> '' and content = trim(content)").select("conv_id", "turn", hooks.rewritten(F.col("content"), reply).alias("query"))


@add("G11_prepare_gate", f"""
WITH {V.TURNS} SELECT conv_id, turn, conv_id % 2 = 0 OR (turn > 0 AND ((length(content) < 60 AND {sql_any('lower(content)', X.FOLLOW_UPS)}) OR length(content) < 20)) AS prepare FROM turns
""")
def g11(spark, d):
    gate = A.prepares(F.col("content"), F.col("turn") > 0, F.col("turn") > 0, F.when(F.col("conv_id") % 2 != 0, "wiki"), F.lit(False), rewrite=True, classify=True, infer=True, mode="rules")
    return V.turns(spark, d).select("conv_id", "turn", gate.alias("prepare"))


@add("G12_search_scope", """
SELECT o_orderkey AS qid, CASE WHEN m < 2 THEN 'c' WHEN m < 5 THEN 'p' WHEN m < 8 THEN 'r' END AS project, CASE WHEN m = 0 THEN 'cb' WHEN m = 1 THEN NULL WHEN m < 5 THEN 'pb' WHEN m < 8 THEN 'rb' END AS build,
  CASE WHEN m < 2 THEN 'caller' WHEN m < 5 THEN 'prepared' WHEN m < 8 THEN 'rules' ELSE 'none' END AS source FROM (SELECT o_orderkey, o_orderkey % 10 AS m FROM orders)
""")
def g12(spark, d):
    m = F.col("o_orderkey") % 10
    rows = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), F.when(m < 2, "c").alias("caller_project"), F.when(m == 0, "cb").alias("caller_build"), F.when(m < 5, "p").alias("prepared_project"), F.when(m < 5, "pb").alias("prepared_build"), F.when(m < 8, "r").alias("rule_project"), F.when(m < 8, "rb").alias("rule_build"))
    return A.search_scope(rows)


@add("G13_route", """
SELECT o_orderkey AS qid, CASE WHEN o_orderkey % 11 = 0 THEN 'cancelled' WHEN t = 'translate' THEN 'translation' WHEN coalesce(t, 'wiki') = 'wiki' AND (n = 0 OR coalesce(s < -4.0, FALSE)) THEN 'assistant' WHEN n = 0 THEN 'insufficient' ELSE 'prepared' END AS route
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'translate' WHEN 1 THEN 'debug' WHEN 2 THEN 'wiki' END AS t, o_orderkey % 3 AS n, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 9) - 8.0 END AS s FROM orders)
""")
def g13(spark, d):
    o = F.col("o_orderkey")
    task = F.when(o % 4 == 0, "translate").when(o % 4 == 1, "debug").when(o % 4 == 2, "wiki")
    return V.table(spark, d, "orders").select(o.alias("qid"), A.route(o % 11 == 0, task, o % 3, F.when(o % 3 > 0, o % 9 - 8.0)).alias("route"))


@add("G14_answers", f"WITH {V.KB_DOCS}, {HITS} SELECT DISTINCT qid, FALSE AS insufficient_context FROM hits WHERE rank = 1 AND {S.format('content')} <> ''")
def g14(spark, d):
    found = hits(spark, d).filter(X.strip(F.col("content")) != "")
    asked = found.select("qid").distinct().select("qid", F.lit("why?").alias("question"), F.lit("(none)").alias("history"))
    return A.answers(asked, found, "{{context}}\n\n{{history}}\n\nQ: {{question}}").select("qid", "insufficient_context")


@add("G18_task_resolution", "SELECT o_orderkey AS qid, CASE WHEN o_orderkey % 2 = 0 THEN 'wiki' WHEN o_orderkey % 3 = 0 THEN 'debug' ELSE 'fa' END AS separate, CASE WHEN o_orderkey % 2 = 0 THEN 'wiki' WHEN o_orderkey % 3 = 0 THEN 'debug' END AS merged FROM orders")
def g18(spark, d):
    o = F.col("o_orderkey")
    args = (F.when(o % 2 == 0, "wiki"), F.when(o % 3 == 0, "debug"), F.lit("fa"))
    return V.table(spark, d, "orders").select(o.alias("qid"), A.resolved_task(*args, merged=False).alias("separate"), A.resolved_task(*args, merged=True).alias("merged"))


@add("G19_finalised", f"SELECT o_orderkey AS qid, CASE WHEN o_orderkey % 3 = 0 THEN '{A.INSUFFICIENT}' ELSE o_orderpriority END AS answer, o_orderkey % 3 = 0 AS insufficient_context FROM orders")
def g19(spark, d):
    said = F.when(F.col("o_orderkey") % 3 == 0, " \n").otherwise(F.concat("o_orderpriority", F.lit("\n")))
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), A.finished(said).alias("x")).select("qid", "x.*")


# --- evaluation over the benchmark as a golden set ----------------------------------------------

CASES = """cases AS (SELECT item_id, 'Q-' || lpad(item_id::VARCHAR, 3, '0') AS case_id, text AS question, (['fact','how','trap'])[item_id % 3 + 1] AS category, item_id % 4 <> 0 AS mandatory, item_id % 5 = 0 AS negative,
  list_transform(range(item_id % 3), lambda i: text || ' v' || i) AS paraphrases FROM benchmark)"""


def cases(spark, d):
    i = F.col("item_id")
    category = F.element_at(F.array(*map(F.lit, ["fact", "how", "trap"])), (i % 3 + 1).cast("int"))
    more = F.when(i % 3 == 0, F.array().cast(X.STRINGS)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(i % 3 - 1, F.lit(0)).cast("int")), lambda n: F.concat("text", F.lit(" v"), n.cast("string"))))
    return V.table(spark, d, "benchmark").select(i, F.concat(F.lit("Q-"), F.lpad(i.cast("string"), 3, "0")).alias("case_id"), F.col("text").alias("question"), category.alias("category"), (i % 4 != 0).alias("mandatory"), (i % 5 == 0).alias("negative"), more.alias("paraphrases"))


@add("E01_case_selection", f"WITH {CASES} SELECT case_id FROM cases WHERE category IN ('fact', 'trap') AND mandatory")
def e01(spark, d):
    return E.selected(cases(spark, d), categories=["fact", "trap"], mandatory_only=True).select("case_id")


@add("E02_question_variants", f"WITH {CASES} SELECT case_id, unnest(range(len(q)))::INTEGER AS variant, unnest(q) AS question FROM (SELECT case_id, list_concat([question], paraphrases) AS q FROM cases)")
def e02(spark, d):
    return E.questions(cases(spark, d))


REQUIRED = "required AS (SELECT DISTINCT doc_id // 3 AS qid, CASE WHEN doc_id % 3 = 0 THEN 'data/processed/' || path ELSE 'data/raw/none/' || doc_id || '.md' END AS source FROM kb_docs)"


def required(spark, d):
    source = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("data/processed/"), "path")).otherwise(F.concat(F.lit("data/raw/none/"), F.col("doc_id").cast("string"), F.lit(".md")))
    return V.kb_docs(spark, d).select(F.floor(F.col("doc_id") / 3).alias("qid"), source.alias("source")).distinct()


@add("E03_source_hits", f"""
WITH {V.KB_DOCS}, {HITS}, {REQUIRED}, found AS (SELECT qid, min(rank) AS first_rank, string_agg(DISTINCT source, ' ' ORDER BY source) AS matched FROM required JOIN hits USING (qid) WHERE replace(source, 'data/processed/', '') = replace(source_file, 'data/raw/', '') GROUP BY 1)
SELECT qid, first_rank IS NOT NULL AS source_hit, first_rank, coalesce(matched, '') AS matched FROM (SELECT DISTINCT qid FROM required) LEFT JOIN found USING (qid)
""")
def e03(spark, d):
    return E.source_hits(hits(spark, d), required(spark, d)).withColumn("matched", F.array_join("matched", " "))


FACTS = "facts AS (SELECT qid, string_agg(content, chr(10) ORDER BY rank) AS text FROM hits GROUP BY 1)"
IN_TEXT = "contains(regexp_replace(lower(text), '\\s+', '', 'g'), {})"


@add("E04_fact_recall", f"""
WITH {V.KB_DOCS}, {HITS}, {FACTS} SELECT qid, ({IN_TEXT.format("'the'")}::INTEGER + {IN_TEXT.format("'quede'")}::INTEGER + {IN_TEXT.format("'zzzq'")}::INTEGER)::INTEGER AS facts_found, 3 AS facts_total FROM facts
""")
def e04(spark, d):
    texts = E.combined_text(hits(spark, d)).withColumn("facts", F.array(F.lit("THE"), F.lit("que  de"), F.lit("zzzq")))
    return E.fact_recall(texts).select("qid", "facts_found", "facts_total")


@add("E05_forbidden", f"""
WITH {V.KB_DOCS}, {HITS} SELECT qid, bool_or(project = 'prj1' AND build = 'b2') AS scope_hit, bool_or(contains(source_file, '/sop/d') AND doc_id % 50 = 22) AS source_hit, bool_or(contains(content, 'zwischen') OR contains(content, 'The')) AS text_hit FROM hits GROUP BY 1
""")
def e05(spark, d):
    found = hits(spark, d)
    barred = F.array_compact(F.collect_list(F.when(F.col("doc_id") % 50 == 22, F.concat(F.lit("data/raw/prj1/common/sop/d"), F.col("doc_id").cast("string"), F.lit(".md")))))
    rules = found.groupBy("qid").agg(barred.alias("sources")).select("qid", F.lit("prj1").alias("project"), F.lit("b2").alias("build"), "sources", F.array(F.lit("zwischen"), F.lit("The")).alias("words"))
    return E.forbidden(found, rules)


METRICS = """metrics AS (SELECT o_custkey AS case_id, o_custkey % 4 = 0 AS negative, o_orderkey % 3 <> 0 AS source_hit, (o_orderkey % 11) / 10.0::DOUBLE AS fact_recall, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 7) - 6.0 END AS top_score, (o_orderkey % 5)::INTEGER AS chunk_count, o_orderkey % 97 = 0 AS forbidden FROM orders)"""


def metrics(spark, d):
    o = F.col("o_orderkey")
    return V.table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), (F.col("o_custkey") % 4 == 0).alias("negative"), (o % 3 != 0).alias("source_hit"), (o % 11 / F.lit(10.0)).alias("fact_recall"), F.when(o % 5 > 0, o % 7 - 6.0).alias("top_score"), (o % 5).cast("int").alias("chunk_count"), (o % 97 == 0).alias("forbidden"))


QUIET = "(chunk_count = 0 OR top_score IS NULL OR top_score <= -2.0)"


@add("E06_query_metrics", f"""
WITH {V.KB_DOCS}, {HITS}, {REQUIRED}, found AS (SELECT qid, min(rank) AS first_rank FROM required JOIN hits USING (qid) WHERE replace(source, 'data/processed/', '') = replace(source_file, 'data/raw/', '') GROUP BY 1),
{FACTS}, counts AS (SELECT qid, count(*) AS chunk_count FROM hits GROUP BY 1)
SELECT qid, first_rank IS NOT NULL AS source_hit, {IN_TEXT.format("'the'")}::INTEGER AS facts_found, chunk_count FROM (SELECT DISTINCT qid FROM required) LEFT JOIN found USING (qid) JOIN facts USING (qid) JOIN counts USING (qid)
""")
def e06(spark, d):
    found = hits(spark, d)
    recall = E.fact_recall(E.combined_text(found).withColumn("facts", F.array(F.lit("the")))).select("qid", "facts_found")
    counts = found.groupBy("qid").agg(F.count("*").alias("chunk_count"))
    return E.source_hits(found, required(spark, d)).select("qid", "source_hit").join(recall, "qid").join(counts, "qid")


@add("E07_answer_metrics", """
SELECT o_orderkey AS qid, o_orderkey % 3 = 0 AS refused, o_orderkey % 4 = 1 AS violated, NOT (o_orderkey % 4 = 1) AND CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 = 0 ELSE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 END AS passed FROM orders
""")
def e07(spark, d):
    o = F.col("o_orderkey")
    said = F.concat(F.when(o % 3 == 0, "无法回答 ").otherwise("use 3.3 V "), F.when(o % 4 == 1, "secret").otherwise("ok"))
    rows = V.table(spark, d, "orders").select(
        o.alias("qid"), (o % 5 == 0).alias("negative"), said.alias("answer"), F.lit(False).alias("insufficient"), F.when(o % 3 == 0, F.array(F.lit("9V"))).otherwise(F.array(F.lit("3.3V"))).alias("facts"), F.array(F.lit("secret")).alias("must_not"),
        F.array(F.when(o % 2 == 0, "data/raw/a/b/x.pdf").otherwise("data/raw/a/b/y.pdf")).alias("cited"), F.array(F.lit("data/processed/q/b/x.md")).alias("required"),
    )
    return E.answer_metrics(rows).select("qid", "refused", "violated", "passed")


@add("E08_case_verdicts", f"""
WITH {METRICS} SELECT case_id, bool_or(negative) AS negative, CASE WHEN bool_or(negative) THEN bool_and({QUIET}) AND NOT bool_or(forbidden) ELSE bool_or(source_hit) AND bool_and(fact_recall >= 0.6) AND NOT bool_or(forbidden) END AS passed FROM metrics GROUP BY 1
""")
def e08(spark, d):
    return E.case_verdicts(metrics(spark, d)).select("case_id", "negative", "passed")


@add("E09_stability", f"WITH {METRICS} SELECT case_id, count(DISTINCT source_hit) = 1 AND count(DISTINCT round_even(fact_recall, 2)) = 1 AS stable FROM metrics GROUP BY 1")
def e09(spark, d):
    return E.case_verdicts(metrics(spark, d)).select("case_id", "stable")


@add("E10_answer_verdicts", "SELECT o_custkey AS case_id, bool_and(o_orderkey % 6 <> 0) AS passed FROM orders GROUP BY 1")
def e10(spark, d):
    return E.answer_verdicts(V.table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 6 != 0).alias("passed")))


@add("E11_report", """
WITH c AS (SELECT o_orderkey % 3 = 0 AS passed, o_orderkey % 2 = 0 AS mandatory, o_orderkey % 7 = 0 AS negative, o_orderkey % 5 <> 0 AS source_hit, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 8 = 0 END AS generated FROM orders)
SELECT count(*)::BIGINT AS cases, count(*) FILTER (WHERE passed)::BIGINT AS passed, round(count(*) FILTER (WHERE passed) / count(*)::DOUBLE, 6) AS pass_rate, round(count(*) FILTER (WHERE passed AND mandatory) / (count(*) FILTER (WHERE mandatory))::DOUBLE, 6) AS mandatory_rate,
  round(count(*) FILTER (WHERE passed AND negative) / (count(*) FILTER (WHERE negative))::DOUBLE, 6) AS negative_rate, round(count(*) FILTER (WHERE source_hit AND NOT negative) / (count(*) FILTER (WHERE NOT negative))::DOUBLE, 6) AS source_hit_rate,
  round(count(*) FILTER (WHERE generated) / (count(*) FILTER (WHERE generated IS NOT NULL))::DOUBLE, 6) AS generation_rate, FALSE AS accepted FROM c
""")
def e11(spark, d):
    o = F.col("o_orderkey")
    rows = V.table(spark, d, "orders").select((o % 3 == 0).alias("passed"), (o % 2 == 0).alias("mandatory"), (o % 7 == 0).alias("negative"), (o % 5 != 0).alias("source_hit"), F.when(o % 4 == 0, o % 8 == 0).alias("generated"))
    out = E.meets(E.report(rows))
    return out.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


@add("E14_dataset_rules", f"WITH {CASES} SELECT case_id, 'no source' AS broken FROM cases WHERE NOT negative AND item_id % 2 = 0")
def e14(spark, d):
    sources = F.when(F.col("item_id") % 2 == 0, F.array().cast(X.STRINGS)).otherwise(F.array(F.lit("data/raw/a.md")))
    return E.invalid_cases(cases(spark, d).withColumn("required_sources", sources)).select("case_id", F.array_join("broken", ",").alias("broken"))


# --- the whole way of a request -----------------------------------------------------------------


def lifecycle_model():
    """A stub: names a task and a product by the length of the question, and answers with a fixed text."""

    def model(prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            if "Answer with the lines" not in prompt:
                out.append("an answer [1]")
                continue
            n = len(prompt.split("\n\nQuestion: ", 1)[1].rsplit("\n\nAnswer with the lines", 1)[0])
            out.append(f"TASK: {('wiki', 'translate', 'fa')[n % 3]}\nPRODUCT: {'none' if n % 2 else f'prj{n % 3}'}\nREVISION: none\nLAYER: inherit")
        return out

    return model


# The caller names a scope for half of the questions; the model prepares what has no scope or no task.
_N = f"length({S.format('query')})"
_FREE = f"(qid % 4 >= 2 AND {_N} % 2 = 1)"
_TASK = f"CASE WHEN qid % 7 = 1 THEN 'translate' WHEN qid % 7 = 2 THEN 'debug' ELSE (['wiki','translate','fa'])[{_N} % 3 + 1] END"
_ASKED = f"qid % 11 <> 0 AND {_TASK} <> 'translate'"


def lifecycle_sql() -> str:
    from tessera.plans import q_retrieve as Q

    searched = Q.SEARCHED.replace("TIERED", "TRUE").replace("qid % 4 = 3", _FREE).replace("qid % 4 <> 3", f"NOT {_FREE}")
    searched = searched.replace("'prj' || (qid % 3) AS p", f"CASE WHEN qid % 4 < 2 THEN 'prj' || (qid % 3) ELSE 'prj' || ({_N} % 3) END AS p")
    # The rank of a scope is asked for where the text of the question is no longer there.
    searched = searched.replace("SELECT qid, CASE WHEN tiered AND NOT " + _FREE, "SELECT qid, CASE WHEN tiered AND NOT free").replace(Q.RANK_BY_NAME.replace("qid % 4 = 3", _FREE), Q.RANK_BY_NAME.replace("qid % 4 = 3", "free"))
    searched = searched.replace("SELECT DISTINCT qid, project, build FROM targets", "SELECT DISTINCT qid, free, project, build FROM targets")
    return f"""
WITH {V.KB_DOCS}, {V.QUESTIONS}, {Q.STATS}, {Q.SCORES}, {searched},
merged AS (SELECT *, row_number() OVER (PARTITION BY qid, tier ORDER BY score DESC, {Q.ORDER}) AS tier_rank FROM scored),
led AS (SELECT *, coalesce(min(CASE WHEN score >= -3.0 THEN tier END) OVER (PARTITION BY qid), max(tier) OVER (PARTITION BY qid)) AS primary_tier FROM merged),
capped AS (SELECT * FROM led WHERE tier >= primary_tier AND tier_rank <= CASE WHEN tier = primary_tier THEN ([6, 6, 8])[primary_tier + 1] ELSE ([6, 2, 2])[tier + 1] END),
hits AS (SELECT qid, score, row_number() OVER (PARTITION BY qid ORDER BY tier, tier_rank) AS rank FROM capped QUALIFY rank <= 8),
found AS (SELECT qid, count(*)::INTEGER AS hit_count, max(score) AS top_score FROM hits GROUP BY qid),
told AS (
  SELECT qid, CASE WHEN qid % 11 = 0 THEN 'cancelled' WHEN {_TASK} = 'translate' THEN 'translation'
    WHEN (qid % 7 <> 2) AND (coalesce(hit_count, 0) = 0 OR coalesce(top_score < -4.0, FALSE)) THEN 'assistant' WHEN coalesce(hit_count, 0) = 0 THEN 'insufficient' ELSE 'prepared' END AS route,
    CASE WHEN qid % 11 = 0 THEN (CASE qid % 7 WHEN 1 THEN 'translate' WHEN 2 THEN 'debug' END) ELSE {_TASK} END AS task,
    CASE WHEN {_ASKED} THEN coalesce(hit_count, 0) ELSE 0 END AS hit_count, CASE WHEN {_ASKED} THEN top_score END AS top_score,
    qid % 11 <> 0 AND qid % 7 <> 1 AND (qid % 7 <> 2 OR qid % 4 >= 2) AS model_prepared
  FROM questions LEFT JOIN found USING (qid)
)
SELECT *, CASE WHEN route IN ('translation', 'assistant', 'prepared') THEN 'an answer [1]' ELSE '' END AS answer FROM told"""


@add("G13_lifecycle", lifecycle_sql())
def g13_lifecycle(spark, d):
    from tessera.operators import lifecycle as L
    from tessera.operators import retrieve as R
    from tessera.operators import scope
    from tessera.plans import q_retrieve as Q

    rows, index = Q.indexed(spark, d)
    q = F.col("qid")
    own = V.questions(spark, d).select(
        "qid", F.col("query").alias("question"), F.when(q % 4 < 2, F.concat(F.lit("prj"), (q % 3).cast("string"))).alias("project"), F.when(q % 4 < 2, F.concat(F.lit("b"), (q % 3 + 1).cast("string"))).alias("build"),
        F.when(q % 7 == 1, "translate").when(q % 7 == 2, "debug").alias("task"), (q % 11 == 0).alias("cancelled"),
    )
    catalog = scope.catalog(index.leads)
    none = F.lit(None).cast("string")
    chunks = rows.select("chunk_key", F.col("chunk_key").cast("string").alias("chunk_id"), none.alias("source_file"), none.alias("target_file"), F.lit(0).alias("page"), none.alias("heading_path"))
    made = L.answered(own, lambda asked: R.retrieve(asked, rows, index, catalog), catalog, chunks, lifecycle_model(), "{{context}}\n\nQ: {{question}}")
    return made.select("qid", "route", "task", "hit_count", "top_score", "model_prepared", F.regexp_replace("answer", r"(?s)\n\n---.*$", "").alias("answer"))
