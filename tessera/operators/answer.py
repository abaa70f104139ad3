"""Prompts, routes, citations and image blocks for answers grounded in retrieved chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import hooks
from tessera.operators import scope as S
from tessera.schema import LAYOUT, RETRIEVAL, Layout, Retrieval

INSUFFICIENT = "知识库中未找到相关内容，无法回答该问题。"
#: Placeholders in the order in which they are filled.
PLACES = ("scope_rules", "context", "history", "question")


def context_blocks(hits: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """``hits`` (qid, rank, project, build, source_file, page, chunk_id, heading_path, content) to (qid,
    context): numbered blocks with a header that says where each comes from."""
    scope = S.tier_label(F.col("project"), F.col("build"), layout)
    head = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] scope="), scope, F.lit(" project="), F.col("project"), F.lit(" build="), F.col("build"), F.lit(" source="), F.coalesce("source_file", F.lit("")),
        F.lit(" page="), F.coalesce("page", F.lit(0)).cast("string"), F.lit(" chunk_id="), F.col("chunk_id"),
    )
    head = F.when(F.coalesce("heading_path", F.lit("")) != "", F.concat(head, F.lit(" section="), F.col("heading_path"))).otherwise(head)
    block = F.concat(head, F.lit("\n"), X.strip(F.col("content")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"))


def citations(hits: DataFrame, base: str = "http://localhost:8000") -> DataFrame:
    """(qid, citations): per question an array of (source_file, chunk_id, page, excerpt, url, images)."""
    target = F.when(F.coalesce("target_file", F.lit("")) != "", F.col("target_file")).otherwise(F.regexp_replace("source_file", "^data/raw/", "data/processed/"))
    relative = F.regexp_replace(target, "^data/processed/", "")
    url = F.when(target != "", X.source_url(base, relative, F.col("chunk_id"))).otherwise("")
    folder = F.regexp_replace(relative, r"/?[^/]*$", "")
    found = F.filter(F.transform(X.image_refs(F.col("content")), lambda r: X.asset_path(folder, r)), lambda p: p.isNotNull())
    web = F.array_distinct(F.transform(found, lambda p: F.when(F.startswith(p, F.lit("http")), p).otherwise(X.asset_url(base, p))))
    render = X.asset_url(base, X.page_image(relative, F.coalesce("page", F.lit(0))))
    images = F.when(F.size(web) > 0, web).when(render.isNotNull(), F.array(render)).otherwise(F.array().cast(X.STRINGS))
    one = F.struct(F.col("source_file"), F.col("chunk_id"), F.coalesce("page", F.lit(0)).alias("page"), X.excerpt(F.col("content")).alias("excerpt"), url.alias("url"), images.alias("images"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", one.alias("c"))))
    return hits.groupBy("qid").agg(F.transform(ordered, lambda x: x["c"]).alias("citations"))


def source_name(index: Column, source_file: Column, chunk_id: Column) -> Column:
    """The label of a source chip."""
    name = F.element_at(F.split(F.regexp_replace(source_file, "^data/(raw|processed)/", ""), "/"), -1)
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(chunk_id))


def image_block(answer: Column, images: Column, most: int = 4) -> Column:
    """Images of the citations that an answer cites, in order of their numbers, each URL once.
    ``images``: array (by citation) of arrays of URLs."""
    marks = F.array_sort(F.array_distinct(F.transform(F.filter(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: F.length(m) < 9), lambda m: m.cast("int"))))
    marks = F.filter(marks, lambda n: (n >= 1) & (n <= F.size(images)))
    pairs = F.flatten(F.transform(marks, lambda n: F.transform(F.get(images, n - 1), lambda u: F.struct(u.alias("url"), n.alias("n")))))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["url"]), p["url"]) == i + 1)
    shown = F.slice(first, 1, most)
    label = lambda u: F.element_at(F.split(F.split_part(u, F.lit("?"), F.lit(1)), "/"), -1)
    lines = F.transform(shown, lambda p: F.concat(F.lit("![\\["), p["n"].cast("string"), F.lit("\\] "), label(p["url"]), F.lit("]("), p["url"], F.lit(")")))
    return F.when(F.size(shown) == 0, "").otherwise(F.concat(F.lit("\n\n---\n\n**相关截图 / Referenced Diagrams**\n\n"), F.array_join(lines, "\n"), F.lit("\n")))


def rendered(template: Column, **values: Column) -> Column:
    """A template with its placeholders filled one after the other."""
    out = template
    for name in (*[p for p in PLACES if p in values], *[n for n in values if n not in PLACES]):
        out = F.replace(out, F.lit("{{" + name + "}}"), values[name])
    return X.strip(out)


def weak(task: Column, hit_count: Column, top_score: Column, *, fallback: bool, default_task: str = "wiki", config: Retrieval = RETRIEVAL) -> Column:
    """Whether the assistant answers instead: nothing found, or nothing good enough."""
    open_task = F.coalesce(task, F.lit(default_task)) == default_task
    return F.lit(fallback) & open_task & ((hit_count == 0) | F.coalesce(top_score < config.weak_score, F.lit(False)))


def route(cancelled: Column, task: Column, hit_count: Column, top_score: Column, *, fallback: bool = True, config: Retrieval = RETRIEVAL) -> Column:
    return (F.when(cancelled, "cancelled").when(F.coalesce(task == "translate", F.lit(False)), "translation")
            .when(weak(task, hit_count, top_score, fallback=fallback, config=config), "assistant").when(hit_count == 0, "insufficient").otherwise("prepared"))


def resolved_task(caller: Column, prepared: Column, classified: Column, *, merged: bool) -> Column:
    """The caller's task, else the prepared one, else (in separate mode only) the classified one."""
    return F.coalesce(caller, prepared) if merged else F.coalesce(caller, prepared, classified)


def prepares(question: Column, has_history: Column, has_prior_user: Column, caller_task: Column, has_scope: Column, *, rewrite: bool, classify: bool, infer: bool, mode: str) -> Column:
    """Whether a model call before retrieval is due."""
    need = F.lit(classify) & caller_task.isNull()
    need = need | (F.lit(rewrite) & has_history & X.needs_rewrite(question, has_prior_user))
    return need | (F.lit(infer and mode in ("llm", "merged")) & ~has_scope)


def search_scope(rows: DataFrame) -> DataFrame:
    """(qid, project, build, source): what limits the search: the caller, else the prepared scope, else
    the rules'."""
    caller, prepared = F.col("caller_project").isNotNull(), F.col("prepared_project").isNotNull()
    pick = lambda part: F.when(caller, F.col(f"caller_{part}")).when(prepared, F.col(f"prepared_{part}")).otherwise(F.col(f"rule_{part}"))
    source = F.when(caller, "caller").when(prepared, "prepared").when(F.col("rule_project").isNotNull(), "rules").otherwise("none")
    return rows.select("qid", pick("project").alias("project"), pick("build").alias("build"), source.alias("source"))


def finished(answer: Column) -> Column:
    """(answer, insufficient_context): an empty answer becomes the refusal."""
    clean = X.strip(F.coalesce(answer, F.lit("")))
    return F.struct(F.when(clean == "", INSUFFICIENT).otherwise(clean).alias("answer"), (clean == "").alias("insufficient_context"))


def answers(questions: DataFrame, hits: DataFrame, template: str, model: hooks.Model = hooks.extractive_model, base: str = "http://localhost:8000") -> DataFrame:
    """(qid, answer, insufficient_context, citations) for ``questions`` (qid, question, history)."""
    blocks = context_blocks(hits)
    rows = questions.join(blocks, "qid", "left").join(citations(hits, base), "qid", "left")
    prompt = rendered(F.lit(template), context=F.coalesce("context", F.lit("")), history=F.col("history"), question=F.col("question"))
    made = hooks.generated(rows.withColumn("prompt", prompt), "prompt", model).withColumn("done", finished(F.col("answer")))
    return made.select("qid", "done.answer", "done.insufficient_context", F.when(~F.col("done.insufficient_context"), F.col("citations")).alias("citations"))


TRANSLATION = "Translate the following answer as the user asks.\n\nConversation:\n{{history}}\n\nRequest: {{question}}"
ASSISTANT = "{{role}}\n\nThe knowledge base has nothing reliable on this question. Say so, or introduce yourself if you are asked who you are.\n\nQuestion: {{question}}"
CLASSIFY = "Name the task of this question as one of: wiki, debug, fa, design_review, translate.\n\nQuestion: {{question}}"
REWRITE = "Rewrite the last question so that it can be understood without the conversation.\n\n{{history}}\n\nQuestion: {{question}}"
PREPARE = "{{history}}\n\nKnown products:\n{{known_products}}\n\nQuestion: {{question}}\n\nAnswer with the lines QUERY:, TASK:, PRODUCT:, REVISION:, LAYER:."


def prompt_for(route: Column, question: Column, history: Column, context: Column, template: str, role: str = "You are the assistant of an engineering knowledge base.") -> Column:
    """The prompt that a route sends; null where it sends none."""
    values = {"question": question, "history": history}
    return (F.when(route == "translation", rendered(F.lit(TRANSLATION), **values)).when(route == "assistant", rendered(F.lit(ASSISTANT), role=F.lit(role), question=question))
            .when(route == "prepared", rendered(F.lit(template), context=context, **values)))


def classified(rows: DataFrame, model: hooks.Model, default: str = "wiki") -> DataFrame:
    """``rows`` (question) with the task that a model names, or the default."""
    asked = rows.withColumn("__prompt", rendered(F.lit(CLASSIFY), question=F.col("question")))
    said = hooks.generated(asked, "__prompt", model, "__said")
    return said.withColumn("task", F.coalesce(X.task_label(F.col("__said")), F.lit(default))).drop("__prompt", "__said")


def prepared(rows: DataFrame, model: hooks.Model, listing: str, default: str = "wiki") -> DataFrame:
    """``rows`` (question, history) with retrieval_query, task, product, revision and layer from one model
    call; scopes still need the catalog's word (``scope.validated``)."""
    asked = rows.withColumn("__prompt", rendered(F.lit(PREPARE), history=F.col("history"), known_products=F.lit(listing), question=F.col("question")))
    said = hooks.generated(asked, "__prompt", model, "__said")
    raw = F.col("__said")
    field = lambda name: X.optional_field(X.labelled_line(raw, name))
    return said.withColumns({
        "retrieval_query": X.retrieval_query(raw, F.col("question")), "task": F.coalesce(X.task_label(X.labelled_line(raw, "TASK")), F.lit(default)),
        "product": field("PRODUCT"), "revision": field("REVISION"), "layer": S.layer_name(X.labelled_line(raw, "LAYER")),
    }).drop("__prompt", "__said")
