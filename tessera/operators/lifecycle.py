"""From requests to answers as one batch plan.

Every request takes a route, and rows are split by it, so that a model or a search is asked only for the
rows that need it: cancelled and empty requests go straight to the end, translations and the assistant
skip retrieval or what it found, and prompts go to the model once all routes are known.  A service asks
for one request, an evaluation for thousands, with the same plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Generation
from tessera.functions import text as X
from tessera.operators import answer as A
from tessera.operators import chunk as C
from tessera.operators import hooks
from tessera.operators import scope as S
from tessera.operators.durable import materialize
from tessera.schema import LAYOUT, RETRIEVAL, Layout, Retrieval

#: What a request may say besides its id and question, with its default.
OPTIONAL = {"project": "string", "build": "string", "task": "string", "history": "string", "recent": "string", "prior_user": "boolean", "cancelled": "boolean"}
Search = Callable[[DataFrame], DataFrame]


def requests(rows: DataFrame) -> DataFrame:
    """``rows`` (qid, question [, project, build, task, history, recent, prior_user, cancelled]) with all of these:
    ``recent`` are the last turns as a rewrite sees them, ``history`` as an answer does."""
    told = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in OPTIONAL.items()]
    rows = rows.select("qid", X.strip(F.coalesce("question", F.lit(""))).alias("question"), *told)
    blank = lambda c: F.when(X.strip(F.col(c)) != "", F.col(c))
    return rows.withColumns({"project": blank("project"), "build": blank("build"), "task": blank("task"), "prior_user": F.coalesce("prior_user", F.lit(False)), "cancelled": F.coalesce("cancelled", F.lit(False))})


def prepared(rows: DataFrame, model: hooks.Model, products: DataFrame, config: Generation) -> DataFrame:
    """``rows`` with retrieval_query, prepared_task, product, revision, layer and ``model_prepared``: by one
    model call for the rows that need it (or, in separate mode, by one for a rewrite and one for a task)."""
    none = F.lit(None).cast("string")
    open_ = ~F.col("cancelled") & (F.col("question") != "") & ~F.coalesce(F.col("task") == "translate", F.lit(False))
    has_scope = F.col("project").isNotNull() | F.col("build").isNotNull()
    has_history = X.strip(F.coalesce("recent", F.lit(""))) != ""
    args = (F.col("question"), has_history, F.col("prior_user"))
    plain = {"retrieval_query": F.col("question"), "prepared_task": none, "product": none, "revision": none, "layer": none}
    out = ["retrieval_query", "prepared_task", "product", "revision", "layer", "model_prepared"]
    if config.prepare == "separate":
        again = open_ & F.lit(config.query_rewrite) & has_history & X.needs_rewrite(F.col("question"), F.col("prior_user"))
        name = open_ & F.lit(config.task_classification) & F.col("task").isNull()
        rows = materialize(rows.withColumns({"again": again, "name": name}), "requests")
        asked = rows.filter("again").withColumn("prompt", A.rendered(F.lit(A.REWRITE), history=F.col("recent"), question=F.col("question")))
        said = hooks.generated(asked, "prompt", model, "reply").select("qid", hooks.rewritten(F.col("question"), F.col("reply")).alias("retrieval_query"))
        named = A.classified(rows.filter("name").select("qid", "question"), model, config.default_task).select("qid", F.col("task").alias("prepared_task"))
        both = rows.join(said, "qid", "left").join(named, "qid", "left")
        return both.withColumns({"retrieval_query": F.coalesce("retrieval_query", "question"), "product": none, "revision": none, "layer": none, "model_prepared": F.col("again") | F.col("name")}).drop("again", "name")
    due = open_ & A.prepares(*args, F.col("task"), has_scope, rewrite=config.query_rewrite, classify=config.task_classification, infer=config.scope_inference, mode=config.scope_inference_mode)
    rows = materialize(rows.withColumn("model_prepared", due), "requests")
    listing = S.known_products(products).first()["listing"]
    asked = rows.filter("model_prepared").withColumn("given", F.coalesce("recent", F.lit("(none)")))
    said = A.prepared(asked.select("qid", "question", F.col("given").alias("history")), model, listing, config.default_task)
    # What is switched off, or the caller said, is not taken from the reply.
    task = F.when(F.lit(config.task_classification), F.col("task")) if config.task_classification else none
    said = said.select("qid", F.col("retrieval_query").alias("q"), task.alias("t"), "product", "revision", "layer")
    both = rows.join(said, "qid", "left")
    infer = F.lit(config.scope_inference and config.scope_inference_mode in ("llm", "merged")) & ~has_scope
    rewrite = F.lit(config.query_rewrite) & F.col("q").isNotNull()
    return both.withColumns({
        "retrieval_query": F.when(rewrite, F.col("q")).otherwise(F.col("question")), "prepared_task": F.when(F.col("task").isNull(), F.col("t")),
        **{c: F.when(infer, F.col(c)) for c in ("product", "revision", "layer")},
    }).select(*rows.columns[:-1], *out)


def scoped(rows: DataFrame, products: DataFrame, config: Generation, layout: Layout = LAYOUT) -> DataFrame:
    """``rows`` with target_project, target_build and ``query``: the caller's scope, else what the model or
    the rules inferred and the catalog knows; scope words go from the query."""
    caller = F.col("project").isNotNull()
    if not config.scope_inference:
        return rows.withColumns({"target_project": F.col("project"), "target_build": F.when(caller, F.col("build")), "query": F.col("retrieval_query"), "inferred": F.lit(None).cast("string")})
    free = rows.filter(~caller)
    none = F.lit(None).cast("string")
    rules = S.extracted(free.select("qid", F.col("question").alias("query")), products, layout) if config.scope_inference_mode in ("rules", "merged") else free.select("qid", none.alias("product"), none.alias("revision"), none.alias("layer"), none.alias("stripped"))
    rules = materialize(rules, "scope-rules")
    offered = free.filter(F.col("product").isNotNull() | F.col("revision").isNotNull() | F.col("layer").isNotNull())
    known = S.validated(offered.select("qid", "product", "revision", "layer"), products, layout)
    chosen = S.merged(rules.select("qid", "product", "revision", "layer"), known).select("qid", F.col("product").alias("s_product"), F.col("revision").alias("s_revision"), F.col("layer").alias("inferred"))
    both = rows.join(chosen, "qid", "left").join(rules.select("qid", F.col("layer").alias("rule_layer"), "stripped"), "qid", "left")
    enterprise, shared = F.lit(layout.enterprise), F.lit(layout.shared_build)
    project = F.when(F.col("inferred") == "enterprise", enterprise).otherwise(F.col("s_product"))
    build = F.when(F.col("inferred") == "enterprise", enterprise).when(F.col("inferred") == "project_common", shared).when(F.col("inferred") == "build", F.col("s_revision"))
    silent = F.col("product").isNull() & F.col("revision").isNull() & F.col("layer").isNull()
    use = F.col("rule_layer").isNotNull() & F.col("inferred").isNotNull() & (F.coalesce("stripped", F.lit("")) != "") & (silent | (F.col("retrieval_query") == F.col("question")))
    return both.withColumns({
        "target_project": F.when(caller, F.col("project")).otherwise(project), "target_build": F.when(caller, F.col("build")).otherwise(build),
        "query": F.when(use, F.col("stripped")).otherwise(F.col("retrieval_query")),
    }).drop("s_product", "s_revision", "rule_layer", "stripped")


def routed(rows: DataFrame, hits: DataFrame, config: Generation, retrieval: Retrieval = RETRIEVAL) -> DataFrame:
    """``rows`` with task, hit_count, top_score and ``route``: cancelled, empty, translation, assistant,
    insufficient or prepared."""
    found = hits.groupBy("qid").agg(F.count("*").cast("int").alias("hit_count"), F.max("top_score").alias("top_score"))
    task = A.resolved_task(F.col("task"), F.col("prepared_task"), F.lit(None).cast("string"), merged=True)
    rows = rows.join(found, "qid", "left").withColumns({"hit_count": F.coalesce("hit_count", F.lit(0)), "resolved": task})
    # The assistant answers for the caller's task alone: a task that the model named does not keep it away.
    weak = F.lit(config.assistant_fallback) & (F.coalesce("task", F.lit(config.default_task)) == config.default_task) & ((F.col("hit_count") == 0) | F.coalesce(F.col("top_score") < retrieval.weak_score, F.lit(False)))
    route = F.when(F.col("cancelled"), "cancelled").when(F.col("question") == "", "empty").when(F.coalesce(F.col("resolved") == "translate", F.lit(False)), "translation")
    return rows.withColumn("route", route.when(weak, "assistant").when(F.col("hit_count") == 0, "insufficient").otherwise("prepared"))


def answered(
    rows: DataFrame, search: Search, products: DataFrame, chunks: DataFrame, model: hooks.Model, template: str, config: Generation | None = None, retrieval: Retrieval = RETRIEVAL,
    base: str = "http://localhost:8000", expand: bool = False, layout: Layout = LAYOUT,
) -> DataFrame:
    """(qid, route, task, query, target_project, target_build, hit_count, top_score, model_prepared, prompt,
    answer, insufficient_context, citations) of ``rows`` (see ``requests``).

    ``search`` takes (qid, query, project, build) to hits (qid, rank, chunk_key, content, project, build,
    top_score, ...); ``chunks`` (chunk_key, chunk_id, source_file, target_file, page, heading_path) names them.
    With ``expand``, a hit is its whole section."""
    config = config or Generation()
    asked = materialize(scoped(prepared(requests(rows), model, products, config), products, config, layout), "prepared-requests")
    skip = F.col("cancelled") | (F.col("question") == "") | F.coalesce(F.coalesce("task", "prepared_task") == "translate", F.lit(False))
    found = search(asked.filter(~skip).select("qid", "query", F.col("target_project").alias("project"), F.col("target_build").alias("build")))
    meta = chunks.select("chunk_key", "chunk_id", "source_file", "target_file", "page", "heading_path")
    hits = materialize(found.join(meta, "chunk_key").select("qid", "rank", "project", "build", "source_file", "target_file", "page", "chunk_id", "heading_path", "content", "top_score"), "hits")
    told = materialize(routed(asked, hits, config, retrieval), "routes")
    shown = hits.join(told.filter("route = 'prepared'").select("qid"), "qid", "left_semi")
    if expand:
        whole = C.expand_sections(shown.select("qid", "rank", "chunk_id"), chunks.select("chunk_id", "content")).select("qid", "section", "rank", "content")
        first = shown.withColumn("section", X.section_key(F.col("chunk_id"))).groupBy("qid", "section").agg(F.min_by(F.struct("project", "build", "source_file", "target_file", "page", "chunk_id", "heading_path"), "rank").alias("m"))
        shown = materialize(whole.join(first, ["qid", "section"]).select("qid", "rank", "m.*", "content"), "sections")
    blocks, cited = A.context_blocks(shown, layout), A.citations(shown, base)
    rows = told.join(blocks, "qid", "left").join(cited, "qid", "left")
    keeps = X.needs_history(F.col("question"), X.strip(F.coalesce("history", F.lit(""))) != "", F.col("prior_user"), F.col("resolved"), F.col("query"))
    history = F.when(keeps, F.col("history")).otherwise("(none)")
    prompt = A.prompt_for(F.col("route"), F.col("question"), history, F.coalesce("context", F.lit("")), template)
    rows = materialize(rows.withColumn("prompt", prompt), "prompts")
    # Only rows with a prompt see the model.
    said = hooks.generated(rows.filter("prompt is not null").select("qid", "prompt"), "prompt", model, "reply").select("qid", "reply")
    rows = rows.join(said, "qid", "left").withColumn("done", A.finished(F.col("reply")))
    insufficient = F.when(F.col("prompt").isNotNull(), F.col("done.insufficient_context")).otherwise(F.col("route") == "insufficient")
    text = F.when(F.col("prompt").isNotNull(), F.col("done.answer")).when(F.col("route") == "insufficient", A.INSUFFICIENT).otherwise("")
    shows = (F.col("route") == "prepared") & ~insufficient
    images = A.image_block(text, F.transform("citations", lambda c: c["images"]), config.inline_images)
    text = F.when(shows & F.lit(config.inline_images > 0) & F.col("citations").isNotNull(), F.concat(X.rstrip(text), images)).otherwise(text)
    return rows.select(
        "qid", "route", F.col("resolved").alias("task"), "query", "target_project", "target_build", "hit_count", "top_score", "model_prepared", "prompt",
        text.alias("answer"), insufficient.alias("insufficient_context"), F.when(shows, F.col("citations")).alias("citations"),
    )
