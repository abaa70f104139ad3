"""Batch retrieval: recall, fusion, reranking, boosts, tier cascade and quotas for many questions.

Questions are rows, so evaluating thousands of them is one job.  Sparse recall searches packed postings
by shard, dense recall packs of vectors (``postings``, ``vectors``); both skip what their bounds rule out.
Questions with fewer matches than asked for are filled up with the first chunks of their pool, which is
what scores of zero in corpus order mean.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import hooks
from tessera.operators import index as I
from tessera.operators import postings as P
from tessera.operators import scope as S
from tessera.operators import vectors as W
from tessera.operators.durable import materialize, spread
from tessera.operators.postings import DIGITS
from tessera.schema import LAYOUT, RETRIEVAL, Layout, Retrieval


def asked_tokens(questions: DataFrame, index: I.Lexical, config: Retrieval = RETRIEVAL) -> DataFrame:
    """(qid, tokens, weights): the tokens of ``questions`` that the index knows, each with its weight times
    how often it is asked for."""
    asked = materialize(questions.select("qid", F.explode(X.tokens(F.col("query"))).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("times")), "question-tokens")
    told = asked.join(index.weights(asked, config).select("token", "idf"), "token").select("qid", F.struct("token", (F.col("idf") * F.col("times")).alias("weight")).alias("x"))
    told = told.groupBy("qid").agg(F.array_sort(F.collect_list("x")).alias("x"))  # a question's tokens
    return told.select("qid", F.transform("x", lambda x: x["token"]).alias("tokens"), F.transform("x", lambda x: x["weight"]).alias("weights"))


def bm25_scores(questions: DataFrame, index: I.Lexical, config: Retrieval = RETRIEVAL, key: str = "chunk_key", pool: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """(qid, key, score) of all chunks that share a token with a question; or, with a ``pool`` (qid, tier,
    project, build), (qid, tier, key, pos, score) of those in it that may be among the ``k`` best.  Statistics
    are those of the whole corpus, whatever the pool."""
    told = asked_tokens(questions, index, config)
    if pool is None:
        # Every question sees every scope: one list of them, which each unfolds.
        listed = index.leads.agg(F.collect_set(F.struct("project", "build")).alias("scopes"))
        where = questions.select("qid").join(F.broadcast(listed), F.lit(True)).select("qid", F.lit(0).alias("tier"), F.explode("scopes").alias("s")).select("qid", "tier", "s.project", "s.build")  # one row
    else:
        where = pool.select("qid", "tier", "project", "build")
    asked = materialize(where.join(told, "qid"), "asked")
    found = P.search(index.packs, asked, index.stats.select("avgdl"), k, config, key)
    return found if pool is not None else found.select("qid", key, "score")


def top_k(rows: DataFrame, k: int, *order: Column, by: tuple[str, ...] = ("qid",), rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1; the cut happens before the shuffle too."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def sparse_recall(questions: DataFrame, pool: DataFrame, index: I.Lexical, k: int, config: Retrieval = RETRIEVAL, key: str = "chunk_key", chunks: DataFrame | None = None) -> DataFrame:
    """(qid, tier, key, pos, score, rank): the best k of each question's pool per tier.

    ``pool``: (qid, tier, project, build).  ``chunks`` (key, pos, project, build) are needed only for more
    results than the index keeps first chunks of a scope."""
    scored = bm25_scores(questions, index, config, key, pool, k)
    # Zero scores in corpus order: the first k of every scope are enough.
    if k > I.LEADS:
        if chunks is None:
            raise ValueError(f"more than {I.LEADS} results need the chunks")
        lead = I.leads(chunks, key, k)
    else:
        lead = index.leads
    zeros = pool.select("qid", "tier", "project", "build").join(top_k(lead.select(key, "pos", "project", "build"), k, F.col("pos"), by=("project", "build"), rank="nth").drop("nth"), ["project", "build"])
    zeros = zeros.select("qid", "tier", key, "pos", F.lit(0.0).alias("score"))
    both = scored.unionByName(zeros).groupBy("qid", "tier", key, "pos").agg(F.max("score").alias("positive"), F.min("score").alias("least"))
    # A chunk that scores below zero also came in as a filler; its own score counts.
    real = both.select("qid", "tier", key, "pos", F.when(F.col("least") < 0, F.col("least")).otherwise(F.col("positive")).alias("score"))
    return top_k(real, k, F.desc("score"), F.col("pos"), by=("qid", "tier"))


def dense_recall(queries: DataFrame, vectors: DataFrame, k: int, key: str = "key") -> DataFrame:
    """(qid, key, score, rank): cosine top k.  ``queries``: (qid, unit [, scopes: array of names]);
    ``vectors``: (key: long, unit [, scope]), or a written table of packs of them.  A question with scopes
    sees only vectors of those."""
    if "centre" not in vectors.columns:
        held = vectors.select(F.col(key).alias("key"), "unit", (F.col("scope") if "scope" in vectors.columns else F.lit("")).alias("scope"))
        vectors = materialize(W.pack_vectors(held), "vector-packs")
    return W.dense_search(queries, vectors, k, key)


def fused(*lists: DataFrame, by: tuple[str, ...] = ("qid",), key: str = "chunk_key") -> DataFrame:
    """Ordered union: the first list, then what the next ones add; the first occurrence wins."""
    marked = reduce(DataFrame.unionByName, [x.select(*by, key, "rank", F.lit(i).alias("source")) for i, x in enumerate(lists)])
    first = marked.groupBy(*by, key).agg(F.min(F.struct("source", "rank")).alias("first"))
    order = Window.partitionBy(*by).orderBy("first")
    return first.select(*by, key, F.col("first.source").alias("source"), F.row_number().over(order).alias("rank"))


def lexical_logit(words: Column, content: Column) -> Column:
    """The offline reranker: the share of the question's words that occur, from -6 to 2."""
    return share_logit(words, X.hits_in(words, content))


def share_logit(words: Column, hits: Column) -> Column:
    return F.round(F.when(F.size(words) == 0, -6.0).otherwise(8.0 * hits / F.size(words) - 6.0), DIGITS)


def metadata_boost(words: Column, interfaces: Column, nets: Column, keywords: Column, title: Column, upper: Callable[[Column], Column] = F.upper) -> Column:
    """How many of the words occur in the metadata."""
    lists = [F.coalesce(F.array_join(c, " "), F.lit("")) for c in (interfaces, nets, keywords)]
    return X.hits_in(words, F.concat_ws(" ", *lists, F.coalesce(title, F.lit(""))), upper)


def keyword_boost(content_hits: Column, metadata_hits: Column) -> Column:
    return content_hits + 2 * metadata_hits


def document_rank(kind: Column, project: Column, build: Column, pin_query: Column, layout: Layout = LAYOUT) -> Column:
    """0: a build's schematic, 2: an enterprise datasheet, 1: all else; only pin questions tell."""
    own = (kind == "schematic") & (project != layout.enterprise) & (build != layout.shared_build)
    return F.when(~pin_query, 0).when(own, 0).when((kind == "datasheet") & (project == layout.enterprise), 2).otherwise(1)


def flat_order() -> tuple[Column, ...]:
    """The order of a flat search: scope, document rank, boost, score, place."""
    return F.coalesce("scope_rank", F.lit(0)).asc(), F.col("doc_rank").asc(), F.desc("boost"), F.desc("score"), F.col("pos").asc()


def flat_results(candidates: DataFrame, k: int) -> DataFrame:
    """Candidates (qid, pos, scope_rank, doc_rank, boost, score) to the first k, with ``top_score`` over
    all candidates of the question."""
    top = F.max("score").over(Window.partitionBy("qid"))
    return top_k(candidates.withColumn("top_score", top), k, *flat_order())


def primary_quota(tier: Column, k: int, quotas: tuple[int, int, int]) -> Column:
    """Places that a tier may take when it leads."""
    caps = [min(k, max(quotas[t], k - sum(quotas[t + 1 :]))) for t in range(3)]
    return F.element_at(F.array(*map(F.lit, caps)), tier + 1)


def tier_merge(candidates: DataFrame) -> DataFrame:
    """Per question and tier: by score alone; the flat order only breaks ties."""
    order = Window.partitionBy("qid", "tier").orderBy(F.desc("score"), *flat_order())
    return candidates.withColumn("tier_rank", F.row_number().over(order))


def cascade(candidates: DataFrame, k: int | None = None, threshold: float | None = None, quotas: tuple[int, int, int] | None = None, config: Retrieval = RETRIEVAL) -> DataFrame:
    """Candidates (qid, tier, pos, scope_rank, doc_rank, boost, score) to the final hits, ranked.

    The leading tier is the first whose best score reaches ``threshold``, or else the deepest with
    candidates; tiers above it drop out.  It fills its quota, then lower tiers theirs, up to k.  All
    tiers are evaluated at once: a tier above the leading one can never be chosen."""
    k, threshold, quotas = k or config.final_k, config.sufficient_score if threshold is None else threshold, quotas or config.quotas
    ranked = tier_merge(candidates)
    per_question = Window.partitionBy("qid")
    enough = F.min(F.when(F.col("score") >= threshold, F.col("tier"))).over(per_question)
    ranked = ranked.withColumn("primary", F.coalesce(enough, F.max("tier").over(per_question)))
    own = F.element_at(F.array(*map(F.lit, quotas)), F.col("tier") + 1)
    cap = F.when(F.col("tier") == F.col("primary"), primary_quota(F.col("primary"), k, quotas)).otherwise(own)
    kept = ranked.filter((F.col("tier") >= F.col("primary")) & (F.col("tier_rank") <= cap))
    final = top_k(kept, k, F.col("tier"), F.col("tier_rank"))
    return final.withColumn("top_score", F.max("score").over(per_question))


def scope_pool(questions: DataFrame, scopes: DataFrame, catalog: DataFrame, tiered: bool) -> DataFrame:
    """(qid, tier, project, build, scope_rank): where each question searches; ``scopes``: (project, build, ...)."""
    known = questions.filter("project is not null and build is not null").select("qid", "project", "build")
    open_ = questions.filter("project is not null and build is null").select("qid", F.col("project").alias("product"))
    every = scopes.select("project", "build").distinct()
    # A question without a project sees all scopes: one list of them, which each such question unfolds.
    listed = every.agg(F.collect_set(F.struct("project", "build")).alias("scopes"))
    free = questions.filter("project is null").select("qid").join(F.broadcast(listed), F.lit(True))  # one row
    anywhere = free.select("qid", F.explode("scopes").alias("s")).select("qid", "s.project", "s.build", F.lit(0).alias("scope_rank"), F.lit(True).alias("free"))
    ranked = S.ranks(known).unionByName(S.inherit_ranks(open_, catalog)).withColumn("free", F.lit(False)).unionByName(anywhere)
    tier = F.when(F.col("free"), 0).otherwise(S.tier(F.col("project"), F.col("build")) if tiered else F.lit(0))
    return ranked.select("qid", tier.alias("tier"), "project", "build", "scope_rank")


def retrieve(questions: DataFrame, chunks: DataFrame, index: I.Lexical, catalog: DataFrame, config: Retrieval = RETRIEVAL, *, use_cascade: bool | None = None, dense: DataFrame | None = None, reranker: hooks.Reranker | None = None, by_letter: bool = False) -> DataFrame:
    """The whole of retrieval for ``questions`` (qid, query, project, build): recall per tier, fusion,
    reranking, boosts, cascade or flat order, and the score gate.

    ``chunks``: (chunk_key, pos, project, build, document_type, content [, title, keywords, nets,
    interfaces]); the columns in brackets feed the metadata part of the boost.  A question with a project
    alone inherits from all its builds; one without a project sees everything as one tier.  ``dense``:
    (qid, tier, chunk_key, pos, score) of a dense recall over each question's pool, which comes first in
    the fusion (see ``dense_pool``).  A ``reranker`` scores each question with the excerpt of a chunk that
    gathers most of its words; without one, the words are looked for in the whole chunk.  ``by_letter``: words
    meet texts in the case of SQL, where ``ß`` is one letter."""
    tiered = config.scope_cascade if use_cascade is None else use_cascade
    boost_tokens, upper = (X.boost_tokens_by_letter, X.upper_by_letter) if by_letter else (X.boost_tokens, F.upper)
    free = questions.select("qid", "query", boost_tokens(F.col("query")).alias("words"), X.is_pin_query(F.col("query")).alias("pin"))
    pool = materialize(scope_pool(questions, index.leads, catalog, tiered), "scope-pool")
    sparse = sparse_recall(questions.select("qid", "query"), pool, index, config.sparse_k, config, chunks=chunks)
    lists = [sparse]
    if dense is not None:
        lists.insert(0, top_k(dense, config.dense_k, F.desc("score"), F.col("pos"), by=("qid", "tier")))
    found = materialize(fused(*lists, by=("qid", "tier")).drop("rank", "source"), "candidates")
    rows = found.join(chunks, "chunk_key").join(free, "qid").join(pool.select("qid", "project", "build", "scope_rank"), ["qid", "project", "build"])
    # The few candidates leave the scan of the chunks before the costly part, by question as the ranks need them.
    rows = spread(rows, "qid").withColumn("hits", X.hits_in(F.col("words"), F.col("content"), upper))
    told = [F.col(c) if c in chunks.columns else F.lit(None).cast(X.STRINGS) for c in ("interfaces", "nets", "keywords")]
    title = F.col("title") if "title" in chunks.columns else F.lit(None).cast("string")
    meta = metadata_boost(F.col("words"), *told, title, upper) if {"title", "keywords"} & set(chunks.columns) else F.lit(0)
    if reranker is None:
        rows = rows.withColumn("score", share_logit(F.col("words"), F.col("hits")))
    else:
        rows = hooks.reranked(rows, "query", "content", "words", reranker, config.excerpt_chars).withColumn("score", F.round("logit", DIGITS))
    rows = rows.withColumns({
        "boost": keyword_boost(F.col("hits"), meta), "doc_rank": document_rank(F.col("document_type"), F.col("project"), F.col("build"), F.col("pin")),
    }).select("qid", "tier", "chunk_key", "pos", "scope_rank", "doc_rank", "boost", "score", "content", "project", "build", "document_type")
    final = cascade(rows, config=config) if tiered else flat_results(rows, config.final_k)
    return final if config.minimum_score is None else final.filter(F.col("top_score") >= config.minimum_score)


def dense_pool(questions: DataFrame, packs: DataFrame, chunks: DataFrame, scopes: DataFrame, catalog: DataFrame, config: Retrieval = RETRIEVAL, *, use_cascade: bool | None = None) -> DataFrame:
    """(qid, tier, chunk_key, pos, score): dense recall per question and tier.  ``questions``: with ``unit``;
    ``packs``: packs of vectors whose scopes are project and build, joined by a unit separator."""
    tiered = config.scope_cascade if use_cascade is None else use_cascade
    scope = F.concat_ws("\x1f", "project", "build")
    pool = scope_pool(questions, scopes, catalog, tiered).groupBy("qid", "tier").agg(F.collect_set(scope).alias("scopes"))
    # A question asks once for each of its tiers.
    asked = materialize(pool.join(questions.select("qid", "unit"), "qid").withColumn("nth", F.monotonically_increasing_id()), "dense-questions")
    found = W.dense_search(asked.select(F.col("nth").alias("qid"), "unit", "scopes"), packs, config.dense_k)
    named = found.select(F.col("qid").alias("nth"), F.col("key").alias("chunk_key"), "score").join(asked.select("nth", "qid", "tier"), "nth")
    return named.join(chunks.select("chunk_key", "pos"), "chunk_key").select("qid", "tier", "chunk_key", "pos", "score")
