"""Golden-set runs: retrieval, generation or both, as one report row and as text."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Config, for_evaluation
from tessera.functions import text as X
from tessera.operators import evaluate as E
from tessera.operators.durable import materialize
from tessera.schema import EVALUATION, Evaluation
from tessera.service import Engine

MODES = ("retrieval", "generation", "both")


def variants(cases: DataFrame) -> DataFrame:
    """A row per question and paraphrase, with its case's expectations and a question id."""
    return E.questions(cases).join(cases.drop("question", "paraphrases"), "case_id").withColumn("qid", F.xxhash64("case_id", "variant"))


def retrieval_metrics(engine: Engine, asked: DataFrame, hits: DataFrame) -> DataFrame:
    """``asked`` with source_hit, fact recall, top_score, chunk_count and forbidden."""
    hit = E.source_hits(hits, asked.select("qid", F.explode("required_sources").alias("source"))).select("qid", "source_hit")
    rules = asked.select("qid", F.lit(None).cast("string").alias("project"), F.lit(None).cast("string").alias("build"), F.col("forbidden_sources").alias("sources"), F.array().cast(X.STRINGS).alias("words"))
    barred = E.forbidden(hits, rules).select("qid", (F.col("scope_hit") | F.col("source_hit") | F.col("text_hit")).alias("forbidden"))
    top = hits.groupBy("qid").agg(F.max("top_score").alias("top_score"), F.count("*").cast("int").alias("chunk_count"))
    rows = E.fact_recall(asked.join(E.combined_text(hits), "qid", "left")).join(hit, "qid", "left").join(top, "qid", "left").join(barred, "qid", "left")
    return rows.withColumns({"source_hit": F.coalesce("source_hit", F.lit(False)), "chunk_count": F.coalesce("chunk_count", F.lit(0)), "forbidden": F.coalesce("forbidden", F.lit(False))})


def answer_metrics(engine: Engine, asked: DataFrame, hits: DataFrame, config: Evaluation = EVALUATION) -> DataFrame:
    """Metrics of the answers to each case's own question (not its paraphrases)."""
    first = asked.filter("variant = 0")
    made = engine.answers(first.select("qid", "question", "project", "build"))
    cited = F.coalesce(F.transform("citations", lambda c: c["source_file"]), F.array().cast(X.STRINGS))
    rows = first.join(made.select("qid", "answer", F.col("insufficient_context").alias("insufficient"), cited.alias("cited")), "qid").withColumn("required", F.col("required_sources"))
    return E.answer_metrics(rows, config)


def run(engine: Engine, cases: DataFrame, mode: str = "retrieval", config: Evaluation = EVALUATION) -> DataFrame:
    """One report row for ``cases`` (see ``sources.golden``)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    # Deterministic: no rewriting, classification, scope inference or fallback.
    engine = replace(engine, generation=for_evaluation(Config(generation=engine.generation)).generation)
    engine.load()
    asked = materialize(variants(cases), "eval-questions")
    found = engine.retrieve(asked.select("qid", F.col("question").alias("query"), "project", "build"))
    meta = engine.tables["chunks"].select("chunk_key", "chunk_id", "source_file", "target_file", "page", "heading_path")
    hits = materialize(found.join(meta, "chunk_key"), "eval-hits")  # read by every metric
    metrics = retrieval_metrics(engine, asked, hits)
    verdicts = E.case_verdicts(metrics, config).join(cases.select("case_id", "mandatory"), "case_id")
    verdicts = verdicts.join(metrics.groupBy("case_id").agg(F.some("source_hit").alias("source_hit")), "case_id")
    if mode == "retrieval":
        verdicts = verdicts.withColumn("generated", F.lit(None).cast("boolean"))
    else:
        generated = E.answer_verdicts(answer_metrics(engine, asked, hits, config)).withColumnRenamed("passed", "generated")
        verdicts = verdicts.join(generated, "case_id", "left")
        if mode == "generation":
            verdicts = verdicts.withColumn("passed", F.coalesce("generated", F.lit(False)))
    return E.meets(E.report(verdicts), config)


def text_report(row: dict) -> str:
    share = lambda x: f"{100 * x:.0f} %"
    return "\n".join([
        f"{row['passed']}/{row['cases']} cases passed ({share(row['pass_rate'])})", f"mandatory {share(row['mandatory_rate'])}, negative {share(row['negative_rate'])}",
        f"source hit {share(row['source_hit_rate'])}, generation {share(row['generation_rate'])}", "accepted" if row["accepted"] else "not accepted",
    ])
