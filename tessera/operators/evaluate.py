"""Golden-set evaluation: metrics per question, verdicts per case, one report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.schema import EVALUATION, Evaluation


def selected(cases: DataFrame, ids: list[str] | None = None, categories: list[str] | None = None, mandatory_only: bool = False) -> DataFrame:
    out = cases if not ids else cases.filter(F.col("case_id").isin(ids))
    out = out if not categories else out.filter(F.col("category").isin(categories))
    return out.filter("mandatory") if mandatory_only else out


def questions(cases: DataFrame) -> DataFrame:
    """(case_id, variant, question): the question and its paraphrases."""
    every = F.concat(F.array("question"), F.coalesce("paraphrases", F.array().cast(X.STRINGS)))
    return cases.select("case_id", F.posexplode(every).alias("variant", "question"))


def source_hits(hits: DataFrame, required: DataFrame) -> DataFrame:
    """``hits`` (qid, rank, source_file) and ``required`` (qid, source) to (qid, source_hit,
    first_rank, matched).  Paths match when equal or when name and folder agree; so the join is on
    the question and the name."""
    found = hits.select("qid", "rank", "source_file", X.stem(X.normal_path(F.col("source_file"))).alias("stem"))
    wanted = required.select("qid", "source", X.stem(X.normal_path(F.col("source"))).alias("stem"))
    both = wanted.join(found, ["qid", "stem"]).filter(X.path_matches(F.col("source"), F.col("source_file")))
    grouped = both.groupBy("qid").agg(F.min("rank").alias("first_rank"), F.array_sort(F.collect_set("source")).alias("matched"))
    return required.select("qid").distinct().join(grouped, "qid", "left").select("qid", F.col("first_rank").isNotNull().alias("source_hit"), "first_rank", F.coalesce("matched", F.array().cast(X.STRINGS)).alias("matched"))


def combined_text(hits: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rank", "content")))
    return hits.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n").alias("text"))


def fact_recall(texts: DataFrame, facts_col: str = "facts", text_col: str = "text") -> DataFrame:
    """``texts`` with facts_found, facts_total and fact_recall; without facts the recall is one."""
    found = F.size(F.filter(F.col(facts_col), lambda f: X.fact_in(f, F.coalesce(F.col(text_col), F.lit("")))))
    total = F.size(facts_col)
    return texts.withColumns({"facts_found": found, "facts_total": total, "fact_recall": F.when(total == 0, 1.0).otherwise(found / total)})


def forbidden(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` (qid, project, build, sources, words) to (qid, scope_hit, source_hit, text_hit)."""
    both = rules.withColumnsRenamed({"project": "f_project", "build": "f_build"}).join(hits, "qid", "left")
    scope = F.coalesce((F.col("project") == F.col("f_project")) & (F.col("build") == F.col("f_build")), F.lit(False))
    source = F.coalesce(F.exists("sources", lambda s: X.path_matches(s, F.coalesce("source_file", F.lit("")))), F.lit(False))
    text = F.coalesce(F.exists("words", lambda w: F.contains(F.coalesce("content", F.lit("")), w)), F.lit(False))
    return both.groupBy("qid").agg(F.some(scope).alias("scope_hit"), F.some(source).alias("source_hit"), F.some(text).alias("text_hit"))


def case_verdicts(metrics: DataFrame, config: Evaluation = EVALUATION) -> DataFrame:
    """``metrics`` (case_id, negative, source_hit, fact_recall, top_score, chunk_count, forbidden) a row
    per variant, to (case_id, passed, stable)."""
    quiet = (F.col("chunk_count") == 0) | F.col("top_score").isNull() | (F.col("top_score") <= config.negative_ceiling)
    grouped = metrics.groupBy("case_id").agg(
        F.some("negative").alias("negative"), F.every(quiet).alias("quiet"), F.some("forbidden").alias("forbidden"), F.some("source_hit").alias("hit"),
        F.every(F.col("fact_recall") >= config.fact_recall).alias("facts"), stable().alias("stable"),
    )
    passed = F.when(F.col("negative"), F.col("quiet") & ~F.col("forbidden")).otherwise(F.col("hit") & F.col("facts") & ~F.col("forbidden"))
    return grouped.select("case_id", "negative", passed.alias("passed"), "stable")


def stable() -> Column:
    """All variants agree on the hit and, to two digits, on the recall (rounded half to even)."""
    return (F.count_distinct("source_hit") == 1) & (F.count_distinct(F.bround("fact_recall", 2)) == 1)


def answer_metrics(rows: DataFrame, config: Evaluation = EVALUATION) -> DataFrame:
    """``rows`` (case_id, negative, answer, insufficient, facts, cited, must_not: arrays) with citation_hit,
    refused, fact_recall, violated, preview and passed."""
    scored = fact_recall(rows, "facts", "answer").withColumns({
        "refused": X.is_refusal(F.col("answer"), F.col("insufficient")), "violated": F.exists("must_not", lambda w: F.contains("answer", w)), "preview": X.preview(F.col("answer"), config.preview_chars),
        "citation_hit": F.exists("cited", lambda c: F.exists("required", lambda r: X.path_matches(r, c))),
    })
    good = ~F.col("refused") & (F.col("citation_hit") | (F.size("required") == 0)) & (F.col("fact_recall") >= config.fact_recall)
    return scored.withColumn("passed", ~F.col("violated") & F.when(F.col("negative"), F.col("refused")).otherwise(good))


def answer_verdicts(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("case_id").agg(F.every("passed").alias("passed"))


def report(cases: DataFrame) -> DataFrame:
    """One row of rates over ``cases`` (case_id, passed, mandatory, negative, source_hit, generated:
    boolean or null); a rate over nothing is one."""
    rate = lambda good, of: F.coalesce(F.try_divide(F.count_if(good & of), F.count_if(of)), F.lit(1.0))
    passed, always = F.col("passed"), F.lit(True)
    return cases.agg(
        F.count("*").alias("cases"), F.count_if(passed).alias("passed"), rate(passed, always).alias("pass_rate"), rate(passed, F.col("mandatory")).alias("mandatory_rate"),
        rate(passed, F.col("negative")).alias("negative_rate"), rate(F.col("source_hit"), ~F.col("negative")).alias("source_hit_rate"), rate(F.coalesce("generated", F.lit(False)), F.col("generated").isNotNull()).alias("generation_rate"),
    )


def meets(row: DataFrame, config: Evaluation = EVALUATION) -> DataFrame:
    return row.withColumn("accepted", (F.col("mandatory_rate") >= config.mandatory_rate) & (F.col("negative_rate") >= config.negative_rate))


CASE_RULES = [("bad id", "not coalesce(case_id rlike '^Q-[0-9]{3}$', false)"), ("no question", "coalesce(trim(question), '') = ''"), ("no source", "not negative and size(required_sources) = 0")]


def invalid_cases(cases: DataFrame) -> DataFrame:
    """(case_id, broken): the dataset rules that each case breaks."""
    checks = [F.when(F.expr(test), F.lit(name)) for name, test in CASE_RULES]
    return cases.select("case_id", F.filter(F.array(*checks), lambda x: x.isNotNull()).alias("broken")).filter(F.size("broken") > 0)


def report_json(row: DataFrame) -> DataFrame:
    rounded = [F.round(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in row.dtypes]
    return row.select(F.to_json(F.struct(*rounded)).alias("report"))
