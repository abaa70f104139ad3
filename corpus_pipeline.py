"""The corpus pipeline: language, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next stage's documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, packing, secrets, similar
from tessera.llm.shared import free_name, materialize, scratch, ship

WORDS, SIMILARITY = 5, 0.8
TOKENIZER = "byte_bpe_50k.json"
MASK = "[SECRET]"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned language explains go: those without letters, and those that a model
    without a language explains better than the best set of languages (see ``langid.accepts``).  All
    stay if no language can be learned."""
    ship(spark)
    return docs.filter(langid.accepted(langid.train(docs), F.col("text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id."""
    return similar.deduplicated(docs, WORDS, SIMILARITY)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; ``n_chars`` follows where a text changes."""
    spans = free_name(docs.columns, "spans")
    found = secrets.findings(docs, secrets.update_ledger(docs), out_col=spans)
    changed = F.size(spans) > 0
    found = found.withColumn("text", secrets.redact(F.col("text"), F.col(spans), MASK))
    n_chars = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage wrote for itself goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return docs


#: Likelihood models, sketches and byte-pair merges have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None
