"""Golden question sets from YAML or JSON lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "case_id string, question string, category string, mandatory boolean, negative boolean, project string, build string, required_sources array<string>, "
    "forbidden_sources array<string>, facts array<string>, must_not array<string>, paraphrases array<string>"
)
LISTS = ("required_sources", "forbidden_sources", "facts", "must_not", "paraphrases")


def _row(case: dict) -> dict:
    filters = case.get("filters") or {}
    category = case.get("category", "")
    row = {
        "case_id": case.get("case_id") or case.get("id"), "question": case.get("question"), "category": category, "mandatory": bool(case.get("mandatory", False)), "negative": bool(case.get("negative", category == "negative")),
        "project": case.get("project") or filters.get("project"), "build": case.get("build") or filters.get("build"),
        "facts": case.get("facts") or case.get("expected_facts"), "must_not": case.get("must_not") or case.get("must_not_contain"), **{k: case.get(k) for k in ("required_sources", "forbidden_sources", "paraphrases")},
    }
    return row | {k: list(row[k] or []) for k in LISTS}


def load(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a dataset file; a golden set is written by hand and small."""
    with open(path, encoding="utf-8") as file:
        if path.endswith((".yaml", ".yml")):
            import yaml

            cases = (yaml.safe_load(file) or {}).get("cases", [])
        else:
            cases = [json.loads(line) for line in file if line.strip()]
    return spark.createDataFrame([_row(c) for c in cases], SCHEMA)
