import json

import pytest
from pyspark.sql import functions as F

from tessera import config
from tessera.operators import answer, build, pages
from tessera.sources import golden


def test_defaults_file_and_environment(tmp_path):
    file = tmp_path / "c.yaml"
    file.write_text("retrieval:\n  final_k: 5\n  quotas: [3, 1, 1]\napi:\n  timeout_seconds: 0\n")
    got = config.load(str(file), {"TESSERA_RETRIEVAL_FINAL_K": "4", "TESSERA_GENERATION_QUERY_REWRITE": "no", "TESSERA_RETRIEVAL_MINIMUM_SCORE": "-1.5"})
    assert (got.retrieval.final_k, got.retrieval.quotas, got.retrieval.minimum_score) == (4, (3, 1, 1), -1.5)
    assert got.api.timeout_seconds is None and not got.generation.query_rewrite
    assert config.load(None, {}) == config.Config()
    assert not config.for_evaluation(got).generation.assistant_fallback
    file.write_text("retrieval:\n  wrong: 1\n")
    with pytest.raises(ValueError, match="wrong"):
        config.load(str(file), {})


def test_golden_sets(spark, tmp_path):
    (tmp_path / "q.yaml").write_text("cases:\n- id: Q-001\n  question: why?\n  category: fact\n  filters: {project: p}\n  expected_facts: [a]\n- id: Q-002\n  question: no\n  category: negative\n")
    rows = golden.load(spark, str(tmp_path / "q.yaml")).orderBy("case_id").collect()
    assert (rows[0].project, rows[0].facts, rows[0].negative, rows[1].negative) == ("p", ["a"], False, True)
    (tmp_path / "q.jsonl").write_text(json.dumps({"case_id": "Q-003", "question": "x"}) + "\n")
    assert golden.load(spark, str(tmp_path / "q.jsonl")).first().paraphrases == []


def test_pdfs_through_a_reader(spark):
    def reader(path, content):
        if content == b"broken":
            return []
        return [{"page": 1, "text": "LCD & TOUCH\nLCD_D1 LCD_D0 LCD_SCL GND U7", "lines": 3, "image_ratio": 0.0, "scanned": None, "described": None}, {"page": 2, "text": "", "lines": 80, "image_ratio": 0.0, "scanned": "scanned words", "described": '```json\n{"markdown": "| a table |", "nets": ["A"'}]

    files = spark.createDataFrame([(f"p/b/{t}/f.pdf", 1.0, 2, b"x") for t in ("note", "datasheet", "schematic")] + [("p/b/note/bad.pdf", 1.0, 2, b"broken")], "path string, mtime double, size long, content binary")
    documents, quarantine = build.processed(files, reader=reader)
    text = {r.document_type: r.content for r in documents.collect()}
    assert text["note"].startswith("# f\n\n## Page 1") and "scanned words" in text["note"]
    assert "| a table |" in text["datasheet"] and "### Page 2 OCR" in text["datasheet"]
    assert text["schematic"].count("## 5. OCR") == 2 and text["schematic"].index("- `LCD_D0`") < text["schematic"].index("- `LCD_D1`")
    assert [r.path for r in quarantine.collect()] == ["p/b/note/bad.pdf"]
    assert build.processed(files)[1].count() == 4


def test_described_schematics_get_the_appendix_once(spark):
    rows = spark.createDataFrame([("d", "T", 1, "LCD_D0", 0, 0.0, None, "report"), ("d", "T", 2, "GND", 0, 0.0, None, None)], pages.PAGES).withColumn("project", F.lit("p"))
    content = pages.schematic_documents(rows, "vlm_plus_ocr").first().content
    assert content.count("## 5. OCR") == 2 and "\n\n---\n\n" in content and "report\n\n## 5. OCR" in content


def test_mirror_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("p/b/note/a.md", 1.5, 2, b"# A\nTPS62840 at 3.3V")], "path string, mtime double, size long, content binary")
    build.write_processed(build.processed(files)[0], str(tmp_path / "mirror"))
    row = build.read_processed(spark, str(tmp_path / "mirror")).first()
    assert row.metadata.source_mtime == 1.5 and "TPS62840" in row.metadata.keywords and row.metadata.nets is None


def test_prepared_query(spark):
    rows = spark.createDataFrame([("and its rail?", "h")], "question string, history string")
    out = answer.prepared(rows, lambda ps: ["QUERY: rail of p1 b1\nTASK: debug\nPRODUCT: p1\nREVISION: none\nLAYER: board"] * len(ps), "- p1: b1").first()
    assert (out.retrieval_query, out.task, out["product"], out.revision, out.layer) == ("rail of p1 b1", "debug", "p1", None, "build")
