import io
import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera import evaluation
from tessera.operators import build, evaluate, ingest, sync
from tessera.operators import index as I
from tessera.service import AdmissionGate, Busy, Engine, asset_file, parse_frame, source_text, stream
from tessera.sources import golden, parsers
from tessera.streaming import ingest as streaming


def workbook():
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Rails" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>net</t></si><si><t>a|b</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row/><row><c r="A3"><v>3.3</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def document():
    out = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {ns}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Power</w:t></w:r></w:p><w:p><w:r><w:t>Rail </w:t><w:t>text</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


@pytest.fixture
def raw(tmp_path):
    root = tmp_path / "raw"
    files = {
        "p1/b1/note/alpha.md": b"# Alpha\r\nThe regulator gives 3.3 V on the LCD header.\r\n", "p1/common/sop/beta.txt": b"How to debug the bootloader with a probe.", "global/datasheet/gamma.md": b"# Gamma\nGeneral part data for the TPS62840.",
        "p1/b1/note/rails.xlsx": workbook(), "p1/b1/note/memo.docx": document(), "p1/b1/note/broken.docx": b"no zip", "p1/b1/misc/x.md": b"x", "p1/b1/note/.hidden.md": b"x", "p1/b1/note/pic.png": b"x",
    }
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return root


def test_end_to_end(spark, raw, tmp_path):
    store = I.Store(spark, str(tmp_path / "index"))
    first = build.sync_index(spark, str(raw), store)
    assert first["index"] == 5 and first["quarantined"] == 3
    assert build.sync_index(spark, str(raw), store) == {"index": 0, "unchanged": 5, "removed": 0, "quarantined": 3}
    assert store.versions() == [1]
    (raw / "p1/b1/note/alpha.md").write_bytes(b"# Alpha\nNow the rail is 1.8 V and much longer than before.\n")
    (raw / "p1/common/sop/beta.txt").unlink()
    changed = build.sync_index(spark, str(raw), store)
    assert (changed["index"], changed["unchanged"], changed["removed"]) == (1, 3, 1)
    assert store.versions() == [1, 2]
    engine = Engine(spark, store)
    answer = engine.query({"question": "rail 1.8 V", "project": "p1", "build": "b1"})
    assert not answer["insufficient_context"] and answer["citations"]
    assert any("alpha" in c["source_file"] for c in answer["citations"])
    chat = engine.complete({"messages": [{"role": "user", "content": "rail voltage?"}], "project": "p1"})
    assert chat["choices"][0]["message"]["content"]
    cases = [
        {"case_id": "Q-001", "question": "rail 1.8 V", "mandatory": True, "project": "p1", "build": "b1", "required_sources": ["data/processed/p1/b1/note/alpha.md"], "facts": ["1.8 V"], "paraphrases": ["the rail"]},
        {"case_id": "Q-002", "question": "zebra quagga okapi", "category": "negative", "project": "p1", "build": "b1"},
    ]
    (tmp_path / "golden.jsonl").write_text("\n".join(map(json.dumps, cases)))
    row = evaluation.run(engine, golden.load(spark, str(tmp_path / "golden.jsonl")), "both").first().asDict()
    assert (row["cases"], row["passed"], row["source_hit_rate"], row["negative_rate"]) == (2, 2, 1.0, 1.0) and row["accepted"]
    assert evaluation.text_report(row).startswith("2/2 cases passed")
    with pytest.raises(ValueError):
        evaluation.run(engine, golden.load(spark, str(tmp_path / "golden.jsonl")), "all")
    build.write_processed(build.processed(ingest.raw_files(spark, str(raw)))[0], str(tmp_path / "mirror"))
    assert "1.8 V" in source_text(spark, str(tmp_path / "mirror"), "data/processed/p1/b1/note/alpha.md")
    assert source_text(spark, str(tmp_path / "mirror"), "none") is None
    assert asset_file(spark, str(raw), "p1/b1/note/pic.png").endswith("pic.png") and asset_file(spark, str(raw), "../x") is None and asset_file(spark, str(raw), "none.png") is None
    assert store.clear() == 4 and store.load("chunks") is None


def test_a_sync_reads_and_writes_only_what_changed(spark, raw, tmp_path, monkeypatch):
    store = I.Store(spark, str(tmp_path / "index"))
    build.sync_index(spark, str(raw), store)
    parsed = []
    keep = build.processed
    monkeypatch.setattr(build, "processed", lambda files, *more: parsed.append(sorted(r.path for r in files.select("path").collect())) or keep(files, *more))
    (raw / "p1/b1/note/[new] *.md").write_bytes(b"# New\nA file whose name looks like a pattern.\n")
    got = build.sync_index(spark, str(raw), store)
    assert (got["index"], got["unchanged"], got["removed"], got["quarantined"]) == (1, 5, 0, 3) and parsed == [["p1/b1/note/[new] *.md"]]
    assert spark.read.parquet(f"{tmp_path}/index/chunks/segment=2").count() == 1
    fresh = I.lexical(store.load("chunks"), "chunk_key", "index_text")
    (raw / "p1/common/sop/beta.txt").write_bytes(b"Changed, but not looked at.")
    (raw / "p1/b1/note/alpha.md").unlink()
    got = build.sync_index(spark, str(raw), store, under="p1/b1/")
    assert (got["index"], got["removed"]) == (0, 1) and build.sync_index(spark, str(raw), store, under="p1/b1/note/alpha.md")["removed"] == 0
    assert build.sync_index(spark, str(raw), store, under="p1/common/sop/beta.txt")["index"] == 1
    fresh = I.lexical(store.load("chunks"), "chunk_key", "index_text")
    rows = lambda df: sorted((r.token, r.df, round(r.idf, 9)) for r in df.collect())
    assert rows(store.load("tokens")) == rows(fresh.weights())
    for path in raw.rglob("*.*"):
        if path.is_file():
            path.unlink()
    assert build.sync_index(spark, str(raw), store) == {"index": 0, "unchanged": 0, "removed": 5, "quarantined": 0}
    assert store.load("chunks") is None and build.sync_index(spark, str(raw), store)["index"] == 0


def test_stream_follows_a_folder(spark, raw, tmp_path, monkeypatch):
    """A batch reads what is new, changes in place and deletions are seen, a batch run again does nothing."""
    store, checkpoint, did = I.Store(spark, str(tmp_path / "index")), str(tmp_path / "checkpoint"), []

    def turn(grace=600_000):
        streaming.watch(spark, str(raw), store, checkpoint, grace=grace, started=did).awaitTermination(180)
        return did[-1]

    assert turn(4_000) == {"index": 5, "removed": 0, "read": 6} and store.versions() == [1]
    (raw / "p1/b1/note/alpha.md").write_bytes(b"# Alpha\nOther text, of another length.\n")
    (raw / "p1/b1/note/new.md").write_bytes(b"# New\nA file that came later.\n")
    (raw / "p1/common/sop/beta.txt").unlink()
    read = []
    keep = ingest.raw_files
    monkeypatch.setattr(ingest, "raw_files", lambda spark, root, only=None, **more: read.append(only) or keep(spark, root, only, **more))
    time.sleep(4.5)
    changed = turn()
    assert (changed["index"], changed["read"]) == (2, 2) and sorted(read[0]) == ["p1/b1/note/alpha.md", "p1/b1/note/new.md"] and None not in read[:2]
    for _ in range(2):  # the timer of a deleted file fires in a batch after its end
        if changed["removed"] == 0:
            changed = turn()
    assert changed["removed"] == 1
    assert {r.target_file.rsplit("/", 1)[1] for r in store.load("manifest").filter("readable").collect()} == {"alpha.md", "new.md", "gamma.md", "rails.md", "memo.md"}
    version = store.versions()[-1]
    paths = spark.createDataFrame([("p1/b1/note/new.md",), ("p1/b1/note/alpha.md",), ("none.md",)], "path string")
    gone = spark.createDataFrame([("p1/common/sop/beta.txt",)], "path string")
    assert build.sync_files(spark, str(raw), store, paths, gone) == {"index": 0, "removed": 0, "read": 0} and store.versions()[-1] == version


def said(capsys):
    return json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_ingest_command_keeps_a_mirror(spark, raw, tmp_path, capsys):
    from tessera.__main__ import main

    mirror = str(tmp_path / "processed")
    assert main(["ingest", str(raw), "--mirror", mirror]) == 0
    first = said(capsys)
    assert (first["ingested"], first["unchanged"], first["removed"]) == (5, 0, 0)
    assert {r["path"]: r["reason"] for r in first["quarantined"]}["p1/b1/note/broken.docx"] == "no readable text"
    assert "LCD header" in source_text(spark, mirror, "data/processed/p1/b1/note/alpha.md")
    files = lambda part: {p.name for p in (tmp_path / "processed" / part).glob("*.parquet")}
    other = files("project=global/build=global/document_type=datasheet")
    (raw / "p1/b1/note/alpha.md").write_bytes(b"# Alpha\nChanged text of another size.\n")
    (raw / "p1/common/sop/beta.txt").unlink()
    main(["ingest", str(raw), "--mirror", mirror])
    again = said(capsys)
    # The broken file is tried again: nothing in the mirror says that it was read.
    assert (again["ingested"], again["unchanged"], again["removed"]) == (1, 3, 1)
    assert "Changed text" in source_text(spark, mirror, "data/processed/p1/b1/note/alpha.md") and source_text(spark, mirror, "data/processed/p1/common/sop/beta.md") is None
    assert files("project=global/build=global/document_type=datasheet") == other  # what did not change is not written
    assert build.read_processed(spark, mirror).count() == 4
    (raw / "p1/b1/note/memo.docx").unlink()
    main(["ingest", str(raw), "--mirror", mirror, "--under", "global/", "--force"])
    assert {k: v for k, v in said(capsys).items() if k != "quarantined"} == {"ingested": 1, "unchanged": 0, "removed": 0}
    main(["ingest", str(raw), "--mirror", mirror, "--under", "p1/b1/note/alpha.md"])
    assert said(capsys)["removed"] == 0 and build.read_processed(spark, mirror).count() == 4


def test_settings_reach_the_commands(spark, raw, tmp_path, capsys, monkeypatch):
    from tessera.__main__ import main

    settings = tmp_path / "settings.yaml"
    settings.write_text("retrieval:\n  final_k: 1\nchunking:\n  max_chars: 30\n  overlap_chars: 5\n  min_chars: 1\n")
    index = str(tmp_path / "index")
    main(["index", str(raw), "--index", index, "--config", str(settings)])
    capsys.readouterr()
    assert I.Store(spark, index).load("chunks").agg(F.max(F.length("content"))).first()[0] <= 45
    main(["query", "regulator rail", "--index", index, "--config", str(settings)])
    assert len(capsys.readouterr().out.strip().splitlines()) == 1
    monkeypatch.setenv("TESSERA_RETRIEVAL_FINAL_K", "3")
    main(["query", "regulator rail", "--index", index, "--config", str(settings)])
    assert len(capsys.readouterr().out.strip().splitlines()) == 3


def test_workbooks_and_documents():
    assert parsers.workbook_rows(workbook()) == [("Rails", [["net", "", "a|b"], [], ["3.3"]])]
    assert parsers.document_markdown(document()) == "## Power\n\nRail text"


def test_sheet_markdown(spark):
    rows = spark.createDataFrame([("d", 0, "Rails", [["net", "", "a|b"], [], ["3.3"]]), ("d", 1, "Empty", [[""]])], "doc string, sheet_no int, sheet string, rows array<array<string>>")
    assert ingest.sheet_markdown(rows).first()["content"] == "## Sheet: Rails\n\n| net |  | a\\|b |\n| --- | --- | --- |\n| 3.3 |  |  |"


def test_update_plan(spark):
    schema = "target_file string, source_mtime double, source_size long"
    now = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 2), ("c", 1.0, 1), (None, 1.0, 1)], schema)
    then = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 2), ("d", 1.0, 1)], schema)
    plan = sorted((r.target_file or "", r.action) for r in sync.update_plan(now, then).collect())
    assert plan == [("", "index"), ("a", "unchanged"), ("b", "index"), ("c", "index"), ("d", "removed")]
    assert {r.action for r in sync.update_plan(now, then, force=True).collect()} == {"index", "removed"}


def test_gate_turns_away():
    gate = AdmissionGate(concurrent=1, depth=0)
    with gate.admitted():
        assert gate.snapshot() == {"active": 1, "waiting": 0, "capacity": 1}
        with pytest.raises(Busy), gate.admitted():
            pass
    assert gate.snapshot()["active"] == 0


def test_stream_frames():
    frames = [parse_frame(f.strip()) for f in stream("x" * 450, status="searching")]
    assert frames[-1] == "[DONE]"
    assert "".join(f["choices"][0]["delta"].get("content", "") for f in frames[1:-1]) == "x" * 450


def test_empty_report_is_all_ones(spark):
    row = evaluate.report(spark.createDataFrame([], "case_id string, passed boolean, mandatory boolean, negative boolean, source_hit boolean, generated boolean")).first()
    assert (row.cases, row.pass_rate, row.mandatory_rate, row.generation_rate) == (0, 1.0, 1.0, 1.0)


def test_violations_are_named(spark):
    rows = spark.createDataFrame([("p", "b", "note", "", "s", -1)], "project string, build string, document_type string, title string, source_file string, page int")
    assert ingest.violations(rows).first()["broken"] == ["title missing", "page negative"]


def test_appendix_comes_once(spark):
    once = ingest.with_appendix(F.lit("report"), F.lit("LCD_D0 U1"))
    row = spark.range(1).select(ingest.with_appendix(once, F.lit("LCD_D0 U1")).alias("x")).first()["x"]
    assert row.count(ingest.APPENDIX) == 1 and "LCD_D0" in row
