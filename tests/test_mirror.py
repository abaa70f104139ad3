"""The mirror of files as a source and a sink."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import build
from tessera.sources import mirror as M

COLUMNS = "target_file string, content string, sidecar string"


@pytest.fixture
def source(spark):
    spark.dataSource.register(M.Mirror)
    # Filters go to Python sources only where that is allowed.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


GIVEN = [("data/processed/p1/b1/note/a.md", "Ä text\n", '{"title": "a"}'), ("data/processed/p1/common/sop/sub/b.md", "", None), ("data/processed/global/datasheet/c.md", "c", "{}"), ("data/processed/p2/b1/note/d.md", "d" * 100_000, "{}")]


def test_round_trip_and_filters(source, tmp_path):
    root = str(tmp_path / "mirror")
    source.createDataFrame(GIVEN, COLUMNS).repartition(3).write.format("mirror").mode("append").save(root)
    assert files(root) == sorted([*(n.removeprefix(M.PREFIX) for n, *_ in GIVEN), "global/datasheet/c.md.meta.json", "p1/b1/note/a.md.meta.json", "p2/b1/note/d.md.meta.json"])
    read = source.read.format("mirror").load(root)
    assert rows(read.select("target_file", "content", "sidecar")) == sorted(GIVEN, key=str) or {tuple(r) for r in read.select("target_file", "content", "sidecar").collect()} == set(GIVEN)
    assert {(r.project, r.build, r.document_type) for r in read.collect()} == {("p1", "b1", "note"), ("p1", "common", "sop"), ("global", "global", "datasheet"), ("p2", "b1", "note")}
    assert [r.target_file for r in read.filter("project = 'p1' and document_type in ('sop', 'x')").collect()] == [GIVEN[1][0]]
    assert read.filter("build = 'b1' and length(content) > 50").select("project").collect()[0].project == "p2" and read.filter("project = 'none'").count() == 0


def test_folders_that_filters_exclude_are_not_listed(tmp_path, monkeypatch):
    for name, *_ in GIVEN:
        path = tmp_path / name.removeprefix(M.PREFIX)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    reader = M.MirrorReader(str(tmp_path))
    assert list(reader.pushFilters([M.EqualTo(("project",), "p1"), M.In(("build",), ("b1", "b2")), M.EqualTo(("content",), "x")])) == [M.EqualTo(("content",), "x")]
    os.chmod(tmp_path / "p2", 0)
    assert [p for part in reader.partitions() for p in part.paths] == [str(tmp_path / "p1/b1/note/a.md")]
    os.chmod(tmp_path / "p2", 0o755)
    monkeypatch.setattr(M, "PER_TASK", 2)
    assert [len(p.paths) for p in M.MirrorReader(str(tmp_path)).partitions()] == [2, 2]


def test_a_failed_write_leaves_nothing(source, tmp_path):
    root = str(tmp_path / "mirror")
    source.createDataFrame(GIVEN[:2], COLUMNS).write.format("mirror").mode("append").save(root)
    before = files(root)
    for bad in (["../x.md"], ["/etc/x"], [None], ["p/../../x"], ["p/.hidden/x.md"], ["p1/n.md", "p1/n.md"]):
        made = source.createDataFrame([("p1/b1/note/new.md", "n", None), *((b, "n", None) for b in bad)], COLUMNS).coalesce(1)
        with pytest.raises(PySparkException):
            made.write.format("mirror").mode("overwrite").save(root)
        assert files(root) == before and not os.path.exists(f"{root}/{M.STAGING}/x")
    with pytest.raises(PySparkException):
        source.createDataFrame([("a",)], "target_file string").write.format("mirror").mode("append").save(root)


def test_append_replaces_and_overwrite_clears(source, tmp_path):
    root = str(tmp_path / "mirror")
    save = lambda given, mode: source.createDataFrame(given, COLUMNS).write.format("mirror").mode(mode).save(root)
    save(GIVEN, "append")
    save([(GIVEN[0][0], "new", None)], "append")
    read = source.read.format("mirror").load(root)
    assert read.count() == 4 and [(r.content, r.sidecar) for r in read.filter("project = 'p1' and build = 'b1'").collect()] == [("new", None)]
    save(GIVEN[2:3], "overwrite")
    assert files(root) == ["global/datasheet/c.md", "global/datasheet/c.md.meta.json"]


def test_ingested_documents_as_files(source, tmp_path):
    given = source.createDataFrame([("p/b/note/a.md", 1.5, 2, b"# A\nTPS62840 at 3.3V")], "path string, mtime double, size long, content binary")
    build.export_files(build.processed(given)[0], str(tmp_path / "out"))
    row = source.read.format("mirror").load(str(tmp_path / "out")).withColumn("m", build.ingest.metadata_from_json(F.col("sidecar"))).first()
    assert row.target_file == "data/processed/p/b/note/a.md" and row.m.source_mtime == 1.5 and "TPS62840" in row.m.keywords
