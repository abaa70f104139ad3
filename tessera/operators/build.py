"""From a raw folder to a versioned index: scan, parse, chunk, embed, save, and only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import chunk, hooks, ingest, pages, sync
from tessera.operators import index as I
from tessera.operators.durable import materialize
from tessera.schema import CHUNKING, LAYOUT, Chunking, Layout
from tessera.shipping import ship
from tessera.sources import mirror as mirror_files
from tessera.sources import parsers


def processed(files: DataFrame, layout: Layout = LAYOUT, reader: pages.PageReader | None = None, schematic_mode: str = "ocr_only") -> tuple[DataFrame, DataFrame]:
    """``files`` (path, mtime, size, content) to (documents, quarantine (path, reason)).

    PDFs need a ``reader`` hook; without one they are quarantined, as other external formats are."""
    fit, skipped = ingest.supported(files, layout)
    plain = fit.filter("parser = 'markdown'").withColumn("text", X.plain_markdown(F.decode("content", "UTF-8")))
    books = fit.filter("parser = 'excel'")
    tables = ingest.sheet_markdown(parsers.sheets_of(books))
    books = books.join(tables.withColumnsRenamed({"doc": "path", "content": "text"}), "path", "left")
    words = fit.filter("parser = 'docx'")
    words = words.join(parsers.words_of(words).withColumnRenamed("doc", "path").select("path", "text"), "path", "left")
    both = plain.unionByName(books).unionByName(words)
    read = ["markdown", "excel", "docx"]
    if reader is not None:
        for kind, made in (("prose_pdf", pages.prose_documents), ("datasheet_pdf", pages.datasheet_documents), ("schematic_pdf", lambda p: pages.schematic_documents(p.withColumn("project", F.split_part("doc", F.lit("/"), F.lit(1))), schematic_mode))):
            own = fit.filter(F.col("parser") == kind)
            texts = made(pages.read_pages(own, reader)).select(F.col("doc").alias("path"), F.col("content").alias("text"))
            both = both.unionByName(own.join(texts, "path", "left"))
            read.append(kind)
    good = both.filter("text is not null")
    bad = both.filter("text is null").select("path", F.lit("no readable text").alias("reason"))
    later = fit.filter(~F.col("parser").isin(read)).select("path", F.lit("needs a parser hook").alias("reason"))
    documents = good.select(
        F.concat(F.lit("data/processed/"), ingest.mirror_path(F.col("path"))).alias("target_file"), "path", X.stem(ingest.mirror_path(F.col("path"))).alias("stem"), "project", "build", "document_type", "title", "source_file",
        F.col("mtime").alias("source_mtime"), F.col("size").alias("source_size"), X.keywords(F.col("text")).alias("keywords"), F.col("text").alias("content"),
    )
    return documents, skipped.unionByName(bad).unionByName(later)


MIRROR = "target_file string, path string, stem string, title string, source_file string, source_mtime double, source_size long, keywords array<string>, content string, sidecar string, project string, build string, document_type string"
#: Folders of the mirror: a scope and a type each.
MIRROR_PARTS = ("project", "build", "document_type")


def write_processed(documents: DataFrame, root: str) -> None:
    """The processed mirror: texts with their metadata as a sidecar column, by scope and type.  Scopes and types
    that ``documents`` has are written anew, others stay."""
    rows = documents.withColumn("sidecar", ingest.metadata_json(documents))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*MIRROR_PARTS).parquet(root)


def read_processed(spark: SparkSession, root: str) -> DataFrame:
    """The mirror back, metadata read leniently from the sidecar."""
    rows = spark.read.schema(MIRROR).parquet(root)  # folders named by numbers stay texts
    return rows.withColumn("metadata", ingest.metadata_from_json(F.coalesce("sidecar", F.lit("{}"))))


def export_files(documents: DataFrame, root: str, mode: str = "append") -> None:
    """The mirror as files, a text and a ``.meta.json`` for each document (see ``sources.mirror``)."""
    spark = documents.sparkSession
    ship(spark)
    spark.dataSource.register(mirror_files.Mirror)
    rows = documents.select("target_file", "content", ingest.metadata_json(documents).alias("sidecar"))
    rows.write.format("mirror").mode(mode).save(root)


def _exists(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(path) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(path))


def ingest_folder(spark: SparkSession, raw_root: str, mirror: str, layout: Layout = LAYOUT, *, force: bool = False, reader: pages.PageReader | None = None, under: str = "") -> dict[str, object]:
    """Bring the processed mirror up to date with a raw folder: parse what is new or changed (all, with
    ``force``), drop what is gone, and say how many documents took which action and what could not be read.

    Only the scopes and types with a change are written, each from what stays and what is new; a failed
    write leaves them as they were.  ``under`` limits this to one folder (with a slash at its end) or file."""
    ship(spark)
    fit, skipped = ingest.supported(ingest.raw_files(spark, raw_root).select("path", "mtime", "size"), layout)
    readable = PARSED if reader is None else [*PARSED, "prose_pdf", "datasheet_pdf", "schematic_pdf"]
    inside = F.startswith("path", F.lit(under)) if under.endswith("/") else (F.col("path") == under) if under else F.lit(True)
    raw = materialize(fit.filter(inside & F.col("parser").isin(readable)).select("path", "mtime", "size"), "raw-files")
    old = read_processed(spark, mirror) if _exists(spark, mirror) else None
    if old is None:
        known = raw.select("path", "mtime", "size").limit(0).withColumn("has_sidecar", F.lit(True))
    else:
        known = old.select("path", F.col("metadata.source_mtime").alias("mtime"), F.col("metadata.source_size").alias("size"), (F.col("sidecar").isNotNull() & F.col("content").isNotNull()).alias("has_sidecar"))
    plan = materialize(sync.needs_ingest(raw, known), "ingest-plan")
    due = plan.filter(F.col("ingest") | F.lit(force)).select("path")
    prefix = under if under.endswith("/") else ""
    gone = known.select("path").limit(0) if under and not prefix else sync.orphans(known.select("path"), fit.select("path"), prefix)
    gone = materialize(gone, "orphans")
    few = [r["path"] for r in due.limit(NAMED_FILES + 1).collect()]
    counts = {"ingested": 0, "unchanged": plan.count() - due.count(), "removed": gone.count()}
    later = fit.filter(inside & ~F.col("parser").isin(readable)).select("path", F.lit("needs a parser hook").alias("reason"))
    bad = skipped.filter(inside).unionByName(later)
    changed = None
    if few:
        files = ingest.raw_files(spark, raw_root, few) if len(few) <= NAMED_FILES else ingest.raw_files(spark, raw_root).join(due, "path", "left_semi")
        documents, unread = processed(files, layout, reader)
        changed = materialize(documents, "ingested-documents")
        counts["ingested"] = changed.count()
        bad = bad.unionByName(unread)
    if changed is not None or counts["removed"]:
        parts = old.join(gone, "path", "left_semi").select(*MIRROR_PARTS) if old is not None else None
        if changed is not None:
            parts = changed.select(*MIRROR_PARTS) if parts is None else parts.unionByName(changed.select(*MIRROR_PARTS))
        parts = materialize(parts.distinct(), "mirror-parts")
        rows = changed
        if old is not None:
            kept = old.drop("metadata", "sidecar").join(parts, [*MIRROR_PARTS], "left_semi").join(due, "path", "left_anti").join(gone, "path", "left_anti")
            rows = kept if changed is None else kept.unionByName(changed)
        rows = materialize(rows, "mirror-rows")  # read before it is overwritten
        write_processed(rows, mirror)
        _drop_empty(spark, mirror, parts.join(rows.select(*MIRROR_PARTS).distinct(), [*MIRROR_PARTS], "left_anti"))
    told = [r.asDict() for r in bad.orderBy("path").limit(1000).collect()]
    return counts | {"quarantined": told}


def _drop_empty(spark: SparkSession, mirror: str, parts: DataFrame) -> None:
    """Folders whose last document is gone."""
    for r in parts.collect():  # a row a scope and type
        path = spark._jvm.org.apache.hadoop.fs.Path("/".join([mirror.rstrip("/"), *(f"{c}={r[c]}" for c in MIRROR_PARTS)]))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def chunk_table(documents: DataFrame, config: Chunking = CHUNKING, embedder: hooks.Embedder = hooks.hashing_embedder) -> DataFrame:
    """Chunks with their document's metadata, index text, vector and a key of (target_file, seq)."""
    pieces = chunk.chunk_documents(documents, config)
    meta = documents.select("target_file", "project", "build", "document_type", "title", "source_file", "source_mtime", "source_size", "keywords")
    rows = pieces.join(meta, "target_file").withColumn("index_text", X.index_text(F.col("heading_path"), F.col("content")))
    return hooks.embedded(rows, "index_text", embedder).withColumn("chunk_key", F.xxhash64("target_file", "seq"))


#: Changed files up to which a sync names them to the reader, which looks each up; beyond, it reads the
#: folder and keeps those that changed.
NAMED_FILES = 500
PARSED = ["markdown", "excel", "docx"]


def sync_index(spark: SparkSession, raw_root: str, store: I.Store, layout: Layout = LAYOUT, config: Chunking = CHUNKING, *, force: bool = False, reader: pages.PageReader | None = None, under: str = "") -> dict[str, int]:
    """Bring the index up to date with a raw folder; returns how many documents took which action.

    ``under`` limits this to one folder below (if it ends with a slash) or to one file, of which nothing is
    removed; all other documents stay as they are.  The plan needs names, times and sizes alone.  Only what it wants indexed is read, parsed and written;
    files that cannot be read are remembered as such and tried again when they change.  A folder without
    documents clears the index."""
    ship(spark)
    settings = I.config_hash(chunking=config, reader=reader is not None)
    fit, skipped = ingest.supported(ingest.raw_files(spark, raw_root).select("path", "mtime", "size"), layout)
    wanted = F.col("parser").isin(PARSED) | F.lit(reader is not None)
    target = F.concat(F.lit("data/processed/"), ingest.mirror_path(F.col("path")))
    prints = fit.filter(wanted).select(target.alias("target_file"), "path", F.col("mtime").alias("source_mtime"), F.col("size").alias("source_size"), F.lit(settings).alias("config_hash"))
    inside = F.startswith("path", F.lit(under)) if under.endswith("/") else (F.col("path") == under) if under else F.lit(True)
    prints = prints.filter(inside)
    manifest = store.load("manifest")
    known = prints.limit(0).withColumn("readable", F.lit(True)) if manifest is None else manifest
    # What another configuration made matches nothing.
    stored = known.filter(inside).select("target_file", F.when(F.col("config_hash") == settings, F.col("source_mtime")).alias("source_mtime"), "source_size")
    plan = sync.update_plan(prints, stored, force=force)
    plan = plan.unionAll(known.filter(~inside).select("target_file", F.lit("unchanged")))
    if under and not under.endswith("/"):
        plan = plan.withColumn("action", F.when(F.col("action") == "removed", "unchanged").otherwise(F.col("action")))
    plan = materialize(plan, "sync-plan")
    actions = {row["action"]: row["count"] for row in plan.groupBy("action").count().collect()}
    due, gone, same = (plan.filter(F.col("action") == a).select("target_file") for a in ("index", "removed", "unchanged"))
    passed_over = skipped.count() + fit.filter(~wanted).count()
    if manifest is not None and not actions.get("index") and not actions.get("unchanged"):
        result = {"index": 0, "unchanged": 0, "removed": _readable(known, gone), "quarantined": passed_over}
        store.clear()
        return result
    if not actions.get("index") and not actions.get("removed"):
        return {"index": 0, "unchanged": _readable(known, same), "removed": 0, "quarantined": passed_over + known.filter("not readable").count()}
    changed = materialize(prints.join(due, "target_file", "left_semi"), "changed-files")
    if actions.get("index", 0) <= NAMED_FILES:
        files = ingest.raw_files(spark, raw_root, [r["path"] for r in changed.select("path").collect()])
    else:
        files = ingest.raw_files(spark, raw_root).filter(inside)
        if actions.get("unchanged"):
            files = files.join(changed.select("path"), "path", "left_semi")
    documents, _ = processed(files, layout, reader)
    documents = materialize(documents, "parsed-documents")
    tried = changed.join(documents.select("target_file", F.lit(True).alias("readable")), "target_file", "left").withColumn("readable", F.coalesce("readable", F.lit(False)))
    kept = None if manifest is None else known.join(same, "target_file", "left_semi")
    store.save(chunk_table(documents, config), tried, kept)
    now = store.load("manifest")
    result = {"index": documents.count(), "unchanged": _readable(known, same), "removed": _readable(known, gone)}
    return result | {"quarantined": passed_over + now.filter("not readable").count()}


def sync_files(spark: SparkSession, raw_root: str, store: I.Store, due: DataFrame, gone: DataFrame, layout: Layout = LAYOUT, config: Chunking = CHUNKING, *, reader: pages.PageReader | None = None) -> dict[str, int]:
    """Bring the index up to date for the files ``due`` (path) and ``gone`` (path) alone; the folder is not
    looked at.  Files that the index holds with the same time and size are left out, so that it does not
    matter how often this runs."""
    ship(spark)
    settings = I.config_hash(chunking=config, reader=reader is not None)
    manifest = store.load("manifest")
    named = [r["path"] for r in due.select("path").distinct().limit(NAMED_FILES + 1).collect()]
    result = {"index": 0, "removed": 0, "read": 0}
    documents = tried = None
    if named:
        # What vanished meanwhile is no file to read; a later batch tells that it is gone.
        files = ingest.raw_files(spark, raw_root, named, missing=True) if len(named) <= NAMED_FILES else ingest.raw_files(spark, raw_root).join(due, "path", "left_semi")
        fit, _ = ingest.supported(files.select("path", "mtime", "size"), layout)
        target = F.concat(F.lit("data/processed/"), ingest.mirror_path(F.col("path")))
        wanted = F.col("parser").isin(PARSED) | F.lit(reader is not None)
        prints = fit.filter(wanted).select(target.alias("target_file"), "path", F.col("mtime").alias("source_mtime"), F.col("size").alias("source_size"), F.lit(settings).alias("config_hash"))
        if manifest is not None:
            prints = prints.join(manifest.select("target_file", "source_mtime", "source_size", "config_hash"), ["target_file", "source_mtime", "source_size", "config_hash"], "left_anti")
        tried = materialize(prints, "due-files")
        paths = [r["path"] for r in tried.select("path").limit(NAMED_FILES + 1).collect()]
        if paths:
            result["read"] = tried.count()
            files = ingest.raw_files(spark, raw_root, paths, missing=True) if len(paths) <= NAMED_FILES else files.join(tried.select("path"), "path", "left_semi")
            documents = materialize(processed(files, layout, reader)[0], "parsed-documents")
            tried = tried.join(documents.select("target_file", F.lit(True).alias("readable")), "target_file", "left").withColumn("readable", F.coalesce("readable", F.lit(False)))
    lost = None
    if manifest is not None:
        lost = materialize(manifest.join(gone.select("path").distinct(), "path", "left_semi").select("target_file"), "gone-files")
        result["removed"] = lost.count()
    if documents is None and not result["removed"]:
        return result
    if documents is None:
        documents = processed(ingest.raw_files(spark, raw_root).limit(0), layout, reader)[0]
        tried = manifest.limit(0).drop("segment", "built_at")
    result["index"] = documents.count()
    kept = None
    if manifest is not None:
        kept = manifest.join(tried.select("target_file").unionAll(lost), "target_file", "left_anti")
    store.save(chunk_table(documents, config), tried, kept)
    return result


def _readable(manifest: DataFrame, targets: DataFrame) -> int:
    return manifest.filter("readable").join(targets, "target_file", "left_semi").count()
