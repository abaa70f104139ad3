"""From raw files to processed documents: paths, dispatch, validation, pages and assembly.

Bad rows go to a quarantine with the reason; they never abort a run.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.schema import LAYOUT, METADATA, Layout

SUFFIXES = {
    "markdown": [".md", ".markdown", ".txt"], "pdf": [".pdf"], "excel": [".xlsx"], "docx": [".docx"], "doc": [".doc"], "iwork": [".key", ".numbers"],
}
MIRRORED_AS_MARKDOWN = [".pdf", ".xlsx", ".docx", ".doc", ".key", ".numbers"]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def parser_kind(path: Column, document_type: Column) -> Column:
    """Which parser reads a file: by suffix, PDFs by document type too; null if none does."""
    kind = F.when(suffix(path).isin(SUFFIXES["markdown"]), "markdown").when(suffix(path) == ".pdf", F.when(document_type == "schematic", "schematic_pdf").when(document_type == "datasheet", "datasheet_pdf").otherwise("prose_pdf"))
    for name in ("excel", "docx", "doc", "iwork"):
        kind = kind.when(suffix(path).isin(SUFFIXES[name]), name)
    return kind


def folder_types(layout: Layout = LAYOUT) -> Column:
    return F.create_map(*[F.lit(x) for pair in layout.folders.items() for x in pair])


def path_metadata(paths: DataFrame, layout: Layout = LAYOUT, raw_label: str = "data/raw") -> DataFrame:
    """``paths`` (path relative to the raw folder) with project, build, document_type, title,
    source_file and ``reason`` (null where the path fits the layout)."""
    parts = F.split("path", "/")
    n, first, name = F.size(parts), F.element_at(parts, 1), F.element_at(parts, -1)
    top = first == layout.enterprise
    folder = F.when(top, F.get(parts, 1)).otherwise(F.get(parts, 2))
    kind = folder_types(layout)[folder]
    outside = F.startswith("path", F.lit("/")) | F.array_contains(parts, "..")
    reason = (F.when(F.startswith(name, F.lit(".")), "hidden file").when(outside, "outside the raw folder").when(top & (n < 3), "missing file name")
              .when(~top & (n < 4), "unexpected layout").when(kind.isNull(), "unknown type folder"))
    fit = reason.isNull()
    title = X.stem(F.col("path"))
    return paths.select("*", F.when(fit, first).alias("project"), F.when(fit, F.when(top, first).otherwise(F.get(parts, 1))).alias("build"), F.when(fit, kind).alias("document_type"), F.when(fit, title).alias("title"), F.when(fit, source_label(F.col("path"), raw_label)).alias("source_file"), reason.alias("reason"))


def source_label(path: Column, raw_label: str = "data/raw") -> Column:
    return F.concat_ws("/", F.lit(raw_label), path)


def mirror_path(path: Column) -> Column:
    """Where the processed text of a file goes: same place, .md for what is converted."""
    return F.when(suffix(path).isin(MIRRORED_AS_MARKDOWN), F.regexp_replace(path, r"\.[^./]+$", ".md")).otherwise(path)


def image_folder(path: Column) -> Column:
    return F.concat(F.regexp_replace(mirror_path(path), r"[^/]*$", ""), F.lit("images/"), X.filename_slug(X.stem(mirror_path(path))))


def raw_files(spark: SparkSession, root: str, only: list[str] | None = None, *, missing: bool = False) -> DataFrame:
    """(path relative to ``root``, mtime, size, content) of all files below it, or of those in ``only``, of
    which some may be ``missing``; contents stay unread until used."""
    base = root.rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if missing:
        at = spark._jvm.org.apache.hadoop.fs.Path
        fs = at(base).getFileSystem(spark._jsc.hadoopConfiguration())
        only = [path for path in only or [] if fs.exists(at(f"{base}/{path}"))]
        if not only:
            return reader.load(root).limit(0).select(F.col("path"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"), "content")
    # Names are no patterns.
    files = reader.load(root if only is None else [f"{base}/" + re.sub(r"([\[\]{}*?\\])", r"\\\1", path) for path in only])
    relative = F.regexp_replace(F.col("path"), "^.*?\\Q" + base + "\\E/", "")
    return files.select(relative.alias("path"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"), "content")


def supported(files: DataFrame, layout: Layout = LAYOUT) -> tuple[DataFrame, DataFrame]:
    """(files to ingest, in path order with their parser; skipped files with the reason)."""
    known = path_metadata(files, layout).withColumn("parser", parser_kind(F.col("path"), F.col("document_type")))
    reason = F.coalesce("reason", F.when(F.col("parser").isNull(), "unsupported suffix").when(F.col("parser").isin("doc", "iwork"), "needs an external converter"))
    marked = known.withColumn("reason", reason)
    hidden = F.startswith(F.element_at(F.split("path", "/"), -1), F.lit(".")) | (suffix(F.col("path")) == "")
    return marked.filter("reason is null"), marked.filter(F.col("reason").isNotNull() & ~hidden).select("path", "reason")


RULES: list[tuple[str, str]] = [
    ("project missing", "project is null or project = ''"), ("build missing", "build is null or build = ''"), ("document_type missing", "document_type is null or document_type = ''"),
    ("title missing", "title is null or title = ''"), ("source_file missing", "source_file is null or source_file = ''"), ("page negative", "page < 0"), ("source_size negative", "source_size < 0"),
]


def violations(rows: DataFrame) -> DataFrame:
    """``rows`` with ``broken``: the names of the metadata rules they break."""
    checks = [F.when(F.coalesce(F.expr(test), F.lit(False)), F.lit(name)) for name, test in RULES if all(c in rows.columns for c in test.split()[:1])]
    return rows.withColumn("broken", F.filter(F.array(*checks), lambda x: x.isNotNull()))


def metadata_json(rows: DataFrame) -> Column:
    """Metadata as a sidecar: lists that only schematics have go elsewhere, an empty target too."""
    only = lambda c: F.when(F.col("document_type") == "schematic", F.col(c)).alias(c)
    fields = [only(f.name) if f.name in ("major_components", "nets", "interfaces") else F.when(F.col(f.name) != "", F.col(f.name)).alias(f.name) if f.name == "target_file" else F.col(f.name) for f in METADATA if f.name in rows.columns]
    return F.to_json(F.struct(*fields))


def metadata_from_json(column: Column) -> Column:
    """A sidecar read leniently: missing parts get their defaults."""
    parsed = F.from_json(column, METADATA)
    defaults = {"page": F.lit(0), "source_mtime": F.lit(0.0), "source_size": F.lit(0).cast("long"), "keywords": F.array().cast("array<string>")}
    nullable = {"major_components", "nets", "interfaces"}
    return F.struct(*[(parsed[f.name] if f.name in nullable else F.coalesce(parsed[f.name], defaults.get(f.name, F.lit("")))).alias(f.name) for f in METADATA])


# --- spreadsheets, pages, images ----------------------------------------------------------------


def sheet_markdown(sheets: DataFrame) -> DataFrame:
    """``sheets`` (doc, sheet_no, sheet, rows: array<array<string>>) to (doc, content): a table per
    sheet with its first row as header; empty rows and sheets go, short rows are padded."""
    rows = F.filter("rows", lambda r: F.exists(r, lambda c: X.strip(F.coalesce(c, F.lit(""))) != ""))
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.replace(F.replace(X.strip(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    ruled = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    text = F.transform(rows, line)
    body = F.array_join(F.concat(F.slice(text, 1, 1), F.array(ruled), F.slice(text, 2, 2**31 - 1)), "\n")
    made = sheets.filter(F.size(rows) > 0).select("doc", "sheet_no", F.concat(F.lit("## Sheet: "), "sheet", F.lit("\n\n"), body).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("sheet_no", "part")))
    return made.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("content"))


def chosen_page_text(native: Column, scanned: Column, least: int = 40) -> Column:
    """Native text, unless it is short and the scan has enough or more."""
    use = (F.length(native) < least) & ((F.length(scanned) >= least) | (F.length(scanned) > F.length(native)))
    return F.when(F.coalesce(use, F.lit(False)), scanned).otherwise(native)


def assembled_pages(pages: DataFrame, title: str | Column = "title") -> DataFrame:
    """``pages`` (doc, title, page, text, images: array<string>) to (doc, content); blank pages go."""
    pictures = F.transform(F.coalesce("images", F.array().cast("array<string>")), lambda i: F.concat(F.lit("!["), F.element_at(F.split(i, "/"), -1), F.lit("]("), i, F.lit(")")))
    body = F.array_join(F.filter(F.concat(F.array(X.page_text(F.col("text"))), pictures), lambda x: x != ""), "\n\n")
    rows = pages.withColumn("body", body).filter("body <> ''")
    part = F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n\n"), "body")
    ordered = F.array_sort(F.collect_list(F.struct("page", part.alias("part"))))
    parts = F.transform(ordered, lambda x: x["part"])
    return rows.groupBy("doc").agg(F.concat(F.lit("# "), F.first("title"), F.lit("\n\n"), F.array_join(parts, "\n\n"), F.lit("\n")).alias("content"))


def largest_images(images: DataFrame, per_page: int = 5, least_area: int = 10_000) -> DataFrame:
    """Images big enough to matter, the largest few of each page."""
    area = F.col("width").cast("long") * F.col("height")
    order = Window.partitionBy("doc", "page").orderBy(F.desc("area"), "index")
    return images.withColumn("area", area).filter(F.col("area") >= least_area).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_page)


def distinct_images(images: DataFrame, most_pages: int = 3) -> DataFrame:
    """The first occurrence of each image of a document; what is on more pages is a template and goes."""
    spread = images.groupBy("doc", "hash").agg(F.count_distinct("page").alias("pages"), F.min(F.struct("page", "index")).alias("first"))
    return spread.filter(F.col("pages") <= most_pages).select("doc", "hash", "first.page", "first.index")


def merged_schematic(pages: DataFrame) -> DataFrame:
    """``pages`` (doc, page, text, nets, interfaces [, title]) to one row a document: texts between page breaks,
    lists in order, each entry once."""
    ordered = F.sort_array(F.collect_list(F.struct("page", "text", "nets", "interfaces")))
    more = ["title"] if "title" in pages.columns else []
    rows = pages.groupBy("doc").agg(ordered.alias("p"), F.count("*").alias("page_count"), *(F.first(c).alias(c) for c in more))
    both = lambda c: X.ordered_distinct(F.flatten(F.transform("p", lambda x: x[c])))
    text = F.array_join(F.filter(F.transform("p", lambda x: X.strip(x["text"])), lambda t: t != ""), "\n\n---\n\n")
    return rows.select("doc", "page_count", text.alias("content"), both("nets").alias("nets"), both("interfaces").alias("interfaces"), *more)


APPENDIX = "## 5. OCR 保真摘录（检索依据，禁止改写）"


def fidelity_appendix(text: Column, labels: Column | None = None, nets: Column | None = None) -> Column:
    """What was read off a schematic page, as an appendix for retrieval."""
    labels, nets = X.module_labels(text) if labels is None else labels, X.nets(text) if nets is None else nets
    items = lambda found, none: F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda x: F.concat(F.lit("- `"), x, F.lit("`"))), "\n")).otherwise(none)
    parts = [
        F.lit(f"{APPENDIX}\n\n### 5.1 模块分区标签"), items(labels, "- （未识别到模块分区标签）"), F.lit("\n### 5.2 网络名清单"), items(nets, "- （未识别到网络名）"),
        F.lit("\n### 5.3 主要器件位号"), items(X.major_components(text), "- （未识别到 IC 位号）"), F.concat(F.lit("\n### 5.4 OCR 全文\n\n```text\n"), X.strip(text), F.lit("\n```")),
    ]
    return F.concat_ws("\n", *parts)


def with_appendix(report: Column, text: Column, labels: Column | None = None, nets: Column | None = None) -> Column:
    """A page report with the appendix, once."""
    return F.when(F.contains(report, F.lit(APPENDIX)), report).otherwise(F.concat(X.rstrip(report), F.lit("\n\n"), fidelity_appendix(text, labels, nets)))


def model_payload(reply: Column) -> Column:
    """The fields of a vision model's reply (components, nets, interfaces): fenced or bare JSON, else
    what a pattern salvages from it."""
    bare = F.regexp_replace(X.strip(reply), r"^```[a-z]*\s*|\s*```$", "")
    schema = "struct<components:array<string>,nets:array<string>,interfaces:array<string>>"
    parsed = F.from_json(bare, schema, {"mode": "PERMISSIVE"})
    salvage = lambda name: F.regexp_extract_all(F.regexp_extract(bare, rf'"{name}"\s*:\s*\[([^\]]*)', 1), F.lit(r'"([^"]+)"'), F.lit(1))
    return F.struct(*[F.coalesce(parsed[n], salvage(n)).alias(n) for n in ("components", "nets", "interfaces")])


def without_repetition(text: Column, window: int = 24) -> Column:
    """A reply cut where its last ``window`` characters before the end of a stretch start to repeat."""
    return F.regexp_replace(text, rf"(?s)(.{{{window}}})(?:\s*\1){{2,}}.*$", "$1")
