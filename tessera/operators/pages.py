"""PDF page tables to documents.

A reader hook turns a file into pages: (doc, title, page, text, lines, image_ratio, scanned, described),
where ``scanned`` is what OCR read and ``described`` what a vision model wrote (both may be null).
Everything after the reader is relational.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import ingest, reply
from tessera.operators.durable import spread

PAGES = "doc string, title string, page int, text string, lines int, image_ratio double, scanned string, described string"
PageReader = Callable[[str, bytes], list[dict]]


def read_pages(files: DataFrame, reader: PageReader) -> DataFrame:
    """``files`` (path, title, content) through a reader hook; a file that it cannot read has no pages.  What a
    vision model wrote of a page is read leniently (see ``reply``)."""

    def told(page: dict) -> dict:
        return page | {"described": reply.parsed(page["described"])["markdown"] or None} if page.get("described") else page

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"doc": f.path, "title": f.title, **told(page)} for f in frame.itertuples() for page in reader(f.path, f.content)]
            yield pd.DataFrame(rows, columns=["doc", "title", "page", "text", "lines", "image_ratio", "scanned", "described"])

    return files.select("path", "title", "content").mapInPandas(run, PAGES)


def prose_documents(pages: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(doc, content): native text, or the scan where a page has too little of it, with its pictures."""
    rows = pages.withColumn("text", ingest.chosen_page_text(F.coalesce("text", F.lit("")), F.coalesce("scanned", F.lit(""))))
    if images is None:
        return ingest.assembled_pages(rows.withColumn("images", F.lit(None).cast(X.STRINGS)))
    ordered = F.array_sort(F.collect_list(F.struct("index", "file")))
    pictures = images.groupBy("doc", "page").agg(F.transform(ordered, lambda x: x["file"]).alias("images"))
    return ingest.assembled_pages(rows.join(pictures, ["doc", "page"], "left"))


def with_descriptions(images: DataFrame, described: DataFrame) -> DataFrame:
    """``images`` (doc, page, index, file) with the caption that a hook gave the file, or null."""
    return images.join(described.select("file", "caption"), "file", "left")


def datasheet_documents(pages: DataFrame) -> DataFrame:
    """(doc, content): text pages as they are, tables and graphs as described (else scanned), and what
    was scanned once more as an appendix."""
    kind = X.page_kind(F.length(F.coalesce("text", F.lit(""))), F.coalesce("lines", F.lit(0)), F.coalesce("image_ratio", F.lit(0.0)))
    own = F.when(kind == "TEXT", F.col("text")).otherwise(F.coalesce(F.when(X.strip(F.col("described")) != "", F.col("described")), F.col("scanned"), F.col("text")))
    rows = pages.select("doc", "title", "page", X.strip(F.coalesce(own, F.lit(""))).alias("body"), X.strip(F.coalesce("scanned", F.lit(""))).alias("scan"))
    part = F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n"), F.when(F.col("body") != "", F.concat(F.lit("\n"), "body", F.lit("\n"))).otherwise(""))
    extra = F.when(F.col("scan") != "", F.concat(F.lit("### Page "), F.col("page").cast("string"), F.lit(" OCR\n\n"), "scan", F.lit("\n")))
    ordered = F.array_sort(F.collect_list(F.struct("page", part.alias("part"), extra.alias("extra"))))
    grouped = rows.groupBy("doc").agg(F.first("title").alias("title"), ordered.alias("p"))
    extras = F.filter(F.transform("p", lambda x: x["extra"]), lambda e: e.isNotNull())
    appendix = F.when(F.size(extras) > 0, F.concat(F.lit("\n---\n\n## OCR Fidelity Appendix\n\n"), F.array_join(extras, "\n"))).otherwise("")
    return grouped.select("doc", F.concat(F.lit("# "), "title", F.lit("\n\n"), F.array_join(F.transform("p", lambda x: x["part"]), "\n"), appendix).alias("content"))


def heading(level: int, title: Column) -> Column:
    return F.concat(F.lit("#" * level + " "), title)


def _items(values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit("- `"), v, F.lit("`")))


def prefix_groups(nets: Column, level: int) -> Column:
    """Lines that list nets by the word before their first underscore: data buses in number order, then
    the others."""
    named = F.filter(nets, lambda n: F.contains(n, F.lit("_")))
    told = F.transform(named, lambda n: F.struct(F.upper(F.substring_index(n, "_", 1)).alias("p"), F.regexp_extract(n, r"(?i)^[^_]*_D(\d+)$", 1).alias("i"), n.alias("n")))
    none = F.array().cast(X.STRINGS)

    def lines(title: str, p: Column, own: Column) -> Column:
        return X.let(own, lambda found: F.when(F.size(found) > 0, F.concat(F.array(heading(level, F.concat(F.lit(title + "（"), p, F.lit("）")))), _items(found), F.array(F.lit("")))).otherwise(none))

    def block(p: Column, all_: Column) -> Column:
        def of(own: Column) -> Column:
            bus = F.sort_array(F.transform(F.filter(own, lambda x: x["i"] != ""), lambda x: F.struct(x["i"].try_cast("int").alias("i"), x["n"].alias("n"))))
            rest = X.by_upper(F.transform(F.filter(own, lambda x: x["i"] == ""), lambda x: x["n"]))
            return F.concat(lines("数据总线", p, F.transform(bus, lambda x: x["n"])), lines("控制与时钟", p, rest))

        return X.let(F.filter(all_, lambda x: x["p"] == p), of)

    return X.let(told, lambda all_: F.flatten(F.transform(F.sort_array(F.array_distinct(F.transform(all_, lambda x: x["p"]))), lambda p: block(p, all_))))


def power_lines(nets: Column, level: int) -> Column:
    return X.let(X.power_nets(nets), lambda found: F.when(F.size(found) > 0, F.concat(F.array(heading(level, F.lit("电源"))), _items(found), F.array(F.lit("")))).otherwise(F.array().cast(X.STRINGS)))


def with_fields(pages: DataFrame, text: Column) -> DataFrame:
    """``pages`` with ``ocr``, ``labels``, ``found_nets`` and ``zones``, each computed once a row."""
    rows = pages.withColumn("ocr", text)
    rows = rows.withColumns({"labels": X.module_labels(F.col("ocr")), "found_nets": X.nets(F.col("ocr"))})
    return rows.withColumn("zones", X.module_zones(F.col("labels"), F.col("found_nets"), F.col("ocr")))


def module_block(label: Column, nets: Column, level: int = 3) -> Column:
    """The retrieval block of a module zone."""
    lead = F.array(heading(level, F.concat(F.lit("模块："), label)), F.lit(""), F.lit("> 同页 OCR 关联网络；引脚序号请对照原理图 connector。"), F.lit(""))
    return X.strip(F.array_join(F.concat(lead, prefix_groups(nets, level + 1), power_lines(nets, level + 1)), "\n"))


def signal_summary(level: int = 2) -> Column:
    """The module zones of a page with their nets, all nets by prefix, and power; empty if there are
    neither zones nor named nets.  Reads the columns of ``with_fields``."""
    labels, nets = F.col("labels"), F.col("found_nets")
    lead = F.array(heading(level, F.lit("本页模块与接口信号")), F.lit(""), F.lit("> 由同页 OCR 网络名按接口前缀自动分组；引脚序号请对照原理图 connector。"), F.lit(""))
    zones = F.when(F.size(labels) > 0, F.concat(F.array(heading(level + 1, F.lit("模块分区"))), _items(labels), F.array(F.lit("")))).otherwise(F.array().cast(X.STRINGS))
    used = F.filter("zones", lambda z: F.size(z["nets"]) > 0)
    blocks = F.flatten(F.transform(used, lambda z: F.array(module_block(z["label"], z["nets"], level + 1), F.lit(""))))
    lines = F.concat(lead, zones, blocks, prefix_groups(nets, level + 1), power_lines(nets, level + 1))
    return F.when((F.size(labels) > 0) | F.exists(nets, lambda n: F.contains(n, F.lit("_"))), X.strip(F.array_join(lines, "\n"))).otherwise("")


def page_report(page: Column, project: Column) -> Column:
    """A schematic page from OCR alone.  Reads the columns of ``with_fields``."""
    none = lambda found, said: F.when(F.size(found) > 0, F.array_join(_items(found), "\n")).otherwise(said)
    return F.concat(
        F.lit("## 1. 模块图纸基本信息\n* **图纸页码**: Page "), page.cast("string"), F.lit("\n* **项目代号**: "), project, F.lit("\n* **提取方式**: OCR 保真（未经过 VLM 改写）\n\n## 2. 模块分区标签（OCR 原样）\n"), none(F.col("labels"), "- （未识别到模块分区标签）"),
        F.lit("\n\n## 3. 网络名清单（OCR 原样）\n"), none(F.col("found_nets"), "- （未识别到网络名）"), F.lit("\n\n## 4. 主要器件位号（OCR 原样）\n"), none(X.major_components(F.col("ocr")), "- （未识别到 IC 位号）"), F.lit("\n\n"), signal_summary(3), F.lit("\n\n"),
        ingest.fidelity_appendix(F.col("ocr"), F.col("labels"), F.col("found_nets")), F.lit("\n"),
    )


def schematic_documents(pages: DataFrame, mode: str = "ocr_only", project: str = "project") -> DataFrame:
    """(doc, content, nets, interfaces, page_count).  ``ocr_only`` reports what was read; ``vlm_plus_ocr``
    takes the described page, if there is one, and adds what was read as an appendix, once."""
    text = F.coalesce("scanned", "text", F.lit(""))
    # A page costs far more time than bytes: a small file is one task's, its pages are not.
    pages = with_fields(spread(pages, "doc", "page"), text)
    read = page_report(F.col("page"), F.col(project))
    own = ingest.with_appendix(F.col("described"), F.col("ocr"), F.col("labels"), F.col("found_nets"))
    report = read if mode == "ocr_only" else F.when(X.strip(F.coalesce("described", F.lit(""))) != "", own).otherwise(read)
    named = F.transform(F.filter("found_nets", lambda n: F.contains(n, F.lit("_"))), lambda n: F.substring_index(n, "_", 1))
    rows = pages.select("doc", "title", "page", report.alias("text"), F.col("found_nets").alias("nets"), X.ordered_distinct(F.concat("labels", named)).alias("interfaces"))
    merged = ingest.merged_schematic(rows)
    lead = F.concat(F.lit("# 电子图纸分析报告："), "title", F.lit("\n\n"))
    return merged.select("doc", F.concat(lead, "content", F.lit("\n")).alias("content"), "nets", "interfaces", "page_count")
