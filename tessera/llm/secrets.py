"""Secret scanning over an incremental blob ledger.

A blob is a text, named by the SHA-256 of its UTF-8 bytes; every version of every document is an
occurrence of one.  The ledger holds, for each blob, the rules (with versions) that have been run
on it and what they found.  A scan runs only the pairs of blob and rule version that the ledger
lacks, each once however many documents share the blob, and findings join back to all
occurrences.  ``extend_ledger`` keeps the ledger as a table that grows by appends, so that the next
version of a corpus costs what is new in it; ``compacted`` gives one row a blob.

Texts travel once, already reduced to one copy a map task.  The join back carries ids and spans.

Null texts count as empty.  Repeated rows and documents with equal texts get equal findings.
Positions are code points, ends exclusive; matches of one rule do not overlap.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import broadcast_if_small, free_name, materialize, ship


@dataclass(frozen=True)
class Rule:
    """``find`` yields (start, end) of a text's matches from left to right."""

    kind: str
    version: int
    find: Callable[[str], Iterable[tuple[int, int]]]
    base: bool = True

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: What the base rules match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are maximal, so asking for the least length at once finds the same runs.
HEX = re.compile(r"[0-9a-f]{16,}")
KEY_BEGIN = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----")
#: What belongs to a key without an END line: header lines, and runs or whole lines of base64, apart by
#: blanks, quotes or the escapes of strings in code.
KEY_BODY = re.compile(r"""(?:(?:\s|\\[nrt]|["',])*+(?:(?:Proc-Type|DEK-Info):\s*+[A-Z0-9,-]++|[A-Za-z0-9+/]{16,}+={0,2}+|[A-Za-z0-9+/]++={1,2}+|(?:(?<=[A-Za-z0-9+/-]\n)|(?<=[A-Za-z0-9+/-]\r\n))[A-Za-z0-9+/]++(?=\r?\n|\Z)))*+""")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18


def assignments(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST)


def access_keys(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST)


def hex_runs(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in HEX.finditer(text))


def private_keys(text: str) -> Iterator[tuple[int, int]]:
    """From BEGIN through the END line of the same label, if no other key begins before it."""
    begins = list(KEY_BEGIN.finditer(text))
    limits = [*(m.start() for m in begins[1:]), len(text)]
    for m, limit in zip(begins, limits, strict=False):
        line = f"-----END {m[1]}-----"
        at = text.find(line, m.end(), limit)
        yield m.start(), at + len(line) if at >= 0 else KEY_BODY.match(text, m.end(), limit).end()


#: In the order in which kinds break ties.
RULES = (Rule("assign", 1, assignments), Rule("access", 1, access_keys), Rule("hex", 1, hex_runs), Rule("private_key", 2, private_keys, base=False))

#: Spans (about 60 bytes each) that may be broadcast.
SMALL_SPANS = 400_000

SPAN = T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])
#: ``rule`` is the key of the rule version that found the span.
LEDGER_SPAN = T.StructType([T.StructField("rule", T.StringType(), False), *SPAN.fields])
LEDGER = T.StructType([
    T.StructField("blob_id", T.StringType(), False),
    T.StructField("rules", T.ArrayType(T.StringType(), False), False),
    T.StructField("spans", T.ArrayType(LEDGER_SPAN, False), False),
])


def scan_text(text: str, rules: Iterable[Rule] = RULES) -> list[dict]:
    return [{"rule": rule.key, "kind": rule.kind, "start": start, "end": end} for rule in rules for start, end in rule.find(text)]


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """New ledger rows (blob_id, rules, spans): for every blob of ``docs`` the rules that no row of
    ``ledger`` has run on it, with what they find."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = docs.select(blob_id(F.col(text_col)).alias("blob_id"), text.alias("body")).groupBy("blob_id").agg(F.first("body").alias("body"))
    if ledger is None:
        blobs = blobs.select("blob_id", "body", F.array().cast("array<string>").alias("done"))
    else:
        done = ledger.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("done"))
        wanted = F.array(*[F.lit(rule.key) for rule in rules])
        blobs = blobs.join(done, "blob_id", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
        blobs = blobs.filter(F.size(F.array_except(wanted, F.col("done"))) > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([pa.field("rule", pa.string(), False), pa.field("kind", pa.string(), False), pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)])
        spans_type = pa.list_(pa.field("element", span, False))
        for batch in batches:
            ran, found = [], []
            for body, done in zip(batch.column(1), batch.column(2), strict=True):
                done, text = set(done.as_py()), body.as_py()
                due = [rule for rule in rules if rule.key not in done]
                ran.append([rule.key for rule in due])
                found.append(scan_text(text, due))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ran, pa.list_(pa.field("element", pa.string(), False))), pa.array(found, spans_type)], names=LEDGER.names)

    return blobs.mapInArrow(run, LEDGER)


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``ledger`` with the rows of ``scan_unseen``, written to the shared folder."""
    new = materialize(scan_unseen(docs, ledger, rules, text_col), "secret-ledger")
    return new if ledger is None else ledger.select(*LEDGER.names).unionAll(new)


def extend_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The ledger table under ``path`` (made if absent) after the unseen pairs of ``docs`` were scanned and
    appended.  A run that fails leaves the table as it was; run again, it scans the same pairs."""
    spark = docs.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    old = spark.read.schema(LEDGER).parquet(path) if there else None
    scan_unseen(docs, old, rules, text_col).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def compacted(ledger: DataFrame) -> DataFrame:
    """``ledger`` with one row a blob: all rules that have run on it and all they found."""
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    rows = ledger.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"), spans.alias("spans"))
    return rows.withColumn("spans", without_repeats("spans"))


def without_repeats(name: str) -> Column:
    """A sorted array column without repeats, in one pass (``array_distinct`` compares all structs with
    all)."""
    return F.filter(name, lambda x, i: (i == 0) | (x != F.get(F.col(name), i - 1)))


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", out_col: str = "spans", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``out_col``: the spans that ``rules`` found in its blob, by start, then kind in
    the order of ``rules``.  ``keep_text=False`` leaves the text out, so that it does not travel."""
    key, held = free_name([*docs.columns, out_col], "blob_id"), free_name([*docs.columns, out_col], "held_spans")
    order = F.create_map(*[x for i, rule in enumerate(rules) for x in (F.lit(rule.kind), F.lit(i))])
    rows = ledger.filter(F.size("spans") > 0)  # the others add nothing
    rows = rows.groupBy("blob_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    wanted = F.array(*[F.lit(rule.key) for rule in rules])
    placed = F.transform(F.filter("spans", lambda s: F.array_contains(wanted, s["rule"])), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("nth"), s["end"].alias("end"), s["kind"].alias("kind")))
    rows = rows.select("blob_id", F.array_sort(placed).alias("placed"))
    rows = rows.select(F.col("blob_id").alias(key), F.transform(without_repeats("placed"), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias(held))
    # Written first, so that the join is between plain tables and may split a common blob; a small
    # number of spans travels to the rows instead.
    rows = broadcast_if_small(materialize(rows, "secret-findings"), SMALL_SPANS, F.size(held) + 1)
    left = docs.withColumn(key, blob_id(F.col(text_col)))
    if not keep_text:
        left = left.drop(text_col)
    joined = left.join(rows, key, "left")
    empty = F.array().cast(T.ArrayType(SPAN))
    return joined.withColumn(out_col, F.coalesce(F.col(held), empty)).drop(held, key)


def written(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked_text(text: str, spans: Iterable[tuple[int, int]], mask: str) -> str:
    """``text`` with its spans (by start) replaced; overlapping spans become one mask."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``masked_text`` as a column; only texts with spans leave the JVM."""

    @F.pandas_udf(T.StringType())
    def run(texts, found):
        import pandas as pd

        return pd.Series([None if t is None else masked_text(t, [(s["start"], s["end"]) for s in own], mask) for t, own in zip(texts, found, strict=True)], dtype=object)

    some = F.size(spans) > 0
    return F.when(some, run(F.when(some, text), F.when(some, spans))).otherwise(text)
