"""The retrieval index: packed postings, BM25 statistics, packs of vectors, and their versioned storage.

What a search needs beside postings is small and stored with them: the statistics of the corpus as one
row, how many chunks have a token (looked up for the tokens asked for alone), and the first chunks of
every scope.  No request looks at chunks it does not return.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import postings as P
from tessera.operators import vectors as W
from tessera.operators.durable import broadcast_if_small, materialize
from tessera.schema import RETRIEVAL, Retrieval

#: First chunks of a scope that are kept at hand; searches for more look at the chunks.
LEADS = 64


def document_frequencies(packs: DataFrame) -> DataFrame:
    """(token, df)."""
    return packs.filter("token <> ''").groupBy("token").agg(F.sum("n").alias("df"))


def sizes(packs: DataFrame) -> DataFrame:
    """One row: how many chunks, and how many tokens they have."""
    return packs.filter("token = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))


def raw_weight(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def histogram(frequencies: DataFrame) -> DataFrame:
    """(df, tokens): how many tokens occur in so many chunks; few rows, from which the mean weight follows."""
    return frequencies.groupBy("df").agg(F.count("*").alias("tokens"))


def statistics(counts: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row (n, total, avgdl, mean): ``counts`` as of ``sizes``, ``tokens`` a histogram; ``mean`` is the mean
    raw weight of all tokens."""
    mean = tokens.join(F.broadcast(counts.select("n")), F.lit(True))  # one row
    mean = mean.agg((F.sum(F.col("tokens") * raw_weight(F.col("n"), F.col("df"))) / F.sum("tokens")).alias("mean"))
    return counts.join(F.broadcast(mean), F.lit(True)).select("n", "total", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("avgdl"), "mean")  # one row


def leads(chunks: DataFrame, key: str = "chunk_key", most: int = LEADS) -> DataFrame:
    """(project, build, key, pos, *what is there of document, segment): the first chunks of every scope."""
    more = [c for c in ("document", "segment") if c in chunks.columns]
    first = F.row_number().over(Window.partitionBy("project", "build").orderBy("pos"))
    rows = chunks.select("project", "build", key, "pos", *more)
    return rows.withColumn("nth", first).filter(F.col("nth") <= most).drop("nth")


@dataclass(frozen=True)
class Lexical:
    """What sparse recall searches: packed postings, (token, df) in parts that add up, one row of statistics,
    and the first chunks of every scope."""

    packs: DataFrame
    frequencies: DataFrame
    stats: DataFrame
    leads: DataFrame

    def weights(self, tokens: DataFrame | None = None, config: Retrieval = RETRIEVAL) -> DataFrame:
        """(token, df, idf) of ``tokens`` (a written table), or of all: Okapi weights; negative ones become epsilon times the
        mean of all."""
        known = self.frequencies
        if tokens is not None:
            known = known.join(broadcast_if_small(tokens.select("token"), P.SMALL), "token", "left_semi")
        known = known.groupBy("token").agg(F.sum("df").alias("df")).filter("df > 0")
        both = known.join(F.broadcast(self.stats.select("n", "mean")), F.lit(True))  # one row
        raw = raw_weight(F.col("n"), F.col("df"))
        return both.select("token", "df", F.when(raw < 0, config.epsilon * F.col("mean")).otherwise(raw).alias("idf"))


def lexical(chunks: DataFrame, key: str, text_col: str = "content") -> Lexical:
    """The lexical index of ``chunks`` (key, pos, project, build, text), written."""
    packs = materialize(P.packed(chunks, key, text_col), "postings", keep=True)
    frequencies = materialize(document_frequencies(packs), "document-frequencies", keep=True)
    stats = materialize(statistics(sizes(packs), histogram(frequencies)), "corpus-statistics", keep=True)
    return Lexical(packs, frequencies, stats, materialize(leads(chunks, key), "scope-leads", keep=True))


def unit_vectors(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``rows`` with ``unit`` (array<double>); rows without a usable vector go."""
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("__wide", wide).withColumn("__norm", norm).filter("__norm >= 1e-12").withColumn("unit", F.transform("__wide", lambda x: x / F.col("__norm"))).drop("__wide", "__norm")


def config_hash(**parameters: object) -> str:
    """What a fingerprint needs besides the raw file, so that a changed parameter re-indexes."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]


class Conflict(Exception):
    """Another save finished while this one was under way."""


#: Segments of one size class that compaction joins, and the factor between classes.
FAN, GROWTH = 4, 4
#: Versions whose changes of token frequencies are read one by one; beyond, they are added up.
CHANGES = 8
#: Documents up to which rows are looked up by name, which skips row groups.
NAMED = 1000
META = ("document", "segment")


class Store:
    """An index on disk as versions.

    A save writes one segment, with the chunks, packed postings and packs of vectors of the documents that
    are new or changed, and a manifest, which names for every document its fingerprint and the segment that
    holds it.  What stays is neither read nor written: statistics go from version to version by what was
    added and removed.  Rows of a segment that the manifest does not name are dead; ``live`` tells for each
    shard and pack that has some which of its chunks count.  ``compact`` joins segments of like size and those
    that are mostly dead.

    Every version has its number from a file that only one save can create.  The manifest comes last, and
    readers take the newest version that has one, so a save that fails leaves nothing behind that anyone
    reads, and old versions stay readable until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{path}")

    def _write(self, rows: DataFrame, path: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.root}/{path}")
        return self._read(path)

    def _has(self, path: str) -> bool:
        fs, at = self._fs()
        return fs.exists(at(f"{self.root}/{path}/_SUCCESS"))

    def _segments(self, name: str, segments: list[int]) -> DataFrame:
        """The rows of some segments, with ``segment``; other folders are not listed."""
        paths = [f"{self.root}/{name}/segment={n}" for n in segments]
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*paths).withColumn("segment", F.col("segment").cast("int"))

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(f"{self.root}/manifest")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.root}/manifest"))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(path(f"{self.root}/manifest/{n}/_SUCCESS")))

    def _claim(self, after: int) -> int:
        """The next version number, which no other save has or gets."""
        fs, path = self._fs()
        fs.mkdirs(path(f"{self.root}/claims"))
        version = after + 1
        while not fs.createNewFile(path(f"{self.root}/claims/v{version}")):
            version += 1
        return version

    def _finish(self, manifest: DataFrame, version: int, base: int) -> int:
        if (self.versions() or [0])[-1] != base:
            raise Conflict(f"version {base} is no longer the newest")
        self._write(manifest, f"manifest/v{version}")
        return version

    def save(self, chunks: DataFrame, documents: DataFrame, kept: DataFrame | None = None, key: str = "chunk_key") -> int:
        """Write a new version: ``chunks`` (target_file, key, index_text, project, build [, seq, embedding], ...) of
        ``documents`` (target_file and what else the manifest shall say of them), and of the manifest before,
        the rows ``kept``; without those, the version holds ``documents`` alone."""
        base = (self.versions() or [0])[-1]
        version = self._claim(base)
        self._segment(self._placed(chunks, key), version, key)
        manifest = materialize(documents.withColumns({"segment": F.lit(version), "built_at": F.current_timestamp()}), "manifest")
        packs = self._read(f"packs/segment={version}")
        added, counts = document_frequencies(packs), sizes(packs)
        if kept is None or not base:
            frequencies = self._write(added, f"frequencies/v{version}")
            self._write(histogram(frequencies), f"histogram/v{version}")
            self._write(statistics(counts, self._read(f"histogram/v{version}")), f"stats/v{version}")
            self._write(leads(self._segments("chunks", [version]), key), f"leads/v{version}")
            return self._finish(manifest, version, base)
        before = _named(self._read(f"manifest/v{base}"))
        manifest = materialize(kept.unionByName(manifest, allowMissingColumns=True), "manifest")
        gone = materialize(before.join(_named(kept), [*META], "left_anti"), "gone-documents")
        lost = materialize(self._rows("chunks", gone).select(*META, "project", "build", key, F.array_distinct(X.tokens(F.col("index_text"))).alias("tokens"), F.size(X.tokens(F.col("index_text"))).alias("size")), "gone-chunks")
        # What was added and removed, to token frequencies and their histogram.
        less = lost.select(F.explode("tokens").alias("token")).groupBy("token").agg((-F.count("*")).alias("df"))
        change = self._write(added.unionAll(less).groupBy("token").agg(F.sum("df").alias("df")).filter("df <> 0"), f"changes/v{version}")
        old = self._frequencies(base).join(broadcast_if_small(change.select("token"), P.SMALL), "token", "left_semi").groupBy("token").agg(F.sum("df").alias("old"))
        moved = change.join(old, "token", "left").select(F.coalesce("old", F.lit(0)).alias("old"), (F.coalesce("old", F.lit(0)) + F.col("df")).alias("new"))
        bins = self._read(f"histogram/v{base}").unionAll(moved.select("old", F.lit(-1).cast("long"))).unionAll(moved.select("new", F.lit(1).cast("long")))
        self._write(bins.filter("df > 0").groupBy("df").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"), f"histogram/v{version}")
        changed = lost.agg((-F.count("*")).alias("n"), F.coalesce(-F.sum("size"), F.lit(0)).cast("long").alias("total"))
        counts = self._read(f"stats/v{base}").select("n", "total").unionAll(counts).unionAll(changed).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        self._write(statistics(counts, self._read(f"histogram/v{version}")), f"stats/v{version}")
        self._write_live(base, version, gone, manifest)
        self._write_leads(base, version, gone, lost, manifest, key)
        self._add_up(base, version)
        return self._finish(manifest, version, base)

    def _placed(self, chunks: DataFrame, key: str) -> DataFrame:
        """Chunks with ``document`` and ``pos``, the order of the corpus: documents by name, then as they come."""
        rows = chunks.withColumn("document", F.xxhash64("target_file"))
        if "pos" in rows.columns:
            return rows
        nth = F.lpad(F.col("seq").cast("string"), 8, "0") if "seq" in rows.columns else F.col(key).cast("string")
        return rows.withColumn("pos", F.concat(F.coalesce("target_file", F.lit("")), F.lit("#"), nth))

    def _segment(self, rows: DataFrame, version: int, key: str) -> None:
        """Chunks of a segment, its packed postings and its packs of vectors."""
        own = f"segment={version}"
        rows.repartition("document").sortWithinPartitions("document").write.mode("overwrite").parquet(f"{self.root}/chunks/{own}")
        stored = self._read(f"chunks/{own}")
        packs = P.packed(stored.withColumn("documents", F.col("document")), key, "index_text", ("documents",), version << 32)
        self._write(packs.repartition("project", "build", "shard").sortWithinPartitions("project", "build", "shard", "token"), f"packs/{own}")
        if "embedding" in stored.columns:
            units = unit_vectors(stored.select(F.col(key).alias("key"), "document", "embedding", F.concat_ws("\x1f", "project", "build").alias("scope")))
            made = W.pack_vectors(units.withColumnRenamed("document", "documents"), extra=("documents",))
            self._write(made.withColumn("pack", F.xxhash64(F.lit(version), "pack")), f"vectors/{own}")

    def _rows(self, name: str, documents: DataFrame) -> DataFrame:
        """The rows of some documents (document, segment): only their segments are read, and of those, if the
        documents are few, only the row groups that may hold them."""
        segments = [r["segment"] for r in documents.select("segment").distinct().collect()]  # a row a segment
        if not segments:
            newest = self.versions()[-1]
            return self._segments(name, [r["segment"] for r in self._read(f"manifest/v{newest}").select("segment").distinct().limit(1).collect()]).limit(0)
        rows = self._segments(name, segments)
        few = [r["document"] for r in documents.select("document").limit(NAMED + 1).collect()]
        if len(few) <= NAMED:
            rows = rows.filter(F.col("document").isin(few))
        return rows.join(broadcast_if_small(documents.select(*META), P.SMALL), [*META], "left_semi")

    def _write_live(self, base: int, version: int, gone: DataFrame, manifest: DataFrame) -> None:
        """(kind, segment, id, live): of the shards and packs with dead chunks, which of them count."""
        held = self._read(f"live/v{base}") if self._has(f"live/v{base}") else None
        segments = [r["segment"] for r in gone.select("segment").distinct().collect()]  # a row a segment
        if not segments:
            if held is not None:
                self._write(held, f"live/v{version}")
            return
        named = _named(manifest).withColumn("alive", F.lit(True))
        found = None
        for kind in ("packs", "vectors"):
            fs, path = self._fs()
            own = [n for n in segments if fs.exists(path(f"{self.root}/{kind}/segment={n}"))]
            if not own:
                continue
            rows = self._segments(kind, own)
            rows = rows.filter("token = ''").select("segment", F.concat_ws("\x1f", "project", "build", "shard").alias("id"), "documents") if kind == "packs" else rows.select("segment", F.col("pack").cast("string").alias("id"), "documents")
            each = rows.select("segment", "id", F.posexplode("documents").alias("at", "document"))
            hit = each.join(broadcast_if_small(gone, P.SMALL), [*META], "left_semi").select("segment", "id").distinct()
            each = each.join(hit, ["segment", "id"], "left_semi").join(named, [*META], "left")
            own = each.groupBy("segment", "id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("alive", F.lit(False)).alias("alive")))).alias("x"))
            own = own.select(F.lit(kind).alias("kind"), "segment", "id", F.transform("x", lambda x: x["alive"]).alias("live"))
            found = own if found is None else found.unionAll(own)
        found = materialize(found, "live")
        if held is not None:
            found = found.unionAll(held.join(found, ["kind", "segment", "id"], "left_anti"))
        self._write(found, f"live/v{version}")

    def _write_leads(self, base: int, version: int, gone: DataFrame, lost: DataFrame, manifest: DataFrame, key: str) -> None:
        """The first chunks of every scope: those before, less the dead, and the new ones.  Scopes that lost
        some are looked at again."""
        held = self._read(f"leads/v{base}")
        dead = held.join(broadcast_if_small(gone, P.SMALL), [*META], "left_semi").select("project", "build").distinct()
        dead = materialize(dead, "scopes-with-dead-leads")
        both = held.join(dead, ["project", "build"], "left_anti").unionByName(leads(self._segments("chunks", [version]), key).select(held.columns))
        scopes = [(r["project"], r["build"]) for r in dead.limit(NAMED + 1).collect()]
        if scopes:
            segments = [r["segment"] for r in manifest.select("segment").distinct().collect()]  # a row a segment
            again = self._segments("chunks", segments).filter(F.col("segment") < version)
            if len(scopes) <= NAMED:
                again = again.filter(F.col("project").isin([p for p, _ in scopes]) & F.col("build").isin([b for _, b in scopes]))
            again = again.join(broadcast_if_small(dead, P.SMALL), ["project", "build"], "left_semi").join(_named(manifest), [*META], "left_semi")
            both = both.unionByName(leads(again, key).select(held.columns))
        self._write(leads(both, key), f"leads/v{version}")

    def _frequencies(self, version: int) -> DataFrame:
        """(token, df) in parts that add up: the last full table and the changes since."""
        full = version
        while not self._has(f"frequencies/v{full}"):
            full -= 1
        rows = self._read(f"frequencies/v{full}")
        for n in range(full + 1, version + 1):
            # Numbers of saves that did not finish are gaps.
            if self._has(f"changes/v{n}") and self._has(f"manifest/v{n}"):
                rows = rows.unionAll(self._read(f"changes/v{n}"))
        return rows

    def _add_up(self, base: int, version: int) -> None:
        """After some changes, one table again."""
        full = base
        while not self._has(f"frequencies/v{full}"):
            full -= 1
        if version - full >= CHANGES:
            rows = self._frequencies(base).unionAll(self._read(f"changes/v{version}"))
            self._write(rows.groupBy("token").agg(F.sum("df").alias("df")).filter("df > 0"), f"frequencies/v{version}")

    def compact(self, key: str = "chunk_key") -> int | None:
        """Join segments, if there are ``FAN`` of one size class or some of which half is dead; their live chunks
        become one segment.  Returns the version, or null if there is nothing to do."""
        base = (self.versions() or [0])[-1]
        if not base:
            return None
        manifest = self._read(f"manifest/v{base}")
        named = _named(manifest)
        live = {r["segment"]: r["n"] for r in named.groupBy("segment").agg(F.count("*").alias("n")).collect()}  # a row a segment
        rows = self._segments("packs", sorted(live)).filter("token = ''").select("segment", F.explode("documents").alias("document")).distinct()
        written = {r["segment"]: r["n"] for r in rows.groupBy("segment").agg(F.count("*").alias("n")).collect()}
        classes: dict[int, list[int]] = {}
        for segment, n in live.items():
            size = 0
            while GROWTH ** (size + 1) <= n:
                size += 1
            classes.setdefault(size, []).append(segment)
        due = {s for own in classes.values() if len(own) >= FAN for s in own} | {s for s, n in written.items() if n >= 2 * live[s]}
        if not due:
            return None
        version = self._claim(base)
        chosen = named.filter(F.col("segment").isin(sorted(due)))
        chunks = self._segments("chunks", sorted(due)).join(broadcast_if_small(chosen, P.SMALL), [*META], "left_semi").drop("segment")
        self._segment(chunks, version, key)
        moved = F.when(F.col("segment").isin(sorted(due)), F.lit(version)).otherwise(F.col("segment"))
        manifest = materialize(manifest.withColumn("segment", moved), "manifest")
        for name in ("stats", "histogram"):
            self._write(self._read(f"{name}/v{base}"), f"{name}/v{version}")
        self._write(self._frequencies(base).groupBy("token").agg(F.sum("df").alias("df")).filter("df > 0"), f"frequencies/v{version}")
        self._write(self._read(f"leads/v{base}").withColumn("segment", moved), f"leads/v{version}")
        if self._has(f"live/v{base}"):
            self._write(self._read(f"live/v{base}").filter(~F.col("segment").isin(sorted(due))), f"live/v{version}")
        return self._finish(manifest, version, base)

    def vacuum(self, versions: int = 2) -> list[str]:
        """Remove what the newest ``versions`` versions do not need; returns the folders that went."""
        kept = self.versions()[-versions:]
        if not kept:
            return []
        segments = {r["segment"] for v in kept for r in self._read(f"manifest/v{v}").select("segment").distinct().collect()}  # a row a segment
        full = kept[0]
        while not self._has(f"frequencies/v{full}"):
            full -= 1
        fs, path = self._fs()
        gone = []
        for top in fs.listStatus(path(self.root)):
            name = top.getPath().getName()
            for folder in fs.listStatus(top.getPath()):
                own = folder.getPath().getName()
                if own.startswith("segment="):
                    dead = int(own[8:]) not in segments and int(own[8:]) <= kept[-1]
                else:
                    dead = own[1:].isdigit() and int(own[1:]) < (full if name in ("frequencies", "changes") else kept[0])
                if dead and name != "claims":
                    fs.delete(folder.getPath(), True)
                    gone.append(f"{name}/{own}")
        return sorted(gone)

    def _live(self, kind: str, version: int) -> DataFrame:
        """Packs of a version with ``live``, null where all chunks count."""
        segments = [r["segment"] for r in self._read(f"manifest/v{version}").select("segment").distinct().collect()]  # a row a segment
        rows = self._segments(kind, segments)
        if not self._has(f"live/v{version}"):
            return rows
        told = self._read(f"live/v{version}").filter(F.col("kind") == kind).select("segment", "id", "live")
        if kind == "packs":
            own = F.when(F.col("token") == "", F.concat_ws("\x1f", "project", "build", "shard"))
        else:
            own = F.col("pack").cast("string")
        return rows.withColumn("id", own).join(broadcast_if_small(told, P.SMALL), ["segment", "id"], "left").drop("id")

    def load(self, name: str) -> DataFrame | None:
        """``chunks``, ``postings``, their ``totals`` by token, ``vectors``, ``tokens``, ``stats``, ``leads`` or
        ``manifest`` of the newest version."""
        found = self.versions()
        if not found:
            return None
        if name == "chunks":
            manifest = self._read(f"manifest/v{found[-1]}")
            segments = [r["segment"] for r in manifest.select("segment").distinct().collect()]  # a row a segment
            return self._segments("chunks", segments).join(_named(manifest), [*META], "left_semi").drop(*META)
        if name == "postings":
            return P.unpacked(self._live("packs", found[-1]))
        if name == "totals":
            return P.totals(self._live("packs", found[-1]))
        if name == "vectors":
            fs, path = self._fs()
            return self._live("vectors", found[-1]) if fs.exists(path(f"{self.root}/vectors")) else None
        if name == "tokens":
            return self.lexical().weights()
        return self._read(f"{name}/v{found[-1]}")

    def lexical(self) -> Lexical:
        version = self.versions()[-1]
        return Lexical(self._live("packs", version), self._frequencies(version), self._read(f"stats/v{version}"), self._read(f"leads/v{version}"))

    def clear(self) -> int:
        """Remove all versions; returns how many documents the newest one had."""
        manifest = self.load("manifest")
        if manifest is not None and "readable" in manifest.columns:
            manifest = manifest.filter("readable")
        count = manifest.count() if manifest is not None else 0
        fs, path = self._fs()
        fs.delete(path(self.root), True)
        return count


def _named(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.xxhash64("target_file").alias("document"), "segment")
