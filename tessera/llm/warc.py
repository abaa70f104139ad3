"""WARC archives with revisit records, and a globally ordered index by external merge.

Captures with equal payloads are stored once: the one with the smallest id is a response record,
the others are revisit records that refer to it.  Every map task writes compressed archives of
bounded size, one gzip member a record, as rows of an archive table in the shared folder; each
row's content is the bytes of a valid ``.warc.gz`` file.  Reading back parses the archives, checks
every stored payload against its digest and gives index entries, sorted within an archive: a run.
Ranges of (URL key, timestamp, id) then receive their slices of all runs, and a loser tree merges
the k slices, so that ranges in order, and entries in order within them, are the capture history
of the whole collection.  A URL with very many captures spreads over several ranges, because the
ranges are cut on all key parts.

Null payloads count as empty; null URLs are recorded as ``urn:capture:`` and the id.  Rows that
repeat the smallest id with an equal payload are responses as well.  Null ids are kept, sort last
and are chosen as the response only if all ids of that payload are null (refers_to is null then).
An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import parse_qsl, quote, urlencode, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import materialize, parallelism, ship

#: An archive is closed once it has this many compressed bytes.
ARCHIVE_BYTES = 1 << 21
#: Index entries of a range, on average.
RANGE_ENTRIES = 50_000
#: Runs that one loser tree merges.
FAN_IN = 64
#: Payloads of at least this many bytes are stored once.
LEAST_BYTES = 0
#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
#: Captures without a time of their own get this one plus their id in seconds.
FIRST_CAPTURE = datetime(2000, 1, 1, tzinfo=timezone.utc)
NAMESPACE = uuid.UUID(int=0)


def url_key(url: str | None) -> str:
    """A key that sorts by host, most general label first, then by path and ordered query."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return (url or "").strip().lower()
    if not host:
        return (url or "").strip().lower()
    labels = host.removeprefix("www.").split(".")
    key = ",".join(reversed(labels)) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path.lower() or "/")
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return f"{key}?{query}" if query else key


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def capture_time(capture_id: int | None) -> datetime:
    return FIRST_CAPTURE + timedelta(seconds=(capture_id or 0) % (1 << 31))


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}".encode(), *(f"{k}: {v}".encode() for k, v in headers.items()), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(capture_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{capture_id} {digest} {url}')}>"


def target_uri(capture_id: int | None, url: str | None) -> str:
    return quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else f"urn:capture:{capture_id}"


def written_time(capture_id: int | None) -> str:
    return capture_time(capture_id).strftime("%Y-%m-%dT%H:%M:%SZ")


def capture_record(capture_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, revisit: bool) -> bytes:
    """``refers_to`` and ``refers_url`` are those of the response that a revisit repeats."""
    digest = base32_sha1(payload)
    headers = {
        "WARC-Record-ID": record_id(capture_id, url, digest), "WARC-Date": written_time(capture_id), "WARC-Target-URI": target_uri(capture_id, url),
        "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": HTTP_TYPE,
    }
    if capture_id is not None:
        headers["X-Capture-Id"] = str(capture_id)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        return record("response", headers, head + payload)
    headers["WARC-Profile"] = REVISIT_PROFILE
    if refers_to is not None:
        headers |= {
            "WARC-Refers-To": record_id(refers_to, refers_url, digest), "WARC-Refers-To-Target-URI": target_uri(refers_to, refers_url), "WARC-Refers-To-Date": written_time(refers_to),
            "X-Refers-To-Capture-Id": str(refers_to),
        }
    return record("revisit", headers, head)


class Archive:
    """Collects the members of one archive."""

    def __init__(self, name: str):
        self.name, self.parts, self.size = name, [], 0
        self.add(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>", "WARC-Date": FIRST_CAPTURE.strftime("%Y-%m-%dT%H:%M:%SZ"), "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))

    def add(self, raw: bytes) -> None:
        member = gzip.compress(raw, 6, mtime=0)
        self.parts.append(member)
        self.size += len(member)


ARCHIVES = T.StructType([T.StructField("archive", T.StringType(), False), T.StructField("content", T.BinaryType(), False)])


def write_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The archive table (archive, content) of all captures of ``df``, in the shared folder."""
    ship(df.sparkSession)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    known = materialize(rows.select("id", "url", "digest", F.octet_length("payload").alias("n")), "payload-digests")
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url")))
    first = known.filter(F.col("n") >= least_bytes).groupBy("digest").agg(least.alias("least"), F.count("*").alias("copies")).filter("copies > 1")
    first = first.select("digest", F.col("least.id").alias("first"), F.col("least.url").alias("first_url"))
    # Narrow on purpose: no payloads travel here, by digest; a common digest may split.
    later = materialize(known.select("id", "digest").join(first, "digest").filter("id is null or id > first").distinct().select("id", "digest", "first", "first_url"), "revisits")
    later = later.withColumnsRenamed({"id": "of", "digest": "same"}).withColumn("revisit", F.lit(True))
    told = rows.join(later, rows["id"].eqNullSafe(later["of"]) & (rows["digest"] == later["same"]), "left").select("id", "url", "payload", "first", "first_url", F.coalesce("revisit", F.lit(False)).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # id, url, payload, first, first_url, revisit
        part, count = TaskContext.get().partitionId(), 0
        archive = None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([archive.name]), pa.array([b"".join(archive.parts)], pa.binary())], names=ARCHIVES.names)

        for batch in batches:
            for values in zip(*batch.columns, strict=True):
                if archive is None:
                    archive, count = Archive(f"captures-{part:06d}-{count:06d}.warc.gz"), count + 1
                archive.add(capture_record(*(v.as_py() for v in values)))
                if archive.size >= ARCHIVE_BYTES:
                    yield closed()
                    archive = None
        if archive is not None:
            yield closed()

    return materialize(told.mapInArrow(run, ARCHIVES), "archives")


def parse_member(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


#: Bytes of an archive that the inflater gets at a time, and so at most looks at beyond a record's end.
WINDOW = 8192


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of an archive's members, in time linear in the archive."""
    view, at = memoryview(content), 0
    while at < len(view):
        one, parts, end = zlib.decompressobj(31), [], at
        while not one.eof:
            window = view[end : end + WINDOW]
            if not window:
                raise ValueError(f"the record at {at} breaks off")
            parts.append(one.decompress(window))
            end += len(window)
        end -= len(one.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


ENTRY = T.StructType([
    T.StructField("url_key", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
])


def entry_key(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is None, entry[2] or 0, entry[7], entry[8]


def entries_of(archive: str, content: bytes) -> list[tuple]:
    """The index entries of an archive, in key order.  Stored payloads must match their digests."""
    found = []
    for offset, length, raw in members(content):
        headers, block = parse_member(raw)
        kind = headers["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        head, _, payload = block.partition(b"\r\n\r\n")
        http = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])}
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and base32_sha1(payload) != digest:
            raise ValueError(f"{archive} at {offset}: payload does not match its digest")
        capture, refers_to = headers.get("x-capture-id"), headers.get("x-refers-to-capture-id")
        stamp = headers["warc-date"].translate(str.maketrans("", "", "-:TZ"))
        found.append((url_key(headers["warc-target-uri"]), stamp, None if capture is None else int(capture), int(http["content-length"]), digest, kind, None if refers_to is None else int(refers_to), archive, offset, length))
    return sorted(found, key=entry_key)


def read_archives(archives: DataFrame) -> DataFrame:
    """Index entries of an archive table, or of ``binaryFile`` rows renamed to (archive, content)."""
    ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([pa.field(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in ENTRY])
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = entries_of(name.as_py(), content.as_py())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return archives.select("archive", "content").mapInArrow(run, ENTRY)


class LoserTree:
    """Merges sorted runs.  Inner nodes keep the losers of their matches, so each step replays one
    path from a leaf to the root."""

    def __init__(self, runs: list[list[tuple]]):
        self.feeds = [iter(run) for run in runs]
        self.heads = [self._next(i) for i in range(len(runs))]
        k = len(runs)
        self.losers = [0] * k
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._less(a, b) else (b, a)
        self.champion = winners[1] if k else None

    def _next(self, i: int) -> tuple | None:
        entry = next(self.feeds[i], None)
        return None if entry is None else (entry_key(entry), entry)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return x[0] <= y[0]

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.heads)
        while k and self.heads[self.champion] is not None:
            yield self.heads[self.champion][1]
            self.heads[self.champion] = self._next(self.champion)
            winner, node = self.champion, (self.champion + k) // 2
            while node:
                if self._less(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
            self.champion = winner


def merged_runs(runs: list[list[tuple]], fan_in: int = FAN_IN) -> Iterator[tuple]:
    """All entries of sorted runs in order: in passes of trees with at most ``fan_in`` leaves."""
    while len(runs) > fan_in:
        runs = [list(LoserTree(runs[at : at + fan_in])) for at in range(0, len(runs), fan_in)]
    return iter(LoserTree(runs))


MERGED = T.StructType([*ENTRY.fields, T.StructField("range_no", T.IntegerType()), T.StructField("position", T.LongType())])


def merge_index(entries: DataFrame, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """All entries in global order: by ``range_no``, then ``position``."""
    ship(entries.sparkSession)
    entries = materialize(entries, "capture-runs")
    ranges = max(parallelism(entries.sparkSession), -(-entries.count() // range_entries))
    cut = entries.repartitionByRange(ranges, "url_key", "timestamp", F.col("page_id").asc_nulls_last(), "archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs.setdefault(entry[7], []).append(entry)
        for slice_ in runs.values():
            slice_.sort(key=entry_key)  # in order already unless the shuffle mixed blocks of a run
        part = TaskContext.get().partitionId()
        rows = list(merged_runs(list(runs.values())))
        schema = pa.schema([pa.field(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in ENTRY] + [pa.field("range_no", pa.int32()), pa.field("position", pa.int64())])
        if rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int64())], schema=schema)

    return cut.mapInArrow(run, MERGED)


def capture_index(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write ``df`` to archives, read them back and merge their index."""
    return merge_index(read_archives(write_archives(df, id_col, url_col, html_col, least_bytes)))
