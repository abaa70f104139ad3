import gzip
from collections import defaultdict

import numpy as np
import pytest
from conftest import SMALL, same_rows

from tessera.llm import queries, warc

SCHEMA = "page_id long, url string, html string, digest string, archive string"


def brute(rows, least=0):
    first, out = {}, []
    for i, _, html, *_ in rows:
        body = (html or "").encode()
        if i is not None and len(body) >= least:
            first[body] = min(first.get(body, i), i)
    for i, _, html, *_ in rows:
        body = (html or "").encode()
        lead = first.get(body)
        revisit = len(body) >= least and lead is not None and lead != i
        out.append((i, len(body), warc.base32_sha1(body), "revisit" if revisit else "response", lead if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_query_equals_its_sql(spark, duck):
    same_rows(queries.op3_warc(spark, SMALL), duck, queries.OP3_SQL)


def test_tables_equal_brute_force(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    out = warc.capture_index(pages)
    assert got(out) == brute([(r.page_id, r.url, r.html) for r in pages.collect()])
    keys = [(r.url_key, r.timestamp) for r in out.orderBy("range_no", "position").collect()]
    assert keys == sorted(keys)


ROWS = [(5, "http://e.org/a", "same", "", ""), (2, "http://www.e.org/A?b=1&a=2", "same", "", ""), (9, None, "same", "", ""), (2, "http://x.org", "same", "", ""), (3, "http://e.org/\r\nInjected: x", None, "", ""), (4, "", "", "", ""), (None, "http://e.org/n", "nobody", "", ""), (None, "http://e.org/m", "same", "", ""), (7, "http://ü.org/ß", "é" * 300_000, "", ""), (8, "http://[bad", "x\r\n\r\ny", "", "")]


def test_edges(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert got(warc.capture_index(df)) == brute(ROWS)
    assert got(warc.capture_index(df, least_bytes=5)) == brute(ROWS, 5)
    assert warc.capture_index(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archives_are_plain_files(spark, monkeypatch):
    archives = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA)).collect()
    for a in archives:
        text = gzip.decompress(bytes(a.content))
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        for offset, length, raw in warc.members(bytes(a.content)):
            assert gzip.decompress(bytes(a.content)[offset : offset + length]) == raw
            headers, block = warc.parse_member(raw)
            assert "injected" not in headers and raw.endswith(block + b"\r\n\r\n")
            if headers["warc-type"] == "revisit":
                assert headers["warc-profile"] == warc.REVISIT_PROFILE and block.endswith(b"\r\n\r\n")
    names = [a.archive for a in archives]
    assert len(names) == len(set(names))


def test_damage_is_noticed():
    archive = warc.Archive("x")
    raw = warc.capture_record(1, "http://e.org", b"payload", None, None, False)
    archive.add(raw.replace(b"payload", b"paXload"))
    with pytest.raises(ValueError, match="digest"):
        warc.entries_of("x", b"".join(archive.parts))


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 7, 16])
def test_loser_tree(runs):
    rng = np.random.default_rng(runs)
    made = [sorted(((f"k{rng.integers(5)}", str(rng.integers(3)), int(rng.integers(9)), 0, "", "response", None, f"a{i}", j, 1) for j in range(int(rng.integers(0, 9)))), key=warc.entry_key) for i in range(runs)]
    merged = list(warc.LoserTree(made))
    assert list(warc.merged_runs(made, 2)) == list(warc.merged_runs(made, 3)) == merged
    assert merged == sorted((e for run in made for e in run), key=warc.entry_key)


def test_small_ranges_keep_the_order(spark):
    df = spark.createDataFrame([(i, "http://hot.org/x" if i % 3 else f"http://h{i % 11}.org/", f"body {i % 40}", "", "") for i in range(400)], SCHEMA)
    out = warc.merge_index(warc.read_archives(warc.write_archives(df)), range_entries=20)
    rows = out.orderBy("range_no", "position").collect()
    keys = [(r.url_key, r.timestamp, r.page_id) for r in rows]
    assert keys == sorted(keys) and len(keys) == 400
    ranges = defaultdict(int)
    for r in rows:
        ranges[r.range_no] += 1
    assert max(ranges.values()) < 200


@pytest.mark.parametrize(("url", "want"), [("http://www.Example.COM:80/A?b=2&a=1#f", "com,example)/a?a=1&b=2"), ("https://a.b.org", "org,b,a)/"), ("http://e.org:8080/", "org,e:8080)/"), (None, ""), ("mailto:x", "mailto:x")])
def test_url_keys(url, want):
    assert warc.url_key(url) == want


def test_revisits_name_the_response():
    response, _ = warc.parse_member(warc.capture_record(3, "http://e.org/a", b"same", None, None, False))
    revisit, block = warc.parse_member(warc.capture_record(9, "http://e.org/b", b"same", 3, "http://e.org/a", True))
    assert revisit["warc-refers-to"] == response["warc-record-id"] and revisit["warc-refers-to-target-uri"] == response["warc-target-uri"]
    assert revisit["warc-refers-to-date"] == response["warc-date"] and b"same" not in block


def test_reading_is_linear_and_large_payloads_are_whole(spark):
    """Every byte of an archive goes to the inflater once, but for a window at a record's end."""
    archive = warc.Archive("a")
    sizes = [0, 1, 50, 9_000, 300_000, 5_000_000] + [200] * 3000
    rng = np.random.default_rng(0)
    for i, n in enumerate(sizes):
        archive.add(warc.capture_record(i, f"http://h/{i}", rng.bytes(n), None, None, False))
    content = b"".join(archive.parts)
    found = [*warc.members(content)]
    captures = [warc.parse_member(raw)[1].partition(b"\r\n\r\n")[2] for _, _, raw in found if b"WARC-Type: response" in raw[:400]]
    assert [len(x) for x in captures] == sizes and sum(n for _, n, _ in found) == len(content)
    with pytest.raises(ValueError, match="breaks off"):
        [*warc.members(content[:-5])]
