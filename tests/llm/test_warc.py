"""Archives: round trips, false starts inside payloads, and reading in ranges of any size."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import warc

SCHEMA = "page_id long, url string, html string"


def trap(offset: int) -> str:
    """A payload with whole records inside, their lengths leading here and there."""
    inner = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:666>\r\nContent-Length: {offset}\r\n\r\n"
    return "start\r\n\r\n" + inner + "HTTP/1.1 200 OK\r\n\r\nfake" + "\r\n\r\n" + inner + "x" * 40


def pages() -> list[tuple]:
    rng = random.Random(1)
    long = "".join(rng.choices("<p>abc é日\n", k=1500))
    rows = [(k, f"http://x/{k}", "".join(rng.choices("<a>\r\n bé", k=rng.randint(0, 900)))) for k in range(40)]
    rows += [(100 + k, None, trap(n)) for k, n in enumerate((0, 3, 25, 60, 10**6))]
    rows += [(200 + k, "http://same", long) for k in range(7)] + [(300 + k, "u", "short" * 100) for k in range(3)]
    rows += [(206, "http://again", long), (None, "http://none", long), (400, "u", None), (401, "u\r\nX: y", ""), (402, "u", "é" * 500), (403, "u", "é" * 500), (404, "u", "a" * 1000), (405, "u", "a" * 1000), (406, "u", "a" * 999), (407, "u", "a" * 999)]
    return rows


def expected(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        first = max(same, default=None) if len(data) >= 1000 else page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "response" if first == page else "revisit", None if first == page else first))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [512, 5000, warc.RANGE])
def test_round_trip(spark, tmp_path, width):
    df = spark.createDataFrame(pages(), SCHEMA)
    found = warc.archive_report(df, str(tmp_path / "a"), width)
    assert sorted(map(tuple, found.collect()), key=repr) == expected(pages())


def test_payloads_come_back(spark, tmp_path):
    df = spark.createDataFrame(pages(), SCHEMA).coalesce(1)
    warc.write(df, str(tmp_path / "a"))
    found = {r.page_id: r for r in warc.read(spark, str(tmp_path / "a"), 700).collect() if r.page_id is not None and r.record_type == "response"}
    for page, url, html in pages():
        if page in found and page != 206:
            assert found[page].payload.decode() == (html or "")
            assert found[page].uri == (url or "").replace("\r", "").replace("\n", "")


def test_records_without_a_chain_are_rejected(spark, tmp_path):
    record = lambda n, body: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{n}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    head = "HTTP/1.1 200 OK\r\n\r\n"
    # The inner record's successor is a true boundary, and yet nothing leads to it.
    inner = record(2, head + "inside")
    outer = record(1, head + "x" * 300 + inner.decode() + "y" * 300)
    good = outer + record(3, head + "last")
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "good.warc").write_bytes(good)
    (folder / "no_start.warc").write_bytes(b"junk" + good)
    (folder / "cut.warc").write_bytes(good[:-9])
    (folder / "empty.warc").write_bytes(b"")
    for width in (64, 333, 1 << 20):
        rows = warc.read(spark, str(folder), width).select(F.element_at(F.split("file", "/"), -1).alias("f"), "page_id", "offset").collect()
        assert sorted(map(tuple, rows)) == [("cut.warc", 1, 0), ("good.warc", 1, 0), ("good.warc", 3, len(outer))]


@pytest.mark.parametrize("width", [512, 70_000, warc.RANGE])
def test_long_addresses(spark, tmp_path, width):
    rows = [(1, "http://x/1", "one"), (2, "data:" + "é" * 50_000, "two"), (3, "data:" + "x" * 300_000, "three"), (4, "http://x/4", "four")]
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "a"))
    found = warc.read(spark, str(tmp_path / "a"), width).collect()
    assert sorted((r.page_id, r.uri, r.payload.decode()) for r in found) == rows


@pytest.mark.parametrize("width", [64, 1 << 20])
def test_a_chain_that_leads_nowhere_is_an_error(spark, tmp_path, width):
    body = "HTTP/1.1 200 OK\r\n\r\nbody"
    record = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "bad.warc").write_text(record + "junk" * 40 + record, newline="")
    with pytest.raises(Exception, match=f"no record at offset {len(record)}"):
        warc.read(spark, str(tmp_path), width).collect()
    (tmp_path / "bad.warc").write_text(record + record[:40], newline="")
    assert warc.read(spark, str(tmp_path), width).count() == 1


def test_exits_follow_chains():
    assert warc.exits({0: 10, 10: 25, 25: 90, 12: 25, 30: 31}) == {0: 90, 10: 90, 25: 90, 12: 90, 30: 31}


def test_long_chains_settle(spark):
    rows = [("f", k, 10 * k, 10 * (k + 1)) for k in range(100)] + [("f", k, 10 * k + 3, 10 * (k + 1) + 3) for k in range(5, 90)] + [("g", 0, 5, 50)]
    links = spark.createDataFrame(rows, "file string, part long, offset long, leaves long")
    found = sorted((r.file, r.offset) for r in warc.verified_entries(links).collect())
    assert found == [("f", 10 * k) for k in range(100)]


def test_empty_table(spark, tmp_path):
    assert warc.archive_report(spark.createDataFrame([], SCHEMA), str(tmp_path / "a")).count() == 0
