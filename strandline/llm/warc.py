"""WARC archives: writing with revisits, and reading by boundary-chain verification.

Writing makes each row one record of UTF-8 text; Spark's own text writer puts
them into files, with the blank lines that close a record as line separator. Of
equal payloads of 1000 bytes and more, the one with the largest page_id is a
response and the others revisit it, without the payload.

Reading splits files into ranges. A task finds in its range every place that
looks like a record's start and from its header the successor's offset. Such
places also occur inside payloads, so a place counts only if the chain from the
file's start reaches it: each task first follows its own range's chains to where
they leave it, and pointer jumping over these exits (doubling: rounds grow with
the logarithm of the ranges in a file) tells which of them the file's start
reaches. The records from there on are then read, range by range.

Payloads of any size are read whole, one at a time in memory. An empty table gives
archives without records, and no rows. Null payloads are empty. Rows without a page_id sort below all others; rows that
share the largest page_id of equal payloads are all responses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_cut, few_files

MAGIC = b"WARC/1.1\r\n"
CLOSE = "\r\n\r\n"
RANGE = 16 << 20
#: So many bytes are read for a record's header at first; more if it is longer.
HEADER = 64 << 10
#: Bytes that are read at a time when records are.
BLOCK = 4 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "file string, offset long, record_type string, page_id long, uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def with_revisits(df: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least: int = 1000) -> DataFrame:
    """page_id, url, payload, size, digest, refers_to (null: a response).

    Only digests and ids are grouped, with partial sums. The repeated payloads are
    written as a table, so Spark knows its size: if small it is sent to the rows,
    and no payload is shuffled; else a payload that very many rows share is a
    skewed key of a plain join, which adaptive execution splits.
    """
    rows = df.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    # Equal by length, SHA-1 and a second hash: payloads of one SHA-1 alone can be forged.
    rows = rows.withColumn("same", F.when(F.col("size") >= least, F.concat_ws("/", "size", "digest", F.xxhash64("payload"))))
    first = rows.filter("same is not null").groupBy("same").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = rows.join(cut(first, "repeated"), "same", "left")
    return joined.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("same", "first")


def record_text(df: DataFrame, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """``value``: each row as a record, without the blank lines that close it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(CLOSE))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    clean = F.translate(F.coalesce("url", F.lit("")), "\r\n", "")
    header = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"),
        F.lit("\r\nWARC-Date: " + date + "\r\nWARC-Target-URI: "), clean,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT}\r\nWARC-Refers-To: <urn:x-page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit(CLOSE),
    )
    return df.withColumn("block", block).select(F.concat(header, F.col("block")).alias("value"))


def write(df: DataFrame, path: str, **options) -> None:
    """Write the rows of ``df`` as archives under ``path``."""
    record_text(with_revisits(df, **options)).write.option("lineSep", CLOSE).mode("errorifexists").text(path)


# -- reading ----------------------------------------------------------------------


def _open(uri: str):
    """A file for reading at any place, on whatever store its address names."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def parse_header(data: bytes, at: int, short: bool = False) -> tuple[dict[str, str], int] | bool | None:
    """Named fields of the header at ``at``, and where its block begins; None if it is no header.

    With ``short``, ``data`` isn't all of the file: False says that more of it is needed.
    """
    unknown = False if short else None
    if data[at : at + len(MAGIC)] != MAGIC:
        return unknown if MAGIC.startswith(data[at : at + len(MAGIC)]) else None
    fields: dict[str, str] = {}
    at += len(MAGIC)
    while (end := data.find(b"\r\n", at)) > at:
        name, colon, value = data[at:end].decode("utf-8", "replace").partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
        at = end + 2
    if end < 0:
        return unknown
    if not fields.get("content-length", "").isdigit():
        return None
    return fields, end + 2


def read_header(f, at: int, size: int) -> tuple[bytes, tuple[dict[str, str], int] | None]:
    """What was read from ``at`` on, and its header: as much as that takes."""
    data, parsed, want = b"", False, HEADER
    while parsed is False:
        f.seek(at + len(data))
        data += f.read(min(want, size - at) - len(data))
        parsed = parse_header(data, 0, at + len(data) < size)
        want *= 2
    return data, parsed


class Forward:
    """A file that is read once from front to back, in blocks, by someone who looks at any place from the last one on."""

    def __init__(self, f, size: int, end: int, block: int = BLOCK):
        self.f, self.size, self.end, self.block = f, size, end, block
        self.base, self.data = 0, b""

    def at(self, place: int, n: int) -> bytes:
        """``n`` bytes from ``place`` on, or as many as the file has."""
        have = self.base + len(self.data)
        if place + n > have and have < self.size:
            kept = self.data[place - self.base :] if self.base <= place < have else b""
            start = place + len(kept)
            # No block reaches over the range's end but for what is asked for.
            want = max(n - len(kept), min(self.block, self.end - start))
            self.f.seek(start)
            self.base, self.data = place, kept + self.f.read(min(want, self.size - start))
        return self.data[place - self.base : place - self.base + n]

    def header(self, place: int) -> tuple[dict[str, str], int] | None:
        """The header at ``place`` and its length, however long; None if there is none."""
        n, parsed = 2048, False
        while parsed is False:
            data = self.at(place, n)
            parsed = parse_header(data, 0, place + len(data) < self.size)
            n *= 4
        return parsed


def find_candidates(data: bytes, base: int, limit: int, more: Callable[[int], tuple[dict[str, str], int] | None] | None = None) -> dict[int, int]:
    """Offset of each place under ``limit`` that looks like a record, and its successor's.

    ``more`` parses the header at an offset of the file, for headers that ``data`` doesn't hold to their end.
    """
    out, at = {}, data.find(MAGIC)
    while 0 <= at < limit:
        parsed = parse_header(data, at, more is not None)
        if parsed is False:
            parsed = more(base + at)
        if parsed:
            fields, body = parsed
            out[base + at] = base + body + int(fields["content-length"]) + 4
        at = data.find(MAGIC, at + 1)
    return out


def exits(successors: dict[int, int]) -> dict[int, int]:
    """Where the chain from each candidate leaves the range: the first offset that is no candidate in it."""
    out: dict[int, int] = {}
    for at in sorted(successors, reverse=True):
        nxt = successors[at]
        out[at] = out.get(nxt, nxt)
    return out


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """file, size of all archives under ``path``; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("size")).filter("size > 0")


def ranges_of(files: DataFrame, width: int) -> DataFrame:
    return files.select("file", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / width))).alias("part"))


def dealt(rows: DataFrame, most: int = 50_000) -> DataFrame:
    """Rows that stand for ranges, one to a task: they are few bytes, so adaptive execution would put them all together."""
    return rows.repartition(max(1, min(most, rows.count())))


def chain_links(ranges: DataFrame, width: int) -> DataFrame:
    """file, part, offset, leaves: each candidate and where its chain leaves its range."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, part in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                start = part * width
                with _open(file) as f:
                    f.seek(start)
                    data = f.read(min(width + HEADER, size - start))

                    def more(at: int, f=f, start=start, size=size) -> tuple[dict[str, str], int] | None:
                        parsed = read_header(f, at, size)[1]
                        return parsed and (parsed[0], at - start + parsed[1])

                    leaves = exits(find_candidates(data, start, width, more if start + len(data) < size else None))
                n = len(leaves)
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([part] * n, pa.int64()), pa.array(list(leaves), pa.int64()), pa.array(list(leaves.values()), pa.int64())], names=["file", "part", "offset", "leaves"])

    return dealt(ranges).mapInArrow(scan, "file string, part long, offset long, leaves long")


def verified_entries(links: DataFrame, rounds: int = 64) -> DataFrame:
    """file, part, offset: the first record in each range that the file's start reaches."""
    links = cut(links, "links")
    files = few_files(links.sparkSession, links.count())
    # Only the file's start and places at which some chain enters a range can be entries.
    targets = links.select("file", F.col("leaves").alias("offset")).distinct()
    entry = links.join(targets, ["file", "offset"], "left_semi").unionByName(links.filter("offset = 0")).distinct()
    entry = entry.select("file", "part", "offset", F.col("leaves").alias("next"), (F.col("offset") == 0).alias("reached"))
    now = cut(entry, "jumps", files=files)
    for _ in range(rounds):
        jump = now.select("file", F.col("offset").alias("next"), F.col("next").alias("after"))
        hit = now.filter("reached").select("file", F.col("next").alias("offset"), F.lit(True).alias("hit")).distinct()
        step = now.join(jump, ["file", "next"], "left").join(hit, ["file", "offset"], "left")
        # A pointer past the last entry stays where it is.
        new = cut(step.select("file", "part", "offset", F.coalesce("after", "next").alias("next"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached"), F.col("after").isNotNull().alias("moved")), "jumps", files=files)
        drop_cut(now)
        now = new
        if not now.filter("moved").limit(1).count():
            break
    else:
        raise RuntimeError("pointers have not settled")
    out = cut(now.filter("reached").groupBy("file", "part").agg(F.min("offset").alias("offset")), "entries", files=files)
    drop_cut(now)
    drop_cut(links)
    return out


def read(spark: SparkSession, path: str, width: int = RANGE) -> DataFrame:
    """All records of the archives under ``path``: the columns of ``RECORD``.

    Payloads are what follows the HTTP header of a block; revisits have none.
    ``payload_bytes`` is the length of the full payload, from the HTTP header.
    A file whose start is no record has no records; a record cut short at a file's end is left out.
    Anything else than a record where the chain of records leads is an error.
    """
    files = files_of(spark, path)
    entries = verified_entries(chain_links(ranges_of(files, width), width))

    def page(text: str | None) -> int | None:
        digits = (text or "").rpartition(":")[2].rstrip(">")
        return int(digits) if digits.lstrip("-").isdigit() else None

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in RECORD.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for file, part, at in zip(*[batch.column(n).to_pylist() for n in ("file", "part", "offset")], strict=True):
                end, rows, held = (part + 1) * width, [], 0
                with _open(file) as f:
                    size = f.size()
                    bytes_of = Forward(f, size, min(end, size))
                    while at < min(end, size):
                        parsed = bytes_of.header(at)
                        if not parsed:
                            break
                        fields, body = parsed
                        length = int(fields["content-length"])
                        if at + body + length > size:
                            break
                        block = bytes_of.at(at + body, length)
                        head, _, payload = block.partition(b"\r\n\r\n")
                        full = next((int(x[15:]) for x in head.split(b"\r\n") if x[:15].lower() == b"content-length:"), len(payload))
                        kind = fields.get("warc-type")
                        rows.append((file, at, kind, page(fields.get("warc-record-id")), fields.get("warc-target-uri"), full, fields.get("warc-payload-digest", "").removeprefix("sha1:"), page(fields.get("warc-refers-to")), None if kind == "revisit" else payload))
                        held += length
                        at += body + length + 4
                        if held > 8 << 20:
                            yield out(rows)
                            rows, held = [], 0
                    # Where no record is, the next range's task has nothing to start from.
                    if at < size and bytes_of.header(at) is None:
                        data = bytes_of.at(at, HEADER)
                        if data.strip() and parse_header(data, 0, True) is None:
                            raise ValueError(f"no record at offset {at} of {file}")
                if rows:
                    yield out(rows)

    return dealt(entries).mapInArrow(records, RECORD)


def archive_report(pages: DataFrame, path: str, width: int = RANGE) -> DataFrame:
    """Write ``pages`` under ``path`` and read them back.

    page_id, payload_bytes, payload_digest, record_type, refers_to for every record; responses'
    sizes and digests are those of the payload that was read.
    """
    write(pages, path)
    found = read(pages.sparkSession, path, width)
    own = F.col("payload").isNotNull()
    return found.select(
        "page_id",
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
