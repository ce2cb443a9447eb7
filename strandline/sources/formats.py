"""``spark.read.format("fasta")`` and ``"fastq"``, in batches and as streams: sequence files by ranges of bytes.

A file is cut into ranges of ``split`` bytes (64 MB; a gzipped file is one range). A record
belongs to the range in which its header begins and is read to its end, so ranges are read side
by side and no record is parted. Rows: seq_id, seq, (FASTQ: quality,) file, at (the byte at which
the record begins). A schema given to the reader names the columns that are made. Equality and
``isin`` filters on seq_id, and nulls, are looked at before a sequence is put together, where
``spark.sql.python.filterPushdown.enabled`` is set (``register`` sets it).

With ``pieces`` (FASTA), a file's sequences come in pieces of at most so many bytes, each read by
itself: file, at, begins (the record's id where a piece begins one), seq, ended (a blank line, after which a
record has no more letters). ``files.fasta_pieces`` puts ids and places to them, so that one record of any
length is read by many tasks.

Stores are those that ``pyarrow.fs`` knows. A stream takes files in the order in which they were
last changed; those that appear must be newer than those read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

KINDS = {"seq_id": pa.string(), "seq": pa.string(), "quality": pa.string(), "file": pa.string(), "at": pa.int64(), "begins": pa.string(), "ended": pa.bool_()}
#: Bytes of a range, of a read, and of sequences in a batch.
SPLIT, READ, BATCH = 64 << 20, 1 << 20, 8 << 20


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int

    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def listed(paths: list[str]) -> list[tuple[str, int, int]]:
    """(path, size, time of last change) of files, and of the files in folders but for hidden ones, by path."""
    out = []
    for p in paths:
        store, root = fs.FileSystem.from_uri(p if re.match(r"\w+:/", p) else f"file://{p}")
        prefix = p[: len(p) - len(root)] if p.endswith(root) else ""
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(p)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
        out += [(prefix + f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_."]
    return sorted(out)


def opened(path: str):
    store, root = fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")
    return store.open_input_file(root)


def lines_from(path: str, begin: int) -> Iterator[tuple[int, bytes]]:
    """(place, line without its end) from the first line on that begins at ``begin`` or later; gzipped files from their beginning."""
    with opened(path) as file:
        unzip = zlib.decompressobj(31) if path.endswith(".gz") else None
        at, held = (begin - 1, b"") if begin else (0, b"")
        skip = bool(begin)
        if begin:
            file.seek(begin - 1)
        while True:
            block = file.read(READ)
            if unzip and block:
                data = b""
                while block:
                    data += unzip.decompress(block)
                    block = unzip.unused_data
                    if block:
                        # Files may be several gzip members one after another.
                        unzip = zlib.decompressobj(31)
                last = False
            else:
                data, last = block, not block
            held += data
            parts = held.split(b"\n")
            held = b"" if last else parts.pop()
            for line in parts if not last or parts != [b""] else []:
                if not skip:
                    yield at, line.rstrip(b"\r")
                skip = False
                at += len(line) + 1
            if last:
                return


def fasta_records(part: Range, wanted: set | None) -> Iterator[dict]:
    """Records whose header begins in the range. Sequences end at a blank line."""
    record, lines, open_ = None, [], False

    def done() -> Iterator[dict]:
        if record is not None:
            seq = b"".join(lines).decode()
            if record[1] or seq:
                yield {"seq_id": record[1], "seq": seq, "file": part.path, "at": record[0]}

    for at, line in lines_from(part.path, part.begin):
        head = line.startswith(b">")
        if head or at == 0:
            yield from done()
            if at >= part.end:
                return
            name = (line[1:] if head else line).decode("utf-8", "replace").split()
            name = name[0] if name else ""
            record, lines, open_ = ((at, name) if wanted is None or name in wanted else None), [], True
        elif record is not None and open_:
            open_ = bool(line.strip())
            lines.append(b"".join(line.split()))
    yield from done()


def fasta_pieces(part: Range, most: int) -> Iterator[dict]:
    """The range's lines, whole, in pieces that neither hold two records nor over ``most`` bytes (or one line)."""
    begins, lines, held, ended, start = None, [], 0, False, None

    def done() -> Iterator[dict]:
        if start is not None:
            yield {"file": part.path, "at": start, "begins": begins, "seq": b"".join(lines).decode(), "ended": ended}

    for at, line in lines_from(part.path, part.begin):
        if at >= part.end:
            break
        head = line.startswith(b">") or at == 0
        if head or held + len(line) > most or start is None:
            yield from done()
            begins, lines, held, ended, start = None, [], 0, False, at
        if head:
            name = line.removeprefix(b">").decode("utf-8", "replace").split()
            begins = name[0] if name else ""
        elif not line.strip():
            ended = True
        elif not ended:
            lines.append(b"".join(line.split()))
            held += len(line)
    yield from done()


LETTERS = re.compile(rb"[A-Za-z.*~-]+\s*\Z")


def fastq_records(part: Range, wanted: set | None) -> Iterator[dict]:
    """Records whose header begins in the range.

    A range begins with the first line that begins with @ and opens a record: lines of letters, a
    line that begins with +, and as many qualities. Qualities may begin with @ or +, too: what comes after
    them then isn't a record, so the next line is tried.
    """
    lines = lines_from(part.path, part.begin)
    held: list[tuple[int, bytes]] = []

    def line(k: int) -> tuple[int, bytes] | None:
        while len(held) <= k:
            found = next(lines, None)
            if found is None:
                return None
            held.append(found)
        return held[k]

    in_step = part.begin == 0
    while (first := line(0)) is not None and first[0] < part.end:
        if not first[1].startswith(b"@"):
            held.pop(0)
            continue
        k, seq = 1, []
        while (now := line(k)) is not None and LETTERS.match(now[1]):
            seq.append(now[1].strip())
            k += 1
        if not seq or now is None or not now[1].startswith(b"+"):
            if in_step and seq and now is None:
                yield from _fastq_row(part, first, b"".join(seq), None, wanted)
                return
            held.pop(0)
            continue
        size, k, quality = sum(map(len, seq)), k + 1, []
        while sum(map(len, quality)) < size and (now := line(k)) is not None:
            quality.append(now[1].strip())
            k += 1
        after = line(k)
        while after is not None and not after[1].strip():
            k += 1
            after = line(k)
        whole = sum(map(len, quality)) >= size and (after is None or after[1].startswith(b"@"))
        if not whole and not in_step:
            held.pop(0)
            continue
        in_step = True
        yield from _fastq_row(part, first, b"".join(seq), b"".join(quality) or None, wanted)
        del held[:k]


def _fastq_row(part: Range, first: tuple[int, bytes], seq: bytes, quality: bytes | None, wanted: set | None) -> Iterator[dict]:
    name = first[1][1:].decode("utf-8", "replace").split()
    name = name[0] if name else ""
    if wanted is None or name in wanted:
        yield {"seq_id": name, "seq": seq.decode(), "quality": None if quality is None else quality.decode("utf-8", "replace"), "file": part.path, "at": first[0]}


class _Files:
    """What batches and streams share: options, ranges of files, rows of a range."""

    def __init__(self, source: SequenceSource, schema: StructType):
        options = source.options
        self.kind, self.columns = source.name(), schema.fieldNames()
        self.split = int(options.get("split", SPLIT))
        self.pieces = int(options.get("pieces", 0))
        # One path, or several parted by line ends (``load`` takes a single one).
        self.paths = options["path"].split("\n")
        self.wanted: set | None = None
        if unknown := set(self.columns) - set(KINDS):
            raise ValueError(f"no such columns in {self.kind} files: {sorted(unknown)}")

    def ranges(self, files: list[tuple[str, int, int]]) -> list[Range]:
        out = []
        for path, size, _ in files:
            cuts = [0] if path.endswith(".gz") else range(0, size, self.split)
            out += [Range(path, a, 1 << 62 if len(cuts) == 1 else min(size, a + self.split)) for a in cuts]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if self.kind == "fastq":
            rows = fastq_records(partition, self.wanted)
        elif self.pieces:
            rows = fasta_pieces(partition, self.pieces)
        else:
            rows = fasta_records(partition, self.wanted)
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in held], KINDS[c]) for c in self.columns], names=self.columns)

        for row in rows:
            held.append(row)
            size += len(row["seq"]) + 100
            if size > BATCH:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


class BatchReader(_Files, DataSourceReader):
    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("seq_id",) and not self.pieces:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            elif not (isinstance(f, IsNotNull) and f.attribute == ("seq_id",) and not self.pieces):
                yield f

    def partitions(self) -> list[Range]:
        return self.ranges(listed(self.paths))


class StreamReader(_Files, DataSourceStreamReader):
    """Offsets: the time of the last files read, and how many of that time, by path."""

    def initialOffset(self) -> dict:
        return {"time": 0, "files": 0}

    def _between(self, start: dict, end: dict) -> list[tuple[str, int, int]]:
        order = sorted(listed(self.paths), key=lambda f: (f[2], f[0]))
        place, last, out = 0, None, []
        for f in order:
            place, last = (place + 1 if f[2] == last else 1), f[2]
            if (start["time"], start["files"]) < (f[2], place) <= (end["time"], end["files"]):
                out.append(f)
        return out

    def latestOffset(self) -> dict:
        times = [f[2] for f in listed(self.paths)]
        return {"time": max(times), "files": times.count(max(times))} if times else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(self._between(start, end))

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class SequenceSource(DataSource):
    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(self, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(self, schema)


class FastaSource(SequenceSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "file string, at long, begins string, seq string, ended boolean" if int(self.options.get("pieces", 0)) else "seq_id string, seq string, file string, at long"


class FastqSource(SequenceSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "seq_id string, seq string, quality string, file string, at long"


def register(spark: SparkSession) -> SparkSession:
    """Makes both formats known to the session, with their filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FastaSource, FastqSource):
        spark.dataSource.register(source)
    return spark
