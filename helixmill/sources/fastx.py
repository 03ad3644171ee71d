"""FASTA and FASTQ files as a Spark data source: `spark.read.format("fastx").load(path)`.

Plain files are cut into byte ranges, one partition each; a partition begins at the first record that starts in its range and
reads its last record to the end, wherever that lies. Gzip files, told by their suffix or first bytes, are read by one
partition each. The format of a file is told by its first byte."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "id string, header string, sequence string, quality string, file string, offset long"
SPLIT_BYTES = 64 << 20
SUFFIXES = (".fa", ".fasta", ".fna", ".fq", ".fastq", ".fa.gz", ".fasta.gz", ".fna.gz", ".fq.gz", ".fastq.gz")


class MalformedRecord(ValueError):
    """A file that is neither FASTA nor FASTQ, or a FASTQ record whose lines do not fit."""


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int | None  # None: a compressed file, read whole


def _open(path: str):
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _lines(stream, at: int) -> Iterator[tuple[int, bytes]]:
    """Lines without line ends, each with the offset of its first byte."""
    buffered = io.BufferedReader(stream, 1 << 20) if isinstance(stream, io.RawIOBase) else stream
    while line := buffered.readline():
        yield at, line.rstrip(b"\r\n")
        at += len(line)


def _fasta(lines: Iterator[tuple[int, bytes]], end: int | None):
    head, parts, begin = None, [], 0
    for at, line in lines:
        if line.startswith(b">"):
            if head is not None:
                yield begin, head, b"".join(parts), None
            if end is not None and at >= end:
                return
            head, parts, begin = line[1:], [], at
        elif head is not None:
            parts.append(line.strip())
    if head is not None:
        yield begin, head, b"".join(parts), None


def _fastq(lines: Iterator[tuple[int, bytes]], end: int | None, synced: bool):
    """Records of four lines. Within a file the first record is found by its shape: a line that begins with @, two lines
    before one that begins with +, whose sequence and quality have one length; a quality line may begin with @ too. In a
    well-formed file that is within four lines, wherever a range begins."""
    skipped = 0
    window: list[tuple[int, bytes]] = []
    for item in lines:
        window.append(item)
        if len(window) < 4:
            continue
        (at, head), (_, seq), (_, plus), (_, qual) = window
        fits = head.startswith(b"@") and plus.startswith(b"+") and len(seq) == len(qual)
        if not fits:
            if (synced or skipped >= 3) and any(x for _, x in window):
                raise MalformedRecord(f"no FASTQ record at byte {at}")
            window.pop(0)
            skipped += 1
            continue
        synced = True
        if end is not None and at >= end:
            return
        yield at, head[1:], seq, qual
        window = []
    if synced and any(x for _, x in window):
        raise MalformedRecord(f"a FASTQ record at byte {window[0][0]} is cut off")


class FastxReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options.get("path"), int(options.get("splitBytes", SPLIT_BYTES))
        if not self.path:
            raise ValueError("load() needs a path")

    @property
    def scheme(self) -> str:
        return self.path.split("://")[0] + "://" if "://" in self.path else ""

    def files(self):
        """The one file, or those of the folder whose names end as such files' do, by name."""
        from pyarrow import fs

        system, root = _open(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and i.path.lower().endswith(SUFFIXES)]
        return sorted(files, key=lambda i: i.path)

    def partitions(self):
        out = []
        for f in self.files():
            name = self.scheme + f.path
            if f.path.endswith(".gz"):
                out.append(Split(name, 0, None))
            else:
                out += [Split(name, s, min(s + self.size, f.size)) for s in range(0, f.size, self.size)]
        return out or [Split("", 0, 0)]

    def read(self, partition: Split):
        return self.records(partition)

    def records(self, partition: Split):
        """The rows of SCHEMA of the records that start in a range of bytes, in the order of the file."""
        if not partition.path:
            return
        system, path = _open(partition.path)
        if partition.end is None:
            stream, first = system.open_input_stream(path, compression="gzip"), None
        else:
            stream = system.open_input_file(path)
            first = stream.read(2)
            if first == b"\x1f\x8b":
                stream.close()
                if partition.start == 0:
                    yield from self.records(Split(partition.path, 0, None))
                return
            first = first[:1]
            stream.seek(partition.start)
        with stream:
            text = io.BufferedReader(_Raw(stream), 1 << 20)
            if first is None:
                first = text.peek(1)[:1]
            at = partition.start
            if at:  # the line that the range begins in belongs to the range before, unless it begins exactly here
                stream.seek(at - 1)
                text = io.BufferedReader(_Raw(stream), 1 << 20)
                at += len(text.readline()) - 1
            lines = _lines(text, at)
            if first == b">":
                found = _fasta(lines, partition.end)
            elif first == b"@":
                found = _fastq(lines, partition.end, partition.start == 0)
            elif not first:
                return
            else:
                raise MalformedRecord(f"{partition.path} begins with neither > nor @")
            for begin, head, seq, qual in found:
                header = head.decode()
                yield header.split(maxsplit=1)[0] if header.strip() else "", header, seq.decode(), None if qual is None else qual.decode(), partition.path, begin


class _Raw(io.RawIOBase):
    """A pyarrow stream as a raw stream, so that lines can be read from it."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        data = self.stream.read(len(target))
        target[: len(data)] = data
        return len(data)


class FastxStreamReader(DataSourceStreamReader):
    """Files that keep arriving in a folder. An offset is the size that each file had: a new file is read whole, and of one that
    has grown by whole records what was added. Files are to be moved into the folder, or grow by whole records; compressed ones are to be
    whole when they come, and one that has grown is an error, as is one that has shrunk."""

    def __init__(self, options):
        self.batch = FastxReader(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f.path: f.size for f in self.batch.files()}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        out = []
        for name, size in sorted(end.items()):
            begin = start.get(name, 0)
            if size < begin or (begin and size > begin and name.endswith(".gz")):
                raise MalformedRecord(f"{name} had {begin} bytes and has {size}")
            if name.endswith(".gz"):
                out += [] if begin else [Split(self.batch.scheme + name, 0, None)]
            else:
                out += [Split(self.batch.scheme + name, s, min(s + self.batch.size, size)) for s in range(begin, size, self.batch.size)]
        return out or [Split("", 0, 0)]

    def read(self, partition: Split):
        return self.batch.records(partition)


class FastxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastxReader:
        return FastxReader(self.options)

    def streamReader(self, schema) -> FastxStreamReader:
        return FastxStreamReader(self.options)


class _PlacedReader(FastxReader):
    def read(self, partition: Split):
        for place, row in enumerate(self.records(partition)):
            yield (*row, partition.start, place)


class _CountReader(FastxReader):
    def read(self, partition: Split):
        if partition.path:
            yield partition.path, partition.start, sum(1 for _ in self.records(partition))


class PlacedSource(FastxDataSource):
    """The records with the range of bytes that each starts in, and its number in that range, from 0."""

    @classmethod
    def name(cls) -> str:
        return "fastx_placed"

    def schema(self) -> str:
        return f"{SCHEMA}, range long, place long"

    def reader(self, schema) -> FastxReader:
        return _PlacedReader(self.options)


class CountSource(FastxDataSource):
    """How many records start in each range of bytes; the text of the records does not leave its task."""

    @classmethod
    def name(cls) -> str:
        return "fastx_counts"

    def schema(self) -> str:
        return "file string, range long, n long"

    def reader(self, schema) -> FastxReader:
        return _CountReader(self.options)


class _SpanReader(FastxReader):
    """Headers of a plain FASTA file with the bytes that their sequences take, line ends between included."""

    def read(self, partition: Split):
        if not partition.path or partition.start == partition.end:
            return
        if partition.end is None:
            raise MalformedRecord(f"{partition.path} is compressed: its sequences have no place of their own")
        system, path = _open(partition.path)
        with system.open_input_file(path) as stream:
            if stream.read(1) != b">":
                raise MalformedRecord(f"{partition.path} is no plain FASTA file")
            stream.seek(max(partition.start - 1, 0))
            text = io.BufferedReader(_Raw(stream), 1 << 20)
            at = partition.start
            if at:
                at += len(text.readline()) - 1
            head, start, end = None, 0, 0
            while line := text.readline():
                if line.startswith(b">"):
                    if head is not None:
                        yield head, partition.path, start, end
                    head = None
                    if at >= partition.end:
                        return
                    head, start = line[1:].rstrip(b"\r\n").decode(), at + len(line)
                    end = start
                elif head is not None and line.strip():
                    end = at + len(line.rstrip())
                at += len(line)
            if head is not None:
                yield head, partition.path, start, end


class SpanSource(FastxDataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx_spans"

    def schema(self) -> str:
        return "header string, file string, start long, end long"

    def reader(self, schema) -> FastxReader:
        return _SpanReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (FastxDataSource, PlacedSource, CountSource, SpanSource):
        spark.dataSource.register(source)


#: Ranges of bytes whose counts are broadcast; with more, counts and records are joined by shuffle.
MOST_RANGES = 200_000


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the cluster's own file system, where it names none and that is not the local disk."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return path if "://" in path or default.startswith("file:") else default.rstrip("/") + "/" + path.lstrip("/")


def with_ordinals(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of a file or folder with ordinal: a record's number in its file, from 0, the same at any split size.

    Two passes: records are counted in each range of bytes, counts are added up over a file's ranges, and a record's number in
    its range is added. Nothing but the counts moves."""
    register(spark)
    path = qualified(spark, path)
    load = lambda name: spark.read.format(name).option("splitBytes", split_bytes).load(path)
    ahead = F.sum("n").over(Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = load("fastx_counts").select("file", "range", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    if len(FastxReader({"path": path, "splitBytes": split_bytes}).partitions()) <= MOST_RANGES:
        counts = F.broadcast(counts)
    rows = load("fastx_placed").join(counts, ["file", "range"])
    return rows.withColumn("ordinal", F.col("place") + F.col("ahead")).drop("range", "place", "ahead")


def record_count(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> int:
    register(spark)
    return spark.read.format("fastx_counts").option("splitBytes", split_bytes).load(qualified(spark, path)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def headers(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(header) of the records of a file or folder; with a limit, of that many of them."""
    register(spark)
    rows = spark.read.format("fastx").load(qualified(spark, path)).select("header")
    return rows if limit is None else rows.limit(limit)


#: Ranges of bytes with at most so many between them are read as one, up to so many bytes at once.
GAP, AT_ONCE = 64 << 10, 8 << 20


def fetch(wanted: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """wanted (file, start, end, ...) with sequence, the bytes of the file from start to end without white space, and bytes_read, how
    many were read for the row: neighbours that are read as one are counted with the first.

    Rows of one stretch of a file are read by one task in the order of the file, and nothing else of the file is. Files are
    plain; a null or empty range has an empty sequence, one beyond the file's end is an error."""
    names = wanted.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            texts, read = [""] * len(rows), [0] * len(rows)
            some = [i for i, r in enumerate(rows) if r["file"] is not None and (r["end"] or 0) > (r["start"] or 0)]
            some.sort(key=lambda i: (rows[i]["file"], rows[i]["start"]))
            while some:
                first = rows[some[0]]
                end, group = first["end"], [some.pop(0)]
                while some and rows[some[0]]["file"] == first["file"] and rows[some[0]]["start"] <= end + GAP and max(end, rows[some[0]]["end"]) - first["start"] <= AT_ONCE:
                    end = max(end, rows[some[0]]["end"])
                    group.append(some.pop(0))
                system, path = _open(first["file"])
                with system.open_input_file(path) as stream:
                    if stream.size() < end:
                        raise MalformedRecord(f"{first['file']} ends before byte {end}")
                    stream.seek(first["start"])
                    data = stream.read(end - first["start"])
                read[group[0]] = len(data)
                for i in group:
                    part = data[rows[i]["start"] - first["start"] : rows[i]["end"] - first["start"]]
                    texts[i] = b"".join(part.split()).decode()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(read, pa.int64())], [*names, "sequence", "bytes_read"])

    near = wanted.withColumn("_stretch", F.floor(F.col("start") / split_bytes)).repartition("file", "_stretch").sortWithinPartitions("file", "start").drop("_stretch")
    schema = wanted.withColumns({"sequence": F.lit("").cast("string"), "bytes_read": F.lit(0).cast("long")}).schema
    return near.mapInArrow(run, schema)
