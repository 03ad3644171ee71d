"""Text files for other tools as a Spark sink: df.write.format("records").option("kind", "fasta").mode("append").save(folder).

Each task writes one file beside the folder's others, under a name that no reader looks at. Only when all tasks are done are the files
given their names, which sort as the partitions do; a failed task's file is removed by it, and those of the others when the write is
given up. So a folder has the records of finished writes alone. Kinds: fasta (header, sequence), fastq (header, sequence, quality),
vcf (line; the header in a file that sorts first) and lines (line). gzip=true compresses each file."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .fastx import _open, qualified

#: Header lines of a variant file.
VCF_HEADER = [
    "##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="Coverage">', '##INFO=<ID=AC,Number=1,Type=Integer,Description="Observations">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",
]
COLUMNS = {"fasta": ["header", "sequence"], "fastq": ["header", "sequence", "quality"], "vcf": ["line"], "lines": ["line"]}
_BUFFER = 4 << 20


def _text(kind: str, row: tuple) -> str:
    if kind == "fasta":
        return f">{row[0]}\n{row[1] or ''}\n"
    if kind == "fastq":
        return f"@{row[0]}\n{row[1] or ''}\n+\n{row[2] or ''}\n"
    return f"{row[0]}\n"


@dataclass
class Written(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class RecordWriter(DataSourceWriter):
    def __init__(self, options, schema, overwrite: bool):
        self.folder, self.kind = options.get("path"), options.get("kind", "lines")
        self.gzip = options.get("gzip", "false").lower() == "true"
        if not self.folder or self.kind not in COLUMNS:
            raise ValueError(f"save() needs a path and a kind of {sorted(COLUMNS)}")
        names = [f.name for f in schema.fields]
        if missing := [c for c in COLUMNS[self.kind] if c not in names]:
            raise ValueError(f"{self.kind} needs the columns {missing}")
        self.at = [names.index(c) for c in COLUMNS[self.kind]]
        self.run, self.overwrite = uuid.uuid4().hex, overwrite

    def _name(self, path: str, name: str) -> str:
        return f"{path.rstrip('/')}/{name}"

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, folder = _open(self.folder)
        system.create_dir(folder, recursive=True)
        path = self._name(folder, f"_writing-{self.run}-{task.partitionId():06d}-{task.taskAttemptId()}")
        rows = 0
        try:
            with system.open_output_stream(path) as raw:
                out = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) if self.gzip else raw
                waiting, size = [], 0
                for row in iterator:
                    text = _text(self.kind, tuple(row[i] for i in self.at))
                    waiting.append(text)
                    size += len(text)
                    rows += 1
                    if size >= _BUFFER:
                        out.write("".join(waiting).encode())
                        waiting, size = [], 0
                out.write("".join(waiting).encode())
                if self.gzip:
                    out.close()
        except BaseException:
            system.delete_file(path)
            raise
        return Written(task.partitionId(), path, rows)

    def _leftovers(self, system, folder: str) -> list[str]:
        from pyarrow import fs

        if system.get_file_info(folder).type == fs.FileType.NotFound:
            return []
        return [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith(f"_writing-{self.run}-")]

    def commit(self, messages: list) -> None:
        """Names in the order of partitions. A task that ran twice has one message; the other's file is removed."""
        from pyarrow import fs

        system, folder = _open(self.folder)
        system.create_dir(folder, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("part-")] if self.overwrite else []
        for path in old:
            system.delete_file(path)
        end = f".{self.kind if self.kind != 'lines' else 'txt'}" + (".gz" if self.gzip else "")
        if self.kind == "vcf":
            head = "".join(f"{line}\n" for line in VCF_HEADER).encode()
            with system.open_output_stream(self._name(folder, f"part-{self.run}-000000{end}")) as f:
                f.write(gzip.compress(head, mtime=0) if self.gzip else head)
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            if m.rows:
                system.move(m.path, self._name(folder, f"part-{self.run}-{m.partition + 1:06d}{end}"))
        for path in self._leftovers(system, folder):
            system.delete_file(path)

    def abort(self, messages: list) -> None:
        system, folder = _open(self.folder)
        for path in self._leftovers(system, folder):
            system.delete_file(path)


class RecordSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        raise NotImplementedError("records are read with the format fastx")

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSink)


def save(df: DataFrame, path: str, kind: str, order: list[str] | None = None, gzip: bool = False, mode: str = "append") -> None:
    """df into the folder path as records of a kind; with an order, files and records in them are in it."""
    register(df.sparkSession)
    rows = df if order is None else df.orderBy(*order)
    rows.select(*COLUMNS[kind]).write.format("records").option("kind", kind).option("gzip", str(gzip).lower()).mode(mode).save(qualified(df.sparkSession, path))
