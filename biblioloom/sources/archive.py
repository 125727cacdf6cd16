"""Lines of zip archives as a Spark data source: a task for each member, and for each byte range of a stored one.

``spark.read.format("archive_lines").load(path)`` gives (archive, member, value) for one archive or a folder of them. Only the
directories of the archives are read to plan the tasks. A task reads its member as a stream in pieces of ``PIECE`` bytes, so
an archive or a member may be larger than a task's memory. Members that are stored without compression are cut
into ranges of ``range_bytes`` (an option); a line belongs to the range in which it begins. A compressed member cannot be
entered in its middle and is one task.

Paths are those of ``pyarrow.fs`` (local, ``hdfs://``, ``s3://``, …), as Python tasks do not reach Spark's own readers.
"""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES, PIECE = 64 << 20, 4 << 20
SCHEMA = "archive string, member string, value string"


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    """A member of an archive, or the bytes from ``start`` to ``stop`` of one that is stored at ``at``."""

    archive: str
    member: str
    at: int = -1
    start: int = 0
    stop: int = -1
    size: int = 0


def parts_of(archive: str, range_bytes: int) -> list[Part]:
    system, path = located(archive)
    out = []
    with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            if info.compress_type != zipfile.ZIP_STORED or info.flag_bits & 1:
                out.append(Part(archive, info.filename))
                continue
            f.seek(info.header_offset + 26)
            name, extra = struct.unpack("<HH", f.read(4))
            at = info.header_offset + 30 + name + extra
            out += [Part(archive, info.filename, at, s, min(s + range_bytes, info.file_size), info.file_size) for s in range(0, max(info.file_size, 1), range_bytes)]
    return out


def _pieces(part: Part) -> Iterator[bytes]:
    """The bytes of whole lines of a part, piece by piece."""
    system, path = located(part.archive)
    with system.open_input_file(path) as f:
        if part.at < 0:
            with zipfile.ZipFile(f) as z, z.open(part.member) as m:
                while piece := m.read(PIECE):
                    yield piece
            return
        # from the byte before the range: what ends there began in the range before
        at = max(part.start - 1, 0)
        f.seek(part.at + at)
        inside, held = part.start == 0, at
        while held < part.size:
            piece = f.read(min(PIECE, part.size - held))
            if not piece:
                return
            base, held = held, held + len(piece)
            if not inside:
                cut = piece.find(b"\n")
                if cut < 0:
                    if held >= part.stop:
                        return
                    continue
                inside, base, piece = True, base + cut + 1, piece[cut + 1 :]
                if base >= part.stop:
                    return
            if held >= part.stop:  # the last line goes on to its end beyond the range
                end = piece.find(b"\n", max(part.stop - 1 - base, 0))
                if end >= 0:
                    yield piece[: end + 1]
                    return
            yield piece


def lines_of(part: Part) -> Iterator[pa.RecordBatch]:
    names, rest = ["archive", "member", "value"], b""

    def batch(rows: list[bytes]) -> pa.RecordBatch:
        values = pa.array([r.decode("utf-8", "replace").rstrip("\r") for r in rows], pa.string())
        return pa.RecordBatch.from_arrays([pa.array([part.archive] * len(rows), pa.string()), pa.array([part.member] * len(rows), pa.string()), values], names)

    for piece in _pieces(part):
        rows = (rest + piece).split(b"\n")
        rest = rows.pop()
        if rows:
            yield batch(rows)
    if rest:
        yield batch([rest])


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Part]:
        system, path = located(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        head = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        files = [path] if info.is_file else sorted(x.path for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file and x.path.endswith(".zip"))
        return [p for f in files for p in parts_of(f"{head}{f}", self.range_bytes)] or [Part("", "")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.archive:
            yield from lines_of(partition)


class ArchiveLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(archive, member, value) of the archive or folder of archives at ``path``."""
    spark.dataSource.register(ArchiveLines)
    return spark.read.format("archive_lines").option("range_bytes", range_bytes).load(path)


def write_archives(lines: DataFrame, path: str, stored: bool = True) -> None:
    """Lines (value) as archives in the folder ``path``, one for each partition, written by the tasks."""
    kind = zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED
    system, folder = located(path)
    system.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = located(path)
        target = f"{folder}/part-{context.partitionId():05d}.zip"
        draft, rows = f"{folder}/.part-{context.partitionId():05d}-{context.taskAttemptId()}", 0
        with system.open_output_stream(draft) as f, zipfile.ZipFile(f, "w", kind) as z, z.open("lines.json", "w", force_zip64=True) as m:
            for b in batches:
                for v in b.column(0).to_pylist():
                    m.write(((v or "") + "\n").encode())
                    rows += 1
        system.move(draft, target)  # a task that runs again writes the same file
        yield pa.RecordBatch.from_arrays([pa.array([rows])], ["n"])

    lines.select("value").mapInArrow(write, "n long").agg(F.sum("n")).collect()
