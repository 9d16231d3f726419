"""The ``bundle`` format: JSON lines in parts, and a manifest that makes them one.

Tasks write a part each and return its name, length and checksum; the commit
puts these into ``manifest.json``, written aside and then moved into place. A
reader takes the parts the manifest names and nothing else, so parts of failed,
repeated or unfinished attempts are never read, and a folder without a manifest
holds no bundle. Parts are numbered in the order of the frame's partitions: a
sorted frame is a bundle in that order. A second write replaces the first; only
one job may write a folder at a time.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "bundle"
MANIFEST = "manifest.json"
SCHEMA = "section string, story_id long, chunk long, line string"
BATCH_BYTES = 4 << 20
BODY = ',"body":'


def place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system a folder lies in, and its path there."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


def read_manifest(folder: str) -> dict | None:
    system, path = place(folder)
    name = f"{path}/{MANIFEST}"
    if system.get_file_info(name).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(name) as stream:
        return json.loads(stream.read())


@dataclass
class Part(WriterCommitMessage):
    """What a task has written; without a name it had no rows."""

    number: int
    file: str | None = None
    rows: int = 0
    bytes: int = 0
    crc32: int = 0
    sections: dict = field(default_factory=dict)


@dataclass
class Piece(InputPartition):
    part: dict


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool, generated_at: str | None):
        if not overwrite and read_manifest(folder) is not None:
            raise ValueError(f"{folder} holds a bundle; write it whole, with mode overwrite")
        self.folder, self.generated_at, self.run = folder, generated_at, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        part, sections, stream = Part(task.partitionId()), Counter(), None
        system, path = place(self.folder)
        name = f"part-{part.number:06d}-{self.run}-{task.taskAttemptId()}.jsonl"
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if stream is None:
                        system.create_dir(path, recursive=True)
                        stream = system.open_output_stream(f"{path}/{name}")
                    head = json.dumps({k: row[k] for k in ("section", "story_id", "chunk")}, separators=(",", ":"))
                    line = f"{head[:-1]}{BODY}{row['line']}}}\n".encode()
                    stream.write(line)
                    part.rows, part.bytes, part.crc32 = part.rows + 1, part.bytes + len(line), zlib.crc32(line, part.crc32)
                    sections[row["section"]] += 1
        finally:
            if stream is not None:
                stream.close()
                part.file = name
        part.sections = dict(sections)
        return part

    def commit(self, messages: list[Part | None]) -> None:
        before = read_manifest(self.folder)
        parts = sorted((m for m in messages if m is not None and m.file), key=lambda m: m.number)
        total = Counter()
        for part in parts:
            total.update(part.sections)
        manifest = {
            "generated_at": self.generated_at, "rows": sum(p.rows for p in parts), "sections": dict(sorted(total.items())),
            "parts": [{"file": p.file, "rows": p.rows, "bytes": p.bytes, "crc32": p.crc32} for p in parts],
        }
        system, path = place(self.folder)
        system.create_dir(path, recursive=True)
        aside = f"{path}/.{MANIFEST}-{self.run}"
        with system.open_output_stream(aside) as stream:
            stream.write(json.dumps(manifest).encode())
        system.move(aside, f"{path}/{MANIFEST}")
        self._remove([p["file"] for p in before["parts"]] if before else [])

    def abort(self, messages: list[Part | None]) -> None:
        self._remove([m.file for m in messages if m is not None and m.file])

    def _remove(self, files: list[str]) -> None:
        system, path = place(self.folder)
        for file in files:
            if system.get_file_info(f"{path}/{file}").type == fs.FileType.File:
                system.delete_file(f"{path}/{file}")


class BundleReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Piece]:
        manifest = read_manifest(self.folder)
        if manifest is None:
            raise ValueError(f"no bundle in {self.folder}: it has no {MANIFEST}")
        return [Piece(part) for part in manifest["parts"]] or [Piece({})]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        part = partition.part
        if not part:
            return
        system, path = place(self.folder)
        rows = crc = held = 0
        columns: list[list] = [[], [], [], []]
        with system.open_input_stream(f"{path}/{part['file']}") as stream:
            for line in _lines(stream):
                rows, crc, held = rows + 1, zlib.crc32(line, crc), held + len(line)
                head, body = line.decode().rstrip("\n").split(BODY, 1)
                known = json.loads(head + "}")
                for column, value in zip(columns, (known["section"], known["story_id"], known["chunk"], body[:-1])):
                    column.append(value)
                if held >= BATCH_BYTES:
                    yield _batch(columns)
                    columns, held = [[], [], [], []], 0
        if (rows, crc) != (part["rows"], part["crc32"]):
            raise ValueError(f"{part['file']} is damaged: {rows} rows of {part['rows']}, checksum {crc} for {part['crc32']}")
        if columns[0]:
            yield _batch(columns)


def _lines(stream) -> Iterator[bytes]:
    rest: list[bytes] = []
    while chunk := stream.read(1 << 20):
        *whole, last = chunk.split(b"\n")
        for piece in whole:
            yield b"".join(rest) + piece + b"\n"
            rest = []
        if last:
            rest.append(last)
    if rest:
        yield b"".join(rest)


def _batch(columns: list[list]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["section", "story_id", "chunk", "line"])


class BundleSource(DataSource):
    """``spark.read.format("bundle").load(folder)`` and ``df.write.format("bundle").mode("overwrite").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BundleReader:
        return BundleReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options["path"], overwrite, self.options.get("generatedat", self.options.get("generatedAt")))


def write(lines: DataFrame, folder: str, generated_at: str | None = None) -> None:
    """The frame's lines (columns of ``SCHEMA``) as a bundle in ``folder``."""
    lines.sparkSession.dataSource.register(BundleSource)
    out = lines.select("section", "story_id", "chunk", "line").write.format(FORMAT).mode("overwrite")
    (out.option("generatedAt", generated_at) if generated_at else out).save(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(BundleSource)
    return spark.read.format(FORMAT).load(folder)
