"""Archives: a header (magic number, codec) and records (type, length, content), little-endian.

After ``register(spark)`` the data source ``dedup_archive`` reads and writes them.  Reading takes a
file, or a folder of files, and gives path, record_no, type, length, content; a task reads one file,
record by record.  Writing takes rows (type, content), in the order of their partitions and within
them: each task writes its part, and the commit puts the header before them and lists them in an
index, so that no byte passes the driver; the parts in order are the archive, and are read as one.
With the option ``single`` the commit joins them to one file.  ``write`` orders encoded rows by place
and writes them.  Files are opened by URI, in any store that pyarrow knows."""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from cairnspark.functions.codecs import NUMBERS, codec
from cairnspark.operators.dedup import PLACE, joined

# Fixed values of the format.
MAGIC, FINGERPRINT, DATA, ORIGINAL = 123456, 0, 1, 2
RECORDS = "path string, record_no long, type tinyint, length long, content binary"
#: What a sink's folder holds: the parts, and this list of them.
INDEX = "_index.json"


def header(name: str) -> bytes:
    codec(name)
    return struct.pack("<iB", MAGIC, NUMBERS[name])


def record(kind: int, content: bytes) -> bytes:
    return struct.pack("<BQ", kind, len(content)) + content


def codec_of(data: bytes) -> str:
    if len(data) < 5:
        raise ValueError("an archive has a header of 5 bytes")
    magic, number = struct.unpack_from("<iB", data)
    if magic != MAGIC:
        raise ValueError("not an archive")
    names = {n: k for k, n in NUMBERS.items()}
    if number not in names:
        raise ValueError(f"no codec has number {number}")
    return names[number]


def exactly(read: Callable[[int], bytes], n: int, what: str) -> bytes:
    """``n`` bytes, however many reads that takes; fewer are an error, none at all are none."""
    parts, left = [], n
    while left and (piece := read(left)):
        parts.append(piece)
        left -= len(piece)
    if left and (parts or what):
        raise ValueError(f"{what or 'a record'} is cut short")
    return b"".join(parts)


def scan(read: Callable[[int], bytes], first: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(number, type, content) of the records that ``read`` gives, one at a time; damage is an error."""
    n = first
    while head := exactly(read, 9, ""):
        kind, length = struct.unpack("<BQ", head)
        if kind not in (FINGERPRINT, DATA):  # ORIGINAL too: no writer makes it
            raise ValueError(f"no record has type {kind}")
        if kind == FINGERPRINT and length != 20 or kind == DATA and not length:
            raise ValueError("a record's length is wrong")
        yield n, kind, exactly(read, length, "a record")
        n += 1


def parse(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(number, type, content) of each record of a whole archive."""
    codec_of(data)
    return scan(io.BytesIO(data[5:]).read)


def restore(data: bytes) -> bytes:
    """The stream in an archive."""
    import hashlib

    unpack, known, out = codec(codec_of(data))[1], {}, []
    for _, kind, content in parse(data):
        if kind == DATA:
            part = unpack(content)
            known[hashlib.sha1(part).digest()] = part
        elif (part := known.get(content)) is None:
            raise ValueError("a fingerprint refers to nothing before it")
        out.append(part)
    return b"".join(out)


def records(encoded: DataFrame) -> DataFrame:
    """Record columns by place: duplicates are fingerprints, originals their payload."""
    content = F.when(F.col("is_duplicate"), F.unhex("fp")).otherwise(F.col("payload"))
    kind = F.when(F.col("is_duplicate"), F.lit(FINGERPRINT)).otherwise(F.lit(DATA)).cast("tinyint")
    return encoded.select(*PLACE, kind.alias("type"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


def bytes_of(encoded: DataFrame, name: str) -> DataFrame:
    """One row per stream: stream_id, archive (one value).  Originals must be in the same stream."""
    head = F.concat(F.unhex(F.when(F.col("type") == FINGERPRINT, "00").otherwise("01")), _little_endian(F.col("length")), F.col("content"))
    whole = joined(records(encoded).select(*PLACE, head.alias("bytes")), "bytes")
    return whole.select("stream_id", F.concat(F.lit(header(name)), "content").alias("archive"))


def _little_endian(value: F.Column) -> F.Column:
    """Eight bytes of a number, the lowest first."""
    digits = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(8))))


def write(encoded: DataFrame, name: str, path: str, single: bool = False) -> None:
    """Encoded rows as one archive at ``path``, in the order of their places."""
    n = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    register(encoded.sparkSession)
    ordered = records(encoded).repartitionByRange(n, *PLACE).sortWithinPartitions(*PLACE).select("type", "content")
    ordered.write.format("dedup_archive").options(path=path, codec=name, single=str(single).lower()).mode("overwrite").save()


def _system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


@dataclass
class _Part(InputPartition):
    """Files that are read one after the other: the first has the header if ``first`` is 0."""

    path: str
    files: list[str]
    first: int = 0
    headed: bool = True


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, at = _system(self.path)
        if system.get_file_info(at).type != fs.FileType.Directory:
            return [_Part(self.path, [at])]
        found = sorted(x.path for x in system.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File)
        if f"{at}/{INDEX}" not in found:
            return [_Part(x, [x]) for x in found if not x.rsplit("/", 1)[1].startswith((".", "_"))]
        with system.open_input_stream(f"{at}/{INDEX}") as f:
            index = json.loads(f.read())
        out, before = [], 0
        for part in index["parts"]:  # each is read by a task; numbers go on from part to part
            out.append(_Part(self.path, [f"{at}/{part['name']}"], before, False))
            before += part["records"]
        return out or [_Part(self.path, [])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        system, _ = _system(self.path)
        for file in partition.files:
            with system.open_input_stream(file, compression=None) as f:
                if partition.headed:
                    codec_of(f.read(5))
                for n, kind, content in scan(f.read, partition.first):
                    yield partition.path, n, kind, len(content), content


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    name: str
    records: int
    size: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, name: str, single: bool, overwrite: bool):
        codec(name)
        self.path, self.name, self.single, self.overwrite, self.run = path, name, single, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, at = _system(self.path)
        task = TaskContext.get()
        # an attempt's own name: what a lost or slower attempt leaves is not listed
        name, n, size = f"part-{task.partitionId():08d}-{self.run}-{task.taskAttemptId()}", 0, 0
        system.create_dir(f"{at}.{self.run}" if self.single else at, recursive=True)
        with system.open_output_stream(f"{at}.{self.run}/{name}" if self.single else f"{at}/{name}", compression=None) as f:
            for row in rows:
                own = record(row.type, bytes(row.content))
                f.write(own)
                n, size = n + 1, size + len(own)
        return _Written(task.partitionId(), name, n, size)

    def commit(self, messages: list[_Written]) -> None:
        from pyarrow import fs

        system, at = _system(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        if self.single:
            with system.open_output_stream(at, compression=None) as out:
                out.write(header(self.name))
                for m in parts:
                    with system.open_input_stream(f"{at}.{self.run}/{m.name}", compression=None) as f:
                        while piece := f.read(1 << 20):
                            out.write(piece)
            if parts:
                system.delete_dir(f"{at}.{self.run}")
            return
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/header-{self.run}", compression=None) as f:
            f.write(header(self.name))
        index = {"codec": self.name, "header": f"header-{self.run}", "parts": [{"name": m.name, "records": m.records, "bytes": m.size} for m in parts if m.records]}
        with system.open_output_stream(f"{at}/{INDEX}", compression=None) as f:
            f.write(json.dumps(index).encode())
        # what an earlier archive or a lost attempt left
        listed = {INDEX, index["header"], *(m["name"] for m in index["parts"])}
        for x in system.get_file_info(fs.FileSelector(at)):
            if x.path.rsplit("/", 1)[1] not in listed:
                system.delete_file(x.path)

    def abort(self, messages: list[_Written]) -> None:
        system, at = _system(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{at}.{self.run}/{m.name}" if self.single else f"{at}/{m.name}")


def archive_bytes(path: str) -> bytes:
    """The bytes of a (small) archive, be it one file or a folder of parts."""
    from pyarrow import fs

    system, at = _system(path)
    files = [at]
    if system.get_file_info(at).type == fs.FileType.Directory:
        with system.open_input_stream(f"{at}/{INDEX}") as f:
            index = json.loads(f.read())
        files = [f"{at}/{x}" for x in (index["header"], *(p["name"] for p in index["parts"]))]
    out = []
    for x in files:
        with system.open_input_stream(x, compression=None) as f:
            out.append(f.read())
    return b"".join(out)


def codec_at(path: str) -> str:
    """The codec that an archive names."""
    from pyarrow import fs

    system, at = _system(path)
    if system.get_file_info(at).type == fs.FileType.Directory:
        with system.open_input_stream(f"{at}/{INDEX}") as f:
            return json.loads(f.read())["codec"]
    with system.open_input_stream(at, compression=None) as f:
        return codec_of(f.read(5))


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dedup_archive"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not overwrite:
            raise ValueError("an archive is written whole: use mode overwrite")
        return _Writer(self.options["path"], self.options.get("codec", "gzip"), self.options.get("single", "false") == "true", overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
