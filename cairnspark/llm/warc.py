"""WARC archives with a two-level capture index (operator 5).

Writing: every page becomes one WARC/1.1 record, compressed as a gzip member of its own.
Of pages with equal payloads of at least ``least`` bytes the one with the largest id is a
response and the others are revisits that refer to it and carry no payload.  Copies are found on
digests and row numbers; payloads stay in the task that scans them where the list of revisits has
``REVISITS`` rows at most, and are joined with it by row else.  Archives are .warc.gz files of
bounded size in the shared folder, named by their task's attempt; the table that ``write``
returns lists those that count, so a task that is run again leaves no doubt.

Reading: ``captures`` scans the archives for the records' headers.  ``index`` sorts the captures
by reversed-host URL key into compressed blocks.  The sparse directory holds the first key of
each run of blocks (a run is one block, or more where there would be over ``DIRECTORY`` entries,
so what is broadcast is bounded).  ``lookup`` searches the directory by halves for the runs that
can hold a key, sends the key there, searches the run's blocks and then the block's lines by
halves, and ``ranges`` reads the records' byte ranges from the files.

Defined cases: null html is an empty payload; null url has the empty key; a null page_id
is written and read as null and is the smallest; repeated rows are records each, and copies
under the largest id are all responses; very long pages are records of any length (an archive
holds at least one); extra columns are ignored; an empty table gives no archives and an empty
result.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.shared import ROW, delete, drop, numbered, scratch, slices, written

LEAST = 1000
FILE_BYTES = 64 << 20
BLOCK_LINES = 1000
#: Entries of the sparse directory, but for one a range of the index.
DIRECTORY = 1 << 16
#: Revisits that are broadcast (some 24 bytes each); more are joined by row.
REVISITS = 1_000_000
DATE = "2024-01-01T00:00:00Z"

ARCHIVES = "archive string, n_bytes long, n_records long"
CAPTURES = "key string, archive string, start long, length long, page_id long, url string, record_type string, payload_digest string, refers_to long"
_NAMES = [x.split()[0] for x in CAPTURES.split(", ")]
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all executors share, and the folder's path in it."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def _uri(url: str | None) -> str:
    """The URL as records hold it: blanks and control characters are escaped."""
    return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url) if url else ""


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, then the port if unusual, path and query."""
    url = _uri(url)
    if not url:
        return ""
    try:
        parts = urlsplit(url.lower())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url.lower()
    key = ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/")
    return key + (f"?{'&'.join(sorted(parts.query.split('&')))}" if parts.query else "")


def _record(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record, uncompressed.  A page's own number is in WARC-Record-ID; the digest is bare hex."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url)}"]
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of an uncompressed record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    if len(body) != int(headers["Content-Length"]):
        raise ValueError("a WARC record is cut short")
    return headers, body.partition(b"\r\n\r\n")[2]


def _number(uri: str | None) -> int | None:
    digits = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _revisits(rows: DataFrame, least: int) -> DataFrame:
    """row, refers_to, of pages whose payload stands under a larger id; a table."""
    narrow = written(rows.filter(F.octet_length("payload") >= least).select(F.col(ROW).alias("row"), "page_id", F.sha1("payload").alias("digest")), "digests")
    last = narrow.groupBy("digest").agg(F.max("page_id").alias("of"), F.count("*").alias("n")).filter("n > 1").select("digest", "of")
    out = narrow.join(last, "digest").filter(F.col("of").isNotNull() & ~F.col("of").eqNullSafe(F.col("page_id"))).select("row", F.col("of").alias("refers_to"))
    out = written(out, "revisits")
    drop(narrow)
    return out


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST, file_bytes: int = FILE_BYTES, level: int = 6, broadcast: int = REVISITS) -> DataFrame:
    """Writes the archives to ``folder``, which every executor can write to (by default one in the
    shared folder); archive (the path), n_bytes, n_records of each, as a table."""
    folder = folder or scratch(pages.sparkSession, "warc")
    system, base = _system(folder)
    system.create_dir(base, recursive=True)
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    stored = numbered(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    rows = stored.select(ROW, "page_id", "url", payload.alias("payload"))
    revisits = _revisits(rows, least)
    few = revisits.count() <= broadcast
    rows = rows.join(F.broadcast(revisits) if few else revisits, F.col(ROW) == F.col("row"), "left").select("page_id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(folder)
        at, n_files, out, size, n = TaskContext.get(), 0, None, 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["archive", "n_bytes", "n_records"])

        for batch in slices(batches):
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind, kept = ("response", payload) if refers_to is None else ("revisit", b"")
                member = gzip.compress(_record(kind, page_id, url, hashlib.sha1(payload).hexdigest(), kept, refers_to), level, mtime=0)
                if out is not None and size + len(member) > file_bytes:
                    yield closed()
                    out = None
                if out is None:
                    name, n_files, size, n = f"{base}/part-{at.partitionId():06d}-{at.taskAttemptId()}-{n_files:04d}.warc.gz", n_files + 1, 0, 0
                    out = system.open_output_stream(name, compression=None)
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            yield closed()

    made = written(rows.mapInArrow(run, ARCHIVES).withColumn("folder", F.lit(folder)), "archives")
    drop(stored, revisits)
    return made


def _starts(read: Callable[[int], bytes], step: int = 16 << 10) -> Iterator[tuple[int, int, bytes]]:
    """Start, length and uncompressed bytes of each gzip member of what ``read`` gives."""
    chunk, at, pos = memoryview(b""), 0, 0
    while True:
        d, parts, start = zlib.decompressobj(31), [], at + pos
        while not d.eof:
            if pos >= len(chunk):
                chunk, at, pos = memoryview(read(1 << 20)), at + len(chunk), 0
                if not len(chunk):
                    if at == start:
                        return
                    raise ValueError("a gzip member is cut short")
            part = chunk[pos : pos + step]
            parts.append(d.decompress(part))
            pos += len(part) - len(d.unused_data)
        yield start, at + pos - start, b"".join(parts)


def starts(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    return _starts(io.BytesIO(content).read)


def captures(archives: DataFrame) -> DataFrame:
    """One row per record, from a scan of the archives; a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for archive, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                with _system(folder)[0].open_input_file(archive) as f:
                    for start, length, record in _starts(f.read):
                        h, _ = parsed(record)
                        url = h.get("WARC-Target-URI") or None
                        rows.append((url_key(url), archive, start, length, _number(h["WARC-Record-ID"]), url, h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:"), _number(h.get("WARC-Refers-To"))))
                        if len(rows) >= 4096:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    # the list of archives is short: a task each, as far as there are tasks
    n = min(max(1, archives.count()), 4 * int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(archives.select("archive", "folder").repartition(n).mapInArrow(run, CAPTURES), "captures")


def index(found: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """The sorted, compressed blocks: part and seq (their place), first_key, n, block; a table."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = found.repartitionByRange(n, "key", "archive", "start").sortWithinPartitions("key", "archive", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        part, seq = TaskContext.get().partitionId(), 0

        def out() -> pa.RecordBatch:
            nonlocal seq
            lines = "\n".join(json.dumps(x) for x in held[:block_lines]).encode()
            values = ((part, pa.int32()), (seq, pa.int64()), (held[0][0], pa.string()), (min(len(held), block_lines), pa.int64()), (zlib.compress(lines), pa.binary()))
            del held[:block_lines]
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in values], ["part", "seq", "first_key", "n", "block"])

        for batch in slices(batches):
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= block_lines:
                yield out()
        if held:
            yield out()

    return written(rows.select(*_NAMES).mapInArrow(run, "part int, seq long, first_key string, n long, block binary"), "cdx")


def directory(blocks: DataFrame, entries: int = DIRECTORY) -> tuple[list[tuple[str, int, int]], int]:
    """The first key of each run of blocks with the run's place, in order, and how many blocks a run has."""
    each = -(-max(1, blocks.count()) // entries)
    firsts = blocks.filter(F.col("seq") % each == 0).select("first_key", "part", (F.col("seq") / each).cast("long").alias("run"))
    return sorted(((r.first_key, r.part, r.run) for r in firsts.collect()), key=lambda x: x[1:]), each


def _hits(firsts: list[str], key: str) -> range:
    """The runs that can hold ``key``: from the last that begins below it to the last that begins with it or below."""
    return range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))


def lookup(blocks: DataFrame, urls: DataFrame | list[str], entries: int = DIRECTORY) -> DataFrame:
    """The captures of some URLs (a frame's column ``url``, or a list), by search in the two levels."""
    spark = blocks.sparkSession
    if isinstance(urls, list):
        urls = spark.createDataFrame([(u,) for u in urls], "url string")
    listed, each = directory(blocks, entries)
    told = spark.sparkContext.broadcast(listed)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = told.value
        firsts = [x[0] for x in runs]
        for batch in slices(batches):
            rows = [(*runs[i][1:], key) for key in {url_key(u) for u in batch.column(0).to_pylist()} for i in _hits(firsts, key)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.string()), strict=True)], ["part", "run", "key"])

    asked = urls.select(F.col("url").cast("string").alias("url")).mapInArrow(sent, "part int, run long, key string").distinct()
    none = F.lit(None)
    asked = asked.select("part", "run", F.lit(1).alias("asks"), none.cast("long").alias("seq"), "key", none.cast("binary").alias("block"))
    held = blocks.select("part", (F.col("seq") / each).cast("long").alias("run"), F.lit(0).alias("asks"), "seq", F.col("first_key").alias("key"), "block")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, firsts, run_blocks, open_ = None, [], [], {}
        for batch in slices(batches):
            rows = []
            for part, run, asks, _, key, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (part, run):
                    at, firsts, run_blocks, open_ = (part, run), [], [], {}
                if not asks:
                    firsts.append(key)
                    run_blocks.append(block)
                    continue
                for i in _hits(firsts, key):
                    if i not in open_:  # keys come in order, so one block or two are open at a time
                        open_ = {k: v for k, v in open_.items() if k == i - 1}
                        lines = [tuple(json.loads(x)) for x in zlib.decompress(run_blocks[i]).split(b"\n")]
                        open_[i] = lines, [x[0] for x in lines]
                    lines, keys = open_[i]
                    rows += lines[bisect_left(keys, key) : bisect_right(keys, key)]
                if len(rows) >= 4096:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    both = held.unionByName(asked).repartition("part", "run").sortWithinPartitions("part", "run", "asks", "seq", "key")
    return both.mapInArrow(searched, CAPTURES)


def ranges(found: DataFrame, folder: str) -> DataFrame:
    """Reads each capture's byte range; a row per capture with its payload, checked against its digest."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "payload_digest", "refers_to", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at, file = _system(folder)[0], None, None
        for batch in slices(batches):
            rows, size = [], 0
            for w in batch.to_pylist():
                if at != w["archive"]:
                    if file is not None:
                        file.close()
                    at, file = w["archive"], system.open_input_file(w["archive"])
                h, payload = parsed(gzip.decompress(file.read_at(w["length"], w["start"])))
                if h["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != w["payload_digest"]:
                    raise ValueError(f"the payload of page {w['page_id']} isn't what its digest says")
                rows.append((_number(h["WARC-Record-ID"]), w["url"], h["WARC-Type"], w["payload_digest"], _number(h.get("WARC-Refers-To")), payload))
                size += len(payload)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if file is not None:
            file.close()

    # neighbours in an archive are read by one task, and an archive by as many as it takes
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.select("archive", "start", "length", "page_id", "url", "payload_digest").repartitionByRange(n, "archive", "start").sortWithinPartitions("archive", "start")
    return dealt.mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes pages, indexes the archives, looks every page's URL up, reads its records' ranges and resolves revisits."""
    folder = scratch(pages.sparkSession, "warc")
    archives = write(pages, folder, least)
    found = captures(archives)
    blocks = index(found)
    drop(found)
    hits = written(lookup(blocks, pages.select("url")), "hits")
    back = ranges(hits, folder).select("page_id", "url", "record_type", "payload_digest", "refers_to", F.octet_length("payload").cast("long").alias("own_bytes"))
    back = written(back, "records")
    drop(hits, blocks, archives)
    delete(pages.sparkSession, folder)
    # a revisit's payload is that of the response it refers to
    told = back.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("told"), F.col("own_bytes").alias("full_bytes"))
    told = told.join(back.filter("record_type = 'revisit'").select("refers_to").distinct(), "refers_to", "left_semi").distinct()
    full = back.filter("record_type = 'revisit'").join(told, [back.refers_to == told.refers_to, back.payload_digest == told.told], "left").select(back["*"], "full_bytes")
    whole = back.filter("record_type = 'response'").withColumn("full_bytes", F.col("own_bytes")).unionByName(full)
    return whole.select("page_id", F.col("full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url")
