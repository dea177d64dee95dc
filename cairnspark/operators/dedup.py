"""Chunking, first-wins deduplication, compression and restoring of byte streams.

A stream is a row (stream_id, content).  Rows keep their place (stream_id, l1, l2) all the
way; nothing depends on partition order.  Payloads are never shuffled to find duplicates:
only places, lengths and fingerprints are.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnspark.functions.chunking import chunk_lengths
from cairnspark.functions.codecs import codec
from cairnspark.operators import stats
from cairnspark.sources.tables import written

PLACE = ("stream_id", "l1", "l2")
CHUNKS = "stream_id long, l1 long, l2 long, offset long, length long, data binary"
BLOCKS = "stream_id long, l1 long, offset long, length long, data binary, is_last boolean"
#: Bytes of a coarse block, at least: its end is sought beyond them.
COARSE = 2 << 20
#: Parts that a fingerprint's rows are dealt to before they are summed.
SALTS = 64


@dataclass(frozen=True)
class Options:
    """How streams are encoded: the codec, the chunker's window (0 is the compatible one), and whether
    the input is held in memory before the work starts."""

    codec: str = "gzip"
    window: int = 32
    preload: bool = False


def blobs(rows: DataFrame, id_col: str, column: str) -> DataFrame:
    """stream_id, content from a text or binary column; a null is an empty stream."""
    kind = dict(rows.dtypes)[column]
    content = F.col(column) if kind == "binary" else F.encode(F.col(column).cast("string"), "UTF-8")
    return rows.select(F.col(id_col).cast("long").alias("stream_id"), F.coalesce(content, F.lit(b"")).alias("content"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """stream_id (a hash of the path), path, length, content of regular files; Spark passes over empty ones."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("stream_id"), "path", "length", "content")


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """length, from text files with a whole number a line."""
    return spark.read.text(path).select(F.nullif(F.trim("value"), F.lit("")).cast("long").alias("length")).filter("length is not null")


def preloaded(rows: DataFrame) -> DataFrame:
    """``rows`` held by the executors, all read before this returns."""
    held = rows.persist(StorageLevel.MEMORY_AND_DISK)
    held.count()
    return held


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over as many tasks as can run, where the scan has fewer (a table of one row group).

    Tables with more parts than cores, as large ones are, stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # a small file is one part, and a part can hold no row group at all
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < 2 * cores else rows


def _pieces(stream_id: int, l1: int, content: bytes, start: int, lengths: list[int]) -> Iterator[tuple]:
    at = 0
    for l2, n in enumerate(lengths):
        yield stream_id, l1, l2, start + at, n, content[at : at + n]
        at += n


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def chunks(streams: DataFrame, window: int = 32) -> DataFrame:
    """Content-defined chunks of whole streams, one task a stream; l1 is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = content.as_py()
                if rows := list(_pieces(stream_id, 0, content, 0, chunk_lengths(content, window))):
                    yield _batch(rows, CHUNKS)

    return streams.select("stream_id", "content").mapInArrow(run, CHUNKS)


def coarse_lengths(content: bytes, window: int = 32, jump: int = COARSE) -> list[int]:
    """Lengths of coarse blocks: each ends at the first anchor beyond ``jump`` bytes, the last with the stream."""
    out, at = [], 0
    while len(content) - at > jump:
        # the anchor is that of a chunk which begins at the jump; more of the stream is looked at until it ends before that
        reach = 1 << 16
        while (n := chunk_lengths(content[at + jump : at + jump + reach], window)[0]) == min(reach, len(content) - at - jump) and reach < len(content) - at - jump:
            reach *= 2
        if at + jump + n >= len(content):
            break
        out.append(jump + n)
        at += jump + n
    return out + [len(content) - at] * (at < len(content))


def coarse(streams: DataFrame, window: int = 32, jump: int = COARSE) -> DataFrame:
    """stream_id, l1, offset, length, data, is_last: blocks of large streams, to be refined apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content, at = content.as_py(), 0
                lengths = coarse_lengths(content, window, jump)
                for l1, n in enumerate(lengths):
                    yield _batch([(stream_id, l1, at, n, content[at : at + n], l1 + 1 == len(lengths))], BLOCKS)
                    at += n

    return streams.select("stream_id", "content").mapInArrow(run, BLOCKS)


def refined(blocks: DataFrame, window: int = 32) -> DataFrame:
    """The chunks of coarse blocks, each cut from its own start, with is_last for a block's last chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream_id, l1, start, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                rows = list(_pieces(stream_id, l1, data, start, chunk_lengths(data, window)))
                yield _batch([(*r, k + 1 == len(rows)) for k, r in enumerate(rows)], f"{CHUNKS}, is_last boolean")

    # blocks of one stream go to different tasks
    dealt = blocks.select("stream_id", "l1", "offset", "data").repartition("stream_id", "l1")
    return dealt.mapInArrow(run, f"{CHUNKS}, is_last boolean")


def fingerprinted(rows: DataFrame, column: str = "data") -> DataFrame:
    return rows.withColumn("fp", F.sha1(column))


def first_places(rows: DataFrame, place: tuple[str, ...] = PLACE) -> DataFrame:
    """fp, ref: the first place of each fingerprint, summed up before the shuffle."""
    return rows.groupBy("fp").agg(F.min(F.struct(*place)).alias("ref"))


def mark_duplicates(rows: DataFrame, place: tuple[str, ...] = PLACE) -> DataFrame:
    """``rows`` with ref and is_duplicate.  The first in stream order is the original.

    ``rows`` are read once and dealt by fingerprint and a part of the place, so a frequent fingerprint
    is spread; both the sums and the rows that are marked come from that exchange.  Only fingerprints
    that repeat are joined back: a broadcast where they are few, else a join whose frequent keys
    Spark splits."""
    others = [c for c in rows.columns if c not in place and c != "fp"]
    dealt = rows.repartition(F.col("fp"), F.pmod(F.xxhash64(*place), F.lit(SALTS)))
    # all columns are summed, though only the place is used: so both readers want the same exchange
    first = F.struct(F.struct(*place).alias("ref"), F.struct(*others).alias("rest")) if others else F.struct(F.struct(*place).alias("ref"))
    repeated = dealt.groupBy("fp").agg(F.min_by(first, F.struct(*place)).alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("fp").alias("__fp"), "first.ref")
    marked = dealt.join(repeated, F.col("fp") == F.col("__fp"), "left").drop("__fp")
    own = F.struct(*place)
    return marked.withColumns({"ref": F.coalesce("ref", own), "is_duplicate": F.coalesce(own != F.col("ref"), F.lit(False))})


def new_only(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Rows whose fingerprint the store lacks."""
    return rows.join(store.select("fp"), "fp", "left_anti")


def known_only(rows: DataFrame, store: DataFrame) -> DataFrame:
    return rows.join(store.select("fp"), "fp", "left_semi")


def coded(rows: DataFrame, name: str, column: str, out: str, back: bool = False, micros: str | None = None) -> DataFrame:
    """``rows`` with ``column`` compressed (or restored) as ``out``; nulls stay null.

    ``micros`` names a column for the microseconds that each value took, to be summed."""
    work = codec(name)[back]
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())])
    if micros:
        schema = schema.add(micros, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, took = [], []
            for x in batch.column(batch.schema.get_field_index(column)):
                began, x = time.perf_counter_ns(), x.as_py()
                done.append(None if x is None else work(x))
                took.append((time.perf_counter_ns() - began) // 1000)
            more = [(out, pa.array(done, pa.binary()))] + [(micros, pa.array(took, pa.int64()))] * bool(micros)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(c for _, c in more)], [*batch.schema.names, *(n for n, _ in more)])

    return rows.mapInArrow(run, schema)


def encode(streams: DataFrame, name: str = "gzip", window: int = 32) -> DataFrame:
    """Marked chunks with the payload of originals compressed; duplicates carry none.

    The chunks are written once: marks are made from their places and fingerprints, and the payloads
    are read beside them."""
    cut = written(fingerprinted(chunks(streams, window)), "chunks")
    own = F.struct(*PLACE)
    repeated = cut.groupBy("fp").agg(F.min(own).alias("ref"), F.count("*").alias("n")).filter("n > 1").select(F.col("fp").alias("__fp"), "ref")
    marked = cut.join(repeated, F.col("fp") == F.col("__fp"), "left").drop("__fp")
    marked = marked.withColumns({"ref": F.coalesce("ref", own), "is_duplicate": F.coalesce(own != F.col("ref"), F.lit(False))})
    # only originals are compressed
    return coded(marked.withColumn("data", F.when(~F.col("is_duplicate"), F.col("data"))), name, "data", "payload").drop("data")


def joined(rows: DataFrame, data: str = "data") -> DataFrame:
    """stream_id, content: the pieces of each stream in order (a stream is one value), in linear time."""
    parts = F.array_sort(F.collect_list(F.struct("l1", "l2", F.hex(data).alias("hex"))))
    return rows.groupBy("stream_id").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x["hex"]), "")).alias("content"))


def decode(encoded: DataFrame, name: str) -> DataFrame:
    """stream_id, content restored; every duplicate must find its original.

    Originals are restored once and keep their place; only duplicates are joined with them."""
    whole = coded(encoded.filter("not is_duplicate").select(*PLACE, "fp", "payload"), name, "payload", "data", back=True).drop("payload")
    lost = F.coalesce("data", F.raise_error(F.concat(F.lit("no original for "), "fp")).cast("binary"))
    twins = encoded.filter("is_duplicate").select(*PLACE, "fp").join(whole.select("fp", "data"), "fp", "left").select(*PLACE, lost.alias("data"))
    return joined(whole.select(*PLACE, "data").unionByName(twins))


def restored(records: DataFrame, name: str) -> DataFrame:
    """stream_id, record_no, data from archive records (stream_id, record_no, type, content).

    Digests are made anew from what is restored.  A fingerprint must refer to an earlier record of
    its own archive; a record of another type is an error."""
    kind = F.when(F.col("type").isin(0, 1), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("no record has type "), F.col("type").cast("string"))).cast("tinyint"))
    rows = records.select("stream_id", "record_no", kind.alias("type"), "content")
    whole = fingerprinted(coded(rows.filter("type = 1").select("stream_id", "record_no", "content"), name, "content", "data", back=True).drop("content"))
    firsts = whole.groupBy("stream_id", "fp").agg(F.min_by(F.struct("record_no", "data"), "record_no").alias("first")).select("stream_id", "fp", "first")
    refs = rows.filter("type = 0").select("stream_id", "record_no", F.lower(F.hex("content")).alias("fp"))
    found = F.when(F.col("first.record_no") < F.col("record_no"), F.col("first.data"))
    lost = F.raise_error(F.concat(F.lit("a fingerprint refers to nothing before it: "), "fp")).cast("binary")
    twins = refs.join(firsts, ["stream_id", "fp"], "left").select("stream_id", "record_no", F.coalesce(found, lost).alias("data"))
    return whole.select("stream_id", "record_no", "data").unionByName(twins)


def decode_records(records: DataFrame, name: str) -> DataFrame:
    """stream_id, content from archive records."""
    return joined(restored(records, name).withColumns({"l1": F.lit(0), "l2": F.col("record_no")}))


def dedup_encode(streams: DataFrame, options: Options = Options()) -> DataFrame:
    """``encode`` by options."""
    return encode(preloaded(streams) if options.preload else spread(streams), options.codec, options.window)


def dedup_decode(encoded: DataFrame, options: Options = Options()) -> DataFrame:
    """Streams from marked rows, or from archive records."""
    return decode_records(encoded, options.codec) if "record_no" in encoded.columns else decode(encoded, options.codec)


def dedup_stats(encoded: DataFrame) -> DataFrame:
    """One row with the totals of an encoding, and its factors and shares."""
    total = stats.totals(encoded.withColumn("payload_length", F.octet_length("payload")))
    return total.select("*", *stats.percentage_columns())
