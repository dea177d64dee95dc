"""Deduplication of streams: against a growing table of fingerprints, or against keyed state that
expires; and the emission of rows in their order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairnspark.operators.dedup import first_places

#: Fingerprints are stored by their first two hex digits.
BUCKET = 2
#: Batches after which a store's files are put together.
COMPACT = 32


def source(spark: SparkSession, path: str, schema: str, max_files: int = 1000, max_bytes: str | None = None) -> DataFrame:
    """A stream of Parquet files with at most so many files, or bytes, a batch: what comes faster waits."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxBytesPerTrigger", max_bytes) if max_bytes else reader.option("maxFilesPerTrigger", max_files)).parquet(path)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:  # nothing is there before the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _known(spark: SparkSession, store: str, kind: T.StructType, base: int, number: int) -> DataFrame:
    """fp, ref, bucket before batch ``number``: what was put together at ``base``, and the batches since."""
    parts = [spark.createDataFrame([], T.StructType([*kind.fields[:-2], kind.fields[-1]]))]
    if base > 0 and (x := _read(spark, f"{store}/before={base}", parts[0].schema)) is not None:
        parts.append(x)
    if (x := _read(spark, f"{store}/batches", kind)) is not None:
        parts.append(x.filter((F.col("batch") >= base) & (F.col("batch") < number)).drop("batch"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mark_stream(stream: DataFrame, place: tuple[str, ...], store: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Appends each row with fp, ref and is_duplicate to ``sink``.

    Within a batch the first place wins; a fingerprint of an earlier batch keeps its first
    place.  Tables are written once per batch id, so a batch that is run again after a
    failure replaces its own rows only.  The store is kept by the fingerprints' first digits and put
    together every ``COMPACT`` batches, so a batch reads a few large files of the digits it has."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        bucket = F.substring("fp", 1, BUCKET)
        firsts = first_places(rows, place)
        kind = T.StructType([*firsts.schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.StringType())])
        base = number // COMPACT * COMPACT
        if base and base == number:
            _known(spark, store, kind, base - COMPACT, number).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{store}/before={number}")
        digits = [r[0] for r in firsts.select(bucket).distinct().collect()]  # 256 at most
        known = _known(spark, store, kind, base, number).filter(F.col("bucket").isin(digits)).drop("bucket")
        old = firsts.select("fp").join(known, "fp")
        new = firsts.join(old.select("fp"), "fp", "left_anti")
        marked = rows.join(old.unionByName(new), "fp").withColumn("is_duplicate", F.struct(*place) != F.col("ref"))
        marked.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        new.withColumn("bucket", bucket).write.partitionBy("bucket").mode("overwrite").parquet(f"{store}/batches/batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mark_with_state(stream: DataFrame, place: tuple[str, ...], expires_ms: int | None = None) -> DataFrame:
    """``stream`` with ref and is_duplicate from state by fingerprint, which a fingerprint leaves
    ``expires_ms`` milliseconds after it last came (never, if none); then its next row is an original again.

    Of one batch the first place wins.  Frequent fingerprints stream by in parts."""
    kind = T.StructType([*stream.schema.fields, T.StructField("ref", T.StructType([stream.schema[p] for p in place])), T.StructField("is_duplicate", T.BooleanType())])
    held = T.StructType([stream.schema[p] for p in place])
    names = [f.name for f in stream.schema.fields]

    def mark(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = [p for p in parts if len(p)]
        ref = tuple(state.get) if state.exists else min(tuple(r) for p in rows for r in p[list(place)].itertuples(index=False))
        state.update(ref)
        if expires_ms is not None:
            state.setTimeoutDuration(expires_ms)
        for p in rows:
            out = p[names].copy()
            own = list(p[list(place)].itertuples(index=False, name=None))
            out["ref"] = [dict(zip(place, ref, strict=True))] * len(p)
            out["is_duplicate"] = [tuple(x) != tuple(ref) for x in own]
            yield out

    timeout = GroupStateTimeout.NoTimeout if expires_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy("fp").applyInPandasWithState(mark, kind, held, "append", timeout)


def finish(rows: DataFrame, sink: str, checkpoint: str) -> None:
    """Appends what a stream has now to Parquet, and ends.

    State that expires by the clock asks for batches without data for ever, so there are none meanwhile:
    what has expired leaves with the next data."""
    spark, key = rows.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()
    finally:
        spark.conf.set(key, old)


def emit_in_order(stream: DataFrame, position: str, pending: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Appends rows to ``sink`` in the order of ``position`` (0, 1, 2 and so on, over the whole stream).

    A row waits in ``pending`` until all before it have come; each batch writes one sorted part, and the
    batches' parts follow each other.  What still waits at the end shows a gap."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        kind = T.StructType([*rows.schema.fields, T.StructField("__next", T.LongType())])
        before = _read(spark, f"{pending}/after={number - 1}", kind) if number else None
        due = 0
        if before is not None:
            due = before.agg(F.max("__next")).first()[0] or 0
            rows = rows.unionByName(before.filter(F.col(position).isNotNull()).drop("__next"))
        rows = rows.persist()
        # the first position that is missing: by ranges, each sorted in a task of its own
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        part = rows.select(F.col(position).alias("p")).repartitionByRange(n, "p").withColumn("part", F.spark_partition_id())
        spans = part.groupBy("part").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.count_distinct("p").alias("n")).orderBy("low").collect()
        end = due
        for s in spans:  # one row a range
            if s.low != end:
                break
            if s.high - s.low + 1 != s.n:
                own = part.filter((F.col("p") >= s.low) & (F.col("p") <= s.high)).select("p").distinct()
                # the least that has no successor
                end = own.join(own.select((F.col("p") - 1).alias("p")), "p", "left_anti").agg(F.min("p")).first()[0] + 1
                break
            end = s.high + 1
        ready = rows.filter(F.col(position) < end)
        ready.repartitionByRange(n, position).sortWithinPartitions(position).write.mode("overwrite").parquet(f"{sink}/batch={number:08d}")
        waits = rows.filter(F.col(position) >= end).withColumn("__next", F.lit(end).cast("long"))
        told = spark.createDataFrame([(end,)], "__next long")
        waits.unionByName(told, allowMissingColumns=True).write.mode("overwrite").parquet(f"{pending}/after={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
