"""Timed runs of the encoder: data sets, codecs and repetitions, from files and from memory, kept in a run table."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from cairnspark.operators import analysis, dedup

RUN = "dataset string, mode string, compression string, seq int, threads int, total_time double, memory int"


def timed(streams: DataFrame, options: dedup.Options) -> float:
    """Milliseconds that an encoding takes; a preloaded input is read before."""
    held = dedup.preloaded(streams) if options.preload else streams
    began = time.perf_counter()
    dedup.dedup_encode(held, dedup.Options(options.codec, options.window)).write.format("noop").mode("overwrite").save()
    took = 1000 * (time.perf_counter() - began)
    if options.preload:
        held.unpersist()
    return took


def run(spark: SparkSession, datasets: dict[str, DataFrame], path: str, codecs: Iterable[str] = ("none", "gzip", "lzss"), windows: Iterable[int] = (32, 0), repetitions: int = 5, retries: int = 3) -> DataFrame:
    """Runs each plan ``repetitions`` times, from files (memory 0) and preloaded (1), and appends what they took
    to the table at ``path``, which is returned.  A run that fails is tried ``retries`` times in all."""
    threads = spark.sparkContext.defaultParallelism
    for seq in range(repetitions):
        for dataset, streams in datasets.items():
            for memory in (0, 1):
                for name in codecs:
                    for window in windows:
                        for attempt in range(retries):
                            try:
                                took = timed(streams, dedup.Options(name, window, bool(memory)))
                                break
                            except Exception:
                                if attempt + 1 == retries:
                                    raise
                        row = (dataset, f"window{window}", name, seq, threads, took, memory)
                        analysis.append_results(spark.createDataFrame([row], RUN), path)
    return spark.read.schema(analysis.RESULT).parquet(path)
