"""Whole files as rows: written to a folder that every executor can write to, and coded file by file."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.operators import dedup, stats

WRITTEN = "name string, n_bytes long"


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (name, content) as files of ``folder``; name, n_bytes of each.

    A file gets its name when it is whole, so an attempt that is lost or runs twice does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))
        system.create_dir(base, recursive=True)
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
                with system.open_output_stream(held, compression=None) as f:
                    f.write(content.as_py() or b"")
                system.move(held, f"{base}/{name}")
                sizes.append(len(content.as_py() or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["name", "n_bytes"])

    made = rows.select(F.col("name").cast("string"), "content").mapInArrow(run, WRITTEN)
    return rows.sparkSession.createDataFrame(made.collect(), WRITTEN)  # one short row a file; writing is done here


def code_files(spark: SparkSession, path: str, folder: str, name: str = "lzss", back: bool = False) -> DataFrame:
    """Compresses (or restores) the files at ``path`` into ``folder``; one row with sizes, time and throughput.

    Compressed files get the codec as an ending, which restoring takes off."""
    rows = dedup.spread(dedup.read_files(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content"))
    done = dedup.coded(rows, name, "content", "coded", back, "micros")
    new = F.regexp_replace("name", f"[.]{name}$", "") if back else F.concat("name", F.lit(f".{name}"))
    # coded once: the bytes are written by the tasks that make them, beside their sizes and times
    done = done.select(new.alias("name"), "length", F.col("coded").alias("content"), "micros").persist()
    write_files(done, folder)
    sums = done.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("input_bytes"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("output_bytes"), F.coalesce(F.sum("micros"), F.lit(0)).alias("micros"))
    out = spark.createDataFrame(sums.collect(), sums.schema)
    done.unpersist()
    return stats.size_throughput(out)
