"""Runs of benchmarks: their tables, the output they are read from, and their analysis.

Analysed are rows (dataset, mode, threads, total_time)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the run tables.
RESULT = "id long, dataset string, mode string, compression string, seq int, threads int, total_time decimal(10,6), memory int, current_date string, current_time string"
LZSS_RESULT = (
    "id long, dataset string, mode string, plan string, seq int, threads int, input_file_size decimal(10,2), output_file_size decimal(10,2), compress_ratio decimal(10,2), "
    "input_processing decimal(10,2), output_processing decimal(10,2), total_time decimal(10,6), gpu_host_to_device decimal(10,6), gpu_device_to_host decimal(10,6), "
    "gpu_kernel decimal(10,4), finding_match decimal(10,6), current_date string, current_time string"
)
# What a run prints, by column, and the default where it doesn't.
TIME = (r"It took ([\d\.]+)", "0")
PRINTED = {
    "plan": (r"Selected Plan: ([A-Za-z_]+)", ""),
    "file_statistics": (r"File statistics: ([A-Za-z]+)", ""),
    "gpu_host_to_device": (r"timeSpentOnMemoryHostToDevice: ([\d\.]+) seconds", "0"),
    "gpu_device_to_host": (r"timeSpentOnMemoryDeviceToHost: ([\d\.]+) seconds", "0"),
    "gpu_kernel": (r"timeSpentOnKernel: ([\d\.]+) seconds", "0"),
    "total_time": (r"Total time: ([\d\.]+) seconds", "0"),
    "finding_match": (r"Finding match: ([\d\.]+) seconds", "0"),
    "input_file_size": (r"Input file size: ([\d\.]+) MB", "0"),
    "output_file_size": (r"Output file size: ([\d\.]+) MB", "0"),
    "compress_ratio": (r"Compress ratio: ([\d\.]+)%", "0"),
    "input_processing": (r"Input processing: ([\d\.]+) MB", "0"),
    "output_processing": (r"Output processing: ([\d\.]+) MB", "0"),
}
KEYS = ("dataset", "mode", "threads")


def group_stats(runs: DataFrame) -> DataFrame:
    """Mean, sample deviation (null for one run) and number of runs."""
    return runs.groupBy(*KEYS).agg(F.avg("total_time").alias("avg_time"), F.stddev_samp("total_time").alias("stdev"), F.count("*").alias("n"))


def speedups(runs: DataFrame, baseline_mode: str, baseline: str = "per_dataset") -> DataFrame:
    """Speedup over the baseline mode's mean, per data set or (``global``) over all, and its error."""
    base = runs.filter(F.col("mode") == baseline_mode)
    stats = group_stats(runs.filter(F.col("mode") != baseline_mode))
    if baseline == "global":
        joined = stats.join(F.broadcast(base.agg(F.avg("total_time").alias("base"))))  # one row
    elif baseline == "per_dataset":
        joined = stats.join(base.groupBy("dataset").agg(F.avg("total_time").alias("base")), "dataset", "left")
    else:
        raise ValueError("baseline is global or per_dataset")
    speed = F.col("base") / F.col("avg_time")
    error = F.coalesce(F.col("base") / (F.col("avg_time") + F.col("stdev")) - speed, F.lit(0.0))
    return joined.select(*KEYS, speed.alias("speedup"), error.alias("error"))


def best(runs: DataFrame, n: int = 1) -> DataFrame:
    """The fastest configurations on average; ties by their keys."""
    return group_stats(runs).orderBy("avg_time", *KEYS).limit(n).select(*KEYS, "avg_time")


def throughput(size_bytes: F.Column, milliseconds: F.Column) -> F.Column:
    return size_bytes / (1024.0 * 1024.0) / (milliseconds / 1000.0)


def extracted(text: F.Column, pattern: str, default: str) -> F.Column:
    """The pattern's first group, or a default where it doesn't match."""
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit(default))


def printed(text: F.Column) -> dict[str, F.Column]:
    """The fields of what a compression run prints: words as they are, all others as numbers."""
    words = ("plan", "file_statistics")
    return {k: extracted(text, p, d) if k in words else extracted(text, p, d).cast("double") for k, (p, d) in PRINTED.items()}


def append_results(runs: DataFrame, path: str, schema: str = RESULT) -> None:
    """Appends runs to a table of ``schema``; the day and time are now's, ids go on from the largest."""
    spark = runs.sparkSession
    now = {"current_date": F.current_date().cast("string"), "current_time": F.date_format(F.current_timestamp(), "HH:mm:ss")}
    base = spark.read.schema(schema).parquet(path).agg(F.max("id")).first()[0] if _exists(spark, path) else None
    own = runs.drop("id").withColumns(now).withColumn("id", F.monotonically_increasing_id() + F.lit((base or 0) + 1))
    fields = [x.strip().split(" ", 1) for x in schema.replace("(10,", "(10;").split(",")]
    own.select(*((F.col(n) if n in own.columns else F.lit(None)).cast(k.replace(";", ",")).alias(n) for n, k in fields)).write.mode("append").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def select_data(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """A query over run tables, given by name."""
    return spark.sql(sql, **tables) if tables else spark.sql(sql)


def select_vector(spark: SparkSession, sql: str, **tables: DataFrame) -> np.ndarray:
    """The first column of a query's (small) result."""
    return np.array([r[0] for r in select_data(spark, sql, **tables).collect()])


def population_stats(runs: DataFrame) -> DataFrame:
    """Mean and population deviation by configuration."""
    return runs.groupBy(*KEYS).agg(F.avg("total_time").alias("avg_time"), F.stddev_pop("total_time").alias("stdev_pop"))


def throughputs(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mean and population deviation of the runs' MB a second; sizes: dataset, size_bytes; total_time in milliseconds."""
    each = runs.join(sizes, "dataset").withColumn("mb_s", throughput(F.col("size_bytes"), F.col("total_time")))
    return each.groupBy(*KEYS).agg(F.avg("mb_s").alias("mb_s"), F.stddev_pop("mb_s").alias("mb_s_stdev"))


def remapped(runs: DataFrame, plan: str, factor: int = 10, last: int = 7) -> DataFrame:
    """Runs of ``plan`` with the threads 0 to ``last`` as 10, 20 and so on."""
    hit = (F.col("plan") == plan) & F.col("threads").between(0, last)
    return runs.withColumn("threads", F.when(hit, (F.col("threads") + 1) * factor).otherwise(F.col("threads")))


# Words as names show them.
SHOWN = {"spar": "SPar", "cuda": "CUDA", "opencl": "OpenCL", "sequential": "Sequencial"}


def better_name(name: F.Column) -> F.Column:
    """A configuration's name without its last part, with words as they are shown; SPar with its replicas."""
    parts = F.split(name, "_")
    out = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    for word, shown in SHOWN.items():
        out = F.replace(out, F.lit(word), F.lit(shown))
    last = F.element_at(parts, -1)
    replicas = F.concat(out, F.lit(" ("), last, F.lit(" replica"), F.when(F.try_to_number(last, F.lit("999999")) > 1, "s").otherwise(""), F.lit(")"))
    return F.when(out == "SPar", replicas).otherwise(out)


def base_name(path: F.Column) -> F.Column:
    """A file's name without its folders and what follows its first dot."""
    return F.element_at(F.split(F.element_at(F.split(path, "/"), -1), r"\."), 1)


def label(plan: F.Column, threads: F.Column) -> F.Column:
    """A plan with the number of threads or GPUs it ran on."""
    n, several = threads.cast("string"), F.when(threads > 1, "S)").otherwise(")")
    cpu = F.concat(F.lit("SPar("), n, F.lit(" THREAD"), F.when(threads != 1, "S)").otherwise(")"))
    return F.when(plan == "CPU_SEQUENTIAL", cpu).otherwise(F.concat(F.replace(plan, F.lit("GPU_"), F.lit("")), F.lit("("), n, F.lit(" GPU"), several))


def one_group(runs: DataFrame) -> DataFrame:
    """Mean and deviation over all runs, beside the configuration of the fastest (the least by its keys, of equals).

    Stands for the old queries that name columns beside a sum without grouping, which pick any row."""
    first = F.min_by(F.struct(*KEYS), F.struct("total_time", *KEYS)).alias("at")
    return runs.agg(first, F.avg("total_time").alias("avg_time"), F.stddev_samp("total_time").alias("stdev")).select("at.*", "avg_time", "stdev")


def in_final_order(rows: DataFrame, rank: str = "o") -> DataFrame:
    """By rank, then data set, threads and mode."""
    return rows.orderBy(rank, "dataset", "threads", "mode")
