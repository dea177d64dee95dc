"""Statistics of deduplicated rows (length, is_duplicate, payload length)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS, SLOT_BYTES, RECORD, HEADER = 256, 128, 9, 5


def slot(length: F.Column) -> F.Column:
    return F.least(F.shiftright(length.cast("long"), 7), F.lit(SLOTS - 1).cast("long"))


def histogram(rows: DataFrame, length: str = "length") -> DataFrame:
    """slot, midpoint, n."""
    return rows.groupBy(slot(F.col(length)).alias("slot")).agg(F.count("*").alias("n")).select("slot", (F.col("slot") * SLOT_BYTES + SLOT_BYTES // 2).alias("midpoint"), "n")


def density(rows: DataFrame, length: str = "length", bins: int = 50) -> DataFrame:
    """bin, n, density over equal bins from the least to the greatest length; the greatest is in the last bin."""
    ends = rows.agg(F.min(length).alias("low"), F.max(length).alias("high"), F.count("*").alias("total"))
    wide = (F.col("high") - F.col("low")) / bins
    own = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col(length) - F.col("low")) * bins / (F.col("high") - F.col("low"))), F.lit(bins - 1))).otherwise(0)
    binned = rows.select(length).join(F.broadcast(ends)).withColumn("bin", own.cast("long"))  # one row
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.first(wide).alias("w"), F.first("total").alias("total")).select("bin", "n", F.when(F.col("w") > 0, F.col("n") / (F.col("total") * F.col("w"))).alias("density"))


def totals(rows: DataFrame, size: str = "payload_length") -> DataFrame:
    """One row: chunk counts and bytes.  A record is 9 bytes and its content, which is 20 bytes for a duplicate."""
    unique = ~F.col("is_duplicate")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.agg(
        F.count("*").alias("n_chunks"),
        zero(F.sum(F.col("is_duplicate").cast("long"))).alias("n_duplicates"),
        zero(F.sum("length")).alias("total_input"),
        zero(F.sum(F.when(unique, F.col("length")))).alias("total_dedup"),
        zero(F.sum(F.when(unique, F.col(size)))).alias("total_compressed"),
        (zero(F.sum(F.when(unique, F.col(size)).otherwise(20) + RECORD)) + HEADER).alias("total_output"),
        F.avg("length").alias("mean_length"),
        F.stddev_pop("length").alias("stddev_length"),
    )


def percentage_columns() -> list[F.Column]:
    of = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    overhead = F.col("total_output") - F.col("total_compressed")
    return [
        (100 * of("n_duplicates", "n_chunks")).alias("duplicate_pct"),
        of("total_input", "total_dedup").alias("dedup_factor"),
        of("total_dedup", "total_compressed").alias("compression_factor"),
        of("total_input", "total_output").alias("total_factor"),
        F.when(F.col("total_output") != 0, 100 * overhead / F.col("total_output")).alias("overhead_pct"),
    ]


def percentages(total: DataFrame) -> DataFrame:
    """Factors and shares, null where they would divide by zero."""
    return total.select(*percentage_columns())


# Unit names, each 1024 of the one before.
UNITS = ("Bytes", "KB", "MB", "GB", "TB", "PB", "EB")


def scaled(total: DataFrame, columns: tuple[str, ...] = ("total_input", "total_dedup", "total_compressed", "total_output")) -> DataFrame:
    """The totals in the largest unit in which all of them are one at least, with its name as unit."""
    least = F.least(*columns)
    step = sum(F.when(least >= float(1024**k), 1).otherwise(0) for k in range(1, len(UNITS)))
    return total.select(*((F.col(c) / F.pow(F.lit(1024.0), step)).alias(c) for c in columns), F.element_at(F.array(*map(F.lit, UNITS)), step + 1).alias("unit"))


def slot_mean(slots: DataFrame) -> DataFrame:
    """mean, stddev and root_sum_squares over a histogram's slots (midpoint, n), by their midpoints.

    root_sum_squares is the old reports' deviation, which isn't divided by the number."""
    n, x = F.sum("n"), F.col("midpoint").cast("double")
    sums = slots.agg(n.alias("n"), F.sum(x * F.col("n")).alias("s"), F.sum(x * x * F.col("n")).alias("q"))
    spread = F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))
    return sums.filter("n > 0").select((F.col("s") / F.col("n")).alias("mean"), F.sqrt(spread / F.col("n")).alias("stddev"), F.sqrt(spread).alias("root_sum_squares"))


def size_throughput(rows: DataFrame) -> DataFrame:
    """seconds, input_mb, output_mb, ratio_pct, input_mb_s, output_mb_s from input_bytes, output_bytes and micros."""
    mb = float(1 << 20)
    seconds = F.col("micros") / 1e6
    some = lambda a, b: F.when(b != 0, a / b)
    others = [c for c in rows.columns if c not in ("input_bytes", "output_bytes", "micros")]
    return rows.select(
        *others,
        seconds.alias("seconds"),
        (F.col("input_bytes") / mb).alias("input_mb"),
        (F.col("output_bytes") / mb).alias("output_mb"),
        (100 * some(F.col("output_bytes"), F.col("input_bytes"))).alias("ratio_pct"),
        some(F.col("input_bytes") / mb, seconds).alias("input_mb_s"),
        some(F.col("output_bytes") / mb, seconds).alias("output_mb_s"),
    )
