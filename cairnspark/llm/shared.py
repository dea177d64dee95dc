"""What several operators here need: tables in the shared folder, row numbers and table reading.

Intermediate results that are read more than once, or whose lineage is cut, are
written as Parquet below ``spark.checkpoint.dir`` - the folder that every executor
and the driver share.  A lost executor therefore costs only the tasks it ran.  An operator
drops its tables as soon as nothing reads them any more; what its result reads stays until
``clean`` or until the folder is emptied.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.sources.tables import clean, delete, drop, folder, scratch, written

__all__ = ["ROW", "below", "clean", "delete", "drop", "folder", "free", "is_scan", "numbered", "scratch", "slices", "table", "written"]

#: Rows that become Python objects at a time.  Spark bounds an Arrow batch itself at 64 MB.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20
#: The column that tells rows apart: a file and a row's place in it, or a number given once.
ROW = "__cairn_row"


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is no more than columns and filters of one Parquet table."""
    plan = df._jdf.queryExecution().optimizedPlan()
    names = [m[0] for line in plan.toString().splitlines() if (m := re.search(r"\w+", line))]
    return bool(names) and set(names[:-1]) <= {"Project", "Filter"} and names[-1] == "Relation" and plan.toString().rstrip().endswith("parquet") and plan.deterministic() and "_metadata" not in df.columns


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a column that tells rows apart and is the same in each scan.

    Rows of a Parquet table are known by their file (its path below the table's) and their
    place in it, whatever the splits; of anything else a numbered copy is stored first
    (``drop`` deletes it)."""
    if is_scan(docs):
        roots = docs._jdf.queryExecution().optimizedPlan().collectLeaves().head().relation().location().rootPaths()
        path, root = F.col("_metadata.file_path"), roots.head().toString() if roots.size() == 1 else ""
        below = F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(path)
        return docs.select("*", F.struct(F.xxhash64(below, F.lit(0)).alias("file"), F.col("_metadata.row_index").alias("place")).alias(ROW))
    return written(docs.withColumn(ROW, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("place"))), "rows")


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever it has."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def below(hashed: F.Column, share: float) -> F.Column:
    """Whether a 64-bit hash is among the lowest ``share`` of all."""
    return hashed <= F.lit(int(share * float(1 << 64)) - (1 << 63)) if share < 1 else hashed.isNotNull()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of bounded rows and, but for single rows, bytes."""
    for batch in batches:
        step = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
