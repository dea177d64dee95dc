"""Intermediate tables in the folder that the driver and all executors share.

Results that are read more than once, or whose lineage is cut, are written as Parquet below
``spark.checkpoint.dir``; a lost executor costs only the tasks it ran.  ``drop`` deletes a table
that nothing reads any more, ``clean`` all that this application has left."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one; a temporary one only in local mode, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        base = f"file://{tempfile.mkdtemp(prefix='cairnspark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/cairnspark-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Deletes all tables of this application; results that read them and aren't yet written are lost."""
    delete(spark, folder(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: its lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_stored"] = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes what ``written`` made; frames that are none of its are left alone."""
    for t in tables:
        if t is not None and (path := t.__dict__.pop("_stored", None)):
            delete(t.sparkSession, path)
