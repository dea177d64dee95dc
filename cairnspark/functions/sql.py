"""SQL functions: ``compress(content, codec)``, ``decompress(content, codec)`` and the table function
``cdc_chunks(content, window)``, after ``register(spark)``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnspark.functions.chunking import chunk_lengths
from cairnspark.functions.codecs import codec


def _by_codec(back: bool):
    def run(content: pd.Series, name: pd.Series) -> pd.Series:
        work = {n: codec(n)[back] for n in name.dropna().unique()}
        return pd.Series([None if x is None or n is None else work[n](bytes(x)) for x, n in zip(content, name, strict=True)], dtype=object)

    return F.pandas_udf(run, T.BinaryType())


compress, decompress = _by_codec(False), _by_codec(True)


_CHUNK = T.StructType([T.StructField(n, k) for n, k in (("l2", T.LongType()), ("offset", T.LongType()), ("length", T.LongType()), ("data", T.BinaryType()))])


@F.udtf(returnType=_CHUNK)
class CdcChunks:
    """A row per chunk, in order; none of null or empty content."""

    def eval(self, content: bytes, window: int = 32) -> Iterator[tuple]:
        at = 0
        for l2, n in enumerate(chunk_lengths(bytes(content), window) if content else ()):
            yield l2, at, n, bytes(content[at : at + n])
            at += n


def register(spark: SparkSession) -> None:
    spark.udf.register("compress", compress)
    spark.udf.register("decompress", decompress)
    spark.udtf.register("cdc_chunks", CdcChunks)
