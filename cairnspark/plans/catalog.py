"""The registered queries and the same results in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.functions import chunking, sql
from cairnspark.operators import analysis, dedup, stats
from cairnspark.sources import archive, tables
from cairnspark.streaming import dedup as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, length, fp: no text leaves the scan."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("length"), F.sha1(F.encode("text", "UTF-8")).alias("fp"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.mark_duplicates(_docs(spark, sf_dir), ("doc_id",))
    return rows.select("doc_id", "length", "fp", F.col("ref.doc_id").alias("ref_id"), "is_duplicate")


_F = "f AS (SELECT doc_id, strlen(text)::BIGINT AS length, sha1(text) AS fp FROM documents)"
_M = f"{_F}, m AS (SELECT *, min(doc_id) OVER (PARTITION BY fp) AS ref_id, doc_id <> min(doc_id) OVER (PARTITION BY fp) AS is_duplicate FROM f)"


@query(f"WITH {_F} SELECT * FROM f")
def doc_fingerprint(spark, sf_dir):
    return _docs(spark, sf_dir)


@query(f"WITH {_M} SELECT * FROM m")
def doc_mark_duplicates(spark, sf_dir):
    return _marked(spark, sf_dir)


@query(f"WITH {_M} SELECT doc_id, length, fp FROM m WHERE NOT is_duplicate")
def doc_unique(spark, sf_dir):
    return _marked(spark, sf_dir).filter("not is_duplicate").select("doc_id", "length", "fp")


@query(f"WITH {_M} SELECT doc_id, ref_id FROM m WHERE is_duplicate")
def doc_duplicate_only(spark, sf_dir):
    return _marked(spark, sf_dir).filter("is_duplicate").select("doc_id", "ref_id")


@query(f"WITH {_F} SELECT doc_id, fp FROM f WHERE doc_id % 2 = 1 AND fp IN (SELECT fp FROM f WHERE doc_id % 2 = 0)")
def fp_semi(spark, sf_dir):
    """The odd half against the even half's fingerprints."""
    rows = _docs(spark, sf_dir).select("doc_id", "fp")
    return dedup.known_only(rows.filter("doc_id % 2 = 1"), rows.filter("doc_id % 2 = 0")).select("doc_id", "fp")


@query(f"WITH {_F} SELECT doc_id, fp FROM f WHERE doc_id % 2 = 1 AND fp NOT IN (SELECT fp FROM f WHERE doc_id % 2 = 0)")
def fp_anti(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "fp")
    return dedup.new_only(rows.filter("doc_id % 2 = 1"), rows.filter("doc_id % 2 = 0")).select("doc_id", "fp")


@query(f"WITH {_M} SELECT d.doc_id, d.ref_id, o.length AS ref_length FROM m d JOIN m o ON d.ref_id = o.doc_id WHERE d.is_duplicate")
def duplicate_resolve(spark, sf_dir):
    """Each duplicate with its original."""
    rows = _marked(spark, sf_dir)
    own = rows.filter("not is_duplicate").select("fp", F.col("length").alias("ref_length"))
    return rows.filter("is_duplicate").join(own, "fp").select("doc_id", "ref_id", "ref_length")


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents")
def doc_md5(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("md5"))


@query("""WITH t AS (SELECT 0 AS kind, doc_id AS id, string_split(text, chr(10)) AS lines FROM documents UNION ALL SELECT 1, page_id, string_split(html, chr(10)) FROM pages),
l AS (SELECT kind, id, unnest(range(len(lines))) AS line_no, unnest(lines) AS line FROM t),
g AS (SELECT sha1(line) AS fp, min((kind, id, line_no)) AS ref, count(*) AS n, max(strlen(line)) AS length FROM l GROUP BY 1)
SELECT fp, struct_extract(ref, 1)::INT AS kind, struct_extract(ref, 2)::BIGINT AS id, struct_extract(ref, 3)::BIGINT AS line_no, n::BIGINT AS n, length::BIGINT AS length FROM g""")
def line_dedup(spark, sf_dir):
    """Distinct lines of documents and pages with their first place and number."""
    lines = [
        _table(spark, sf_dir, t).select(F.lit(kind).alias("kind"), F.col(i).alias("id"), F.posexplode(F.split(c, "\n")).alias("line_no", "line"))
        for kind, (t, i, c) in enumerate((("documents", "doc_id", "text"), ("pages", "page_id", "html")))
    ]
    rows = lines[0].unionByName(lines[1]).select("kind", "id", F.col("line_no").cast("long").alias("line_no"), F.octet_length("line").alias("length"), F.sha1(F.encode("line", "UTF-8")).alias("fp"))
    got = rows.groupBy("fp").agg(F.min(F.struct("kind", "id", "line_no")).alias("ref"), F.count("*").alias("n"), F.max("length").cast("long").alias("length"))
    return got.select("fp", "ref.kind", "ref.id", "ref.line_no", "n", "length")


@query(f"WITH {_M} SELECT doc_id, CASE WHEN is_duplicate THEN 0 ELSE 1 END AS type, CASE WHEN is_duplicate THEN 20 ELSE length END::BIGINT AS length, CASE WHEN is_duplicate THEN fp ELSE sha1(text) END AS content_id FROM m JOIN documents USING (doc_id)")
def records_none(spark, sf_dir):
    """Archive records without compression, whole documents as chunks."""
    rows = _marked(spark, sf_dir)
    dup = F.col("is_duplicate")
    return rows.select("doc_id", F.when(dup, 0).otherwise(1).alias("type"), F.when(dup, F.lit(20).cast("long")).otherwise(F.col("length")).alias("length"), F.col("fp").alias("content_id"))


def _totals(spark, sf_dir) -> DataFrame:
    return stats.totals(_marked(spark, sf_dir), "length")


_T = f"""{_M}, t AS (SELECT count(*) AS n_chunks, sum(is_duplicate::INT)::BIGINT AS n_duplicates, sum(length)::BIGINT AS total_input,
sum(CASE WHEN NOT is_duplicate THEN length ELSE 0 END)::BIGINT AS total_dedup, sum(CASE WHEN NOT is_duplicate THEN length ELSE 0 END)::BIGINT AS total_compressed,
(5 + sum(9 + CASE WHEN is_duplicate THEN 20 ELSE length END))::BIGINT AS total_output, round(avg(length), 6) AS mean_length, round(stddev_pop(length), 6) AS stddev_length FROM m)"""


@query(f"WITH {_T} SELECT * FROM t")
def dedup_totals(spark, sf_dir):
    return _totals(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("mean_length", "stddev_length")})


@query(f"""WITH {_T} SELECT round(100.0 * n_duplicates / n_chunks, 6) AS duplicate_pct, round(total_input / total_dedup, 6) AS dedup_factor, round(total_dedup / total_compressed, 6) AS compression_factor,
round(total_input / total_output, 6) AS total_factor, round(100.0 * (total_output - total_compressed) / total_output, 6) AS overhead_pct FROM t""")
def dedup_percentages(spark, sf_dir):
    got = stats.percentages(_totals(spark, sf_dir))
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


_SIZES = "s AS (SELECT strlen(text)::BIGINT AS length FROM documents UNION ALL SELECT strlen(html)::BIGINT FROM pages)"


@query(f"WITH {_SIZES} SELECT least(length >> 7, 255)::BIGINT AS slot, (least(length >> 7, 255) * 128 + 64)::BIGINT AS midpoint, count(*) AS n FROM s GROUP BY 1, 2")
def size_histogram(spark, sf_dir):
    lengths = [_table(spark, sf_dir, t).select(F.octet_length(c).cast("long").alias("length")) for t, c in (("documents", "text"), ("pages", "html"))]
    return stats.histogram(lengths[0].unionByName(lengths[1]))


@query("""WITH s AS (SELECT strlen(text)::BIGINT AS length FROM documents), e AS (SELECT min(length) AS low, max(length) AS high, count(*) AS total FROM s),
b AS (SELECT CASE WHEN high > low THEN least(floor((length - low) * 50 / (high - low)), 49) ELSE 0 END::BIGINT AS bin, (high - low) / 50 AS w, total FROM s, e)
SELECT bin, count(*) AS n, round(count(*) / (any_value(total) * any_value(w)), 9) AS density FROM b GROUP BY bin""")
def size_histogram_50(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.octet_length("text").cast("long").alias("length"))
    return stats.density(rows).withColumn("density", F.round("density", 9))


@query(f"""WITH {_T}, u AS (SELECT *, least(total_input, total_dedup, total_compressed, total_output) AS low FROM t), k AS (SELECT *, CASE WHEN low >= 1024 THEN floor(log(low) / log(1024) + 1e-12) ELSE 0 END::INT AS step FROM u)
SELECT round(total_input / 1024.0 ** step, 6) AS total_input, round(total_dedup / 1024.0 ** step, 6) AS total_dedup, round(total_compressed / 1024.0 ** step, 6) AS total_compressed, round(total_output / 1024.0 ** step, 6) AS total_output,
['Bytes', 'KB', 'MB', 'GB', 'TB', 'PB', 'EB'][step + 1] AS unit FROM k""")
def stats_scaled(spark, sf_dir):
    """Totals in their unit."""
    got = stats.scaled(_totals(spark, sf_dir))
    return got.withColumns({c: F.round(c, 6) for c in got.columns if c != "unit"})


@query(f"""WITH {_SIZES}, h AS (SELECT least(length >> 7, 255) * 128 + 64 AS x, count(*) AS n FROM s GROUP BY 1), m AS (SELECT sum(x * n) / sum(n) AS mean, sum(n) AS total FROM h)
SELECT round(any_value(mean), 6) AS mean, round(sqrt(sum(n * (x - mean) ** 2) / any_value(total)), 4) AS stddev, round(sqrt(sum(n * (x - mean) ** 2)), 2) AS root_sum_squares FROM h, m""")
def stats_slot_mean(spark, sf_dir):
    """Mean and deviation by the histogram's slots."""
    lengths = [_table(spark, sf_dir, t).select(F.octet_length(c).cast("long").alias("length")) for t, c in (("documents", "text"), ("pages", "html"))]
    got = stats.slot_mean(stats.histogram(lengths[0].unionByName(lengths[1])))
    return got.select(F.round("mean", 6).alias("mean"), F.round("stddev", 4).alias("stddev"), F.round("root_sum_squares", 2).alias("root_sum_squares"))


@query("""WITH r AS (SELECT doc_id, strlen(text)::BIGINT AS i, strlen(text)::BIGINT // 3 AS o, doc_id % 1000 + 1 AS m FROM documents)
SELECT doc_id, round(m / 1e6, 6) AS seconds, round(i / 1048576.0, 6) AS input_mb, round(o / 1048576.0, 6) AS output_mb, round(100.0 * o / nullif(i, 0), 6) AS ratio_pct, round((i / 1048576.0) / (m / 1e6), 4) AS input_mb_s, round((o / 1048576.0) / (m / 1e6), 4) AS output_mb_s FROM r""")
def size_throughput(spark, sf_dir):
    """Sizes, ratio and throughput of runs, here with a time made of the id."""
    n = F.octet_length("text").cast("long")
    got = stats.size_throughput(_table(spark, sf_dir, "documents").select("doc_id", n.alias("input_bytes"), F.floor(n / 3).alias("output_bytes"), (F.col("doc_id") % 1000 + 1).alias("micros")))
    return got.select("doc_id", *(F.round(c, 4 if c.endswith("_s") else 6).alias(c) for c in got.columns if c != "doc_id"))


@query("SELECT strlen(text)::BIGINT AS length, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def sizes_text_scan(spark, sf_dir):
    """Chunk sizes written as text, one a line, and read back."""
    path = tables.scratch(spark, "sizes")
    _table(spark, sf_dir, "documents").filter("text is not null").select(F.octet_length("text").cast("string")).write.text(path)
    return dedup.read_sizes(spark, path).groupBy("length").agg(F.count("*").alias("n"))


def _restored(column: str) -> list[F.Column]:
    return [F.octet_length(column).cast("long").alias("n_bytes"), F.sha1(column).alias("sha1")]


_BACK = "SELECT {0}::BIGINT AS stream_id, strlen(coalesce({1}, ''))::BIGINT AS n_bytes, sha1(coalesce({1}, '')) AS sha1 FROM {2}"


def _blobs(spark: SparkSession, sf_dir: str, table: str = "documents", id_col: str = "doc_id", column: str = "text") -> DataFrame:
    return dedup.spread(dedup.blobs(_table(spark, sf_dir, table), id_col, column))


def _with_empty(spark: SparkSession, sf_dir: str, whole: DataFrame, table: str = "documents", id_col: str = "doc_id") -> DataFrame:
    """Restored streams, and the empty ones, of which there is no chunk."""
    ids = _table(spark, sf_dir, table).select(F.col(id_col).cast("long").alias("stream_id"))
    return ids.join(whole, "stream_id", "left").select("stream_id", *_restored(F.coalesce("content", F.lit(b""))))


def _cuts(window: int):
    def run(spark, sf_dir):
        return dedup.chunks(_blobs(spark, sf_dir), window).select("stream_id", "l2", "offset", "length")

    return run


def _cut_sql() -> str:
    """The cuts of window 32: a byte's part of the hash depends on how many places before the last it is,
    so the low twelve bits come from 32 tables; then cuts are taken from the left, 32 bytes apart at least."""
    places = [[int(x) & chunking.MASK for x in row] for row in chunking.place_tables()]
    hashed = " ".join(f"xor({row}[b[i - {k}] + 1]," for k, row in enumerate(places[:-1]))
    value = f"{hashed} {places[-1]}[b[i - 31] + 1]" + ")" * (len(places) - 1)
    return f"""
WITH RECURSIVE h AS MATERIALIZED (SELECT doc_id, strlen(text)::BIGINT AS n, regexp_extract_all(hex(encode(text)), '..') AS x FROM documents WHERE strlen(text) > 0),
d AS (SELECT doc_id AS stream_id, n, list_transform(x, lambda c: ('0x' || c)::INT) AS b FROM h),
p AS (SELECT stream_id, b, unnest(range(32, n + 1)) AS i FROM d WHERE n >= 32),
e AS (SELECT stream_id, i AS cut FROM p WHERE {value} = 0),
c AS (SELECT stream_id, n, 0::BIGINT AS l2, 0::BIGINT AS "offset", coalesce((SELECT min(cut) FROM e WHERE e.stream_id = d.stream_id), n) AS stop FROM d
UNION ALL SELECT c.stream_id, c.n, l2 + 1, c.stop, coalesce((SELECT min(cut) FROM e WHERE e.stream_id = c.stream_id AND e.cut >= c.stop + 32), c.n) FROM c WHERE c.stop < c.n)
SELECT stream_id, l2, "offset", stop - "offset" AS length FROM c"""


query(_cut_sql(), "chunk_cuts_w32")(_cuts(32))
query(None, "chunk_cuts_w0")(_cuts(0))


def _reassembled(table: str, id_col: str, column: str, window: int):
    def run(spark, sf_dir):
        cut = dedup.chunks(_blobs(spark, sf_dir, table, id_col, column), window)
        return _with_empty(spark, sf_dir, dedup.joined(cut), table, id_col)

    return run


for _t, _i, _c in (("documents", "doc_id", "text"), ("pages", "page_id", "html")):
    for _w in (0, 32):
        query(_BACK.format(_i, _c, _t), f"cdc_reassemble_w{_w}" + ("_pages" if _t == "pages" else ""))(_reassembled(_t, _i, _c, _w))


@query(_BACK.format("doc_id", "text", "documents"))
def coarse_refine(spark, sf_dir):
    """Cut into coarse blocks, refined apart and put together; blocks of 8 KiB, as documents are short."""
    blocks = dedup.coarse(_blobs(spark, sf_dir), jump=8192)
    return _with_empty(spark, sf_dir, dedup.joined(dedup.refined(blocks)))


def _round_trip(name: str):
    def run(spark, sf_dir):
        packed = dedup.coded(_blobs(spark, sf_dir), name, "content", "packed").drop("content")
        return dedup.coded(packed, name, "packed", "content", back=True).select("stream_id", *_restored("content"))

    return run


for _n in ("none", "gzip", "bzip2", "lzss"):
    query(_BACK.format("doc_id", "text", "documents"), f"{_n}_roundtrip")(_round_trip(_n))


@query(_BACK.format("doc_id", "text", "documents"))
def dedup_roundtrip(spark, sf_dir):
    """Chunked, deduplicated across all documents, compressed and restored."""
    done = tables.written(dedup.dedup_encode(dedup.blobs(_table(spark, sf_dir, "documents"), "doc_id", "text")), "encoded")
    return _with_empty(spark, sf_dir, dedup.dedup_decode(done))


@query("SELECT count(*) > 0 AS has_chunks, sum(strlen(text))::BIGINT AS total_input FROM documents")
def dedup_stats(spark, sf_dir):
    """Totals of an encoding; only what doesn't depend on the cuts is compared."""
    done = dedup.dedup_stats(dedup.dedup_encode(dedup.blobs(_table(spark, sf_dir, "documents"), "doc_id", "text")))
    sound = (F.col("total_dedup") <= F.col("total_input")) & (F.col("total_compressed") < F.col("total_output")) & (F.col("n_duplicates") < F.col("n_chunks"))
    return done.select(sound.alias("has_chunks"), "total_input")


@query(_BACK.format("page_id", "html", "pages"))
def archive_roundtrip(spark, sf_dir):
    """An archive per page, parsed and restored."""
    import pyarrow as pa
    from pyspark.sql import Window

    cut = dedup.fingerprinted(dedup.chunks(_blobs(spark, sf_dir, "pages", "page_id", "html")))
    # an archive stands alone: duplicates are sought within its stream
    first = F.min(F.struct("l1", "l2")).over(Window.partitionBy("stream_id", "fp"))
    marked = cut.withColumn("is_duplicate", F.struct("l1", "l2") != first)
    packed = dedup.coded(marked.withColumn("own", F.when(~F.col("is_duplicate"), F.col("data"))).drop("data"), "gzip", "own", "payload")
    made = archive.bytes_of(packed, "gzip")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([archive.restore(x) for x in batch.column(1).to_pylist()], pa.binary())], ["stream_id", "content"])

    return _with_empty(spark, sf_dir, made.mapInArrow(run, "stream_id long, content binary"), "pages", "page_id")


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS record_no, strlen(text)::BIGINT AS n_bytes, sha1(text) AS sha1 FROM documents WHERE strlen(text) > 0")
def archive_file_roundtrip(spark, sf_dir):
    """Documents as the records of one archive, written by the sink, read back and restored (an empty one has no record)."""
    rows = dedup.blobs(_table(spark, sf_dir, "documents"), "doc_id", "text").filter("octet_length(content) > 0")
    rows = dedup.fingerprinted(rows.select("stream_id", F.lit(0).alias("l1"), F.lit(0).alias("l2"), F.col("content").alias("data")))
    marked = dedup.mark_duplicates(rows.select(*dedup.PLACE, "fp"))
    own = rows.select(F.col("stream_id").alias("id"), "data").join(marked.filter("not is_duplicate").select(F.col("stream_id").alias("id")), "id")
    payload = dedup.coded(own, "gzip", "data", "payload").drop("data")
    path = tables.scratch(spark, "archive")
    archive.write(marked.join(payload, F.col("stream_id") == F.col("id"), "left").drop("id"), "gzip", path)
    records = spark.read.format("dedup_archive").load(path).withColumn("stream_id", F.lit(0).cast("long"))
    return dedup.restored(records, archive.codec_at(path)).select("record_no", *_restored("data"))


@query("SELECT doc_id, strlen(text)::BIGINT AS n_bytes, strlen(text)::BIGINT AS chunk_bytes, sha1(text) AS sha1 FROM documents WHERE strlen(text) > 0")
def sql_functions(spark, sf_dir):
    """compress, decompress and cdc_chunks in SQL."""
    sql.register(spark)
    return spark.sql(
        """SELECT doc_id, octet_length(content)::BIGINT AS n_bytes, sum(c.length) AS chunk_bytes, sha1(any_value(decompress(packed, 'lzss'))) AS sha1
        FROM (SELECT doc_id, content, compress(content, 'lzss') AS packed FROM (SELECT doc_id, encode(text, 'UTF-8') AS content FROM {docs})), LATERAL cdc_chunks(content, 32) c
        GROUP BY doc_id, content""",
        docs=dedup.spread(_table(spark, sf_dir, "documents").select("doc_id", "text")),
    )


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, (sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) - strlen(text))::BIGINT AS "start" FROM conversations""")
def ordered_records(spark, sf_dir):
    """Turns in order, with their place and byte offset in the conversation."""
    from pyspark.sql import Window

    by = Window.partitionBy("conv_id").orderBy("turn")
    size = F.octet_length("text").cast("long")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(by).cast("long").alias("position"), (F.sum(size).over(by) - size).alias("start"))


def _streamed(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, str]:
    """Fingerprints of documents as a stream of four files, and a folder for what the stream writes."""
    path = tables.scratch(spark, name)
    _docs(spark, sf_dir).select("doc_id", "fp").repartitionByRange(4, "doc_id").write.parquet(f"{path}/in")
    return streaming.source(spark, f"{path}/in", "doc_id long, fp string", max_files=2), path


@query(f"WITH {_M} SELECT fp, count(*) AS n, sum(is_duplicate::INT)::BIGINT AS n_duplicates FROM m GROUP BY 1")
def stream_mark(spark, sf_dir):
    """A stream against a growing table: each fingerprint has one original, whatever the batches."""
    rows, path = _streamed(spark, sf_dir, "marked")
    streaming.mark_stream(rows, ("doc_id",), f"{path}/store", f"{path}/out", f"{path}/cp").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("fp").agg(F.count("*").alias("n"), F.sum(F.col("is_duplicate").cast("long")).alias("n_duplicates"))


@query(f"WITH {_M} SELECT fp, count(*) AS n, sum(is_duplicate::INT)::BIGINT AS n_duplicates FROM m GROUP BY 1")
def stream_state(spark, sf_dir):
    """The same with keyed state that expires after a day."""
    rows, path = _streamed(spark, sf_dir, "state")
    streaming.finish(streaming.mark_with_state(rows, ("doc_id",), 86_400_000), f"{path}/out", f"{path}/cp")
    return spark.read.parquet(f"{path}/out").groupBy("fp").agg(F.count("*").alias("n"), F.sum(F.col("is_duplicate").cast("long")).alias("n_duplicates"))


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events")
def stream_in_order(spark, sf_dir):
    """Events that come out of order, emitted in order: part by part, the rows' own number."""
    path = tables.scratch(spark, "ordered")
    events = _table(spark, sf_dir, "events").select("event_id")
    low = events.agg(F.min("event_id")).first()[0] or 0
    events.withColumn("position", F.col("event_id") - low).repartition(4, "event_id").write.parquet(f"{path}/in")
    rows = streaming.source(spark, f"{path}/in", "event_id long, position long", max_files=1)
    streaming.emit_in_order(rows, "position", f"{path}/wait", f"{path}/out", f"{path}/cp").awaitTermination()
    # only the numbers of what was emitted
    return spark.read.parquet(f"{path}/out").select("event_id", "position")


def _runs(spark, sf_dir) -> DataFrame:
    """Events as benchmark runs: the type is the data set, users are spread over modes and threads."""
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset"), F.concat(F.lit("mode"), F.col("user_id") % 3).alias("mode"), (F.col("event_id") % 4).alias("threads"), F.col("value").alias("total_time"))


_R = "r AS (SELECT event_type AS dataset, 'mode' || (user_id % 3) AS mode, event_id % 4 AS threads, value AS total_time FROM events)"
_G = f"{_R}, g AS (SELECT dataset, mode, threads, avg(total_time) AS avg_time, stddev_samp(total_time) AS stdev, count(*) AS n FROM r GROUP BY ALL)"
_SPEED = "round(base / avg_time, 6) AS speedup, round(coalesce(base / (avg_time + stdev) - base / avg_time, 0), 6) AS error"


@query(f"WITH {_G} SELECT dataset, mode, threads, round(avg_time, 6) AS avg_time, round(stdev, 6) AS stdev, n FROM g")
def result_group_stats(spark, sf_dir):
    return analysis.group_stats(_runs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("avg_time", "stdev")})


@query(f"WITH {_G}, b AS (SELECT avg(total_time) AS base FROM r WHERE mode = 'mode0') SELECT dataset, mode, threads, {_SPEED} FROM g, b WHERE mode <> 'mode0'")
def result_speedup(spark, sf_dir):
    return analysis.speedups(_runs(spark, sf_dir), "mode0", "global").withColumns({c: F.round(c, 6) for c in ("speedup", "error")})


@query(f"WITH {_G}, b AS (SELECT dataset, avg(total_time) AS base FROM r WHERE mode = 'mode0' GROUP BY 1) SELECT dataset, mode, threads, {_SPEED} FROM g LEFT JOIN b USING (dataset) WHERE mode <> 'mode0'")
def result_speedup_correlated(spark, sf_dir):
    return analysis.speedups(_runs(spark, sf_dir), "mode0").withColumns({c: F.round(c, 6) for c in ("speedup", "error")})


@query(f"""WITH {_G}, u AS (SELECT dataset, mode, threads, avg_time FROM g WHERE mode = 'mode0' UNION SELECT dataset, mode, threads + 1, avg_time FROM g WHERE mode <> 'mode0')
SELECT dataset, mode, threads, round(avg_time, 6) AS avg_time FROM u UNION SELECT * FROM (SELECT 'best' AS dataset, mode, threads, round(avg_time, 6) FROM g ORDER BY avg_time, dataset, mode, threads LIMIT 1)""")
def result_union_best(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    g = analysis.group_stats(runs).select("dataset", "mode", "threads", "avg_time")
    u = g.filter("mode = 'mode0'").union(g.filter("mode <> 'mode0'").withColumn("threads", F.col("threads") + 1))
    top = analysis.best(runs).withColumn("dataset", F.lit("best"))
    return u.union(top).withColumn("avg_time", F.round("avg_time", 6)).distinct()


@query(f"""WITH {_R}, a AS (SELECT dataset, mode, threads FROM r UNION ALL SELECT p_type, p_brand, p_size % 4 FROM part)
SELECT DISTINCT mode || '_' || threads AS label, dataset FROM a WHERE dataset ILIKE '%C%' AND mode <> 'mode1'""")
def result_modes(spark, sf_dir):
    """Distinct labels, of runs and of parts as further runs."""
    parts = _table(spark, sf_dir, "part").select(F.col("p_type").alias("dataset"), F.col("p_brand").alias("mode"), (F.col("p_size") % 4).cast("long").alias("threads"))
    runs = _runs(spark, sf_dir).select("dataset", "mode", "threads").unionByName(parts)
    runs = runs.filter(F.col("dataset").ilike("%C%") & (F.col("mode") != "mode1"))
    return runs.select(F.concat("mode", F.lit("_"), "threads").alias("label"), "dataset").distinct()


@query(f"WITH {_R} SELECT dataset, mode, threads, round(avg(total_time), 6) AS avg_time, round(stddev_pop(total_time), 6) AS stdev_pop FROM r GROUP BY ALL")
def result_population(spark, sf_dir):
    return analysis.population_stats(_runs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("avg_time", "stdev_pop")})


@query(f"""WITH {_R}, s AS (SELECT * FROM (VALUES ('view', 193034240), ('purchase', 854784000), ('click', 211957760)) v(dataset, size_bytes)), t AS (SELECT dataset, mode, threads, size_bytes / 1048576.0 / (total_time / 1000.0) AS v FROM r JOIN s USING (dataset) WHERE total_time > 0.01)
SELECT dataset, mode, threads, round(avg(v), 2) AS mb_s, round(stddev_pop(v), 2) AS mb_s_stdev FROM t GROUP BY ALL""")
def result_throughput(spark, sf_dir):
    sizes = spark.createDataFrame([("view", 193034240), ("purchase", 854784000), ("click", 211957760)], "dataset string, size_bytes long")
    return analysis.throughputs(_runs(spark, sf_dir).filter("total_time > 0.01"), sizes).withColumns({c: F.round(c, 2) for c in ("mb_s", "mb_s_stdev")})


_P = "p AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'CPU_SEQUENTIAL' ELSE 'GPU_CUDA' END AS plan, event_id % 10 AS threads FROM events)"


def _plans(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, "CPU_SEQUENTIAL").otherwise("GPU_CUDA").alias("plan"), (F.col("event_id") % 10).alias("threads"))


@query(f"WITH {_P} SELECT event_id, plan, CASE WHEN plan = 'CPU_SEQUENTIAL' AND threads <= 7 THEN (threads + 1) * 10 ELSE threads END AS threads FROM p")
def result_remap(spark, sf_dir):
    return analysis.remapped(_plans(spark, sf_dir), "CPU_SEQUENTIAL")


@query(f"""WITH {_P} SELECT DISTINCT plan, threads, CASE WHEN plan = 'CPU_SEQUENTIAL' THEN 'SPar(' || threads || ' THREAD' || CASE WHEN threads <> 1 THEN 'S)' ELSE ')' END
ELSE replace(plan, 'GPU_', '') || '(' || threads || ' GPU' || CASE WHEN threads > 1 THEN 'S)' ELSE ')' END END AS label FROM p""")
def result_labels(spark, sf_dir):
    return _plans(spark, sf_dir).select("plan", "threads", analysis.label(F.col("plan"), F.col("threads")).alias("label")).distinct()


@query("""WITH n AS (SELECT DISTINCT (['spar', 'cuda_spar', 'opencl', 'sequential'])[(user_id % 4)::INT + 1] || '_' || event_id % 5 AS name FROM events),
s AS (SELECT name, string_split(name, '_') AS p FROM n),
w AS (SELECT name, p[-1] AS t, replace(replace(replace(replace(array_to_string(p[:-2], ' '), 'spar', 'SPar'), 'cuda', 'CUDA'), 'opencl', 'OpenCL'), 'sequential', 'Sequencial') AS shown FROM s)
SELECT name, CASE WHEN shown = 'SPar' THEN shown || ' (' || t || ' replica' || CASE WHEN t::INT > 1 THEN 's' ELSE '' END || ')' ELSE shown END AS shown, regexp_extract('/data/' || name || '.tar.gz', '([^/.]+)[^/]*$', 1) AS base FROM w""")
def result_names(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("spar", "cuda_spar", "opencl", "sequential"))), (F.col("user_id") % 4).cast("int") + 1)
    names = _table(spark, sf_dir, "events").select(F.concat(kind, F.lit("_"), (F.col("event_id") % 5).cast("string")).alias("name")).distinct()
    return names.select("name", analysis.better_name(F.col("name")).alias("shown"), analysis.base_name(F.concat(F.lit("/data/"), "name", F.lit(".tar.gz"))).alias("base"))


@query(f"""WITH {_R}, a AS (SELECT avg(total_time) AS avg_time, stddev_samp(total_time) AS stdev FROM r)
SELECT dataset, mode, threads, round(avg_time, 6) AS avg_time, round(stdev, 6) AS stdev FROM (SELECT * FROM r WHERE total_time IS NOT NULL ORDER BY total_time, dataset, mode, threads LIMIT 1), a""")
def result_one_group(spark, sf_dir):
    return analysis.one_group(_runs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("avg_time", "stdev")})


@query(f"""WITH {_G}, o AS (SELECT 3 AS o, dataset, mode, threads, avg_time FROM g WHERE mode <> 'mode0' UNION SELECT * FROM (SELECT 2, dataset, mode, threads, avg_time FROM g WHERE mode = 'mode0' ORDER BY avg_time, dataset, mode, threads LIMIT 1) UNION SELECT 1, dataset, mode, threads, avg_time FROM g WHERE mode = 'mode0' AND threads = 0)
SELECT o, dataset, mode, threads, round(avg_time, 6) AS avg_time, row_number() OVER (ORDER BY o, dataset, threads, mode) AS place FROM o""")
def result_ordered(spark, sf_dir):
    """Tagged groups in their final order, with their place in it."""
    from pyspark.sql import Window

    runs = _runs(spark, sf_dir)
    g = analysis.group_stats(runs).select("dataset", "mode", "threads", "avg_time")
    tagged = [g.filter("mode <> 'mode0'").withColumn("o", F.lit(3)), analysis.best(runs.filter("mode = 'mode0'")).withColumn("o", F.lit(2)), g.filter("mode = 'mode0' and threads = 0").withColumn("o", F.lit(1))]
    rows = analysis.in_final_order(tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).distinct())
    # a handful of groups, so one window
    place = F.row_number().over(Window.orderBy("o", "dataset", "threads", "mode"))
    return rows.select("o", "dataset", "mode", "threads", F.round("avg_time", 6).alias("avg_time"), place.cast("long").alias("place"))


@query(f"WITH {_R} SELECT dataset, mode, threads::INT AS threads, total_time::DECIMAL(10,6)::DOUBLE AS total_time, count(*) AS n, 2::BIGINT AS appends FROM (SELECT * FROM r UNION ALL SELECT * FROM r) GROUP BY ALL")
def result_append(spark, sf_dir):
    """Runs appended twice to a run table with the day and time, and read from it by SQL."""
    path = tables.scratch(spark, "result")
    runs = _runs(spark, sf_dir)
    analysis.append_results(runs, path)
    analysis.append_results(runs, path)
    result = spark.read.schema(analysis.RESULT).parquet(path)
    sound = "count(DISTINCT id) = count(*) AND count(current_date) = count(*) AND min(length(current_time)) = 8"
    return analysis.select_data(spark, f"SELECT dataset, mode, threads, CAST(total_time AS DOUBLE) AS total_time, count(*) AS n, CASE WHEN {sound} THEN 2L END AS appends FROM {{result}} GROUP BY dataset, mode, threads, total_time", result=result)


_LOG = "CASE WHEN event_type = 'purchase' THEN 'It took ' || user_id || '.' || (event_id % 1000) || ' ms' ELSE props END"


@query(f"""SELECT event_id, coalesce(nullif(regexp_extract(props, '"k": ([0-9]+)', 1), ''), '-1') AS k, coalesce(nullif(regexp_extract({_LOG}, 'It took ([0-9.]+)', 1), ''), '0') AS took FROM events""")
def log_extract(spark, sf_dir):
    """Fields of a run's output; purchases stand for runs that print their time."""
    return _table(spark, sf_dir, "events").select("event_id", analysis.extracted(F.col("props"), '"k": ([0-9]+)', "-1").alias("k"), analysis.extracted(F.expr(_LOG), *analysis.TIME).alias("took"))


_PRINTED = """'Selected Plan: ' || upper(event_type) || '_' || chr((65 + event_id % 26)::INT) || chr(10) || CASE WHEN event_id % 3 = 0 THEN 'File statistics: memory' || chr(10) ELSE '' END ||
'timeSpentOnMemoryHostToDevice: 0.' || (event_id % 97) || ' seconds' || chr(10) || CASE WHEN event_id % 2 = 0 THEN 'timeSpentOnKernel: ' || (event_id % 89) || '.5 seconds' || chr(10) || 'timeSpentOnMemoryDeviceToHost: 0.25 seconds' || chr(10) ELSE '' END ||
'Total time: ' || (event_id % 1000) || '.25 seconds' || chr(10) || 'Finding match: ' || (event_id % 50) || '.125 seconds' || chr(10) || 'Input file size: ' || (event_id % 7) || '.50 MB(1 bytes)' || chr(10) || 'Output file size: 1.75 MB(1 bytes)' || chr(10) ||
'Compress ratio: ' || (event_id % 100) || '.00% ' || chr(10) || 'Input processing: 12.50 MB/s' || chr(10) || 'Output processing: ' || (event_id % 11) || '.00 MB/s'"""


def _printed_sql() -> str:
    own = lambda k, p, d: f"coalesce(nullif(regexp_extract(t, '{p}', 1), ''), '{d}')" + ("" if k in ("plan", "file_statistics") else "::DOUBLE") + f" AS {k}"
    return f"SELECT event_id, {', '.join(own(k, p, d) for k, (p, d) in analysis.PRINTED.items())} FROM (SELECT event_id, {_PRINTED} AS t FROM events)"


@query(_printed_sql())
def lzss_log_extract(spark, sf_dir):
    """The twelve fields that a compression run prints, of texts made from events."""
    text = _PRINTED.replace("::INT", "").replace("chr((65 + event_id % 26))", "chr(65 + event_id % 26)")
    rows = _table(spark, sf_dir, "events").select("event_id", F.expr(text).alias("t"))
    return rows.select("event_id", *(c.alias(k) for k, c in analysis.printed(F.col("t")).items()))
