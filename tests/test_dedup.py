import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark.functions import sql
from cairnspark.functions.chunking import chunk_lengths
from cairnspark.operators import analysis, dedup, stats
from cairnspark.plans import benchmark
from cairnspark.sources import archive, files, tables
from cairnspark.streaming import dedup as streaming


@pytest.fixture(scope="module")
def streams(spark):
    a, b = b"".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(900)), bytes(200)
    return spark.createDataFrame([(1, a + b), (2, b"x" + a), (3, b""), (4, a + b), (5, b"short")], "stream_id long, content binary")


@pytest.mark.parametrize("name", ["none", "gzip", "bzip2", "lzss"])
def test_encode_decode(streams, name):
    done = dedup.encode(streams, name).cache()
    assert done.filter("is_duplicate and payload is not null or not is_duplicate and payload is null").count() == 0
    assert done.filter(F.col("is_duplicate") & (F.struct("stream_id", "l1", "l2") <= F.col("ref"))).count() == 0
    back = {r.stream_id: bytes(r.content) for r in dedup.decode(done, name).collect()}
    assert back == {r.stream_id: bytes(r.content) for r in streams.collect() if r.content}


def test_first_wins_in_any_order(spark):
    rows = [(i, f"{i % 7:02d}") for i in range(200)]
    for n in (1, 3, 8):
        got = dedup.mark_duplicates(spark.createDataFrame(rows[::-1], "id long, fp string").repartition(n), ("id",))
        assert {r.id for r in got.filter("not is_duplicate").collect()} == set(range(7))


def test_missing_original(streams):
    done = dedup.encode(streams, "none").filter("is_duplicate")
    with pytest.raises(Exception, match="no original"):
        dedup.decode(done, "none").collect()


@pytest.mark.parametrize("single", [True, False])
def test_archive(spark, streams, tmp_path, single):
    done = dedup.encode(streams, "gzip").cache()
    path = str(tmp_path / "a.dedup")
    archive.write(done, "gzip", path, single)
    archive.write(done, "gzip", path, single)  # written again, whole
    data = archive.archive_bytes(path)
    assert data == open(path, "rb").read() if single else len(list((tmp_path / "a.dedup").iterdir())) > 2
    whole = b"".join(bytes(r.content) for r in streams.orderBy("stream_id").collect())
    assert archive.restore(data) == whole and archive.codec_at(path) == "gzip"
    got = spark.read.format("dedup_archive").load(path)
    total = stats.totals(done.withColumn("payload_length", F.octet_length("payload"))).first()
    assert (got.count(), total.total_output) == (total.n_chunks, len(data))
    assert [(r.record_no, r.type, bytes(r.content)) for r in got.orderBy("record_no").collect()] == list(archive.parse(data))
    assert total.total_input == len(whole) == sum(r.length for r in done.select("length").collect())
    back = dedup.dedup_decode(got.withColumn("stream_id", F.lit(0).cast("long")))
    assert bytes(back.first().content) == whole


def test_archives_of_a_folder(spark, streams, tmp_path):
    for i in (1, 2, 4):
        archive.write(dedup.encode(streams.filter(f"stream_id = {i}"), "lzss"), "lzss", str(tmp_path / f"{i}.dedup"), single=True)
    got = spark.read.format("dedup_archive").load(str(tmp_path)).withColumn("stream_id", F.regexp_extract("path", "([0-9]+)[.]dedup", 1).cast("long"))
    back = {r.stream_id: bytes(r.content) for r in dedup.decode_records(got, "lzss").collect()}
    assert back == {r.stream_id: bytes(r.content) for r in streams.collect() if r.stream_id in (1, 2, 4)}


def test_decode_records_finds_damage(spark):
    fp = hashlib.sha1(b"abc").digest()
    kind = "stream_id long, record_no long, type tinyint, content binary"
    fine = [(1, 0, 1, b"abc"), (1, 1, 0, fp), (1, 2, 1, b"d")]
    assert bytes(dedup.decode_records(spark.createDataFrame(fine, kind), "none").first().content) == b"abcabcd"
    for rows, what in ([(1, 0, 0, fp), (1, 1, 1, b"abc")], "nothing before"), ([(2, 0, 1, b"abc"), (1, 1, 0, fp)], "nothing before"), ([(1, 0, 2, b"x")], "no record has type 2"), ([(1, 0, 9, b"x")], "type 9"):
        with pytest.raises(Exception, match=what):
            dedup.decode_records(spark.createDataFrame(rows, kind), "none").collect()
    # the digest is that of what was restored, not of what is stored
    packed = spark.createDataFrame([(1, 0, 1, zlib.compress(b"abc")), (1, 1, 0, fp)], kind)
    assert bytes(dedup.decode_records(packed, "gzip").first().content) == b"abcabc"


def test_empty_archive(spark, tmp_path):
    empty = spark.createDataFrame([], "stream_id long, content binary")
    for single in (True, False):
        path = str(tmp_path / f"e{single}")
        archive.write(dedup.encode(empty), "gzip", path, single)
        assert archive.archive_bytes(path) == archive.header("gzip") == struct.pack("<iB", 123456, 0)
        assert spark.read.format("dedup_archive").load(path).count() == 0
    assert archive.restore(archive.header("gzip")) == b""


def test_short_reads():
    data = archive.header("none") + archive.record(1, b"abcdef") + archive.record(1, b"g")
    at = [5]

    def read(n):  # two bytes at a time
        at[0] += (k := min(n, 2, len(data) - at[0]))
        return data[at[0] - k : at[0]]

    assert list(archive.scan(read)) == [(0, 1, b"abcdef"), (1, 1, b"g")]


def test_bad_archives():
    head = archive.header("none")
    bad = [b"\0" + head[1:], head[:3], head + archive.record(2, b"x"), head + archive.record(9, b"x"), head + archive.record(0, bytes(19)), head + archive.record(0, bytes(20)), head + archive.record(1, b""), head + archive.record(1, b"abc")[:-1], head + b"\1\0"]
    for data in bad:
        with pytest.raises(ValueError):
            archive.restore(data)


def test_stats(spark):
    rows = spark.createDataFrame([(0, False), (127, False), (128, True), (40000, False)], "length long, is_duplicate boolean").withColumn("payload_length", F.col("length"))
    assert {(r.slot, r.midpoint, r.n) for r in stats.histogram(rows).collect()} == {(0, 64, 2), (1, 192, 1), (255, 32704, 1)}
    assert sum(r.n for r in stats.density(rows).collect()) == 4
    none = stats.totals(rows.limit(0))
    assert none.first().total_output == 5 and stats.percentages(none).first().dedup_factor is None


def test_analysis(spark):
    rows = [("d", "seq", 1, 10.0), ("d", "seq", 1, 20.0), ("d", "par", 2, 5.0), ("e", "par", 2, 4.0), ("e", "par", 2, 6.0), ("e", "seq", 1, 8.0)]
    runs = spark.createDataFrame(rows, "dataset string, mode string, threads int, total_time double")
    assert {(r.dataset, r.mode): r.stdev for r in analysis.group_stats(runs).collect()}[("d", "par")] is None
    own = {r.dataset: (r.speedup, r.error) for r in analysis.speedups(runs, "seq").collect()}
    assert own["d"] == (3.0, 0.0) and own["e"][0] == 1.6 and own["e"][1] < 0
    assert {r.speedup for r in analysis.speedups(runs, "seq", "global").collect()} == {38 / 3 / 5}
    assert analysis.best(runs).first().avg_time == 5.0
    text = spark.createDataFrame([("It took 1.5 s",), ("no",)], "t string")
    assert [r[0] for r in text.select(analysis.extracted(F.col("t"), r"It took ([\d.]+)", "0")).collect()] == ["1.5", "0"]


def _times_x8(h, byte):
    """h * x^8 + byte modulo the polynomial, bit by bit."""
    h = h << 8 | byte
    for bit in range(39, 31, -1):
        if h >> bit & 1:
            h ^= (1 << 32 | 0x45C2B6A1) << (bit - 32)
    return h


def plain_lengths(data, window):
    gone = []
    for byte in range(256):
        h = byte
        for _ in range(window - 1):
            h = _times_x8(h, 0)
        gone.append(h)
    out, start = [], 0
    while start < len(data):
        h, end = 0, start
        while end < len(data):
            if end - start >= 32:
                h ^= gone[data[end - 32]]
            h = _times_x8(h, data[end])
            end += 1
            if end - start >= 32 and not h & 0xFFF:
                break
        out.append(end - start)
        start = end
    return out


@pytest.mark.parametrize("window", [0, 32])
def test_cuts_against_a_plain_loop(spark, window):
    from cairnspark.plans import catalog

    got = {}
    for r in catalog.QUERIES[f"chunk_cuts_w{window}"](spark, "/root/testdata/sf0.001").orderBy("stream_id", "l2").collect():
        assert r.offset == sum(got.get(r.stream_id, []))
        got.setdefault(r.stream_id, []).append(r.length)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id % 3 = 0").collect()
    for r in rows:
        assert got.get(r.doc_id, []) == plain_lengths(r.text.encode(), window)


@pytest.mark.parametrize("window", [0, 32])
def test_coarse_blocks(spark, streams, window):
    jump = 5000
    for r in streams.collect():
        data, want = bytes(r.content), []
        while len(data) > jump and jump + (n := plain_lengths(data[jump:], window)[0]) < len(data):
            want.append(jump + n)
            data = data[jump + n :]
        assert dedup.coarse_lengths(bytes(r.content), window, jump) == want + [len(data)] * bool(data)
    blocks = dedup.coarse(streams, window, jump)
    assert blocks.filter("is_last").count() == 4
    cut = dedup.refined(blocks, window).cache()
    assert cut.groupBy("stream_id", "l1").agg(F.sum(F.col("is_last").cast("int")).alias("n")).filter("n <> 1").count() == 0
    assert {r.stream_id: bytes(r.content) for r in dedup.joined(cut).collect()} == {r.stream_id: bytes(r.content) for r in streams.collect() if r.content}
    for r in blocks.collect():
        own = [x.length for x in cut.filter((F.col("stream_id") == r.stream_id) & (F.col("l1") == r.l1)).orderBy("l2").collect()]
        assert own == chunk_lengths(bytes(r.data), window)


def test_a_frequent_fingerprint_is_spread(spark):
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.sha1(F.col("id").cast("string"))).alias("fp"), F.lit(1).alias("length"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        marked = dedup.mark_duplicates(rows, ("id",))
        sizes = marked.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    counts = sorted(r["count"] for r in sizes)
    assert len(counts) == 4 and counts[-1] <= 2 * counts[len(counts) // 2]
    assert marked.filter("is_duplicate").count() == 19_999 and marked.filter("is_duplicate and ref.id <> 0").count() == 0
    plan = marked._jdf.queryExecution().executedPlan()
    marked.collect()
    # one scan: the sums and the rows come from one exchange
    assert plan.toString().split("== Initial Plan ==")[0].count("Range (") == 1


def test_options(streams):
    for options in (dedup.Options(), dedup.Options("lzss", 0, True)):
        done = dedup.dedup_encode(streams, options).cache()
        back = {r.stream_id: bytes(r.content) for r in dedup.dedup_decode(done, options).collect()}
        assert back == {r.stream_id: bytes(r.content) for r in streams.collect() if r.content}
        told = dedup.dedup_stats(done).first()
        assert told.total_input == sum(len(x) for x in back.values()) and 0 < told.duplicate_pct < 100
    with pytest.raises(ValueError):
        dedup.dedup_encode(streams, dedup.Options("zip"))


def test_files_and_times(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"f{k}").write_bytes(b"x" * k * 100)
    got = dedup.read_files(spark, str(tmp_path / "in"))
    assert sorted((r.path[-2:], r.length, len(r.content)) for r in got.collect()) == [("f1", 100, 100), ("f2", 200, 200)]
    timed = dedup.coded(dedup.preloaded(got).select("stream_id", "content"), "lzss", "content", "packed", micros="micros")
    assert timed.agg(F.sum("micros")).first()[0] >= 0 and timed.columns == ["stream_id", "content", "packed", "micros"]
    (tmp_path / "sizes.txt").write_text("12\n 7 \n\n300\n")
    assert sorted(r.length for r in dedup.read_sizes(spark, str(tmp_path / "sizes.txt")).collect()) == [7, 12, 300]


def test_more_stats(spark):
    kind = "total_input long, total_dedup long, total_compressed long, total_output long"
    small, large = spark.createDataFrame([(5000, 900, 800, 2000)], kind), spark.createDataFrame([(5 << 40, 3 << 40, 2 << 40, 2 << 30)], kind)
    assert stats.scaled(small).first().unit == "Bytes" and stats.scaled(large).first().unit == "GB" and stats.scaled(large).first().total_output == 2.0
    assert stats.scaled(spark.createDataFrame([(0, 0, 0, 5)], kind)).first().total_output == 5.0
    got = stats.slot_mean(spark.createDataFrame([(64, 2), (192, 2)], "midpoint long, n long")).first()
    assert (got.mean, got.stddev, got.root_sum_squares) == (128.0, 64.0, 128.0)
    assert stats.slot_mean(spark.createDataFrame([], "midpoint long, n long")).count() == 0
    row = stats.size_throughput(spark.createDataFrame([(0, 0, 0), (1 << 21, 1 << 20, 500_000)], "input_bytes long, output_bytes long, micros long")).collect()
    assert row[0].ratio_pct is None and row[0].input_mb_s is None and (row[1].seconds, row[1].input_mb, row[1].ratio_pct, row[1].input_mb_s, row[1].output_mb_s) == (0.5, 2.0, 50.0, 4.0, 2.0)


def test_more_analysis(spark, tmp_path):
    names = spark.createDataFrame([("spar_1",), ("spar_4",), ("cuda_spar_original_0",), ("sequential_0",), ("x",)], "n string")
    assert [r[0] for r in names.select(analysis.better_name(F.col("n"))).collect()] == ["SPar (1 replica)", "SPar (4 replicas)", "CUDA SPar original", "Sequencial", ""]
    plans = spark.createDataFrame([("CPU_SEQUENTIAL", 0), ("CPU_SEQUENTIAL", 7), ("CPU_SEQUENTIAL", 8), ("GPU_CUDA", 1), ("GPU_CUDA", 2), ("CPU_SEQUENTIAL", 1)], "plan string, threads int")
    assert [r.threads for r in analysis.remapped(plans, "CPU_SEQUENTIAL").collect()] == [10, 80, 8, 1, 2, 20]
    assert [r[0] for r in plans.select(analysis.label(F.col("plan"), F.col("threads"))).collect()] == ["SPar(0 THREADS)", "SPar(7 THREADS)", "SPar(8 THREADS)", "CUDA(1 GPU)", "CUDA(2 GPUS)", "SPar(1 THREAD)"]
    runs = spark.createDataFrame([("d", "m", 1, 2.5), ("d", "m", 1, None)], "dataset string, mode string, threads int, total_time double")
    path = str(tmp_path / "runs")
    for _ in range(2):
        analysis.append_results(runs, path)
    got = spark.read.schema(analysis.RESULT).parquet(path)
    assert got.count() == 4 and got.select("id").distinct().count() == 4 and got.filter("current_date is null or current_time is null").count() == 0
    assert sorted(analysis.select_vector(spark, "SELECT total_time FROM {result} WHERE total_time IS NOT NULL", result=got).astype(float).tolist()) == [2.5, 2.5]
    assert np.isclose(analysis.throughputs(runs, spark.createDataFrame([("d", 5 << 20)], "dataset string, size_bytes long")).first().mb_s, 2000.0)
    lz = spark.createDataFrame([("p", 3.14159)], "plan string, total_time double")
    analysis.append_results(lz, str(tmp_path / "lz"), analysis.LZSS_RESULT)
    assert str(spark.read.parquet(str(tmp_path / "lz")).first().total_time) == "3.141590"


def test_sql_functions(spark, streams):
    sql.register(spark)
    streams.createOrReplaceTempView("streams")
    got = spark.sql("SELECT stream_id, content, decompress(compress(content, 'bzip2'), 'bzip2') AS back, compress(null, 'gzip') AS none FROM streams").collect()
    assert all(bytes(r.back) == bytes(r.content) and r.none is None for r in got)
    cut = spark.sql("SELECT stream_id, c.l2, c.offset, c.data FROM streams, LATERAL cdc_chunks(content, 0) c ORDER BY stream_id, l2").collect()
    want = [(r.stream_id, k, n) for r in streams.orderBy("stream_id").collect() for k, n in enumerate(chunk_lengths(bytes(r.content), 0))]
    assert [(r.stream_id, r.l2, len(r.data)) for r in cut] == want


def test_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "COMPACT", 2)
    src, want, seen = str(tmp_path / "in"), {}, {}
    for k in range(5):
        rows = [(10 * k + j, f"{(7 * k + 3 * j) % 9}ab") for j in range(6)]
        for i, fp in rows:
            seen.setdefault(fp, i)
            want[i] = (seen[fp], seen[fp] != i)
        spark.createDataFrame(rows, "id long, fp string").coalesce(1).write.mode("append").parquet(src)
        stream = streaming.source(spark, src, "id long, fp string", max_files=1)
        streaming.mark_stream(stream, ("id",), str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.id: (r.ref.id, r.is_duplicate) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want and (tmp_path / "store" / "before=4").exists()


def test_state_expires(spark, tmp_path):
    src = str(tmp_path / "in")
    kind = "id long, fp string"

    def run(expires):
        out = str(tmp_path / f"out{expires}")
        streaming.finish(streaming.mark_with_state(streaming.source(spark, src, kind), ("id",), expires), out, f"{out}-cp")
        return {r.id: (r.ref.id, r.is_duplicate) for r in spark.read.parquet(out).collect()}

    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], kind).coalesce(1).write.mode("append").parquet(src)
    assert run(None) == {1: (1, False), 2: (2, False), 3: (1, True)} == run(1)
    import time

    time.sleep(0.2)
    spark.createDataFrame([(4, "c")], kind).coalesce(1).write.mode("append").parquet(src)
    run(1)  # the expired ones leave
    spark.createDataFrame([(5, "a")], kind).coalesce(1).write.mode("append").parquet(src)
    assert run(None)[5] == (1, True) and run(1)[5] == (5, False)


def test_in_order(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    told = []
    for part in ([3, 0], [1, 5], [2], [7, 4], [6]):
        spark.createDataFrame([(p, f"v{p}") for p in part], "position long, v string").coalesce(1).write.mode("append").parquet(src)
        rows = streaming.source(spark, src, "position long, v string", max_files=1)
        streaming.emit_in_order(rows, "position", str(tmp_path / "wait"), out, str(tmp_path / "cp")).awaitTermination()
        told.append(sorted(r.position for r in spark.read.parquet(out).collect()))
    assert told == [[0], [0, 1], [0, 1, 2, 3], [0, 1, 2, 3, 4, 5], list(range(8))]


def test_tables(spark):
    t = tables.written(spark.range(5).toDF("x"), "five")
    assert t.count() == 5 and t.__dict__["_stored"].startswith(tables.folder(spark))
    tables.drop(t, None, spark.range(1))
    with pytest.raises(Exception, match="NOT_EXIST|NOT_FOUND|does not exist"):
        t.collect()


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(1, 4):
        (tmp_path / "in" / f"f{k}.txt").write_bytes(b"abc " * k * 50)
    told = files.code_files(spark, str(tmp_path / "in"), f"file://{tmp_path}/packed").first()
    assert told.input_mb == sum(200 * k for k in range(1, 4)) / (1 << 20) and 0 < told.ratio_pct < 100
    assert sorted(p.name for p in (tmp_path / "packed").iterdir()) == [f"f{k}.txt.lzss" for k in range(1, 4)]
    files.code_files(spark, str(tmp_path / "packed"), f"file://{tmp_path}/back", back=True)
    assert {p.name: p.read_bytes() for p in (tmp_path / "back").iterdir()} == {p.name: p.read_bytes() for p in (tmp_path / "in").iterdir()}


def test_benchmark(spark, streams, tmp_path):
    got = benchmark.run(spark, {"small": streams}, str(tmp_path / "runs"), codecs=("none",), repetitions=2)
    assert got.count() == 8 and got.filter("total_time <= 0").count() == 0
    stats_ = analysis.group_stats(got.withColumn("total_time", F.col("total_time").cast("double"))).collect()
    assert {(r.mode, r.n) for r in stats_} == {("window32", 4), ("window0", 4)}
