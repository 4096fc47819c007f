"""Files, binary logs and streams."""

import random
import struct
import time
import zlib
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from blockwright.operators import checks
from blockwright.plans import file_queries
from blockwright.sources import files, headed, sinks
from blockwright.streaming import ordered, runs


def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for b in data:
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def test_headers_and_telemetry(spark):
    good = struct.pack("<IBBBBIBBBBII", 0x314A4349, 5, 24, 1, 0, 4_000_000_000, 3, 2, 1, 1, 230_400, zlib.crc32(b"x"))
    rows = spark.createDataFrame([(bytearray(good),), (bytearray(good[:20]),), (bytearray(b"\0" * 24),), (None,)], "raw binary")
    got = files.decode_headers(rows).collect()
    assert (got[0].error, got[0].run_id, got[0].order_index, got[0].payload_len, got[0].crc32) == (None, 4_000_000_000, 3, 230_400, zlib.crc32(b"x"))
    assert [r.error for r in got[1:3]] == ["size", "magic"]
    body = struct.pack("<HBB6I2H", 0x544D, 1, 36, 1, 2, 3, 4, 5, 6, 4321, 3600)
    rows = spark.createDataFrame([(bytearray(body + struct.pack("<HH", crc16(body), 0)),), (bytearray(body + b"\0\0\0\0"),)], "raw binary")
    got = files.decode_telemetry(rows).collect()
    assert (got[0].error, got[0].psnr_x100, got[0].kernel_us) == (None, 4321, 6) and got[1].error == "check sum"
    assert spark.createDataFrame([(bytearray(b"123456789"),)], "b binary").select(F.crc32("b")).first()[0] == 3421780262


def test_images(spark, tmp_path):
    (tmp_path / "b.BMP").write_bytes(b"BM" + struct.pack("<IIIIiiHH", 0, 0, 54, 40, 2, 1, 1, 24) + b"\0" * 24 + bytes([3, 2, 1, 6, 5, 4, 0, 0]))
    (tmp_path / "a.ppm").write_bytes(b"P6\n# note\n1 2\n255\n" + bytes(range(6)))
    (tmp_path / "bad.ppm").write_bytes(b"P6 9 9 255\n12")
    assert [r.name for r in files.list_images(spark, str(tmp_path)).collect()] == ["b.BMP"]
    assert bytes(files.read_images(spark, str(tmp_path), "*.BMP").first().data) == bytes([1, 2, 3, 4, 5, 6])
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_images(spark, str(tmp_path), "*.ppm").collect()}
    assert bytes(got["a.ppm"].data) == bytes(range(6)) and got["bad.ppm"].data is None and got["bad.ppm"].error


def test_record_and_metric_files(spark, tmp_path):
    d = tmp_path / "run7"
    d.mkdir()
    (d / "run7_summary.csv").write_text(",".join(files.RECORD_CSV.names) + "\nframe_0007,rdct,0.5,N/A,0.9,1.5,10,20,,,,,,,,,,,OK,\n")
    (d / "run7_rdct.txt").write_text("---\nrun_id:  7\nt_total: 12: 5\nrun_id: 8\n")
    r = files.read_records(headed.read_headed(spark, str(tmp_path), "*_summary.csv")).first()
    assert (r.run, r.method, r.psnr, r.ssim, r.dct_kernel_us) == ("run7", "rdct", None, 0.9, None)
    assert {(r.name, r.value) for r in files.read_metrics(files.text_lines(spark, f"{tmp_path}/*/*.txt")).collect()} == {("run_id", "7"), ("t_total", "12: 5")}


def test_status_of_records(spark):
    """The first check that fails: check sum, mode, size, run lengths."""
    block = struct.pack("<h", -5) + bytes([3, 7, 0]) + bytes([0, 0, 0])
    full = struct.pack("<h", 9) + bytes([62, 1, 0])  # its last place is used, so no end follows
    cases = [
        (1, 230_400, 0, b"raw", "OK"), (1, 500, 0, b"raw", "RAW_SIZE_FAIL"), (2, 8, 0, block, "DECODED"), (2, 8, 1, block, "CRC_FAIL"), (3, 8, 0, block, "MODE_FAIL"), (2, 0, 0, block, "JPEG_SIZE_FAIL"), (2, 687_601, 0, block, "JPEG_SIZE_FAIL"),
        (2, 5, 0, full, "DECODED"), (2, 8, 0, full + bytes(3), "DECODE_FAIL"), (2, 5, 0, block[:5], "DECODE_FAIL"), (2, 7, 0, block[:7], "DECODE_FAIL"), (2, 11, 0, full[:2] + bytes([40, 1, 0, 40, 1, 0, 0, 0, 0]), "DECODE_FAIL"), (2, 2, 0, full[:2], "DECODE_FAIL"),
    ]
    rows = spark.createDataFrame([(m, n, zlib.crc32(p) + wrong, bytearray(p), want) for m, n, wrong, p, want in cases], "mode_type int, payload_len long, crc32 long, payload binary, want string")
    assert [(r.status, r.want) for r in checks.processed(rows).collect() if r.status != r.want] == []


def stream_of(spark, rows, columns, folder, batches):
    """Rows as a stream of so many files in their order, one a batch, and the end of the stream."""
    table = lambda part: spark.createDataFrame(part, columns).withColumn("ts", F.timestamp_seconds("ts"))
    size = -(-len(rows) // batches)
    for k in range(0, len(rows), size):
        table(rows[k : k + size]).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.02)  # files are taken by their times
    width = len(rows[0])
    table([(None, 4_000_000_000, *[None] * (width - 2))]).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(table(rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def given_out(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in stream.sparkSession.table(name).collect()], q.recentProgress


def test_expected_order_is_the_same_for_any_batches(spark, tmp_path):
    rng, columns = random.Random(2), "run_id long, ts long, ord long, order_index int"
    rows = [(k % 3, 1000 + (k * 7) % 120 + (5000 if k > 80 else 0), k, rng.choice([0, 0, 1, 1, 2, 3])) for k in range(120)]
    want, state = [], {}
    for run, ts, k, at in sorted(rows, key=lambda r: (r[1], r[2])):
        wanted, last = state.get(run, (0, ts))
        wanted = 0 if ts - last >= 600 else wanted
        want.append((run, k, at, wanted, at == wanted))
        state[run] = ((wanted + (at == wanted)) % 4, ts)
    for batches in (1, 4):
        stream = stream_of(spark, rows, columns, tmp_path / f"in{batches}", batches)
        got, progress = given_out(runs.in_order(stream, 600_000_000, slots=4), f"ordered{batches}")
        assert sorted(got) == sorted(want) and not ordered.dropped_rows(progress)
    assert sum(x[-1] for x in want) > 10 and max(x[3] for x in want) == 3


def test_runs_are_assembled_once_and_freed(spark, tmp_path):
    columns = "run_id long, ts long, ord long, slot int, part string, failed boolean"
    whole = [(1, 100 + k, k, k // 3, runs.PARTS[k % 3], k == 4) for k in range(9)]
    rows = whole + [(1, 105, 20, 1, "payload", True)] + [(2, 100, 30, 0, "header", False), (2, 130, 31, 2, "header", True), (2, 135, 32, 2, "header", True), (2, 300, 33, 1, "payload", False)] + [(3, 90, 40, 0, "header", False), (4, 100, 50, 7, "header", False)]
    stream = stream_of(spark, rows, columns, tmp_path / "in", 2)
    got, progress = given_out(runs.assemble(stream, 60_000_000, slots=3), "assembled")
    at = 1_000_000
    assert sorted(got) == [(1, 100 * at, 108 * at, 3, 3, 9, 1, False), (2, 100 * at, 135 * at, 2, 0, 2, 1, True)]  # single records are dropped
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    columns = "run_id long, ts long, ord long, order_index int"
    rows = [(1, 100_000, 0, 0), (1, 200_000, 1, 1), (1, 200_050, 2, 2), (1, 150_000, 3, 9), (1, 200_100, 4, 3)]  # the fourth comes after the watermark
    got, progress = given_out(runs.in_order(stream_of(spark, rows, columns, tmp_path / "in", 5)), "late")
    assert sorted(r[1] for r in got) == [0, 1, 2, 4] and all(r[-1] for r in got) and ordered.dropped_rows(progress) == 1
    stream = stream_of(spark, rows, columns, tmp_path / "in2", 5)
    got, progress = given_out(runs.finished(runs.stretches(stream.withWatermark("ts", "10 minutes"), "5 minutes")), "late_stretches")
    assert [(r[0], r[3], r[4]) for r in got] == [(1, 3, True)] and ordered.dropped_rows(progress) == 1


def test_statuses_of_other_runs_are_stale(spark, tmp_path):
    rng, columns = random.Random(3), "device long, ts long, ord long, run_id long"
    rows = [(k % 2, 1000 + k * 10, k, rng.choice([1, 2])) for k in range(200)]
    is_start = lambda r: r[2] % 5 == 0
    want, now = [], {}
    for r in rows:
        if is_start(r):
            now[r[0]] = r[3]
        elif now.get(r[0]) == r[3]:
            want.append((r[0], r[2], r[3]))
    starts, statuses = (stream_of(spark, [r for r in rows if is_start(r) == s], columns, tmp_path / str(s), n) for s, n in ((True, 1), (False, 3)))
    got, _ = given_out(runs.of_current_run(starts, statuses), "current")
    assert sorted(got) == sorted(want)


def test_sources_are_tried_in_turn(spark, tmp_path):
    some = spark.createDataFrame([(1,)], "a int")
    some.limit(0).write.parquet(f"{tmp_path}/empty")
    some.write.parquet(f"{tmp_path}/some")
    read = lambda n: lambda: spark.read.parquet(f"{tmp_path}/{n}")
    assert files.first_source(spark, {n: read(n) for n in ("none", "empty", "some")})[0] == "some"
    with pytest.raises(FileNotFoundError, match="none, empty"):
        files.first_source(spark, {n: read(n) for n in ("none", "empty")})


def test_missing_captures_are_an_error(spark):
    there = spark.createDataFrame([("a/run1_raw.bmp",), ("a/run1_ref.bmp",)], "file string")
    wanted = spark.createDataFrame([(1, "raw"), (1, "ref")], "run long, kind string")
    assert files.require_captures(there, wanted).count() == 2
    with pytest.raises(FileNotFoundError, match="2 raw"):
        files.require_captures(there, wanted.unionByName(spark.createDataFrame([(2, "raw")], wanted.schema)))


def test_union_has_columns_in_the_order_first_seen(spark, tmp_path):
    rows = sinks.write_union([spark.createDataFrame([(1, 2)], "b int, a int"), spark.createDataFrame([(3, 4)], "c int, a int")], str(tmp_path / "u"))
    assert rows.columns == ["b", "a", "c"]
    assert {p.read_text().split("\n")[0] for p in (tmp_path / "u").glob("*.csv")} == {"b,a,c"}


def test_a_lot_is_appended_once(spark, tmp_path):
    path, rows = str(tmp_path / "summary"), spark.createDataFrame([(1,), (2,)], "a int")
    assert sinks.read_summary(spark, path, "a int").count() == 0
    assert sinks.append_summary(rows, path, "first") and not sinks.append_summary(rows, path, "first")
    with ThreadPoolExecutor(4) as pool:  # of several writers of one lot one counts
        assert sum(pool.map(lambda _: sinks.append_summary(rows, path, "second"), range(4))) == 1
    rows.write.option("header", True).csv(f"{path}/rows/left-behind")  # by a writer that failed before its claim
    assert sorted(r.a for r in sinks.read_summary(spark, path, "a int").collect()) == [1, 1, 2, 2]


def test_run_ids_are_claimed_by_one_writer(spark, tmp_path):
    folder = str(tmp_path / "runs")
    assert sinks.claim_run_id(spark, folder, 7) == 7 and sinks.claim_run_id(spark, folder) == 8
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda k: sinks.claim_run_id(spark, folder, owner=f"w{k}"), range(12)))
    assert sorted(got) == list(range(9, 21))


def test_headers_of_their_own(spark, tmp_path):
    """Files of other columns, short rows, quotes, blank lines and empty files; large ones are read by several tasks."""
    (tmp_path / "a").mkdir()
    (tmp_path / "b=2").mkdir()
    (tmp_path / "a" / "x.csv").write_text('m,k\r\n1,"2,5"\r\n\r\n3\r\n')
    (tmp_path / "b=2" / "y.csv").write_text("k,m,z\n" + "".join(f"{i},é{i},\n" for i in range(5000)))
    (tmp_path / "a" / "empty.csv").write_text("")
    (tmp_path / "a" / "head.csv").write_text("m,k\n")
    (tmp_path / "a" / "_hidden.csv").write_text("m\n1\n")
    (tmp_path / "a" / "other.txt").write_text("m\n1\n")
    for most in (700, 128 << 20):
        rows = files.named(headed.read_headed(spark, str(tmp_path), maxPartitionBytes=most))
        assert (rows.rdd.getNumPartitions() > 50) == (most == 700)
        got = sorted((r.folder, r.m["m"], r.m["k"]) for r in rows.withColumn("folder", files.folder_of()).collect())
        assert got == sorted([("a", "1", "2,5"), ("a", "3", None), *[("2", f"é{i}", str(i)) for i in range(5000)]])


def test_folders_are_written_by_tasks(spark, tmp_path):
    """One file for each folder, rows in order, any text in names and cells; folders have the name that the pattern gave them."""
    rows = [(f, k, c) for f in ("a", "b=c", "x/y", "1%2", None) for k in (2, 1) for c in ('say "x", then y', "", None, "é")]
    table = spark.createDataFrame(rows, "folder string, k int, text string").repartition(3)
    sinks.write_folders(table, str(tmp_path / "t"), "folder", ["k"])
    made = sorted(p.relative_to(tmp_path / "t").parts for p in (tmp_path / "t").rglob("*") if p.is_file())
    assert [p[0] for p in made] == ["folder=1%252", "folder=__HIVE_DEFAULT_PARTITION__", "folder=a", "folder=b%3Dc", "folder=x%2Fy"] and all(len(p) == 2 for p in made)
    got = headed.read_headed(spark, str(tmp_path / "t")).orderBy("file", "line").collect()
    assert len(got) == len(rows) and {tuple(r.names) for r in got} == {("k", "text")} and [r.cells[0] for r in got[:8]] == ["1"] * 4 + ["2"] * 4
    assert {r.cells[1] for r in got} == {'say "x", then y', "", "é"}
    paths = ["/a/b=c/f.csv", "/a/b/f.csv", "b=c/f", "f", "/a/=c/f", "/a/b=/f", "/a=b/c=d=e/f", "/f"]
    old = F.regexp_extract("file", r"(?:[^/=]+=)?([^/]+)/[^/]+$", 1)
    assert [r.file for r in spark.createDataFrame([(p,) for p in paths], "file string").where(~files.folder_of().eqNullSafe(old)).collect()] == []
    assert "regexp" not in str(spark.range(1).selectExpr("'x' AS file").select(files.folder_of())._jdf.queryExecution().analyzed())


def test_check_sums_by_batch(spark):
    rng = random.Random(4)
    raws = [rng.randbytes(n) for n in (0, 5, 31, 32, 33, 60)] + [None]
    t = spark.createDataFrame([(k, None if r is None else bytearray(r)) for k, r in enumerate(raws)], "k int, raw binary").coalesce(1)
    got = dict(map(tuple, t.select("k", files.crc16(F.col("raw"), 32)).collect()))
    assert got == {k: crc16(r[:32]) if r is not None and len(r) >= 32 else None for k, r in enumerate(raws)}
    plan = files.decode_telemetry(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan


def test_reports_are_made_behind_the_shuffle(spark):
    plan = file_queries.report_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "timestamp:" not in plan[plan.index("Aggregate") :] and "timestamp:" in plan


def test_waiting_rows_are_read_in_pieces():
    """A key with many rows: what a task holds at once is an hour of each batch, and the order is that of all rows."""
    from pyspark.sql.types import Row, StructType

    class Store(dict):
        read = 0

        def updateValue(self, k, v):
            self[k] = v

        def getValue(self, k):
            self.read += 1
            return self[k]

        def removeKey(self, k):
            del self[k]

    class Handle:
        def getMapState(self, *_):
            return Store()

        getValueState = getMapState

        def registerTimer(self, at):
            timers.append(at)

    rng, timers, hour = random.Random(6), [], ordered.PIECE_US
    made = ordered.InOrder(StructType.fromDDL("ts_us long, ord long, name string"))
    made.init(Handle())
    rows = [(rng.randrange(48 * hour), k, f"r{k}") for k in range(100_000)]
    rng.shuffle(rows)
    for part in (rows[:90_000], rows[90_000:90_100], rows[90_100:]):
        list(made.handleInputRows((1,), (Row(ts_us=t, name=n, key=1, ord=o) for t, o, n in part), None))
    assert min(timers) == min(r[0] for r in rows) // 1000 + 1
    got, most = [], 10 * hour
    for r in made.ready(most):
        got.append(tuple(r))
        if len(got) == 1:
            assert made.waiting.read <= 4  # of some 130 pieces
    assert got == sorted(r for r in rows if r[0] <= most)
    timers.clear()
    assert [tuple(r) for r in made.ready(100 * hour)] == sorted(r for r in rows if r[0] > most) and not made.waiting and not timers
