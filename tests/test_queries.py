"""Each query with SQL against DuckDB on a small part of the tables; kernels without SQL against NumPy."""

import datetime
import decimal
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwright.functions import scalars
from blockwright.operators import analytics, codec, selection, strips
from blockwright.operators import frames as images
from blockwright.plans import block_queries, file_queries, record_queries
from blockwright.plans.dims import zigzag

SOURCE = "/root/testdata/sf0.001"
TABLES = {"embeddings": "SELECT * FROM src ORDER BY vec_id LIMIT 40", "events": "SELECT * FROM src ORDER BY event_id LIMIT 900", "lineitem": "SELECT * FROM src LIMIT 400", "orders": "SELECT * FROM src", "pages": "SELECT * FROM src"}
QUERIES, SQL = record_queries.QUERIES | block_queries.QUERIES | file_queries.QUERIES, record_queries.SQL | block_queries.SQL | file_queries.SQL


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    con = duckdb.connect()
    for t, q in TABLES.items():
        con.execute(f"COPY ({q.replace('src', chr(39) + SOURCE + '/' + t + '.parquet' + chr(39))}) TO '{d}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return str(d), con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, small, name):
    d, con = small
    df = QUERIES[name](spark, d)
    r = con.sql(SQL[name])
    assert table(df.columns, df.collect()) == table(r.columns, r.fetchall())


def test_fixed_decimals_round_as_the_sql_does(spark, tmp_path):
    """A ratio of 7.03125 lies in the middle; 0.00015 and 2.675 only look so."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT * REPLACE (event_id + 31700 AS event_id) FROM '{SOURCE}/events.parquet' WHERE event_id < 100")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df, r = QUERIES["k14_record_report"](spark, str(tmp_path)), con.sql(SQL["k14_record_report"])
    assert table(df.columns, df.collect()) == table(r.columns, r.fetchall())
    values = [7.03125, 0.00015, 2.675, 1e-9, 123456789.5, 0.5, -0.00025]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(*[scalars.decimals(F.col("v"), n) for n in (2, 3, 4)]).collect()
    assert [tuple(r) for r in got] == [tuple(f"{v:.{n}f}" for n in (2, 3, 4)) for v in values]


def blocks_of(spark, x):
    return spark.createDataFrame([(i, [int(v) for v in b]) for i, b in enumerate(x)], "i int, b array<int>")


def edge_blocks():
    rng = np.random.default_rng(0)
    x = rng.integers(-128, 128, (20, 64))
    x[0] = 0
    x[1] = [(37 * i + 19) % 255 - 128 for i in range(64)]
    x[2, 1:] = 0
    return x


def test_j7_inverse_is_exact(spark):
    x = edge_blocks()
    df = blocks_of(spark, x).withColumn("c", codec.forward(F.col("b"), "silveira_j7")).withColumn("d", codec.inverse(F.col("c"), "silveira_j7"))
    assert all(list(r.d) == list(r.b) for r in df.collect())


def test_j7_impulse_is_the_outer_product(spark):
    b = np.zeros((1, 64), int)
    b[0, 0] = 1
    row = [2, 2, 2, 1, 2, 2, 0, 0]
    got = blocks_of(spark, b).select(codec.forward(F.col("b"), "silveira_j7").alias("c")).first().c
    assert list(got) == [p * q for p in row for q in row]


def cosine_sums(line, back):
    """The transform by its definition: sums of cosines in 64 bits, not rounded."""
    k, n = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    m = np.cos((2 * n + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return (m.T if back else m) @ np.asarray(line, float)


@pytest.mark.parametrize("back", [False, True])
def test_butterfly_lines_are_rounded_cosine_sums(back):
    """Each pass is the definition, rounded; 32-bit sums may only fall to the other side where a sum is as good as half a number off."""
    x = np.random.default_rng(5).integers(-1024, 1024, (4000, 8))
    got = (codec.butterfly_inverse_line if back else codec.butterfly_line)(x)
    exact = np.array([cosine_sums(v, back) for v in x])
    assert np.abs(got - exact).max() < 0.5 + 1e-3
    flat = codec.butterfly_line(np.full((1, 8), 100))
    assert flat.tolist() == [[283, 0, 0, 0, 0, 0, 0, 0]]  # 100 times the square root of 8
    assert codec.butterfly_inverse_line(np.array([[283, 0, 0, 0, 0, 0, 0, 0]])).tolist() == [[100] * 8]


def scalar_matrix(line, back):
    m, out = codec.cosine_basis(), []
    for k in range(8):
        total = np.float32(0)
        for n in range(8):
            total += np.float32(line[n]) * (m[n][k] if back else m[k][n])
        out.append(int(math.copysign(math.floor(abs(float(total)) + 0.5), total)))
    return out


def butterfly(line, back):
    return (codec.butterfly_inverse_line if back else codec.butterfly_line)(np.array([line]))[0]


@pytest.mark.parametrize("method, line", [("matrix", scalar_matrix), ("loeffler", butterfly)])
def test_float_kernels_are_lines_both_ways(spark, method, line):
    def both(block, back):
        b = np.array(block).reshape(8, 8)
        for rows in (not back, back):
            b = np.array([line(v, back) for v in (b if rows else b.T)])
            b = b if rows else b.T
        return b.ravel().tolist()

    x = edge_blocks()
    there = codec.float_kernel(blocks_of(spark, x), method, "b")
    want = [both(b, False) for b in x]
    assert [list(r.b) for r in there.orderBy("i").collect()] == want
    back = [list(r.b) for r in codec.float_kernel(there, method, "b", True).orderBy("i").collect()]
    assert back == [both(b, True) for b in want]
    assert np.abs(np.array(back) - x).max() <= 3


def test_any_line_transform_can_be_registered(spark):
    codec.register_kernel("twice", lambda x: 2 * x, lambda x: x // 2)
    try:
        there = codec.float_kernel(blocks_of(spark, edge_blocks()), "twice", "b")
        assert [list(r.b) for r in there.orderBy("i").collect()] == (4 * edge_blocks()).tolist()
        assert [list(r.b) for r in codec.float_kernel(there, "twice", "b", True).orderBy("i").collect()] == edge_blocks().tolist()
    finally:
        del codec.KERNELS["twice"]


def pattern(w, h):
    return [(w, h, y, x, (13 * x + 7 * y) & 255, (3 * x + 17 * y + 40) & 255, (19 * x + 5 * y + 90) & 255) for y in range(h) for x in range(w)]


@pytest.mark.parametrize("subsampling", ["444", "422", "420"])
def test_identity_job_gives_the_image_back(spark, subsampling):
    """23 by 17 pixels: what chroma loses is what its means lose; luma blocks cover whole units."""
    f = strips.from_rasters(spark.createDataFrame([(1, 23, 17, raster(23, 17))], "i int, w int, h int, data binary"), ["i"])
    levels = strips.compress(f, ["i"], "identity", 1.0, subsampling)
    count = {r.plane: r["count"] for r in strips.level_blocks(levels, ["i"], subsampling).groupBy("plane").count().collect()}
    luma = {"444": 9, "422": 12, "420": 16}[subsampling]
    chroma = {"444": 9, "422": 6, "420": 4}[subsampling]
    assert count == {"y": luma, "cb": chroma, "cr": chroma}
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in strips.long(strips.decompress(levels, ["i"], "identity", 1.0, subsampling), ["i"]).collect()}
    want = {(y, x): c for _, _, y, x, *c in pattern(23, 17)}
    assert set(got) == set(want)
    if subsampling == "444":
        assert max(abs(a - b) for p in want for a, b in zip(got[p], want[p])) <= 3
    gray = strips.blocks(f, ["i"], channel=lambda r, g, b: r - 128)
    assert {(r.y, r.x): r.v for r in images.to_gray(gray, ["i", "w", "h"]).collect()} == {p: c[0] for p, c in want.items()}
    alike = strips.level_blocks(strips.compress(f, ["i"], "rdct", 0.5, gray=True), ["i"])
    assert {r.plane for r in alike.select("plane").distinct().collect()} == {"y"}


def raster(w, h):
    return bytes(v for *_, r, g, b in pattern(w, h) for v in (r, g, b))


def no_exchange(df):
    return "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_strips_are_cut_and_joined_without_an_exchange(spark):
    f = strips.from_rasters(spark.createDataFrame([(1, 23, 40, raster(23, 40))], "i int, w int, h int, data binary"), ["i"])
    there = strips.compress(f, ["i"], "rdct", 0.5, "420")
    assert no_exchange(strips.blocks(f, ["i"], "420")) and no_exchange(strips.decompress(there, ["i"], "rdct", 0.5, "420"))
    one = strips.round_trips(f, ["i"], [("rdct", 2, 0.5)], "420")
    assert no_exchange(one)
    assert {(r.top, bytes(r.data)) for r in strips.decompress(there, ["i"], "rdct", 0.5, "420").collect()} == {(r.top, bytes(r.other)) for r in one.collect()}


def test_windows_reach_over_strips(spark):
    """PSNR and SSIM of an image in three strips against whole arrays; a mask leaves out windows and pixels; a small image has no window."""
    w, h = 19, 37
    a = np.frombuffer(raster(w, h), np.uint8).reshape(h, w, 3).astype(float)
    rows = spark.createDataFrame([(1, w, h, raster(w, h)), (2, 6, 20, raster(6, 20))], "i int, w int, h int, data binary")
    both = strips.round_trips(strips.from_rasters(rows, ["i"]), ["i"], [("matrix", 3, 0.8)])
    b = np.concatenate([np.frombuffer(r.other, np.uint8) for r in both.where("i = 1").orderBy("top").collect()]).reshape(h, w, 3).astype(float)
    got = {r.i: r for r in strips.distortion(both, ["i"]).collect()}
    values = []
    for c in range(3):
        win = [(a[y : y + 7, x : x + 7, c].ravel(), b[y : y + 7, x : x + 7, c].ravel()) for y in range(h - 6) for x in range(w - 6)]
        values.append(np.mean([(2 * p.mean() * q.mean() + 6.5025) * (2 * np.cov(p, q)[0, 1] + 58.5225) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (p.var(ddof=1) + q.var(ddof=1) + 58.5225)) for p, q in win]))
    assert math.isclose(got[1].ssim, np.mean(values), rel_tol=1e-9) and math.isclose(got[1].ssim_g, values[1], rel_tol=1e-9)
    assert got[1].sse == int(((a - b) ** 2).sum()) and math.isclose(got[1].psnr, 10 * math.log10(65025 / ((a - b) ** 2).mean()))
    assert got[2].ssim == 1.0 and got[2].sse > 0
    assert strips.box_sums(both.where("i = 1"), ["i"]).count() == 3 * (h - 6) * (w - 6)
    mask = bytes([1] * (16 * w - 1) + [0])
    masked = both.where("i = 1").withColumn("mask", F.when(F.col("top") == 0, F.lit(mask)))
    assert strips.box_sums(masked.withColumn("mask", F.coalesce("mask", F.lit(bytes([1] * 16 * w)))), ["i"]).count() == 3 * ((h - 6) * (w - 6) - 7)


def test_records_meet_the_raw_raster_of_their_run(spark):
    rows = spark.createDataFrame([(r, 16, 20, raster(16, 20)) for r in (1, 2)], "run int, w int, h int, data binary")
    f = strips.from_rasters(rows, ["run"])
    records = strips.round_trips(f, ["run"], [("rdct", 0, 0.1), ("identity", 9, 1.0)]).drop("data").withColumnRenamed("other", "data")
    got = {(r.run, r.method): r for r in strips.against_raw(records, f.where("run = 1"), "run", ["method", "k_idx"]).collect()}
    assert len(got) == 4 and {r.status for k, r in got.items() if k[0] == 2} == {"REF_MISSING"} and got[2, "rdct"].psnr is None and got[2, "rdct"].stream_bytes == got[1, "rdct"].stream_bytes
    assert got[1, "rdct"].raw_bytes == 960 and math.isclose(got[1, "rdct"].ratio, 960 / got[1, "rdct"].stream_bytes) and got[1, "rdct"].psnr < got[1, "identity"].psnr


def test_parameter_errors(spark):
    good = (1, 8, 8, 2, 0, 0, 0.5)
    rows = [(good, 0), ((None, *good[1:]), -1), ((1, 0, *good[2:]), -2), ((1, 8, 8, 6, 0, 0, 0.5), -4), ((1, 8, 8, 2, 2, 0, 0.5), -5), ((1, 8, 8, 2, 1, 3, 0.5), -8), ((1, 8, 8, 2, 0, 0, 0.0), -9), ((1, 8, 8, 2, 0, 0, 32.5), -9), ((1, 8, 8, 2, 0, 0, float("nan")), -9), ((1, 8, 8, 2, 0, 0, None), -9)]
    df = spark.createDataFrame([(*r, e) for r, e in rows], "image int, w int, h int, m int, c int, s int, k double, want int")
    assert all(r.want == r.got for r in df.withColumn("got", images.parameter_error(*map(F.col, ("image", "w", "h", "m", "c", "s", "k")))).collect())


def test_a_missing_reference_is_told(spark):
    records = spark.createDataFrame([(1, 100, "OK"), (2, 100, "OK"), (2, 0, "CRC_FAIL")], "run_id long, stream_bytes long, status string")
    got = analytics.with_reference(records, spark.createDataFrame([(2, 500)], "run_id long, raw_bytes long")).orderBy("run_id", "stream_bytes").collect()
    assert [(r.ratio, r.status) for r in got] == [(0.0, "REF_MISSING"), (0.0, "CRC_FAIL"), (5.0, "OK")]


def test_numbers_go_on_over_spans(spark):
    got = analytics.numbered(spark.range(0, 3000, 3).repartition(5), "id", spans=7).collect()
    assert sorted((r.place, r.id) for r in got) == [(k + 1, 3 * k) for k in range(1000)]


def test_reciprocal_quantizer_is_no_division(spark):
    got = blocks_of(spark, np.full((1, 64), 2)).select(codec.quantize(F.col("b"), [3] * 64).alias("q"), codec.quantize_by_division(F.col("b"), [3] * 64).alias("d")).first()
    assert set(got.q) == {0} and set(got.d) == {1}


def test_tables_round_k():
    assert codec.scaled_k(0.2) == 205 and codec.quant_table("matrix", 0.2)[0] == 16 * 205 >> 10


def test_zigzag_and_tokens_round_trip(spark):
    x = np.zeros((4, 64), int)
    x[1, 63], x[2, 0], x[3, [0, 5, 20]] = 9, 4, [1, -2, 3]
    df = blocks_of(spark, x).select("i", codec.scan(F.col("b")).alias("z"))
    tokens = codec.tokens(df, ["i"])
    back = {r.i: list(r.z) for r in codec.from_tokens(tokens, ["i"]).collect()}
    assert back == {i: [int(x[i, p]) for p in zigzag()] for i in range(4)}
    size = {r.i: r.n for r in tokens.groupBy("i").agg(F.sum(F.when(F.col("kind") == "DC", 2).otherwise(3)).alias("n")).collect()}
    assert size == {r.i: r.n for r in df.select("i", codec.rle_bytes(F.col("z")).alias("n")).collect()}


def test_missing_end_gives_null(spark):
    rows = spark.createDataFrame([(1, 0, 0, 5, "DC"), (1, 1, 70, 2, "AC"), (1, 2, 0, 0, "EOB"), (2, 0, 0, 5, "DC")], "i int, seq int, zero_run int, value int, kind string")
    assert all(r.z is None for r in codec.from_tokens(rows, ["i"]).collect())


def test_sweep_has_all_cases(spark):
    s = codec.sweep(blocks_of(spark, edge_blocks()[:3]), [(0, 0.1), (3, 0.8)])
    assert {(r.method, r.k_idx) for r in s.collect()} == {(m, k) for m in ("loeffler", "matrix", "rdct", "silveira_j3", "silveira_j7") for k in (0, 3)}


def test_medians_are_exact_for_any_parts(spark):
    rng = np.random.default_rng(7)
    rows = [(int(k), float(v)) for k in range(4) for v in rng.integers(-50, 50, 301 + k)] + [(9, 1e300), (9, -1e300), (8, None), (7, 5.0)] + [(6, 1.0)] * 500 + [(6, 2.0)] * 500 + [(None, 3.0)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(3)
    want = {k: (float(np.median(vs)) if (vs := [v for i, v in rows if i == k and v is not None]) else None) for k in {k for k, _ in rows}}
    for parts in (1, 13):
        assert {r.k: r.m for r in selection.median(df, ["k"], "v", "m", parts).collect()} == want
    assert selection.median(df.limit(0), ["k"], "v", "m").collect() == []


def test_tokens_back_without_maps(spark):
    """Blocks from tokens: runs, a missing end, a run past the block and one that is far past it."""
    cases = {1: [(0, 5, "DC"), (62, -3, "AC")], 2: [(0, 5, "DC"), (3, 7, "AC"), (0, 0, "EOB")], 3: [(0, 5, "DC")], 4: [(0, 5, "DC"), (63, 1, "AC")], 5: [(0, 5, "DC"), (2_000_000_000, 1, "AC")]}
    rows = [(k, i, *t) for k, ts in cases.items() for i, t in enumerate(ts)]
    got = codec.from_tokens(spark.createDataFrame(rows, "k int, seq int, zero_run int, value int, kind string"), ["k"])
    assert dict(map(tuple, got.collect())) == {1: [5] + [0] * 62 + [-3], 2: [5, 0, 0, 0, 7] + [0] * 59, 3: None, 4: None, 5: None}
    assert "map_concat" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_steps_on_strips_share_a_worker(spark):
    """From vectors to pixels or levels and back a task has one Python worker, not one for each step."""
    for name in ("t8_blocks_to_rgb", "t33_compress_matrix_444", "t34_decompress_rdct_420", "t1_luma_blocks"):
        plan = block_queries.QUERIES[name](spark, SOURCE)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1, name


def test_strips_are_made_once_and_compared_once(spark):
    """What makes the records isn't run again for their sizes, their rows below and their distortion: one step makes them, one the rasters, one compares."""
    for name, steps in (("j1_raster_reference", 3), ("a3_windowed_ssim", 2), ("w1_box_sums", 2), ("x4_image_round_trip", 2)):
        plan = QUERIES[name](spark, SOURCE)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == steps, name


@pytest.mark.parametrize("subsampling", ["444", "422", "420"])
def test_strips_of_all_sizes_in_one_lot(spark, subsampling):
    """Strips side by side are what each is alone: pixels by decompress, bytes by the run lengths of its blocks; one is wider than a lot."""
    sizes = [(1, 1), (8, 8), (23, 17), (9, 40), (31, 5), (4200, 3), (16, 25)]
    rows = [(i, w, h, raster(w, h)) for i, (w, h) in enumerate(sizes)]
    f = strips.from_rasters(spark.createDataFrame(rows, "i int, w int, h int, data binary").coalesce(1), ["i"])
    f = f.withColumn("mask", F.when(F.col("i") == 2, F.expr("cast(concat(repeat('\\u0001', length(data) div 3 - 5), repeat('\\u0000', 5)) AS binary)")))
    got = strips.round_trips(f, ["i"], [("loeffler", 1, 0.2), ("identity", 9, 1.0), ("silveira_j7", 3, 0.8)], subsampling).collect()
    for method, k in (("loeffler", 0.2), ("identity", 1.0), ("silveira_j7", 0.8)):
        there = strips.compress(f, ["i"], method, k, subsampling)
        pixels = {(r.i, r.top): bytes(r.data) for r in strips.decompress(there, ["i"], method, k, subsampling).collect()}
        assert {(r.i, r.top): bytes(r.other) for r in got if r.method == method} == pixels
        b = strips.level_blocks(there, ["i"], subsampling).groupBy("i").agg(F.sum(codec.rle_bytes(codec.scan(F.col("q")))).alias("n"))
        total = {i: sum(r.stream_bytes for r in got if (r.i, r.method) == (i, method)) for i in range(len(sizes))}
        assert {r.i: r.n for r in b.collect()} == total


def test_parts_of_a_raster(spark):
    """A raw raster without its lower strip is compared where it is; a mask of the lower strip alone holds for windows from above; a null k_idx is a key."""
    w, h = 9, 20
    f = strips.from_rasters(spark.createDataFrame([(1, w, h, raster(w, h))], "run int, w int, h int, data binary"), ["run"])
    records = strips.round_trips(f, ["run"], [("rdct", 0, 0.1)]).drop("data").withColumnRenamed("other", "data").withColumn("k_idx", F.lit(None).cast("int"))
    whole, part = (strips.against_raw(records, raw, "run", ["method", "k_idx"]).first() for raw in (f, f.where("top = 0")))
    assert whole.raw_bytes == 3 * w * h and part.raw_bytes == 3 * w * 16 and part.stream_bytes == whole.stream_bytes
    both = strips.round_trips(f, ["run"], [("rdct", 0, 0.1)])
    alone = strips.distortion(both.where("top = 0").withColumn("h", F.lit(16)), ["run"]).first()
    assert math.isclose(part.psnr, alone.psnr) and math.isclose(part.ssim, alone.ssim) and whole.psnr and whole.ssim != part.ssim
    masked = both.withColumn("mask", F.when(F.col("top") == 16, F.lit(bytes([0] * 4 * w))))
    got = strips.distortion(masked, ["run"]).first()
    assert got.sse == alone.sse and math.isclose(got.ssim, alone.ssim)
