"""Queries over experiment records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockwright.functions import scalars as S
from blockwright.operators import analytics as A
from blockwright.operators import checks
from blockwright.operators import quality as Q
from blockwright.operators import reports, selection
from blockwright.plans.dims import K_VALUES, METHOD_NAMES, grid, kfactors, methods
from blockwright.sources import files, sinks
from blockwright.sources.records import BLOCK_CALLS, FULL_SQL, HEIGHT, RAW_BYTES, RECORDS_SQL, WIDTH, full_records, records

QUERIES: dict = {}
SQL: dict[str, str] = {}
METRICS = ["psnr", "ssim", "bpp", "compress_us"]


def query(name: str, sql: str | None, base: str | None = RECORDS_SQL):
    def put(f):
        QUERIES[name] = f
        if not sql:
            return f
        more = sql.startswith(", ") or not base
        SQL[name] = f"WITH {base}{sql}" if base and more else f"WITH {base} {sql}" if base else sql
        return f

    return put


def each(items, text: str) -> str:
    return ", ".join(text.format(x) for x in items)


MEANS_SQL = f"means AS (SELECT method, k_idx, {each(METRICS, 'avg({0}) AS {0}')} FROM records GROUP BY ALL)"


def means(spark, d):
    return A.group_means(records(spark, d), METRICS)


@query("a11_group_stats", "SELECT method, k_idx, count(*) AS n, " + each(METRICS, "avg({0}) AS {0}_mean, CASE WHEN count({0}) > 0 THEN coalesce(stddev_samp({0}), 0.0) END AS {0}_std, min({0}) AS {0}_min, max({0}) AS {0}_max") + " FROM records GROUP BY method, k_idx")
def _(spark, d):
    return A.group_stats(A.in_grid(records(spark, d), grid(spark)), METRICS)


@query("a10_group_means", f", {MEANS_SQL} SELECT * FROM means".lstrip(", "), None)
def _(spark, d):
    return means(spark, d)


SQL["a10_group_means"] = f"WITH {RECORDS_SQL}, {MEANS_SQL} SELECT * FROM means"


@query("a15_two_level_mean", "SELECT method, coalesce(avg(m), 0.0) AS psnr FROM (SELECT method, k_idx, avg(psnr) AS m FROM records GROUP BY ALL) GROUP BY method")
def _(spark, d):
    return A.two_level_mean(records(spark, d), "psnr")


@query("a16_kernel_split", "SELECT method, avg(dct_kernel_us) AS kernel, greatest(0.0, avg(compress_us) - avg(dct_kernel_us)) AS other FROM records GROUP BY method")
def _(spark, d):
    return A.kernel_split(records(spark, d), "compress_us", "dct_kernel_us")


@query("a17_median_time", "SELECT method, k_idx, median(compress_us) AS median_us FROM records GROUP BY ALL")
def _(spark, d):
    return selection.median(records(spark, d), ["method", "k_idx"], "compress_us", "median_us")


@query("a20_means_on_grid", f", {MEANS_SQL} SELECT g.method, g.k_idx, g.method_ord, g.k, g.k_label, {each(METRICS, 'm.{0}')} FROM grid g LEFT JOIN means m ON m.method = g.method AND m.k_idx = g.k_idx")
def _(spark, d):
    return A.complete(means(spark, d), grid(spark))


@query("a21_records_per_run", "SELECT run_id, count(*) AS records FROM records GROUP BY run_id")
def _(spark, d):
    return records(spark, d).groupBy("run_id").agg(F.count("*").alias("records"))


@query("a22_saturating_totals", "SELECT run_id, least(sum(dct_kernel_us), 4294967295)::BIGINT AS kernel_us, least(sum(dct_kernel_calls), 4294967295)::BIGINT AS calls, least(sum(dct_kernel_calls), 65535)::BIGINT AS wire_calls FROM records GROUP BY run_id")
def _(spark, d):
    """Totals of a run; 32 bits hold them, and 16 bits the calls on the wire."""
    us, calls = F.sum("dct_kernel_us"), F.sum("dct_kernel_calls")
    return records(spark, d).groupBy("run_id").agg(*[F.least(v, F.lit(most)).alias(n) for n, v, most in (("kernel_us", us, 2**32 - 1), ("calls", calls, 2**32 - 1), ("wire_calls", calls, 2**16 - 1))])


@query("a23_means_by_k", f"SELECT k, {each(METRICS, 'avg({0}) AS {0}')} FROM records GROUP BY k")
def _(spark, d):
    return A.group_means(records(spark, d), METRICS, ("k",))


@query("a25_psnr_against_time", "SELECT method, k_idx, avg(psnr) AS psnr, avg(compress_us + decompress_us) / 1000 AS ms FROM records GROUP BY ALL")
def _(spark, d):
    return records(spark, d).groupBy("method", "k_idx").agg(F.avg("psnr").alias("psnr"), (F.avg(F.col("compress_us") + F.col("decompress_us")) / 1000).alias("ms"))


LINES_SQL = "li AS (SELECT l_orderkey AS run_id, l_linenumber % 5 AS method_ord, (l_partkey % 4)::INTEGER AS k_idx, l_extendedprice AS compress_us, l_extendedprice * l_tax AS tx_us, l_suppkey, 1000 + l_suppkey AS stream_bytes, 'OK' AS status FROM lineitem)"


def lines(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") % 5).alias("method_ord"), (F.col("l_partkey") % 4).cast("int").alias("k_idx"), F.col("l_extendedprice").alias("compress_us"), (F.col("l_extendedprice") * F.col("l_tax")).alias("tx_us"), "l_suppkey", (1000 + F.col("l_suppkey")).alias("stream_bytes"), F.lit("OK").alias("status"))


@query("j1_reference_join", "SELECT l.run_id, l_suppkey, method_ord, k_idx, o_totalprice AS raw_bytes, raw_tx_us, CASE WHEN o_totalprice > 0 AND stream_bytes > 0 THEN o_totalprice / stream_bytes ELSE 0.0 END AS ratio, CASE WHEN o_totalprice IS NULL THEN 'REF_MISSING' ELSE status END AS status FROM li l LEFT JOIN (SELECT *, o_totalprice * 2 AS raw_tx_us FROM orders) o ON o_orderkey = l.run_id", LINES_SQL)
def _(spark, d):
    raw = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("raw_bytes"), (F.col("o_totalprice") * 2).alias("raw_tx_us"))
    return A.with_reference(lines(spark, d), raw).select("run_id", "l_suppkey", "method_ord", "k_idx", "raw_bytes", "raw_tx_us", "ratio", "status")


@query("j3_matrix_delta", "SELECT ord, psnr, matrix, abs(psnr - matrix) AS delta FROM (SELECT *, avg(CASE WHEN method = 'matrix' THEN psnr END) OVER (PARTITION BY run_id, k_idx) AS matrix FROM records)")
def _(spark, d):
    return A.matrix_delta(records(spark, d)).select("ord", "psnr", "matrix", "delta")


@query("j5_gain", f", {MEANS_SQL} SELECT k_idx, {each(('psnr', 'ssim', 'bpp'), chr(109) + 'ax(CASE WHEN method = ' + chr(39) + 'silveira_j7' + chr(39) + ' THEN {0} END) - max(CASE WHEN method = ' + chr(39) + 'rdct' + chr(39) + ' THEN {0} END) AS gain_{0}')} FROM means GROUP BY k_idx")
def _(spark, d):
    return A.gain(means(spark, d), ["psnr", "ssim", "bpp"])


@query("j6_snapshot", f", {MEANS_SQL} SELECT k_idx, {', '.join(f'''max(CASE WHEN method = '{m}' THEN {x} END) AS {m}_{x}''' for m in METHOD_NAMES for x in ('psnr', 'ssim', 'bpp'))} FROM means GROUP BY k_idx")
def _(spark, d):
    return means(spark, d).groupBy("k_idx").pivot("method", METHOD_NAMES).agg(*[F.max(x).alias(x) for x in ("psnr", "ssim", "bpp")])


@query("j8_full_grid", "SELECT g.method, g.k_idx, count(r.ord) AS n FROM grid g LEFT JOIN records r ON r.method = g.method AND r.k_idx = g.k_idx GROUP BY ALL")
def _(spark, d):
    n = records(spark, d).groupBy("method", "k_idx").agg(F.count("*").alias("n"))
    return A.complete(n, grid(spark)).select("method", "k_idx", F.coalesce("n", F.lit(0)).alias("n"))


@query("j9_study_records", "SELECT ord, method, k_idx FROM records WHERE k_idx IN (0, 1) AND method <> 'matrix'")
def _(spark, d):
    return A.in_grid(records(spark, d), grid(spark).where("k_idx < 2 AND method <> 'matrix'")).select("ord", "method", "k_idx")


@query("j10_bpp_by_run", "SELECT run_id, " + ", ".join(f"max(CASE WHEN method = '{m}' AND k_idx = {k} THEN b END) AS {m}_{k}" for m in METHOD_NAMES for k in range(4)) + " FROM (SELECT run_id, method, k_idx, arg_max(bpp, ord) AS b FROM records GROUP BY ALL) GROUP BY run_id")
def _(spark, d):
    last = A.last_per_key(records(spark, d).select("run_id", "method", "k_idx", "ord", "bpp"), ["run_id", "method", "k_idx"], "ord")
    cells = [f"{m}_{k}" for m in METHOD_NAMES for k in range(4)]
    return last.withColumn("cell", F.concat_ws("_", "method", "k_idx")).groupBy("run_id").pivot("cell", cells).agg(F.max("bpp"))


def fixed(c: str, decimals: int, scale: int = 1):
    """A number with fixed decimals; a missing one is an empty cell."""
    v = F.col(c) if scale == 1 else F.col(c) / scale
    return F.coalesce(F.when(v.isNotNull(), F.format_string(f"%.{decimals}f", v.cast("double"))), F.lit("")).alias(c.replace("_us", "_ms"))


def fixed_text_sql(x: str, decimals: int) -> str:
    """Fixed decimals of the shortest digits of a number, halves away from zero."""
    return f"coalesce(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {decimals})::DECIMAL(38, {decimals})::VARCHAR, '')"


def fixed_sql(c: str, decimals: int, scale: int = 1) -> str:
    return f"{fixed_text_sql(c + (f' / {scale}' if scale > 1 else ''), decimals)} AS {c.replace('_us', '_ms')}"


FIXED = [("psnr", 8), ("ssim", 8), ("bpp", 8), ("compress_us", 6, 1000), ("decompress_us", 6, 1000)]
IMAGE_SQL = "'frame_' || lpad(run_id::VARCHAR, 4, '0')"
#: Bytes of the codec for a frame of 320 by 240 in 4:4:4.
MEMORY = 104 + 256 * 3 * 1200


def image_name():
    return F.concat(F.lit("frame_"), F.lpad(F.col("run_id").cast("string"), 4, "0"))


@query("k2_fixed_decimals", f"SELECT ord, {IMAGE_SQL} AS image, method, k, {', '.join(fixed_sql(*f) for f in FIXED)}, {MEMORY} AS memory_bytes, {fixed_text_sql('abs(psnr - matrix)', 8)} AS delta_psnr_vs_matrix FROM (SELECT *, avg(CASE WHEN method = 'matrix' THEN psnr END) OVER (PARTITION BY run_id, k_idx) AS matrix FROM records)")
def _(spark, d):
    """The table of single images: every metric with its decimals, memory, and the distance to the matrix method."""
    r = A.matrix_delta(records(spark, d)).withColumnRenamed("delta", "delta_psnr_vs_matrix")
    memory = Q.codec_memory(F.lit(WIDTH), F.lit(HEIGHT), F.lit("444"), F.lit(False))
    return r.select("ord", image_name().alias("image"), "method", "k", *[fixed(*f) for f in FIXED], memory.cast("int").alias("memory_bytes"), fixed("delta_psnr_vs_matrix", 8))


@query("k3_summary", f"SELECT g.method, g.k, {', '.join(fixed_sql(*f) for f in FIXED)}, {MEMORY} AS memory_bytes FROM grid g LEFT JOIN (SELECT method, k_idx, {each([f[0] for f in FIXED], 'avg({0}) AS {0}')} FROM records GROUP BY ALL) m ON m.method = g.method AND m.k_idx = g.k_idx")
def _(spark, d):
    """Twenty rows in the order of methods and k."""
    m = A.complete(A.group_means(records(spark, d), [f[0] for f in FIXED]), grid(spark)).orderBy("method_ord", "k_idx")
    memory = Q.codec_memory(F.lit(WIDTH), F.lit(HEIGHT), F.lit("444"), F.lit(False))
    return m.select("method", "k", *[fixed(*f) for f in FIXED], F.round(memory).cast("int").alias("memory_bytes"))


EXPORTED = ["psnr", "ssim", "bpp", "compress_us", "decompress_us"]


@query("k4_long_export", f", li AS (SELECT ['loeffler', 'matrix', 'rdct', 'silveira_j3', 'silveira_j7'][l_linenumber % 5 + 1] AS method, (l_partkey % 4)::INTEGER AS k_idx, l_extendedprice AS us FROM lineitem), p AS (SELECT 0 AS place, 'python' AS platform, method, k_idx, {each(EXPORTED, 'avg({0}) AS {0}')} FROM records GROUP BY ALL UNION ALL SELECT 1, 'c', method, k_idx, NULL, NULL, NULL, avg(us), NULL FROM li GROUP BY ALL) SELECT n.place, n.platform, g.method, g.k_label, {each(EXPORTED, '{0}')} FROM grid g, (VALUES (0, 'python'), (1, 'c')) n(place, platform) LEFT JOIN p ON p.place = n.place AND p.method = g.method AND p.k_idx = g.k_idx")
def _(spark, d):
    """Every platform, method and k has a row; a platform that doesn't measure something leaves it empty. Events are one platform, line items the other."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.element_at(F.array(*map(F.lit, METHOD_NAMES)), (F.col("l_linenumber") % 5 + 1).cast("int")).alias("method"), (F.col("l_partkey") % 4).cast("int").alias("k_idx"), F.col("l_extendedprice").alias("compress_us"))
    none = [F.lit(None).cast("double").alias(c) for c in EXPORTED if c != "compress_us"]
    sides = [("python", A.group_means(records(spark, d), EXPORTED)), ("c", A.group_means(li, ["compress_us"]).select("method", "k_idx", "compress_us", *none))]
    parts = [A.complete(m, grid(spark)).select(F.lit(i).alias("place"), F.lit(n).alias("platform"), "method", "k_label", *EXPORTED) for i, (n, m) in enumerate(sides)]
    return parts[0].unionByName(parts[1])


@query("k5_wide_export", f", {MEANS_SQL} SELECT k_idx, {', '.join(f'''max(CASE WHEN method = '{m}' THEN psnr END) AS {m}''' for m in METHOD_NAMES)} FROM means GROUP BY k_idx")
def _(spark, d):
    return A.wide(means(spark, d), "k_idx", "method", "psnr", METHOD_NAMES)


@query("k7_bar_export", f", {MEANS_SQL} SELECT method, {', '.join(f'''max(CASE WHEN k_idx = {i} THEN compress_us END) AS k{str(k).replace('.', 'p')}''' for i, k in enumerate(K_VALUES))} FROM means GROUP BY method")
def _(spark, d):
    columns = ["k" + str(k).replace(".", "p") for k in K_VALUES]
    m = means(spark, d).withColumn("c", F.element_at(F.array(*map(F.lit, columns)), F.col("k_idx") + 1))
    return A.wide(m, "method", "c", "compress_us", columns)


EMBEDDED = ["psnr", "ssim", "bpp", "compress_ms", "decompress_ms", "dct_kernel_ms", "idct_kernel_ms", "dct_kernel_calls", "idct_kernel_calls", "tx_ms", "total_core_ms", "compression_ratio"]


@query("k9_scene_export", f"SELECT ord, {IMAGE_SQL} AS scene, method, k_label AS k, psnr, ssim, bpp, {each(('compress', 'decompress', 'dct_kernel', 'idct_kernel', 'tx'), '{0}_us / 1000 AS {0}_ms')}, dct_kernel_calls, idct_kernel_calls, core_us / 1000 AS total_core_ms, 230400 / stream_bytes AS compression_ratio FROM fr WHERE status = 'OK'", FULL_SQL)
def _(spark, d):
    """Records of good status with every metric of a scene."""
    r = full_records(spark, d).where("status = 'OK'").withColumn("total_core_us", reports.core_time())
    r = r.withColumns({c: F.col(c.replace("_ms", "_us")) / 1000 for c in EMBEDDED if c.endswith("_ms")}).withColumn("compression_ratio", S.ratio(F.lit(RAW_BYTES), F.col("stream_bytes")))
    return r.select("ord", image_name().alias("scene"), "method", F.col("k_label").alias("k"), *EMBEDDED)


@query("k10_transmission", "SELECT ord, run_id AS run, method, k, bpp, CASE WHEN frame_bytes > 0 THEN frame_bytes ELSE stream_bytes + 24 END AS frame_bytes, CASE WHEN raw_bytes > 0 THEN raw_bytes WHEN mode = 'RAW' THEN stream_bytes ELSE 0 END AS raw_bytes, 230400 / stream_bytes AS compression_ratio, tx_us / 1000 AS tx_ms, CASE WHEN tx_raw_us > 0 THEN tx_raw_us WHEN mode = 'RAW' THEN tx_us ELSE 0 END / 1000 AS tx_raw_ms FROM fr", FULL_SQL)
def _(spark, d):
    """What each record sends, and what its raw frame would."""
    c, raw = F.col, F.col("mode") == "RAW"
    frame = F.when(c("frame_bytes") > 0, c("frame_bytes")).otherwise(c("stream_bytes") + reports.HEADER_BYTES)
    raw_bytes = F.when(c("raw_bytes") > 0, c("raw_bytes")).when(raw, c("stream_bytes")).otherwise(0)
    tx_raw = F.when(c("tx_raw_us") > 0, c("tx_raw_us")).when(raw, c("tx_us")).otherwise(0)
    return full_records(spark, d).select("ord", c("run_id").alias("run"), "method", "k", "bpp", frame.alias("frame_bytes"), raw_bytes.alias("raw_bytes"), S.ratio(F.lit(RAW_BYTES), c("stream_bytes")).alias("compression_ratio"), (c("tx_us") / 1000).alias("tx_ms"), (tx_raw / 1000).alias("tx_raw_ms"))


ONLY = "CASE WHEN mode = '{0}' THEN {1} ELSE 0 END"
SUMMARY_SQL = {
    "image": "'frame_' || lpad(run_id::VARCHAR, 4, '0')", "method": "method_name", "k": "k_label", "psnr": "CASE WHEN psnr >= 0 THEN format('{:.6f}', psnr) ELSE 'N/A' END", "ssim": "CASE WHEN ssim >= 0 THEN format('{:.6f}', ssim) ELSE 'N/A' END", "bpp": "format('{:.6f}', bpp)",
    **{c: ONLY.format("JPEG", c) for c in ("compress_us", "decompress_us", "dct_kernel_us", "idct_kernel_us", "dct_kernel_calls", "idct_kernel_calls", "tx_us")},
    "frame_bytes": "CASE WHEN frame_bytes > 0 THEN frame_bytes ELSE stream_bytes + 24 END", "tx_raw_us": "CASE WHEN tx_raw_us > 0 THEN tx_raw_us WHEN mode = 'RAW' THEN tx_us ELSE 0 END", "raw_bytes": "CASE WHEN raw_bytes > 0 THEN raw_bytes WHEN mode = 'RAW' THEN stream_bytes ELSE 0 END",
    "compression_ratio": "format('{:.6f}', 230400 / stream_bytes)", "sha256_input_first8": "coalesce(fingerprint, 'N/A')", "status": "status", "status_detalhado": "translate(coalesce(nullif(notes, ''), status), ',', ' ')",
}


@query("k12_summary_rows", "SELECT ord, " + ", ".join(f"{v} AS {k}" for k, v in SUMMARY_SQL.items()) + " FROM fr", FULL_SQL)
def _(spark, d):
    return reports.summary_rows(full_records(spark, d), "ord")


REPORT_SQL = {
    "run_id": "run_id", "timestamp": "'boot+' || (capture_us * 1000 // 1000000) || '.' || lpad(((capture_us * 1000 % 1000000) // 1000)::VARCHAR, 3, '0') || ' s'", "mode_type": "mode", "method": "method_name", "record_type": "mode || '_FRAME'", "order_index": "slot", "seq_num": "seq_num", "width": "320", "height": "240", "colorspace": "0", "subsampling": "subsampling", "k": "k_label",
    "stream_bytes": "stream_bytes", "bpp": "format('{:.4f}', bpp)", "compression_ratio_vs_raw": "format('{:.4f}', 230400 / stream_bytes)", "psnr_db": "CASE WHEN psnr >= 0 THEN format('{:.3f}', psnr) ELSE 'N/A' END", "ssim": "CASE WHEN ssim >= 0 THEN format('{:.4f}', ssim) ELSE 'N/A' END", "sha256_input_first8": "coalesce(fingerprint, 'N/A')",
    "t_capture_us": "capture_us", "t_rgb565_to_rgb888_us": "convert_us", "t_raw_pack_us": ONLY.format("RAW", "prepare_us"), "t_compress_us": ONLY.format("JPEG", "compress_us"), "t_cam_decompress_us": ONLY.format("JPEG", "cam_decompress_us"), "t_frame_encode_us": ONLY.format("JPEG", "prepare_us"),
    "t_spi_rx_us": "tx_us", "t_raw_unpack_us": "unpack_us", "t_frame_decode_us": "frame_decode_us", "t_decompress_us": "decompress_us", "t_dct_kernel_us": "dct_kernel_us", "t_idct_kernel_us": "idct_kernel_us", "dct_kernel_calls": "dct_kernel_calls", "idct_kernel_calls": "idct_kernel_calls", "t_metrics_us": "metrics_us",
    "t_sd_save_us": "lpad(save_us::VARCHAR, 10, '0')", "t_tft_draw_us": "draw_us", "t_total_core_us": "core_us", "crc_ok": "(status <> 'CRC_FAIL')::INTEGER", "retry_count": "retry_count", "status": "status", "notes": "notes",
}


def report_sql() -> str:
    # How wide a name stands in the report, where it isn't 22.
    width = {"compression_ratio_vs_raw": 26, "t_spi_rx_us": 21}
    return " || chr(10) || ".join("'---'" if n == "-" else f"'{(n + ':').ljust(width.get(n, 22))}' || ({REPORT_SQL[n]})" for n in reports.REPORT)


@query("k14_record_report", f"SELECT ord, {report_sql()} AS report FROM fr", FULL_SQL)
def _(spark, d):
    return full_records(spark, d).select("ord", reports.record_report().alias("report"))


@query("k15_run_report", "SELECT run_id, text, row_number() OVER (PARTITION BY run_id ORDER BY part, slot, ord)::INTEGER AS line FROM (SELECT run_id, 1 AS part, slot, ord, '- ' || method_name || ' k=' || k_label || ' (' || mode || '): bytes=' || stream_bytes || ' bpp=' || format('{:.4f}', bpp) || ' psnr=' || CASE WHEN psnr >= 0 THEN format('{:.3f}', psnr) ELSE 'N/A' END || ' core_us=' || core_us || ' dct_us=' || dct_kernel_us || ' idct_us=' || idct_kernel_us || ' status=' || status || ' crc_ok=' || (status <> 'CRC_FAIL')::INTEGER AS text FROM fr UNION ALL SELECT DISTINCT run_id, 0, i, 0, ['run_id: ' || run_id, 'reference_method: RAW', 'records_expected: 21', 'records:'][i + 1] FROM fr, range(4) r(i))", FULL_SQL)
def _(spark, d):
    t = reports.run_lines(full_records(spark, d))
    return t.select("run_id", "text", F.row_number().over(Window.partitionBy("run_id").orderBy("line")).alias("line"))


@query("k16_three_sections", "SELECT 0 AS place, 'image' AS section, run_id::VARCHAR AS name, avg(psnr) AS psnr FROM records GROUP BY run_id UNION ALL SELECT 1, 'method', method, avg(psnr) FROM records GROUP BY method UNION ALL SELECT 2, 'snapshot', k::VARCHAR, avg(psnr) FROM records GROUP BY k")
def _(spark, d):
    """Three titled tables in one text, one after the other, written and read again."""
    r, path = records(spark, d), sinks.scratch(spark)
    mean = lambda c: r.groupBy(F.col(c).cast("string").alias("name")).agg(F.avg("psnr").alias("psnr"))
    sinks.write_sections([("image", mean("run_id")), ("method", mean("method")), ("snapshot", mean("k"))], path)
    return sinks.read_sections(spark, path, "name string, psnr double")


@query("k18_next_run_id", "SELECT max(run_id) + 1 AS next_run_id FROM records")
def _(spark, d):
    """The id after the largest one, claimed so that no other writer gets it."""
    largest = records(spark, d).agg(F.max("run_id")).first()[0]
    run = sinks.claim_run_id(spark, f"{sinks.scratch(spark)}/runs", largest + 1)
    return spark.createDataFrame([(run,)], "next_run_id bigint")


@query("k19_usable_results", f"SELECT ord, {IMAGE_SQL} AS filename, {WIDTH} AS width, {HEIGHT} AS height, {fixed_text_sql('psnr', 2)} AS psnr, {fixed_text_sql('ssim', 4)} AS ssim, {fixed_text_sql('bpp', 3)} AS bitrate FROM records WHERE psnr >= 0")
def _(spark, d):
    """The batch table: images that failed, with a negative PSNR or none, are left out."""
    return A.usable(records(spark, d)).select("ord", image_name().alias("filename"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), fixed("psnr", 2), fixed("ssim", 4), fixed("bpp", 3).alias("bitrate"))


@query("f6_bpp", "SELECT ord, stream_bytes * 8.0 / 76800 AS bpp_stream FROM records")
def _(spark, d):
    return records(spark, d).select("ord", S.bpp(F.col("stream_bytes"), F.lit(WIDTH), F.lit(HEIGHT)).alias("bpp_stream"))


@query("f7_ratio", "SELECT ord, CASE WHEN ord % 5 = 0 THEN 0.0 ELSE 230400 / stream_bytes END AS ratio FROM records")
def _(spark, d):
    return records(spark, d).select("ord", S.ratio(F.lit(RAW_BYTES), F.when(F.col("ord") % 5 == 0, 0).otherwise(F.col("stream_bytes"))).alias("ratio"))


@query("f8_method_ids", "SELECT ord, CASE WHEN id = 0 THEN 'raw' ELSE m.method END AS name, coalesce(id BETWEEN 1 AND 5, false) AS is_jpeg, coalesce(m.method_ord, -1) AS method_index FROM (SELECT ord, ord % 8 AS id FROM records) r LEFT JOIN methods m ON m.wire_id = r.id")
def _(spark, d):
    """Ids 0 (raw), 1 to 5, and some that are no method."""
    return A.method_facts(records(spark, d).select("ord", (F.col("ord") % 8).alias("id")), "id").select("ord", "name", "is_jpeg", "method_index")


@query("f9_slots", "SELECT ord, 1 + 5 * r.k_idx + method_ord AS slot, (5 * r.k_idx + method_ord) % 5 AS method_back, (5 * r.k_idx + method_ord) // 5 AS k_back FROM records r JOIN methods m ON m.method = r.method")
def _(spark, d):
    r = records(spark, d).withColumn("slot", A.slot(A.method_place("method"), F.col("k_idx")))
    return r.select("ord", "slot", F.pmod(F.col("slot") - 1, F.lit(5)).alias("method_back"), F.floor((F.col("slot") - 1) / 5).cast("int").alias("k_back"))


@query("f10_k_factors", "SELECT ord, f.k_label, f.k_fixed8 FROM records r JOIN kfactors f ON f.k_idx = r.k_idx")
def _(spark, d):
    return records(spark, d).join(F.broadcast(kfactors(spark).drop("k")), "k_idx").select("ord", "k_label", "k_fixed8")


@query("f11_k_text", "SELECT ord, regexp_replace(regexp_replace(format('{:.6f}', value / 4), '0+$', ''), '\\.$', '') AS k_text, 'k' || replace(regexp_replace(regexp_replace(format('{:.6f}', value / 4), '0+$', ''), '\\.$', ''), '.', 'p') AS token FROM records")
def _(spark, d):
    t = S.k_text(F.col("value") / 4)
    return records(spark, d).select("ord", t.alias("k_text"), F.concat(F.lit("k"), F.translate(t, ".", "p")).alias("token"))


@query("f12_parse_number", "SELECT ord, TRY_CAST(CASE ord % 3 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE value::VARCHAR END AS DOUBLE) / 1000 AS ms FROM records")
def _(spark, d):
    t = F.when(F.col("ord") % 3 == 0, "N/A").when(F.col("ord") % 3 == 1, "").otherwise(F.col("value").cast("string"))
    return records(spark, d).select("ord", S.number(t, 1000.0).alias("ms"))


@query("f15_first8_digest", "SELECT ord, substr(sha256(substr(status || method, 1, 8)), 1, 16) AS fingerprint FROM records")
def _(spark, d):
    return records(spark, d).select("ord", F.substring(F.sha2(F.substring(F.concat("status", "method"), 1, 8), 256), 1, 16).alias("fingerprint"))


@query("f16_core_time", "SELECT ord, CASE WHEN mode = 'RAW' THEN prepare_us + tx_us + unpack_us ELSE compress_us + prepare_us + tx_us + frame_decode_us + decompress_us END AS core_us FROM records")
def _(spark, d):
    return records(spark, d).select("ord", reports.core_time().alias("core_us"))


@query("f17_core_fallback", "SELECT ord, coalesce(CASE WHEN ord % 2 = 0 THEN tx_us / 1000 END, (compress_us + decompress_us + CASE WHEN ord % 7 <> 0 THEN tx_us END) / 1000) AS core_ms FROM records")
def _(spark, d):
    c = F.col
    return records(spark, d).select("ord", F.coalesce(F.when(c("ord") % 2 == 0, c("tx_us") / 1000), (c("compress_us") + c("decompress_us") + F.when(c("ord") % 7 != 0, c("tx_us"))) / 1000).alias("core_ms"))


@query("f19_reported_psnr", "SELECT ord, psnr, coalesce(psnr, -1.0) AS psnr_or_minus_one FROM (SELECT ord, coalesce(nullif(ord % 40 * 100, 0) / 100, psnr) AS psnr FROM records)")
def _(spark, d):
    """The reported PSNR (in hundredths, 0 is none) before a computed one; where there is neither, -1 stands in files."""
    p = S.reported_psnr(F.col("ord") % 40 * 100, F.col("psnr"))
    return records(spark, d).select("ord", p.alias("psnr"), F.coalesce(p, F.lit(-1.0)).alias("psnr_or_minus_one"))


@query("f20_half_up", "SELECT ord, round(CAST(CAST(value / 8 AS VARCHAR) AS DECIMAL(38, 18)), 2)::DOUBLE AS rounded FROM records")
def _(spark, d):
    return records(spark, d).select("ord", S.half_up(F.col("value") / 8).cast("double").alias("rounded"))


@query("f21_or_na", "SELECT ord, CASE WHEN psnr IS NULL THEN 'N/A' ELSE format('{:.3f}', psnr) END AS text FROM records")
def _(spark, d):
    return records(spark, d).select("ord", S.or_na(F.col("psnr"), 3).alias("text"))


@query("f22_csv_field", "SELECT event_id AS ord, translate(event_type || ',' || props || chr(10), ',' || chr(13) || chr(10), '   ') AS field FROM events", None)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("ord"), S.csv_field(F.concat("event_type", F.lit(","), "props", F.lit("\n"))).alias("field"))


@query("f23_notes", "SELECT ord, left(concat_ws('; ', CASE WHEN status <> 'OK' THEN status END, CASE WHEN psnr IS NULL THEN 'no psnr' END, method), 127) AS notes FROM records")
def _(spark, d):
    return records(spark, d).select("ord", F.left(F.concat_ws("; ", F.when(F.col("status") != "OK", F.col("status")), F.when(F.col("psnr").isNull(), F.lit("no psnr")), "method"), F.lit(127)).alias("notes"))


@query("f24_quality", "SELECT ord, CASE WHEN psnr > 40 THEN 'Excellent' WHEN psnr > 30 THEN 'Good' WHEN psnr > 20 THEN 'Fair' ELSE 'Poor' END AS label FROM records")
def _(spark, d):
    return records(spark, d).select("ord", S.quality(F.col("psnr"), (40, 30, 20)).alias("label"))


@query("f25_quality_by_table", "SELECT ord, label FROM records JOIN (VALUES (40.0, 1e9, 'Excellent'), (35.0, 40.0, 'Good'), (30.0, 35.0, 'Fair'), (-1e9, 30.0, 'Poor')) t(lo, hi, label) ON psnr > lo AND psnr <= hi")
def _(spark, d):
    cuts = spark.createDataFrame([(40.0, 1e9, "Excellent"), (35.0, 40.0, "Good"), (30.0, 35.0, "Fair"), (-1e9, 30.0, "Poor")], "lo double, hi double, label string")
    return records(spark, d).join(F.broadcast(cuts), (F.col("psnr") > F.col("lo")) & (F.col("psnr") <= F.col("hi"))).select("ord", "label")


@query("f26_exposure_gate", "SELECT ord, (value * 10) BETWEEN 20 AND 215 AS exposed FROM records")
def _(spark, d):
    return records(spark, d).select("ord", (F.col("value") * 10).between(20, 215).alias("exposed"))


@query("f27_codec_memory", "SELECT ord, s, keep, greatest(104 + 256 * (CASE s WHEN '444' THEN l WHEN 'gray' THEN l WHEN '422' THEN 2 * c ELSE 4 * c END + CASE s WHEN 'gray' THEN 0 WHEN '444' THEN 2 * l ELSE 2 * c END) * (1 + keep), 24 + w * h * CASE s WHEN 'gray' THEN 1 ELSE 3 END)::BIGINT AS memory FROM (SELECT *, ((w + 7) // 8) * ((h + 7) // 8) AS l, CASE s WHEN '422' THEN ((w + 15) // 16) * ((h + 7) // 8) ELSE ((w + 15) // 16) * ((h + 15) // 16) END AS c FROM (SELECT ord, 8 + ord % 120 AS w, 5 + ord % 77 AS h, s, keep FROM records, (VALUES ('444'), ('422'), ('420'), ('gray')) a(s), (VALUES (0), (1)) b(keep)))")
def _(spark, d):
    r = records(spark, d).select("ord", (8 + F.col("ord") % 120).alias("w"), (5 + F.col("ord") % 77).alias("h"), F.explode(F.array(*map(F.lit, ("444", "422", "420", "gray")))).alias("s")).withColumn("keep", F.explode(F.array(F.lit(0), F.lit(1))))
    return r.select("ord", "s", "keep", Q.codec_memory(F.col("w"), F.col("h"), F.col("s"), F.col("keep") == 1).alias("memory"))


@query("f29_uptime", "SELECT ord, 'boot+' || (tx_us * 1000 // 1000000) || '.' || lpad(((tx_us * 1000 % 1000000) // 1000)::VARCHAR, 3, '0') || ' s' AS stamp FROM records")
def _(spark, d):
    return records(spark, d).select("ord", S.uptime(F.col("tx_us") * 1000).alias("stamp"))


@query("f30_multiplications", "SELECT r.method, m.multiplications, count(*) * m.multiplications AS total FROM records r JOIN methods m ON m.method = r.method GROUP BY r.method, m.multiplications")
def _(spark, d):
    return records(spark, d).groupBy("method").count().join(F.broadcast(methods(spark)), "method").select("method", "multiplications", (F.col("count") * F.col("multiplications")).alias("total"))


@query("f31_valid_timings", "SELECT ord, " + ", ".join(f"{ONLY.format(m, c)} AS {n}" for n, m, c in (("t_raw_pack_us", "RAW", "prepare_us"), ("t_compress_us", "JPEG", "compress_us"), ("t_cam_decompress_us", "JPEG", "cam_decompress_us"), ("t_frame_encode_us", "JPEG", "prepare_us"))) + " FROM records")
def _(spark, d):
    return records(spark, d).select("ord", *[c.alias(n) for n, c in reports.valid_timings().items()])


HEADS = {
    "method_id": "l_linenumber - 1", "record_type": "CASE WHEN l_partkey % 19 = 0 THEN 3 WHEN l_linenumber = 1 OR l_partkey % 41 = 0 THEN 1 ELSE 2 END", "mode_type": "CASE WHEN (l_linenumber = 1) <> (l_suppkey % 9 = 0) THEN 1 ELSE 2 END", "k_idx": "CASE WHEN l_partkey % 10 = 0 THEN 4 ELSE l_partkey % 4 END",
    "colorspace": "CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END", "subsampling": "CASE WHEN l_linenumber = 1 THEN 255 WHEN l_partkey % 11 = 0 THEN 2 ELSE 0 END", "width": "CASE WHEN l_quantity >= 49 THEN 160 ELSE 320 END", "height": "CASE WHEN l_quantity <= 1 THEN 120 ELSE 240 END", "order_index": "CAST(floor(l_quantity / 2) AS INT)", "expected": "CASE WHEN l_suppkey % 13 = 0 THEN 0 ELSE 21 END",
}
REJECTS = """CASE WHEN NOT (method_id = 0 OR (k_idx < 4 AND method_id BETWEEN 1 AND 5)) THEN 'method or k' WHEN record_type = 1 AND mode_type <> 1 THEN 'mode of a raw record' WHEN record_type = 1 AND (method_id <> 0 OR subsampling <> 255) THEN 'method or subsampling of a raw record' WHEN record_type = 2 AND (mode_type <> 2 OR method_id NOT BETWEEN 1 AND 5) THEN 'method or mode'
  WHEN record_type = 2 AND k_idx >= 4 THEN 'k' WHEN record_type = 2 AND (colorspace <> 0 OR subsampling <> 0) THEN 'not RGB 4:4:4' WHEN record_type NOT IN (1, 2) THEN 'record type' WHEN colorspace <> 0 THEN 'colour space' WHEN expected = 0 OR expected > 21 THEN 'records expected' WHEN width <> 320 OR height <> 240 THEN 'size' WHEN order_index >= expected THEN 'order' WHEN again THEN 'duplicate' END"""


@query("f32_reject_reason", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {REJECTS} AS reason FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, method_id, CASE WHEN method_id = 0 THEN 0 ELSE k_idx END ORDER BY l_linenumber, l_partkey, l_suppkey) > 1 AS again FROM (SELECT *, {', '.join(f'{v.replace('CAST(floor(l_quantity / 2) AS INT)', 'floor(l_quantity / 2)::INTEGER')} AS {k}' for k, v in HEADS.items())} FROM lineitem))", None)
def _(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("*", *[F.expr(v).alias(k) for k, v in HEADS.items()])
    slot = Window.partitionBy("l_orderkey", "method_id", F.when(F.col("method_id") == 0, 0).otherwise(F.col("k_idx"))).orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = li.withColumn("again", F.row_number().over(slot) > 1)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", A.reject_reason().alias("reason"))


@query("f33_payload_rules", "SELECT ord, CASE WHEN mode = 'RAW' AND bytes <> 230400 THEN 'RAW_SIZE_FAIL' WHEN mode <> 'RAW' AND (bytes <= 0 OR bytes > 687600) THEN 'JPEG_SIZE_FAIL' ELSE 'OK' END AS status FROM (SELECT ord, mode, CASE WHEN mode = 'RAW' AND ord % 4 > 0 THEN 230400 ELSE stream_bytes * 20 END AS bytes FROM records)")
def _(spark, d):
    raw = F.col("mode") == "RAW"
    size = F.when(raw & (F.col("ord") % 4 > 0), RAW_BYTES).otherwise(F.col("stream_bytes") * 20)
    return records(spark, d).select("ord", F.coalesce(checks.size_status(raw, size), F.lit("OK")).alias("status"))


@query("w3_brightness_settled", "f AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ord) - 1 AS frame, value FROM records), s AS (SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY run_id ORDER BY frame)) <= 4, false) AS calm FROM f WHERE frame < 25), i AS (SELECT *, sum((NOT calm)::INTEGER) OVER (PARTITION BY run_id ORDER BY frame) AS island FROM s), t AS (SELECT *, sum(calm::INTEGER) OVER (PARTITION BY run_id, island ORDER BY frame) AS streak FROM i) SELECT run_id, coalesce(min(CASE WHEN streak >= 3 THEN frame END), max(frame))::INTEGER AS frame FROM t GROUP BY run_id", RECORDS_SQL + ",")
def _(spark, d):
    f = records(spark, d).withColumn("frame", F.row_number().over(Window.partitionBy("run_id").orderBy("ord")) - 1)
    return A.settled(f.select("run_id", "frame", "value"), "value", 4, 3, 25)


@query("w4_order_in_run", "SELECT ord, (row_number() OVER (PARTITION BY run_id ORDER BY (mode <> 'RAW')::INTEGER, k_idx, method_ord, ord) - 1)::INTEGER AS raw_first, (row_number() OVER (PARTITION BY run_id ORDER BY (mode = 'RAW')::INTEGER, k_idx, method_ord, ord) - 1)::INTEGER AS raw_last FROM (SELECT r.*, method_ord FROM records r JOIN methods m ON m.method = r.method)")
def _(spark, d):
    r = A.order_in_run(records(spark, d), "raw_first", raw_first=True)
    return A.order_in_run(r, "raw_last", raw_first=False).select("ord", "raw_first", "raw_last")


@query("w5_method_order", "SELECT DISTINCT method_name AS method, CASE WHEN method_name = 'raw' THEN 999 ELSE (SELECT method_ord FROM methods m WHERE m.method = method_name) END AS place FROM fr", FULL_SQL)
def _(spark, d):
    """Methods of the study in its order; raw is none of them and comes after."""
    m = full_records(spark, d).select(F.col("method_name").alias("method")).distinct()
    return m.select("method", A.method_place("method").alias("place")).orderBy("place", "method")


@query("w6_by_k_and_method", "SELECT r.ord, k_idx, method_ord, dense_rank() OVER (ORDER BY k_idx, method_ord) AS place FROM records r JOIN methods m ON m.method = r.method")
def _(spark, d):
    """Records sorted by k, then method; place is that of the pair among all pairs that occur."""
    r = records(spark, d).select("ord", "k_idx", A.method_place("method").alias("method_ord"))
    pairs = r.select("k_idx", "method_ord").distinct().withColumn("place", F.row_number().over(Window.orderBy("k_idx", "method_ord")))  # at most 20 rows
    return r.join(F.broadcast(pairs), ["k_idx", "method_ord"]).orderBy("k_idx", "method_ord", "ord").select("ord", "k_idx", "method_ord", "place")


@query("w7_last_wins", "SELECT run_id, method, k_idx, max(ord) AS ord, arg_max(bpp, ord) AS bpp FROM records GROUP BY ALL")
def _(spark, d):
    return A.last_per_key(records(spark, d).select("run_id", "method", "k_idx", "ord", "bpp"), ["run_id", "method", "k_idx"], "ord")


@query("w8_shown_and_more", "SELECT run_id, ord, CASE WHEN n = 21 THEN '+' || (total - 20) || ' more' ELSE method || ' ' || status END AS text FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ord) AS n, count(*) OVER (PARTITION BY run_id) AS total FROM records) WHERE n <= 21")
def _(spark, d):
    """Twenty lines of each run, and how many there are beyond."""
    return A.shown(records(spark, d), "run_id", "ord", F.concat_ws(" ", "method", "status"), 20)


@query("w9_rotated_cases", "SELECT run_id, k_idx, method, method_turn::INTEGER AS method_turn, k_turn::INTEGER AS k_turn, (4 * method_turn + k_turn)::INTEGER AS place FROM (SELECT *, ((k_idx - run_id - method_turn) % 4 + 4) % 4 AS k_turn FROM (SELECT run_id, r.k_idx, r.method, ((method_ord - run_id) % 5 + 5) % 5 AS method_turn FROM (SELECT DISTINCT run_id, method, k_idx FROM records) r JOIN methods m ON m.method = r.method))")
def _(spark, d):
    """The order of an image's cases: methods begin with another one for each image, and k with another one for each image and place of the method."""
    return A.rotated(records(spark, d).select("run_id", "k_idx", "method").distinct(), "run_id")


@query("u1_desktop_table", ", li AS (SELECT ['loeffler', 'matrix', 'rdct', 'silveira_j3', 'silveira_j7'][l_linenumber % 5 + 1] AS method, l_extendedprice AS us FROM lineitem) SELECT 0 AS place, 'python' AS side, method, avg(compress_us::DOUBLE) AS us FROM records GROUP BY method UNION ALL SELECT 1, 'c', method, avg(us) FROM li GROUP BY method")
def _(spark, d):
    """The rows of one study, then those of the other: events and line items."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.element_at(F.array(*map(F.lit, METHOD_NAMES)), (F.col("l_linenumber") % 5 + 1).cast("int")).alias("method"), F.col("l_extendedprice").alias("us"))
    side = lambda i, n, r: A.group_means(r, ["us"], ("method",)).select(F.lit(i).alias("place"), F.lit(n).alias("side"), "method", "us")
    return side(0, "python", records(spark, d).select("method", F.col("compress_us").cast("double").alias("us"))).unionByName(side(1, "c", li)).orderBy("place", "method")


@query("u2_snapshot_equal", f", s AS (SELECT k_idx, method, round(avg(psnr), 1) AS expected, round(avg(CASE WHEN status = 'OK' THEN psnr END), 1) AS actual FROM records GROUP BY k_idx, method) SELECT k_idx, count(*) AS cells, count(CASE WHEN expected IS DISTINCT FROM actual THEN 1 END) AS different, count(CASE WHEN expected IS DISTINCT FROM actual THEN 1 END) = 0 AS same FROM s GROUP BY k_idx")
def _(spark, d):
    """A snapshot of the good records against the stored one of all, row by row; the stored one is written and read again."""
    snap = lambda r: r.groupBy("k_idx").pivot("method", METHOD_NAMES).agg(F.round(F.avg("psnr"), 1))
    path = sinks.scratch(spark)
    snap(records(spark, d)).write.option("header", True).csv(path)
    stored = spark.read.option("header", True).schema("k_idx int, " + ", ".join(f"{m} double" for m in METHOD_NAMES)).csv(path)
    return A.snapshot_differences(snap(records(spark, d).where("status = 'OK'")), stored, "k_idx", METHOD_NAMES)


@query("u3_distinct_runs", "SELECT 0 AS place, 'run' AS kind, run_id::VARCHAR AS value FROM (SELECT DISTINCT run_id FROM records) UNION ALL SELECT 1, 'method', method FROM (SELECT DISTINCT method FROM records) UNION ALL SELECT 2, 'k', k_idx::VARCHAR FROM (SELECT DISTINCT k_idx FROM records)")
def _(spark, d):
    """Runs, methods and k that occur, each sorted."""
    r = records(spark, d)
    part = lambda i, n, c: r.select(F.lit(i).alias("place"), F.lit(n).alias("kind"), F.col(c).alias("by").cast("string").alias("value")).distinct()
    both = part(0, "run", "run_id").unionByName(part(1, "method", "method")).unionByName(part(2, "k", "k_idx"))
    return both.orderBy("place", F.col("value").try_cast("bigint"), "value")


@query("u4_first_slot_wins", "SELECT run_id, method, k_idx, min(ord) AS ord, arg_min(status, ord) AS status FROM records GROUP BY ALL")
def _(spark, d):
    return A.first_per_key(records(spark, d).select("run_id", "method", "k_idx", "ord", "status"), ["run_id", "method", "k_idx"], "ord")


@query("u5_consistent_runs", "SELECT run_id, count(DISTINCT (capture_us, convert_us)) = 1 AS consistent FROM records GROUP BY run_id")
def _(spark, d):
    return A.consistent(records(spark, d), ["capture_us", "convert_us"])


@query("u6_kernel_calls", "SELECT ord, dct_kernel_calls AS calls, expected, dct_kernel_calls = expected AS as_expected FROM (SELECT *, CASE device % 4 WHEN 3 THEN 1200 WHEN 0 THEN 3600 WHEN 1 THEN 2400 ELSE 1800 END::BIGINT AS expected FROM records)")
def _(spark, d):
    """Kernel calls of frames of 320 by 240 against luma blocks and twice the chroma blocks: 3600 in 4:4:4."""
    s = F.element_at(F.array(*map(F.lit, ("444", "422", "420", "gray"))), (F.col("device") % 4 + 1).cast("int"))
    luma, chroma = Q.geometry(F.lit(WIDTH), F.lit(HEIGHT), s, s == "gray")
    expected = (luma + 2 * chroma).cast("bigint")
    return records(spark, d).select("ord", F.col("dct_kernel_calls").alias("calls"), expected.alias("expected"), (F.col("dct_kernel_calls") == expected).alias("as_expected"))


@query("r8_complete_runs", "SELECT run_id, device % 4 = 3 AS single, CASE WHEN device % 4 = 3 THEN 1 ELSE 21 END AS expected, count(DISTINCT slot) AS slots, count(DISTINCT slot) >= CASE WHEN device % 4 = 3 THEN 1 ELSE 21 END AS complete FROM fr WHERE status = 'OK' GROUP BY run_id, device", FULL_SQL)
def _(spark, d):
    """Good slots of each run against what its mode expects: 21, or one in single mode, in which every fourth device works."""
    single = F.col("device") % 4 == 3
    g = full_records(spark, d).where("status = 'OK'").groupBy("run_id", single.alias("single")).agg(F.count_distinct("slot").alias("slots"))
    expected = checks.expected_records(F.col("single"))
    return g.select("run_id", "single", expected.alias("expected"), "slots", (F.col("slots") >= expected).alias("complete"))


@query("k8_schema_only", "SELECT method, k_idx, k_label, NULL::DOUBLE AS psnr, NULL::DOUBLE AS ssim FROM grid WHERE method IN (SELECT method FROM records)")
def _(spark, d):
    none = F.lit(None).cast("double")
    return grid(spark).join(records(spark, d).select("method").distinct(), "method", "left_semi").select("method", "k_idx", "k_label", none.alias("psnr"), none.alias("ssim"))


@query("k20_capture_catalogue", "SELECT run_id, (row_number() OVER (ORDER BY run_id))::INTEGER AS place, 'run' || run_id || '_raw.bmp' AS filename, 320 AS width, 240 AS height, 320 * 240 AS pixels FROM (SELECT DISTINCT run_id FROM records)")
def _(spark, d):
    runs = A.numbered(records(spark, d).select("run_id").distinct(), "run_id")
    return runs.select("run_id", F.col("place").cast("int").alias("place"), F.concat(F.lit("run"), "run_id", F.lit("_raw.bmp")).alias("filename"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(WIDTH * HEIGHT).alias("pixels"))


DC, RUN_1, RUN_2 = "ord % 1000", "ord % 40", "ord % 31"
BYTES = f"[({DC}) & 255, ({DC}) >> 8, {RUN_1}, 7, 0, {RUN_2}, 9, 0, 0, 0, 0]"
CRC32_SQL = "xor(list_reduce([4294967295] || {0}, lambda c, x: list_reduce([xor(c, x)] || range(8), lambda a, i: CASE WHEN a & 1 > 0 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295)"


@query("r2_record_status", f", p AS (SELECT *, CASE WHEN ord % 23 = 0 THEN ({BYTES})[1:8] ELSE {BYTES} END AS bytes, CASE WHEN mode = 'RAW' AND ord % 4 > 0 THEN 230400 WHEN ord % 59 = 0 THEN 0 ELSE stream_bytes END AS size FROM records), h AS (SELECT *, {CRC32_SQL.format('bytes')} AS crc FROM p) SELECT ord, crc::BIGINT AS crc32, CASE WHEN status = 'CRC_FAIL' THEN 'CRC_FAIL' WHEN mode = 'RAW' AND size <> 230400 THEN 'RAW_SIZE_FAIL' WHEN mode = 'RAW' THEN 'OK' WHEN device = 15 THEN 'MODE_FAIL' WHEN size <= 0 OR size > 687600 THEN 'JPEG_SIZE_FAIL' WHEN CASE WHEN ord % 23 = 0 THEN ({RUN_1}) + ({RUN_2}) <> 61 ELSE ({RUN_1}) + ({RUN_2}) >= 61 END THEN 'DECODE_FAIL' ELSE 'DECODED' END AS status FROM h")
def _(spark, d):
    """Records from their bytes: the payload's check sum against the header's, sizes by mode, and whether its run lengths decode. Payloads are one block's; some are cut before their end, some run past the block or go on behind its last place; a cut one that fills the block is whole."""
    byte = lambda c, k=0: (F.expr(f"({c}) >> {k} & 255") if isinstance(c, str) else F.lit(c), 1)
    whole = files.little_endian(byte(DC), byte(DC, 8), byte(RUN_1), byte(7), byte(0), byte(RUN_2), byte(9), byte(0), byte(0), byte(0), byte(0))
    sent = F.when(F.col("ord") % 23 == 0, F.substring(whole, 1, 8)).otherwise(whole)
    size = F.when((F.col("mode") == "RAW") & (F.col("ord") % 4 > 0), RAW_BYTES).when(F.col("ord") % 59 == 0, 0).otherwise(F.col("stream_bytes"))
    mode = F.when(F.col("mode") == "RAW", 1).when(F.col("device") == 15, 3).otherwise(2)
    r = records(spark, d).select("ord", sent.alias("payload"), size.alias("payload_len"), mode.alias("mode_type"), "status")
    told = F.crc32("payload") + (F.col("status") == "CRC_FAIL").cast("int")
    return checks.processed(r.withColumn("crc32", told).drop("status")).select("ord", F.crc32("payload").alias("crc32"), "status")
