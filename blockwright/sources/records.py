"""Experiment records: one row for each compressed frame of a run.

The derived source reads the events table: a user is a run, an event type a method, the
number in props a quality factor, and the value scales the metrics. Status and missing
values follow from the event number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwright.plans.dims import GRID_SQL, K_VALUES

# Event types as methods.
EVENT_METHODS = {"click": "loeffler", "error": "matrix", "purchase": "rdct", "signup": "silveira_j3", "view": "silveira_j7"}
RAW_BYTES, HEADER_BYTES, WIDTH, HEIGHT, BLOCK_CALLS = 230_400, 24, 320, 240, 3_600

#: The columns of a record file, all nullable.
RECORD_CSV = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("image", T.StringType()), ("method", T.StringType()), ("k", T.DoubleType()), ("psnr", T.StringType()), ("ssim", T.StringType()), ("bpp", T.DoubleType()),
        ("compress_us", T.LongType()), ("decompress_us", T.LongType()), ("dct_kernel_us", T.LongType()), ("idct_kernel_us", T.LongType()), ("dct_kernel_calls", T.LongType()),
        ("idct_kernel_calls", T.LongType()), ("tx_us", T.LongType()), ("frame_bytes", T.LongType()), ("tx_raw_us", T.LongType()), ("raw_bytes", T.LongType()),
        ("compression_ratio", T.DoubleType()), ("sha256_input_first8", T.StringType()), ("status", T.StringType()), ("status_detalhado", T.StringType()),
    )]
)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    method = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(m)) for t, m in EVENT_METHODS.items()])
    n = F.col("event_id")
    status = F.when(n % 29 == 0, "CRC_FAIL").when(n % 31 == 0, "DECODE_FAIL").when(n % 37 == 0, "PSRAM_FAIL").otherwise("OK")
    us = lambda x: F.floor(F.col("value") * x).cast("long")
    return e.select(
        n.alias("ord"), F.col("user_id").alias("run_id"), F.col("ts"), F.col("value"), method.alias("method"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 4).alias("k_idx"), status.alias("status"),
        F.when(n % 41 != 0, 20 + F.col("value") % 30).alias("psnr"), F.when(n % 43 != 0, (n % 100) / 100.0).alias("ssim"),
        (n % 97 / 8.0).alias("bpp"), (1000 + n % 50_000).alias("stream_bytes"), us(1000).alias("compress_us"), us(700).alias("decompress_us"),
        us(400).alias("dct_kernel_us"), us(300).alias("idct_kernel_us"), us(2000).alias("tx_us"), us(10).alias("prepare_us"), us(20).alias("frame_decode_us"), F.substring("props", 1, 8).alias("props_text"),
        F.when(n % 21 == 0, "RAW").otherwise("JPEG").alias("mode"), (50_000 + F.col("user_id") % 997).alias("capture_us"), (9_000 + F.col("user_id") % 97 + F.when(n % 211 == 0, 1).otherwise(0)).alias("convert_us"),
        us(5).alias("unpack_us"), us(30).alias("cam_decompress_us"), us(3).alias("metrics_us"), us(900).alias("save_us"), us(60).alias("draw_us"), (F.col("user_id") % 16).alias("device"),
        F.when(n % 97 == 0, BLOCK_CALLS - 1).otherwise(BLOCK_CALLS).cast("long").alias("dct_kernel_calls"), (BLOCK_CALLS + n % 3).alias("idct_kernel_calls"), (n % 4).alias("retry_count"),
    ).withColumn("k", F.element_at(F.array(*[F.lit(k) for k in K_VALUES]), F.col("k_idx") + 1))


def full_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records with all that the reports show: names, labels, slot, place in the run, sizes, fingerprint and notes."""
    from blockwright.operators.analytics import method_place

    r, raw = records(spark, sf_dir), F.col("mode") == "RAW"
    label = F.element_at(F.array(*[F.lit(f"{k:g}") for k in K_VALUES]), F.col("k_idx") + 1)
    slot = F.when(raw, 0).otherwise(1 + 5 * F.col("k_idx") + method_place("method"))
    notes = F.concat_ws("; ", F.when(F.col("status") != "OK", F.col("status")), F.when(F.col("psnr").isNull(), F.lit("no psnr")))
    return r.select(
        "*", F.when(raw, "raw").otherwise(F.col("method")).alias("method_name"), label.alias("k_label"), slot.cast("int").alias("slot"), slot.cast("int").alias("order_index"), (F.col("ord") % 65_536).alias("seq_num"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"),
        F.lit(0).alias("colorspace"), F.when(raw, 255).otherwise(0).alias("subsampling"), F.when(F.col("ord") % 10 != 0, F.substring(F.sha2(F.col("props_text"), 256), 1, 16)).alias("fingerprint"), notes.alias("notes"),
        F.when(F.col("ord") % 6 != 0, F.col("stream_bytes") + HEADER_BYTES + 1).otherwise(0).alias("frame_bytes"), F.when(F.col("ord") % 8 == 0, F.col("tx_us") + 1).otherwise(0).alias("tx_raw_us"), F.when(F.col("ord") % 9 == 0, F.lit(RAW_BYTES)).otherwise(0).cast("bigint").alias("raw_bytes"),
    )


RECORDS_SQL = f"""{GRID_SQL}, records AS (SELECT r.*, [{", ".join(f"{k}::DOUBLE" for k in K_VALUES)}][k_idx + 1] AS k FROM (SELECT event_id AS ord, user_id AS run_id, ts, value,
  CASE event_type {" ".join(f"WHEN '{t}' THEN '{m}'" for t, m in EVENT_METHODS.items())} END AS method, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 4 AS k_idx,
  CASE WHEN event_id % 29 = 0 THEN 'CRC_FAIL' WHEN event_id % 31 = 0 THEN 'DECODE_FAIL' WHEN event_id % 37 = 0 THEN 'PSRAM_FAIL' ELSE 'OK' END AS status,
  CASE WHEN event_id % 41 <> 0 THEN 20 + value % 30 END AS psnr, CASE WHEN event_id % 43 <> 0 THEN (event_id % 100) / 100.0::DOUBLE END AS ssim, (event_id % 97) / 8.0::DOUBLE AS bpp,
  1000 + event_id % 50000 AS stream_bytes, floor(value * 1000)::BIGINT AS compress_us, floor(value * 700)::BIGINT AS decompress_us, floor(value * 400)::BIGINT AS dct_kernel_us,
  floor(value * 300)::BIGINT AS idct_kernel_us, floor(value * 2000)::BIGINT AS tx_us, floor(value * 10)::BIGINT AS prepare_us, floor(value * 20)::BIGINT AS frame_decode_us, substr(props, 1, 8) AS props_text,
  CASE WHEN event_id % 21 = 0 THEN 'RAW' ELSE 'JPEG' END AS mode, 50000 + user_id % 997 AS capture_us, 9000 + user_id % 97 + CASE WHEN event_id % 211 = 0 THEN 1 ELSE 0 END AS convert_us, floor(value * 5)::BIGINT AS unpack_us, floor(value * 30)::BIGINT AS cam_decompress_us,
  floor(value * 3)::BIGINT AS metrics_us, floor(value * 900)::BIGINT AS save_us, floor(value * 60)::BIGINT AS draw_us, user_id % 16 AS device, CASE WHEN event_id % 97 = 0 THEN 3599 ELSE 3600 END::BIGINT AS dct_kernel_calls, 3600 + event_id % 3 AS idct_kernel_calls, event_id % 4 AS retry_count FROM events) r)"""
FULL_SQL = RECORDS_SQL + """, fr AS (SELECT r.*, CASE WHEN mode = 'RAW' THEN 'raw' ELSE r.method END AS method_name, f.k_label, (CASE WHEN mode = 'RAW' THEN 0 ELSE 1 + 5 * r.k_idx + method_ord END)::INTEGER AS slot, ord % 65536 AS seq_num, CASE WHEN mode = 'RAW' THEN 255 ELSE 0 END AS subsampling,
  CASE WHEN ord % 10 <> 0 THEN substr(sha256(props_text), 1, 16) END AS fingerprint, concat_ws('; ', CASE WHEN status <> 'OK' THEN status END, CASE WHEN psnr IS NULL THEN 'no psnr' END) AS notes, CASE WHEN ord % 6 <> 0 THEN stream_bytes + 25 ELSE 0 END AS frame_bytes, CASE WHEN ord % 8 = 0 THEN tx_us + 1 ELSE 0 END AS tx_raw_us, CASE WHEN ord % 9 = 0 THEN 230400 ELSE 0 END AS raw_bytes,
  CASE WHEN mode = 'RAW' THEN prepare_us + tx_us + unpack_us ELSE compress_us + prepare_us + tx_us + frame_decode_us + decompress_us END AS core_us FROM records r JOIN methods m ON m.method = r.method JOIN kfactors f ON f.k_idx = r.k_idx)"""
