"""Text and table forms of records: the report of one record, of a run, and the row of the summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwright.functions import scalars as S

# Names of the report's fields in their order; a rule stands where there is "-".
REPORT = [
    "-", "run_id", "timestamp", "mode_type", "method", "record_type", "order_index", "seq_num", "width", "height", "colorspace", "subsampling", "k",
    "-", "stream_bytes", "bpp", "compression_ratio_vs_raw", "psnr_db", "ssim", "sha256_input_first8",
    "-", "t_capture_us", "t_rgb565_to_rgb888_us", "t_raw_pack_us", "t_compress_us", "t_cam_decompress_us", "t_frame_encode_us", "t_spi_rx_us", "t_raw_unpack_us", "t_frame_decode_us", "t_decompress_us",
    "t_dct_kernel_us", "t_idct_kernel_us", "dct_kernel_calls", "idct_kernel_calls", "t_metrics_us", "t_sd_save_us", "t_tft_draw_us", "t_total_core_us",
    "-", "crc_ok", "retry_count", "status", "notes", "-",
]
# The summary's columns in their order, and the width that names of the report are padded to.
SUMMARY = ["image", "method", "k", "psnr", "ssim", "bpp", "compress_us", "decompress_us", "dct_kernel_us", "idct_kernel_us", "dct_kernel_calls", "idct_kernel_calls", "tx_us", "frame_bytes", "tx_raw_us", "raw_bytes", "compression_ratio", "sha256_input_first8", "status", "status_detalhado"]
WIDTH = 22
HEADER_BYTES = 24


def only(mode: str, c: Column | str) -> Column:
    """A timing of one mode; 0 in the other."""
    return F.when(F.col("mode") == mode, F.col(c) if isinstance(c, str) else c).otherwise(F.lit(0))


def core_time() -> Column:
    c = F.col
    return F.when(c("mode") == "RAW", c("prepare_us") + c("tx_us") + c("unpack_us")).otherwise(c("compress_us") + c("prepare_us") + c("tx_us") + c("frame_decode_us") + c("decompress_us"))


def valid_timings() -> dict[str, Column]:
    """The timings that hold for a record's mode; the others are 0."""
    return {"t_raw_pack_us": only("RAW", "prepare_us"), "t_compress_us": only("JPEG", "compress_us"), "t_cam_decompress_us": only("JPEG", "cam_decompress_us"), "t_frame_encode_us": only("JPEG", "prepare_us")}


def report_values() -> dict[str, Column]:
    c = F.col
    ratio = S.ratio(F.lit(230_400), c("stream_bytes"))
    plain = {
        "run_id": "run_id", "mode_type": "mode", "method": "method_name", "order_index": "order_index", "seq_num": "seq_num", "width": "width", "height": "height", "colorspace": "colorspace", "subsampling": "subsampling",
        "stream_bytes": "stream_bytes", "t_capture_us": "capture_us", "t_rgb565_to_rgb888_us": "convert_us", "t_spi_rx_us": "tx_us", "t_raw_unpack_us": "unpack_us", "t_frame_decode_us": "frame_decode_us",
        "t_decompress_us": "decompress_us", "t_dct_kernel_us": "dct_kernel_us", "t_idct_kernel_us": "idct_kernel_us", "dct_kernel_calls": "dct_kernel_calls", "idct_kernel_calls": "idct_kernel_calls",
        "t_metrics_us": "metrics_us", "t_tft_draw_us": "draw_us", "retry_count": "retry_count", "status": "status", "notes": "notes",
    }
    made = {
        "timestamp": S.uptime(c("capture_us") * 1000), "record_type": F.concat("mode", F.lit("_FRAME")), "k": c("k_label"), "bpp": S.decimals(c("bpp"), 4),
        "compression_ratio_vs_raw": S.decimals(ratio, 4), "psnr_db": S.or_na(c("psnr"), 3), "ssim": S.or_na(c("ssim"), 4), "sha256_input_first8": F.coalesce("fingerprint", F.lit("N/A")),
        "t_sd_save_us": F.lpad(c("save_us").cast("string"), 10, "0"), "t_total_core_us": core_time(), "crc_ok": (c("status") != "CRC_FAIL").cast("int"),
    }
    return {k: c(v) for k, v in plain.items()} | made | valid_timings()


def record_report() -> Column:
    """The report of one record as text."""
    values = report_values()
    lines = [F.lit("---") if n == "-" else F.concat(F.lit(f"{n}:".ljust(max(WIDTH, len(n) + 1 + (n == "compression_ratio_vs_raw")) - (n == "t_spi_rx_us"))), values[n].cast("string")) for n in REPORT]
    return F.concat_ws("\n", *lines)


def run_line() -> Column:
    """A record's line in the report of its run."""
    c = F.col
    parts = [F.lit("- "), c("method_name"), F.lit(" k="), c("k_label"), F.lit(" ("), c("mode"), F.lit("): bytes="), c("stream_bytes").cast("string"), F.lit(" bpp="), S.decimals(c("bpp"), 4), F.lit(" psnr="), S.or_na(c("psnr"), 3)]
    parts += [F.lit(" core_us="), core_time().cast("string"), F.lit(" dct_us="), c("dct_kernel_us").cast("string"), F.lit(" idct_us="), c("idct_kernel_us").cast("string"), F.lit(" status="), c("status"), F.lit(" crc_ok="), (c("status") != "CRC_FAIL").cast("int").cast("string")]
    return F.concat(*parts)


def run_lines(records: DataFrame) -> DataFrame:
    """run_id, line, text: the lines of all run reports, head first, then records by slot; write them sorted by run and line. No run is gathered in one row."""
    head = [F.concat(F.lit("run_id: "), F.col("run_id").cast("string")), F.lit("reference_method: RAW"), F.concat(F.lit("records_expected: "), F.lit(21).cast("string")), F.lit("records:")]
    heads = records.select("run_id").distinct().select("run_id", F.posexplode(F.array(*head)).alias("line", "text")).select("run_id", F.struct(F.lit(0).alias("part"), F.col("line").cast("bigint").alias("slot"), F.lit(0).cast("bigint").alias("ord")).alias("line"), "text")
    own = records.select("run_id", F.struct(F.lit(1).alias("part"), F.col("slot").cast("bigint").alias("slot"), F.col("ord").cast("bigint").alias("ord")).alias("line"), run_line().alias("text"))
    return heads.unionByName(own)


def summary_rows(records: DataFrame, *more: str) -> DataFrame:
    """The 20 columns of the summary. Raw bytes, raw sending time and frame bytes fall back; timings of compressed records are 0 for raw ones."""
    c = F.col
    raw = c("mode") == "RAW"
    kept = lambda x, other: F.when(c(x) > 0, c(x)).otherwise(other)
    return records.select(
        *more, F.concat(F.lit("frame_"), F.lpad(c("run_id").cast("string"), 4, "0")).alias("image"), c("method_name").alias("method"), c("k_label").alias("k"), S.or_na(c("psnr"), 6).alias("psnr"), S.or_na(c("ssim"), 6).alias("ssim"), S.decimals(c("bpp"), 6).alias("bpp"),
        *[only("JPEG", n).alias(n) for n in ("compress_us", "decompress_us", "dct_kernel_us", "idct_kernel_us", "dct_kernel_calls", "idct_kernel_calls", "tx_us")],
        kept("frame_bytes", c("stream_bytes") + HEADER_BYTES).alias("frame_bytes"), kept("tx_raw_us", F.when(raw, c("tx_us")).otherwise(0)).alias("tx_raw_us"), kept("raw_bytes", F.when(raw, c("stream_bytes")).otherwise(0)).alias("raw_bytes"),
        S.decimals(S.ratio(F.lit(230_400), c("stream_bytes")), 6).alias("compression_ratio"), F.coalesce("fingerprint", F.lit("N/A")).alias("sha256_input_first8"), "status",
        S.csv_field(F.coalesce(F.nullif("notes", F.lit("")), "status")).alias("status_detalhado"),
    )
