"""Files as tables: images, record files and binary record logs. Bad files and rows come as rejects, not as errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.sources.records import RECORD_CSV

FRAME = "path string, width int, height int, channels int, data binary, error string"
# Magic numbers, versions and sizes of the binary records.
HEADER_MAGIC, HEADER_VERSION, HEADER_SIZE = 0x314A4349, 5, 24
TELEMETRY_MAGIC, TELEMETRY_VERSION, TELEMETRY_SIZE = 0x544D, 1, 36


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, length of the image files of a folder, by name."""
    return image_names(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length"))


def image_names(files: DataFrame) -> DataFrame:
    """path, name, length of the files (path, length) that are images by their ending, by name."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.lower("path").rlike(r"\.(bmp|png|jpe?g)$")).select("path", name.alias("name"), "length").orderBy("name", "path")


def bmp(raw: bytes) -> tuple[int, int, bytes]:
    """24-bit BMP, rows from the bottom, padded to four bytes, blue first."""
    head = np.frombuffer(raw[:54], np.uint8)
    if raw[:2] != b"BM" or len(head) < 54:
        raise ValueError("no BMP")
    start, width, height = (int(np.frombuffer(raw[a : a + 4], "<i4")[0]) for a in (10, 18, 22))
    depth = int(np.frombuffer(raw[28:30], "<u2")[0])
    row = (width * 3 + 3) // 4 * 4
    if depth != 24 or width <= 0 or height <= 0 or len(raw) < start + row * height:
        raise ValueError("size or depth")
    rows = np.frombuffer(raw, np.uint8, row * height, start).reshape(height, row)[::-1, : width * 3]
    return width, height, rows.reshape(height, width, 3)[:, :, ::-1].tobytes()


def ppm(raw: bytes) -> tuple[int, int, bytes]:
    """Binary PPM with 255 as the largest value; comments are skipped."""
    fields, at = [], 0
    while len(fields) < 4:
        while at < len(raw) and (raw[at : at + 1].isspace() or raw[at : at + 1] == b"#"):
            at = raw.index(b"\n", at) + 1 if raw[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("short header")
        fields.append(raw[at:end])
        at = end
    width, height = int(fields[1]), int(fields[2])
    data = raw[at + 1 : at + 1 + width * height * 3]
    if fields[0] != b"P6" or fields[3] != b"255" or len(data) < width * height * 3:
        raise ValueError("kind, largest value or size")
    return width, height, data


def read_images(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Frames of BMP or PPM files; error is set and data null where a file can't be read."""
    return decode_images(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content"))


def decode_images(files: DataFrame) -> DataFrame:
    """Frames of files (path, content), batch by batch."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for path, raw in zip(p["path"], p["content"]):
                try:
                    w, h, data = (bmp if bytes(raw[:2]) == b"BM" else ppm)(bytes(raw))
                    out.append((path, w, h, 3, data, None))
                except (ValueError, IndexError) as e:
                    out.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "width", "height", "channels", "data", "error"])

    return files.mapInPandas(decode, FRAME)


# CSV files come from read_headed(); other text files are tables of lines (file, line, value), so that lines from anywhere are read by the same rules.


def text_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """file, line (orders the lines of a file), value."""
    line = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return spark.read.text(pattern).select(F.col("_metadata.file_path").alias("file"), line.alias("line"), "value")


def named(rows: DataFrame) -> DataFrame:
    """Rows of read_headed() with m, a map from column names to cells; rows may be short."""
    return rows.withColumn("m", F.map_from_arrays("names", F.transform("names", lambda n, i: F.get("cells", i))))


def cell(*names: str) -> Column:
    """The first of several names that a file has; empty cells and N/A are null."""
    t = F.trim(F.coalesce(*[F.col("m")[n] for n in names]))
    return F.when((t != "") & (t != "N/A"), t)


def folder_of(file: str = "file") -> Column:
    """The name of a file's folder; of a folder name=value the value."""
    folder = F.substring_index(F.substring_index(file, "/", -2), "/", 1)  # a pattern would be tried at every place of a path
    at = F.instr(folder, "=")
    value = F.when((at > 1) & (at < F.length(folder)), folder.substr(at + 1, F.length(folder))).otherwise(folder)
    return F.when(F.instr(F.col(file), "/") > 0, value).otherwise("")


ALIASES = {"compress_ms": ("compress_ms", "comp_ms"), "decompress_ms": ("decompress_ms", "decomp_ms")}


def read_summary(headed: DataFrame, metrics: list[str]) -> DataFrame:
    """method, k (6 places) and metrics of summary files; of rows with one key the last counts."""
    rows = named(headed).select("file", "line", cell("method").alias("method"), F.round(cell("k").try_cast("double"), 6).alias("k"), *[cell(*ALIASES.get(c, (c,))).try_cast("double").alias(c) for c in metrics])
    last = rows.groupBy("method", "k").agg(F.max_by(F.struct(*metrics), F.struct("file", "line")).alias("x"))
    return last.select("method", "k", "x.*")


def read_records(headed: DataFrame) -> DataFrame:
    """Record files of all runs; the run is the folder's name. Empty cells and N/A are null."""
    typed = [cell(f.name).try_cast(f.dataType).alias(f.name) if f.name not in ("psnr", "ssim") else cell(f.name).try_cast("double").alias(f.name) for f in RECORD_CSV]
    return named(headed).select(folder_of().alias("run"), *typed)


def scene_records(headed: DataFrame, grid: DataFrame) -> DataFrame:
    """Records of good status whose method and k belong to the study; the scene is the folder's name."""
    rows = read_records(headed).withColumnRenamed("run", "scene").withColumn("k", F.round("k", 6)).where("status = 'OK'")
    return rows.join(F.broadcast(grid.select("method", F.round("k", 6).alias("k"))), ["method", "k"], "left_semi")


def time_summary(headed: DataFrame, metric: str) -> DataFrame:
    """method, k and mean of timing files. A file with a column image has a row for each image and is averaged first; others are averaged already."""
    rows = named(headed).select("file", cell("method").alias("method"), F.round(cell("k").try_cast("double"), 6).alias("k"), F.array_contains("names", "image").alias("per_image"), cell(*ALIASES.get(metric, (metric,))).try_cast("double").alias("v"))
    averaged = rows.where("per_image").groupBy("file", "method", "k").agg(F.avg("v").alias("v")).select("method", "k", "v")
    return averaged.unionByName(rows.where("NOT per_image").select("method", "k", "v")).groupBy("method", "k").agg(F.avg("v").alias(metric))


METRIC_FILE = r"([^/]+)/run([0-9]+)_(.+)_k([0-9p]+)\.txt$"


def read_metrics(lines: DataFrame) -> DataFrame:
    """file, name, value of "name: value" files; the first line of a name counts."""
    split = F.split("value", ":", 2)
    named = lines.where(F.size(split) == 2).select("file", "line", F.trim(split[0]).alias("name"), F.trim(split[1]).alias("value"))
    return named.groupBy("file", "name").agg(F.min_by("value", "line").alias("value"))


def record_metric(lines: DataFrame, name: str, by_scene: bool = False) -> DataFrame:
    """One metric of each record: scene (the folder), run, method, k_token, value. by_scene: the run is no part of the match; the first file by name has the value of the whole scene."""
    ending = F.substring_index("file", "/", -2)
    part = lambda i: F.regexp_extract(ending, METRIC_FILE, i)
    m = read_metrics(lines).where((F.col("name") == name) & ending.rlike(METRIC_FILE)).select("file", part(1).alias("scene"), part(2).cast("bigint").alias("run"), part(3).alias("method"), part(4).alias("k_token"), "value")
    return m.groupBy("scene", "method", "k_token").agg(F.min_by("value", "file").alias("value")) if by_scene else m.drop("file")


def preferred_capture(files: DataFrame) -> DataFrame:
    """scene, file: of the captures (file) in a folder one that ends in _ref.bmp, else one that ends in _raw.bmp; the first by name."""
    rank = F.when(F.col("file").endswith("_ref.bmp"), 0).when(F.col("file").endswith("_raw.bmp"), 1)
    return files.withColumn("rank", rank).where("rank IS NOT NULL").groupBy(folder_of().alias("scene")).agg(F.min(F.struct("rank", "file")).alias("x")).select("scene", "x.file")


def missing_captures(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of the wanted captures (run, kind) those that no file run<run>_<kind>.bmp is there for."""
    name = F.concat(F.lit("run"), F.col("run").cast("string"), F.lit("_"), "kind", F.lit(".bmp"))
    there = files.select(F.element_at(F.split("file", "/"), -1).alias("name")).distinct()
    return wanted.withColumn("name", name).join(there, "name", "left_anti").drop("name")


def require_captures(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, if every capture is there; an error names up to ten that aren't."""
    gone = [f"{r.run} {r.kind}" for r in missing_captures(files, wanted).orderBy("run", "kind").limit(10).collect()]
    if gone:
        raise FileNotFoundError(f"captures are missing: {', '.join(gone)}")
    return wanted


def first_source(spark: SparkSession, candidates: dict[str, Callable[[], DataFrame]]) -> tuple[str, DataFrame]:
    """Name and rows of the first source that exists and has a row."""
    for name, read in candidates.items():
        try:
            rows = read()
            if not rows.isEmpty():
                return name, rows
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"no source: {', '.join(candidates)}")


def unsigned(raw: str | Column, at: int, size: int) -> Column:
    """Little-endian unsigned number of size bytes at a place of a binary column."""
    c = F.col(raw) if isinstance(raw, str) else raw
    return F.conv(F.concat(*[F.hex(F.substring(c, at + k, 1)) for k in range(size, 0, -1)]), 16, 10).cast("bigint")


def little_endian(*fields: tuple[Column, int]) -> Column:
    """Whole numbers with their sizes as one binary column, the lowest byte first."""
    byte = lambda c, k: F.lpad(F.hex(F.shiftrightunsigned(c.cast("bigint"), 8 * k).bitwiseAND(255)), 2, "0")
    return F.unhex(F.concat(*[byte(c, k) for c, size in fields for k in range(size)]))


def decode_headers(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """The fields of 24-byte record headers; error names what keeps a row from being one."""
    u = lambda at, size: unsigned(raw, at, size)
    error = F.when(F.octet_length(raw) != HEADER_SIZE, "size").when(u(0, 4) != HEADER_MAGIC, "magic").when(u(4, 1) != HEADER_VERSION, "version").when(u(5, 1) != HEADER_SIZE, "header size")
    fields = [("record_type", 6, 1), ("flags", 7, 1), ("run_id", 8, 4), ("order_index", 12, 1), ("method_id", 13, 1), ("mode_type", 14, 1), ("k_idx", 15, 1), ("payload_len", 16, 4), ("crc32", 20, 4)]
    return rows.withColumn("error", error).select("*", *[F.when(F.col("error").isNull(), u(at, size)).alias(n) for n, at, size in fields])


def crc_table() -> np.ndarray:
    table = np.arange(256) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, table << 1 ^ 0x1021, table << 1) & 0xFFFF
    return table


def crc16(raw: Column, length: int) -> Column:
    """CRC-16 with polynomial 0x1021 from 0xFFFF over the first bytes of a binary column; null where there are fewer."""
    table = crc_table()

    @F.arrow_udf("int")
    def crc(v: pa.Array) -> pa.Array:
        v = v.cast(pa.large_binary())
        at = np.frombuffer(v.buffers()[1], np.int64)[v.offset : v.offset + len(v) + 1] if len(v) else np.zeros(1, np.int64)
        known = (np.diff(at) >= length) & v.is_valid().to_numpy(zero_copy_only=False)
        data = np.frombuffer(v.buffers()[2], np.uint8) if known.any() else np.zeros(0, np.uint8)
        start, out = at[:-1][known], np.full(len(v), 0xFFFF, np.int64)
        now = out[known]
        for k in range(length):
            now = (now << 8 & 0xFFFF) ^ table[now >> 8 ^ data[start + k]]
        out[known] = now
        return pa.array(out.astype(np.int32), mask=~known)

    return crc(raw)


def decode_telemetry(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """The fields of 36-byte telemetry blocks; the check sum covers the first 32 bytes."""
    u = lambda at, size: unsigned(raw, at, size)
    error = F.when(F.octet_length(raw) != TELEMETRY_SIZE, "size").when(u(0, 2) != TELEMETRY_MAGIC, "magic").when(u(2, 1) != TELEMETRY_VERSION, "version").when(u(3, 1) != TELEMETRY_SIZE, "block size").when(crc16(F.col(raw), 32) != u(32, 2), "check sum")
    fields = [("capture_us", 4, 4), ("convert_us", 8, 4), ("prepare_us", 12, 4), ("algorithm_us", 16, 4), ("decompress_us", 20, 4), ("kernel_us", 24, 4), ("psnr_x100", 28, 2), ("kernel_calls", 30, 2)]
    return rows.withColumn("error", error).select("*", *[F.when(F.col("error").isNull(), u(at, size)).alias(n) for n, at, size in fields])
