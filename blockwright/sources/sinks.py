"""Writers: tables as CSV with a header, parts by method or run, appended summaries, rasters, and what a stream gives out."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from blockwright.functions import scalars as S
from blockwright.sources.headed import write_headed


def scratch(spark: SparkSession) -> str:
    """A new place below the folder that driver and executors share; only a session on one machine may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="blockwright-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/written-{uuid.uuid4().hex}"


def write_union(parts: list[DataFrame], path: str) -> DataFrame:
    """Rows of tables of different columns as CSV: the columns are those of all, in the order in which they are first seen."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows.write.option("header", True).csv(path)
    return rows


def write_by(rows: DataFrame, path: str, column: str) -> None:
    """One folder for each value of a column."""
    rows.write.partitionBy(column).option("header", True).csv(path)


def write_runs(records: DataFrame, path: str) -> None:
    """One record file for each run, by k, then method."""
    write_headed(records, path, "run_id", ["k_idx", "method_ord"])


def write_folders(rows: DataFrame, path: str, folder: str, order: list[str]) -> None:
    """One CSV file with a header for each value of a column, in a folder of its name, its rows in order. Later calls add folders."""
    write_headed(rows, path, folder, order)


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with its text, all at once, unless it is there: of several writers one succeeds.

    A hard link makes the claim on a local or mounted file system, a rename elsewhere; both
    fail where the name is taken.
    """
    jvm, made = spark.sparkContext._jvm, f"{path}.{uuid.uuid4().hex}"
    target, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(made)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = store.create(source, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if store.getScheme() != "file":
            return not store.exists(target) and store.rename(source, target)
        os.link(source.toUri().getPath(), target.toUri().getPath())
        return True
    except FileExistsError:
        return False
    finally:
        store.delete(source, False)


def claims(spark: SparkSession, folder: str) -> dict[str, str]:
    """Names and texts of the claims in a folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        return {}
    names = [f.getPath().getName() for f in store.listStatus(at)]
    names = [n for n in names if "." not in n]  # others are being made
    rows = spark.read.option("wholetext", True).text([f"{folder}/{n}" for n in names]).select(F.element_at(F.split(F.input_file_name(), "/"), -1), "value").collect() if names else []
    return dict(map(tuple, rows))


def claim_run_id(spark: SparkSession, folder: str, least: int = 1, owner: str = "") -> int:
    """The next run id that nobody has: one more than all that are claimed, and least at least. Two writers never get the same."""
    run = max([least, *(int(n) + 1 for n in claims(spark, folder))])
    while not claim(spark, f"{folder}/{run}", owner or "run"):
        run += 1
    return run


def append_summary(rows: DataFrame, path: str, lot: str) -> bool:
    """Add a lot of rows to a summary once: False and nothing added if a lot of that name is there.

    The rows go into a folder of their own; then a claim in the ledger, which names the
    folder, makes them part of the summary. What a failed or late writer leaves is in no
    ledger and is never read.
    """
    spark = rows.sparkSession
    if lot in claims(spark, f"{path}/ledger"):
        return False
    attempt = uuid.uuid4().hex
    rows.write.option("header", True).csv(f"{path}/rows/{attempt}")
    return claim(spark, f"{path}/ledger/{lot}", attempt)


def read_summary(spark: SparkSession, path: str, kinds: str) -> DataFrame:
    """The rows of all lots in the ledger."""
    lots = [f"{path}/rows/{attempt}" for attempt in claims(spark, f"{path}/ledger").values()]
    return spark.read.option("header", True).schema(kinds).csv(lots) if lots else spark.createDataFrame([], kinds)


def write_sections(sections: list[tuple[str, DataFrame]], path: str) -> None:
    """Titled tables of one set of columns as one text: a title, then its rows as CSV by their first column. Parts of the folder follow each other in the order of their names."""
    lines = None
    for i, (title, rows) in enumerate(sections):
        text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])
        head = rows.sparkSession.createDataFrame([(i, "", f"# {title}")], "place int, by string, value string")
        part = head.unionByName(rows.select(F.lit(i).alias("place"), F.concat(F.lit(" "), F.coalesce(F.col(rows.columns[0]).cast("string"), F.lit(""))).alias("by"), text.alias("value")))
        lines = part if lines is None else lines.unionByName(part)
    lines.orderBy("place", "by", "value").select("value").write.text(path)


def read_sections(spark: SparkSession, path: str, kinds: str) -> DataFrame:
    """place, section and columns of what write_sections() wrote. The few titles are looked up first, and tell of each line which section it is in."""
    at = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", at.alias("at"))
    titles = lines.where(F.col("value").startswith("# ")).orderBy("at").collect()
    section = F.lit(-1)
    for i, t in enumerate(titles):
        section = F.when(F.col("at") >= F.struct(F.lit(t["at"][0]).alias("file"), *[F.lit(n).cast("bigint").alias(c) for n, c in zip(t["at"][1:], ("start", "line"))]), i).otherwise(section)
    names = F.array(*[F.lit(t["value"][2:]) for t in titles])
    row = F.from_csv("value", kinds)
    return lines.where(~F.col("value").startswith("# ")).select(section.alias("place"), names[section].alias("section"), row.alias("r")).select("place", "section", "r.*")


def write_rasters(blocks: DataFrame, path: str) -> None:
    """Gray rasters of whole images from blocks (image, method, k_idx, brow, bcol, d), level-shifted back: image, width, height, raster (binary), in folders by method and k_idx."""
    value = lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), v + 128)).cast("bigint")), 2, "0")
    lines = blocks.select("image", "method", "k_idx", "bcol", "brow", F.posexplode(F.transform(F.array(*map(F.lit, range(8))), lambda r: F.array_join(F.transform(F.slice("d", r * 8 + 1, 8), value), ""))).alias("r", "hex"))
    lines = lines.withColumn("y", F.col("brow") * 8 + F.col("r"))
    g = lines.groupBy("image", "method", "k_idx").agg(F.array_sort(F.collect_list(F.struct("y", "bcol", "hex"))).alias("rows"), (F.max("y") + 1).alias("height"), ((F.max("bcol") + 1) * 8).alias("width"))
    g.select("image", "method", "k_idx", "width", "height", F.unhex(F.array_join(F.transform("rows", lambda x: x["hex"]), "")).alias("raster")).write.partitionBy("method", "k_idx").parquet(path)


#: A time that no record reaches.
END_OF_STREAM = "2200-01-01"


def as_stream(rows: DataFrame, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table with a column ts as a stream: written into a folder and read from it file by file.

    A last row without key, at the end of time, lets the watermark pass all others, as the
    clock of a real stream would.
    """
    if rows.schema["ts"].dataType == TimestampNTZType():
        rows = rows.withColumn("ts", F.timestamp_micros(S.micros("ts")))
    rows.write.parquet(path)
    end = rows.sparkSession.createDataFrame([(END_OF_STREAM,)], "at string").select(*[F.to_timestamp("at").alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    end.write.mode("append").parquet(path)
    stream = rows.sparkSession.readStream.schema(rows.schema)
    return (stream.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else stream).parquet(path)


#: Bytes of a played table for which a partition of state is worth its task.
STATE_BYTES = 4 << 20


def played(stream: DataFrame, path: str, kinds: str, progress: list | None = None, folders: tuple[str, ...] = ()) -> DataFrame:
    """What a stream gives out until its source is used up, written batch by batch and read again.

    progress: takes the query's reports. folders: where the table lies that is played; a
    small one gets fewer partitions of state than the session has for shuffles, each batch
    of which would be a task.
    """
    spark = stream.sparkSession
    configured = spark.conf.get("spark.sql.shuffle.partitions")
    if folders:
        jvm = spark.sparkContext._jvm
        places = [jvm.org.apache.hadoop.fs.Path(f) for f in folders]
        size = sum(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength() for p in places)
        spark.conf.set("spark.sql.shuffle.partitions", min(int(configured), max(spark.sparkContext.defaultParallelism, -(-size // STATE_BYTES))))
    try:
        return run_to_end(stream, path, kinds, progress)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", configured)


def run_to_end(stream: DataFrame, path: str, kinds: str, progress: list | None) -> DataFrame:
    q = stream.writeStream.outputMode("append").foreachBatch(emit_once(path)).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").start()
    q.awaitTermination()
    if progress is not None:
        progress += q.recentProgress
    return read_emitted(stream.sparkSession, path, kinds)


def emit_once(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the header is written once, each batch of runs into a folder of its own, so that a repeated batch replaces itself."""

    def put(df: DataFrame, batch: int) -> None:
        flat = df.select(*[F.concat_ws(" ", c).alias(c) if k.startswith("array") else F.col(c) for c, k in df.dtypes])
        df.sparkSession.createDataFrame([(",".join(df.columns),)], "value string").coalesce(1).write.mode("ignore").text(f"{path}/header")
        flat.write.mode("overwrite").csv(f"{path}/rows/batch={batch}")

    return put


def read_emitted(spark: SparkSession, path: str, kinds: str) -> DataFrame:
    """The rows of emit_once(), with the names in the header checked against kinds."""
    names = spark.read.text(f"{path}/header").first().value.split(",")
    rows = spark.read.schema(kinds).csv(f"{path}/rows/*")
    if rows.columns != names:
        raise ValueError(f"the header names {names}")
    return rows
