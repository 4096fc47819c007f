"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.operators.memory import lean as lean  # the operators take it from here

#: A-Z to a-z on UTF-8 bytes; all other bytes stay.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows of some 60 bytes that are few enough to send to every task.
SENT_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine may leave it unset."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="blockwright-")
        spark.sparkContext.setCheckpointDir(known)
    return known


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Settings of the session for a while; names with __ for dots."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def durable(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    Cuts the lineage at a place that outlives any executor, and computes df once. Its
    shuffle files go when the write has ended. by: a column with few values, for each of
    which a folder is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/blockwright-{uuid.uuid4().hex}"
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__execution__arrow__maxBytesPerBatch="16m"):
        df.write.parquet(path, partitionBy=by)
    back = spark.read.schema(df.schema).parquet(path)
    back.durable_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete what durable() wrote, once nothing reads it any more."""
    for df in tables:
        jvm, path = df.sparkSession.sparkContext._jvm, df.durable_path
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def groups(batches, key: int = 0):
    """Runs of equal keys in Arrow batches that are sorted by the key column: (key, list of rows as tuples). Lists come as arrays."""
    now, rows = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            columns = [c.to_numpy(zero_copy_only=False) if pa.types.is_list(c.type) else c.to_pylist() for c in batch.slice(at, 1024).columns]
            for row in zip(*columns):
                if row[key] != now:
                    if rows:
                        yield now, rows
                    now, rows = row[key], []
                rows.append(row)
    if rows:
        yield now, rows


def packed(task: np.ndarray, kind: int, columns: dict[str, str], **given: np.ndarray) -> pa.RecordBatch:
    """Values as rows (task, kind, columns): one for each run of equal tasks, with the run's values of a column one after the other as bytes.

    columns: names and number types; those that aren't given are empty. Such rows spare the
    shuffle a row for each value.
    """
    start = np.flatnonzero(np.r_[True, task[1:] != task[:-1]]) if len(task) else np.zeros(0, np.int64)
    ends = np.append(start, len(task))
    arrays = [pa.array(task[start].astype(np.int32)), pa.array(np.full(len(start), kind, np.int32))]
    for name, dtype in columns.items():
        v = np.ascontiguousarray(given[name].astype(dtype)) if name in given else np.zeros(0, dtype)
        offsets = (ends if name in given else np.zeros(len(ends), np.int64)) * v.itemsize
        arrays.append(pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(v)]))
    return pa.RecordBatch.from_arrays(arrays, ["task", "kind", *columns])


def values(batch: pa.RecordBatch, columns: dict[str, str]) -> dict[str, np.ndarray]:
    """What packed() has put into rows, by column; rows: how many values each row has."""
    out = {}
    for k, (name, dtype) in enumerate(columns.items()):
        c = batch.column(k + 2)
        offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int32)
        size = int(offsets[-1] - offsets[0]) // np.dtype(dtype).itemsize
        out[name] = np.frombuffer(c.buffers()[2], dtype, size, int(offsets[0])) if size else np.zeros(0, dtype)
        if size and "rows" not in out:
            out["rows"] = np.diff(offsets) // np.dtype(dtype).itemsize
    return out


def whole_tasks(batches):
    """Arrow batches that are sorted by their first column, cut so that all rows of one task come together."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if rest is None else pa.concat_batches([rest, b])
        task = b.column(0).to_numpy()
        at = int(np.searchsorted(task, task[-1]))
        if at:
            yield b.slice(0, at)
        rest = b.slice(at)
    if rest is not None:
        yield rest


def sent(df: DataFrame) -> DataFrame:
    """Broadcast what has been counted and is small; otherwise leave the join to shuffles."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Label each node of an undirected graph with the smallest node of its component.

    edges: columns a and b of one orderable type. Returns node, component for each
    node that occurs. Alternates large-star and small-star steps: each round joins
    every node's neighbours to the smallest one, so chains halve and no node ever
    gathers its neighbours in one list. Each round is written to the shared folder.
    Rows with a null end and loops only are ignored.
    """
    e = durable(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes, mark = e, None
    for _ in range(most_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = durable(small)
        if e is not nodes:
            discard(e)
        e, last = small, mark
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()  # equal edges have equal sums
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    ends = nodes.select(F.col("a").alias("node")).unionByName(nodes.select(F.col("b").alias("node"))).distinct()
    label = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    out = durable(ends.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    discard(*({nodes, e}))
    return out
