"""A data source of CSV files whose headers differ: each row comes with its own file's names. It also writes a file for each of many folders.

Spark's CSV reader wants one schema for all files. Here a partition is a range of bytes of a
file or several small files; a task reads the first line of each of its files, then its
lines, so no row has to meet its header by a shuffle. Paths may be of any file system that
Arrow knows; a path without a scheme is local to all executors.

Tables of many runs have a folder and a file for each. Spark's own writer takes some
milliseconds for a folder, most of them one after the other when the driver commits; here
tasks put each file into its place by a rename, and the driver has nothing to move.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "file string, line bigint, names array<string>, cells array<string>"
ROWS = 4096
#: What opening a file costs, in bytes of reading: many small files are dealt into more tasks.
OPENING = 32 << 10
#: Files of at most so many bytes are read at once.
SMALL = 1 << 20
#: Folder of rows without a value, as Spark names it.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


class Ranges(InputPartition):
    """Parts of files: (path, first byte, byte behind the last)."""

    def __init__(self, parts: list[tuple[str, int, int]]):
        super().__init__(0)
        self.parts = parts


def packed(files: list[tuple[str, int]], most: int) -> list[Ranges]:
    """Files (path, size) dealt into partitions of at most so many bytes; large ones are split."""
    out: list[list[tuple[str, int, int]]] = []
    size = 0
    for path, length in files:
        for start in range(0, length, most):
            part = path, start, min(length, start + most)
            if not out or size + part[2] - start > most:
                out.append([])
                size = 0
            out[-1].append(part)
            size += part[2] - start + OPENING
    return [Ranges(p) for p in out]


def file_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


class HeadedReader(DataSourceReader):
    def __init__(self, options):
        self.uri = options["path"]
        self.pattern = options.get("pathGlobFilter", options.get("pathglobfilter", "*.csv"))
        self.most = int(options.get("maxPartitionBytes", options.get("maxpartitionbytes", 128 << 20)))

    def partitions(self) -> list[Ranges]:
        store, root = file_store(self.uri)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        visible = lambda f: not any(p[:1] in ("_", ".") for p in f.path[len(root) :].split("/"))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and visible(f) and fnmatch.fnmatch(f.base_name, self.pattern))
        return packed(files, self.most)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = file_store(self.uri)
        files: list[tuple[str, list[str]]] = []
        rows: list[tuple[int, int, list[str]]] = []
        for path, start, end in partition.parts:
            with store.open_input_file(path) as raw:
                names, size = None, raw.size()
                for at, text in of_small(raw.read()) if not start and end >= size <= SMALL else of_range(io.BufferedReader(raw), start, end):
                    if names is None:
                        names = text
                        files.append((path, names))
                        continue
                    rows.append((len(files) - 1, at, text))
                    if len(rows) == ROWS:
                        yield batch(files, rows)
                        files, rows = files[-1:], []
        if rows:
            yield batch(files, rows)


def of_small(data: bytes) -> Iterator[tuple[int, list[str]]]:
    """The same of a whole file."""
    plain, at = b'"' not in data and b"\xef\xbb\xbf" not in data, 0
    for line in data.split(b"\n"):
        if at == 0 and data or line.strip():
            yield at, line.decode("utf-8", "replace").rstrip("\r").split(",") if plain and line.rstrip(b"\r") else cells(line)
        at += len(line) + 1


def of_range(lines: io.BufferedReader, start: int, end: int) -> Iterator[tuple[int, list[str]]]:
    """(first byte, cells) of the header and of the lines that begin inside a range of bytes; blank lines are left out."""
    header = lines.readline()
    if header:
        yield 0, cells(header)
    if start > len(header):
        lines.seek(start - 1)
        lines.readline()  # the line that began before the range
    while (at := lines.tell()) < end and (line := lines.readline()):
        if line.strip():
            yield at, cells(line)


def cells(line: bytes) -> list[str]:
    return next(csv.reader([line.decode("utf-8-sig", "replace").rstrip("\r\n")]), [])


def batch(files: list[tuple[str, list[str]]], rows: list[tuple[int, int, list[str]]]) -> pa.RecordBatch:
    """Rows (file, first byte, cells) of several files (path, names)."""
    lists, of = pa.list_(pa.string()), pa.array([r[0] for r in rows], pa.int32())
    offsets = np.cumsum([0, *(len(r[2]) for r in rows)], dtype=np.int32)
    all_cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array([c for r in rows for c in r[2]], pa.string()))
    columns = [pa.array([f[0] for f in files], pa.string()).take(of), pa.array([r[1] for r in rows], pa.int64()), pa.array([f[1] for f in files], lists).take(of), all_cells.cast(lists)]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema([("file", pa.string()), ("line", pa.int64()), ("names", lists), ("cells", lists)]))


class FolderWriter(DataSourceArrowWriter):
    """Rows (folder, line) that are sorted by folder, as a file in each folder. A task that is repeated replaces its files by equal ones."""

    def __init__(self, options):
        self.uri, self.header, self.name = options["path"], options["header"], f"part-{uuid.uuid4().hex}.csv"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = file_store(self.uri)
        now, out, made = None, None, f"_{uuid.uuid4().hex}"
        for b in batches:
            folders, lines = b.column(0), b.column(1).to_pylist()
            runs = folders.to_pylist()
            cuts = [0, *(k for k in range(1, len(runs)) if runs[k] != runs[k - 1]), len(runs)]
            for first, behind in zip(cuts, cuts[1:]):
                if first == behind:
                    continue
                if runs[first] != now:
                    self.close(store, root, now, out, made)
                    now = runs[first]
                    store.create_dir(f"{root}/{now}", recursive=True)
                    out = store.open_output_stream(f"{root}/{now}/{made}")
                    out.write(f"{self.header}\n".encode())
                out.write("".join(f"{x}\n" for x in lines[first:behind]).encode())
        self.close(store, root, now, out, made)
        return WriterCommitMessage()

    def close(self, store: fs.FileSystem, root: str, folder: str | None, out: pa.NativeFile | None, made: str) -> None:
        if out:
            out.close()
            store.move(f"{root}/{folder}/{made}", f"{root}/{folder}/{self.name}")


class HeadedCsv(DataSource):
    """Format "headed_csv". Options: path (a folder, read with all below it), pathGlobFilter (names of files), maxPartitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "headed_csv"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeadedReader:
        return HeadedReader(self.options)

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options)


def read_headed(spark: SparkSession, folder: str, pattern: str = "*.csv", **options) -> DataFrame:
    """file, line (its first byte, which orders the lines of a file), names and cells of all rows of the CSV files below a folder. Empty files and files with a header only give no rows."""
    spark.dataSource.register(HeadedCsv)
    return spark.read.format("headed_csv").options(pathGlobFilter=pattern, **options).load(folder)


def write_headed(rows: DataFrame, path: str, folder: str, order: list[str]) -> None:
    """A CSV file with a header for each value of a column, in a folder name=value, its rows in order. Later calls add files. A folder's rows pass one task, line by line."""
    rows.sparkSession.dataSource.register(HeadedCsv)
    columns = [c for c in rows.columns if c != folder]
    header = io.StringIO()
    csv.writer(header, lineterminator="").writerow(columns)
    value = F.coalesce(F.nullif(F.col(folder).cast("string"), F.lit("")), F.lit(NO_VALUE))
    plain = value
    for c in "%\"#'*/:=?\\{}[]^":  # as Spark escapes them
        value = F.replace(value, F.lit(c), F.lit(f"%{ord(c):02X}"))
    name = F.concat(F.lit(f"{folder}="), F.when(plain.rlike("[^A-Za-z0-9_.-]"), value).otherwise(plain))
    sorted_rows = rows.repartition(folder).sortWithinPartitions(folder, *order)
    lines = sorted_rows.select(name.alias("folder"), F.to_csv(F.struct(*columns), {"escape": '"'}).alias("line"))
    lines.write.format("headed_csv").option("header", header.getvalue()).mode("append").save(path)
