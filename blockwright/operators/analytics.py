"""Record analytics: validation, joins to the reference record, group statistics, comparison tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockwright.plans.dims import K_VALUES, METHOD_NAMES, METHODS

# Statuses that keep a record out of the global summary.
FAILED = ("CRC_FAIL", "DECODE_FAIL", "DECOMP_FAIL", "JPEG_SIZE_FAIL", "RAW_SIZE_FAIL", "OOM", "SD_FAIL", "REF_MISSING", "MODE_FAIL")


def in_grid(records: DataFrame, grid: DataFrame) -> DataFrame:
    """Records whose method and k belong to the study."""
    return records.join(F.broadcast(grid.select("method", "k_idx")), ["method", "k_idx"], "left_semi")


def complete(summary: DataFrame, grid: DataFrame) -> DataFrame:
    """One row for each method and k of the grid, metrics null where there is no group."""
    return F.broadcast(grid).join(summary.drop("k"), ["method", "k_idx"], "left")


def group_means(records: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("method", "k_idx")) -> DataFrame:
    return records.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def group_stats(records: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("method", "k_idx")) -> DataFrame:
    """Rows, and mean, sample deviation (0 for one value), least and greatest of each metric; missing values are left out."""
    stats = [(F.avg, "mean"), (lambda m: F.when(F.count(m) > 0, F.coalesce(F.stddev_samp(m), F.lit(0.0))), "std"), (F.min, "min"), (F.max, "max")]
    return records.groupBy(*keys).agg(F.count("*").alias("n"), *[f(m).alias(f"{m}_{s}") for m in metrics for f, s in stats])


def two_level_mean(records: DataFrame, metric: str) -> DataFrame:
    """Unweighted mean over k of the means by method and k; 0 if there is none."""
    return group_means(records, [metric]).groupBy("method").agg(F.coalesce(F.avg(metric), F.lit(0.0)).alias(metric))


def kernel_split(records: DataFrame, total: str, kernel: str) -> DataFrame:
    means = group_means(records, [total, kernel], ("method",))
    return means.select("method", F.col(kernel).alias("kernel"), F.greatest(F.lit(0.0), F.col(total) - F.col(kernel)).alias("other"))


def wide(summary: DataFrame, row: str, column: str, metric: str, values: list) -> DataFrame:
    return summary.groupBy(row).pivot(column, values).agg(F.first(metric))


def gain(summary: DataFrame, metrics: list[str], better: str = "silveira_j7", base: str = "rdct") -> DataFrame:
    """Differences of two methods by k; null where one side is missing."""
    side = lambda m: F.max(F.when(F.col("method") == m[0], F.col(m[1])))
    return summary.groupBy("k_idx").agg(*[(side((better, m)) - side((base, m))).alias(f"gain_{m}") for m in metrics])


def matrix_delta(records: DataFrame, metric: str = "psnr") -> DataFrame:
    """Each record beside the mean of the matrix method in its run and k, and the absolute difference."""
    w = Window.partitionBy("run_id", "k_idx")
    own = records.withColumn("matrix", F.avg(F.when(F.col("method") == "matrix", F.col(metric))).over(w))
    return own.withColumn("delta", F.abs(F.col(metric) - F.col("matrix")))


def with_reference(records: DataFrame, raw: DataFrame) -> DataFrame:
    """Each compressed record beside its run's raw record (run_id, raw_bytes, tx_raw_us): ratio and status."""
    j = records.join(raw, "run_id", "left")
    ratio = F.when((F.col("raw_bytes") > 0) & (F.col("stream_bytes") > 0), F.col("raw_bytes") / F.col("stream_bytes")).otherwise(F.lit(0.0))
    return j.withColumn("ratio", ratio).withColumn("status", F.when(F.col("raw_bytes").isNull(), "REF_MISSING").otherwise(F.col("status")))


def keep_summary_rows(records: DataFrame) -> DataFrame:
    """Rows that may go into the global summary: no status that starts with a failure. A null status passes."""
    failed = reduce(lambda a, b: a | b, [F.col("status").startswith(p) for p in FAILED])
    return records.where(~F.coalesce(failed, F.lit(False)))


def last_per_key(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    return records.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in records.columns if c not in keys]), order).alias("x")).select(*keys, "x.*")


def first_per_key(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    return records.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in records.columns if c not in keys]), order).alias("x")).select(*keys, "x.*")


def slot(method_ord: Column, k_idx: Column) -> Column:
    """0 is the raw record; compressed ones are 1 + 5 k_idx + method."""
    return F.when(method_ord < 0, F.lit(0)).otherwise(1 + 5 * k_idx + method_ord)


def order_in_run(records: DataFrame, name: str = "order_index", raw_first: bool = True) -> DataFrame:
    """Zero-based place of each record in its run: the raw one first or last, others by k, then method, then arrival."""
    raw = (F.col("mode") == "RAW").cast("int")
    w = Window.partitionBy("run_id").orderBy(-raw if raw_first else raw, "k_idx", method_place("method"), "ord")
    return records.withColumn(name, F.row_number().over(w) - 1)


def rotated(cases: DataFrame, image: str) -> DataFrame:
    """cases (image, k_idx, method) with method_turn, k_turn and place: methods are turned by the image's number, and k by that and the method's place among the turned ones."""
    method = F.pmod(method_place("method") - F.col(image), F.lit(len(METHOD_NAMES))).cast("int")
    k = F.pmod(F.col("k_idx") - F.col(image) - F.col("method_turn"), F.lit(len(K_VALUES))).cast("int")
    return cases.withColumn("method_turn", method).withColumn("k_turn", k).withColumn("place", len(K_VALUES) * F.col("method_turn") + F.col("k_turn"))


def usable(results: DataFrame) -> DataFrame:
    """Results of images that didn't fail: a failed one has a negative PSNR, or none."""
    return results.where("psnr >= 0")


def numbered(rows: DataFrame, by: str, spans: int = 64) -> DataFrame:
    """rows with place, from 1 in the order of a unique number: numbered inside spans between quantiles, and moved on by the sizes of the spans before, so no task orders all rows."""
    cuts = sorted(set(rows.approxQuantile(by, [i / spans for i in range(1, spans)], 0.002)))  # at most spans numbers
    span = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(by))) if cuts else F.lit(0)
    spread = rows.withColumn("__span", span)
    sizes = spread.groupBy("__span").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each span
    place = F.row_number().over(Window.partitionBy("__span").orderBy(by)) + F.col("__before")
    return spread.join(F.broadcast(sizes.select("__span", before.alias("__before"))), "__span").withColumn("place", place).drop("__span", "__before")


def method_place(column: str) -> Column:
    """Place of a method in the study's order; unknown ones come last."""
    return F.coalesce(*[F.when(F.col(column) == m, F.lit(i)) for i, m in enumerate(METHOD_NAMES)], F.lit(999))


def settled(frames: DataFrame, value: str, most: float, times: int, within: int) -> DataFrame:
    """For each run the first frame at which the value has moved by at most `most` that many times in a row, or the last frame looked at."""
    w = Window.partitionBy("run_id").orderBy("frame")
    f = frames.where(F.col("frame") < within).withColumn("step", F.abs(F.col(value) - F.lag(value).over(w)))
    calm = F.coalesce(F.col("step") <= most, F.lit(False))
    f = f.withColumn("island", F.sum((~calm).cast("int")).over(w))
    f = f.withColumn("streak", F.sum(calm.cast("int")).over(Window.partitionBy("run_id", "island").orderBy("frame")))
    return f.groupBy("run_id").agg(F.coalesce(F.min(F.when(F.col("streak") >= times, F.col("frame"))), F.max("frame")).alias("frame"))


def method_facts(rows: DataFrame, id_col: str) -> DataFrame:
    """rows with name, is_jpeg and method_index of a method id on the wire: 0 is raw; other ids than those of the study have no name, and -1."""
    ids = {w: (i, m) for i, (m, _, w, _) in enumerate(METHODS)}
    pick = lambda f: F.coalesce(*[F.when(F.col(id_col) == w, F.lit(f(x))) for w, x in ids.items()])
    name = F.when(F.col(id_col) == 0, "raw").otherwise(pick(lambda x: x[1]))
    return rows.withColumns({"name": name, "is_jpeg": F.coalesce(F.col(id_col).isin(*ids), F.lit(False)), "method_index": F.coalesce(pick(lambda x: x[0]), F.lit(-1))})


def reject_reason(slots: int = 21, width: int = 320, height: int = 240) -> Column:
    """Why a record's header can't belong to its run, by the first rule that it breaks; null if it may.

    Reads method_id, record_type (1 raw, 2 compressed), mode_type (1 raw, 2 compressed), k_idx,
    colorspace (0 RGB), subsampling (0 is 4:4:4, 255 none), width, height, order_index, expected
    (records of the run) and again (a record of the slot was there before).
    """
    c = F.col
    jpeg, raw_type, jpeg_type = c("method_id").between(1, 5), c("record_type") == 1, c("record_type") == 2
    rules = [
        ("method or k", ~((c("method_id") == 0) | (jpeg & (c("k_idx") < 4)))), ("mode of a raw record", raw_type & (c("mode_type") != 1)), ("method or subsampling of a raw record", raw_type & ((c("method_id") != 0) | (c("subsampling") != 255))),
        ("method or mode", jpeg_type & ((c("mode_type") != 2) | ~jpeg)), ("k", jpeg_type & (c("k_idx") >= 4)), ("not RGB 4:4:4", jpeg_type & ((c("colorspace") != 0) | (c("subsampling") != 0))), ("record type", ~(raw_type | jpeg_type)),
        ("colour space", c("colorspace") != 0), ("records expected", (c("expected") == 0) | (c("expected") > slots)), ("size", (c("width") != width) | (c("height") != height)), ("order", c("order_index") >= c("expected")), ("duplicate", c("again")),
    ]
    return F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules])


def shown(rows: DataFrame, key: str, order: str, text: Column, most: int) -> DataFrame:
    """key, order, text: the first rows of each key, and in place of the next a line with how many more there are."""
    own = Window.partitionBy(key)
    r = rows.select(key, order, text.alias("text"), F.row_number().over(own.orderBy(order)).alias("__n"), F.count("*").over(own).alias("__all")).where(F.col("__n") <= most + 1)
    more = F.concat(F.lit("+"), (F.col("__all") - most).cast("string"), F.lit(" more"))
    return r.select(key, order, F.when(F.col("__n") <= most, F.col("text")).otherwise(more).alias("text"))


def snapshot_differences(actual: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, cells, different, same: a table against its stored form, row by row."""
    j = actual.join(stored.withColumnsRenamed({c: f"__{c}" for c in columns}), key, "full")
    apart = sum((F.when(F.col(c).eqNullSafe(F.col(f"__{c}")), 0).otherwise(1) for c in columns), F.lit(0)).cast("bigint")
    return j.select(key, F.lit(len(columns)).cast("bigint").alias("cells"), apart.alias("different"), (apart == 0).alias("same"))


def consistent(records: DataFrame, columns: list[str]) -> DataFrame:
    """Runs whose records all have the same values in columns."""
    return records.groupBy("run_id").agg((F.count_distinct(F.struct(*columns)) == 1).alias("consistent"))
