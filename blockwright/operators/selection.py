"""Exact quantiles of groups of any size, without a group in one task.

Equal values are counted before they travel. The counted values are sorted by range over
keys and value, so a large group lies in many parts; a small table of counts by group and
part says in which part the wanted places are, and only those parts are looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockwright.sources.sinks import scratch


def at_places(rows: DataFrame, keys: list[str], value: str, places: list[Column], parts: int | None = None) -> DataFrame:
    """keys, n, v0, v1, ...: the values at places (expressions of n, the number of values of a group, counted from 0). Nulls are no values; groups without values come with n 0 and nulls."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    path = scratch(spark)
    counted.where(F.col(value).isNotNull()).repartitionByRange(parts, *keys, value).withColumn("part", F.spark_partition_id()).write.parquet(path)  # bounds are drawn once
    dealt = spark.read.parquet(path)
    by_part = dealt.groupBy(*keys, "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(*keys).orderBy("part")
    whole = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    begun = by_part.select(*keys, "part", (F.sum("n").over(before) - F.col("n")).alias("begin"), F.sum("n").over(before).alias("end"), F.sum("n").over(whole).alias("total"))
    ranks = begun.withColumn("n", F.col("total")).withColumn("ranks", F.array(*[p.cast("bigint") for p in places]))
    inside = ranks.where(F.exists("ranks", lambda r: (r >= F.col("begin")) & (r < F.col("end")))).select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], F.col("part").alias("__part"), "begin", "total", "ranks")
    same = F.col("part") == F.col("__part")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__{i}"))
    run = F.col("begin") + F.sum("n").over(Window.partitionBy(*keys, "part").orderBy(value))
    found = dealt.join(inside, same).select(*keys, value, "n", "total", "ranks", run.alias("until"))
    hit = [F.max(F.when((F.col("ranks")[i] < F.col("until")) & (F.col("ranks")[i] >= F.col("until") - F.col("n")), F.col(value))).alias(f"v{i}") for i in range(len(places))]
    values = found.groupBy(*keys).agg(F.max("total").alias("n"), *hit)
    groups = counted.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]).distinct()
    both = F.lit(True)
    for i, k in enumerate(keys):
        both &= F.col(k).eqNullSafe(F.col(f"__{i}"))
    return groups.join(values, both, "left").select(*[F.col(f"__{i}").alias(k) for i, k in enumerate(keys)], F.coalesce("n", F.lit(0)).alias("n"), *[f"v{i}" for i in range(len(places))])


def median(rows: DataFrame, keys: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """keys and the exact median of value: the middle value, or the mean of the two in the middle."""
    n = F.col("n")
    found = at_places(rows, keys, value, [F.floor((n - 1) / 2), F.floor(n / 2)], parts)
    return found.select(*keys, ((F.col("v0").cast("double") + F.col("v1").cast("double")) / 2).alias(name))
