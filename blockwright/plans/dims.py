"""Dimension tables and fixed values of the study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Methods in their order, their ids in the codec and on the wire, multiplications per one-dimensional transform.
METHODS = [("loeffler", 0, 1, 11), ("matrix", 1, 2, 64), ("rdct", 2, 3, 0), ("silveira_j3", 3, 4, 0), ("silveira_j7", 4, 5, 0)]
METHOD_NAMES = [m[0] for m in METHODS]
# Quality factors.
K_VALUES = [0.1, 0.2, 0.5, 0.8]
# 50 % quantization tables, luma and chroma, and the zigzag scan.
Q50_LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
Q50_CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
# Rows of the integer transforms, the weights and divisors of their inverses, and row norms times 1024.
BASIS = {
    "rdct": [[1, 1, 1, 1, 1, 1, 1, 1], [1, 1, 1, 0, 0, -1, -1, -1], [1, 0, 0, -1, -1, 0, 0, 1], [1, 0, -1, -1, 1, 1, 0, -1], [1, -1, -1, 1, 1, -1, -1, 1], [1, -1, 0, 1, -1, 0, 1, -1], [0, -1, 1, 0, 0, 1, -1, 0], [0, -1, 1, -1, 1, -1, 1, 0]],
    "silveira_j3": [[1, 1, 1, 1, 1, 1, 1, 1], [1, 1, 0, 0, 0, 0, -1, -1], [1, 0, 0, -1, -1, 0, 0, 1], [0, 0, -1, -1, 1, 1, 0, 0], [1, -1, -1, 1, 1, -1, -1, 1], [1, -1, 0, 0, 0, 0, 1, -1], [0, -1, 1, 0, 0, 1, -1, 0], [0, 0, 1, -1, 1, -1, 0, 0]],
    "silveira_j7": [[2, 2, 2, 2, 2, 2, 2, 2], [2, 2, 1, 0, 0, -1, -2, -2], [2, 0, 0, -2, -2, 0, 0, 2], [1, 0, -2, -2, 2, 2, 0, -1], [2, -2, -2, 2, 2, -2, -2, 2], [2, -2, 0, 1, -1, 0, 2, -2], [0, -2, 2, 0, 0, 2, -2, 0], [0, -1, 2, -2, 2, -2, 1, 0]],
}
INVERSE = {"rdct": ([3, 4, 6, 4, 3, 4, 6, 4], 24), "silveira_j3": ([1, 2, 2, 2, 1, 2, 2, 2], 8), "silveira_j7": ([9, 16, 18, 16, 9, 16, 18, 16], 288)}
NORMS = {"rdct": [2896, 2508, 2048, 2508, 2896, 2508, 2048, 2508], "silveira_j3": [2896, 2048, 2048, 2048, 2896, 2048, 2048, 2048], "silveira_j7": [5792, 4344, 4096, 4344, 5792, 4344, 4096, 4344]}


def zigzag() -> list[int]:
    """Raster positions in zigzag order: along the anti-diagonals, in turns up and down."""
    return sorted(range(64), key=lambda p: (s := p // 8 + p % 8, p // 8 if s % 2 else p % 8))


def scaled_k(k: float) -> int:
    """k as a whole number of 1/1024, rounded."""
    return int(k * 1024 + 0.5)


def methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *m) for i, m in enumerate(METHODS)], "method_ord int, method string, codec_id int, wire_id int, multiplications int")


def kfactors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, f"{k:g}", round(k * 100)) for i, k in enumerate(K_VALUES)], "k_idx int, k double, k_label string, k_fixed8 int")


def grid(spark: SparkSession) -> DataFrame:
    """All pairs of method and k, 20 rows."""
    return methods(spark).select("method_ord", "method").crossJoin(kfactors(spark).select("k_idx", "k", "k_label"))


def array_of(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


#: The same tables for the oracle.
METHODS_SQL = "methods(method_ord, method, codec_id, wire_id, multiplications) AS (VALUES " + ", ".join(f"({i}, '{m}', {c}, {w}, {x})" for i, (m, c, w, x) in enumerate(METHODS)) + ")"
KFACTORS_SQL = "kfactors(k_idx, k, k_label, k_fixed8) AS (VALUES " + ", ".join(f"({i}, {k}::DOUBLE, '{k:g}', {round(k * 100)})" for i, k in enumerate(K_VALUES)) + ")"
GRID_SQL = f"{METHODS_SQL}, {KFACTORS_SQL}, grid AS (SELECT method_ord, method, k_idx, k, k_label FROM methods, kfactors)"
