"""8x8 blocks and pixels derived from the embeddings table.

A vector of 64 numbers is one block; 16 vectors make an image of 32 brow 32 pixels. The
second and third channel are the same samples at other positions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.functions.scalars import clamp
from blockwright.operators import strips

SIDE = 32


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, brow, bcol, v: 64 samples of 0 to 255 in raster order. Vectors of another length are left out."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("size(embedding) = 64")
    sample = lambda x: clamp(F.floor(x.cast("double") * 255 + 128.5)).cast("int")
    at = F.col("vec_id") % 16
    return e.select(F.floor(F.col("vec_id") / 16).alias("image"), F.floor(at / 4).cast("int").alias("brow"), (at % 4).cast("int").alias("bcol"), F.transform("embedding", sample).alias("v"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, brow, bcol, b: level-shifted samples."""
    return samples(spark, sf_dir).select("image", "brow", "bcol", F.transform("v", lambda x: x - 128).alias("b"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, y, x, r, g, b."""
    s = samples(spark, sf_dir).select("image", "brow", "bcol", "v", F.posexplode("v").alias("pos", "r"))
    other = lambda i: F.element_at("v", (i + 1).cast("int"))
    return s.select("image", (F.col("brow") * 8 + F.floor(F.col("pos") / 8)).cast("int").alias("y"), (F.col("bcol") * 8 + F.col("pos") % 8).alias("x"), "r", other(63 - F.col("pos")).alias("g"), other((F.col("pos") + 21) % 64).alias("b"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, w, h, y, x, r, g, b: images of 11 to 32 pixels a side, most of which end inside a block."""
    w, h = (32 - F.col("image") % 7 * 3).cast("int"), (32 - F.col("image") % 5 * 5).cast("int")
    return pixels(spark, sf_dir).select("image", w.alias("w"), h.alias("h"), "y", "x", "r", "g", "b").where("x < w AND y < h")


def frame_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same images as strips: image, w, h, top, data, mask; an image of which a part is missing has masks. The vectors of an image meet once, at most 16 of them."""
    s = samples(spark, sf_dir).groupBy("image").agg(F.collect_list(F.struct("brow", "bcol", "v")).alias("parts"))
    pos = np.arange(64)

    def work(row):
        w, h = 32 - row["image"] % 7 * 3, 32 - row["image"] % 5 * 5
        rgb, mask = np.zeros((SIDE, SIDE, 3), np.uint8), np.zeros((SIDE, SIDE), bool)
        for part in row["parts"]:
            v, at = np.array(part["v"], np.uint8), (slice(8 * part["brow"], 8 * part["brow"] + 8), slice(8 * part["bcol"], 8 * part["bcol"] + 8))
            rgb[at] = np.stack([v, v[63 - pos], v[(pos + 21) % 64]], 1).reshape(8, 8, 3)
            mask[at] = True
        rgb, mask = rgb[:h, :w], mask[:h, :w]
        for top in range(0, h if mask.any() else 0, strips.ROWS):
            end = top + strips.ROWS
            yield {"image": row["image"], "w": w, "h": h, "top": top, "data": rgb[top:end].tobytes(), "mask": None if mask.all() else mask[top:end].tobytes()}

    return strips.in_strips(s, f"image bigint, {strips.LAYOUT}", work)


SAMPLES_SQL = "samples AS (SELECT vec_id // 16 AS image, ((vec_id % 16) // 4)::INTEGER AS brow, (vec_id % 4)::INTEGER AS bcol, (i - 1)::INTEGER AS pos, greatest(0, least(255, floor(embedding[i]::DOUBLE * 255 + 128.5)))::INTEGER AS v FROM embeddings, range(1, 65) t(i) WHERE len(embedding) = 64)"
BLOCKS_SQL = SAMPLES_SQL + ", blocks AS (SELECT image, brow, bcol, pos, v - 128 AS v FROM samples)"
PIXELS_SQL = "pixels AS (SELECT image, (brow * 8 + i // 8)::INTEGER AS y, (bcol * 8 + i % 8)::INTEGER AS x, s[i + 1] AS r, s[64 - i] AS g, s[(i + 21) % 64 + 1] AS b FROM (SELECT vec_id // 16 AS image, (vec_id % 16) // 4 AS brow, vec_id % 4 AS bcol, [greatest(0, least(255, floor(e::DOUBLE * 255 + 128.5)))::INTEGER FOR e IN embedding] AS s, unnest(range(64)) AS i FROM embeddings WHERE len(embedding) = 64))"
FRAMES_SQL = PIXELS_SQL + ", frames AS (SELECT * FROM (SELECT *, (32 - image % 7 * 3)::INTEGER AS w, (32 - image % 5 * 5)::INTEGER AS h FROM pixels) WHERE x < w AND y < h)"
