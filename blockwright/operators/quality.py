"""Distortion between two rasters, exposure, and block geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwright.functions import scalars as S

#: Constants of the structural similarity for 8-bit samples, and the side of its window.
C1, C2, WINDOW = 6.5025, 58.5225, 7


def error(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b", exact: float = 100.0) -> DataFrame:
    """Sum of squared errors, mean squared error and PSNR by keys; sums stay whole to the last step."""
    d = (F.col(a) - F.col(b)).cast("bigint")
    g = pairs.groupBy(*keys).agg(F.sum(d * d).alias("sse"), F.count("*").alias("n"))
    return g.select(*keys, "sse", (F.col("sse") / F.col("n")).alias("mse"), S.psnr(F.col("sse"), F.col("n"), exact).alias("psnr"))


def ssim(ma: Column, mb: Column, va: Column, vb: Column, cov: Column) -> Column:
    return (2 * ma * mb + C1) * (2 * cov + C2) / ((ma * ma + mb * mb + C1) * (va + vb + C2))


def global_ssim(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """One value for each key from population moments."""
    g = pairs.groupBy(*keys).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.covar_pop(a, b).alias("cov"))
    return g.select(*keys, ssim(*[F.col(c) for c in ("ma", "mb", "va", "vb", "cov")]).alias("ssim"))


def brightness(pixels: DataFrame, keys: list[str], place: Column, every: int = 32) -> DataFrame:
    """Whole mean of the luma of every 32nd pixel."""
    luma = F.shiftright(306 * F.col("r") + 601 * F.col("g") + 117 * F.col("b"), 10)
    return pixels.where(place % every == 0).groupBy(*keys).agg(F.floor(F.sum(luma) / F.count("*")).cast("bigint").alias("brightness"))


def saturation(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Percent of pixels with any channel, all channels, and the mean near the upper end; and the mean gray."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    share = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    total = r + g + b  # stays whole to the last step
    return pixels.groupBy(*keys).agg(share(F.greatest(r, g, b) >= 250).alias("any_250"), share(F.least(r, g, b) >= 250).alias("all_250"), share(total >= 690).alias("gray_230"), (F.sum(total) / (3.0 * F.count("*"))).alias("gray"))


def geometry(width: Column, height: Column, subsampling: Column, gray: Column) -> tuple[Column, Column]:
    """Luma and chroma blocks of an image: blocks cover the edge, chroma units are 1, 2 or 2 x 2 blocks."""
    up = lambda x, d: F.floor((x + d - 1) / d)
    luma = up(width, 8) * up(height, 8)
    chroma = F.when(gray, 0).when(subsampling == "444", luma).when(subsampling == "422", up(width, 16) * up(height, 8)).otherwise(up(width, 16) * up(height, 16))
    full = F.when(gray | (subsampling == "444"), luma).when(subsampling == "422", 2 * chroma).otherwise(4 * chroma)
    return full, chroma


def codec_memory(width: Column, height: Column, subsampling: Column, keep: Column) -> Column:
    """Bytes that a codec job needs: its level blocks (twice with coefficients kept) or the image, whichever is more. subsampling may be gray."""
    luma, chroma = geometry(width, height, subsampling, subsampling == "gray")
    levels = 104 + 256 * (luma + 2 * chroma) * F.when(keep, 2).otherwise(1)
    return F.greatest(levels, 24 + width * height * F.when(subsampling == "gray", 1).otherwise(3)).cast("bigint")
