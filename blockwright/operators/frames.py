"""Blocks of whole images as rows: chroma at full size, gray rasters, and the parameters of a job.

Blocks of all planes lie in one table with a column plane: y, cb, cr. Chroma may be halved
across (422) or both ways (420); the grid of blocks then covers whole units of 16 pixels, as
the codec does. Images are cut into blocks and put together again in strips.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwright.functions import scalars as S

PLANES = ("y", "cb", "cr")
# Error codes of a compress job's parameters.
ERRORS = {"SUCCESS": 0, "NULL_POINTER": -1, "INVALID_DIMENSIONS": -2, "ALLOCATION_FAILED": -3, "INVALID_METHOD": -4, "INVALID_COLORSPACE": -5, "INVALID_FRAME": -6, "BUFFER_TOO_SMALL": -7, "INVALID_SUBSAMPLING": -8, "INVALID_QUALITY": -9}


def halves(subsampling: str) -> tuple[int, int]:
    """How often chroma is halved down and across."""
    return {"444": (0, 0), "422": (0, 1), "420": (1, 1)}[subsampling]


def upsampled(block: Column, down: int, across: int) -> Column:
    """The blocks that a chroma block stands for, row by row: each sample for 2 x 1 or 2 x 2 pixels."""
    def part(dy: int, dx: int) -> Column:
        source = [((dy * 4 + p // 8 // 2) if down else p // 8) * 8 + ((dx * 4 + p % 8 // 2) if across else p % 8) for p in range(64)]
        return F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.array(*[block[i] for i in source]).alias("b"))

    return F.array(*[part(dy, dx) for dy in range(1 + down) for dx in range(1 + across)])


def at_full_size(blocks: DataFrame, keys: list[str], subsampling: str) -> DataFrame:
    """Blocks of the chroma planes at the size of luma; no join, each becomes one, two or four."""
    down, across = halves(subsampling)
    chroma = blocks.where("plane <> 'y'").select(*keys, "plane", "brow", "bcol", F.explode(upsampled(F.col("b"), down, across)).alias("u"))
    chroma = chroma.select(*keys, "plane", (F.shiftleft("brow", down) + F.col("u.dy")).alias("brow"), (F.shiftleft("bcol", across) + F.col("u.dx")).alias("bcol"), F.col("u.b").alias("b"))
    return blocks.where("plane = 'y'").select(*keys, "plane", "brow", "bcol", "b").unionByName(chroma)


def to_gray(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, v from luma blocks, cut to w by h."""
    p = blocks.select(*keys, "brow", "bcol", F.posexplode("b").alias("pos", "s"))
    y, x = F.col("brow") * 8 + F.shiftright("pos", 3), F.col("bcol") * 8 + F.col("pos").bitwiseAND(7)
    return p.select(*keys, y.alias("y"), x.alias("x"), S.clamp(F.col("s") + 128).alias("v")).where("y < h AND x < w")


def parameter_error(image: Column, width: Column, height: Column, method: Column, colorspace: Column, subsampling: Column, k: Column) -> Column:
    """Error code of a compress job, 0 if there is none: methods 0-5, colour spaces 0 (RGB) and 1 (gray), subsampling 0-2, finite k in (0, 32]."""
    finite = ~F.isnan(k) & (F.abs(k) != float("inf"))
    code = lambda ok, name: F.when(~F.coalesce(ok, F.lit(False)), F.lit(ERRORS[name]))
    return F.coalesce(
        code(image.isNotNull(), "NULL_POINTER"), code((width > 0) & (height > 0), "INVALID_DIMENSIONS"), code(method.between(0, 5), "INVALID_METHOD"), code(colorspace.isin(0, 1), "INVALID_COLORSPACE"),
        code(subsampling.between(0, 2), "INVALID_SUBSAMPLING"), code(finite & (k > 0) & (k <= 32), "INVALID_QUALITY"), F.lit(0),
    )
