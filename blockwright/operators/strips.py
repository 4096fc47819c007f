"""Images as strips: one row holds 16 rows of pixels as bytes, so pixels never travel on their own.

A strip is (keys, w, h, top, data, mask): its image's size, its first row, the bytes of its
pixels row by row (red, green, blue), and a byte for each pixel that says whether it is
there; a null mask means that all are. Sixteen rows are a whole unit of every chroma
subsampling, so a strip is cut into blocks, compressed, decompressed and put together again
inside one task. Only windows that reach into the next strip need rows from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwright.functions import scalars as S
from blockwright.operators import codec
from blockwright.operators.frames import PLANES, halves
from blockwright.operators.memory import lean
from blockwright.operators.quality import C1, C2, WINDOW

ROWS = 16
#: Strips that a task has in hand at a time, and rows that it gives back at a time.
AT_ONCE, ROWS_OUT = 64, 512
#: Pixels that are worked on at a time; a wider strip is a lot of its own.
LOT = 1 << 16
LAYOUT = "w int, h int, top int, data binary, mask binary"


def rounded_mean(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Half away from zero; 0 where there is nothing."""
    n = np.maximum(n, 1)
    return np.sign(total) * ((2 * np.abs(total) + n) // (2 * n))


def to_planes(rgb: np.ndarray, mask: np.ndarray, subsampling: str) -> list[np.ndarray]:
    """Level-shifted luma, and chroma as the rounded mean of the pixels that are there; 0 where there are none. rgb: rows by w by 3."""
    down, across = halves(subsampling)
    r, g, b = (rgb[:, :, i].astype(np.int32) for i in range(3))
    y, cb, cr = ((77 * r + 150 * g + 29 * b + 128) >> 8) - 128, (-43 * r - 85 * g + 128 * b + 128) >> 8, (128 * r - 107 * g - 21 * b + 128) >> 8
    if down + across:
        edge = [(0, -len(rgb) % (1 << down)), (0, -rgb.shape[1] % (1 << across))]

        def units(v: np.ndarray) -> np.ndarray:
            v = np.pad(v, edge)
            return v.reshape(len(v) >> down, 1 << down, -1, 1 << across).sum((1, 3))

        n = units(mask.astype(np.int32))
        cb, cr = (rounded_mean(units(v * mask), n) for v in (cb, cr))
        return [y * mask, cb, cr]
    return [y * mask, cb * mask, cr * mask]


def grid(rows: int, w: int, subsampling: str, plane: str) -> tuple[int, int]:
    """Rows and columns of blocks that a strip's plane has: whole units."""
    down, across = halves(subsampling)
    high, wide = -(-rows // (8 << down)), -(-w // (8 << across))
    return (high << down, wide << across) if plane == "y" else (high, wide)


def cut(plane: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Blocks of 64 samples in raster order, row of blocks by row; zeros beyond the samples."""
    whole = np.zeros((8 * high, 8 * wide), np.int32)
    whole[: len(plane), : plane.shape[1]] = plane
    return whole.reshape(high, 8, wide, 8).transpose(0, 2, 1, 3).reshape(-1, 64)


def joined(blocks: np.ndarray, high: int, wide: int) -> np.ndarray:
    return blocks.reshape(high, wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * high, 8 * wide)


def to_rgb(planes: list[np.ndarray], rows: int, w: int, subsampling: str) -> np.ndarray:
    """Bytes of pixels from whole planes of samples; chroma samples stand for their pixels."""
    down, across = halves(subsampling)
    y, cb, cr = (p if not i else p.repeat(1 << down, 0).repeat(1 << across, 1) for i, p in enumerate(planes))
    y, cb, cr = (p[:rows, :w].astype(np.int32) for p in (y, cb, cr))
    return np.clip(np.stack([y + 128 + ((359 * cr + 128) >> 8), y + 128 - ((88 * cb + 183 * cr + 128) >> 8), y + 128 + ((454 * cb + 128) >> 8)], 2), 0, 255).astype(np.uint8)


def pixels_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Pixels and mask of a strip."""
    rows = min(ROWS, row["h"] - row["top"])
    mask = np.ones((rows, row["w"]), bool) if row["mask"] is None else np.frombuffer(row["mask"], bool).reshape(rows, row["w"])
    return np.frombuffer(row["data"], np.uint8).reshape(rows, row["w"], 3), mask


def lots(rows: Iterator[dict]) -> Iterator[list[dict]]:
    """Strips in lots of LOT pixels at most."""
    lot, size = [], 0
    for row in rows:
        n = ROWS * row["w"]
        if lot and size + n > LOT:
            yield lot
            lot, size = [], 0
        lot.append(row)
        size += n
    if lot:
        yield lot


def side_by_side(lot: list[dict], unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strips of a lot as one wide strip: pixels, mask, and the column of each strip and the end, whole units. What lies between strips and below short ones isn't there."""
    at = np.cumsum([0, *[-(-row["w"] // unit) * unit for row in lot]])
    rgb, mask = np.zeros((ROWS, at[-1], 3), np.uint8), np.zeros((ROWS, at[-1]), bool)
    for row, x in zip(lot, at):
        v, there = pixels_of(row)
        rgb[: len(v), x : x + row["w"]], mask[: len(v), x : x + row["w"]] = v, there
    return rgb, mask, at


def in_strips(df: DataFrame, out: str, work: Callable[[dict], Iterator[dict]] | Callable[[list[dict]], Iterator[dict]], in_lots: bool = False) -> DataFrame:
    """work on each row, or on each lot of strips; its results as rows of the layout out, a few strips at a time.

    Strips are small, so what calls NumPy often for each should take lots. What is done to the result of another in_strips() is done in the same worker, strip by
    strip: a chain of steps has one worker a task, and nothing between steps is kept.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    source, before = getattr(df, "strip_steps", (df, ()))
    steps = (*before, (work, in_lots))
    schema = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                rows = iter(batch.slice(at, AT_ONCE).to_pylist())
                for step, many in steps:
                    rows = chain.from_iterable(map(step, lots(rows) if many else rows))
                while found := list(islice(rows, ROWS_OUT)):
                    yield pa.RecordBatch.from_pydict({f.name: pa.array([r[f.name] for r in found], f.type) for f in schema}, schema=schema)

    made = source.mapInArrow(lean(run), out)
    made.strip_steps = source, steps
    return made


def kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def from_rasters(images: DataFrame, keys: list[str]) -> DataFrame:
    """Strips of whole rasters (keys, w, h, data): files that were read whole are cut inside their task."""

    def work(row):
        size = 3 * row["w"] * ROWS
        for top in range(0, row["h"], ROWS):
            yield {k: row[k] for k in (*keys, "w", "h")} | {"top": top, "data": row["data"][size * (top // ROWS) : size * (top // ROWS + 1)], "mask": None}

    return in_strips(images.select(*keys, "w", "h", "data"), f"{kinds(images, keys)}, {LAYOUT}", work)


def blocks(strips: DataFrame, keys: list[str], subsampling: str = "444", channel: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """keys, w, h, plane, brow, bcol, b: blocks of all planes; or of one plane of any value of red, green and blue (whole numbers)."""

    def work(row):
        rgb, mask = pixels_of(row)
        planes = to_planes(rgb, mask, subsampling) if channel is None else [channel(*(rgb[:, :, i].astype(np.int64) for i in range(3))) * mask]
        for name, plane in zip(PLANES, planes):
            high, wide = grid(*rgb.shape[:2], subsampling, name)
            top = row["top"] // 8 if name == "y" else row["top"] // 8 >> halves(subsampling)[0]
            for i, b in enumerate(cut(plane, high, wide)):
                yield {k: row[k] for k in (*keys, "w", "h")} | {"plane": name, "brow": top + i // wide, "bcol": i % wide, "b": b}

    return in_strips(strips, f"{kinds(strips, keys)}, w int, h int, plane string, brow int, bcol int, b array<bigint>", work)


def tables(method: str, k: float, plain: bool) -> list[list[int] | None]:
    """The tables of luma and chroma; None where levels are the coefficients."""
    return [None, None] if plain or method == "identity" else [codec.quant_table(method, k, chroma) for chroma in (False, True)]


def levels_of(rgb: np.ndarray, mask: np.ndarray, forth, both: list, subsampling: str) -> list[np.ndarray]:
    out = []
    for name, plane in zip(PLANES, to_planes(rgb, mask, subsampling)):
        c = forth(cut(plane, *grid(*rgb.shape[:2], subsampling, name)))
        table = both[name != "y"]
        out.append(np.asarray(c if table is None else codec.quantized(c, table), np.int32))
    return out


def restored(levels: list[np.ndarray], rows: int, w: int, back, both: list, subsampling: str) -> np.ndarray:
    planes = []
    for name, q in zip(PLANES, levels):
        table = both[name != "y"]
        planes.append(joined(back(q if table is None else q * np.array(table, np.int32)), *grid(rows, w, subsampling, name)))
    return to_rgb(planes, rows, w, subsampling)


def compress(strips: DataFrame, keys: list[str], method: str, k: float, subsampling: str = "444", skip_quantization: bool = False, gray: bool = False) -> DataFrame:
    """The compress job: keys, w, h, top, levels, the levels of a strip's blocks plane by plane as 32-bit integers. The identity is never quantized. gray: of an image whose channels are alike, luma only."""
    forth, both = codec.kernel(method), tables(method, k, skip_quantization)

    def work(row):
        levels = levels_of(*pixels_of(row), forth, both, subsampling)[: 1 if gray else 3]
        yield {n: row[n] for n in (*keys, "w", "h", "top")} | {"levels": b"".join(q.astype("<i4").tobytes() for q in levels)}

    return in_strips(strips, f"{kinds(strips, keys)}, w int, h int, top int, levels binary", work)


def planes_of(row: dict, subsampling: str) -> list[np.ndarray]:
    """Blocks of levels of the three planes of a strip."""
    rows, at, out = min(ROWS, row["h"] - row["top"]), 0, []
    for name in PLANES:
        if at == len(row["levels"]):
            break  # gray
        high, wide = grid(rows, row["w"], subsampling, name)
        out.append(np.frombuffer(row["levels"], "<i4", 64 * high * wide, at).reshape(-1, 64))
        at += 256 * high * wide
    return out


def level_blocks(compressed: DataFrame, keys: list[str], subsampling: str = "444") -> DataFrame:
    """keys, w, h, plane, brow, bcol, q of compressed strips."""

    def work(row):
        rows = min(ROWS, row["h"] - row["top"])
        for name, q in zip(PLANES, planes_of(row, subsampling)):
            _, wide = grid(rows, row["w"], subsampling, name)
            top = row["top"] // 8 if name == "y" else row["top"] // 8 >> halves(subsampling)[0]
            for i, b in enumerate(q):
                yield {k: row[k] for k in (*keys, "w", "h")} | {"plane": name, "brow": top + i // wide, "bcol": i % wide, "q": b}

    return in_strips(compressed, f"{kinds(compressed, keys)}, w int, h int, plane string, brow int, bcol int, q array<int>", work)


def decompress(compressed: DataFrame, keys: list[str], method: str, k: float, subsampling: str = "444", skip_quantization: bool = False) -> DataFrame:
    """The decompress job: strips again, with every pixel there."""
    back, both = codec.kernel(method, True), tables(method, k, skip_quantization)

    def work(row):
        rgb = restored(planes_of(row, subsampling), min(ROWS, row["h"] - row["top"]), row["w"], back, both, subsampling)
        yield {n: row[n] for n in (*keys, "w", "h", "top")} | {"data": rgb.tobytes(), "mask": None}

    return in_strips(compressed, f"{kinds(compressed, keys)}, {LAYOUT}", work)


def round_trips(strips: DataFrame, keys: list[str], cases: list[tuple[str, int, float]], subsampling: str = "444") -> DataFrame:
    """Strips beside what each case (method, k_idx, k) makes of them: keys, w, h, top, method, k_idx, data, mask, other, stream_bytes. A lot of strips is transformed once for each method."""
    jobs = {}
    for method, k_idx, k in cases:
        jobs.setdefault(method, (codec.kernel(method), codec.kernel(method, True), []))[2].append((k_idx, tables(method, k, False)))
    _, across = halves(subsampling)

    def work(lot):
        rgb, mask, at = side_by_side(lot, 8 << across)
        rows = [min(ROWS, row["h"] - row["top"]) for row in lot]
        grids = [grid(ROWS, at[-1], subsampling, name) for name in PLANES]
        samples = np.concatenate([cut(p, *g) for p, g in zip(to_planes(rgb, mask, subsampling), grids)])
        ends = np.cumsum([high * wide for high, wide in grids])
        own = []  # for each plane: which blocks are of a strip, and the first block of each strip and the end
        for name, (high, wide) in zip(PLANES, grids):
            first = at // (8 if name == "y" else 8 << across)
            highs = np.repeat([grid(n, row["w"], subsampling, name)[0] for n, row in zip(rows, lot)], np.diff(first))
            own.append((np.arange(high)[:, None] < highs, first))
        for method, (forth, back, some) in jobs.items():
            c = forth(samples)
            for k_idx, both in some:
                parts = [x if t is None else codec.quantized(x, t) for x, t in zip(np.split(c, ends[:1]), both)]
                sizes = np.split(np.concatenate([run_length_bytes(q) for q in parts]), ends[:-1])
                stream_bytes = sum(between((n.reshape(g) * there).sum(0), first) for n, g, (there, first) in zip(sizes, grids, own))
                d = back(np.concatenate([q if t is None else q * np.array(t, np.int32) for q, t in zip(parts, both)]))
                other = to_rgb([joined(p, *g) for p, g in zip(np.split(d, ends[:-1]), grids)], ROWS, at[-1], subsampling)
                for row, n, x, size in zip(lot, rows, at, stream_bytes):
                    yield row | {"method": method, "k_idx": k_idx, "other": other[:n, x : x + row["w"]].tobytes(), "stream_bytes": int(size)}

    return in_strips(strips, f"{kinds(strips, keys)}, {LAYOUT}, method string, k_idx int, other binary, stream_bytes bigint", work, True)


def between(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the whole numbers v from each place to the next."""
    return np.diff(np.concatenate([[0], v.cumsum(dtype=np.int64)])[at])


def run_length_bytes(levels: np.ndarray) -> np.ndarray:
    """Of each block: two bytes, three for each level behind the first that isn't zero, three for an end that isn't the last place. The first and last places of the scan are those of the raster."""
    return 2 + 3 * np.count_nonzero(levels[:, 1:], 1) + 3 * (levels[:, 63] == 0)


def long(strips: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, r, g, b: a row for each pixel that is there."""

    def work(row):
        rgb, mask = pixels_of(row)
        y, x = np.nonzero(mask)
        v = rgb[y, x]
        yield {k: row[k] for k in keys} | {"y": y + row["top"], "x": x} | {c: v[:, i] for i, c in enumerate("rgb")}

    lists = in_strips(strips, f"{kinds(strips, keys)}, " + ", ".join(f"{c} array<int>" for c in "yxrgb"), work)
    return lists.select(*keys, F.inline(F.arrays_zip(*"yxrgb")))


def with_below(pairs: DataFrame, keys: list[str], columns: list[str], rows: int = WINDOW - 1) -> DataFrame:
    """Strips with the first rows of the strip below (column_below, null at the lower edge). The only exchange of a window over whole images: six rows of sixteen travel beside the strip. A strip gives both from one reading, so what makes it runs once."""
    names = [c for c in pairs.columns if c not in (*keys, "top")]
    none = lambda c: F.lit(None).cast(pairs.schema[c].dataType)
    size = {c: F.col("w") * (1 if c == "mask" else 3) * F.least(F.lit(rows), F.col("h") - F.col("top")) for c in columns}
    own = F.struct("top", *names, *[none(c).alias(f"{c}_below") for c in columns])
    above = F.struct((F.col("top") - ROWS).alias("top"), *[none(c).alias(c) for c in names], *[F.substr(c, F.lit(1), size[c].cast("int")).alias(f"{c}_below") for c in columns])
    both = pairs.select(*keys, F.inline(F.when(F.col("top") > 0, F.array(own, above)).otherwise(F.array(own))))
    return both.groupBy(*keys, "top").agg(*[F.max(c).alias(c) for c in [*names, *[f"{c}_below" for c in columns]]]).where("w IS NOT NULL")


def boxes(v: np.ndarray, side: int = WINDOW) -> np.ndarray:
    """Sums over all side x side boxes, in 32 bits: of bytes or their products."""
    v = v.astype(np.int32, copy=False)
    rows, columns = (n - side + 1 for n in v.shape)
    v = sum(v[i : i + rows] for i in range(side))
    return sum(v[:, i : i + columns] for i in range(side))


def box_moments(lot: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Iterator[dict[str, np.ndarray]]]:
    """Strips of a lot, with the rows below them, side by side: pixels a (data) and b (other), which are there, the column of each strip and the end, which boxes (by their first pixel) are whole and of one strip, and for each channel the boxes' sums of a, b, aa, bb, ab."""
    at = np.cumsum([0, *[max(1, row["w"]) for row in lot]])
    size = (ROWS + WINDOW - 1, at[-1] + WINDOW - 1)
    a, b, mask, inside = np.zeros((*size, 3), np.uint8), np.zeros((*size, 3), np.uint8), np.zeros(size, bool), np.zeros(at[-1], bool)
    for row, x in zip(lot, at):
        w, n = row["w"], min(ROWS, row["h"] - row["top"])
        here = slice(x, x + w)
        a[:n, here], b[:n, here] = (np.frombuffer(row[c], np.uint8).reshape(n, w, 3) for c in ("data", "other"))
        mask[:n, here] = True if row["mask"] is None else np.frombuffer(row["mask"][: n * w], bool).reshape(n, w)
        if row["data_below"] and row["other_below"]:
            x_data, x_other = (np.frombuffer(row[f"{c}_below"], np.uint8).reshape(-1, w, 3) for c in ("data", "other"))
            below = slice(n, n + len(x_data))
            a[below, here], b[below, here] = x_data, x_other
            mask[below, here] = True if row["mask_below"] is None else np.frombuffer(row["mask_below"], bool).reshape(-1, w)
        inside[x : max(x, x + w - WINDOW + 1)] = True
    whole = (boxes(mask) == WINDOW * WINDOW) & inside
    wide = ((a[:, :, i].astype(np.int32), b[:, :, i].astype(np.int32)) for i in range(3))
    return a, b, mask, at, whole, ({"a": boxes(x), "b": boxes(y), "aa": boxes(x * x), "bb": boxes(y * y), "ab": boxes(x * y)} for x, y in wide)


def box_sums(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, channel, y, x, a, b, aa, bb, ab: sums over the 7 x 7 boxes of strips data and other, at the box's middle; only boxes that lie inside the image."""

    def work(lot):
        *_, at, whole, channels = box_moments(lot)
        for channel, sums in enumerate(channels):
            for row, start, end in zip(lot, at, at[1:]):
                y, x = np.nonzero(whole[:, start:end])
                yield {k: row[k] for k in keys} | {"channel": channel, "y": y + row["top"] + WINDOW // 2, "x": x + WINDOW // 2} | {c: v[y, x + start] for c, v in sums.items()}

    lists = in_strips(with_below(pairs, keys, ["data", "other", "mask"]), f"{kinds(pairs, keys)}, channel int, y array<int>, x array<int>, " + ", ".join(f"{c} array<bigint>" for c in ("a", "b", "aa", "bb", "ab")), work, True)
    return lists.select(*keys, "channel", F.inline(F.arrays_zip("y", "x", "a", "b", "aa", "bb", "ab")))


def compared(beside: DataFrame, keys: list[str], totals: list[str]) -> DataFrame:
    """keys, sums of totals (whole numbers of each strip), sse, psnr, ssim, ssim_r, ssim_g, ssim_b of strips data and other with the rows below; the latter null where no strip has an other."""
    n, sums = WINDOW * WINDOW, {"sse": "bigint", "n": "bigint", "windows": "bigint", "s_r": "double", "s_g": "double", "s_b": "double"}

    def work(lot):
        own = lambda row: {k: row[k] for k in (*keys, *totals)}
        yield from (own(row) | dict.fromkeys(sums) for row in lot if row["other"] is None)
        if not (lot := [row for row in lot if row["other"] is not None]):
            return
        a, b, mask, at, whole, channels = box_moments(lot)
        d = (a[:ROWS].astype(np.int32) - b[:ROWS]) ** 2
        found = {"sse": between((d.sum(2) * mask[:ROWS]).sum(0), at), "n": between(3 * mask[:ROWS].sum(0), at), "windows": between(whole.sum(0), at)}
        for c, s in zip("rgb", channels):
            ma, mb = s["a"] / n, s["b"] / n
            va, vb, cov = ((s[m] - n * p * q) / (n - 1) for m, p, q in (("aa", ma, ma), ("bb", mb, mb), ("ab", ma, mb)))
            value = (2 * ma * mb + C1) * (2 * cov + C2) / ((ma * ma + mb * mb + C1) * (va + vb + C2))
            found[f"s_{c}"] = np.add.reduceat((value * whole).sum(0), at[:-1])
        for row, *values in zip(lot, *[v.tolist() for v in found.values()]):
            yield own(row) | dict(zip(found, values))

    parts = in_strips(beside, f"{kinds(beside, [*keys, *totals])}, " + ", ".join(f"{c} {kind}" for c, kind in sums.items()), work, True)
    g = parts.groupBy(*keys).agg(*[F.sum(c).cast("bigint" if c in totals else sums[c]).alias(c) for c in (*totals, *sums)])
    one = {c: F.when(F.col("windows") > 0, F.col(f"s_{c}") / F.col("windows")).when(F.col("windows") == 0, 1.0) for c in "rgb"}
    return g.select(*keys, *totals, "sse", S.psnr(F.col("sse"), F.col("n")).alias("psnr"), ((one["r"] + one["g"] + one["b"]) / 3).alias("ssim"), *[v.alias(f"ssim_{c}") for c, v in one.items()])


def distortion(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sse, psnr, ssim, ssim_r, ssim_g, ssim_b of strips data and other, over the pixels that are there.

    Squared errors stay whole to the last step. ssim is the mean of the channels, each the
    mean over all 7 x 7 windows with sample moments; an image without a window has 1.
    """
    return compared(with_below(pairs, keys, ["data", "other", "mask"]), keys, [])


def against_raw(records: DataFrame, raw: DataFrame, run: str, record: list[str]) -> DataFrame:
    """run, record columns, stream_bytes, frame_bytes, raw_bytes, ratio, psnr, ssim, status of compressed records beside their run's raw raster.

    records: strips (run, record columns, w, h, top, data, mask, stream_bytes); raw: at most
    one strip for each run and top. Strips meet by run and top, so the records of a long run
    are spread over its strips, and a large place is split by the join. What is met is read
    once, for the rows below, the sizes and the distortion together. A record whose run has
    no raw raster keeps its sizes, has neither ratio nor distortion, and the status
    REF_MISSING.
    """
    keys = [run, *record]
    met = records.select(*keys, "w", "h", "top", "data", "mask", "stream_bytes").join(raw.select(run, "top", F.col("data").alias("other")), [run, "top"], "left")
    beside = with_below(met, keys, ["data", "other", "mask"]).withColumn("raw_bytes", F.octet_length("other").cast("bigint"))
    out = compared(beside, keys, ["stream_bytes", "raw_bytes"])
    ratio: Column = F.when((F.col("raw_bytes") > 0) & (F.col("stream_bytes") > 0), F.col("raw_bytes") / F.col("stream_bytes"))
    return out.select(*keys, "stream_bytes", (F.col("stream_bytes") + 24).alias("frame_bytes"), "raw_bytes", ratio.alias("ratio"), "psnr", "ssim", F.when(F.col("raw_bytes").isNull(), "REF_MISSING").otherwise("DECODED").alias("status"))
