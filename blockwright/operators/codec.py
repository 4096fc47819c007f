"""Block transforms, quantization, run lengths and distortion over tables of blocks.

A block is an array of 64 whole numbers in raster order. Integer transforms are column
expressions: a pass over one axis is eight dot products for each line, and both passes are
bound inside one transform so that the first is not written into each use of it. The jobs
over whole tables (compress, round trip, sweep) do the same on Arrow batches, where a pass is
one matrix product for thousands of blocks: that is some ten times as fast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwright.functions.scalars import div_round
from blockwright.plans.dims import BASIS, INVERSE, METHOD_NAMES, NORMS, Q50_CHROMA, Q50_LUMA, scaled_k, zigzag


@dataclass(frozen=True)
class Method:
    """A separable transform: basis rows for the forward pass; weights and a divisor for the inverse; row norms times 1024."""

    name: str
    basis: tuple[tuple[int, ...], ...]
    weights: tuple[int, ...]
    divisor: int
    norms: tuple[int, ...]


REGISTRY: dict[str, Method] = {}


def register_method(name: str, basis: list[list[int]], weights: list[int], divisor: int, norms: list[int]) -> Method:
    REGISTRY[name] = Method(name, tuple(map(tuple, basis)), tuple(weights), divisor, tuple(norms))
    return REGISTRY[name]


for _name in BASIS:
    register_method(_name, BASIS[_name], *INVERSE[_name], NORMS[_name])


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def lines(block: Column, matrix: list[list[int]], rows: bool, finish=lambda s: s) -> Column:
    """One pass: out[k] of each line is the dot product of matrix[k] and the line. rows: lines are rows, else columns."""
    flat = F.array(*[F.lit(c).cast("bigint") for row in matrix for c in row])

    def cell(p: Column) -> Column:
        high, low = F.shiftright(p, 3), p.bitwiseAND(7)
        line, k = (high, low) if rows else (low, high)
        at = (lambda n: F.shiftleft(line, 3) + n) if rows else (lambda n: F.shiftleft(n, 3) + line)
        return finish(F.aggregate(F.array(*map(F.lit, range(8))), F.lit(0).cast("bigint"), lambda total, n: total + flat[F.shiftleft(k, 3) + n] * block[at(n)]))

    return F.transform(F.array(*map(F.lit, range(64))), cell)


def forward(block: Column, method: str) -> Column:
    """Integer transform, rows then columns."""
    m = [list(r) for r in REGISTRY[method].basis]
    return bound(bound(block, lambda b: lines(b, m, True)), lambda t: lines(t, m, False))


def inverse(coefficients: Column, method: str) -> Column:
    """Inverse of forward: columns then rows, each pass divided and rounded half away from zero."""
    m = REGISTRY[method]
    back = [[m.basis[k][n] * m.weights[k] for k in range(8)] for n in range(8)]
    done = lambda s: div_round(s, m.divisor)
    return bound(bound(coefficients, lambda c: lines(c, back, False, done)), lambda t: lines(t, back, True, done))


def quant_table(method: str, k: float, chroma: bool = False) -> list[int]:
    """The scaled table with the method's norms worked in, rounded at both steps."""
    table = [max(1, (q * scaled_k(k)) >> 10) for q in (Q50_CHROMA if chroma else Q50_LUMA)]
    if method in REGISTRY:
        norms = REGISTRY[method].norms
        table = [max(1, ((q * norms[p // 8] + 512) // 1024 * norms[p % 8] + 512) // 1024) for p, q in enumerate(table)]
    return table


def as_column(table: list[int] | Column) -> Column:
    return table if isinstance(table, Column) else F.array(*map(F.lit, table))


def quantize(coefficients: Column, table: list[int] | Column) -> Column:
    """By reciprocals of 16 bits: close to a division, and not the same everywhere."""
    q = as_column(table)
    r = F.transform(q, lambda t: F.floor((65536 + F.floor(t / 2)) / t)) if isinstance(table, Column) else as_column([(65536 + t // 2) // t for t in table])
    one = lambda c, i: (F.sign(c) * F.shiftright((F.abs(c).cast("bigint") + F.floor(q[i] / 2)) * r[i], 16)).cast("int")
    return F.transform(coefficients, one)


def quantize_by_division(coefficients: Column, table: list[int]) -> Column:
    q = F.array(*map(F.lit, table))
    return F.transform(coefficients, lambda c, i: (F.sign(c) * F.floor((F.abs(c) + F.floor(q[i] / 2)) / q[i])).cast("int"))


def dequantize(levels: Column, table: list[int] | Column) -> Column:
    q = as_column(table)
    return F.transform(levels, lambda c, i: c * q[i])


def scan(block: Column) -> Column:
    return F.array(*[block[p] for p in zigzag()])


def unscan(levels: Column) -> Column:
    place = {p: i for i, p in enumerate(zigzag())}
    return F.array(*[levels[place[p]] for p in range(64)])


def last_nonzero(levels: Column) -> Column:
    """Greatest position with a value other than 0, or -1."""
    return F.aggregate(F.transform(levels, lambda v, i: F.when(v != 0, i).otherwise(-1)), F.lit(-1), lambda a, b: F.greatest(a, b))


def rle_bytes(levels: Column) -> Column:
    """2 bytes for the first value, 3 for each other that isn't 0, and 3 for the end unless the last position is used."""
    others = F.size(F.filter(levels, lambda v, i: (i > 0) & (v != 0)))
    return 2 + 3 * others + F.when(levels[63] != 0, 0).otherwise(3)


def tokens(levels: DataFrame, keys: list[str], column: str = "z") -> DataFrame:
    """Run-length tokens as rows: keys, seq, zero_run, value, kind. The first value always has one; an end follows unless position 63 is used."""
    used = F.filter(F.transform(column, lambda v, i: F.struct(i.alias("pos"), v.alias("value"))), lambda t: (t["pos"] == 0) | (t["value"] != 0))
    placed = levels.select(*keys, column, used.alias("used"))
    run = F.transform("used", lambda t, i: F.struct(i.alias("seq"), F.when(i == 0, 0).otherwise(t["pos"] - F.element_at("used", F.greatest(i, F.lit(1)))["pos"] - 1).alias("zero_run"), t["value"].alias("value"), F.when(i == 0, "DC").otherwise("AC").alias("kind")))
    end = F.when(F.col(column)[63] == 0, F.array(F.struct(F.size("used").alias("seq"), F.lit(0).alias("zero_run"), F.lit(0).alias("value"), F.lit("EOB").alias("kind")))).otherwise(F.array().cast("array<struct<seq: int, zero_run: int, value: int, kind: string>>"))
    return placed.select(*keys, F.explode(F.concat(run, end)).alias("t")).select(*keys, "t.*")


def from_tokens(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, z: positions are running sums of zero runs; a run past the block or a missing end gives a null block."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "zero_run", "value", "kind")))
    g = rows.groupBy(*keys).agg(ordered.alias("t"))
    zeros = lambda n: F.array_repeat(F.lit(0), n)
    start = F.struct(F.lit(-1).alias("pos"), F.array().cast("array<int>").alias("z"))

    def step(s, t):
        pos = s["pos"] + t["zero_run"] + 1
        z = F.when(pos <= 63, F.concat(s["z"], zeros(t["zero_run"]), F.array(F.coalesce(t["value"], F.lit(0))))).otherwise(s["z"])
        return F.when(t["kind"] == "EOB", s).otherwise(F.struct(pos.alias("pos"), z.alias("z")))

    g = g.withColumn("s", F.aggregate("t", start, step))
    ended = (F.element_at("t", -1)["kind"] == "EOB") != (F.col("s.pos") == 63)
    whole = F.concat("s.z", zeros(63 - F.col("s.pos")))
    return g.select(*keys, F.when((F.col("s.pos") <= 63) & ended, whole).alias("z"))


# Kernels on Arrow batches. Those of floats have 32-bit arithmetic in a fixed order. A kernel
# is a pair of functions of lines (n by 8), forward and inverse; any such pair can be registered.

KERNELS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray], np.ndarray]]] = {}


def register_kernel(name: str, forward_line, inverse_line) -> None:
    """A method by its one-dimensional transforms of lines; both return whole numbers."""
    KERNELS[name] = forward_line, inverse_line


def separable(x: np.ndarray, line, rows_first: bool) -> np.ndarray:
    """A two-dimensional transform of blocks (n, 8, 8) from any transform of lines (n, 8), rounded after each pass as line is."""
    for rows in (rows_first, not rows_first):
        lines_ = np.ascontiguousarray(x if rows else x.transpose(0, 2, 1)).reshape(-1, 8)
        x = line(lines_).reshape(-1, 8, 8)
        x = x if rows else x.transpose(0, 2, 1)
    return x


def cosine_basis() -> np.ndarray:
    n, k = np.meshgrid(np.arange(8), np.arange(8))
    return (np.cos((2 * n + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)).astype(np.float32)


def round_away(x: np.ndarray) -> np.ndarray:
    return (np.sign(x) * np.floor(np.abs(x).astype(np.float64) + 0.5)).astype(np.int32)


def weighed(lines_: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each line times weights (out by in), summed in 32 bits from the first term on."""
    total = np.zeros((len(lines_), len(weights)), np.float32)
    for n in range(lines_.shape[1]):
        total += lines_[:, n, None].astype(np.float32) * weights[:, n]
    return total


def odd_half() -> np.ndarray:
    """Outputs 1, 3, 5, 7 of the butterfly from t = (d0 + d3, d1 + d2, d1 - d2, d0 - d3) of its mirrored differences d, times the square root of 8.

    Output k is half the sum of d(n) cos((2n + 1) k pi / 16), and a pair of d is half the sum
    or the difference of a pair of t; the sums of two cosines make each entry the cosine of
    one multiple of pi / 16 again.
    """
    k = 2 * np.arange(4) + 1
    one, three, five, seven = (np.cos(n * k * np.pi / 16) for n in (1, 3, 5, 7))
    return (np.sqrt(0.5) * np.stack([one + seven, three + five, three - five, one - seven], 1)).astype(np.float32)


ODD = odd_half()
C6, S6, ROOT2, HALF_ROOT = map(np.float32, (np.cos(6 * np.pi / 16), np.sin(6 * np.pi / 16), np.sqrt(2), np.sqrt(1 / 8)))


def butterfly_line(x: np.ndarray) -> np.ndarray:
    """Forward: an even half of mirrored sums, an odd half of mirrored differences."""
    out = np.empty(x.shape, np.float32)
    s, d = ((x[:, :4] + sign * x[:, :3:-1]).astype(np.float32) for sign in (1, -1))
    low, mid = s[:, 1] + s[:, 2], s[:, 1] - s[:, 2]
    high, far = s[:, 0] + s[:, 3], s[:, 0] - s[:, 3]
    out[:, 0], out[:, 4] = (high + low) * HALF_ROOT, (high - low) * HALF_ROOT
    out[:, 2], out[:, 6] = (C6 * mid + S6 * far) * np.float32(0.5), (-S6 * mid + C6 * far) * np.float32(0.5)
    turned = np.stack([d[:, 0] + d[:, 3], d[:, 1] + d[:, 2], d[:, 1] - d[:, 2], d[:, 0] - d[:, 3]], 1)
    out[:, 1::2] = weighed(turned, ODD) * HALF_ROOT
    return round_away(out)


def butterfly_inverse_line(x: np.ndarray) -> np.ndarray:
    """Inverse: the same halves back, four times as large in the middle and divided by 8 at the end."""
    z = x.astype(np.float32) * np.float32(2)
    dc, ac = z[:, 0] * ROOT2, z[:, 4] * ROOT2
    low, high = np.float32(2) * (C6 * z[:, 2] - S6 * z[:, 6]), np.float32(2) * (S6 * z[:, 2] + C6 * z[:, 6])
    s = np.stack([dc + ac + high, dc - ac + low, dc - ac - low, dc + ac - high], 1)
    n = weighed(z[:, 1::2], ODD.T)
    d = np.stack([n[:, 0] + n[:, 3], n[:, 1] + n[:, 2], n[:, 1] - n[:, 2], n[:, 0] - n[:, 3]], 1) * ROOT2
    return round_away(np.concatenate([s + d, (s - d)[:, ::-1]], 1) / np.float32(8))


register_kernel("matrix", lambda x: round_away(weighed(x, cosine_basis())), lambda x: round_away(weighed(x, cosine_basis().T)))
register_kernel("loeffler", butterfly_line, butterfly_inverse_line)


def exact_product(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Lines x times a matrix of whole numbers, as floats that hold every sum exactly: of 32 bits where no sum can reach 2**24, else of 64."""
    kind = np.float32 if np.abs(x).max(initial=0) * np.abs(m).sum(0).max() < 1 << 24 else np.float64
    return x.reshape(-1, 8).astype(kind, copy=False) @ m.astype(kind)


def integer_forward(method: Method):
    """Rows then columns by the basis."""
    m = np.array(method.basis).T

    def run(x: np.ndarray) -> np.ndarray:
        rows = exact_product(x, m).reshape(-1, 8, 8)
        return exact_product(rows.transpose(0, 2, 1), m).reshape(-1, 8, 8).transpose(0, 2, 1).astype(np.int32)

    return run


def integer_inverse(method: Method):
    """Columns then rows, each pass divided and rounded half away from zero."""
    back = (np.array(method.basis).T * np.array(method.weights)).T

    def halves(x: np.ndarray) -> np.ndarray:
        s = exact_product(x, back).astype(np.int64)
        s = s.astype(np.int32) if np.abs(s).max(initial=0) < 1 << 29 else s
        return np.sign(s) * ((2 * np.abs(s) + method.divisor) // (2 * method.divisor))

    def run(x: np.ndarray) -> np.ndarray:
        columns = halves(x.transpose(0, 2, 1)).reshape(-1, 8, 8).transpose(0, 2, 1)
        return halves(columns).reshape(-1, 8, 8).astype(np.int32)

    return run


def kernel(method: str, back: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """A method's transform of blocks (n by 64) to blocks."""
    if method == "identity":
        return lambda x: x
    if method in KERNELS:
        line = KERNELS[method][back]
        return lambda x: separable(x.reshape(-1, 8, 8), line, not back).reshape(-1, 64)
    whole = (integer_inverse if back else integer_forward)(REGISTRY[method])
    return lambda x: whole(x.reshape(-1, 8, 8)).reshape(-1, 64)


def quantized(c: np.ndarray, table: list[int]) -> np.ndarray:
    """Levels by reciprocals, in 32 bits without sign where the products fit."""
    q = np.array(table, np.int64)
    r, size = (65536 + q // 2) // q, np.abs(c)
    fits = (int(size.max(initial=0)) + int(q.max()) // 2) * int(r.max()) < 1 << 32
    kind = np.uint32 if fits else np.int64
    levels = ((size.astype(kind) + (q // 2).astype(kind)) * r.astype(kind)) >> kind(16)
    return np.where(c < 0, -levels.astype(np.int32), levels.astype(np.int32))


def block_job(df: DataFrame, column: str, out: list[str], job: Callable[[np.ndarray], list[np.ndarray]], times: int = 1, numbers: dict[str, list[int]] | None = None) -> DataFrame:
    """df with new columns of blocks, which job makes from a column of blocks, Arrow batch by Arrow batch and without an object for each block.

    job: takes n by 64, gives times * n by 64 for each of out: row i, case by case. With times
    over 1 each row of df comes out that often; numbers name the cases. Blocks that are null or
    don't have 64 samples give null.
    """
    names = [f.name for f in df.schema]
    kept = [f for f in df.schema if f.name not in out and f.name not in (numbers or {})]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                blocks = part.column(names.index(column))
                size = pc.fill_null(pc.list_value_length(blocks), 0).to_numpy()
                good = size == 64
                if good.all():
                    x = blocks.flatten().to_numpy().reshape(-1, 64).astype(np.int32, copy=False)
                else:
                    x = np.zeros((len(size), 64), np.int32)
                    x[good] = blocks.filter(pa.array(good)).flatten().to_numpy().reshape(-1, 64)
                missing = np.repeat(~good, times)
                made = [pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * len(missing) + 1, 64, dtype=np.int32)), pa.array(np.ascontiguousarray(v, np.int32).reshape(-1)), mask=pa.array(missing) if missing.any() else None) for v in job(x)]
                take = pa.array(np.repeat(np.arange(len(size)), times))
                same = [part.column(names.index(f.name)) if times == 1 else part.column(names.index(f.name)).take(take) for f in kept]
                cases = [pa.array(np.tile(np.array(v, np.int32), len(size))) for v in (numbers or {}).values()]
                yield pa.RecordBatch.from_arrays([*same, *cases, *made], [*[f.name for f in kept], *(numbers or {}), *out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} int" for n in numbers or {}] + [f"`{c}` array<int>" for c in out]
    return df.mapInArrow(run, ", ".join(fields))


def float_kernel(df: DataFrame, method: str, column: str, back: bool = False) -> DataFrame:
    """df with the column of blocks replaced by the transform of each by a kernel of lines."""
    return block_job(df, column, [column], lambda x, f=kernel(method, back): [f(x)])


def transformed(blocks: DataFrame, method: str) -> DataFrame:
    """blocks (b) with their coefficients c."""
    return block_job(blocks, "b", ["c"], lambda x, f=kernel(method): [f(x)])


def restored(df: DataFrame, method: str) -> DataFrame:
    """df with its coefficients d replaced by blocks."""
    return block_job(df, "d", ["d"], lambda x, f=kernel(method, True): [f(x)])


def compress(blocks: DataFrame, method: str, k: float, chroma: bool = False, coefficients: bool = False) -> DataFrame:
    """blocks with their levels q for one method and quality factor, and with their coefficients c if they are asked for."""
    forth, table = kernel(method), quant_table(method, k, chroma)

    def job(x: np.ndarray) -> list[np.ndarray]:
        c = forth(x)
        return [c, quantized(c, table)] if coefficients else [quantized(c, table)]

    return block_job(blocks, "b", ["c", "q"] if coefficients else ["q"], job)


def decompress(levels: DataFrame, method: str, k: float, chroma: bool = False) -> DataFrame:
    """levels with the reconstructed block d."""
    back, table = kernel(method, True), np.array(quant_table(method, k, chroma))
    return block_job(levels, "q", ["d"], lambda q: [back(q * table)])


def round_trip(blocks: DataFrame, method: str, k: float, chroma: bool = False) -> DataFrame:
    """blocks with what compress and decompress make of them (d), in one pass."""
    return block_job(blocks, "b", ["d"], lambda x, f=case_job(method, [quant_table(method, k, chroma)]): f(x)[2:])


def case_job(method: str, tables: list[list[int]]) -> Callable[[np.ndarray], list[np.ndarray]]:
    """Coefficients, levels and reconstruction of blocks by each of several tables; a block is transformed once."""
    forth, back = kernel(method), kernel(method, True)

    def job(x: np.ndarray) -> list[np.ndarray]:
        c = forth(x)
        q = np.stack([quantized(c, t) for t in tables], 1)
        d = back((q * np.array(tables)).reshape(-1, 64))
        return [np.repeat(c, len(tables), 0), q.reshape(-1, 64), d]

    return job


def sweep(blocks: DataFrame, ks: list[tuple[int, float]], methods: list[str] = METHOD_NAMES) -> DataFrame:
    """Every block by every method and quality factor, one row each: method, k_idx, c, q, d.

    A block is transformed once for each method; its coefficients then meet the tables of
    all quality factors. There is no shuffle.
    """
    out = None
    for m in methods:
        df = block_job(blocks, "b", ["c", "q", "d"], case_job(m, [quant_table(m, k) for _, k in ks]), len(ks), {"k_idx": [i for i, _ in ks]}).withColumn("method", F.lit(m))
        out = df if out is None else out.unionByName(df)
    return out


def against_matrix(blocks: DataFrame, keys: list[str], ks: list[tuple[int, float]], methods: list[str]) -> DataFrame:
    """keys, method, k_idx, total, diffs, sse, sse_matrix: levels and reconstructions of methods beside those of the matrix method, block by block.

    Both sides come from one row, so nothing is joined.
    """
    case = {"k_idx": [i for i, _ in ks]}
    base = case_job("matrix", [quant_table("matrix", k) for _, k in ks])
    error = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("bigint")), F.lit(0).cast("bigint"), lambda t, x: t + x)
    diffs = F.size(F.filter(F.zip_with("q", "w", lambda a, b: a != b), lambda x: x))
    out = None
    for m in methods:
        own = case_job(m, [quant_table(m, k) for _, k in ks])
        df = block_job(blocks.select(*keys, "b"), "b", ["q", "d", "w", "z"], lambda x, own=own: [*own(x)[1:], *base(x)[1:]], len(ks), case)
        df = df.select(*keys, F.lit(m).alias("method"), "k_idx", F.size("q").cast("bigint").alias("total"), diffs.cast("bigint").alias("diffs"), error("b", "d").alias("sse"), error("b", "z").alias("sse_matrix"))
        out = df if out is None else out.unionByName(df)
    return out
