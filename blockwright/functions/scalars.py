"""Scalar rules of the study as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div_round(n: Column, d: int) -> Column:
    """Division that rounds half away from zero, for whole numbers and d > 0."""
    return F.sign(n).cast("bigint") * F.floor((F.abs(n) * 2 + d) / (2 * d)).cast("bigint")


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return (F.shiftright(77 * r + 150 * g + 29 * b + 128, 8) - 128, F.shiftright(-43 * r - 85 * g + 128 * b + 128, 8), F.shiftright(128 * r - 107 * g - 21 * b + 128, 8))


def clamp(x: Column, low: int = 0, high: int = 255) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    v = y + 128
    return clamp(v + F.shiftright(359 * cr + 128, 8)), clamp(v - F.shiftright(88 * cb + 183 * cr + 128, 8)), clamp(v + F.shiftright(454 * cb + 128, 8))


def rgb565_to_rgb(hi: Column, lo: Column) -> tuple[Column, Column, Column]:
    """Two big-endian bytes to three channels; high bits are repeated in the low ones."""
    v = F.shiftleft(hi, 8).bitwiseOR(lo)
    r, g, b = F.shiftright(v, 11).bitwiseAND(31), F.shiftright(v, 5).bitwiseAND(63), v.bitwiseAND(31)
    return F.shiftleft(r, 3).bitwiseOR(F.shiftright(r, 2)), F.shiftleft(g, 2).bitwiseOR(F.shiftright(g, 4)), F.shiftleft(b, 3).bitwiseOR(F.shiftright(b, 2))


def bpp(size: Column, width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), size * 8.0 / (width * height)).otherwise(F.lit(0.0))


def ratio(raw: Column, stream: Column) -> Column:
    return F.when((raw > 0) & (stream > 0), raw / stream).otherwise(F.lit(0.0))


def number(text: Column, scale: float = 1.0) -> Column:
    """Null for null, empty, N/A and what is no number."""
    t = F.trim(text)
    return F.when((t != "") & (t != "N/A"), t).try_cast("double") / scale


def decimals(x: Column, digits: int) -> Column:
    """A number with fixed decimals as C prints it: rounded by its binary value, ties to even (format_string rounds the shortest decimal digits half up)."""
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * digits))


def or_na(x: Column, digits: int) -> Column:
    return F.when(x.isNull() | (x < 0), "N/A").otherwise(decimals(x, digits))


def csv_field(x: Column) -> Column:
    return F.translate(x, ",\r\n", "   ")


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounding half up of the decimal text of a double."""
    return F.round(x.cast("string").cast("decimal(38,18)"), digits)


def psnr(sse: Column, n: Column, exact: float = 100.0) -> Column:
    """From the sum of squared errors over n samples; exact is the value for no error."""
    return F.when(sse == 0, F.lit(exact)).otherwise(10 * F.log10(F.lit(65025.0) / (sse / n)))


def psnr_x100(value: Column, sse: Column) -> Column:
    return F.when(sse == 0, F.lit(9999)).otherwise(F.least(F.lit(9999), F.greatest(F.lit(0), F.floor(value * 100 + 0.5)))).cast("int")


def quality(p: Column, cuts: tuple[float, float, float]) -> Column:
    best, good, fair = cuts
    return F.when(p > best, "Excellent").when(p > good, "Good").when(p > fair, "Fair").otherwise("Poor")


def uptime(us: Column) -> Column:
    return F.format_string("boot+%d.%03d s", F.expr("0L") + F.floor(us / 1_000_000), F.floor(us % 1_000_000 / 1000))


def k_text(k: Column) -> Column:
    """k as short text: 0.1, 0.25, 1."""
    return F.regexp_replace(F.regexp_replace(decimals(k, 6), "0+$", ""), "\\.$", "")


def reported_psnr(x100: Column, computed: Column) -> Column:
    """The PSNR that a record reports in hundredths (0: none), else a computed one."""
    return F.coalesce(F.nullif(x100, F.lit(0)) / 100, computed)


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a time without a zone, read as UTC whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{ts}`)")


def from_micros(us: str) -> Column:
    """The time without a zone of microseconds since 1970."""
    return F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(`{us}` AS decimal(24, 6)) / 1000000)")
