"""Queries over blocks and pixels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockwright.functions import scalars as S
from blockwright.operators import analytics as A
from blockwright.operators import codec as C
from blockwright.operators import frames as R
from blockwright.operators import quality as Q
from blockwright.operators import strips as P
from blockwright.plans.dims import BASIS, INVERSE, K_VALUES, METHOD_NAMES, Q50_CHROMA, Q50_LUMA, scaled_k, zigzag
from blockwright.sources.blocks import BLOCKS_SQL, FRAMES_SQL, PIXELS_SQL, SAMPLES_SQL, blocks, frame_strips, frames, pixels, samples

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEY = ["image", "brow", "bcol"]


def query(name: str, sql: str | None, base: str = BLOCKS_SQL):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {base}{sql}" if sql.startswith(", ") else f"WITH {base} {sql}"
        return f

    return put


def long(df, column: str, *more: str):
    return df.select(*KEY, *more, F.posexplode(column).alias("pos", "v"))


def rounded(n: str, d: int) -> str:
    return f"(sign({n}) * ((abs({n}) * 2 + {d}) // {2 * d}))::BIGINT"


def basis_sql(name: str, matrix) -> str:
    return f"{name}(k, n, c) AS (VALUES " + ", ".join(f"({k}, {n}, {c})" for k, row in enumerate(matrix) for n, c in enumerate(row)) + ")"


def forward_sql(method: str) -> str:
    return f", {basis_sql('bas', BASIS[method])}, p1 AS (SELECT image, brow, bcol, pos // 8 AS y, k, sum(v * c) AS v FROM blocks JOIN bas ON n = pos % 8 GROUP BY ALL), coef AS (SELECT image, brow, bcol, (bas.k * 8 + p1.k)::INTEGER AS pos, sum(v * c)::BIGINT AS v FROM p1 JOIN bas ON bas.n = p1.y GROUP BY ALL)"


def inverse_sql(method: str, source: str) -> str:
    w, d = INVERSE[method]
    back = [[BASIS[method][k][n] * w[k] for k in range(8)] for n in range(8)]
    return f", {basis_sql('bk', back)}, i1 AS (SELECT image, brow, bcol, bk.k AS y, pos % 8 AS x, {rounded('sum(v * c)', d)} AS v FROM {source} JOIN bk ON bk.n = pos // 8 GROUP BY image, brow, bcol, bk.k, pos % 8), back AS (SELECT image, brow, bcol, (y * 8 + bk.k)::INTEGER AS pos, {rounded('sum(v * c)', d)} AS v FROM i1 JOIN bk ON bk.n = x GROUP BY image, brow, bcol, y, bk.k)"


def table_sql(method: str, k: float, chroma: bool = False) -> str:
    return "qt(pos, q) AS (VALUES " + ", ".join(f"({p}, {q})" for p, q in enumerate(C.quant_table(method, k, chroma))) + ")"


# Transforms of a list of 64 in SQL, for methods of any kind.


def literal(values, kind: str = "BIGINT") -> str:
    return "[" + ", ".join(map(str, values)) + f"]::{kind}[]"


def pass_sql(source: str, m: str, rows: bool, kind: str, finish: str) -> str:
    """One pass over lines: m names a list of 64 weights, out by in; summed from the first term on."""
    line, k = ("(p // 8)", "(p % 8)") if rows else ("(p % 8)", "(p // 8)")
    at = lambda n: f"{line} * 8 + {n + 1}" if rows else f"{n * 8 + 1} + {line}"
    total = " + ".join(f"{m}[{k} * 8 + {n + 1}] * {source}[{at(n)}]::{kind}" for n in range(8))
    return "[" + finish.format(f"({total})") + " FOR p IN range(64)]"


def turn_sql(source: str) -> str:
    return f"[{source}[p % 8 * 8 + p // 8 + 1] FOR p IN range(64)]"


def butterfly_sql(source: str, back: bool) -> str:
    """Rows of a block by the butterfly, written out."""
    f = lambda x: f"('{x:.9g}'::FLOAT)"
    c6, s6, root2, half = map(f, (C.C6, C.S6, C.ROOT2, C.HALF_ROOT))
    odd = [[f(x) for x in row] for row in C.ODD]
    v = lambda n: f"{source}[p * 8 + {n + 1}]"
    dot = lambda w, x: "(" + " + ".join(f"{a} * {b}" for a, b in zip(w, x)) + ")"
    whole = lambda x: f"round({x})::INTEGER"
    if not back:
        s, d = ([f"({v(i)} {sign} {v(7 - i)})" for i in range(4)] for sign in "+-")
        low, mid, high, far = (f"({a} {o} {b})::FLOAT" for a, o, b in ((s[1], "+", s[2]), (s[1], "-", s[2]), (s[0], "+", s[3]), (s[0], "-", s[3])))
        turned = [f"({a} {o} {b})::FLOAT" for a, o, b in ((d[0], "+", d[3]), (d[1], "+", d[2]), (d[1], "-", d[2]), (d[0], "-", d[3]))]
        out = [f"({high} + {low}) * {half}", f"{dot(odd[0], turned)} * {half}", f"({c6} * {mid} + {s6} * {far}) * 0.5::FLOAT", f"{dot(odd[1], turned)} * {half}", f"({high} - {low}) * {half}", f"{dot(odd[2], turned)} * {half}", f"((-{s6}) * {mid} + {c6} * {far}) * 0.5::FLOAT", f"{dot(odd[3], turned)} * {half}"]
    else:
        z = [f"({v(i)}::FLOAT * 2::FLOAT)" for i in range(8)]
        dc, ac = f"{z[0]} * {root2}", f"{z[4]} * {root2}"
        low, high = f"2::FLOAT * ({c6} * {z[2]} - {s6} * {z[6]})", f"2::FLOAT * ({s6} * {z[2]} + {c6} * {z[6]})"
        s = [f"({dc} {a} {ac} {b})" for a, b in (("+", f"+ {high}"), ("-", f"+ {low}"), ("-", f"- {low}"), ("+", f"- {high}"))]
        n = [dot([odd[r][c] for r in range(4)], [z[1], z[3], z[5], z[7]]) for c in range(4)]
        d = [f"({a} {o} {b}) * {root2}" for a, o, b in ((n[0], "+", n[3]), (n[1], "+", n[2]), (n[1], "-", n[2]), (n[0], "-", n[3]))]
        out = [f"({s[i]} + {d[i]}) / 8::FLOAT" for i in range(4)] + [f"({s[i]} - {d[i]}) / 8::FLOAT" for i in (3, 2, 1, 0)]
    return f"flatten([[{', '.join(map(whole, out))}] FOR p IN range(8)])"


def list_transform_sql(method: str, back: bool, source: str, keys: str, column: str, out: str, name: str) -> str:
    """CTEs that end in name: the rows of source with the list column transformed as out."""
    a, b = f"{name}_1", f"{name}_2"
    if method == "identity":
        return f"{name} AS (SELECT {keys}, {column} AS {out} FROM {source})"
    if method == "loeffler":
        first = turn_sql(column) if back else column
        steps = [f"{a} AS (SELECT {keys}, {first} AS step FROM {source})", f"{b} AS (SELECT {keys}, {butterfly_sql('step', back)} AS step FROM {a})", f"{name}_3 AS (SELECT {keys}, {turn_sql('step')} AS step FROM {b})", f"{name}_4 AS (SELECT {keys}, {butterfly_sql('step', back)} AS step FROM {name}_3)"]
        return ", ".join([*steps, f"{name} AS (SELECT {keys}, {'step' if back else turn_sql('step')} AS {out} FROM {name}_4)"])
    if method == "matrix":
        basis = C.cosine_basis()
        m = literal([f"'{x:.9g}'" for x in (basis.T if back else basis).ravel()], "FLOAT")
        kind, finish = "FLOAT", "round({})::INTEGER"
    else:
        w, d = INVERSE[method]
        m = literal([BASIS[method][k][n] * w[k] for n in range(8) for k in range(8)] if back else [x for row in BASIS[method] for x in row])
        kind, finish = "BIGINT", ("(sign({0}) * ((abs({0}) * 2 + " + f"{d}) // {2 * d}))::BIGINT") if back else "{}"
    one = f"{a} AS (SELECT {keys}, {pass_sql(column, 'm', not back, kind, finish)} AS step FROM {source}, (SELECT {m} AS m))"
    return f"{one}, {name} AS (SELECT {keys}, {pass_sql('step', 'm', back, kind, finish)} AS {out} FROM {a}, (SELECT {m} AS m))"


def quantized_sql(column: str, table: str) -> str:
    return f"[(sign({column}[p + 1]) * (((abs({column}[p + 1])::BIGINT + {table}[p + 1] // 2) * ((65536 + {table}[p + 1] // 2) // {table}[p + 1])) >> 16))::BIGINT FOR p IN range(64)]"


def dequantized_sql(column: str, table: str) -> str:
    return f"[{column}[p + 1] * {table}[p + 1] FOR p IN range(64)]"


LISTS = ", bl AS (SELECT image, brow, bcol, list(v ORDER BY pos) AS b FROM blocks GROUP BY image, brow, bcol)"
BLOCK_KEY = "image, brow, bcol"


def exploded_sql(source: str, column: str, keys: str = BLOCK_KEY) -> str:
    return f"SELECT {keys}, unnest(range(64))::INTEGER AS pos, unnest({column}) AS v FROM {source}"


LEVELS = "levels AS (SELECT image, brow, bcol, coef.pos, (sign(v) * (((abs(v) + q // 2) * ((65536 + q // 2) // q)) >> 16))::BIGINT AS v FROM coef JOIN qt ON qt.pos = coef.pos)"
RDCT_LEVELS = f"{forward_sql('rdct')}, {table_sql('rdct', 0.5)}, {LEVELS}"
SCAN = "zz(z, pos) AS (VALUES " + ", ".join(f"({i}, {p})" for i, p in enumerate(zigzag())) + ")"


def levels(spark, d):
    return C.compress(blocks(spark, d), "rdct", 0.5, coefficients=True)


def scanned(spark, d):
    return levels(spark, d).select(*KEY, C.scan(F.col("q")).alias("z"))


ZSQL = f"{RDCT_LEVELS}, {SCAN}, zl AS (SELECT image, brow, bcol, zz.z AS pos, v FROM levels JOIN zz ON zz.pos = levels.pos)"

for _t, _i, _m in (("t16", "t17", "rdct"), ("t18", "t19", "silveira_j3"), ("t20", "t21", "silveira_j7")):
    query(f"{_t}_forward_{_m}", f"{forward_sql(_m)} SELECT * FROM coef")(lambda spark, d, m=_m: long(blocks(spark, d).withColumn("c", C.forward(F.col("b"), m)), "c"))
    query(f"{_i}_inverse_{_m}", f"{forward_sql(_m)}{inverse_sql(_m, 'coef')} SELECT * FROM back")(lambda spark, d, m=_m: long(blocks(spark, d).withColumn("c", C.forward(F.col("b"), m)).withColumn("d", C.inverse(F.col("c"), m)), "d"))
for _t, _m, _back in (("t12", "matrix", False), ("t13", "matrix", True), ("t14", "loeffler", False), ("t15", "loeffler", True)):
    _sql = f"{LISTS}, {list_transform_sql(_m, False, 'bl', BLOCK_KEY, 'b', 'c', 'fwd')}" + (f", {list_transform_sql(_m, True, 'fwd', BLOCK_KEY, 'c', 'c', 'inv')} {exploded_sql('inv', 'c')}" if _back else f" {exploded_sql('fwd', 'c')}")
    query(f"{_t}_{'inverse' if _back else 'forward'}_{_m}", _sql)(lambda spark, d, m=_m, back=_back: long(C.float_kernel(C.float_kernel(blocks(spark, d), m, "b"), m, "b", True) if back else C.float_kernel(blocks(spark, d), m, "b"), "b"))


@query("t22_identity", "SELECT * FROM blocks")
def _(spark, d):
    return long(blocks(spark, d), "b")


@query("t7_blocks_to_channel", "SELECT image, brow * 8 + pos // 8 AS y, bcol * 8 + pos % 8 AS x, v FROM blocks WHERE brow * 8 + pos // 8 < 23 AND bcol * 8 + pos % 8 < 30")
def _(spark, d):
    b = long(blocks(spark, d), "b")
    y, x = (F.col("brow") * 8 + F.floor(F.col("pos") / 8)).cast("int"), F.col("bcol") * 8 + F.col("pos") % 8
    return b.select("image", y.alias("y"), x.alias("x"), "v").where("y < 23 AND x < 30")


@query("f1_rgb_to_ycbcr", "SELECT image, y, x, ((77 * r + 150 * g + 29 * b + 128) >> 8) - 128 AS yy, ((-43 * r - 85 * g + 128 * b + 128) >> 8) AS cb, ((128 * r - 107 * g - 21 * b + 128) >> 8) AS cr FROM pixels", PIXELS_SQL)
def _(spark, d):
    yy, cb, cr = S.rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b"))
    return pixels(spark, d).select("image", "y", "x", yy.alias("yy"), cb.alias("cb"), cr.alias("cr"))


YCC = ", ycc AS (SELECT image, y, x, r, g, b, ((77 * r + 150 * g + 29 * b + 128) >> 8) - 128 AS yy, ((-43 * r - 85 * g + 128 * b + 128) >> 8) AS cb, ((128 * r - 107 * g - 21 * b + 128) >> 8) AS cr FROM pixels)"
RGB_BACK = ", back AS (SELECT image, y, x, r AS r0, g AS g0, b AS b0, greatest(0, least(255, yy + 128 + ((359 * cr + 128) >> 8))) AS r, greatest(0, least(255, yy + 128 - ((88 * cb + 183 * cr + 128) >> 8))) AS g, greatest(0, least(255, yy + 128 + ((454 * cb + 128) >> 8))) AS b FROM ycc)"


def converted(spark, d):
    yy, cb, cr = S.rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b"))
    return pixels(spark, d).select("image", "y", "x", F.col("r").alias("r0"), F.col("g").alias("g0"), F.col("b").alias("b0"), yy.alias("yy"), cb.alias("cb"), cr.alias("cr"))


def restored(spark, d):
    r, g, b = S.ycbcr_to_rgb(F.col("yy"), F.col("cb"), F.col("cr"))
    return converted(spark, d).select("image", "y", "x", "r0", "g0", "b0", r.alias("r"), g.alias("g"), b.alias("b"))


@query("f2_ycbcr_to_rgb", f"{YCC}{RGB_BACK} SELECT image, y, x, r, g, b FROM back", PIXELS_SQL)
def _(spark, d):
    return restored(spark, d).select("image", "y", "x", "r", "g", "b")


IMAGE = ["image", "w", "h"]
PLACE = "image, w, h, plane, brow, bcol"


def planes_sql(sub: str) -> str:
    """ycc, and pl: the samples of all planes."""
    down, across = R.halves(sub)
    ycc = ", ycc AS (SELECT image, w, h, y, x, ((77 * r + 150 * g + 29 * b + 128) >> 8) - 128 AS yy, ((-43 * r - 85 * g + 128 * b + 128) >> 8) AS cb, ((128 * r - 107 * g - 21 * b + 128) >> 8) AS cr FROM frames)"
    both = "SELECT image, w, h, 'cb' AS plane, y, x, cb AS v FROM ycc UNION ALL SELECT image, w, h, 'cr', y, x, cr FROM ycc"
    return ycc + f", pl AS (SELECT image, w, h, 'y' AS plane, y, x, yy::BIGINT AS v FROM ycc UNION ALL SELECT image, w, h, plane, y >> {down}, x >> {across}, (sign(sum(v)) * ((abs(sum(v)) * 2 + count(*)) // (2 * count(*))))::BIGINT FROM ({both}) GROUP BY image, w, h, plane, y >> {down}, x >> {across})"


def blocks_sql(sub: str = "444", names=R.PLANES) -> str:
    """gr: the grid of blocks, and fb: blocks with zeros where there is no sample of pl."""
    down, across = R.halves(sub)
    size = lambda c, n: f"CASE WHEN plane = 'y' THEN (({c} + {(8 << n) - 1}) // {8 << n}) << {n} ELSE ({c} + {(8 << n) - 1}) // {8 << n} END"
    grid = f", gr AS (SELECT image, w, h, plane, brow::INTEGER AS brow, bcol::INTEGER AS bcol FROM (SELECT DISTINCT image, w, h FROM frames), (VALUES {', '.join(f'({chr(39)}{n}{chr(39)})' for n in names)}) n(plane), range(0, 4) a(brow), range(0, 4) c(bcol) WHERE brow < {size('h', down)} AND bcol < {size('w', across)})"
    return grid + ", fb AS (SELECT g.image, g.w, g.h, g.plane, g.brow, g.bcol, list(coalesce(pl.v, 0) ORDER BY g.pos) AS b FROM (SELECT gr.*, pos FROM gr, range(0, 64) s(pos)) g LEFT JOIN pl ON pl.image = g.image AND pl.plane = g.plane AND pl.y = g.brow * 8 + g.pos // 8 AND pl.x = g.bcol * 8 + g.pos % 8 GROUP BY ALL)"


def upsampled_sql(source: str, sub: str, out: str) -> str:
    """Blocks of source (b) at the size of luma."""
    down, across = R.halves(sub)
    at = f"({'dy * 4 + p // 16' if down else 'p // 8'}) * 8 + ({'dx * 4 + p % 8 // 2' if across else 'p % 8'}) + 1"
    return f"{out} AS (SELECT {PLACE}, b FROM {source} WHERE plane = 'y' UNION ALL SELECT image, w, h, plane, ((brow << {down}) + dy)::INTEGER, ((bcol << {across}) + dx)::INTEGER, [b[{at}] FOR p IN range(64)] FROM {source}, range(0, {1 + down}) s(dy), range(0, {1 + across}) t(dx) WHERE plane <> 'y')"


def rgb_sql(source: str, out: str) -> str:
    """Pixels of full-size blocks of three planes."""
    value = lambda n: f"max(CASE WHEN plane = '{n}' THEN v END) AS {n}"
    px = f"{out}_1 AS (SELECT image, w, h, (brow * 8 + pos // 8)::INTEGER AS y, (bcol * 8 + pos % 8)::INTEGER AS x, {', '.join(value(n).replace('AS y', 'AS yy') for n in R.PLANES)} FROM (SELECT {PLACE}, unnest(range(64)) AS pos, unnest(b) AS v FROM {source}) GROUP BY image, w, h, brow * 8 + pos // 8, bcol * 8 + pos % 8)"
    return f"{px}, {out} AS (SELECT image, y, x, greatest(0, least(255, yy + 128 + ((359 * cr + 128) >> 8))) AS r, greatest(0, least(255, yy + 128 - ((88 * cb + 183 * cr + 128) >> 8))) AS g, greatest(0, least(255, yy + 128 + ((454 * cb + 128) >> 8))) AS b FROM {out}_1 WHERE y < h AND x < w)"


def frame_blocks(spark, d, sub: str = "444", channel=None):
    return P.blocks(frame_strips(spark, d), ["image"], sub, channel)


def shown(df, column: str = "b"):
    return df.select("image", "plane", "brow", "bcol", F.posexplode(column).alias("pos", "v"))


def plane_query(name: str, sub: str, where: str):
    query(name, f"{planes_sql(sub)}{blocks_sql(sub)} SELECT image, plane, brow, bcol, unnest(range(64))::INTEGER AS pos, unnest(b) AS v FROM fb WHERE {where}", FRAMES_SQL)(lambda spark, d: shown(frame_blocks(spark, d, sub).where(where)))


plane_query("t1_luma_blocks", "444", "plane = 'y'")
plane_query("t3_chroma_444", "444", "plane <> 'y'")
plane_query("t4_chroma_420", "420", "plane <> 'y'")
plane_query("t5_chroma_422", "422", "plane <> 'y'")
for _n, _value, _of in (("t2_gray_blocks", "r - 128", lambda r, g, b: r - 128), ("t6_channel_blocks", "g * 3 - b", lambda r, g, b: g * 3 - b)):
    _sql = f", pl AS (SELECT image, w, h, 'y' AS plane, y, x, ({_value})::BIGINT AS v FROM frames){blocks_sql('444', ('y',))} SELECT image, plane, brow, bcol, unnest(range(64))::INTEGER AS pos, unnest(b) AS v FROM fb"
    query(_n, _sql, FRAMES_SQL)(lambda spark, d, c=_of: shown(frame_blocks(spark, d, "444", c)))
for _n, _sub in (("t10_upsample_420", "420"), ("t11_upsample_422", "422")):
    query(_n, f"{planes_sql(_sub)}{blocks_sql(_sub)}, {upsampled_sql('fb', _sub, 'up')} SELECT image, plane, brow, bcol, unnest(range(64))::INTEGER AS pos, unnest(b) AS v FROM up", FRAMES_SQL)(lambda spark, d, s=_sub: shown(R.at_full_size(frame_blocks(spark, d, s), IMAGE, s)))


@query("t9_blocks_to_gray", f", pl AS (SELECT image, w, h, 'y' AS plane, y, x, (r - 128)::BIGINT AS v FROM frames){blocks_sql('444', ('y',))} SELECT image, y, x, v FROM (SELECT image, w, h, (brow * 8 + pos // 8)::INTEGER AS y, (bcol * 8 + pos % 8)::INTEGER AS x, greatest(0, least(255, v + 128)) AS v FROM (SELECT *, unnest(range(64)) AS pos, unnest(b) AS v FROM fb)) WHERE y < h AND x < w", FRAMES_SQL)
def _(spark, d):
    """The gray raster of luma blocks, cut to the image; what isn't there is middle gray."""
    return R.to_gray(frame_blocks(spark, d, "444", lambda r, g, b: r - 128), IMAGE).select("image", "y", "x", "v")


@query("t8_blocks_to_rgb", f"{planes_sql('444')}{blocks_sql('444')}, {rgb_sql('fb', 'px')} SELECT * FROM px", FRAMES_SQL)
def _(spark, d):
    """The identity job, back and forth: blocks of three planes give the image."""
    key = ["image"]
    rgb = P.long(P.decompress(P.compress(frame_strips(spark, d), key, "identity", 1.0), key, "identity", 1.0), key)
    return rgb.select("image", "y", "x", *[F.col(c).cast("bigint").alias(c) for c in "rgb"])


def job_sql(method: str, k: float, sub: str) -> str:
    """lv: levels of the compress job; px: pixels of the decompress job."""
    table = f"CASE WHEN plane = 'y' THEN {literal(C.quant_table(method, k))} ELSE {literal(C.quant_table(method, k, True))} END"
    return f"{planes_sql(sub)}{blocks_sql(sub)}, {list_transform_sql(method, False, 'fb', PLACE, 'b', 'c', 'fwd')}, lv AS (SELECT {PLACE}, t, {quantized_sql('c', 't')} AS q FROM (SELECT *, {table} AS t FROM fwd)), dq AS (SELECT {PLACE}, {dequantized_sql('q', 't')} AS d FROM lv), {list_transform_sql(method, True, 'dq', PLACE, 'd', 'b', 'inv')}, {upsampled_sql('inv', sub, 'up')}, {rgb_sql('up', 'px')}"


for _method, _k, _sub in (("rdct", 0.5, "420"), ("matrix", 0.2, "444"), ("silveira_j7", 0.8, "422")):
    query(f"t33_compress_{_method}_{_sub}", f"{job_sql(_method, _k, _sub)} SELECT image, plane, brow, bcol, unnest(range(64))::INTEGER AS pos, unnest(q) AS v FROM lv", FRAMES_SQL)(lambda spark, d, a=(_method, _k, _sub): shown(P.level_blocks(P.compress(frame_strips(spark, d), ["image"], *a), ["image"], a[2]), "q"))
    query(f"t34_decompress_{_method}_{_sub}", f"{job_sql(_method, _k, _sub)} SELECT image, y, x, r, g, b FROM px", FRAMES_SQL)(lambda spark, d, a=(_method, _k, _sub): P.long(P.decompress(P.compress(frame_strips(spark, d), ["image"], *a), ["image"], *a), ["image"]))


ERROR_CASES = "SELECT image, brow, bcol, s % 9 - 1 AS m, s % 3 AS c, (s // 3) % 5 - 1 AS sub, CASE s % 13 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE ELSE (s % 400) / 10.0::DOUBLE - 2 END AS k, s % 11 AS w, (s // 11) % 12 AS h, s % 17 > 0 AS has FROM (SELECT image, brow, bcol, sum(v) AS s FROM samples GROUP BY ALL)"


@query("f5_parameter_errors", f"SELECT image, brow, bcol, CASE WHEN NOT has THEN -1 WHEN w <= 0 OR h <= 0 THEN -2 WHEN m NOT BETWEEN 0 AND 5 THEN -4 WHEN c NOT IN (0, 1) THEN -5 WHEN sub NOT BETWEEN 0 AND 2 THEN -8 WHEN NOT isfinite(k) OR k <= 0 OR k > 32 THEN -9 ELSE 0 END AS error FROM ({ERROR_CASES})", SAMPLES_SQL)
def _(spark, d):
    s = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x)
    k = F.when(F.col("s") % 13 == 0, float("nan")).when(F.col("s") % 13 == 1, float("inf")).otherwise((F.col("s") % 400) / 10.0 - 2)
    c = samples(spark, d).select(*KEY, s.alias("s")).select(*KEY, "s", k.alias("k"))
    third, eleventh = F.floor(F.col("s") / 3), F.floor(F.col("s") / 11)
    error = R.parameter_error(F.when(F.col("s") % 17 > 0, F.lit(1)), F.col("s") % 11, eleventh % 12, F.col("s") % 9 - 1, F.col("s") % 3, third % 5 - 1, F.col("k"))
    return c.select(*KEY, error.alias("error"))


@query("s4_rgb565_to_rgb888", "SELECT image, brow, bcol, pos, ((h >> 3) << 3) | (h >> 5) AS r, ((((h & 7) << 3) | (l >> 5)) << 2) | ((((h & 7) << 3) | (l >> 5)) >> 4) AS g, ((l & 31) << 3) | ((l & 31) >> 2) AS b FROM (SELECT *, v AS h, (v * 7 + pos) % 256 AS l FROM samples)", SAMPLES_SQL)
def _(spark, d):
    p = long(samples(spark, d), "v")
    r, g, b = S.rgb565_to_rgb(F.col("v"), (F.col("v") * 7 + F.col("pos")) % 256)
    return p.select(*KEY, "pos", r.alias("r"), g.alias("g"), b.alias("b"))


@query("f3_symmetric_division", f"SELECT image, brow, bcol, pos, {rounded('v', 24)} AS v FROM blocks")
def _(spark, d):
    return long(blocks(spark, d), "b").withColumn("v", S.div_round(F.col("v"), 24))


@query("f4_geometry", "SELECT image, brow, bcol, CASE WHEN s = '422' THEN 2 * c WHEN s = '420' THEN 4 * c ELSE l END AS luma, CASE WHEN s = 'gray' THEN 0 WHEN s = '444' THEN l ELSE c END AS chroma FROM (SELECT *, ((w + 7) // 8) * ((h + 7) // 8) AS l, CASE s WHEN '422' THEN ((w + 15) // 16) * ((h + 7) // 8) ELSE ((w + 15) // 16) * ((h + 15) // 16) END AS c FROM (SELECT image, brow, bcol, sum(v) % 97 + 1 AS w, sum(v * pos) % 89 + 1 AS h, ['444', '422', '420', 'gray'][bcol + 1] AS s FROM samples GROUP BY ALL))", SAMPLES_SQL)
def _(spark, d):
    total = F.aggregate("v", F.lit(0), lambda a, x: a + x)
    weighed = F.aggregate(F.transform("v", lambda x, i: x * i), F.lit(0), lambda a, x: a + x)
    s = samples(spark, d).select(*KEY, (total % 97 + 1).alias("w"), (weighed % 89 + 1).alias("h"), F.element_at(F.array(*map(F.lit, ("444", "422", "420", "gray"))), F.col("bcol") + 1).alias("s"))
    luma, chroma = Q.geometry(F.col("w"), F.col("h"), F.col("s"), F.col("s") == "gray")
    return s.select(*KEY, luma.alias("luma"), chroma.alias("chroma"))


TABLES = [(m, i) for m in METHOD_NAMES for i in range(4)]
_Q50 = "q50(pos, y, c) AS (VALUES " + ", ".join(f"({p}, {a}, {b})" for p, (a, b) in enumerate(zip(Q50_LUMA, Q50_CHROMA))) + "), ks(k_idx, kf) AS (VALUES " + ", ".join(f"({i}, {scaled_k(k)})" for i, k in enumerate(K_VALUES)) + ")"


@query("t23_scaled_tables", f", {_Q50} SELECT image, brow, bcol, k_idx, sum(v * greatest(1, (y * kf) >> 10))::BIGINT AS luma, sum(v * greatest(1, (c * kf) >> 10))::BIGINT AS chroma FROM blocks JOIN q50 ON q50.pos = blocks.pos, ks GROUP BY image, brow, bcol, k_idx")
def _(spark, d):
    dot = lambda t: F.aggregate(F.zip_with("b", F.array(*map(F.lit, t)), lambda x, q: x * q), F.lit(0), lambda a, x: a + x).cast("bigint")
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("k_idx"), dot(C.quant_table("identity", k)).alias("luma"), dot(C.quant_table("identity", k, True)).alias("chroma")) for i, k in enumerate(K_VALUES)]))
    return blocks(spark, d).select(*KEY, parts.alias("t")).select(*KEY, "t.*")


for _n, _m in (("t24_norms_rdct", "rdct"), ("t25_norms_j3", "silveira_j3"), ("t25_norms_j7", "silveira_j7")):
    _norms = C.REGISTRY[_m].norms
    _sql = f", {_Q50}, nm(i, f) AS (VALUES " + ", ".join(f"({i}, {f})" for i, f in enumerate(_norms)) + "), t AS (SELECT pos, greatest(1, (((greatest(1, (y * 512) >> 10) * a.f + 512) // 1024) * b.f + 512) // 1024) AS q FROM q50 JOIN nm a ON a.i = pos // 8 JOIN nm b ON b.i = pos % 8) SELECT image, brow, bcol, sum(v * q)::BIGINT AS dot FROM blocks JOIN t ON t.pos = blocks.pos GROUP BY image, brow, bcol"
    query(_n, _sql)(lambda spark, d, m=_m: blocks(spark, d).select(*KEY, F.aggregate(F.zip_with("b", F.array(*map(F.lit, C.quant_table(m, 0.5))), lambda x, q: x * q), F.lit(0), lambda a, x: a + x).cast("bigint").alias("dot")))


@query("t26_reciprocals", f", {table_sql('rdct', 0.5)} SELECT image, brow, bcol, sum(v * ((65536 + q // 2) // q))::BIGINT AS dot FROM blocks JOIN qt ON qt.pos = blocks.pos GROUP BY image, brow, bcol")
def _(spark, d):
    r = F.array(*[F.lit((65536 + q // 2) // q) for q in C.quant_table("rdct", 0.5)])
    return blocks(spark, d).select(*KEY, F.aggregate(F.zip_with("b", r, lambda x, q: (x * q).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("dot"))


@query("t27_quantize", f"{RDCT_LEVELS} SELECT * FROM levels")
def _(spark, d):
    return long(levels(spark, d), "q")


@query("t28_quantize_by_division", f"{forward_sql('rdct')}, {table_sql('rdct', 0.5)} SELECT image, brow, bcol, coef.pos, (sign(v) * ((abs(v) + q // 2) // q))::BIGINT AS v FROM coef JOIN qt ON qt.pos = coef.pos")
def _(spark, d):
    return long(blocks(spark, d).withColumn("c", C.quantize_by_division(C.forward(F.col("b"), "rdct"), C.quant_table("rdct", 0.5))), "c")


@query("t29_dequantize", f"{RDCT_LEVELS} SELECT image, brow, bcol, levels.pos, v * q AS v FROM levels JOIN qt ON qt.pos = levels.pos")
def _(spark, d):
    return long(levels(spark, d).withColumn("q", C.dequantize(F.col("q"), C.quant_table("rdct", 0.5))), "q")


@query("j11_table_join", f"{RDCT_LEVELS} SELECT image, brow, bcol, sum(abs(v) * q)::BIGINT AS weight FROM levels JOIN qt ON qt.pos = levels.pos GROUP BY image, brow, bcol")
def _(spark, d):
    t = spark.createDataFrame(list(enumerate(C.quant_table("rdct", 0.5))), "pos int, w int")
    return long(levels(spark, d), "q").join(F.broadcast(t), "pos").groupBy(*KEY).agg(F.sum(F.abs("v") * F.col("w")).alias("weight"))


@query("t30_zigzag", f"{ZSQL} SELECT * FROM zl")
def _(spark, d):
    return long(scanned(spark, d), "z")


TOKENS = ", used AS (SELECT *, row_number() OVER w - 1 AS seq, pos - lag(pos) OVER w - 1 AS run FROM zl WHERE pos = 0 OR v <> 0 WINDOW w AS (PARTITION BY image, brow, bcol ORDER BY pos)), tok AS (SELECT image, brow, bcol, seq, coalesce(run, 0) AS zero_run, v AS value, CASE WHEN pos = 0 THEN 'DC' ELSE 'AC' END AS kind FROM used UNION ALL SELECT image, brow, bcol, max(seq) + 1, 0, 0, 'EOB' FROM used GROUP BY image, brow, bcol HAVING max(pos) < 63)"


@query("t31_tokens", f"{ZSQL}{TOKENS} SELECT * FROM tok")
def _(spark, d):
    return C.tokens(scanned(spark, d), KEY)


@query("t32_from_tokens", f"{ZSQL} SELECT * FROM zl")
def _(spark, d):
    return long(C.from_tokens(C.tokens(scanned(spark, d), KEY), KEY), "z")


@query("w2_last_nonzero", f"{ZSQL} SELECT image, brow, bcol, coalesce(max(CASE WHEN v <> 0 THEN pos END), -1) AS last FROM zl GROUP BY image, brow, bcol")
def _(spark, d):
    return scanned(spark, d).select(*KEY, C.last_nonzero(F.col("z")).alias("last"))


BYTES = ", rb AS (SELECT image, brow, bcol, 2 + 3 * count(CASE WHEN pos > 0 AND v <> 0 THEN 1 END) + CASE WHEN max(CASE WHEN v <> 0 THEN pos END) = 63 THEN 0 ELSE 3 END AS bytes FROM zl GROUP BY image, brow, bcol)"


@query("a5_rle_bytes", f"{ZSQL}{BYTES} SELECT * FROM rb")
def _(spark, d):
    return scanned(spark, d).select(*KEY, C.rle_bytes(F.col("z")).alias("bytes"))


@query("a7_amplitude_bitrate", f"{ZSQL} SELECT image, avg((last + 1) * 8 / 64.0) AS bitrate FROM (SELECT image, brow, bcol, coalesce(max(CASE WHEN v <> 0 THEN pos END), -1) AS last FROM zl GROUP BY image, brow, bcol) GROUP BY image")
def _(spark, d):
    return scanned(spark, d).groupBy("image").agg(F.avg((C.last_nonzero(F.col("z")) + 1) * 8 / 64.0).alias("bitrate"))


@query("a9_zero_share", f"{ZSQL} SELECT image, 100 * avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END) AS zeros FROM zl GROUP BY image")
def _(spark, d):
    zeros = F.size(F.filter("z", lambda v: v == 0))
    return scanned(spark, d).groupBy("image").agg((100 * F.sum(zeros) / (64 * F.count("*"))).alias("zeros"))


def compared_sql(methods: list[str], ks: list[int]) -> str:
    """cmp: levels and reconstructions of methods beside those of the matrix method, by block and k."""
    parts, out = [LISTS], []
    for m in ["matrix", *methods]:
        tables = " ".join(f"WHEN {i} THEN {literal(C.quant_table(m, K_VALUES[i]))}" for i in ks)
        parts.append(f", {list_transform_sql(m, False, 'bl', BLOCK_KEY + ', b', 'b', 'c', 'f_' + m)}, l_{m} AS (SELECT image, brow, bcol, k_idx, b, t, {quantized_sql('c', 't')} AS q FROM (SELECT *, CASE k_idx {tables} END AS t FROM f_{m}, (VALUES {', '.join(f'({i})' for i in ks)}) kk(k_idx))), d_{m} AS (SELECT *, {dequantized_sql('q', 't')} AS d FROM l_{m}), {list_transform_sql(m, True, 'd_' + m, 'image, brow, bcol, k_idx, b, q', 'd', 'd', 'r_' + m)}")
    for m in methods:
        error = lambda t: f"list_sum([({t}.d[p + 1] - {t}.b[p + 1])::BIGINT * ({t}.d[p + 1] - {t}.b[p + 1]) FOR p IN range(64)])"
        out.append(f"SELECT a.image, '{m}' AS method, a.k_idx, 64 AS total, list_sum([CASE WHEN a.q[p + 1] <> z.q[p + 1] THEN 1 ELSE 0 END FOR p IN range(64)]) AS diffs, {error('a')} AS sse, {error('z')} AS sse_matrix FROM r_{m} a JOIN r_matrix z USING (image, brow, bcol, k_idx)")
    return "".join(parts) + ", cmp AS (" + " UNION ALL ".join(out) + ")"


def compared(spark, d, methods, ks):
    return C.against_matrix(blocks(spark, d), KEY, [(i, K_VALUES[i]) for i in ks], methods)


@query("j2_coefficient_differences", f"{compared_sql(['loeffler', 'rdct', 'silveira_j3', 'silveira_j7'], [0, 1, 2, 3])} SELECT image, method, k_idx, sum(total)::BIGINT AS total, sum(diffs)::BIGINT AS diffs FROM cmp GROUP BY image, method, k_idx")
def _(spark, d):
    return compared(spark, d, ["loeffler", "rdct", "silveira_j3", "silveira_j7"], [0, 1, 2, 3]).groupBy("image", "method", "k_idx").agg(F.sum("total").alias("total"), F.sum("diffs").alias("diffs"))


EQUIVALENT = f"{compared_sql(['loeffler'], [0, 1, 2, 3])}, eq AS (SELECT image, k_idx, sum(total)::BIGINT AS total, sum(diffs)::BIGINT AS diffs, sum(sse)::BIGINT AS sse, sum(sse_matrix)::BIGINT AS sse_matrix FROM cmp GROUP BY image, k_idx), ev AS (SELECT image, k_idx, total, diffs, CASE WHEN sse = 0 THEN 100.0 ELSE 10 * log10(65025.0 / (sse::DOUBLE / total)) END AS psnr_loeffler, CASE WHEN sse_matrix = 0 THEN 100.0 ELSE 10 * log10(65025.0 / (sse_matrix::DOUBLE / total)) END AS psnr_matrix FROM eq)"


def equivalence(spark, d):
    """Levels of the two cosine kernels: differences, their number and both PSNRs, by image and quality factor."""
    g = compared(spark, d, ["loeffler"], [0, 1, 2, 3]).groupBy("image", "k_idx").agg(*[F.sum(c).alias(c) for c in ("total", "diffs", "sse", "sse_matrix")])
    g = g.select("image", "k_idx", "total", "diffs", S.psnr(F.col("sse"), F.col("total")).alias("psnr_loeffler"), S.psnr(F.col("sse_matrix"), F.col("total")).alias("psnr_matrix"))
    return g.withColumn("delta_psnr", F.abs(F.col("psnr_loeffler") - F.col("psnr_matrix")))


@query("j4_equivalence", f"{EQUIVALENT} SELECT *, abs(psnr_loeffler - psnr_matrix) AS delta_psnr FROM ev")
def _(spark, d):
    return equivalence(spark, d)


@query("j12_differences_by_k", f"{EQUIVALENT} SELECT image, {', '.join(f'max(CASE WHEN k_idx = {i} THEN diffs END) AS k{i}' for i in range(4))} FROM ev GROUP BY image")
def _(spark, d):
    """Images by quality factors: how many coefficients of the two cosine kernels differ."""
    return equivalence(spark, d).withColumn("cell", F.concat(F.lit("k"), "k_idx")).groupBy("image").pivot("cell", [f"k{i}" for i in range(4)]).agg(F.first("diffs"))


@query("a18_differing_coefficients", f"{compared_sql(['silveira_j3'], [2])} SELECT sum(total)::BIGINT AS total, sum(diffs)::BIGINT AS diffs, 100.0 * sum(diffs) / sum(total) AS percent FROM cmp")
def _(spark, d):
    g = compared(spark, d, ["silveira_j3"], [2]).agg(F.sum("total").alias("total"), F.sum("diffs").alias("diffs"))
    return g.withColumn("percent", 100.0 * F.col("diffs") / F.col("total"))


@query("a19_verdict", f"{EQUIVALENT} SELECT sum(diffs)::BIGINT AS diffs, sum(total)::BIGINT AS total, max(abs(psnr_loeffler - psnr_matrix)) AS largest_delta, sum(diffs) = 0 AS same FROM ev")
def _(spark, d):
    return equivalence(spark, d).agg(F.sum("diffs").alias("diffs"), F.sum("total").alias("total"), F.max("delta_psnr").alias("largest_delta"), (F.sum("diffs") == 0).alias("same"))


RECON = f"{RDCT_LEVELS}, deq AS (SELECT image, brow, bcol, levels.pos, v * q AS v FROM levels JOIN qt ON qt.pos = levels.pos){inverse_sql('rdct', 'deq')}, pair AS (SELECT a.image, a.brow * 8 + a.pos // 8 AS y, a.bcol * 8 + a.pos % 8 AS x, a.v + 128 AS a, greatest(0, least(255, b.v + 128)) AS b FROM blocks a JOIN back b ON a.image = b.image AND a.brow = b.brow AND a.bcol = b.bcol AND a.pos = b.pos)"


def pairs(spark, d, method: str = "rdct", k: float = 0.5):
    t = C.round_trip(blocks(spark, d), method, k).select(*KEY, F.posexplode(F.arrays_zip("b", "d")).alias("pos", "z"))
    y, x = (F.col("brow") * 8 + F.floor(F.col("pos") / 8)).cast("int"), F.col("bcol") * 8 + F.col("pos") % 8
    return t.select("image", y.alias("y"), x.alias("x"), (F.col("z.b") + 128).alias("a"), S.clamp(F.col("z.d") + 128).alias("b"))


PSNR = "CASE WHEN sse = 0 THEN {} ELSE 10 * log10(65025.0 / (sse::DOUBLE / n)) END"
SSE = ", e AS (SELECT image, sum((a - b) * (a - b))::BIGINT AS sse, count(*) AS n FROM pair GROUP BY image)"


@query("a1_psnr", f"{RECON}{SSE} SELECT image, sse, sse::DOUBLE / n AS mse, {PSNR.format('100.0')} AS psnr FROM e")
def _(spark, d):
    return Q.error(pairs(spark, d), ["image"])


@query("f18_psnr_x100", f"{RECON}{SSE} SELECT image, CASE WHEN sse = 0 THEN 9999 ELSE least(9999, greatest(0, floor({PSNR.format('100.0')} * 100 + 0.5))) END::INTEGER AS x100 FROM e")
def _(spark, d):
    return Q.error(pairs(spark, d), ["image"]).select("image", S.psnr_x100(F.col("psnr"), F.col("sse")).alias("x100"))


@query("a2_psnr_infinite", f"SELECT image, brow, bcol, CASE WHEN sse = 0 THEN 'exact' ELSE 'lossy' END AS kind, CASE WHEN sse = 0 THEN 'Infinity'::DOUBLE ELSE 10 * log10(65025.0 / (sse::DOUBLE / 64)) END AS psnr FROM (SELECT image, brow, bcol, sum((v - v // 2 * 2) * (v - v // 2 * 2)) AS sse FROM samples GROUP BY ALL)", SAMPLES_SQL)
def _(spark, d):
    p = long(samples(spark, d), "v").withColumn("w", F.floor(F.col("v") / 2).cast("int") * 2)
    return Q.error(p, KEY, "v", "w", float("inf")).select(*KEY, F.when(F.col("psnr") == float("inf"), "exact").otherwise("lossy").alias("kind"), "psnr")


@query("a4_global_ssim", f"{RECON} SELECT image, (2 * ma * mb + 6.5025) * (2 * cv + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)) AS ssim FROM (SELECT image, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cv FROM pair GROUP BY image)")
def _(spark, d):
    return Q.global_ssim(pairs(spark, d), ["image"])


CASE = ("rdct", 0.5, "444")
SUMS = ("sa", "sb", "saa", "sbb", "sab")


def box_sql(keys: str, source: str) -> str:
    """q3: sums over the 7 x 7 boxes of source (keys, x, y, a, b) by two windows."""
    box = ", ".join(f"sum({c}) OVER w AS {c}" for c in SUMS)
    frame = "ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING"
    return f", q0 AS (SELECT {keys}, x, y, a AS sa, b AS sb, a * a AS saa, b * b AS sbb, a * b AS sab FROM {source}), q1 AS (SELECT {keys}, x, y, {box}, count(*) OVER w AS n FROM q0 WINDOW w AS (PARTITION BY {keys}, x ORDER BY y {frame})), q2 AS (SELECT {keys}, x, y, {box}, count(*) OVER w AS n FROM q1 WHERE n = 7 WINDOW w AS (PARTITION BY {keys}, y ORDER BY x {frame})), q3 AS (SELECT * FROM q2 WHERE n = 7)"


def ssim_sql(keys: str) -> str:
    """Mean similarity of the boxes q3 by keys."""
    return f"SELECT {keys}, avg((2 * ma * mb + 6.5025) * (2 * (sab - 49 * ma * mb) / 48 + 58.5225) / ((ma * ma + mb * mb + 6.5025) * ((saa - 49 * ma * ma) / 48 + (sbb - 49 * mb * mb) / 48 + 58.5225))) AS ssim FROM (SELECT *, sa / 49 AS ma, sb / 49 AS mb FROM q3) GROUP BY {keys}"


COMPARED = f"{job_sql(*CASE)}, pair3 AS (SELECT f.image, f.y, f.x, unnest([0, 1, 2]) AS channel, unnest([f.r, f.g, f.b]) AS a, unnest([p.r, p.g, p.b]) AS b FROM frames f JOIN px p ON p.image = f.image AND p.y = f.y AND p.x = f.x)"


def one_job(spark, d):
    """Frames beside what one job makes of them."""
    return P.round_trips(frame_strips(spark, d), ["image"], [(CASE[0], 2, CASE[1])], CASE[2])


@query("w1_box_sums", f"{COMPARED}{box_sql('image, channel', 'pair3')} SELECT image, channel, y, x, {', '.join(f'{c}::BIGINT AS {c[1:]}' for c in SUMS)} FROM q3", FRAMES_SQL)
def _(spark, d):
    return P.box_sums(one_job(spark, d), ["image"])


@query("a3_windowed_ssim", f"{COMPARED}{box_sql('image, channel', 'pair3')}, s AS ({ssim_sql('image, channel')}), e AS (SELECT image, channel, coalesce(ssim, 1.0) AS ssim FROM (SELECT DISTINCT image, channel FROM pair3) LEFT JOIN s USING (image, channel)) SELECT image, avg(ssim) AS ssim, max(CASE channel WHEN 0 THEN ssim END) AS ssim_r, max(CASE channel WHEN 1 THEN ssim END) AS ssim_g, max(CASE channel WHEN 2 THEN ssim END) AS ssim_b FROM e GROUP BY image", FRAMES_SQL)
def _(spark, d):
    """Similarity of each channel over all windows, and the mean of the channels."""
    return P.distortion(one_job(spark, d), ["image"]).select("image", "ssim", "ssim_r", "ssim_g", "ssim_b")


def raster_sql() -> str:
    """all_px: pixels that every method and k makes of the frames, and bytes: the run-length bytes of their levels."""
    parts, blocks_, sizes = [f"{planes_sql('444')}{blocks_sql('444')}"], [], []
    key = f"{PLACE}, k_idx"
    size = f"2 + 3 * list_sum([CASE WHEN p > 0 AND q[p + 1] <> 0 THEN 1 ELSE 0 END FOR p IN range(64)]) + CASE WHEN q[{zigzag()[63] + 1}] <> 0 THEN 0 ELSE 3 END"
    for m in METHOD_NAMES:
        table = " ".join(f"WHEN k_idx = {i} AND plane {'=' if not c else '<>'} 'y' THEN {literal(C.quant_table(m, k, c))}" for i, k in enumerate(K_VALUES) for c in (False, True))
        parts.append(f", {list_transform_sql(m, False, 'fb', PLACE, 'b', 'c', 'f_' + m)}, l_{m} AS (SELECT {key}, t, {quantized_sql('c', 't')} AS q FROM (SELECT *, CASE {table} END AS t FROM f_{m}, range(0, 4) kk(k_idx))), d_{m} AS (SELECT {key}, {dequantized_sql('q', 't')} AS d FROM l_{m}), {list_transform_sql(m, True, 'd_' + m, key, 'd', 'b', 'r_' + m)}")
        blocks_.append(f"SELECT {key}, '{m}' AS method, b FROM r_{m}")
        sizes.append(f"SELECT image, '{m}' AS method, k_idx, sum({size}) AS stream_bytes FROM l_{m} GROUP BY image, k_idx")
    value = ", ".join(f"max(CASE WHEN plane = '{n}' THEN v END) AS {'yy' if n == 'y' else n}" for n in R.PLANES)
    parts.append(f", all_b AS ({' UNION ALL '.join(blocks_)}), all_1 AS (SELECT image, w, h, method, k_idx, (brow * 8 + pos // 8)::INTEGER AS y, (bcol * 8 + pos % 8)::INTEGER AS x, {value} FROM (SELECT {key}, method, unnest(range(64)) AS pos, unnest(b) AS v FROM all_b) GROUP BY image, w, h, method, k_idx, brow * 8 + pos // 8, bcol * 8 + pos % 8)")
    parts.append(", all_px AS (SELECT image, method, k_idx, y, x, greatest(0, least(255, yy + 128 + ((359 * cr + 128) >> 8))) AS r, greatest(0, least(255, yy + 128 - ((88 * cb + 183 * cr + 128) >> 8))) AS g, greatest(0, least(255, yy + 128 + ((454 * cb + 128) >> 8))) AS b FROM all_1 WHERE y < h AND x < w)")
    return "".join(parts) + f", bytes AS ({' UNION ALL '.join(sizes)})"


@query("j1_raster_reference", f"{raster_sql()}, raw AS (SELECT image, 3 * count(*) AS raw_bytes FROM frames GROUP BY image, w, h HAVING count(*) = w * h), pair4 AS (SELECT f.image, method, k_idx, f.y, f.x, unnest([0, 1, 2]) AS channel, unnest([f.r, f.g, f.b]) AS a, unnest([p.r, p.g, p.b]) AS b FROM frames f JOIN raw USING (image) JOIN all_px p ON p.image = f.image AND p.y = f.y AND p.x = f.x){box_sql('image, method, k_idx, channel', 'pair4')}, s AS ({ssim_sql('image, method, k_idx, channel')}), m AS (SELECT image, method, k_idx, avg(ssim) AS ssim FROM s GROUP BY ALL), e AS (SELECT image, method, k_idx, sum((a - b) * (a - b))::BIGINT AS sse, count(*) AS n FROM pair4 GROUP BY ALL) SELECT z.image, z.method, z.k_idx::INTEGER AS k_idx, stream_bytes::BIGINT AS stream_bytes, (stream_bytes + 24)::BIGINT AS frame_bytes, raw_bytes, raw_bytes / stream_bytes::DOUBLE AS ratio, CASE WHEN sse = 0 THEN 100.0 ELSE 10 * log10(65025.0 / (sse::DOUBLE / n)) END AS psnr, CASE WHEN raw_bytes IS NOT NULL THEN coalesce(ssim, 1.0) END AS ssim, CASE WHEN raw_bytes IS NULL THEN 'REF_MISSING' ELSE 'DECODED' END AS status FROM bytes z LEFT JOIN raw USING (image) LEFT JOIN e ON e.image = z.image AND e.method = z.method AND e.k_idx = z.k_idx LEFT JOIN m ON m.image = z.image AND m.method = z.method AND m.k_idx = z.k_idx", FRAMES_SQL)
def _(spark, d):
    """Twenty records of each image against its raw raster; an image with missing vectors has no raw raster."""
    f = frame_strips(spark, d)
    records = P.round_trips(f, ["image"], [(m, i, k) for m in METHOD_NAMES for i, k in enumerate(K_VALUES)]).drop("data").withColumnRenamed("other", "data").withColumn("mask", F.lit(None).cast("binary"))
    return P.against_raw(records, f.where("mask IS NULL"), "image", ["method", "k_idx"])


@query("a12_brightness", "SELECT image, (sum((306 * r + 601 * g + 117 * b) >> 10) // count(*))::BIGINT AS brightness FROM pixels WHERE (y * 32 + x) % 32 = 0 GROUP BY image", PIXELS_SQL)
def _(spark, d):
    return Q.brightness(pixels(spark, d), ["image"], F.col("y") * 32 + F.col("x"))


@query("a13_brightness_565", "SELECT image, (sum((8 * (r >> 3) + 4 * (g >> 2) + 8 * (b >> 3)) // 3) // count(*))::BIGINT AS brightness FROM pixels WHERE (y * 32 + x) % 32 = 0 GROUP BY image", PIXELS_SQL)
def _(spark, d):
    p = pixels(spark, d).where((F.col("y") * 32 + F.col("x")) % 32 == 0)
    v = F.floor((8 * F.shiftright("r", 3) + 4 * F.shiftright("g", 2) + 8 * F.shiftright("b", 3)) / 3)
    return p.groupBy("image").agg(F.floor(F.sum(v) / F.count("*")).alias("brightness"))


@query("a14_saturation", "SELECT image, avg(CASE WHEN greatest(r, g, b) >= 250 THEN 100.0 ELSE 0.0 END) AS any_250, avg(CASE WHEN least(r, g, b) >= 250 THEN 100.0 ELSE 0.0 END) AS all_250, avg(CASE WHEN r + g + b >= 690 THEN 100.0 ELSE 0.0 END) AS gray_230, sum(r + g + b) / (3.0::DOUBLE * count(*)) AS gray FROM pixels GROUP BY image", PIXELS_SQL)
def _(spark, d):
    return Q.saturation(pixels(spark, d), ["image"])


@query("f28_image_metadata", "SELECT image, (row_number() OVER (ORDER BY image))::INTEGER AS place, px AS pixels, px / 1000000 AS megapixels, round(w / h, 4) AS aspect FROM (SELECT image, count(*) AS px, max(x) + 1 AS w, max(y) + 1 AS h FROM frames GROUP BY image)", FRAMES_SQL)
def _(spark, d):
    g = frames(spark, d).groupBy("image").agg(F.count("*").alias("pixels"), (F.max("x") + 1).alias("wide"), (F.max("y") + 1).alias("high"))
    return A.numbered(g, "image").select("image", F.col("place").cast("int").alias("place"), "pixels", (F.col("pixels") / 1_000_000).alias("megapixels"), F.round(F.col("wide") / F.col("high"), 4).alias("aspect"))


def sweep_parts() -> str:
    """sw: every block by every method and k, with levels q and reconstruction d."""
    parts, out = [LISTS], []
    for m in METHOD_NAMES:
        tables = " ".join(f"WHEN {i} THEN {literal(C.quant_table(m, k))}" for i, k in enumerate(K_VALUES))
        parts.append(f", {list_transform_sql(m, False, 'bl', BLOCK_KEY + ', b', 'b', 'c', 'f_' + m)}, l_{m} AS (SELECT image, brow, bcol, k_idx, b, t, {quantized_sql('c', 't')} AS q FROM (SELECT *, CASE k_idx {tables} END AS t FROM f_{m}, range(0, 4) kk(k_idx))), d_{m} AS (SELECT *, {dequantized_sql('q', 't')} AS d FROM l_{m}), {list_transform_sql(m, True, 'd_' + m, 'image, brow, bcol, k_idx, b, q', 'd', 'd', 'r_' + m)}")
        out.append(f"SELECT image, brow, bcol, '{m}' AS method, k_idx::INTEGER AS k_idx, q, b, d FROM r_{m}")
    return "".join(parts) + f", sw AS ({' UNION ALL '.join(out)})"


def sweep_sql() -> str:
    size = f"2 + 3 * list_sum([CASE WHEN p > 0 AND q[p + 1] <> 0 THEN 1 ELSE 0 END FOR p IN range(64)]) + CASE WHEN q[{zigzag()[63] + 1}] <> 0 THEN 0 ELSE 3 END"
    return f"{sweep_parts()} SELECT image, method, k_idx, sum(bytes) / (8.0 * count(*)) AS bpp, CASE WHEN sum(sse) = 0 THEN 100.0 ELSE 10 * log10(65025.0 / (sum(sse)::DOUBLE / (64 * count(*)))) END AS psnr FROM (SELECT image, method, k_idx, {size} AS bytes, list_sum([(d[p + 1] - b[p + 1])::BIGINT * (d[p + 1] - b[p + 1]) FOR p IN range(64)])::BIGINT AS sse FROM sw) GROUP BY image, method, k_idx"


@query("t35_sweep", sweep_sql())
def _(spark, d):
    """Every block by every method and quality factor: bytes and squared error by image, method and k."""
    s = C.sweep(blocks(spark, d), list(enumerate(K_VALUES)))
    e = F.aggregate(F.zip_with("b", "d", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("bigint"), lambda t, x: t + x)
    g = s.groupBy("image", "method", "k_idx").agg(F.sum(C.rle_bytes(C.scan(F.col("q")))).alias("bytes"), F.sum(e).alias("sse"), F.count("*").alias("blocks"))
    return g.select("image", "method", "k_idx", (F.col("bytes") / (8 * F.col("blocks"))).alias("bpp"), S.psnr(F.col("sse"), 64 * F.col("blocks")).alias("psnr"))


SCANNED = f"{job_sql(*CASE)}, zl AS (SELECT {PLACE}, [q[z + 1] FOR z IN {literal(zigzag(), 'INTEGER')}] AS z FROM lv)"


def scanned_planes(spark, d):
    return P.level_blocks(P.compress(frame_strips(spark, d), ["image"], *CASE), ["image"]).select(*IMAGE, "plane", C.scan(F.col("q")).alias("z"))


@query("a6_rle_bpp", f"{SCANNED} SELECT image, sum(2 + 3 * list_sum([CASE WHEN p > 0 AND z[p + 1] <> 0 THEN 1 ELSE 0 END FOR p IN range(64)]) + CASE WHEN z[64] <> 0 THEN 0 ELSE 3 END) * 8 / (w * h)::DOUBLE AS bpp FROM zl GROUP BY image, w, h", FRAMES_SQL)
def _(spark, d):
    """Run-length bytes of three planes over the pixels of the image."""
    return scanned_planes(spark, d).groupBy(*IMAGE).agg(F.sum(C.rle_bytes(F.col("z"))).alias("n")).select("image", (F.col("n") * 8 / (F.col("w") * F.col("h")).cast("double")).alias("bpp"))


@query("a24_mean_of_planes", f"{SCANNED}, rate AS (SELECT image, plane, avg((coalesce(list_max([CASE WHEN z[p + 1] <> 0 THEN p ELSE -1 END FOR p IN range(64)]), -1) + 1) * 8 / 64.0) AS bpp FROM zl GROUP BY image, plane) SELECT image, (max(CASE WHEN plane = 'y' THEN bpp END) + max(CASE WHEN plane = 'cb' THEN bpp END) + max(CASE WHEN plane = 'cr' THEN bpp END)) / 3 AS combined FROM rate GROUP BY image", FRAMES_SQL)
def _(spark, d):
    """Unweighted mean of the three planes' amplitude bitrates."""
    rate = scanned_planes(spark, d).groupBy("image", "plane").agg(F.avg((C.last_nonzero(F.col("z")) + 1) * 8 / 64.0).alias("bpp"))
    g = rate.groupBy("image").pivot("plane", list(R.PLANES)).agg(F.max("bpp"))
    return g.select("image", ((F.col("y") + F.col("cb") + F.col("cr")) / 3).alias("combined"))


@query("a8_pooled_bitrate", f"{SCANNED} SELECT image, avg((coalesce(list_max([CASE WHEN z[p + 1] <> 0 THEN p ELSE -1 END FOR p IN range(64)]), -1) + 1) * 8 / 64.0) AS bitrate, count(*) AS blocks FROM zl GROUP BY image", FRAMES_SQL)
def _(spark, d):
    """Amplitude bitrate of an image over the blocks of its three planes together."""
    return scanned_planes(spark, d).groupBy("image").agg(F.avg((C.last_nonzero(F.col("z")) + 1) * 8 / 64.0).alias("bitrate"), F.count("*").alias("blocks"))
