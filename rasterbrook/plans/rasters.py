"""Queries of the aggregates, filters and neighbourhood operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import neighbourhood as N
from ..operators import reductions as A
from ..operators.selection import exact_percentiles
from .bridge import PATCH, PLANE8, RGB, RGB8, out, patch, plane8, query, rgb, rgb8, sql_out
from .pointwise import DENSITY, GRAY, LUMA, SAT, dense

SPREAD = "(greatest(r, g, b) - least(r, g, b))"


def each(df: DataFrame, keys: str = "image_id") -> DataFrame:
    return out(df, keys, **{c: F.col(c) for c in df.columns if c not in keys.split()})


def wrap(inner: str, ctes: str, cols: str, keys: str = "image_id") -> str:
    return sql_out(f"({inner})", ctes, keys, **{c: c for c in cols.split()})


@query("agg01_percentiles", wrap("SELECT image_id, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.5) AS mid, quantile_cont(v, 0.995) AS hi FROM patch GROUP BY image_id", PATCH, "lo mid hi"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return each(patch(spark, d).groupBy("image_id").agg(*[A.pct(F.col("v"), p).alias(n) for n, p in (("lo", 0.5), ("mid", 50), ("hi", 99.5))]))


@query("agg01_selected", wrap("SELECT image_id, " + ", ".join(f"quantile_cont(v, {p}) AS p{i}" for i, p in enumerate((0, 0.01, 0.355, 0.5, 0.99, 1))) + " FROM s GROUP BY image_id", RGB + ", s AS (SELECT image_id, unnest([r, g, b]) AS v FROM rgb)", "p0 p1 p2 p3 p4 p5"))
def _(spark: SparkSession, d: str) -> DataFrame:
    values = rgb(spark, d).select("image_id", F.explode(F.array("r", "g", "b")).alias("v"))
    return each(exact_percentiles(values, F.col("v"), {"p0": 0, "p1": 1, "p2": 35.5, "p3": 50, "p4": 99, "p5": 100}))


_REFLECT = "CASE WHEN (({i}) % 14 + 14) % 14 < 8 THEN (({i}) % 14 + 14) % 14 ELSE 14 - (({i}) % 14 + 14) % 14 END"
_METRICS = RGB8 + f""", q AS (SELECT *, floor({GRAY}) AS gray, {SAT} AS sat FROM rgb8), lap AS (SELECT q.image_id, q.gray, q.sat, q.r, q.g, q.b,
    sum(p.gray) - 4 * any_value(q.gray) AS l FROM q, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx), q p WHERE p.image_id = q.image_id
    AND p.y = {_REFLECT.format(i="q.y + dy")} AND p.x = {_REFLECT.format(i="q.x + dx")} GROUP BY q.image_id, q.y, q.x, q.gray, q.sat, q.r, q.g, q.b)"""
_M9 = "gray_mean gray_std clipped_black clipped_white blue_red green_magenta spread saturation sharpness"


@query("agg02_image_metrics", wrap("""SELECT image_id, avg(gray) AS gray_mean, stddev_pop(gray) AS gray_std, avg((gray <= 2)::INT) AS clipped_black,
    avg((gray >= 253)::INT) AS clipped_white, (avg(b) - avg(r)) / 255 AS blue_red, (2 * avg(g) - avg(b) - avg(r)) / 255 AS green_magenta,
    (greatest(avg(r), avg(g), avg(b)) - least(avg(r), avg(g), avg(b))) / 255 AS spread, avg(sat) AS saturation, var_pop(l) AS sharpness FROM lap GROUP BY image_id""", _METRICS, _M9))
def _(spark: SparkSession, d: str) -> DataFrame:
    return each(A.image_metrics(rgb8(spark, d)))


@query("agg03_deviation", wrap("SELECT image_id, stddev_pop(v) AS std, var_pop(v) AS var, stddev_pop(v) / greatest(avg(v), 0.000000001) AS cv FROM patch GROUP BY image_id", PATCH, "std var cv"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return each(patch(spark, d).groupBy("image_id").agg(F.stddev_pop("v").alias("std"), F.var_pop("v").alias("var"), A.cv(F.col("v")).alias("cv")))


def _strips(frm: str, n: int) -> str:
    return f"""strips AS (SELECT *, 'top' AS side FROM {frm} WHERE y < {n} UNION ALL SELECT *, 'bottom' FROM {frm} WHERE y >= 8 - {n}
        UNION ALL SELECT *, 'left' FROM {frm} WHERE x < {n} UNION ALL SELECT *, 'right' FROM {frm} WHERE x >= 8 - {n})"""


FILM_BASE = f"""q AS (SELECT *, round((r + g + b) / 3, 9) AS gray FROM rgb8), p AS (SELECT image_id, round(quantile_cont(gray, 0.99), 9) AS p99 FROM q GROUP BY image_id), {_strips("q", 1)},
    s AS (SELECT image_id, round(quantile_cont(gray, 0.8), 9) AS p80 FROM strips GROUP BY image_id)"""


@query("agg04_film_base", wrap("SELECT image_id, " + ", ".join(f"least(greatest(quantile_cont({c}, 0.95), 32), 255) AS {c}" for c in "rgb") + " FROM u GROUP BY image_id", RGB8 + f""",
    {FILM_BASE},
    u AS (SELECT image_id, r, g, b FROM q JOIN p USING (image_id) WHERE gray >= p99 UNION ALL SELECT image_id, r, g, b FROM strips JOIN s USING (image_id) WHERE gray >= p80)""", "r g b"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return each(A.film_base(rgb8(spark, d), least=1))


@query("agg05_side_fusion", wrap("SELECT image_id, " + ", ".join(f"median({c}) AS {c}" for c in "rgb") + ", count(*) AS sides, CASE WHEN count(*) = 1 THEN 0.35 ELSE least(greatest(1 - 4 * avg(e), 0), 1) END AS consistency FROM k GROUP BY image_id", RGB + f""",
    {_strips("rgb", 1)}, s AS (SELECT image_id, side, median(r) AS r, median(g) AS g, median(b) AS b FROM strips GROUP BY ALL),
    m AS (SELECT image_id, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM s GROUP BY image_id),
    e AS (SELECT *, sqrt((r - mr) * (r - mr) + (g - mg) * (g - mg) + (b - mb) * (b - mb)) / greatest(sqrt(mr * mr + mg * mg + mb * mb), 0.000001) AS e FROM s JOIN m USING (image_id)),
    q AS (SELECT image_id, quantile_cont(e, 0.6) AS p60 FROM e GROUP BY image_id), k AS (SELECT * FROM e JOIN q USING (image_id) WHERE e <= greatest(p60, 0.08))""", "r g b sides consistency"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return each(A.side_fusion(rgb(spark, d)))


@query("agg06_leader_range", wrap("SELECT *, CASE WHEN greatest(dmax_r, dmax_g, dmax_b) > 4 THEN 0 ELSE 1 END AS confidence FROM (SELECT image_id, " + ", ".join(f"quantile_cont({c}, 0.1) FILTER (l <= lo) AS dmin_{c}, quantile_cont({c}, 0.9) FILTER (l >= hi) AS dmax_{c}" for c in "rgb") + " FROM q JOIN p USING (image_id) GROUP BY image_id)", DENSITY + f""",
    q AS (SELECT *, {LUMA} AS l FROM density), p AS (SELECT image_id, quantile_cont(l, 0.01) AS lo, quantile_cont(l, 0.99) AS hi FROM q GROUP BY image_id)""", "dmin_r dmin_g dmin_b dmax_r dmax_g dmax_b confidence"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return each(A.leader_range(dense(spark, d)))


def _flat(spark: SparkSession, d: str) -> DataFrame:
    """Mean plane of all patches over its own mean: the illumination of the bench."""
    p = patch(spark, d).groupBy("y", "x").agg(F.avg("v").alias("flat"))
    mean = p.agg(F.avg("flat").alias("m"))
    return p.join(F.broadcast(mean), F.lit(True)).select("y", "x", (F.col("flat") / F.col("m")).alias("flat"))


FLAT = PATCH + ", fp AS (SELECT y, x, avg(v) AS flat FROM patch GROUP BY y, x), flat AS (SELECT y, x, flat / (SELECT avg(flat) FROM fp) AS flat FROM fp)"


@query("prj15_flat_field", sql_out("patch JOIN flat USING (y, x)", FLAT, v="v / pow(greatest(flat, 0.000001), 0.8)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    both = patch(spark, d).join(F.broadcast(_flat(spark, d)), ["y", "x"])  # 64 rows
    return out(both, v=F.col("v") / F.pow(F.greatest("flat", F.lit(1e-6)), F.lit(0.8)))


@query("jn02_calibration_join", sql_out("patch JOIN flat USING (y, x)", FLAT, v="least(greatest(v / greatest(flat, 0.000001), 0), 1)", flat="flat"))
def _(spark: SparkSession, d: str) -> DataFrame:
    both = patch(spark, d).join(F.broadcast(_flat(spark, d)), ["y", "x"])
    return out(both, v=C.clamp(F.col("v") / F.greatest("flat", F.lit(1e-6))), flat=F.col("flat"))


def _box(frm: str, value: str, size: int) -> str:
    k = size // 2
    return f"""box AS (SELECT q.image_id, q.y, q.x, greatest(avg(p.{value} * p.{value}) - avg(p.{value}) * avg(p.{value}), 0) AS variance
        FROM {frm} q, range({-k}, {k + 1}) a(dy), range({-k}, {k + 1}) b(dx), {frm} p WHERE p.image_id = q.image_id
        AND p.y = {_REFLECT.format(i="q.y + dy")} AND p.x = {_REFLECT.format(i="q.x + dx")} GROUP BY ALL)"""


@query("win02_local_variance", sql_out("box", PATCH + ", " + _box("patch", "v", 3), variance="variance"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(N.local_variance(patch(spark, d), "v", 3), variance=F.col("variance"))


@query("agg07_base_ratio", wrap("""SELECT image_id, quantile_cont(ratio, 0.9) AS ratio, count(*) AS n, least(greatest(1 - 2 * ((quantile_cont(ratio, 0.9) - quantile_cont(ratio, 0.1)) / greatest(median(ratio), 0.000001)), 0), 1) AS confidence FROM k GROUP BY image_id""", FLAT + ", " + _box("patch", "v", 3) + """,
    q AS (SELECT image_id, v / greatest(flat, 0.000001) AS ratio, v, variance FROM patch JOIN flat USING (y, x) JOIN box USING (image_id, y, x)),
    p AS (SELECT image_id, quantile_cont(variance, 0.4) AS v40, quantile_cont(v, 0.05) AS l5, quantile_cont(v, 0.92) AS l92 FROM q GROUP BY image_id),
    c AS (SELECT *, v BETWEEN l5 AND l92 AS c1, v BETWEEN l5 AND l92 AND round(variance, 9) <= round(v40, 9) AS c2 FROM q JOIN p USING (image_id)),
    n AS (SELECT image_id, count(*) FILTER (c1) AS n1, count(*) FILTER (c2) AS n2 FROM c GROUP BY image_id),
    k AS (SELECT * FROM c JOIN n USING (image_id) WHERE CASE WHEN n2 >= 22 THEN c2 WHEN n1 >= 8 THEN c1 ELSE true END)""", "ratio n confidence"))
def _(spark: SparkSession, d: str) -> DataFrame:
    both = patch(spark, d).withColumnRenamed("v", "base").join(F.broadcast(_flat(spark, d)), ["y", "x"])
    return each(A.base_ratio(both, 22, 8))


_MID = RGB + f""", q AS (SELECT *, {LUMA} AS l, {SPREAD} AS s FROM rgb),
    p AS (SELECT image_id, quantile_cont(l, 0.2) AS l20, quantile_cont(l, 0.8) AS l80, quantile_cont(s, 0.7) AS s70 FROM q GROUP BY image_id),
    c AS (SELECT *, l BETWEEN l20 AND l80 AS c1, l BETWEEN l20 AND l80 AND s <= s70 AS c2 FROM q JOIN p USING (image_id)),
    n AS (SELECT image_id, count(*) FILTER (c1) AS n1, count(*) FILTER (c2) AS n2 FROM c GROUP BY image_id)"""


@query("agg09_mid_neutral_gains", wrap("SELECT image_id, " + ", ".join(f"least(greatest((mr + mg + mb) / 3 / greatest(m{c}, 0.000001), 0.78), 1.28) AS gain_{c}" for c in "rgb") + " FROM (SELECT image_id, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM c JOIN n USING (image_id) WHERE CASE WHEN n2 >= 28 THEN c2 WHEN n1 >= 8 THEN c1 ELSE true END GROUP BY image_id)", _MID, "gain_r gain_g gain_b"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return each(A.mid_neutral_gains(rgb(spark, d), 28, 8))


@query("agg10_middle_gray", wrap("SELECT image_id, gain, log2(gain) AS ev FROM (SELECT image_id, least(greatest(0.18::DOUBLE / greatest(median(l), 0.000001), 0.25), 4) AS gain FROM c JOIN n USING (image_id) WHERE CASE WHEN n1 >= 16 THEN c1 ELSE true END GROUP BY image_id)", _MID, "gain ev"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return each(A.middle_gray(rgb(spark, d), enough=16))


@query("agg11_cfa_stats", sql_out("(SELECT image_id, y % 2 AS py, x % 2 AS px, avg(v) AS mean, min(v) AS min, max(v) AS max, stddev_pop(v) AS std, avg((v >= 0.995)::INT) AS saturated, avg((v <= 0.001)::INT) AS dark FROM patch GROUP BY ALL)", PATCH, "image_id py px", mean="mean", min="min", max="max", std="std", saturated="saturated", dark="dark"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return each(A.cfa_stats(patch(spark, d)), "image_id py px")


@query("agg12_uniformity", wrap("""SELECT image_id, stddev_pop(v) / greatest(avg(v), 0.000000001) AS cv, (quantile_cont(v, 0.95) - quantile_cont(v, 0.05)) / greatest(median(v), 0.000001) AS span,
    max(v) / greatest(median(v), 0.000001) - 1 AS hotspot, avg(v) FILTER (c) / greatest(avg(v) FILTER (NOT c), 0.000001) AS centre_edge, avg((v >= 0.995)::INT) AS clipped_high, avg((v <= 0.001)::INT) AS clipped_low
    FROM (SELECT *, y >= 2.4 AND y < 5.6 AND x >= 2.4 AND x < 5.6 AS c FROM patch) GROUP BY image_id""", PATCH, "cv span hotspot centre_edge clipped_high clipped_low"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return each(A.uniformity(patch(spark, d)))


_DIAG = [f"{c}_{n}" for c in "rgb" for n in ("mean", "p95", "min", "max")]


@query("agg13_stage_diagnostics", wrap("SELECT image_id, " + ", ".join(f"avg({c}) AS {c}_mean, quantile_cont({c}, 0.95) AS {c}_p95, min({c}) AS {c}_min, max({c}) AS {c}_max" for c in "rgb") + f", avg({SPREAD}) AS chroma_mean, quantile_cont({SPREAD}, 0.95) AS chroma_p95 FROM rgb GROUP BY image_id", RGB, " ".join([*_DIAG, "chroma_mean", "chroma_p95"])))
def _(spark: SparkSession, d: str) -> DataFrame:
    return each(A.stage_diagnostics(rgb(spark, d)))


@query("agg14_grid_estimates", sql_out("(SELECT image_id, gy, gx, median(v) AS median, stddev_pop(v) AS std, count(*) AS n FROM (SELECT *, (y * 3) // 8 AS gy, (x * 3) // 8 AS gx FROM patch) GROUP BY GROUPING SETS ((image_id), (image_id, gy, gx)) HAVING count(*) >= 4)", PATCH, "image_id gy gx", median="median", std="std", n="n"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return each(A.grid_estimates(patch(spark, d)), "image_id gy gx")


@query("agg15_weighted_score", wrap(f"SELECT image_id, floor(least(greatest(0.25::DOUBLE * round(avg(r), 6) + 0.30::DOUBLE * round(avg(g), 6) + 0.30::DOUBLE * round(avg(b), 6) + 0.15::DOUBLE * round(avg({LUMA}), 6), 0), 1) * 10000 + 0.500001::DOUBLE) / 10000 AS score FROM rgb GROUP BY image_id", RGB, "score"))
def _(spark: SparkSession, d: str) -> DataFrame:
    six = lambda c: F.round(F.avg(c), 6)
    parts = {"border": six(F.col("r")), "film": six(F.col("g")), "inversion": six(F.col("b")), "render": six(C.luma(F.col("r"), F.col("g"), F.col("b")))}
    return each(rgb(spark, d).groupBy("image_id").agg(A.weighted_score(parts, {"border": 0.25, "film": 0.30, "inversion": 0.30, "render": 0.15}).alias("score")))


@query("agg16_content_box", f"WITH {PATCH} SELECT image_id, min(y) FILTER (v > 0.9) AS y0, max(y) FILTER (v > 0.9) AS y1, min(x) FILTER (v > 0.9) AS x0, max(x) FILTER (v > 0.9) AS x1 FROM patch GROUP BY image_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.content_box(patch(spark, d), F.col("v") > 0.9)


@query("agg17_side_depth", f"""WITH {PATCH}, r AS (SELECT image_id, y, count(*) FILTER (v > 0.4) AS n FROM patch WHERE y < 4 GROUP BY ALL),
    o AS (SELECT image_id, y, sum(n) OVER (PARTITION BY image_id ORDER BY y) >= 0.6::DOUBLE * (y + 1) * 8 AS ok FROM r) SELECT image_id, coalesce(min(y) FILTER (NOT ok), 4)::BIGINT AS depth FROM o GROUP BY image_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.top_depth(patch(spark, d), F.col("v") > 0.4)


def _blur(frm: str, value: str, sigma: float, name: str) -> str:
    w = N.gaussian(sigma)
    k = len(w) // 2
    kernel = ", ".join(f"({i - k}, {x!r}::DOUBLE)" for i, x in enumerate(w))
    return f"""kern(d, w) AS (VALUES {kernel}), bx AS (SELECT q.image_id, q.y, q.x, sum(w * p.{value}) AS {value} FROM {frm} q, kern, {frm} p WHERE p.image_id = q.image_id AND p.y = q.y AND p.x = {_REFLECT.format(i="q.x + d")} GROUP BY ALL),
        {name} AS (SELECT q.image_id, q.y, q.x, sum(w * p.{value}) AS {value} FROM bx q, kern, bx p WHERE p.image_id = q.image_id AND p.x = q.x AND p.y = {_REFLECT.format(i="q.y + d")} GROUP BY ALL)"""


@query("win01_unsharp", sql_out("patch JOIN (SELECT image_id, y, x, v AS g FROM blurred) USING (image_id, y, x)", PATCH + ", " + _blur("patch", "v", 1.2, "blurred"), v="v + 0.35::DOUBLE * (v - g)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(N.unsharp(patch(spark, d), "v", 0.35, 1.2), v=F.col("v"))


@query("win01_bloom", sql_out("t JOIN (SELECT image_id, y, x, t AS g FROM blurred) USING (image_id, y, x)", PATCH + ", t AS (SELECT image_id, y, x, v, least(greatest((v - 0.7::DOUBLE) / 0.3::DOUBLE, 0), 1) AS t FROM patch), " + _blur("t", "t", 1.0, "blurred"), v="least(greatest(v + 0.2::DOUBLE * g, 0), 1)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    df = N.with_blur(patch(spark, d).withColumn("t", C.clamp((F.col("v") - 0.7) / 0.3)), "t", 1.0, "glow")
    return out(df, v=C.clamp(F.col("v") + 0.2 * F.col("glow")))


@query("flt02_cast_mask", sql_out("blurred JOIN p USING (image_id)", RGB8 + f", t AS (SELECT image_id, y, x, least(greatest((({SAT}) - 0.22::DOUBLE) / 0.78::DOUBLE, 0), 1) * least(greatest((greatest(r, g, b) / 255 - 0.55::DOUBLE) / 0.45::DOUBLE, 0), 1) AS m FROM rgb8), " + _blur("t", "m", 1.0, "blurred") + ", p AS (SELECT image_id, quantile_cont(m, 0.995) AS top FROM blurred GROUP BY image_id)", m="CASE WHEN top > 0.000001 THEN least(greatest(m / top, 0), 1) ELSE m END"))
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.stats import cast_mask, with_percentile

    m = rgb8(spark, d).select("image_id", "y", "x", cast_mask(F.col("r"), F.col("g"), F.col("b")).alias("m"))
    m = with_percentile(N.blur(m, "m", 1.0), F.col("m"), 99.5, "top")
    return out(m, m=F.when(F.col("top") > 1e-6, C.clamp(F.col("m") / F.greatest("top", F.lit(1e-6)))).otherwise(F.col("m")))


@query("win03_laplacian_variance", wrap("SELECT image_id, var_pop(l) AS sharpness FROM lap GROUP BY image_id", _METRICS, "sharpness"))
def _(spark: SparkSession, d: str) -> DataFrame:
    df = rgb8(spark, d).withColumn("gray", F.floor(C.gray(F.col("r"), F.col("g"), F.col("b"))).cast("double"))
    return each(N.laplacian(df, "gray").groupBy("image_id").agg(F.var_pop("laplacian").alias("sharpness")))


MEDIAN = PATCH + """, med AS (SELECT q.image_id, q.y, q.x, any_value(q.v) AS v, median(p.v) AS m FROM patch q, range(-1, 2) a(dy), range(-1, 2) b(dx), patch p
    WHERE p.image_id = q.image_id AND p.y = least(greatest(q.y + dy, 0), 7) AND p.x = least(greatest(q.x + dx, 0), 7) GROUP BY q.image_id, q.y, q.x)"""


@query("win04_median", sql_out("med", MEDIAN, m="m"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(N.median3(patch(spark, d), "v"), m=F.col("median"))


@query("flt05_bad_pixels", sql_out("med JOIN s USING (image_id)", MEDIAN + ", s AS (SELECT image_id, stddev_pop(v - m) AS sd FROM med GROUP BY image_id)", v="CASE WHEN sd >= 0.00000001 AND abs(v - m) > 2.5::DOUBLE * sd THEN m ELSE v END"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(N.replace_bad_pixels(patch(spark, d), "v", 2.5), v=F.col("v"))


_SMALL = "CASE WHEN (({i}) % 6 + 6) % 6 < 4 THEN (({i}) % 6 + 6) % 6 ELSE 6 - (({i}) % 6 + 6) % 6 END"


@query("win05_low_frequency", sql_out("""(SELECT image_id, fy.y, fx.x, sum(fy.k * fx.k * v) AS low FROM blurred s JOIN taps fy ON fy.i = s.y JOIN (SELECT y AS x, i, k FROM taps) fx ON fx.i = s.x GROUP BY ALL)""", PATCH + ", small AS (SELECT image_id, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM patch GROUP BY ALL), " + _blur("small", "v", 0.8, "blurred").replace(_REFLECT.format(i="q.x + d"), _SMALL.format(i="q.x + d")).replace(_REFLECT.format(i="q.y + d"), _SMALL.format(i="q.y + d")) + """,
    taps AS (SELECT y, least(greatest(floor((y + 0.5) / 2 - 0.5)::BIGINT + e, 0), 3) AS i, CASE WHEN e = 0 THEN 1 - ((y + 0.5) / 2 - 0.5 - floor((y + 0.5) / 2 - 0.5)) ELSE (y + 0.5) / 2 - 0.5 - floor((y + 0.5) / 2 - 0.5) END::DOUBLE AS k FROM range(8) a(y), range(2) b(e))""", low="low"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(N.low_frequency(patch(spark, d), "v", 2, 0.8), low=F.col("low"))


@query("win06_clahe", sql_out("""(SELECT image_id, ay.y, ax.x, sum(ay.k * ax.k * ((SELECT count(*) * 0) + cum + excess * (bin + 1)) * 255 / area) AS v FROM px JOIN taps ay ON ay.y = px.y JOIN taps ax ON ax.y = px.x
    JOIN lut ON lut.image_id = px.image_id AND lut.ty = ay.i AND lut.tx = ax.i AND lut.level = px.bin GROUP BY image_id, ay.y, ax.y)""".replace("ax.x", "ax.y AS x").replace("(SELECT count(*) * 0) + ", "").replace("SELECT image_id,", "SELECT px.image_id,").replace("GROUP BY image_id", "GROUP BY px.image_id"), PLANE8 + """,
    px AS (SELECT image_id, y, x, floor(v)::BIGINT AS bin FROM plane), hist AS (SELECT image_id, y // 4 AS ty, x // 4 AS tx, bin, count(*) AS n FROM px GROUP BY ALL),
    tile AS (SELECT image_id, ty, tx, sum(n) AS area, greatest(1, floor(8.0::DOUBLE * sum(n) / 256)) AS lim FROM hist GROUP BY ALL),
    ex AS (SELECT t.image_id, t.ty, t.tx, any_value(area) AS area, sum(greatest(n - lim, 0)) / 256.0::DOUBLE AS excess FROM hist JOIN tile t USING (image_id, ty, tx) GROUP BY ALL),
    lut AS (SELECT e.image_id, e.ty, e.tx, level, any_value(e.area) AS area, any_value(excess) AS excess, sum(CASE WHEN n IS NULL THEN 0 ELSE least(n, lim) END) AS cum FROM ex e JOIN tile USING (image_id, ty, tx), range(256) l(level) LEFT JOIN hist h ON h.image_id = e.image_id AND h.ty = e.ty AND h.tx = e.tx AND h.bin <= level GROUP BY e.image_id, e.ty, e.tx, level),
    taps AS (SELECT y, least(greatest(floor((y + 0.5) / 4 - 0.5)::BIGINT + e, 0), 1) AS i, CASE WHEN e = 0 THEN 1 - ((y + 0.5) / 4 - 0.5 - floor((y + 0.5) / 4 - 0.5)) ELSE (y + 0.5) / 4 - 0.5 - floor((y + 0.5) / 4 - 0.5) END::DOUBLE AS k FROM range(8) a(y), range(2) b(e))""", v="v"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(N.clahe(plane8(spark, d), "v", 2, 8.0), v=F.col("v"))


@query("win07_edge_distance", f"WITH {PATCH} SELECT image_id, y, x, least(y, 7 - y, x, 7 - x) AS distance FROM patch")
def _(spark: SparkSession, d: str) -> DataFrame:
    return N.edge_distance(patch(spark, d)).select("image_id", "y", "x", "distance")


_BAYER = PATCH + """, m AS (SELECT *, CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN 'r' WHEN y % 2 = 1 AND x % 2 = 1 THEN 'b' ELSE 'g' END AS c FROM patch),
    n AS (SELECT q.image_id, q.y, q.x, p.c, p.v, p.y = q.y AND p.x = q.x AS own FROM m q JOIN m p ON p.image_id = q.image_id AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1)"""


@query("win08_demosaic", sql_out("(SELECT image_id, y, x, " + ", ".join(f"coalesce(max(v) FILTER (own AND c = '{c}'), avg(v) FILTER (c = '{c}')) AS {c}" for c in "rgb") + " FROM n GROUP BY ALL)", _BAYER, each="{c}"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(N.demosaic(patch(spark, d)), r=F.col("r"), g=F.col("g"), b=F.col("b"))


@query("win09_edge_connected", f"""WITH RECURSIVE {PATCH}, m AS (SELECT image_id, y, x FROM patch WHERE v > 0.55),
    r AS (SELECT image_id, y, x FROM m WHERE y IN (0, 7) OR x IN (0, 7) UNION SELECT m.image_id, m.y, m.x FROM r JOIN m ON m.image_id = r.image_id AND abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1)
    SELECT image_id, y, x FROM r""")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = patch(spark, d).withColumn("m", F.col("v") > 0.55)
    return N.edge_connected(m, "m").where("connected").select("image_id", "y", "x")
