"""Queries of the row-local operators: projections per pixel and colour functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import tone as T
from ..operators import stats as S
from .bridge import PATCH, PLANE8, RGB, RGB8, out, patch, plane8, query, rgb, rgb8, sql_out



def channels(df: DataFrame, f) -> DataFrame:
    return out(df, **{c: f(F.col(c)) for c in "rgb"})


def three(df: DataFrame, cols, keys: str = "image_id y x") -> DataFrame:
    return out(df, keys, **dict(zip("rgb", cols, strict=True)))


U8 = "floor(least(greatest({}, 0.0::DOUBLE), 255.0::DOUBLE))"
SAT = "CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END"
LUMA = "(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b)"
GRAY = "(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)"


@query("prj01_invert", sql_out("plane", PLANE8, v="255 - v"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(plane8(spark, d), v=T.invert(F.col("v")))


@query("prj02_percentile_stretch", f"""WITH {RGB8}, p AS (SELECT image_id,
    {", ".join(f"quantile_cont({c}, 0.02) AS {c}l, quantile_cont({c}, 0.98) AS {c}h" for c in "rgb")} FROM rgb8 GROUP BY image_id)
    SELECT image_id, y, x, {", ".join(f"{U8.format(f'CASE WHEN {c}h - {c}l < 1 THEN {c} ELSE ({c} - {c}l) * 255.0::DOUBLE / greatest({c}h - {c}l, 1.0) END')} + 0.0 AS {c}" for c in "rgb")}
    FROM rgb8 JOIN p USING (image_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(S.percentile_stretch(rgb8(spark, d), 2, 98), r=F.col("r"), g=F.col("g"), b=F.col("b"))


@query("prj03_gamma", sql_out("rgb8", RGB8, each=U8.format("pow({c} / 255.0::DOUBLE, 0.8::DOUBLE) * 255.0::DOUBLE")))
def _(spark: SparkSession, d: str) -> DataFrame:
    return channels(rgb8(spark, d), lambda c: T.gamma_u8(c, 0.8))


@query("prj04_highlight_compression", sql_out("rgb8", RGB8, each=U8.format("{c} / 255.0::DOUBLE * (1 - 0.3::DOUBLE * ({c} / 255.0::DOUBLE)) * 255.0::DOUBLE")))
def _(spark: SparkSession, d: str) -> DataFrame:
    return channels(rgb8(spark, d), lambda c: T.compress_highlights(c, 0.3))


@query("prj05_shadow_lift", sql_out("rgb8", RGB8, each=U8.format("{c} + 8")))
def _(spark: SparkSession, d: str) -> DataFrame:
    return channels(rgb8(spark, d), lambda c: T.lift_shadows(c, 8))


def _saturate(new: str) -> str:
    return f"CASE WHEN ({SAT}) > 0 THEN greatest(r, g, b) - (greatest(r, g, b) - {{c}}) * ({new}) / ({SAT}) ELSE {{c}} END"


@query("prj06_vibrance", sql_out("rgb8", RGB8, each=_saturate(f"least(greatest(({SAT}) + 0.25::DOUBLE * (1 - ({SAT})), 0), 1)")))
def _(spark: SparkSession, d: str) -> DataFrame:
    return three(rgb8(spark, d), T.vibrance(F.col("r"), F.col("g"), F.col("b"), 0.25))


_MASK = f"least(greatest((({SAT}) - 0.22::DOUBLE) / 0.78::DOUBLE, 0), 1) * least(greatest((greatest(r, g, b) / 255.0::DOUBLE - 0.55::DOUBLE) / 0.45::DOUBLE, 0), 1)"


@query("prj07_selective_desaturation", sql_out("rgb8", RGB8, each=_saturate(f"({SAT}) * (1 - least(greatest(({_MASK}) * 0.6::DOUBLE, 0), 1))")))
def _(spark: SparkSession, d: str) -> DataFrame:
    return three(rgb8(spark, d), T.desaturate(F.col("r"), F.col("g"), F.col("b"), S.cast_mask(F.col("r"), F.col("g"), F.col("b")), 0.6))


@query("prj08_density_demask", f"""WITH {RGB8}, base AS (SELECT image_id, {", ".join(f"greatest(quantile_cont({c}, 0.95), 32) AS {c}b" for c in "rgb")} FROM rgb8 GROUP BY image_id),
    t AS (SELECT image_id, y, x, {", ".join(f"-ln(least(greatest(({c} + 1) / ({c}b + 1), 0.0001::DOUBLE), 1)) AS {c}" for c in "rgb")} FROM rgb8 JOIN base USING (image_id)),
    s AS (SELECT image_id, {", ".join(f"greatest(quantile_cont({c}, 0.99), 0.0001::DOUBLE) AS {c}s" for c in "rgb")} FROM t GROUP BY image_id)
    SELECT image_id, y, x, {", ".join(f"{U8.format(f'round(255 * {c} / {c}s, 6)')} + 0.0 AS {c}" for c in "rgb")} FROM t JOIN s USING (image_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(S.density_demask(rgb8(spark, d)), r=F.col("r"), g=F.col("g"), b=F.col("b"))


@query("prj09_density", sql_out("rgb", RGB, each="-ln(least(greatest({c} / 0.9::DOUBLE, 0.000001::DOUBLE), 1))"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return channels(rgb(spark, d), lambda c: T.density(T.transmission(c, F.lit(0.9))))


DENSITY = RGB + ", density AS (SELECT image_id, y, x, " + ", ".join(f"-ln(least(greatest({c} / 0.9::DOUBLE, 0.000001::DOUBLE), 1)) AS {c}" for c in "rgb") + " FROM rgb)"
UPPER = DENSITY + ", u AS (SELECT image_id, " + ", ".join(f"greatest(quantile_cont({c}, 0.99), 0.05::DOUBLE) AS {c}u" for c in "rgb") + " FROM density GROUP BY image_id)"


def dense(spark: SparkSession, d: str) -> DataFrame:
    return rgb(spark, d).withColumns({c: T.density(T.transmission(F.col(c), F.lit(0.9))) for c in "rgb"})


@query("prj10_density_normalise", sql_out("density JOIN u USING (image_id)", UPPER, each="least(greatest(({c} - 0.02::DOUBLE) / greatest({c}u - 0.02::DOUBLE, 0.0001::DOUBLE), 0), 1)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    df = S.with_upper_density(dense(spark, d))
    return out(df, **{c: T.normalise_density(F.col(c), F.lit(0.02), F.col(f"{c}_upper")) for c in "rgb"})


@query("prj11_density_positive", sql_out("density JOIN u USING (image_id)", UPPER, each="least(greatest({c} / greatest({c}u, 0.0001::DOUBLE), 0), 1)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(S.with_upper_density(dense(spark, d)), **{c: T.to_positive(F.col(c), F.col(f"{c}_upper")) for c in "rgb"})


@query("prj11_density_positive_compat", sql_out("density JOIN u USING (image_id)", UPPER, each="1 - least(greatest({c} / greatest({c}u, 0.0001::DOUBLE), 0), 1)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(S.with_upper_density(dense(spark, d)), **{c: T.to_positive(F.col(c), F.col(f"{c}_upper"), True) for c in "rgb"})


_EXPM1 = RGB + ", e AS (SELECT image_id, y, x, " + ", ".join(f"exp(least(greatest({c} * {k}::DOUBLE, 0), 8)) - 1 AS {c}" for c, k in zip("rgb", (1.35, 1.20, 1.10))) + " FROM rgb), u AS (SELECT image_id, " + ", ".join(f"quantile_cont({c}, 0.995) AS {c}u" for c in "rgb") + " FROM e GROUP BY image_id)"


@query("prj12_expm1_inversion", sql_out("e JOIN u USING (image_id)", _EXPM1, each="least(greatest({c} / greatest({c}u, 0.000001::DOUBLE), 0), 1)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(S.expm1_inversion(rgb(spark, d)), r=F.col("r"), g=F.col("g"), b=F.col("b"))


#: A mild unmixing of the dyes; rows add up to one.
UNMIX = ((1.20, -0.15, -0.05), (-0.10, 1.25, -0.15), (-0.05, -0.20, 1.25))


@query("prj13_matrix_unmix", sql_out("rgb", RGB, **{c: f"{c} + 0.8::DOUBLE * ({m[0]}::DOUBLE * r + {m[1]}::DOUBLE * g + {m[2]}::DOUBLE * b - {c})" for c, m in zip("rgb", UNMIX)}))
def _(spark: SparkSession, d: str) -> DataFrame:
    return three(rgb(spark, d), T.matrix_blend((F.col("r"), F.col("g"), F.col("b")), UNMIX, 0.8))


@query("prj14_black_white_level", sql_out("patch", PATCH, v="CASE WHEN image_id % 7 = 0 THEN least(greatest(v, 0), 1) ELSE least(greatest((v - 0.0625::DOUBLE) / (1 - 0.0625::DOUBLE), 0), 1) END"))
def _(spark: SparkSession, d: str) -> DataFrame:
    black = F.when(F.col("image_id") % 7 != 0, F.lit(256.0))
    return out(patch(spark, d), v=T.black_level(F.col("v"), black, F.lit(4096.0)))


@query("prj16_residual_gains", sql_out("rgb", RGB, r="least(greatest(r * 1.1::DOUBLE, 0), 1)", g="least(greatest(g, 0), 1)", b="least(greatest(b * 0.9::DOUBLE, 0), 1)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return three(rgb(spark, d), [C.clamp(c * k) for c, k in zip((F.col("r"), F.col("g"), F.col("b")), (1.1, 1.0, 0.9), strict=True)])


@query("prj17_tone_curve", sql_out("rgb", RGB, each="least(greatest(0.5::DOUBLE + (pow({c}, 0.9::DOUBLE) - 0.5::DOUBLE) * 1.15::DOUBLE + 0.02::DOUBLE, 0), 1)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return channels(rgb(spark, d), lambda c: T.tone_curve(c, 0.9, 0.15, 0.02))


@query("prj18_saturation", sql_out("rgb", RGB, each=_saturate(f"least(greatest(({SAT}) * 1.2::DOUBLE, 0), 1)")))
def _(spark: SparkSession, d: str) -> DataFrame:
    return three(rgb(spark, d), C.with_saturation(F.col("r"), F.col("g"), F.col("b"), C.clamp(C.saturation(F.col("r"), F.col("g"), F.col("b")) * 1.2)))


_SPREAD = "(greatest(r, g, b) - least(r, g, b))"
_ANCHOR = RGB + f", p AS (SELECT image_id, quantile_cont({_SPREAD}, 0.3) AS lim FROM rgb GROUP BY image_id), m AS (SELECT image_id, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM rgb JOIN p USING (image_id) WHERE {_SPREAD} <= lim GROUP BY image_id)"


@query("prj20_gray_anchor", sql_out("rgb JOIN m USING (image_id)", _ANCHOR, each="{c} / (0.65::DOUBLE + 0.35::DOUBLE * m{c} + 0.000001::DOUBLE)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(S.gray_anchor(rgb(spark, d), 30, 0.35), r=F.col("r"), g=F.col("g"), b=F.col("b"))


@query("agg08_low_saturation_mean", sql_out("m", _ANCHOR, "image_id", mr="mr", mg="mg", mb="mb"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(S.neutral_means(rgb(spark, d), 30), "image_id", mr=F.col("r_mean"), mg=F.col("g_mean"), mb=F.col("b_mean"))


@query("prj21_neutral_damp", sql_out("rgb", RGB, each=f"{{c}} + 0.25::DOUBLE * exp(-{_SPREAD} * {_SPREAD} / (2 * 0.1::DOUBLE * 0.1::DOUBLE)) * ((r + g + b) / 3 - {{c}})"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return three(rgb(spark, d), T.neutral_damp(F.col("r"), F.col("g"), F.col("b"), 0.25, 0.1))


@query("prj22_red_guard", sql_out("rgb", RGB, r="r - 0.3::DOUBLE * greatest(r - 0.5::DOUBLE * (g + b) - 0.05::DOUBLE, 0)", g="g", b="b"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return three(rgb(spark, d), (T.red_guard(F.col("r"), F.col("g"), F.col("b"), 0.05, 0.3), F.col("g"), F.col("b")))


def _step(lo: float, hi: float, v: str = "v") -> str:
    t = f"least(greatest(({v} - {lo}::DOUBLE) / {hi - lo}::DOUBLE, 0), 1)"
    return f"({t} * {t} * (3 - 2 * {t}))"


_LOW, _HIGH = f"(1 - {_step(0.25 - 0.1, 0.25 + 0.1)})", _step(0.75 - 0.1, 0.75 + 0.1)
_MID = f"greatest(1 - {_LOW} - {_HIGH}, 0)"


@query("prj23_zoned_tone", sql_out("patch", PATCH, v=f"({_LOW} * pow(v, 0.9::DOUBLE) + {_MID} * (1 / (1 + exp(-5::DOUBLE * (v - 0.5::DOUBLE)))) + {_HIGH} * (v / (1 + 0.6::DOUBLE * greatest(v - 0.75::DOUBLE, 0)))) / ({_LOW} + {_MID} + {_HIGH})"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(patch(spark, d), v=T.zoned_tone(F.col("v"), 0.25, 0.75, 0.9, 5.0, 0.5, 0.6))


@query("prj24_highlight_rolloff", sql_out("patch", PATCH, v="v / (1 + 0.35::DOUBLE * pow(v, 2.2::DOUBLE))"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(patch(spark, d), v=T.rolloff(F.col("v"), 0.35, 2.2))


@query("prj25_luminance_chroma", sql_out("patch", PATCH, v="least(greatest(0.9::DOUBLE + 0.4::DOUBLE * exp(-(v - 0.5::DOUBLE) * (v - 0.5::DOUBLE) / (2 * 0.2::DOUBLE * 0.2::DOUBLE)) - 0.1::DOUBLE * v, 0.5::DOUBLE), 1.3::DOUBLE)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(patch(spark, d), v=T.chroma_scale(F.col("v"), 0.9, 0.4, 0.5, 0.2, 0.1, 0.5, 1.3))


_XYZ = ["(" + " + ".join(f"{m}::DOUBLE * {c}" for m, c in zip(row, "rgb")) + f") / {w}::DOUBLE" for row, w in zip(C.TO_XYZ, C.WHITE)]
_F = "CASE WHEN {t} > pow(6.0::DOUBLE / 29, 3) THEN cbrt({t}) ELSE {t} / (3 * (6.0::DOUBLE / 29) * (6.0::DOUBLE / 29)) + 4.0::DOUBLE / 29 END"
LAB = RGB + ", xyz AS (SELECT image_id, y AS py, x AS px, " + ", ".join(f"{e} AS t{n}" for e, n in zip(_XYZ, "xyz")) + " FROM rgb), f AS (SELECT image_id, py, px, " + ", ".join(f"{_F.format(t=f't{n}')} AS f{n}" for n in "xyz") + " FROM xyz), lab AS (SELECT image_id, py AS y, px AS x, 1.16::DOUBLE * fy - 0.16::DOUBLE AS l, 5 * (fx - fy) AS a, 2 * (fy - fz) AS b FROM f)"


def in_lab(spark: SparkSession, d: str) -> DataFrame:
    lightness, a, b = C.lab(F.col("r"), F.col("g"), F.col("b"))
    return rgb(spark, d).select("image_id", "y", "x", lightness.alias("l"), a.alias("a"), b.alias("b"))


@query("fn02_lab", sql_out("lab", LAB, l="l", a="a", b="b"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(in_lab(spark, d), l=F.col("l"), a=F.col("a"), b=F.col("b"))


_INV = "CASE WHEN {t} > 6.0::DOUBLE / 29 THEN {t} * {t} * {t} ELSE 3 * (6.0::DOUBLE / 29) * (6.0::DOUBLE / 29) * ({t} - 4.0::DOUBLE / 29) END * {w}::DOUBLE"
BACK = LAB + ", g AS (SELECT *, (l + 0.16::DOUBLE) / 1.16::DOUBLE AS gy, (l + 0.16::DOUBLE) / 1.16::DOUBLE + a / 5 AS gx, (l + 0.16::DOUBLE) / 1.16::DOUBLE - b / 2 AS gz FROM lab2), h AS (SELECT image_id, y, x, " + ", ".join(f"{_INV.format(t=f'g{n}', w=w)} AS h{n}" for n, w in zip("xyz", C.WHITE)) + " FROM g)"
_FROM = {c: " + ".join(f"{m}::DOUBLE * h{n}" for m, n in zip(row, "xyz")) for c, row in zip("rgb", C.FROM_XYZ)}


def _edited(sql: str) -> str:
    """The way back to RGB from Lab that an edit (l, a, b over lab) has changed."""
    return BACK.replace(", g AS (SELECT *", f", lab2 AS (SELECT image_id, y, x, {sql} FROM lab), g AS (SELECT *", 1)


@query("fn02_lab_round_trip", sql_out("h", _edited("l * 0.9::DOUBLE AS l, a, b"), **_FROM))
def _(spark: SparkSession, d: str) -> DataFrame:
    return three(in_lab(spark, d), C.from_lab(F.col("l") * 0.9, F.col("a"), F.col("b")))


_SAT30 = f"(1 - 0.5::DOUBLE * {_step(0.7 - 0.05, 0.7 + 0.05, 'l')})"


@query("prj30_highlight_desaturate", sql_out("h", _edited(f"l, a * {_SAT30} AS a, b * {_SAT30} AS b"), **_FROM))
def _(spark: SparkSession, d: str) -> DataFrame:
    s = T.weight_by_lightness(F.col("l"), 0.7, 0.5, True)
    return three(in_lab(spark, d), C.from_lab(F.col("l"), F.col("a") * s, F.col("b") * s))


_HUE = "(CASE WHEN atan2(b, a) BETWEEN -0.45 AND 0.55 THEN 0.9::DOUBLE ELSE 1 END * CASE WHEN atan2(b, a) BETWEEN 0.9 AND 1.8 THEN 1.1::DOUBLE ELSE 1 END * CASE WHEN abs(atan2(b, a)) > 2.1 THEN 0.8::DOUBLE ELSE 1 END)"


@query("prj26_hue_adjust", sql_out("lab", LAB, a=f"a * {_HUE}", b=f"b * {_HUE}"))
def _(spark: SparkSession, d: str) -> DataFrame:
    a, b = T.hue_adjust(F.col("a"), F.col("b"), 0.9, 1.1, 0.8)
    return out(in_lab(spark, d), a=a, b=b)


_P20 = LAB + ", p AS (SELECT image_id, quantile_cont(sqrt(a * a + b * b), 0.2) AS lim FROM lab GROUP BY image_id)"


@query("prj27_neutral_protection", sql_out("lab JOIN p USING (image_id)", _P20, **{c: f"{c} * CASE WHEN sqrt(a * a + b * b) < lim THEN 0.45::DOUBLE ELSE 1 END" for c in "ab"}))
def _(spark: SparkSession, d: str) -> DataFrame:
    df = S.with_percentile(in_lab(spark, d), F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")), 20, "lim")
    a, b = T.protect_neutral(F.col("a"), F.col("b"), F.col("lim"))
    return out(df, a=a, b=b)


_OETF = "CASE WHEN {v} <= 0.0031308 THEN {v} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow({v}, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END"
_ALL = RGB + ", s AS (SELECT image_id, unnest([r, g, b]) AS v FROM rgb), p AS (SELECT image_id, quantile_cont(v, 0.995) AS lim FROM s GROUP BY image_id)"


@query("prj28_display_mapping", sql_out("rgb JOIN p USING (image_id)", _ALL, each=_OETF.replace("{v}", "least(greatest({c} / (lim + 0.000001::DOUBLE), 0), 1)")))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(S.display_mapping(rgb(spark, d), 99.5), r=F.col("r"), g=F.col("g"), b=F.col("b"))


@query("prj29_global_trim", sql_out("rgb", RGB, **{c: f"least(greatest((0.5::DOUBLE + (({c} * pow(2, 0.1::DOUBLE) - 0.02::DOUBLE) / (0.98::DOUBLE - 0.02::DOUBLE) - 0.5::DOUBLE) * 1.05::DOUBLE) * {k}::DOUBLE, 0), 1)" for c, k in zip("rgb", (1 + 0.02, 1 - 0.01, 1 - 0.02))}))
def _(spark: SparkSession, d: str) -> DataFrame:
    return three(rgb(spark, d), T.trim((F.col("r"), F.col("g"), F.col("b")), 0.1, 0.02, 0.98, 0.05, 0.02, -0.01))


@query("prj31_grain")
def _(spark: SparkSession, d: str) -> DataFrame:
    bright = C.luma(F.col("r"), F.col("g"), F.col("b"))
    return channels(rgb(spark, d), lambda c: T.grain(c, F.col("y"), F.col("x"), bright, 0.02))


_K = f"(1 / (1 + 0.5::DOUBLE * greatest({LUMA} * 1.2::DOUBLE, 0.000001::DOUBLE)))"
_LO, _HI = "(1 / (1 + exp(3.0::DOUBLE)))", "(1 / (1 + exp(-3.0::DOUBLE)))"


@query("prj32_filmic", sql_out("rgb", RGB, each=f"least(greatest((1 / (1 + exp(-6::DOUBLE * ({{c}} * 1.2::DOUBLE * {_K} - 0.5::DOUBLE))) - {_LO}) / ({_HI} - {_LO}), 0), 1)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return three(rgb(spark, d), T.filmic(F.col("r"), F.col("g"), F.col("b"), F.lit(1.2)))


@query("prj33_feather", sql_out("patch", PATCH, w="(CASE WHEN x < 4 THEN 0.001::DOUBLE + 0.999::DOUBLE * x / 3 ELSE 1 END) * (CASE WHEN y >= 4 THEN 0.001::DOUBLE + 0.999::DOUBLE * (7 - y) / 3 ELSE 1 END)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(patch(spark, d), w=T.feather(F.col("x"), 8, 4, False, True) * T.feather(F.col("y"), 8, 4, True, False))


_GW = RGB + ", m AS (SELECT image_id, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM rgb GROUP BY image_id)"


@query("prj34_gray_world", sql_out("rgb JOIN m USING (image_id)", _GW, each="{c} * CASE WHEN m{c} < 0.000001 THEN 1 ELSE least(greatest((mr + mg + mb) / 3 / m{c}, 0.5::DOUBLE), 2) END"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(S.gray_world(rgb(spark, d)), r=F.col("r"), g=F.col("g"), b=F.col("b"))


@query("prj35_master_output", sql_out("patch", PATCH, v="CASE WHEN image_id % 2 = 0 THEN v ELSE " + _OETF.replace("{v}", "v") + " END"))
def _(spark: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("image_id") % 2 == 0, "linear_float").otherwise("display_mapped_float")
    return out(patch(spark, d), v=S.master_output(mode, F.col("v"), C.srgb_encode(F.col("v"))))


@query("fn01_luma", sql_out("rgb", RGB, gray=GRAY, luma=LUMA))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(rgb(spark, d), gray=C.gray(F.col("r"), F.col("g"), F.col("b")), luma=C.luma(F.col("r"), F.col("g"), F.col("b")))


@query("fn03_hsv_saturation", sql_out("rgb8", RGB8, s=SAT, v="greatest(r, g, b)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(rgb8(spark, d), s=C.saturation(F.col("r"), F.col("g"), F.col("b")), v=F.greatest(F.col("r"), F.col("g"), F.col("b")))


@query("fn04_packed_lab", sql_out("lab", LAB, l="l * 255", a="a * 100 + 128", b="b * 100 + 128"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(in_lab(spark, d), l=F.col("l") * 255.0, a=F.col("a") * 100.0 + 128.0, b=F.col("b") * 100.0 + 128.0)


@query("fn05_srgb", sql_out("patch", PATCH, oetf=_OETF.replace("{v}", "v"), eotf="CASE WHEN v <= 0.04045 THEN v / 12.92::DOUBLE ELSE pow((v + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(patch(spark, d), oetf=C.srgb_encode(F.col("v")), eotf=C.srgb_decode(F.col("v")))


@query("fn06_smoothstep", sql_out("patch", PATCH, s=_step(0.2, 0.8)))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(patch(spark, d), s=C.smoothstep(0.2, 0.8, F.col("v")))


@query("flt12_scrub", sql_out("patch", PATCH, v="CASE WHEN x = 0 THEN 0 ELSE greatest(v - 0.4::DOUBLE, 0) END"))
def _(spark: SparkSession, d: str) -> DataFrame:
    bad = F.when(F.col("x") == 0, F.when(F.col("y") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("v") - 0.4)
    return out(patch(spark, d), v=S.scrub(bad))
