"""Queries of the whole developments, and their SQL, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import develop as D
from ..operators import masks as M
from ..operators import mosaic
from ..operators.scratch import settled
from .bridge import RGB8, out, query, rgb8, sql_out
from .flows import _CROPS, _W, manifest_of
from .pointwise import _F, _INV, _XYZ, GRAY, SAT
from .rasters import FILM_BASE, _blur

#: Parameters of the bench, so that no stage is left out.
PARAMS = {
    "gamma": 0.9, "shadow_lift": 6.0, "highlight_compression": 0.1, "vibrance": 0.25, "clahe_grid": 4.0, "clahe_clip": 2.0, "desat_sigma": 2.0, "desat_strength": 0.4,
}
TOP = "greatest(r, g, b)"


def level(e: str) -> str:
    return f"floor(round(least(greatest({e}, 0), 255), 6))"


def pixels(name: str, frm: str, each: str | dict[str, str]) -> str:
    """A CTE of the three channels; {c} stands for each in turn."""
    each = each if isinstance(each, dict) else {c: each.replace("{c}", c) for c in "rgb"}
    return f"{name} AS MATERIALIZED (SELECT image_id, y, x, " + ", ".join(f"{e} AS {c}" for c, e in each.items()) + f" FROM {frm})"


def per_image(name: str, frm: str, what: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT image_id, {what} FROM {frm} GROUP BY image_id)"


def each_of(template: str) -> str:
    return ", ".join(template.replace("{c}", c) for c in "rgb")


def demask(frm: str, name: str) -> list[str]:
    return [
        FILM_BASE.replace("rgb8", frm),
        "u AS (SELECT image_id, r, g, b FROM q JOIN p USING (image_id) WHERE gray >= p99 UNION ALL SELECT image_id, r, g, b FROM strips JOIN s USING (image_id) WHERE gray >= p80)",
        per_image("fb", "u", each_of("least(greatest(quantile_cont({c}, 0.95), 32), 255) AS {c}0")),
        pixels("dn", f"{frm} JOIN fb USING (image_id)", "-ln(least(greatest(({c} + 1.0::DOUBLE) / ({c}0 + 1.0::DOUBLE), 0.0001::DOUBLE), 1.0::DOUBLE))"),
        per_image("dt", "dn", each_of("greatest(quantile_cont({c}, 0.99), 0.0001::DOUBLE) AS {c}t")),
        pixels(name, "dn JOIN dt USING (image_id)", level("255.0::DOUBLE * {c} / {c}t")),
    ]


def stretch(frm: str, name: str, lo: float, hi: float) -> list[str]:
    return [
        per_image(f"{name}_p", frm, each_of(f"round(quantile_cont({{c}}, {lo}), 9) AS {{c}}l, round(quantile_cont({{c}}, {hi}), 9) AS {{c}}h")),
        pixels(name, f"{frm} JOIN {name}_p USING (image_id)", f"CASE WHEN {{c}}h - {{c}}l < 1 THEN {{c}} ELSE {level('({c} - {c}l) * 255.0::DOUBLE / greatest({c}h - {c}l, 1.0)')} END"),
    ]


def gains(frm: str, name: str, lo: float, hi: float, least: float, most: float, more: str = "") -> list[str]:
    return [
        f"{name}_q AS (SELECT *, round({GRAY}, 9) AS gr FROM {frm})",
        per_image(f"{name}_p", f"{name}_q", f"round(quantile_cont(gr, {lo}), 9) AS lo, round(quantile_cont(gr, {hi}), 9) AS hi"),
        per_image(f"{name}_m", f"{name}_q JOIN {name}_p USING (image_id)", each_of(f"coalesce(avg({{c}}) FILTER (gr BETWEEN lo AND hi{more}), avg({{c}})) AS m{{c}}")),
        pixels(name, f"{frm} JOIN {name}_m USING (image_id)", level(f"{{c}} * least(greatest((mr + mg + mb) / 3 / greatest(m{{c}}, 0.000001::DOUBLE), {least}), {most})")),
    ]


def lab(frm: str, name: str) -> list[str]:
    decoded = "CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
    return [
        pixels(f"{name}_d", frm, decoded),
        f"{name}_x AS (SELECT image_id, y, x, " + ", ".join(f"{e} AS t{n}" for e, n in zip(_XYZ, "xyz", strict=True)) + f" FROM {name}_d)",
        f"{name}_f AS (SELECT image_id, y, x, " + ", ".join(f"{_F.format(t=f't{n}')} AS f{n}" for n in "xyz") + f" FROM {name}_x)",
        f"{name} AS MATERIALIZED (SELECT image_id, y, x, {level('(1.16::DOUBLE * fy - 0.16::DOUBLE) * 255.0::DOUBLE + 0.5')} AS l, "
        f"{level('5 * (fx - fy) * 100.0::DOUBLE + 128.0 + 0.5')} AS a, {level('2 * (fy - fz) * 100.0::DOUBLE + 128.0 + 0.5')} AS b FROM {name}_f)",
    ]


def from_lab(frm: str, name: str) -> list[str]:
    grey = "(l / 255.0::DOUBLE + 0.16::DOUBLE) / 1.16::DOUBLE"
    linear = {c: " + ".join(f"{m}::DOUBLE * h{n}" for m, n in zip(row, "xyz", strict=True)) for c, row in zip("rgb", C.FROM_XYZ, strict=True)}
    encoded = level("CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow({c}, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END * 255.0::DOUBLE + 0.5")
    return [
        f"{name}_g AS (SELECT image_id, y, x, {grey} AS gy, {grey} + (a - 128.0::DOUBLE) / 100.0::DOUBLE / 5 AS gx, {grey} - (b - 128.0::DOUBLE) / 100.0::DOUBLE / 2 AS gz FROM {frm})",
        f"{name}_h AS (SELECT image_id, y, x, " + ", ".join(f"{_INV.format(t=f'g{n}', w=w)} AS h{n}" for n, w in zip("xyz", C.WHITE, strict=True)) + f" FROM {name}_g)",
        pixels(f"{name}_r", f"{name}_h", {c: f"least(greatest({e}, 0), 1)" for c, e in linear.items()}),
        pixels(name, f"{name}_r", encoded),
    ]


def neutral_lab(frm: str, name: str, strength: float) -> list[str]:
    return [
        *lab(frm, f"{name}_l"),
        per_image(f"{name}_p", f"{name}_l", "round(quantile_cont(l, 0.1), 9) AS lo, round(quantile_cont(l, 0.9), 9) AS hi"),
        per_image(f"{name}_m", f"{name}_l JOIN {name}_p USING (image_id)", ", ".join(f"coalesce(avg({c}) FILTER (l BETWEEN lo AND hi), 128) - 128 AS m{c}" for c in "ab")),
        f"{name}_s AS MATERIALIZED (SELECT image_id, y, x, l, " + ", ".join(f"{level(f'{c} - {strength}::DOUBLE * m{c}')} AS {c}" for c in "ab") + f" FROM {name}_l JOIN {name}_m USING (image_id))",
        *from_lab(f"{name}_s", name),
    ]


def clahe(frm: str, name: str, grid: int, clip: float) -> list[str]:
    """Of 8 x 8 pixels, whose tiles are all full."""
    t, n = 8 // grid, name
    tap = f"(y + 0.5) / {t} - 0.5"
    return [
        *lab(frm, f"{n}_l"),
        f"{n}_hist AS MATERIALIZED (SELECT image_id, y // {t} AS ty, x // {t} AS tx, l::BIGINT AS bin, count(*) AS n FROM {n}_l GROUP BY ALL)",
        f"{n}_t AS MATERIALIZED (SELECT image_id, ty, tx, sum(n) AS area, greatest(1, floor({clip}::DOUBLE * sum(n) / 256)) AS lim FROM {n}_hist GROUP BY ALL)",
        f"{n}_e AS MATERIALIZED (SELECT t.image_id, t.ty, t.tx, any_value(area) AS area, any_value(lim) AS lim, sum(greatest(n - lim, 0)) / 256.0::DOUBLE AS excess FROM {n}_hist h JOIN {n}_t t USING (image_id, ty, tx) GROUP BY ALL)",
        f"{n}_c AS MATERIALIZED (SELECT y, least(greatest(floor({tap})::BIGINT + e, 0), {grid - 1}) AS i, CASE WHEN e = 0 THEN 1 - ({tap} - floor({tap})) ELSE {tap} - floor({tap}) END::DOUBLE AS k FROM range(8) a(y), range(2) b(e))",
        f"{n}_k AS MATERIALIZED (SELECT p.image_id, p.y, p.x, any_value(p.l) AS l, any_value(p.a) AS a, any_value(p.b) AS b, ay.i AS ty, ax.i AS tx, sum(ay.k * ax.k) AS w FROM {n}_l p JOIN {n}_c ay ON ay.y = p.y JOIN {n}_c ax ON ax.y = p.x GROUP BY p.image_id, p.y, p.x, ay.i, ax.i)",
        f"{n}_v AS MATERIALIZED (SELECT k.image_id, k.y, k.x, k.ty, k.tx, any_value(k.l) AS l, any_value(k.a) AS a, any_value(k.b) AS b, any_value(w) * (coalesce(sum(CASE WHEN n IS NOT NULL THEN least(n, lim) END), 0) + any_value(excess) * (any_value(k.l) + 1)) * 255.0::DOUBLE / any_value(area) AS v FROM {n}_k k JOIN {n}_e e USING (image_id, ty, tx) LEFT JOIN {n}_hist h ON h.image_id = k.image_id AND h.ty = k.ty AND h.tx = k.tx AND h.bin <= k.l GROUP BY k.image_id, k.y, k.x, k.ty, k.tx)",
        f"{n}_s AS MATERIALIZED (SELECT image_id, y, x, {level('sum(v)')} AS l, any_value(a) AS a, any_value(b) AS b FROM {n}_v GROUP BY image_id, y, x)",
        *from_lab(f"{n}_s", n),
    ]


def blurred(frm: str, value: str, sigma: float, name: str) -> str:
    got = _blur(frm, value, sigma, name)
    for word in ("kern(", "kern,", "bx AS", "bx q", "bx p"):
        got = got.replace(word, f"{name}_{word}")
    return got


def saturated(frm: str, name: str, new: str) -> str:
    return pixels(name, f"(SELECT *, {SAT} AS sat FROM {frm})", level(f"CASE WHEN sat > 0 THEN {TOP} - ({TOP} - {{c}}) * ({new}) / sat ELSE {{c}} END"))


def casts(frm: str, name: str, sigma: float, strength: float) -> list[str]:
    clamp = "least(greatest({}, 0), 1)".format
    return [
        f"{name}_m AS MATERIALIZED (SELECT image_id, y, x, {clamp(f'(({SAT}) - 0.22::DOUBLE) / 0.78::DOUBLE')} * {clamp(f'({TOP} / 255.0::DOUBLE - 0.55::DOUBLE) / 0.45::DOUBLE')} AS m FROM {frm})",
        blurred(f"{name}_m", "m", sigma, f"{name}_b"),
        per_image(f"{name}_t", f"{name}_b", "quantile_cont(m, 0.995) AS top"),
        f"{name}_k AS MATERIALIZED (SELECT f.*, CASE WHEN top > 0.000001 THEN {clamp('m / greatest(top, 0.000001::DOUBLE)')} ELSE m END AS mask FROM {frm} f JOIN {name}_b USING (image_id, y, x) JOIN {name}_t USING (image_id))",
        saturated(f"{name}_k", name, f"sat * (1 - {clamp(f'mask * {strength}::DOUBLE')})"),
    ]


def sharpened(frm: str, name: str, amount: float, sigma: float) -> list[str]:
    soft = [blurred(frm, c, sigma, f"{name}_{c}") for c in "rgb"]
    joined = f"(SELECT f.*, " + ", ".join(f"s{c}.{c} AS b{c}" for c in "rgb") + f" FROM {frm} f " + " ".join(f"JOIN {name}_{c} s{c} ON s{c}.image_id = f.image_id AND s{c}.y = f.y AND s{c}.x = f.x" for c in "rgb") + ")"
    return [*soft, pixels(name, joined, level(f"{{c}} + {amount}::DOUBLE * ({{c}} - b{{c}})"))]


CURVES = {
    "gamma": level("pow({c} / 255.0::DOUBLE, 0.9::DOUBLE) * 255.0::DOUBLE"),
    "highlights": level("{c} / 255.0::DOUBLE * (1.0 - 0.1::DOUBLE * {c} / 255.0::DOUBLE) * 255.0::DOUBLE"),
    "lift": level("{c} + 6.0"),
}
VIBRANT = "least(greatest(sat + 0.25::DOUBLE * (1 - sat), 0), 1)"

NEGATIVE = ", ".join([
    RGB8, *demask("rgb8", "n1"), *stretch("n1", "n2", 0.005, 0.995), *gains("n2", "n3", 0.1, 0.9, 0.5, 1.8), *neutral_lab("n3", "n4", 0.85),
    *stretch("n4", "n5", 0.008, 0.992), pixels("n6", "n5", CURVES["gamma"]), pixels("n7", "n6", CURVES["highlights"]), pixels("n8", "n7", CURVES["lift"]),
    *clahe("n8", "n9", 4, 2.0), *casts("n9", "n10", 2.0, 0.4), saturated("n10", "n11", VIBRANT), *sharpened("n11", "n12", 0.35, 1.2),
    *gains("n12", "n13", 0.15, 0.85, 0.75, 1.35, f" AND round({SAT}, 9) < 0.35"),
])
POSITIVE = ", ".join([
    RGB8, *stretch("rgb8", "n1", 0.005, 0.995), pixels("n2", "n1", CURVES["lift"]), pixels("n3", "n2", CURVES["gamma"]), pixels("n4", "n3", CURVES["highlights"]),
    *clahe("n4", "n5", 4, 2.0), saturated("n5", "n6", VIBRANT), *sharpened("n6", "n7", 0.35, 1.2),
])


@query("pipe02_negative", sql_out("n13", NEGATIVE, each="{c}"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(D.negative(rgb8(spark, d), PARAMS, border=1), **{c: F.col(c) for c in "rgb"})


@query("pipe03_positive", sql_out("n7", POSITIVE, each="{c}"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(D.positive(rgb8(spark, d), PARAMS), **{c: F.col(c) for c in "rgb"})


def _whole(ctes: str, frm: str) -> str:
    return "(" + sql_out(frm, ctes, each="{c}") + ")"


_KINDS = RGB8 + """, k AS (SELECT image_id, avg(r) > avg(g) + 12 AND avg(g) > avg(b) + 10 AS neg FROM rgb8 GROUP BY image_id)"""


@query("udf05_dispatch_whole", f"WITH {_KINDS} SELECT n.* FROM {_whole(NEGATIVE, 'n13')} n JOIN k USING (image_id) WHERE neg UNION ALL SELECT p.* FROM {_whole(POSITIVE, 'n7')} p JOIN k USING (image_id) WHERE NOT neg")
def _(spark: SparkSession, d: str) -> DataFrame:
    px = settled(rgb8(spark, d))
    got = D.dispatched(px, M.film_type(px).select("image_id", "film_type"), PARAMS, border=1)
    return out(got, **{c: F.col(c) for c in "rgb"})


DEMO = ", ".join([
    RGB8, "manifest(filename, row, col, top, left_) AS (VALUES " + ", ".join(str(c) for c in _CROPS) + ")",
    "tl AS (SELECT image_id, row, col, top, left_, p.y - top AS y, p.x - left_ AS x, r, g, b FROM rgb8 p JOIN manifest ON p.y >= top AND p.y < top + 5 AND p.x >= left_ AND p.x < left_ + 5)",
    "tw AS (SELECT image_id, y + top AS y, x + left_ AS x, r, g, b, " + _W.format(r="row", i="y") + " * " + _W.format(r="col", i="x") + " AS w FROM tl)",
    "cv AS MATERIALIZED (SELECT image_id, y, x, " + each_of("sum({c} * w) / greatest(sum(w), 0.000001::DOUBLE) AS {c}") + " FROM tw GROUP BY image_id, y, x)",
    pixels("t0", "cv", f"255 - {level('{c}')}"), *stretch("t0", "t1", 0.005, 0.995), *stretch("t1", "t2", 0.008, 0.992), *clahe("t2", "t3", 4, 2.0), *casts("t3", "t4", 2.0, 0.4), *sharpened("t4", "t5", 0.35, 1.2),
])


@query("pipe01_tile_demo_whole", sql_out("t5", DEMO, each="{c}"))
def _(spark: SparkSession, d: str) -> DataFrame:
    manifest, tiles = manifest_of(spark, rgb8(spark, d), "rgb")
    return out(D.tile_demo(mosaic.stitch(manifest, tiles, 2, tuple("rgb")), PARAMS), **{c: F.col(c) for c in "rgb"})
