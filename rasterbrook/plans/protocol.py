"""Queries of the multi-frame protocol (rectangles, base candidates, base model, report, rendering) and of the border vote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import borders, integral, protocol
from .bridge import PATCH, RGB, out, patch, query, rgb, rounded, sql_out
from .composites import blurred
from .pointwise import LUMA, SAT
from .rasters import _REFLECT, _box, each

GRIDS = (1, 2, 3, 4, 5, 8)


@query("pipe05_rectangles", sql_out(f"""(SELECT image_id, 'grid_' || k || '_' || i || '_' || j AS region, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std
    FROM patch JOIN (SELECT * FROM (VALUES {", ".join(f"({g})" for g in GRIDS)}) a(k), range(8) b(i), range(8) c(j) WHERE i < k AND j < k) ON y >= i * 8 // k AND y < (i + 1) * 8 // k AND x >= j * 8 // k AND x < (j + 1) * 8 // k
    GROUP BY ALL)""", PATCH, "image_id region", n="n", mean="mean", std="std"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return each(integral.grid_stats(patch(spark, d), GRIDS, "v"), "image_id region")


_CANDIDATES = RGB + f""", l AS (SELECT *, round({LUMA}, 9) AS luma FROM rgb), {_box("l", "luma", 5)},
    q AS (SELECT l.*, greatest(round(variance, 9), 0) AS var FROM l JOIN box USING (image_id, y, x)),
    p AS (SELECT image_id, greatest(round(quantile_cont(var, 0.35), 9), 0.00000001) AS calm, round(quantile_cont(luma, 0.05), 9) AS lo, round(quantile_cont(luma, 0.9), 9) AS hi FROM q GROUP BY image_id),
    c AS (SELECT *, var <= calm AS c1, luma BETWEEN lo AND hi AS c2 FROM q JOIN p USING (image_id)),
    k AS (SELECT *, (y * 3 + 2) // 8 AS gy, (x * 3 + 2) // 8 AS gx FROM c QUALIFY c1 AND (c2 OR count(*) FILTER (c1 AND c2) OVER (PARTITION BY image_id) < 12)),
    cand AS (SELECT image_id, CASE WHEN gy IS NULL THEN 'low_variance_base' ELSE 'grid_3_' || gy || '_' || gx END AS region, {", ".join(f"median({c}) AS {c}, stddev_pop({c}) AS std_{c}" for c in "rgb")},
        count(*) AS n, avg(luma) AS luma_mean FROM k GROUP BY GROUPING SETS ((image_id), (image_id, gy, gx)) HAVING gy IS NULL OR count(*) >= 2),
    mid AS (SELECT image_id, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM cand GROUP BY image_id),
    rel AS (SELECT *, round(sqrt((r - mr) * (r - mr) + (g - mg) * (g - mg) + (b - mb) * (b - mb)) / (sqrt(mr * mr + mg * mg + mb * mb) + 0.000001), 9) AS rel FROM cand JOIN mid USING (image_id)),
    lim AS (SELECT image_id, greatest(round(quantile_cont(rel, 0.7), 9), 0.05::DOUBLE) AS lim FROM rel GROUP BY image_id),
    scored AS (SELECT *, least(greatest(1 - rel / (2 * lim), 0), 1) AS score, rel <= lim AS consistent FROM rel JOIN lim USING (image_id))"""
_SHOWN = [*"rgb", *(f"std_{c}" for c in "rgb"), "n", "luma_mean", "score"]


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return protocol.score_candidates(protocol.base_candidates(rgb(spark, d), fewest=12, cell_fewest=2))


@query("pipe05_base_candidates", sql_out("scored", _CANDIDATES, "image_id region consistent", **{c: c for c in _SHOWN}))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(_scored(spark, d), "image_id region consistent", **{c: F.col(c) for c in _SHOWN})


@query("pipe05_base_model", sql_out("f", _CANDIDATES + f""", g AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS n_all, count(*) FILTER (consistent) OVER (PARTITION BY image_id) AS n_good FROM scored),
    m AS (SELECT image_id, {", ".join(f"least(greatest(median({c}), 0.000001), 1) AS {c}, stddev_pop({c}) AS s{c}" for c in "rgb")}, count(*) AS n_consistent, any_value(n_all) AS n_candidates FROM g WHERE consistent OR n_good = 0 GROUP BY image_id),
    f AS (SELECT *, (sr + sg + sb) / 3 / ((r + g + b) / 3 + 0.000001) AS rel_spread FROM m)""", r="r", g="g", b="b", rel_spread="rel_spread", confidence="least(greatest(n_consistent / n_candidates * (1 - 4 * rel_spread), 0), 1)", n_candidates="n_candidates", n_consistent="n_consistent", keys="image_id"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return each(protocol.base_model(_scored(spark, d)))


#: Frames of the bench: the mean plane is the flat, that of every fifth frame behind an orange mask the clear film. Some
#: frames lack a value, some lie beside the flat.
MASK = {"r": 0.9, "g": 0.7, "b": 0.5}


def _frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    px = rgb(spark, d)
    mean = lambda df, k: df.groupBy("y", "x").agg(*[(F.avg(c) * k[c]).alias(c) for c in "rgb"])
    frames = px.withColumns({
        "r": F.when(~((F.col("image_id") % 11 == 7) & (F.col("y") == 3) & (F.col("x") == 3)), F.col("r")),
        "y": F.col("y") + F.when(F.col("image_id") % 13 == 5, 1).otherwise(0),
    })
    return mean(px, dict.fromkeys("rgb", 1.0)), mean(px.where("image_id % 5 = 0"), MASK), frames


def _each(f: str, sep: str = ", ") -> str:
    return sep.join(f.replace("{c}", c).replace("{k}", str(MASK[c])) for c in "rgb")


_CLIP = "((avg((r <= 0 OR r >= 1)::INT) + avg((g <= 0 OR g >= 1)::INT) + avg((b <= 0 OR b >= 1)::INT)) / 3)"
_PROTOCOL = RGB + f""", fl AS (SELECT y, x, {_each("avg({c}) AS {c}")} FROM rgb GROUP BY y, x), fm AS (SELECT {_each("avg({c}) AS m{c}")} FROM fl),
    bs AS (SELECT y, x, {_each("avg({c}) * {k}::DOUBLE AS {c}")} FROM rgb WHERE image_id % 5 = 0 GROUP BY y, x),
    bl AS (SELECT 0::BIGINT AS image_id, y, x, bs.r, bs.g, bs.b, fl.r AS fr, fl.g AS fg, fl.b AS fb, round({LUMA.replace("* r", "* bs.r").replace("* g", "* bs.g").replace("* b)", "* bs.b)")}, 9) AS luma FROM bs JOIN fl USING (y, x)), {_box("bl", "luma", 5)},
    bq AS (SELECT bl.*, greatest(round(variance, 9), 0) AS var FROM bl JOIN box USING (image_id, y, x)),
    bp AS (SELECT greatest(round(quantile_cont(var, 0.4), 9), 0.000000001) AS calm, round(quantile_cont(luma, 0.05), 9) AS lo, round(quantile_cont(luma, 0.92), 9) AS hi FROM bq),
    bc AS (SELECT *, var <= calm AS c1, var <= calm AND luma BETWEEN lo AND hi AS c2 FROM bq, bp),
    bk AS (SELECT * FROM bc, (SELECT count(*) FILTER (c1) AS n1, count(*) FILTER (c2) AS n2 FROM bc) WHERE CASE WHEN n2 >= 12 THEN c2 WHEN n1 >= 8 THEN c1 ELSE true END),
    col AS (SELECT {_each("least(greatest(p{c} * m{c}, 0.000001), 1) AS b{c}")} FROM (SELECT {_each("quantile_cont({c} / greatest(f{c}, 0.000001), 0.9) AS p{c}")} FROM bk), fm),
    fx AS (SELECT image_id, y + (image_id % 13 = 5)::INT AS y, x, CASE WHEN NOT (image_id % 11 = 7 AND y = 3 AND x = 3) THEN r END AS r, g, b FROM rgb),
    fe AS (SELECT image_id, CASE WHEN image_id % 13 = 5 THEN 'flat field: 8 pixels outside of it' WHEN count(r) < 64 THEN 'load: 1 pixels without a finite value' END AS error FROM fx GROUP BY image_id),
    dn AS (SELECT image_id, y, x, {_each("-ln(least(greatest(least(greatest(fx.{c} / greatest(fl.{c} / greatest(m{c}, 0.000001), 0.000001), 0), 1) / b{c}, 0.000001::DOUBLE), 1)) AS {c}")} FROM fx JOIN fl USING (y, x) JOIN fe USING (image_id), fm, col WHERE error IS NULL),
    up AS (SELECT image_id, {_each("greatest(quantile_cont({c}, 0.99), 0.05::DOUBLE) AS u{c}")} FROM dn GROUP BY image_id),
    ps AS (SELECT image_id, y, x, {_each("least(greatest(1 - {c} / u{c}, 0), 1) AS {c}")} FROM dn JOIN up USING (image_id)),
    pm AS (SELECT image_id, {_each("avg({c}) AS p_{c}")}, {_CLIP} AS p_clipped FROM ps GROUP BY image_id),
    nt AS (SELECT image_id, y, x, {_each("least(greatest({c} * CASE WHEN (p_r + p_g + p_b) / 3 < 0.000001 THEN 1 ELSE least(greatest((p_r + p_g + p_b) / 3 / greatest(p_{c}, 0.000001), 0.5), 2) END, 0), 1) AS {c}")} FROM ps JOIN pm USING (image_id))"""
_REPORT = _PROTOCOL + f""", gy AS (SELECT *, {LUMA} AS gray, floor(round(({LUMA}) * 255, 6)) AS g8 FROM nt),
    s8 AS (SELECT image_id, y, x, {SAT} AS sat FROM (SELECT image_id, y, x, {_each("floor(round({c} * 255, 6)) AS {c}")} FROM nt)),
    lap AS (SELECT q.image_id, q.y, q.x, sum(p.g8) - 4 * any_value(q.g8) AS l FROM gy q, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx), gy p WHERE p.image_id = q.image_id
        AND p.y = {_REFLECT.format(i="q.y + dy")} AND p.x = {_REFLECT.format(i="q.x + dx")} GROUP BY ALL),
    mt AS (SELECT image_id, avg(gray) AS gray_mean, stddev_pop(gray) AS gray_std, {_each("avg(({c} <= 0)::INT)", " / 3 + ")} / 3 AS clipped_black, {_each("avg(({c} >= 1)::INT)", " / 3 + ")} / 3 AS clipped_white,
        greatest(avg(r), avg(g), avg(b)) - least(avg(r), avg(g), avg(b)) AS channel_spread, avg(sat) AS saturation, var_pop(l) AS sharpness, avg(b) - avg(r) AS blue_red, avg(g) - (avg(r) + avg(b)) / 2 AS green_magenta
        FROM gy JOIN s8 USING (image_id, y, x) JOIN lap USING (image_id, y, x) GROUP BY image_id),
    ev AS (SELECT *, least(greatest((1 - least(channel_spread * 5, 1)) * 0.5 + (1 - least(p_clipped * 4, 1)) * 0.5, 0), 1) AS inversion,
        least(greatest(CASE WHEN round(gray_mean, 9) BETWEEN 0.25 AND 0.75 THEN 1 ELSE greatest(0, 1 - abs(round(gray_mean, 9) - 0.5::DOUBLE) * 3) END * 0.5 + least(greatest((sharpness - 50) / 300, 0), 1) * 0.5, 0), 1) AS rendering
        FROM mt JOIN pm USING (image_id)),
    rp AS (SELECT fe.image_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error, CASE WHEN round(blue_red, 9) > 0.05 THEN 'blue' WHEN round(blue_red, 9) < -0.05 THEN 'red' WHEN round(green_magenta, 9) > 0.05 THEN 'green'
        WHEN round(green_magenta, 9) < -0.05 THEN 'magenta' END AS cast_, ev.* EXCLUDE (image_id) FROM fe LEFT JOIN ev USING (image_id))"""
_METRICS = ["p_r", "p_g", "p_b", "p_clipped", "gray_mean", "gray_std", "clipped_black", "clipped_white", "channel_spread", "saturation", "sharpness", "blue_red", "green_magenta", "inversion", "rendering"]


@query("pipe05_protocol_report", sql_out("rp", _REPORT, "image_id status error cast_", score="inversion * 0.6::DOUBLE + rendering * 0.4::DOUBLE", confidence="CASE WHEN error IS NULL THEN least(greatest(1 - 2 * p_clipped, 0), 1) END", **{c: c for c in _METRICS}))
def _(spark: SparkSession, d: str) -> DataFrame:
    report = protocol.run_protocol(*_frames(spark, d), enough=12, some=8)[0]
    return report.select("image_id", "status", "error", F.col("cast").alias("cast_"), *[rounded(F.col(c)).alias(c) for c in ("score", "confidence", *_METRICS)])


@query("pipe05_rendered", sql_out("nt JOIN z USING (image_id, y, x)", _PROTOCOL + ", " + blurred("nt", 1.2, "z"), each="least(greatest({c} + 0.3::DOUBLE * ({c} - b{c}), 0), 1)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(protocol.run_protocol(*_frames(spark, d), enough=12, some=8)[1], **{c: F.col(c) for c in "rgb"})


#: The border vote of the bench: bright lines, calm places, and bright pixels with half a vote.
_VOTES = PATCH + f""", rm AS (SELECT image_id, y, avg(v) AS m FROM patch GROUP BY ALL), cm AS (SELECT image_id, x, avg(v) AS m FROM patch GROUP BY ALL),
    rt AS (SELECT image_id, max(m) AS t FROM rm GROUP BY image_id), ct AS (SELECT image_id, max(m) AS t FROM cm GROUP BY image_id),
    pj AS (SELECT p.image_id, p.y, p.x, p.v, rm.m >= 0.85::DOUBLE * rt.t AS br, cm.m >= 0.85::DOUBLE * ct.t AS bc, least(p.y, 7 - p.y, p.x, 7 - p.x) AS distance
        FROM patch p JOIN rm USING (image_id, y) JOIN cm ON cm.image_id = p.image_id AND cm.x = p.x JOIN rt ON rt.image_id = p.image_id JOIN ct ON ct.image_id = p.image_id), {_box("patch", "v", 5)},
    bt AS (SELECT image_id, max(variance) AS t FROM box GROUP BY image_id),
    cd AS (SELECT pj.*, (br OR bc) AND distance < 1 AS mp, round(variance, 9) <= round(greatest(0.3::DOUBLE * bt.t, 0.00000001::DOUBLE), 9) AS mc, v > 0.55 AS ml FROM pj JOIN box USING (image_id, y, x) JOIN bt USING (image_id)),
    cf AS (SELECT image_id, CASE WHEN avg(mp::INT) < 0.005 THEN 0.1 ELSE least(greatest(2 * (avg(br::INT) FILTER (x = 0) + avg(bc::INT) FILTER (y = 0)), 0), 1) END AS cp,
        CASE WHEN avg(mc::INT) < 0.005 THEN 0.1 ELSE least(greatest(1 - 2 * (avg(distance) FILTER (mc) / 4.000001::DOUBLE), 0.1), 0.9) END AS cc FROM cd GROUP BY image_id),
    vt AS (SELECT image_id, y, x, distance, round((mp::INT * cp + mc::INT * cc + ml::INT * 0.5) / (cp + cc + 0.5), 9) AS vote FROM cd JOIN cf USING (image_id)),
    mk AS (SELECT image_id, y, x, k, vote >= CASE k WHEN 0 THEN 0.33 ELSE 0.66 END AS m FROM vt, range(2) r(k)),
    re AS (SELECT image_id, k, y, x FROM mk WHERE m AND (y IN (0, 7) OR x IN (0, 7)) UNION SELECT mk.image_id, mk.k, mk.y, mk.x FROM re JOIN mk ON mk.m AND mk.image_id = re.image_id AND mk.k = re.k AND abs(mk.y - re.y) <= 1 AND abs(mk.x - re.x) <= 1),
    kp AS (SELECT mk.*, CASE WHEN count(re.y) OVER (PARTITION BY mk.image_id, mk.k) = 0 THEN m ELSE re.y IS NOT NULL END AS kept FROM mk LEFT JOIN re USING (image_id, k, y, x)),
    dp AS (SELECT image_id, k, {", ".join(f"(count(*) FILTER (kept AND {c}) >= 0.6 * 8)::INT AS {n}" for n, c in zip(borders.SIDES, ("y = 0", "y = 7", "x = 0", "x = 7")))} FROM kp GROUP BY ALL),
    st AS (SELECT kp.*, CASE WHEN top_ + bottom + left_ + right_ = 0 THEN kept ELSE y < top_ OR y >= 8 - bottom OR x < left_ OR x >= 8 - right_ END AS s FROM kp JOIN dp USING (image_id, k)),
    bc AS (SELECT image_id, y, x, distance, vote, a.s AS border, CASE WHEN count(*) FILTER (b.s) OVER (PARTITION BY image_id) = 0 THEN a.s ELSE b.s END AS clear
        FROM vt JOIN (SELECT * FROM st WHERE k = 0) a USING (image_id, y, x) JOIN (SELECT * FROM st WHERE k = 1) b USING (image_id, y, x))""".replace(" AS top,", " AS top_,").replace(" AS left,", " AS left_,").replace(" AS right ", " AS right_ ")
_RECURSIVE = "WITH RECURSIVE " + _VOTES


def _voted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    df = borders.with_projection(patch(spark, d)).withColumn("level", F.col("v") > 0.55)
    df = borders.with_calm(df, 5, 0.3)
    return borders.merge_borders(df, {"projection": F.col("c_projection"), "calm": F.col("c_calm"), "level": F.lit(0.5)}, block=3)


@query("flt13_border_vote", _RECURSIVE + " SELECT image_id, y, x, border, clear FROM bc")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _voted(spark, d)[0]


@query("flt13_border_report", _RECURSIVE + """, bd AS (SELECT image_id, (count(*) FILTER (border AND y = 0) >= 0.6 * 8)::INT + (count(*) FILTER (border AND y = 7) >= 0.6 * 8)::INT + (count(*) FILTER (border AND x = 0) >= 0.6 * 8)::INT + (count(*) FILTER (border AND x = 7) >= 0.6 * 8)::INT AS deep,
        min(x) FILTER (NOT border) AS x0, min(y) FILTER (NOT border) AS y0, max(x) FILTER (NOT border) AS x1, max(y) FILTER (NOT border) AS y1, avg(vote) FILTER (border) AS votes, avg(distance) FILTER (border) AS far, avg(border::INT) AS part FROM bc GROUP BY image_id)
    SELECT image_id, x0, y0, x1, y1, round(least(greatest(0.4::DOUBLE * coalesce(votes, 0) + 0.4::DOUBLE * coalesce(least(greatest(1 - far / 2, 0), 1), 0) + 0.2::DOUBLE * least(deep / 4, 1), 0), 1), 6) + 0.0 AS confidence, round(part, 6) + 0.0 AS border_share FROM bd""")
def _(spark: SparkSession, d: str) -> DataFrame:
    report = _voted(spark, d)[1]
    return report.select("image_id", "x0", "y0", "x1", "y1", *[rounded(F.col(c)).alias(c) for c in ("confidence", "border_share")])
