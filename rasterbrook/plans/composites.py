"""Queries of whole pipelines, of the rule-based models, and of sources and sinks on literal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import tone as T
from ..operators import masks as M
from ..operators import mosaic, reductions
from ..operators import neighbourhood as N
from ..operators import stats as S
from ..operators.scratch import scratch_path
from ..sources import files, png
from ..streaming import jobs
from .bridge import PATCH, RGB, RGB8, out, patch, query, rgb, rgb8, rounded, sql_out, table
from .flows import _FILM, _TILES, _W, _tiles, heuristic_score
from .flows import _SCORE as SCORE_SQL
from .pointwise import _OETF, LUMA, UNMIX
from .rasters import _REFLECT, FLAT, _blur, _box, _flat, each

COLS = ("r", "g", "b")


def renamed(sql: str, k: int) -> str:
    """The names that a blur's SQL uses inside, numbered, so that several fit one statement."""
    return sql.replace("kern(", f"kern{k}(").replace("kern,", f"kern{k},").replace("bx ", f"bx{k} ")


def blurred(frm: str, sigma: float, name: str) -> str:
    parts = ", ".join(renamed(_blur(frm, c, sigma, f"{name}_{c}"), k) for k, c in enumerate("rgb"))
    cols = ", ".join(f"{name}_{c}.{c} AS b{c}" for c in "rgb")
    return f"{parts}, {name} AS (SELECT image_id, y, x, {cols} FROM {name}_r JOIN {name}_g USING (image_id, y, x) JOIN {name}_b USING (image_id, y, x))"


_PREVIEW = ", t AS (SELECT image_id, y, x, " + ", ".join(f"least(greatest(0.5::DOUBLE + (pow(least(greatest({c} * {k}::DOUBLE, 0), 1), 0.9::DOUBLE) - 0.5::DOUBLE) * 1.1::DOUBLE, 0), 1) AS {c}" for c, k in zip("rgb", (1.05, 1.0, 0.95))) + " FROM rgb), " + blurred("t", 1.2, "z")


def preview(df: DataFrame, gains=(1.05, 1.0, 0.95), gamma: float = 0.9, contrast: float = 0.1, amount: float = 0.3) -> DataFrame:
    """Gains, gamma, contrast, then a mild unsharp mask."""
    df = df.withColumns({c: T.tone_curve(C.clamp(F.col(c) * k), gamma, contrast, 0.0) for c, k in zip(COLS, gains, strict=True)})
    df = N.unsharp(df, COLS, amount, 1.2)
    return df.withColumns({c: C.clamp(F.col(c)) for c in COLS})


@query("prj19_preview", sql_out("t JOIN z USING (image_id, y, x)", RGB + _PREVIEW, each="least(greatest({c} + 0.3::DOUBLE * ({c} - b{c}), 0), 1)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(preview(rgb(spark, d)), **{c: F.col(c) for c in COLS})


@query("flt07_calm_border", f"WITH {PATCH}, {_box('patch', 'v', 5)}, t AS (SELECT image_id, max(variance) AS top FROM box GROUP BY image_id) SELECT image_id, y, x FROM box JOIN t USING (image_id) WHERE round(variance, 9) <= round(greatest(0.3::DOUBLE * top, 0.00000001::DOUBLE), 9)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return M.calm_border(patch(spark, d), 5, 0.3).where("candidate").select("image_id", "y", "x")


@query("snk02_linear16", sql_out("patch", PATCH, v="round_even(v * 65535, 0)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(patch(spark, d), v=F.rint(C.clamp(F.col("v")) * 65535.0))


@query("snk03_preview", sql_out("rgb JOIN p USING (image_id)", RGB + ", s AS (SELECT image_id, unnest([r, g, b]) AS v FROM rgb), p AS (SELECT image_id, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi0, CASE WHEN quantile_cont(v, 0.995) <= quantile_cont(v, 0.005) THEN quantile_cont(v, 0.005) + 0.000001::DOUBLE ELSE quantile_cont(v, 0.995) END AS hi FROM s GROUP BY image_id)", each="pow(least(greatest(({c} - lo) / (hi - lo), 0), 1), 1 / 2.2::DOUBLE)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    df = rgb(spark, d)
    p = df.select("image_id", F.explode(F.array(*COLS)).alias("v")).groupBy("image_id").agg(reductions.pct(F.col("v"), 0.5).alias("lo"), reductions.pct(F.col("v"), 99.5).alias("hi"))
    df = S.join_back(df, p.withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1e-6).otherwise(F.col("hi"))))
    return out(df, **{c: F.pow(C.clamp((F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo"))), F.lit(1 / 2.2)) for c in COLS})


@query("snk04_debug_planes", sql_out("patch", PATCH, v="floor(least(greatest(v, 0), 1) * 255)", mask="CASE WHEN v > 0.5 THEN 255 ELSE 0 END"))
def _(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return out(patch(spark, d), v=F.floor(C.clamp(v) * 255.0), mask=F.when(v > 0.5, 255).otherwise(0))


@query("snk05_report", "SELECT c_custkey, '{\"id\":' || c_custkey || ',\"segment\":\"' || c_mktsegment || '\",\"where\":{\"nation\":' || c_nationkey || '}}' AS report FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    nested = F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_nationkey").alias("nation")).alias("where"))
    return table(spark, d, "customer").select("c_custkey", F.to_json(nested).alias("report"))


@query("snk06_upload_status", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 405 WHEN event_id % 5 < 2 THEN 400 ELSE 200 END AS status FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    method = F.array(*map(F.lit, ("GET", "POST", "post", "Post")))[(F.col("event_id") % 4).cast("int")]
    body = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 5 == 1, "").otherwise(F.col("props").cast("string"))
    return files.upload_status(table(spark, d, "events").select("event_id", method.alias("method"), body.alias("body"))).select("event_id", "status")


def _reread(df: DataFrame, channels: tuple[str, ...], rounding: str) -> DataFrame:
    """Images written as PNG files, in bands of three lines, and read again."""
    folder = scratch_path(df.sparkSession, "png")
    png.write_png(df, folder, channels, rounding=rounding, lines=3)
    got = files.read_images(df.sparkSession, folder)
    name = F.regexp_extract("path", r"([^/]*)\.png$", 1)
    return got.withColumn("image_id", name.cast("long")).drop("path")


@query("snk01_png_files", sql_out("rgb", RGB, each="round_even({c} * 255, 0) / 255"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(_reread(rgb(spark, d), COLS, "even"), **{c: F.col(c) for c in COLS})


@query("snk04_mask_files", sql_out("patch", PATCH, v="CASE WHEN v > 0.5 THEN 1 ELSE 0 END"))
def _(spark: SparkSession, d: str) -> DataFrame:
    mask = patch(spark, d).withColumn("v", F.when(F.col("v") > 0.5, 1.0).otherwise(0.0))
    return out(_reread(mask, ("v",), "down"), v=F.col("r"))


@query("src04_routing", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'raw' WHEN 1 THEN 'standard' WHEN 2 THEN 'standard' ELSE 'other' END AS kind FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    end = F.element_at(F.array(*[F.lit(x) for x in (".DNG", ".Png", ".tiff", ".txt")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", files.kind_of(F.concat("p_name", end)).alias("kind"))


@query("src07_loader_choice", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'image' WHEN s_suppkey % 3 = 0 THEN 'raw' ELSE 'image' END AS loader FROM supplier")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "a.png").otherwise("a.nef").alias("path"), F.when(F.col("s_suppkey") % 3 == 0, "raw").alias("decoded"))
    return s.select("s_suppkey", F.when(files.kind_of(F.col("path")) == "standard", "image").otherwise(F.coalesce("decoded", F.lit("image"))).alias("loader"))


@query("src08_layouts", """SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'a' || s_suppkey END AS name, (s_suppkey % 5)::INT AS x0, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS y0, (s_suppkey % 5 + 3)::INT AS x1, 4 AS y1 FROM supplier
    UNION ALL SELECT 'b' || s_suppkey, 5, 0, 9, 4 FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT 'c' || s_suppkey, NULL, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 2 = 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k, x = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 5
    box = lambda y: F.concat(F.lit("["), x.cast("string"), F.lit(f", {y}, "), (x + 3).cast("string"), F.lit(", 4]"))
    listed = F.concat(F.lit('[{"name": "'), F.col("s_name"), F.lit('", "bbox": '), box(2), F.lit("}]"))
    named = F.concat(F.lit('{"a'), k, F.lit('": {"bbox": '), box(1), F.lit('}, "b'), k, F.lit('": [5, 9], "c'), k, F.lit('": "?", "y": [0, 4]}'))
    return files.layout(spark, table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, listed).otherwise(named).alias("json"))).drop("raw")


@query("src09_calibration_pick", "SELECT p_name AS name FROM part WHERE contains(lower(p_name), 'flat') OR contains(lower(p_name), 'e') ORDER BY p_size DESC, name LIMIT 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    listing = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("modificationTime"))
    return files.pick_flat(listing, ("flat", "e")).select("name")


@query("src10_settings", "SELECT 'KEY_' || c_custkey AS key, CASE WHEN c_custkey % 4 = 1 THEN c_mktsegment || ' x' ELSE 'v=' || c_nationkey END AS value FROM customer WHERE c_custkey % 4 IN (1, 2)")
def _(spark: SparkSession, d: str) -> DataFrame:
    k, part = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    line = F.when(part == 0, F.concat(F.lit("# KEY_"), k, F.lit("=no"))).when(part == 1, F.concat(F.lit("KEY_"), k, F.lit(" = '"), F.col("c_mktsegment"), F.lit(" x'")))
    line = line.when(part == 2, F.concat(F.lit("KEY_"), k, F.lit("=v="), F.col("c_nationkey").cast("string"))).otherwise(F.lit(""))
    return files.env_lines(table(spark, d, "customer").select(line.alias("value")))


@query("str01_latest_frame", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return jobs.latest(e, "user_id", "at", "event_id").select("user_id", "event_id")


@query("str04_capture_ready", "SELECT o_orderkey FROM orders WHERE (SELECT count(DISTINCT c_mktsegment) FROM customer) >= 3 AND o_orderstatus = 'F'")
def _(spark: SparkSession, d: str) -> DataFrame:
    ready = table(spark, d, "customer").agg(F.count_distinct("c_mktsegment").alias("n")).where("n >= 3")
    captures = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.lit(1).alias("one"))
    return captures.join(F.broadcast(ready.select(F.lit(1).alias("one"))), "one", "left_semi").select("o_orderkey")  # one row


_MOSAIC = _TILES + ", m AS (SELECT image_id, y, x, floor(round(least(greatest(v * 255, 0), 255), 6)) AS v FROM (SELECT image_id, y + top AS y, x + left_ AS x, sum(v * w) / greatest(sum(w), 0.000001) AS v FROM (SELECT *, " + _W.format(r="row", i="y") + " * " + _W.format(r="col", i="x") + " AS w FROM tiles) GROUP BY image_id, y + top, x + left_)), i AS (SELECT image_id, y, x, 255 - v AS v FROM m), p AS (SELECT image_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM i GROUP BY image_id), s AS (SELECT image_id, y, x, floor(least(greatest(CASE WHEN hi - lo < 1 THEN v ELSE (v - lo) * 255.0::DOUBLE / greatest(hi - lo, 1.0) END, 0), 255)) AS v FROM i JOIN p USING (image_id)), " + _blur("s", "v", 1.2, "blurred")


@query("pipe01_tile_demo", sql_out("s JOIN (SELECT image_id, y, x, v AS g FROM blurred) USING (image_id, y, x)", _MOSAIC, v="v + 0.35::DOUBLE * (v - g)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    df = mosaic.stitch(*_tiles(spark, d), overlap=2).withColumn("v", T.invert(F.floor(F.round(C.clamp(F.col("v") * 255.0, 0, 255), 6)).cast("double")))
    df = S.join_back(df, df.groupBy("image_id").agg(reductions.pct(F.col("v"), 1).alias("lo"), reductions.pct(F.col("v"), 99).alias("hi")))
    df = df.select("image_id", "y", "x", T.stretch(F.col("v"), F.col("lo"), F.col("hi")).alias("v"))
    return out(N.unsharp(df, "v", 0.35, 1.2), v=F.col("v"))


def raw_negative(df: DataFrame, base: DataFrame) -> DataFrame:
    """Transmission over the frame's own base, density over its upper reference, then the preview. df and base: r, g, b per image."""
    df = S.join_back(df, base.select("image_id", *[F.col(c).alias(f"{c}_base") for c in COLS]))
    df = df.withColumns({c: T.density(T.transmission(F.col(c), F.col(f"{c}_base"))) for c in COLS})
    df = S.with_upper_density(df)
    df = df.select("image_id", "y", "x", *[T.to_positive(F.col(c), F.col(f"{c}_upper")).alias(c) for c in COLS])
    return preview(df)


_RAWNEG = RGB + ", bs AS (SELECT image_id, " + ", ".join(f"quantile_cont({c}, 0.95) AS {c}0" for c in "rgb") + " FROM rgb GROUP BY image_id), dn AS (SELECT image_id, y, x, " + ", ".join(f"-ln(least(greatest({c} / greatest({c}0, 0.000001), 0.000001::DOUBLE), 1)) AS {c}" for c in "rgb") + " FROM rgb JOIN bs USING (image_id)), up AS (SELECT image_id, " + ", ".join(f"greatest(quantile_cont({c}, 0.99), 0.05::DOUBLE) AS {c}u" for c in "rgb") + " FROM dn GROUP BY image_id), ps AS (SELECT image_id, y, x, " + ", ".join(f"least(greatest({c} / greatest({c}u, 0.0001::DOUBLE), 0), 1) AS {c}" for c in "rgb") + " FROM dn JOIN up USING (image_id))" + _PREVIEW.replace("FROM rgb)", "FROM ps)")


@query("pipe04_raw_negative", sql_out("t JOIN z USING (image_id, y, x)", _RAWNEG, each="least(greatest({c} + 0.3::DOUBLE * ({c} - b{c}), 0), 1)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    df = rgb(spark, d)
    base = df.groupBy("image_id").agg(*[reductions.pct(F.col(c), 95).alias(c) for c in COLS])
    return out(raw_negative(df, base), **{c: F.col(c) for c in COLS})


@query("pipe05_protocol", f"""WITH {FLAT}, c AS (SELECT image_id, y, x, least(greatest(v / greatest(flat, 0.000001), 0), 1) AS v FROM patch JOIN flat USING (y, x)),
    b AS (SELECT image_id, quantile_cont(v, 0.9) AS base FROM c GROUP BY image_id), t AS (SELECT image_id, y, x, -ln(least(greatest(v / greatest(base, 0.000001), 0.000001::DOUBLE), 1)) AS v FROM c JOIN b USING (image_id)),
    u AS (SELECT image_id, greatest(quantile_cont(v, 0.99), 0.05::DOUBLE) AS up FROM t GROUP BY image_id), p AS (SELECT image_id, least(greatest(v / greatest(up, 0.0001::DOUBLE), 0), 1) AS v FROM t JOIN u USING (image_id))
    SELECT image_id, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std, round(avg((v >= 0.995)::INT), 6) + 0.0 AS clipped FROM p GROUP BY image_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    df = patch(spark, d).join(F.broadcast(_flat(spark, d)), ["y", "x"])  # 64 rows of calibration
    df = df.withColumn("v", C.clamp(F.col("v") / F.greatest("flat", F.lit(1e-6))))
    df = S.with_percentile(df, F.col("v"), 90, "base").withColumn("v", T.density(T.transmission(F.col("v"), F.col("base"))))
    df = S.with_percentile(df, F.col("v"), 99, "up").withColumn("v", T.to_positive(F.col("v"), F.greatest("up", F.lit(0.05))))
    return each(df.groupBy("image_id").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), reductions.share(F.col("v") >= 0.995).alias("clipped")))


def physical(df: DataFrame) -> DataFrame:
    """Density, unmixing, expm1 inversion, neutral damping, red guard and display mapping of linear negatives."""
    r, g, b = (F.col(c) for c in COLS)
    df = df.withColumns({c: T.density(T.transmission(F.col(c), F.lit(0.9))) for c in COLS})
    df = df.select("image_id", "y", "x", *[c.alias(n) for c, n in zip(T.matrix_blend((r, g, b), UNMIX, 0.8), COLS, strict=True)])
    df = S.expm1_inversion(df).select("image_id", "y", "x", *COLS)
    df = df.select("image_id", "y", "x", *[c.alias(n) for c, n in zip(T.neutral_damp(r, g, b, 0.25, 0.1), COLS, strict=True)])
    return S.display_mapping(df.withColumn("r", T.red_guard(r, g, b, 0.05, 0.3)), 99.5)


_SP = "(greatest(r, g, b) - least(r, g, b))"
_PHYS = RGB + ", d AS (SELECT image_id, y, x, " + ", ".join(f"-ln(least(greatest({c} / 0.9::DOUBLE, 0.000001::DOUBLE), 1)) AS {c}" for c in "rgb") + " FROM rgb), m AS (SELECT image_id, y, x, " + ", ".join(f"{c} + 0.8::DOUBLE * ({w[0]}::DOUBLE * r + {w[1]}::DOUBLE * g + {w[2]}::DOUBLE * b - {c}) AS {c}" for c, w in zip("rgb", UNMIX)) + " FROM d), e AS (SELECT image_id, y, x, " + ", ".join(f"exp(least(greatest({c} * {k}::DOUBLE, 0), 8)) - 1 AS {c}" for c, k in zip("rgb", (1.35, 1.20, 1.10))) + " FROM m), q AS (SELECT image_id, " + ", ".join(f"quantile_cont({c}, 0.995) AS {c}u" for c in "rgb") + " FROM e GROUP BY image_id), n AS (SELECT image_id, y, x, " + ", ".join(f"least(greatest({c} / greatest({c}u, 0.000001::DOUBLE), 0), 1) AS {c}" for c in "rgb") + " FROM e JOIN q USING (image_id)), a AS (SELECT image_id, y, x, " + ", ".join(f"{c} + 0.25::DOUBLE * exp(-{_SP} * {_SP} / (2 * 0.1::DOUBLE * 0.1::DOUBLE)) * ((r + g + b) / 3 - {c}) AS {c}" for c in "rgb") + " FROM n), h AS (SELECT image_id, y, x, r - 0.3::DOUBLE * greatest(r - 0.5::DOUBLE * (g + b) - 0.05::DOUBLE, 0) AS r, g, b FROM a), s AS (SELECT image_id, unnest([r, g, b]) AS v FROM h), p AS (SELECT image_id, quantile_cont(v, 0.995) AS lim FROM s GROUP BY image_id)"


@query("pipe06_physical", sql_out("h JOIN p USING (image_id)", _PHYS, each=_OETF.replace("{v}", "least(greatest({c} / (lim + 0.000001::DOUBLE), 0), 1)")))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(physical(rgb(spark, d)), **{c: F.col(c) for c in COLS})


@query("udf01_classify", f"WITH {_FILM} SELECT image_id, CASE WHEN image_id % 5 = 0 THEN 'positive_120' WHEN mr > mg + 12 AND mg > mb + 10 THEN 'negative_120' WHEN border < 55 AND border + 18 < inner_ THEN 'positive_120' ELSE 'positive_35mm' END AS film_type FROM m JOIN b USING (image_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    model = F.when(F.col("image_id") % 5 == 0, "positive_120")  # stands for a model that answers some of the time
    return M.film_type(rgb8(spark, d)).select("image_id", F.coalesce(model, F.col("film_type")).alias("film_type"))


@query("udf02_evaluate", SCORE_SQL.replace("SELECT image_id, round(least", "SELECT image_id, CASE WHEN image_id % 7 = 0 THEN 0.5 ELSE 1 END * round(least"))
def _(spark: SparkSession, d: str) -> DataFrame:
    said = heuristic_score(rgb8(spark, d))
    return said.withColumn("score", F.when(F.col("image_id") % 7 == 0, 0.5).otherwise(1.0) * F.col("score"))


@query("udf04_flat_evaluator", f"""WITH {PATCH}, u AS (SELECT image_id, stddev_pop(v) / greatest(avg(v), 0.000000001) AS cv, (quantile_cont(v, 0.95) - quantile_cont(v, 0.05)) / greatest(median(v), 0.000001) AS span, max(v) / greatest(median(v), 0.000001) - 1 AS hot,
    avg(v) FILTER (c) / greatest(avg(v) FILTER (NOT c), 0.000001) AS ce, avg((v >= 0.995)::INT) AS hi FROM (SELECT *, y >= 2.4 AND y < 5.6 AND x >= 2.4 AND x < 5.6 AS c FROM patch) GROUP BY image_id)
    SELECT image_id, round(least(greatest(1 - least(1.7::DOUBLE * cv * 0.2 + 0.7::DOUBLE * span * 0.2 + 0.55::DOUBLE * hot * 0.2, 1) - least(6 * hi, 0.25::DOUBLE), 0), 1), 6) + 0.0 AS score,
    round(least(greatest(CASE WHEN round(ce, 6) < 0.94 THEN 0.9 ELSE 1.2 END, 0.7), 1.8), 6) AS strength FROM u""")
def _(spark: SparkSession, d: str) -> DataFrame:
    u = reductions.uniformity(patch(spark, d))
    uneven = 1.7 * F.col("cv") * 0.2 + 0.7 * F.col("span") * 0.2 + 0.55 * F.col("hotspot") * 0.2
    score = C.clamp(1.0 - F.least(uneven, F.lit(1.0)) - F.least(6.0 * F.col("clipped_high"), F.lit(0.25)))
    strength = C.clamp(F.when(F.round("centre_edge", 6) < 0.94, 0.9).otherwise(1.2), 0.7, 1.8)
    return u.select("image_id", rounded(score).alias("score"), rounded(strength).alias("strength"))
