"""Queries of refinement by delta iteration and of models that answer in JSON, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masks as M
from ..operators import models, refine
from ..operators.stats import join_back
from .bridge import RGB8, out, query, rgb8, rounded, sql_out
from .flows import _FILM
from .pointwise import GRAY, SAT
from .rasters import _REFLECT

TUNED = ("gamma", "highlight_compression", "shadow_lift", "vibrance")
_LEVEL = "floor(round(least(greatest({}, 0), 255), 6))"
_TOP = "greatest(r, g, b)"


def _step(e: str) -> str:
    return ", ".join(f"{e.replace('{c}', c)} AS {c}" for c in "rgb")


def _round(k: int) -> str:
    """The CTEs of a round: pixels of the active images with their parameters, metrics, verdict."""
    p = ", ".join(TUNED)
    gamma = f"CASE WHEN abs(gamma - 1) < 0.01 THEN {{c}} ELSE {_LEVEL.format('pow({c} / 255.0::DOUBLE, gamma) * 255.0::DOUBLE')} END"
    high = f"CASE WHEN highlight_compression <= 0.001 THEN {{c}} ELSE {_LEVEL.format('{c} / 255.0::DOUBLE * (1.0 - highlight_compression * {c} / 255.0::DOUBLE) * 255.0::DOUBLE')} END"
    lift = f"CASE WHEN shadow_lift = 0 THEN {{c}} ELSE {_LEVEL.format('{c} + shadow_lift')} END"
    vivid = f"CASE WHEN abs(vibrance) < 0.01 THEN {{c}} ELSE {_LEVEL.format(f'CASE WHEN sat > 0 THEN {_TOP} - ({_TOP} - {{c}}) * least(greatest(sat + vibrance * (1 - sat), 0), 1) / sat ELSE {{c}} END')} END"
    nine = lambda e, n: f"round({e}, 9) AS {n}"
    return f"""
    g{k} AS (SELECT image_id, y, x, {_step(gamma)}, {p} FROM rgb8 JOIN a{k} USING (image_id)), h{k} AS (SELECT image_id, y, x, {_step(high)}, {p} FROM g{k}),
    l{k} AS (SELECT image_id, y, x, {_step(lift)}, {p} FROM h{k}), p{k} AS MATERIALIZED (SELECT image_id, y, x, {_step(vivid)} FROM (SELECT *, {SAT} AS sat FROM l{k})),
    q{k} AS MATERIALIZED (SELECT *, floor({GRAY}) AS gray, {SAT} AS sat FROM p{k}),
    w{k} AS (SELECT q.image_id, q.y, q.x, any_value(q.r) AS r, any_value(q.g) AS g, any_value(q.b) AS b, any_value(q.gray) AS gray, any_value(q.sat) AS sat, sum(n.gray) - 4 * any_value(q.gray) AS l
        FROM q{k} q, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx), q{k} n WHERE n.image_id = q.image_id AND n.y = {_REFLECT.format(i="q.y + dy")} AND n.x = {_REFLECT.format(i="q.x + dx")} GROUP BY q.image_id, q.y, q.x),
    m{k} AS (SELECT image_id, {nine("avg(gray)", "mean")}, {nine("avg((gray <= 2)::INT)", "black")}, {nine("avg((gray >= 253)::INT)", "white")}, {nine("(avg(b) - avg(r)) / 255", "br")}, {nine("(2 * avg(g) - avg(b) - avg(r)) / 255", "gm")},
        {nine("(greatest(avg(r), avg(g), avg(b)) - least(avg(r), avg(g), avg(b))) / 255", "spread")}, {nine("avg(sat)", "sat")}, least(round(var_pop(l), 9) / 200, 1) AS sharp FROM w{k} GROUP BY image_id),
    s{k} AS (SELECT *, round(least(greatest(1 - 0.22::DOUBLE * CASE WHEN mean < 100 THEN least((100 - mean) / 100, 1) WHEN mean > 165 THEN least((mean - 165) / 90, 1) ELSE 0 END - 0.12::DOUBLE * least(black + white, 1)
        - 0.28::DOUBLE * least(spread * 1.2::DOUBLE + abs(br) * 1.8::DOUBLE + abs(gm) * 0.8::DOUBLE, 1) - 0.2::DOUBLE * (1 - sharp) - 0.18::DOUBLE * CASE WHEN sat < 0.04 THEN 1 WHEN sat < 0.08 THEN (0.08::DOUBLE - sat) / 0.04::DOUBLE ELSE 0 END, 0), 1), 9) AS score,
        list_filter([CASE WHEN mean < 100 THEN 'image is too dark' WHEN mean > 165 THEN 'image is too bright' END, CASE WHEN br > 0.08 THEN 'blue/cyan cast remains' WHEN br < -0.08 THEN 'red/yellow cast remains' WHEN spread > 0.18 THEN 'visible channel imbalance' END,
            CASE WHEN sharp < 0.4 THEN 'output appears soft' END, CASE WHEN sat < 0.04 THEN 'output is desaturated' WHEN sat < 0.08 THEN 'colours are muted' END], lambda t: t IS NOT NULL) AS parts FROM m{k}),
    j{k} AS MATERIALIZED (SELECT s.image_id, {k} AS iteration, score, score >= 0.8 AS passed, CASE WHEN len(parts) = 0 THEN 'Good exposure, colour balance, and detail.' ELSE upper(array_to_string(parts, '; ')[1]) || array_to_string(parts, '; ')[2:] || '.' END AS feedback, {", ".join(f"a.{c} AS used_{c}" for c in TUNED)},
        CASE WHEN mean < 100 THEN 0.75 WHEN mean > 165 THEN 1.3 ELSE 1 END::DOUBLE AS gamma, CASE WHEN white > 0.01 THEN 0.25 ELSE 0 END::DOUBLE AS highlight_compression, CASE WHEN mean < 100 THEN 8 ELSE 0 END::DOUBLE AS shadow_lift, CASE WHEN sat < 0.08 THEN 0.25 ELSE 0 END::DOUBLE AS vibrance
        FROM s{k} s JOIN a{k} a USING (image_id)),
    a{k + 1} AS (SELECT image_id, {p} FROM j{k} WHERE NOT passed)"""


_REFINED = RGB8 + ", a1 AS (SELECT DISTINCT image_id, 1.0::DOUBLE AS gamma, 0.0::DOUBLE AS highlight_compression, 0.0::DOUBLE AS shadow_lift, 0.0::DOUBLE AS vibrance FROM rgb8)," + ",".join(_round(k) for k in (1, 2, 3)) + """,
    best AS (SELECT *, max(iteration) OVER (PARTITION BY image_id) AS tries FROM (SELECT * FROM j1 UNION ALL SELECT * FROM j2 UNION ALL SELECT * FROM j3) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, iteration) = 1)"""


def _refined(spark: SparkSession, d: str):
    px = rgb8(spark, d)
    start = {"gamma": 1.0, "highlight_compression": 0.0, "shadow_lift": 0.0, "vibrance": 0.0}
    first = px.select("image_id").distinct().select("image_id", *[F.lit(v).alias(n) for n, v in start.items()])
    judge = lambda df, k: refine.judged(df, 0.8).select("image_id", "score", "passed", "feedback", *TUNED)
    return refine.refine_images(px, first, refine.curves, judge, most=3)


@query("itr01_delta_report", sql_out("best", _REFINED, "image_id iteration passed tries feedback", score="score", **{c: f"used_{c}" for c in TUNED}))
def _(spark: SparkSession, d: str) -> DataFrame:
    report = _refined(spark, d)[0]
    return out(report, "image_id iteration passed tries feedback", score=F.col("score"), **{c: F.col(c) for c in TUNED})


@query("itr01_delta_pixels", sql_out("(SELECT p.*, 1 AS iteration FROM p1 p UNION ALL SELECT p.*, 2 FROM p2 p UNION ALL SELECT p.*, 3 FROM p3 p) JOIN best USING (image_id, iteration)", _REFINED, each="{c}"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return out(_refined(spark, d)[1], r=F.col("r"), g=F.col("g"), b=F.col("b"))


def _number(request: str) -> int:
    asked = json.loads(request)
    return (asked["image_id"] * 7 + asked["level"]) % 23


def typing_model(requests: list[str]) -> list[str]:
    """Stands for a model: answers by the image's level, fails or talks nonsense now and then."""
    numbers = [_number(r) for r in requests]
    if 0 in numbers:
        raise ValueError("model failed")
    odd = {1: "no json", 2: '{"film_type": "polaroid"}'}
    return [odd.get(n, 'Sure: {"film_type": " Positive_120 "}' if n % 2 else '{"film_type": "negative_35mm"}') for n in numbers]


def scoring_model(requests: list[str]) -> list[str]:
    levels = [json.loads(r)["level"] for r in requests]
    numbers = [_number(r) for r in requests]
    if 0 in numbers:
        raise ValueError("model failed")
    odd = {1: "no json", 2: '{"score": null}'}
    said = [json.dumps({"score": v % 100 / 100, "feedback": f" level {v} ", "suggested_params": {"gamma": v / 100, "vibrance": "much", "clahe_clip": "2.5"}}) for v in levels]
    return [odd.get(n, s) for n, s in zip(numbers, said, strict=True)]


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    px = rgb8(spark, d)
    seen = models.with_metrics(M.film_type(px).select("image_id", F.col("film_type").alias("rule")), px.groupBy("image_id").agg(F.floor(F.avg("r")).cast("long").alias("level")))
    return seen, {"request": F.to_json(F.struct("image_id", "level")), "agent": F.col("image_id") % 4, "order": F.col("image_id")}


_MODEL = _FILM + """, n AS (SELECT image_id, floor(mr)::BIGINT AS level, image_id % 4 AS agent, (image_id * 7 + floor(mr)::BIGINT) % 23 AS n,
    CASE WHEN mr > mg + 12 AND mg > mb + 10 THEN 'negative_120' WHEN border < 55 AND border + 18 < inner_ THEN 'positive_120' ELSE 'positive_35mm' END AS rule FROM m JOIN b USING (image_id)),
    f AS (SELECT *, coalesce(min(CASE WHEN n < 3 THEN image_id END) OVER (PARTITION BY agent), 9223372036854775807) AS first FROM n)"""


@query("udf01_model_hook", f"WITH {_MODEL} SELECT image_id, CASE WHEN image_id >= first THEN rule WHEN n % 2 = 1 THEN 'positive_120' ELSE 'negative_35mm' END AS film_type, CASE WHEN image_id >= first THEN 'heuristic' ELSE 'model' END AS mode FROM f")
def _(spark: SparkSession, d: str) -> DataFrame:
    seen, how = _asked(spark, d)
    return models.classify(seen, typing_model, rule=F.col("rule"), **how).select("image_id", "film_type", "mode")


@query("udf02_model_hook", f"""WITH {_MODEL} SELECT image_id, CASE WHEN n < 3 THEN 'default' ELSE 'model' END AS mode, CASE WHEN n < 3 THEN 0 ELSE level % 100 / 100.0::DOUBLE END AS score, n >= 3 AND level % 100 >= 75 AS passed,
    CASE n WHEN 0 THEN 'Parse error: ValueError: model failed' WHEN 1 THEN 'Parse error: unusable answer: no json' WHEN 2 THEN 'Parse error: unusable answer: {{"score": null}}' ELSE 'level ' || level END AS feedback,
    CASE WHEN n < 3 THEN 1 ELSE least(greatest(level / 100.0::DOUBLE, 0.4), 2.2) END::DOUBLE AS gamma, CASE WHEN n < 3 THEN 1.4 ELSE 2.5 END::DOUBLE AS clahe_clip, 0.0::DOUBLE AS vibrance FROM f""")
def _(spark: SparkSession, d: str) -> DataFrame:
    seen, how = _asked(spark, d)
    got = models.evaluate(seen, scoring_model, rule={}, fallback=False, **how)
    return got.select("image_id", "mode", *[rounded(F.col(c)).alias(c) for c in ("score", "gamma", "clahe_clip", "vibrance")], "passed", "feedback")
