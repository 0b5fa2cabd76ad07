"""Rectangles, boxes, the protocol, border votes, refinement and models against plain versions."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterbrook.operators import borders, graph, integral, models, neighbourhood, protocol, refine

PLANE = "image_id long, y long, x long, v double"
RGB = "image_id long, y long, x long, r double, g double, b double"


def plane(spark, *images):
    return spark.createDataFrame([(i, y, x, float(a[y, x])) for i, a in enumerate(images) for y in range(a.shape[0]) for x in range(a.shape[1])], PLANE)


def back(rows, value, shape):
    a = np.full(shape, np.nan)
    for r in rows:
        a[r.y, r.x] = r[value]
    return a


@pytest.mark.parametrize("shape, half", [((7, 12), 2), ((20, 9), 7), ((5, 5), 0), ((3, 3), 9), ((1, 4), 1)])
def test_box_means(spark, shape, half):
    a = np.random.default_rng(1).random(shape)
    got = integral.box_means(plane(spark, a).withColumn("kept", F.col("x") * 10), ["v"], F.lit(half)).collect()
    ky, kx = min(half, shape[0] - 1), min(half, shape[1] - 1)
    p = np.pad(a, ((ky, ky), (kx, kx)), mode="reflect") if min(shape) > 1 else np.pad(a, ((0, 0), (kx, kx)), mode="reflect")
    want = np.array([[p[y : y + 2 * ky + 1, x : x + 2 * kx + 1].mean() for x in range(shape[1])] for y in range(shape[0])])
    assert np.allclose(back(got, "v", shape), want) and all(r.kept == r.x * 10 for r in got)


def test_rectangles(spark):
    rng = np.random.default_rng(2)
    images = [rng.random((11, 17)), rng.random((30, 6))]
    rects = [(i, f"r{k}", *(sorted(rng.choice(images[i].shape[0] + 1, 2, replace=False).tolist())), *(sorted(rng.choice(images[i].shape[1] + 1, 2, replace=False).tolist()))) for i in (0, 1) for k in range(40)]
    df = spark.createDataFrame([(i, n, y0, x0, y1, x1) for i, n, y0, y1, x0, x1 in rects], "image_id long, region string, y0 long, x0 long, y1 long, x1 long")
    got = {(r.image_id, r.region): r for r in integral.rectangle_stats(plane(spark, *images), df, "v").collect()}
    for i, n, y0, y1, x0, x1 in rects:
        part, r = images[i][y0:y1, x0:x1], got[i, n]
        assert r.n == part.size and abs(r["mean"] - part.mean()) < 1e-12 and abs(r["std"] - part.std()) < 2e-6
    assert integral.rectangle_stats(plane(spark, images[0]).limit(0), df, "v").collect() == []


def test_proxy(spark):
    a = np.random.default_rng(3).random((20, 35))
    df = plane(spark, a).select("image_id", "y", "x", *[(F.col("v") * k).alias(c) for k, c in enumerate("rgb", 1)])
    got = protocol.proxy(df, 13).collect()
    h, w = max(1, round(20 * 13 / 35)), 13
    share = lambda n, m: np.array([[max(0, min((i + 1) * m / n, k + 1) - max(i * m / n, k)) for i in range(n)] for k in range(m)])
    wy, wx = share(20, h), share(35, w)
    want = (wy @ a @ wx.T) / np.outer(wy.sum(1), wx.sum(1))
    assert np.allclose(back(got, "r", (h, w)), want) and np.allclose(back(got, "b", (h, w)), 3 * want)
    assert protocol.proxy(df, 35).count() == a.size


def test_base_model_of_a_frame_with_three_zones(spark):
    """Bright light at the top, even film base on the left, a picture elsewhere."""
    rng = np.random.default_rng(4)
    base = np.array([0.45, 0.28, 0.15])
    img = rng.random((60, 80, 3)) * 0.5
    img[:, :30] = base + rng.normal(0, 0.001, (60, 30, 3))
    img[:6] = 0.98
    df = spark.createDataFrame([(9, y, x, *map(float, img[y, x])) for y in range(60) for x in range(80)], RGB)
    found = protocol.base_candidates(df)
    assert {"low_variance_base", "grid_3_1_0", "grid_3_2_0"} <= {r.region for r in found.collect()}
    model = protocol.base_model(protocol.score_candidates(found)).first()
    assert np.allclose([model.r, model.g, model.b], base, atol=0.01) and model.confidence > 0.6 and model.n_consistent >= 3


def test_protocol_keeps_broken_frames_apart(spark):
    rng = np.random.default_rng(5)
    flat = 0.5 + 0.4 * rng.random((12, 12, 3))
    base = flat * [0.8, 0.6, 0.4]
    frames = [base * (0.2 + 0.8 * rng.random((12, 12, 1))) for _ in range(4)]
    rows = [(i, y, x, *map(float, f[y, x])) for i, f in enumerate(frames) for y in range(12) for x in range(12)]
    rows = [(*r[:3], float("nan"), *r[4:]) if r[:3] == (1, 4, 4) else r for r in rows] + [(2, 99, 0, 0.1, 0.1, 0.1), (7, 0, 0, None, 0.1, 0.1)]
    px = lambda a: spark.createDataFrame([(y, x, *map(float, a[y, x])) for y in range(12) for x in range(12)], "y long, x long, r double, g double, b double")
    report, shown = protocol.run_protocol(px(flat), px(base), spark.createDataFrame(rows, RGB))
    by = {r.image_id: r for r in report.collect()}
    assert {i: r.status for i, r in by.items()} == {0: "ok", 1: "error", 2: "error", 3: "ok", 7: "error"}
    assert by[1].error.startswith("load: 1") and by[2].error.startswith("flat field: 1") and by[1].score is None
    assert 0 <= by[0].score <= 1 and by[0].channel_spread < 0.05 and {r.image_id for r in shown.select("image_id").distinct().collect()} == {0, 3}
    slide = protocol.run_protocol(px(flat), px(base), spark.createDataFrame(rows, RGB), negative=False, gamma=0.8, contrast=0.1)[1]
    assert slide.agg(F.min("r"), F.max("r")).first()[0] >= 0


def brute_regions(mask):
    seen, out = {}, []
    for p in zip(*np.nonzero(mask), strict=True):
        if p in seen:
            continue
        todo, seen[p] = [p], len(out)
        out.append(set())
        while todo:
            y, x = todo.pop()
            out[seen[p]].add((int(y), int(x)))
            for q in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and q not in seen:
                    seen[q] = seen[p]
                    todo.append(q)
    return {frozenset(s) for s in out}


@pytest.mark.parametrize("block", [1, 3, 7, 256])
def test_regions_over_blocks_of_lines(spark, block):
    rng = np.random.default_rng(6)
    masks = [rng.random((25, 30)) < 0.4, np.ones((9, 4), bool), np.zeros((5, 5), bool)]
    snake = np.zeros((20, 20), bool)
    snake[:, ::2] = True
    snake[0, 1::4] = snake[19, 3::4] = True
    masks.append(snake)
    df = plane(spark, *masks).withColumn("m", F.when(F.col("v") > 0, True))
    got = {}
    for r in neighbourhood.regions(df, "m", block).collect():
        got.setdefault((r.image_id, r.region), set()).add((r.y, r.x))
    for i, mask in enumerate(masks):
        assert {frozenset(s) for (k, _), s in got.items() if k == i} == brute_regions(mask)


def test_components_of_structs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    df = spark.createDataFrame([((7, a), (7, b)) for a, b in edges], "a struct<i:long, n:long>, b struct<i:long, n:long>")
    low = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node.n: r.component.n for r in graph.components(df).collect()}
    assert {n: got.get(n, n) for n in low} == low
    assert graph.components(df.limit(0)).collect() == []


def brute_depths(mask):
    out = []
    for m in (mask, mask[::-1], mask.T, mask.T[::-1]):
        depth = 0
        for d in range(1, max(1, int(m.shape[0] * 0.2)) + 1):
            if m[:d].mean() < 0.6:
                break
            depth = d
        out.append(depth)
    return out


def brute_refined(mask):
    h, w = mask.shape
    on = np.zeros_like(mask)
    for s in brute_regions(mask):
        if any(y in (0, h - 1) or x in (0, w - 1) for y, x in s):
            for p in s:
                on[p] = True
    on = mask if on.mean() < 0.005 else on
    t, b, le, r = brute_depths(on)
    strips = np.zeros_like(mask)
    strips[:t] = strips[h - b :] = True
    strips[:, :le] = strips[:, w - r :] = True
    return on if strips.mean() < 0.005 else strips


def test_border_vote(spark):
    rng = np.random.default_rng(7)
    masks, want = [], []
    for k in range(4):
        a = [rng.random((30, 40)) < 0.08 for _ in range(3)]
        for m in a[: 2 + k % 2]:
            m[: 2 + k] |= rng.random((2 + k, 40)) < 0.9
            m[:, 37:] |= rng.random((30, 3)) < 0.8
        masks.append(a)
    masks.append([np.zeros((10, 12), bool)] * 3)
    conf = [0.5, 0.9, 0.3]
    rows = []
    for i, a in enumerate(masks):
        vote = np.round(sum(c * m for c, m in zip(conf, a, strict=True)) / sum(conf), 9)
        border, clear = brute_refined(vote >= 0.33), brute_refined(vote >= 0.66)
        clear = border if clear.mean() < 0.005 else clear
        want.append((border, clear, vote))
        rows += [(i, y, x, *(bool(m[y, x]) for m in a)) for y in range(a[0].shape[0]) for x in range(a[0].shape[1])]
    df = spark.createDataFrame(rows, "image_id long, y long, x long, a boolean, b boolean, c boolean")
    px, report = borders.merge_borders(df, {n: F.lit(c) for n, c in zip("abc", conf, strict=True)}, block=8)
    px, report = px.collect(), {r.image_id: r for r in report.collect()}
    for i, (border, clear, vote) in enumerate(want):
        mine = [r for r in px if r.image_id == i]
        assert (back(mine, "border", border.shape) == border).all() and (back(mine, "clear", border.shape) == clear).all()
        h, w = border.shape
        far = np.minimum(np.minimum.outer(np.arange(h), np.arange(w)), np.minimum.outer(np.arange(h)[::-1], np.arange(w)[::-1]))
        near = np.clip(1 - far[border].mean() / (min(h, w) / 4), 0, 1) if border.any() else 0
        deep = np.clip(np.mean([d / max(0.05 * n, 1) for d, n in zip(brute_depths(border), (h, h, w, w), strict=True)]), 0, 1)
        sure = np.clip(0.4 * (vote[border].mean() if border.any() else 0) + 0.4 * near + 0.2 * deep, 0, 1)
        assert abs(report[i].confidence - sure) < 1e-9
        ys, xs = np.nonzero(~border)
        assert (report[i].x0, report[i].y0, report[i].x1, report[i].y1) == (xs.min(), ys.min(), xs.max(), ys.max())


def test_detected_border(spark):
    v = 0.2 + 0.5 * np.random.default_rng(8).random((40, 60))
    v[:4] = v[36:] = v[:, :5] = v[:, 55:] = 0.95
    px, report = borders.detect_border(plane(spark, v))
    got = back(px.collect(), "border", v.shape)
    assert got[:3].mean() > 0.95 and got[10:30, 15:45].mean() == 0 and report.first().confidence > 0.5


def test_refinement_processes_only_what_has_not_passed(spark):
    rng = np.random.default_rng(9)
    rows = [(i, y, x, *map(float, np.floor(255 * np.clip((0.2 + 0.2 * i) * rng.random(3), 0, 1)))) for i in range(5) for y in range(6) for x in range(6)]
    px = spark.createDataFrame(rows, RGB)
    first = px.select("image_id").distinct().select("image_id", F.lit(0.0).alias("lift"))

    def evaluate(df, k):
        m = df.groupBy("image_id").agg(F.avg("r").alias("mean"))
        score = F.round(F.col("mean") / 255, 6)
        return m.select("image_id", score.alias("score"), (score >= 0.4).alias("passed"), F.lit("x").alias("feedback"), (F.col("mean") + 10.0 * k - F.col("mean")).alias("lift"))

    process = lambda df, names: df.select("image_id", "y", "x", *[(F.col(c) + F.col("lift")).alias(c) for c in "rgb"])
    report, shown, rounds = refine.refine_images(px, first, process, evaluate, 4)
    mean = {i: np.mean([r[3] for r in rows if r[0] == i]) for i in range(5)}
    lifts, active, want = dict.fromkeys(range(5), 0.0), set(range(5)), {}
    for k in range(1, 5):
        assert rounds[k - 1] == (k, len(active), 36 * len(active))
        for i in sorted(active):
            score = round((mean[i] + lifts[i]) / 255, 6)
            if i not in want or score > want[i][1]:
                want[i] = (k, score, lifts[i])
            if score >= 0.4:
                active.discard(i)
            lifts[i] = 10.0 * k
        if not active:
            break
    got = {r.image_id: r for r in report.collect()}
    assert {i: (r.iteration, round(r.score, 6), r.lift) for i, r in got.items()} == {i: (k, pytest.approx(s), v) for i, (k, s, v) in want.items()}
    for r in shown.groupBy("image_id").agg(F.avg("r").alias("m")).collect():
        assert abs(r.m - mean[r.image_id] - want[r.image_id][2]) < 1e-9
    assert len(rounds) < 4 or active
    none = refine.refine_images(px.limit(0), first.limit(0), process, evaluate, 3)
    assert none[0].count() == none[1].count() == 0 and none[2] == []


def test_rules_of_judgement(spark):
    flat = spark.createDataFrame([(0, y, x, 40.0, 40.0, 40.0) for y in range(6) for x in range(6)] + [(1, y, x, 200.0, 120.0, 60.0 + 60 * ((y + x) % 2)) for y in range(6) for x in range(6)], RGB)
    a, b = (r for r in refine.judged(flat).orderBy("image_id").collect())
    assert a.feedback == "Image is too dark; output appears soft; output is desaturated." and not a.passed and (a.gamma, a.shadow_lift, a.vibrance, a.lab_strength, a.unsharp_amount) == (0.75, 8.0, 0.25, 1.0, 0.5)
    assert b.feedback == "Red/yellow cast remains." and (b.wb_clip_percent, b.lab_strength, b.gamma) == (0.9, 1.2, 1.0)


def answer(request):
    n = json.loads(request)["n"]
    return {0: "junk", 1: None, 2: '{"film_type": "polaroid"}'}.get(n % 10, f'well: {{"film_type": "Negative_120", "score": {n / 100}, "suggested_params": {{"gamma": 9}}}} bye')


def model(requests):
    if any(json.loads(r)["n"] % 10 == 3 for r in requests):
        raise RuntimeError("boom")
    return [answer(r) for r in requests]


def asked(spark, numbers):
    return spark.createDataFrame([(i, n, i % 2) for i, n in enumerate(numbers)], "i long, n long, agent long").repartition(3)



def how():
    return {"request": F.to_json(F.struct("n")), "agent": F.col("agent"), "order": F.col("i")}


def test_classifier_with_a_breaker(spark):
    numbers = [4, 5, 6, 7, 8, 3, 4, 5, 0, 6, 7, 8, 9, 14]
    df = asked(spark, numbers)
    got = {r.i: r for r in models.classify(df, model, rule=F.lit("positive_35mm"), **how()).collect()}
    first = {a: min((i for i, n in enumerate(numbers) if i % 2 == a and n % 10 < 4), default=99) for a in (0, 1)}
    for i in range(len(numbers)):
        on = i < first[i % 2]
        assert (got[i].film_type, got[i].mode) == (("negative_120", "model") if on else ("positive_35mm", "heuristic"))
    strict = {r.i: r for r in models.classify(df, model, rule=F.lit("positive_35mm"), fallback=False, **how()).collect()}
    assert [strict[i].mode for i in range(len(numbers))] == ["default" if n % 10 < 4 else "model" for n in numbers]
    assert {strict[i].film_type for i, n in enumerate(numbers) if n % 10 < 4} == {models.DEFAULT_TYPE}
    assert {r.mode for r in models.classify(df, None, rule=F.lit("positive_120"), **how()).collect()} == {"heuristic"}
    assert models.classify(df.limit(0), model, rule=F.lit("x"), **how()).collect() == []


def test_evaluator(spark):
    df = asked(spark, [80, 33, 70, 21, 95])
    got = {r.n: r for r in models.evaluate(df, model, rule={}, fallback=False, **how()).collect()}
    assert got[95].score == 0.95 and got[95].passed and got[95].gamma == 2.2 and got[95].mode == "model"
    assert got[33].score == 0 and got[33].feedback == "Parse error: RuntimeError: boom" and got[21].feedback == "Parse error: unusable answer: None" and got[80].mode == "default"
    rule = {"score": F.lit(0.8), "feedback": F.lit("fine"), "gamma": F.lit(1.1), "clahe_clip": F.lit(1.0), "vibrance": F.lit(0.1)}
    ruled = models.evaluate(df, None, rule=rule, **how()).collect()
    assert all((r.score, r.feedback, r.gamma, r.passed, r.mode) == (0.8, "fine", 1.1, True, "heuristic") for r in ruled)


def test_a_range_stops_asking_after_a_failure(spark, tmp_path):
    calls = tmp_path / "calls"

    def counting(requests):
        with calls.open("a") as f:
            f.write("".join(f"{json.loads(r)['n']}\n" for r in requests))
        return [answer(r) for r in requests]

    df = spark.createDataFrame([(i, 0 if i == 70 else 4, 0) for i in range(1000)], "i long, n long, agent long").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        got = models.classify(df, counting, rule=F.lit("r"), **how()).groupBy("mode").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert {r["mode"]: r["count"] for r in got} == {"model": 70, "heuristic": 930} and len(calls.read_text().split()) == 128


def test_empty_tables(spark):
    none = plane(spark, np.zeros((2, 2))).limit(0)
    px, report = borders.merge_borders(none.withColumn("a", F.col("v") > 0), {"a": F.lit(0.5)})
    assert px.count() == report.count() == 0
    colours = none.select("image_id", "y", "x", *[F.col("v").alias(c) for c in "rgb"])
    assert protocol.base_model(protocol.score_candidates(protocol.base_candidates(colours))).count() == 0
    flat = spark.createDataFrame([(y, x, 0.5, 0.5, 0.5) for y in range(8) for x in range(8)], "y long, x long, r double, g double, b double")
    report, shown = protocol.run_protocol(flat, flat, colours)
    assert report.count() == shown.count() == 0
