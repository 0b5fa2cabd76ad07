"""Queries against their SQL on small made tables where the two engines' arithmetic is easily told apart."""

import datetime as dt
import random

import duckdb
import pytest

from rasterbrook.plans.registry import ORACLE_SQL, QUERIES


def same(spark, folder, name, table):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = c.execute(ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    got = QUERIES[name](spark, str(folder)).select(*cols).collect()
    key = lambda row: [(v is None, v or 0) for v in row]
    assert sorted(map(tuple, got), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("name", ["itr01_refine_loop", "itr02_refine_early_stop", "top01_best_run"])
def test_scores_on_a_half(spark, tmp_path, name):
    """72.5 / 500 to two places is 0.14 by the SQL's rounding; so is 70 / 500."""
    start, values = dt.datetime(2024, 1, 1), [72.5, 70.0, 72.5, 287.5, 502.5, 1.5, 2.5, 7.5]
    rows = [(u * 8 + i, start + dt.timedelta(seconds=i), u, "view", v) for u in range(8) for i, v in enumerate(values[u:] + values[:u])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    same(spark, tmp_path, name, "events")


def test_grid_cells_are_rectangles(spark):
    """Cells of grids that don't divide the image, some without a pixel, in one aggregate; the query's plan looks nothing up."""
    from rasterbrook.operators import integral, neighbourhood

    rng = random.Random(3)
    df = spark.createDataFrame([(k, y, x, rng.random()) for k, h, w in ((1, 7, 10), (2, 3, 5)) for y in range(h) for x in range(w)], "image_id long, y long, x long, v double")
    want = integral.rectangle_stats(df, integral.grid_rectangles(neighbourhood.sizes(df), (1, 3, 4)), "v").collect()
    got = integral.grid_stats(df, (1, 3, 4), "v").collect()
    near = lambda rows: sorted((r.image_id, r.region, r.n, round(r["mean"], 9), round(r["std"], 5)) for r in rows)
    assert near(got) == near(want)


@pytest.mark.parametrize("name", ["pipe05_rectangles", "win06_clahe", "agg05_side_fusion", "prj02_percentile_stretch"])
def test_vectors_are_dealt_out_before_their_pixels(spark, tmp_path, name):
    """What goes by image moves vectors between tasks, never pixels: no shuffle above the explosion but those of the tables joined back."""
    rng = random.Random(4)
    rows = [(k, [rng.uniform(-0.3, 0.3) for _ in range(64)]) for k in range(12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and all("REPARTITION_BY" in line for line in moved)
    same(spark, tmp_path, name, "embeddings")


def test_an_image_of_repeated_vectors(spark, tmp_path):
    """Ids that come twice: the larger value of each pixel, as in the SQL."""
    rows = [(0, [0.1, -0.2] * 32), (0, [-0.1, 0.2] * 32), (1, [0.05] * 64), (3, [0.1] * 64), (4, [0.2] * 64), (5, [0.3] * 64), (6, [0.3] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    same(spark, tmp_path, "prj03_gamma", "embeddings")


def test_stretch_to_the_last_bit(spark, tmp_path):
    """Of 2,000 images some have a value that lies on a whole step but for the percentile's last bit."""
    rng = random.Random(6)
    rows = [(k, [rng.gauss(0, 0.125) for _ in range(64)]) for k in range(6000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    same(spark, tmp_path, "prj02_percentile_stretch", "embeddings")


def test_grey_values_that_differ_in_the_last_bit(spark, tmp_path):
    """Pixels of one brightness, but for the last bit, in other channels: those below the tenth percentile don't count."""
    rng = random.Random(7)
    grey = lambda t: 0.299 * t[0] + 0.587 * t[1] + 0.114 * t[2]
    met, pairs = {}, []
    while len(pairs) < 20:
        t = tuple(rng.randrange(256) for _ in range(3))
        other = met.setdefault(299 * t[0] + 587 * t[1] + 114 * t[2], t)
        if grey(other) != grey(t):
            pairs.append(sorted((other, t), key=grey))
    rows = []
    for k, (low, high) in enumerate(pairs):
        pixels = [low] * 6 + [high] * 58
        rows += [(3 * k + c, [((p[c] + 0.5) / 255 - 0.5) / 2 for p in pixels]) for c in range(3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    same(spark, tmp_path, "flt01_band_gains", "embeddings")


def test_pixels_of_one_cell_stay_where_they_are(spark, monkeypatch):
    """All images share the cells of a grid: no pixel is shuffled by its cell; with too many regions the rows are the same."""
    from rasterbrook.operators import masks

    df = spark.createDataFrame([(k, y, x, float(k + y * x)) for k in range(6) for y in range(8) for x in range(8)], "image_id long, y long, x long, v double")
    rois = spark.createDataFrame([("a b", 0, 0, 8, 8), ("c", 2, 2, 7, 7)], "name string, y0 long, x0 long, y1 long, x1 long")
    got = masks.roi_metrics(df, rois)
    assert "BroadcastHashJoin" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(FLOOR" not in plan
    told = lambda got: sorted((r.image_id, r.roi, round(r["mean"], 9), round(r.cv, 9), r.n) for r in got.collect())
    rows = told(got)
    monkeypatch.setattr(masks, "REGIONS", 1)
    assert rows == told(masks.roi_metrics(df, rois)) and len(rows) == 12


@pytest.mark.parametrize("grid", [2, 4])
def test_equalising_makes_no_row_per_level(spark, grid):
    """A tile's table comes of the levels that occur, the lowest and highest too; its values are those of a plain histogram's."""
    from rasterbrook.operators import neighbourhood

    rng, clip = random.Random(grid), 8.0
    px = {(k, y, x): rng.choice([0, 255, rng.randrange(256)]) if k else 7 for k in range(3) for y in range(8) for x in range(8)}
    df = spark.createDataFrame([(*at, float(v)) for at, v in px.items()], "image_id long, y long, x long, v double")
    got = neighbourhood.clahe(df, "v", grid, clip)
    assert "Window" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "posexplode" not in plan
    size = 8 // grid
    area = size * size
    limit = max(1, int(clip * area / 256))

    def table(k, ty, tx):
        n = [0] * 256
        for y in range(ty * size, ty * size + size):
            for x in range(tx * size, tx * size + size):
                n[px[k, y, x]] += 1
        excess = sum(max(c - limit, 0) for c in n) / 256.0
        return [(sum(min(c, limit) for c in n[: b + 1]) + excess * (b + 1)) * 255.0 / area for b in range(256)]

    tables = {(k, ty, tx): table(k, ty, tx) for k in range(3) for ty in range(grid) for tx in range(grid)}
    near = lambda i: min(max(i, 0), grid - 1)
    rows = got.collect()
    assert len(rows) == len(px)
    for r in rows:
        fy, fx = (r.y + 0.5) / size - 0.5, (r.x + 0.5) / size - 0.5
        want = 0.0
        for ty, a in ((fy // 1, 1 - fy % 1), (fy // 1 + 1, fy % 1)):
            for tx, b in ((fx // 1, 1 - fx % 1), (fx // 1 + 1, fx % 1)):
                want += a * b * tables[r.image_id, near(int(ty)), near(int(tx))][px[r.image_id, r.y, r.x]]
        assert r.v == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("name", ["jn01_stitch", "pipe01_tile_demo"])
def test_tiles_stay_with_their_image(spark, tmp_path, name, monkeypatch):
    """Four files' names are shared by all images: no pixel is shuffled by them; with too many files the rows are the same."""
    from rasterbrook.operators import mosaic

    rng = random.Random(9)
    rows = [(k, [rng.uniform(-0.3, 0.3) for _ in range(64)]) for k in range(12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and all("REPARTITION_BY" in line for line in moved) if name == "jn01_stitch" else not any("filename" in line for line in moved)
    same(spark, tmp_path, name, "embeddings")
    monkeypatch.setattr(mosaic, "FILES", 1)
    same(spark, tmp_path, name, "embeddings")


def test_sides_of_an_image_are_told_without_joins(spark):
    """Medians and limits of four rows an image are windows over them: only the image's size is joined to its pixels."""
    from rasterbrook.operators import reductions

    df = spark.createDataFrame([(k, y, x, 0.1 * k, 0.01 * y, 0.02 * x) for k in range(3) for y in range(8) for x in range(8)], "image_id long, y long, x long, r double, g double, b double")
    plan = reductions.side_fusion(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1


def test_equalising_tables_are_no_longer_than_their_tiles(spark):
    """An image's tables took 256 numbers a tile, whatever its size: 2 kB for each 8 x 8 pixels' quarter."""
    from rasterbrook.operators import neighbourhood

    df = spark.range(64).selectExpr("0L as image_id", "id div 8 as y", "id % 8 as x", "cast(id * 4 as double) as v")
    seen = []

    def kept(df, stats, key="image_id", settle=False):
        seen.append(stats)
        return join_back(df, stats, key, settle)

    join_back, neighbourhood.join_back = neighbourhood.join_back, kept
    try:
        neighbourhood.clahe(df, "v", 2, 8.0)
    finally:
        neighbourhood.join_back = join_back
    (row,) = seen[-1].collect()
    assert len(row._tables) == 4 and all(len(t["sums"]) == 16 for t in row._tables.values())
