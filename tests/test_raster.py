"""Raster operators: metamorphic checks, degenerate cases, sources and sinks, and the SQL of every query on a small table."""

import json
import os
import zlib

import pytest
from pyspark.sql import functions as F

from rasterbrook.functions import color, text, tone
from rasterbrook.operators import masks, mosaic, neighbourhood, ranking, reductions, stats
from rasterbrook.plans import registry
from rasterbrook.sources import files

DATA = "/root/testdata/sf0.001"
RGB = "image_id long, y long, x long, r double, g double, b double"


def image(f, h=10, w=15):
    return [(1, y, x, *map(float, f(y, x))) for y in range(h) for x in range(w)]


def test_constant_image_is_left_alone_by_the_stretch(spark):
    df = spark.createDataFrame(image(lambda y, x: (50, 100, 200)), RGB)
    got = stats.percentile_stretch(df, 1, 99).select("r", "g", "b").distinct().collect()
    assert [tuple(r) for r in got] == [(50.0, 100.0, 200.0)]


def test_shadow_lift_never_lowers_the_mean(spark):
    df = spark.createDataFrame(image(lambda y, x: (y * 20, x * 17, 250)), RGB)
    a, b = df.agg(F.avg("b")).first()[0], df.agg(F.avg(tone.lift_shadows(F.col("b"), 20))).first()[0]
    assert b >= a


def test_density_demask_inverts(spark):
    df = spark.createDataFrame(image(lambda y, x: (10 + 10 * x,) * 3), RGB)
    got = {r.x: r.r for r in stats.density_demask(df).where("y = 0").collect()}
    assert got[0] > got[7] > got[14]


def test_lab_round_trip(spark):
    df = spark.createDataFrame(image(lambda y, x: (x / 15, y / 10, 0.4)), RGB)
    lab = color.lab(F.col("r"), F.col("g"), F.col("b"))
    back = color.from_lab(*lab)
    worst = df.select(F.max(F.greatest(*[F.abs(a - F.col(c)) for a, c in zip(back, "rgb")]))).first()[0]
    assert worst < 1e-5


def test_constant_plane_stitches_back(spark):
    tiles = [(1, n, y, x, 7.0) for n in "abcd" for y in range(5) for x in range(5)]
    manifest = spark.createDataFrame([("a", 0, 0, 0, 0, 5, 5), ("b", 0, 1, 0, 3, 5, 5), ("c", 1, 0, 3, 0, 5, 5), ("d", 1, 1, 3, 3, 5, 5)], "filename string, row int, col int, top int, left int, width int, height int")
    t = spark.createDataFrame(tiles, "image_id long, filename string, y long, x long, v double")
    got = mosaic.stitch(manifest, t, 2).collect()
    assert len(got) == 64 and all(abs(r.v - 7) < 1e-9 for r in got)
    with pytest.raises(FileNotFoundError):
        mosaic.stitch(manifest, t.where("filename <> 'c'"), 2)


def test_blur_keeps_a_constant_and_unsharp_is_neutral(spark):
    df = spark.createDataFrame([(1, y, x, 3.0) for y in range(6) for x in range(4)], "image_id long, y long, x long, v double")
    assert all(abs(r.v - 3) < 1e-9 for r in neighbourhood.unsharp(df, "v", 0.5, 1.0).collect())


def test_single_pixel_image(spark):
    df = spark.createDataFrame([(1, 0, 0, 3.0)], "image_id long, y long, x long, v double")
    assert neighbourhood.laplacian(df, "v").first().laplacian == 0
    assert neighbourhood.median3(df, "v").first().median == 3
    assert neighbourhood.local_variance(df, "v", 3).first().variance == pytest.approx(0, abs=1e-12)


def test_empty_mask_uses_all_pixels(spark):
    df = spark.createDataFrame(image(lambda y, x: (40, 40, 40)), RGB)
    assert tuple(masks.band_gains(df).first())[1:] == (1.0, 1.0, 1.0)


@pytest.mark.parametrize("enough,want", [(20, 30), (31, 150)])
def test_relaxing_filters(spark, enough, want):
    df = spark.createDataFrame(image(lambda y, x: (y, x, 0)), RGB)
    assert reductions.relaxed(df, [F.col("r") < 2], [enough]).count() == want


def test_ties_keep_the_earliest_run(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.8), (1, 3, 0.8), (2, 1, None)], "job_id long, iteration long, score double")
    assert [tuple(r) for r in ranking.best_run(df).orderBy("job_id").collect()] == [(1, 2, 0.8), (2, 1, None)]


def test_refine_exits_early(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.95), (2, 1, 0.5), (2, 2, 0.85), (2, 3, 0.99), (3, 1, 0.4), (3, 2, 0.4), (3, 3, 0.4), (3, 4, 0.9)], "job_id long, iteration long, score double")
    got = {r.job_id: (r.iteration, r.tries, r.passed) for r in ranking.refine(df).collect()}
    assert got == {1: (1, 1, True), 2: (2, 2, True), 3: (1, 3, False)}


def test_job_states(spark):
    df = spark.createDataFrame([(1, i, e) for i, e in enumerate(["start", "start", "done", "start", "fail", "start", "reset"])] + [(2, 0, "done")], "job_id long, n int, event string")
    assert {r.job_id: r.state for r in ranking.fold_state(df, "job_id", "n", "event").collect()} == {1: "ready", 2: "ready"}


def test_json_params_defaults_and_ranges(spark):
    df = spark.createDataFrame([('{"gamma": 9, "black_point": "x"}',), (None,), ("junk",)], "j string")
    got = df.select(*[c.alias(n) for n, c in text.params(F.col("j"), ("gamma", "black_point")).items()]).collect()
    assert [tuple(r) for r in got] == [(2.2, 0.8), (1.0, 0.8), (1.0, 0.8)]
    assert df.select(text.json_in_text(F.lit("say {a} and {b}. no"))).first()[0] == "{a} and {b}"


def test_manifest_and_metadata(spark, tmp_path):
    p = tmp_path / "manifest.csv"
    head = "index,row,col,filename,left,top,right,bottom,width,height,stride_x,stride_y,overlap_x_px,overlap_y_px,overlap_x_ratio,overlap_y_ratio"
    p.write_text(head + "\n1,0,1,b.png,5,0,9,4,4,4,5,5,64.7,66,.2,.2\n0,0,0,a.png,0,0,4,4,4,4,5,5,,60,.2,.2\n")
    got = files.read_manifest(spark, str(p)).collect()
    assert [(r.filename, r.overlap_x_px, r.overlap_y_px) for r in got] == [("a.png", 64, 66), ("b.png", 64, 66)]
    (tmp_path / "none.csv").write_text(head + "\n")
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(tmp_path / "none.csv"))
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"overlap": {"x_px": 64, "y_px": None}}, indent=1))
    assert tuple(files.read_metadata_overlap(spark, str(m)).first()) == (None, None)


def test_png_round_trip_and_listing(spark, tmp_path):
    df = spark.createDataFrame([(1, y, x, x / 4, y / 3, 1.0) for y in range(4) for x in range(5)], RGB)
    row = files.encode_png(df).first()
    (tmp_path / "scan.png").write_bytes(row.png)
    (tmp_path / "flat.dng").write_bytes(b"raw")
    (tmp_path / "old_flat_2.dng").write_bytes(b"raw")
    back = files.read_images(spark, str(tmp_path / "scan.png")).orderBy("y", "x").collect()
    assert len(back) == 20 and all(abs(r.r - r.x / 4) < 0.003 and abs(r.g - r.y / 3) < 0.003 and r.b == 1 for r in back)
    listing = files.list_captures(spark, str(tmp_path))
    assert [(r.name, r.kind) for r in listing.collect()] == [("flat.dng", "raw"), ("old_flat_2.dng", "raw"), ("scan.png", "standard")]
    assert files.pick_flat(listing).first().name == "flat.dng"
    wide = files.encode_png(df, depth=16).first().png
    assert wide[24] == 16 and zlib.decompress(wide[41 : 41 + int.from_bytes(wide[33:37], "big")])[7:9] == (round(1 / 4 * 65535)).to_bytes(2, "big")


def test_decoder_errors_are_rows(spark, tmp_path):
    (tmp_path / "a.dng").write_bytes(b"12")
    (tmp_path / "b.dng").write_bytes(b"x")

    def decode(data):
        yield {"v": [float(data[1]), 7.0]}

    raw = spark.read.format("binaryFile").load(str(tmp_path))
    got = [(os.path.basename(r.path), r.v, r.error) for r in files.decode_with(raw, decode, "v double").orderBy("path", "v").collect()]
    assert got[:2] == [("a.dng", 7.0, None), ("a.dng", 50.0, None)] and got[2][0] == "b.dng" and got[2][2].startswith("IndexError") and len(got) == 3


def test_a_broken_image_is_an_error(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="not an image"):
        files.read_images(spark, str(tmp_path)).collect()


def test_tiles_arrive_one_by_one(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.png").write_bytes(bytes([i] * 4))
    sizes = []
    q = files.tile_stream(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda b, _: sizes.append(b.count())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sizes == [1, 1, 1]


def test_stage_arrays(spark, tmp_path):
    df = spark.createDataFrame(image(lambda y, x: (y, x, 5), 3, 4), RGB)
    files.write_stage_arrays(df, str(tmp_path / "out"), "inverted")
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("y").collect()
    assert [(r.stage, r.y, r.width, r["values"]) for r in rows] == [("inverted", y, 4, [float(y)] * 4 + [0.0, 1.0, 2.0, 3.0] + [5.0] * 4) for y in range(3)]


def test_whole_negative_takes_the_mask_off(spark):
    from rasterbrook.operators import develop

    def scan(y, x):  # a positive of two colours, as a masked negative
        pos = (90, 60, 40) if x < 8 else (140, 170, 200)
        return [min(255, 255 - v + m) for v, m in zip(pos, (90, 35, 0), strict=True)]

    df = spark.createDataFrame(image(scan, 16, 16), RGB)
    cast = lambda d: abs(d.agg(F.avg("b") - F.avg("r")).first()[0])
    got = develop.negative(df)
    assert got.count() == 256 and cast(got) < cast(df.withColumns({c: 255 - F.col(c) for c in "rgb"}))
    with pytest.raises(ValueError):
        develop.negative(df, {"gama": 1.0})
    lifted = develop.positive(df, {"shadow_lift": 20.0}).agg(F.avg("r")).first()[0]
    assert lifted >= develop.positive(df).agg(F.avg("r")).first()[0]


def test_regions_of_a_mask(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    on = rng.random((20, 30)) < 0.4
    df = spark.createDataFrame([(1, y, x, bool(on[y, x])) for y in range(20) for x in range(30)], "image_id long, y long, x long, m boolean")
    got = {(r.y, r.x): r.region for r in neighbourhood.regions(df, "m").collect()}
    want = {}
    for y, x in zip(*np.nonzero(on)):
        todo = [(y, x)]
        while todo:
            p = todo.pop()
            if p not in want:
                want[p] = (y, x)
                todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= p[0] + a < 20 and 0 <= p[1] + b < 30 and on[p[0] + a, p[1] + b]]
    assert set(got) == set(want) and len({(got[p], want[p]) for p in want}) == len(set(got.values())) == len(set(want.values()))


@pytest.mark.parametrize("pattern", neighbourhood.PATTERNS)
def test_mosaic_of_a_constant_colour(spark, pattern):
    value = {"R": 0.2, "G": 0.5, "B": 0.9}
    df = spark.createDataFrame([(1, y, x, value[pattern[y % 2 * 2 + x % 2]]) for y in range(6) for x in range(5)], "image_id long, y long, x long, v double")
    for edge_aware in (False, True):
        got = neighbourhood.demosaic(df, "v", pattern, edge_aware).collect()
        assert len(got) == 30 and all((round(r.r, 9), round(r.g, 9), round(r.b, 9)) == (0.2, 0.5, 0.9) for r in got)
    with pytest.raises(ValueError):
        neighbourhood.demosaic(df, "v", "RGBG")


def brute_edges(v, low=30, high=100):
    import numpy as np

    h, w = v.shape
    mirror = lambda i, n: (i % (2 * n - 2)) if (i % (2 * n - 2)) < n else 2 * n - 2 - i % (2 * n - 2)
    k = np.exp(-np.arange(-2, 3) ** 2 / (2 * 1.5**2))
    k /= k.sum()
    g = np.floor(np.clip(v, 0, 1) * 255)
    g = np.array([[sum(k[d + 2] * g[y, mirror(x + d, w)] for d in range(-2, 3)) for x in range(w)] for y in range(h)])
    g = np.array([[sum(k[d + 2] * g[mirror(y + d, h), x] for d in range(-2, 3)) for x in range(w)] for y in range(h)])
    g = np.pad(np.floor(np.round(g + 0.5, 6)), 1, mode="edge")
    at = lambda dy, dx: g[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    gx = sum(f * (at(dy, 1) - at(dy, -1)) for dy, f in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(f * (at(1, dx) - at(-1, dx)) for dx, f in ((-1, 1), (0, 2), (1, 1)))
    m = np.pad(abs(gx) + abs(gy), 1)
    weak, strong = set(), set()
    for y in range(h):
        for x in range(w):
            c, n = m[y + 1, x + 1], lambda dy, dx: m[y + 1 + dy, x + 1 + dx]
            if abs(gy[y, x]) < np.tan(np.pi / 8) * abs(gx[y, x]):
                top = c > n(0, -1) and c >= n(0, 1)
            elif abs(gy[y, x]) > np.tan(3 * np.pi / 8) * abs(gx[y, x]):
                top = c > n(-1, 0) and c >= n(1, 0)
            else:
                s = 1 if gx[y, x] * gy[y, x] >= 0 else -1
                top = c > n(-1, -s) and c > n(1, s)
            if top and c > low:
                weak.add((y, x))
            if top and c > high:
                strong.add((y, x))
    out, todo = set(), list(strong)
    while todo:
        p = todo.pop()
        if p in weak and p not in out:
            out.add(p)
            todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_edges_and_their_border(spark, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    v = np.full((30, 40), 0.9)
    v[6:24, 8:30] = 0.3
    v[10:15, 12:20] = 0.8
    v = np.clip(v + rng.normal(0, 0.02 * seed, v.shape), 0, 1)
    df = spark.createDataFrame([(1, y, x, float(v[y, x])) for y in range(30) for x in range(40)], "image_id long, y long, x long, v double")
    got = {(r.y, r.x) for r in masks.edges(df).where("edge").collect()}
    want = brute_edges(v)
    assert got == want and len(want) > 40
    rows = masks.edge_border(df).collect()
    thick = {(y, x) for a, b in want for y in range(a - 4, a + 5) for x in range(b - 4, b + 5)}
    box = {(r.y, r.x) for r in rows if not r.candidate}
    assert box <= {(y, x) for y in range(30) for x in range(40)} and {(r.y, r.x) for r in rows if r.candidate}.isdisjoint({p for p in thick if p in box})
    assert (5, 7) in box and (24, 30) in box and (0, 0) not in box and all(0.1 <= r.confidence <= 0.9 for r in rows)
    flat = masks.edge_border(df.withColumn("v", F.lit(0.5))).collect()
    assert {(r.y, r.x) for r in flat if r.candidate} == {(y, x) for y in range(30) for x in range(40) if y < 1 or y > 28 or x < 2 or x > 37}


def test_chains_read_their_input_a_few_times(spark):
    df = spark.createDataFrame(image(lambda y, x: (y, x, x * y)), RGB)
    plan = masks.stable_base(df, 12)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1


def test_debounce_of_a_busy_key(spark):
    import random

    rng = random.Random(2)
    t, rows = 0, []
    for _ in range(3000):
        t += rng.choice([1, 5, 40, 400, 700, 50_000, 9_000_000])
        rows.append((rng.choice([1, 1, 1, 2, None]), t))
    df = spark.createDataFrame(rows, "k long, ms long").select("k", F.timestamp_millis("ms").alias("ts"))
    want, last = [], {}
    for k, ms in rows:
        if k not in last or ms - last[k] > 500:
            last[k] = ms
            want.append((k, ms))
    got = ranking.debounce(df, "k", "ts", 500).select("k", F.unix_millis(F.col("ts").cast("timestamp"))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)

def test_layouts(spark):
    df = spark.createDataFrame([('[{"name": "n", "bbox": [1, 2, 3, 4]}, {"odd": 1}]',), ('{"a": {"bbox": [0, 1, 2, 3]}, "b": [5, 9], "c": "?", "y": [0, 4]}',), ("junk",)], "json string")
    got = {r.name: (r.x0, r.y0, r.x1, r.y1) for r in files.layout(spark, df).collect()}
    assert got["n"] == (1, 2, 3, 4) and got["a"] == (0, 1, 2, 3) and got["b"] == (5, 0, 9, 4) and got["c"] == (None,) * 4


def test_env_lines(spark):
    df = spark.createDataFrame([("# x",), ("A = 'b c'",), ("K=v=w",), ("",)], "value string")
    assert {r.key: r.value for r in files.env_lines(df).collect()} == {"A": "b c", "K": "v=w"}
    assert files.setting({"A": "", "B": "2"}, "A", "B") == "2"


def test_streaming_debounce_matches_the_fold(spark, tmp_path):
    from rasterbrook.streaming import jobs

    rows = [(u, f"2024-01-01 00:00:{s:02d}.{m:03d}") for u, s, m in [(1, 0, 0), (1, 0, 400), (1, 0, 600), (1, 1, 50), (2, 0, 0), (1, 1, 200)]]
    df = spark.createDataFrame(rows, "k long, t string").select("k", F.col("t").cast("timestamp").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = jobs.accepted_edges(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", 500).writeStream.format("memory").queryName("edges").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    batch = ranking.debounce(df, "k", "ts", 500).select("k", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    assert sorted(map(tuple, spark.sql("select k, ms from edges").collect())) == sorted(map(tuple, batch.collect()))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return "None" if v != v else f"{float(v):.10g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    a = sorted(tuple(map(norm, r)) for r in got.select(*cols).collect())
    if name not in registry.ORACLE_SQL:
        assert a
        return
    con = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == cols
    b = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in con.fetchall())
    assert a == b
