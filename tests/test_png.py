"""PNG files in bands: against a reader of its own, over several tasks, with retries, clashes and failures."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterbrook.sources import files, png

SCHEMA = "image_id long, y long, x long, r double, g double, b double"


def decode(path):
    data, at, packed = open(path, "rb").read(), 8, b""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        assert zlib.crc32(kind + body) == struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]
        if kind == b"IHDR":
            w, h, depth, colour = struct.unpack(">IIBB", body[:10])
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    raw = zlib.decompress(packed)  # checks the sum of all bands
    n = 3 if colour == 2 else 1
    a = np.frombuffer(raw, np.uint8).reshape(h, 1 + w * n * depth // 8)
    assert not a[:, 0].any()
    return np.frombuffer(a[:, 1:].tobytes(), ">u2" if depth == 16 else "u1").reshape(h, w, n)


def pixels(spark, arrays):
    rows = [(i, y, x, *map(float, a[y, x])) for i, a in arrays.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("depth, channels, rounding, lines", [(8, "rgb", "even", 4), (16, "rgb", "even", 7), (8, "g", "down", 1), (16, "b", "even", 64)])
def test_files(spark, tmp_path, depth, channels, rounding, lines):
    rng = np.random.default_rng(depth)
    arrays = {i: rng.normal(0.5, 0.4, (h, w, 3)) for i, (h, w) in enumerate([(23, 9), (1, 1), (40, 3), (7, 50)])}
    png.write_png(pixels(spark, arrays), f"file://{tmp_path}/x", tuple(channels), depth, rounding, lines)
    assert sorted(os.listdir(tmp_path / "x")) == [f"{i}.png" for i in arrays]
    for i, a in arrays.items():
        v = np.clip(a[:, :, ["rgb".index(c) for c in channels]], 0, 1) * ((1 << depth) - 1)
        assert (decode(tmp_path / "x" / f"{i}.png") == (np.rint(v) if rounding == "even" else np.floor(np.round(v, 6)))).all()


def test_an_image_is_compressed_by_several_tasks(spark):
    df = png.bands(pixels(spark, {1: np.random.default_rng(1).random((60, 5, 3))}), lines=5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and df.count() == 12
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_odd_pixels(spark, tmp_path):
    rows = [(4, 0, 0, float("nan"), None, 2.0), (4, 2, 1, 1.0, -1.0, 0.5)]  # the rest is missing
    png.write_png(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/x", lines=1)
    got = decode(tmp_path / "x" / "4.png")
    assert got.shape == (3, 2, 3) and got[0, 0].tolist() == [0, 0, 255] and got[2, 1].tolist() == [255, 0, 128] and got[1].sum() == 0


def test_existing_files_and_failures(spark, tmp_path):
    folder = f"file://{tmp_path}/x"
    df = pixels(spark, {1: np.zeros((4, 4, 3)), 2: np.ones((4, 4, 3))})
    png.write_png(df, folder)
    with pytest.raises(Exception, match="FileExistsError"):
        png.write_png(pixels(spark, {2: np.zeros((4, 4, 3)), 3: np.zeros((4, 4, 3))}), folder)
    assert sorted(os.listdir(tmp_path / "x")) == ["1.png", "2.png"] and decode(tmp_path / "x" / "2.png").min() == 255
    png.write_png(pixels(spark, {2: np.zeros((4, 4, 3))}), folder, mode="overwrite")
    assert decode(tmp_path / "x" / "2.png").max() == 0
    broken = png.bands(pixels(spark, {8: np.zeros((9, 4, 3)), 9: np.zeros((9, 4, 3))}), lines=3).where("not (image_id = 9 and band = 1)")
    with pytest.raises(Exception, match="6 of 9 lines"):
        broken.repartition("image_id").sortWithinPartitions("image_id", "band").write.format(png.FORMAT).mode("append").save(folder)
    assert sorted(os.listdir(tmp_path / "x")) == ["1.png", "2.png"]


def test_no_images(spark, tmp_path):
    png.write_png(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/x")
    assert not os.path.exists(tmp_path / "x") or os.listdir(tmp_path / "x") == []


def test_check_sums():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (rng.bytes(int(rng.integers(0, 90_000))) for _ in range(2))
        assert png.check_of_both(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(lines, step, rng):
    """Each line by a filter of its own, as the format defines them, byte by byte."""
    out, above = b"", bytes(lines.shape[1])
    for line in lines:
        line, how = line.tobytes(), int(rng.integers(5))
        out += bytes([how])
        for k, v in enumerate(line):
            a, b, c = line[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
            paeth = min((a, b, c), key=lambda q: (abs(a + b - c - q), [a, b, c].index(q)))
            out += bytes([(v - [0, a, b, (a + b) // 2, paeth][how]) % 256])
        above = line
    return out


def test_png_files_of_all_kinds_are_read_as_the_image_source_does(spark, tmp_path):
    rng, (h, w) = np.random.default_rng(5), (13, 11)
    for name, depth, colour, woven in [("g8", 8, 0, 0), ("rgb8", 8, 2, 0), ("rgb8w", 8, 2, 1), ("ga8", 8, 4, 0), ("rgba8", 8, 6, 1), ("g1", 1, 0, 0), ("g2", 2, 0, 1), ("g4", 4, 0, 0), ("p8", 8, 3, 0), ("p4", 4, 3, 1)]:
        n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        a = rng.integers(0, 1 << depth, (h, w, n), dtype=np.uint8)
        raw = b""
        for y, x, dy, dx in png._WOVEN if woven else [(0, 0, 1, 1)]:
            part = a[y::dy, x::dx]
            bits = np.unpackbits(part.reshape(-1, 1), axis=1)[:, 8 - depth :].reshape(len(part), -1)
            raw += filtered(np.packbits(bits, axis=1), max(1, n * depth // 8), rng)
        colours = chunk(b"PLTE", rng.integers(0, 256, 3 << depth, dtype=np.uint8).tobytes()) if colour == 3 else b""
        data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, woven)) + colours + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
        for end in (".PnG", ".png_", "-Xng"):  # the last two go through Spark's image source
            (tmp_path / f"{name} {end}").write_bytes(data)
    both = files.read_images(spark, str(tmp_path))
    rows = {}
    for r in both.collect():
        name, end = os.path.basename(r.path).replace("%20", " ").split()
        rows.setdefault(name, {}).setdefault(end, {})[r.y, r.x] = (r.r, r.g, r.b)
    assert len(rows) == 10
    for name, ways in rows.items():
        assert len(ways[".PnG"]) == h * w and ways[".PnG"] == ways[".png_"] == ways["-Xng"], name
    by = {r.path: r.image_id for r in both.select("path", "image_id").distinct().collect()}
    assert len(by) == 30 and len(set(by.values())) == 30
    assert all("%20" in p for p in by)  # as Spark writes paths in both ways


def test_small_files_need_no_image_source(spark, tmp_path):
    png.write_png(pixels(spark, {i: np.full((2, 2, 3), i / 9) for i in range(9)}), f"file://{tmp_path}/x")
    df = files.read_images(spark, f"file://{tmp_path}/x")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan binaryFile" in plan or "BinaryFile" in plan
    assert df.count() == 36 and df.where("abs(r * 9 - regexp_extract(path, '([0-9])[.]png', 1)) < 0.02").count() == 36
