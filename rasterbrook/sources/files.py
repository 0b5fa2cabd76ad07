"""Readers: manifests, metadata, images, directories of captures, region layouts, settings."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import suffix
from .png import BATCH, decoded

MANIFEST = (
    "index int, row int, col int, filename string, left int, top int, right int, bottom int, width int, height int, "
    "stride_x int, stride_y int, overlap_x_px string, overlap_y_px string, overlap_x_ratio double, overlap_y_ratio double"
)
METADATA = (
    "source_image string, source_size struct<width:int,height:int>, grid struct<rows:int,cols:int,count:int>, "
    "tile_size struct<width:int,height:int>, stride struct<x:int,y:int>, overlap struct<x_px:int,y_px:int,x_ratio:double,y_ratio:double>, ordering string"
)
#: Suffixes of standard images and of camera files.
STANDARD = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".webp")
RAW = (".dng", ".nef", ".cr2", ".arw")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tiles in reading order with the overlap (the last row's that has one). No rows: an error."""
    rows = spark.read.schema(MANIFEST).option("header", True).option("enforceSchema", False).csv(path)
    if rows.isEmpty():
        raise ValueError(f"{path}: no tiles")
    whole = lambda c: F.col(c).try_cast("double").cast("int")
    last = rows.agg(*[F.max_by(whole(c), F.when(whole(c).isNotNull(), F.col("index"))).alias(c) for c in ("overlap_x_px", "overlap_y_px")])
    kept = rows.select("row", "col", "filename", "left", "top", "right", "bottom")
    return kept.join(F.broadcast(last), F.lit(True)).orderBy("row", "col")


def read_metadata_overlap(spark: SparkSession, path: str) -> DataFrame:
    """One row (x_px, y_px); both null unless both are there."""
    o = spark.read.schema(METADATA).option("multiLine", True).json(path).select("overlap.x_px", "overlap.y_px")
    both = F.col("x_px").isNotNull() & F.col("y_px").isNotNull()
    return o.select(*[F.when(both, F.col(c)).alias(c) for c in ("x_px", "y_px")])


#: Bytes of files that one task decodes, where they come to more tasks than a shuffle has.
PART = 128 << 20
#: File names that end on .png in any case, and all others.
PNG = "*.[pP][nN][gG]"
NOT_PNG = "{[gG],[nN][gG],[pP][nN][gG],*[^gG],*[^nN][gG],*[^pP][nN][gG],*[^.][pP][nN][gG]}"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (image_id, path, y, x, r, g, b), 0..1, of JPEG and PNG files.

    Files named .png are decoded here, as Spark's image source builds an encoder for each file, which takes longer than a
    small file's decoding; all others are that source's. A file that can't be decoded is an error. Whole lines travel in
    batches of some size, so no image is held as rows.
    """
    kinds = "image_id long, path string, y long, x long, r double, g double, b double"

    def lines(decode: Callable[..., tuple]) -> Callable[[Iterator], Iterator]:
        def pixels(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            wait, held = [], 0

            def made() -> pa.RecordBatch:
                n = [len(r) for _, _, _, _, r in wait]
                values = np.concatenate([r for *_, r in wait])
                cols = [np.repeat([i for i, *_ in wait], n), pa.array([o for _, o, *_ in wait]).take(pa.array(np.repeat(np.arange(len(wait)), n)))]
                cols += [np.concatenate([c[k] for c in wait]) for k in (2, 3)] + [np.ascontiguousarray(values[:, k]) for k in range(3)]
                wait.clear()
                return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["image_id", "path", "y", "x", "r", "g", "b"])

            for b in batches:
                for k in range(b.num_rows):  # an image at a time
                    i, o, *rest = (b.column(c)[k].as_py() for c in range(b.num_columns))
                    try:
                        a, top = decode(*rest)
                    except Exception as e:
                        raise ValueError(f"{o}: not an image") from e
                    h, w = a.shape[:2]
                    some = max(1, BATCH // 64 // w)
                    for y in range(0, h, some):  # some lines at a time
                        part = a[y : y + some]
                        n = len(part)
                        wait.append((i, o, np.repeat(np.arange(y, y + n), w), np.tile(np.arange(w), n), np.broadcast_to(part / top, (n, w, 3)).reshape(-1, 3)))
                        held += n * w
                        if held >= BATCH // 64:
                            yield made()
                            held = 0
            if wait:
                yield made()

        return pixels

    def raw(h: int, w: int, n: int, data: bytes) -> tuple:
        import numpy as np

        if h <= 0 or w <= 0:
            raise ValueError("no size")
        a = np.frombuffer(data, np.uint8).reshape(h, w, n)
        return (a if n == 1 else a[:, :, 2::-1]), 255.0

    def own(data: bytes) -> tuple:
        a = decoded(data)
        return a, 65535.0 if a.dtype.itemsize == 2 else 255.0

    others = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", NOT_PNG).load(path).select("image.*")
    others = others.select(F.xxhash64("origin").alias("image_id"), "origin", "height", "width", "nChannels", "data").mapInArrow(lines(raw), kinds)
    own_files = spark.read.format("binaryFile").option("pathGlobFilter", PNG).load(path)
    # Spark deals out small files by their number, tens a task, of which a task in Python takes longer than their decoding.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(own_files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    own_files = own_files.select("*", "_metadata.file_path").coalesce(max(tasks, size // PART + 1))
    origin = F.col("file_path")  # encoded as the image source's
    return own_files.select(F.xxhash64(origin).alias("image_id"), origin.alias("origin"), "content").mapInArrow(lines(own), kinds).unionByName(others)


def kind_of(path: Column) -> Column:
    s = suffix(path)
    return F.when(s.isin(*RAW), "raw").when(s.isin(*STANDARD), "standard").otherwise("other")


def list_captures(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, kind, modificationTime, length) of a directory, by name; contents aren't read."""
    f = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    return f.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("kind", kind_of(F.col("path"))).orderBy("name")


def decode_with(files: DataFrame, decoder: Callable[[bytes], "object"], schema: str) -> DataFrame:
    """Camera files through a decoder of the caller's: binaryFile rows (path, content) to rows of schema and an error column.

    decoder(bytes) yields dicts of arrays (or single values) by column of the schema, a line of the
    image each, say; a file that it can't read to its end gives one more row, with the error.
    """
    out = T.StructType([T.StructField("path", T.StringType()), *T.StructType.fromDDL(schema).fields, T.StructField("error", T.StringType())])

    def run(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        names = [f.name for f in out.fields]
        for pdf in frames:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    for columns in decoder(content):
                        got = {c: np.atleast_1d(v) for c, v in columns.items()}
                        yield pd.DataFrame({"path": path, **got, "error": None}, columns=names)
                except Exception as e:  # the file's own row tells
                    yield pd.DataFrame([{"path": path, "error": f"{type(e).__name__}: {e}"}], columns=names)

    return files.select("path", "content").mapInPandas(run, out)


def layout(spark: SparkSession, text: DataFrame) -> DataFrame:
    """Regions (name, x0, y0, x1, y1, raw) of layout JSON in column json: lists of {name, bbox}, {name: {bbox}}, or
    {name: [x0, x1], "y": [y0, y1]}; other entries keep their JSON with null corners."""
    v = text.select(F.try_parse_json("json").alias("whole"))
    rows = v.lateralJoin(spark.tvf.variant_explode(F.col("whole").outer()))
    get = lambda p, t: F.try_variant_get("value", p, t)
    box = F.coalesce(get("$.bbox", "array<int>"), F.when(F.size(get("$", "array<int>")) == 4, get("$", "array<int>")))
    span, ys = get("$", "array<int>"), F.try_variant_get("whole", "$.y", "array<int>")
    pair = F.when((F.size(span) == 2) & (F.size(ys) == 2), F.array(span[0], ys[0], span[1], ys[1]))
    box = F.coalesce(F.when(F.size(box) == 4, box), pair)
    name = F.coalesce(get("$.name", "string"), F.col("key"), F.concat(F.lit("region_"), F.col("pos").cast("string")))
    return rows.where("key is null or key <> 'y'").select(
        name.alias("name"), *[F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], F.to_json("value").alias("raw")
    )


def pick_flat(files: DataFrame, hints: tuple[str, ...] = ("flat", "backlight")) -> DataFrame:
    """The calibration frame of a listing: an exact hint as name first, then the newest, then by name."""
    stem = F.lower(F.regexp_replace("name", r"\.[^.]*$", ""))
    hit = F.lit(False)
    for h in hints:
        hit = hit | stem.contains(h)
    return files.where(hit).orderBy((~stem.isin(*hints)).cast("int"), F.col("modificationTime").desc(), "name").limit(1)


def setting(env: Mapping[str, str], *keys: str, default: str = "") -> str:
    """The first of the keys that is set and not empty."""
    return next((env[k] for k in keys if env.get(k)), default)


def env_lines(text: DataFrame) -> DataFrame:
    """(key, value) of lines `key=value` in column value; comments are skipped, quotes stripped."""
    line = F.trim("value")
    rows = text.where((line != "") & ~line.startswith("#") & line.contains("="))
    return rows.select(F.trim(F.substring_index(line, "=", 1)).alias("key"), F.regexp_replace(F.trim(F.expr("substring(trim(value), instr(trim(value), '=') + 1)")), "^[\"']|[\"']$", "").alias("value"))


def png(h: int, w: int, depth: int, channels: int, lines: Iterator[bytes]) -> bytes:
    """A PNG of raw big-endian lines, grey or RGB, 8 or 16 bits."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, depth, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + x for x in lines))) + chunk(b"IEND", b"")


def encode_png(df: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), depth: int = 8, rounding: str = "even") -> DataFrame:
    """(image_id, png) of pixels 0..1; values are clipped, then rounded half to even or cut off. An image is one group."""

    def encode(pdf):
        import numpy as np
        import pandas as pd

        h, w, top = int(pdf.y.max()) + 1, int(pdf.x.max()) + 1, (1 << depth) - 1
        a = np.zeros((h, w, len(channels)))
        for i, c in enumerate(channels):
            a[pdf.y, pdf.x, i] = np.clip(np.nan_to_num(pdf[c].to_numpy(float)), 0, 1) * top
        a = (np.rint(a) if rounding == "even" else np.floor(a)).astype(">u2" if depth == 16 else np.uint8)
        return pd.DataFrame({"image_id": [pdf.image_id.iloc[0]], "png": [png(h, w, depth, len(channels), (x.tobytes() for x in a))]})

    return df.select("image_id", "y", "x", *channels).groupBy("image_id").applyInPandas(encode, "image_id long, png binary")


def tile_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A scan as it arrives: image files of a folder as a stream (path, modificationTime, content), so many a trigger."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def write_stage_arrays(df: DataFrame, path: str, stage: str, channels: tuple[str, ...] = ("r", "g", "b")) -> None:
    """A stage's intermediate rasters as arrays: below path/stage=<name>, a row per image line with the
    line's values channel by channel (image_id, y, width, channels, values); lines are gathered, never images."""
    line = F.array_sort(F.collect_list(F.struct("x", *channels)))
    rows = df.groupBy("image_id", "y").agg(line.alias("l")).select(
        "image_id", "y", F.size("l").alias("width"), F.array(*map(F.lit, channels)).alias("channels"),
        F.flatten(F.array(*[F.col(f"l.{c}") for c in channels])).alias("values"),
    )
    rows.write.mode("errorifexists").parquet(f"{path}/stage={stage}")


def write_report(df: DataFrame, path: str) -> None:
    """Nested reports as JSON lines."""
    df.write.mode("errorifexists").json(path)


def upload_status(requests: DataFrame) -> DataFrame:
    """HTTP status of each upload request (method, body): 405, 400 or 200."""
    status = F.when(F.upper("method") != "POST", 405).when(F.col("body").isNull() | (F.length("body") == 0), 400).otherwise(200)
    return requests.withColumn("status", status)
