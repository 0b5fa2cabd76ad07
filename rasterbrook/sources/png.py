"""PNG files as a data source to write to: an image is compressed in bands by any number of tasks.

bands() turns pixels into compressed stretches of lines, each a piece of one deflate stream that ends on a
byte. The writer streams the bands of an image into its file, a chunk each, and puts the streams' check
sums together. Files appear under their names when all tasks have ended well; an aborted write leaves none.
decoded() reads PNG files of any kind.
"""

from __future__ import annotations

import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

if TYPE_CHECKING:
    import numpy as np

FORMAT = "raster_png"
SCHEMA = "image_id long, h long, w long, depth int, channels int, band long, lines long, data binary, check long, size long"
_BASE = 65521
#: Bytes of compressed bands, and of decoded lines, that travel in one batch; a longer one goes alone.
BATCH = 1 << 20


def check_of_both(a: int, b: int, size: int) -> int:
    """The Adler-32 of two stretches from the sums of each and the length of the second."""
    low = ((a & 0xFFFF) + (b & 0xFFFF) - 1) % _BASE
    high = ((a >> 16) + (b >> 16) + size * ((a & 0xFFFF) - 1)) % _BASE
    return high << 16 | low


def bands(df: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), depth: int = 8, rounding: str = "even", lines: int = 64) -> DataFrame:
    """Rows of SCHEMA: pixels 0..1 (image_id, y, x, channels) as compressed bands of so many lines.

    Values are clipped, null and not a number count as 0, then rounded half to even or cut off (rounding="down").
    A task holds one band at a time. Pixels that are missing are 0; of repeated ones the last counts.
    """
    size = df.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")).withColumnRenamed("image_id", "_k")
    px = df.select("image_id", "y", "x", *[F.col(c).cast("double").alias(c) for c in channels], F.floor(F.col("y") / lines).alias("band"))
    px = px.withColumn("real", F.lit(True))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("h") - 1) / lines)))  # so that no band is without a row
    some = size.select(F.col("_k").alias("image_id"), every.alias("band")).select(
        "image_id", (F.col("band") * lines).alias("y"), F.lit(0).cast("long").alias("x"), *[F.lit(0.0).alias(c) for c in channels], "band", F.lit(False).alias("real")
    )
    px = px.unionByName(some).join(size, F.col("image_id") == F.col("_k")).drop("_k")
    px = px.repartition("image_id", "band").sortWithinPartitions("image_id", "band", "y", "x", "real")
    top, kind = (1 << depth) - 1, ">u2" if depth == 16 else "u1"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        at, plane, rows, waiting = None, None, [], 0
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.binary()] + [pa.int64()] * 2
        names = [f.split()[0] for f in SCHEMA.split(", ")]

        def pack() -> int:
            image, band, h, w = at
            raw = b"".join(b"\0" + line.tobytes() for line in plane)
            packer = zlib.compressobj(wbits=-15) if len(raw) > 4096 else zlib.compressobj(wbits=-12, memLevel=5)  # tables are made anew for each band
            data = packer.compress(raw) + packer.flush(zlib.Z_FULL_FLUSH)
            rows.append((image, h, w, depth, len(channels), band, len(plane), data, zlib.adler32(raw), len(raw)))
            return len(data) + 100

        def made() -> pa.RecordBatch:
            cols = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            keys = [b.column(c).to_numpy() for c in ("image_id", "band", "h", "w")]
            ys, xs = (b.column(c).to_numpy() for c in ("y", "x"))
            values = np.stack([np.clip(np.nan_to_num(b.column(c).to_numpy(zero_copy_only=False).astype(float)), 0, 1) * top for c in channels], axis=1)
            values = (np.rint(values) if rounding == "even" else np.floor(np.round(values, 6))).astype(kind)
            new = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1
            starts = [0, *new.tolist()] if b.num_rows else []
            for start, end in zip(starts, [*starts[1:], b.num_rows], strict=True):
                head = tuple(int(k[start]) for k in keys)
                if head != at:
                    if at:
                        waiting += pack()
                        if waiting >= BATCH:
                            yield made()
                            waiting = 0
                    at = head
                    _, band, h, w = at
                    plane = np.zeros((min(lines, h - band * lines), w, len(channels)), kind)
                plane[ys[start:end] - at[1] * lines, xs[start:end]] = values[start:end]
        if at:
            pack()
            yield made()

    return px.mapInArrow(run, SCHEMA)


def decoded(data: bytes) -> np.ndarray:
    """The colours of a PNG file's content as levels (h, w, 1 or 3): 16-bit ones as they are, all others 8-bit. Alpha is left out."""
    import numpy as np

    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, palette = 8, [], None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, woven = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if not w or not h:
        raise ValueError("no pixels")
    raw, at, n = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8), 0, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    out = np.empty((h, w, n), ">u2" if depth == 16 else np.uint8)
    for y, x, dy, dx in _WOVEN if woven else ((0, 0, 1, 1),):
        part = out[y::dy, x::dx]
        if part.size:
            rows, cols = part.shape[:2]
            line = (cols * n * depth + 7) // 8
            got = _unfiltered(raw[at : at + rows * (line + 1)].reshape(rows, line + 1), max(n * depth // 8, 1))
            at += rows * (line + 1)
            if depth < 8:
                bits = np.unpackbits(got, axis=1).reshape(rows, -1, depth)
                got = np.packbits(bits, axis=2)[:, :cols, 0] >> (8 - depth)
            part[:] = np.ascontiguousarray(got).view(out.dtype).reshape(part.shape)
    if colour == 3:
        return palette[out[:, :, 0]]
    return (out * (255 // ((1 << depth) - 1)) if depth < 8 else out)[:, :, : 3 if n > 2 else 1]


#: First line and column and steps of the seven passes of an interlaced file.
_WOVEN = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Bytes of lines, whose first byte names their filter. Pixels of one diagonal need earlier ones only, so they are undone at once."""
    import numpy as np

    how, lines = lines[:, 0], lines[:, 1:]
    if not how.any():
        return lines
    if how.max() > 4:
        raise ValueError(f"filter {how.max()}")
    h, w = lines.shape[0], -(-lines.shape[1] // step)
    out = np.zeros((h + 1, w + 1, step), np.int16)  # a line above and a pixel to the left of all, 0
    flat = np.zeros((h, w * step), np.int16)
    flat[:, : lines.shape[1]] = lines
    flat = flat.reshape(h, w, step)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x, f = d - y, how[y, None]
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        near = [np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)]
        paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
        out[y + 1, x + 1] = (flat[y, x] + np.select([f == 1, f == 2, f == 3, f == 4], [left, up, (left + up) >> 1, paeth], 0)) & 255
    return out[1:, 1:].reshape(h, -1)[:, : lines.shape[1]].astype(np.uint8)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: their names while written, their names to be."""

    files: list[tuple[str, str]]


class PngWriter(DataSourceWriter):
    """Streams bands, in order within each image, into files of a folder in any store that Arrow knows by its address."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        self.run = uuid.uuid4().hex

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", self.folder))

    def write(self, rows: Iterator) -> Written:
        store, root = self._store()
        pending = posixpath.join(root, f"_pending-{self.run}")
        store.create_dir(pending)
        files, out, at, check, seen = [], None, None, 1, 0

        def close() -> None:
            if out is not None:
                if seen != at[1]:
                    raise ValueError(f"image {at[0]}: {seen} of {at[1]} lines")
                out.write(_chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", check)) + _chunk(b"IEND", b""))
                out.close()

        try:
            for r in rows:
                if at is None or at[0] != r.image_id:
                    close()
                    at, check, seen = (r.image_id, r.h), 1, 0
                    path = posixpath.join(pending, f"{r.image_id}-{uuid.uuid4().hex}")
                    files.append((path, posixpath.join(root, f"{r.image_id}.png")))
                    out = store.open_output_stream(path)
                    head = struct.pack(">IIBBBBB", r.w, r.h, r.depth, 2 if r.channels == 3 else 0, 0, 0, 0)
                    out.write(b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", b"\x78\x9c"))
                out.write(_chunk(b"IDAT", bytes(r.data)))
                check, seen = check_of_both(check, r.check, r.size), seen + r.lines
            close()
        except BaseException:
            for path, _ in files:  # this attempt's own; a retry has names of its own
                store.delete_file(path)
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = self._store()
        files = [f for m in messages if m for f in m.files]
        if not self.overwrite:
            there = [t for _, t in files if store.get_file_info(t).type != fs.FileType.NotFound]
            if there:
                self.abort(messages)
                raise FileExistsError(there[0])
        with ThreadPoolExecutor(16) as several:  # a store far away answers slowly
            list(several.map(lambda f: store.move(*f), files))
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._store())

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        pending = posixpath.join(root, f"_pending-{self.run}")
        if store.get_file_info(pending).type == fs.FileType.Directory:
            store.delete_dir(pending)


class PngSource(DataSource):
    """df.write.format("raster_png").mode("append").save(folder) for rows of bands(), each image's together and in order."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> PngWriter:
        if not self.options.get("path"):
            raise ValueError("a folder is needed: save(path)")
        return PngWriter(self.options["path"], overwrite)


def write_png(df: DataFrame, folder: str, channels: tuple[str, ...] = ("r", "g", "b"), depth: int = 8, rounding: str = "even", lines: int = 64, mode: str = "append") -> None:
    """Pixels 0..1 as folder/<image_id>.png. mode append: a file that is there is an error; overwrite: it is replaced."""
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(PngSource)
    made = bands(df, channels, depth, rounding, lines)
    # So many tasks in any case: bands are small and files take time, so joining partitions by their bytes would leave a task or two.
    made.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image_id").sortWithinPartitions("image_id", "band").write.format(FORMAT).mode(mode).save(folder)
