"""A scan as it grows, as a streaming source: the tiles of a manifest in reading order, a few a batch."""

from __future__ import annotations

import csv
import io
import posixpath
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

FORMAT = "scan_tiles"
SCHEMA = "row int, col int, filename string, left int, top int, right int, bottom int, path string"
_PLACES = ("left", "top", "right", "bottom")


def _store(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", address))


class TileReader(SimpleDataSourceStreamReader):
    """Manifest rows beyond an offset, the last place that was read and the number of tiles up to it.

    A batch ends before the first tile whose file isn't there yet, so tiles come in (row, col) order whatever the
    order in which their files arrive. A tile that appears before the offset is an error: it would never be read.
    """

    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder.rstrip("/"), most

    def initialOffset(self) -> dict:
        return {"row": -1, "col": -1, "tiles": 0}

    def _listed(self) -> list[tuple]:
        from pyarrow import fs

        store, root = _store(self.folder)
        path = posixpath.join(root, "manifest.csv")
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return []
        with store.open_input_stream(path) as f:
            rows = csv.DictReader(io.StringIO(f.read().decode()))
            return sorted((int(r["row"]), int(r["col"]), r["filename"], *[int(r[c]) for c in _PLACES]) for r in rows if r["bottom"])

    def _after(self, start: dict) -> list[tuple]:
        rows = self._listed()
        at = (start["row"], start["col"])
        if sum(r[:2] <= at for r in rows) != start["tiles"]:
            raise ValueError(f"{self.folder}: the manifest has changed before {at}")
        return [r for r in rows if r[:2] > at]

    def _row(self, r: tuple) -> tuple:
        return (*r, f"{self.folder}/{r[2]}")

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        from pyarrow import fs

        store, root = _store(self.folder)
        out = []
        for r in self._after(start)[: self.most]:
            if store.get_file_info(posixpath.join(root, r[2])).type == fs.FileType.NotFound:
                break
            out.append(r)
        end = {"row": out[-1][0], "col": out[-1][1], "tiles": start["tiles"] + len(out)} if out else start
        return iter([self._row(r) for r in out]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same rows again, after a restart."""
        return iter([self._row(r) for r in self._after(start) if r[:2] <= (end["row"], end["col"])])


class TileSource(DataSource):
    """spark.readStream.format("scan_tiles").option("tilesPerBatch", n).load(folder)"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> TileReader:
        return TileReader(self.options["path"], int(self.options.get("tilesPerBatch", "1")))


def tiles(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    """The stream of tiles (SCHEMA) of a folder with manifest.csv; the offset makes each come once, restarts included."""
    spark.dataSource.register(TileSource)
    return spark.readStream.format(FORMAT).option("tilesPerBatch", per_batch).load(folder)


def with_content(df: DataFrame) -> DataFrame:
    """df with the bytes of the files in its column path, read by the tasks, a file at a time."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                store, path = _store(b.column("path")[i].as_py())
                with store.open_input_stream(path) as f:
                    content = f.read()
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary())], [*row.schema.names, "content"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.withColumn("path", F.col("path")).mapInArrow(run, kinds + ", content binary")
