"""WARC archives: writing with identical-payload revisits, reading back, and a merged capture index."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, pieces, scratch_dir, written

RECORDS = (
    "page_id long, url string, url_key string, captured string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, file string, offset long, length long"
)
_START = datetime(2024, 1, 1)


def url_key(url: str | None) -> str:
    """Sort-friendly key: reversed host, then port, path and query, lower-cased as usual for capture indexes."""
    m = re.match(r"(?s).*?://([^/?#:]*)(:\d+)?([^#]*)", url or "")
    if not m:
        return (url or "").lower()
    host = m[1].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + (m[2] or "") + ")" + (m[3] or "/").lower()


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header(*lines: tuple[str, object]) -> bytes:
    said = (str(v).replace("\r", "%0D").replace("\n", "%0A") for _, v in lines)
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for (k, _), v in zip(lines, said, strict=True)) + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    """One record, without the line break that ends its last empty line."""
    day = (_START + timedelta(seconds=(page_id or 0) % 31_536_000)).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = b"" if revisit else payload
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"),
        ("WARC-Page", "" if page_id is None else page_id),
        ("WARC-Date", day),
        ("WARC-Target-URI", "" if url is None else url),
        ("WARC-Has-Target", int(url is not None)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", len(payload)),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page", refers)] if revisit else []),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", len(body)),
    ]
    return _header(*lines) + body + b"\r\n"


def _archives(file_bytes: int):
    """Records joined to archive files: a row ends with the record that makes it file_bytes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for b in pieces(batches, "html"):
            for r in b.to_pylist():
                payload = (r["html"] or "").encode()
                digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                out.append(record(r["page_id"], r["url"], payload, digest, r["first"], r["first"] is not None))
                size += len(out[-1]) + 2
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\r\n".join(out)], pa.binary())], ["value"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"\r\n".join(out)], pa.binary())], ["value"])

    return run


def write_warc(pages: DataFrame, path: str, min_payload: int = 0, file_bytes: int = 16 << 20) -> None:
    """Writes a record per row of pages (page_id, url, html) to archive files below path.

    Of the records with one payload of min_payload bytes or more, the smallest page_id's is the
    response and the others are revisits of it (digests with one record need no look-up); smaller payloads are all responses. Null html is an
    empty payload. Rows that repeat the smallest page_id are responses too; a null page_id is a
    revisit where a row with an id has the payload, else a response. Before compression a file holds
    file_bytes and at most one record more, however long the pages are.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload.cast("binary")).alias("digest"))
    size = F.octet_length(payload)
    first = rows.where(size >= min_payload).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    first = written(first.where("n > 1").select(F.col("digest").alias("d"), "least"), "warc-first")
    both = rows.join(bounded(first), (F.col("digest") == F.col("d")) & (size >= min_payload), "left")
    both = both.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")))
    made = both.select("page_id", "url", "html", "digest", "first").mapInArrow(_archives(file_bytes), "value binary")
    # The text writer puts bytes out as they are, on any file system that Spark knows; a row is a file.
    made.select(F.col("value").cast("string").alias("value")).write.options(lineSep="\r\n", compression="gzip", maxRecordsPerFile=1).text(path)
    discard(first)


def parse(data: bytes, file: str) -> Iterator[tuple]:
    """The records of one archive file; responses are checked against their digest."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"{file}: no record at byte {at}")
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        n = int(head["Content-Length"])
        payload, digest = data[end + 4 : end + 4 + n], head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and sha1_base32(payload) != digest:
            raise ValueError(f"{file}: payload at byte {at} doesn't match its digest")
        number = lambda x: int(x) if x else None
        url = head["WARC-Target-URI"] if head["WARC-Has-Target"] == "1" else None
        yield (
            number(head["WARC-Page"]), url, url_key(url), head["WARC-Date"], int(head["WARC-Payload-Length"]), digest,
            head["WARC-Type"], number(head.get("WARC-Refers-To-Page")), file, at, end + 8 + n - at,
        )
        at = end + 8 + n


def _arrow(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


_NAMES = [x.split()[0] for x in RECORDS.split(", ")]
_KINDS = [pa.int64() if x.endswith(" long") else pa.string() for x in RECORDS.split(", ")]
_ORDER = (2, 3, 0, 8, 9)  # url_key, captured, page_id, file, offset


def _key(row: tuple) -> tuple:
    return tuple((x is not None, x) for x in (row[i] for i in _ORDER))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each archive file gives a run: its captures, sorted."""
    for b in batches:
        for path, content in zip(b.column("path"), b.column("content"), strict=True):
            run = sorted(parse(gzip.decompress(content.as_py()), path.as_py().rsplit("/", 1)[-1]), key=_key)
            for k in range(0, len(run), 5000):
                yield _arrow(run[k : k + 5000], _NAMES, _KINDS)


class LoserTree:
    """Merges k sorted runs: inner nodes keep the loser of their match, so a new entry costs log2(k) matches."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [self._next(i) for i in range(len(runs))] or [None]
        self.losers = [-1] * self.k
        self.best = self._build(1)

    def _next(self, i: int) -> tuple | None:
        row = next(self.runs[i], None)
        return None if row is None else (_key(row), i, row)

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won, lost = (a, b) if self._wins(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[self.best] is not None:
            best = self.best
            yield self.heads[best][2]
            self.heads[best] = self._next(best)
            node = (best + self.k) // 2
            while node >= 1:
                if self._wins(self.losers[node], best):
                    self.losers[node], best = best, self.losers[node]
                node //= 2
            self.best = best


def _captures(stretches: list[pa.RecordBatch]) -> Iterator[tuple]:
    """A run's captures, a few hundred at a time out of their compact columns."""
    for b in stretches:
        for i in range(0, b.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in b.slice(i, 256).columns), strict=True)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs' parts within one key range, one after the other, become one sorted sequence.

    The shuffle delivers each run's captures of the range as a contiguous sorted stretch (ordered by
    file). Their columns are held as they came; the tree takes captures out of each a few at a time.
    The number of ranges follows the number of captures, so a range is bounded at any size.
    """
    runs: dict[str, list[pa.RecordBatch]] = {}
    for b in batches:
        files = b.column("file").to_pylist()
        cuts = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1]), len(files)]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                runs.setdefault(files[a], []).append(b.slice(a, z - a))
    out = []
    for row in LoserTree([_captures(x) for x in runs.values()]):
        out.append(row)
        if len(out) == 5000:
            yield _arrow(out, _NAMES, _KINDS)
            out = []
    yield _arrow(out, _NAMES, _KINDS)


def capture_index(path: str, spark, name: str = "warc-runs", range_rows: int = 100_000) -> DataFrame:
    """One row per record of the archives below path, in global order of url_key and time.

    Each file becomes a locally sorted run in the shared folder; key ranges of all runs, of about
    range_rows captures each, are then merged side by side. Ranges are cut on (url_key, captured,
    page_id, file, offset), so many captures of one url don't land in one range.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "content")
    runs = written(files.mapInArrow(_runs, RECORDS), name)
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_rows))
    ranged = runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "file", "offset")
    ranged = ranged.sortWithinPartitions("file", "url_key", "captured", "page_id", "offset")
    return ranged.mapInArrow(_merge, RECORDS)


def archive(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and reads the merged capture index back."""
    path = f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, min_payload)
    return capture_index(path, pages.sparkSession)
