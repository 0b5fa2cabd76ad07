"""Streams with state and with offsets: cancelled and failed scans, tiles in order and once, over restarts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from rasterbrook.sources import tiles
from rasterbrook.streaming import scan_jobs

EVENTS = "job_id long, ordinal long, event string, ts timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


def step(state, event):
    ready, (now, result) = ("ready", "none"), state
    if event == "reset":
        return ready
    if event == "start":
        return ("working", "none") if now == "ready" else state
    if now not in ("working", "cancelling"):
        return state
    if event == "cancel":
        return ("cancelling", "none")
    if event in ("failed", "upload_failed"):
        return ("error", "failed")
    if now == "cancelling" and event in ("tile", "uploaded"):
        return ("ready", "cancelled")
    return ("ready", "done") if event == "uploaded" else state


def scans(seed, n=600):
    rng = random.Random(seed)
    at = datetime.datetime(2024, 1, 1)
    kinds = ["start", "start", "tile", "tile", "tile", "cancel", "uploaded", "upload_failed", "reset", "failed", "other"]
    return [(rng.choice([1, 1, 1, 2, 3, 4]), i, rng.choice(kinds), at + datetime.timedelta(seconds=i)) for i in range(n)]


def brute(rows):
    state, tiles_, n = {}, {}, {}
    for job, _, event, _ in sorted(rows, key=lambda r: r[1]):
        before = state.get(job, ("ready", "none"))
        state[job] = step(before, event)
        n[job] = n.get(job, 0) + 1
        if event == "reset" or before[0] == "ready" and event == "start":
            tiles_[job] = 0
        elif event == "tile" and before[0] in ("working", "cancelling"):
            tiles_[job] = tiles_.get(job, 0) + 1
    return {j: (*state[j], tiles_.get(j, 0), n[j]) for j in state}


@pytest.mark.parametrize("seed", [1, 2])
def test_outcomes_of_a_batch(spark, seed):
    rows = scans(seed)
    got = scan_jobs.outcomes(spark.createDataFrame(rows, EVENTS), "job_id", "ordinal", "event").collect()
    assert {r.job_id: (r.state, r.result, r.n) for r in got} == {j: (s, r, n) for j, (s, r, _, n) in brute(rows).items()}


def run_stream(spark, tmp_path, batches, timeout):
    source = tmp_path / "in"
    seen = {}

    def keep(df, _):
        for r in df.collect():
            seen[r.job_id] = (r.state, r.result, r.tiles, r.n)

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        events = spark.readStream.schema(EVENTS).parquet(str(source))
        # A new query each time: state and offsets come from the checkpoint.
        q = scan_jobs.stream(events, timeout).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(90)
        assert not q.exception()
    return seen


def test_stream_over_restarts_ends_as_the_batch_does(rocks, tmp_path):
    rows = scans(3, 300)
    assert run_stream(rocks, tmp_path, [rows[:120], rows[120:200], rows[200:]], 10**9) == brute(rows)


def test_silent_scans_fail_by_their_timer(rocks, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    after = lambda s: at + datetime.timedelta(seconds=s)
    first = [(1, 0, "start", at), (2, 1, "start", at), (2, 2, "tile", after(1)), (2, 3, "uploaded", after(2)), (3, 4, "start", after(5))]
    later = [(3, 5, "tile", after(600)), (9, 6, "start", after(601))]
    got = run_stream(rocks, tmp_path, [first, later, [(9, 7, "tile", after(1000))]], 500_000)
    assert got[1] == ("error", "failed", 0, 1) and got[2] == ("ready", "done", 1, 3) and got[9] == ("working", "none", 1, 2)


def write_scan(folder, places, files):
    folder.mkdir(exist_ok=True)
    lines = [f"{r},{c},t{r}_{c}.bin,{c * 10},{r * 10},{c * 10 + 12},{r * 10 + 12}" for r, c in places]
    (folder / "manifest.csv").write_text("\n".join(["row,col,filename,left,top,right,bottom", *lines]) + "\n")
    for r, c in files:
        (folder / f"t{r}_{c}.bin").write_bytes(bytes([r, c]) * 3)


def test_tiles_in_order_and_once(spark, tmp_path):
    """Files arrive out of order, a batch fails after it was read, the query is started again and again."""
    folder, got, fail = tmp_path / "scan", {}, [2]
    places = [(r, c) for r in range(3) for c in range(3)]

    def sink(df, batch):
        rows = df.orderBy("row", "col").collect()
        if batch == fail[0]:
            fail[0] = -1
            raise RuntimeError("lost")
        got[batch] = [(r.row, r.col, bytes(r.content)) for r in rows]

    def go():
        q = tiles.with_content(tiles.tiles(spark, f"file://{folder}", 2)).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        except Exception as e:
            assert "lost" in str(e)
        q.stop()

    write_scan(folder, places[4::-1], [(0, 0), (0, 1), (1, 0)])  # (0, 2) is missing
    go()
    assert [p[:2] for b in sorted(got) for p in got[b]] == [(0, 0), (0, 1)]
    write_scan(folder, places[:6], places[:6])
    go()
    go()
    write_scan(folder, places, places)
    go()
    read = [p for b in sorted(got) for p in got[b]]
    assert [p[:2] for p in read] == places and all(c == bytes([r, k]) * 3 for r, k, c in read) and all(len(v) <= 2 for v in got.values()) and fail == [-1]


def test_a_late_tile_is_an_error(tmp_path):
    write_scan(tmp_path / "x", [(0, 1), (0, 2)], [(0, 1), (0, 2)])
    reader = tiles.TileReader(f"file://{tmp_path}/x", 5)
    rows, end = reader.read(reader.initialOffset())
    assert [r[:2] for r in rows] == [(0, 1), (0, 2)] and end == {"row": 0, "col": 2, "tiles": 2}
    assert [r[:2] for r in reader.readBetweenOffsets(reader.initialOffset(), {"row": 0, "col": 1, "tiles": 1})] == [(0, 1)]
    write_scan(tmp_path / "x", [(0, 0), (0, 1), (0, 2)], [(0, 0)])
    with pytest.raises(ValueError, match="has changed"):
        reader.read(end)
    assert list(tiles.TileReader(f"file://{tmp_path}/none", 5).read(reader.initialOffset())[0]) == []


def test_captures_are_processed_once_where_calibrated(spark, tmp_path):
    """A batch fails after its results were written and is run again; another takes too long."""
    from rasterbrook.streaming import captures

    source, folder = tmp_path / "captures", f"file://{tmp_path}/out"
    listing = [("s1", k) for k in captures.CALIBRATION] + [("s2", "flat"), ("s2", "flat"), ("s2", "base")]
    broken, seconds = [1], [60.0]

    def process(df):
        out = df.select("capture", (F.col("n") * 2).alias("twice"))
        if seconds[0] < 60:
            import time

            slow = F.udf(lambda n: time.sleep(30) or n, "long")
            out = out.withColumn("twice", slow("twice"))
        return out

    def calibration():
        return spark.createDataFrame(listing, "session string, kind string")

    def go(rows):
        if rows:
            spark.createDataFrame(rows, "capture long, session string, n long").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("capture long, session string, n long").parquet(str(source))
        real = captures.run_batch

        def run(df, i, *args):
            real(df, i, *args)
            if broken[0] == i:
                broken[0] = -1
                raise RuntimeError("lost")

        q = stream.writeStream.foreachBatch(lambda df, i: run(df, i, calibration(), process, folder, seconds[0])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            q.awaitTermination(90)
        except Exception as e:
            assert "lost" in str(e)

    go([(1, "s1", 10), (2, "s2", 20)])
    go([(3, "s1", 30), (4, None, 5)])  # lost after its rows were written
    go([])
    listing.append(("s2", "layout"))
    go([(5, "s2", 50)])
    seconds[0] = 2.0
    go([(6, "s1", 60), (7, "s3", 70)])
    status = {(r.capture, r.status) for r in spark.read.parquet(f"{folder}/status").collect()}
    assert status == {(1, "done"), (2, "skipped"), (3, "done"), (4, "skipped"), (5, "done"), (6, "timed out"), (7, "skipped")}
    assert sorted((r.capture, r.twice) for r in spark.read.parquet(f"{folder}/results").collect()) == [(1, 20), (3, 60), (5, 100)]
    assert spark.read.parquet(f"{folder}/status").count() == 7
