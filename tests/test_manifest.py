"""Versions by manifest: two writers, what a batch writes, expiry; and alarms of silent runs by the clock."""

import glob
import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from feedlake.sources import manifest, tables
from feedlake.streaming import jobs

SCHEMA = "external_id string, feed_id int, price long"


def rows(spark, base, **kw):
    return sorted(tuple(r) for r in tables.read_snapshot(spark, base, **kw).collect())


def frame(spark, *found):
    return spark.createDataFrame(list(found), SCHEMA)


def add(spark, base, row, meet=None):
    """Adds a row to its feed; ``meet`` is awaited between reading the old rows and writing."""

    def make(old):
        if meet is not None:
            meet()
        new = frame(spark, row)
        return new if old is None else old.unionByName(new)

    return tables.publish_change(spark, base, make, [row[1]])


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both read version 1 before either writes; once they change the same feed, once two feeds."""
    for name, feeds in (("same", (1, 1)), ("two", (1, 2))):
        base = str(tmp_path / name)
        tables.publish_snapshot(frame(spark, ("a", 1, 1), ("b", 2, 2)), base)
        barrier, tries, failed = threading.Barrier(2), {0: 0, 1: 0}, []

        def write(k):
            def meet():
                tries[k] += 1
                if tries[k] == 1:
                    barrier.wait(60)

            try:
                add(spark, base, (f"w{k}", feeds[k], 10 + k), meet)
            except Exception as error:  # shown by the assertion below
                failed.append(error)

        threads = [threading.Thread(target=write, args=(k,)) for k in range(2)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert not failed
        assert rows(spark, base) == sorted([("a", 1, 1), ("b", 2, 2), ("w0", feeds[0], 10), ("w1", feeds[1], 11)])
        assert tables.current_version(spark, base) == 3
        # on the same feed the second is made again from the first's rows; on another it only takes over the entries
        assert sum(tries.values()) == (3 if name == "same" else 2)
        assert rows(spark, base, version=1) == [("a", 1, 1), ("b", 2, 2)]


def test_many_writers(spark, tmp_path):
    base = str(tmp_path / "t")
    threads = [threading.Thread(target=add, args=(spark, base, (f"w{k}", k % 3, k))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert rows(spark, base) == sorted((f"w{k}", k % 3, k) for k in range(8)) and tables.current_version(spark, base) == 8
    assert not os.listdir(f"{base}/drafts") or all(n.startswith(".") for n in os.listdir(f"{base}/drafts"))


def test_a_version_is_created_once(spark, tmp_path):
    folder = manifest.Folder(spark, str(tmp_path))
    made = []
    threads = [threading.Thread(target=lambda k=k: made.append((folder.create("versions/1", f"writer {k}"), k))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [k for ok, k in made if ok]
    assert len(won) == 1 and folder.read("versions/1") == f"writer {won[0]}"


def test_publication_based_on_an_older_version(spark, tmp_path):
    base = str(tmp_path / "t")
    assert tables.current_version(spark, base) is None
    with pytest.raises(ValueError):
        tables.read_snapshot(spark, base)
    tables.publish_snapshot(frame(spark, ("a", 1, 1)), base)
    tables.publish_snapshot(frame(spark, ("a", 1, 2)), base, based_on=1)
    with pytest.raises(manifest.Conflict):
        tables.publish_snapshot(frame(spark, ("a", 1, 3)), base, based_on=1)
    with pytest.raises(ValueError):
        tables.publish_change(spark, base, lambda old: frame(spark, ("z", 9, 1)), [1])
    assert rows(spark, base) == [("a", 1, 2)]


def test_feeds_and_columns_come_and_go(spark, tmp_path):
    base = str(tmp_path / "t")
    tables.publish_snapshot(frame(spark, ("a", 1, 1), ("b", 2, 2), ("n", None, 3)), base)
    tables.publish_change(spark, base, lambda old: old.withColumn("colour", F.lit("red")), [1])
    got = {r["external_id"]: r["colour"] for r in tables.read_snapshot(spark, base).collect()}
    assert got == {"a": "red", "b": None, "n": None}
    tables.publish_change(spark, base, lambda old: old.limit(0), [2, None])
    assert [r["external_id"] for r in tables.read_snapshot(spark, base).collect()] == ["a"]
    tables.publish_change(spark, base, lambda old: old.limit(0), [1])
    assert tables.read_snapshot(spark, base).count() == 0
    tables.publish_change(spark, base, lambda old: frame(spark, ("c", 3, 3)), [3])
    with pytest.raises(ValueError):  # a column keeps its type while other feeds have it
        tables.publish_change(spark, base, lambda old: spark.createDataFrame([("q", 5, "text")], "external_id string, feed_id int, price string"), [5])
    assert rows(spark, base) == [("c", 3, 3, None)]


def test_expiry(spark, tmp_path):
    base = str(tmp_path / "t")
    tables.publish_snapshot(frame(spark, ("a", 1, 1), ("b", 2, 2)), base)
    for k in range(3):
        tables.publish_change(spark, base, lambda old: old.withColumn("price", F.col("price") + 1), [1])
    assert manifest.expire(spark, base, 2) == [1, 2]
    assert rows(spark, base) == [("a", 1, 4), ("b", 2, 2)] and rows(spark, base, version=3) == [("a", 1, 3), ("b", 2, 2)]
    with pytest.raises(ValueError):
        tables.read_snapshot(spark, base, 1)
    left = {os.path.relpath(f, base).split(os.sep)[1] for f in glob.glob(f"{base}/data/*/*/*.parquet")}
    assert len(left) == 3  # feed 2 of the first write, feed 1 of the last two


def test_a_batch_writes_only_its_feeds(spark, tmp_path):
    base, src = str(tmp_path / "t"), tmp_path / "in"
    src.mkdir()
    schema = f"{SCHEMA}, last_updated timestamp"
    start = spark.range(3_000).selectExpr("cast(id AS string) AS external_id", "cast(id % 10 AS int) AS feed_id", "id AS price", "timestamp'2024-01-01' AS last_updated")
    tables.publish_snapshot(start, base)
    whole = sum(os.path.getsize(f) for f in glob.glob(f"{base}/data/*/*/*.parquet"))
    (src / "1.json").write_text('{"external_id":"13","feed_id":3,"price":-1,"last_updated":"2024-02-01T00:00:00"}\n')
    before = set(glob.glob(f"{base}/data/*/*/*.parquet"))
    jobs.stream_ingest(spark, str(src), schema, base, str(tmp_path / "cp"), ["last_updated"]).awaitTermination()
    new = set(glob.glob(f"{base}/data/*/*/*.parquet")) - before
    assert new and all("_feed=3" in f for f in new) and sum(map(os.path.getsize, new)) < whole / 5
    found = {r["external_id"]: r["price"] for r in tables.read_snapshot(spark, base).collect()}
    assert len(found) == 3_000 and found["13"] == -1 and found["23"] == 23
    # the same batch again changes nothing
    jobs._land(spark.read.schema(schema).json(str(src)), base, lambda old, new: jobs.upsert(old, new))
    assert {r["external_id"]: r["price"] for r in tables.read_snapshot(spark, base).collect()} == found


def test_a_lone_silent_run_is_reported(spark, tmp_path, monkeypatch):
    """No other run moves anything on: the clock alone raises the alarm, once for each silence."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def beat(name, run, ago, mode="full"):
        stamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(time.time() - ago))
        (tmp_path / name).write_text(json.dumps({"run_id": run, "mode": mode, "ts": stamp}) + "\n")
        os.rename(tmp_path / name, src / name)  # whole files only

    beat("1.json", "lone", 86)
    beat("2.json", "other mode", 9_999, "by_hand")
    beat("3.json", "alive", 1)
    stream = spark.readStream.schema("run_id string, mode string, ts timestamp").json(str(src))
    query = jobs.watch_runs(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()

    def alarms(n):
        until = time.time() + 60
        while time.time() < until:
            if query.exception():
                raise query.exception()
            if os.path.isdir(out) and (found := spark.read.schema("run_id string, mode string, last timestamp, stalled_at timestamp").parquet(out).collect()) and len(found) >= n:
                return found
            time.sleep(0.5)
        return []

    try:
        first = alarms(1)
        assert [(r["run_id"], r["mode"]) for r in first] == [("lone", "full")]
        assert 90 <= (first[0]["stalled_at"] - first[0]["last"]).total_seconds() < 120
        beat("4.json", "lone", 88)  # alive again, then silent
        assert [r["run_id"] for r in alarms(2)] == ["lone", "lone"]
    finally:
        query.stop()
