"""Many feeds share folders: what a version gives, and how many folders there are, against a plain dict."""

import os

from pyspark.sql import functions as F

from feedlake.sources import manifest, tables


def rows(spark, base, **kw):
    return sorted((tuple(r) for r in tables.read_snapshot(spark, base, **kw).collect()), key=str)


def folders(base):
    return {(w, n) for w in os.listdir(f"{base}/data") for n in os.listdir(f"{base}/data/{w}") if not n.startswith((".", "_SUCCESS"))}


def test_feeds_share_folders_and_change_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "MOST_FOLDERS", 4, raising=False)
    base = str(tmp_path / "t")
    first = spark.range(120).selectExpr("cast(id AS string) AS external_id", "nullif(cast(id % 40 AS int), 39) AS feed_id", "id AS price")
    tables.publish_snapshot(first, base)
    assert len(folders(base)) <= 4
    want = {i: (str(i), None if i % 40 == 39 else i % 40, i) for i in range(120)}
    shown = lambda: sorted(want.values(), key=str)
    assert rows(spark, base) == shown()

    def change(feeds, make, now):
        seen = []
        tables.publish_change(spark, base, lambda old: make(old) if not seen.append(sorted(r[0] for r in old.select("external_id").collect())) else None, feeds)
        mine = [i for i, r in want.items() if r[1] in feeds]
        assert seen[0] == sorted(str(i) for i in mine)  # of a pack no other feed's rows are given
        for i in mine:
            want[i] = now(want[i])
        for i in [i for i, r in want.items() if r is None]:
            del want[i]
        assert rows(spark, base) == shown()

    dearer = lambda old: old.withColumn("price", F.col("price") + 1000)
    raised = lambda r: (r[0], r[1], r[2] + 1000)
    change([3, None], dearer, raised)
    change([5], lambda old: old.limit(0), lambda r: None)
    change([3, 7, 11, 12, 13, 14], dearer, raised)  # more than there may be folders: packs again
    assert len(folders(base)) <= 4 + 2 + 4
    change([7, 13, 39], dearer, raised)
    assert rows(spark, base, version=1) == sorted((tuple(r) for r in first.collect()), key=str)
    assert manifest.expire(spark, base, 1) == [1, 2, 3, 4] and rows(spark, base) == shown()
    tables.publish_snapshot(first, base)
    manifest.expire(spark, base, 1)
    assert len(folders(base)) <= 4
    tables.publish_change(spark, base, lambda old: old.limit(0), list(range(39)))
    tables.publish_change(spark, base, lambda old: old.limit(0), [None])
    assert rows(spark, base) == []


def test_versions_with_a_line_for_each_feed_are_read(spark, tmp_path):
    base = str(tmp_path / "t")
    tables.publish_change(spark, base, lambda old: spark.createDataFrame([("a", 1), ("b", 2)], "external_id string, feed_id int"), [1, 2])
    assert {n for _, n in folders(base)} == {"_feed=1", "_feed=2"}
    assert rows(spark, base) == [("a", 1), ("b", 2)]
