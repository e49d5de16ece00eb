"""S1 with many feeds: they share folders, and what a write replaces equals a plain dict."""

import os

from pyspark.sql import functions as F

from feedlake.sources import manifest, tables


def folders(path):
    return {n for n in os.listdir(path) if "=" in n}


def rows(spark, path):
    return sorted(((r.external_id, r.feed_id, r.price) for r in spark.read.parquet(path).collect()), key=str)


def test_many_feeds_share_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "MOST_FOLDERS", 8)
    path = str(tmp_path / "p")
    table = spark.range(200).selectExpr("cast(id AS string) AS external_id", "nullif(cast(id % 40 AS int), 39) AS feed_id", "id AS price")
    want = {i: (str(i), None if i % 40 == 39 else i % 40, i) for i in range(200)}
    tables.write_products(table, path)
    assert 1 < len(folders(path)) <= 8 and all(n.startswith("_pack=") for n in folders(path))
    assert rows(spark, path) == sorted(want.values(), key=str)
    # some feeds, with fewer rows than before; a new feed; rows without a feed
    again = table.where("feed_id % 5 = 0 and cast(external_id AS int) < 120 or feed_id is null").withColumn("price", F.col("price") + 1000)
    tables.write_products(again.unionByName(spark.createDataFrame([("new", 77, 1)], "external_id string, feed_id int, price long")), path)
    changed = {i: (r[0], r[1], r[2] + 1000) for i, r in want.items() if r[1] is None or r[1] % 5 == 0 and i < 120}
    want = {i: r for i, r in want.items() if r[1] is not None and r[1] % 5} | changed | {"new": ("new", 77, 1)}
    assert rows(spark, path) == sorted(want.values(), key=str)
    assert len(folders(path)) <= 8
    # one feed alone: packs without it aren't touched
    before = {n: sorted(os.listdir(f"{path}/{n}")) for n in folders(path)}
    tables.write_products(table.where("feed_id = 3").limit(1).withColumn("price", F.lit(-1).cast("long")), path)
    assert sum(before[n] != sorted(os.listdir(f"{path}/{n}")) for n in before) == 1
    found = rows(spark, path)
    assert len([r for r in found if r[1] == 3]) == 1 and [r for r in found if r[1] != 3] == sorted((r for r in want.values() if r[1] != 3), key=str)


def test_a_table_of_few_feeds_keeps_a_folder_for_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "MOST_FOLDERS", 4)
    path = str(tmp_path / "p")
    some = lambda n: spark.range(n).selectExpr("cast(id AS string) AS external_id", "cast(id AS int) AS feed_id", "id AS price")
    tables.write_products(some(3), path)
    tables.write_products(some(9).where("feed_id > 1"), path)
    assert folders(path) == {f"feed_id={k}" for k in range(9)} and rows(spark, path) == [(str(k), k, k) for k in range(9)]
