"""The bucketed catalog: rows as by plain joins, and no exchange between the catalog's scan and its join."""

import glob
import re
import uuid

import pytest
from pyspark.sql import functions as F

from feedlake.operators import catalog, lookups
from feedlake.sources import bucketed

SCHEMA = "external_id string, feed_id int, status string, price double, original_price double, in_stock int, image_url string, affiliate_link string, last_updated timestamp"
BUCKETS = 6


@pytest.fixture
def no_broadcast(spark):
    for k, v in (("autoBroadcastJoinThreshold", "-1"), ("adaptive.enabled", "false")):
        spark.conf.set(f"spark.sql.{k}", v)
    yield
    for k in ("autoBroadcastJoinThreshold", "adaptive.enabled"):
        spark.conf.unset(f"spark.sql.{k}")


def rows(spark, ids, price):
    base = spark.range(0, 1).select(F.explode(F.array(*[F.lit(i) for i in ids])).alias("i"))
    at = F.to_timestamp(F.lit("2024-01-01"))
    return base.select(
        F.concat(F.lit("p"), "i").alias("external_id"), (F.col("i") % 3).cast("int").alias("feed_id"), F.when(F.col("i") % 5 == 0, "unavailable").otherwise("active").alias("status"),
        F.lit(price).alias("price"), F.lit(9.0).alias("original_price"), F.lit(1).alias("in_stock"), F.lit("u").alias("image_url"), F.lit("l").alias("affiliate_link"), at.alias("last_updated"),
    )


def above_scan(df, table):
    """Names of the operators from the table's scan up to the first join."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [re.search(r"[A-Za-z*]", x).start() if re.search(r"[A-Za-z*]", x) else 0 for x in lines]
    at = next(i for i, x in enumerate(lines) if "Scan" in x and table in x)
    names, level = [], depth[at]
    assert "Bucketed: true" in lines[at]
    for i in range(at, -1, -1):
        if depth[i] < level:
            level = depth[i]
            names.append(lines[i][depth[i]:])
            if "Join" in lines[i]:
                return names
    raise AssertionError("no join above the scan")


def same(a, b):
    return sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))


def test_upsert_and_sync_leave_the_catalog_in_place(spark, tmp_path, no_broadcast):
    name = lambda: f"t{uuid.uuid4().hex}"
    old, new = rows(spark, range(200), 1.0).union(rows(spark, [1, 4], 1.5).withColumn("feed_id", F.lit(None).cast("int"))), rows(spark, range(150, 260), 2.0)
    first = bucketed.lay_out(old, name(), BUCKETS, str(tmp_path))
    second = bucketed.upsert_buckets(spark, first, new, name())
    assert same(bucketed.read_buckets(spark, second), catalog.upsert(old, new))
    third = bucketed.sync_buckets(spark, second, rows(spark, range(20), 7.0), name())
    assert same(bucketed.read_buckets(spark, third), catalog.quick_sync(catalog.upsert(old, new), rows(spark, range(20), 7.0)))
    for layout, most in ((first, 1), (second, 2), (third, 2)):
        assert len(glob.glob(f"{tmp_path}/{layout.table}/*.parquet")) <= most * BUCKETS
    with bucketed.one_key_suffices(spark):
        table = bucketed.read_buckets(spark, first)
        for df in (catalog.upsert(table, new), catalog.quick_sync(table, new)):
            assert not [x for x in above_scan(df, first.table) if "Exchange" in x]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_lookups_shuffle_the_ids_alone(spark, tmp_path, no_broadcast):
    old = rows(spark, range(300), 1.0).union(rows(spark, range(40), 3.0).withColumn("feed_id", F.lit(8)))
    layout = bucketed.lay_out(old, f"t{uuid.uuid4().hex}", BUCKETS, str(tmp_path))
    ids = spark.createDataFrame([(f"p{i}",) for i in [*range(0, 400, 7), 7, 7]] + [(None,)], "product_id string")
    for look in (lookups.resolve, lookups.fetch):
        df = look(ids, bucketed.read_buckets(spark, layout))
        assert same(df, look(ids, old))
        assert not [x for x in above_scan(df, layout.table) if "Exchange" in x]


def test_an_existing_table_is_not_overwritten(spark, tmp_path):
    layout = bucketed.lay_out(rows(spark, [1], 1.0), f"t{uuid.uuid4().hex}", 2, str(tmp_path))
    with pytest.raises(Exception, match="already exists"):
        bucketed.lay_out(rows(spark, [2], 1.0), layout.table, 2, str(tmp_path))
    assert bucketed.read_buckets(spark, layout).count() == 1
