"""R1-R16 over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.operators import reports
from feedlake.plans.views import frame, with_views

MISSING = {
    "product_name": "product_name IS NULL OR product_name = ''", "price": "price IS NULL OR price = 0", "image_url": "image_url IS NULL OR image_url = ''",
    "affiliate_link": "affiliate_link IS NULL OR affiliate_link = ''", "brand": "brand IS NULL OR brand = ''",
    "original_price": "original_price IS NULL OR original_price = 0", "category": "category IS NULL OR category = ''",
    "currency": "currency IS NULL OR currency = ''", "in_stock": "in_stock IS NULL",
}
_COMPLETE = "NOT (" + " OR ".join(f"({MISSING[c]})" for c in ("product_name", "price", "image_url", "affiliate_link")) + ")"
_QUALITY = f"""quality AS (SELECT feed_name, count(*) AS total, sum(CASE WHEN {_COMPLETE} THEN 1 ELSE 0 END)::BIGINT AS complete,
  {", ".join(f"sum(CASE WHEN {w} THEN 1 ELSE 0 END)::BIGINT AS missing_{c}" for c, w in MISSING.items())}
  FROM products WHERE status = 'active' GROUP BY feed_name)"""
_PERCENT = "cast(floor(complete * 100.0 / total + 0.5) AS bigint)"
_SCORE = " + ".join(f"CASE WHEN {MISSING[c]} THEN {w} ELSE 0 END" for c, w in reports.MISSING_WEIGHTS)
_LISTED = "concat_ws('|', " + ", ".join(f"CASE WHEN {MISSING[c]} THEN '{c}' END" for c, _ in reports.MISSING_WEIGHTS) + ")"
_FIELD_ROWS = " UNION ALL ".join(
    f"SELECT feed_name, {_PERCENT} AS quality, '{n}' AS field, '{t}' AS tier, '{s}' AS standard, missing_{n} AS missing FROM quality" for n, t, s in reports.QUALITY_FIELDS
)


def products(spark, d):
    return frame(spark, d, "products")


def feeds(spark, d):
    return frame(spark, d, "feeds")


def refs(spark, d):
    return frame(spark, d, "refs")


def stops(spark):
    return spark.createDataFrame([("with",), ("from",)], "token string")


def _worst(spark, d):
    found = reports.worst_products(products(spark, d))
    return found.withColumn("missing_fields", F.array_join("missing_fields", "|"))


def _dead(spark, d):
    found = reports.dead_products(refs(spark, d), products(spark, d))
    return found.withColumn("dead_ids", F.array_join("dead_ids", "|"))


QUERIES = {
    "r1_counts": lambda s, d: reports.counts(products(s, d)),
    "r2_feed_counts": lambda s, d: reports.feed_counts(products(s, d), feeds(s, d)),
    "r3_stats": lambda s, d: reports.stats(products(s, d)).withColumn("last_updated", F.to_date("last_updated")),
    "r4_status_breakdown": lambda s, d: reports.status_breakdown(products(s, d)),
    "r5_mapping_quality": lambda s, d: reports.mapping_quality(products(s, d)),
    "r5_mapping_quality_fields": lambda s, d: reports.mapping_quality_fields(products(s, d)).drop("source"),
    "r6_worst_products": _worst,
    "r7_orphan_preview": lambda s, d: reports.orphan_preview(products(s, d), feeds(s, d)),
    "r8_dashboard": lambda s, d: reports.dashboard(products(s, d), feeds(s, d)).withColumn("last_sync", F.to_date("last_sync")),
    "r9_quality_bucket": lambda s, d: reports.mapping_quality(products(s, d)).select("feed_name", reports.quality_bucket(F.col("quality")).alias("bucket")),
    "r10_refresh_feed_stats": lambda s, d: reports.refresh_feed_stats(feeds(s, d), products(s, d)),
    "r11_dead_products": _dead,
    "r12_reference_integrity": lambda s, d: reports.reference_integrity(refs(s, d), products(s, d)),
    "r13_build_vocab": lambda s, d: reports.build_vocab(products(s, d), stops(s)),
    "r14_known_brands": lambda s, d: reports.known_brands(products(s, d)),
    "r15_reference_stats": lambda s, d: reports.reference_stats(refs(s, d)),
    "r16_live_ids": lambda s, d: reports.live_ids(products(s, d)),
}

ORACLE_SQL = {
    "r1_counts": with_views("SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active FROM products", "products"),
    "r2_feed_counts": with_views("SELECT feed_id, count(*) AS products FROM products WHERE status = 'active' AND feed_id IN (SELECT feed_id FROM feeds) GROUP BY feed_id", "products", "feeds"),
    "r3_stats": with_views("SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'unavailable') AS unavailable, max(last_updated)::DATE AS last_updated FROM products", "products"),
    "r4_status_breakdown": with_views("SELECT feed_id, status, count(*) AS products FROM products GROUP BY ALL", "products"),
    "r5_mapping_quality": with_views(f"WITH {_QUALITY} SELECT *, {_PERCENT} AS quality FROM quality", "products"),
    "r5_mapping_quality_fields": with_views(f"WITH {_QUALITY} {_FIELD_ROWS}", "products"),
    "r6_worst_products": with_views(
        f"""SELECT feed_name, external_id, CASE WHEN coalesce(product_name, '') = '' THEN '(empty)' ELSE product_name END AS product_name, ({_SCORE})::INT AS score, {_LISTED} AS missing_fields,
        row_number() OVER (PARTITION BY feed_name ORDER BY ({_SCORE}) DESC, external_id)::INT AS place,
        ({" + ".join(f"CASE WHEN {MISSING[c]} THEN 1 ELSE 0 END" for c, _ in reports.MISSING_WEIGHTS)})::INT AS missing_count
        FROM products WHERE status = 'active' QUALIFY place <= 3""", "products"),
    "r7_orphan_preview": with_views("SELECT feed_name, feed_id, count(*) AS products FROM products WHERE feed_id NOT IN (SELECT feed_id FROM feeds) GROUP BY GROUPING SETS ((feed_name), (feed_id), ())", "products", "feeds"),
    "r8_dashboard": with_views(
        f"""WITH {_QUALITY} SELECT (SELECT count(*) FROM products WHERE status = 'active') AS products, (SELECT max(last_updated)::DATE FROM products) AS last_sync,
        (SELECT count(*) FROM feeds) AS feeds, (SELECT cast(floor(avg({_PERCENT}) + 0.5) AS bigint) FROM quality WHERE feed_name IN (SELECT feed_name FROM feeds)) AS avg_quality""", "products", "feeds"),
    "r9_quality_bucket": with_views(f"WITH {_QUALITY} SELECT feed_name, CASE WHEN {_PERCENT} >= 90 THEN 'high' WHEN {_PERCENT} >= 70 THEN 'mid' ELSE 'low' END AS bucket FROM quality", "products"),
    "r10_refresh_feed_stats": with_views(
        f"""WITH {_QUALITY}, n AS (SELECT feed_id, count(*) AS c FROM products WHERE status = 'active' GROUP BY feed_id)
        SELECT f.feed_name, f.feed_id, f.default_currency, coalesce(n.c, 0) AS product_count, coalesce({_PERCENT}, 0) AS mapping_quality FROM feeds f LEFT JOIN n USING (feed_id) LEFT JOIN quality q USING (feed_name)""", "products", "feeds"),
    "r11_dead_products": with_views(
        """WITH s AS (SELECT external_id, max(CASE WHEN status = 'active' THEN 1 ELSE 0 END) AS alive FROM products GROUP BY external_id),
        r AS (SELECT DISTINCT post_id, title, product_id FROM refs)
        SELECT post_id, title, count(*) AS dead, string_agg(product_id, '|' ORDER BY product_id) AS dead_ids FROM r JOIN s ON product_id = external_id WHERE alive = 0 GROUP BY post_id, title""", "products", "refs"),
    "r12_reference_integrity": with_views(
        """WITH b AS (SELECT * FROM products QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY CASE WHEN status = 'active' THEN 0 ELSE 1 END, feed_id) = 1),
        r AS (SELECT DISTINCT product_id FROM refs)
        SELECT product_id, (external_id IS NOT NULL)::INT AS found, coalesce((coalesce(price, 0) <> 0)::INT, 0) AS has_price, coalesce((image_url <> '')::INT, 0) AS has_image,
        coalesce((brand <> '')::INT, 0) AS has_brand, coalesce((affiliate_link <> '')::INT, 0) AS has_link FROM r LEFT JOIN b ON product_id = external_id""", "products", "refs"),
    "r13_build_vocab": with_views(
        """WITH a AS (SELECT * FROM products WHERE status = 'active'), b AS (SELECT DISTINCT lower(trim(brand)) AS token FROM a WHERE length(lower(trim(brand))) >= 3),
        w AS (SELECT unnest(regexp_split_to_array(lower(product_name), '[^\\p{L}\\p{N}]+')) AS token FROM a),
        e AS (SELECT token, 100 AS freq FROM b UNION ALL SELECT token, count(*) FROM w WHERE length(token) >= 4 AND token NOT IN ('with', 'from') GROUP BY token)
        SELECT token, sum(freq)::BIGINT AS freq FROM e GROUP BY token HAVING sum(freq) >= 3""", "products"),
    "r14_known_brands": with_views("SELECT DISTINCT lower(brand) AS brand FROM products WHERE brand <> ''", "products"),
    "r15_reference_stats": with_views("SELECT resolver, count(*) AS refs, count(DISTINCT product_id) AS ids, count(DISTINCT post_id) AS posts FROM refs GROUP BY resolver", "refs"),
    "r16_live_ids": with_views("SELECT DISTINCT external_id FROM products WHERE status IN ('active', 'importing')", "products"),
}
