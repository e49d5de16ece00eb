"""U1-U20 over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.operators import catalog
from feedlake.plans.views import frame, with_views

_KEEP = ("external_id", "feed_id", "product_name", "price", "original_price", "in_stock", "status", "affiliate_link")
_COLS = ", ".join(_KEEP)
_DAY = "1997-01-01"


def products(s, d):
    return frame(s, d, "products")


def feeds(s, d):
    return frame(s, d, "feeds")


def updates(s, d):
    return frame(s, d, "updates")


def _raw_updates(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select((F.col("event_id") % 900).cast("string").alias("external_id"), (F.col("event_id") % 50 + 1).alias("feed_id"), "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))


_RAW = "raw AS (SELECT cast(event_id % 900 AS string) AS external_id, event_id % 50 + 1 AS feed_id, event_id, cast(round(value * 100) AS bigint) AS cents FROM events)"


def _split(s, d):
    rules = {"price": F.col("price") > 0, "image": F.col("image_url") != "", "link": F.col("affiliate_link") != ""}
    good, bad = catalog.split_valid(products(s, d), rules)
    return good.select("external_id", "feed_id", F.lit("").alias("broken")).unionByName(bad.select("external_id", "feed_id", F.array_join("broken", "|").alias("broken")))


def _orphans(s, d):
    p = products(s, d)
    table, report = catalog.mark_orphans(p, p.where("feed_id % 5 = 0").select("feed_id"), feeds(s, d), F.to_timestamp(F.lit(_DAY)), True)
    counted = table.groupBy("feed_id", "status").agg(F.count("*").alias("n"))
    return counted.crossJoin(report.select("orphans", "configured_active", F.col("applied").cast("int").alias("applied")))


def run_log(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    i = F.col("event_id")
    return e.select(
        (i % 37).cast("string").alias("run_id"), (i % 90 + 1).alias("feed_id"), F.when(i % 9 == 0, "priority_active").otherwise("import").alias("phase"),
        F.when(i % 11 == 0, "failed").when(i % 5 == 0, "processing").otherwise("completed").alias("status"),
        (i % 1000).alias("offset"), F.lit(1000).cast("long").alias("total_rows"), F.when(i % 400 == 1, "bad").otherwise("").alias("error"),
        (i % 70).alias("found"), (i % 90).alias("wanted"),
    )


_LOG = """log AS (SELECT cast(event_id % 37 AS string) AS run_id, event_id % 90 + 1 AS feed_id, CASE WHEN event_id % 9 = 0 THEN 'priority_active' ELSE 'import' END AS phase,
  CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 5 = 0 THEN 'processing' ELSE 'completed' END AS status, event_id % 1000 AS "offset", 1000 AS total_rows,
  CASE WHEN event_id % 400 = 1 THEN 'bad' ELSE '' END AS error, event_id % 70 AS found, event_id % 90 AS wanted FROM events)"""


def _feed_ids(s, d):
    f = feeds(s, d).select("feed_name", F.when(F.col("feed_id") % 3 == 0, F.col("feed_id")).alias("feed_id"), F.col("feed_id").alias("position"))
    return catalog.assign_feed_ids(f)


def _refresh(s, d):
    table, _ = catalog.full_refresh(products(s, d), updates(s, d), feeds(s, d), F.to_timestamp(F.lit(_DAY)))
    return table.select(*_KEEP)


QUERIES = {
    "u1_dedup_last": lambda s, d: catalog.dedup_last(_raw_updates(s, d), ["external_id"], ["event_id"]),
    "u2_dedup_by_image": lambda s, d: catalog.dedup_by_image(products(s, d), ["feed_id", "external_id"]).select(*_KEEP),
    "u3_upsert": lambda s, d: catalog.upsert(products(s, d), updates(s, d)).select(*_KEEP),
    "u4_split_valid": _split,
    "u5_restrict_to_ids": lambda s, d: catalog.restrict_to_ids(products(s, d), updates(s, d), "feed_id").select(*_KEEP),
    "u6_quick_sync": lambda s, d: catalog.quick_sync(products(s, d), updates(s, d)).select(*_KEEP),
    "u7_force_raw_fields": lambda s, d: catalog.force_raw_fields(
        products(s, d).withColumns({"raw_price": F.when(F.col("feed_id") % 2 == 0, "12.50 EUR").otherwise(""), "raw_old_price": F.lit("25,00"), "raw_in_stock": F.when(F.col("feed_id") % 3 == 0, "0").otherwise("")})
    ).select("external_id", "feed_id", (F.col("price") * 100).cast("long").alias("price"), (F.col("original_price") * 100).cast("long").alias("original_price"), "in_stock", "discount_percentage"),
    "u8_reactivate": lambda s, d: catalog.reactivate(products(s, d), updates(s, d)).select(*_KEEP),
    "u9_mark_orphans": _orphans,
    "u10_drop_unconfigured": lambda s, d: catalog.drop_unconfigured(products(s, d), feeds(s, d)).select(*_KEEP),
    "u11_drop_unconfigured_by_name": lambda s, d: catalog.drop_unconfigured(products(s, d), feeds(s, d), "feed_name").select(*_KEEP),
    "u12_delete_feed": lambda s, d: catalog.delete_feed(products(s, d), feed_id=8)[0].select(*_KEEP),
    "u13_carry_forward": lambda s, d: catalog.carry_forward(updates(s, d), products(s, d), frame(s, d, "refs").select(F.col("product_id").alias("external_id"))).select("external_id", "feed_id", "status", "product_name"),
    "u14_merge_snapshot": lambda s, d: catalog.merge_snapshot(
        catalog.dedup_last(products(s, d), ["external_id"], ["feed_id"]), catalog.dedup_last(updates(s, d), ["external_id"], ["feed_id"])
    ).select(*_KEEP),
    "u15_assign_feed_ids": _feed_ids,
    "u16_full_refresh": _refresh,
    "u17_run_verdict": lambda s, d: catalog.run_verdict(run_log(s, d), feeds(s, d)).withColumn("all_feeds_ok", F.col("all_feeds_ok").cast("int")),
    "u18_run_progress": lambda s, d: catalog.run_progress(run_log(s, d)),
    "u19_quick_progress": lambda s, d: catalog.quick_progress(run_log(s, d)).distinct(),
    "u20_midrun_total": lambda s, d: catalog.midrun_total(run_log(s, d), feeds(s, d).withColumn("product_count", F.col("feed_id") * 10), products(s, d)),
    "u21_refresh_feed": lambda s, d: catalog.refresh_feed(products(s, d), updates(s, d), 8).select(*_KEEP),
}

_KEY = "u.external_id = p.external_id AND u.feed_id = p.feed_id"
_MERGED = f"SELECT {_COLS}, last_updated, feed_name FROM products p WHERE NOT EXISTS (SELECT 1 FROM updates u WHERE {_KEY}) UNION ALL SELECT {_COLS}, last_updated, feed_name FROM updates"
ORACLE_SQL = {
    "u1_dedup_last": f"WITH {_RAW} SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY event_id DESC) = 1",
    "u2_dedup_by_image": with_views(f"SELECT {_COLS} FROM products QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(lower(image_url), ''), external_id || '|' || colour) ORDER BY feed_id, external_id) = 1", "products"),
    "u3_upsert": with_views(f"SELECT {_COLS} FROM products p WHERE NOT EXISTS (SELECT 1 FROM updates u WHERE {_KEY}) UNION ALL SELECT {_COLS} FROM updates", "products", "updates"),
    "u4_split_valid": with_views("SELECT external_id, feed_id, concat_ws('|', CASE WHEN NOT price > 0 THEN 'price' END, CASE WHEN image_url = '' THEN 'image' END, CASE WHEN affiliate_link = '' THEN 'link' END) AS broken FROM products", "products"),
    "u5_restrict_to_ids": with_views(f"SELECT {_COLS} FROM products WHERE external_id IN (SELECT external_id FROM updates) QUALIFY rank() OVER (PARTITION BY external_id ORDER BY feed_id) = 1", "products", "updates"),
    "u6_quick_sync": with_views(
        f"""SELECT p.external_id, p.feed_id, p.product_name, coalesce(u.price, p.price) AS price, coalesce(u.original_price, p.original_price) AS original_price, coalesce(u.in_stock, p.in_stock) AS in_stock,
        p.status, coalesce(u.affiliate_link, p.affiliate_link) AS affiliate_link FROM products p LEFT JOIN updates u ON {_KEY}""", "products", "updates"),
    "u7_force_raw_fields": with_views(
        """SELECT external_id, feed_id, CASE WHEN feed_id % 2 = 0 THEN 1250 ELSE price * 100 END AS price, 2500 AS original_price, CASE WHEN feed_id % 3 = 0 THEN 0 ELSE in_stock END AS in_stock,
        CASE WHEN feed_id % 2 = 0 THEN 50 WHEN price < 25 AND price > 0 THEN cast(floor((25 - price) / 25.0 * 100 + 0.5) AS bigint) END AS discount_percentage FROM products""", "products"),
    "u8_reactivate": with_views(
        """SELECT external_id, feed_id, product_name, price, original_price, in_stock, CASE WHEN status = 'unavailable' AND external_id IN (SELECT external_id FROM updates) THEN 'active' ELSE status END AS status,
        affiliate_link FROM products""", "products", "updates"),
    "u9_mark_orphans": with_views(
        f"""WITH m AS (SELECT *, feed_id % 5 = 0 AND status = 'active' AND last_updated < DATE '{_DAY}' AS stale, feed_id IN (SELECT feed_id FROM feeds) AND status = 'active' AS conf FROM products),
        r AS (SELECT count(*) FILTER (stale) AS orphans, count(*) FILTER (conf) AS configured_active FROM m),
        g AS (SELECT orphans, configured_active, (orphans <= configured_active * 0.5)::INT AS applied FROM r),
        t AS (SELECT feed_id, CASE WHEN stale AND applied = 1 THEN 'unavailable' ELSE status END AS status FROM m, g)
        SELECT feed_id, status, n, orphans, configured_active, applied FROM (SELECT feed_id, status, count(*) AS n FROM t GROUP BY ALL), g""", "products", "feeds"),
    "u10_drop_unconfigured": with_views(f"SELECT {_COLS} FROM products WHERE feed_id IN (SELECT feed_id FROM feeds)", "products", "feeds"),
    "u11_drop_unconfigured_by_name": with_views(f"SELECT {_COLS} FROM products WHERE feed_name IS NULL OR lower(feed_name) IN (SELECT lower(feed_name) FROM feeds)", "products", "feeds"),
    "u12_delete_feed": with_views(f"SELECT {_COLS} FROM products WHERE feed_id <> 8", "products"),
    "u13_carry_forward": with_views(
        """WITH o AS (SELECT * FROM products QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY feed_id DESC) = 1),
        l AS (SELECT DISTINCT product_id AS external_id FROM refs WHERE product_id NOT IN (SELECT external_id FROM updates))
        SELECT external_id, feed_id, status, product_name FROM updates UNION ALL SELECT l.external_id, o.feed_id, 'unavailable', o.product_name FROM l LEFT JOIN o USING (external_id)""", "products", "updates", "refs"),
    "u14_merge_snapshot": with_views(
        f"""WITH a AS (SELECT * FROM products QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY feed_id DESC) = 1), b AS (SELECT * FROM updates QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY feed_id DESC) = 1)
        SELECT {_COLS} FROM a WHERE external_id NOT IN (SELECT external_id FROM b) UNION ALL SELECT {_COLS} FROM b""", "products", "updates"),
    "u15_assign_feed_ids": with_views(
        """WITH f AS (SELECT feed_name, CASE WHEN feed_id % 3 = 0 THEN feed_id END AS feed_id, feed_id AS position FROM feeds), n AS (SELECT *, row_number() OVER (PARTITION BY feed_id IS NULL ORDER BY position) AS n FROM f)
        SELECT feed_name, position, coalesce(feed_id, (SELECT max(feed_id) FROM f) + n) AS feed_id FROM n""", "feeds"),
    "u16_full_refresh": with_views(
        f"""WITH m AS (SELECT * FROM ({_MERGED}) WHERE feed_id IN (SELECT feed_id FROM feeds)),
        k AS (SELECT *, feed_id IN (SELECT feed_id FROM updates) AND status = 'active' AND last_updated < DATE '{_DAY}' AS stale FROM m),
        g AS (SELECT count(*) FILTER (stale) <= count(*) FILTER (status = 'active') * 0.5 AS ok FROM k)
        SELECT external_id, feed_id, product_name, price, original_price, in_stock, CASE WHEN stale AND ok THEN 'unavailable' ELSE status END AS status, affiliate_link FROM k, g""", "products", "updates", "feeds"),
    "u17_run_verdict": with_views(
        f"""WITH {_LOG} SELECT run_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed' OR error <> '') AS failed, (SELECT count(*) FROM feeds) AS configured,
        (count(*) FILTER (status = 'failed' OR error <> '') = 0 AND count(*) FILTER (status = 'completed') >= (SELECT count(*) FROM feeds))::INT AS all_feeds_ok FROM log WHERE phase <> 'priority_active' GROUP BY run_id""", "feeds"),
    "u18_run_progress": f"""WITH {_LOG}, x AS (SELECT run_id, count(*) FILTER (phase = 'priority_active') AS pa, count(*) FILTER (phase = 'priority_active' AND status = 'completed') AS pd,
        count(*) FILTER (phase <> 'priority_active') AS fa, count(*) FILTER (phase <> 'priority_active' AND status = 'completed') AS fd,
        sum(CASE WHEN phase <> 'priority_active' AND status = 'processing' THEN least(1.0, "offset" / 1000.0::DOUBLE) ELSE 0.0 END) AS part FROM log GROUP BY run_id)
        SELECT run_id, least(99, round(CASE WHEN pa > 0 AND pd < pa THEN 5.0 * pd / pa WHEN fa > 0 THEN 5 + 94 * (fd + part) / fa ELSE 5.0 END))::BIGINT AS percent FROM x""",
    "u19_quick_progress": f"WITH {_LOG} SELECT DISTINCT run_id, (CASE WHEN status = 'completed' THEN 100 ELSE least(99, floor(found * 100 / greatest(wanted, 1))) END)::BIGINT AS percent FROM log",
    "u20_midrun_total": with_views(
        f"""WITH {_LOG}, n AS (SELECT feed_id, count(*) AS c FROM products WHERE status = 'active' GROUP BY feed_id), dn AS (SELECT DISTINCT run_id, feed_id FROM log WHERE status = 'completed' AND phase <> 'priority_active')
        SELECT r.run_id, sum(CASE WHEN dn.run_id IS NOT NULL THEN coalesce(n.c, 0) ELSE f.feed_id * 10 END)::BIGINT AS total FROM (SELECT DISTINCT run_id FROM log) r CROSS JOIN feeds f
        LEFT JOIN dn ON dn.run_id = r.run_id AND dn.feed_id = f.feed_id LEFT JOIN n ON n.feed_id = f.feed_id GROUP BY r.run_id""", "products", "feeds"),
    "u21_refresh_feed": with_views(
        f"SELECT {_COLS} FROM products p WHERE NOT EXISTS (SELECT 1 FROM updates u WHERE {_KEY} AND u.feed_id = 8) UNION ALL SELECT {_COLS} FROM updates WHERE feed_id = 8", "products", "updates"),
}
