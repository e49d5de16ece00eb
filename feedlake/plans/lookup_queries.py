"""J1-J12 over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.operators import lookups
from feedlake.operators.normalize import COLOUR_PHRASES, SIZES
from feedlake.plans.views import frame, with_views


def products(s, d):
    return frame(s, d, "products")


def refs(s, d):
    return frame(s, d, "refs")


def ids(s, d):
    return refs(s, d).select("product_id")


def posts(s, d):
    content = F.concat(
        F.lit('<!-- wp:shop/cards {"selectedProducts":[{"id":"'), F.col("product_id"), F.lit('","x":{"y":1}},{"id":"a'), F.col("post_id").cast("string"),
        F.lit('"}],"productIds":"7, 8"} /--> text [shop-cards ids="'), F.col("product_id"), F.lit(',9"] end'),
    )
    return refs(s, d).select("post_id", "title", content.alias("post_content"))


def second_source(s, d):
    return frame(s, d, "updates").select("external_id", "feed_id", "product_name", "status")


_BEST = "SELECT * FROM products QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY CASE WHEN status = 'active' THEN 0 ELSE 1 END, feed_id) = 1"
_SIZELESS = f"regexp_replace(regexp_replace(product_name, '(?i)\\s*[-–—]\\s*({SIZES})\\s*$', ''), '(?i)\\s+[A-Z]\\d{{2,4}}\\s*$', '')"
_PHRASES = "(?i)(" + "|".join(p.replace(" ", "\\s+") for p in sorted((p for p in COLOUR_PHRASES if p.isascii()), key=len, reverse=True)) + ")"
_COLOUR = _PHRASES.replace("(?i)(", "(?i)\\b(") + "\\b"
_BASE = f"lower(regexp_replace(regexp_replace(regexp_replace({_SIZELESS}, '{_COLOUR}', '', 'g'), '\\s+', ' ', 'g'), '^[\\s\\-,.]+|[\\s\\-,.]+$', '', 'g'))"
_SHADE = f"nullif(trim(regexp_replace(regexp_extract({_SIZELESS}, '{_COLOUR}', 1), '\\s+', ' ', 'g')), '')"
_SIBLINGS = f"""
WITH rows AS (SELECT feed_id, external_id, product_name, in_stock, nullif(trim(lower(colour)), '') AS own, coalesce(nullif(trim(lower(colour)), ''), lower({_SHADE})) AS shade,
   'item_group_id=' || nullif(json_extract_string(raw_data, '$.item_group_id'), '') AS grp, {_BASE} AS base FROM products WHERE status = 'active'),
e AS (SELECT 0 AS strategy, a.feed_id, a.external_id AS for_id, b.external_id, b.in_stock, b.own AS colour, a.own AS mine FROM rows a JOIN rows b ON a.feed_id = b.feed_id AND a.grp = b.grp WHERE b.own IS NOT NULL
  UNION ALL SELECT 1, a.feed_id, a.external_id, b.external_id, b.in_stock, b.own, a.own FROM rows a JOIN rows b ON a.feed_id = b.feed_id AND a.product_name = b.product_name WHERE a.grp IS NULL AND b.own IS NOT NULL
  UNION ALL SELECT 2, a.feed_id, a.external_id, b.external_id, b.in_stock, b.shade, a.shade FROM rows a JOIN rows b ON a.feed_id = b.feed_id AND a.base = b.base WHERE a.grp IS NULL AND length(a.base) >= 4 AND b.shade IS NOT NULL),
w AS (SELECT feed_id, for_id, min(strategy) AS strategy FROM (SELECT strategy, feed_id, for_id FROM e GROUP BY ALL HAVING count(DISTINCT colour) >= 2) GROUP BY ALL),
c AS (SELECT e.* FROM e JOIN w USING (strategy, feed_id, for_id) QUALIFY row_number() OVER (PARTITION BY feed_id, for_id, colour ORDER BY CASE WHEN in_stock = 1 THEN 0 ELSE 1 END, external_id) = 1)
SELECT feed_id, for_id, strategy, (row_number() OVER (PARTITION BY feed_id, for_id ORDER BY CASE WHEN colour IS NOT DISTINCT FROM mine THEN 0 ELSE 1 END, colour))::INT AS position, external_id, colour FROM c
"""


def _siblings(s, d):
    rows = products(s, d)
    return lookups.colour_siblings(rows, rows.select("feed_id", "external_id"))


QUERIES = {
    "j1_resolve": lambda s, d: lookups.resolve(ids(s, d), products(s, d)).select("external_id", "feed_id", "status", "product_name", "price"),
    "j2_fetch": lambda s, d: lookups.fetch(ids(s, d), products(s, d)).select("external_id", "feed_id", "status", "price"),
    "j3_resolve_multi": lambda s, d: lookups.resolve_multi(ids(s, d), [products(s, d).select("external_id", "feed_id", "product_name", "status"), second_source(s, d)]),
    "j4_available_sizes": lambda s, d: lookups.available_sizes(products(s, d)).withColumn("sizes", F.array_join("sizes", "|")),
    "j5_j8_colour_siblings": _siblings,
    "j9_extract_refs": lambda s, d: lookups.extract_refs(posts(s, d), "shop/cards"),
    "j10_resolve_cards": lambda s, d: lookups.resolve_cards(refs(s, d), products(s, d)),
    "j11_refresh_refs": lambda s, d: lookups.refresh_refs(refs(s, d), products(s, d)),
    "j12_rename_marker": lambda s, d: lookups.rename_marker(posts(s, d), "shop/cards", "store/cards"),
}

_CONTENT = """'<!-- wp:shop/cards {"selectedProducts":[{"id":"' || product_id || '","x":{"y":1}},{"id":"a' || post_id || '"}],"productIds":"7, 8"} /--> text [shop-cards ids="' || product_id || ',9"] end'"""
ORACLE_SQL = {
    "j1_resolve": with_views(f"SELECT external_id, feed_id, status, product_name, price FROM ({_BEST}) WHERE external_id IN (SELECT product_id FROM refs)", "products", "refs"),
    "j2_fetch": with_views("SELECT external_id, feed_id, status, price FROM products WHERE external_id IN (SELECT product_id FROM refs)", "products", "refs"),
    "j3_resolve_multi": with_views(
        """WITH u AS (SELECT external_id, feed_id, product_name, status, 0 AS source_rank FROM products
          UNION ALL SELECT external_id, feed_id, product_name, status, 1 FROM updates)
        SELECT * FROM u WHERE external_id IN (SELECT product_id FROM refs)
        QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY source_rank, CASE WHEN status = 'active' THEN 0 ELSE 1 END, feed_id) = 1""", "products", "refs", "updates"),
    "j4_available_sizes": with_views(
        """WITH x AS (SELECT DISTINCT product_name, colour, json_extract_string(raw_data, '$.size') AS size FROM products WHERE status = 'active')
        SELECT product_name, colour, string_agg(size, '|' ORDER BY size::DOUBLE) AS sizes FROM x WHERE size <> '0' AND size <> '' GROUP BY ALL""", "products"),
    "j5_j8_colour_siblings": with_views(_SIBLINGS, "products"),
    "j9_extract_refs": with_views(
        """SELECT DISTINCT post_id, title, product_id, resolver FROM (
          SELECT post_id, title, product_id, 'block' AS resolver FROM refs UNION ALL SELECT post_id, title, 'a' || post_id, 'block' FROM refs
          UNION ALL SELECT post_id, title, x, 'block' FROM refs, (VALUES ('7'), ('8')) v(x)
          UNION ALL SELECT post_id, title, product_id, 'shortcode' FROM refs UNION ALL SELECT post_id, title, '9', 'shortcode' FROM refs)""", "refs"),
    "j10_resolve_cards": with_views(
        f"""SELECT r.post_id, r.product_id, CASE WHEN b.status = 'active' THEN 'resolved' WHEN b.status IS NOT NULL THEN 'unavailable' WHEN r.stored_title <> '' THEN 'fallback' ELSE 'missing' END AS state,
        coalesce(b.product_name, r.stored_title) AS title FROM refs r LEFT JOIN ({_BEST}) b ON r.product_id = b.external_id""", "products", "refs"),
    "j11_refresh_refs": with_views(
        f"""SELECT r.post_id, r.product_id, coalesce(nullif(b.product_name, ''), r.stored_title) AS title, coalesce(nullif(b.price, 0), r.stored_price) AS price
        FROM refs r LEFT JOIN ({_BEST}) b ON r.product_id = b.external_id""", "products", "refs"),
    "j12_rename_marker": with_views(f"SELECT post_id, title, replace({_CONTENT}, 'wp:shop/cards', 'wp:store/cards') AS post_content FROM refs", "refs"),
}
