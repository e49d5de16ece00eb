"""The product-feed tables as views over the driver's tables, in SQL that Spark and DuckDB share.

Spark runs a template with DataFrames in its braces; ``sql`` fills in the plain table names.
Money is in whole cents. Products are aggregated by their keys, on numbers alone, before they meet parts and suppliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "part", "supplier", "events", "documents", "pages")

PRODUCTS = """
SELECT cast(l.l_partkey AS string) AS external_id, l.l_suppkey + 1 AS feed_id, s.s_name AS feed_name,
  p.p_name || CASE l.l_partkey % 5 WHEN 0 THEN ' - L' WHEN 1 THEN ' - EU 42' WHEN 2 THEN ' dark blue' WHEN 3 THEN ' C100' ELSE '' END AS product_name,
  CASE WHEN l.l_partkey % 13 = 0 THEN '' ELSE p.p_brand END AS brand,
  CASE WHEN l.l_partkey % 17 = 0 THEN NULL ELSE 'Catalog > ' || p.p_type || ' > ' || p.p_brand END AS category,
  CASE l.l_partkey % 7 WHEN 0 THEN 'Black' WHEN 1 THEN 'white' WHEN 2 THEN 'Red' WHEN 3 THEN 'blue' ELSE '' END AS colour,
  CASE WHEN l.l_partkey % 11 = 0 THEN '' ELSE 'http://img.example.com/' || cast(l.l_partkey AS string) || '.jpg' END AS image_url,
  CASE WHEN l.l_partkey % 23 = 0 THEN '' ELSE 'http://shop' || cast(l.l_suppkey AS string) || '.example.com/p/' || cast(l.l_partkey AS string) END AS affiliate_link,
  CASE WHEN l.l_partkey % 29 = 0 THEN '' ELSE 'EUR' END AS currency,
  CASE WHEN l.l_partkey % 19 = 0 THEN 0 ELSE cast(floor(p.p_retailprice * 100 * (1 - l.discount) + 0.5) AS bigint) END AS price,
  CASE WHEN l.l_partkey % 3 = 0 THEN 0 ELSE cast(floor(p.p_retailprice * 100 + 0.5) AS bigint) END AS original_price,
  l.in_stock,
  CASE WHEN l.l_partkey % 10 = 3 THEN 'unavailable' WHEN l.listed = 1 THEN 'active' ELSE 'unavailable' END AS status,
  l.shipped AS last_updated,
  '{{"size":"' || cast(p.p_size AS string) || '"' || CASE WHEN l.l_partkey % 2 = 0 THEN ',"item_group_id":"g' || cast(l.l_partkey % 40 AS string) || '"' ELSE '' END || '}}' AS raw_data
FROM (
  SELECT l_partkey, l_suppkey, max(l_discount) AS discount, max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS in_stock,
    max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS listed, max(l_shipdate) AS shipped
  FROM {lineitem} GROUP BY l_partkey, l_suppkey
) l JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
"""
FEEDS = "SELECT s_suppkey + 1 AS feed_id, s_name AS feed_name, CASE WHEN s_suppkey % 2 = 0 THEN 'EUR' ELSE 'x' END AS default_currency FROM {supplier} WHERE s_suppkey % 7 <> 0"
REFS = """
SELECT DISTINCT user_id AS post_id, 'post ' || cast(user_id % 97 AS string) AS title,
  CASE WHEN event_id % 31 = 0 THEN 'x' || cast(event_id % 100 AS string) ELSE cast(event_id % 500 AS string) END AS product_id,
  CASE WHEN event_id % 3 = 0 THEN 'shortcode' ELSE 'block' END AS resolver,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE 'stored ' || cast(event_id % 500 AS string) END AS stored_title, event_id % 1000 AS stored_price
FROM {events}
"""
UPDATES = """
SELECT external_id, feed_id, feed_name, product_name, brand, category, colour, image_url, affiliate_link, currency, price, original_price, in_stock, status, last_updated, raw_data
FROM (SELECT cast(e.event_id % 900 AS string) AS external_id, e.event_id % 50 + 1 AS feed_id, 'feed ' || cast(e.event_id % 50 + 1 AS string) AS feed_name,
  'update ' || cast(e.event_id AS string) AS product_name, 'Brand#1' AS brand, 'New' AS category, '' AS colour, '' AS image_url, 'http://u.example.com' AS affiliate_link, 'EUR' AS currency,
  cast(e.event_id % 10000 AS bigint) AS price, cast(0 AS bigint) AS original_price, 1 AS in_stock, 'active' AS status, e.ts AS last_updated, '{{}}' AS raw_data,
  row_number() OVER (PARTITION BY e.event_id % 900, e.event_id % 50 ORDER BY e.event_id DESC) AS n FROM {events} e) u WHERE n = 1
"""
RAW_FEED = """
SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE cast(p_partkey AS string) END AS aw_product_id, 'P' || cast(p_partkey AS string) AS product_id,
  CASE WHEN p_partkey % 8 = 0 THEN '0' ELSE '  ' || p_name || '  ' END AS product_name, p_name || '  (TM) ' || p_type AS title,
  CASE p_partkey % 6 WHEN 0 THEN cast(p_partkey AS string) || ',50 EUR' WHEN 1 THEN '$' || cast(p_partkey AS string) || '.25' WHEN 2 THEN '' WHEN 3 THEN cast(p_partkey % 300 AS string) || ',75'
    WHEN 4 THEN 'USD ' || cast(p_partkey AS string) ELSE '1,' || cast(100 + p_partkey % 900 AS string) || '.56' END AS price,
  CASE p_partkey % 4 WHEN 0 THEN cast(p_partkey % 200 AS string) ELSE '' END AS sale_price,
  CASE p_partkey % 3 WHEN 0 THEN cast(p_partkey + 40 AS string) || '.10' WHEN 1 THEN '0' ELSE '12.00' END AS rrp_price,
  CASE p_partkey % 5 WHEN 0 THEN '25 %' WHEN 1 THEN '150' WHEN 2 THEN '0' ELSE '' END AS savings_percent,
  CASE p_partkey % 4 WHEN 0 THEN '12345' WHEN 1 THEN '99AB' WHEN 2 THEN 'Shop ' || p_brand ELSE '' END AS merchant_name, 'Program ' || p_brand AS program_name,
  CASE p_partkey % 3 WHEN 0 THEN 'http://m.example.com/' || cast(p_partkey AS string) ELSE '' END AS merchant_image_url, 'http://t.example.com/' || cast(p_partkey AS string) AS aw_image_url,
  CASE WHEN p_partkey % 10 = 0 THEN 'http://l.example.com/' || cast(p_partkey AS string) ELSE '' END AS large_image,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'http://track.example.com/?ued=' || cast(p_partkey AS string) END AS aw_deep_link, 'http://direct.example.com/' || cast(p_partkey AS string) AS merchant_deep_link,
  CASE p_partkey % 6 WHEN 0 THEN '0' WHEN 1 THEN '3.49' WHEN 2 THEN 'DE::Ground:3.49' WHEN 3 THEN 'free' WHEN 4 THEN '0.00' ELSE '1234.5' END AS shipping,
  CASE WHEN p_partkey % 2 = 0 THEN 'EUR' ELSE '' END AS currency, 'size:' || cast(p_size AS string) || '|gender:male|note:a:b' AS param,
  CASE WHEN p_partkey % 3 = 0 THEN 'red, blue' ELSE '' END AS colour, 'a.jpg| b.jpg;;c.jpg,0' AS images, p_brand AS brand_name, p_brand AS brand, p_type AS category,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'no' END AS availability
FROM {part}
"""
LINKS = """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://images.productserve.com/preview/' || cast(page_id AS string) || '.jpg'
  WHEN 1 THEN 'https://res.cloudinary.com/demo/image/upload/v1/' || cast(page_id AS string) || '.png'
  WHEN 2 THEN 'https://cdn.shopify.com/s/files/shoe_small.jpg?v=' || cast(page_id AS string) WHEN 3 THEN 'https://x.example.com/wp-content/uploads/a-300x200.png'
  WHEN 4 THEN 'https://cdn11.bigcommerce.com/s-1/images/stencil/100x100/p.jpg' ELSE url END AS image_url, url, html FROM {pages}
"""
#: Rows of lineitem that one task aggregates to products; a table of more rows is dealt to more tasks.
ROWS_A_TASK = 500_000
VIEWS = {"products": PRODUCTS, "feeds": FEEDS, "refs": REFS, "updates": UPDATES, "raw_feed": RAW_FEED, "links": LINKS}


def _by_part(lineitem: DataFrame) -> DataFrame:
    """lineitem dealt by its parts, so that a task's share stays the same however large the table is. Hardly two rows have a
    key of products in common, so aggregating them before the shuffle would hold a whole split in memory for nothing; products
    then meet their parts where they are.
    """
    tasks = max(lineitem.sparkSession.sparkContext.defaultParallelism, lineitem.count() // ROWS_A_TASK + 1)
    return lineitem.repartition(tasks, "l_partkey")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    template = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in template}
    if "lineitem" in used:
        used["lineitem"] = _by_part(used["lineitem"])
    return spark.sql(template, **used)


def with_views(query: str, *names: str) -> str:
    """DuckDB text: the named views in front of a query."""
    plain = {t: t for t in TABLES}
    views = [f"{n} AS ({VIEWS[n].format(**plain)})" for n in names]
    body = query.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(views) + ",\n" + body[5:]
    return "WITH " + ",\n".join(views) + "\n" + body
