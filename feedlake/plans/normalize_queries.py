"""C1-C32 over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions.values import CURRENCY_CODES
from feedlake.operators import normalize as n
from feedlake.plans.lookup_queries import _BASE, _COLOUR, _SHADE
from feedlake.plans.views import frame, with_views


def raw(s, d):
    return frame(s, d, "raw_feed")


def products(s, d):
    return frame(s, d, "products")


def cents(name):
    return F.round(F.col(name) * 100).cast("long").alias(name)


_CODES = "|".join(CURRENCY_CODES)


def sql_price(c):
    """Price text to a number, as DuckDB text."""
    bare = f"trim(regexp_replace(regexp_replace({c}, '[€$£¥₹]', '', 'g'), '(?i)\\b({_CODES})\\b', '', 'g'))"
    point = f"CASE WHEN regexp_matches({bare}, '^\\d+,\\d{{2}}$') THEN replace({bare}, ',', '.') ELSE {bare} END"
    number = "'^\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*$'"
    return f"(CASE WHEN regexp_matches({c}, {number}) THEN trim({c})::DOUBLE ELSE coalesce(try_cast(nullif(regexp_extract({point}, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE), 0) END)"


def sql_mapper_price(c):
    bare = f"regexp_replace(regexp_replace({c}, '[€$£¥₹,\\s]', '', 'g'), '(?i)\\b({_CODES})\\b', '', 'g')"
    number = "'^\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*$'"
    return f"(CASE WHEN regexp_matches({c}, {number}) THEN trim({c})::DOUBLE ELSE coalesce(try_cast(nullif(regexp_extract({bare}, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE), 0) END)"


def sql_filled(c):
    return f"(CASE WHEN {c} IS NOT NULL AND {c} <> '' AND {c} <> '0' THEN {c} END)"


def sql_cents(c):
    return f"round(({c}) * 100)::BIGINT"


_P = {c: sql_price(c) for c in ("price", "sale_price", "rrp_price")}
_POS = {c: f"(CASE WHEN {sql_filled(c)} IS NOT NULL AND {_P[c]} > 0 THEN {_P[c]} END)" for c in _P}
_PRICES = f"""b AS (SELECT *, coalesce({_POS['price']}, {_POS['sale_price']}, 0) AS p0, {_P['sale_price']} AS s0, {_P['price']} AS f0, {_P['rrp_price']} AS r0 FROM raw_feed),
  c AS (SELECT *, (s0 > 0 AND f0 > 0 AND s0 < f0) AS swap, coalesce(CASE WHEN {sql_filled('rrp_price')} IS NOT NULL AND r0 > 0 AND r0 > p0 THEN round(r0, 2) END, 0) AS o0 FROM b),
  e AS (SELECT *, CASE WHEN swap THEN s0 ELSE p0 END AS np, CASE WHEN swap THEN f0 ELSE o0 END AS old FROM c)"""
_LEAD = "coalesce(try_cast(nullif(regexp_extract(savings_percent, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1), '') AS DOUBLE), 0)"


def discounted(s, d):
    return n.with_discount(n.with_prices(raw(s, d).withColumnRenamed("price", "price_x").withColumnRenamed("price_x", "price")))


def _limited(s, d):
    e = s.read.parquet(f"{d}/documents.parquet")
    return n.sanitize(e.select("doc_id", F.concat(F.lit("\x01\x00"), "text").alias("product_name"), F.col("lang").alias("currency")), {"product_name": 50, "currency": 1})


def _attributes(s, d):
    found = n.with_attributes(raw(s, d))
    return found.select("k", "attr_color", "attr_size", "attr_gender", "attr_material")


def _networks(s):
    return s.createDataFrame([("a", "http://t.example.com/{program_id}?o={organization_id}&u={url}", "11", "22")], "network string, template string, program_id string, organization_id string")


QUERIES = {
    "c1_price": lambda s, d: n.with_price(raw(s, d), "price", "p").select("k", cents("p")),
    "c2_price_mapper": lambda s, d: n.with_price(raw(s, d), "price", "p", "mapper").select("k", cents("p")),
    "c3_fill_from": lambda s, d: n.fill_from(n.fill_from(raw(s, d).drop("title"), "id"), "title").select("k", "id", "title"),
    "c4_priority": lambda s, d: n.apply_priority(raw(s, d)).select("k", "image_url", "affiliate_link"),
    "c5_merchant": lambda s, d: n.with_merchant(raw(s, d)).select("k", "merchant"),
    "c6_prices": lambda s, d: n.with_prices(raw(s, d)).select("k", cents("price"), cents("old_price")),
    "c7_discount": lambda s, d: discounted(s, d).select("k", cents("price"), cents("old_price"), "discount_percentage"),
    "c8_reconcile": lambda s, d: n.reconcile_prices(
        raw(s, d).select("k", (F.col("k") % 90).cast("string").alias("price"), F.lit("0").alias("old_price"), (F.col("k") % 70).cast("string").alias("sale_price"), (F.col("k") % 40).cast("string").alias("discount_percentage"))
    ).select("k", cents("price"), cents("old_price"), F.col("discount_percentage").cast("long").alias("discount_percentage")),
    "c9_currency": lambda s, d: n.with_currency(raw(s, d).withColumn("feed_id", F.col("k") % 50 + 1), frame(s, d, "feeds")).select("k", "currency"),
    "c10_shipping_text": lambda s, d: n.with_shipping_text(raw(s, d)).select("k", "shipping_text"),
    "c11_clean_text": lambda s, d: n.clean_text(raw(s, d).withColumn("image_url", F.when(F.col("k") % 2 == 0, "x.example.com/a").otherwise("https://y"))).select("k", "title", "product_name", "image_url"),
    "c11_clean_description": lambda s, d: frame(s, d, "links").select("page_id", n.clean_description(F.regexp_replace("html", r"(?s)^.*?<article>", "")).alias("description")),
    "c12_split_lists": lambda s, d: raw(s, d).select("k", F.array_join(n.split_images(F.col("images")), "^").alias("images"), F.array_join(n.split_attributes(F.col("colour")), "^").alias("colours")),
    "c13_images": lambda s, d: n.with_images(raw(s, d).select("k", F.col("merchant_image_url").alias("alternate_image"), F.col("aw_image_url").alias("additional_image_link"), F.array("aw_image_url", F.lit("z")).alias("picture"))).select("k", F.array_join("additional_images", "^").alias("images")),
    "c14_attributes": _attributes,
    "c15_sanitize": _limited,
    "c16_valid_ids": lambda s, d: n.filter_valid_ids(raw(s, d).withColumn("external_id", F.when(F.col("k") % 5 == 0, "  ").when(F.col("k") % 7 == 0, F.repeat(F.lit("é"), 101)).otherwise("x"))).select("k"),
    "c17_product_rows": lambda s, d: n.to_product_rows(raw(s, d).select(F.col("k").cast("string").alias("id"), "title", "merchant_image_url", "aw_image_url", "large_image", "colour", F.lit("12.50").alias("price"), F.lit("yes").alias("in_stock")), 3, "f").select(
        "external_id", "feed_id", "feed_name", "product_name", cents("price"), cents("original_price"), "currency", "image_url", "colour", "in_stock", "status", F.get_json_object("raw_data", "$.aw_image_url").alias("extra")),
    "c18_from_rows": lambda s, d: n.from_product_rows(products(s, d)).select("external_id", "feed_id", F.col("product")["size"].alias("size"), F.col("product")["title"].alias("title"), F.size("product").alias("keys")),
    "c19_search_text": lambda s, d: n.with_search_text(products(s, d)).select("external_id", "feed_id", "search_text"),
    "c19_search_text_bulk": lambda s, d: n.with_search_text(products(s, d), keep_blanks=True).select("external_id", "feed_id", "search_text"),
    "c20_backfill_colour": lambda s, d: n.backfill_colour(products(s, d).withColumns({"colour": F.lit(""), "raw_data": F.concat(F.lit('{"attributes":{"color":["c'), F.col("feed_id"), F.lit('"]}}'))})).select("external_id", "feed_id", "colour"),
    "c21_feed_names": lambda s, d: n.clean_feed_names(products(s, d).withColumn("feed_name", F.concat("feed_name", F.when(F.col("feed_id") % 2 == 0, " (Priorität)").otherwise(" (Priority) x")))).select("external_id", "feed_id", "feed_name"),
    "c22_upgrade_images": lambda s, d: n.upgrade_images(frame(s, d, "links")).select("page_id", "image_url"),
    "c23_strip_size": lambda s, d: products(s, d).select("external_id", "feed_id", n.strip_size(F.col("product_name")).alias("name")),
    "c24_name_colour": lambda s, d: n.split_name_colour(products(s, d)).select("external_id", "feed_id", "base_name", "derived_colour"),
    "c25_category": lambda s, d: n.normalize_category(products(s, d), products(s, d).select(F.lower("brand").alias("brand")).where("brand <> ''").distinct()).select("external_id", "feed_id", "category_path"),
    "c26_display_price": lambda s, d: n.with_display_price(products(s, d).withColumns({"price": F.col("price") / 100, "original_price": F.col("original_price") / 100})).select("external_id", "feed_id", cents("shown_price"), cents("crossed_price"), "percent_off", "price_text"),
    "c27_shop": lambda s, d: n.with_shop(raw(s, d).select("k", F.when(F.col("k") % 3 == 0, "AB12").when(F.col("k") % 3 == 1, "Good Shop").otherwise("").alias("merchant"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("https://www.track.example.com/c?x=1&ued=https%3A%2F%2Fwww.dest"), F.col("k") % 9, F.lit(".example.org%2Fp"))).otherwise("http://www.plain.example.com/p").alias("affiliate_link"))).select("k", "shop"),
    "c28_resolve_prices": lambda s, d: n.resolve_prices(raw(s, d)).select("k", cents("effective_price"), cents("list_price")),
    "c29_variants": lambda s, d: n.with_variants(products(s, d).withColumn("size", F.get_json_object("raw_data", "$.size"))).select("external_id", "feed_id", F.array_join("all_colours", "|").alias("all_colours"), F.array_join("all_sizes", "|").alias("all_sizes")),
    "c30_availability": lambda s, d: n.with_availability(raw(s, d)).select("k", "availability"),
    "c31_prices_keep_equal": lambda s, d: n.with_prices(raw(s, d), keep_equal=True).select("k", cents("price"), cents("old_price")),
    "c32_tracking_link": lambda s, d: n.with_tracking_link(products(s, d).withColumn("network", F.when(F.col("feed_id") % 2 == 0, "a").otherwise("b")), _networks(s)).select("external_id", "feed_id", "tracking_link"),
}

_HOST = "nullif(lower(regexp_replace(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1), '^www\\.', '')), '')"
_TEXT_PARTS = ("product_name", "brand", "feed_name", "category", "colour")
_SIZED = f"'(?i)\\s*[-–]\\s*({n.SIZES})\\s*$'"
ORACLE_SQL = {
    "c1_price": with_views(f"SELECT k, {sql_cents(sql_price('price'))} AS p FROM raw_feed", "raw_feed"),
    "c2_price_mapper": with_views(f"SELECT k, {sql_cents(sql_mapper_price('price'))} AS p FROM raw_feed", "raw_feed"),
    "c3_fill_from": with_views(f"SELECT k, trim(coalesce({sql_filled('aw_product_id')}, {sql_filled('product_id')})) AS id, trim({sql_filled('product_name')}) AS title FROM raw_feed", "raw_feed"),
    "c4_priority": with_views("SELECT k, coalesce(nullif(large_image, ''), nullif(merchant_image_url, ''), nullif(aw_image_url, '')) AS image_url, coalesce(nullif(aw_deep_link, ''), nullif(merchant_deep_link, '')) AS affiliate_link FROM raw_feed", "raw_feed"),
    "c5_merchant": with_views("SELECT k, CASE WHEN merchant_name <> '' AND NOT regexp_matches(merchant_name, '^\\d+$') AND NOT regexp_matches(merchant_name, '(?i)^\\d+[A-Z]+$') THEN merchant_name ELSE program_name END AS merchant FROM raw_feed", "raw_feed"),
    "c6_prices": with_views(f"WITH {_PRICES} SELECT k, {sql_cents('np')} AS price, {sql_cents('old')} AS old_price FROM e", "raw_feed"),
    "c7_discount": with_views(
        f"""WITH {_PRICES}, f AS (SELECT *, coalesce(CASE WHEN {sql_filled('savings_percent')} IS NOT NULL AND {_LEAD} > 0 AND {_LEAD} < 100 THEN round({_LEAD}) END, 0) AS dd FROM e),
        g AS (SELECT *, CASE WHEN dd > 0 AND dd < 100 AND old <= 0 AND np > 0 THEN np / (1 - dd / 100) ELSE old END AS o2 FROM f),
        h AS (SELECT *, CASE WHEN dd <= 0 AND o2 > np AND np > 0 THEN round((o2 - np) / o2 * 100) ELSE dd END AS pc FROM g)
        SELECT k, {sql_cents('np')} AS price, {sql_cents('round(o2, 2)')} AS old_price, CASE WHEN pc > 0 AND pc < 100 THEN pc::BIGINT END AS discount_percentage FROM h""", "raw_feed"),
    "c8_reconcile": with_views(
        f"""WITH a AS (SELECT k, (k % 90)::DOUBLE AS p, 0.0::DOUBLE AS o, (k % 70)::DOUBLE AS s, (k % 40)::DOUBLE AS d FROM raw_feed),
        b AS (SELECT k, s, d, CASE WHEN s > 0 AND o = 0 AND p > s THEN p ELSE o END AS o, CASE WHEN s > 0 AND o = 0 AND p > s THEN s ELSE p END AS p FROM a),
        c AS (SELECT k, s, d, CASE WHEN s > 0 AND p > 0 AND s > p THEN p ELSE o END AS o, CASE WHEN s > 0 AND p > 0 AND s > p THEN s ELSE p END AS p FROM b)
        SELECT k, {sql_cents('p')} AS price, {sql_cents("CASE WHEN NOT (d > 0 AND o > 0 AND p > 0) AND d > 0 AND d < 100 AND p > 0 AND o = 0 THEN round(p / (1 - d / 100), 2) ELSE o END")} AS old_price,
        (CASE WHEN (d > 0 AND o > 0 AND p > 0) OR (d > 0 AND d < 100 AND p > 0 AND o = 0) THEN round(d) WHEN o > p AND p > 0 THEN round((o - p) / o * 100) WHEN d <> 0 THEN d END)::BIGINT AS discount_percentage FROM c""", "raw_feed"),
    "c9_currency": with_views(
        f"""SELECT k, coalesce(nullif(trim(currency), ''), nullif(upper(regexp_extract(price, '(?i)\\b({_CODES})\\b', 1)), ''), nullif(upper(regexp_extract(sale_price, '(?i)\\b({_CODES})\\b', 1)), ''),
        CASE WHEN regexp_matches(f.default_currency, '^[A-Za-z]{{3}}$') THEN upper(f.default_currency) END) AS currency FROM raw_feed r LEFT JOIN feeds f ON f.feed_id = r.k % 50 + 1""", "raw_feed", "feeds"),
    "c10_shipping_text": with_views(
        """SELECT k, CASE k % 6 WHEN 0 THEN 'Shipping costs may apply' WHEN 3 THEN 'Shipping costs may apply' WHEN 4 THEN 'Free Shipping' WHEN 5 THEN 'Shipping: 1,234.50 ' || currency ELSE 'Shipping: 3.49 ' || currency END AS shipping_text FROM raw_feed""", "raw_feed"),
    "c11_clean_text": with_views(
        """SELECT k, regexp_replace(regexp_replace(trim(title), '\\s+', ' ', 'g'), '[™®©]', '', 'g') AS title, regexp_replace(trim(product_name), '\\s+', ' ', 'g') AS product_name,
        CASE WHEN k % 2 = 0 THEN 'http://x.example.com/a' ELSE 'https://y' END AS image_url FROM raw_feed""", "raw_feed"),
    "c11_clean_description": with_views(
        """WITH t AS (SELECT page_id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?<article>', ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>', '', 'g'), ' '), '\\s+', ' ', 'g') AS x FROM links)
        SELECT page_id, CASE WHEN length(x) > 500 THEN substr(x, 1, 497) || '...' ELSE x END AS description FROM t""", "links"),
    "c12_split_lists": with_views("SELECT k, 'a.jpg^b.jpg^c.jpg' AS images, CASE WHEN k % 3 = 0 THEN 'red^blue' ELSE '' END AS colours FROM raw_feed", "raw_feed"),
    "c13_images": with_views("SELECT k, concat_ws('^', nullif(merchant_image_url, ''), aw_image_url, 'z') AS images FROM raw_feed", "raw_feed"),
    "c14_attributes": with_views("SELECT k, nullif(colour, '') AS attr_color, nullif(regexp_extract(param, 'size:(\\d+)', 1), '0') AS attr_size, 'male' AS attr_gender, NULL AS attr_material FROM raw_feed", "raw_feed"),
    "c15_sanitize": "SELECT doc_id, substr(text, 1, 50) AS product_name, substr(lang, 1, 1) AS currency FROM documents",
    "c16_valid_ids": with_views("SELECT k FROM raw_feed WHERE k % 5 <> 0 AND k % 7 <> 0", "raw_feed"),
    "c17_product_rows": with_views(
        """SELECT k::VARCHAR AS external_id, 3 AS feed_id, 'f' AS feed_name, title AS product_name, 1250 AS price, 0 AS original_price, 'EUR' AS currency,
        coalesce(nullif(large_image, ''), nullif(merchant_image_url, ''), aw_image_url) AS image_url, colour, 0 AS in_stock, 'active' AS status, aw_image_url AS extra FROM raw_feed""", "raw_feed"),
    "c18_from_rows": with_views("SELECT external_id, feed_id, json_extract_string(raw_data, '$.size') AS size, product_name AS title, 13 + 1 + (external_id::BIGINT % 2 = 0)::INT AS keys FROM products", "products"),
    "c19_search_text": with_views("SELECT external_id, feed_id, concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in _TEXT_PARTS) + ") AS search_text FROM products", "products"),
    "c19_search_text_bulk": with_views("SELECT external_id, feed_id, concat_ws(' ', " + ", ".join(f"coalesce({c}, '')" for c in _TEXT_PARTS) + ") AS search_text FROM products", "products"),
    "c20_backfill_colour": with_views("SELECT external_id, feed_id, 'c' || feed_id AS colour FROM products", "products"),
    "c21_feed_names": with_views("SELECT external_id, feed_id, CASE WHEN feed_id % 2 = 0 THEN feed_name ELSE feed_name || ' (Priority) x' END AS feed_name FROM products", "products"),
    "c22_upgrade_images": with_views(
        """SELECT page_id, CASE page_id % 6 WHEN 0 THEN replace(image_url, '/preview/', '/large/') WHEN 1 THEN replace(image_url, '/upload/', '/upload/w_1024,q_auto,f_auto/') WHEN 2 THEN replace(image_url, '_small.', '_1024x1024.')
        WHEN 3 THEN replace(image_url, '-300x200', '') WHEN 4 THEN replace(image_url, '100x100', '1024x1024') ELSE image_url END AS image_url FROM links""", "links"),
    "c23_strip_size": with_views(f"SELECT external_id, feed_id, trim(regexp_replace(regexp_replace(product_name, {_SIZED}, ''), '(?i)\\s+[A-Z]\\d{{2,4}}\\s*$', '')) AS name FROM products", "products"),
    "c24_name_colour": with_views(f"SELECT external_id, feed_id, {_BASE} AS base_name, {_SHADE} AS derived_colour FROM products", "products"),
    "c25_category": with_views(
        """WITH b AS (SELECT DISTINCT lower(brand) AS brand FROM products WHERE brand <> ''), p AS (SELECT *, list_filter(list_transform(string_split(category, '>'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM products)
        SELECT external_id, feed_id, array_to_string(CASE WHEN b.brand IS NOT NULL AND len(parts) > 1 THEN parts[:len(parts) - 1] ELSE parts END, ' > ') AS category_path FROM p LEFT JOIN b ON b.brand = lower(parts[-1])""", "products"),
    "c26_display_price": with_views(
        """WITH t AS (SELECT *, CASE WHEN original_price > price THEN original_price END AS crossed FROM products)
        SELECT external_id, feed_id, price AS shown_price, crossed AS crossed_price, round((crossed - price) / crossed::DOUBLE * 100)::BIGINT AS percent_off,
        trim(replace(replace(replace(format('{:,}', price // 100), ',', '.') || ',' || lpad((price % 100)::VARCHAR, 2, '0'), '#', ''), '#', '') || ' ' || CASE WHEN currency = 'EUR' THEN '€' ELSE '' END) AS price_text FROM t""", "products"),
    "c27_shop": with_views(
        "SELECT k, CASE WHEN k % 3 = 1 THEN 'Good Shop' WHEN k % 2 = 0 THEN 'dest' || (k % 9) || '.example.org' ELSE 'plain.example.com' END AS shop FROM raw_feed", "raw_feed"),
    "c28_resolve_prices": with_views(f"SELECT k, {sql_cents('coalesce(nullif(' + _P['sale_price'] + ', 0), nullif(' + _P['price'] + ', 0))')} AS effective_price, {sql_cents('nullif(' + _P['rrp_price'] + ', 0)')} AS list_price FROM raw_feed", "raw_feed"),
    "c29_variants": with_views(
        f"""WITH t AS (SELECT external_id, feed_id, list_concat(CASE WHEN colour = '' THEN [] ELSE [colour] END, regexp_extract_all(product_name, '{_COLOUR}', 1)) AS l, json_extract_string(raw_data, '$.size') AS size FROM products),
        u AS (SELECT external_id, feed_id, size, list_transform(l, lambda c: array_to_string(list_transform(string_split(c, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')) AS l FROM t)
        SELECT external_id, feed_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS all_colours, size AS all_sizes FROM u""", "products"),
    "c30_availability": with_views("SELECT k, CASE WHEN availability = '' THEN 'in stock' ELSE availability END AS availability FROM raw_feed", "raw_feed"),
    "c31_prices_keep_equal": with_views(
        f"WITH {_PRICES} SELECT k, {sql_cents('np')} AS price, {sql_cents('CASE WHEN swap THEN f0 ELSE coalesce(CASE WHEN ' + sql_filled('rrp_price') + ' IS NOT NULL AND r0 > 0 THEN round(r0, 2) END, 0) END')} AS old_price FROM e", "raw_feed"),
    "c32_tracking_link": with_views(
        "SELECT external_id, feed_id, CASE WHEN feed_id % 2 = 0 THEN 'http://t.example.com/11?o=22&u=' || replace(replace(affiliate_link, ':', '%3A'), '/', '%2F') ELSE affiliate_link END AS tracking_link FROM products", "products"),
}
