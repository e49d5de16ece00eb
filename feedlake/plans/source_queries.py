"""A, S, M and T operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.operators import mapping
from feedlake.sources import readers, tables
from feedlake.streaming import jobs
from feedlake.plans.views import frame, with_views


def _heads(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    i = F.col("event_id")
    head = F.when(i % 7 == 0, F.concat(F.lit("<offer id='"), i, F.lit("'/>"))).when(i % 7 == 1, F.concat(F.lit('{"id":'), i, F.lit("}\n{}"))).when(i % 7 == 2, F.concat(F.lit('{"id":'), i, F.lit("\n}"))).when(
        i % 7 == 3, F.concat(F.lit("a;b;"), i)).when(i % 7 == 4, F.concat(F.lit('"x,y,z"\t'), i)).when(i % 7 == 5, F.concat(F.lit("["), i, F.lit("]"))).otherwise(F.concat(F.lit("a,b|"), i))
    return e.select("event_id", readers.classify_text(head).alias("format"))


def _urls(s, d):
    p = frame(s, d, "links")
    i = F.col("page_id")
    url = F.when(i % 4 == 0, F.concat(F.col("url"), F.lit("/format/xml/z"))).when(i % 4 == 1, F.concat(F.lit("http://a.example.com/f.csv.gz?x="), i)).when(i % 4 == 2, F.concat(F.lit("http://a.example.com/?format=json&x="), i)).otherwise("http://a.example.com/feed.ndjson")
    return p.select("page_id", readers.format_from_url(url).alias("format"))


def _feed_columns(s, d):
    """A registry made from the suppliers: every feed has some of nine columns."""
    names = ["aw_product_id", "product_name", "old_price", "price", "deep_link", "brand_name", "image_url", "category", "x_currency"]
    sup = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("feed_id"))
    listed = sup.select("feed_id", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("k", "column")).where((F.col("feed_id") + F.col("k")) % 4 != 0)
    per = listed.groupBy("feed_id").agg(F.array_sort(F.collect_list(F.struct("k", "column"))).alias("l"))
    return per.select("feed_id", F.size("l").alias("columns"), F.posexplode("l").alias("position", "x")).select("feed_id", "x.column", "position", "columns")


PATTERNS = (
    ("id", 0, "suffix", "_id"), ("title", 1, "exact", "product_name"), ("title", 1, "contains", "name"), ("price", 2, "exact", "price"), ("price", 2, "contains", "price"), ("price", 2, "exclude", "old_"),
    ("old_price", 3, "exact", "old_price"), ("affiliate_link", 4, "contains", "link"), ("brand", 5, "prefix", "brand"), ("image", 6, "contains", "image"), ("currency", 7, "suffix", "currency"),
)
SIGNATURES = (("n", "url", "feed7", 20), ("n", "prefix", "aw_", 20), ("m", "field", "price", 20), ("m", "field", "category", 20), ("o", "field", "image_url", 15), ("google_shopping", "field", "price", 30),
              ("google_shopping", "field", "category", 30), ("google_shopping", "field", "brand_name", 30), ("google_shopping", "field", "image_url", 30), ("google_shopping", "field", "zzz", 30))
WEIGHTS = (("id", 100), ("title", 95), ("price", 90), ("old_price", 80), ("affiliate_link", 95), ("brand", 75))


def patterns(s):
    return s.createDataFrame(list(PATTERNS), "standard string, rank int, kind string, pattern string")


def _scored(s, d):
    return mapping.score_candidates(_feed_columns(s, d), patterns(s))


def _networks(s, d):
    feeds = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("feed_id"), F.concat(F.lit("http://FEED"), F.col("s_suppkey") % 9, F.lit(".example.com")).alias("url"))
    signatures = s.createDataFrame(list(SIGNATURES), "network string, kind string, value string, boost int")
    return mapping.detect_network(_feed_columns(s, d), feeds, signatures)


def _best(s, d):
    """The best candidate of each field, for M6 and M7."""
    return _scored(s, d).groupBy("feed_id", "standard").agg(F.max_by("column", "score").alias("column"))


def _stored(s, d):
    return _best(s, d).where("feed_id % 5 <> 0").withColumn("column", F.concat(F.lit("old_"), F.col("column")))


def beats(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select((F.col("event_id") % 40).alias("run_id"), F.when(F.col("event_id") % 40 % 2 == 0, "full").otherwise("active_only").alias("mode"), "ts", (F.col("event_id") % 100).alias("processed_rows"))


def _stalled(s, d):
    b = beats(s, d)
    now = b.agg(F.max("ts")).first()[0]
    return jobs.stalled_runs(b, F.lit(now) + F.expr("INTERVAL 60 SECONDS"))


def _latest(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("id"), F.col("event_id").alias("v"), "ts")
    return jobs.stream_latest(e).select("id", "v", F.unix_timestamp("ts").alias("at"))


_PROFILED = ("aw_product_id", "product_name", "price", "sale_price", "colour", "large_image", "availability")
#: What the products fill of the feeds' columns.
_FILLED = {"aw_product_id": "external_id", "product_name": "product_name", "old_price": "original_price", "price": "price", "deep_link": "''", "brand_name": "brand", "image_url": "image_url", "category": "category", "x_currency": "''"}


def _repaired(s, d):
    best = _scored(s, d).groupBy("feed_id", "standard").agg(F.max_by("column", F.struct("score", -F.col("position"))).alias("column"))
    rates = mapping.fill_rates(frame(s, d, "products").selectExpr(*[f"{e} AS {c}" for c, e in _FILLED.items()]))
    return mapping.repair_mapping(best, rates, _scored(s, d)).select("feed_id", "standard", "column")


def _post_lists(s, d):
    """The documents of the posts, taken apart again."""
    refs = frame(s, d, "refs").select("post_id", "product_id")
    docs = tables.to_jsonld(tables.post_products(refs, frame(s, d, "products")), "post_id", ["external_id"])
    items = F.from_json("jsonld", "itemListElement array<struct<position:int,item:struct<name:string,sku:string,offers:struct<price:string>>>>")["itemListElement"]
    listed = lambda f: F.array_join(F.transform("i", f), "|")
    return docs.select("post_id", items.alias("i")).select(
        "post_id", F.size("i").alias("items"), listed(lambda x: x["item"]["sku"]).alias("skus"), listed(lambda x: x["item"]["name"]).alias("names"), listed(lambda x: x["item"]["offers"]["price"]).alias("prices"))


QUERIES = {
    "a7_classify": _heads,
    "a8_format_from_url": _urls,
    "a12_count_items": lambda s, d: readers.count_items(frame(s, d, "products"), F.col("feed_id")),
    "a13_profile_feed": lambda s, d: readers.profile_feeds(frame(s, d, "raw_feed").select((F.col("k") % 40).alias("feed_id"), *_PROFILED), "feed_id"),
    "s3_compact_log": lambda s, d: tables.compact_log(s.read.parquet(f"{d}/events.parquet").select((F.col("event_id") % 300).cast("string").alias("id"), F.col("event_id").alias("seq"))),
    "s4_listed_nodes": lambda s, d: tables.listed_nodes(frame(s, d, "products"), "feed_id", ["external_id"]).select("feed_id", "external_id", "position", F.col("shown").cast("long").alias("shown")),
    "s4_jsonld": _post_lists,
    "m1_detect_network": _networks,
    "m2_network_from_url": lambda s, d: frame(s, d, "links").select("page_id", mapping.network_from_url(F.col("url"), [("blog.", "b"), (".com", "c"), ("example", "e")]).alias("network")),
    "m3_score_candidates": _scored,
    "m4_learn_mapping": lambda s, d: mapping.learn_mapping(_scored(s, d)),
    "m5_fill_rates": lambda s, d: mapping.fill_rates(frame(s, d, "raw_feed").select("aw_product_id", "price", "sale_price", "colour")),
    "m5_repair_mapping": _repaired,
    "m6_validate_mapping": lambda s, d: mapping.validate_mapping(_best(s, d)).withColumn("valid", F.col("valid").cast("int")),
    "m7_mapping_confidence": lambda s, d: mapping.mapping_confidence(_best(s, d), s.createDataFrame(list(WEIGHTS), "standard string, weight int")),
    "m8_apply_mapping": lambda s, d: mapping.apply_mapping(frame(s, d, "raw_feed"), {"id": "product_id", "title": "title", "none": "x.y"}).select("raw_k", "id", "title", "none"),
    "m9_schema_drift": lambda s, d: mapping.schema_drift(_feed_columns(s, d).where("position < 4"), _feed_columns(s, d).where("position > 0")).withColumn("drifted", F.col("drifted").cast("int")),
    "m10_remap_feeds": lambda s, d: mapping.remap_feeds(_stored(s, d), _best(s, d), mapping.schema_drift(_feed_columns(s, d).where("position < 4"), _feed_columns(s, d).where("position > 0 or feed_id % 3 = 0"))),
    "m14_relearn_all": lambda s, d: mapping.relearn_all(_feed_columns(s, d), patterns(s))[1],
    "m12_product_id": lambda s, d: (lambda r: r.select("k", mapping.product_id(r, ["nope", "aw_product_id", "product_id"]).alias("id")))(frame(s, d, "raw_feed")),
    "t2_latest": _latest,
    "t4_stalled_runs": _stalled,
    "t5_throughput": lambda s, d: jobs.throughput(beats(s, d)).select("run_id", F.unix_timestamp("window_start").alias("window_start"), "rows"),
}

_COLS = """cols AS (SELECT feed_id, col AS "column", (row_number() OVER (PARTITION BY feed_id ORDER BY k) - 1)::INT AS position, (count(*) OVER (PARTITION BY feed_id))::INT AS columns
  FROM (SELECT s_suppkey AS feed_id, col, k FROM supplier, (VALUES ('aw_product_id', 0), ('product_name', 1), ('old_price', 2), ('price', 3), ('deep_link', 4), ('brand_name', 5), ('image_url', 6), ('category', 7), ('x_currency', 8)) v(col, k)) t WHERE (feed_id + k) % 4 <> 0)"""
_PATTERNS = "pat(standard, rank, kind, pattern) AS (VALUES " + ", ".join(str(p) for p in PATTERNS) + ")"
_SCORED = f"""{_COLS}, {_PATTERNS}, hits AS (SELECT DISTINCT feed_id, "column", position, columns, standard, rank, kind FROM cols JOIN pat ON CASE kind WHEN 'exact' THEN "column" = pattern
  WHEN 'prefix' THEN starts_with("column", pattern) WHEN 'suffix' THEN ends_with("column", pattern) AND instr("column", pattern) = length("column") - length(pattern) + 1 ELSE contains("column", pattern) END),
  scored AS (SELECT feed_id, standard, rank, "column", position, round(sum(CASE kind WHEN 'exact' THEN 100 WHEN 'contains' THEN 80 WHEN 'exclude' THEN -50 ELSE 75 END) + (columns - position) / columns::DOUBLE * 10, 6) AS score
  FROM hits GROUP BY feed_id, standard, rank, "column", position, columns HAVING score > 30)"""
#: M4 step by step: the best unused column of each standard field, in rank order.
_RANKS = sorted({rank for _, rank, _, _ in PATTERNS})
_LEARNED = _SCORED + "".join(
    f""",\n  a{r} AS (SELECT feed_id, standard, "column", score FROM scored s WHERE rank = {r}"""
    + "".join(f' AND NOT EXISTS (SELECT 1 FROM a{q} WHERE a{q}.feed_id = s.feed_id AND a{q}."column" = s."column")' for q in _RANKS if q < r)
    + " QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY score DESC, position) = 1)" for r in _RANKS
) + ", learned AS (" + " UNION ALL ".join(f"SELECT * FROM a{r}" for r in _RANKS) + ")"
_SIG = "sig(network, kind, value, boost) AS (VALUES " + ", ".join(str(p) for p in SIGNATURES) + ")"
ORACLE_SQL = {
    "a7_classify": "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'xml' WHEN 1 THEN 'json_lines' WHEN 2 THEN 'json' WHEN 3 THEN 'ssv' WHEN 4 THEN 'tsv' WHEN 5 THEN 'json' ELSE 'csv' END AS format FROM events",
    "a8_format_from_url": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'xml' WHEN 1 THEN 'csv' WHEN 2 THEN 'json' ELSE 'json_lines' END AS format FROM pages",
    "a12_count_items": with_views("SELECT feed_id AS feed, count(*) AS items FROM products GROUP BY feed_id", "products"),
    "s3_compact_log": "SELECT cast(m AS string) AS id, max(event_id) AS seq FROM (SELECT event_id % 300 AS m, event_id FROM events) WHERE m <> 0 GROUP BY m",
    "s4_listed_nodes": with_views("SELECT feed_id, external_id, (row_number() OVER (PARTITION BY feed_id ORDER BY external_id))::INT AS position, price AS shown FROM products WHERE product_name <> '' AND image_url <> '' AND affiliate_link <> '' AND currency <> '' AND price > 0", "products"),
    "m1_detect_network": f"""WITH {_COLS}, {_SIG}, u AS (SELECT s_suppkey AS feed_id, 'http://feed' || (s_suppkey % 9) || '.example.com' AS url FROM supplier),
      a AS (SELECT feed_id, network, sum(boost)::DOUBLE AS p, 1 AS linked, 0 AS f FROM u JOIN sig ON kind = 'url' AND contains(url, value) GROUP BY ALL),
      w AS (SELECT network, count(*) AS n, max(boost) AS b FROM sig WHERE kind = 'field' GROUP BY network),
      b AS (SELECT feed_id, network, count(DISTINCT value) / w.n::DOUBLE * w.b AS p, 0 AS linked, count(DISTINCT value) AS f FROM cols JOIN sig ON kind = 'field' AND "column" = value JOIN w USING (network) GROUP BY feed_id, network, w.n, w.b),
      c AS (SELECT feed_id, network, least(count(DISTINCT "column") * 5, max(boost))::DOUBLE AS p, 0 AS linked, 0 AS f FROM cols JOIN sig ON kind = 'prefix' AND starts_with("column", value) GROUP BY feed_id, network),
      e AS (SELECT feed_id, network, sum(p) AS score, max(linked) AS linked, max(f) AS f FROM (FROM a UNION ALL FROM b UNION ALL FROM c) GROUP BY ALL),
      t AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY score DESC, network) = 1), s AS (SELECT feed_id FROM e WHERE network = 'google_shopping' AND f >= 4)
      SELECT t.feed_id, CASE WHEN s.feed_id IS NOT NULL AND linked = 0 THEN 'google_shopping' ELSE network END AS network, round(score, 6) AS score FROM t LEFT JOIN s USING (feed_id)""",
    "m2_network_from_url": "SELECT page_id, CASE WHEN contains(lower(url), 'blog.') THEN 'b' WHEN contains(lower(url), '.com') THEN 'c' WHEN contains(lower(url), 'example') THEN 'e' END AS network FROM pages",
    "m3_score_candidates": f"WITH {_SCORED} SELECT * FROM scored",
    "a13_profile_feed": with_views(" UNION ALL ".join(
        f"SELECT k % 40 AS feed, '{c}' AS \"column\", {i} AS position, {len(_PROFILED)} AS columns, min(nullif(trim({c}), '')) AS sample, count(nullif(trim({c}), '')) AS filled FROM raw_feed GROUP BY k % 40" for i, c in enumerate(_PROFILED)), "raw_feed"),
    "s4_jsonld": with_views(
        """WITH a AS (SELECT DISTINCT post_id, product_id AS external_id FROM refs), b AS (SELECT * FROM products QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY (status <> 'active')::INT, feed_id) = 1),
        n AS (SELECT post_id, external_id, product_name, price FROM a JOIN b USING (external_id) WHERE trim(product_name) <> '' AND trim(image_url) <> '' AND trim(affiliate_link) <> '' AND trim(currency) <> '' AND price > 0)
        SELECT post_id, count(*)::INT AS items, string_agg(external_id, '|' ORDER BY external_id) AS skus, string_agg(trim(product_name), '|' ORDER BY external_id) AS names,
          string_agg(printf('%.2f', price::DOUBLE), '|' ORDER BY external_id) AS prices FROM n GROUP BY post_id""", "products", "refs"),
    "m4_learn_mapping": f"WITH {_LEARNED} SELECT * FROM learned",
    "m14_relearn_all": f"""WITH {_LEARNED}, p AS (SELECT feed_id, count(*) FILTER (standard IN ('id', 'title', 'price', 'affiliate_link')) AS n FROM learned GROUP BY feed_id)
      SELECT count(*) AS feeds, count(*) FILTER (coalesce(n, 0) < 4) AS errors FROM (SELECT DISTINCT feed_id FROM cols) LEFT JOIN p USING (feed_id)""",
    "m5_repair_mapping": with_views(
        f"""WITH {_SCORED}, best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY feed_id, standard ORDER BY score DESC, position) = 1), filled(c) AS (SELECT unnest(list_value({', '.join(f"CASE WHEN (SELECT count(*) FROM products WHERE length(trim(cast({e} AS VARCHAR))) > 0) > 0 THEN '{c}' END" for c, e in _FILLED.items())}))),
        spare AS (SELECT feed_id, standard, "column" FROM scored s WHERE "column" IN (SELECT c FROM filled WHERE c IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM best b WHERE b.feed_id = s.feed_id AND b."column" = s."column")
          QUALIFY row_number() OVER (PARTITION BY feed_id, standard ORDER BY score DESC, position) = 1)
        SELECT b.feed_id, b.standard, CASE WHEN b."column" IN (SELECT c FROM filled WHERE c IS NOT NULL) THEN b."column" ELSE coalesce(s."column", b."column") END AS "column" FROM best b LEFT JOIN spare s USING (feed_id, standard)""", "products"),
    "m5_fill_rates": with_views(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (length(trim({c})) > 0) AS filled, count(*) AS rows FROM raw_feed" for c in ("aw_product_id", "price", "sale_price", "colour")), "raw_feed"),
    "m6_validate_mapping": f"""WITH {_SCORED}, s AS (SELECT feed_id, list(DISTINCT standard) AS l FROM scored GROUP BY feed_id)
      SELECT feed_id, array_to_string(list_filter(['id', 'title', 'price', 'affiliate_link'], lambda x: NOT list_contains(l, x)), '|') AS missing, (len(list_filter(['id', 'title', 'price', 'affiliate_link'], lambda x: NOT list_contains(l, x))) = 0)::INT AS valid FROM s""",
    "m7_mapping_confidence": f"""WITH {_SCORED}, w(standard, weight) AS (VALUES {', '.join(str(x) for x in WEIGHTS)})
      SELECT feed_id, round(sum(weight)::DOUBLE / (SELECT sum(weight) FROM w)::DOUBLE * 100, 6) AS confidence FROM (SELECT DISTINCT feed_id, standard FROM scored) JOIN w USING (standard) GROUP BY feed_id""",
    "m8_apply_mapping": with_views("SELECT k AS raw_k, product_id AS id, title, NULL AS none FROM raw_feed", "raw_feed"),
    "m9_schema_drift": f"""WITH {_COLS}, o AS (SELECT feed_id, list("column") AS o FROM cols WHERE position < 4 GROUP BY feed_id), n AS (SELECT feed_id, list("column") AS n FROM cols WHERE position > 0 GROUP BY feed_id),
      x AS (SELECT feed_id, (len(list_filter(n, lambda c: NOT list_contains(o, c))) + len(list_filter(o, lambda c: NOT list_contains(n, c)))) / greatest(len(n), len(o))::DOUBLE AS share FROM n JOIN o USING (feed_id))
      SELECT feed_id, round(share, 6) AS share, (share > 0.1)::INT AS drifted FROM x""",
    "m12_product_id": with_views("SELECT k, coalesce(nullif(aw_product_id, ''), product_id) AS id FROM raw_feed", "raw_feed"),
    "t2_latest": "SELECT user_id AS id, event_id AS v, floor(epoch(ts))::BIGINT AS at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "t4_stalled_runs": """WITH b AS (SELECT event_id % 40 AS run_id, CASE WHEN event_id % 40 % 2 = 0 THEN 'full' ELSE 'active_only' END AS mode, max(ts) AS last FROM events GROUP BY ALL),
      i AS (SELECT run_id, mode, (floor(epoch((SELECT max(ts) FROM events)) + 60) - floor(epoch(last)))::BIGINT AS idle_seconds FROM b)
      SELECT * FROM i WHERE idle_seconds > CASE mode WHEN 'full' THEN 90 ELSE 300 END""",
    "t5_throughput": "SELECT event_id % 40 AS run_id, (floor(epoch(ts) / 600) * 600)::BIGINT AS window_start, sum(event_id % 100)::BIGINT AS rows FROM events GROUP BY ALL",
}
