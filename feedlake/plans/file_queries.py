"""Readers, sinks and streams over files that Spark writes from the given tables into the shared folder.

The files of a query are read when its result is, so they stay there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedlake.functions.staging import shared_folder
from feedlake.operators import catalog, mapping
from feedlake.plans.views import frame, with_views
from feedlake.sources import bucketed, manifest, readers, tables
from feedlake.streaming import jobs, resume

_KEEP = ("external_id", "feed_id", "product_name", "price", "original_price", "in_stock", "status", "affiliate_link")
_COLS = ", ".join(_KEEP)
#: Items of one JSON document.
PER_DOCUMENT = 500


def _folder(s) -> str:
    return f"{shared_folder(s)}/feeds-{uuid.uuid4().hex}"


def _raw(s, d):
    """A feed with quotes and line ends in a field."""
    note = F.concat(F.lit('say "'), "title", F.lit('"\nthen, '), "param")
    return frame(s, d, "raw_feed").select(F.col("k").cast("string").alias("id"), "title", note.alias("note"))


def _written(s, d, write):
    folder = _folder(s)
    write(_raw(s, d), folder)
    return folder


def _csv(df, folder, **options):
    df.write.options(header=True, quoteAll=True, escape='"', **options).csv(folder)


def _delimited(s, d):
    return readers.read_delimited(s, _written(s, d, _csv), "csv").select("id", "title", "note")


def _split(s, d):
    return readers.read_delimited(s, _written(s, d, lambda df, f: _csv(df, f, sep=";")), "ssv", split=True).select("id", "title", "note")


def _packed(s, d):
    return readers.read_feed(s, _written(s, d, lambda df, f: _csv(df, f, compression="gzip")), "csv", _folder(s)).select("id", "title", "note")


def _xml(s, d):
    nested = lambda df: df.select(F.col("id").alias("_id"), "title", F.struct(F.col("note").alias("text"), F.lit("DE").alias("country")).alias("info"))
    folder = _written(s, d, lambda df, f: nested(df).write.format("xml").options(rowTag="offer", rootTag="offers").save(f))
    return readers.flatten_xml(readers.read_xml(s, folder)).select("id", "title", F.col("info_text").alias("note"), F.col("info_country").alias("country"))


def _recovered(s, d):
    """Items among text that is no XML."""
    item = F.concat(F.lit("junk & <item><id>"), "id", F.lit("</id><title>"), F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</title></item> < more"))
    return readers.recover_xml(s, _written(s, d, lambda df, f: df.select(item).write.text(f)), "item", "id string, title string")


def _documents(s, d, make):
    """Bounded JSON documents, one a file."""
    def write(df, folder):
        grouped = df.groupBy(F.floor(F.col("id").cast("long") / PER_DOCUMENT).alias("part"))
        grouped.agg(make.alias("value")).write.partitionBy("part").text(folder)

    return f"{_written(s, d, write)}/*"


def _json_doc(s, d):
    whole = F.to_json(F.struct(F.collect_list(F.struct("id", "title", "note")).alias("items"), F.lit(1).alias("version")))
    return readers.read_json_doc(s, _documents(s, d, whole)).select("id", "title", "note")


def _snapshot_json(s, d):
    items = F.map_from_entries(F.collect_list(F.struct("id", F.struct("title", "note"))))
    found = readers.read_snapshot_json(s, _documents(s, d, F.to_json(F.struct(items.alias("items")))))
    return found.select("id", F.get_json_object("product", "$.title").alias("title"), F.get_json_object("product", "$.note").alias("note"))


def _json_lines(s, d):
    return readers.read_json_lines(s, _written(s, d, lambda df, f: df.write.json(f))).select("id", "title", "note")


def _ingested(s, d):
    """Three feeds of three formats, and one that isn't there."""
    folder, rows = _folder(s), _raw(s, d)
    of = lambda k: rows.where(F.col("id").cast("long") % 3 == k)
    _csv(of(0), f"{folder}/a")
    of(1).write.json(f"{folder}/b")
    of(2).write.format("xml").options(rowTag="item", rootTag="feed").save(f"{folder}/c")
    feeds = [{"feed_id": i, "name": n, "path": f"{folder}/{n}", "format": f} for i, n, f in ((1, "a", "csv"), (2, "b", "json_lines"), (3, "c", "xml"), (4, "none", "csv"))]
    found, errors = readers.ingest_feeds(s, feeds, {i: {"key": "id", "name": "title"} for i in (1, 2, 3, 4)}, f"{folder}/landed")
    assert [e[0] for e in errors] == [4]
    return found.select("feed_id", "feed_name", F.col("key").cast("string").alias("key"), "name")


def _products(s, d):
    return frame(s, d, "products")


def _updates(s, d):
    return frame(s, d, "updates")


def _replaced(s, d):
    """Feeds divisible by 5 are written again with another status; the other feeds' files stay."""
    folder = _folder(s)
    tables.write_products(_products(s, d), folder)
    tables.write_products(_products(s, d).where("feed_id % 5 = 0").withColumn("status", F.lit("again")), folder)
    return s.read.parquet(folder).select("external_id", F.col("feed_id").cast("long").alias("feed_id"), "status")


def _published(s, d):
    folder = _folder(s)
    tables.publish_snapshot(_products(s, d), folder)
    return folder


def _changed(s, d):
    """Published, changed feed by feed where there are updates, and the older version expired."""
    folder, new = _published(s, d), _updates(s, d)
    tables.publish_change(s, folder, lambda old: catalog.upsert(old, new), [r[0] for r in new.select("feed_id").distinct().collect()])
    manifest.expire(s, folder, 1)
    return tables.read_snapshot(s, folder).select(*_KEEP)


def _streamed(s, d, start):
    """Updates arrive as files in two batches of their ids."""
    target, files, state = _published(s, d), _folder(s), _folder(s)
    new = _updates(s, d).select(*_products(s, d).columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _products(s, d).schema.fields)
    for k in range(2):
        new.where(F.col("external_id").cast("long") % 2 == k).write.mode("append").json(files)
        start(s, files, schema, target, state).awaitTermination()
    return tables.read_snapshot(s, target).select(*_KEEP)


def _ingest(s, files, schema, target, state):
    return jobs.stream_ingest(s, files, schema, target, state, ["last_updated"])


def _sync(s, files, schema, target, state):
    stream = s.readStream.schema(schema).json(files)
    return jobs.stream_quick_sync(stream, tables.read_snapshot(s, target).select("external_id"), target, state)


def _resumed(s, d):
    """Updates as one delimited feed, stopped after the first third of its records and then taken up again."""
    target, new = _published(s, d), _updates(s, d)
    fields = [f for f in _products(s, d).schema.fields]
    files = _folder(s)
    _csv(new.select(*[F.col(f.name).cast("string") for f in fields]), files)
    rows_of = lambda raw: raw.select(resume.NUMBER, *[F.col(f.name).cast(f.dataType) for f in fields])
    third = new.count() // 3 + 1
    for most in (1, None):
        resume.ingest_records(s, files, "csv", target, rows_of, third, most)
    return tables.read_snapshot(s, target).select(*_KEEP)


def _bucketed(s, d):
    """The catalog laid out in buckets and updated where it lies."""
    name = f"products_{uuid.uuid4().hex}"
    first = bucketed.lay_out(_products(s, d), name, int(s.conf.get("spark.sql.shuffle.partitions")), _folder(s))
    return bucketed.read_buckets(s, bucketed.upsert_buckets(s, first, _updates(s, d), f"{name}_2")).select(*_KEEP)


def _product_lines(s, d):
    rows = _products(s, d).select("external_id", F.col("feed_id").cast("int").alias("feed_id"), "product_name", F.col("price").cast("double").alias("price"), "raw_data")
    folder = _folder(s)
    tables.write_product_json(rows, folder)
    at = lambda c: F.get_json_object("value", f"$.{c}")
    return s.read.text(folder).select(at("size").alias("size"), at("item_group_id").alias("item_group_id")).groupBy("size", "item_group_id").agg(F.count("*").alias("rows"))


def _templates(s, d):
    feeds = s.read.parquet(f"{d}/supplier.parquet").select(
        F.col("s_suppkey").alias("feed_id"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("t"), (F.col("s_suppkey") % 2).cast("string"))).alias("template_id"),
        F.create_map(F.lit("id"), F.concat(F.lit("own_"), F.col("s_suppkey").cast("string"))).alias("mapping"),
    )
    known = feeds.where("template_id IS NOT NULL").select("template_id").distinct()
    templates = known.select("template_id", F.create_map(F.lit("id"), F.concat("template_id", F.lit("_id")), F.lit(" "), F.lit("x")).alias("mapping"))
    return mapping.apply_template(feeds, templates).select("feed_id", F.col("mapping")["id"].alias("id"), F.size("mapping").alias("fields"))


QUERIES = {
    "a1_read_delimited": _delimited,
    "a1_read_by_many_tasks": _split,
    "a2_a3_read_xml": _xml,
    "a4_recover_xml": _recovered,
    "a5_read_json_doc": _json_doc,
    "a6_read_json_lines": _json_lines,
    "a9_read_packed_feed": _packed,
    "a10_ingest_feeds": _ingested,
    "a11_read_snapshot_json": _snapshot_json,
    "s1_write_products": _replaced,
    "s2_publish_change": _changed,
    "u3_bucketed_upsert": _bucketed,
    "s5_write_product_json": _product_lines,
    "m11_apply_template": _templates,
    "t1_stream_ingest": lambda s, d: _streamed(s, d, _ingest),
    "t1_resumed_ingest": _resumed,
    "t3_stream_quick_sync": lambda s, d: _streamed(s, d, _sync),
}

_RAW = """SELECT cast(k AS VARCHAR) AS id, title, 'say "' || title || '"' || chr(10) || 'then, ' || param AS note FROM raw_feed"""
_KEY = "u.external_id = p.external_id AND u.feed_id = p.feed_id"
_UPSERT = with_views(f"SELECT {_COLS} FROM products p WHERE NOT EXISTS (SELECT 1 FROM updates u WHERE {_KEY}) UNION ALL SELECT {_COLS} FROM updates", "products", "updates")
ORACLE_SQL = {
    **{name: with_views(_RAW, "raw_feed") for name in ("a1_read_delimited", "a1_read_by_many_tasks", "a5_read_json_doc", "a6_read_json_lines", "a9_read_packed_feed", "a11_read_snapshot_json")},
    "a2_a3_read_xml": with_views(f"SELECT *, 'DE' AS country FROM ({_RAW})", "raw_feed"),
    "a4_recover_xml": with_views(f"SELECT id, title FROM ({_RAW})", "raw_feed"),
    "a10_ingest_feeds": with_views("SELECT k % 3 + 1 AS feed_id, ['a', 'b', 'c'][k % 3 + 1] AS feed_name, cast(k AS VARCHAR) AS key, title AS name FROM raw_feed", "raw_feed"),
    "s1_write_products": with_views("SELECT external_id, feed_id, CASE WHEN feed_id % 5 = 0 THEN 'again' ELSE status END AS status FROM products", "products"),
    "s2_publish_change": _UPSERT,
    "u3_bucketed_upsert": _UPSERT,
    "t1_stream_ingest": _UPSERT,
    "t1_resumed_ingest": _UPSERT,
    "t3_stream_quick_sync": with_views(
        f"""SELECT p.external_id, p.feed_id, p.product_name, coalesce(u.price, p.price) AS price, coalesce(u.original_price, p.original_price) AS original_price, coalesce(u.in_stock, p.in_stock) AS in_stock,
        p.status, coalesce(u.affiliate_link, p.affiliate_link) AS affiliate_link FROM products p LEFT JOIN updates u ON {_KEY}""", "products", "updates"),
    "s5_write_product_json": with_views(
        "SELECT json_extract_string(raw_data, '$.size') AS size, json_extract_string(raw_data, '$.item_group_id') AS item_group_id, count(*) AS rows FROM products GROUP BY ALL", "products"),
    "m11_apply_template": """SELECT s_suppkey AS feed_id, CASE WHEN s_suppkey % 3 = 0 THEN 't' || (s_suppkey % 2) || '_id' ELSE 'own_' || s_suppkey END AS id, 1 AS fields FROM supplier""",
}
