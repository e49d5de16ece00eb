"""Feed files, publication, mapping and streams on small files made here."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from feedlake.operators import mapping
from feedlake.sources import readers, tables
from feedlake.streaming import jobs


def write(path, text, mode="w", **kw):
    with open(path, mode, **kw) as f:
        f.write(text)
    return str(path)


@pytest.mark.parametrize("fmt", list(readers.SEPARATORS))
def test_delimited(spark, tmp_path, fmt):
    s = readers.SEPARATORS[fmt]
    rows = [["﻿id", " name ", "price"], ["1", '"two\nlines"', "2,00" if s != "," else "2.00"], ["2", '"say ""hi"""', "0"], ["3", "short"], ["4", "a", "b", "long"], ["1", "again", ""]]
    df = readers.read_delimited(spark, write(tmp_path / "f.txt", "\n".join(s.join(r) for r in rows) + "\n"), fmt)
    assert df.columns == ["id", "name", "price"]
    assert [(r["id"], r["name"]) for r in df.collect()] == [("1", "two\nlines"), ("2", 'say "hi"'), ("1", "again")]


def test_xml(spark, tmp_path):
    text = """<?xml version="1.0"?><yml><offers><offer id="7" available="true"><name>A</name><picture>p1</picture><picture>p2</picture><param name="size">28</param><param name="gender">male</param>
    <shipping><country>DE</country><price>3.49</price></shipping></offer><offer id="8" available="false"><name>B</name><picture>p3</picture><param name="size">30</param></offer><offer id="9"><name>C"""
    df = readers.with_params(readers.flatten_xml(readers.read_xml(spark, write(tmp_path / "f.xml", text))), ["param_size", "param_gender"])
    out = {r["id"]: r.asDict() for r in df.collect()}
    assert set(out) == {"7", "8"}
    assert out["7"]["picture"] == ["p1", "p2"] and out["7"]["param_size"] == "28" and out["7"]["param_gender"] == "male" and out["7"]["shipping_country"] == "DE"
    assert out["8"]["param_gender"] is None


def test_json(spark, tmp_path):
    assert readers.read_json_doc(spark, write(tmp_path / "a.json", '[{"id":1},{"id":2}]')).count() == 2
    assert readers.read_json_doc(spark, write(tmp_path / "b.json", '{"n":1,"items":[{"id":"x"}]}')).first()["id"] == "x"
    assert readers.read_json_doc(spark, write(tmp_path / "c.json", '{"id":"solo"}')).first()["id"] == "solo"
    assert readers.read_json_lines(spark, write(tmp_path / "d.jsonl", '{"id":1}\n\nbroken{\n{"id":2}\n')).count() == 2


def test_formats(spark, tmp_path):
    heads = {"﻿<a/>": "xml", " [1]": "json", '{"a":\n1}': "json", '{"a":1}\n{"a":2}': "json_lines", "a,b;c\n": "csv", 'a\tb\t"x,y,z,w"': "tsv", "a;b;c": "ssv", "a|b": "psv", "plain": "csv"}
    df = spark.createDataFrame(list(heads.items()), "head string, want string")
    got = df.withColumn("got", readers.classify_text(F.col("head"))).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    urls = {"http://x/format/xml/y": "xml", "http://x/?a=1&format=csv": "csv", "http://x/feed.json.gz?k=1": "json", "http://x/f.ndjson": "json_lines", "http://x/none": None}
    df = spark.createDataFrame(list(urls.items()), "u string, want string")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", readers.format_from_url(F.col("u"))).collect())
    write(tmp_path / "plain.bin", "a,b", "w")
    write(tmp_path / "packed.bin", gzip.compress(b"c;d"), "wb")
    assert sorted(r["text"] for r in readers.gunzip_texts(spark, str(tmp_path)).collect()) == ["a,b", "c;d"]


def test_ingest_isolates_a_broken_feed(spark, tmp_path):
    feeds = [{"feed_id": 1, "name": "one", "path": write(tmp_path / "a.csv", "id,title\n1,x\n2,y\n"), "format": "csv"}, {"feed_id": 2, "name": "two", "path": str(tmp_path / "no.csv"), "format": "csv"},
             {"feed_id": 3, "name": "three", "path": write(tmp_path / "b.json", '[{"pid":5,"info":{"t":"z"}}]'), "format": "json"}]
    rows, errors = readers.ingest_feeds(spark, feeds, {1: {"id": "id", "title": "title"}, 2: {}, 3: {"id": "pid", "title": "info.t"}}, str(tmp_path / "work"))
    assert sorted((str(r["id"]), r["title"], r["feed_id"]) for r in rows.collect()) == [("1", "x", 1), ("2", "y", 1), ("5", "z", 3)]
    assert [e[0] for e in errors] == [2]
    assert sorted((r["feed"], r["items"]) for r in readers.count_items(rows, F.col("feed_id")).collect()) == [(1, 2), (3, 1)]


def test_snapshot_json_and_profile(spark, tmp_path):
    path = write(tmp_path / "s.json", json.dumps({"items": {"a": {"title": "x"}, "b": {"n": 1}}, "__search_fields": {}}))
    assert sorted(r["id"] for r in readers.read_snapshot_json(spark, path).collect()) == ["a", "b"]
    prof = {r["column"]: (r["position"], r["sample"], r["filled"]) for r in readers.profile_feed(spark.createDataFrame([(" ", "b"), ("z", "a"), (None, None)], "x string, y string"), 4).collect()}
    assert prof == {"x": (0, "z", 1), "y": (1, "a", 2)}


def test_publication(spark, tmp_path):
    base = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "external_id string, feed_id int")
    assert tables.publish_snapshot(df, base) == 1
    with pytest.raises(ValueError):
        tables.publish_snapshot(df.limit(0), base)
    assert tables.read_snapshot(spark, base).count() == 2
    tables.publish_snapshot(df.limit(1), base)
    assert tables.read_snapshot(spark, base).count() == 1
    path = str(tmp_path / "p")
    tables.write_products(df, path)
    tables.write_products(spark.createDataFrame([("c", 2), ("d", 2)], "external_id string, feed_id int"), path)
    assert sorted((r["external_id"], r["feed_id"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("c", 2), ("d", 2)]


def test_log_and_jsonld(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("", 2, "n"), (None, 4, "n"), ("b", 2, "y")], "id string, seq int, v string")
    assert sorted((r["id"], r["v"]) for r in tables.compact_log(log).collect()) == [("a", "z"), ("b", "y")]
    rows = [("1", "A", "i", "l", "eur", 10.0, 7.5, "br", 1), ("2", "B", "", "l", "EUR", 9.0, 0.0, "", 1), ("3", "C", "i", "l", "EUR", 0.0, 0.0, "", 1), ("4", "D", "i", "l", "EUR", 5.0, 0.0, "", 1)]
    df = spark.createDataFrame(rows, "external_id string, product_name string, image_url string, affiliate_link string, currency string, price double, sale_price double, brand string, post_id int")
    doc = json.loads(tables.to_jsonld(df, "post_id", ["external_id"]).first()["jsonld"])
    items = doc["itemListElement"]
    assert [(i["position"], i["item"]["name"], i["item"]["offers"]["price"]) for i in items] == [(1, "A", "7.50"), (2, "D", "5.00")] and items[0]["item"]["offers"]["priceCurrency"] == "EUR"


def test_mapping(spark):
    names = ["aw_id", "product_name", "old_price", "price", "deep_link"]
    cols = spark.createDataFrame([(1, c, i, len(names)) for i, c in enumerate(names)], "feed_id long, column string, position int, columns int")
    patterns = spark.createDataFrame(
        [("id", 0, "suffix", "_id"), ("title", 1, "exact", "product_name"), ("title", 1, "contains", "name"), ("price", 2, "exact", "price"), ("price", 2, "contains", "price"), ("price", 2, "exclude", "old_"),
         ("old_price", 3, "exact", "old_price"), ("affiliate_link", 4, "contains", "link")], "standard string, rank int, kind string, pattern string")
    found = {(r["standard"], r["column"]): r["score"] for r in mapping.score_candidates(cols, patterns).collect()}
    assert found == {("id", "aw_id"): 85, ("title", "product_name"): 188, ("price", "price"): 184, ("price", "old_price"): 36, ("old_price", "old_price"): 106, ("affiliate_link", "deep_link"): 82}
    learned = mapping.learn_mapping(mapping.score_candidates(cols, patterns))
    assert {r["standard"]: r["column"] for r in learned.collect()} == {"id": "aw_id", "title": "product_name", "price": "price", "old_price": "old_price", "affiliate_link": "deep_link"}
    assert mapping.validate_mapping(learned).first()["valid"] and mapping.validate_mapping(learned.where("standard <> 'id'")).first()["missing"] == "id"
    feed = spark.createDataFrame([("", "9")], "price string, old_price string")
    fixed = mapping.repair_mapping(learned.where("standard = 'price'"), mapping.fill_rates(feed), mapping.score_candidates(cols, patterns))
    assert fixed.first()["column"] == "old_price"
    signatures = spark.createDataFrame([("n", "url", "n.com", 20), ("n", "prefix", "aw_", 20), ("m", "field", "price", 20), ("m", "field", "zzz", 20)], "network string, kind string, value string, boost int")
    feeds = spark.createDataFrame([(1, "http://www.N.com/f")], "feed_id long, url string")
    assert tuple(mapping.detect_network(cols, feeds, signatures).first()) == (1, "n", 25.0)
    drift = mapping.schema_drift(cols, cols.where("column <> 'price'"))
    assert drift.first()["drifted"] and drift.first()["share"] == 0.2
    nested = spark.createDataFrame([(([("x",)],),)], "a struct<b:array<struct<c:string>>>")
    assert mapping.apply_mapping(nested, {"t": "a.b[0].c", "no": "q.r"}).select("t", "no").first() == ("x", None)


def test_streams(spark, tmp_path):
    base, src = str(tmp_path / "target"), tmp_path / "in"
    src.mkdir()
    schema = "external_id string, feed_id int, price long, last_updated timestamp"
    write(src / "1.json", '{"external_id":"a","feed_id":1,"price":5,"last_updated":"2024-01-01T00:00:00"}\n{"external_id":"a","feed_id":1,"price":6,"last_updated":"2024-01-02T00:00:00"}\n')
    for k in range(2):
        jobs.stream_ingest(spark, str(src), schema, base, str(tmp_path / "cp"), ["last_updated"]).awaitTermination()
        write(src / f"{k + 2}.json", '{"external_id":"b","feed_id":1,"price":7,"last_updated":"2024-01-03T00:00:00"}\n')
    assert sorted((r["external_id"], r["price"]) for r in tables.read_snapshot(spark, base).collect()) == [("a", 6), ("b", 7)]
    updates = spark.createDataFrame([("a", 1, "2024-01-01"), ("a", 2, "2024-01-03"), ("b", 3, "2024-01-02")], "id string, v int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["id"], r["v"]) for r in jobs.stream_latest(updates).collect()) == [("a", 2), ("b", 3)]
    beats = spark.createDataFrame([("r1", "full", 10, 100), ("r1", "full", 11, 100), ("r2", "full", 9, 1), ("r3", "active_only", 0, 1), ("r4", "active_only", -201, 1)], "run_id string, mode string, s int, processed_rows long").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")))
    now = F.timestamp_seconds(F.lit(1_700_000_100))
    assert sorted(r["run_id"] for r in jobs.stalled_runs(beats, now).collect()) == ["r2", "r4"]
    assert sum(r["rows"] for r in jobs.throughput(beats).collect()) == 203


def test_templates_and_registration(spark):
    feeds = spark.createDataFrame([(1, "t", {"id": "old"}), (2, None, {"id": "own"})], "feed_id int, template_id string, mapping map<string,string>")
    templates = spark.createDataFrame([("t", {"id": "new", " ": "x"})], "template_id string, mapping map<string,string>")
    assert {r["feed_id"]: r["mapping"] for r in mapping.apply_template(feeds, templates).collect()} == {1: {"id": "new"}, 2: {"id": "own"}}
    listed = spark.createDataFrame([(1, "a", "http://x/f.xml.gz", "", "h"), (2, "b", "http://y", "csv", ""), (3, "", "http://z", "", "")], "feed_id long, name string, url string, format_hint string, network_hint string")
    detected = spark.createDataFrame([(2, "n", 1.0)], "feed_id long, network string, score double")
    sure = spark.createDataFrame([(1, 85.0), (2, 61.0)], "feed_id long, confidence double")
    out = {r["feed_id"]: (r["format"], r["network"], r["confidence_label"]) for r in mapping.register_feeds(listed, detected, sure).collect()}
    assert out == {1: ("xml", "h", "high"), 2: ("csv", "n", "mid")}


def test_quick_sync_stream_and_hooks(spark, tmp_path):
    from feedlake.operators.catalog import full_refresh

    schema = "external_id string, feed_id int, feed_name string, product_name string, brand string, category string, colour string, price long, original_price long, in_stock int, image_url string, affiliate_link string, status string, last_updated timestamp"
    stamp = "cast('2024-01-01' as timestamp)"
    rows = spark.sql(f"SELECT * FROM VALUES ('a', 1, 'f', 'A', '', '', '', 5L, 0L, 1, 'i', 'l', 'active', {stamp}), ('b', 1, 'f', 'B', '', '', '', 6L, 0L, 1, 'i', 'l', 'active', {stamp}) AS t({', '.join(x.split()[0] for x in schema.split(', '))})")
    base, src = str(tmp_path / "t"), tmp_path / "in"
    src.mkdir()
    tables.publish_snapshot(rows, base)
    line = {"external_id": "a", "feed_id": 1, "price": 9, "in_stock": 0, "image_url": "i2", "affiliate_link": "l2", "original_price": 12, "last_updated": "2024-02-01T00:00:00"}
    write(src / "1.json", json.dumps(line) + "\n" + json.dumps(line | {"external_id": "b", "price": 1}) + "\n" + json.dumps(line | {"external_id": "new"}) + "\n")
    stream = spark.readStream.schema(schema).json(str(src))
    jobs.stream_quick_sync(stream, spark.createDataFrame([("a",), ("new",)], "external_id string"), base, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["external_id"], r["price"], r["product_name"]) for r in tables.read_snapshot(spark, base).collect()) == [("a", 9, "A"), ("b", 6, "B")]
    told = []
    feeds = spark.createDataFrame([(1,)], "feed_id int")
    table, report = full_refresh(rows, rows.where("external_id = 'a'").withColumn("last_updated", F.to_timestamp(F.lit("2024-03-01"))), feeds, F.to_timestamp(F.lit("2024-02-15")))
    tables.publish_snapshot(table, str(tmp_path / "hooked"), on_complete=lambda t: told.append(t.count() + tables.current_version(spark, str(tmp_path / "hooked"))))
    assert told == [3] and {r["external_id"]: r["status"] for r in table.collect()} == {"a": "active", "b": "unavailable"}  # exactly half may go
    changed = tables.to_jsonld(rows.withColumn("currency", F.lit("EUR")), "feed_id", ["external_id"], transform=lambda n: n.withColumn("product_name", F.upper("product_name")).where("position = 1"))
    assert len(json.loads(changed.first()["jsonld"])["itemListElement"]) == 1
