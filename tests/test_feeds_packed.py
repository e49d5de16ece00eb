"""Packed and broken feed files, and stalled runs on a stream."""

import gzip
import json
import os

import pandas as pd

from feedlake.sources import readers
from feedlake.streaming import jobs


def test_a_packed_feed_under_a_plain_name_ends_as_rows(spark, tmp_path):
    text = 'id,title\n1,"two\nlines"\n2,plain\n'
    (tmp_path / "feed").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "lines.gz").write_bytes(gzip.compress(b'{"id":"3"}\n'))
    (tmp_path / "x.csv").write_text(text)
    folder = str(tmp_path / "work")
    want = [("1", "two\nlines"), ("2", "plain")]
    for name in ("feed", "x.csv"):
        assert sorted(map(tuple, readers.read_feed(spark, str(tmp_path / name), "csv", folder).collect())) == want
    assert [r["id"] for r in readers.read_feed(spark, str(tmp_path / "lines.gz"), "json_lines", folder).collect()] == ["3"]


def test_a_feed_that_breaks_while_it_is_read_fails_alone(spark, tmp_path):
    (tmp_path / "good.csv").write_text("id,t\n1,a\n")
    (tmp_path / "packed").write_bytes(gzip.compress(b"id,t\n" + b"5,e\n" * 50_000)[:-20])
    feeds = [{"feed_id": 1, "name": "g", "path": str(tmp_path / "good.csv"), "format": "csv"}, {"feed_id": 2, "name": "b", "path": str(tmp_path / "packed"), "format": "csv"},
             {"feed_id": 3, "name": "m", "path": str(tmp_path / "missing"), "format": "csv"}]
    rows, errors = readers.ingest_feeds(spark, feeds, {k: {"id": "id", "title": "t"} for k in (1, 2, 3)}, str(tmp_path / "work"))
    assert [(r["id"], r["title"], r["feed_id"]) for r in rows.collect()] == [("1", "a", 1)]
    assert [f for f, _ in errors] == [2, 3]


def test_items_are_recovered_from_a_broken_file(spark, tmp_path):
    (tmp_path / "b.xml").write_text("<feed><item><id>1</id><t>a</t></item> & junk < <item><id>2</id><t>b & c</t></item><item a='x'><id>3</id></item><item><id>4</id>")
    got = readers.recover_xml(spark, str(tmp_path / "b.xml"), "item").select("id").collect()
    assert sorted(r["id"] for r in got) == ["1", "3"]
    typed = readers.recover_xml(spark, str(tmp_path / "b.xml"), "item", "id int, t string").collect()
    assert sorted((r["id"], r["t"]) for r in typed if r["t"]) == [(1, "a")]
    (tmp_path / "none.xml").write_text("nothing")
    assert readers.recover_xml(spark, str(tmp_path / "none.xml"), "item").count() == 0


def test_stalled_runs_on_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    beat = lambda run, mode, at: json.dumps({"run_id": run, "mode": mode, "ts": pd.Timestamp("2024-01-01") .isoformat() if not at else (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=at)).isoformat()})
    first = [beat("a", "full", 0), beat("a", "full", 60), beat("b", "active_only", 0), beat("c", "full", 100), beat("d", "other", 0)]
    later = [beat("c", "full", 180), beat("c", "full", 260), beat("b", "active_only", 250)]
    (src / "1.json").write_text("\n".join(first) + "\n")
    (src / "2.json").write_text("\n".join(later) + "\n")
    os.utime(src / "1.json", (1, 1))
    stream = spark.readStream.schema("run_id string, mode string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(src))
    out = str(tmp_path / "out")
    jobs.stream_stalled(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [(r["run_id"], r["mode"], str(r["last"])) for r in spark.read.parquet(out).collect()] == [("a", "full", "2024-01-01 00:01:00")]
