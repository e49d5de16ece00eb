"""Large delimited files by many tasks, mixed folders, and items of XML that no parser takes."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from feedlake.sources import readers, records


@pytest.fixture
def small_blocks(spark):
    for k, v in (("maxPartitionBytes", "300"), ("openCostInBytes", "0"), ("minPartitionNum", "1")):
        spark.conf.set(f"spark.sql.files.{k}", v)
    yield
    for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{k}")


def field(rng, sep):
    kind = rng.randrange(9)
    word = "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 12)))
    inner = word + rng.choice(["", sep, '""', "\n", "\n\n", f'{sep}"",\n""x', f"\n{word}\n"]) + word
    return [word, word, "", f'5"{word}', f'{word}"', f'"{word}"', f'"{inner}"', f'"{inner}\n{inner}"', '""'][kind]


@pytest.mark.parametrize("seed", range(4))
def test_many_tasks_give_the_rows_of_one(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    fmt = ["csv", "tsv", "ssv", "psv"][seed]
    sep, end = readers.SEPARATORS[fmt], "\r\n" if seed == 2 else "\n"
    rows = [sep.join(["id", "a", '"b\nc"', "d"])]
    for i in range(250):
        rows.append(sep.join([str(i), *(field(rng, sep) for _ in range(rng.choice([3, 3, 3, 3, 2, 4])))]))
        rows += [""] * (rng.random() < 0.05)
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "f.txt").write_bytes(end.join(rows).replace("\n", end if seed == 2 else "\n").replace("\r\r", "\r").encode())
    (tmp_path / "one" / "g.txt").write_bytes(("\n".join([rows[0], *(sep.join([f"g{i}", '"x\ny"', "1", "2"]) for i in range(60))]) + "\n").encode())
    path = str(tmp_path / "one")
    want = readers.read_delimited(spark, path, fmt)
    got = readers.read_delimited(spark, path, fmt, split=True)
    key = lambda r: tuple("" if v is None else v for v in r)
    assert got.columns == want.columns
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and want.count() > 150
    blocks = records.delimited_records(spark, path, sep).select("path", "block").distinct().count()
    assert blocks > 20


def test_one_long_record_over_many_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f"line {i}" for i in range(400))
    (tmp_path / "f.csv").write_text(f'id,t\n1,"{long}"\n2,b\n3,"{long}x"\n')
    got = {r["id"]: r["t"] for r in readers.read_delimited(spark, str(tmp_path / "f.csv"), split=True).collect()}
    assert got == {"1": long, "2": "b", "3": long + "x"}


def test_state_after_a_line(spark):
    lines = {"a,b": False, 'a,"b': True, '"a","b"': False, 'x"': False, '5" x,y': False, '""': False, '"a""': True, '"': True, '","': False, "": False, '"a"b,"c': True}
    df = spark.createDataFrame(list(lines), "string").toDF("v")
    got = {r["v"]: r["o"] for r in df.select("v", records.ends_inside(F.col("v"), ",").alias("o")).collect()}
    assert got == lines


def test_empty_and_header_only_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text("id,t\n")
    assert readers.read_delimited(spark, str(tmp_path / "h.csv"), split=True).count() == 0
    (tmp_path / "blank.csv").write_text("\n\nid,t\n\n1,x\n\n")
    assert [tuple(r) for r in readers.read_delimited(spark, str(tmp_path / "blank.csv"), split=True).collect()] == [("1", "x")]


def test_folders_of_packed_and_plain_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "plain.csv").write_text("id,t\n1,a\n2,b\n")
    (tmp_path / "in" / "packed").write_bytes(gzip.compress(b'id,t\n3,"c\nd"\n'))
    (tmp_path / "in" / "packed2").write_bytes(gzip.compress(b"id,t\n4,d\n"))
    (tmp_path / "in" / "named.csv.gz").write_bytes(gzip.compress(b"id,t\n5,e\n"))
    got = readers.read_feed(spark, str(tmp_path / "in"), "csv", str(tmp_path / "work")).collect()
    assert sorted(map(tuple, got)) == [("1", "a"), ("2", "b"), ("3", "c\nd"), ("4", "d"), ("5", "e")]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text('{"id":1}\n')
    (tmp_path / "lines" / "b").write_bytes(gzip.compress(b'{"id":2}\n'))
    assert sorted(r["id"] for r in readers.read_feed(spark, str(tmp_path / "lines"), "json_lines", str(tmp_path / "work")).collect()) == [1, 2]


def test_items_are_recovered_where_the_parser_finds_none(spark, tmp_path, monkeypatch):
    (tmp_path / "b.xml").write_text("<feed><offer><id>1</id><t>a</t></offer>\n junk & < <offer><id>2</id><t>b</t></offer></feed>")
    folder = str(tmp_path / "work")
    plain = readers.read_feed(spark, str(tmp_path / "b.xml"), "xml", folder)
    assert sorted(str(r["id"]) for r in plain.collect()) == ["1", "2"]

    def broken(*_):
        raise ValueError("no parser takes it")

    monkeypatch.setattr(readers, "read_xml", broken)
    found = readers.read_feed(spark, str(tmp_path / "b.xml"), "xml", folder)
    assert sorted((r["id"], r["t"]) for r in found.collect()) == [("1", "a"), ("2", "b")]
    feeds = [{"feed_id": 1, "name": "x", "path": str(tmp_path / "b.xml"), "format": "xml"}]
    rows, errors = readers.ingest_feeds(spark, feeds, {1: {"id": "id", "title": "t"}}, folder)
    assert not errors and sorted(r["title"] for r in rows.collect()) == ["a", "b"]
    (tmp_path / "none.xml").write_text("<feed></feed>")
    assert readers.read_feed(spark, str(tmp_path / "none.xml"), "xml", folder).count() == 0
