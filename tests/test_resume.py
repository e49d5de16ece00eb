"""A feed taken in by batches of records: stops at any point, two runs, changed files, awkward files."""

import os

import pytest
from pyspark.sql import functions as F

from feedlake.sources import manifest, tables
from feedlake.streaming import resume


def write(path, rows):
    path.write_text("id,feed,name\n" + "".join(f'{i},{f},"{n}"\n' for i, f, n in rows))


def mapped(raw):
    return raw.select(resume.NUMBER, F.col("id").alias("external_id"), F.col("feed").cast("int").alias("feed_id"), F.col("name").alias("product_name"))


def table(spark, base):
    return sorted(tuple(r) for r in tables.read_snapshot(spark, base).collect())


@pytest.fixture
def small_blocks(spark):
    for k, v in (("maxPartitionBytes", "200"), ("openCostInBytes", "0"), ("minPartitionNum", "1")):
        spark.conf.set(f"spark.sql.files.{k}", v)
    yield
    for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{k}")


def test_resumes_at_the_next_record(spark, tmp_path, small_blocks):
    """A run that fails after k records; the next begins at k + 1, across blocks and records of several lines."""
    rows = [(f"p{i}", 1 + i % 2, f"line one\nline two of {i}, end") for i in range(50)]
    src, base = tmp_path / "f.csv", str(tmp_path / "t")
    write(src, rows)
    seen = []

    with pytest.raises(RuntimeError, match="stopped"):
        resume.ingest_records(spark, str(src), "csv", base, lambda raw: mapped(raw) if not seen.append(_span(raw)) and seen[-1][0] < 30 else _stop(), 15)
    assert seen == [(0, 14, 15), (15, 29, 15), (30, 44, 15)]
    assert table(spark, base) == sorted((i, f, n) for i, f, n in rows[:30])
    seen.clear()
    # with another size of batch the next run begins at record 30 all the same
    assert resume.ingest_records(spark, str(src), "csv", base, lambda raw: mapped(raw) if not seen.append(_span(raw)) else None, 20) == 50
    assert seen == [(30, 39, 10), (40, 49, 10)]
    assert table(spark, base) == sorted(rows)
    version = tables.current_version(spark, base)
    assert resume.ingest_records(spark, str(src), "csv", base, lambda raw: _stop(), 20) == 50
    assert tables.current_version(spark, base) == version


def _span(raw):
    numbers = sorted(r[0] for r in raw.select(resume.NUMBER).collect())
    return numbers[0], numbers[-1], len(numbers)


def _stop():
    raise RuntimeError("stopped")


def test_last_record_of_a_key_counts_and_bad_ones_go(spark, tmp_path):
    src, base = tmp_path / "f.csv", str(tmp_path / "t")
    src.write_text("id,feed,name\na,1,first\n\na,1,second\nb,1,x,y,z\nc,2,sea\na,1,third\n")
    assert resume.ingest_records(spark, str(src), "csv", base, mapped, 2, most=1) == 2
    assert table(spark, base) == [("a", 1, "second")]
    assert resume.ingest_records(spark, str(src), "csv", base, mapped, 2) == 5
    assert table(spark, base) == [("a", 1, "third"), ("c", 2, "sea")]


def test_a_changed_file_comes_in_anew_and_others_keep_their_place(spark, tmp_path):
    one, two, base = tmp_path / "one.csv", tmp_path / "two.csv", str(tmp_path / "t")
    write(one, [("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z")])
    write(two, [("d", 2, "x"), ("e", 2, "y")])
    assert resume.ingest_records(spark, str(one), "csv", base, mapped, 2, most=1) == 2
    assert resume.ingest_records(spark, str(two), "csv", base, mapped, 1, most=1) == 1
    write(one, [("a", 1, "new x"), ("b", 1, "new y"), ("f", 1, "w")])
    os.utime(one, (1, 1))
    assert resume.ingest_records(spark, str(one), "csv", base, mapped, 2) == 3
    assert sorted(p["records"] for p in manifest.current(spark, base).progress.values()) == [1, 3]
    assert table(spark, base) == [("a", 1, "new x"), ("b", 1, "new y"), ("d", 2, "x"), ("f", 1, "w")]


def test_a_run_that_another_overtakes(spark, tmp_path):
    """While a run maps its first batch another takes in two; it goes on behind them and no batch comes in twice."""
    src, base = tmp_path / "f.csv", str(tmp_path / "t")
    rows = [(f"p{i}", 1, f"n{i}") for i in range(10)]
    write(src, rows)
    asked = []

    def slow(raw):
        asked.append(_span(raw)[0])
        if len(asked) == 1:
            assert resume.ingest_records(spark, str(src), "csv", base, mapped, 3, most=2) == 6
        return mapped(raw)

    assert resume.ingest_records(spark, str(src), "csv", base, slow, 3) == 10
    assert asked == [0, 6, 9] and table(spark, base) == sorted(rows)
    assert tables.current_version(spark, base) == 4


def test_folders_and_empty_files(spark, tmp_path):
    src, base = tmp_path / "feed", str(tmp_path / "t")
    src.mkdir()
    write(src / "a.csv", [("a", 1, "x"), ("b", 1, "y")])
    write(src / "b.csv", [])
    write(src / "c.csv", [("c", 1, "z"), ("a", 1, "later")])
    spans = []
    assert resume.ingest_records(spark, str(src), "csv", base, lambda raw: mapped(raw) if not spans.append(_span(raw)) else None, 3) == 4
    assert spans == [(0, 2, 3), (3, 3, 1)]
    assert table(spark, base) == [("a", 1, "later"), ("b", 1, "y"), ("c", 1, "z")]
    write(tmp_path / "h.csv", [])
    assert resume.ingest_records(spark, str(tmp_path / "h.csv"), "csv", base, mapped, 3) == 0
    assert len(table(spark, base)) == 3
    with pytest.raises(ValueError, match="must keep"):
        resume.ingest_records(spark, str(src / "a.csv"), "csv", base, lambda raw: mapped(raw).drop(resume.NUMBER), 3)
