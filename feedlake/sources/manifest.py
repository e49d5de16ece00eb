"""Versions of a product table: a manifest names the folder of every feed, and a commit adds the next manifest.

    base/data/<write>/_feed=<feed_id>/    files of one feed as one write left them
    base/data/<write>/_pack=<number>/     files of several feeds, where a write has many
    base/versions/<number>                the manifest: a header with the schema and how far sources are in, then a line for each folder

A whole table, and a change of more than MOST_FOLDERS feeds, is laid into so many packs, ordered by feed, so that folders don't
become more with the feeds. A line of a pack lists the feeds that it gives, and those whose rows in it are of older versions.

A write puts only the feeds it touches into a folder of its own name, then creates the next manifest, which
names the new folders and the old ones of all other feeds. The manifest is created only if it isn't there yet
(compare and set), so of two writers one comes second: it takes over the other's entries if they touch other
feeds, and is made again from the newer rows if they touch its own. No write is lost, readers see whole
versions, and ``expire`` deletes what old versions alone name.

A manifest lists each feed once or twice and goes through the driver, as the registry of feeds does. On HDFS the manifest is
renamed into place, which fails if it is there; on local disks it is linked. Other stores need a rename
that does not overwrite.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_TRIES = 50
#: Folders at most into which a write lays its feeds: one each up to so many feeds, packs for more.
MOST_FOLDERS = 256
NO_FEED = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """The table moved on while a version based on an older one was being written."""


class Overtaken(Conflict):
    """Another run took in the same part of a source first."""


@dataclass
class Progress:
    """How far a source is in: ``was`` in the newest version (None: not at all) and ``now`` in the one to be made."""

    source: str
    was: dict | None
    now: dict


@dataclass
class Version:
    """number 0 is a table without versions; entries: feed (as text) to folder below the base; progress: of sources that come in parts;
    gone: folder of a pack to the feeds whose rows in it don't count any more.
    """

    number: int = 0
    schema: T.StructType | None = None
    entries: dict[str, str] = field(default_factory=dict)
    progress: dict[str, dict] = field(default_factory=dict)
    gone: dict[str, list[str]] = field(default_factory=dict)


class Folder:
    """A folder through Hadoop's file systems, whatever the store."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.jvm = spark._jvm
        self.base = self.path(base)
        self.fs = self.base.getFileSystem(spark._jsc.hadoopConfiguration())
        self.name = self.fs.makeQualified(self.base).toString()

    def path(self, *parts: str):
        made = self.jvm.org.apache.hadoop.fs.Path(parts[0])
        for part in parts[1:]:
            made = self.jvm.org.apache.hadoop.fs.Path(made, part)
        return made

    def names(self, folder: str) -> list[str]:
        path = self.path(self.name, folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def children(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.base)] if self.fs.exists(self.base) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(self.name, name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Makes a file with all of its text at once; False if it is there already."""
        target, draft = self.path(self.name, name), self.path(self.name, "drafts", uuid.uuid4().hex)
        self.fs.mkdirs(target.getParent())
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                of = lambda p: self.jvm.java.nio.file.Paths.get(p.toUri())
                try:
                    self.jvm.java.nio.file.Files.createLink(of(target), of(draft))
                except Py4JJavaError as error:
                    if "FileAlreadyExistsException" in str(error.java_exception):
                        return False
                    raise
                return True
            return bool(not self.fs.exists(target) and self.fs.rename(draft, target))
        finally:
            self.fs.delete(draft, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(self.name, name), True)

    def drop(self) -> None:
        self.fs.delete(self.base, True)

    def listing(self) -> list[tuple[str, int, int]]:
        """(path, length, time of change) of the file that the path names, or of the files of that folder."""
        found = self.fs.listStatus(self.base)
        return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found if not s.isDirectory())

    def has(self, name: str) -> bool:
        return self.fs.exists(self.path(self.name, name))


def _numbers(folder: Folder) -> list[int]:
    return sorted(int(n) for n in folder.names("versions") if n.isdigit())


def _load(folder: Folder, number: int) -> Version:
    head, *lines = folder.read(f"versions/{number:012}").splitlines()
    head, lines = json.loads(head), [json.loads(line) for line in lines]
    entries = {f: e["folder"] for e in lines for f in e.get("feeds", [e.get("feed")])}
    return Version(number, T.StructType.fromJson(head["schema"]), entries, head.get("progress", {}), {e["folder"]: e["gone"] for e in lines if "gone" in e})


def _lines(entries: dict[str, str], gone: dict[str, list[str]]) -> list[str]:
    held: dict[str, list[str]] = {}
    for feed, at in sorted(entries.items()):
        held.setdefault(at, []).append(feed)
    line = lambda at, feeds: {"folder": at, "feeds": feeds, "gone": sorted(gone.get(at, []))} if _packed(at) else {"feed": feeds[0], "folder": at}
    return [json.dumps(line(at, feeds)) for at, feeds in held.items()]


def _packed(folder: str) -> bool:
    return folder.rsplit("/", 1)[1].startswith("_pack=")


def current(spark: SparkSession, base: str, number: int | None = None) -> Version:
    """The newest version, or the one of that number."""
    folder = Folder(spark, base)
    numbers = _numbers(folder)
    if number is not None and number not in numbers:
        raise ValueError(f"no version {number} at {base}")
    return _load(folder, number or numbers[-1]) if numbers else Version()


def read_feeds(spark: SparkSession, base: str, version: Version, feeds: set[str] | None = None) -> DataFrame | None:
    """The rows of a version, or of some of its feeds only; None if there is no version yet. Columns that a feed's files
    don't have are null.
    """
    if version.schema is None:
        return None
    held = Counter(version.entries.values())
    wanted: dict[str, list[str]] = {}
    for feed, at in version.entries.items():
        if feeds is None or feed in feeds:
            wanted.setdefault(at, []).append(feed)
    whole = [at for at, own in wanted.items() if not version.gone.get(at) and len(own) == held[at]]
    part = {at: own for at, own in wanted.items() if at not in set(whole)}
    read = lambda folders: spark.read.schema(version.schema).parquet(*[f"{base}/{at}" for at in folders])
    found = [read(whole)] if whole else []
    if part:
        found.append(_of_packs(read(part), part if feeds is not None else {at: version.gone[at] for at in part}, feeds is not None))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], version.schema)


def _of_packs(rows: DataFrame, feeds: dict[str, list[str]], keep: bool) -> DataFrame:
    """The rows of packs whose feeds are listed for their pack, or those of all other feeds (not ``keep``)."""
    if keep and rows.schema["feed_id"].dataType.simpleString() in ("int", "bigint", "string"):
        # packs are ordered by feed, so files are read where these feeds are
        ids = sorted({f for own in feeds.values() for f in own})
        if len(ids) <= MOST_FOLDERS and NO_FEED not in ids:
            rows = rows.where(F.col("feed_id").isin(*[F.lit(f).cast(rows.schema["feed_id"].dataType) for f in ids]))
    pairs = rows.sparkSession.createDataFrame([(at, f) for at, own in feeds.items() for f in own], "_at string, _feed string")
    at = F.regexp_extract(F.col("_metadata.file_path"), r"(data/[^/]+/[^/]+)/[^/]+$", 1)
    # the feeds of the manifest, which went through the driver
    return rows.withColumns({"_at": at, "_feed": feed_text()}).join(F.broadcast(pairs), ["_at", "_feed"], "left_semi" if keep else "left_anti").select(*rows.columns)


def feed_text() -> Column:
    return F.coalesce(F.nullif(F.col("feed_id").cast("string"), F.lit("")), F.lit(NO_FEED))


def with_pack(df: DataFrame) -> DataFrame:
    """With the pack of each row's feed."""
    return df.withColumn("_pack", F.pmod(F.xxhash64(feed_text()), F.lit(MOST_FOLDERS)))


def _merged(old: T.StructType | None, new: T.StructType) -> T.StructType:
    """The new fields after the old ones; a field keeps its type."""
    if old is None:
        return T.StructType([T.StructField(f.name, f.dataType) for f in new])
    kinds = {f.name: f.dataType for f in old}
    for f in new:
        if f.name in kinds and kinds[f.name].simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {kinds[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return T.StructType([T.StructField(f.name, f.dataType) for f in [*old, *(f for f in new if f.name not in kinds)]])


def _write(folder: Folder, df: DataFrame, feeds: set[str] | None) -> tuple[str, dict[str, str]]:
    """The name of a new write and its entries. Rebalancing splits a large feed or pack over several files. feeds: that may be in it."""
    name = f"data/{uuid.uuid4().hex}"
    if "feed_id" in df.columns and (feeds is None or len(feeds) > MOST_FOLDERS):
        packs = with_pack(df).hint("rebalance", "_pack")
        packs.sortWithinPartitions("_pack", "feed_id").write.partitionBy("_pack").parquet(f"{folder.name}/{name}")
        kinds = T.StructType([T.StructField("feed_id", df.schema["feed_id"].dataType), T.StructField("_pack", T.LongType())])
        written = df.sparkSession.read.schema(kinds).parquet(f"{folder.name}/{name}").distinct().withColumn("feed", feed_text())
        return name, {r["feed"]: f"{name}/_pack={r['_pack']}" for r in written.collect()}
    feed = F.col("feed_id") if "feed_id" in df.columns else F.lit(None)
    df.withColumn("_feed", feed.cast("string")).hint("rebalance", "_feed").write.partitionBy("_feed").parquet(f"{folder.name}/{name}")
    return name, {n.removeprefix("_feed="): f"{name}/{n}" for n in folder.names(name) if n.startswith("_feed=")}


def feed_names(feed_ids: list) -> set[str]:
    return {NO_FEED if f is None else str(f) for f in feed_ids}


def commit(
    spark: SparkSession, base: str, make: Callable[[DataFrame | None], DataFrame], feeds: set[str] | None = None, based_on: int | None = None, allow_empty: bool = True,
    progress: Progress | None = None,
) -> int:
    """Writes what ``make`` gives for the rows of ``feeds`` (None: of all) in the newest version, in their place, and
    returns the new version's number. ``make`` is called again if another writer changed these feeds meanwhile.
    Feeds of which no row is left are taken off.

    based_on: the only version that may be replaced, else Conflict. progress: committed with the rows, so that a source's part is
    in the table if and only if the version says so; Overtaken if another run moved it on meanwhile.
    """
    folder = Folder(spark, base)
    made: tuple[Version, T.StructType, str, dict[str, str]] | None = None
    for _ in range(MOST_TRIES):
        seen = current(spark, base)
        if based_on is not None and seen.number != based_on:
            raise Conflict(f"version {based_on} is not the newest any more, {seen.number} is")
        if progress is not None and seen.progress.get(progress.source) != progress.was:
            if made is not None:
                folder.delete(made[2])
            raise Overtaken(f"{progress.source} is at {seen.progress.get(progress.source)}, not at {progress.was}")
        touched = lambda v: v.entries if feeds is None else {f: v.entries.get(f) for f in feeds}
        if made is None or touched(made[0]) != touched(seen):
            if made is not None:
                folder.delete(made[2])
            df = make(read_feeds(spark, base, seen, feeds))
            _merged(None if feeds is None else seen.schema, df.schema)  # an error before anything is written
            name, written = _write(folder, df, feeds)
            if feeds is not None and not set(written) <= feeds:
                folder.delete(name)
                raise ValueError(f"rows of other feeds than asked for: {sorted(set(written) - feeds)[:5]}")
            made = seen, df.schema, name, written
        rest = {} if feeds is None else {f: at for f, at in seen.entries.items() if f not in feeds}
        entries = rest | made[3]
        gone = {at: [*own, *(f for f in feeds or () if seen.entries.get(f) == at)] for at, own in seen.gone.items()}
        if not entries and not allow_empty:
            folder.delete(made[2])
            raise ValueError("an empty snapshot is not published")
        schema = _merged(None if feeds is None else seen.schema, made[1])
        known = seen.progress if progress is None else seen.progress | {progress.source: progress.now}
        lines = [json.dumps({"schema": schema.jsonValue(), "progress": known}), *_lines(entries, gone)]
        if folder.create(f"versions/{seen.number + 1:012}", "\n".join(lines)):
            return seen.number + 1
    folder.delete(made[2])
    raise Conflict(f"{MOST_TRIES} other writers came first at {base}")


def expire(spark: SparkSession, base: str, keep: int = 2) -> list[int]:
    """Deletes all versions but the newest ``keep`` and the folders that only they name; returns their numbers. What a
    writer hasn't committed yet is named by none, so it stays.
    """
    folder = Folder(spark, base)
    numbers = _numbers(folder)
    old, kept = numbers[:-keep] if keep else numbers, numbers[-keep:] if keep else []
    used = {at for n in kept for at in _load(folder, n).entries.values()}
    gone = {at for n in old for at in _load(folder, n).entries.values()} - used
    for n in old:
        folder.delete(f"versions/{n:012}")
    for at in sorted(gone):
        folder.delete(at)
    for write in {at.rsplit("/", 1)[0] for at in gone}:
        if not any(n.startswith(("_feed=", "_pack=")) for n in folder.names(write)):
            folder.delete(write)
    return old
