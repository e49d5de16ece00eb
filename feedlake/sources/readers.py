"""Readers of feed files (A1-A13). All columns of delimited feeds are text."""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.sources.records import delimited_records

SEPARATORS = {"csv": ",", "tsv": "\t", "ssv": ";", "psv": "|"}
#: Item tags in order of preference, and keys of a JSON document that hold the items.
ITEM_TAGS = ("item", "entry", "offer", "product")
ITEM_KEYS = ("products", "items", "data", "results", "offers", "entries")
CORRUPT = "_corrupt"


def sound_rows(df: DataFrame) -> DataFrame:
    """Rows without a parse error. Spark refuses a scan of the error column alone, so a column of the
    data takes part in the filter and survives pruning.
    """
    plain = [f.name for f in df.schema.fields if f.name != CORRUPT and isinstance(f.dataType, T.AtomicType)]
    anchor = F.col(f"`{plain[0]}`").cast("string") if plain else F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != CORRUPT]))
    return df.where(F.col(CORRUPT).isNull() & (F.concat_ws("", F.lit("x"), anchor) != "")).drop(CORRUPT)


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace("\ufeff", "").strip(" \t\r\n\"'") or f"column_{i}" for i, c in enumerate(df.columns)])


def read_delimited(spark: SparkSession, paths: str | list[str], fmt: str = "csv", split: bool = False) -> DataFrame:
    """A1: quoted and multi-line fields; rows whose number of fields differs from the header's are dropped.

    ``split``: large files are read by many tasks, with the rows of the read in one (``feedlake.sources.records``).
    """
    schema, options = delimited_schema(spark, paths, fmt), delimited_options(fmt)
    if not split:
        rows = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=True).schema(schema).csv(paths)
        return clean_names(sound_rows(rows))
    records = delimited_records(spark, paths, SEPARATORS[fmt]).where(F.trim("record") != "")
    heads = records.groupBy("path").agg(F.min(F.struct("block", "line")).alias("_head"))
    body = records.join(heads, "path").where(F.struct("block", "line") != F.col("_head"))
    return clean_names(parsed_records(body, schema, fmt))


def delimited_options(fmt: str) -> dict:
    return {"header": True, "sep": SEPARATORS[fmt], "quote": '"', "escape": '"', "multiLine": True}


def delimited_schema(spark: SparkSession, paths: str | list[str], fmt: str) -> T.StructType:
    """The header's fields as text, and one for records that don't fit them."""
    names = spark.read.options(**delimited_options(fmt)).csv(paths).columns
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])


def parsed_records(records: DataFrame, schema: T.StructType, fmt: str, *keep: str) -> DataFrame:
    """The fields of the text in ``record``, after the columns ``keep``; records that don't fit the schema are dropped."""
    plain = {k: str(v) for k, v in delimited_options(fmt).items() if k in ("sep", "quote", "escape")} | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    read = records.select(*keep, F.from_csv("record", schema.toDDL(), plain).alias("r")).select(*keep, "r.*")
    return read.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def _xml(spark: SparkSession, paths, tag: str) -> DataFrame:
    return spark.read.format("xml").options(rowTag=tag, ignoreNamespace=True, columnNameOfCorruptRecord=CORRUPT).load(paths)


def read_xml(spark: SparkSession, paths: str | list[str], row_tag: str | None = None) -> DataFrame:
    """A2, A4: items of the first tag of ITEM_TAGS that the file holds; an item cut off at the end is dropped."""
    for tag in [row_tag] if row_tag else ITEM_TAGS:
        df = _xml(spark, paths, tag)
        if df.columns and df.columns != [CORRUPT]:
            return sound_rows(df) if CORRUPT in df.columns else df
    return spark.createDataFrame([], "item string")


def flatten_xml(df: DataFrame) -> DataFrame:
    """A3: attributes and one nested level as columns (tag_sub), <param name=x> as param_x, repeated
    tags as arrays of text.
    """
    out: dict[str, Column] = {}
    for field in df.schema.fields:
        name, kind, c = field.name, field.dataType, F.col(f"`{field.name}`")
        if name == "param":
            params = c if isinstance(kind, T.ArrayType) else F.array(c)
            out["_params"] = F.map_from_entries(F.transform(params, lambda p: F.struct(F.concat(F.lit("param_"), p["_name"].cast("string")), p["_VALUE"].cast("string"))))
        elif isinstance(kind, T.StructType):
            for sub in kind.fields:
                value = c.getField(sub.name)
                out[name if sub.name == "_VALUE" else f"{name}_{sub.name.lstrip('_')}"] = value.cast("string") if not isinstance(sub.dataType, T.ArrayType) else value
        elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StructType):
            out[name] = c.cast("array<string>")
        else:
            out[name.lstrip("_")] = (F.to_json(c) if isinstance(kind, T.ArrayType) else c).cast("string")
    return df.select(*[c.alias(n) for n, c in out.items()])


def with_params(df: DataFrame, names: list[str]) -> DataFrame:
    """A3: the named param_x columns out of the map of ``flatten_xml``."""
    return df.withColumns({n: F.col("_params")[n] for n in names}).drop("_params")


def read_json_doc(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A5: a top-level array; else the first of ITEM_KEYS that is a list; else one object."""
    df = spark.read.json(paths, multiLine=True)
    for key in ITEM_KEYS:
        if key in df.columns and isinstance(df.schema[key].dataType, T.ArrayType):
            return df.select(F.explode(key).alias("item")).select("item.*")
    return df


def read_json_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One object a line; blank and broken lines are skipped."""
    df = spark.read.option("columnNameOfCorruptRecord", CORRUPT).json(paths)
    return sound_rows(df) if CORRUPT in df.columns else df


def classify_text(head: Column) -> Column:
    """The format of a feed from its beginning: BOM off, '<' xml, '[' json, '{' json or json_lines
    by the next line, else the most frequent delimiter of the first line outside quotes.
    """
    text = F.trim(F.regexp_replace(F.coalesce(head, F.lit("")), r"^\uFEFF", ""))
    second = F.trim(F.regexp_extract(text, r"^[^\n]*\n\s*([^\n]*)", 1))
    line = F.regexp_extract(F.regexp_replace(text, '"[^"]*"', ""), r"^([^\r\n]*)", 1)
    n = {k: F.length(line) - F.length(F.replace(line, F.lit(s), F.lit(""))) for k, s in SEPARATORS.items()}
    most = F.greatest(*n.values())
    vote = F.coalesce(*[F.when(n[k] == most, k) for k in ("csv", "tsv", "ssv", "psv")])
    lines = F.when(second.startswith("{"), "json_lines").otherwise("json")
    return F.when(text.startswith("<"), "xml").when(text.startswith("["), "json").when(text.startswith("{"), lines).otherwise(vote)


def classify_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, format) of whole files."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", classify_text(F.decode(F.substring("content", 1, 32_768), "UTF-8")).alias("format"))


def format_from_url(url: Column) -> Column:
    """From '/format/x/', '?format=x', then the file's suffix, '.gz' taken off."""
    low = F.lower(url)
    word = F.coalesce(F.nullif(F.regexp_extract(low, r"/format/([a-z]+)", 1), F.lit("")), F.nullif(F.regexp_extract(low, r"[?&]format=([a-z]+)", 1), F.lit("")),
                      F.nullif(F.regexp_extract(low, r"^[^?#]*?\.([a-z]+)(?:\.gz)?(?:[?#].*)?$", 1), F.lit("")))
    return F.when(word.isin("jsonl", "ndjson"), "json_lines").when(word.isin("csv", "tsv", "ssv", "psv", "xml", "json"), word)


def recover_xml(spark: SparkSession, paths: str | list[str], row_tag: str, schema: str | None = None) -> DataFrame:
    """A4: the whole items of files that no parser takes: they are cut out of the text by their tags and
    parsed one by one; those that still don't parse are dropped. Without a schema, the first items tell it.
    """
    items = _items(spark, paths, row_tag)
    if schema is None:
        seen = [r["item"] for r in items.limit(20).collect()]
        if not seen:
            return spark.createDataFrame([], "item string")
        parsed = [T.StructType.fromDDL(spark.range(1).select(F.schema_of_xml(F.lit(x))).first()[0]) for x in seen if _is_xml(x)]
        names = dict.fromkeys(f.name for s in parsed for f in s.fields)
        schema = ", ".join(f"`{n}` string" for n in names)
    read = items.select(F.from_xml("item", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}).alias("x")).select("x.*")
    return read.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def _is_xml(text: str) -> bool:
    try:
        ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return False
    return True


def gunzip_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of files that are gzip by their magic bytes, whatever their suffix; others as they are."""

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [(gzip.decompress(c) if c[:2] == b"\x1f\x8b" else c).decode("utf-8", "replace") for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "text": texts})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(opened, "path string, text string")


def unpacked(spark: SparkSession, path: str, folder: str) -> list[str]:
    """The path itself, or, if files are gzip by their magic bytes under another suffix, the other files and
    a copy of the lines of each of these below ``folder``.
    """
    files = spark.read.format("binaryFile").load(path)
    names = files.select("path", ((F.hex(F.substring("content", 1, 2)) == "1F8B") & ~F.col("path").endswith(".gz")).alias("packed")).collect()
    if not any(n["packed"] for n in names):
        return [path]

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with io.TextIOWrapper(gzip.GzipFile(fileobj=io.BytesIO(content)), "utf-8", "replace", newline="\n") as text:
                    while some := text.readlines(1 << 20):
                        yield pd.DataFrame({"value": [x.removesuffix("\n") for x in some]})

    out = [n["path"] for n in names if not n["packed"]]
    for name in (n["path"] for n in names if n["packed"]):  # a copy of its own for each, as each has a header
        staged = f"{folder}/{uuid.uuid4().hex}"
        spark.read.format("binaryFile").load(name).select("content").mapInPandas(lines, "value string").write.text(staged)
        out.append(staged)
    return out


def _items(spark: SparkSession, paths: str | list[str], tag: str) -> DataFrame:
    """The texts of the whole items of files, cut out by their tags."""
    texts = spark.read.text(paths, wholetext=True)
    return texts.select(F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>"), F.lit(0))).alias("item"))


def read_items(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A2, A4: the items of XML files. Where the parser fails or gives fewer rows than there are items between
    tags (it can stop at what stands between two), the items are cut out and parsed one by one, and the larger result counts.
    """
    for tag in ITEM_TAGS:
        there = _items(spark, paths, tag).count()
        try:
            df = read_xml(spark, paths, tag)
            rows = df.count() if df.columns != ["item"] else 0
        except Exception:  # whatever the parser stumbles over, the items may be whole
            df, rows = None, 0
        if there > rows:
            found = recover_xml(spark, paths, tag)
            if found.count() > rows:
                return found
        if rows:
            return df
    return spark.createDataFrame([], "item string")


def read_feed(spark: SparkSession, path: str, fmt: str, folder: str) -> DataFrame:
    """The rows of a feed of a known format, a file or a folder of them, packed or not; ``folder`` takes unpacked
    copies. Delimited files are read by many tasks.
    """
    plain = unpacked(spark, path, folder)
    if fmt == "xml":
        return flatten_xml(read_items(spark, plain))
    if fmt in ("json", "json_lines"):
        return (read_json_doc if fmt == "json" else read_json_lines)(spark, plain)
    return read_delimited(spark, plain, fmt, split=True)


def ingest_feeds(
    spark: SparkSession, feeds: list[dict], mappings: dict[int, dict[str, str]], folder: str
) -> tuple[DataFrame | None, list[tuple[int, str]]]:
    """A10: every registered feed read, mapped and tagged with feed_id and feed_name. ``feeds``: a registry of tens of
    records with feed_id, name, path and format.

    Each feed is landed as Parquet below ``folder`` on its own, so one that can't be read, or breaks while it is
    read, goes to the errors and the others go on.
    """
    from feedlake.operators.mapping import apply_mapping

    out, errors = None, []
    for feed in feeds:
        landed = f"{folder}/{uuid.uuid4().hex}"
        try:
            rows = read_feed(spark, feed["path"], feed["format"], folder)
            mapped = apply_mapping(rows, mappings[feed["feed_id"]]).withColumn("feed_id", F.lit(feed["feed_id"])).withColumn("feed_name", F.lit(feed["name"]))
            mapped.write.parquet(landed)
            mapped = spark.read.parquet(landed)
            out = mapped if out is None else out.unionByName(mapped, allowMissingColumns=True)
        except Exception as error:  # one broken feed must not stop the others
            errors.append((feed["feed_id"], str(error).splitlines()[0]))
    return out, errors


def read_snapshot_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, product as JSON) from one object {"items": {id: product}}."""
    text = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "items map<string,variant>")["items"]
    return text.select(F.explode(items).alias("id", "v")).select("id", F.to_json("v").alias("product"))


def count_items(df: DataFrame, by: Column | None = None) -> DataFrame:
    """Data rows per feed file (or by another column)."""
    return df.groupBy((by if by is not None else F.col("_metadata.file_path")).alias("feed")).agg(F.count("*").alias("items"))


def profile_feeds(df: DataFrame, by: str) -> DataFrame:
    """A13 for all feeds at once: (feed, column, position, columns, sample, filled) by the column ``by``: of each feed's
    columns the smallest filled value and how many are filled. One pass, summed before it is shuffled.
    """
    names = [c for c in df.columns if c != by]
    text = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    per = df.groupBy(F.col(by).alias("feed")).agg(*[F.struct(F.min(text(c)).alias("sample"), F.count(text(c)).alias("filled")).alias(f"_{i}") for i, c in enumerate(names)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.lit(len(names)).alias("columns"), F.col(f"_{i}.sample").alias("sample"), F.col(f"_{i}.filled").alias("filled")) for i, c in enumerate(names)]
    return per.select("feed", F.explode(F.array(*rows)).alias("r")).select("feed", "r.*")


def profile_feed(df: DataFrame, feed_id: int) -> DataFrame:
    """(feed_id, column, position, columns, sample, filled): the first filled value in text order."""
    names = df.columns
    text = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    row = df.agg(*[F.struct(F.min(text(c)).alias("sample"), F.count(text(c)).alias("filled")).alias(f"_{i}") for i, c in enumerate(names)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.lit(len(names)).alias("columns"), F.col(f"_{i}.sample").alias("sample"), F.col(f"_{i}.filled").alias("filled")) for i, c in enumerate(names)]))
    return row.select(F.lit(feed_id).alias("feed_id"), rows.alias("r")).select("feed_id", "r.*")
