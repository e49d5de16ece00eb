"""Publishing the product table and exporting it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlake.functions.staging import shared_folder
from feedlake.functions.values import non_empty
from feedlake.operators.normalize import from_product_rows
from feedlake.sources import manifest


def write_products(df: DataFrame, path: str) -> None:
    """A feed in ``df`` replaces its rows, other feeds stay. A folder a feed (feed_id=...) if the first write has up to
    MOST_FOLDERS feeds; with more, feeds share as many packs (_pack=..., a column when it is read), ordered by feed, and a pack
    that has one of the feeds is written anew, by one writer at a time. The first write settles which. Feeds of any size:
    rebalancing splits a large one over several files.
    """
    spark, folder = df.sparkSession, manifest.Folder(df.sparkSession, path)
    laid = {n.split("=")[0] for n in folder.children() if "=" in n}
    if not laid and df.select("feed_id").distinct().limit(manifest.MOST_FOLDERS + 1).count() > manifest.MOST_FOLDERS:
        _replace_folders(manifest.with_pack(df), path, "_pack", "feed_id")
    elif "_pack" not in laid:
        _replace_folders(df, path, "feed_id")
    else:
        # the new rows are made once, and laid down before the others of their packs are read; names of feeds fit into the driver
        beside = manifest.Folder(spark, f"{shared_folder(spark)}/products-{uuid.uuid4().hex}")
        manifest.with_pack(df).write.parquet(beside.name)
        new = spark.read.parquet(beside.name)
        feeds, packs = new.select(manifest.feed_text().alias("_feed")).distinct(), [r[0] for r in new.select("_pack").distinct().collect()]
        old = spark.read.parquet(path)
        kept = old.where(F.col("_pack").isin(packs)).withColumn("_feed", manifest.feed_text()).join(F.broadcast(feeds), "_feed", "left_anti").drop("_feed")
        _replace_folders(new.unionByName(kept, allowMissingColumns=True), path, "_pack", "feed_id")
        beside.drop()


def _replace_folders(rows: DataFrame, path: str, by: str, *within: str) -> None:
    dealt = rows.hint("rebalance", by)
    dealt = dealt.sortWithinPartitions(by, *within) if within else dealt
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def current_version(spark: SparkSession, base: str) -> int | None:
    """None only if nothing is published yet; any failure to look is an error."""
    return manifest.current(spark, base).number or None


def publish_snapshot(
    df: DataFrame, base: str, on_complete: Callable[[DataFrame], object] | None = None, based_on: int | None = None
) -> int:
    """The whole table as the next version; an empty one is refused. A reader sees the old or the new version, and of
    two writers the second gets the number after the first's. ``based_on``: the version that ``df`` was made
    from; Conflict if another one came between. Changes of what is there go through ``publish_change``.

    ``on_complete`` (X3) takes the published table once readers see it.
    """
    spark = df.sparkSession
    version = manifest.commit(spark, base, lambda _: df, based_on=based_on, allow_empty=False)
    if on_complete is not None:
        on_complete(read_snapshot(spark, base, version))
    return version


def publish_change(spark: SparkSession, base: str, make: Callable[[DataFrame | None], DataFrame], feed_ids: list | None = None, progress: manifest.Progress | None = None) -> int:
    """The next version, with the rows of ``feed_ids`` (None: of all feeds) replaced by what ``make`` gives for them. Only
    these feeds are read and written; ``make`` is called again where another writer changed them.
    """
    return manifest.commit(spark, base, make, None if feed_ids is None else manifest.feed_names(feed_ids), progress=progress)


def read_snapshot(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    found = manifest.read_feeds(spark, base, manifest.current(spark, base, version))
    if found is None:
        raise ValueError(f"nothing is published at {base}")
    return found


def compact_log(log: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """S3: the last entry of each id; entries without an id are dropped."""
    window = Window.partitionBy(key).orderBy(F.desc(order))
    return log.where(non_empty(F.col(key)).isNotNull()).withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def _shown_price(products: DataFrame) -> Column:
    sale = F.coalesce(F.col("sale_price").cast("double"), F.lit(0.0)) if "sale_price" in products.columns else F.lit(0.0)
    price = F.coalesce(F.col("price").cast("double"), F.lit(0.0))
    return F.when((sale > 0) & (sale < price), sale).otherwise(price)


def listed_nodes(products: DataFrame, by: str, order: list[str]) -> DataFrame:
    """S4, flat: products with name, picture, link, price and currency, numbered within ``by``."""
    filled = [F.trim(F.coalesce(F.col(c), F.lit(""))) != "" for c in ("product_name", "image_url", "affiliate_link", "currency")]
    rows = products.withColumn("shown", _shown_price(products)).where(filled[0] & filled[1] & filled[2] & filled[3] & (F.col("shown") > 0))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def post_products(refs: DataFrame, products: DataFrame) -> DataFrame:
    """The products that each post refers to (post_id, product_id, in any order), an active row of an id before others,
    then the smallest feed_id. A post's list is bounded by its references.
    """
    asked = refs.where(F.col("product_id").isNotNull()).select("post_id", F.col("product_id").alias("external_id")).distinct()
    rows = products.join(asked.select("external_id").distinct(), "external_id", "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in products.columns])
    first = F.struct((F.col("status") != "active").alias("other"), F.col("feed_id"))
    best = rows.groupBy("external_id").agg(F.min_by(row, first).alias("_row")).select("_row.*")
    return asked.join(best, "external_id")


def to_jsonld(products: DataFrame, by: str, order: list[str], transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(by, jsonld): an ItemList of the listed products; ``transform`` may change the nodes."""
    nodes = listed_nodes(products, by, order)
    nodes = transform(nodes) if transform else nodes
    offer = F.struct(
        F.lit("Offer").alias("@type"), F.trim("affiliate_link").alias("url"), F.format_string("%.2f", "shown").alias("price"),
        F.upper(F.trim("currency")).alias("priceCurrency"), F.lit("https://schema.org/InStock").alias("availability"),
    )
    item = F.struct(
        F.col("position"), F.lit("ListItem").alias("@type"),
        F.struct(F.lit("Product").alias("@type"), F.trim("product_name").alias("name"), F.trim("image_url").alias("image"), offer.alias("offers"),
                 F.when(non_empty(F.col("brand")).isNotNull(), F.struct(F.lit("Brand").alias("@type"), F.col("brand").alias("name"))).alias("brand"), non_empty(F.col("external_id")).alias("sku")).alias("item"),
    )
    whole = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("ItemList").alias("@type"), F.array_sort(F.collect_list(item)).alias("itemListElement"))
    return nodes.groupBy(by).agg(F.to_json(whole).alias("jsonld"))


def write_product_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, the JSON remainder below the stored columns."""
    from_product_rows(df).select(F.to_json("product").alias("value")).write.mode("overwrite").text(path)
