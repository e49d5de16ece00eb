"""Counts and reports over the product table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions.values import any_of, blank, zero

ACTIVE = "active"
#: The columns of the mapping-quality report, their tier and their standard field.
QUALITY_FIELDS = (
    ("product_name", "required", "title"),
    ("price", "required", "price"),
    ("image_url", "required", "image_url"),
    ("affiliate_link", "required", "affiliate_link"),
    ("brand", "important", "brand"),
    ("original_price", "important", "old_price"),
    ("category", "optional", "category"),
    ("currency", "optional", "currency"),
    ("in_stock", "optional", "availability"),
)
#: Weights of missing fields in the ranking of worst-mapped products.
MISSING_WEIGHTS = (
    ("product_name", 2), ("price", 2), ("image_url", 2), ("affiliate_link", 2), ("brand", 1), ("original_price", 1), ("category", 1),
)
QUALITY_HIGH, QUALITY_MID = 90, 70


def is_missing(name: str) -> Column:
    c = F.col(name)
    if name in ("price", "original_price"):
        return zero(c)
    return c.isNull() if name == "in_stock" else blank(c)


def counts(products: DataFrame) -> DataFrame:
    """All rows and active rows."""
    return products.agg(F.count("*").alias("total"), F.count_if(F.col("status") == ACTIVE).alias("active"))


def feed_counts(products: DataFrame, feeds: DataFrame) -> DataFrame:
    """R2: active rows of each configured feed."""
    ours = products.where(F.col("status") == ACTIVE).join(feeds.select("feed_id").distinct(), "feed_id", "left_semi")
    return ours.groupBy("feed_id").agg(F.count("*").alias("products"))


def stats(products: DataFrame) -> DataFrame:
    """Totals by status and the last update."""
    return products.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == ACTIVE).alias("active"),
        F.count_if(F.col("status") == "unavailable").alias("unavailable"),
        F.max("last_updated").alias("last_updated"),
    )


def status_breakdown(products: DataFrame) -> DataFrame:
    """Rows by feed and status."""
    return products.groupBy("feed_id", "status").agg(F.count("*").alias("products"))


def mapping_quality(products: DataFrame) -> DataFrame:
    """R5, wide: per feed the complete rows, the percentage and nine missing counters."""
    complete = ~any_of([is_missing(n) | (F.col(n) < 0 if n == "price" else F.lit(False)) for n, tier, _ in QUALITY_FIELDS if tier == "required"])
    found = products.where(F.col("status") == ACTIVE).groupBy("feed_name").agg(
        F.count("*").alias("total"),
        F.count_if(complete).alias("complete"),
        *[F.count_if(is_missing(n)).alias(f"missing_{n}") for n, _, _ in QUALITY_FIELDS],
    )
    return found.withColumn("quality", F.round(F.col("complete") * 100 / F.col("total")).cast("long"))


def mapping_quality_fields(products: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """R5, long: a row per feed and field with tier, missing count and source column.

    ``mappings``: feed_name, standard, source.
    """
    wide = mapping_quality(products)
    rows = F.explode(
        F.array(*[F.struct(F.lit(n).alias("field"), F.lit(t).alias("tier"), F.lit(s).alias("standard"), F.col(f"missing_{n}").alias("missing")) for n, t, s in QUALITY_FIELDS])
    )
    long = wide.select("feed_name", "quality", rows.alias("r")).select("feed_name", "quality", "r.*")
    if mappings is None:
        return long.withColumn("source", F.lit(None).cast("string"))
    return long.join(mappings.select("feed_name", "standard", F.nullif("source", F.lit("")).alias("source")), ["feed_name", "standard"], "left")


def worst_products(products: DataFrame, k: int = 3) -> DataFrame:
    """The k rows of each feed with the largest weighted number of missing fields."""
    score = sum((F.when(is_missing(n), w).otherwise(0) for n, w in MISSING_WEIGHTS), F.lit(0))
    missing = F.filter(F.array(*[F.when(is_missing(n), F.lit(n)) for n, _ in MISSING_WEIGHTS]), lambda x: x.isNotNull())
    order = Window.partitionBy("feed_name").orderBy(F.desc("score"), "external_id")
    return (
        products.where(F.col("status") == ACTIVE)
        .select("feed_name", "external_id", F.coalesce(F.nullif("product_name", F.lit("")), F.lit("(empty)")).alias("product_name"), score.alias("score"), missing.alias("missing_fields"))
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        .withColumn("missing_count", F.size("missing_fields"))
    )


def orphan_preview(products: DataFrame, feeds: DataFrame) -> DataFrame:
    """Rows of unconfigured feeds: in all, by feed_name and by feed_id."""
    lost = products.join(feeds.select("feed_id").distinct(), "feed_id", "left_anti")
    return lost.groupingSets([("feed_name",), ("feed_id",), ()], "feed_name", "feed_id").agg(F.count("*").alias("products"))


def quality_bucket(quality: Column) -> Column:
    """High, mid or low."""
    return F.when(quality >= QUALITY_HIGH, "high").when(quality >= QUALITY_MID, "mid").otherwise("low")


def dashboard(products: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row: active products, feeds, average mapping quality, last update."""
    quality = mapping_quality(products).join(feeds.select("feed_name").distinct(), "feed_name", "left_semi")
    head = products.agg(F.count_if(F.col("status") == ACTIVE).alias("products"), F.max("last_updated").alias("last_sync"))
    average = quality.agg(F.round(F.avg("quality")).cast("long").alias("avg_quality"))
    # three one-row tables
    return head.crossJoin(feeds.agg(F.count("*").alias("feeds"))).crossJoin(average)


def refresh_feed_stats(feeds: DataFrame, products: DataFrame) -> DataFrame:
    """The registry with product_count and mapping_quality brought up to date."""
    kept = feeds.drop("product_count", "mapping_quality")
    quality = mapping_quality(products).select("feed_name", F.col("quality").alias("mapping_quality"))
    counted = feed_counts(products, feeds).withColumnRenamed("products", "product_count")
    return kept.join(counted, "feed_id", "left").join(quality, "feed_name", "left").fillna(0, ["product_count", "mapping_quality"])


def dead_products(refs: DataFrame, products: DataFrame) -> DataFrame:
    """Posts with referenced ids that exist but are never active; unknown ids are not dead.

    refs: post_id, title, product_id. Numeric ids may name the surrogate key ``id`` where the
    product table has one.
    """
    by_id = products.groupBy(F.col("external_id").alias("product_id")).agg(F.max(F.col("status") == ACTIVE).alias("alive"))
    if "id" in products.columns:
        by_key = products.select(F.col("id").cast("string").alias("product_id"), (F.col("status") == ACTIVE).alias("alive"))
        by_id = by_id.unionByName(by_key).groupBy("product_id").agg(F.max("alive").alias("alive"))
    dead = refs.select("post_id", "title", "product_id").distinct().join(by_id.where(~F.col("alive")), "product_id", "left_semi")
    return dead.groupBy("post_id", "title").agg(F.count("*").alias("dead"), F.array_sort(F.collect_set("product_id")).alias("dead_ids"))


def reference_integrity(refs: DataFrame, products: DataFrame) -> DataFrame:
    """For each referenced id whether it is found (an active row first) and what it has."""
    has = {"has_price": ~zero(F.col("price")), "has_image": ~blank(F.col("image_url")), "has_brand": ~blank(F.col("brand")), "has_link": ~blank(F.col("affiliate_link"))}
    # only rows that are asked for, and of each id the first by an aggregate
    asked = products.join(refs.select(F.col("product_id").alias("external_id")).distinct(), "external_id", "left_semi")
    row = F.struct(*[c.cast("int").alias(n) for n, c in has.items()], F.lit(1).alias("found"))
    first = F.struct((F.col("status") != ACTIVE).alias("other"), F.col("feed_id"))
    flags = asked.groupBy(F.col("external_id").alias("product_id")).agg(F.min_by(row, first).alias("r")).select("product_id", "r.*")
    return refs.select("product_id").distinct().join(flags, "product_id", "left").fillna(0, ["found", *has])


def build_vocab(products: DataFrame, stops: DataFrame, brand_weight: int = 100, least: int = 3) -> DataFrame:
    """Brand names (3 characters or more, weight 100) and name words (4 or more, no stop
    words) with their frequency, at least ``least``; a brand keeps adding its counts as a word.
    """
    active = products.where(F.col("status") == ACTIVE)
    brands = active.select(F.lower(F.trim("brand")).alias("token")).where(F.length("token") >= 3).distinct().withColumn("freq", F.lit(brand_weight).cast("long"))
    words = active.select(F.explode(F.split(F.lower("product_name"), r"[^\p{L}\p{N}]+")).alias("token")).where(F.length("token") >= 4)
    words = words.join(F.broadcast(stops.select("token")), "token", "left_anti").groupBy("token").agg(F.count("*").alias("freq"))
    return brands.unionByName(words).groupBy("token").agg(F.sum("freq").alias("freq")).where(F.col("freq") >= least)


def known_brands(products: DataFrame) -> DataFrame:
    """Distinct brands in lower case."""
    return products.where(~blank(F.col("brand"))).select(F.lower("brand").alias("brand")).distinct()


def reference_stats(refs: DataFrame) -> DataFrame:
    """References, distinct ids and posts by how they were found."""
    return refs.groupBy("resolver").agg(
        F.count("*").alias("refs"), F.countDistinct("product_id").alias("ids"), F.countDistinct("post_id").alias("posts")
    )


def live_ids(products: DataFrame) -> DataFrame:
    """Ids that are active or being imported."""
    return products.where(F.col("status").isin(ACTIVE, "importing")).select("external_id").distinct()
