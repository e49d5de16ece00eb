"""Joins against the product table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions.staging import staged
from feedlake.functions.values import blank, non_empty, zero
from feedlake.operators.postings import bounded
from feedlake.operators.reports import ACTIVE

#: Keys in the JSON remainder that group colour variants, the first filled one counts.
GROUP_KEYS = (
    "item_group_id", "group_id", "product_group_id", "parent_sku", "master_product_id", "base_product_id", "aw_group_id", "parent_id",
)
#: Letter sizes in order.
LETTER_SIZES = ("XXS", "XS", "S", "M", "L", "XL", "XXL", "XXXL")


def active_first(*more: str) -> list[Column]:
    return [F.when(F.col("status") == ACTIVE, 0).otherwise(1), *[F.col(c) for c in more]]


def resolve(ids: DataFrame, products: DataFrame) -> DataFrame:
    """One row per id (product_id): an active row before any other, then the smallest feed_id."""
    order = Window.partitionBy("product_id").orderBy(*active_first("feed_id"))
    joined = ids.select("product_id").distinct().join(products, F.col("product_id") == F.col("external_id"))
    return joined.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "product_id")


def fetch(ids: DataFrame, products: DataFrame) -> DataFrame:
    """All rows of the ids, whatever their status."""
    return products.join(ids.select(F.col("product_id").alias("external_id")).distinct(), "external_id", "left_semi")


def resolve_multi(ids: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """One row per id from the first source that has it; ``source_rank`` says which."""
    ranked = [s.withColumn("source_rank", F.lit(k)) for k, s in enumerate(sources)]
    every = ranked[0]
    for s in ranked[1:]:
        every = every.unionByName(s, allowMissingColumns=True)
    order = Window.partitionBy("external_id").orderBy("source_rank", *active_first("feed_id"))
    wanted = every.join(ids.select(F.col("product_id").alias("external_id")).distinct(), "external_id", "left_semi")
    return wanted.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def size_rank(size: Column) -> Column:
    """Sort key of a size: numbers, then letter sizes in order, then other text."""
    number = size.try_cast("double")
    letter = F.array_position(F.array(*[F.lit(s) for s in LETTER_SIZES]), F.upper(size))
    return F.struct(
        F.when(number.isNotNull(), 0).when(letter > 0, 1).otherwise(2).alias("kind"),
        F.coalesce(number, letter.cast("double")).alias("place"),
        size.alias("size"),
    )


def raw_size(raw: Column) -> Column:
    """The size in the JSON remainder: size, attributes.size or 'Fashion:size'."""
    first = lambda path: F.coalesce(non_empty(F.get_json_object(raw, f"{path}[0]")), non_empty(F.get_json_object(raw, path)))
    return F.coalesce(first("$.size"), first("$.attributes.size"), first("$['Fashion:size']"))


def available_sizes(products: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Sizes of each (product_name, colour) among active rows, in order; ``keys`` restricts them."""
    rows = products.where(F.col("status") == ACTIVE).select("product_name", "colour", raw_size(F.col("raw_data")).alias("size")).where("size IS NOT NULL")
    if keys is not None:
        rows = rows.join(keys.select("product_name", "colour").distinct(), ["product_name", "colour"], "left_semi")
    ranked = F.array_sort(F.collect_set(size_rank(F.trim("size"))))
    return rows.groupBy("product_name", "colour").agg(F.transform(ranked, lambda s: s["size"]).alias("sizes"))


def group_key(raw: Column) -> Column:
    """'key=value' of the first filled group key in the JSON remainder."""
    # a text without the key, and without an escape that may stand for its letters, isn't parsed for it
    filled = lambda k: F.when(raw.contains(k) | raw.contains("\\"), F.nullif(F.get_json_object(raw, f"$.{k}"), F.lit("")))
    return F.coalesce(*[F.concat(F.lit(f"{k}="), filled(k)) for k in GROUP_KEYS])


def _colour_rows(products: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active rows with their group key, own colour and whether they are asked for; what each of their names says): a name is
    taken apart once, whoever lists it.
    """
    from feedlake.operators.normalize import base_name, name_colour

    asked = ids.select("feed_id", "external_id").distinct().withColumn("asked", F.lit(True))
    own = F.nullif(F.trim(F.lower("colour")), F.lit("")).alias("own")
    rows = products.where(F.col("status") == ACTIVE).select("feed_id", "external_id", "product_name", "in_stock", own, group_key(F.col("raw_data")).alias("grp"))
    rows = staged(rows.join(asked, ["feed_id", "external_id"], "left"))
    name = F.col("product_name")
    return rows, staged(rows.select(name).distinct().select(name, F.lower(name_colour(name)).alias("named"), base_name(name).alias("base")))


def colour_siblings(products: DataFrame, ids: DataFrame) -> DataFrame:
    """For each (feed_id, external_id) the colour variants, one row per colour.

    Strategy 0: same feed and group key, if the product has one. 1: same feed and name with two
    colours or more. 2: same feed and colour-stripped name of 4 characters or more, colours also
    read from the name, with two or more. The first that applies counts, and only with two
    colours. A colour shows an in-stock row first, then the smallest id; the product's own colour
    comes first, the others by name.
    """
    # ids meet the products once; the three groupings and the products asked for read the result
    rows, names = _colour_rows(products, ids)
    named = rows.join(bounded(names), "product_name", "left").withColumn("shade", F.coalesce("own", "named"))

    def groups(rows: DataFrame, key: str, colour: str, out: str) -> DataFrame:
        """The shown row of each colour of a group of two colours or more, as one array a group; a colour is one row
        before that, so what is gathered grows with the colours, not with the products.
        """
        shown = F.min(F.struct(F.when(F.col("in_stock") == 1, 0).otherwise(1).alias("stock"), F.col("external_id")))["external_id"].alias("external_id")
        each = rows.where(F.col(key).isNotNull() & F.col(colour).isNotNull()).groupBy("feed_id", key, F.col(colour).alias("colour")).agg(shown)
        listed = each.groupBy("feed_id", key).agg(F.collect_list(F.struct("colour", "external_id")).alias(out))
        return listed.where(F.size(out) >= 2)

    # a product has a group key or it hasn't: neither half meets the other's groupings
    keyed = rows.where("asked AND grp IS NOT NULL").select("feed_id", F.col("external_id").alias("for_id"), "grp", "own")
    loose = named.where("asked AND grp IS NULL").select("feed_id", F.col("external_id").alias("for_id"), "product_name", "base", "own", "shade")
    found = keyed.join(groups(rows, "grp", "own", "_0"), ["feed_id", "grp"])
    loose = loose.join(groups(rows, "product_name", "own", "_1"), ["feed_id", "product_name"], "left")
    loose = loose.join(groups(named, "base", "shade", "_2").where(F.length("base") >= 4), ["feed_id", "base"], "left")
    chosen = found.select("feed_id", "for_id", F.lit(0).alias("strategy"), F.col("own").alias("mine"), F.col("_0").alias("colours")).unionByName(
        loose.where("_1 IS NOT NULL OR _2 IS NOT NULL").select(
            "feed_id", "for_id", F.when(F.col("_1").isNotNull(), 1).otherwise(2).alias("strategy"),
            F.when(F.col("_1").isNotNull(), F.col("own")).otherwise(F.col("shade")).alias("mine"), F.coalesce("_1", "_2").alias("colours"),
        )
    )
    order = F.transform("colours", lambda c: F.struct(F.when(c["colour"].eqNullSafe(F.col("mine")), 0).otherwise(1).alias("other"), c["colour"].alias("colour"), c["external_id"].alias("external_id")))
    each = chosen.select("feed_id", "for_id", "strategy", F.posexplode(F.array_sort(order)).alias("n", "c"))
    return each.select("feed_id", "for_id", "strategy", (F.col("n") + 1).alias("position"), "c.external_id", "c.colour")


def extract_refs(posts: DataFrame, marker: str, shortcode: str | None = None) -> DataFrame:
    """(post_id, title, product_id, resolver) from block comments and shortcodes in post_content.

    A block is ``<!-- wp:<marker> {json} -->``; its JSON holds selectedProducts (objects with id)
    or productIds (a list in a string). Every block has its own comment, so nested ones need no
    recursion. A shortcode is ``[<marker> ids="1,2"]``.
    """
    code = shortcode or marker.replace("/", "-")
    content = F.coalesce(F.col("post_content"), F.lit(""))
    blocks = F.regexp_extract_all(content, F.lit(rf"(?s)<!--\s*wp:{marker}\s+(\{{.*?\}})\s*/?-->"), F.lit(1))
    base = posts.select("post_id", "title", content.alias("c"), blocks.alias("blocks"))
    in_blocks = base.select("post_id", "title", F.explode("blocks").alias("j")).select(
        "post_id", "title", F.from_json("j", "selectedProducts array<struct<id:string>>, productIds string").alias("j")
    )
    objects = in_blocks.select("post_id", "title", F.explode("j.selectedProducts.id").alias("product_id"))
    listed = in_blocks.select("post_id", "title", F.explode(F.split("j.productIds", ",")).alias("product_id"))
    codes = base.select("post_id", "title", F.explode(F.regexp_extract_all("c", F.lit(rf'\[{code}[^\]]*ids="([^"]*)"'), F.lit(1))).alias("ids"))
    coded = codes.select("post_id", "title", F.explode(F.split("ids", ",")).alias("product_id"))
    found = objects.unionByName(listed).withColumn("resolver", F.lit("block")).unionByName(coded.withColumn("resolver", F.lit("shortcode")))
    return found.withColumn("product_id", F.trim("product_id")).where(~blank(F.col("product_id"))).distinct()


def _best_of(products: DataFrame, refs: DataFrame, *names: str) -> DataFrame:
    """product_id and the named columns of the best row (active first, smallest feed_id) of each referenced id."""
    used = products.join(refs.select(F.col("product_id").alias("external_id")).distinct(), "external_id", "left_semi")
    first = F.min_by(F.struct(*names), F.struct(F.when(F.col("status") == ACTIVE, 0).otherwise(1), F.col("feed_id"))).alias("b")
    return used.groupBy(F.col("external_id").alias("product_id")).agg(first).select("product_id", "b.*")


def resolve_cards(refs: DataFrame, products: DataFrame) -> DataFrame:
    """State of each selected product: resolved, unavailable, missing, or fallback to what the
    block stored (stored_title) where the catalog has no row.
    """
    best = _best_of(products, refs, "status", "product_name")
    state = (
        F.when(F.col("status") == ACTIVE, "resolved").when(F.col("status").isNotNull(), "unavailable")
        .when(non_empty(F.col("stored_title")).isNotNull(), "fallback").otherwise("missing")
    )
    return refs.join(best, "product_id", "left").select("post_id", "product_id", state.alias("state"), F.coalesce("product_name", "stored_title").alias("title"))


def refresh_refs(refs: DataFrame, products: DataFrame) -> DataFrame:
    """Stored selections with current values where the catalog has them, else the old ones."""
    best = _best_of(products, refs, "product_name", "price").select(
        "product_id", F.col("product_name").alias("_title"), F.when(~zero(F.col("price")), F.col("price")).alias("_price")
    )
    return refs.join(best, "product_id", "left").select(
        "post_id", "product_id", F.coalesce(non_empty(F.col("_title")), F.col("stored_title")).alias("title"), F.coalesce("_price", "stored_price").alias("price")
    )


def rename_marker(posts: DataFrame, old: str, new: str) -> DataFrame:
    """Block markers renamed inside post_content."""
    return posts.withColumn("post_content", F.replace("post_content", F.lit(f"wp:{old}"), F.lit(f"wp:{new}")))
