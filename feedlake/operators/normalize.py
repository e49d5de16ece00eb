"""Normalization projections over a whole feed or product table.

Each function adds or replaces columns and leaves the others alone. ``raw`` columns are the feed's
own; functions that read them skip the names a feed lacks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.values import (
    CODE_PATTERN, column, first_of, is_number, leading_number, non_empty, present, price_number,
    price_number_locale, price_number_no_commas,
)

#: Feed columns that fill a standard field, in order.
ID_FIELDS = ("aw_product_id", "product_id", "id", "sku")
TITLE_FIELDS = ("product_name", "title", "name", "n")
LINK_FIELDS = ("aw_deep_link", "merchant_deep_link", "deep_link", "product_url", "link", "url")
HIRES_FIELDS = (
    "large_image_url", "large_image", "original_image_url", "original_image", "hires_image_url", "hires_image", "full_image_url", "full_image",
)
IMAGE_FIELDS = ("merchant_image_url", "aw_image_url", *HIRES_FIELDS, "image_url", "image", "image_link", "picture")
MORE_IMAGE_FIELDS = ("alternate_image", "alternate_image_two", "alternate_image_three", "alternate_image_four", "additional_image_link")
BRAND_FIELDS = ("brand_name", "brand", "manufacturer", "vendor")
MERCHANT_FIELDS = ("merchant_name", "advertiser_name", "shop_name", "shopname", "store_name", "retailer_name", "seller_name", "program_name")
PRICE_FIELDS = ("search_price", "store_price", "price", "display_price", "current_price", "sale_price")
OLD_PRICE_FIELDS = ("rrp_price", "product_price_old", "rrp", "msrp", "list_price", "original_price", "was_price", "oldprice")
DISCOUNT_FIELDS = ("savings_percent", "saving", "discount", "discount_percent", "discount_percentage")
CURRENCY_FIELDS = ("currency", "currencyId", "currency_code", "currencyCode")
PRICE_TEXT_FIELDS = ("price", "sale_price", "search_price")
SHIPPING_FIELDS = ("delivery_cost", "shipping_cost", "shipping_price", "shipping")
CATEGORY_FIELDS = ("category_name", "category", "product_type", "categoryId", "google_product_category_text")
COLOUR_FIELDS = ("colour", "color", "Fashion:swatch", "Fashion:colour")
DESCRIPTION_FIELDS = ("product_short_description", "description", "long_description")
FALLBACKS = {
    "id": ID_FIELDS, "title": TITLE_FIELDS, "affiliate_link": LINK_FIELDS, "image_url": IMAGE_FIELDS, "brand": BRAND_FIELDS,
    "category": CATEGORY_FIELDS, "shipping": SHIPPING_FIELDS, "description": DESCRIPTION_FIELDS,
}
#: Characters of each stored column.
COLUMN_LIMITS = {
    "external_id": 100, "product_name": 500, "currency": 10, "brand": 200, "category": 200, "status": 20, "feed_name": 255,
    "image_url": 65000, "affiliate_link": 65000,
}
#: Colour phrases recognised inside product names.
COLOUR_PHRASES = (
    "light wash", "dark wash", "medium wash", "stone wash", "acid wash", "black wash", "blue wash",
    "light blue", "dark blue", "navy blue", "royal blue", "light grey", "dark grey", "light gray", "dark gray",
    "light green", "dark green", "olive green", "off white", "bone white", "natural white", "hot pink", "dusty pink",
    "black", "white", "red", "blue", "green", "yellow", "brown", "gray", "grey", "pink", "purple", "orange", "navy",
    "beige", "khaki", "olive", "cream", "ivory", "maroon", "burgundy", "teal", "turquoise", "mint", "lime", "gold",
    "silver", "indigo", "vintage", "faded", "schwarz", "weiss", "weiß", "rot", "blau", "gruen", "grün", "gelb",
    "braun", "grau", "rosa", "lila", "türkis", "tuerkis",
)
COLOUR_PATTERN = r"(?i)(?U)\b(" + "|".join(p.replace(" ", r"\s+") for p in sorted(COLOUR_PHRASES, key=len, reverse=True)) + r")\b"
#: How sizes are written.
SIZES = r"XXXL|XXL|XL|XS|S|M|L|EU\s*\d+|US\s*\d+|UK\s*\d+|\d{2,3}"
#: Symbols of the display price.
CURRENCY_SIGNS = {"EUR": "€", "USD": "$", "GBP": "£", "JPY": "¥", "INR": "₹"}
SHIPPING_UNKNOWN, SHIPPING_FREE = "Shipping costs may apply", "Free Shipping"
PRICE_MODES = {"strict": price_number, "mapper": price_number_no_commas, "locale": price_number_locale}


def with_price(df: DataFrame, src: str, dst: str, mode: str = "strict") -> DataFrame:
    """A number from price text. strict: '1,234.56' is 1; mapper: commas go; locale: both read."""
    return df.withColumn(dst, PRICE_MODES[mode](column(df, src)))


def fill_from(df: DataFrame, target: str, candidates: tuple[str, ...] | None = None) -> DataFrame:
    """``target`` where it is filled, else the first filled candidate (lists give their first)."""
    found = F.trim(first_of(df, candidates or FALLBACKS[target]))
    return df.withColumn(target, F.coalesce(non_empty(column(df, target)), found) if target in df.columns else found)


def apply_priority(df: DataFrame, prefix: str = "") -> DataFrame:
    """C4: image_url and affiliate_link by source: merchant over thumbnail, tracked over direct
    link, and a high-resolution column over both images. ``prefix`` names the raw columns.
    """
    raw = lambda names: [present(column(df, prefix + n)) for n in names if prefix + n in df.columns]
    own = lambda n: [F.col(n)] if n in df.columns else []
    images = [*raw(HIRES_FIELDS), *raw(("merchant_image_url", "aw_image_url")), *own("image_url")]
    links = [*raw(("aw_deep_link", "merchant_deep_link")), *own("affiliate_link")]
    for name, found in (("image_url", images), ("affiliate_link", links)):
        df = df.withColumn(name, F.coalesce(*found)) if found else df
    return df


def with_merchant(df: DataFrame) -> DataFrame:
    """Merchant: the first candidate that is not an id (digits, or digits and letters)."""

    def name(c: Column) -> Column:
        v = F.trim(non_empty(c).cast("string"))
        return F.when(~v.rlike(r"^\d+$") & ~v.rlike(r"(?i)^\d+[A-Z]+$"), v)

    found = first_of(df, MERCHANT_FIELDS, name)
    return df.withColumn("merchant", F.coalesce(found, F.col("merchant")) if "merchant" in df.columns else found)


def with_prices(df: DataFrame, keep_equal: bool = False) -> DataFrame:
    """Price and old_price from raw columns.

    The first positive of six columns is the price; the first of eight above it is the old price
    (``keep_equal``: the first positive). Where sale_price is below price, they are the two.
    """
    positive = lambda c: F.when(price_number(non_empty(c)) > 0, price_number(c))
    price = F.coalesce(first_of(df, PRICE_FIELDS, positive).cast("double"), F.lit(0.0))
    df = df.withColumn("_price", price)
    above = positive if keep_equal else lambda c: F.when((price_number(non_empty(c)) > 0) & (price_number(c) > F.col("_price")), price_number(c))
    old = F.coalesce(F.round(first_of(df, OLD_PRICE_FIELDS, above).cast("double"), 2), F.lit(0.0))
    sale = price_number(non_empty(column(df, "sale_price"))) if "sale_price" in df.columns else F.lit(0.0)
    full = price_number(non_empty(column(df, "price"))) if "price" in df.columns else F.lit(0.0)
    swap = (sale > 0) & (full > 0) & (sale < full)
    df = df.withColumn("_old", F.when(swap, full).otherwise(old)).withColumn("_price", F.when(swap, sale).otherwise(F.col("_price")))
    return df.withColumn("price", F.col("_price")).withColumn("old_price", F.col("_old")).drop("_price", "_old")


def with_discount(df: DataFrame) -> DataFrame:
    """discount_percentage, from a column, else from the two prices; old_price from it if missing."""
    inside = lambda c: F.when((leading_number(non_empty(c)) > 0) & (leading_number(c) < 100), leading_number(c))
    direct = F.coalesce(F.round(first_of(df, DISCOUNT_FIELDS, inside).cast("double")), F.lit(0.0))
    price, old = F.coalesce("price", F.lit(0.0)), F.coalesce("old_price", F.lit(0.0))
    derived = (direct > 0) & (direct < 100) & (old <= 0) & (price > 0)
    df = df.withColumn("_direct", direct).withColumn("_old", F.when(derived, price / (1 - direct / 100)).otherwise(old))
    percent = F.when(
        (F.col("_direct") <= 0) & (F.col("_old") > price) & (price > 0), F.round((F.col("_old") - price) / F.col("_old") * 100)
    ).otherwise(F.col("_direct"))
    df = df.withColumn("discount_percentage", F.when((percent > 0) & (percent < 100), percent).cast("long"))
    return df.withColumn("old_price", F.round("_old", 2)).drop("_direct", "_old")


def reconcile_prices(df: DataFrame) -> DataFrame:
    """Price, old_price, sale_price and discount_percentage of mapped rows made consistent."""
    number = lambda n: leading_number(F.col(n)) if n in df.columns else F.lit(0.0)
    df = df.withColumns({"_p": number("price"), "_o": number("old_price"), "_s": number("sale_price"), "_d": number("discount_percentage")})
    lower = "_s > 0 and _o = 0 and _p > _s"
    df = df.withColumns({"_o": F.expr(f"if({lower}, _p, _o)"), "_p": F.expr(f"if({lower}, _s, _p)")})
    higher = "_s > 0 and _p > 0 and _s > _p"
    df = df.withColumns({"_o": F.expr(f"if({higher}, _p, _o)"), "_p": F.expr(f"if({higher}, _s, _p)")})
    given, back = "_d > 0 and _o > 0 and _p > 0", "_d > 0 and _d < 100 and _p > 0 and _o = 0"
    df = df.withColumns({
        "_percent": F.expr(f"case when {given} or ({back}) then round(_d) when _o > _p and _p > 0 then round((_o - _p) / _o * 100) when _d <> 0 then _d end"),
        "_o": F.expr(f"if(not ({given}) and {back}, round(_p / (1 - _d / 100), 2), _o)"),
    })
    return df.withColumns({"price": F.col("_p"), "old_price": F.col("_o"), "discount_percentage": F.col("_percent")}).drop("_p", "_o", "_s", "_d", "_percent")


def with_currency(df: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """Currency: a column, else a code inside a price text, else the feed's default of three
    letters (``feeds``: feed_id, default_currency); never a fixed default.
    """
    code = lambda c: F.nullif(F.upper(F.regexp_extract(c.cast("string"), CODE_PATTERN, 1)), F.lit(""))
    found = F.coalesce(F.trim(first_of(df, CURRENCY_FIELDS)), first_of(df, PRICE_TEXT_FIELDS, code))
    if feeds is None:
        return df.withColumn("currency", found)
    default = feeds.select("feed_id", F.when(F.col("default_currency").rlike("^[A-Za-z]{3}$"), F.upper("default_currency")).alias("_default"))
    return df.join(default, "feed_id", "left").withColumn("currency", F.coalesce(found, "_default")).drop("_default")


def shipping_text(shipping: Column, currency: Column, embedded: bool = True) -> Column:
    """Words for a shipping cost; ``embedded``: 'DE::Ground:3.49' counts as 3.49."""
    filled = non_empty(F.nullif(F.trim(shipping.cast("string")), F.lit("")))
    number = F.when(is_number(filled), F.trim(filled).try_cast("double"))
    if embedded:
        number = F.coalesce(number, F.nullif(F.regexp_extract(filled, r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double"))
    priced = F.concat(F.lit("Shipping: "), F.format_number(number, 2), F.lit(" "), F.coalesce(currency, F.lit("EUR")))
    return F.when(filled.isNull() | number.isNull(), SHIPPING_UNKNOWN).when(number == 0, SHIPPING_FREE).otherwise(priced)


def with_shipping_text(df: DataFrame, embedded: bool = True) -> DataFrame:
    return df.withColumn("shipping_text", shipping_text(F.col("shipping"), F.col("currency"), embedded))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def clean_title(text: Column) -> Column:
    return shortened(F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), "[™®©]", ""), 200)


def clean_description(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""), r"<[^>]*>", "")
    return shortened(F.regexp_replace(F.trim(bare), r"\s+", " "), 500)


def clean_url(url: Column) -> Column:
    u = F.trim(url)
    return F.when(non_empty(u).isNotNull() & ~u.rlike("^https?://"), F.concat(F.lit("http://"), u)).otherwise(u)


def clean_text(df: DataFrame) -> DataFrame:
    """C11: titles, descriptions and links cleaned (cut by characters)."""
    rules = {"title": clean_title, "product_name": clean_title, "description": clean_description, "image_url": clean_url, "affiliate_link": clean_url}
    return df.withColumns({n: f(F.col(n)) for n, f in rules.items() if n in df.columns})


def split_attributes(c: Column) -> Column:
    """An attribute's values, split on commas and trimmed."""
    return F.transform(F.split(c, ","), lambda x: F.trim(x))


def split_images(c: Column) -> Column:
    """Image links split on comma, bar or semicolon, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, "[,|;]"), lambda x: F.trim(x)), lambda x: non_empty(x).isNotNull())


def with_images(df: DataFrame) -> DataFrame:
    """additional_images: alternates, then repeated pictures, unique in order."""
    lists = [F.array(non_empty(F.col(n))) for n in MORE_IMAGE_FIELDS if n in df.columns]
    if dict(df.dtypes).get("picture", "").startswith("array"):
        lists.append(F.coalesce("picture", F.array().cast("array<string>")))
    found = F.array_distinct(F.filter(F.concat(*lists), lambda x: non_empty(x).isNotNull())) if lists else F.array().cast("array<string>")
    return df.withColumn("additional_images", found)


def param_value(param: Column, key: str) -> Column:
    """The first value of a key in 'size:28|gender:male'; a value may hold colons."""
    pairs = F.transform(F.split(param, r"\|"), lambda p: F.split(p, ":", 2))
    hit = F.filter(pairs, lambda p: (F.size(p) == 2) & (F.trim(F.get(p, F.lit(0))) == key))
    return non_empty(F.trim(F.get(F.get(hit, F.lit(0)), F.lit(1))))


def with_attributes(df: DataFrame) -> DataFrame:
    """C14: color, size, gender and material from the colour columns, the param pairs, then the
    param_* columns; a value that is there already stays.
    """
    keys = {"color": ("color", "colour"), "size": ("size",), "gender": ("gender",), "material": ("material",)}
    for target, names in keys.items():
        options = [non_empty(F.col(f"attr_{target}"))] if f"attr_{target}" in df.columns else []
        if target == "color":
            options += [non_empty(column(df, n)) for n in COLOUR_FIELDS if n in df.columns]
        options += [param_value(F.col("param"), n) for n in names] if "param" in df.columns else []
        options += [non_empty(F.col(f"param_{n}")) for n in names if f"param_{n}" in df.columns]
        df = df.withColumn(f"attr_{target}", F.coalesce(*options) if options else F.lit(None).cast("string"))
    return df


def sanitize(df: DataFrame, limits: Mapping[str, int] = COLUMN_LIMITS) -> DataFrame:
    """Control characters out of every text, stored columns cut to their limits."""
    out = {}
    for name, kind in df.dtypes:
        if kind == "string":
            clean = F.regexp_replace(F.col(f"`{name}`"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
            out[name] = F.substring(clean, 1, limits.get(name, 65000))
    return df.withColumns(out)


def filter_valid_ids(df: DataFrame, name: str = "external_id") -> DataFrame:
    """Ids that are filled after trimming and take 200 bytes at most."""
    c = F.trim(F.col(name))
    return df.where((c != "") & (F.octet_length(c) <= 200))


def to_product_rows(df: DataFrame, feed_id: int | Column, feed_name: str | Column) -> DataFrame:
    """C17: mapped rows (id, title, ...) to stored rows; columns without a place go to raw_data."""
    has = lambda *names: [F.col(n) for n in names if n in df.columns]
    pick = lambda *names: F.coalesce(*[non_empty(c) for c in has(*names)], F.lit(""))
    given = lambda default, *names: F.coalesce(*has(*names), F.lit(default))
    stored = {
        "id", "title", "product_name", "price", "old_price", "original_price", "currency", "image_url", "affiliate_link", "brand", "category",
        "colour", "color", "in_stock", "status", "merchant", "feed_name", "feed_id", "last_updated", "unavailable_since",
    }
    rest = [F.col(f"`{c}`") for c in df.columns if c not in stored]
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    whole = F.coalesce(leading_number(given("1", "in_stock")).cast("int"), F.lit(1)) if has("in_stock") else F.lit(1)
    return df.select(
        given("", "id").cast("string").alias("external_id"),
        as_column(feed_id).cast("int").alias("feed_id"),
        F.substring(as_column(feed_name), 1, 255).alias("feed_name"),
        given("", "title", "product_name").alias("product_name"),
        leading_number(given("0", "price")).cast("decimal(10,2)").alias("price"),
        leading_number(given("0", "old_price", "original_price")).cast("decimal(10,2)").alias("original_price"),
        given("EUR", "currency").alias("currency"),
        pick("large_image", "merchant_image_url", "aw_image_url", "image_url", "aw_thumb_url").alias("image_url"),
        given("", "affiliate_link").alias("affiliate_link"),
        given("", "brand").alias("brand"),
        given("", "category").alias("category"),
        F.substring(pick("colour", "color", "attr_color"), 1, 200).alias("colour"),
        whole.alias("in_stock"),
        given("active", "status").alias("status"),
        (F.to_json(F.struct(*rest)) if rest else F.lit(None).cast("string")).alias("raw_data"),
    )


def from_product_rows(df: DataFrame) -> DataFrame:
    """``product``: the JSON remainder as a map, with the stored columns on top."""
    named = {
        "id": "external_id", "title": "product_name", "price": "price", "old_price": "original_price", "currency": "currency", "image_url": "image_url",
        "affiliate_link": "affiliate_link", "brand": "brand", "category": "category", "colour": "colour", "in_stock": "in_stock", "status": "status",
        "merchant": "feed_name",
    }
    explicit = F.create_map(*[x for k, c in named.items() if c in df.columns for x in (F.lit(k), F.col(c).cast("string"))])
    raw = F.coalesce(F.from_json("raw_data", "map<string,string>"), F.create_map().cast("map<string,string>"))
    below = F.map_filter(raw, lambda k, v: ~k.isin(*named))
    return df.withColumn("product", F.map_concat(below, explicit))


def search_text(df: DataFrame, keep_blanks: bool = False) -> Column:
    names = ("product_name", "brand", "feed_name", "category", "colour")
    part = (lambda c: F.coalesce(c, F.lit(""))) if keep_blanks else non_empty
    return F.concat_ws(" ", *[part(F.col(n)) for n in names if n in df.columns])


def with_search_text(df: DataFrame, overwrite: bool = False, keep_blanks: bool = False) -> DataFrame:
    """search_text where it is null or empty (or everywhere); the bulk form keeps blanks."""
    made = search_text(df, keep_blanks)
    if overwrite or "search_text" not in df.columns:
        return df.withColumn("search_text", made)
    return df.withColumn("search_text", F.coalesce(F.nullif("search_text", F.lit("")), made))


def backfill_colour(df: DataFrame) -> DataFrame:
    """C20: colour from the JSON remainder, only if no row of the table has a colour."""
    first = lambda path: F.coalesce(non_empty(F.get_json_object("raw_data", f"{path}[0]")), non_empty(F.get_json_object("raw_data", path)))
    paths = ("$.attributes.color", "$.attributes.colour", "$.colour", "$.color", "$['Fashion:colour']")
    found = F.substring(F.coalesce(*[first(p) for p in paths]), 1, 200)
    some = df.agg(F.count_if(F.coalesce(F.col("colour"), F.lit("")) != "").alias("_coloured"))  # one row
    return df.crossJoin(F.broadcast(some)).withColumn("colour", F.when(F.col("_coloured") == 0, F.coalesce(found, "colour")).otherwise(F.col("colour"))).drop("_coloured")


def clean_feed_names(df: DataFrame) -> DataFrame:
    """The suffix ' (Priority)' or ' (Priorität)' taken off feed_name."""
    ends = F.col("feed_name").endswith(" (Priorität)") | F.col("feed_name").endswith(" (Priority)")
    bare = F.trim(F.replace(F.replace("feed_name", F.lit(" (Priorität)"), F.lit("")), F.lit(" (Priority)"), F.lit("")))
    return df.withColumn("feed_name", F.when(ends, bare).otherwise(F.col("feed_name")))


#: Fixed patterns of image hosts that carry the size in the link.
IMAGE_SIZE = r"(?i)_(?:pico|icon|thumb|small|compact|medium|grande|large|master|\d{2,4}x\d{0,4}|x\d{2,4})(\.(?:jpe?g|png|webp|gif))(\?[^\"']*)?$"
CLOUD_UPLOAD = r"(?i)^(https?://res\.cloudinary\.com/[^/]+/image/upload/)(.+)$"


def upgraded_image(url: Column) -> Column:
    """The large form of an image link by five host rules; the first that changes it counts."""
    tail = F.regexp_extract(url, CLOUD_UPLOAD, 2)
    head = F.substring_index(tail, "/", 1)
    plain = (tail != "") & ~(head.contains(",") | head.rlike(r"(?i)^[a-z]_[a-z0-9_,.]+$"))
    shop = url.contains("cdn.shopify.com") | url.contains(".myshopify.com")
    changed = lambda made: F.when(made != url, made)
    rules = F.coalesce(
        F.when(url.contains("images.productserve.com"), changed(F.regexp_replace(url, r"(images\.productserve\.com/)preview/", "$1large/"))),
        F.when(url.contains("res.cloudinary.com") & plain, F.concat(F.regexp_extract(url, CLOUD_UPLOAD, 1), F.lit("w_1024,q_auto,f_auto/"), tail)),
        F.when(shop, changed(F.regexp_replace(url, IMAGE_SIZE, "_1024x1024$1$2"))),
        F.when(shop & url.rlike(r"(?i)[?&]width=\d+"), F.regexp_replace(url, r"(?i)(?<=[?&]width=)\d+", "1024")),
        F.when(url.rlike(r"cdn\d*\.bigcommerce\.com/.+/images/stencil/"), changed(F.regexp_replace(url, r"(?<=/images/stencil/)\d+x\d+(?=/)", "1024x1024"))),
        F.when(url.contains("/wp-content/uploads/"), changed(F.regexp_replace(url, r"(?i)-\d{2,4}x\d{2,4}(\.(?:jpe?g|png|webp|gif))(\?[^\"']*)?$", "$1$2"))),
        url,
    )
    return F.when(url.startswith("http") | url.startswith("//"), rules).otherwise(url)


def upgrade_images(df: DataFrame, name: str = "image_url") -> DataFrame:
    return df.withColumn(name, upgraded_image(F.col(name)))


def strip_size(name: Column) -> Column:
    """A size suffix (' - XL', ' - EU 42') and a trailing code ('C100') taken off."""
    bare = F.regexp_replace(name, rf"(?i)\s*[-–]\s*({SIZES})\s*$", "")
    return F.trim(F.regexp_replace(bare, r"(?i)\s+[A-Z]\d{2,4}\s*$", ""))


def _sizeless(name: Column) -> Column:
    bare = F.regexp_replace(name, rf"(?i)\s*[-–—]\s*({SIZES})\s*$", "")
    return F.regexp_replace(bare, r"(?i)\s+[A-Z]\d{2,4}\s*$", "")


def name_colour(name: Column) -> Column:
    """The colour phrase in a name, longest first; null if none."""
    found = F.regexp_replace(F.regexp_extract(_sizeless(name), COLOUR_PATTERN, 1), r"\s+", " ")
    return F.nullif(F.trim(found), F.lit(""))


def base_name(name: Column) -> Column:
    """A name in lower case without its size and colours."""
    bare = F.regexp_replace(F.regexp_replace(_sizeless(name), COLOUR_PATTERN, ""), r"\s+", " ")
    return F.lower(F.regexp_replace(bare, r"^[\s\-,.]+|[\s\-,.]+$", ""))


def split_name_colour(df: DataFrame) -> DataFrame:
    return df.withColumn("base_name", base_name(F.col("product_name"))).withColumn("derived_colour", name_colour(F.col("product_name")))


def normalize_category(df: DataFrame, brands: DataFrame) -> DataFrame:
    """A path 'A > B > Brand' without a last part that is a known brand (brands: brand, lower)."""
    parts = F.filter(F.transform(F.split("category", ">"), lambda x: F.trim(x)), lambda p: p != "")
    df = df.withColumn("_parts", parts).withColumn("_last", F.lower(F.get(F.col("_parts"), F.size("_parts") - 1)))
    known = brands.select(F.col("brand").alias("_last"), F.lit(True).alias("_known")).distinct()
    joined = df.join(known, "_last", "left")
    kept = F.when(F.col("_known") & (F.size("_parts") > 1), F.slice("_parts", 1, F.size("_parts") - 1)).otherwise(F.col("_parts"))
    return joined.withColumn("category_path", F.array_join(kept, " > ")).drop("_parts", "_last", "_known")


def money_text(amount: Column, sign: Column) -> Column:
    """'1.234,56 €'."""
    return F.concat(F.translate(F.format_number(amount, 2), ",.", ".,"), F.lit(" "), sign)


def with_display_price(df: DataFrame) -> DataFrame:
    """Shown price, crossed-out price, percent and text from price, sale_price, original_price."""
    sale = F.coalesce(leading_number(F.col("sale_price")), F.lit(0.0)) if "sale_price" in df.columns else F.lit(0.0)
    price, old = F.coalesce(F.col("price").cast("double"), F.lit(0.0)), F.coalesce(F.col("original_price").cast("double"), F.lit(0.0))
    on_sale = (sale > 0) & (sale < price)
    shown, crossed = F.when(on_sale, sale).otherwise(price), F.when(on_sale, price).when(old > price, old)
    signs = F.create_map(*[x for k, v in CURRENCY_SIGNS.items() for x in (F.lit(k), F.lit(v))])
    sign = F.coalesce(F.element_at(signs, F.upper("currency")), F.col("currency"), F.lit(""))
    return df.withColumns({
        "shown_price": shown, "crossed_price": crossed,
        "percent_off": F.when(crossed > 0, F.round((crossed - shown) / crossed * 100)).cast("long"),
        "price_text": F.trim(money_text(shown, sign)),
    })


#: Query parameters of tracking links that hold the destination.
TARGET_PARAMETERS = ("ued", "url", "u", "murl", "deeplink", "dest", "destination", "target", "p")


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1), "^www\\.", "")), F.lit(""))


def with_shop(df: DataFrame, names: tuple[str, ...] = ("merchant", "feed_name")) -> DataFrame:
    """Shop: a name that isn't a code, else the host behind a tracking link, else the link's host."""
    looks_like_code = lambda c: c.rlike(r"^[A-Z0-9_-]*\d[A-Z0-9_-]*$")
    named = [F.when(non_empty(F.col(n)).isNotNull() & ~looks_like_code(F.col(n)), F.col(n)) for n in names if n in df.columns]
    link = F.col("affiliate_link")
    inner = [host_of(F.try_url_decode(F.regexp_extract(link, rf"[?&]{p}=([^&#]*)", 1))) for p in TARGET_PARAMETERS]
    return df.withColumn("shop", F.coalesce(*named, *inner, host_of(link)))


def resolve_prices(df: DataFrame, current: tuple[str, ...] = ("sale_price", "price", "current_price"), original: tuple[str, ...] = ("old_price", "original_price", "rrp_price", "rrp", "was_price")) -> DataFrame:
    """effective_price and list_price over field synonyms, the first positive of each."""
    positive = lambda c: F.when(price_number(c) > 0, price_number(c))
    return df.withColumn("effective_price", first_of(df, current, positive)).withColumn("list_price", first_of(df, original, positive))


def with_variants(df: DataFrame) -> DataFrame:
    """all_colours (columns, attributes, title words; capitalised, unique) and all_sizes (in order)."""
    from feedlake.operators.lookups import size_rank

    colours = [F.split(F.col(n), r"[,/|]") for n in ("colour", "color", "attr_color") if n in df.columns]
    in_title = F.regexp_extract_all(F.coalesce(F.col("product_name"), F.lit("")), F.lit(COLOUR_PATTERN), F.lit(1))
    none = F.array().cast("array<string>")
    cleaned = F.transform(F.concat(*[F.coalesce(c, none) for c in colours], in_title), lambda x: F.initcap(F.trim(x)))
    sizes = [F.split(F.col(n), r"[,/|]") for n in ("size", "attr_size") if n in df.columns]
    listed = F.array_distinct(F.filter(F.transform(F.concat(none, *[F.coalesce(c, none) for c in sizes]), lambda x: F.trim(x)), lambda x: x != ""))
    ranked = F.transform(F.array_sort(F.transform(listed, size_rank)), lambda s: s["size"])
    return df.withColumn("all_colours", F.array_distinct(F.filter(cleaned, lambda x: x != ""))).withColumn("all_sizes", ranked)


def with_availability(df: DataFrame) -> DataFrame:
    """Availability 'in stock' where it is empty."""
    return df.withColumn("availability", F.coalesce(non_empty(F.col("availability")), F.lit("in stock")))


def with_tracking_link(df: DataFrame, networks: DataFrame) -> DataFrame:
    """tracking_link from the network's template (networks: network, template, program_id,
    organization_id); {url} takes the encoded link.
    """
    filled = F.col("template")
    for mark, value in (("{program_id}", F.col("program_id")), ("{organization_id}", F.col("organization_id")), ("{url}", F.url_encode("affiliate_link"))):
        filled = F.replace(filled, F.lit(mark), F.coalesce(value.cast("string"), F.lit("")))
    joined = df.join(F.broadcast(networks.select("network", "template", "program_id", "organization_id")), "network", "left")
    return joined.withColumn("tracking_link", F.coalesce(filled, F.col("affiliate_link"))).drop("template", "program_id", "organization_id")
