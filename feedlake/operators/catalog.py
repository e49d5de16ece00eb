"""Keeping the product table in step with the feeds.

Tables are immutable here: every function returns the new table, and publishing it is the
sinks' part (``feedlake.sources.tables``). The key of a product is (external_id, feed_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions.values import leading_number, non_empty, price_number
from feedlake.operators.reports import ACTIVE

KEY = ["external_id", "feed_id"]
UNAVAILABLE = "unavailable"
SYNCED = ("price", "original_price", "in_stock", "image_url", "affiliate_link", "last_updated")
#: Fixed value: orphan marking stops above this share of the active rows of configured feeds.
ORPHAN_LIMIT = 0.5


def dedup_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in ``order``; ties go by a hash of the row, so a run repeats the last one."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    window = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order], F.xxhash64(*plain))
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def dedup_by_image(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per picture over all feeds, the first in ``order``; without a picture, per id and colour."""
    picture = F.lower(non_empty(F.col("image_url")))
    key = F.coalesce(picture, F.concat_ws("|", F.col("external_id"), F.coalesce(F.col("colour"), F.lit(""))))
    window = Window.partitionBy("_key").orderBy(*order)
    return df.withColumn("_key", key).withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n", "_key")


def upsert(target: DataFrame, updates: DataFrame, key: list[str] = KEY, order: list[str] | None = None) -> DataFrame:
    """U3 (U14 with key external_id): updates replace whole rows, new keys are added, none removed. Of several
    updates of a key the last in ``order`` counts (last_updated, where it is a column, if none is given).
    """
    new = dedup_last(updates, key, order or [c for c in ("last_updated",) if c in updates.columns])
    return target.join(new.select(*key), key, "left_anti").select(*target.columns).unionByName(new.select(*target.columns))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """U4: (good rows, quarantined rows with the broken rules in ``broken``)."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def restrict_to_ids(rows: DataFrame, ids: DataFrame, feed_order: str | None = None) -> DataFrame:
    """Rows of the wanted ids; with ``feed_order`` the first feed that has an id provides it."""
    found = rows.join(ids.select("external_id").distinct(), "external_id", "left_semi")
    if feed_order is None:
        return found
    window = Window.partitionBy("external_id").orderBy(feed_order)
    return found.withColumn("_n", F.rank().over(window)).where("_n = 1").drop("_n")


def quick_sync(target: DataFrame, updates: DataFrame, ids: DataFrame | None = None, match: list[str] = KEY) -> DataFrame:
    """Price, stock, picture, link and time brought up to date; nothing inserted or marked.

    ``match=["external_id"]`` updates every feed's row of an id. Of several updates the last one counts.
    """
    if ids is not None:
        updates = restrict_to_ids(updates, ids)
    new = dedup_last(updates, match, ["last_updated"]).select(*match, F.lit(1).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in SYNCED])
    joined = target.join(new, match, "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in SYNCED else F.col(c) for c in target.columns])


def force_raw_fields(df: DataFrame, price: str = "raw_price", old: str = "raw_old_price", stock: str = "raw_in_stock") -> DataFrame:
    """Price, original_price and stock overwritten from raw columns where those are filled; percent anew."""
    # columns of their own: a price text is then read for its two uses here, and not for every use of the price as well
    df = df.withColumns({"_price": price_number(F.col(price)), "_old": price_number(F.col(old))})
    fill = lambda n, raw: F.when(F.col(raw) > 0, F.col(raw)).otherwise(F.col(n).cast("double"))
    df = df.withColumns({"price": fill("price", "_price"), "original_price": fill("original_price", "_old")}).drop("_price", "_old")
    df = df.withColumn("in_stock", F.when(F.coalesce(F.col(stock), F.lit("")) != "", leading_number(F.col(stock)).cast("int")).otherwise(F.col("in_stock")))
    off = F.when((F.col("original_price") > F.col("price")) & (F.col("price") > 0), F.round((F.col("original_price") - F.col("price")) / F.col("original_price") * 100))
    return df.withColumn("discount_percentage", off.cast("long"))


def reactivate(target: DataFrame, found_ids: DataFrame) -> DataFrame:
    """U8: unavailable rows whose ids were found become active."""
    hit = found_ids.select("external_id").distinct().withColumn("_hit", F.lit(True))
    status = F.when(F.col("_hit") & (F.col("status") == UNAVAILABLE), ACTIVE).otherwise(F.col("status"))
    return target.join(hit, "external_id", "left").withColumn("status", status).select(*target.columns)


def mark_orphans(target: DataFrame, touched: DataFrame, feeds: DataFrame, start: Column, all_ok: bool) -> tuple[DataFrame, DataFrame]:
    """(table, report). Active rows of feeds touched in this run (feed_id) and not updated
    since ``start`` become unavailable, if all feeds went well and at most ORPHAN_LIMIT of the
    active rows of configured feeds would go. The guard is a one-row table, so all stays lazy.
    """
    seen = touched.select("feed_id").distinct().withColumn("_touched", F.lit(True))
    known = feeds.select("feed_id").distinct().withColumn("_known", F.lit(True))
    joined = target.join(seen, "feed_id", "left").join(known, "feed_id", "left")
    stale = F.coalesce(F.col("_touched"), F.lit(False)) & (F.col("status") == ACTIVE) & (F.col("last_updated") < start)
    marked = joined.withColumn("_stale", F.coalesce(stale, F.lit(False)))
    report = marked.agg(
        F.count_if("_stale").alias("orphans"), F.count_if(F.coalesce(F.col("_known"), F.lit(False)) & (F.col("status") == ACTIVE)).alias("configured_active")
    )
    fits = F.lit(all_ok) & start.isNotNull() & (F.col("orphans") <= F.col("configured_active") * ORPHAN_LIMIT)
    report = report.withColumn("applied", fits)
    status = F.when(F.col("_stale") & F.col("applied"), UNAVAILABLE).otherwise(F.col("status"))
    table = marked.crossJoin(F.broadcast(report.select("applied"))).withColumn("status", status).select(*target.columns)
    return table, report


def drop_unconfigured(target: DataFrame, feeds: DataFrame, by: str = "feed_id") -> DataFrame:
    """Rows of configured feeds only. By feed_id nothing goes if no feed is known; by
    feed_name an empty list removes all named rows, and a null name stays.
    """
    if by == "feed_id":
        known = feeds.select("feed_id").where("feed_id IS NOT NULL").distinct()
        some = known.agg(F.count("*").alias("_feeds"))
        joined = target.join(known.withColumn("_known", F.lit(True)), "feed_id", "left").crossJoin(F.broadcast(some))
        return joined.where(F.col("_known") | (F.col("_feeds") == 0)).select(*target.columns)
    names = feeds.select(F.lower("feed_name").alias("_name")).distinct()
    kept = target.where("feed_name IS NOT NULL").join(names, F.lower("feed_name") == F.col("_name"), "left_semi")
    return kept.unionByName(target.where("feed_name IS NULL"))


def delete_feed(target: DataFrame, feed_name: str | None = None, feed_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(table without the feed's rows, one row with their number); by name, else by id."""
    gone = F.coalesce(F.lower("feed_name") == feed_name.lower() if feed_name else F.col("feed_id") == feed_id, F.lit(False))
    return target.where(~gone), target.agg(F.count_if(gone).alias("deleted"))


def carry_forward(new: DataFrame, old: DataFrame, used_ids: DataFrame) -> DataFrame:
    """Ids in use but missing from the new build, re-added from the old one as unavailable (a
    stub row if the old build lacks them too).
    """
    lost = used_ids.select("external_id").distinct().join(new.select("external_id"), "external_id", "left_anti")
    one = dedup_last(old, ["external_id"], ["feed_id"])
    back = lost.join(one, "external_id", "left").withColumn("status", F.lit(UNAVAILABLE))
    return new.unionByName(back.select(*new.columns))


def merge_snapshot(active: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge by id, the new row wins, nothing is removed."""
    return upsert(active, updates, ["external_id"])


def assign_feed_ids(feeds: DataFrame, next_id: int | None = None) -> DataFrame:
    """feed_id where missing: numbered on in list order (``position``), from the largest in use."""
    top = feeds.agg(F.coalesce(F.max("feed_id"), F.lit(0)).alias("_top"))
    # the registry is a table of tens of rows
    order = Window.partitionBy(F.col("feed_id").isNull()).orderBy("position")
    numbered = feeds.withColumn("_n", F.row_number().over(order)).crossJoin(F.broadcast(top))
    start = F.col("_top") if next_id is None else F.greatest(F.col("_top"), F.lit(next_id - 1))
    return numbered.withColumn("feed_id", F.coalesce("feed_id", start + F.col("_n"))).drop("_n", "_top")


def rewrite_feed_ids(products: DataFrame, feeds: DataFrame) -> DataFrame:
    """U15, second half: products take the feed_id of the feed of their name."""
    named = feeds.select("feed_name", F.col("feed_id").alias("_new")).dropDuplicates(["feed_name"])
    return products.join(named, "feed_name", "left").withColumn("feed_id", F.coalesce("_new", "feed_id")).select(*products.columns)


def run_verdict(run_log: DataFrame, feeds: DataFrame) -> DataFrame:
    """Per run whether all feeds went well; priority passes don't count."""
    own = run_log.where(F.col("phase") != "priority_active").groupBy("run_id").agg(
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if((F.col("status") == "failed") | (F.coalesce(F.col("error"), F.lit("")) != "")).alias("failed"),
    )
    n = feeds.agg(F.count("*").alias("configured"))
    return own.crossJoin(F.broadcast(n)).withColumn("all_feeds_ok", (F.col("failed") == 0) & (F.col("completed") >= F.col("configured")))


def run_progress(run_log: DataFrame) -> DataFrame:
    """Percent of a full run: up to 5 for the priority passes, then 94 over the feeds, 99 at most."""
    priority = F.col("phase") == "priority_active"
    done = F.col("status") == "completed"
    share = F.when((F.col("status") == "processing") & (F.col("total_rows") > 0), F.least(F.lit(1.0), F.col("offset") / F.col("total_rows"))).otherwise(0.0)
    per = run_log.groupBy("run_id").agg(
        F.count_if(priority).alias("p_all"), F.count_if(priority & done).alias("p_done"),
        F.count_if(~priority).alias("f_all"), F.count_if(~priority & done).alias("f_done"), F.sum(F.when(~priority, share).otherwise(0.0)).alias("part"),
    )
    first = F.when(F.col("p_all") > 0, 5.0 * F.col("p_done") / F.col("p_all")).otherwise(5.0)
    main = F.when(F.col("f_all") > 0, 5 + 94 * (F.col("f_done") + F.col("part")) / F.col("f_all")).otherwise(5.0)
    busy = (F.col("p_all") > 0) & (F.col("p_done") < F.col("p_all"))
    return per.select("run_id", F.least(F.lit(99), F.round(F.when(busy, first).otherwise(main))).cast("long").alias("percent"))


def quick_progress(run_log: DataFrame) -> DataFrame:
    """Percent of a quick sync: found of wanted, 99 at most, 100 when completed."""
    part = F.floor(F.col("found") * 100 / F.greatest(F.col("wanted"), F.lit(1)))
    return run_log.select("run_id", F.when(F.col("status") == "completed", 100).otherwise(F.least(F.lit(99), part)).cast("long").alias("percent"))


def midrun_total(run_log: DataFrame, feeds: DataFrame, products: DataFrame) -> DataFrame:
    """Per run the product total: new counts of completed feeds, last known ones of the others."""
    new = products.where(F.col("status") == ACTIVE).groupBy("feed_id").agg(F.count("*").alias("now"))
    done = run_log.where((F.col("status") == "completed") & (F.col("phase") != "priority_active")).select("run_id", "feed_id").distinct()
    runs = run_log.select("run_id").distinct()
    every = runs.crossJoin(F.broadcast(feeds.select("feed_id", "product_count")))  # runs times the registry
    state = every.join(done.withColumn("_done", F.lit(True)), ["run_id", "feed_id"], "left").join(new, "feed_id", "left")
    n = F.when(F.col("_done"), F.coalesce("now", F.lit(0))).otherwise(F.coalesce("product_count", F.lit(0)))
    return state.groupBy("run_id").agg(F.sum(n).alias("total"))


def full_refresh(
    target: DataFrame, rows: DataFrame, feeds: DataFrame, start: Column, all_ok: bool = True, order: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """U16: (table, orphan report) after a full run: dedup, upsert, unconfigured feeds out, orphans
    marked, search text filled. The hook of X3 belongs to ``publish_snapshot``, which makes the table seen.
    """
    from feedlake.operators.normalize import with_search_text

    new = dedup_last(rows, KEY, order or ["last_updated"])
    merged = drop_unconfigured(upsert(target, new), feeds)
    table, report = mark_orphans(merged, rows, feeds, start, all_ok)
    return with_search_text(table), report


def refresh_feed(target: DataFrame, rows: DataFrame, feed_id: int, order: list[str] | None = None) -> DataFrame:
    """One feed's rows deduplicated and upserted; no marking, no deletes."""
    return upsert(target, dedup_last(rows.where(F.col("feed_id") == feed_id), KEY, order or ["last_updated"]))
