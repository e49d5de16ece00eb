"""Learning how a feed's columns map to standard fields.

The knowledge comes in as tables, so that a user can bring their own:
``feed_columns`` (feed_id, column, position from 0, columns), ``signatures`` (network, kind: url,
field or prefix; value; boost) and ``patterns`` (standard, rank, kind: exact, contains, prefix,
suffix or exclude; pattern).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of each kind of match, the largest position bonus, the network bonus, the least score.
POINTS = {"exact": 100, "contains": 80, "prefix": 75, "suffix": 75, "exclude": -50}
POSITION_BONUS, NETWORK_BONUS, LEAST_SCORE = 10, 20, 30
#: The standard fields without which a feed can't be imported.
CRITICAL = ("id", "title", "price", "affiliate_link")
SHOPPING, SHOPPING_FIELDS = "google_shopping", 4
DRIFT = 0.1


def detect_network(feed_columns: DataFrame, feeds: DataFrame, signatures: DataFrame) -> DataFrame:
    """M1: (feed_id, network, score): boost for each link pattern in the url, the share of signature
    fields times boost, and 5 for each prefixed column up to boost; the best wins. The shopping
    format overrides a winner without a link hit if SHOPPING_FIELDS of its fields are there.
    """
    url = feeds.select("feed_id", F.lower("url").alias("u"))
    by_url = url.join(signatures.where("kind = 'url'"), F.col("u").contains(F.lower("value"))).groupBy("feed_id", "network").agg(F.sum("boost").cast("double").alias("points"), F.lit(1).alias("linked"), F.lit(0).alias("fields"))
    fields = signatures.where("kind = 'field'")
    wanted = fields.groupBy("network").agg(F.count("*").alias("all"), F.max("boost").alias("b"))
    has = feed_columns.join(fields, F.col("column") == F.col("value")).groupBy("feed_id", "network").agg(F.countDistinct("value").alias("n")).join(wanted, "network")
    by_field = has.select("feed_id", "network", (F.col("n") / F.col("all") * F.col("b")).alias("points"), F.lit(0).alias("linked"), F.col("n").cast("int").alias("fields"))
    prefixed = feed_columns.join(signatures.where("kind = 'prefix'"), F.lower("column").startswith(F.lower("value")))
    by_prefix = prefixed.groupBy("feed_id", "network").agg(F.least(F.countDistinct("column") * 5, F.max("boost")).cast("double").alias("points"), F.lit(0).alias("linked"), F.lit(0).alias("fields"))
    every = by_url.unionByName(by_field).unionByName(by_prefix).groupBy("feed_id", "network").agg(
        F.sum("points").alias("score"), F.max("linked").alias("linked"), F.max("fields").alias("fields")
    )
    best = every.withColumn("_n", F.row_number().over(Window.partitionBy("feed_id").orderBy(F.desc("score"), "network"))).where("_n = 1")
    shop = every.where((F.col("network") == SHOPPING) & (F.col("fields") >= SHOPPING_FIELDS)).select("feed_id", F.lit(True).alias("_shop"))
    return best.join(shop, "feed_id", "left").select(
        "feed_id", F.when(F.col("_shop") & (F.col("linked") == 0), SHOPPING).otherwise(F.col("network")).alias("network"), F.round("score", 6).alias("score")
    )


def network_from_url(url: Column, patterns: list[tuple[str, str]]) -> Column:
    """M2: the network of the first (pattern, network) that the link holds."""
    return F.coalesce(*[F.when(F.lower(url).contains(p.lower()), n) for p, n in patterns])


def score_candidates(feed_columns: DataFrame, patterns: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """M3: (feed_id, standard, rank, column, position, score) above LEAST_SCORE. Each kind counts once;
    earlier columns get up to POSITION_BONUS; ``prefixes`` (feed_id, prefix) NETWORK_BONUS.
    """
    low, pattern = F.lower("column"), F.lower("pattern")
    hit = (
        F.when(F.col("kind") == "exact", low == pattern).when(F.col("kind") == "prefix", low.startswith(pattern))
        .when(F.col("kind") == "suffix", low.endswith(pattern) & (F.expr("instr(lower(column), lower(pattern))") == F.length("column") - F.length("pattern") + 1))
        .otherwise(low.contains(pattern))
    )
    points = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in POINTS.items()])
    # a registry's columns against a table of some hundred patterns
    hits = feed_columns.join(F.broadcast(patterns), hit).select("feed_id", "column", "position", "columns", "standard", "rank", "kind", points.alias("points")).distinct()
    scored = hits.groupBy("feed_id", "column", "position", "columns", "standard", "rank").agg(F.sum("points").alias("points"))
    score = F.col("points") + (F.col("columns") - F.col("position")) / F.col("columns") * POSITION_BONUS
    if prefixes is not None:
        own = feed_columns.join(prefixes, "feed_id").where(low.startswith(F.lower("prefix"))).select("feed_id", "column", F.lit(NETWORK_BONUS).alias("_bonus")).distinct()
        scored = scored.join(own, ["feed_id", "column"], "left")
        score = score + F.coalesce("_bonus", F.lit(0))
    return scored.withColumn("score", F.round(score, 6)).where(F.col("score") > LEAST_SCORE).select("feed_id", "standard", "rank", "column", "position", "score")


def learn_mapping(candidates: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """M4: (feed_id, standard, column, score): ``fixed`` (feed_id, standard, column, rank) first, then
    the best unused candidate of each standard field in rank order; a column is used once.
    """

    rows = candidates.select("feed_id", "standard", "rank", "column", "position", "score", F.lit(False).alias("given"))
    if fixed is not None:
        rows = rows.unionByName(fixed.select("feed_id", "standard", "rank", "column", F.lit(0).alias("position"), F.lit(100.0).alias("score"), F.lit(True).alias("given")))
    rank, score = F.col("rank").cast("long"), F.col("score").cast("double")
    # fixed ones first, in rank order; the others by rank, best first; what is missing comes last
    down = F.when(F.col("given"), 0.0).otherwise(F.coalesce(-score, F.lit(float("nan"))))
    row = F.struct(
        (~F.col("given")).alias("free"), rank.isNull().alias("unranked"), rank.alias("rank"), down.alias("down"), F.col("position").cast("long").alias("position"),
        F.col("column").cast("string").alias("column"), F.col("standard").cast("string").alias("standard"), score.alias("score"),
    )
    per = rows.groupBy(F.col("feed_id").cast("long").alias("feed_id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    none = F.struct(
        F.array().cast("array<struct<standard:string,column:string,score:double>>").alias("taken"), F.lit(None).cast("long").alias("rank"),
    )

    def assign(state: Column, x: Column) -> Column:
        has = lambda name: F.exists(state["taken"], lambda s: s[name].eqNullSafe(x[name]))
        # a rank gives one field at most, a column serves one field at most; fixed columns may serve several
        open_ = ~x["free"] | (~x["unranked"] & ~state["rank"].eqNullSafe(x["rank"]) & ~has("column"))
        new = F.struct(x["standard"].alias("standard"), x["column"].alias("column"), F.when(x["free"], x["score"]).otherwise(100.0).alias("score"))
        take = open_ & ~has("standard")
        return F.struct(
            F.when(take, F.array_append(state["taken"], new)).otherwise(state["taken"]).alias("taken"), F.when(take & x["free"], x["rank"]).otherwise(state["rank"]).alias("rank"),
        )

    taken = F.aggregate("rows", none, assign, lambda state: state["taken"])
    return per.select("feed_id", F.explode(taken).alias("x")).select("feed_id", "x.standard", "x.column", "x.score")


def fill_rates(feed: DataFrame) -> DataFrame:
    """M5, first half: (column, filled, rows): how many rows of each column hold more than blanks."""
    names = feed.columns
    counted = feed.agg(F.count("*").alias("rows"), *[F.count_if(F.length(F.trim(F.col(f"`{c}`").cast("string"))) > 0).alias(f"_{i}") for i, c in enumerate(names)])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("filled")) for i, c in enumerate(names)]))
    return counted.select("rows", pairs.alias("x")).select("x.column", "x.filled", "rows")


def repair_mapping(mapping: DataFrame, rates: DataFrame, candidates: DataFrame) -> DataFrame:
    """M5: a mapped column that is empty in the data gives way to the best filled candidate, if any."""
    filled = rates.where("filled > 0").select("column")
    dead = mapping.join(filled, "column", "left_anti")
    options = candidates.join(filled, "column", "left_semi").join(mapping.select("feed_id", "column"), ["feed_id", "column"], "left_anti")
    ranked = dead.select("feed_id", "standard").join(options, ["feed_id", "standard"])
    best = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("feed_id", "standard").orderBy(F.desc("score"), "position"))).where("_n = 1")
    new = best.select("feed_id", "standard", F.col("column").alias("_new"))
    return mapping.join(new, ["feed_id", "standard"], "left").withColumn("column", F.coalesce("_new", "column")).drop("_new")


def validate_mapping(mapping: DataFrame) -> DataFrame:
    """M6: per feed the critical fields that are missing, and whether none is."""
    per = mapping.groupBy("feed_id").agg(F.collect_set("standard").alias("s"))
    missing = F.array_except(F.array(*[F.lit(c) for c in CRITICAL]), "s")
    return per.select("feed_id", F.array_join(missing, "|").alias("missing"), (F.size(missing) == 0).alias("valid"))


def mapping_confidence(mapping: DataFrame, weights: DataFrame) -> DataFrame:
    """M7: per feed the mapped share of the total weight, in percent (weights: standard, weight)."""
    total = weights.agg(F.sum("weight").alias("_total"))
    per = mapping.select("feed_id", "standard").distinct().join(F.broadcast(weights), "standard").groupBy("feed_id").agg(F.sum("weight").alias("w"))
    return per.crossJoin(F.broadcast(total)).select("feed_id", F.round(F.col("w") / F.col("_total") * 100, 6).alias("confidence"))


def path_column(df: DataFrame, path: str) -> Column:
    """M8: a column by path: ``a``, ``a.b`` or ``a[0].b``."""
    if path in df.columns:
        return F.col(f"`{path}`")
    out = None
    for name, index in re.findall(r"([^.\[\]]+)|\[(\d+)\]", path):
        if out is None:
            out = F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")
            if name not in df.columns:
                return out
        else:
            out = out.getField(name) if name else F.get(out, F.lit(int(index)))
    return out


def apply_mapping(df: DataFrame, mapping: dict[str, str], prefix: str = "raw_") -> DataFrame:
    """M8: standard fields by path, the feed's own columns kept under ``prefix``."""
    return df.select(*[path_column(df, p).alias(s) for s, p in mapping.items()], *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns])


def schema_drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """M9: per feed the share of added and removed columns, and whether it calls for new learning."""
    sets = lambda df, n: df.groupBy("feed_id").agg(F.collect_set("column").alias(n))
    both = sets(current, "new").join(sets(stored, "old"), "feed_id", "left")
    old = F.coalesce("old", F.array().cast("array<string>"))
    changed = F.size(F.array_except("new", old)) + F.size(F.array_except(old, F.col("new")))
    share = changed / F.greatest(F.size("new"), F.size(old))
    return both.select("feed_id", F.round(share, 6).alias("share"), ((share > DRIFT) | (F.size(old) == 0)).alias("drifted"))


def apply_template(feeds: DataFrame, templates: DataFrame) -> DataFrame:
    """Feeds (feed_id, template_id, mapping) take their template's mapping, empty keys dropped."""
    clean = F.map_filter("t_mapping", lambda k, v: F.trim(k) != "")
    joined = feeds.join(templates.select("template_id", F.col("mapping").alias("t_mapping")), "template_id", "left")
    return joined.withColumn("mapping", F.coalesce(clean, "mapping")).drop("t_mapping")


def product_id(df: DataFrame, candidates: list[str]) -> Column:
    """The first present of an ordered list of id columns."""
    there = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in dict.fromkeys(candidates) if c in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def register_feeds(feeds: DataFrame, detected: DataFrame, confidence: DataFrame) -> DataFrame:
    """Feeds with a name and a url, their format (hint, else url) and network (detected, else hint,
    else auto-detected) and a label for the mapping confidence.
    """
    from feedlake.sources.readers import format_from_url

    kept = feeds.where((F.trim("name") != "") & (F.trim("url") != ""))
    joined = kept.join(detected.select("feed_id", "network"), "feed_id", "left").join(confidence, "feed_id", "left")
    label = F.when(F.col("confidence") >= 80, "high").when(F.col("confidence") >= 60, "mid").when(F.col("confidence") > 0, "low").otherwise("none")
    return joined.withColumns({
        "format": F.coalesce(F.nullif("format_hint", F.lit("")), format_from_url(F.col("url"))),
        "network": F.coalesce("network", F.nullif("network_hint", F.lit("")), F.lit("auto-detected")), "confidence_label": label,
    })


def remap_feeds(stored: DataFrame, learned: DataFrame, drift: DataFrame, sampled: DataFrame | None = None) -> DataFrame:
    """The mapping each feed goes on with: the learned one where the columns drifted or nothing is
    stored and it holds all critical fields, else the stored one. ``sampled`` (feed_id, columns): a
    feed whose sample shows fewer than half of more than ten mapped columns is left alone.
    """
    new = drift.where("drifted").select("feed_id").join(validate_mapping(learned).where("valid").select("feed_id"), "feed_id", "left_semi")
    fresh = learned.select("feed_id").distinct().join(stored.select("feed_id").distinct(), "feed_id", "left_anti")
    take = new.unionByName(fresh).distinct()
    if sampled is not None:
        sizes = stored.groupBy("feed_id").agg(F.count("*").alias("mapped"))
        thin = sampled.join(sizes, "feed_id").where((F.col("mapped") > 10) & (F.col("columns") * 2 < F.col("mapped"))).select("feed_id")
        take = take.join(thin, "feed_id", "left_anti")
    names = ["feed_id", "standard", "column"]
    return stored.select(*names).join(take, "feed_id", "left_anti").unionByName(learned.select(*names).join(take, "feed_id", "left_semi"))


def relearn_all(feed_columns: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new mappings of all feeds, one row with the feeds learned and those without all critical fields)."""
    learned = learn_mapping(score_candidates(feed_columns, patterns))
    checked = feed_columns.select("feed_id").distinct().join(validate_mapping(learned), "feed_id", "left")
    return learned, checked.agg(F.count("*").alias("feeds"), F.count_if(~F.coalesce("valid", F.lit(False))).alias("errors"))
