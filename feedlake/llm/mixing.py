"""Mixing sources to target weights by temperature.

A source with the share p of all tokens gets a weight in proportion to p**alpha. Alpha runs from
1 (natural) to 0 (uniform); the entropy of the weights falls and the repetition of the smallest
source shrinks as alpha grows, so both limits are met by narrowing an interval. Every round of
the search evaluates GRID values of alpha in one aggregation over the table of sources, which
therefore never has to fit the driver.

The weights are realised as budgeted block permutations: each pass over a source is a
permutation of its documents; passes are laid end to end until the source's token budget is
spent; a document's place on that line gives its block, so that each block holds the sources in
the target proportions. Running token counts are taken in buckets, so a source with a third of
all rows is spread over many tasks.

Defined results: tokens are the words of the text, at least 1 (also for null and empty texts); a
null source is a source; with one source the weight is 1; ties in the permutation are broken by
doc_id; repeated rows of one doc_id are separate rows; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.common import WORD_SEPARATORS, bucket_count, cut_lineage, read_table, running_position, set_aside

GRID = 32
ROUNDS = 7


def token_count(text):
    """Words of a text, at least 1."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WORD_SEPARATORS, " "))
    return F.greatest(F.lit(1), F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("long")


def _curves(shares: DataFrame, alphas: list[float]) -> list[dict]:
    """Entropy, and the largest and smallest ratio of weight to share, at each alpha."""
    wanted = [F.count("*").alias("sources"), F.min("share").alias("least"), F.max("share").alias("most")]
    for i, a in enumerate(alphas):
        power = F.pow(F.col("share"), F.lit(float(a)))
        wanted += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log("share")).alias(f"s{i}")]
    r = shares.agg(*wanted).first()
    out = []
    for i, a in enumerate(alphas):
        z = r[f"z{i}"]
        ratios = [r["least"] ** (a - 1) / z, r["most"] ** (a - 1) / z]
        out.append({"alpha": a, "z": z, "entropy": _ln(z) - a * r[f"s{i}"] / z, "top": max(ratios), "low": min(ratios)})
    return out


def _ln(x: float) -> float:
    return math.log(x)


def solve_temperature(
    shares: DataFrame, entropy: float | None = None, repetition: float | None = None, upsample_only: bool = False, budget_ratio: float = 1.0
) -> dict:
    """The least alpha in [0, 1] that meets the limits: entropy at most ``entropy`` (nats) and no
    source repeated more than ``repetition`` times, for a budget of ``budget_ratio`` corpora or,
    with ``upsample_only``, the least budget at which every source is passed over once.
    """

    def repeats(c: dict) -> float:
        return c["top"] / c["low"] if upsample_only else c["top"] * budget_ratio

    def good(c: dict) -> bool:
        fits = repetition is None or repeats(c) <= repetition * (1 + 1e-9)
        return fits and (entropy is None or c["entropy"] <= entropy + 1e-12)

    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        curves = _curves(shares, grid)
        k = next((i for i, c in enumerate(curves) if good(c)), GRID)
        best = curves[k]
        if k == 0 or not good(best):
            break
        low, high = grid[k - 1], grid[k]
    best["ratio"] = 1 / best["low"] if upsample_only else budget_ratio
    return best


def mix_sources(
    docs: DataFrame,
    entropy_share: float | None = None,
    repetition: float | None = 4.0,
    budget_ratio: float = 1.0,
    upsample_only: bool = False,
    block_tokens: int = 1_000_000,
    seed: int = 1,
) -> DataFrame:
    """All columns of ``docs``, a row for each time a document is dealt, plus mix_tokens,
    mix_pass, mix_weight, mix_alpha and mix_block, which replace input columns of these names.

    ``entropy_share``: target entropy as a share of the uniform one. ``budget_ratio``: token
    budget in corpora. ``upsample_only``: spend what it takes for every source to be passed over
    at least once, so that no document is left out. Documents are whole: a source ends with the
    last one that its budget still holds.
    """
    row_hash = F.xxhash64("doc_id", "source", F.coalesce(F.col("text"), F.lit("")))
    # rows that repeat one id, source and text are dealt together, as one unit
    light = (
        docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), row_hash.alias("_row"), token_count(F.col("text")).alias("_tokens"))
        .groupBy("_id", "_source", "_row")
        .agg(F.first("_tokens").alias("_each"), F.sum("_tokens").alias("_tokens"))
    )
    light = cut_lineage(light)
    sources = cut_lineage(light.groupBy("_source").agg(F.sum("_tokens").alias("_total"), F.count("*").alias("_docs")))
    whole = sources.agg(F.sum("_total").alias("t"), F.sum("_docs").alias("n"), F.count("*").alias("k")).first()
    added = ["mix_tokens long", "mix_pass int", "mix_weight double", "mix_alpha double", "mix_block long"]
    names = [x.split()[0] for x in added]
    plain, back = set_aside(docs.drop(*names), "doc_id", "source", "text")
    if not whole["n"]:
        return plain.select(*back, *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in added])
    total = whole["t"]
    shares = sources.withColumn("share", F.col("_total") / F.lit(float(total)))
    best = solve_temperature(shares, entropy_share and entropy_share * _ln(whole["k"]), repetition, upsample_only, budget_ratio)
    weight = F.pow(F.col("share"), F.lit(best["alpha"])) / F.lit(best["z"])
    # a hair above the budget, so that a source due exactly whole passes keeps its last document
    plan = shares.withColumn("_weight", weight).withColumn(
        "_budget", F.floor(F.col("_weight") * F.lit(best["ratio"] * total) * F.lit(1 + 1e-9) + F.lit(1e-6))
    ).select(F.col("_source").alias("_s"), "_total", "_weight", "_budget")
    last = F.floor((F.col("_budget") - 1) / F.col("_total"))
    slim = (
        light.join(plan, F.col("_source").eqNullSafe(F.col("_s")))
        .where(F.col("_budget") > 0)
        .withColumn("_pass", F.explode(F.sequence(F.lit(0), last.cast("int"))))
        .withColumn("_h", F.xxhash64(F.lit(seed), F.col("_pass"), F.col("_row")))
        .drop("_s")
    )
    slim = cut_lineage(slim)
    buckets = bucket_count(whole["n"], 20_000)
    spread = F.pmod(F.call_function("shiftright", F.col("_h"), F.lit(32)), F.lit(buckets)).cast("int")
    lined = running_position(slim, ["_source", "_pass"], spread, ["_h", "_id"], buckets, "_tokens", "_before")
    place = F.col("_pass").cast("long") * F.col("_total") + F.col("_before")
    blocks = max(1, round(best["ratio"] * total / block_tokens))
    kept = (
        lined.where(place + F.col("_tokens") <= F.col("_budget"))
        .select(
            F.col("_id"), F.col("_source"), F.col("_row"), F.col("_each").alias("mix_tokens"), F.col("_pass").alias("mix_pass"),
            F.col("_weight").alias("mix_weight"), F.lit(best["alpha"]).alias("mix_alpha"),
            F.floor(place / F.col("_budget") * F.lit(blocks)).cast("long").alias("mix_block"),
        )
    )
    same = (row_hash == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
    return plain.join(kept, same).select(*back, *names)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights at 97 % of the uniform entropy, or flatter by as little as needed for at most four passes."""
    mixed = mix_sources(read_table(spark, sf_dir, "documents"), entropy_share=0.97, repetition=4.0, upsample_only=True)
    return mixed.select("doc_id", "source", "mix_tokens", "mix_pass", "mix_weight", "mix_alpha", "mix_block")


QUERIES = {"op10_mixing": op10_mixing}
ORACLE_SQL: dict[str, str] = {}
