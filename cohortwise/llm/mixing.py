"""Mixing sources to target weights by temperature.

Token shares p of the sources are raised to an exponent a and normalised, q ~ p^a. The exponent is found by
bisection, sixteen sections at a time, so that the entropy of q meets a target or no source is repeated more
than a limit. A source's budget is its weight times the total budget. It is realised in whole passes and one partial
pass: documents are hashed into small blocks, every pass permutes the blocks of a source by digest, and the
partial pass takes blocks in that order as long as at least half of the next one fits the rest of the budget. Running sums over blocks are
made in two levels, so a source of any share is never ordered in one task.

Without a budget, the smallest total is chosen that shows every document at least once.

Defined cases: NULL sources form one source of their own. NULL and empty texts count no tokens; sources without any
tokens have weight 0 and are shown once. Repeated rows are rows of their own. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.llm.common import whole, written

#: Documents in a block on average, and blocks in a group of the upper level.
BLOCK_DOCS = 8
GROUP_BLOCKS = 1024
SECTIONS = 16
TOLERANCE = 1e-11


def _key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), "source"))


def _number(text: Column) -> Column:
    """32 bits of a digest as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))


def token_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, its key, tokens of the whole text, digest number that deals it to a block."""
    tokens = F.regexp_count(whole(), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")
    return docs.select("doc_id", "source", _key().alias("key"), tokens.alias("n_tokens"), _number(_id()).alias("deal"))


def _statistics(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(exponent, entropy of q in nats, largest repetition per smallest) for each exponent; one row each comes back."""
    tried = sources.select("p", F.explode(F.array(*[F.lit(float(a)) for a in exponents])).alias("a"))
    raised, log = F.pow("p", "a"), F.log("p")
    rows = tried.groupBy("a").agg(
        F.sum(raised).alias("z"), F.sum(raised * log).alias("l"),
        F.max((F.col("a") - 1) * log).alias("most"), F.min((F.col("a") - 1) * log).alias("least")).collect()
    return sorted((r.a, math.log(r.z) - r.a * r.l / r.z, math.exp(r.most - r.least)) for r in rows)


def exponent_for(sources: DataFrame, target_entropy: float | None, max_repetition: float | None) -> float:
    """Largest exponent in [0, 1] that reaches the entropy, or smallest that keeps the repetition limit.

    Repetition counts passes over the most repeated source while the least repeated is shown once.
    """
    low, high = 0.0, 1.0
    meets = (lambda entropy, ratio: entropy >= target_entropy) if target_entropy is not None else (lambda entropy, ratio: ratio > max_repetition)
    while high - low > TOLERANCE:
        points = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        below = [a for a, entropy, ratio in _statistics(sources, points) if meets(entropy, ratio)]
        at = points.index(max(below)) if below else 0
        low, high = points[at], points[min(at + 1, SECTIONS)]
        if not below or at == SECTIONS:
            return round(points[at], 9)
    return round(high, 9)


def weighted_sources(rows: DataFrame, target_entropy: float | None, max_repetition: float | None, budget: float | None) -> DataFrame:
    """One row per source: key, tokens, docs, weight, epochs (passes, a fraction counts as partial pass)."""
    sources = written(rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return sources.select("key", "tokens", "docs", F.lit(0.0).alias("weight"), F.lit(1.0).alias("epochs"))
    shares = sources.where("tokens > 0").withColumn("p", F.col("tokens") / F.lit(float(total)))
    a = exponent_for(shares, target_entropy, max_repetition)
    raised = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))
    z, largest = shares.agg(F.sum(F.pow("p", F.lit(a))), F.max(F.col("tokens") / F.pow("p", F.lit(a)))).first()
    all_tokens = z * largest if budget is None else float(budget)
    weight = F.when(F.col("tokens") > 0, raised / F.lit(z)).otherwise(F.lit(0.0))
    epochs = F.when(F.col("tokens") > 0, F.round(weight * F.lit(all_tokens) / F.col("tokens"), 9)).otherwise(F.lit(1.0))
    return sources.select("key", "tokens", "docs", weight.alias("weight"), epochs.alias("epochs"))


def block_copies(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per block: key, block, copies, weight, epochs."""
    blocks = (with_blocks(rows, sources).groupBy("key", "block")
              .agg(F.sum("n_tokens").alias("block_tokens"), *[F.first(c).alias(c) for c in ("docs", "tokens", "weight", "epochs")]))
    full = F.floor("epochs").cast("bigint")
    blocks = blocks.withColumn("full", full).withColumn("place", place("key", "block", F.col("full") + 1))
    groups_of_source = F.ceil(F.col("docs") / (BLOCK_DOCS * GROUP_BLOCKS))
    blocks = written(blocks.withColumn("part", F.floor(F.col("place") * groups_of_source / F.lit(2**32)).cast("bigint")), "blocks")
    upper = blocks.groupBy("key", "part").agg(F.sum("block_tokens").alias("part_tokens"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.select("key", "part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("key", "part").orderBy("place", "block")
    reached = F.col("earlier") + F.sum("block_tokens").over(inside)
    rest = F.round((F.col("epochs") - F.col("full")) * F.col("tokens"))
    return (blocks.join(upper, ["key", "part"])
            .withColumn("partial", reached - F.col("block_tokens") / 2 <= rest)
            .select("key", "block", "weight", "epochs", (F.col("full") + F.col("partial").cast("bigint")).alias("copies")))


def place(key: str, block: str, epoch: Column) -> Column:
    """Place of a block in the permutation of its source in one pass."""
    return _number(F.concat_ws("|", key, F.col(block).cast("string"), epoch.cast("string")))


def with_blocks(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(sources, "key").withColumn("block", F.col("deal") % F.ceil(F.col("docs") / BLOCK_DOCS).cast("bigint"))


def copies(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = 3.0, budget: float | None = None) -> DataFrame:
    """One row per document: doc_id, source, n_tokens, block, weight and epochs of its source, copies in the mix."""
    rows = written(token_rows(docs), "tokens")
    sources = written(weighted_sources(rows, target_entropy, max_repetition, budget), "weights")
    chosen = block_copies(rows, sources)
    dealt = with_blocks(rows, sources.select("key", "docs"))
    return dealt.join(chosen, ["key", "block"]).select(
        "doc_id", "source", "n_tokens", "block", F.round("weight", 9).alias("weight"), F.round("epochs", 6).alias("epochs"), "copies")


def mixed(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = 3.0, budget: float | None = None) -> DataFrame:
    """The mix itself: every document with all its columns once per copy, ``epoch`` and its place in the mix.

    Sorting by (epoch, mix_place, doc_id) gives the permuted sequence.
    """
    rows = written(token_rows(docs), "tokens")
    sources = written(weighted_sources(rows, target_entropy, max_repetition, budget), "weights")
    chosen = block_copies(rows, sources).select(F.col("key").alias("__key"), F.col("block").alias("__block"), F.col("copies").alias("__copies"))
    sizes = sources.select(F.col("key").alias("__source"), F.ceil(F.col("docs") / BLOCK_DOCS).cast("bigint").alias("__blocks"))
    dealt = docs.withColumn("__own", _key()).join(sizes, F.col("__own") == F.col("__source")).withColumn("__deal", _number(_id()) % F.col("__blocks"))
    joined = dealt.join(chosen, (F.col("__own") == F.col("__key")) & (F.col("__deal") == F.col("__block"))).where("__copies > 0")
    own = [c for c in docs.columns if c not in ("epoch", "mix_place")]
    return (joined.withColumn("__epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))))
            .select(*own, F.col("__epoch").alias("epoch"), place("__own", "__deal", F.col("__epoch")).alias("mix_place")))
