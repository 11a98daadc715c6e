"""Mixing sources to target weights: floor(rate) copies of each document plus a hash-seeded coin for the fraction.

Sizes are word counts. Sources in code point order, null last, take the weights in turn. The budget is a share of all
words; a source's target stops at ``most`` times its size and what is cut off goes to the others by weight. With
``level`` the common words per weight unit, every target is ``min(most * size, level * weight)``; sources reach their
cap in the order of size / weight, so the level follows from two running sums over the source table.

Defined cases: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own; a source
without words has target 0 and rate 0; repeated rows share one coin; an empty table gives an empty result. Extra
columns of any name pass through ``mixed`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varicube.llm.common import WORD, checkpointed, fresh, sized_broadcast

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix"
COIN_RANGE = 1 << 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def coin(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by seed and id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(COIN_RANGE))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target and rate for each source of ``sizes`` (source, size)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source: the running sums below are over the mixture's own table.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The first source in ratio order that its share does not fill fixes the level; the ones before it are capped.
    level = F.when(F.col("cap") >= left / weight_left * F.col("weight"), left / weight_left)
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.first("level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .select("source", "source_size", "target", "rate")
    )


def mixture(docs: DataFrame, seed: str = SEED, **targets) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies and taken = copies * size."""
    sizes = checkpointed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    table = sized_broadcast(source_targets(sizes, **targets).withColumnRenamed("source", "its_source"))
    joined = sizes.join(table, F.col("source").eqNullSafe(F.col("its_source")), "left")
    whole = F.floor("rate")
    copies = whole + (coin(F.col("doc_id"), seed) < F.col("rate") - whole).cast("bigint")
    return joined.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed(docs: DataFrame, seed: str = SEED, **targets) -> DataFrame:
    """``docs`` with each row as often as the mixture takes it; same columns."""
    source, rate, size = fresh(docs, "mix_source", "mix_rate", "mix_copy")
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    table = sized_broadcast(source_targets(sizes, **targets).select(F.col("source").alias(source), F.col("rate").alias(rate)))
    whole = F.floor(rate)
    copies = whole + (coin(F.col("doc_id"), seed) < F.col(rate) - whole).cast("bigint")
    joined = docs.join(table, F.col("source").eqNullSafe(F.col(source)), "left")
    taken = joined.withColumn(size, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
