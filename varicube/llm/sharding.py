"""Proportional stratified interleaving: every shard, and every stretch of a shard, has the mixture of the whole.

Rows are shuffled inside their source by a seeded digest. A row at place r of n in its source has the fractional rank
(2r - 1) / 2n; sorted by it the sources interleave in proportion, and the order is cut into runs of equal count.

Both ranks are exact and neither sorts a source in one task: digests fall into buckets of about ``per_bucket`` rows, the
rows of a bucket are numbered in it and the earlier buckets' counts are added. The fractional rank is cut the same way.

Defined cases: a null source is a source of its own; a null or empty text has size 1 and CRC-32 0; a null id counts as
empty text in the digest; equal rows take neighbouring places in any order; an empty table gives an empty result.
Extra columns of any name pass through ``sharded`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varicube.llm.common import checkpointed, fresh, sized_broadcast

SHARDS = 16
SEED = "shard"
PER_BUCKET = 5_000


def _digest(seed: str, *parts: Column) -> Column:
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(seed), *text).cast("binary"))


def _earlier(counts: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """Rows in the earlier buckets of each group; one row per bucket, so a group here is rows / per_bucket long."""
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("earlier", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))


def placed(keys: DataFrame, shards: int = SHARDS, per_bucket: int = PER_BUCKET) -> DataFrame:
    """``keys`` (stratum, digest, tie, ...) with shard and slot."""
    strata = sized_broadcast(keys.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")))
    share = F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    dealt = keys.join(strata, "stratum").withColumn("bucket", F.floor(share * F.ceil(F.col("n") / per_bucket)))
    offsets = _earlier(dealt.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("in_bucket")), ["stratum"], "bucket")
    inside = Window.partitionBy("stratum", "bucket").orderBy("digest", "tie")
    ranked = (
        dealt.withColumn("place", F.row_number().over(inside))
        .join(offsets.drop("in_bucket"), ["stratum", "bucket"])
        .withColumn("rank", F.col("place") + F.col("earlier"))
        .drop("place", "earlier", "bucket")
    )
    total = keys.count()
    # floor(cells * (2 rank - 1) / (2 n)) in whole numbers
    cells = max(1, -(-total // per_bucket))
    cut = checkpointed(ranked.withColumn("cell", F.expr(f"({cells}L * (2 * rank - 1)) div (2 * n)")))
    before = _earlier(cut.groupBy("cell").agg(F.count(F.lit(1)).alias("in_bucket")).withColumn("all", F.lit(1)), ["all"], "cell")
    fraction = (F.lit(2) * F.col("rank") - 1) / (F.lit(2.0) * F.col("n"))
    order = Window.partitionBy("cell").orderBy(fraction, "stratum", "rank")
    position = F.row_number().over(order) + F.col("earlier") - 1
    numbered = cut.join(before.select("cell", "earlier"), "cell").withColumn("position", position)
    shard = F.expr(f"(position * {shards}) div {total}L")
    start = F.expr(f"((position * {shards}) div {total}L * {total}L + {shards - 1}) div {shards}")
    return numbered.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("position") - start)


def shard_table(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, **options) -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, law, shard, slot, grown_shard (null under ``rows``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select(
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("stratum"),
        _digest(seed, F.col("doc_id")).alias("digest"), F.crc32(text.cast("binary")).alias("tie"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"), "doc_id", "source",
    )
    return placed(checkpointed(keys), shards, **options).select(
        "doc_id", "source", "size", F.col("tie").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, **options) -> DataFrame:
    """All columns of ``docs`` with shard and slot (prefixed with ``__`` where the table has such a column).

    ``docs`` is stored data: rows are numbered by scan."""
    row, = fresh(docs, "row")
    kept = docs.withColumn(row, F.monotonically_increasing_id())
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = kept.select(
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("stratum"),
        _digest(seed, F.col("doc_id")).alias("digest"), F.crc32(text.cast("binary")).alias("tie"), F.col(row).alias("row"),
    )
    taken = {c.lower() for c in docs.columns}
    shard, slot = (fresh(docs, c)[0] if c in taken else c for c in ("shard", "slot"))
    places = placed(checkpointed(keys), shards, **options).select(
        F.col("row").alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot)
    )
    return kept.join(places, row).drop(row)
