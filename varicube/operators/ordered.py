"""Global order without a single-task sort: ranks, running sums and running extremes.

Rows are range-partitioned on the full order, the partition number is fixed by a checkpoint, one small
row per partition carries the offset, and windows run inside partitions. A tie group of any size spreads
over partitions because the order ends in a unique key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varicube.session import cut_lineage


def in_global_order(frame: DataFrame, *order: Column) -> DataFrame:
    """``frame`` with ``_part``: partition numbers ascend with ``order``."""
    ranged = frame.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    return cut_lineage(ranged)


def running(ordered: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """Add running sums (first row to current row) of the given expressions."""
    offsets = ordered.groupBy("_part").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in totals.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(
        "_part", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in totals]
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ordered.withColumns({f"_l_{n}": F.sum(e).over(inside) for n, e in totals.items()})
    joined = local.join(offsets, "_part")
    return joined.withColumns({n: F.col(f"_o_{n}") + F.col(f"_l_{n}") for n in totals}).drop(
        *[f"_{k}_{n}" for n in totals for k in ("o", "l")]
    )


def with_ordinal(frame: DataFrame, *keys: str, name: str = "ordinal") -> DataFrame:
    """Zero-based position of each row in ``keys`` order (keys unique)."""
    order = [F.col(k) for k in keys]
    ordered = in_global_order(frame, *order)
    return running(ordered, order, {name: F.lit(1).cast("bigint")}).withColumn(name, F.col(name) - 1).drop("_part")


def cumulative_share(frame: DataFrame, value: str, key: str) -> DataFrame:
    """Running share of ``value`` in descending order, with its 1-based position."""
    order = [F.col(value).desc(), F.col(key).asc()]
    ordered = in_global_order(frame, *order)
    total = ordered.agg(F.sum(value)).first()[0]
    placed = running(ordered, order, {"position": F.lit(1).cast("bigint"), "_sum": F.col(value)})
    if not total:
        return placed.withColumn("share", F.lit(None).cast("double")).drop("_sum", "_part")
    return placed.withColumn("share", F.col("_sum") / F.lit(float(total))).drop("_sum", "_part")


def running_mean(frame: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """Mean of the smallest values up to and including each row (ties by ``key``)."""
    order = [F.col(value).asc(), F.col(key).asc()]
    ordered = in_global_order(frame, *order)
    placed = running(ordered, order, {"_n": F.lit(1).cast("bigint"), "_sum": F.col(value)})
    return placed.withColumn(name, F.col("_sum") / F.col("_n")).drop("_n", "_sum", "_part")


def benjamini_hochberg(frame: DataFrame, p: str, key: str, name: str = "FDR") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values: the running minimum of p*m/rank from the largest p down."""
    order = [F.col(p).asc(), F.col(key).asc()]
    ordered = in_global_order(frame.where(F.col(p).isNotNull()), *order)
    m = ordered.count()
    ranked = running(ordered, order, {"_rank": F.lit(1).cast("bigint")})
    ranked = ranked.withColumn("_raw", F.col(p) * F.lit(float(m)) / F.col("_rank"))
    later = Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    tails = ranked.groupBy("_part").agg(F.min("_raw").alias("_least")).select(
        "_part", F.min("_least").over(later).alias("_later")
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    adjusted = ranked.withColumn("_here", F.min("_raw").over(inside)).join(tails, "_part")
    return adjusted.withColumn(name, F.least("_here", "_later", F.lit(1.0))).drop(
        "_rank", "_raw", "_here", "_later", "_part"
    )
