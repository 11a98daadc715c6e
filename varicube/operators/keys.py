"""Key checks, exact keyed draws and one-row statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varicube.session import cut_lineage


def key_mismatch(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only, with the side: empty when both key sets are equal."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return (
        a.join(b, key, "left_anti").withColumn("side", F.lit("left"))
        .unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))
    )


def require_same_keys(left: DataFrame, right: DataFrame, key: str, what: str) -> None:
    """Raise ``ValueError`` unless both sides hold the same set of keys."""
    sample = key_mismatch(left, right, key).take(5)
    if sample:
        shown = ", ".join(str(row[key]) for row in sample)
        raise ValueError(f"{what}: key sets differ, for example {shown}")


def draw_exact(rows: DataFrame, strata: list[str], digest: Column, tie: str, take: Column) -> DataFrame:
    """Mark exactly ``take`` rows of every stratum as ``drawn``, smallest digest first.

    ``digest`` is a hex digest, so its leading digits cut a stratum into even buckets whatever its
    size. Bucket counts locate the cut; only the bucket that straddles it is ranked, so no task
    ever sorts a whole stratum. Equivalent to row_number() over (partition by strata order by
    digest, tie) <= take.
    """
    rows = rows.withColumns({"_digest": digest, "_take": take}).withColumn("_bucket", F.substring("_digest", 1, 3))
    per_bucket = rows.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_in_bucket"))
    before = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("_before", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)))
    cut = (F.col("_before") < F.col("_take")) & (F.col("_before") + F.col("_in_bucket") > F.col("_take"))
    limits = rows.select(*strata, "_take").distinct()
    per_bucket = cut_lineage(per_bucket.join(limits, strata).withColumn("_cut", cut).drop("_take"))  # at most 4,096 rows a stratum
    placed = rows.join(per_bucket, [*strata, "_bucket"])
    rank = F.row_number().over(Window.partitionBy(*strata, "_bucket").orderBy("_digest", tie))
    whole = placed.where("not _cut").withColumn("drawn", F.col("_before") < F.col("_take"))
    ranked = placed.where("_cut").withColumn("drawn", F.col("_before") + rank <= F.col("_take"))
    return whole.unionByName(ranked).drop("_digest", "_bucket", "_in_bucket", "_before", "_take", "_cut")


def last_drawn(rows: DataFrame, strata: list[str], digest: Column, ties: list[str], take: int) -> DataFrame:
    """Strata, ``_digest`` and ``ties`` of the last row that a draw of ``take`` rows per stratum takes.

    The draw is that of ``draw_exact``, with ``ties`` unique in a stratum: it takes the rows up to this one. A stratum
    without a row here is drawn not at all (``take`` is 0), else it has fewer rows than ``take``.
    """
    rows = rows.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, 3))
    per_bucket = rows.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_in_bucket"))
    before = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("_left", F.lit(take) - F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)))
    cut = per_bucket.where((F.col("_left") > 0) & (F.col("_left") <= F.col("_in_bucket"))).select(*strata, "_bucket", "_left")
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("_digest", *ties))
    edge = rows.join(F.broadcast(cut_lineage(cut)), [*strata, "_bucket"]).withColumn("_rank", rank)  # a row a stratum is broadcast
    return edge.where("_rank = _left").select(*strata, "_digest", *ties)


def token_set_match(names: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose ``is_A_B`` name holds exactly the ``&``-joined tokens of ``query``, in any order."""
    wanted = F.array_sort(F.array(*[F.lit(t) for t in query.split("&")]))
    tokens = F.array_sort(F.split(F.regexp_replace(column, "is_", ""), "_"))
    return names.where(tokens == wanted)
