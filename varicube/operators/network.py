"""The category network: members, clusters, block correlations and the cluster graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varicube.functions.scalars import INFINITY, finite
from varicube.functions.stats import normal_quantile

# Terms that never represent a community.
GENERIC_TERMS = ("All", "Any", "SNV", "Indel")


def prepare_members(rows: DataFrame, min_count: float) -> DataFrame:
    """Directed z-scores and log risks of categories (code, cluster, P, Relative_Risk, Raw_counts).

    ``flag`` drops rare categories and missing P; ``flag2`` also drops infinite log risks. Infinite
    z-scores become 1.1 times the largest finite one.
    """
    rr, p = F.col("Relative_Risk"), F.col("P")
    directed = F.when((rr <= 1) & (p < 0.5), 1 - p).otherwise(p)
    scored = rows.withColumns({
        "z": normal_quantile(F.lit(1.0) - directed),
        "log_rr": F.when(rr == 0, F.lit(-INFINITY)).otherwise(F.log(rr)),
        "flag": (F.col("Raw_counts") < min_count) | p.isNull(),
    })
    top = scored.agg(F.max(F.when(finite(F.col("z")), F.col("z")))).first()[0]
    edge = 1.1 * abs(top or 0.0)
    z = F.col("z")
    return scored.withColumns({
        "z": F.when(z == INFINITY, edge).when(z == -INFINITY, -edge).otherwise(z),
        "flag2": F.col("flag") | (F.abs("log_rr") == INFINITY),
    })


def cluster_sizes(members: DataFrame) -> DataFrame:
    """Usable members of each cluster."""
    return members.groupBy("cluster").agg(F.count_if(F.col("P").isNotNull() & ~F.col("flag")).alias("size"))


def cluster_pairs(ids: DataFrame) -> DataFrame:
    """All pairs src < dst of cluster numbers; the number of clusters is a parameter of the analysis."""
    top = ids.agg(F.max("cluster")).first()[0]
    if top is None:
        return ids.select(F.col("cluster").alias("src"), F.col("cluster").alias("dst")).limit(0)
    upper = ids.where(F.col("cluster") < top).select(
        F.col("cluster").alias("src"), F.explode(F.sequence(F.col("cluster") + 1, F.lit(top))).alias("dst")
    )
    return upper.join(ids.select(F.col("cluster").alias("dst")), "dst", "left_semi").select("src", "dst")


def block_means(pairs: DataFrame, clusters: DataFrame, value: str) -> DataFrame:
    """Mean of ``value`` over the whole block of each cluster pair; absent category pairs are zeros."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    left = clusters.select(F.col("code").alias("code_i"), F.col("cluster").alias("cluster_i"))
    right = clusters.select(F.col("code").alias("code_j"), F.col("cluster").alias("cluster_j"))
    sums = (
        pairs.join(left, "code_i").join(right, "code_j").where(F.col("cluster_i") <= F.col("cluster_j"))
        .groupBy("cluster_i", "cluster_j").agg(F.sum(value).alias("total"))
    )
    sized = sums.join(sizes.select(F.col("cluster").alias("cluster_i"), F.col("size").alias("size_i")), "cluster_i").join(
        sizes.select(F.col("cluster").alias("cluster_j"), F.col("size").alias("size_j")), "cluster_j"
    )
    return sized.select("cluster_i", "cluster_j", (F.col("total") / (F.col("size_i") * F.col("size_j"))).alias(f"mean_{value}"))


def graph_edges(means: DataFrame, threshold: float, value: str = "mean_corr") -> DataFrame:
    """Edges between different clusters whose mean correlation exceeds ``threshold``."""
    return means.where((F.col("cluster_i") < F.col("cluster_j")) & (F.col(value) > threshold)).select(
        F.col("cluster_i").alias("src"), F.col("cluster_j").alias("dst"), F.col(value).alias("weight")
    )


def representative_terms(named: DataFrame, tag: str | None = None) -> DataFrame:
    """Most frequent terms of each cluster (all ties, sorted), empty where nothing repeats."""
    tokens = named.select("cluster", F.explode(F.split("Category", "_")).alias("term")).where(~F.col("term").isin(*GENERIC_TERMS))
    if tag:
        tokens = tokens.where(~F.contains(F.lower("term"), F.lit(tag.lower())))
    counted = tokens.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("n"))
    # A cluster's list is bounded by the terms of the domain.
    listed = counted.groupBy("cluster").agg(F.max("n").alias("top"), F.collect_list(F.struct("term", "n")).alias("terms"))
    best = F.transform(F.filter("terms", lambda t: t["n"] == F.col("top")), lambda t: t["term"])
    return listed.select(
        "cluster", F.col("top").alias("n"),
        F.when(F.col("top") > 1, F.array_join(F.array_sort(best), "&")).otherwise("").alias("terms"),
    )
