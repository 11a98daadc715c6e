"""k-means on integer vectors in Spark expressions.

Vectors are quantised once and stored. Every round sends the k centroids as array literals: ``zip_with`` and ``aggregate``
give the integer distance to each, ``array_min`` of (distance, number) chooses, and one sum per component, combined in the
map tasks, gives the next centroids. Only k rows of sums come back to the driver; a cluster may hold any share of the rows.
All arithmetic is on whole numbers, so partitioning and order cannot change the result.

Defined cases: vectors that are null, of another length, or with a null or non-finite component are left out; a null id
counts as empty text in the seed's hash; ties in the hash (repeated ids) go to the smaller vector; with fewer than k kept
vectors there are as many centroids; repeated rows each get their own equal result; an empty table gives an empty result;
extra columns are ignored. Numbers too large for a squared distance of 64 bits end the query with an overflow error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varicube.llm.common import checkpointed, work_folder

WIDTH = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = "3"


def quantised(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id and ``q``, the integer vector, of the usable rows."""
    components = F.col("embedding").cast("array<double>")
    largest = F.lit(1.7976931348623157e308)
    finite = F.forall(components, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= largest))
    usable = F.coalesce((F.size("embedding") == width) & finite, F.lit(False))
    return vectors.where(usable).select("vec_id", F.transform(components, lambda x: F.floor(x * scale)).alias("q"))


def seeds(stored: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> list[list[int]]:
    """The vectors with the smallest hashes, in hash order."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    drawn = stored.select(F.sha2(text.cast("binary"), 256).alias("hash"), "q").orderBy("hash", "q").limit(clusters)
    return [r["q"] for r in sorted(drawn.collect(), key=lambda r: (r["hash"], r["q"]))]


def _literal(centroid: list[int]) -> Column:
    return F.array(*[F.lit(c).cast("bigint") for c in centroid])


def nearest(centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid; the smaller number wins a tie."""

    def distance(centroid: list[int]) -> Column:
        squares = F.zip_with("q", _literal(centroid), lambda x, c: (x - c) * (x - c))
        return F.aggregate(squares, F.lit(0).cast("bigint"), lambda total, s: total + s)

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)]))


def _moved(stored: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    chosen = stored.select(nearest(centroids)["cluster"].alias("cluster"), "q")
    sums = [F.sum(F.col("q")[i]).alias(f"s{i}") for i in range(width)]
    moved = list(centroids)
    for row in chosen.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # a row per centroid
        moved[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return moved


def fit(stored: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, seed: str = SEED) -> list[list[int]]:
    centroids = seeds(stored, clusters, seed)
    for _ in range(rounds if centroids else 0):
        moved = _moved(stored, centroids, width)
        if moved == centroids:  # every further round repeats this one
            break
        centroids = moved
    return centroids


def clustered(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = SEED
) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark: SparkSession = vectors.sparkSession
    folder = work_folder(spark, "vectors")
    quantised(vectors, width, scale).write.parquet(folder)
    stored = spark.read.parquet(folder)
    centroids = fit(stored, clusters, rounds, width, seed)
    if not centroids:
        shape = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return spark.createDataFrame([], shape)
    best = stored.select("vec_id", nearest(centroids).alias("best"))
    assigned = checkpointed(best.select("vec_id", F.col("best.cluster").alias("cluster"), F.col("best.distance").alias("distance")))
    inertia = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    at = F.col("cluster") + 1
    return assigned.select(
        "vec_id", "cluster", "distance",
        F.element_at(_literal([inertia.get(k, 0) for k in range(len(centroids))]), at).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"),
        F.element_at(F.array(*[F.lit(d) for d in digest]), at).alias("centroid_sha256"),
    )
