"""Communities of categories: nearest-neighbour graph and Leiden clustering.

The graph joins each category with its nearest ones. Points are cut into blocks, a task compares one pair of blocks and
keeps each point's nearest there, and the few candidates per block are merged. Distances become weights as in a fuzzy
neighbourhood: full for the nearest, falling with a width found per point, and an edge is as strong as either side sees it.

Leiden alternates local moves, refinement and aggregation, each as joins on the edge table. Nodes of a round move at once;
a coin holds half of them back, and a round that would lower the modularity is done again with moves that touch every
community at most once, whose gains add up exactly. Refinement starts from single nodes inside each community and lets
single nodes join a neighbouring group that keeps still, so groups are connected. In the end a community that fell apart
is split into its connected parts, which never lowers the modularity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from varicube.session import stored

BLOCK = 512
NEIGHBOURS = 15
COMPONENTS = 50
MOST_ROUNDS = 1_000
GAIN = 1e-12
NEAREST = "code bigint, near array<struct<distance: double, code: bigint>>"


def matrix_points(pairs: DataFrame, value: str) -> DataFrame:
    """(code, point): the rows of a symmetric matrix (code_i, code_j, value); a row is as long as the category list."""
    codes = sorted(r[0] for r in pairs.select("code_i").distinct().collect())

    @F.pandas_udf(ArrayType(DoubleType()))
    def dense(cells: pd.Series) -> pd.Series:
        out = []
        for row in cells:
            point = np.zeros(len(codes))
            point[np.searchsorted(codes, [c["code_j"] for c in row])] = [c["v"] for c in row]
            out.append(point.tolist())
        return pd.Series(out)

    rows = pairs.groupBy("code_i").agg(F.collect_list(F.struct("code_j", F.coalesce(F.col(value), F.lit(0.0)).alias("v"))).alias("cells"))
    return rows.select(F.col("code_i").alias("code"), dense("cells").alias("point"))


def principal_points(points: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(code, point) by the leading principal components; shorter points stay as they are."""
    width = points.select(F.max(F.size("point"))).first()[0] or 0
    if width <= components:
        return points.select("code", "point")
    features = points.select("code", array_to_vector("point").alias("f"))
    return PCA(k=components, inputCol="f", outputCol="p").fit(features).transform(features).select("code", vector_to_array("p").alias("point"))


def nearest(points: DataFrame, k: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """(code, near): the k nearest other points by Euclidean distance, nearest first; ties go to the smaller code."""
    n = points.count()
    blocks = max(1, -(-n // block))
    placed = points.select("code", "point", F.pmod(F.xxhash64("code"), F.lit(blocks)).alias("block"))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asking = placed.withColumn("other", others).select(F.col("block").alias("bi"), F.col("other").alias("bj"), "code", "point", F.lit(True).alias("asks"))
    offered = placed.withColumn("other", others).select(F.col("other").alias("bi"), F.col("block").alias("bj"), "code", "point", F.lit(False).alias("asks"))

    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        ask, offer = pair[pair["asks"]].sort_values("code"), pair[~pair["asks"]].sort_values("code")
        if not len(ask) or not len(offer):
            return pd.DataFrame({"code": [], "near": []})
        x, y = np.vstack(ask["point"].to_list()), np.vstack(offer["point"].to_list())
        squared = np.maximum((x * x).sum(1)[:, None] - 2.0 * x @ y.T + (y * y).sum(1)[None, :], 0.0)
        codes = offer["code"].to_numpy()
        squared[ask["code"].to_numpy()[:, None] == codes[None, :]] = np.inf
        order = np.argsort(squared, axis=1, kind="stable")[:, :k]
        near = [[(float(np.sqrt(d[j])), int(codes[j])) for j in o if np.isfinite(d[j])] for d, o in zip(squared, order)]
        return pd.DataFrame({"code": ask["code"].to_numpy(), "near": near})

    found = asking.unionByName(offered).groupBy("bi", "bj").applyInPandas(compare, NEAREST)
    merged = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k)  # k candidates per block
    return found.groupBy("code").agg(merged.alias("near"))


@F.pandas_udf(ArrayType(DoubleType()))
def _weights(near: pd.Series) -> pd.Series:
    """Fuzzy membership of each neighbour: the width makes their sum log2 of their number."""
    out = []
    for row in near:
        d = np.array([item["distance"] for item in row])
        positive = d[d > 0]
        over = np.maximum(d - (positive.min() if len(positive) else 0.0), 0.0)
        low, high, wanted = 0.0, np.inf, np.log2(max(len(d), 2))
        width = max(float(over.mean()), 1e-12)
        for _ in range(64):
            total = np.exp(-over / width).sum()
            low, high = (low, width) if total > wanted else (width, high)
            width = 2.0 * width if np.isinf(high) else (low + high) / 2.0
        out.append(np.exp(-over / max(width, 1e-3 * max(float(d.mean()), 1e-12))).tolist())
    return pd.Series(out)


def neighbour_graph(points: DataFrame, k: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """(src, dst, weight) with src < dst."""
    weighted = nearest(points, k, block).withColumn("weight", _weights("near"))
    sides = weighted.select(F.col("code").alias("a"), F.inline(F.arrays_zip(F.col("near.code").alias("b"), "weight")))
    each = sides.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "weight")
    either = F.sum("weight") - F.when(F.count(F.lit(1)) > 1, F.min("weight") * F.max("weight")).otherwise(0.0)
    return each.groupBy("src", "dst").agg(either.alias("weight"))


def _both(edges: DataFrame) -> DataFrame:
    """Both directions; an edge from a node to itself once, with its weight doubled."""
    ordinary = edges.where("src <> dst")
    loops = edges.where("src = dst").select("src", "dst", (F.col("weight") * 2).alias("weight"))
    return ordinary.unionByName(ordinary.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).unionByName(loops)


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of ``labels`` (node, community) on undirected ``edges`` (src, dst, weight)."""
    return _quality(_both(edges), labels, resolution)


def _quality(both: DataFrame, labels: DataFrame, resolution: float) -> float:
    a, b = (labels.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}")) for end in ("src", "dst"))
    sums = both.join(a, "src").join(b, "dst").groupBy(F.col("c_src").alias("c")).agg(
        F.sum("weight").alias("degree"), F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("weight")).otherwise(0.0)).alias("inside")
    )
    row = sums.agg(F.sum("degree").alias("all"), F.sum("inside").alias("inside"), F.sum(F.col("degree") * F.col("degree")).alias("squares")).first()
    return row["inside"] / row["all"] - resolution * row["squares"] / row["all"] ** 2 if row["all"] else 0.0


def best_moves(both: DataFrame, labels: DataFrame, total: float, resolution: float, within: Column | None = None) -> DataFrame:
    """(node, community, target, gain): every node's best other community among its neighbours', if it gains.

    ``labels`` has node, community and degree (and what ``within`` needs of ``mine`` and ``theirs``); ``total`` is the
    sum of all degrees. The gain is in units of the modularity.
    """
    extra = [c for c in labels.columns if c not in ("node", "community", "degree")]
    theirs = labels.select(F.col("node").alias("dst"), F.col("community").alias("target"), *[F.col(c).alias(f"their_{c}") for c in extra])
    mine = labels.select(F.col("node").alias("src"), "community", "degree", *[F.col(c).alias(f"my_{c}") for c in extra])
    met = both.where("src <> dst").join(theirs, "dst").join(mine, "src")
    links = (met if within is None else met.where(within)).groupBy("src", "community", "degree", "target").agg(F.sum("weight").alias("links"))
    sizes = labels.groupBy(F.col("community").alias("target")).agg(F.sum("degree").alias("size"))
    known = links.join(sizes, "target")
    own = known.where("target = community").select("src", F.col("links").alias("own_links"))
    left = sizes.select(F.col("target").alias("community"), F.col("size").alias("own_size"))
    compared = known.where("target <> community").join(own, "src", "left").join(left, "community")
    gain = F.lit(2.0) * (F.col("links") - F.coalesce("own_links", F.lit(0.0))) / total - F.lit(2.0 * resolution) * F.col("degree") * (
        F.col("size") - F.col("own_size") + F.col("degree")
    ) / F.lit(total * total)
    gained = compared.withColumn("gain", gain).where(F.col("gain") > GAIN)
    best = F.max_by(F.struct("community", "target", "gain"), F.struct(F.round("gain", 12), -F.col("target")))
    return gained.groupBy(F.col("src").alias("node")).agg(best.alias("b")).select("node", "b.community", "b.target", "b.gain")


def _coin(node: Column, number: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(number), node), F.lit(2)) == 1


def _moved(labels: DataFrame, moves: DataFrame) -> DataFrame:
    chosen = moves.select("node", F.col("target").alias("_target"))
    return labels.join(chosen, "node", "left").withColumn("community", F.coalesce("_target", "community")).drop("_target")


def local_moves(both: DataFrame, labels: DataFrame, total: float, resolution: float) -> DataFrame:
    """Labels after moves until no single move gains; the modularity rises in every round."""
    quality = _quality(both, labels, resolution)
    for number in range(MOST_ROUNDS):
        moves = stored(best_moves(both, labels, total, resolution))
        if moves.isEmpty():
            return labels
        tried = stored(_moved(labels, moves.where(_coin(F.col("node"), number))))
        reached = _quality(both, tried, resolution)
        if reached <= quality + GAIN:
            touched = moves.select("node", "gain", F.explode(F.array("community", "target")).alias("touched"))
            first = touched.groupBy("touched").agg(F.max_by("node", F.struct("gain", -F.col("node"))).alias("node"))
            free = first.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("node")
            tried = stored(_moved(labels, moves.join(free, "node", "left_semi")))
            reached = _quality(both, tried, resolution)
        labels, quality = tried, reached
    raise ArithmeticError(f"nodes still move after {MOST_ROUNDS} rounds")


def refined(both: DataFrame, labels: DataFrame, total: float, resolution: float) -> DataFrame:
    """Connected groups inside the communities: labels with ``community`` the group and ``outer`` the community."""
    groups = stored(labels.select("node", "degree", F.col("community").alias("outer"), F.col("node").alias("community")))
    for number in range(MOST_ROUNDS):
        moves = best_moves(both, groups, total, resolution, F.col("my_outer") == F.col("their_outer"))
        alone = groups.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("only")).where("n = 1")
        moves = stored(moves.join(alone.select(F.col("only").alias("node")), "node", "left_semi"))
        if moves.isEmpty():
            return groups
        # A lone node that moves must not be joined in the same round. The node with the best gain moves in any case.
        coined = moves.where(_coin(F.col("node"), number))
        still = coined.join(coined.select(F.col("node").alias("target")), "target", "left_anti")
        if still.isEmpty():
            still = moves.orderBy(F.desc("gain"), "node").limit(1)
        groups = stored(_moved(groups, still))
    raise ArithmeticError(f"groups still grow after {MOST_ROUNDS} rounds")


def connected_parts(both: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, community): every community cut into its connected parts, named by their smallest nodes."""
    parts = labels.select("node", "community", F.col("node").alias("part"))
    ends = both.select("src", "dst").where("src <> dst")
    a, b = (labels.select(F.col("node").alias(e), F.col("community").alias(f"c_{e}")) for e in ("src", "dst"))
    inside = stored(ends.join(a, "src").join(b, "dst").where("c_src = c_dst").select("src", "dst"))
    for _ in range(MOST_ROUNDS):
        seen = inside.join(parts.select(F.col("node").alias("dst"), F.col("part").alias("near")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("near").alias("near"))
        least = parts.join(seen, "node", "left").withColumn("least", F.least("part", F.coalesce("near", "part")))
        # A part also takes the name that its own namesake has found, which halves the way.
        jump = least.select(F.col("node").alias("least"), F.col("least").alias("jump"))
        moved = stored(least.join(jump, "least", "left").select("node", "community", "part", F.least("least", F.coalesce("jump", "least")).alias("now")))
        parts = moved.select("node", "community", F.col("now").alias("part"))
        if moved.where("now <> part").isEmpty():
            return parts.select("node", F.col("part").alias("community"))
    raise ArithmeticError(f"parts still change after {MOST_ROUNDS} rounds")


def leiden(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(node, community) of a weighted undirected graph; communities are named by their smallest nodes.

    A node without edges is a community of its own. The result is connected and no single node gains by moving alone
    on the last level; it depends on the graph only, not on partitions or order.
    """
    edges = stored(edges.where("weight > 0").select("src", "dst", "weight"))
    both = stored(_both(edges))
    row = both.agg(F.sum("weight")).first()
    total = float(row[0] or 0.0)
    members = stored(nodes.select("node", F.col("node").alias("top")).distinct())  # node and its node on the current level
    if not total:
        return members.select("node", F.col("top").alias("community"))
    level, start = both, None
    for _ in range(MOST_ROUNDS):
        degrees = level.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree"))
        labels = degrees.withColumn("community", F.col("node")) if start is None else degrees.join(start, "node")
        labels = local_moves(level, stored(labels), total, resolution)
        groups = refined(level, labels, total, resolution)
        before, after, outer = groups.agg(F.count(F.lit(1)), F.countDistinct("community"), F.countDistinct("outer")).first()
        if after == before or outer == before:
            found = members.join(labels.select(F.col("node").alias("top"), "community"), "top", "left").select("node", F.coalesce("community", "top").alias("community"))
            return connected_parts(both, stored(found))
        renamed = groups.select(F.col("node").alias("top"), F.col("community").alias("group"))
        members = stored(members.join(renamed, "top", "left").select("node", F.coalesce("group", "top").alias("top")))
        a, b = (groups.select(F.col("node").alias(e), F.col("community").alias(f"g_{e}")) for e in ("src", "dst"))
        level = stored(level.join(a, "src").join(b, "dst").groupBy(F.col("g_src").alias("src"), F.col("g_dst").alias("dst")).agg(F.sum("weight").alias("weight")))
        # On the next level a community is named by one of its groups.
        named = groups.withColumn("name", F.min("community").over(Window.partitionBy("outer")))
        start = stored(named.select(F.col("community").alias("node"), F.col("name").alias("community")).distinct())
    raise ArithmeticError(f"levels still change after {MOST_ROUNDS}")


def numbered(found: DataFrame) -> DataFrame:
    """(code, cluster): communities numbered from 1, the largest first."""
    sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("n"))  # bounded by the category domain
    order = Window.orderBy(F.desc("n"), "community")
    ranks = sizes.select("community", F.row_number().over(order).alias("cluster"))
    return found.join(ranks, "community").select(F.col("node").alias("code"), "cluster")


def category_communities(points: DataFrame, resolution: float = 1.0, k: int = NEIGHBOURS) -> DataFrame:
    """(code, cluster) from (code, point): principal components, neighbour graph, Leiden."""
    reduced = stored(principal_points(points))
    return numbered(leiden(neighbour_graph(reduced, k), reduced.select(F.col("code").alias("node")), resolution))
