"""Neighbour graph and Leiden against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varicube.operators import communities

EDGES = "src long, dst long, weight double"


def frame(spark, edges, parts=3):
    return spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in edges], EDGES).repartition(parts)


def plain_modularity(edges, label, resolution=1.0):
    m = sum(w for *_, w in edges)
    degree = {}
    for a, b, w in edges:
        degree[a] = degree.get(a, 0) + w
        degree[b] = degree.get(b, 0) + w
    size = {}
    for node, k in degree.items():
        size[label[node]] = size.get(label[node], 0) + k
    return sum(w for a, b, w in edges if label[a] == label[b]) / m - resolution * sum(s * s for s in size.values()) / (4 * m * m)


def connected(edges, label):
    for c in set(label.values()):
        todo = [min(n for n in label if label[n] == c)]
        seen = set(todo)
        while todo:
            n = todo.pop()
            for a, b, _ in edges:
                for x, y in ((a, b), (b, a)):
                    if x == n and label[y] == c and y not in seen:
                        seen.add(y)
                        todo.append(y)
        if seen != {n for n in label if label[n] == c}:
            return False
    return True


def labels_of(found):
    return {r["node"]: r["community"] for r in found.collect()}


@pytest.fixture(scope="module")
def planted():
    """Three groups of ten; strong inside, weak and rare between; a pair on its own."""
    rng = np.random.default_rng(3)
    edges = [(a, b, 1.0 if a // 10 == b // 10 else 0.3) for a in range(30) for b in range(a + 1, 30) if rng.random() < (0.6 if a // 10 == b // 10 else 0.03)]
    return [*edges, (70, 71, 0.5), (5, 5, 0.25)]


def test_planted_groups(spark, planted):
    nodes = spark.createDataFrame([(n,) for n in [*range(30), 70, 71, 99]], "node long")
    found = communities.leiden(frame(spark, planted), nodes)
    label = labels_of(found)
    assert len(label) == 33 and label[99] == 99 and label[70] == label[71] == 70
    assert all(len({label[n] for n in range(10 * g, 10 * g + 10)}) == 1 for g in range(3)) and len(set(label.values())) == 5
    assert all(c == min(n for n in label if label[n] == c) for c in set(label.values()))
    assert connected(planted, label)
    assert communities.modularity(frame(spark, planted), found) == pytest.approx(plain_modularity(planted, label))
    again = labels_of(communities.leiden(frame(spark, planted[::-1], 7).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), nodes.repartition(5)))
    assert again == label


def test_low_resolution_gives_one_community(spark):
    cliques = [(4 * c + i, 4 * c + j, 1.0) for c in range(4) for i in range(4) for j in range(i)]
    ring = cliques + [(4 * c, 4 * ((c + 1) % 4) + 1, 1.0) for c in range(4)]
    nodes = spark.range(16).select(F.col("id").alias("node"))
    coarse = labels_of(communities.leiden(frame(spark, ring), nodes, resolution=0.01))
    assert len(set(coarse.values())) == 1


def test_no_single_move_gains_by_brute_force(spark, planted):
    """best_moves lists exactly the gains that a plain recomputation finds."""
    label = {n: n % 7 for n in range(30)} | {70: 70, 71: 71}
    both = communities._both(frame(spark, planted))
    total = both.agg(F.sum("weight")).first()[0]
    labels = spark.createDataFrame(list(label.items()), "node long, community long").join(both.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree")), "node")
    moves = {r["node"]: r for r in communities.best_moves(both, labels, total, 1.3).collect()}
    base = plain_modularity(planted, label, 1.3)
    for node in label:
        near = {label[b if a == node else a] for a, b, _ in planted if node in (a, b)} - {label[node]}
        gains = {c: plain_modularity(planted, label | {node: c}, 1.3) - base for c in near}
        best = max(gains.values(), default=0.0)
        if best > 1e-9:
            assert moves[node]["gain"] == pytest.approx(best) and gains[moves[node]["target"]] == pytest.approx(best)
        else:
            assert node not in moves


def test_connected_parts(spark):
    edges = [(i, i + 1, 1.0) for i in range(40)] + [(50, 51, 1.0)]
    label = [(i, 0 if i < 15 or 25 <= i else 1) for i in range(41)] + [(50, 0), (51, 0), (60, 0)]
    found = labels_of(communities.connected_parts(communities._both(frame(spark, edges)), spark.createDataFrame(label, "node long, community long")))
    assert found == {**{i: 0 for i in range(15)}, **{i: 15 for i in range(15, 25)}, **{i: 25 for i in range(25, 41)}, 50: 50, 51: 50, 60: 60}


def test_no_edges(spark):
    nodes = spark.createDataFrame([(3,), (4,)], "node long")
    assert labels_of(communities.leiden(frame(spark, []), nodes)) == {3: 3, 4: 4}
    assert labels_of(communities.leiden(frame(spark, []), nodes.limit(0))) == {}


@pytest.mark.parametrize("block", [512, 13])
def test_nearest_by_brute_force(spark, block):
    rng = np.random.default_rng(0)
    points = np.round(rng.normal(size=(90, 4)), 1)
    points[50] = points[7]
    found = communities.nearest(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "code long, point array<double>"), 5, block)
    for r in found.collect():
        d = np.sqrt(((points - points[r["code"]]) ** 2).sum(axis=1))
        expected = sorted((x, i) for i, x in enumerate(d) if i != r["code"])[:5]
        assert [n["distance"] for n in r["near"]] == pytest.approx([x for x, _ in expected], abs=1e-6)
    assert found.count() == 90


def test_weights_of_the_graph(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(40, 3))
    frame_ = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "code long, point array<double>")
    near = {r["code"]: r["near"] for r in communities.nearest(frame_, 8).collect()}
    weights = {r["code"]: r["w"] for r in communities.nearest(frame_, 8).select("code", communities._weights("near").alias("w")).collect()}
    for code, w in weights.items():
        assert w[0] == pytest.approx(1.0) and sum(w) == pytest.approx(3.0, abs=1e-6) and w == sorted(w, reverse=True)
    side = {(c, n["code"]): x for c in near for n, x in zip(near[c], weights[c])}
    for r in communities.neighbour_graph(frame_, 8).collect():
        a, b = side.get((r["src"], r["dst"]), 0.0), side.get((r["dst"], r["src"]), 0.0)
        assert r["src"] < r["dst"] and r["weight"] == pytest.approx(a + b - a * b)
