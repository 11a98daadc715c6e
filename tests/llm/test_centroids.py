import hashlib
import math

import pytest

from oracle_check import connect, difference
from varicube.llm import centroids, queries

SHAPE = "vec_id long, embedding array<float>"


def brute(rows, clusters, rounds, width):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    text = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(((text(i), v) for i, v in kept))[:clusters]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, v in kept:
            groups[assign(v)[1]].append(v)
        centres = [[sum(c) // len(g) for c in zip(*g)] if g else old for g, old in zip(groups, centres)]
    final = [(i, *assign(v)) for i, v in kept]
    per = [sum(d for _, d, k in final if k == c) for c in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, k, d, per[k], sum(per), sha[k]) for i, d, k in final), key=str)


def result(frame, **options):
    found = centroids.clustered(frame, **options)
    return sorted((tuple(r) for r in found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_brute_force(spark, parts):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    assert result(table.repartition(parts)) == brute(rows, 8, 10, 64)


def test_sql_on_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    good = [[((i * 7 + j * 3) % 11 - 5) / 3 for j in range(64)] for i in range(30)]
    rows = [(i, v) for i, v in enumerate(good)] + [(3, good[3]), (3, good[4]), (None, good[5]), (40, None), (41, []), (42, good[0][:63]), (43, good[0] + [0.0]),
            (44, [None] + good[0][1:]), (45, [nan] + good[0][1:]), (46, [inf] + good[0][1:]), (47, [-inf] + good[0][1:])]
    frame = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS q", "2 AS cluster", "3 AS distance", "'x' AS best")
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert result(frame) == brute(rows, 8, 10, 64)
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert difference(queries.op11_centroids(spark, str(tmp_path)), con, queries.ORACLE["op11_centroids"]) is None


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [0.0, 0.0]) for i in range(6)] + [(9, [1.0, 0.0])]
    found = result(spark.createDataFrame(rows, SHAPE), clusters=5, width=2)
    assert found == brute(rows, 5, 10, 2)
    assert len({r[1] for r in found if r[0] != 9}) == 1


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.5, -0.5]), (2, [0.25, 0.75])]
    assert result(spark.createDataFrame(rows, SHAPE), width=2) == brute(rows, 8, 10, 2)
    assert result(spark.createDataFrame([], SHAPE)) == []
    assert result(spark.createDataFrame([(1, None)], SHAPE)) == []


def test_sums_are_floored_for_negative_numbers(spark):
    rows = [(i, [-(i + 1) / 1024, i / 1024]) for i in range(4)]
    frame = spark.createDataFrame(rows, SHAPE)
    stored = centroids.quantised(frame, 2)
    assert centroids._moved(stored, [[0, 0]], 2) == [[-3, 1]]  # -10 / 4 and 6 / 4


def test_no_python_in_the_plan(spark):
    stored = spark.createDataFrame([(1, [1, 2])], "vec_id long, q array<long>")
    plan = stored.select(centroids.nearest([[0, 0], [1, 1]]))._jdf.queryExecution().toString()
    assert "zip_with" in plan and "array_min" in plan and "Python" not in plan and "Arrow" not in plan
