"""Mixing, exact deduplication and sharding: SQL, brute force, edge cases."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from oracle_check import connect, difference

import __spark_entry__ as entry
from varicube.llm import exact_dedup, mixing, sharding

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_mixing", "op7_exact_dedup"])
def test_query_matches_sql(spark, name):
    assert difference(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) is None


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Share out by weight, cap, and share the excess again until nobody is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = {s: 0.0 for s in order}, set(order)
    left = share * sum(sizes.values())
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        given = {s: target[s] + left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] = min(given[s], most * sizes[s])
            left += given[s] - target[s]
            if given[s] >= most * sizes[s]:
                open_.discard(s)
    return target


def test_targets_by_repeated_sharing(spark):
    sizes = {"a": 10, "b": 1000, "é": 30, None: 500, "Z": 2, "zz": 0}
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mixture_edges(edge, empty):
    rows = mixing.mixture(edge).collect()
    assert len(rows) == 10
    assert {r["doc_id"]: r["size"] for r in rows}[1] == 0
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mixture(empty).count() == 0
    out = mixing.mixed(edge)
    assert out.columns == edge.columns
    taken = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    copies = {(r["doc_id"], r["source"]): r["copies"] for r in rows}
    assert taken[4] == copies[4, "b"] and taken[6] == 2 * copies[6, "c"]
    assert mixing.mixed(empty).count() == 0


def test_mixture_repeats(documents):
    a, b = mixing.mixture(documents).collect(), mixing.mixture(documents).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def brute_classes(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = max(known) if known else None
        seen = False
        for i in ids:
            kept = i == best and not seen
            seen = seen or kept
            out.append((i, best, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("per_salt", [1, 2, 1000])
def test_classes_by_brute_force(edge, documents, per_salt):
    for frame in (edge, documents):
        want = brute_classes([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()])
        got = [tuple(r) for r in exact_dedup.classes(frame, per_salt=per_salt).collect()]
        assert sorted(got, key=str) == want


def test_classes_hot_group_without_ids(spark, empty):
    rows = [(None if i % 3 == 0 else i, "hot") for i in range(300)] + [(None, "lost"), (None, "lost")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in exact_dedup.classes(frame, per_salt=10).collect()]
    assert sorted(got, key=str) == brute_classes(rows)
    assert exact_dedup.classes(empty).count() == 0
    smallest = exact_dedup.deduplicated(frame, keep="min").collect()
    assert {r["doc_id"] for r in smallest} == {1, None}


def test_classes_many_equal_rows_without_ids(spark):
    frame = spark.range(100_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'one hot text' AS text")
    got = exact_dedup.classes(frame)
    row = got.groupBy("doc_id", "keep_id", "group_size").agg({"*": "count"}).collect()
    assert [tuple(r) for r in row] == [(None, None, 100_000, 100_000)]
    assert got.where("kept").count() == 1


def test_classes_compare_neighbours(spark, documents, monkeypatch):
    """Texts are range-partitioned, sorted and windowed; no hash aggregate or hash exchange touches them."""
    monkeypatch.setattr(exact_dedup, "checkpointed", lambda frame: frame)
    plan = exact_dedup.classes(documents)._jdf.queryExecution().executedPlan().toString()
    touched = [line for line in plan.splitlines() if "text#" in line and ("Aggregate" in line or "hashpartitioning" in line)]
    assert "Window" in plan and "rangepartitioning(lead" in plan
    assert not [line for line in touched if "keys=[hash#" not in line and "hashpartitioning(hash#" not in line], touched


def brute_shards(rows, shards=16):
    """rows: (doc_id, text, source) -> [(doc_id, shard, slot)]"""
    by_source = defaultdict(list)
    for doc_id, text, source in rows:
        key = hashlib.md5(f"shard:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        by_source["n" if source is None else "s" + source].append((key, zlib.crc32((text or "").encode()), doc_id))
    order = []
    for stratum, members in by_source.items():
        members.sort(key=lambda m: m[:2])
        order += [((2 * r - 1) / (2.0 * len(members)), stratum.encode(), r, m[2]) for r, m in enumerate(members, 1)]
    order.sort(key=lambda x: x[:3])
    out, slots = [], Counter()
    for position, (*_, doc_id) in enumerate(order):
        shard = position * shards // len(order)
        out.append((doc_id, shard, slots[shard]))
        slots[shard] += 1
    return sorted(out, key=str)


@pytest.mark.parametrize("per_bucket", [1, 7, 5000])
def test_shards_by_brute_force(edge, documents, per_bucket):
    for frame in (edge, documents):
        got = sharding.shard_table(frame, per_bucket=per_bucket).collect()
        want = brute_shards([(r["doc_id"], r["text"], r["source"]) for r in frame.select("doc_id", "text", "source").collect()])
        assert sorted([(r["doc_id"], r["shard"], r["slot"]) for r in got], key=str) == want
        counts = Counter(r["shard"] for r in got)
        assert max(counts.values()) - min(counts.get(s, 0) for s in range(16)) <= 1
        text = {r["doc_id"]: (r["text"] or "").encode() for r in frame.select("doc_id", "text").collect()}
        assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in got)


def test_sharded_keeps_columns(edge, empty):
    out = sharding.sharded(edge)
    assert out.columns[: len(edge.columns)] == edge.columns and out.count() == 10
    assert out.columns[-2:] == ["__shard", "__slot"]
    assert sharding.sharded(empty).count() == 0 and sharding.shard_table(empty).count() == 0
