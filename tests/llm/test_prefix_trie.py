import hashlib
import zlib
from collections import defaultdict

import pytest

from oracle_check import connect, difference
from varicube.llm import prefix_trie, queries

SHAPE = "conv_id long, turn long, role string, text string"


def brute(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, f"{len(r[3] or '')}:", r[2] or "", r[3] or "")
    own = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=order):
        own[row[0]].append((row[2] or "", row[3] or ""))
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        own_saved = (len(convs) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += own_saved
    return sorted(
        (min(c), len(p), min(members[p[:-1]]) if p else -1, len(c), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, c in members.items()
    )


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def result(frame, **options):
    found = prefix_trie.trie(frame, **options).na.fill(-1, ["parent_conv_id"])
    return sorted(tuple(r) for r in found.select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def odd():
    rows = []
    for c in range(0, 130):  # shared openings, equal conversations, prefixes of others
        for t in range(c % 5 + (c % 3 == 0)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} {c % 2 if t > 2 else ''}é\U0001f600"))
    for c in (250, 251, 300, 400, 499):
        rows += [(c, t, "user", f"long {t} {c if t > 20 else ''}") for t in range(40)]
    rows += [(301, t, None, None) for t in range(9)] + [(302, t, "", "") for t in range(9)]  # null and empty are equal
    rows += [(700, None, "user", "first"), (700, 0, "user", "second"), (700, 0, "user", "second"), (700, None, "user", "first"), (700, 0, "tool", "zz")]
    rows += [(-5, t, "user", f"minus {t}") for t in range(4)] + [(-100, t, "user", f"base {t}") for t in range(3)]
    rows += [(None, 0, "user", "nobody"), (None, None, None, None)]
    rows += [(800, 0, "a", "bc"), (801, 0, "ab", "c")]  # role and text do not run together
    return rows


@pytest.mark.parametrize("width, parts", [(8, 3), (3, 1), (1, 5)])
def test_brute_force(spark, odd, width, parts):
    frame = spark.createDataFrame(odd, SHAPE).selectExpr("*", "1 AS block", "2 AS k1", "'x' AS t1", "3 AS position").repartition(parts)
    assert result(frame, width=width) == brute(odd)


def test_sql(spark, odd, tmp_path):
    rows = [r for r in odd if r[0] != 700]  # SQL leaves the order of equal turn numbers open
    spark.createDataFrame(rows, SHAPE).write.parquet(str(tmp_path / "conversations.parquet"))
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert difference(queries.op13_prefix_trie(spark, str(tmp_path)), con, queries.ORACLE["op13_prefix_trie"]) is None


def test_tables_by_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert result(table) == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_hot_conversation_and_hot_node(spark):
    rows = [(9000, t, "user", f"t{t % 7}") for t in range(3000)] + [(1000 + i, 0, "user", "same") for i in range(2000)]
    frame = spark.createDataFrame(rows, SHAPE).repartition(6)
    found = result(frame)
    expected = brute([r for r in rows if r[0] != 9000])
    assert [r for r in found if r[0] < 9000 and r[1] > 0] == [r for r in expected if r[1] > 0]
    chain = sorted(r for r in found if r[0] == 9000)
    assert [r[1] for r in chain] == list(range(1, 3001)) and all(r[5] == 1 for r in chain)


def test_ends_in_small_pieces(spark):
    convs = spark.createDataFrame([(1, 2, 3, c) for c in range(-3, 25)] + [(1, 2, 4, 7)], "depth long, n1 long, n2 long, conv_id long")
    found = {r["n2"]: r["ends_sha256"] for r in prefix_trie.ends(convs.repartition(4), piece=2).collect()}
    assert found == {3: hashlib.sha256(",".join(map(str, range(-3, 25))).encode()).hexdigest(), 4: hashlib.sha256(b"7").hexdigest()}


def test_empty(spark):
    assert result(spark.createDataFrame([], SHAPE)) == []
    assert result(spark.createDataFrame([(None, 1, "user", "x")], SHAPE)) == []
