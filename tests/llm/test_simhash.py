import random

import numpy as np
import pytest
import xxhash

from varicube.llm import simhash


def mixed(h, table):
    """SplitMix64 in plain integers."""
    if not table:
        return h
    h = (h + table * 0x9E3779B97F4A7C15) % 2**64
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
    return h ^ h >> 31


def brute_fingerprint(text, k=3, table=0):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [mixed(xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42), table) for i in range(max(1, len(words) - k + 1))]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def brute_components(keyed, radius):
    """keyed: {key: code or codes}; the smallest key that each reaches through any of its codes."""
    keys = sorted(keyed)
    table = np.array([np.atleast_1d(keyed[k]) for k in keys], dtype=np.int64).view(np.uint64)
    label = list(range(len(keys)))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(keys)):
        for j in np.flatnonzero((np.bitwise_count(table[: i + 1] ^ table[i]) <= radius).any(axis=1)):
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    return {k: keys[find(i)] for i, k in enumerate(keys)}


def near_components(keyed, apart=0.16):
    """keyed: {key: codes}; near are code 0 within 2 bits, or all codes within the share of bits and one segment equal."""
    keys = sorted(keyed)
    table = np.array([keyed[k] for k in keys], dtype=np.int64).view(np.uint64)
    masks = np.array([(1 << 22) - 1, (1 << 22) - 1 << 22, (1 << 20) - 1 << 44], dtype=np.uint64)
    root = np.arange(len(keys))
    for i in range(len(keys)):
        x = table ^ table[i]
        bits = np.bitwise_count(x)
        shared = ((x[:, :, None] & masks) == 0).any(axis=2) & (bits <= 16)
        near = (bits[:, 0] <= 2) | ((bits.sum(axis=1) <= apart * 64 * table.shape[1]) & shared.any(axis=1))
        joined = np.isin(root, root[near])
        root[joined] = root[joined].min()
    return {k: keys[root[i]] for i, k in enumerate(keys)}


def planted(n, seed):
    rng = random.Random(seed)
    codes = []
    for _ in range(n):
        code = rng.getrandbits(64)
        for _ in range(rng.choice((1, 1, 1, 4, 30))):
            codes.append(code)
            for _ in range(rng.choice((1, 1, 2, 3))):
                code ^= 1 << rng.randrange(64)
    return [c - (1 << 64) if c >> 63 else c for c in dict.fromkeys(codes)]


@pytest.mark.parametrize("radius,segments,hot", [(2, 2, 16), (2, 2, 1), (3, 2, 1)])
def test_links_by_brute_force(spark, radius, segments, hot):
    codes = planted(60, radius)
    frame = spark.createDataFrame([(0, c) for c in codes], "table int, code long")
    from varicube.llm.components import components

    got = {r["node"]: r["root"] for r in components(simhash.links(frame, radius, segments, hot), "a", "b").collect()}
    want = brute_components({c: c for c in codes}, radius)
    assert {c: got.get(c, c) for c in codes} == want


@pytest.mark.parametrize("tables", [1, 3])
def test_classes_by_brute_force(documents, edge, tables):
    for frame in (documents, edge.where("doc_id is not null"))[tables > 1 :]:
        rows = frame.select("doc_id", "text").collect()
        codes = {r["doc_id"]: [brute_fingerprint(r["text"], table=t) for t in range(tables)] for r in rows}
        want = brute_components(codes, 2)
        got = simhash.classes(frame, tables=tables).collect()
        assert sorted((r["doc_id"], r["codes"], r["component"]) for r in got) == sorted((r["doc_id"], codes[r["doc_id"]], want[r["doc_id"]]) for r in rows)


def test_first_of_each(edge, empty):
    out = simhash.first_of_each(edge)
    assert out.columns == edge.columns
    ids = sorted((r["doc_id"] for r in out.collect()), key=str)
    assert ids == sorted([1, 4, 5, 6, None, 8], key=str)  # 1, 2 and 3 have no words; 6, 6 and 7 are one text
    assert simhash.first_of_each(empty).count() == 0 and simhash.classes(empty).count() == 0


def similarity(a, b, k=5):
    a, b = ({tuple(t.split()[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_by_similarity(spark, tmp_path):
    """Copies with some words changed: those of 0.8 and more on five-word shingles are found, those below 0.7 stay."""
    rng = random.Random(3)
    rows, wanted = [], set()
    for group in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 400))]
        rows.append((2 * group, " ".join(words)))
        copy = list(words)
        changes = max(1, len(words) * (group % 2 * 6 + 1) // 100)
        for i in rng.sample(range(len(copy)), changes):
            copy[i] = "other"
        rows.append((2 * group + 1, " ".join(copy)))
        found = similarity(rows[-1][1], rows[-2][1])
        assert found >= 0.8 or found < 0.75
        wanted |= {2 * group} if found >= 0.8 else {2 * group, 2 * group + 1}
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = {r["doc_id"] for r in simhash.first_of_each(spark.read.parquet(path)).collect()}
    assert got == wanted and 60 < len(wanted) < 120


def test_first_of_each_by_brute_force(documents):
    rows = documents.select("doc_id", "text").collect()
    roots = near_components({r["doc_id"]: [brute_fingerprint(r["text"], 5, t) for t in range(8)] for r in rows})
    got = {r["doc_id"] for r in simhash.first_of_each(documents, tables=8).collect()}
    assert got == {i for i, root in roots.items() if i == root}


def near_copies(n, tables, rng):
    """Codes of variants 11 % of the bits from a base, about 20 % from one another; the base comes last."""
    bits = tables * 64
    base = rng.getrandbits(bits)
    made = [base ^ sum(1 << b for b in rng.sample(range(bits), bits * 11 // 100)) for _ in range(n)] + [base]
    return [np.frombuffer(code.to_bytes(bits // 8, "little"), dtype="<i8").tolist() for code in made]


def test_members_behind_a_stand_in(spark):
    """Groups whose base is read after its variants: every link of the whole-distance brute force is found."""
    rng = random.Random(5)
    codes = [c for n in (1, 2, 3, 40, 300) for c in near_copies(n, 8, rng)]
    marked = spark.createDataFrame(list(enumerate(codes)), "row long, codes array<long>")
    got = {tuple(r["codes"]): r["root"] for r in simhash._near_groups(marked, 3, 0.16).collect()}
    assert {i: got[tuple(c)] for i, c in enumerate(codes)} == near_components(dict(enumerate(codes)))


def test_share_of_near_pairs_found(spark):
    """Of all pairs 15 % of the bits apart, which is within the limit, the segment tables miss some by chance."""
    rng = random.Random(7)
    codes = []
    for _ in range(200):
        base = rng.getrandbits(2048)
        other = base ^ sum(1 << b for b in rng.sample(range(2048), 2048 * 15 // 100))
        codes += [np.frombuffer(code.to_bytes(256, "little"), dtype="<i8").tolist() for code in (base, other)]
    table = np.array(codes, dtype=np.int64).view(np.uint64)
    near = [(i, j) for i in range(400) for j in np.flatnonzero(np.bitwise_count(table[i + 1 :] ^ table[i]).sum(axis=1) <= 0.16 * 2048) + i + 1]
    assert near == [(i, i + 1) for i in range(0, 400, 2)]
    marked = spark.createDataFrame(list(enumerate(codes)), "row long, codes array<long>")
    roots = {tuple(r["codes"]): r["root"] for r in simhash._near_groups(marked, 3, 0.16).collect()}
    found = sum(roots[tuple(codes[i])] == roots[tuple(codes[j])] for i, j in near)
    assert 180 <= found < 200 and len(set(roots.values())) == 400 - found


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(str(i * i % 997) for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "AT_ONCE", 100)
    assert simhash.fingerprint(text.encode()) == whole == [brute_fingerprint(text)]
    assert simhash.fingerprint(text.encode(), 5, 2) == [brute_fingerprint(text, 5, t) for t in range(2)]


def test_chance_meetings_grow_about_as_the_input(spark):
    """Unrelated codes, five times as many: entries of shared slots grew 25 times with slots of fixed width."""
    from pyspark.sql import functions as F

    def met(n):
        codes = F.array(*[F.xxhash64("id", F.lit(t)) for t in range(4)])
        tuples = spark.range(n).select(F.col("id").alias("node"), codes.alias("codes"))
        return simhash._shared(tuples, 4, *simhash._windows(n, 4, 3)).count()

    few, many = met(40_000), met(200_000)
    assert 2_000 < few and many < 12 * few


@pytest.mark.parametrize("wider", [2, 9])
def test_wider_windows_find_as_many(wider):
    """Of pairs 15 % of the bits apart, windows of any width leave out fewer than segments do; values fit a slot."""
    width, windows = simhash._windows(simhash.FEW << wider, 32, 3)
    assert width == 22 + wider and all(sum(bits for _, _, bits in parts) == width for parts in windows)
    assert all(0 <= start and start + bits <= 64 for parts in windows for _, start, bits in parts)
    assert (32 * len(windows) << width) < 2**63
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(1000):
        differing = np.zeros(2048, dtype=bool)
        differing[rng.choice(2048, 2048 * 15 // 100, replace=False)] = True
        differing = differing.reshape(32, 64)
        fine = differing.sum(axis=1) <= simhash.NEAR_CODE
        same = [~np.any([np.roll(differing, -d, axis=0)[:, s : s + n].any(axis=1) for d, s, n in parts], axis=0) for parts in windows]
        found += bool((np.any(same, axis=0) & fine).any())
    assert 940 < found < 1000


def test_wider_windows_link_near_pairs(spark, monkeypatch):
    """The same slots by the query's own steps: few texts count as many, so that slots are 29 bits wide."""
    rng = random.Random(9)
    codes = []
    for _ in range(200):
        base = rng.getrandbits(2048)
        other = base ^ sum(1 << b for b in rng.sample(range(2048), 2048 * 15 // 100))
        codes += [np.frombuffer(code.to_bytes(256, "little"), dtype="<i8").tolist() for code in (base, other)]
    monkeypatch.setattr(simhash, "FEW", 4)
    marked = spark.createDataFrame(list(enumerate(codes)), "row long, codes array<long>")
    roots = {tuple(r["codes"]): r["root"] for r in simhash._near_groups(marked, 3, 0.16).collect()}
    found = sum(roots[tuple(codes[i])] == roots[tuple(codes[i + 1])] for i in range(0, 400, 2))
    assert 180 <= found and len(set(roots.values())) == 400 - found


@pytest.mark.parametrize("at_once", [1 << 18, 20])
def test_components_in_one_part_and_several(spark, monkeypatch, at_once):
    from varicube.llm import components as module

    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(50, 400), rng.randrange(50, 400)) for _ in range(150)] + [(7, 7), (3, 3)]
    label = {n: n for pair in links[:-2] for n in pair if pair[0] != pair[1]}
    for _ in range(len(label)):
        for a, b in links[:-2]:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    monkeypatch.setattr(module, "AT_ONCE", at_once)
    frame = spark.createDataFrame(links, "a long, b long").repartition(12)
    assert {r["node"]: r["root"] for r in module.components(frame, "a", "b").collect()} == label
    assert module.components(frame.where("a = b"), "a", "b").count() == 0


def _family(rng, members, lone):
    """Codes of a base, of variants near it and of others, not near any; all of them share slots with the variants."""
    def flipped(base, share):
        return base ^ sum(1 << b for b in rng.sample(range(2048), int(2048 * share)))

    base = rng.getrandbits(2048)
    whole = [base, *(flipped(base, 0.07) for _ in range(members)), *(flipped(base, 0.175) for _ in range(lone))]
    return [np.frombuffer(code.to_bytes(256, "little"), dtype="<i8").tolist() for code in whole]


def test_no_pairs_written_of_a_large_group_and_its_neighbours(spark, monkeypatch):
    """Entries are not joined with degrees, and pairs to judge do not grow as the square (120: 7,525; 240: 28,323 before)."""
    n, plans, judged = 120, [], []
    codes = _family(random.Random(5), n, n)
    keep, near = simhash.stored, simhash._near

    def noted(frame):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return keep(frame)

    def counted(tuples, pairs, apart):
        judged.append(pairs.count())
        return near(tuples, pairs, apart)

    monkeypatch.setattr(simhash, "stored", noted)
    monkeypatch.setattr(simhash, "_near", counted)
    marked = spark.createDataFrame(list(enumerate(codes)), "row long, codes array<long>")
    got = {tuple(r["codes"]): r["root"] for r in simhash._near_groups(marked, 3, 0.16).collect()}
    assert {i: got[tuple(c)] for i, c in enumerate(codes)} == near_components(dict(enumerate(codes)))
    assert plans and not [p for p in plans if "LeftOuter" in p and "slot" in p]
    assert sum(judged) < 10 * n


def test_a_member_that_is_no_head_links_a_lone_node(spark):
    """The lone node is near one variant only, which is not the entry that stands for its group in any slot."""
    rng = random.Random(8)
    codes = _family(rng, 60, 0)
    for variant in (7, 31):
        whole = int.from_bytes(np.array(codes[variant], dtype="<i8").tobytes(), "little")
        other = whole ^ sum(1 << b for b in rng.sample(range(2048), int(2048 * 0.125)))
        codes.append(np.frombuffer(other.to_bytes(256, "little"), dtype="<i8").tolist())
    marked = spark.createDataFrame(list(enumerate(codes)), "row long, codes array<long>")
    got = {tuple(r["codes"]): r["root"] for r in simhash._near_groups(marked, 3, 0.16).collect()}
    assert near_components(dict(enumerate(codes))) == {i: 0 for i in range(len(codes))} == {i: got[tuple(c)] for i, c in enumerate(codes)}
