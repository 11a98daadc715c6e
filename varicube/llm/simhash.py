"""SimHash near-duplicates with multi-index hashing.

A text's fingerprint has a bit for every bit that is set in over half of its shingle hashes. Documents with one
fingerprint form a class, and only distinct fingerprints are searched.

Search: the 64 bits are cut into segments and every fingerprint is filed under each segment's value. Two fingerprints
within ``radius`` bits differ in some segment ``s`` by at most ``reach[s]`` bits, where the reaches add up to
``radius - segments + 1``; so a fingerprint looks up the Hamming ball of that size around each of its segment values
and the candidates found are verified on all 64 bits.

A segment value that over ``hot`` fingerprints share (a large group of near copies) would yield all its pairs. Its
fingerprints leave the tables and meet elsewhere, exactly: two of them within ``radius`` bits have a code in common
that is at most half the radius from one and the rest of it from the other, so each files itself under every such
code, and a code links its fingerprints to one of them. Only true links arise, a bounded number per fingerprint.

Few bits tell only the nearest copies from the rest. ``first_of_each`` therefore takes a long fingerprint of ``tables``
codes, whose complete distance estimates the similarity of the shingles (0.8 is about 15 % of the bits), in four steps.
With many fingerprints, wider windows of two codes take the place of the segments (see ``_windows``).
Slots with a single fingerprint are left out before them, slots of a single group before each.
First the classes of code 0 are searched as above. Then every fingerprint is compared with the centres of its slots (its
segment values in some codes), in rounds: a centre is an entry by chance at first, then the one with most links, which is
the base of a group of near copies; both steps gather large groups in linear work. Third, every code is cut into
segments, balls of radius zero: pairs of different groups that agree in any segment are candidates, and those whose
complete distance is at most the share ``apart`` of all bits are linked; a group with several members has one entry per
segment value here. Last, all members of such groups meet the other groups' members in each slot, so a pair that the
entry for a group does not show is found too; nothing is capped. Pairs of one group are never formed then, those of
groups that stay apart are, but in both steps with lone nodes they are judged where they meet and only near ones written. Pairs within (number of segments - 1) bits
are found for certain, farther ones with a probability that the README states. Rows are numbered by scan, so ``docs`` is
stored data.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; a text shorter than a shingle
is one shingle; null ids take part but never become a component's id unless it has no other; repeated rows share a
component, and ``first_of_each`` keeps one of them; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varicube.llm.common import checkpointed, fresh, slim_batches, utf8
from varicube.llm.components import components
from varicube.session import stored

SHINGLE = 3
RADIUS = 2
SEGMENTS = 2
HOT = 16
HASH_SEED = 42
BITS = 64
AT_ONCE = 1 << 16

#: The long fingerprint: words of a shingle, codes, segments of a code, share of differing bits up to which texts are near,
#: and the bits of one code that a pair worth the complete comparison differs in at most (near pairs: 10, unrelated ones: 21).
NEAR_SHINGLE = 5
NEAR_TABLES = 32
NEAR_SEGMENTS = 3
NEAR_APART = 0.16
NEAR_CODE = 16
#: Distinct fingerprints up to which slots are the segments of a code; beyond, how many more windows than segments a code
#: has, and how many times more for each bit that they are wider. Pairs 16 % apart are found as often with them.
FEW = 1 << 15
MORE = 1.2
MORE_A_BIT = 1.22
#: Codes whose slots gather large groups before pairs are formed, by round.
STAR_CODES = (1, 2, 5)

#: Fixed values of the SplitMix64 generator, which turns one hash into one per code.
STEP = 0x9E3779B97F4A7C15
FIRST_FACTOR = 0xBF58476D1CE4E5B9
SECOND_FACTOR = 0x94D049BB133111EB
#: Rows whose set bits an unsigned byte can count.
BYTE_ROWS = 255


def spread_hashes(hashes: np.ndarray, tables: int) -> np.ndarray:
    """One column of hashes per code: the hashes themselves, then their mixtures with multiples of a step."""
    steps = np.arange(tables, dtype=np.uint64) * np.uint64(STEP)
    mixed = hashes[:, None] + steps
    mixed ^= mixed >> np.uint64(30)
    mixed *= np.uint64(FIRST_FACTOR)
    mixed ^= mixed >> np.uint64(27)
    mixed *= np.uint64(SECOND_FACTOR)
    mixed ^= mixed >> np.uint64(31)
    mixed[:, 0] = hashes
    return mixed


def fingerprint(text: bytes, shingle: int = SHINGLE, tables: int = 1) -> list[int]:
    """Signed 64-bit codes of UTF-8 text; shingles count as often as they occur."""
    words = text.lower().split()
    if not words:
        return [0] * tables
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(tables * BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, AT_ONCE):
        stop = min(n, start + AT_ONCE)
        columns = [words[start + k : stop + k] for k in range(min(shingle, len(words)))]
        hashes = np.array([digest(b" ".join(s), HASH_SEED) for s in zip(*columns)], dtype="<u8")
        for at in range(0, len(hashes), BYTE_ROWS):
            block = spread_hashes(hashes[at : at + BYTE_ROWS], tables)
            bits = np.unpackbits(block.view(np.uint8), axis=1, bitorder="little")
            counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > n, bitorder="little").view("<i8").tolist()


def fingerprints(docs: DataFrame, *keys: str, shingle: int = SHINGLE, tables: int = 1) -> DataFrame:
    """The key columns and ``codes``, the array of fingerprints, of each document."""
    rows = docs.select(*keys, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim_batches(batches):
            codes = [fingerprint(text, shingle, tables) for text in utf8(batch.column("text"))]
            yield pa.record_batch([*(batch.column(k) for k in keys), pa.array(codes, pa.list_(pa.int64()))], [*keys, "codes"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{kinds}, codes array<long>")


def ball(bits: int, reach: int) -> list[int]:
    """All masks with at most ``reach`` of the lowest ``bits`` bits set, as signed 64-bit numbers."""
    masks = [sum(1 << i for i in chosen) for r in range(reach + 1) for chosen in combinations(range(bits), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _around(value: Column, masks: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda mask: value.bitwiseXOR(mask))


def _slots(segment: int, values: Column) -> Column:
    return F.transform(values, lambda value: F.struct(F.lit(segment).alias("segment"), value.alias("value")))


def links(codes: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, hot: int = HOT) -> DataFrame:
    """(table, a, b) such that the components are those of all pairs of one table within ``radius`` bits.

    ``codes`` holds distinct (table, code).
    """
    width = -(-BITS // segments)
    spare = max(0, radius - segments + 1)
    reach = [spare // segments + (s < spare % segments) for s in range(segments)]
    filed, sought = [], []
    for s in range(segments):
        bits = min(width, BITS - s * width)
        value = F.shiftrightunsigned("code", s * width).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
        filed.append(F.struct(F.lit(s).alias("segment"), value.alias("value")))
        sought.append(_slots(s, _around(value, ball(bits, reach[s]))))
    slot = ["table", "segment", "value"]
    filings = codes.select("table", "code", F.explode(F.array(*filed)).alias("at")).select("table", "code", "at.*")
    # Counted by an aggregate, which combines a crowded slot's rows before the shuffle; there are few such slots.
    crowds = stored(filings.groupBy(*slot).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(*slot))
    probes = codes.select("table", F.col("code").alias("a"), F.explode(F.concat(*sought)).alias("at")).select("table", "a", "at.*")
    cold = filings.join(crowds, slot, "left_anti").select(F.col("code").alias("b"), *slot)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    # A code within the reach of another has it within its own, so one direction is enough.
    found = probes.join(cold, slot).where((F.col("a") < F.col("b")) & near).select("table", "a", "b")
    crowded = filings.join(crowds, slot, "left_semi")
    outside = probes.join(crowds, slot, "left_semi").select("table", F.col("a").alias("code"))
    met = checkpointed(crowded.select("table", "code").union(outside).distinct())
    return found.distinct().union(_through_codes(met, radius))


def _through_codes(codes: DataFrame, radius: int) -> DataFrame:
    """Links by codes between two fingerprints: one at most radius // 2 away (close), the other the rest."""
    close, far = radius // 2, radius - radius // 2
    between = codes.select("table", "code", F.explode(_around(F.col("code"), ball(BITS, far))).alias("via"))
    is_close = F.bit_count(F.col("code").bitwiseXOR(F.col("via"))) <= close
    first = F.min(F.when(is_close, F.col("code"))).over(Window.partitionBy("table", "via"))
    return between.select("table", "code", first.alias("first")).where("first <> code").select(
        "table", F.col("code").alias("a"), F.col("first").alias("b")
    ).distinct()


def _groups(marked: DataFrame, **search) -> DataFrame:
    """codes and ``root`` for each distinct ``codes`` of ``marked`` (row, codes); a root is the number of a row."""
    tuples = checkpointed(marked.groupBy("codes").agg(F.min("row").alias("node")))
    spread = tuples.select("node", F.posexplode("codes").alias("table", "code"))
    owners = checkpointed(spread.groupBy("table", "code").agg(F.min("node").alias("owner")))
    same = spread.join(owners, ["table", "code"]).where("node <> owner").select("node", "owner")
    first, second = (owners.select("table", F.col("code").alias(c), F.col("owner").alias(f"{c}_owner")) for c in ("a", "b"))
    close = links(owners.select("table", "code"), **search).join(first, ["table", "a"]).join(second, ["table", "b"])
    roots = components(same.union(close.select("a_owner", "b_owner")), "node", "owner").withColumnRenamed("node", "member")
    return tuples.join(roots, F.col("node") == F.col("member"), "left").select("codes", F.coalesce("root", "node").alias("root"))


def _marked(docs: DataFrame, shingle: int, tables: int) -> DataFrame:
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return checkpointed(fingerprints(numbered, "doc_id", "row", shingle=shingle, tables=tables))


def classes(docs: DataFrame, shingle: int = SHINGLE, tables: int = 1, **search) -> DataFrame:
    """One row per document: doc_id, ``codes`` and ``component``, the smallest id that is reachable.

    With more ``tables``, documents that are near in any of their codes are linked.
    """
    marked = _marked(docs, shingle, tables)
    groups = checkpointed(_groups(marked, **search))
    smallest = marked.groupBy("codes").agg(F.min("doc_id").alias("smallest")).join(groups, "codes")
    named = smallest.groupBy("root").agg(F.min("smallest").alias("component"))
    table = checkpointed(groups.join(named, "root").select("codes", "component"))
    return marked.join(table, "codes").select("doc_id", "codes", "component")


def _windows(nodes: int, tables: int, segments: int) -> tuple[int, list[list[tuple[int, int, int]]]]:
    """Width of a slot's value and the windows of each code: parts (codes further on, lowest bit, bits) of their values.

    Up to ``FEW`` nodes: every code's segments. Each doubling beyond makes values a bit wider, and more windows make up for
    it, so a node meets about as many others by chance; a window is then some bits of one code with some of another.
    """
    wider = max(0, math.ceil(math.log2(max(nodes, 1) / FEW)))
    width = -(-BITS // segments) + wider
    if not wider:
        return width, [[(0, s * width, min(width, BITS - s * width))] for s in range(segments)]
    low, high = width // 2, width - width // 2
    n = math.ceil(MORE * segments * MORE_A_BIT**wider)
    starts = [i * (BITS - low) // (n - 1) for i in range(n)]
    return width, [
        [(0, start, low), (1 + i % max(1, tables - 1), (start + 17 * (i + 1)) % (BITS - high + 1), high)] for i, start in enumerate(starts)
    ]


def _entries(tuples: DataFrame, tables: int, width: int, windows: list[list[tuple[int, int, int]]]) -> DataFrame:
    """(slot, node, code) for every window of every code; a slot is the code's place, the window and its value."""
    at = []
    for number, parts in enumerate(windows):
        slot, place = F.shiftleft((F.col("table") * len(windows) + number).cast("bigint"), width), 0
        for further, start, bits in parts:
            code = F.get("codes", (F.col("table") + further) % tables) if further else F.col("code")
            value = F.shiftrightunsigned(code, start).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
            slot, place = slot.bitwiseOR(F.shiftleft(value, place)), place + bits
        at.append(slot)
    codes = tuples.select("node", "codes", F.posexplode("codes").alias("table", "code"))
    return codes.select(F.explode(F.array(*at)).alias("slot"), "node", "code")


def _shared(tuples: DataFrame, *places) -> DataFrame:
    """The entries of slots that several nodes share. Most slots hold one node and can link nothing, so only a count of
    them is shuffled; what is left serves every later step."""
    entries = _entries(tuples, *places)
    slots = stored(entries.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("slot"))
    return stored(entries.join(slots, "slot", "left_semi"))


def _crossing(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(slot, root, node, code) and further columns of ``roots``, of the slots in which several roots meet."""
    rooted = entries.join(roots, "node").select("slot", "node", "code", *(c for c in roots.columns if c != "node"))
    slots = rooted.groupBy("slot").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    slots = stored(slots.where("low < high").select("slot"))
    return stored(rooted.join(slots, "slot", "left_semi"))


def _side(entries: DataFrame, side: str, *more: str) -> DataFrame:
    return entries.select("slot", *(F.col(c).alias(f"{c}_{side}") for c in ("root", "node", "code", *more)))


def _near(tuples: DataFrame, pairs: DataFrame, apart: float) -> DataFrame:
    """The ``pairs`` (root_a, root_b, node_a, node_b) that are near on all bits."""
    for side in "ab":
        pairs = pairs.join(tuples.select(F.col("node").alias(f"node_{side}"), F.col("codes").alias(f"codes_{side}")), f"node_{side}")
    differing = F.zip_with("codes_a", "codes_b", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    near = F.aggregate(differing, F.lit(0), lambda total, bits: total + bits) <= apart * BITS * F.size("codes_a")
    return stored(pairs.where(near).select("root_a", "root_b", "node_a", "node_b"))


def _merged(roots: DataFrame, near: DataFrame) -> DataFrame:
    """``roots`` (node, root) with those joined that ``near`` (root_a, root_b) links."""
    joined = components(near, "root_a", "root_b").select(F.col("node").alias("member"), F.col("root").alias("merged"))
    others = [c for c in roots.columns if c not in ("node", "root")]
    found = roots.join(joined, F.col("root") == F.col("member"), "left")
    return stored(found.select("node", F.coalesce("merged", "root").alias("root"), *others))


def _counted(roots: DataFrame, near: DataFrame) -> DataFrame:
    """``roots`` (node, root, degree) with the links ``near`` added to their nodes' degrees."""
    ends = near.select("node_a").union(near.select("node_b")).groupBy(F.col("node_a").alias("linked")).agg(F.count(F.lit(1)).alias("more"))
    degree = F.col("degree") + F.coalesce("more", F.lit(0).cast("bigint"))
    return roots.join(ends, F.col("node") == F.col("linked"), "left").select("node", "root", degree.alias("degree"))


def _close_pairs(a: DataFrame, b: DataFrame, *needed: Column) -> DataFrame:
    """Distinct pairs of the entries ``a`` and ``b`` (sides a and b) that share a slot with codes that are not too far apart
    and fulfil what else is ``needed``."""
    met = a.join(b, "slot").where(F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))) <= NEAR_CODE)
    for condition in needed:
        met = met.where(condition)
    return met.select("root_a", "root_b", "node_a", "node_b").distinct()


def _gathered(tuples: DataFrame, shared: DataFrame, roots: DataFrame, width: int, each: int, apart: float) -> DataFrame:
    """``roots`` after rounds in which every entry meets the centre of its slot, an entry by chance, then the one with most
    links; with ``degree``, the links found. A round takes further codes, and only slots whose roots still differ.

    A node's degree travels with its root, so it is looked up once a node and not for each of its entries.
    """
    roots, done = roots.withColumn("degree", F.lit(0).cast("bigint")), 0
    for codes in STAR_CODES:
        low, high = (n * each << width for n in (done, done + codes))
        entries = _crossing(shared.where((F.col("slot") >= low) & (F.col("slot") < high)), roots)
        rank = (F.col("degree") if done else F.xxhash64("slot", "node")).alias("rank")
        done += codes
        best = F.max(F.struct(rank, "node", "root", "code")).alias("centre")
        centres = stored(entries.groupBy("slot").agg(best).select("slot", "centre.*"))
        near = _near(tuples, _close_pairs(_side(entries, "a"), _side(centres, "b"), F.col("root_a") != F.col("root_b")), apart)
        roots = _merged(_counted(roots, near), near)
    return roots


def _judged(a: DataFrame, b: DataFrame, different: Column, tables: int, apart: float) -> DataFrame:
    """The near ones of ``_close_pairs``, for entries with ``codes``.

    In a large group and around it many pairs meet that are not near, with the square of its size. They are judged on all
    bits where they meet, so entries are written with the codes of their nodes but pairs never are.
    """
    differing = sum(F.bit_count(F.get("codes_a", F.lit(n)).bitwiseXOR(F.get("codes_b", F.lit(n)))) for n in range(tables))
    return _close_pairs(a, b, different, differing <= apart * BITS * tables)


def _heads_near(tuples: DataFrame, entries: DataFrame, tables: int, apart: float) -> DataFrame:
    """Near pairs of different roots; a root with several nodes in a slot has one entry there, that with most links."""
    heads = entries.groupBy("slot", "root").agg(F.max(F.struct("degree", "node", "code")).alias("entry"))
    heads = stored(heads.select("slot", "root", "entry.node", "entry.code").join(tuples, "node"))
    return _judged(_side(heads, "a", "codes"), _side(heads, "b", "codes"), F.col("root_a") < F.col("root_b"), tables, apart)


def _members_near(tuples: DataFrame, entries: DataFrame, roots: DataFrame, tables: int, apart: float) -> DataFrame:
    """The near pairs of every member of a root with several nodes: with lone nodes, and with the members of other such roots."""
    several = roots.groupBy("root").agg((F.count(F.lit(1)) > 1).alias("several"))
    # Stored in the order of nodes, whose codes then take the room of one copy. Lone nodes have met in the step before.
    entries = stored(entries.join(roots.join(several, "root").join(tuples, "node"), "node"))
    members, lone = entries.where("several"), entries.where("not several")
    with_lone = _judged(_side(members, "a", "codes"), _side(lone, "b", "codes"), F.lit(True), tables, apart)
    # The roots of a slot are paired before their members are, so no two members of one root are ever compared.
    heads = members.select("slot", "root").distinct()
    first, second = (heads.select("slot", F.col("root").alias(f"root_{side}")) for side in "ab")
    met = first.join(second, "slot").where("root_a < root_b").join(_side(members, "a"), ["slot", "root_a"])
    across = met.join(_side(members, "b"), ["slot", "root_b"])
    close = F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))) <= NEAR_CODE
    return with_lone.union(_near(tuples, across.where(close).select("root_a", "root_b", "node_a", "node_b").distinct(), apart))


def _near_groups(marked: DataFrame, segments: int, apart: float) -> DataFrame:
    """Like ``_groups``, for long fingerprints: those of one code-0 group or at most the share ``apart`` of bits away."""
    tuples = stored(marked.groupBy("codes").agg(F.min("row").alias("node")))
    tight = _groups(tuples.select(F.slice("codes", 1, 1).alias("codes"), F.col("node").alias("row")))
    tight = tight.select(F.element_at("codes", 1).alias("code"), "root")
    first = tuples.select("node", F.element_at("codes", 1).alias("code"))
    roots = stored(first.join(tight, "code").select("node", "root"))

    # Large groups first, so that few pairs are left between groups.
    tables = tuples.select(F.max(F.size("codes"))).first()[0] or 1
    width, windows = _windows(tuples.count(), tables, segments)
    shared = _shared(tuples, tables, width, windows)
    roots = _gathered(tuples, shared, roots, width, len(windows), apart)
    # Roots only grow together, so the slots in which they meet become fewer.
    entries = _crossing(shared, roots)
    roots = _merged(roots, _heads_near(tuples, entries, tables, apart)).drop("degree")
    roots = _merged(roots, _members_near(tuples, entries.drop("root", "degree"), roots, tables, apart))
    return tuples.join(roots, "node").select("codes", "root")


def first_of_each(
    docs: DataFrame, shingle: int = NEAR_SHINGLE, tables: int = NEAR_TABLES, segments: int = NEAR_SEGMENTS, apart: float = NEAR_APART
) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one with the smallest id. ``docs`` is stored data."""
    row, = fresh(docs, "row")
    marked = _marked(docs, shingle, tables)
    groups = _near_groups(marked, segments, apart)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    firsts = marked.groupBy("codes").agg(F.min(place).alias("first")).join(groups, "codes")
    kept = firsts.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(checkpointed(kept), row, "left_semi").drop(row)
