"""Trie of conversation prefixes by ROLLUP over positional turn-id columns.

A turn's id is the code points of its text and a digest of (role, text). A conversation's turns lie in rows of ``WIDTH``
positional columns; the row's key is the node that the earlier rows lead to. ``GROUP BY ROLLUP ((key), t1, ..., t8)`` then
aggregates every prefix of every row at once, and grouping_id tells the levels apart. A node is named by the XOR of hashes
of (position, turn id) along its path, 128 bits, so a row's key and a node's parent are known without a join by prefix,
and all blocks of all conversations go through one ROLLUP instead of one after the other.

Sums over subtrees need no walk. The members of a node contain those of all nodes below, and the nodes that have one
conversation as smallest member are the last part of its path. So each such conversation carries the length of that part
(``tail``) and whether it ends in a childless node (``leaf``), a second ROLLUP adds them up, and the node's own share is
put right from its representative.

Hot groups: positions and keys are running values over range partitions of (conversation, turn), so one conversation may
hold any share of the rows; rollups combine in the map tasks; the SHA-256 of a node's ends reads joined pieces in order
and holds one piece.

Defined cases: rows without conv_id belong to no conversation and are left out; equal turn numbers of a conversation go by
code points and digest of role and text; repeated rows are turns of their own; a negative id's shared conversation is
c - c % 100 with the remainder's sign of c; an empty table has no node; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varicube.llm.common import checkpointed

WIDTH = 8
SHARED = 100
LONGEST_PREFIX = 6
PIECE = 65_536


def _hashes(position: Column, turn: Column) -> list[Column]:
    return [F.xxhash64(F.lit(salt), position.cast("bigint"), turn) for salt in ("a", "b")]


def _length(turn: Column) -> Column:
    return F.substring_index(turn, ":", 1).cast("bigint")


def _running(rows: DataFrame, order: list[str], values: dict[str, tuple]) -> DataFrame:
    """Add ``before_x`` (earlier rows of the conversation) and ``all_x`` for each x: (aggregate, column, neutral value, inverse).

    ``inverse`` takes a running value and the row's own and returns the value before the row.
    """
    ranged = checkpointed(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("conv_id", "part").agg(*[agg(c).alias(f"t_{x}") for x, (agg, c, _, _) in values.items()])
    parts = Window.partitionBy("conv_id")  # a row per partition that holds some of the conversation
    earlier = parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "conv_id", "part",
        *[F.coalesce(agg(f"t_{x}").over(earlier), F.lit(zero)).alias(f"o_{x}") for x, (agg, _, zero, _) in values.items()],
        *[agg(f"t_{x}").over(parts).alias(f"all_{x}") for x, (agg, _, _, _) in values.items()],
    )
    here = Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"l_{x}": agg(c).over(here) for x, (agg, c, _, _) in values.items()})
    joined = local.join(offsets, ["conv_id", "part"])
    before = {}
    for x, (agg, c, _, inverse) in values.items():
        combine = (lambda a, b: a.bitwiseXOR(b)) if agg is F.bit_xor else (lambda a, b: a + b)
        before[f"before_{x}"] = combine(F.col(f"o_{x}"), inverse(F.col(f"l_{x}"), c))
    return joined.withColumns(before).drop("part", *[f"{k}_{x}" for x in values for k in ("o", "l")])


def _minus(running: Column, own: Column) -> Column:
    return running - own


def _xor(running: Column, own: Column) -> Column:
    return running.bitwiseXOR(own)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn_id, position (from 1) and all_n, the conversation's turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.concat(F.length(text), F.lit(":"), digest).alias("turn_id"),
        F.monotonically_increasing_id().alias("row"),  # splits a range of equal rows
    )
    one = F.lit(1).cast("bigint")
    placed = _running(rows, ["turn", "turn_id", "row"], {"n": (F.sum, one, 0, _minus)})
    return placed.select("conv_id", "turn_id", (F.col("before_n") + 1).alias("position"), "all_n")


def rebuilt(numbered: DataFrame) -> DataFrame:
    """conv_id, position, turn_id after the shared prefix is put in; position 0 with a null turn for every conversation."""
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % LONGEST_PREFIX
    sizes = numbered.where("position = 1").select("conv_id", "all_n")
    convs = sizes.select("conv_id", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base"))
    known = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("all_n").alias("base_n")), "base", "left").select(
        "conv_id", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")
    )
    openings = numbered.where((F.col("position") < LONGEST_PREFIX) & (F.col("conv_id") % SHARED == 0))
    lent = known.join(openings.select(F.col("conv_id").alias("base"), "position", "turn_id"), "base").where("position <= h")
    own = numbered.select("conv_id", "position", "turn_id").join(known, "conv_id").where("position > h")
    marks = known.select("conv_id", F.lit(0).cast("bigint").alias("position"), F.lit(None).cast("string").alias("turn_id"))
    return lent.select("conv_id", "position", "turn_id").unionByName(
        own.select("conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("position"), "turn_id")
    ).unionByName(marks)


def blocks(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row per ``width`` turns: conv_id, block, t1.., the key (k1, k2) and code points before it, and the conversation's totals."""
    block, place = F.expr(f"greatest(position - 1, 0) div {width}"), F.col("position") - F.col("block") * width
    own = [F.coalesce(h, F.lit(0)) for h in (F.when(F.col("turn_id").isNotNull(), h) for h in _hashes(F.col("position"), F.col("turn_id")))]
    wide = rows.withColumn("block", block).groupBy("conv_id", "block").agg(
        *[F.max(F.when(place == i, F.col("turn_id"))).alias(f"t{i}") for i in range(1, width + 1)],
        F.count("turn_id").alias("n"), F.coalesce(F.sum(_length(F.col("turn_id"))), F.lit(0)).alias("chars"),
        *[F.bit_xor(h).alias(f"x{i}") for i, h in enumerate(own, 1)],
    )
    keyed = _running(wide, ["block"], {
        "n": (F.sum, F.col("n"), 0, _minus), "chars": (F.sum, F.col("chars"), 0, _minus),
        "x1": (F.bit_xor, F.col("x1"), 0, _xor), "x2": (F.bit_xor, F.col("x2"), 0, _xor),
    })
    return checkpointed(keyed.select(
        "conv_id", "block", *[f"t{i}" for i in range(1, width + 1)], F.col("before_x1").alias("k1"), F.col("before_x2").alias("k2"),
        F.col("before_chars").alias("chars_before"), "all_n", "all_chars", "all_x1", "all_x2",
    ))


def _prefixes(rows: DataFrame, sums: str, width: int) -> DataFrame:
    """One row per node with the aggregates ``sums``: depth, its name (n1, n2), its parent's (p1, p2), chars (of its last turn), above (of its ancestors)."""
    columns = [f"t{i}" for i in range(1, width + 1)]
    rolled = rows.sparkSession.sql(
        f"SELECT block, k1, k2, chars_before, {', '.join(columns)}, grouping_id() AS grouped, {sums} FROM {{rows}} "
        f"GROUP BY ROLLUP ((block, k1, k2, chars_before), {', '.join(columns)})",
        rows=rows,
    )
    levels = {(1 << (width - k)) - 1: k for k in range(width + 1)}
    level = F.element_at(F.create_map(*[F.lit(x) for pair in levels.items() for x in pair]), F.col("grouped").cast("int"))
    last = F.array(*columns)[F.col("level") - 1]
    kept = rolled.where(f"grouped < {1 << width}").withColumn("level", level)  # without the grand total
    kept = kept.withColumn("last", F.when(F.col("level") > 0, last)).where("last is not null or (level = 0 and block = 0)")

    def name(half: int, below: Column) -> Column:
        result = F.col(f"k{half + 1}")
        for i, t in enumerate(columns, 1):
            own = _hashes(F.col("block") * width + i, F.col(t))[half]
            result = result.bitwiseXOR(F.when(below >= i, own).otherwise(F.lit(0)))
        return result

    above = F.col("chars_before")
    for i, t in enumerate(columns, 1):
        above = above + F.when(F.col("level") > i, _length(F.col(t))).otherwise(F.lit(0))
    names = [n.strip().split(" ")[-1] for n in sums.split(",")]
    level = F.col("level")
    return kept.select(
        (F.col("block") * width + level).alias("depth"), name(0, level).alias("n1"), name(1, level).alias("n2"),
        name(0, level - 1).alias("p1"), name(1, level - 1).alias("p2"),
        F.coalesce(_length(F.col("last")), F.lit(0)).alias("chars"), above.alias("above"), *names,
    )


def ends(convs: DataFrame, piece: int = PIECE) -> DataFrame:
    """(depth, n1, n2, ends_sha256) of the nodes where conversations end.

    Pieces of joined ids are made where the sorted ids lie; then each node's pieces are hashed in order, one at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids = None, None, []
        out: list[tuple] = []
        for batch in batches:
            for *node, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "n1", "n2", "conv_id"))):
                if ids and (node != key or len(ids) >= piece):
                    out.append((*key, first, ",".join(ids)))
                    ids = []
                if not ids:
                    key, first = node, conv
                ids.append(str(conv))
            if out:
                yield _rows(out)
                out = []
        if ids:
            yield _rows([(*key, first, ",".join(ids))])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        *numbers, text = zip(*out)
        return pa.RecordBatch.from_arrays(
            [*[pa.array(n, pa.int64()) for n in numbers], pa.array(text, pa.string())], names=["depth", "n1", "n2", "first", "ids"]
        )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                *node, text = (batch.column(c)[i].as_py() for c in ("depth", "n1", "n2", "ids"))
                if node != key:
                    if state is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = node, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if out:
                yield _digests(out)
        if state is not None:
            yield _digests([(*key, state.hexdigest())])

    def _digests(out: list[tuple]) -> pa.RecordBatch:
        *numbers, text = zip(*out)
        return pa.RecordBatch.from_arrays([*[pa.array(n, pa.int64()) for n in numbers], pa.array(text)], names=["depth", "n1", "n2", "ends_sha256"])

    node = ["depth", "n1", "n2"]
    sorted_ids = convs.repartitionByRange(*node, "conv_id").sortWithinPartitions(*node, "conv_id")
    parts = sorted_ids.mapInArrow(pieces, "depth long, n1 long, n2 long, first long, ids string")
    return parts.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(hashed, "depth long, n1 long, n2 long, ends_sha256 string")


def trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    wide = blocks(rebuilt(checkpointed(turns(conversations))), width)
    sums = "min(conv_id) AS conv_id, count(1) AS n_convs, sum(all_chars) AS all_chars"
    node = ["depth", "n1", "n2"]
    found = checkpointed(_prefixes(wide, sums, width))
    children = found.where("depth > 0").groupBy(F.expr("depth - 1").alias("depth"), F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    counted = checkpointed(found.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # For a smallest member: code points above its first own node, and below it along its path.
    own = checkpointed(counted.groupBy("conv_id").agg(
        F.min("above").alias("base"), (F.max(F.col("above") + F.col("chars")) - F.min("above")).alias("tail"),
        F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"),
    ))
    below = _prefixes(wide.join(own, "conv_id"), "sum(tail) AS tails, sum(leaf) AS n_leaves", width).select(*node, "tails", "n_leaves")
    parents = counted.select(F.expr("depth + 1").alias("depth"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    last = ends(wide.where("block = 0").select(F.col("all_n").alias("depth"), F.col("all_x1").alias("n1"), F.col("all_x2").alias("n2"), "conv_id"))
    whole = counted.join(below, node).join(own.select("conv_id", "base"), "conv_id").join(last, node, "left").join(
        parents, ["depth", "p1", "p2"], "left"
    )
    saved = F.col("all_chars") - F.col("n_convs") * F.col("above") - F.col("tails") - F.col("base") + F.col("above")
    return whole.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
        "n_children", "n_leaves", saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
