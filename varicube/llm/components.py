"""Connected components of a link table by local forests and alternating large-star and small-star rounds.

Each part of the links, of bounded size, is first replaced by a forest of itself: every node and the smallest one that it
reaches there. A single part is then done. Otherwise every round is a few joins on the links; the links stay distributed
and each round is checkpointed. Rounds go on until the links no longer change, which takes about the logarithm of the
longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varicube.llm.common import checkpointed
from varicube.session import stored

#: Links of one part.
AT_ONCE = 1 << 18


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("high", "low")).alias("mix")).first()
    return row["n"], row["mix"]


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (high, low) of each node with the smallest that it reaches by the given ones."""
    above = {}

    def top(node):
        while (over := above.setdefault(node, node)) != node:
            above[node] = node = above[over]
        return node

    schema = None
    for batch in batches:
        schema = batch.schema
        for high, low in zip(batch.column("high").to_pylist(), batch.column("low").to_pylist()):
            one, other = top(high), top(low)
            above[max(one, other)] = min(one, other)
    if above:
        found = [(node, top(node)) for node in list(above)]
        columns = zip(*((node, root) for node, root in found if node != root))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node of a link; root is the smallest node that it reaches."""
    given = stored(links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where("high <> low"))
    parts = max(1, -(-given.count() // AT_ONCE))
    links = checkpointed(given.coalesce(parts).mapInArrow(forest, given.schema))
    before, now = None, None
    while parts > 1 and (before is None or now != before):
        both = links.select(F.col("high").alias("node"), F.col("low").alias("peer")).union(links.select("low", "high"))
        least = both.groupBy("node").agg(F.min("peer").alias("first"))
        large = both.join(least, "node").where("peer > node").select(
            F.col("peer").alias("high"), F.least("node", "first").alias("low")
        ).distinct()
        smallest = large.groupBy("high").agg(F.min("low").alias("first"))
        moved = large.join(smallest, "high").where("low <> first").select(F.col("low").alias("high"), F.col("first").alias("low"))
        before = now or _state(links)
        links = checkpointed(moved.union(smallest.select("high", "first")).distinct())
        now = _state(links)
    roots = links.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return roots.union(links.select("low", "low").distinct())
