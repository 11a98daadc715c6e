"""Exact deduplication by content sort.

Spark samples splitters over (leading characters, 64-bit hash, salt) and range-partitions the rows by them, so the
splitters stay short however long the texts are. Inside a partition one external sort on (leading characters, hash, salt,
whole text, id) puts equal texts next to each other; a window over that order compares neighbours in full, numbers the
rows of a group and gives each the group's first id and size. No group is gathered in a cell.

A text with many copies would fill one partition. A first pass adds up bytes by hash; a hash above the limit (1 MB, or a
2^20th of all bytes, so at most 2^20 hashes of 16 bytes are broadcast) is salted into parts of about that size. The first
row of each part then meets the other parts' first rows in a second sort by whole text. A hash collision only adds a
needless salt.

Defined cases: a null text counts as empty; a null id sorts below all others and is the kept one only in a group
without ids; repeated rows with the kept id keep one row (the first of them after the sort); an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varicube.llm.common import checkpointed

MOST_HEAVY = 1 << 20
PER_SALT = 1 << 20
ROW_BYTES = 64
LEADING = 32


def classes(docs: DataFrame, normalise=lambda text: text, keep: str = "max", per_salt: int = PER_SALT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``normalise`` maps the text column to the text that is compared; ``keep`` is ``max`` or ``min`` of doc_id;
    ``per_salt`` is the size in bytes above which the copies of a text are dealt over several partitions.
    """
    text = normalise(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", text.alias("text")).withColumn("hash", F.xxhash64("text"))
    sizes = checkpointed(rows.groupBy("hash").agg(F.sum(F.octet_length("text") + F.lit(ROW_BYTES)).alias("bytes")))
    most = max(per_salt, (sizes.agg(F.sum("bytes")).first()[0] or 0) // MOST_HEAVY)
    heavy = sizes.where(F.col("bytes") > most).select(
        F.col("hash").alias("heavy_hash"), F.ceil(F.col("bytes") / F.lit(most)).alias("salts")
    )
    hashed = rows.join(F.broadcast(heavy), F.col("hash") == F.col("heavy_hash"), "left")
    # The row's number spreads copies without an id, or with one id, as well.
    dealt = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("salts"))
    keyed = hashed.select(
        F.substring("text", 1, LEADING).alias("lead"), "hash", F.coalesce(dealt, F.lit(0)).alias("salt"), "text",
        F.col("salts").isNotNull().alias("salted"), "doc_id", F.monotonically_increasing_id().alias("number"),
    )
    first = F.col("doc_id").desc_nulls_last() if keep == "max" else F.col("doc_id").asc_nulls_last()
    equal = Window.partitionBy("lead", "hash", "salt", "text").orderBy(first, "number")
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = keyed.repartitionByRange("lead", "hash", "salt").select(
        "lead", "hash", "text", "salted", "doc_id", F.row_number().over(equal).alias("place"), F.first("doc_id").over(whole).alias("best"),
        F.count(F.lit(1)).over(whole).alias("n"), F.first("number").over(whole).alias("part"),
    )
    heads = F.col("salted") & (F.col("place") == 1)
    narrow = checkpointed(
        ordered.select(
            "doc_id", "best", "n", "part", "salted", (F.col("place") == 1).alias("kept"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
            F.when(heads, F.struct("lead", "hash", "text")).alias("head"),
        )
    )
    columns = ("doc_id", F.col("best").alias("keep_id"), F.col("n").alias("group_size"), "kept", "text_sha256")
    parts = narrow.where(F.col("head").isNotNull()).select("head.lead", "head.hash", "head.text", "best", "n", "part")
    first = F.col("best").desc_nulls_last() if keep == "max" else F.col("best").asc_nulls_last()
    equal = Window.partitionBy("lead", "hash", "text").orderBy(first, "part")
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = parts.repartitionByRange("lead", "hash").select(
        "part", F.first("best").over(whole).alias("best"), F.sum("n").over(whole).alias("n"), (F.row_number().over(equal) == 1).alias("leads")
    )
    salted = narrow.where("salted").drop("best", "n").join(merged, "part").withColumn("kept", F.col("kept") & F.col("leads"))
    return narrow.where(~F.col("salted")).select(*columns).unionByName(salted.select(*columns))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The ids that stay, one row per distinct text."""
    return classes(docs, **options).where("kept").select("doc_id", "text_sha256", "group_size")
