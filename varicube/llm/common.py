"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varicube.session import checkpoint_folder, cut_lineage

__all__ = [
    "WORD", "WHITE", "ascii_lower", "checkpointed", "crc_fold", "fresh", "sized_broadcast", "slim_batches", "table", "utf8", "words", "work_folder",
]

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(frame: DataFrame, *stems: str) -> list[str]:
    """Column names that do not clash with any column of ``frame``, whatever their case."""
    taken = {c.lower() for c in frame.columns}
    names = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def crc_fold(doc_id: Column, modulus: int) -> Column:
    """CRC-32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null becomes empty."""
    return [b"" if value is None else value for value in column.cast(pa.large_binary()).to_pylist()]


def slim_batches(batches: Iterator[pa.RecordBatch], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most about ``most`` bytes each (one row at least), so long texts are not decoded all at once."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(batch.nbytes, most))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def checkpointed(frame: DataFrame) -> DataFrame:
    """``frame`` written to the cluster's checkpoint folder and read from there."""
    return cut_lineage(frame)


def sized_broadcast(frame: DataFrame, most_rows: int = 10_000) -> DataFrame:
    """``frame`` written down and counted; small enough, it is broadcast, else joined by shuffling."""
    written = checkpointed(frame)
    return F.broadcast(written) if written.count() <= most_rows else written


def work_folder(spark: SparkSession, stem: str) -> str:
    """URI of a new folder under the shared checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"
