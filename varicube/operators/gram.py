"""Category co-occurrence as a blocked product of sparse indicator rows.

Each unit (a sample, or a distinct term signature with its multiplicity) is one row holding its sorted
category codes. Rows are cut into column blocks; a task adds up block products in place and emits each
block's nonzero cells once, so the shuffle carries partial sums per category pair and never the pairs of
a unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
#: Categories up to which a task keeps all cells at once (32 MB), and rows it multiplies at once.
WHOLE_CODES = 2048
ROWS_AT_ONCE = 4096
CELLS = "code_i bigint, code_j bigint, n double"


def unit_rows(cells: DataFrame, unit: str) -> DataFrame:
    """(unit, codes) from long (unit, code) cells; a row is bounded by the number of categories."""
    return cells.groupBy(unit).agg(F.array_sort(F.collect_set("code")).alias("codes"))


def _indicator(columns: pd.Series, base: int) -> np.ndarray:
    sizes = [len(c) for c in columns]
    dense = np.zeros((len(sizes), BLOCK))
    if sum(sizes):
        dense[np.repeat(np.arange(len(sizes)), sizes), np.concatenate(columns.to_list()).astype(np.int64) - base] = 1.0
    return dense


def _emit(key: tuple[int, int], cell: np.ndarray) -> pd.DataFrame:
    i, j = np.nonzero(cell)
    return pd.DataFrame({"code_i": i + key[0] * BLOCK, "code_j": j + key[1] * BLOCK, "n": cell[i, j]})


def _block_products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by block pair: one accumulator is alive at a time."""
    current, total = None, None
    for batch in batches:
        for key, rows in batch.groupby(["bi", "bj"], sort=True):
            if key != current:
                if total is not None:
                    yield _emit(current, total)
                current, total = key, np.zeros((BLOCK, BLOCK))
            left = _indicator(rows["left"], int(key[0]) * BLOCK)
            right = left if key[0] == key[1] else _indicator(rows["right"], int(key[1]) * BLOCK)
            total += left.T @ (right * rows["w"].to_numpy(dtype=float)[:, None])
    if total is not None:
        yield _emit(current, total)


def _whole_products(n_codes: int):
    """All cells of the rows a task holds; only columns that occur in a batch are multiplied."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_codes, n_codes))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                lists, w = part.column("codes"), part.column("w").to_numpy()
                owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                present, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
                # Sums of at most ROWS_AT_ONCE ones are exact in single precision.
                dense = np.zeros((len(lists), len(present)), dtype=np.float32 if (w == 1.0).all() else np.float64)
                dense[owner, place] = 1.0
                right = dense if dense.dtype == np.float32 else dense * w[:, None]
                total[np.ix_(present, present)] += dense.T @ right
        i, j = np.nonzero(total)
        kept = i // BLOCK <= j // BLOCK  # as the block products
        i, j = i[kept], j[kept]
        yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total[i, j])], ["code_i", "code_j", "n"])

    return multiply


def co_occurrence(rows: DataFrame, n_codes: int, weight: str | None = None, salt: str | None = None) -> DataFrame:
    """Weighted number of units holding both categories: (code_i, code_j, n) with code_i <= code_j blocks.

    ``rows`` has ``codes`` (array of category codes) and optionally ``weight``. ``salt`` names a column whose
    hash spreads one block pair over tasks; it is needed only above ``WHOLE_CODES`` codes.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    if n_codes <= WHOLE_CODES:
        # Every task multiplies the rows it already holds.
        partial = rows.select(F.col("codes").cast("array<bigint>"), w.alias("w")).mapInArrow(_whole_products(n_codes), CELLS)
    else:
        numbers = F.transform("codes", lambda c: F.floor(c / F.lit(BLOCK)))
        split = rows.withColumn(
            "parts",
            F.transform(
                F.array_distinct(numbers),
                lambda b: F.struct(b.alias("b"), F.filter("codes", lambda c: F.floor(c / F.lit(BLOCK)) == b).alias("codes")),
            ),
        )
        pairs = F.flatten(F.transform(
            "parts",
            lambda a: F.transform(
                F.filter("parts", lambda b: b["b"] >= a["b"]),
                lambda b: F.struct(
                    a["b"].alias("bi"), b["b"].alias("bj"), a["codes"].alias("left"), b["codes"].alias("right")
                ),
            ),
        ))
        n_blocks = -(-n_codes // BLOCK)
        key = F.pmod(F.xxhash64(salt if salt else "codes"), F.lit(64))
        blocks = (
            split.select(F.inline(pairs), w.alias("w"), key.alias("_salt"))
            .repartition(min(64 * n_blocks * (n_blocks + 1) // 2, 4096), "bi", "bj", "_salt")
            .sortWithinPartitions("bi", "bj")
            .select("bi", "bj", "left", "right", "w")
        )
        partial = blocks.mapInPandas(_block_products, CELLS)
    return partial.groupBy("code_i", "code_j").agg(F.sum("n").cast("bigint").alias("n"))


def both_triangles(cells: DataFrame) -> DataFrame:
    """All ordered pairs: block products above the diagonal blocks are mirrored."""
    upper = F.floor(F.col("code_i") / F.lit(BLOCK)) < F.floor(F.col("code_j") / F.lit(BLOCK))
    mirrored = F.array(F.struct("code_i", "code_j"), F.struct(F.col("code_j").alias("code_i"), F.col("code_i").alias("code_j")))
    return cells.select(
        F.inline(F.when(upper, mirrored).otherwise(F.array(F.struct("code_i", "code_j")))), "n"
    )


def correlation(intersections: DataFrame) -> DataFrame:
    """I_ij / sqrt(I_ii I_jj) for every co-occurring pair."""
    own = intersections.where(F.col("code_i") == F.col("code_j")).select(F.col("code_i").alias("_c"), F.col("n").alias("_own"))
    left = own.select(F.col("_c").alias("code_i"), F.col("_own").alias("n_i"))
    right = own.select(F.col("_c").alias("code_j"), F.col("_own").alias("n_j"))
    joined = intersections.join(left, "code_i").join(right, "code_j")
    return joined.select(
        "code_i", "code_j", "n", F.try_divide(F.col("n").cast("double"), F.sqrt(F.col("n_i") * F.col("n_j").cast("double"))).alias("corr")
    )


def covariance(intersections: DataFrame, case_share: float) -> DataFrame:
    return intersections.select(
        "code_i", "code_j", (F.col("n") * F.lit(case_share) * F.lit(1.0 - case_share)).alias("value")
    )


def normalised(matrix: DataFrame, value: str) -> DataFrame:
    """|a_ij| / sqrt(d_i d_j) with d the column sums of |a|."""
    size = F.abs(F.col(value))
    degrees = matrix.groupBy(F.col("code_j").alias("_c")).agg(F.sum(size).alias("_d"))
    left = degrees.select(F.col("_c").alias("code_i"), F.col("_d").alias("d_i"))
    right = degrees.select(F.col("_c").alias("code_j"), F.col("_d").alias("d_j"))
    joined = matrix.join(left, "code_i").join(right, "code_j")
    return joined.select("code_i", "code_j", F.try_divide(size, F.sqrt(F.col("d_i") * F.col("d_j"))).alias("value"))
