"""Eigenvalues of the normalised category matrix and the effective number of tests."""

from __future__ import annotations

import numpy as np
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varicube.operators.ordered import cumulative_share
from varicube.session import cut_lineage

# A matrix of this many categories (128 MB) is solved in memory; larger ones by a distributed SVD.
LOCAL_CATEGORIES = 4096
SMALLEST_EIGENVALUE = 1e-12
VECTORS = "code bigint, vector array<double>"


def sparse_rows(matrix: DataFrame) -> DataFrame:
    """(code_i, cells) with one row per category; a row is bounded by the number of categories."""
    return matrix.groupBy("code_i").agg(F.collect_list(F.struct("code_j", "value")).alias("cells"))


def eigen_decomposition(matrix: DataFrame, components: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Eigenvalues (position, value) and eigenvectors (code, vector), largest eigenvalue first.

    ``matrix`` holds code_i, code_j, value of a symmetric positive semidefinite matrix, which makes its
    singular values its eigenvalues. The code list is bounded by the domain.
    """
    spark = matrix.sparkSession
    matrix = cut_lineage(matrix.select("code_i", "code_j", "value"))
    codes = [r[0] for r in matrix.select("code_i").distinct().orderBy("code_i").collect()]
    n = len(codes)
    if n == 0:
        return spark.createDataFrame([], "position bigint, value double"), spark.createDataFrame([], VECTORS)
    place = {code: i for i, code in enumerate(codes)}
    if n <= LOCAL_CATEGORIES:
        dense = np.zeros((n, n))
        cells = matrix.toPandas()
        dense[cells["code_i"].map(place), cells["code_j"].map(place)] = cells["value"]
        values, vectors = np.linalg.eigh((dense + dense.T) / 2.0)
        order = np.argsort(-np.abs(values), kind="stable")[: components or n]
        values, vectors = values[order], vectors[:, order]
        labelled = spark.createDataFrame([(c, [float(x) for x in vectors[i]]) for i, c in enumerate(codes)], VECTORS)
    else:
        index = spark.createDataFrame(list(place.items()), "code bigint, i bigint")
        rows = (
            sparse_rows(matrix.join(index.select(F.col("code").alias("code_j"), F.col("i").alias("j")), "code_j")
                        .select("code_i", F.col("j").alias("code_j"), "value"))
            .join(index.select(F.col("code").alias("code_i"), "i"), "code_i")
            .select("i", "cells")
        )
        distributed = IndexedRowMatrix(
            rows.rdd.map(lambda r: IndexedRow(r[0], Vectors.sparse(n, sorted((c[0], c[1]) for c in r[1])))), n, n
        )
        decomposition = distributed.computeSVD(components or n, computeU=True)
        values = decomposition.s.toArray()
        left = decomposition.U.rows.map(lambda r: (r.index, [float(x) for x in r.vector.toArray()]))
        labelled = spark.createDataFrame(left, "i bigint, vector array<double>").join(index, "i").select("code", "vector")
    table = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(values)], "position bigint, value double")
    return table, labelled


def effective_number(eigenvalues: DataFrame, share: float = 0.99) -> int:
    """Leading eigenvalues needed to reach ``share`` of their sum; values below 1e-12 are ignored."""
    kept = eigenvalues.where(F.col("value") >= SMALLEST_EIGENVALUE)
    placed = cumulative_share(kept.select(F.col("position").alias("key"), "value"), "value", "key")
    # The last share is 1 up to rounding, so it may stay a hair under the target only when it is the target.
    first = placed.where(F.col("share") >= share - 1e-12).agg(F.min("position")).first()[0]
    return int(first or 0)
