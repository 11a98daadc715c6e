"""Intermediate results that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varicube.operators import burden, cube, permutation
from varicube.plans import star_tables as star
from varicube.session import cut_lineage, stored

DOMAIN = star.DOMAIN


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return cube.category_counts(star.termed_variants(spark, sf), DOMAIN)


def sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``counts`` with one row per sample."""
    return cube.sample_rows(star.termed_variants(spark, sf), DOMAIN)


def totals(spark: SparkSession, sf: str) -> DataFrame:
    """(code, n) over all samples, from signatures that ignore the sample."""
    rows = cube.expand(cube.packed_signatures(star.termed_variants(spark, sf), DOMAIN, []), DOMAIN, [])
    return rows.groupBy("code").agg(F.sum("n").alias("n"))


def sums(spark: SparkSession, sf: str) -> DataFrame:
    """Variants of every category over all samples, in cases and in controls: one pass, stored, one row per category.

    Sums do not need the samples apart, so variants collapse to the distinct signatures of the domain before they become
    categories. Counts are those of ``counts`` joined to the samples: a sample listed twice counts twice. Raw_counts is
    ``totals``; a category without a listed sample has ``listed`` 0.
    """
    keys = ["cases", "ctrls"]
    rows = cube.expand(cube.packed_signatures(star.labelled_variants(spark, sf), DOMAIN, keys), DOMAIN, keys)
    n = F.col("n")
    return cut_lineage(rows.groupBy("code").agg(
        F.sum(n).alias("Raw_counts"), F.sum(n * F.col("cases")).alias("Case_DNV_Count"), F.sum(n * F.col("ctrls")).alias("Ctrl_DNV_Count"),
    ).withColumn("listed", F.col("Case_DNV_Count") + F.col("Ctrl_DNV_Count")))


def labelled_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``sample_rows`` with ``cases`` and ``ctrls``, how often the sample is listed as either; stored, for several readers."""
    return stored(cube.sample_rows(star.labelled_variants(spark, sf), DOMAIN, also=("cases", "ctrls")))


def sums_of(rows: DataFrame) -> DataFrame:
    """``sums`` from ``labelled_rows``, where the caller has them."""
    found = cut_lineage(cube.code_sums(rows, DOMAIN.size, "cases", "ctrls"))
    renamed = found.select("code", F.col("n").alias("Raw_counts"), F.col("cases").alias("Case_DNV_Count"), F.col("ctrls").alias("Ctrl_DNV_Count"))
    return renamed.withColumn("listed", F.col("Case_DNV_Count") + F.col("Ctrl_DNV_Count"))


def risk_table(spark: SparkSession, sf: str, carriers: bool = False, table: DataFrame | None = None) -> tuple[DataFrame, burden.Cohort]:
    """Counts and relative risk of each category; ``table`` is ``sums`` where the caller has it."""
    people = star.samples(spark, sf)
    size = burden.cohort(people)
    if carriers:
        return burden.burden_table(counts(spark, sf), people, size, F.col("n"), True), size
    table = sums(spark, sf) if table is None else table
    found = table.where("listed > 0").select("code", "Case_DNV_Count", "Ctrl_DNV_Count")
    return found.withColumn("Relative_Risk", burden.relative_risk(F.col("Case_DNV_Count"), F.col("Ctrl_DNV_Count"), size)), size


def tested(spark: SparkSession, sf: str, table: DataFrame | None = None) -> tuple[DataFrame, burden.Cohort]:
    """``risk_table`` with its tests, stored: one row per category."""
    found, size = risk_table(spark, sf, table=table)
    return cut_lineage(burden.binomial_test(found, size, "Case_DNV_Count", "Ctrl_DNV_Count")), size


def tested_and_raw(spark: SparkSession, sf: str, table: DataFrame | None = None) -> tuple[DataFrame, DataFrame, burden.Cohort]:
    """``tested``, (code, Raw_counts) and the cohort, from one pass over the variants; ``table`` is ``sums`` where the caller has it."""
    table = sums(spark, sf) if table is None else table
    found, size = tested(spark, sf, table)
    return found, table.select("code", "Raw_counts"), size


class Inputs:
    """Samples and category counts of one query, computed once and read from the checkpoint folder by all its parts."""

    def __init__(self, spark: SparkSession, sf: str):
        self.people = cut_lineage(star.samples(spark, sf))
        self.size = burden.cohort(self.people)
        self.rows = stored(sample_rows(spark, sf))
        self.counts = cube.long_counts(self.rows, "SAMPLE")

    def table(self, carriers: bool = False) -> DataFrame:
        # Labels join a sample's row, not each of its counts.
        labelled = cube.long_counts(self.rows.join(self.people.select("SAMPLE", "PHENOTYPE"), "SAMPLE"), "PHENOTYPE")
        return burden.with_risk(burden.case_control_of(labelled, F.col("n")), self.size, carriers)

    def tested(self) -> DataFrame:
        return burden.binomial_test(self.table(), self.size, "Case_DNV_Count", "Ctrl_DNV_Count")

    def totals(self) -> DataFrame:
        return self.counts.groupBy("code").agg(F.sum("n").alias("n"))

    def permuted(self, trials: int, carriers: bool = False, draw: str = "digest") -> DataFrame:
        """Stored: at most ``trials`` rows per category, read by several parts."""
        return cut_lineage(permutation.permuted_counts(
            self.counts, self.people, self.size, trials, DOMAIN.size, F.col("n"), carriers, draw=draw, rows=self.rows
        ))


def keyed(frame: DataFrame) -> DataFrame:
    return frame.withColumn("Category", DOMAIN.key(F.col("code"))).drop("code")
