"""Case/control burden statistics per category."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varicube.functions.scalars import divide, finite, half_even, log_ratio
from varicube.functions.stats import binomial_greater, binomial_two_sided, normal_quantile


@dataclass(frozen=True)
class Cohort:
    cases: int
    controls: int

    @property
    def case_share(self) -> float:
        return self.cases / (self.cases + self.controls)


def cohort_sizes(samples: DataFrame) -> DataFrame:
    return samples.agg(
        F.count_if(F.col("PHENOTYPE") == "case").alias("n_case"),
        F.count_if(F.col("PHENOTYPE") == "ctrl").alias("n_ctrl"),
    )


def cohort(samples: DataFrame) -> Cohort:
    row = cohort_sizes(samples).first()
    return Cohort(row["n_case"], row["n_ctrl"])


def adjusted(counts: DataFrame, factors: DataFrame) -> DataFrame:
    """Counts with ``adjusted`` = n times the sample's factor."""
    return counts.join(factors.select("SAMPLE", "AdjustFactor"), "SAMPLE").withColumn(
        "adjusted", F.col("n") * F.col("AdjustFactor")
    )


def case_control(counts: DataFrame, samples: DataFrame, value: Column, by: str = "code") -> DataFrame:
    """Per category: sums of ``value`` and numbers of carriers, for cases and controls."""
    return case_control_of(counts.join(samples.select("SAMPLE", "PHENOTYPE"), "SAMPLE"), value, by)


def case_control_of(labelled: DataFrame, value: Column, by: str = "code") -> DataFrame:
    """``case_control`` of counts that have their PHENOTYPE."""
    case, ctrl = F.col("PHENOTYPE") == "case", F.col("PHENOTYPE") == "ctrl"
    zero = F.lit(0)
    return labelled.groupBy(by).agg(
        F.sum(F.when(case, value).otherwise(zero)).alias("Case_DNV_Count"),
        F.sum(F.when(ctrl, value).otherwise(zero)).alias("Ctrl_DNV_Count"),
        F.count_if(case & (value > 0)).alias("Case_Carrier_Count"),
        F.count_if(ctrl & (value > 0)).alias("Ctrl_Carrier_Count"),
    )


def relative_risk(case: Column, ctrl: Column, cohort: Cohort) -> Column:
    return divide(case.cast("double") / F.lit(float(cohort.cases)), ctrl.cast("double") / F.lit(float(cohort.controls)))


def raw_and_adjusted(counts: DataFrame, value: Column, carriers: bool = False, by: str = "code") -> DataFrame:
    """Raw and adjusted totals per category (numbers of carriers when ``carriers``)."""
    if carriers:
        return counts.groupBy(by).agg(
            F.count_if(F.col("n") > 0).alias("Raw_counts"), F.count_if(value > 0).alias("Adj_counts")
        )
    return counts.groupBy(by).agg(F.sum("n").alias("Raw_counts"), F.sum(value).alias("Adj_counts"))


def burden_table(
    counts: DataFrame, samples: DataFrame, size: Cohort, value: Column, carriers: bool = False, by: str = "code"
) -> DataFrame:
    """Counts and relative risk of each category."""
    return with_risk(case_control(counts, samples, value, by), size, carriers, by)


def with_risk(table: DataFrame, size: Cohort, carriers: bool = False, by: str = "code") -> DataFrame:
    kept = ("Case_Carrier_Count", "Ctrl_Carrier_Count") if carriers else ("Case_DNV_Count", "Ctrl_DNV_Count")
    table = table.select(by, *kept)
    return table.withColumn("Relative_Risk", relative_risk(F.col(kept[0]), F.col(kept[1]), size))


def binomial_test(table: DataFrame, size: Cohort, case_column: str, ctrl_column: str) -> DataFrame:
    """Exact two-sided P, one-sided P with a pseudocount on both arms, and its z-score.

    ``table`` has one row per category, so the Arrow kernel sees a domain-bounded number of rows.
    """
    n1 = half_even(F.col(case_column).cast("double"))
    n2 = half_even(F.col(ctrl_column).cast("double"))
    p = size.case_share
    tested = table.withColumn("P", binomial_two_sided(n1, n2, p)).withColumn(
        "P_1side", binomial_greater(n1 + 1, n2 + 1, p)
    )
    return tested.withColumn("Z_1side", normal_quantile(F.lit(1.0) - F.col("P_1side")))


def volcano(table: DataFrame, raw_counts: DataFrame, threshold: int, by: str = "code") -> DataFrame:
    """Plot data: log2 relative risk (infinities at the axis end) and -log10 P of well-counted categories."""
    shown = table.join(raw_counts.where(F.col("Raw_counts") >= threshold).select(by), by, "left_semi")
    points = shown.withColumns(
        {"log2_RR": log_ratio(F.col("Relative_Risk"), 2), "neg_log_P": -log_ratio(F.col("P"), 10)}
    )
    span = points.agg(F.max(F.when(finite(F.col("log2_RR")), F.abs("log2_RR")))).first()[0]
    edge = float(int(span or 0.0)) + 2.0
    inside = F.when(finite(F.col("log2_RR")), F.col("log2_RR")).when(F.col("log2_RR") > 0, edge).when(
        F.col("log2_RR") < 0, -edge
    )
    return points.withColumn("x", inside)


def significant(table: DataFrame, p_cut: float) -> DataFrame:
    """Categories at or below ``p_cut``, with the direction of the effect."""
    direction = F.when(F.col("Relative_Risk") > 1, "case").when(F.col("Relative_Risk") < 1, "ctrl")
    return table.where(F.col("P") <= p_cut).withColumn("direction", direction).where(F.col("direction").isNotNull())


def rare_categories(counts: DataFrame, samples: DataFrame, value: Column, threshold: float, by: str = "code") -> DataFrame:
    """Categories whose control total is below ``threshold`` (categories without controls included)."""
    ctrl = F.sum(F.when(F.col("PHENOTYPE") == "ctrl", value).otherwise(F.lit(0)))
    labelled = counts.join(samples.select("SAMPLE", "PHENOTYPE"), "SAMPLE")
    return labelled.groupBy(by).agg(ctrl.alias("ctrl_count")).where(F.col("ctrl_count") < threshold)
