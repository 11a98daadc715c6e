"""Variant extraction by category set, and the train/test split of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varicube.domain import DIMENSIONS, GENCODE_TERMS, CategoryDomain
from varicube.functions import annotate
from varicube.operators.cube import ARRAY_DIMENSIONS
from varicube.operators.keys import draw_exact

SLIM_COLUMNS = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "SAMPLE")


def flag_columns(score_column: str, threshold: float) -> list[Column]:
    """The is_*Region flags of variants that carry ``gene_sets``."""
    sets = F.coalesce(F.col("gene_sets"), F.array().cast("array<string>"))
    return annotate.extract_flags(
        F.col("Consequence"), F.col("LoF"), F.col("LoF_flags"), F.col(score_column),
        F.array_contains(sets, "ProteinCoding"), F.array_contains(sets, "lincRNA"), threshold,
    )


def by_category_set(variants: DataFrame, codes: DataFrame, domain: CategoryDomain) -> DataFrame:
    """Variants (with term arrays) of the given category codes, one row per variant and category.

    Categories are listed for each distinct combination of term arrays and meet the set there; a variant only joins the
    matches of its own combination, so no variant row is multiplied by categories that nobody asked for.
    """
    listed = variants.select(*ARRAY_DIMENSIONS).distinct()
    for array, dimension in ARRAY_DIMENSIONS.items():
        listed = listed.withColumn(dimension, F.explode_outer(array))
    coded = listed.withColumn("code", domain.encode(*[F.col(d) for d in DIMENSIONS]))
    matches = coded.join(codes.select("code").distinct(), "code").groupBy(*ARRAY_DIMENSIONS).agg(F.collect_list("code").alias("_codes"))
    joined = variants.join(matches, list(ARRAY_DIMENSIONS))
    return joined.withColumn("code", F.explode("_codes")).drop(*ARRAY_DIMENSIONS, "_codes")


def with_extract_terms(variants: DataFrame, score_column: str, threshold: float) -> DataFrame:
    """Replace the gencode terms by those of the extract flags (both UTR terms may be present)."""
    flagged = variants.select("*", *flag_columns(score_column, threshold))
    terms = [F.when(F.col(f"is_{t}") == 1, F.lit(t)) for t in GENCODE_TERMS if t != "Any"]
    return flagged.withColumn("gc", F.concat(F.array(F.lit("Any")), F.array_compact(F.array(*terms))))


def slim(extracted: DataFrame) -> DataFrame:
    kept = [c for c in SLIM_COLUMNS if c in extracted.columns]
    return extracted.select(*kept, *(["CATEGORY"] if "CATEGORY" in extracted.columns else []))


def split_samples(samples: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Training and test sets with exactly round(n * fraction) training samples per phenotype.

    A given SET column is kept.
    """
    if "SET" in samples.columns:
        return samples
    sizes = samples.groupBy("PHENOTYPE").agg(F.bround(F.count(F.lit(1)) * F.lit(fraction), 0).cast("bigint").alias("_n_train"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("SAMPLE")))
    drawn = draw_exact(samples.join(sizes, "PHENOTYPE"), ["PHENOTYPE"], digest, "SAMPLE", F.col("_n_train"))
    return drawn.withColumn("SET", F.when(F.col("drawn"), "training").otherwise("test")).drop("drawn", "_n_train")
