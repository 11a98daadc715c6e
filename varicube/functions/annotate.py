"""Per-variant annotation as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varicube.domain import CategoryDomain, literal_array

# Consequence words, grouped by the region they decide.
TRUNCATING = ("stop_gained", "splice_donor", "splice_acceptor")
FRAMESHIFT = ("frameshift_variant",)
MISSENSE = ("missense_variant", "protein_altering_variant", "start_lost", "stop_lost")
INFRAME = ("inframe_deletion", "inframe_insertion")
SILENT = ("synonymous_variant",)
CODING_REMAINDER = (
    "stop_retained_variant",
    "incomplete_terminal_codon_variant",
    "protein_altering_variant",
    "coding_sequence_variant",
)
INTERGENIC = ("downstream_gene_variant", "intergenic_variant")

# Noncoding regions in order of precedence, with the word that selects each.
NONCODING_ORDER = (
    ("5PrimeUTRsRegion", ("5_prime_UTR_variant",)),
    ("3PrimeUTRsRegion", ("3_prime_UTR_variant",)),
    ("PromoterRegion", ("upstream_gene_variant",)),
    ("SpliceSiteRegion", ("splice_region_variant",)),
    ("IntronRegion", ("intron_variant",)),
    ("IntergenicRegion", INTERGENIC),
)


def has_any(text: Column, words) -> Column:
    return reduce(or_, [F.contains(text, F.lit(word)) for word in words])


def variant_type(ref: Column, alt: Column) -> Column:
    return F.when((F.length(ref) == 1) & (F.length(alt) == 1), "SNV").otherwise("Indel")


def variant_class(ref: Column, alt: Column) -> Column:
    return (
        F.when(F.length(ref) > 1, "Deletion")
        .when((F.length(ref) == 1) & (F.length(alt) == 1), "SNV")
        .otherwise("Insertion")
    )


def effective_gene(consequence: Column, symbol: Column, nearest: Column) -> Column:
    return F.when(has_any(consequence, INTERGENIC), nearest).otherwise(symbol)


def gene_set_terms(gene_sets: Column, domain: CategoryDomain) -> Column:
    """``Any`` plus the gene's sets in domain order; lincRNA never becomes a term."""
    offered = literal_array([g for g in domain.gene_sets if g != "lincRNA"])
    return F.concat(F.array(F.lit("Any")), F.array_intersect(offered, gene_sets))


def missense_score(score: Column) -> Column:
    """Largest of the ``&``-joined scores; null where the score is empty or ``NA``."""
    parts = F.transform(F.split(score, "&"), lambda part: part.try_cast("double"))
    return F.when((score != "") & (score != "NA"), F.array_max(parts))


def is_damaging(score: Column, threshold: float) -> Column:
    return F.coalesce(missense_score(score) >= F.lit(float(threshold)), F.lit(False))


def _lof_gate(lof: Column, lof_flags: Column) -> Column:
    return (lof == "HC") & lof_flags.isin("SINGLE_EXON", "")


#: Gencode terms of a coding variant, and of a noncoding one, by the number of its branch; the terms of a gene's other variants.
CODING_BRANCHES = (
    ("CodingRegion", "PTVRegion"),
    ("CodingRegion", "FrameshiftRegion", "PTVRegion"),
    ("CodingRegion", "DamagingMissenseRegion", "MissenseRegion"),
    ("CodingRegion", "MissenseRegion"),
    ("CodingRegion", "InFrameRegion"),
    ("CodingRegion", "SilentRegion"),
    ("CodingRegion",),
)
NONCODING_BRANCHES = tuple(("NoncodingRegion", region) for region, _ in NONCODING_ORDER)
#: Places of a branch in a shape, which also counts "none".
BRANCHES = 8


def coding_branch(consequence: Column, lof: Column, lof_flags: Column, score: Column, threshold: float) -> Column:
    """Number of the branch in ``CODING_BRANCHES`` that a variant of a protein-coding gene takes; 0 for none."""
    gate = _lof_gate(lof, lof_flags)
    still_coding = has_any(consequence, CODING_REMAINDER + TRUNCATING + FRAMESHIFT)
    return (
        F.when(has_any(consequence, TRUNCATING) & gate, 1)
        .when(has_any(consequence, FRAMESHIFT) & gate, 2)
        .when(has_any(consequence, MISSENSE), F.when(is_damaging(score, threshold), 3).otherwise(4))
        .when(has_any(consequence, INFRAME), 5)
        .when(has_any(consequence, SILENT), 6)
        .when(still_coding, 7)
        .otherwise(0)
    )


def noncoding_branch(consequence: Column) -> Column:
    """Number of the branch in ``NONCODING_BRANCHES``; 0 where the gene decides."""
    branch = None
    for number, (_, words) in enumerate(NONCODING_ORDER, 1):
        test = has_any(consequence, words)
        branch = F.when(test, number) if branch is None else branch.when(test, number)
    return branch.otherwise(0)


def _branch_terms(branch: Column, branches, otherwise: Column) -> Column:
    chosen = None
    for number, names in enumerate(branches, 1):
        value = literal_array(names)
        chosen = F.when(branch == number, value) if chosen is None else chosen.when(branch == number, value)
    return chosen.otherwise(otherwise)


def gencode_of(coding: Column, noncoding: Column, gene_sets: Column) -> Column:
    """Gencode region terms of a variant's branches and its gene, ``Any`` first."""
    protein_coding = F.array_contains(gene_sets, "ProteinCoding")
    by_gene = (
        F.when(protein_coding, literal_array(("NoncodingRegion",)))
        .when(F.array_contains(gene_sets, "lincRNA"), literal_array(("NoncodingRegion", "lincRnaRegion")))
        .otherwise(literal_array(("NoncodingRegion", "OtherTranscriptRegion")))
    )
    outside = _branch_terms(noncoding, NONCODING_BRANCHES, by_gene)
    region = F.when(protein_coding & (coding > 0), _branch_terms(coding, CODING_BRANCHES, outside)).otherwise(outside)
    return F.concat(literal_array(("Any",)), region)


def gencode_terms(
    consequence: Column,
    gene_sets: Column,
    lof: Column,
    lof_flags: Column,
    score: Column,
    threshold: float,
) -> Column:
    """Gencode region terms of a variant, ``Any`` first."""
    return gencode_of(coding_branch(consequence, lof, lof_flags, score, threshold), noncoding_branch(consequence), gene_sets)


def bit_is_set(mask: Column, bit: int) -> Column:
    return F.shiftright(mask, bit).bitwiseAND(F.lit(1)) == 1


def mask_terms(mask: Column, names) -> Column:
    """Names whose bit is set in ``mask``; the first name is the least significant bit."""
    if not names:
        return literal_array(())
    return F.array_compact(F.array(*[F.when(bit_is_set(mask, i), F.lit(n)) for i, n in enumerate(names)]))


def mask_columns(mask: Column, names, as_array: bool = False) -> list[Column]:
    """One 0/1 column per track, from a BIGINT mask or an array of track numbers."""
    if as_array:
        return [F.coalesce(F.array_contains(mask, i), F.lit(False)).cast("int").alias(n) for i, n in enumerate(names)]
    return [bit_is_set(mask, i).cast("int").alias(n) for i, n in enumerate(names)]


def score_terms(track_names: Column, domain: CategoryDomain) -> Column:
    return F.concat(F.array(F.lit("All")), F.array_intersect(literal_array(domain.scores), track_names))


def annotation_terms(track_names: Column, domain: CategoryDomain) -> Column:
    return F.concat(F.array(F.lit("Any")), F.array_intersect(literal_array(domain.annotations), track_names))


def track_names(variants: DataFrame, domain: CategoryDomain) -> Column:
    """Track names of each variant, from ``ANNOT`` as a BIGINT mask or an array of track ids."""
    kind = variants.schema["ANNOT"].dataType.typeName()
    if kind == "array":
        names = literal_array(domain.tracks)
        return F.transform(F.col("ANNOT"), lambda i: F.element_at(names, (i + 1).cast("int")))
    if len(domain.tracks) > 62:
        raise ValueError("more than 62 tracks: keep ANNOT as an array of track ids")
    return mask_terms(F.col("ANNOT").cast("bigint"), domain.tracks)


def with_shape(variants: DataFrame, score_column: str, threshold: float) -> DataFrame:
    """Add ``shape``: a number for what a variant's own columns say about its type and gencode terms.

    Added before the gene sets are joined, it is what travels to them instead of the texts it was made from.
    """
    coding = coding_branch(F.col("Consequence"), F.col("LoF"), F.col("LoF_flags"), F.col(score_column), threshold)
    snv = F.when(variant_type(F.col("REF"), F.col("ALT")) == "SNV", 1).otherwise(0)
    return variants.withColumn("shape", (snv * BRANCHES + coding) * BRANCHES + noncoding_branch(F.col("Consequence")))


def with_terms(variants: DataFrame, domain: CategoryDomain, score_column: str, threshold: float) -> DataFrame:
    """Add one term array per dimension (vt, gs, fs, gc, fa).

    ``variants`` has ANNOT, ``gene_sets`` (array of the effective gene's sets, null where the gene is unknown), and
    either ``shape`` (see ``with_shape``) or REF, ALT, Consequence, LoF, LoF_flags and the score column.
    """
    shaped = variants if "shape" in variants.columns else with_shape(variants, score_column, threshold)
    sets = F.coalesce(F.col("gene_sets"), F.array().cast("array<string>"))
    tracks = track_names(variants, domain)
    shape = F.col("shape")
    return shaped.withColumns(
        {
            "vt": F.array(F.lit("All"), F.when(shape >= BRANCHES * BRANCHES, "SNV").otherwise("Indel")),
            "gs": gene_set_terms(sets, domain),
            "fs": score_terms(tracks, domain),
            "gc": gencode_of(F.shiftright(shape, 3).bitwiseAND(F.lit(BRANCHES - 1)), shape.bitwiseAND(F.lit(BRANCHES - 1)), sets),
            "fa": annotation_terms(tracks, domain),
        }
    ).drop("shape")


def with_gene_sets(variants: DataFrame, gene_sets: DataFrame) -> DataFrame:
    """Left join of the effective gene to its sets (``gene_name``, ``gene_sets``).

    The gene table has one row per gene, so nothing multiplies; a hot gene on the variant side is
    split by AQE when the gene table is too large to broadcast.
    """
    gene = effective_gene(F.col("Consequence"), F.col("SYMBOL"), F.col("NEAREST"))
    return (
        variants.withColumn("effective_gene", gene)
        .join(gene_sets.withColumnRenamed("gene_name", "effective_gene"), "effective_gene", "left")
    )


def extract_flags(
    consequence: Column,
    lof: Column,
    lof_flags: Column,
    score: Column,
    protein_coding: Column,
    linc_rna: Column,
    threshold: float,
) -> list[Column]:
    """The is_*Region columns of the variant extract (unlike the cascade, both UTR flags may be set)."""

    def words(*groups) -> Column:
        return has_any(consequence, [w for g in groups for w in g])

    coding = protein_coding & words(TRUNCATING, FRAMESHIFT, MISSENSE, INFRAME, SILENT, CODING_REMAINDER)
    ptv = coding & words(TRUNCATING, FRAMESHIFT) & _lof_gate(lof, lof_flags)
    frameshift = ptv & words(FRAMESHIFT) & ~words(TRUNCATING)
    missense = coding & ~ptv & words(MISSENSE)
    inframe = coding & ~ptv & ~missense & words(INFRAME)
    silent = coding & ~ptv & ~missense & ~inframe & words(SILENT)
    utr3 = ~coding & words(("3_prime_UTR_variant",))
    utr5 = ~coding & words(("5_prime_UTR_variant",))
    taken = coding | utr3 | utr5
    later = {}
    for region, tests in NONCODING_ORDER[2:]:
        later[region] = ~taken & words(tests)
        taken = taken | later[region]
    linc = ~taken & linc_rna & ~protein_coding
    other = ~taken & ~linc & ~protein_coding
    flags = {
        "is_CodingRegion": coding,
        "is_NoncodingRegion": ~coding,
        "is_PTVRegion": ptv,
        "is_FrameshiftRegion": frameshift,
        "is_MissenseRegion": missense,
        "is_DamagingMissenseRegion": missense & is_damaging(score, threshold),
        "is_InFrameRegion": inframe,
        "is_SilentRegion": silent,
        "is_3PrimeUTRsRegion": utr3,
        "is_5PrimeUTRsRegion": utr5,
        "is_UTRsRegion": utr3 | utr5,
        "is_PromoterRegion": later["PromoterRegion"],
        "is_SpliceSiteRegion": later["SpliceSiteRegion"],
        "is_IntronRegion": later["IntronRegion"],
        "is_IntergenicRegion": later["IntergenicRegion"],
        "is_lincRnaRegion": linc,
        "is_OtherTranscriptRegion": other,
    }
    return [F.coalesce(test, F.lit(False)).cast("int").alias(name) for name, test in flags.items()]
