"""The five category dimensions, their terms and the redundant term pairs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dimension names, in category-key order.
DIMENSIONS = ("variant_type", "gene_set", "functional_score", "gencode", "functional_annotation")

# The wildcard term of each dimension.
WILDCARDS = {
    "variant_type": "All",
    "gene_set": "Any",
    "functional_score": "All",
    "gencode": "Any",
    "functional_annotation": "Any",
}

# Variant type terms.
VARIANT_TYPES = ("All", "SNV", "Indel")

# Gencode region terms.
GENCODE_TERMS = (
    "Any",
    "CodingRegion",
    "FrameshiftRegion",
    "InFrameRegion",
    "SilentRegion",
    "PTVRegion",
    "DamagingMissenseRegion",
    "MissenseRegion",
    "NoncodingRegion",
    "SpliceSiteRegion",
    "IntronRegion",
    "PromoterRegion",
    "IntergenicRegion",
    "5PrimeUTRsRegion",
    "3PrimeUTRsRegion",
    "lincRnaRegion",
    "OtherTranscriptRegion",
)

# Fixed values: (variant_type, gencode) pairs whose categories are redundant.
REDUNDANT_TYPE_GENCODE = (
    ("All", "FrameshiftRegion"),
    ("All", "InFrameRegion"),
    ("All", "DamagingMissenseRegion"),
    ("All", "MissenseRegion"),
    ("All", "SilentRegion"),
    ("Indel", "DamagingMissenseRegion"),
    ("Indel", "MissenseRegion"),
    ("Indel", "SilentRegion"),
    ("SNV", "FrameshiftRegion"),
    ("SNV", "InFrameRegion"),
)

# Fixed values: (gene_set, gencode) pairs whose categories are redundant.
REDUNDANT_GENESET_GENCODE = (
    ("Any", "CodingRegion"),
    ("Any", "FrameshiftRegion"),
    ("Any", "InFrameRegion"),
    ("Any", "PTVRegion"),
    ("Any", "DamagingMissenseRegion"),
    ("Any", "MissenseRegion"),
    ("Any", "SilentRegion"),
    ("Any", "lincRnaRegion"),
    ("lincRNA", "Any"),
)

# Gencode groups behind the is_* region flags.
CODING_TERMS = (
    "CodingRegion",
    "MissenseRegion",
    "SilentRegion",
    "PTVRegion",
    "InFrameRegion",
    "DamagingMissenseRegion",
    "FrameshiftRegion",
)
NONCODING_TERMS = (
    "NoncodingRegion",
    "IntronRegion",
    "lincRnaRegion",
    "IntergenicRegion",
    "OtherTranscriptRegion",
    "PromoterRegion",
    "3PrimeUTRsRegion",
    "5PrimeUTRsRegion",
    "SpliceSiteRegion",
)
REGION_FLAGS = {
    "is_coding": CODING_TERMS,
    "is_coding_no_ptv": ("MissenseRegion", "SilentRegion", "InFrameRegion", "DamagingMissenseRegion"),
    "is_PTV": ("PTVRegion",),
    "is_missense": ("MissenseRegion",),
    "is_damaging_missense": ("DamagingMissenseRegion",),
    "is_noncoding": NONCODING_TERMS,
    "is_noncoding_wo_promoter": (
        "IntronRegion",
        "lincRnaRegion",
        "IntergenicRegion",
        "OtherTranscriptRegion",
        "3PrimeUTRsRegion",
        "5PrimeUTRsRegion",
        "SpliceSiteRegion",
    ),
    "is_promoter": ("PromoterRegion",),
    "is_splice": ("SpliceSiteRegion",),
    "is_intron": ("IntronRegion",),
    "is_intergenic": ("IntergenicRegion",),
    "is_3primeUTR": ("3PrimeUTRsRegion",),
    "is_5primeUTR": ("5PrimeUTRsRegion",),
    "is_UTR": ("3PrimeUTRsRegion", "5PrimeUTRsRegion"),
    "is_lincRNA": ("lincRnaRegion",),
}

# The gencode groups that burden shift pairs with other terms.
SHIFT_GROUPS = (
    "coding",
    "noncoding",
    "promoter",
    "3primeUTR",
    "5primeUTR",
    "splice",
    "intergenic",
    "intron",
    "lincRNA",
)


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


@dataclass(frozen=True)
class CategoryDomain:
    """Ordered terms of each dimension, and a dense integer code for every category.

    A category code is the mixed-radix index of its five term positions, so categories travel
    through shuffles as one BIGINT and are spelled out only in results.
    """

    gene_sets: tuple[str, ...]
    scores: tuple[str, ...] = ()
    annotations: tuple[str, ...] = ()
    terms: dict[str, tuple[str, ...]] = field(init=False)

    def __post_init__(self):
        terms = {
            "variant_type": VARIANT_TYPES,
            "gene_set": ("Any", *self.gene_sets),
            "functional_score": ("All", *self.scores),
            "gencode": GENCODE_TERMS,
            "functional_annotation": ("Any", *self.annotations),
        }
        for name, values in terms.items():
            if len(set(values)) != len(values):
                raise ValueError(f"duplicate terms in {name}")
        object.__setattr__(self, "terms", terms)

    @property
    def tracks(self) -> tuple[str, ...]:
        """Interval tracks in mask order: scores first, then annotations."""
        return (*self.scores, *self.annotations)

    @property
    def size(self) -> int:
        total = 1
        for name in DIMENSIONS:
            total *= len(self.terms[name])
        return total

    def stride(self, name: str) -> int:
        """Code distance between neighbouring terms of a dimension."""
        later = DIMENSIONS[DIMENSIONS.index(name) + 1:]
        value = 1
        for other in later:
            value *= len(self.terms[other])
        return value

    def redundant_prefixes(self) -> list[int]:
        """Summed variant type, gene set and gencode places of every redundant combination."""
        places = {
            name: {term: i * self.stride(name) for i, term in enumerate(self.terms[name])}
            for name in ("variant_type", "gene_set", "gencode")
        }
        by_type, by_gene = set(REDUNDANT_TYPE_GENCODE), set(REDUNDANT_GENESET_GENCODE)
        return [
            a + b + c
            for vt, a in places["variant_type"].items()
            for gs, b in places["gene_set"].items()
            for gc, c in places["gencode"].items()
            if (vt, gc) in by_type or (gs, gc) in by_gene
        ]

    def position(self, name: str, term: Column) -> Column:
        """Place of a term in its dimension; null for an unknown term."""
        return F.nullif(F.array_position(literal_array(self.terms[name]), term), F.lit(0).cast("bigint")) - F.lit(1)

    def parse_key(self, key: Column) -> list[Column]:
        """The five terms of a key by the terms of the domain, which may hold underscores; null where it is no key."""
        choices = ("|".join(re.escape(t) for t in sorted(self.terms[n], key=len, reverse=True)) for n in DIMENSIONS)
        pattern = "^" + "_".join(f"({c})" for c in choices) + "$"
        return [F.when(key.rlike(pattern), F.regexp_extract(key, pattern, i + 1)).alias(n) for i, n in enumerate(DIMENSIONS)]

    def encode(self, *columns: Column) -> Column:
        """Category code from five term columns given in DIMENSIONS order."""
        code = F.lit(0).cast("bigint")
        for name, column in zip(DIMENSIONS, columns):
            code = code * F.lit(len(self.terms[name])) + self.position(name, column)
        return code

    def decode(self, code: Column) -> list[Column]:
        """Five aliased term columns from a category code."""
        columns = []
        stride = self.size
        for name in DIMENSIONS:
            radix = len(self.terms[name])
            stride //= radix
            digit = F.floor(code / F.lit(stride)) % F.lit(radix)
            columns.append(F.element_at(literal_array(self.terms[name]), (digit + 1).cast("int")).alias(name))
        return columns

    def key(self, code: Column) -> Column:
        """Category key text: the five terms joined by underscores."""
        return F.concat_ws("_", *self.decode(code))


def category_key() -> Column:
    return F.concat_ws("_", *DIMENSIONS)


def split_category_key(key: Column) -> list[Column]:
    parts = F.split(key, "_")
    return [parts[i].alias(name) for i, name in enumerate(DIMENSIONS)]


def is_redundant(variant_type: Column, gene_set: Column, gencode: Column) -> Column:
    """True when the terms contain one of the redundant pairs."""
    by_type: dict[str, list[str]] = {}
    for left, right in REDUNDANT_TYPE_GENCODE:
        by_type.setdefault(left, []).append(right)
    by_gene: dict[str, list[str]] = {}
    for left, right in REDUNDANT_GENESET_GENCODE:
        by_gene.setdefault(left, []).append(right)
    rule = F.lit(False)
    for left, rights in by_type.items():
        rule = rule | ((variant_type == left) & gencode.isin(rights))
    for left, rights in by_gene.items():
        rule = rule | ((gene_set == left) & gencode.isin(rights))
    return rule


def region_flags(gencode: Column, gene_set: Column) -> list[Column]:
    """The is_* flags of a category."""
    flags = []
    for name, members in REGION_FLAGS.items():
        test = gencode.isin(list(members))
        if name == "is_lincRNA":
            test = test | (gene_set == "lincRNA")
        flags.append(test.cast("int").alias(name))
    return flags
