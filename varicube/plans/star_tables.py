"""The burden data model over the star-schema tables: a variant is a line item, a sample is a customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varicube.domain import CategoryDomain
from varicube.functions.annotate import with_gene_sets, with_shape, with_terms
from varicube.session import spread

DOMAIN = CategoryDomain(
    gene_sets=("ProteinCoding", "lincRNA", "Constrained"),
    scores=("Conserved",),
    annotations=("Enhancer", "OpenChromatin"),
)
SCORE_COLUMN = "MisDb_MPC"
SCORE_THRESHOLD = 5.0

# Consequence words by (7 * line number + priority digit) modulo their number.
CONSEQUENCES = (
    "stop_gained",
    "missense_variant",
    "synonymous_variant",
    "intron_variant",
    "intergenic_variant",
    "frameshift_variant",
    "inframe_deletion",
    "upstream_gene_variant",
    "splice_region_variant&intron_variant",
    "3_prime_UTR_variant",
    "5_prime_UTR_variant",
    "downstream_gene_variant",
    "stop_retained_variant",
    "non_coding_transcript_exon_variant",
    "missense_variant&splice_region_variant",
    "protein_altering_variant",
    "3_prime_UTR_variant&5_prime_UTR_variant",
)


LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def variants(spark: SparkSession, sf_dir: str, owner: DataFrame | None = None) -> DataFrame:
    """One row per line item; ``owner`` adds its further columns by ``o_custkey``, null where it has no such key."""
    # What lines decide alone is decided before they meet the orders, so that few bytes travel.
    mask = (
        F.when(F.col("l_tax") >= 0.05, 1).otherwise(0)
        + F.when(F.month("l_shipdate") <= 3, 2).otherwise(0)
        + F.when(F.col("l_suppkey") % 4 == 0, 4).otherwise(0)
    )
    lines = spread(table(spark, sf_dir, "lineitem").select(*LINE_COLUMNS)).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus",
        (F.col("l_quantity") <= 25).alias("snv"),
        F.bround(F.col("l_discount") * 100, 0).cast("int").alias("hundredths"),
        mask.cast("bigint").alias("mask"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("digit")
    )
    added = [c for c in owner.columns if c != "o_custkey"] if owner is not None else []
    if owner is not None:  # at the orders, which are a fraction of the lines
        orders = orders.join(owner, "o_custkey", "left")
    joined = lines.join(orders, "l_orderkey")
    snv = F.col("snv")
    odd = F.col("l_linenumber") % 2 == 1
    words = F.array(*[F.lit(c) for c in CONSEQUENCES])
    pick = (F.col("l_linenumber") * 7 + F.col("digit")) % len(CONSEQUENCES) + 1
    score = F.col("hundredths").cast("string")
    return joined.select(
        F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("SAMPLE"),
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 22 + 1).cast("string")).alias("CHROM"),
        F.floor("l_extendedprice").cast("bigint").alias("POS"),
        F.when(snv | ~odd, "A").otherwise("ACGT").alias("REF"),
        F.when(snv, "G").when(odd, "A").otherwise("ACC").alias("ALT"),
        F.element_at(words, pick).alias("Consequence"),
        F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("SYMBOL"),
        F.concat(F.lit("G"), F.col("l_suppkey").cast("string")).alias("NEAREST"),
        F.when(F.col("l_linestatus") == "F", "HC").otherwise("LC").alias("LoF"),
        F.when(F.col("l_returnflag") == "A", "SINGLE_EXON")
        .when(F.col("l_returnflag") == "R", "PHYLOCSF_WEAK")
        .otherwise("")
        .alias("LoF_flags"),
        F.when(F.col("l_linenumber") == 7, "")
        .when(score == "0", "NA")
        .when(odd, F.concat(F.lit("1&"), score))
        .otherwise(score)
        .alias(SCORE_COLUMN),
        F.col("mask").alias("ANNOT"),
        *added,
    )


def gene_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide 0/1 gene matrix, one row per part."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("gene_id"),
        F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene_name"),
        F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO", "MEDIUM").cast("int").alias("ProteinCoding"),
        (F.col("p_type") == "SMALL").cast("int").alias("lincRNA"),
        (F.col("p_size") >= 40).cast("int").alias("Constrained"),
    )


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = gene_matrix(spark, sf_dir)
    names = F.array_compact(F.array(*[F.when(F.col(g) == 1, F.lit(g)) for g in DOMAIN.gene_sets]))
    return matrix.select("gene_name", names.alias("gene_sets"))


def phenotype():
    return F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "case").otherwise("ctrl")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that own at least one variant."""
    customer = table(spark, sf_dir, "customer")
    owners = (
        table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
        .join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
        .select(F.col("o_custkey").alias("c_custkey")).distinct()
    )
    return customer.join(owners, "c_custkey", "left_semi").select(
        F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("SAMPLE"),
        phenotype().alias("PHENOTYPE"),
        F.concat(F.lit("F"), F.floor(F.col("c_custkey") / 2).cast("string")).alias("FAMILY"),
    )


def adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor per sample; a decimal, so sums do not depend on their order."""
    customer = table(spark, sf_dir, "customer")
    factor = (1 + F.floor(F.col("c_acctbal")) / 10000).cast("decimal(12,4)")
    return customer.select(
        F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("SAMPLE"), factor.alias("AdjustFactor")
    )


def termed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = with_gene_sets(with_shape(variants(spark, sf_dir), SCORE_COLUMN, SCORE_THRESHOLD), gene_sets(spark, sf_dir))
    return with_terms(located, DOMAIN, SCORE_COLUMN, SCORE_THRESHOLD)


def labelled_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``termed_variants`` with ``cases`` and ``ctrls``: how often the sample is listed as either."""
    case = phenotype() == "case"
    listed = table(spark, sf_dir, "customer").where(F.col("c_custkey").isNotNull()).groupBy(F.col("c_custkey").alias("o_custkey")).agg(
        F.count_if(case).alias("cases"), F.count_if(~case).alias("ctrls")
    )
    rows = with_shape(variants(spark, sf_dir, listed).fillna(0, ["cases", "ctrls"]), SCORE_COLUMN, SCORE_THRESHOLD)
    return with_terms(with_gene_sets(rows, gene_sets(spark, sf_dir)), DOMAIN, SCORE_COLUMN, SCORE_THRESHOLD)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval tracks: one per event type, minutes since the first day; the user picks the chromosome."""
    events = table(spark, sf_dir, "events")
    minute = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(1704067200)) / 60)
    names = F.array(*[F.lit(t) for t in EVENT_TRACKS])
    start = minute.cast("bigint")
    length = F.floor("value").cast("bigint") + 1
    return events.where(F.col("event_type").isin(*EVENT_TRACKS)).select(
        F.concat(F.lit("chr"), (F.col("user_id") % 22 + 1).cast("string")).alias("chrom"),
        start.alias("start"),
        (start + length).alias("end"),
        (F.array_position(names, F.col("event_type")) - 1).cast("int").alias("track"),
    )


EVENT_TRACKS = ("click", "error", "purchase", "signup", "view")
