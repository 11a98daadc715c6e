"""Registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varicube.domain import DIMENSIONS, REDUNDANT_GENESET_GENCODE, REDUNDANT_TYPE_GENCODE, category_key, region_flags, split_category_key
from varicube.functions import annotate, stats
from varicube.functions.scalars import divide, half_even
from varicube.operators import (
    burden, communities, cube, extract, gram, grid, intervals, keys, netfit, network, ordered, permutation, risk, shift, spectrum,
)
from varicube.plans import model
from varicube.plans import star_tables as star
from varicube.session import checkpoint_folder, cut_lineage, stored
from varicube.sources import bgzf, tables, vcf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DOMAIN = star.DOMAIN
ROW = ("SAMPLE", "CHROM", "POS", "REF", "ALT", "Consequence")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def text(array) -> F.Column:
    return F.array_join(F.array_sort(array), ",")


def r6(column, name: str):
    return F.round(column.cast("double"), 6).alias(name)


# ---- scans and parsing -------------------------------------------------------------------------


@query
def scan_samples(spark, sf):
    return star.samples(spark, sf)


@query
def info_parse_kv(spark, sf):
    """INFO text rebuilt from the tables, then parsed; RULE's value contains ``=`` and DB is a flag."""
    rows = star.variants(spark, sf).select(
        *ROW,
        F.concat(
            F.lit("SAMPLE="), "SAMPLE", F.lit(";RULE=SYM="), "SYMBOL", F.lit(";DB;ANNOT="), F.col("ANNOT").cast("string")
        ).alias("INFO"),
    )
    info = vcf.info_map(F.col("INFO"))
    return rows.withColumn("info", info).select(
        "POS", "Consequence",
        F.col("info")["SAMPLE"].alias("info_sample"),
        F.col("info")["RULE"].alias("info_rule"),
        F.col("info")["ANNOT"].cast("bigint").alias("info_annot"),
        F.map_contains_key("info", "DB").cast("int").alias("has_db"),
    )


@query
def csq_positional_split(spark, sf):
    fields = ("Consequence", "SYMBOL", "NEAREST", "LoF", "LoF_flags", star.SCORE_COLUMN)
    rows = star.variants(spark, sf).select("SAMPLE", "POS", F.concat_ws("|", *fields).alias("CSQ"))
    return rows.select("SAMPLE", "POS", *vcf.csq_columns(F.col("CSQ"), fields))


@query
def gene_matrix_sets(spark, sf):
    return star.gene_sets(spark, sf).select("gene_name", text("gene_sets").alias("gene_sets"))


@query
def gene_keep_last(spark, sf):
    """Names repeat across parts; the last row of a name wins (a max_by, so a hot name pre-aggregates)."""
    part = star.table(spark, sf, "part")
    last = F.max_by(F.struct("p_partkey", "p_type", "p_size"), "p_partkey")
    kept = part.groupBy(F.col("p_name").alias("gene_name")).agg(last.alias("last"))
    return kept.select("gene_name", F.col("last.p_partkey").alias("gene_id"), F.col("last.p_type").alias("p_type"), F.col("last.p_size").alias("p_size"))


@query
def mask_bits(spark, sf):
    return star.variants(spark, sf).select("SAMPLE", "POS", "ANNOT", *annotate.mask_columns(F.col("ANNOT"), DOMAIN.tracks))


# ---- projections -------------------------------------------------------------------------------


@query
def variant_type(spark, sf):
    return star.variants(spark, sf).select(*ROW, annotate.variant_type(F.col("REF"), F.col("ALT")).alias("variant_type"))


@query
def variant_class(spark, sf):
    return star.variants(spark, sf).select(*ROW, annotate.variant_class(F.col("REF"), F.col("ALT")).alias("class"))


@query
def effective_gene(spark, sf):
    gene = annotate.effective_gene(F.col("Consequence"), F.col("SYMBOL"), F.col("NEAREST"))
    return star.variants(spark, sf).select(*ROW, gene.alias("gene"))


@query
def gene_left_join(spark, sf):
    """Variants with the 0/1 gene-set columns of their effective gene, 0 for unknown genes."""
    gene = annotate.effective_gene(F.col("Consequence"), F.col("SYMBOL"), F.col("NEAREST"))
    matrix = star.gene_matrix(spark, sf).drop("gene_id")
    # Every third gene name gets a suffix that no gene has, so some variants find none.
    missing = F.when(F.col("POS") % 3 == 0, F.concat(gene, F.lit(".1"))).otherwise(gene)
    joined = star.variants(spark, sf).withColumn("gene_name", missing).join(matrix, "gene_name", "left")
    return joined.select(*ROW, *[F.coalesce(F.col(g), F.lit(0)).alias(g) for g in DOMAIN.gene_sets])


@query
def gene_set_terms(spark, sf):
    return star.termed_variants(spark, sf).select(*ROW, text("gs").alias("gene_set"))


@query
def gencode_cascade(spark, sf):
    return star.termed_variants(spark, sf).select(*ROW, "LoF", "LoF_flags", star.SCORE_COLUMN, text("gc").alias("gencode"))


@query
def damaging_missense(spark, sf):
    score = F.col(star.SCORE_COLUMN)
    return star.variants(spark, sf).select(
        *ROW, score,
        annotate.missense_score(score).alias("score"),
        annotate.is_damaging(score, star.SCORE_THRESHOLD).cast("int").alias("damaging"),
    )


@query
def track_terms(spark, sf):
    return star.termed_variants(spark, sf).select(
        *ROW, "ANNOT", text("fs").alias("functional_score"), text("fa").alias("functional_annotation")
    )


@query
def category_keys(spark, sf):
    """Key text built from five columns and split back into them."""
    found = cube.category_universe(model.totals(spark, sf), DOMAIN)
    built = found.select(category_key().alias("Category"))
    return built.select("Category", *split_category_key(F.col("Category")))


@query
def category_key_codes(spark, sf):
    """Categories written as text by key, read back by key and by their five columns, and decoded again."""
    found = cube.category_universe(model.totals(spark, sf), DOMAIN)
    path = f"{checkpoint_folder(spark)}/keys-{uuid.uuid4().hex}"
    tables.write_table(found.select("Category", *DIMENSIONS), path)
    stored = tables.read_table(spark, path)
    by_key = tables.with_codes(stored.select("Category"), DOMAIN).select("Category", "code")
    by_terms = tables.with_codes(stored, DOMAIN).select("Category", F.col("code").alias("code_by_terms"))
    both = by_key.join(by_terms, "Category")
    return both.select("Category", "code", "code_by_terms", DOMAIN.key(F.col("code")).alias("again"))


@query
def bed_text_roundtrip(spark, sf):
    """Interval tracks written as four-column text with header lines and read back, one contig at a time and all."""
    path = f"{checkpoint_folder(spark)}/bed-{uuid.uuid4().hex}"
    rows = star.tracks(spark, sf)
    lines = rows.select(F.concat_ws("\t", "chrom", "start", "end", F.concat(F.lit("track"), F.col("track").cast("string"))).alias("value"))
    heads = spark.createDataFrame([("#chrom\tstart\tend\tname",), ("track name=x",), ("chrom\tchromStart\tchromEnd\tname",), ("",)], "value string")
    heads.unionByName(lines).write.text(path)
    every = tables.read_intervals(spark, path).withColumn("asked", F.lit("all"))
    return every.unionByName(tables.read_intervals(spark, path, "chr7").withColumn("asked", F.lit("chr7")))


@query
def indexed_contig_scan(spark, sf):
    """Interval tracks written as blocked gzip and read back: all, one contig through the index, and one that is not there."""
    path = f"{checkpoint_folder(spark)}/blocked-{uuid.uuid4().hex}"
    rows = star.tracks(spark, sf)
    line = F.concat_ws("\t", "chrom", "start", "end", F.concat(F.lit("track"), F.col("track").cast("string")))
    bgzf.write_lines(rows.select(F.col("chrom").alias("contig"), "start", line.alias("value")), path, "start", header=["#chrom\tstart\tend\tname"])

    def asked(name: str, contig: str | None) -> DataFrame:
        return tables.read_intervals(spark, path, contig).withColumn("asked", F.lit(name))

    return asked("all", None).unionByName(asked("chr7", "chr7")).unionByName(asked("chrUn", "chrUn"))


@query
def region_flag_table(spark, sf):
    found = cube.category_universe(model.totals(spark, sf), DOMAIN)
    return found.select("Category", *DIMENSIONS, *region_flags(F.col("gencode"), F.col("gene_set")))


@query
def extract_region_flags(spark, sf):
    rows = annotate.with_gene_sets(star.variants(spark, sf), star.gene_sets(spark, sf))
    return rows.select(*ROW, *extract.flag_columns(star.SCORE_COLUMN, star.SCORE_THRESHOLD))


# ---- filters -----------------------------------------------------------------------------------


def _open_cube(spark, sf):
    """Category totals before the redundant pairs are removed."""
    rows = cube.signatures(star.termed_variants(spark, sf), [])
    for array, name in zip(cube.TERM_ARRAYS, ("variant_type", "gene_set", "functional_score", "gencode", "functional_annotation")):
        rows = rows.withColumn(name, F.explode_outer(array)).drop(array)
    return rows.groupBy(*DIMENSIONS).agg(F.sum("n").alias("n"))


@query
def redundant_exclusion(spark, sf):
    return cube.drop_redundant(_open_cube(spark, sf))


@query
def redundant_rule_table(spark, sf):
    """The same exclusion from a rule table with ``*`` wildcards."""
    star_row = {d: "*" for d in DIMENSIONS}
    rules = [{**star_row, "variant_type": a, "gencode": b} for a, b in REDUNDANT_TYPE_GENCODE]
    rules += [{**star_row, "gene_set": a, "gencode": b} for a, b in REDUNDANT_GENESET_GENCODE]
    table = spark.createDataFrame([tuple(r[d] for d in DIMENSIONS) for r in rules], list(DIMENSIONS))
    return cube.drop_by_rule_table(_open_cube(spark, sf), table)


@query
def count_threshold(spark, sf):
    kept = model.totals(spark, sf).where(F.col("n") >= 100)
    return model.keyed(kept).withColumnRenamed("n", "Raw_counts")


@query
def auto_threshold(spark, sf):
    """Categories passing the smallest informative count under the cohort's case share."""
    size = burden.cohort(star.samples(spark, sf))
    cut = stats.count_threshold(size.case_share)
    kept = model.totals(spark, sf).where(F.col("n") >= cut)
    return model.keyed(kept).select("Category", F.col("n").alias("Raw_counts"), F.lit(cut).cast("bigint").alias("threshold"))


@query
def rare_categories(spark, sf):
    listed = model.sums(spark, sf).where("listed > 0").select("code", F.col("Ctrl_DNV_Count").alias("ctrl_count"))
    return model.keyed(listed.where("ctrl_count < 50")).select("Category", "ctrl_count")


@query
def significant_categories(spark, sf):
    table, _ = model.tested(spark, sf)
    return model.keyed(burden.significant(table, 0.05)).select("Category", "direction", r6(F.col("P"), "P"))


@query
def category_set_extract(spark, sf):
    """Variants of a category set: one join on the category, not one filter per category."""
    wanted = model.totals(spark, sf).where(F.col("n") <= 40)
    rows = star.termed_variants(spark, sf)
    found = extract.by_category_set(rows, wanted.select("code"), DOMAIN)
    return found.select("CHROM", "POS", "REF", "ALT", "SAMPLE", DOMAIN.key(F.col("code")).alias("CATEGORY"))


# ---- joins -------------------------------------------------------------------------------------


def _segments(spark, sf):
    return intervals.coverage_segments(star.tracks(spark, sf), len(star.EVENT_TRACKS), bin_width=4096)


@query
def bed_merge(spark, sf):
    return _segments(spark, sf)


@query
def interval_overlap_or(spark, sf):
    """Mask of every distinct variant region that meets a segment."""
    rows = star.variants(spark, sf)
    start, end = intervals.region_of(F.col("POS"), F.col("REF"), F.col("ALT"))
    regions = rows.select(F.col("CHROM").alias("chrom"), start.alias("r_start"), end.alias("r_end"))
    return intervals.overlap_masks(regions, _segments(spark, sf), bin_width=512)


@query
def interval_overlap_left0(spark, sf):
    rows = star.variants(spark, sf).select("SAMPLE", "CHROM", "POS", "REF", "ALT")
    return intervals.annotate_overlaps(rows, _segments(spark, sf), bin_width=512)


@query
def contig_filter(spark, sf):
    """Intervals of one contig; an unknown contig gives no rows."""
    tracks = star.tracks(spark, sf)
    return tracks.where(F.col("chrom") == "chr7").unionByName(tracks.where(F.col("chrom") == "chrUn"))


@query
def phenotype_join(spark, sf):
    n = F.aggregate("counts", F.lit(0).cast("bigint"), lambda total, x: total + x)
    own = model.sample_rows(spark, sf).select("SAMPLE", n.alias("n"), F.size("codes").cast("bigint").alias("n_categories"))
    joined = own.join(star.samples(spark, sf), "SAMPLE")  # a sample's categories are added up before they meet its labels
    return joined.groupBy("SAMPLE", "PHENOTYPE").agg(F.sum("n").alias("n"), F.sum("n_categories").alias("n_categories"))


@query
def adjusted_counts(spark, sf):
    rows = burden.adjusted(model.counts(spark, sf), star.adjustment(spark, sf))
    return model.keyed(rows).select("SAMPLE", "Category", "n", r6(F.col("adjusted"), "adjusted"))


@query
def semi_categories(spark, sf):
    chosen = cut_lineage(model.totals(spark, sf).where(F.col("n") >= 500).select("code"))  # at most the domain's categories
    kept = model.counts(spark, sf).join(chosen, "code", "left_semi")
    return model.keyed(kept.groupBy("code").agg(F.count(F.lit(1)).alias("n_samples"), F.max("n").alias("max_n")))


@query
def sample_set_equality(spark, sf):
    """Customers without variants appear as mismatched keys."""
    people = star.table(spark, sf, "customer").select(F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("SAMPLE"))
    active = star.variants(spark, sf).select("SAMPLE")
    return keys.key_mismatch(active, people, "SAMPLE")


def _variant_pairs(spark, sf):
    rows = cube.signature_codes(cube.signatures(star.termed_variants(spark, sf), []), DOMAIN)
    return cut_lineage(gram.both_triangles(gram.co_occurrence(rows, DOMAIN.size, weight="n")))


def _sample_pairs(spark, sf, rows=None):
    rows = (model.sample_rows(spark, sf) if rows is None else rows).select("SAMPLE", "codes")
    return cut_lineage(gram.both_triangles(gram.co_occurrence(rows, DOMAIN.size, salt="SAMPLE")))


def _pair_keys(frame):
    return frame.select(
        DOMAIN.key(F.col("code_i")).alias("category_i"), DOMAIN.key(F.col("code_j")).alias("category_j"), "*"
    ).drop("code_i", "code_j")


@query
def cooccur_variant(spark, sf):
    return _pair_keys(_variant_pairs(spark, sf))


@query
def cooccur_sample(spark, sf):
    return _pair_keys(_sample_pairs(spark, sf))


@query
def setname_match(spark, sf):
    names = shift.category_sets(cube.category_universe(model.totals(spark, sf), DOMAIN)).select("category_set").distinct()
    return keys.token_set_match(names, "category_set", "Enhancer&coding").unionByName(
        keys.token_set_match(names, "category_set", "Constrained&OpenChromatin")
    )


# ---- aggregations ------------------------------------------------------------------------------


@query
def category_counts(spark, sf):
    rows = model.counts(spark, sf)
    return rows.select("SAMPLE", *DOMAIN.decode(F.col("code")), "n")


@query
def category_matrix_dense(spark, sf):
    """One row per sample, a column position per category in key order, zeros included."""
    rows = stored(model.sample_rows(spark, sf))
    found = cube.category_universe(cube.long_counts(rows), DOMAIN).orderBy("Category").select("code").collect()
    dense = cube.dense_rows(rows, [r[0] for r in found])
    return dense.select("SAMPLE", F.array_join(F.transform("counts", lambda v: v.cast("string")), ",").alias("counts"))


@query
def cohort_sizes(spark, sf):
    return burden.cohort_sizes(star.samples(spark, sf))


@query
def case_ctrl_counts(spark, sf):
    table = burden.case_control(model.counts(spark, sf), star.samples(spark, sf), F.col("n"))
    return model.keyed(table).select(
        "Category", F.col("Case_DNV_Count").cast("bigint").alias("Case_DNV_Count"), F.col("Ctrl_DNV_Count").cast("bigint").alias("Ctrl_DNV_Count")
    )


@query
def carrier_counts(spark, sf):
    table = burden.case_control(model.counts(spark, sf), star.samples(spark, sf), F.col("n"))
    return model.keyed(table).select("Category", "Case_Carrier_Count", "Ctrl_Carrier_Count")


@query
def raw_adj_counts(spark, sf):
    rows = burden.adjusted(model.counts(spark, sf), star.adjustment(spark, sf))
    return model.keyed(burden.raw_and_adjusted(rows, F.col("adjusted"))).select("Category", "Raw_counts", r6(F.col("Adj_counts"), "Adj_counts"))


@query
def burden_relative_risk(spark, sf):
    table, _ = model.risk_table(spark, sf)
    return cube.spell_out(table, DOMAIN).select(
        "Category", *DIMENSIONS,
        F.col("Case_DNV_Count").cast("bigint").alias("Case_DNV_Count"),
        F.col("Ctrl_DNV_Count").cast("bigint").alias("Ctrl_DNV_Count"),
        r6(F.col("Relative_Risk"), "Relative_Risk"),
    )


@query
def carrier_relative_risk(spark, sf):
    table, _ = model.risk_table(spark, sf, carriers=True)
    return model.keyed(table).select("Category", "Case_Carrier_Count", "Ctrl_Carrier_Count", r6(F.col("Relative_Risk"), "Relative_Risk"))


@query
def adjusted_relative_risk(spark, sf):
    """Relative risk of adjusted counts."""
    people = star.samples(spark, sf)
    rows = burden.adjusted(model.counts(spark, sf), star.adjustment(spark, sf))
    table = burden.burden_table(rows, people, burden.cohort(people), F.col("adjusted"))
    return model.keyed(table).select("Category", *[r6(F.col(c), c) for c in ("Case_DNV_Count", "Ctrl_DNV_Count", "Relative_Risk")])


@query
def category_universe(spark, sf):
    return cube.category_universe(model.totals(spark, sf), DOMAIN).select("Category", *DIMENSIONS)


def _clusters(spark, sf, raw=None):
    """Categories clustered by gencode region (1-based), a stand-in for fitted clusters; ``raw`` has their codes."""
    found = cube.category_universe(model.totals(spark, sf) if raw is None else raw, DOMAIN)
    return found.select("code", "Category", (DOMAIN.position("gencode", F.col("gencode")) + 1).cast("int").alias("cluster"))


@query
def cluster_sizes(spark, sf):
    table, raw, _ = model.tested_and_raw(spark, sf)
    members = network.prepare_members(table.join(raw, "code").join(_clusters(spark, sf, raw).drop("Category"), "code"), 20)
    return network.cluster_sizes(members).select("cluster", F.col("size").cast("bigint").alias("size"))


@query
def block_mean(spark, sf):
    corr = gram.correlation(_sample_pairs(spark, sf))
    means = network.block_means(corr, _clusters(spark, sf), "corr")
    return means.select("cluster_i", "cluster_j", r6(F.col("mean_corr"), "mean_corr"))


@query
def cluster_graph_edges(spark, sf):
    corr = gram.correlation(_sample_pairs(spark, sf))
    edges = network.graph_edges(network.block_means(corr, _clusters(spark, sf), "corr"), 0.12)
    return edges.select("src", "dst", r6(F.col("weight"), "weight"))


@query
def token_mode(spark, sf):
    """Most frequent terms of each cluster's category names."""
    return network.representative_terms(_clusters(spark, sf))


# ---- order-dependent ---------------------------------------------------------------------------


@query
def cum_share_99(spark, sf):
    """Leading categories that together hold 99 % of all counts."""
    raw = model.totals(spark, sf)
    placed = ordered.cumulative_share(raw, "n", "code")
    return model.keyed(placed.where((F.col("share") - F.col("n") / raw.agg(F.sum("n")).first()[0]) < 0.99)).select(
        "Category", "n", "position", r6(F.col("share"), "share")
    )


@query
def local_fdr(spark, sf):
    table, _ = model.tested(spark, sf)
    rows = table.select("code", F.round("P_1side", 6).alias("posterior"))
    placed = ordered.running_mean(rows, "posterior", "code", "local_fdr")
    return model.keyed(placed).select("Category", r6(F.col("local_fdr"), "local_fdr"))


@query
def bh_fdr(spark, sf):
    table, _ = model.tested(spark, sf)
    rows = table.select("code", F.round("P", 6).alias("P"))
    return model.keyed(ordered.benjamini_hochberg(rows, "P", "code")).select("Category", "P", r6(F.col("FDR"), "FDR"))


@query
def version_sorted_variants(spark, sf):
    """Position of each distinct site in chromosome version order."""
    sites = star.variants(spark, sf).select("CHROM", "POS").distinct().withColumn("rank", vcf.chromosome_rank(F.col("CHROM")))
    return ordered.with_ordinal(sites, "rank", "CHROM", "POS").select("CHROM", "POS", "ordinal")


# ---- set operations ----------------------------------------------------------------------------


def _gencode_of(spark, sf, snv: bool):
    rows = star.termed_variants(spark, sf).where((annotate.variant_type(F.col("REF"), F.col("ALT")) == "SNV") == snv)
    return rows.select(F.explode("gc").alias("gencode"), F.element_at("gs", -1).alias("gene_set")).distinct()


@query
def category_intersect(spark, sf):
    return _gencode_of(spark, sf, True).intersect(_gencode_of(spark, sf, False))


@query
def category_except(spark, sf):
    return _gencode_of(spark, sf, True).exceptAll(_gencode_of(spark, sf, True).where(F.col("gene_set") == "Any"))


@query
def category_union(spark, sf):
    return _gencode_of(spark, sf, True).union(_gencode_of(spark, sf, False)).distinct()


# ---- statistics --------------------------------------------------------------------------------


@query
def binomial_burden(spark, sf):
    """Two-sided and one-sided exact P and the z-score of every category."""
    table, _ = model.tested(spark, sf)
    return model.keyed(table).select("Category", *[r6(F.col(c), c) for c in ("P", "P_1side", "Z_1side")])


@query
def binomial_burden_adjusted(spark, sf):
    """The exact test on adjusted counts, rounded half to even."""
    people = star.samples(spark, sf)
    size = burden.cohort(people)
    rows = burden.adjusted(model.counts(spark, sf), star.adjustment(spark, sf))
    table = burden.burden_table(rows, people, size, F.col("adjusted"))
    tested = burden.binomial_test(table, size, "Case_DNV_Count", "Ctrl_DNV_Count")
    return model.keyed(tested).select(
        "Category",
        half_even(F.col("Case_DNV_Count").cast("double")).cast("bigint").alias("n1"),
        half_even(F.col("Ctrl_DNV_Count").cast("double")).cast("bigint").alias("n2"),
        r6(F.col("P"), "P"),
    )


@query
def volcano_points(spark, sf):
    table, raw, size = model.tested_and_raw(spark, sf)
    points = burden.volcano(table, raw, stats.count_threshold(size.case_share))
    return model.keyed(points).select("Category", r6(F.col("x"), "x"), r6(F.col("P"), "P"))


TRIALS = 20


@query
def permutation_risk(spark, sf):
    given = model.Inputs(spark, sf)
    risks = permutation.permuted_risk(given.permuted(TRIALS), given.size)
    return model.keyed(risks).select("trial", "Category", "case_n", "ctrl_n", r6(F.col("perm_rr"), "perm_rr"))


@query
def permutation_carriers(spark, sf):
    return model.keyed(model.Inputs(spark, sf).permuted(TRIALS, carriers=True))


@query
def permutation_pvalue(spark, sf):
    given = model.Inputs(spark, sf)
    result = permutation.permutation_p(permutation.permuted_risk(given.permuted(TRIALS), given.size), given.table(), TRIALS)
    return model.keyed(result).select("Category", "n_extreme", r6(F.col("P"), "P"))


@query
def permutation_two_stage(spark, sf):
    """Low P values are refined with three times the trials."""
    given = model.Inputs(spark, sf)
    result = permutation.two_stage_p(
        given.counts, given.people, given.size, cut_lineage(given.table()), TRIALS, DOMAIN.size, F.col("n"),
        draw="digest", cut=0.1, factor=3, rows=given.rows,
    )
    return model.keyed(result).select("Category", "n_extreme", F.col("n_trials").cast("int").alias("n_trials"), r6(F.col("P"), "P"))


@query
def permutation_seeded(spark, sf):
    """Permutation P from the seeded generator (100 trials)."""
    given = model.Inputs(spark, sf)
    rows = given.permuted(100, draw="seeded")
    result = permutation.permutation_p(permutation.permuted_risk(rows, given.size), given.table(), 100)
    return model.keyed(result).select("Category", "n_extreme", r6(F.col("P"), "P"))


SHIFT_TRIALS = 5


@query
def permutation_signed_binomial(spark, sf):
    given = model.Inputs(spark, sf)
    signed = permutation.signed_binomial(given.permuted(SHIFT_TRIALS), given.size)
    return model.keyed(signed).select("trial", "Category", r6(F.col("signed_p"), "signed_p"))


def _shift(spark, sf):
    given = model.Inputs(spark, sf)
    raw = cut_lineage(given.totals().select("code", F.col("n").alias("Raw_counts")))
    sets = cut_lineage(shift.category_sets(cube.category_universe(raw, DOMAIN)))
    signed = cut_lineage(permutation.signed_binomial(given.permuted(SHIFT_TRIALS), given.size))
    return shift.burden_shift(sets, raw, cut_lineage(given.tested()), signed, SHIFT_TRIALS, 7, 0.05)


@query
def category_set_sizes(spark, sf):
    sets = shift.category_sets(cube.category_universe(model.totals(spark, sf), DOMAIN))
    return sets.groupBy("category_set").agg(F.count(F.lit(1)).alias("n_categories"))


@query
def burden_shift(spark, sf):
    return _shift(spark, sf).select("category_set", "N_cats_case", "N_cats_control", r6(F.col("P_case"), "P_case"), r6(F.col("P_control"), "P_control"))


@query
def topn_sets(spark, sf):
    """The ten category sets with the strongest case shift."""
    top = shift.top_sets(_shift(spark, sf), 10)
    return top.select("category_set", "N_cats_case", r6(F.col("P_case"), "P_case"))


@query
def shift_size_classes(spark, sf):
    """Dot sizes of the burden-shift figure."""
    return shift.figure_points(_shift(spark, sf)).select("category_set", "phenotype", "n_cats", "size")


@query
def train_test_split(spark, sf):
    """70 % of each phenotype for training, exact counts."""
    return extract.split_samples(star.samples(spark, sf), 0.7, 42).select("SAMPLE", "PHENOTYPE", "SET")


@query
def family_label_swap(spark, sf):
    people = star.samples(spark, sf)
    return permutation.swap_within_groups(people, "FAMILY", "PHENOTYPE", 7).select("SAMPLE", "FAMILY", "PHENOTYPE", "swapped")


# ---- matrices and models -----------------------------------------------------------------------


@query
def correlation_sample(spark, sf):
    return _pair_keys(gram.correlation(_sample_pairs(spark, sf)).select("code_i", "code_j", r6(F.col("corr"), "corr")))


@query
def correlation_variant(spark, sf):
    return _pair_keys(gram.correlation(_variant_pairs(spark, sf)).select("code_i", "code_j", r6(F.col("corr"), "corr")))


@query
def covariance_inter(spark, sf):
    size = burden.cohort(star.samples(spark, sf))
    value = gram.covariance(_variant_pairs(spark, sf), size.case_share)
    return _pair_keys(value.select("code_i", "code_j", r6(F.col("value"), "value")))


@query
def neg_laplacian(spark, sf):
    matrix = gram.normalised(gram.correlation(_variant_pairs(spark, sf)), "corr")
    return _pair_keys(matrix.select("code_i", "code_j", r6(F.col("value"), "value")))


@query
def z_transform(spark, sf):
    """Directed z-scores and log risks that enter the network step."""
    table, raw, _ = model.tested_and_raw(spark, sf)
    # P near one is rounded: 1 - P would otherwise keep only rounding noise.
    rows = table.withColumn("P", F.round("P", 9)).join(raw, "code").withColumn("cluster", F.lit(1))
    members = network.prepare_members(rows, 20)
    return model.keyed(members).select(
        "Category", r6(F.col("z"), "z"), r6(F.col("log_rr"), "log_rr"), F.col("flag").cast("int").alias("flag"), F.col("flag2").cast("int").alias("flag2")
    )


def _spectrum(spark, sf):
    matrix = gram.normalised(gram.correlation(_variant_pairs(spark, sf)), "corr")
    return spectrum.eigen_decomposition(matrix)


@query
def eigenvalues(spark, sf):
    """Spectrum of the normalised category matrix with running shares."""
    values, _ = _spectrum(spark, sf)
    kept = values.where(F.col("value") >= spectrum.SMALLEST_EIGENVALUE)
    placed = ordered.cumulative_share(kept.select(F.col("position").alias("key"), "value"), "value", "key")
    return placed.select("position", "value", "share")


@query
def eigen_moments(spark, sf):
    """Number, sum and sum of squares of the eigenvalues: the order, trace and squared Frobenius norm of the matrix."""
    values, _ = _spectrum(spark, sf)
    return values.agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("value"), "trace"), r6(F.sum(F.col("value") * F.col("value")), "frobenius")
    )


@query
def effective_tests(spark, sf):
    values, _ = _spectrum(spark, sf)
    return values.agg(F.count(F.lit(1)).alias("n_eigenvalues")).withColumn(
        "n_effective", F.lit(spectrum.effective_number(values)).cast("bigint")
    )


@query
def lasso_models(spark, sf):
    """Cross-validated lasso of every seed on rare categories, with permutation P of the test R2."""
    people = cut_lineage(extract.split_samples(star.samples(spark, sf), 0.7, 42))
    counted = cube.long_counts(stored(model.sample_rows(spark, sf)), "SAMPLE")
    size = burden.cohort(people)
    rare = burden.rare_categories(counted, people, F.col("n"), 30).select("code")
    rare = cut_lineage(rare)
    cells = counted.join(rare, "code", "left_semi").select("SAMPLE", "code", F.col("n").alias("value"))
    codes = sorted(r[0] for r in rare.collect())  # bounded by the category domain
    n = size.cases + size.controls
    fitted = risk.fit_models(cells, risk.model_labels(people, range(42, 72, 10), 5, 0.7, False), codes, 5, 30, n, 3)
    # A permutation may make any category rare that some choice of cases leaves to few controls.
    every = counted.select("SAMPLE", "code", F.col("n").alias("value"))
    open_codes = cut_lineage(grid.candidates(every, size.cases, 30))
    permuted = risk.fit_models(
        every.join(open_codes, "code", "left_semi"), risk.model_labels(people, range(42, 47), 5, 0.7, True),
        sorted(r[0] for r in open_codes.collect()), 5, 30, n, 5,
    )
    fitted = cut_lineage(fitted)
    chosen = risk.selected_categories(fitted, 3).count()
    return risk.score_table(fitted, permuted, chosen)


GRID_DOMAINS = ["all", "coding", "noncoding"]


def _grid_inputs(spark, sf):
    inputs = model.Inputs(spark, sf)
    people = cut_lineage(extract.split_samples(inputs.people, 0.7, 42))
    # Rare: fewer counts in the controls than a tenth of their number.
    cells = inputs.counts.select("SAMPLE", "code", F.col("n").alias("value"))
    rows = inputs.rows.select("SAMPLE", "codes", F.col("counts").alias("vals"))
    return cells, rows, people, inputs.size, inputs.size.controls // 10


@query
def lasso_annotation_grid(spark, sf):
    """Risk score of every domain with each annotation term alone and without it, with permutation P."""
    cells, rows, people, size, rare_below = _grid_inputs(spark, sf)
    models = grid.grid_models(DOMAIN, GRID_DOMAINS, list(grid.ANNOTATIONS), [grid.EACH, grid.WITHOUT])

    def fits(seeds, permute):
        labels = risk.model_labels(people, seeds, 5, 0.7, permute)
        return cut_lineage(grid.fit_grid(cells, labels, DOMAIN, models, 5, rare_below, size.cases, rows=rows))

    return grid.grid_scores(fits(range(42, 62, 10), False), fits(range(42, 45), True), grid.model_table(spark, models), 2)


@query
def lasso_grid_optimality(spark, sf):
    """Rare categories and training samples of every model, and whether its fit meets the lasso's conditions on the counts."""
    cells, rows, people, size, rare_below = _grid_inputs(spark, sf)
    models = grid.grid_models(DOMAIN, ["all"], list(grid.ANNOTATIONS), [grid.WHOLE, grid.EACH, grid.WITHOUT])
    labels = cut_lineage(risk.model_labels(people, range(42, 43), 5, 0.7, False))
    fits = cut_lineage(grid.fit_grid(cells, labels, DOMAIN, models, 5, rare_below, size.cases, rows=rows))
    masks = grid.mask_table(spark, *grid.member_masks(cells.select("code").distinct(), DOMAIN, models))
    members = cut_lineage(grid.rare_members(cells, labels, fits, masks, rare_below))
    counted = members.groupBy("model").agg(F.count(F.lit(1)).alias("n_members"))
    gaps = grid.optimality(cells, labels, fits, members)
    n_train = labels.where("fold > 0").count()
    met = (F.coalesce("gap", F.lit(0.0)) < 1e-6) & (F.coalesce("intercept_gap", F.lit(0.0)) < 1e-6)
    return grid.model_table(spark, models).join(fits.select("model", "n_rare", "parameter"), "model").join(gaps, "model", "left").join(
        counted, "model", "left"
    ).select(
        "domain", "dimension", "term", "mode", F.coalesce("n_members", F.lit(0)).alias("n_rare"),
        (F.col("n_rare") == F.coalesce("n_members", F.lit(0))).alias("same_rare"), F.lit(n_train).cast("bigint").alias("n_train"), met.alias("optimal"),
    )


def _fitted_clusters(spark, sf):
    _, vectors = _spectrum(spark, sf)
    clusters, scores = netfit.cluster_categories(vectors, range(2, 9), 42)
    return cut_lineage(clusters), scores


@query
def kmeans_clusters(spark, sf):
    clusters, _ = _fitted_clusters(spark, sf)
    return model.keyed(clusters)


@query
def silhouette_scores(spark, sf):
    _, vectors = _spectrum(spark, sf)
    flat = netfit.plane(netfit.unit_rows(vectors))
    return spark.createDataFrame(netfit.silhouettes(flat, range(2, 9), 42), "k int, silhouette double")


def _members(spark, sf, rows):
    """Members of the gencode clusters, and the clusters, from ``labelled_rows``."""
    table, raw, _ = model.tested_and_raw(spark, sf, model.sums_of(rows))
    clusters = _clusters(spark, sf, raw)
    return cut_lineage(network.prepare_members(table.join(raw, "code").join(clusters.select("code", "cluster"), "code"), 20)), clusters


@query
def supernode_statistics(spark, sf):
    """Sparse leading-vector statistic of each gencode cluster."""
    rows = model.labelled_rows(spark, sf)  # one pass over the variants for both
    corr = cut_lineage(gram.correlation(_sample_pairs(spark, sf, rows)))
    members, _ = _members(spark, sf, rows)
    return netfit.supernode_tests(members, corr, "z", "flag", 5.25).select(
        "cluster", "statistic", "sparsity", F.size("codes").alias("n_codes")
    )


@query
def network_risk(spark, sf):
    """Cluster risk, p-value and FDR after the hidden Markov random field."""
    return _network(spark, sf)[1]


@query
def network_fdr(spark, sf):
    return _network(spark, sf)[0]


def _network(spark, sf):
    rows = model.labelled_rows(spark, sf)  # one pass over the variants for both
    corr = cut_lineage(gram.correlation(_sample_pairs(spark, sf, rows)))
    members, clusters = _members(spark, sf, rows)
    z = cut_lineage(netfit.supernode_tests(members, corr, "z", "flag", 5.25))
    rr = netfit.supernode_tests(members, corr, "log_rr", "flag2", None)
    edges = network.graph_edges(network.block_means(corr, clusters, "corr"), 0.12)
    # The tables hold no signal at the usual 0.05, so the field starts from a looser risk threshold.
    return netfit.network_tables(z, rr, edges, p_cut=0.95)


@query
def network_communities(spark, sf):
    """Label-propagation communities of the category correlation graph."""
    corr = gram.correlation(_variant_pairs(spark, sf))
    edges = cut_lineage(corr.where((F.col("code_i") < F.col("code_j")) & (F.col("corr") > 0.5)).select(
        F.col("code_i").alias("src"), F.col("code_j").alias("dst"), F.col("corr").alias("weight")
    ))
    nodes = model.totals(spark, sf).select(F.col("code").alias("node"))
    found = netfit.label_propagation(edges, nodes)
    return found.select(DOMAIN.key(F.col("node")).alias("Category"), DOMAIN.key(F.col("community")).alias("community"))


def _leiden(spark, sf):
    points = communities.matrix_points(cut_lineage(gram.correlation(_variant_pairs(spark, sf))), "corr")
    reduced = cut_lineage(communities.principal_points(points))
    edges = cut_lineage(communities.neighbour_graph(reduced))
    nodes = reduced.select(F.col("code").alias("node"))
    return edges, cut_lineage(communities.leiden(edges, nodes))


@query
def leiden_quality(spark, sf):
    """Whether every community is connected, and whether the modularity computed in SQL from the labels agrees."""
    edges, found = _leiden(spark, sf)
    parts = communities.connected_parts(communities._both(edges), found)
    restated = spark.sql(
        """
        WITH m AS (SELECT sum(weight) AS m FROM {edges}),
        degree AS (SELECT node, sum(weight) AS k FROM (SELECT src AS node, weight FROM {edges} UNION ALL SELECT dst, weight FROM {edges}) GROUP BY node),
        inside AS (SELECT sum(e.weight) AS w FROM {edges} e JOIN {found} a ON a.node = e.src JOIN {found} b ON b.node = e.dst AND b.community = a.community),
        squares AS (SELECT sum(k * k) AS s FROM (SELECT f.community, sum(k) AS k FROM degree d JOIN {found} f ON f.node = d.node GROUP BY f.community))
        SELECT w / m - s / (4 * m * m) AS q FROM m, inside, squares
        """,
        edges=edges, found=found,
    ).first()[0]  # one row of four sums
    quality = communities.modularity(edges, found)
    return found.join(parts.select("node", F.col("community").alias("part")), "node").agg(
        F.count(F.lit(1)).alias("n_categories"), (F.countDistinct("community") == F.countDistinct("part")).alias("connected"),
        F.lit(abs(quality - restated) < 1e-9).alias("modularity_agrees"), F.lit(quality > 0.1).alias("modular"),
    )


@query
def cluster_pairs(spark, sf):
    return network.cluster_pairs(_clusters(spark, sf).select("cluster").distinct())
