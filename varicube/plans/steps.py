"""The analysis steps, file to file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varicube.domain import DIMENSIONS, REGION_FLAGS, CategoryDomain, region_flags
from varicube.functions import annotate, stats
from varicube.operators import (
    burden, communities, cube, extract, gram, grid, intervals, keys, netfit, network, permutation, risk, shift, spectrum,
)
from varicube.session import cut_lineage
from varicube.sources import tables, vcf


def preparation(spark: SparkSession, tracks: list[tuple[str, str]], out_dir: str) -> None:
    """Merge interval tracks into disjoint masked segments."""
    rows, names = tables.read_tracks(spark, tracks)
    tables.write_segments(intervals.coverage_segments(rows, len(names)), names, out_dir)


def annotation(spark: SparkSession, vcf_path: str, segments_dir: str, out_dir: str) -> None:
    """Add the interval mask to variants that already carry consequence annotation."""
    header = vcf.read_header(spark, vcf_path)
    cells = F.split("value", "\t", -1)
    rows = spark.read.text(vcf_path).where(~F.startswith("value", F.lit("#")))
    variants = rows.select(*[cells[i].alias(c) for i, c in enumerate(header.columns)])
    segments, names = tables.read_segments(spark, segments_dir)
    vcf.write_annotated(intervals.annotate_overlaps(variants, segments), header, names, out_dir)


def _termed(spark, vcf_path, gene_path, scores, score_column, threshold):
    variants, header = vcf.read_variants(spark, vcf_path, spark.sparkContext.defaultParallelism)
    genes, set_names = tables.read_gene_matrix(spark, gene_path)
    known = [t for t in header.tracks if t in scores]
    domain = CategoryDomain(tuple(set_names), tuple(known), tuple(t for t in header.tracks if t not in scores))
    if domain.tracks != tuple(header.tracks):
        raise ValueError("score tracks must precede annotation tracks in the mask")
    located = annotate.with_gene_sets(annotate.with_shape(variants, score_column, threshold), genes)
    return annotate.with_terms(located, domain, score_column, threshold), domain


def categorization(spark, vcf_path, gene_path, scores, score_column, threshold, out_dir, rules_path=None) -> None:
    """``rules_path`` names a table of redundant categories (five term columns, ``*`` for any) that are left out as well."""
    termed, domain = _termed(spark, vcf_path, gene_path, scores, score_column, threshold)
    counts = cube.category_counts(termed, domain)
    if rules_path:
        kept = cube.drop_by_rule_table(cube.category_universe(counts, domain), tables.read_table(spark, rules_path))
        counts = counts.join(kept.select("code"), "code", "left_semi")
    tables.write_counts(counts, domain, out_dir)


def _burden_inputs(spark, counts_dir, samples_path, factors_path):
    counts, domain = tables.read_counts(spark, counts_dir)
    people = tables.read_samples(spark, samples_path)
    keys.require_same_keys(counts, people, "SAMPLE", "samples of the counts and of the sample table")
    value = F.col("n")
    if factors_path:
        factors = tables.read_adjustment(spark, factors_path)
        keys.require_same_keys(counts, factors, "SAMPLE", "samples of the counts and of the adjustment factors")
        counts, value = burden.adjusted(counts, factors), F.col("adjusted")
    return counts, domain, people, value


def _save_burden(table: DataFrame, counts: DataFrame, domain: CategoryDomain, value, carriers: bool, out_dir: str) -> None:
    spelled = cube.spell_out(table, domain).drop("code")
    tables.write_table(spelled.select("Category", *DIMENSIONS, *[c for c in spelled.columns if c not in ("Category", *DIMENSIONS)]), f"{out_dir}/burden_test")
    raw = burden.raw_and_adjusted(counts, value, carriers)
    tables.write_table(raw.select(domain.key(F.col("code")).alias("Category"), "Raw_counts", "Adj_counts"), f"{out_dir}/category_counts")
    info = cube.category_universe(counts, domain)
    tables.write_table(info.select("Category", *DIMENSIONS, *region_flags(F.col("gencode"), F.col("gene_set"))), f"{out_dir}/category_info")


def binomial_test(spark, counts_dir, samples_path, out_dir, factors_path=None, carriers=False) -> None:
    counts, domain, people, value = _burden_inputs(spark, counts_dir, samples_path, factors_path)
    size = burden.cohort(people)
    table = burden.burden_table(counts, people, size, value, carriers)
    names = ("Case_Carrier_Count", "Ctrl_Carrier_Count") if carriers else ("Case_DNV_Count", "Ctrl_DNV_Count")
    tested = cut_lineage(burden.binomial_test(table, size, *names))
    _save_burden(tested, counts, domain, value, carriers, out_dir)
    points = burden.volcano(tested, burden.raw_and_adjusted(counts, value, carriers), stats.count_threshold(size.case_share))
    tables.write_table(points.withColumn("Category", domain.key(F.col("code"))).drop("code"), f"{out_dir}/volcano_points")


def permutation_test(spark, counts_dir, samples_path, out_dir, factors_path=None, carriers=False, trials=10000, burden_shift=False) -> None:
    counts, domain, people, value = _burden_inputs(spark, counts_dir, samples_path, factors_path)
    size = burden.cohort(people)
    table = cut_lineage(burden.burden_table(counts, people, size, value, carriers))
    rows = None
    if burden_shift:  # the trials are wanted themselves: drawn and multiplied once, for both results
        rows = cut_lineage(permutation.permuted_counts(counts, people, size, trials, domain.size, value, carriers))
    p = permutation.two_stage_p(counts, people, size, table, trials, domain.size, value, carriers, trials=rows)
    _save_burden(table.join(p.select("code", "P"), "code"), counts, domain, value, carriers, out_dir)
    if rows is not None:
        signed = permutation.signed_binomial(rows, size).select("trial", domain.key(F.col("code")).alias("Category"), "signed_p")
        signed.write.mode("overwrite").parquet(f"{out_dir}/binom_pvals")


def extract_variant(spark, vcf_path, gene_path, scores, score_column, threshold, out_dir, set_path=None, annotation_info=False) -> None:
    termed, domain = _termed(spark, vcf_path, gene_path, scores, score_column, threshold)
    rows = extract.with_extract_terms(termed, score_column, threshold)
    if annotation_info:
        wide = rows.schema["ANNOT"].dataType.typeName() == "array"
        in_set = [F.coalesce(F.array_contains("gene_sets", g), F.lit(False)).cast("int").alias(g) for g in domain.gene_sets]
        rows = rows.select(
            "*", annotate.variant_class(F.col("REF"), F.col("ALT")).alias("CLASS"), *in_set,
            *annotate.mask_columns(F.col("ANNOT"), domain.tracks, wide),
        )
    if set_path:
        wanted = tables.with_codes(tables.read_table(spark, set_path), domain)
        rows = extract.by_category_set(rows, wanted, domain).withColumn("CATEGORY", domain.key(F.col("code"))).drop("code")
    else:
        rows = rows.drop(*cube.TERM_ARRAYS)
    result = rows.drop("gene_sets", "ANNOT") if annotation_info else extract.slim(rows)
    tables.write_table(result, f"{out_dir}/extracted_variants", gzip=True)


def correlation(spark, counts_dir, out_dir, level, info_path=None, domains="all", intersections=False, variants=None) -> None:
    """``level`` is ``sample``, or ``variant`` with ``variants`` holding the categorization inputs."""
    if level not in ("sample", "variant"):
        raise ValueError(f"level must be sample or variant, not {level}")
    counts, domain = tables.read_counts(spark, counts_dir)
    if level == "variant":
        termed, domain = _termed(spark, *variants)
        rows = cube.signature_codes(cube.signatures(termed, []), domain)
        pairs = gram.co_occurrence(rows, domain.size, weight="n")
    else:
        pairs = gram.co_occurrence(gram.unit_rows(counts, "SAMPLE"), domain.size, salt="SAMPLE")
    pairs = cut_lineage(gram.both_triangles(pairs))
    info = tables.with_codes(tables.read_table(spark, info_path), domain) if info_path else None
    for name in tables.choose_domains(domains, info.columns if info is not None else []):
        chosen = pairs
        if name != "all":
            member = info.where(F.col(f"is_{name}") == 1).select("code")
            chosen = pairs.join(member.withColumnRenamed("code", "code_i"), "code_i", "left_semi").join(
                member.withColumnRenamed("code", "code_j"), "code_j", "left_semi"
            )
        if intersections:
            chosen.write.mode("overwrite").parquet(f"{out_dir}/intersection_matrix/domain={name}")
        gram.correlation(chosen).write.mode("overwrite").parquet(f"{out_dir}/correlation_matrix/domain={name}")


def effective_num_test(
    spark, matrix_path, category_counts_path, domain, samples_path, out_dir, matrix="corr", threshold=None, components=None,
    set_path=None, domains="all",
) -> dict[str, int]:
    """Effective number of tests of every chosen domain.

    ``set_path`` is a category table: only its categories count, and its is_* columns define the domains.
    """
    pairs = spark.read.parquet(matrix_path)
    if threshold is None and not samples_path or matrix == "inter" and not samples_path:
        raise ValueError("samples are needed for the count threshold and for the covariance")
    size = burden.cohort(tables.read_samples(spark, samples_path)) if samples_path else None
    cut = threshold if threshold is not None else stats.count_threshold(size.case_share)
    wanted = tables.with_codes(tables.read_table(spark, category_counts_path), domain).where(F.col("Raw_counts") >= cut).select("code")
    members = tables.with_codes(tables.read_table(spark, set_path), domain) if set_path else None
    if members is not None:
        wanted = wanted.join(members.select("code"), "code", "left_semi")
    found = {}
    names = tables.choose_domains(domains, members.columns if members is not None else [])
    for name in names:
        chosen = wanted if name == "all" else wanted.join(members.where(F.col(f"is_{name}") == 1).select("code"), "code", "left_semi")
        kept = pairs.join(chosen.withColumnRenamed("code", "code_i"), "code_i", "left_semi").join(chosen.withColumnRenamed("code", "code_j"), "code_j", "left_semi")
        kept, column = (gram.covariance(kept, size.case_share), "value") if matrix == "inter" else (kept, "corr")
        values, vectors = spectrum.eigen_decomposition(gram.normalised(kept, column), components)
        folder = out_dir if names == ["all"] else f"{out_dir}/domain={name}"
        values.write.mode("overwrite").parquet(f"{folder}/eig_vals")
        vectors.write.mode("overwrite").parquet(f"{folder}/eig_vecs")
        found[name] = spectrum.effective_number(values)
    return found


def burden_shift(spark, burden_path, pvals_path, info_path, counts_path, domain, out_dir, cutoff=7, p_cut=0.05, sets_path=None, top=10) -> None:
    """``sets_path`` lists the category sets to show, one a line (``coding``, or tokens in any order, ``A&B``); else the ``top`` sets are shown."""
    table = tables.with_codes(tables.read_table(spark, burden_path), domain)
    signed = tables.with_codes(spark.read.parquet(pvals_path), domain)
    raw = tables.with_codes(tables.read_table(spark, counts_path), domain)
    sets = cut_lineage(shift.category_sets(tables.with_codes(tables.read_table(spark, info_path), domain)))
    trials = signed.agg(F.max("trial")).first()[0] or 0
    result = cut_lineage(shift.burden_shift(sets, raw, table, signed, trials, cutoff, p_cut))
    tables.write_table(result, f"{out_dir}/burdenshift_p{p_cut}_cutoff{cutoff}")
    points = shift.figure_points(result)
    tables.write_table(points, f"{out_dir}/burdenshift_points")
    chosen = shift.listed_sets(result, spark.read.text(sets_path)) if sets_path else shift.top_sets(result, top).select("category_set")
    tables.write_table(shift.labelled_points(points, chosen), f"{out_dir}/burdenshift_shown")
    tables.write_table(shift.trial_distribution(sets, raw, signed, cutoff, p_cut), f"{out_dir}/burdenshift_trials")


def risk_score(
    spark, counts_dir, samples_path, out_dir, factors_path=None, carriers=False, threshold=3, fraction=0.7, regressions=10, folds=5,
    permutations=1000, seed=42, domains="all", modes=(), dimensions=tuple(grid.ANNOTATIONS),
) -> None:
    """Lasso risk scores of the chosen domains; with ``modes``, of each annotation term alone or of all but that term instead."""
    counts, domain, people, value = _burden_inputs(spark, counts_dir, samples_path, factors_path)
    unknown = set(dimensions) - set(grid.ANNOTATIONS)
    if unknown:
        raise ValueError(f"no annotation dimension: {', '.join(sorted(unknown))}")
    size = burden.cohort(people)
    people = cut_lineage(extract.split_samples(people, fraction, seed))
    # A carrier counts with its adjustment factor, as a count does.
    factor = F.col("adjusted") / F.col("n") if factors_path else F.lit(1)
    cells = cut_lineage(counts.select("SAMPLE", "code", (F.when(F.col("n") > 0, factor).otherwise(0) if carriers else value).alias("value")))
    names = tables.choose_domains(domains, list(REGION_FLAGS))
    models = grid.grid_models(domain, names, list(dimensions), list(modes) or [grid.WHOLE])
    table = grid.model_table(spark, models)

    def fits(seeds: range, permute: bool) -> DataFrame:
        labels = risk.model_labels(people, seeds, folds, fraction, permute)
        return cut_lineage(grid.fit_grid(cells, labels, domain, models, folds, threshold, size.cases))

    observed = fits(range(seed, seed + 10 * regressions, 10), False)
    null = fits(range(seed, seed + permutations), True) if permutations else None
    subset = ["domain", "dimension", "term", "mode"]
    average = grid.grid_scores(observed, null, table, regressions)
    each = observed.join(table, "model").select(*subset, F.col("seed").cast("string").alias("seed"), "parameter", "r2", F.col("n_select").cast("bigint").alias("n_select"))
    results = average.withColumn("seed", F.lit("average")).select(*subset, "seed", *[c for c in average.columns if c not in subset])
    tables.write_table(results.unionByName(each, allowMissingColumns=True), f"{out_dir}/lasso_results")
    coefficients = observed.select("model", "seed", F.inline(F.arrays_zip("codes", "coefficients"))).join(table, "model")
    tables.write_table(
        coefficients.select(*subset, "seed", domain.key(F.col("codes")).alias("Category"), F.col("coefficients").alias("coefficient")), f"{out_dir}/lasso_coef"
    )
    if null is not None:
        drawn = null.join(table, "model").select(*subset, F.col("seed").cast("string").alias("permutation"), "r2")
        spread = drawn.groupBy(*subset).agg(F.avg("r2").alias("r2"), F.stddev_pop("r2").alias("std")).withColumn("permutation", F.lit("average"))
        tables.write_table(spread.unionByName(drawn, allowMissingColumns=True), f"{out_dir}/lasso_null_models")


def dawn(spark, vectors_path, correlation_path, permutation_path, counts_path, domain, out_dir, ks=range(2, 101), k=None, seed=42, sparsity=5.25, min_count=20, min_corr=0.12, min_size=2, leiden=None, resolution=1.0) -> None:
    """Cluster categories, build the cluster graph, and test clusters with the random field.

    ``leiden`` is ``eigen_vector`` or ``corr_mat``: communities of the neighbour graph of these rows instead of k-means.
    """
    vectors, corr = spark.read.parquet(vectors_path), spark.read.parquet(correlation_path)
    if leiden not in (None, "eigen_vector", "corr_mat"):
        raise ValueError(f"leiden must be eigen_vector or corr_mat, not {leiden}")
    if leiden:
        points = vectors.select("code", F.col("vector").alias("point")) if leiden == "eigen_vector" else communities.matrix_points(corr, "corr")
        clusters, scores = communities.category_communities(points, resolution), []
    else:
        clusters, scores = netfit.cluster_categories(vectors, ks, seed, k)
    clusters = cut_lineage(clusters)
    tested = tables.with_codes(tables.read_table(spark, permutation_path), domain).select("code", "P", "Relative_Risk")
    raw = tables.with_codes(tables.read_table(spark, counts_path), domain).select("code", "Raw_counts")
    members = cut_lineage(network.prepare_members(tested.join(raw, "code").join(clusters, "code"), min_count))
    large = network.cluster_sizes(members).where(F.col("size") >= min_size).select("cluster")
    members = members.join(large, "cluster", "left_semi")
    kept = clusters.join(large, "cluster", "left_semi")
    edges = cut_lineage(network.graph_edges(network.block_means(corr, kept, "corr"), min_corr))
    named = clusters.select("cluster", domain.key(F.col("code")).alias("Category"))
    for frame, name in ((edges, "adjacency"), (named, "cluster_annotation"), (network.representative_terms(named), "cluster_terms")):
        tables.write_table(frame, f"{out_dir}/{name}", sep=",")
    if scores:
        tables.write_table(spark.createDataFrame(scores, "k int, silhouette double"), f"{out_dir}/silhouette", sep=",")
    # The tests come last: they fail where no cluster exceeds the threshold, and the tables above stay.
    z = cut_lineage(netfit.supernode_tests(members, corr, "z", "flag", sparsity))
    rr = netfit.supernode_tests(members, corr, "log_rr", "flag2", None)
    fdr, risks = netfit.network_tables(z, rr, edges)
    tables.write_table(fdr, f"{out_dir}/cluster_fdr", sep=",")
    tables.write_table(risks, f"{out_dir}/cluster_risk", sep=",")
