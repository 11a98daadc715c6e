"""Burden shift: observed against permuted numbers of significant categories in category sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varicube.domain import REGION_FLAGS, SHIFT_GROUPS, region_flags

# The domains of the points, in the order of the legend.
POINT_DOMAINS = (
    "Coding (All)", "PTV", "Missense", "Coding w/o PTV", "Noncoding (All)", "Promoter", "Intron", "Intergenic", "5primeUTR", "3primeUTR",
    "SpliceSite", "LincRNA", "CRE", "Others",
)


def category_sets(categories: DataFrame) -> DataFrame:
    """Long (category_set, code): region flags, single terms, and their pairwise combinations.

    ``categories`` has code and the five term columns. A category's sets are listed inside its row and
    exploded, so no set is scanned on its own.
    """
    flags = {name: flag for name, flag in zip(REGION_FLAGS, region_flags(F.col("gencode"), F.col("gene_set")))}
    gene, region, score = F.col("gene_set"), F.col("functional_annotation"), F.col("functional_score")
    has_gene, has_region, has_score = gene != "Any", region != "Any", score != "All"
    names = [F.when(flags[name] == 1, F.lit(name)) for name in flags]
    for term, present in ((gene, has_gene), (region, has_region), (score, has_score)):
        names.append(F.when(present, F.concat(F.lit("is_"), term)))
        for group in SHIFT_GROUPS:
            inside = flags[f"is_{group}"] == 1
            names.append(F.when(present & inside, F.concat(F.lit(f"is_{group}_"), term)))
    names.append(F.when(has_region & has_gene, F.concat(F.lit("is_"), region, F.lit("_"), gene)))
    names.append(F.when(has_score & has_gene, F.concat(F.lit("is_"), score, F.lit("_"), gene)))
    listed = F.array_distinct(F.array_compact(F.array(*names)))
    return categories.select("code", F.explode(listed).alias("category_set"))


def burden_shift(
    sets: DataFrame, raw: DataFrame, observed: DataFrame, signed: DataFrame, n_trials: int, cutoff: float, p_cut: float
) -> DataFrame:
    """Per set: observed significant categories by direction, and the share of trials with as many.

    Only significant permuted categories are joined to their sets; trials without any count as zero, which
    reaches the observed number only when that is zero too.
    """
    kept = raw.where(F.col("Raw_counts") >= cutoff).select("code")
    everything = kept.select("code", F.lit("All").alias("category_set"))
    members = sets.join(kept, "code", "left_semi").select("code", "category_set").unionByName(everything)
    hit = F.col("P") <= p_cut
    seen = members.join(observed.select("code", "P", "Relative_Risk"), "code").groupBy("category_set").agg(
        F.count_if(hit & (F.col("Relative_Risk") > 1) & ~F.isnan("Relative_Risk")).alias("N_cats_case"),
        F.count_if(hit & (F.col("Relative_Risk") < 1)).alias("N_cats_control"),
    )
    p = F.col("signed_p")
    hits = signed.where((p != 0) & (F.abs(p) <= p_cut)).select("trial", "code", p)
    per_trial = members.join(hits, "code").groupBy("category_set", "trial").agg(
        F.count_if(p > 0).alias("case"), F.count_if(p < 0).alias("ctrl")
    )
    reached = seen.join(per_trial, "category_set", "left").groupBy("category_set", "N_cats_case", "N_cats_control").agg(
        F.count_if(F.col("case") >= F.col("N_cats_case")).alias("_case"),
        F.count_if(F.col("ctrl") >= F.col("N_cats_control")).alias("_ctrl"),
    )
    trials = F.lit(float(n_trials))
    return reached.select(
        "category_set", "N_cats_case", "N_cats_control",
        F.when(F.col("N_cats_case") == 0, 1.0).otherwise(F.col("_case") / trials).alias("P_case"),
        F.when(F.col("N_cats_control") == 0, 1.0).otherwise(F.col("_ctrl") / trials).alias("P_control"),
    )


def trial_distribution(sets: DataFrame, raw: DataFrame, signed: DataFrame, cutoff: float, p_cut: float) -> DataFrame:
    """Figure data: significant categories per (set, trial) and direction; trials without any are absent."""
    kept = raw.where(F.col("Raw_counts") >= cutoff).select("code")
    p = F.col("signed_p")
    hits = signed.where((p != 0) & (F.abs(p) <= p_cut)).select("trial", "code", p).join(kept, "code", "left_semi")
    return sets.join(hits, "code").groupBy("category_set", "trial").agg(
        F.count_if(p > 0).alias("case"), F.count_if(p < 0).alias("ctrl")
    )


def top_sets(result: DataFrame, n: int) -> DataFrame:
    shown = result.where(~F.col("category_set").isin("All", "is_lincRNA_lincRNA"))
    return shown.orderBy(F.col("P_case").asc(), F.col("N_cats_case").desc(), F.col("category_set").asc()).limit(n)


def listed_sets(result: DataFrame, lines: DataFrame) -> DataFrame:
    """Category sets of a list (column ``value``): ``A&B`` is the set of exactly these tokens in any order, else ``is_`` + name.

    Blank lines, unknown names and repeated lines add nothing.
    """
    wanted = lines.select(F.trim("value").alias("value")).where("value != ''").distinct()
    several = F.instr("value", "&") > 0
    names = wanted.where(~several).select(F.concat(F.lit("is_"), "value").alias("category_set"))
    # The sorted tokens are the join key, so the list may be of any length.
    tokens = lambda text, mark: F.array_join(F.array_sort(F.split(text, mark)), "_")
    keyed = result.select("category_set", tokens(F.regexp_replace("category_set", "is_", ""), "_").alias("tokens"))
    matched = keyed.join(wanted.where(several).select(tokens(F.col("value"), "&").alias("tokens")), "tokens", "left_semi")
    known = result.select("category_set").join(names, "category_set", "left_semi")
    return known.unionByName(matched.select("category_set")).distinct()


def labelled_points(points: DataFrame, chosen: DataFrame) -> DataFrame:
    """The points of the chosen sets with their domain, its place in the legend and -log10 P.

    A P of 0 is drawn half a unit above the largest finite value of all points.
    """
    words = F.split("category_set", "_")
    name = F.coalesce(F.try_element_at(words, F.lit(2)), F.lit(""))
    name = F.when(F.lower(name) == "ptv", "PTV").otherwise(F.concat(F.upper(F.substring(name, 1, 1)), F.expr("substring(split(category_set, '_')[1], 2)")))
    without_ptv = F.col("category_set").isin("is_coding_no_ptv", "is_coding_wo_ptv")
    label = (
        F.when(without_ptv, "Coding w/o PTV").when(name.isin("Coding", "Noncoding"), F.concat(name, F.lit(" (All)")))
        .when(name == "Damaging", "Missense").when(name.isin(*POINT_DOMAINS), name).otherwise("Others")
    )
    scored = points.withColumn("domain", label).withColumn(
        "domain_order", F.array_position(F.array(*map(F.lit, POINT_DOMAINS)), F.col("domain")) - 1
    ).withColumn("neg_log10_p", F.when(F.col("P") > 0, -F.log10("P")))
    most = scored.agg((F.max("neg_log10_p") + 0.5).alias("_most"))  # one row
    shown = scored.join(chosen, "category_set", "left_semi").join(F.broadcast(most))
    return shown.withColumn("neg_log10_p", F.when(F.col("P") == 0, F.col("_most")).otherwise(F.col("neg_log10_p"))).drop("_most")


def figure_points(result: DataFrame) -> DataFrame:
    """One point per set and phenotype with its size class (odd numbers from 1)."""
    shown = result.where(~F.col("category_set").isin("All", "is_lincRNA_lincRNA"))
    points = shown.select(
        "category_set",
        F.inline(F.array(
            F.struct(F.lit("Case").alias("phenotype"), F.col("N_cats_case").alias("n_cats"), F.col("P_case").alias("P")),
            F.struct(F.lit("Control").alias("phenotype"), F.col("N_cats_control").alias("n_cats"), F.col("P_control").alias("P")),
        )),
    )
    low, high = points.agg(F.min("n_cats"), F.max("n_cats")).first()
    if low is None:
        return points.withColumn("size", F.lit(1))
    n_bins = 6 if high >= 12 else 3 if high >= 6 else 2 if high > 1 else 1
    step = max(1, (high - low) // n_bins)
    edges = list(range(low, high + 1, step))[:6]
    above = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("n_cats")))
    return points.withColumn("size", F.lit(1) + F.lit(2) * above)
