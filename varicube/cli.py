"""Command line: one sub-command per analysis step."""

from __future__ import annotations

import argparse
from pathlib import Path

from varicube.operators.grid import ANNOTATIONS, EACH, WITHOUT
from varicube.plans import steps
from varicube.session import build_session
from varicube.sources import tables


def _named_tracks(items: list[str]) -> list[tuple[str, str]]:
    """``path=name`` pairs; a bare path is named after its file."""
    pairs = []
    for item in items:
        path, _, name = item.partition("=")
        pairs.append((path, name or Path(path).name.split(".")[0]))
    return pairs


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="varicube")
    sub = parser.add_subparsers(dest="step", required=True)

    def step(name: str, *needed: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for flag in needed:
            p.add_argument(f"--{flag}", required=True)
        p.add_argument("--out", required=True)
        return p

    step("preparation").add_argument("--tracks", nargs="+", required=True, help="path=name, score tracks first")
    step("annotation", "vcf", "segments")
    for name in ("categorization", "extract_variant"):
        p = step(name, "vcf", "genes", "score-column")
        p.add_argument("--scores", nargs="*", default=[])
        p.add_argument("--threshold", type=float, required=True)
        if name == "categorization":
            p.add_argument("--redundant", help="table of redundant categories, * for any term")
        if name == "extract_variant":
            p.add_argument("--category-set")
            p.add_argument("--annotation-info", action="store_true")
    for name in ("binomial_test", "permutation_test", "risk_score"):
        p = step(name, "counts", "samples")
        p.add_argument("--factors")
        p.add_argument("--carriers", action="store_true")
        if name == "permutation_test":
            p.add_argument("--trials", type=int, default=10000)
            p.add_argument("--burden-shift", action="store_true")
        if name == "risk_score":
            p.add_argument("--rare-below", type=float, default=3)
            p.add_argument("--train-fraction", type=float, default=0.7)
            p.add_argument("--regressions", type=int, default=10)
            p.add_argument("--folds", type=int, default=5)
            p.add_argument("--permutations", type=int, default=1000)
            p.add_argument("--domains", default="all", help="all, run_all or a comma-separated list")
            p.add_argument("--each-annotation", action="store_true", help="a model per annotation term")
            p.add_argument("--without-annotation", action="store_true", help="a model without each annotation term")
            p.add_argument("--dimensions", nargs="+", default=list(ANNOTATIONS), choices=list(ANNOTATIONS))
            p.add_argument("--seed", type=int, default=42)
    p = step("correlation", "counts")
    p.add_argument("--level", required=True, choices=("sample", "variant"))
    p.add_argument("--category-info")
    p.add_argument("--domains", default="all")
    p.add_argument("--intersections", action="store_true")
    for flag in ("vcf", "genes", "score-column"):
        p.add_argument(f"--{flag}")
    p.add_argument("--scores", nargs="*", default=[])
    p.add_argument("--threshold", type=float, default=0.0)
    p = step("effective_num_test", "matrix", "counts", "category-counts")
    p.add_argument("--samples")
    p.add_argument("--format", choices=("corr", "inter"), default="corr")
    p.add_argument("--count-threshold", type=int)
    p.add_argument("--components", type=int)
    p.add_argument("--category-set")
    p.add_argument("--domains", default="all", help="all, run_all or a comma-separated list; is_* columns of the category set")
    p = step("burden_shift", "counts", "burden", "pvals", "category-info", "category-counts")
    p.add_argument("--cutoff", type=float, default=7)
    p.add_argument("--pval", type=float, default=0.05)
    p.add_argument("--category-sets", help="a list of category sets to show, one a line")
    p.add_argument("--top", type=int, default=10, help="number of sets to show without a list")
    p = step("dawn", "counts", "vectors", "matrix", "permutation", "category-counts")
    p.add_argument("--k-range", default="2,100")
    p.add_argument("--k", type=int)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--leiden", choices=("eigen_vector", "corr_mat"))
    p.add_argument("--resolution", type=float, default=1.0)
    p.add_argument("--sparsity", type=float, default=5.25)
    p.add_argument("--min-count", type=int, default=20)
    p.add_argument("--min-corr", type=float, default=0.12)
    p.add_argument("--min-size", type=int, default=2)
    return parser


def main(argv: list[str] | None = None) -> None:
    parser = _parser()
    a = parser.parse_args(argv)
    if a.step == "effective_num_test" and not a.samples and (a.count_threshold is None or a.format == "inter"):
        parser.error("--samples is needed without --count-threshold and for --format inter")
    if a.step == "correlation" and a.level == "variant" and not (a.vcf and a.genes and a.score_column):
        parser.error("--level variant needs --vcf, --genes and --score-column")
    spark = build_session(f"varicube-{a.step}")
    if a.step == "preparation":
        steps.preparation(spark, _named_tracks(a.tracks), a.out)
    elif a.step == "annotation":
        steps.annotation(spark, a.vcf, a.segments, a.out)
    elif a.step == "categorization":
        steps.categorization(spark, a.vcf, a.genes, a.scores, a.score_column, a.threshold, a.out, a.redundant)
    elif a.step == "extract_variant":
        steps.extract_variant(
            spark, a.vcf, a.genes, a.scores, a.score_column, a.threshold, a.out, a.category_set, a.annotation_info
        )
    elif a.step == "binomial_test":
        steps.binomial_test(spark, a.counts, a.samples, a.out, a.factors, a.carriers)
    elif a.step == "permutation_test":
        steps.permutation_test(spark, a.counts, a.samples, a.out, a.factors, a.carriers, a.trials, a.burden_shift)
    elif a.step == "risk_score":
        steps.risk_score(
            spark, a.counts, a.samples, a.out, a.factors, a.carriers, a.rare_below, a.train_fraction,
            a.regressions, a.folds, a.permutations, a.seed, a.domains,
            [EACH] * a.each_annotation + [WITHOUT] * a.without_annotation, a.dimensions,
        )
    elif a.step == "correlation":
        inputs = (a.vcf, a.genes, a.scores, a.score_column, a.threshold)
        steps.correlation(spark, a.counts, a.out, a.level, a.category_info, a.domains, a.intersections, inputs)
    else:
        _, domain = tables.read_counts(spark, a.counts)
        if a.step == "effective_num_test":
            n = steps.effective_num_test(
                spark, a.matrix, a.category_counts, domain, a.samples, a.out, a.format, a.count_threshold, a.components,
                a.category_set, a.domains,
            )
            for name, tests in n.items():
                print(f"effective tests: {tests} ({name})")
        elif a.step == "burden_shift":
            steps.burden_shift(spark, a.burden, a.pvals, a.category_info, a.category_counts, domain, a.out, a.cutoff, a.pval, a.category_sets, a.top)
        else:
            low, high = (int(v) for v in a.k_range.split(","))
            steps.dawn(
                spark, a.vectors, a.matrix, a.permutation, a.category_counts, domain, a.out,
                range(low, high + 1), a.k, a.seed, a.sparsity, a.min_count, a.min_corr, a.min_size, a.leiden, a.resolution,
            )


if __name__ == "__main__":
    main()
