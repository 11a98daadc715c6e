import math
import random
from itertools import product
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from varicube.domain import DIMENSIONS, CategoryDomain
from varicube.functions import annotate, stats
from varicube.operators import burden, cube, gram, intervals, keys, netfit, ordered, permutation, risk, spectrum
from varicube.sources import tables, vcf

TRACKS = [(0, 100, 300), (0, 1000, 1100), (1, 200, 400), (1, 1150, 1200), (2, 250, 350), (2, 1250, 1350)]
SEGMENTS = [
    (100, 200, 1), (200, 250, 3), (250, 300, 7), (300, 350, 6), (350, 400, 2), (1000, 1100, 1), (1150, 1200, 2), (1250, 1350, 4),
]
COUNTS = {"Sample1": (5, 4), "Sample2": (10, 16), "Sample3": (12, 8), "Sample4": (7, 11), "Sample5": (8, 6), "Sample6": (15, 10)}
FACTORS = {"Sample1": 2.0, "Sample2": 0.5, "Sample3": 0.25, "Sample4": 1.0, "Sample5": 0.5, "Sample6": 0.2}
CASES = ("Sample1", "Sample3")


def track_frame(spark, rows=TRACKS):
    return spark.createDataFrame([("chr1", s, e, t) for t, s, e in rows], "chrom string, start bigint, end bigint, track int")


@pytest.mark.parametrize("width", [64, 1 << 16])
def test_coverage_segments(spark, width):
    found = intervals.coverage_segments(track_frame(spark), 3, width).orderBy("start").collect()
    assert [(r["start"], r["end"], r["mask"]) for r in found] == SEGMENTS


def test_coverage_with_one_hot_chromosome_matches_brute_force(spark):
    rng = np.random.RandomState(1)
    rows = [(int(t), int(s), int(s + w)) for t, s, w in zip(rng.randint(0, 4, 400), rng.randint(0, 2000, 400), rng.randint(1, 60, 400))]
    ends = sorted({x for _, s, e in rows for x in (s, e)})
    expected = []
    for a, b in zip(ends, ends[1:]):
        mask = 0
        for t, s, e in rows:
            if s < b and a < e:
                mask |= 1 << t
        if mask:
            expected.append((a, b, mask))
    for width in (50, 333):
        found = intervals.coverage_segments(track_frame(spark, rows), 4, width).orderBy("start").collect()
        assert [(r["start"], r["end"], r["mask"]) for r in found] == expected


def test_coverage_beyond_62_tracks_gives_ids(spark):
    rows = [(0, 10, 20), (65, 15, 30)]
    found = intervals.coverage_segments(track_frame(spark, rows), 66).orderBy("start").collect()
    assert [(r["start"], r["end"], r["mask"]) for r in found] == [(10, 15, [0]), (15, 20, [0, 65]), (20, 30, [65])]


def test_overlap_annotation(spark):
    segments = intervals.coverage_segments(track_frame(spark), 3)
    rows = [
        ("chr1", 101, "A", "G"), ("chr1", 100, "A", "G"), ("chr1", 100, "A", "GT"), ("chr1", 199, "ACG", "A"), ("chr2", 150, "A", "C"),
        ("chr1", 300, "A", "G"), ("chr1", 301, "A", "G"),
    ]
    variants = spark.createDataFrame(rows, "CHROM string, POS bigint, REF string, ALT string")
    found = {(r["CHROM"], r["POS"], r["REF"], r["ALT"]): r["ANNOT"] for r in intervals.annotate_overlaps(variants, segments, 16).collect()}
    assert found == dict(zip(rows, [1, 0, 1, 3, 0, 7, 6]))


def test_info_and_header_parsing(spark):
    assert vcf.csq_field_names('##INFO=<ID=CSQ,Number=.,Description="x Format: Test1|Test2|Test3">') == ["Test1", "Test2", "Test3"]
    assert vcf.track_field_names("##INFO=<ID=ANNOT,Key=a|b|c>\n") == ["a", "b", "c"]
    row = spark.createDataFrame([("SAMPLE=A;BATCH=1;CSQ=1|2|3;ANNOT=7;X=a=b;FLAG",)], "INFO string")
    info = row.select(vcf.info_map(F.col("INFO")).alias("m")).first()["m"]
    assert info == {"SAMPLE": "A", "BATCH": "1", "CSQ": "1|2|3", "ANNOT": "7", "X": "a=b", "FLAG": None}


@pytest.mark.parametrize("mask,names", [(0, []), (1, ["a"]), (3, ["a", "b"]), (4, ["c"]), (11, ["a", "b", "d"]), (13, ["a", "c", "d"])])
def test_mask_terms(spark, mask, names):
    row = spark.range(1).select(annotate.mask_terms(F.lit(mask).cast("bigint"), "abcd").alias("t")).first()
    assert row["t"] == names


def test_gene_matrix_last_row_wins(spark, tmp_path):
    path = tmp_path / "genes.txt"
    path.write_text("gene_id\tgene_name\tasd1\tasd2\nE1\tg1\t1\t0\nE2\tg2\t0\t1\nE3\tg1\t0\t1\nE4\tg3\t2\t0\n")
    sets, names = tables.read_gene_matrix(spark, str(path))
    assert names == ["asd1", "asd2"]
    assert {r["gene_name"]: r["gene_sets"] for r in sets.collect()} == {"g1": ["asd2"], "g2": ["asd2"], "g3": []}


def test_gencode_cascade(spark):
    cases = [
        ("stop_gained", ["ProteinCoding"], "HC", "", "", ["Any", "CodingRegion", "PTVRegion"]),
        ("stop_gained", ["ProteinCoding"], "LC", "", "", ["Any", "CodingRegion"]),
        ("frameshift_variant", ["ProteinCoding"], "HC", "SINGLE_EXON", "", ["Any", "CodingRegion", "FrameshiftRegion", "PTVRegion"]),
        ("missense_variant", ["ProteinCoding"], "", "", "1&3", ["Any", "CodingRegion", "DamagingMissenseRegion", "MissenseRegion"]),
        ("missense_variant", ["ProteinCoding"], "", "", "NA", ["Any", "CodingRegion", "MissenseRegion"]),
        ("intron_variant", ["ProteinCoding"], "", "", "", ["Any", "NoncodingRegion", "IntronRegion"]),
        ("non_coding_transcript_variant", ["ProteinCoding"], "", "", "", ["Any", "NoncodingRegion"]),
        ("non_coding_transcript_variant", ["lincRNA"], "", "", "", ["Any", "NoncodingRegion", "lincRnaRegion"]),
        ("missense_variant", [], "", "", "", ["Any", "NoncodingRegion", "OtherTranscriptRegion"]),
    ]
    frame = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, c string, g array<string>, l string, f string, s string")
    found = frame.select("i", annotate.gencode_terms(*[F.col(x) for x in "cglfs"], 2.0).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in found] == [c[5] for c in cases]


def cohort_frames(spark):
    counts = spark.createDataFrame([(s, c, n) for s, v in COUNTS.items() for c, n in enumerate(v)], "SAMPLE string, code bigint, n bigint")
    people = spark.createDataFrame([(s, "case" if s in CASES else "ctrl") for s in COUNTS], "SAMPLE string, PHENOTYPE string")
    factors = spark.createDataFrame(list(FACTORS.items()), "SAMPLE string, AdjustFactor double")
    return counts, people, factors


def test_burden_counts_and_risk(spark):
    counts, people, factors = cohort_frames(spark)
    size = burden.cohort(people)
    assert (size.cases, size.controls, size.case_share) == (2, 4, 1 / 3)
    rows = burden.adjusted(counts, factors)
    table = burden.burden_table(rows, people, size, F.col("adjusted")).orderBy("code").collect()
    assert [r["Case_DNV_Count"] for r in table] == [13.0, 10.0]
    assert [r["Ctrl_DNV_Count"] for r in table] == pytest.approx([19.0, 24.0])
    assert [r["Relative_Risk"] for r in table] == pytest.approx([(13 / 2) / (19 / 4), (10 / 2) / (24 / 4)])


def test_sample_set_mismatch_raises(spark):
    counts, _, _ = cohort_frames(spark)
    with pytest.raises(ValueError):
        keys.require_same_keys(counts, spark.createDataFrame([("SampleA",)], "SAMPLE string"), "SAMPLE", "samples")


def test_exact_binomial_against_enumeration():
    for x, n, p in [(13, 32, 1 / 3), (10, 34, 1 / 3), (0, 5, 0.3), (5, 5, 0.3), (40, 300, 0.2)]:
        mass = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
        two, greater = stats.binomial_tails(x, n, p)
        assert greater == pytest.approx(sum(mass[x:]), rel=1e-9)
        assert two == pytest.approx(min(1.0, sum(m for m in mass if m <= mass[x] * (1 + 1e-7))), rel=1e-9)
    assert stats.binomial_tails(13, 32, 1 / 3)[0] == pytest.approx(0.4532065869, abs=1e-9)
    assert stats.binomial_tails(0, 0, 0.4) == (1.0, 1.0)
    assert 0.0 <= stats.binomial_tails(120_000, 255_106, 0.5)[0] < 1e-100


def test_normal_quantile(spark):
    points = [1e-12, 1e-5, 0.02, 0.3, 0.5, 0.8, 0.999, 1 - 1e-9]
    found = spark.createDataFrame([(p,) for p in points], "p double").select("p", stats.normal_quantile(F.col("p")).alias("z")).collect()
    for r in found:
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-9)


def test_category_codes_round_trip(spark):
    domain = CategoryDomain(("G1", "G2"), ("S",), ("A", "B"))
    combos = list(product(*[domain.terms[d] for d in DIMENSIONS]))
    frame = spark.createDataFrame(combos, list(DIMENSIONS)).withColumn("code", domain.encode(*[F.col(d) for d in DIMENSIONS]))
    rows = frame.select(*DIMENSIONS, "code", F.struct(*domain.decode(F.col("code"))).alias("back")).collect()
    assert len({r["code"] for r in rows}) == domain.size == len(combos)
    assert all(tuple(r["back"]) == tuple(r[d] for d in DIMENSIONS) for r in rows)


def test_blocked_product_across_blocks(spark, monkeypatch):
    rng = np.random.RandomState(3)
    x = (rng.rand(40, 2500) < 0.01).astype(int)
    rows = [(i, [int(c) for c in np.flatnonzero(x[i])], int(i % 3 + 1)) for i in range(40)]
    frame = spark.createDataFrame(rows, "id bigint, codes array<bigint>, w bigint")
    found = gram.both_triangles(gram.co_occurrence(frame, 2500, weight="w", salt="id")).collect()
    weights = np.array([r[2] for r in rows])
    expected = x.T @ (x * weights[:, None])
    dense = np.zeros_like(expected)
    for r in found:
        dense[r["code_i"], r["code_j"]] += r["n"]
    assert (dense == expected).all()


def test_seeded_permutation_matches_numpy(spark):
    counts, people, _ = cohort_frames(spark)
    size = burden.cohort(people)
    found = permutation.permuted_counts(counts, people, size, 7, 2, F.col("n")).collect()
    x = np.array([COUNTS[s] for s in sorted(COUNTS)])
    for r in found:
        drawn = np.random.RandomState(10000 + r["trial"]).choice(range(6), 2, replace=False)
        case = x[drawn, r["code"]].sum()
        assert (r["case_n"], r["ctrl_n"]) == (case, x[:, r["code"]].sum() - case)
    assert len(found) == 14


def test_global_order_helpers(spark):
    rng = np.random.RandomState(5)
    p = np.round(rng.rand(200), 2)
    p[:70] = 0.5  # one value holds a third of the rows
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "id bigint, p double")
    order = np.lexsort((np.arange(200), p))
    raw = p[order] * 200 / np.arange(1, 201)
    adjusted = np.minimum(1.0, np.minimum.accumulate(raw[::-1])[::-1])
    found = {r["id"]: r["FDR"] for r in ordered.benjamini_hochberg(frame, "p", "id").collect()}
    assert [found[i] for i in order] == pytest.approx(list(adjusted))
    means = {r["id"]: r["m"] for r in ordered.running_mean(frame, "p", "id", "m").collect()}
    assert [means[i] for i in order] == pytest.approx(list(np.cumsum(p[order]) / np.arange(1, 201)))


def test_effective_number(spark):
    values = spark.createDataFrame([(1, 5.0), (2, 3.0), (3, 1.95), (4, 0.05), (5, -1e-15)], "position bigint, value double")
    assert spectrum.effective_number(values) == 3


def test_lasso_recovers_signal_and_satisfies_optimality():
    rng = np.random.RandomState(2)
    x, fold = rng.randn(400, 12), np.arange(400) % 6
    y = 2.0 * x[:, 3] - 1.0 * x[:, 7] + 0.1 * rng.randn(400)
    z = np.concatenate([np.ones((400, 1)), x, y[:, None]], axis=1)
    moments = np.array([z[fold == f].T @ z[fold == f] for f in range(6)])
    penalty, r2, beta = risk.fit_folds(moments, np.ones(12, bool))
    assert r2 > 0.98 and beta[3] == pytest.approx(2.0, abs=0.1) and beta[7] == pytest.approx(-1.0, abs=0.1)
    train = x[fold > 0]
    gradient = ((train - train.mean(0)) / train.std(0)).T @ (y[fold > 0] - y[fold > 0].mean() - (train - train.mean(0)) @ beta) / len(train)
    assert np.abs(gradient).max() <= penalty + 1e-2


def test_hidden_field_keeps_input_order():
    z = np.array([0.1, 3.0, -0.2, 2.8, 0.0])
    adjacency = np.zeros((5, 5))
    adjacency[1, 3] = adjacency[3, 1] = 1.0
    field = netfit.hidden_field(z, adjacency)
    assert field["indicator"].tolist() == [0, 1, 0, 1, 0]
    assert field["posterior"][1] > 0.5 > field["posterior"][0]


def test_total_category_counts_every_variant(spark):
    from varicube.plans import model

    row = model.totals(spark, "/root/testdata/sf0.001").withColumn("Category", model.DOMAIN.key(F.col("code")))
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert row.where("Category = 'All_Any_All_Any_Any'").first()["n"] == lines


def test_domain_list_choice():
    flags = ["Category", "is_coding", "is_PTV"]
    assert tables.choose_domains("run_all", flags) == ["all", "coding", "PTV"]
    assert tables.choose_domains("all, ptv", flags) == ["all", "PTV"]
    with pytest.raises(ValueError):
        tables.choose_domains("nothing", flags)


def test_rule_table_keeps_sibling_terms(spark):
    rows = [("All", "Any", "All", "PTVRegion", "Any"), ("All", "G", "All", "PTVRegion", "Any")]
    rules = spark.createDataFrame([("*", "Any", "*", "PTVRegion", "*")], list(DIMENSIONS))
    kept = cube.drop_by_rule_table(spark.createDataFrame(rows, list(DIMENSIONS)), rules).collect()
    assert [r["gene_set"] for r in kept] == ["G"]


def test_exceedances_in_tiles_equal_those_of_trial_rows(spark):
    draw = random.Random(8)
    codes, n_codes, trials = (0, 1, 255, 256, 300, 420), 421, 600  # several code and trial blocks
    rows = [(f"s{i:02d}", c, draw.randint(0, 4)) for i in range(24) for c in codes[:-1] if draw.random() < 0.4]
    rows += [("other", 420, 3)]  # a category of nobody who takes part
    counts = spark.createDataFrame(rows, "SAMPLE string, code bigint, n bigint")
    people = spark.createDataFrame([(f"s{i:02d}", "case" if i % 3 else "ctrl") for i in range(24)] + [("other", "unknown")], "SAMPLE string, PHENOTYPE string")
    size = burden.cohort(people)
    observed = spark.createDataFrame([(c, r) for c, r in zip(codes, (1.2, 0.7, float("inf"), float("nan"), 1.0, 0.0))], "code bigint, Relative_Risk double")
    for carriers in (False, True):
        made = permutation.permuted_counts(counts, people, size, trials, n_codes, F.col("n"), carriers)
        want = permutation.permutation_p(permutation.permuted_risk(made, size), observed, trials)
        got = permutation.tiled_p(counts, people, size, observed, trials, n_codes, F.col("n"), carriers)
        as_text = lambda frame: sorted(str((r["code"], r["Relative_Risk"], r["n_extreme"], r["P"])) for r in frame.collect())
        assert as_text(got) == as_text(want) and got.count() == 6
    two = {r["code"]: r["P"] for r in permutation.two_stage_p(counts, people, size, observed, 100, n_codes, F.col("n"), cut=0.5).collect()}
    rows = permutation.permuted_counts(counts, people, size, 100, n_codes, F.col("n"))
    given = {r["code"]: r["P"] for r in permutation.two_stage_p(counts, people, size, observed, 100, n_codes, F.col("n"), cut=0.5, trials=rows).collect()}
    assert two == given
