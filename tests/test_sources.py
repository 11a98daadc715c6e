"""Text input: nothing is lost, nothing is decoded to something else, bad input fails."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varicube import cli
from varicube.domain import DIMENSIONS, CategoryDomain
from varicube.functions import annotate, stats
from varicube.operators import netfit, permutation
from varicube.sources import tables, vcf


def test_intervals_with_a_fourth_column(spark, tmp_path):
    (tmp_path / "a.bed").write_text("#head\ntrack name=t\nbrowser position x\nchrom\tstart\tend\tname\n\nchr1\t1\t2\tA\nchr2\t20\t30\tB\nchr3\t100\t200\tC\n")
    path = str(tmp_path / "a.bed")
    assert sorted(map(tuple, tables.read_intervals(spark, path).collect())) == [("chr1", 1, 2), ("chr2", 20, 30), ("chr3", 100, 200)]
    assert tables.read_intervals(spark, path, "chr1").count() == 1
    assert tables.read_intervals(spark, path, "test").count() == 0


@pytest.mark.parametrize("line", ["chr1\tx\t3", "chr1\t1", "chr1 1 2", "chr1\t1\t2.5\tname"])
def test_a_bad_interval_fails(spark, tmp_path, line):
    (tmp_path / "bad.bed").write_text(f"chr1\t1\t2\n{line}\n")
    with pytest.raises(Exception, match="not an interval"):
        tables.read_intervals(spark, str(tmp_path / "bad.bed")).collect()


def test_undeclared_info_keys_survive(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(
        '##INFO=<ID=CSQ,Description="Format: CSQ1|CSQ2|CSQ3">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n'
        "chr1\t1\t.\tA\tG\t.\t.\tSAMPLE=A;BATCH=1;CSQ=1|2|3\nchr1\t2\t.\tA\tG\t.\t.\tSAMPLE=B;LATE=x=y;CSQ=2|3|1\n"
    )
    rows, _ = vcf.read_variants(spark, str(tmp_path / "a.vcf"))
    got = [r.asDict() for r in rows.orderBy("POS").collect()]
    assert [(r["SAMPLE"], r["BATCH"], r["LATE"], r["CSQ1"], r["CSQ3"]) for r in got] == [("A", "1", None, "1", "3"), ("B", None, "x=y", "2", "1")]


def test_more_tracks_than_a_mask_holds(spark, tmp_path):
    (tmp_path / "in.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n")
    header = vcf.read_header(spark, str(tmp_path / "in.vcf"))
    rows = spark.createDataFrame(
        [("chr1", "1", ".", "A", "G", ".", ".", "SAMPLE=a", [0, 65]), ("chr1", "2", ".", "A", "G", ".", ".", "SAMPLE=b", [])],
        "CHROM string, POS string, ID string, REF string, ALT string, QUAL string, FILTER string, INFO string, ANNOT array<int>",
    )
    names = [f"t{i}" for i in range(66)]
    vcf.write_annotated(rows, header, names, str(tmp_path / "out"))
    back, found = vcf.read_variants(spark, str(tmp_path / "out"))
    assert list(found.tracks) == names
    got = {r["SAMPLE"]: r for r in back.select("SAMPLE", "ANNOT", *annotate.mask_columns(F.col("ANNOT"), names, True)).collect()}
    assert got["a"]["ANNOT"] == [0, 65] and got["b"]["ANNOT"] == []
    assert (got["a"]["t0"], got["a"]["t1"], got["a"]["t65"], got["b"]["t0"]) == (1, 0, 1, 0)


def test_chromosomes_in_version_order(spark):
    names = ["chr10", "2", "10", "chr2", "X"]
    frame = spark.createDataFrame([(n,) for n in names], "c string").withColumn("r", vcf.chromosome_rank(F.col("c")))
    assert {r["c"]: r["r"] for r in frame.collect()} == {"chr10": 10, "2": 2, "10": 10, "chr2": 2, "X": 1_000_000}


DOMAIN = CategoryDomain(("ProteinCoding", "ASD_risk", "ASD"), ("Cons",), ("Enh_a", "Enh"))


def test_terms_with_underscores(spark):
    key = "SNV_ASD_risk_Cons_IntronRegion_Enh_a"
    terms = ("SNV", "ASD_risk", "Cons", "IntronRegion", "Enh_a")
    by_key = tables.with_codes(spark.createDataFrame([(key,)], "Category string"), DOMAIN).withColumn("again", DOMAIN.key(F.col("code"))).first()
    assert by_key["again"] == key
    columns = ", ".join(f"{n} string" for n in ("Category", *DIMENSIONS))
    assert tables.with_codes(spark.createDataFrame([(key, *terms)], columns), DOMAIN).first()["code"] == by_key["code"]


@pytest.mark.parametrize("key", ["SNV_ASD_All_IntronRegion_Typo", "SNV_Nope_All_Any_Any", "SNV_ASD_All_Any", None, ""])
def test_unknown_categories_fail(spark, key):
    with pytest.raises(Exception, match="category outside the domain"):
        tables.with_codes(spark.createDataFrame([(key,)], "Category string"), DOMAIN).collect()


@pytest.mark.parametrize("x,n,p,tail", [(600, 10_000, 0.01, 9.508647351738116e-258), (300, 3_000, 0.01, 1.5366986674347134e-190)])
def test_deep_tails(x, n, p, tail):
    from decimal import Decimal, localcontext
    from math import comb

    with localcontext(prec=60):
        q = Decimal(p)
        mass = Decimal(comb(n, x)) * q**x * (1 - q) ** (n - x)
        exact = Decimal(0)
        for k in range(x, x + 200):
            exact += mass
            mass *= Decimal(n - k) / Decimal(k + 1) * q / (1 - q)
    exact = float(exact)
    two_sided, greater = stats.binomial_tails(x, n, p)
    assert greater == pytest.approx(exact, rel=1e-9) and two_sided == pytest.approx(tail, rel=1e-9)


def test_tails_by_full_sums():
    from fractions import Fraction
    from math import comb

    for n in (1, 2, 7, 40):
        for p in (0.03, 0.5, 0.77):
            q = Fraction(p)
            mass = [comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(n + 1)]
            for x in range(n + 1):
                two = 1.0 if x == n * p else float(sum(m for m in mass if m <= mass[x] * (1 + Fraction(1, 10**7))))
                assert stats.binomial_tails(x, n, p) == pytest.approx((two, float(sum(mass[x:]))), rel=1e-10)


def test_sparse_direction_meets_its_bound():
    rng = np.random.default_rng(3)
    for bound in (1.0, 1.7, 3.0):
        for _ in range(50):
            v = rng.normal(size=20)
            u = netfit.sparse_direction(v, bound)
            assert np.linalg.norm(u) == pytest.approx(1) and np.abs(u).sum() <= bound + 1e-6
            # No other unit vector within the bound is nearer in angle.
            for _ in range(20):
                w = netfit.sparse_direction(v + rng.normal(size=20) * 0.3, bound)
                assert w @ v <= u @ v + 1e-9
    assert netfit.sparse_direction(np.zeros(3), 2.0).tolist() == [0, 0, 0]


def test_leading_vector_of_a_block():
    block = np.zeros((40, 40))
    block[:6, :6] = 0.9
    np.fill_diagonal(block, 1.0)
    v = netfit.leading_vector(block, 2.4)
    assert set(np.flatnonzero(np.abs(v) > 1e-5)) <= set(range(6))
    assert np.abs(netfit.leading_vector(block, None) @ np.linalg.eigh(block)[1][:, -1]) == pytest.approx(1)


def test_swap_keeps_the_case_number(spark):
    rows = [(f"s{i}", f"f{i // 2}", ("case", "ctrl")[i % 2]) for i in range(60)] + [("alone", "f99", "case")]
    frame = spark.createDataFrame(rows, "SAMPLE string, FAMILY string, PHENOTYPE string")
    got = permutation.swap_within_groups(frame, "FAMILY", "PHENOTYPE", 7).collect()
    assert sum(r["swapped"] == "case" for r in got) == 31
    changed = {r["FAMILY"] for r in got if r["swapped"] != r["PHENOTYPE"]}
    assert 5 < len(changed) < 25 and "f99" not in changed
    with pytest.raises(Exception, match="more than two rows"):
        permutation.swap_within_groups(frame.union(frame.limit(1)), "FAMILY", "PHENOTYPE", 7).collect()


@pytest.mark.parametrize("argv", [
    ["correlation", "--counts", "c", "--level", "varient", "--out", "o"],
    ["correlation", "--counts", "c", "--level", "variant", "--out", "o"],
    ["effective_num_test", "--matrix", "m", "--counts", "c", "--category-counts", "k", "--out", "o"],
])
def test_command_line_refuses(argv, capsys):
    with pytest.raises(SystemExit):
        cli.main(argv)


def test_leading_vector_refuses_an_undefined_correlation():
    block = np.full((40, 40), 0.5)
    block[3, 7] = np.nan
    for bound in (None, 2.4):
        with pytest.raises(ValueError):
            netfit.leading_vector(block, bound)
