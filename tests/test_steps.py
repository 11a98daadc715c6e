"""The whole analysis on small files."""

import gzip

import numpy as np
from pyspark.sql import functions as F

from varicube.plans import steps
from varicube.sources import tables
from varicube.streaming import incremental

WORDS = ("stop_gained", "missense_variant", "synonymous_variant", "intron_variant", "intergenic_variant", "upstream_gene_variant", "frameshift_variant")


def write_inputs(folder):
    rng = np.random.RandomState(11)
    for name in ("score", "enhancer"):
        with gzip.open(folder / f"{name}.bed.gz", "wt") as out:
            print("#chrom", "start", "end", sep="\t", file=out)
            for start in sorted(rng.choice(5000, 60, replace=False)):
                print("chr1", start, start + rng.randint(1, 80), sep="\t", file=out)
    (folder / "genes.txt").write_text(
        "gene_id\tgene_name\tProteinCoding\tlincRNA\tRisk\n" + "".join(f"E{i}\tg{i}\t{int(i < 6)}\t{int(i == 7)}\t{int(i % 2)}\n" for i in range(9))
    )
    with gzip.open(folder / "in.vcf.gz", "wt") as out:
        print("##INFO=<ID=SAMPLE,Number=1>", file=out)
        print('##INFO=<ID=CSQ,Description="Format: Consequence|SYMBOL|NEAREST|LoF|LoF_flags|MisDb_MPC">', file=out)
        print("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", sep="\t", file=out)
        for i in range(900):
            word = WORDS[rng.randint(len(WORDS))]
            csq = f"{word}|g{rng.randint(9)}|g{rng.randint(9)}|HC||{rng.randint(1, 4)}"
            ref, alt = (("A", "G"), ("AC", "A"), ("A", "AT"))[rng.randint(3)]
            print("chr1", rng.randint(1, 5200), f"v{i}", ref, alt, ".", ".", f"SAMPLE=s{i % 30};CSQ={csq}", sep="\t", file=out)
    (folder / "samples.txt").write_text("SAMPLE\tPHENOTYPE\n" + "".join(f"s{i}\t{'case' if i % 3 == 0 else 'ctrl'}\n" for i in range(30)))


def test_pipeline(spark, tmp_path):
    write_inputs(tmp_path)
    at = lambda name: str(tmp_path / name)
    steps.preparation(spark, [(at("score.bed.gz"), "score"), (at("enhancer.bed.gz"), "enhancer")], at("prep"))
    steps.annotation(spark, at("in.vcf.gz"), at("prep"), at("annotated"))
    source = (at("annotated"), at("genes.txt"), ["score"], "MisDb_MPC", 2.0)
    steps.categorization(spark, *source, at("cat"))
    counts, domain = tables.read_counts(spark, at("cat"))
    keyed = counts.withColumn("Category", domain.key(F.col("code")))
    assert keyed.where("Category = 'All_Any_All_Any_Any'").agg(F.sum("n")).first()[0] == 900
    assert domain.scores == ("score",) and domain.annotations == ("enhancer",)

    steps.binomial_test(spark, at("cat"), at("samples.txt"), at("binom"))
    table = tables.read_table(spark, at("binom/burden_test"))
    whole = table.where("Category = 'All_Any_All_Any_Any'").first()
    assert (whole["Case_DNV_Count"], whole["Ctrl_DNV_Count"]) == (300, 600)

    steps.permutation_test(spark, at("cat"), at("samples.txt"), at("perm"), trials=20, burden_shift=True)
    p = [r["P"] for r in tables.read_table(spark, at("perm/burden_test")).select("P").where("P is not null").collect()]
    assert p and min(p) >= 1 / 201 and max(p) <= 1

    steps.burden_shift(
        spark, at("binom/burden_test"), at("perm/binom_pvals"), at("binom/category_info"), at("binom/category_counts"), domain, at("shift")
    )
    assert tables.read_table(spark, at("shift/burdenshift_p0.05_cutoff7")).where("category_set = 'All'").count() == 1

    steps.correlation(spark, at("cat"), at("corr"), "variant", at("binom/category_info"), "all,noncoding", True, source)
    pairs = spark.read.parquet(at("corr/correlation_matrix/domain=all"))
    own = pairs.where("code_i = code_j").select(F.min("corr"), F.max("corr")).first()
    assert abs(own[0] - 1) < 1e-12 and abs(own[1] - 1) < 1e-12

    n = steps.effective_num_test(
        spark, at("corr/correlation_matrix/domain=all"), at("binom/category_counts"), domain, at("samples.txt"), at("eff")
    )["all"]
    assert 0 < n <= table.count()

    category = "All_Any_score_Any_Any"
    (tmp_path / "set.txt").write_text(f"Category\n{category}\n")
    steps.extract_variant(spark, *source, at("extract"), at("set.txt"))
    found = tables.read_table(spark, at("extract/extracted_variants")).count()
    assert found == keyed.where(F.col("Category") == category).agg(F.sum("n")).first()[0]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    """All eleven steps by their command line, risk score and network included."""
    from varicube import cli

    monkeypatch.setattr(cli, "build_session", lambda app: spark)
    write_inputs(tmp_path)
    at = lambda name: str(tmp_path / name)
    run = lambda text: cli.main(text.format(**places).split())
    places = {n: at(n) for n in ("prep", "annotated", "cat", "binom", "perm", "shift", "corr", "eff", "extract", "risk", "net")}
    places |= {"score": at("score.bed.gz"), "enhancer": at("enhancer.bed.gz"), "vcf": at("in.vcf.gz"), "genes": at("genes.txt"), "samples": at("samples.txt")}
    source = "--vcf {annotated} --genes {genes} --scores score --score-column MisDb_MPC --threshold 2"
    run("preparation --tracks {score}=score {enhancer}=enhancer --out {prep}")
    run("annotation --vcf {vcf} --segments {prep} --out {annotated}")
    run(f"categorization {source} --out {{cat}}")
    run("binomial_test --counts {cat} --samples {samples} --out {binom}")
    run("permutation_test --counts {cat} --samples {samples} --trials 20 --burden-shift --out {perm}")
    run("burden_shift --counts {cat} --burden {binom}/burden_test --pvals {perm}/binom_pvals --category-info {binom}/category_info --category-counts {binom}/category_counts --out {shift}")
    shown = tables.read_table(spark, places["shift"] + "/burdenshift_shown")
    assert 0 < shown.select("category_set").distinct().count() <= 10 and shown.count() == 2 * shown.select("category_set").distinct().count()
    (tmp_path / "sets.txt").write_text("coding\n\nscore&Risk\nno_such_set\ncoding\n")
    run(f"burden_shift --counts {{cat}} --burden {{binom}}/burden_test --pvals {{perm}}/binom_pvals --category-info {{binom}}/category_info --category-counts {{binom}}/category_counts --category-sets {at('sets.txt')} --cutoff 1 --out {{shift}}")
    shown = tables.read_table(spark, places["shift"] + "/burdenshift_shown").collect()
    assert {r["category_set"] for r in shown} == {"is_coding", "is_score_Risk"}, shown
    assert {r["domain"] for r in shown} == {"Coding (All)", "Others"} and all(float(r["neg_log10_p"]) >= 0 for r in shown)
    run("correlation --counts {cat} --level sample --out {corr}")
    run("effective_num_test --counts {cat} --matrix {corr}/correlation_matrix/domain=all --category-counts {binom}/category_counts --samples {samples} --out {eff}")
    assert "effective tests:" in capsys.readouterr().out
    run("effective_num_test --counts {cat} --matrix {corr}/correlation_matrix/domain=all --category-counts {binom}/category_counts --count-threshold 1 --category-set {binom}/category_info --domains all,Coding --out {risk}_eff")
    lines = [line for line in capsys.readouterr().out.splitlines() if line.startswith("effective tests:")]
    assert [line.split("(")[1] for line in lines] == ["all)", "coding)"] and int(lines[1].split()[2]) <= int(lines[0].split()[2])
    (tmp_path / "rules.txt").write_text("variant_type\tgene_set\tfunctional_score\tgencode\tfunctional_annotation\nSNV\t*\t*\t*\t*\n")
    run(f"categorization {source} --redundant {at('rules.txt')} --out {{cat}}_rules")
    terms = tables.read_counts(spark, places["cat"] + "_rules")
    assert {r[0] for r in terms[0].select(terms[1].decode(F.col("code"))[0]).distinct().collect()} == {"All", "Indel"}
    run(f"extract_variant {source} --annotation-info --out {{extract}}")
    extracted = tables.read_table(spark, places["extract"] + "/extracted_variants")
    assert {"CLASS", "ProteinCoding", "Risk", "score", "enhancer"} <= set(extracted.columns) and extracted.count() == 900
    run("risk_score --counts {cat} --samples {samples} --regressions 2 --permutations 2 --rare-below 8 --out {risk}")
    results = tables.read_table(spark, places["risk"] + "/lasso_results")
    assert sorted(r["seed"] for r in results.collect()) == ["42", "52", "average"]
    null = tables.read_table(spark, places["risk"] + "/lasso_null_models")
    assert sorted(r["permutation"] for r in null.collect()) == ["42", "43", "average"] and "std" in null.columns
    run("risk_score --counts {cat} --samples {samples} --regressions 2 --permutations 0 --rare-below 8 --domains all,Noncoding --without-annotation --dimensions gene_set --out {risk}")
    results = tables.read_table(spark, places["risk"] + "/lasso_results").where("seed = 'average'")
    assert {(r["domain"], r["mode"], r["dimension"]) for r in results.collect()} == {(d, "without", "gene_set") for d in ("all", "noncoding")}
    assert {r["term"] for r in results.collect()} == {"Risk", "ProteinCoding", "lincRNA"}
    try:
        run("dawn --counts {cat} --vectors {eff}/eig_vecs --matrix {corr}/correlation_matrix/domain=all --permutation {perm}/burden_test --category-counts {binom}/category_counts --k 4 --out {net}")
    except ValueError as error:
        assert "no cluster exceeds" in str(error)  # the data hold no signal; the network itself is there
    assert tables.read_table(spark, places["net"] + "/cluster_terms").count() >= 1


def test_incremental_counts_equal_batch(spark, tmp_path):
    from varicube.operators.cube import category_counts
    from varicube.plans import star_tables as star

    termed = star.termed_variants(spark, "/root/testdata/sf0.001").select("SAMPLE", "vt", "gs", "fs", "gc", "fa")
    folder = str(tmp_path / "arriving")
    termed.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(termed.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    incremental.follow(stream, star.DOMAIN, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    summed = incremental.totals(spark, str(tmp_path / "out"))
    batch = category_counts(termed, star.DOMAIN)
    assert summed.exceptAll(batch).isEmpty() and batch.exceptAll(summed).isEmpty()
