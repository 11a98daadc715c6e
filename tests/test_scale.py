"""Plans and kernels whose cost must follow the samples and signatures, not the category rows."""

import hashlib
import io
from contextlib import redirect_stdout

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varicube.domain import CategoryDomain
from varicube.functions import annotate
from varicube.operators import burden, cube, gram, grid, keys, permutation

DOMAIN = CategoryDomain(("Risk", "lincRNA"), ("score",), ("enhancer",))


def termed(spark):
    """A sample with most variants, a null sample, and one-variant samples."""
    rng = np.random.RandomState(3)
    pick = lambda first, offered: [first, *(t for t in offered if rng.rand() < 0.5)]
    rows = []
    for i in range(400):
        sample = "hot" if i % 2 else None if i % 10 == 0 else f"s{i:03d}" if i % 4 else f"t{i % 7}"
        region = [["CodingRegion", "MissenseRegion"], ["NoncodingRegion", "IntronRegion"], ["CodingRegion", "FrameshiftRegion", "PTVRegion"]][i % 3]
        rows.append((sample, ["All", "SNV" if i % 5 else "Indel"], pick("Any", ["Risk"]), pick("All", ["score"]), ["Any", *region], pick("Any", ["enhancer"])))
    kind = ", ".join(f"{a} array<string>" for a in cube.TERM_ARRAYS)
    return spark.createDataFrame(rows, f"SAMPLE string, {kind}")


def plan_of(frame):
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain()
    return out.getvalue()


def expected(rows):
    """Every variant spelled out, without packing."""
    wide = rows
    for a, d in cube.ARRAY_DIMENSIONS.items():
        wide = wide.withColumn(d, F.explode(a))
    kept = cube.drop_redundant(wide)
    return {(r[0], r[1]): r[2] for r in kept.groupBy("SAMPLE", DOMAIN.encode(*map(F.col, cube.ARRAY_DIMENSIONS.values())).alias("code")).count().collect()}


@pytest.mark.parametrize("batch", ["1", "7", "10000"])
def test_counts_of_samples_that_cross_batches(spark, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = cube.category_counts(termed(spark), DOMAIN).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = expected(termed(spark))
    assert len(found) == len(want) and {(r[0], r[1]): r[2] for r in found} == want


def test_unpacked_totals_agree(spark):
    found = cube.expand(cube.packed_signatures(termed(spark), DOMAIN, []), DOMAIN, []).groupBy("code").agg(F.sum("n"))
    want = {}
    for (_, code), n in expected(termed(spark)).items():
        want[code] = want.get(code, 0) + n
    assert {r[0]: r[1] for r in found.collect()} == want


def test_category_rows_are_not_shuffled(spark):
    assert "hashpartitioning(SAMPLE" in plan_of(cube.category_counts(termed(spark), DOMAIN))
    assert ", code#" not in "".join(line for line in plan_of(cube.category_counts(termed(spark), DOMAIN)).splitlines() if "Exchange" in line)


def test_tiles_are_as_high_as_their_trials(spark):
    counts = spark.createDataFrame([(f"s{i}", i % 3, i + 1) for i in range(9)], "SAMPLE string, code bigint, n bigint")
    rows = grid.gathered(counts.withColumnRenamed("n", "value")).withColumn("ordinal", F.substring("SAMPLE", 2, 1).cast("bigint"))
    tiles = permutation.trial_tiles(rows, permutation.seeded_labels(spark, 9, 4, 20), 9, 20, 3).collect()
    assert [len(t["sums"]) for t in tiles] == [2 * 20 * permutation.CODE_BLOCK * 8]
    assert np.frombuffer(tiles[0]["sums"]).sum() == 20 * 45


def test_tiles_add_up_as_they_pass():
    def batch(rows):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["seed", "bi", "bj", "moments", "margins"])

    one, two = np.ones(4).tobytes(), np.full(4, 2.0).tobytes()
    batches = [batch([(1, 0, 0, one, two), (2, 0, 0, two, two)]), batch([(1, 0, 0, two, one), (1, 0, 1, one, None)]), batch([(1, 0, 1, one, None)])]
    found = [r for b in grid._added(iter(batches)) for r in b.to_pylist()]
    read = {(r["seed"], r["bi"], r["bj"]): (np.frombuffer(r["moments"]).sum(), r["margins"] and np.frombuffer(r["margins"]).sum()) for r in found}
    assert read == {(1, 0, 0): (12.0, 12.0), (2, 0, 0): (8.0, 8.0), (1, 0, 1): (8.0, None)}


def test_sample_rows_meet_without_a_shuffle(spark):
    """Above one block, yet few enough cells for a task to keep."""
    rows = spark.createDataFrame([("a", [0, 1500]), ("b", [0, 3, 1500])], "SAMPLE string, codes array<bigint>")
    pairs = gram.co_occurrence(rows, 1600, salt="SAMPLE")
    assert "_salt" not in plan_of(pairs)
    found = {(r["code_i"], r["code_j"]): r["n"] for r in gram.both_triangles(pairs).collect()}
    assert found == {(0, 0): 2, (0, 3): 1, (3, 0): 1, (3, 3): 1, (0, 1500): 2, (1500, 0): 2, (3, 1500): 1, (1500, 3): 1, (1500, 1500): 2}


def test_only_the_bucket_of_the_cut_is_ranked(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("s"), F.col("id").cast("string").alias("name"))
    drawn = keys.draw_exact(rows, ["s"], F.md5("name"), "name", F.lit(500)).where("drawn")
    got = {(r["s"], r["name"]) for r in drawn.collect()}
    ranked = rows.selectExpr("s", "name", "row_number() over (partition by s order by md5(name), name) r").where("r <= 500")
    assert got == {(r["s"], r["name"]) for r in ranked.collect()} and "Union" in plan_of(drawn)


def test_sums_from_sample_rows_that_carry_labels(spark):
    labels = F.when(F.col("SAMPLE") == "hot", 2).when(F.col("SAMPLE").isNull(), 0).otherwise(1).cast("bigint")
    rows = cube.sample_rows(termed(spark).withColumn("cases", labels), DOMAIN, also=("cases",)).repartition(3)
    found = {r["code"]: (r["n"], r["cases"]) for r in cube.code_sums(rows, DOMAIN.size, "cases").collect()}
    want = {}
    for (sample, code), n in expected(termed(spark)).items():
        times = 2 if sample == "hot" else 0 if sample is None else 1
        want[code] = tuple(a + b for a, b in zip(want.get(code, (0, 0)), (n, n * times)))
    assert found == want
    assert cube.code_sums(rows.limit(0), DOMAIN.size, "cases").count() == 0


def test_texts_of_variants_do_not_travel_to_their_genes(spark):
    words = [*(w for _, group in annotate.NONCODING_ORDER for w in group), "stop_gained", "frameshift_variant", "missense_variant", "inframe_deletion", "synonymous_variant", "stop_retained_variant", "other", None]
    lof = [("HC", ""), ("HC", "X"), ("LC", ""), (None, None)]
    variants = spark.createDataFrame(
        [("A" * (1 + i % 2), "G", w, f"G{g}", f"G{g}", a, b, s, i % 4) for i, (w, (a, b), s, g) in enumerate(
            (w, l, s, g) for w in words for l in lof for s in ("7", "2&3", "NA", "", None) for g in range(4)
        )],
        "REF string, ALT string, Consequence string, SYMBOL string, NEAREST string, LoF string, LoF_flags string, score string, ANNOT bigint",
    )
    genes = spark.createDataFrame([("G0", ["ProteinCoding", "Risk"]), ("G1", ["lincRNA"]), ("G2", [])], "gene_name string, gene_sets array<string>")
    shaped = annotate.with_terms(annotate.with_gene_sets(annotate.with_shape(variants, "score", 5.0), genes), DOMAIN, "score", 5.0)
    late = annotate.with_terms(annotate.with_gene_sets(variants, genes), DOMAIN, "score", 5.0)
    assert sorted(map(str, shaped.collect())) == sorted(map(str, late.collect()))
    plan = plan_of(shaped.select(*cube.TERM_ARRAYS).hint("merge")).splitlines()
    join, shape = (next(i for i, line in enumerate(plan) if text in line) for text in ("Join", "AS shape"))
    assert join < shape
    # A variant of each kind, its terms written down.
    by = {(r["Consequence"], r["LoF"], r["LoF_flags"], r["score"], r["effective_gene"]): r["gc"] for r in shaped.collect()}
    assert by["stop_gained", "HC", "", "7", "G0"] == ["Any", "CodingRegion", "PTVRegion"]
    assert by["stop_gained", "LC", "", "7", "G0"] == ["Any", "CodingRegion"]
    assert by["frameshift_variant", "HC", "", "7", "G0"] == ["Any", "CodingRegion", "FrameshiftRegion", "PTVRegion"]
    assert by["missense_variant", "LC", "", "7", "G0"] == ["Any", "CodingRegion", "DamagingMissenseRegion", "MissenseRegion"]
    assert by["missense_variant", "LC", "", "2&3", "G0"] == ["Any", "CodingRegion", "MissenseRegion"]
    assert by["intron_variant", "HC", "", "NA", "G0"] == ["Any", "NoncodingRegion", "IntronRegion"]
    assert by["other", "HC", "", "NA", "G0"] == ["Any", "NoncodingRegion"]
    assert by["missense_variant", "HC", "", "NA", "G1"] == ["Any", "NoncodingRegion", "lincRnaRegion"]
    assert by[None, None, None, None, "G3"] == ["Any", "NoncodingRegion", "OtherTranscriptRegion"]


@pytest.mark.parametrize("carriers", [False, True])
def test_few_trials_are_added_up_where_the_samples_lie(spark, carriers):
    """The samples with the smallest digests are the cases; a sample that is listed twice can be drawn once or twice."""
    names = [f"s{i:02d}" for i in range(30)] + ["s03", "s04"]
    people = spark.createDataFrame([(n, "case" if i % 3 else "ctrl") for i, n in enumerate(names)] + [("none", "unknown")], "SAMPLE string, PHENOTYPE string")
    own = {n: {c: (i * c) % 5 + 1 for c in (0, 7, 300) if (i + c) % 3} for i, n in enumerate(names[:30])} | {"none": {0: 9, 600: 1}}
    counts = spark.createDataFrame([(n, c, v) for n, cells in own.items() for c, v in cells.items()], "SAMPLE string, code bigint, n bigint")
    rows = spark.createDataFrame([(n, list(cells), list(cells.values())) for n, cells in own.items()], "SAMPLE string, codes array<bigint>, counts array<bigint>").repartition(5)
    size = burden.cohort(people)
    made = permutation.permuted_counts(counts, people, size, 12, 700, F.col("n"), carriers, "digest", rows)
    assert "CoGroup" not in plan_of(made)
    want = {}
    for trial in range(1, 13):
        ranked = sorted(names, key=lambda n: (hashlib.md5(f"{trial}|{n}".encode()).hexdigest(), n))
        for code in (0, 7, 300):
            value = [min(1, own[n].get(code, 0)) if carriers else own[n].get(code, 0) for n in ranked]
            want[trial, code] = (sum(value[:size.cases]), sum(value[size.cases:]))
    assert {(r["trial"], r["code"]): (r["case_n"], r["ctrl_n"]) for r in made.collect()} == want


def test_few_trials_and_tiles_agree(spark, monkeypatch):
    counts = spark.createDataFrame([(f"s{i}", (i * k) % 260, i % 4) for i in range(50) for k in (1, 3, 7) if i], "SAMPLE string, code bigint, n bigint").distinct().groupBy("SAMPLE", "code").agg(F.max("n").alias("n"))
    people = spark.createDataFrame([(f"s{i}", "case" if i % 4 else "ctrl") for i in range(50)], "SAMPLE string, PHENOTYPE string")
    size = burden.cohort(people)
    for draw in ("seeded", "digest"):
        results = []
        for most in (permutation.WHOLE_CELLS, 0):
            monkeypatch.setattr(permutation, "WHOLE_CELLS", most)
            results.append(sorted(permutation.permuted_counts(counts, people, size, 9, 260, F.col("n"), draw=draw).collect()))
        assert results[0] == results[1] and len(results[0])
        monkeypatch.undo()


def test_draws_of_none_and_of_all(spark):
    rows = spark.range(40).select((F.col("id") % 2).alias("s"), F.col("id").cast("string").alias("name"))
    last = lambda take: {r["s"]: r["name"] for r in keys.last_drawn(rows, ["s"], F.md5("name"), ["name"], take).collect()}
    order = {s: sorted((str(i) for i in range(s, 40, 2)), key=lambda n: hashlib.md5(n.encode()).hexdigest()) for s in (0, 1)}
    assert last(0) == {} and last(21) == {}
    for take in (1, 7, 20):
        assert last(take) == {s: names[take - 1] for s, names in order.items()}
