"""The annotation grid against a plain fit of every subset, and its optimality against the counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varicube.domain import CategoryDomain
from varicube.operators import grid, risk

DOMAIN = CategoryDomain(("SetA", "SetB"), ("score",), ("annotation",))


@pytest.fixture(scope="module")
def data(spark):
    """200 samples, 40 categories of which one pushes towards the cases; a sample without any count."""
    rng = np.random.default_rng(5)
    codes = sorted(rng.choice(DOMAIN.size, 40, replace=False).tolist())
    x = rng.poisson(0.3, (200, 40))
    x[7] = 0
    y = (x[:, 0] + rng.normal(0, 0.6, 200) > 0.4).astype(int)
    fold = rng.integers(0, 6, 200)
    cells = spark.createDataFrame([(f"s{i}", codes[j], int(x[i, j])) for i in range(200) for j in range(40) if x[i, j]], "SAMPLE string, code bigint, value bigint")
    labels = spark.createDataFrame(
        [(seed, f"s{i}", int(y[i]), int((fold[i] + seed) % 6)) for seed in (1, 2) for i in range(200)], "seed bigint, SAMPLE string, y int, fold int"
    )
    return codes, x, y, fold, cells.repartition(4), labels


MODELS = grid.grid_models(DOMAIN, ["all", "noncoding"], ["gene_set", "functional_score"], [grid.WHOLE, grid.EACH, grid.WITHOUT])


def plain(codes, x, y, fold, masks, rare_below):
    found = {}
    for seed in (1, 2):
        z = np.column_stack([np.ones(200), x, y]).astype(float)
        at = (fold + seed) % 6
        moments = np.stack([z[at == f].T @ z[at == f] for f in range(6)])
        rare = x[y == 0].sum(axis=0) < rare_below
        for m, mask in enumerate(masks):
            found[m, seed] = (grid.fit_subset(moments, mask & rare), int((mask & rare).sum()))
    return found


@pytest.mark.parametrize("block, samples_a_tile", [(256, 10_000), (7, 33)])
def test_every_subset_equals_its_own_fit(spark, data, block, samples_a_tile):
    codes, x, y, fold, cells, labels = data
    n_cases, rare_below = int(y.sum()), 35
    listed, masks = grid.member_masks(cells.select("code").distinct(), DOMAIN, MODELS)
    assert listed == codes
    fits = grid.fit_grid(cells, labels, DOMAIN, MODELS, 5, rare_below, n_cases, block, samples_a_tile)
    expected = plain(codes, x, y, fold, masks, rare_below)
    rows = fits.collect()
    assert {(r["model"], r["seed"]) for r in rows} == set(expected)
    for r in rows:
        fitted, n_rare = expected[r["model"], r["seed"]]
        assert r["n_rare"] == n_rare
        if fitted is None:
            assert r["parameter"] is None and r["codes"] == []
            continue
        penalty, r2, intercept, beta = fitted
        assert r["parameter"] == pytest.approx(penalty) and r["r2"] == pytest.approx(r2, abs=1e-6) and r["intercept"] == pytest.approx(intercept, abs=1e-6)
        assert sum(r["coefficients"]) == pytest.approx(beta.sum(), abs=1e-6)


def test_masks_by_terms(spark):
    codes = spark.range(DOMAIN.size).select(F.col("id").alias("code"))
    listed, masks = grid.member_masks(codes, DOMAIN, MODELS)
    terms = {r["code"]: r for r in codes.select("code", *DOMAIN.decode(F.col("code"))).collect()}
    from varicube.domain import NONCODING_TERMS

    for m, mask in zip(MODELS, masks):
        for code, own in zip(listed, mask):
            wanted = m.domain == "all" or terms[code]["gencode"] in NONCODING_TERMS
            if m.mode != grid.WHOLE:
                wanted = wanted and (terms[code][m.dimension] == m.term) == (m.mode == grid.EACH)
            assert own == wanted


def test_fits_are_optimal_on_the_counts(spark, data):
    codes, x, y, fold, cells, labels = data
    fits = grid.fit_grid(cells, labels, DOMAIN, MODELS, 5, 35, int(y.sum())).persist()
    masks = grid.mask_table(spark, *grid.member_masks(cells.select("code").distinct(), DOMAIN, MODELS))
    members = grid.rare_members(cells, labels, fits, masks, 35)
    gaps = grid.optimality(cells, labels, fits, members).collect()
    assert len(gaps) == fits.where("parameter is not null").count() > 0
    assert max(r["gap"] for r in gaps) < 1e-7 and max(r["intercept_gap"] for r in gaps) < 1e-9
    # A changed coefficient is noticed.
    wrong = fits.withColumn("coefficients", F.transform("coefficients", lambda c: c * 1.01))
    assert max(r["gap"] for r in grid.optimality(cells, labels, wrong, members).collect()) > 1e-4


def test_no_category_that_can_be_rare_is_screened_out(spark, data):
    codes, x, y, fold, cells, labels = data
    kept = {r["code"] for r in grid.candidates(cells, 60, 20).collect()}
    for j, code in enumerate(codes):
        most = np.sort(x[:, j])[::-1]
        if most[60:].sum() < 20:  # the best 60 cases leave this many to the controls
            assert code in kept


def test_scores_and_permutation_p(spark):
    models = [grid.Model(0, "all", None, None, grid.WHOLE), grid.Model(1, "all", "gene_set", "SetA", grid.EACH)]
    fits = spark.createDataFrame(
        [(0, 1, 0.2, 0.5, 0.0, 3, 2, [1, 2], [1.0, 1.0]), (0, 2, 0.4, 0.3, 0.0, 3, 1, [1], [1.0]), (1, 1, None, None, None, 0, 0, [], []), (1, 2, None, None, None, 0, 0, [], [])], grid.FIT
    )
    null = spark.createDataFrame([(0, s, 0.1, r, 0.0, 1, 0, [], []) for s, r in enumerate([0.1, 0.4, 0.9, None])], grid.FIT)
    rows = {r["mode"]: r for r in grid.grid_scores(fits, null, grid.model_table(spark, models), 2).collect()}
    assert (rows["whole"]["r2"], rows["whole"]["n_select"], rows["whole"]["Perm_P"]) == (pytest.approx(0.4), 1, pytest.approx(3 / 4))
    assert (rows["each"]["r2"], rows["each"]["n_select"], rows["each"]["Perm_P"]) == (None, 0, None)


def test_nothing_to_fit(spark, data):
    *_, cells, labels = data
    rows = grid.fit_grid(cells, labels, DOMAIN, MODELS[:2], 5, -1, 10).collect()
    assert {(r["model"], r["seed"]) for r in rows} == {(m, s) for m in (0, 1) for s in (1, 2)} and all(r["parameter"] is None for r in rows)
