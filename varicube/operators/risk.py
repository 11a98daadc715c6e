"""Risk score: cross-validated lasso on rare categories, with label permutation.

A model needs the cross products of its columns per fold. Samples arrive as sparse rows joined to the
labels of each seed, cut into (seed, slice) streams whose number follows the number of samples. Each task
adds its rows to fold-wise cross products as they pass; the slices of a seed are summed and solved.
Memory is folds x categories^2, whatever the number of samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_LAMBDA = 100
SLICE_SAMPLES = 50_000
ROWS_AT_ONCE = 4096
MOST_TASKS = 4096  # an explicit number keeps AQE from merging small but compute-heavy partitions
MOMENTS = "seed bigint, moments binary"
MODEL = "seed bigint, parameter double, r2 double, n_select bigint, n_rare bigint, codes array<bigint>, coefficients array<double>"


def digest_rank(rows: DataFrame, strata: list[str], digest: Column, tie: str, name: str) -> DataFrame:
    """Exact 1-based rank by digest inside each stratum, ranked in digest-prefix buckets."""
    bucketed = rows.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, 3))
    sizes = bucketed.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*strata, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*strata, "_bucket").orderBy("_digest", tie))
    return (
        bucketed.withColumn("_inside", inside).join(offsets, [*strata, "_bucket"])
        .withColumn(name, F.col("_offset") + F.col("_inside")).drop("_digest", "_bucket", "_inside", "_offset")
    )


def model_labels(samples: DataFrame, seeds: range, folds: int, fraction: float, permute: bool) -> DataFrame:
    """(seed, SAMPLE, y, fold): fold 0 is the test set, 1..folds are even slices of the training set.

    ``samples`` has SAMPLE, PHENOTYPE and SET. With ``permute`` each seed redraws the case labels and the
    training set, keeping their numbers.
    """
    base = samples.where(F.col("PHENOTYPE").isin("case", "ctrl"))
    spread = base.withColumn("seed", F.explode(F.sequence(
        F.lit(seeds[0]).cast("bigint"), F.lit(seeds[-1]).cast("bigint"), F.lit(seeds.step).cast("bigint")
    )))

    def digest(salt: str) -> Column:
        return F.md5(F.concat_ws("|", F.lit(salt), F.col("seed").cast("string"), F.col("SAMPLE")))

    if permute:
        counts = base.groupBy("PHENOTYPE").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("SET") == "training").alias("train")
        )
        size = {r["PHENOTYPE"]: (r["n"], r["train"]) for r in counts.collect()}
        n_case, train_case = size.get("case", (0, 0))
        _, train_ctrl = size.get("ctrl", (0, 0))
        ranked = digest_rank(spread, ["seed"], digest("label"), "SAMPLE", "_rank")
        labelled = ranked.withColumn("y", (F.col("_rank") <= n_case).cast("int")).drop("_rank")
        ranked = digest_rank(labelled, ["seed", "y"], digest("set"), "SAMPLE", "_rank")
        take = F.when(F.col("y") == 1, train_case).otherwise(train_ctrl)
        placed = ranked.withColumn("train", (F.col("_rank") <= take).cast("int")).drop("_rank")
    else:
        placed = spread.withColumns({
            "y": (F.col("PHENOTYPE") == "case").cast("int"), "train": (F.col("SET") == "training").cast("int")
        })
    ranked = digest_rank(placed, ["seed", "train"], digest("fold"), "SAMPLE", "_rank")
    sizes = placed.groupBy("seed", "train").agg(F.count(F.lit(1)).alias("_n"))
    slice_ = F.floor((F.col("_rank") - 1) * folds / F.col("_n")) + 1
    return ranked.join(sizes, ["seed", "train"]).select(
        "seed", "SAMPLE", "y", F.when(F.col("train") == 1, slice_).otherwise(0).cast("int").alias("fold")
    )


def _standardise(moments: np.ndarray):
    """Centred cross products, column scales and means from a moment matrix of [1, X, y]."""
    n = moments[0, 0]
    means = moments[0, 1:] / n
    centred = moments[1:, 1:] / n - np.outer(means, means)
    scale = np.sqrt(np.maximum(np.diag(centred)[:-1], 0.0))
    return n, means, centred, scale


# Sweeps over the active coefficients; coordinate descent gets there in far fewer, so reaching it is an error.
MOST_SWEEPS = 100_000


def lasso_path(moments: np.ndarray, lambdas: np.ndarray, stop: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts and coefficients along ``lambdas`` by coordinate descent on the correlation matrix.

    A penalty has converged when no update moves the fit by 1e-7 of the response variance. With ``stop``
    the path ends once the explained share passes 0.999 or gains less than 1e-5.
    """
    _, means, centred, scale = _standardise(moments)
    usable = scale > 1e-12
    scale = np.where(usable, scale, 1.0)
    gram = centred[:-1, :-1] / np.outer(scale, scale)
    target = np.where(usable, centred[:-1, -1] / scale, 0.0)
    total = max(float(centred[-1, -1]), 1e-300)
    tolerance = np.sqrt(1e-7 * total)
    beta = np.zeros(len(scale))
    residual = target.copy()  # target - gram @ beta
    path, explained = [], 0.0
    for penalty in lambdas:
        active = np.flatnonzero(beta != 0.0)
        while True:
            for _ in range(MOST_SWEEPS):
                largest = 0.0
                for j in active:
                    raw = residual[j] + beta[j]
                    new = np.sign(raw) * max(abs(raw) - penalty, 0.0)
                    change = new - beta[j]
                    if change != 0.0:
                        residual -= gram[j] * change
                        beta[j] = new
                        largest = max(largest, abs(change))
                if largest < tolerance:
                    break
            else:
                raise ArithmeticError(f"the lasso did not converge at penalty {penalty}")
            wrong = np.flatnonzero((beta == 0.0) & usable & (np.abs(residual) > penalty * (1.0 + 1e-6)))
            wrong = np.setdiff1d(wrong, active)
            if not len(wrong):
                break
            active = np.concatenate([active, wrong])
        path.append(beta / scale)
        share = float(beta @ (target + residual)) / total
        if stop and len(path) > 5 and (share > 0.999 or share - explained < 1e-5 * share):
            break
        explained = share
    coefficients = np.array(path)
    return means[-1] - coefficients @ means[:-1], coefficients


def penalties(moments: np.ndarray, count: int = N_LAMBDA) -> np.ndarray:
    """Log-spaced penalties from the smallest one that selects nothing."""
    n, _, centred, scale = _standardise(moments)
    usable = scale > 1e-12
    if not usable.any():
        return np.array([])
    top = np.max(np.abs(centred[:-1, -1][usable] / scale[usable]))
    ratio = 1e-4 if n > usable.sum() else 1e-2
    return top * np.logspace(0.0, np.log10(ratio), count) if top > 0 else np.array([])


def squared_error(moments: np.ndarray, intercepts: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Sum of squared errors of every model on the rows behind ``moments``."""
    weights = np.concatenate([intercepts[:, None], path, -np.ones((len(path), 1))], axis=1)
    return np.einsum("ij,jk,ik->i", weights, moments, weights)


def fit_folds(fold_moments: np.ndarray, rare: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(penalty, test R2, coefficients) of the penalty with the least cross-validated error.

    ``fold_moments`` is indexed by fold (0 is the test set); ``rare`` masks the usable columns.
    """
    keep = np.concatenate(([0], np.flatnonzero(rare) + 1, [fold_moments.shape[1] - 1]))
    part = fold_moments[:, keep][:, :, keep]
    training = part[1:].sum(axis=0)
    coefficients = np.zeros(len(rare))
    grid = penalties(training)
    if not len(grid):
        return float("nan"), float("nan"), coefficients
    intercepts, path = lasso_path(training, grid, stop=True)
    grid = grid[: len(path)]
    error = np.zeros(len(grid))
    for fold in part[1:]:
        if fold[0, 0] > 0:
            error += squared_error(fold, *lasso_path(training - fold, grid))
    best = int(np.argmin(error))
    coefficients[rare] = path[best]
    test = part[0]
    spread = test[-1, -1] - test[0, -1] ** 2 / test[0, 0] if test[0, 0] else 0.0
    r2 = 1.0 - squared_error(test, intercepts[best:best + 1], path[best:best + 1])[0] / spread if spread > 0 else float("nan")
    return float(grid[best]), float(r2), coefficients


def _add_moments(codes: list[int], folds: int):
    ordered = np.array(codes, dtype=np.int64)  # ascending
    width = len(codes) + 2

    def dense(part: pd.DataFrame) -> np.ndarray:
        sizes = [len(c) for c in part["codes"]]
        z = np.zeros((len(part), width))
        if sum(sizes):
            columns = np.searchsorted(ordered, np.concatenate(part["codes"].to_list())) + 1
            z[np.repeat(np.arange(len(part)), sizes), columns] = np.concatenate(part["vals"].to_list())
        z[:, 0], z[:, -1] = 1.0, part["y"].to_numpy()
        return z

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, moments = None, None
        for batch in batches:
            for seed, rows in batch.groupby("seed", sort=True):
                if seed != current:
                    if moments is not None:
                        yield pd.DataFrame({"seed": [current], "moments": [moments.tobytes()]})
                    current, moments = seed, np.zeros((folds + 1, width, width))
                for fold, own in rows.groupby("fold"):
                    for start in range(0, len(own), ROWS_AT_ONCE):
                        part = own.iloc[start:start + ROWS_AT_ONCE]
                        z = dense(part)
                        # ``weight`` collapses samples without any count into one row per (fold, y).
                        moments[fold] += z.T @ (z * part["weight"].to_numpy(dtype=float)[:, None])
        if moments is not None:
            yield pd.DataFrame({"seed": [current], "moments": [moments.tobytes()]})

    return add


def _solve(codes: list[int], folds: int, rare_below: float):
    width = len(codes) + 2

    def finish(seed: int, moments: np.ndarray) -> pd.DataFrame:
        every = moments.sum(axis=0)
        control = every[0, 1:-1] - every[1:-1, -1]
        rare = control < rare_below
        penalty, r2, coefficients = fit_folds(moments, rare)
        chosen = np.flatnonzero(coefficients)
        return pd.DataFrame({
            "seed": [seed], "parameter": [penalty], "r2": [r2],
            "n_select": [len(chosen)], "n_rare": [int(rare.sum())],
            "codes": [[codes[i] for i in chosen]], "coefficients": [[float(coefficients[i]) for i in chosen]],
        })

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, total = None, None
        for batch in batches:
            for seed, blob in zip(batch["seed"], batch["moments"]):
                if seed != current:
                    if total is not None:
                        yield finish(current, total)
                    current, total = seed, np.zeros((folds + 1, width, width))
                total += np.frombuffer(blob).reshape(total.shape)
        if total is not None:
            yield finish(current, total)

    return solve


def fit_models(
    cells: DataFrame, labels: DataFrame, codes: list[int], folds: int, rare_below: float, n_samples: int, n_seeds: int
) -> DataFrame:
    """One fitted model per seed. ``cells`` has SAMPLE, code and value for the candidate ``codes``, which ascend.

    Rare means a control total under ``rare_below``, judged with each seed's own labels. Samples without
    any candidate count only matter by number, so they are counted instead of shipped.
    """
    rows = cells.groupBy("SAMPLE").agg(F.collect_list(F.struct("code", F.col("value").cast("double").alias("value"))).alias("cells"))
    joined = labels.join(rows, "SAMPLE", "left")
    slices = -(-n_samples // SLICE_SAMPLES)
    full = joined.where(F.col("cells").isNotNull()).select(
        "seed", "fold", "y", F.col("cells.code").alias("codes"), F.col("cells.value").alias("vals"),
        F.lit(1).cast("bigint").alias("weight"), F.pmod(F.xxhash64("SAMPLE"), F.lit(slices)).alias("slice"),
    )
    empty = joined.where(F.col("cells").isNull()).groupBy("seed", "fold", "y").agg(F.count(F.lit(1)).alias("weight")).select(
        "seed", "fold", "y", F.array().cast("array<bigint>").alias("codes"), F.array().cast("array<double>").alias("vals"),
        "weight", F.lit(0).cast("bigint").alias("slice"),
    )
    moments = (
        full.unionByName(empty).repartition(min(n_seeds * slices, MOST_TASKS), "seed", "slice").sortWithinPartitions("seed")
        .select("seed", "fold", "y", "codes", "vals", "weight")
        .mapInPandas(_add_moments(codes, folds), MOMENTS)
    )
    return moments.repartition(min(n_seeds, MOST_TASKS), "seed").sortWithinPartitions("seed").mapInPandas(_solve(codes, folds, rare_below), MODEL)


def selected_categories(models: DataFrame, n_seeds: int) -> DataFrame:
    """Categories with a nonzero coefficient in more than half of the seeds, with the mean coefficient."""
    nonzero = models.select(F.inline(F.arrays_zip("codes", "coefficients")))
    return nonzero.groupBy(F.col("codes").alias("code")).agg(
        F.count(F.lit(1)).alias("n_seeds"), (F.sum("coefficients") / n_seeds).alias("mean_coefficient")
    ).where(F.col("n_seeds") > n_seeds / 2)


def score_table(models: DataFrame, null_models: DataFrame | None, n_selected: int) -> DataFrame:
    """Per-seed results and their average, with permutation P of R2 when null models are given."""
    average = models.agg(
        F.lit("average").alias("seed"), F.avg("parameter").alias("parameter"), F.avg("r2").alias("r2"),
        F.lit(n_selected).cast("bigint").alias("n_select"),
    )
    table = average.unionByName(models.select(F.col("seed").cast("string").alias("seed"), "parameter", "r2", "n_select"))
    if null_models is None:
        return table
    # Null R2 values number one per permutation, a parameter of the analysis.
    null = null_models.where(~F.isnan("r2")).agg(F.sort_array(F.collect_list("r2")).alias("r2")).first()["r2"]
    reached = F.size(F.filter(F.array(*[F.lit(float(v)) for v in null]) if null else F.array().cast("array<double>"), lambda v: v >= F.col("r2")))
    return table.withColumn("Perm_P", (reached + 1) / F.lit(float(len(null) + 1)))
