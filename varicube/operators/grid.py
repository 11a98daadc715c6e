"""Risk scores of many category subsets from one set of moments.

A model is a subset of the categories: those of a domain that have one annotation term, or all but those. Fitting each
from the samples would read the counts once per model, seed and fold. Here the counts are read once. Categories are cut
into blocks of ``BLOCK``; a sample's part of a block meets its other parts at the shuffle, and a task adds up the cross
products of one block pair for a few seeds at once, fold by fold. A fit takes the columns of its model from these
moments, and leaves a fold out by subtracting that fold's moments.

A tile is (folds + 1) x BLOCK^2 numbers whatever the data; a fitting task holds (folds + 1) x candidates^2 numbers, where
candidates are the categories that can be rare under some labels (``candidates``). The category lists are bounded by the
category domain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varicube.domain import CategoryDomain, region_flags
from varicube.operators.risk import lasso_path, penalties, squared_error
from varicube.session import cut_lineage

BLOCK = 256
SEEDS_A_TILE = 8
SAMPLES_A_TILE = 10_000
MODELS_A_TASK = 12
MOST_TASKS = 4096
#: Annotation dimensions of the grid and the term in them that stands for no restriction.
ANNOTATIONS = {"gene_set": "Any", "functional_score": "All", "functional_annotation": "Any"}
EACH, WITHOUT, WHOLE = "each", "without", "whole"

TILE = "seed bigint, bi int, bj int, moments binary, margins binary"
FIT = (
    "model bigint, seed bigint, parameter double, r2 double, intercept double, n_rare bigint, n_select bigint, "
    "codes array<bigint>, coefficients array<double>"
)


@dataclass(frozen=True)
class Model:
    """One subset of the categories."""

    number: int
    domain: str
    dimension: str | None
    term: str | None
    mode: str


def grid_models(domain: CategoryDomain, domains: list[str], dimensions: list[str], modes: list[str]) -> list[Model]:
    """A model per domain, annotation term and mode; mode ``whole`` has one per domain."""
    wanted = []
    for mode in modes:
        if mode == WHOLE:
            wanted += [(name, None, None, mode) for name in domains]
        else:
            wanted += [
                (name, dimension, term, mode)
                for dimension in dimensions for term in domain.terms[dimension] if term != ANNOTATIONS[dimension] for name in domains
            ]
    return [Model(i, *w) for i, w in enumerate(wanted)]


def model_table(spark, models: list[Model]) -> DataFrame:
    rows = [(m.number, m.domain, m.dimension, m.term, m.mode) for m in models]
    return spark.createDataFrame(rows, "model bigint, domain string, dimension string, term string, mode string")


def candidates(cells: DataFrame, n_cases: Column | int, rare_below: float) -> DataFrame:
    """Codes whose control total can be under ``rare_below`` for some choice of ``n_cases`` cases.

    At most that many carriers can be cases, so the others' values, the least each, stay with the controls.
    """
    sums = cells.where("value > 0").groupBy("code").agg(F.count(F.lit(1)).alias("carriers"), F.min("value").alias("least"))
    return sums.where((F.col("carriers") - n_cases) * F.col("least") < rare_below).select("code")


def member_masks(codes: DataFrame, domain: CategoryDomain, models: list[Model]) -> tuple[list[int], np.ndarray]:
    """The codes in order, and a row of booleans per model."""
    terms = codes.select("code", *domain.decode(F.col("code")))
    flagged = terms.select("code", *ANNOTATIONS, *region_flags(F.col("gencode"), F.col("gene_set"))).orderBy("code").toPandas()
    masks = np.zeros((len(models), len(flagged)), dtype=bool)
    for row, m in zip(masks, models):
        row[:] = True if m.domain == "all" else flagged[f"is_{m.domain}"].to_numpy() == 1
        if m.mode != WHOLE:
            has = flagged[m.dimension].to_numpy() == m.term
            row &= has if m.mode == EACH else ~has
    return [int(c) for c in flagged["code"]], masks


def sample_parts(rows: DataFrame, codes: list[int], block: int = BLOCK) -> DataFrame:
    """(SAMPLE, block, places, vals): at most ``block`` entries a row, zeros and other codes left out.

    ``rows`` has a sample a row: SAMPLE, codes and vals.
    """
    sorter = np.argsort(np.array(codes, dtype=np.int64))
    ordered = np.array(codes, dtype=np.int64)[sorter]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, values = batch.column("codes"), batch.column("vals").flatten().to_numpy()
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten().to_numpy()
            at = np.searchsorted(ordered, flat)
            known = (at < len(ordered)) & (values != 0)
            known[known] = ordered[at[known]] == flat[known]
            place, owner, values = sorter[at[known]], owner[known], values[known]
            order = np.lexsort((place, owner))
            place, owner, values = place[order], owner[order], values[order]
            parts, first = np.unique(owner * blocks + place // block, return_index=True)
            offsets = pa.array(np.append(first, len(place)), pa.int32())
            yield pa.record_batch([
                batch.column("SAMPLE").take(pa.array(parts // blocks)), pa.array(parts % blocks, pa.int32()),
                pa.ListArray.from_arrays(offsets, pa.array(place % block, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(values, pa.float64())),
            ], ["SAMPLE", "block", "places", "vals"])

    blocks = max(1, -(-len(codes) // block))
    kind = rows.schema["SAMPLE"].dataType.simpleString()
    packed = rows.select("SAMPLE", F.col("codes").cast("array<bigint>"), F.col("vals").cast("array<double>"))
    return packed.mapInArrow(cut, f"SAMPLE {kind}, block int, places array<int>, vals array<double>")


def gathered(cells: DataFrame) -> DataFrame:
    """Cells (SAMPLE, code, value) with a sample a row: SAMPLE, codes, vals."""
    own = cells.select("SAMPLE", F.struct("code", F.col("value").cast("double").alias("val")).alias("cell")).groupBy("SAMPLE").agg(F.collect_list("cell").alias("cells"))
    return own.select("SAMPLE", F.col("cells.code").alias("codes"), F.col("cells.val").alias("vals"))


def _tile(folds: int, block: int):
    def dense(part: pd.DataFrame, samples: np.ndarray, n: int) -> np.ndarray:
        z = np.zeros((n, block))
        if len(part):
            rows = np.repeat(samples, [len(p) for p in part["places"]])
            z[rows, np.concatenate(part["places"].to_list())] = np.concatenate(part["vals"].to_list())
        return z

    def add(group: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(group["bi"].iloc[0]), int(group["bj"].iloc[0])
        number, first = np.unique(group["SAMPLE"].to_numpy(), return_index=True)
        at = np.searchsorted(number, group["SAMPLE"].to_numpy())
        sides = [dense(group[own], at[own], len(number)) for own in ((group["block"] == b).to_numpy() for b in (bi, bj))]
        seeds = group["seeds"].iloc[0]
        fold = np.vstack(group["folds"].iloc[first].to_list())
        y = np.vstack(group["ys"].iloc[first].to_list()).astype(float)
        rows = []
        for s, seed in enumerate(seeds):
            moments, margins = np.zeros((folds + 1, block, block)), np.zeros((folds + 1, 2, block))
            for f in range(folds + 1):
                own = fold[:, s] == f
                moments[f] = sides[0][own].T @ sides[1][own]
                if bi == bj:
                    margins[f] = np.stack([sides[0][own].sum(axis=0), y[own, s] @ sides[0][own]])
            rows.append((int(seed), bi, bj, moments.tobytes(), margins.tobytes() if bi == bj else None))
        return pd.DataFrame(rows, columns=["seed", "bi", "bj", "moments", "margins"])

    return add


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of each block pair, which come sorted, added up by seed: a task holds one pair's sums and one batch."""
    names = [c.split()[0] for c in TILE.split(", ")]
    current, sums = None, {}

    def rows() -> Iterator[pa.RecordBatch]:
        for seed, blobs in sums.items():
            cells = [pa.array([c], t) for c, t in zip((seed, *current), (pa.int64(), pa.int32(), pa.int32()))]
            yield pa.record_batch([*cells, *(pa.array([None if b is None else b.tobytes()], pa.binary()) for b in blobs)], names)

    for batch in batches:
        columns = [batch.column(c) for c in names]
        for at, (seed, bi, bj) in enumerate(zip(*(c.to_pylist() for c in columns[:3]))):
            if (bi, bj) != current:
                yield from rows()
                current, sums = (bi, bj), {}
            blobs = [np.frombuffer(c[at].as_buffer()) if c[at].is_valid else None for c in columns[3:]]
            held = sums.get(seed)
            sums[seed] = [None if b is None else b.copy() if held is None else h + b for b, h in zip(blobs, held or blobs)]
    yield from rows()


def moment_tiles(parts: DataFrame, labels: DataFrame, folds: int, n_blocks: int, n_samples: int, block: int = BLOCK, samples_a_tile: int = SAMPLES_A_TILE) -> DataFrame:
    """(seed, bi, bj, moments, margins) for bi <= bj; margins (sums, sums over cases) come with the diagonal."""
    group = F.expr(f"seed_place div {SEEDS_A_TILE}")
    seeds = labels.select("seed").distinct().withColumn("seed_place", F.row_number().over(Window.orderBy("seed")) - 1)
    drawn = labels.join(seeds, "seed").groupBy("SAMPLE", group.alias("seed_group")).agg(
        F.sort_array(F.collect_list(F.struct("seed", "fold", "y"))).alias("drawn")
    ).select(
        "SAMPLE", "seed_group", F.col("drawn.seed").alias("seeds"), F.col("drawn.fold").alias("folds"), F.col("drawn.y").alias("ys")
    )
    slices = -(-n_samples // samples_a_tile)
    met = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumns({
        "bi": F.least("block", "other"), "bj": F.greatest("block", "other"), "slice": F.pmod(F.xxhash64("SAMPLE"), F.lit(slices)),
    }).drop("other")
    keys = ["seed_group", "bi", "bj", "slice"]
    tiles = met.join(drawn, "SAMPLE").groupBy(*keys).applyInPandas(_tile(folds, block), TILE)
    # Groups come sorted by block pair: their tiles are added up in the task that made them, then over the tasks.
    return tiles.mapInArrow(_added, TILE).repartition("bi", "bj", "seed").sortWithinPartitions("bi", "bj").mapInArrow(_added, TILE)


def fold_counts(labels: DataFrame) -> DataFrame:
    """Samples and cases of every seed and fold, samples without any count included."""
    return labels.groupBy("seed", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("cases"))


# Largest violation of the optimality conditions, in units of the response's standard deviation, after polishing.
OPTIMAL = 1e-9
MOST_SWEEPS = 1_000_000


def polished(moments: np.ndarray, beta: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) with the optimality conditions at ``penalty`` met to ``OPTIMAL``, starting from ``beta``."""
    n = moments[0, 0]
    means = moments[0, 1:] / n
    centred = moments[1:, 1:] / n - np.outer(means, means)
    scale = np.sqrt(np.maximum(np.diag(centred)[:-1], 0.0))
    usable = scale > 1e-12
    scale = np.where(usable, scale, 1.0)
    gram, target = centred[:-1, :-1] / np.outer(scale, scale), np.where(usable, centred[:-1, -1] / scale, 0.0)
    beta = np.where(usable, beta * scale, 0.0)
    limit = OPTIMAL * np.sqrt(max(float(centred[-1, -1]), 1e-300))
    for _ in range(MOST_SWEEPS):
        gradient = target - gram @ beta
        gap = np.where(beta != 0.0, np.abs(gradient - penalty * np.sign(beta)), np.maximum(np.abs(gradient) - penalty, 0.0))
        if not usable.any() or gap[usable].max() <= limit:
            return float(means[-1] - (beta / scale) @ means[:-1]), beta / scale
        for j in np.flatnonzero(((beta != 0.0) | (gap > limit)) & usable):
            raw = gradient[j] + beta[j]
            change = np.sign(raw) * max(abs(raw) - penalty, 0.0) - beta[j]
            if change != 0.0:
                gradient -= gram[j] * change
                beta[j] += change
    raise ArithmeticError(f"the lasso did not converge at penalty {penalty}")


def fit_subset(fold_moments: np.ndarray, keep: np.ndarray) -> tuple | None:
    """(penalty, test R2, intercept, coefficients of the kept columns); None where nothing can be fitted.

    ``fold_moments`` is indexed by fold (0 is the test set) over [1, categories, y].
    """
    columns = np.concatenate(([0], np.flatnonzero(keep) + 1, [fold_moments.shape[1] - 1]))
    part = fold_moments[:, columns][:, :, columns]
    training = part[1:].sum(axis=0)
    grid = penalties(training) if training[0, 0] > 0 else np.array([])
    if not len(grid):
        return None
    _, path = lasso_path(training, grid, stop=True)
    grid = grid[: len(path)]
    error = np.zeros(len(grid))
    for fold in part[1:]:
        if 0 < fold[0, 0] < training[0, 0]:
            error += squared_error(fold, *lasso_path(training - fold, grid))
    best = int(np.argmin(error))
    intercept, beta = polished(training, path[best], grid[best])
    test = part[0]
    spread = test[-1, -1] - test[0, -1] ** 2 / test[0, 0] if test[0, 0] else 0.0
    r2 = 1.0 - squared_error(test, np.array([intercept]), beta[None])[0] / spread if spread > 0 else None
    return float(grid[best]), r2, intercept, beta


def _fit(codes: list[int], masks: np.ndarray, folds: int, rare_below: float, counted: dict, block: int):
    packed, width = np.packbits(masks, axis=1), len(codes)

    def finish(seed: int, chunk: int, moments: np.ndarray) -> Iterator[tuple]:
        for fold, n, cases in counted[seed]:
            moments[fold, 0, 0], moments[fold, 0, -1], moments[fold, -1, 0], moments[fold, -1, -1] = n, cases, cases, cases
        every = moments.sum(axis=0)
        rare = every[0, 1:-1] - every[1:-1, -1] < rare_below
        for model in range(chunk * MODELS_A_TASK, min((chunk + 1) * MODELS_A_TASK, len(packed))):
            keep = np.unpackbits(packed[model], count=width).astype(bool) & rare
            fitted = fit_subset(moments, keep)
            if fitted is None:
                yield model, seed, None, None, None, int(keep.sum()), 0, [], []
                continue
            penalty, r2, intercept, beta = fitted
            chosen = np.flatnonzero(beta)
            names = np.flatnonzero(keep)[chosen]
            yield model, seed, penalty, r2, intercept, int(keep.sum()), len(chosen), [codes[i] for i in names], beta[chosen].tolist()

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FIT.split(", ")]
        current, moments = None, None
        for batch in batches:
            for seed, chunk, bi, bj, blob, margins in batch.itertuples(index=False):
                if (seed, chunk) != current:
                    if current is not None:
                        yield pd.DataFrame(list(finish(*current, moments)), columns=names)
                    current, moments = (seed, chunk), np.zeros((folds + 1, width + 2, width + 2))
                if blob is None:
                    continue
                tile = np.frombuffer(blob).reshape(folds + 1, block, block)
                bi, bj = int(bi), int(bj)  # pandas reads them as floats next to nulls
                i, j = bi * block, bj * block
                wi, wj = min(block, width - i), min(block, width - j)
                moments[:, 1 + i : 1 + i + wi, 1 + j : 1 + j + wj] = tile[:, :wi, :wj]
                if bi != bj:
                    moments[:, 1 + j : 1 + j + wj, 1 + i : 1 + i + wi] = tile[:, :wi, :wj].transpose(0, 2, 1)
                else:
                    sums = np.frombuffer(margins).reshape(folds + 1, 2, block)[:, :, :wi]
                    for at, side in ((0, sums[:, 0]), (-1, sums[:, 1])):
                        moments[:, at, 1 + i : 1 + i + wi] = side
                        moments[:, 1 + i : 1 + i + wi, at] = side
        if current is not None:
            yield pd.DataFrame(list(finish(*current, moments)), columns=names)

    return fit


def fit_grid(
    cells: DataFrame, labels: DataFrame, domain: CategoryDomain, models: list[Model], folds: int, rare_below: float, n_cases: int,
    block: int = BLOCK, samples_a_tile: int = SAMPLES_A_TILE, rows: DataFrame | None = None,
) -> DataFrame:
    """One row per model and seed. ``cells`` has SAMPLE, code and value; ``labels`` comes from ``risk.model_labels``.

    ``rows`` are the cells with a sample a row (``gathered``) where the caller has them.

    Rare is judged with each seed's labels among all candidates of the model. A model without a usable rare category has
    null parameter and R2. Coefficients meet the lasso's optimality conditions on the training set (``optimality``).
    """
    labels = cut_lineage(labels)
    kept = cut_lineage(candidates(cells, n_cases, rare_below))
    codes, masks = member_masks(kept, domain, models)
    counted: dict[int, list] = {}
    for r in fold_counts(labels).collect():  # folds + 1 rows a seed
        counted.setdefault(r["seed"], []).append((r["fold"], r["n"], r["cases"]))
    n_samples = max((sum(n for _, n, _ in rows) for rows in counted.values()), default=0)
    blocks = max(1, -(-len(codes) // block))
    parts = sample_parts(gathered(cells.join(kept, "code", "left_semi")) if rows is None else rows, codes, block)
    tiles = moment_tiles(parts, labels, folds, blocks, max(1, n_samples), block, samples_a_tile)
    every = labels.select("seed").distinct().select(  # a seed without any count still gets its rows
        "seed", *[F.lit(None).cast(t).alias(c) for c, t in (("bi", "int"), ("bj", "int"), ("moments", "binary"), ("margins", "binary"))]
    )
    chunks = -(-len(models) // MODELS_A_TASK)
    spread = tiles.unionByName(every).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    tasks = min(max(1, len(counted)) * chunks, MOST_TASKS)
    dealt = spread.repartition(tasks, "seed", "chunk").sortWithinPartitions("seed", "chunk")
    return dealt.select("seed", "chunk", "bi", "bj", "moments", "margins").mapInPandas(_fit(codes, masks, folds, rare_below, counted, block), FIT)


def grid_scores(fits: DataFrame, null_fits: DataFrame | None, models: DataFrame, n_seeds: int) -> DataFrame:
    """Average parameter and R2 of every model, categories chosen by more than half of the seeds, permutation P of R2."""
    chosen = fits.select("model", F.explode("codes").alias("code")).groupBy("model", "code").agg(F.count(F.lit(1)).alias("n"))
    counted = chosen.where(F.col("n") > n_seeds / 2).groupBy("model").agg(F.count(F.lit(1)).alias("n_select"))
    means = fits.groupBy("model").agg(F.avg("parameter").alias("parameter"), F.avg("r2").alias("r2"))
    table = models.join(means, "model").join(counted, "model", "left").withColumn("n_select", F.coalesce("n_select", F.lit(0)))
    if null_fits is not None:
        null = null_fits.where("r2 is not null").select("model", F.col("r2").alias("null_r2"))
        reached = table.select("model", "r2").join(null, "model").groupBy("model").agg(
            F.count_if(F.col("null_r2") >= F.col("r2")).alias("reached"), F.count(F.lit(1)).alias("drawn")
        )
        p = (F.col("reached") + 1) / (F.col("drawn") + F.lit(1.0))
        table = table.join(reached, "model", "left").withColumn("Perm_P", F.when(F.col("r2").isNotNull(), p)).drop("reached", "drawn")
    return table.drop("model")


def mask_table(spark, codes: list[int], masks: np.ndarray) -> DataFrame:
    """(model, code) of every model's categories."""
    return spark.createDataFrame(
        [(m, [c for c, own in zip(codes, row) if own]) for m, row in enumerate(masks)], "model bigint, codes array<bigint>"
    ).select("model", F.explode("codes").alias("code"))


def rare_members(cells: DataFrame, labels: DataFrame, fits: DataFrame, masks: DataFrame, rare_below: float) -> DataFrame:
    """(model, seed, code) of the categories that each fit could choose."""
    controls = labels.where("y = 0").select("seed", "SAMPLE")
    sums = cells.join(controls, "SAMPLE").groupBy("seed", "code").agg(F.sum("value").alias("n"))
    asked = masks.join(fits.select("model", "seed"), "model")
    return asked.join(sums, ["seed", "code"], "left").where(F.coalesce("n", F.lit(0)) < rare_below).select("model", "seed", "code")


def optimality(cells: DataFrame, labels: DataFrame, fits: DataFrame, members: DataFrame) -> DataFrame:
    """(model, seed, gap, intercept_gap): how far a fit is from the lasso's optimality conditions.

    Computed from the counts by joins, not from the moments of the fit: a chosen category's slope on the residuals is the
    penalty with its coefficient's sign, every other member's is at most the penalty, and the mean residual is zero.
    """
    heads = fits.where("parameter is not null").select("model", "seed", "intercept", "parameter")
    weights = fits.select("model", "seed", F.inline(F.arrays_zip("codes", "coefficients"))).withColumnRenamed("codes", "code")
    predicted = cells.join(weights, "code").groupBy("model", "seed", "SAMPLE").agg(F.sum(F.col("value") * F.col("coefficients")).alias("p"))
    train = labels.where("fold > 0").select("seed", "SAMPLE", F.col("y").cast("double").alias("y"))
    residual = train.join(heads, "seed").join(predicted, ["model", "seed", "SAMPLE"], "left").select(
        "model", "seed", "SAMPLE", (F.col("y") - F.col("intercept") - F.coalesce("p", F.lit(0.0))).alias("r")
    )
    means = residual.groupBy("model", "seed").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_r"))
    value = F.col("value").cast("double")
    sums = cells.join(members, "code").join(residual, ["model", "seed", "SAMPLE"]).groupBy("model", "seed", "code").agg(
        F.sum(value * F.col("r")).alias("xr"), F.sum(value).alias("x"), F.sum(value * value).alias("xx")
    )
    known = sums.join(means, ["model", "seed"]).join(heads, ["model", "seed"]).join(weights, ["model", "seed", "code"], "left")
    mean_x = F.col("x") / F.col("n")
    scale = F.sqrt(F.greatest(F.col("xx") / F.col("n") - mean_x * mean_x, F.lit(0.0)))
    slope = (F.col("xr") / F.col("n") - mean_x * F.col("mean_r")) / scale
    gap = F.when(scale <= 1e-12, 0.0).when(
        F.coalesce("coefficients", F.lit(0.0)) != 0.0, F.abs(slope - F.col("parameter") * F.signum("coefficients"))
    ).otherwise(F.greatest(F.abs(slope) - F.col("parameter"), F.lit(0.0)))
    worst = known.groupBy("model", "seed").agg(F.max(gap).alias("gap"))
    return means.join(worst, ["model", "seed"], "left").select(
        "model", "seed", F.coalesce("gap", F.lit(0.0)).alias("gap"), F.abs("mean_r").alias("intercept_gap")
    )
