"""Label permutation as a blocked matrix product.

For every trial, ``n_case`` of the samples are drawn as cases. Case and control totals of each category
are label-matrix times count-matrix, cut into (sample block, code block, trial block) tiles. A tile's size
is fixed by the constants below, whatever the number of samples, categories or trials. Where all trials and categories
together are few, a task adds up the samples it holds and no sample is cut into tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varicube.functions.scalars import divide
from varicube.functions.stats import distinct_tails
from varicube.operators.burden import Cohort
from varicube.operators.cube import code_sums
from varicube.operators.keys import draw_exact, last_drawn
from varicube.operators.ordered import with_ordinal
from varicube.session import cut_lineage

SAMPLE_BLOCK = 4096
CODE_BLOCK = 256
TRIAL_BLOCK = 512
FIRST_SEED = 10001
MOST_TASKS = 4096
#: Trials times codes up to which a task keeps all sums at once (32 MB), and cells it multiplies at once.
WHOLE_CELLS = 1 << 21
CELLS_AT_ONCE = 1 << 20

LABELS = "trial bigint, sb bigint, bits binary"
TILE = "tb bigint, cb bigint, sums binary"
TOTALS = "trial bigint, code bigint, case_n double, ctrl_n double"


def seeded_labels(spark: SparkSession, n_samples: int, n_cases: int, n_trials: int, tasks: int | None = None) -> DataFrame:
    """Case labels of each trial as packed bits per sample block.

    Trial i (from 1) draws from the legacy Mersenne generator seeded 10000+i over samples in sorted-id
    order, so results repeat across runs and cluster sizes. One trial's draw is one permutation of the
    ordinals; different trials are independent tasks.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for trial in batch["id"]:
                generator = np.random.RandomState(FIRST_SEED - 1 + int(trial))
                label = np.zeros(n_samples, dtype=np.uint8)
                label[generator.permutation(n_samples)[:n_cases]] = 1
                blocks = range(0, n_samples, SAMPLE_BLOCK)
                yield pd.DataFrame({
                    "trial": int(trial),
                    "sb": [b // SAMPLE_BLOCK for b in blocks],
                    "bits": [np.packbits(label[b:b + SAMPLE_BLOCK]).tobytes() for b in blocks],
                })

    partitions = tasks or min(n_trials, max(spark.sparkContext.defaultParallelism, n_trials // 64))
    return spark.range(1, n_trials + 1, numPartitions=partitions).mapInPandas(draw, LABELS)


def digest_labels(indexed: DataFrame, n_cases: int, n_trials: int) -> DataFrame:
    """The same label blocks from a portable draw: the ``n_cases`` smallest md5(trial|sample)."""
    trials = indexed.withColumn("trial", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n_trials).cast("bigint"))))
    digest = F.md5(F.concat_ws("|", F.col("trial").cast("string"), F.col("SAMPLE")))
    drawn = draw_exact(trials, ["trial"], digest, "SAMPLE", F.lit(n_cases))
    slot = (F.col("ordinal") % SAMPLE_BLOCK).cast("int")
    members = drawn.where("drawn").groupBy("trial", F.floor(F.col("ordinal") / SAMPLE_BLOCK).alias("sb")).agg(
        F.collect_list(slot).alias("slots")
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = []
            for slots in batch["slots"]:
                label = np.zeros(SAMPLE_BLOCK, dtype=np.uint8)
                label[slots] = 1
                packed.append(np.packbits(label).tobytes())
            yield pd.DataFrame({"trial": batch["trial"], "sb": batch["sb"], "bits": packed})

    return members.mapInPandas(pack, LABELS)


def _by_sample(labels: DataFrame, n_trials: int) -> DataFrame:
    """(ordinal, drawn) from label blocks: whether each trial draws the sample."""

    def turn(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
        block = np.zeros((n_trials, SAMPLE_BLOCK), dtype=bool)
        for trial, bits in zip(blocks.column("trial").to_pylist(), blocks.column("bits").to_pylist()):
            unpacked = np.unpackbits(np.frombuffer(bits, dtype=np.uint8))
            block[trial - 1, :len(unpacked)] = unpacked
        offsets = pa.array(np.arange(0, (SAMPLE_BLOCK + 1) * n_trials, n_trials), pa.int32())
        drawn = pa.ListArray.from_arrays(offsets, pa.array(block.T.ravel()))
        return pa.table([pa.array(key[0].as_py() * SAMPLE_BLOCK + np.arange(SAMPLE_BLOCK)), drawn], ["ordinal", "drawn"])

    return labels.groupBy("sb").applyInArrow(turn, "ordinal bigint, drawn array<boolean>")


def _digest_by_sample(indexed: DataFrame, n_cases: int, n_trials: int) -> DataFrame:
    """(SAMPLE, drawn) of the same draw as ``digest_labels``: a sample is drawn up to each trial's last drawn digest."""

    def digest(trial: Column) -> Column:
        return F.md5(F.concat_ws("|", trial.cast("string"), F.col("SAMPLE")))

    trials = indexed.withColumn("trial", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n_trials).cast("bigint"))))
    last = last_drawn(trials, ["trial"], digest(F.col("trial")), ["SAMPLE", "ordinal"], n_cases)
    limits = last.agg(F.array_sort(F.collect_list(F.struct("trial", F.struct("_digest", "SAMPLE", "ordinal").alias("end")))).alias("limits"))  # a trial each
    reached = F.transform("limits", lambda t: F.struct(digest(t["trial"]).alias("_digest"), "SAMPLE", "ordinal") <= t["end"])
    return indexed.crossJoin(F.broadcast(limits)).select("SAMPLE", reached.alias("drawn"))


def _whole_tiles(cells: DataFrame, n_trials: int, n_codes: int, carriers: bool) -> DataFrame:
    """The tiles of ``trial_tiles``, one of each per task: a task adds up the samples it holds.

    ``cells`` has codes, vals and ``drawn``, a sample a row.
    """
    step = max(1, CELLS_AT_ONCE // n_codes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros((2, n_trials, n_codes)), np.zeros(n_codes, dtype=bool)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                lists = part.column("codes")
                codes, vals = lists.flatten().to_numpy(), part.column("vals").flatten().to_numpy(zero_copy_only=False)
                dense = np.zeros((len(lists), n_codes))
                dense[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), codes] = (vals > 0) if carriers else vals
                met[codes] = True
                # No trial is listed where no sample is drawn.
                drawn = part.column("drawn").flatten().to_numpy(zero_copy_only=False)
                chosen = drawn.reshape(-1, n_trials).astype(float) if len(drawn) else np.zeros((len(lists), n_trials))
                total[0] += chosen.T @ dense
                total[1] += (1.0 - chosen).T @ dense
        for cb in np.unique(np.flatnonzero(met) // CODE_BLOCK).tolist():
            block = np.zeros((2, n_trials, CODE_BLOCK))
            own = total[:, :, cb * CODE_BLOCK:(cb + 1) * CODE_BLOCK]
            block[:, :, :own.shape[2]] = own
            tbs = range(-(-n_trials // TRIAL_BLOCK))
            sums = [block[:, tb * TRIAL_BLOCK:(tb + 1) * TRIAL_BLOCK].tobytes() for tb in tbs]
            yield pa.record_batch([pa.array(tbs, pa.int64()), pa.array([cb] * len(sums), pa.int64()), pa.array(sums, pa.binary())], ["tb", "cb", "sums"])

    return cells.select(F.col("codes").cast("array<bigint>"), F.col("vals").cast("array<double>"), "drawn").mapInArrow(add, TILE)


def _tile(n_trials: int):
    def multiply(key, labels: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        _, cb, tb = key
        if cells.empty:
            return pd.DataFrame({"tb": [], "cb": [], "sums": []})
        block = np.zeros((SAMPLE_BLOCK, CODE_BLOCK))
        slots = np.repeat(cells["slot"].to_numpy(), [len(c) for c in cells["cols"]])
        block[slots, np.concatenate(cells["cols"].to_list())] = np.concatenate(cells["vals"].to_list())
        chosen = np.zeros((min(TRIAL_BLOCK, n_trials - tb * TRIAL_BLOCK), SAMPLE_BLOCK))
        for row, bits in zip(labels["row"], labels["bits"]):
            unpacked = np.unpackbits(np.frombuffer(bits, dtype=np.uint8))
            chosen[row, :len(unpacked)] = unpacked
        sums = np.stack([chosen @ block, (1.0 - chosen) @ block])
        return pd.DataFrame({"tb": [tb], "cb": [cb], "sums": [sums.tobytes()]})

    return multiply


def _add_tiles(unfold):
    """Sums of the tiles of each (trial block, code block), which come sorted; ``unfold`` turns a sum into rows."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, total, last = None, None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                tile = np.frombuffer(row.sums).reshape(2, -1, CODE_BLOCK)
                if (row.tb, row.cb) != current:
                    if total is not None:
                        yield unfold(last, total)
                    current, total, last = (row.tb, row.cb), np.zeros(tile.shape), row
                total += tile
        if total is not None:
            yield unfold(last, total)

    return add


def _trial_rows(n_trials: int, n_codes: int):
    def unfold(row, total: np.ndarray) -> pd.DataFrame:
        tb, cb = row.tb, row.cb
        trials = np.arange(tb * TRIAL_BLOCK + 1, min((tb + 1) * TRIAL_BLOCK, n_trials) + 1)
        codes = np.arange(cb * CODE_BLOCK, min((cb + 1) * CODE_BLOCK, n_codes))
        part = total[:, : len(trials), : len(codes)]
        return pd.DataFrame({
            "trial": np.repeat(trials, len(codes)),
            "code": np.tile(codes, len(trials)),
            "case_n": part[0].ravel(),
            "ctrl_n": part[1].ravel(),
        })

    return unfold


def _exceedances(n_trials: int, cases: int, controls: int):
    """Trials of a tile at least as extreme as the observed risk, by code; their rows never leave the tile."""

    def unfold(row, total: np.ndarray) -> pd.DataFrame:
        trials = min(TRIAL_BLOCK, n_trials - row.tb * TRIAL_BLOCK)
        cols = np.asarray(row.cols, dtype=np.int64)
        rr = np.asarray(row.risks, dtype=float)
        case_n, ctrl_n = np.rint(total[:, :trials][:, :, cols])
        with np.errstate(divide="ignore", invalid="ignore"):
            perm = (case_n / float(cases)) / (ctrl_n / float(controls))
            extreme = np.where(rr >= 1, perm >= rr, (rr < 1) & (perm <= rr))
        return pd.DataFrame({"code": row.cb * CODE_BLOCK + cols, "n_extreme": extreme.sum(axis=0)})

    return unfold


def trial_tiles(cells: DataFrame, labels: DataFrame, n_samples: int, n_trials: int, n_codes: int) -> DataFrame:
    """Case and control sums by (trial block, code block), one row per sample block: tb, cb, sums.

    ``cells`` has ordinal (sample position), codes and vals, a sample a row: at most CODE_BLOCK short columns of it go to
    a tile. A tile's sums are as high as its trials.
    """
    n_tb = -(-n_trials // TRIAL_BLOCK)
    n_cb = -(-n_codes // CODE_BLOCK)
    blocks = cells.select(
        F.floor(F.col("ordinal") / SAMPLE_BLOCK).alias("sb"),
        (F.col("ordinal") % SAMPLE_BLOCK).cast("int").alias("slot"),
        F.arrays_zip(F.col("codes").alias("code"), F.col("vals").alias("val")).alias("both"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_cb - 1).cast("bigint"))).alias("cb"),
    ).withColumn("both", F.filter("both", lambda c: F.floor(c["code"] / CODE_BLOCK) == F.col("cb"))).where(F.size("both") > 0).select(
        "sb", "cb", "slot",
        F.transform("both", lambda c: (c["code"] % CODE_BLOCK).cast("smallint")).alias("cols"),
        F.transform("both", lambda c: c["val"].cast("double")).alias("vals"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_tb - 1).cast("bigint"))).alias("tb"),
    )
    spread = labels.select(
        "sb",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_cb - 1).cast("bigint"))).alias("cb"),
        F.floor((F.col("trial") - 1) / TRIAL_BLOCK).alias("tb"),
        ((F.col("trial") - 1) % TRIAL_BLOCK).cast("int").alias("row"),
        "bits",
    )
    # Explicit numbers keep AQE from merging partitions that are small in bytes but heavy in arithmetic.
    key = ("sb", "cb", "tb")
    n_tiles = min(-(-n_samples // SAMPLE_BLOCK) * n_cb * n_tb, MOST_TASKS)
    spread, blocks = spread.repartition(n_tiles, *key), blocks.repartition(n_tiles, *key)
    return spread.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInPandas(_tile(n_trials), TILE)


def _sorted_tiles(tiles: DataFrame, n_trials: int, n_codes: int) -> DataFrame:
    n_tb, n_cb = -(-n_trials // TRIAL_BLOCK), -(-n_codes // CODE_BLOCK)
    return tiles.repartition(min(n_tb * n_cb, MOST_TASKS), "tb", "cb").sortWithinPartitions("tb", "cb")


def trial_totals(tiles: DataFrame, n_trials: int, n_codes: int) -> DataFrame:
    """Case and control totals: (trial, code, case_n, ctrl_n), unrounded."""
    return _sorted_tiles(tiles, n_trials, n_codes).mapInPandas(_add_tiles(_trial_rows(n_trials, n_codes)), TOTALS)


def _drawn_tiles(
    counts: DataFrame, samples: DataFrame, size: Cohort, n_trials: int, n_codes: int, value: Column, carriers: bool, draw: str,
    rows: DataFrame | None = None,
) -> DataFrame:
    """Tiles of all trials' case and control sums; only case and ctrl samples take part.

    ``rows`` are the counts as ``cube.sample_rows`` where the caller has them; else a sample's counts are gathered here.
    """
    if draw not in ("seeded", "digest"):
        raise ValueError(f"unknown draw {draw!r}")
    eligible = samples.where(F.col("PHENOTYPE").isin("case", "ctrl")).select("SAMPLE")
    indexed = with_ordinal(eligible, "SAMPLE")
    whole = n_trials * n_codes <= WHOLE_CELLS
    if rows is None:
        cell_value = F.when(value > 0, 1).otherwise(0) if carriers else value
        own = counts.select("SAMPLE", F.struct("code", cell_value.alias("val")).alias("cell")).groupBy("SAMPLE").agg(F.collect_list("cell").alias("cells"))
        cells = own.select("SAMPLE", F.col("cells.code").alias("codes"), F.col("cells.val").alias("vals"))
    else:
        vals = F.transform("counts", lambda n: F.when(n > 0, 1).otherwise(0)) if carriers and not whole else F.col("counts")
        cells = rows.select("SAMPLE", "codes", vals.alias("vals"))
    n, spark = size.cases + size.controls, counts.sparkSession
    if not whole:
        labels = seeded_labels(spark, n, size.cases, n_trials) if draw == "seeded" else digest_labels(indexed, size.cases, n_trials)
        return trial_tiles(cells.join(indexed, "SAMPLE").select("ordinal", "codes", "vals"), labels, n, n_trials, n_codes)
    if draw == "seeded":
        drawn = indexed.join(_by_sample(seeded_labels(spark, n, size.cases, n_trials), n_trials), "ordinal").select("SAMPLE", "drawn")
    else:
        drawn = _digest_by_sample(indexed, size.cases, n_trials)
    return _whole_tiles(cells.join(drawn, "SAMPLE"), n_trials, n_codes, carriers)


def _seen(counts: DataFrame, rows: DataFrame | None, n_codes: int) -> DataFrame:
    """The categories of ``counts``; from ``rows`` where given, without spelling their counts out."""
    return counts.select("code").distinct() if rows is None else code_sums(rows, n_codes).select("code")


def permuted_counts(
    counts: DataFrame,
    samples: DataFrame,
    size: Cohort,
    n_trials: int,
    n_codes: int,
    value: Column,
    carriers: bool = False,
    draw: str = "seeded",
    rows: DataFrame | None = None,
) -> DataFrame:
    """Rounded case and control counts of every (trial, code) seen in ``counts``.

    Case and control totals are summed separately before rounding.
    """
    totals = trial_totals(_drawn_tiles(counts, samples, size, n_trials, n_codes, value, carriers, draw, rows), n_trials, n_codes)
    return totals.join(_seen(counts, rows, n_codes), "code", "left_semi").select(
        "trial", "code",
        F.bround("case_n", 0).cast("bigint").alias("case_n"),
        F.bround("ctrl_n", 0).cast("bigint").alias("ctrl_n"),
    )


def permuted_risk(trials: DataFrame, size: Cohort) -> DataFrame:
    ratio = divide(F.col("case_n") / F.lit(float(size.cases)), F.col("ctrl_n") / F.lit(float(size.controls)))
    return trials.withColumn("perm_rr", ratio)


def _with_p(counted: DataFrame, n_trials: int) -> DataFrame:
    p = F.when(~F.isnan("Relative_Risk"), (F.col("n_extreme") + 1) / F.lit(float(n_trials + 1)))
    return counted.withColumn("P", p)


def permutation_p(trials: DataFrame, observed: DataFrame, n_trials: int) -> DataFrame:
    """(#trials at least as extreme + 1) / (trials + 1); null where the observed risk is undefined.

    ``trials`` has code and perm_rr, ``observed`` has code and Relative_Risk.
    """
    rr, perm = F.col("Relative_Risk"), F.col("perm_rr")
    usable = ~F.isnan(perm)
    extreme = usable & (((rr >= 1) & (perm >= rr)) | ((rr < 1) & (perm <= rr)))
    joined = trials.join(observed.select("code", "Relative_Risk"), "code")
    counted = joined.groupBy("code").agg(
        F.first("Relative_Risk").alias("Relative_Risk"), F.count_if(~F.isnan(rr) & extreme).alias("n_extreme")
    )
    return _with_p(counted, n_trials)


def tiled_p(
    counts: DataFrame, samples: DataFrame, size: Cohort, observed: DataFrame, n_trials: int, n_codes: int, value: Column,
    carriers: bool = False, draw: str = "seeded", rows: DataFrame | None = None,
) -> DataFrame:
    """``permutation_p`` counted inside the tiles: one number per code and trial block is shuffled, no trial row."""
    seen = observed.join(_seen(counts, rows, n_codes), "code", "left_semi").select("code", "Relative_Risk")
    wanted = seen.groupBy(F.floor(F.col("code") / CODE_BLOCK).alias("cb")).agg(
        F.array_sort(F.collect_list(F.struct((F.col("code") % CODE_BLOCK).alias("col"), F.col("Relative_Risk").alias("risk")))).alias("_seen")
    )  # at most CODE_BLOCK entries a row
    wanted = wanted.select("cb", F.col("_seen.col").alias("cols"), F.col("_seen.risk").alias("risks"))
    tiles = _drawn_tiles(counts, samples, size, n_trials, n_codes, value, carriers, draw, rows).join(wanted, "cb")
    parts = _sorted_tiles(tiles, n_trials, n_codes).mapInPandas(
        _add_tiles(_exceedances(n_trials, size.cases, size.controls)), "code bigint, n_extreme bigint"
    )
    counted = parts.groupBy("code").agg(F.sum("n_extreme").alias("n_extreme"))
    return _with_p(seen.join(counted, "code").select("code", "Relative_Risk", "n_extreme"), n_trials)


def two_stage_p(
    counts: DataFrame,
    samples: DataFrame,
    size: Cohort,
    observed: DataFrame,
    n_trials: int,
    n_codes: int,
    value: Column,
    carriers: bool = False,
    draw: str = "seeded",
    cut: float = 0.01,
    factor: int = 10,
    trials: DataFrame | None = None,
    rows: DataFrame | None = None,
) -> DataFrame:
    """Permutation P of all categories, refined with ``factor`` times the trials where P < ``cut``.

    ``trials`` are the counts of the first stage where ``permuted_counts`` has made them already.
    """
    if trials is None:
        first = tiled_p(counts, samples, size, observed, n_trials, n_codes, value, carriers, draw, rows)
    else:
        first = permutation_p(permuted_risk(trials, size), observed, n_trials)
    first = cut_lineage(first)  # one row per category; read twice below
    low = first.where(F.col("P") < cut).select("code")
    if low.isEmpty():
        return first.select("code", "Relative_Risk", "P", "n_extreme", F.lit(n_trials).alias("n_trials"))
    more = n_trials * factor
    again = counts.join(low, "code", "left_semi")
    if rows is not None:
        wanted = [r[0] for r in low.collect()]  # bounded by the category domain
        kept = F.filter(F.arrays_zip("codes", "counts"), lambda c: c["codes"].isin(wanted))
        rows = rows.select("SAMPLE", kept.alias("kept")).where(F.size("kept") > 0).select("SAMPLE", "kept.codes", "kept.counts")
    second = tiled_p(again, samples, size, observed, more, n_codes, value, carriers, draw, rows).select("code", F.col("P").alias("_refined"), F.col("n_extreme").alias("_n_extreme"))
    refined = F.col("_refined").isNotNull()
    return first.join(second, "code", "left").select(
        "code", "Relative_Risk",
        F.coalesce("_refined", "P").alias("P"),
        F.coalesce("_n_extreme", "n_extreme").alias("n_extreme"),
        F.when(refined, F.lit(more)).otherwise(F.lit(n_trials)).alias("n_trials"),
    )


def signed_binomial(trials: DataFrame, size: Cohort) -> DataFrame:
    """Two-sided binomial P of every (trial, code), negative where the permuted risk is below 1."""
    p = size.case_share

    @F.pandas_udf("double")
    def two_sided(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.to_numpy(dtype=np.int64), b.to_numpy(dtype=np.int64)
        return pd.Series(distinct_tails(x, x + y, p)[0])

    # Count pairs repeat across trials: each distinct pair is tested once and joined back.
    pairs = trials.select("case_n", "ctrl_n").distinct().withColumn("_p", two_sided("case_n", "ctrl_n"))
    risk = permuted_risk(trials, size)
    return risk.join(pairs, ["case_n", "ctrl_n"]).withColumn(
        "signed_p", F.when(F.col("perm_rr") < 1, -F.col("_p")).otherwise(F.col("_p"))
    ).drop("_p")


def swap_within_groups(labels: DataFrame, group: str, label: str, seed: int) -> DataFrame:
    """Swap the two labels of a group or leave them, by a seeded coin per group. Fails on a group of more than two rows."""
    digit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(group)).cast("binary")), 1, 1), 16, 10).cast("int")
    both = labels.groupBy(group).agg(F.min(label).alias("_low"), F.max(label).alias("_high"), F.count(F.lit(1)).alias("_n"))
    too_many = F.raise_error(F.concat(F.lit("more than two rows in group "), F.col(group))).cast("string")
    low = F.when(F.col("_n") > 2, too_many).otherwise(F.col("_low"))
    other = F.when(F.col(label) == low, F.col("_high")).otherwise(low)
    swapped = F.when((digit % 2 == 1) | (F.col("_n") > 2), other).otherwise(F.col(label))
    return labels.join(both, group).withColumn("swapped", swapped).drop("_low", "_high", "_n")
