"""Interval tracks: merging into disjoint masked segments, and annotating regions by overlap.

Coordinates are 0-based and half-open. Both operators cut the coordinate axis into fixed-width bins, so
work is spread by (chrom, bin) and no task depends on how many rows one chromosome holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SWEEP_BIN = 1 << 16
JOIN_BIN = 1 << 12
MASK_BITS = 62


def _bin(position: Column, width: int) -> Column:
    return F.floor(position / F.lit(width))


def coverage_segments(intervals: DataFrame, n_tracks: int, bin_width: int = SWEEP_BIN) -> DataFrame:
    """Disjoint segments between consecutive interval ends, with the set of covering tracks.

    ``intervals`` has chrom, start, end, track (0-based). Returns chrom, start, end and ``mask``: a BIGINT
    with the first track as the lowest bit, or an array of track ids beyond 62 tracks. Neighbouring
    segments with equal masks stay apart; uncovered gaps are dropped.

    The sweep is a prefix sum in two levels. Ends are netted per (position, track) by partial aggregation;
    each bin is swept on its own; a table of at most one row per (chrom, bin) carries the covers
    entering the bin and the first position of the next one.
    """
    tracks = range(n_tracks)
    ends = intervals.select(
        "chrom", "track",
        F.inline(F.array(
            F.struct(F.col("start").alias("pos"), F.lit(1).alias("delta")),
            F.struct(F.col("end").alias("pos"), F.lit(-1).alias("delta")),
        )),
    )
    steps = [F.sum(F.when(F.col("track") == t, F.col("delta")).otherwise(0)).alias(f"d{t}") for t in tracks]
    points = ends.groupBy("chrom", "pos").agg(*steps).withColumn("bin", _bin(F.col("pos"), bin_width))

    per_bin = points.groupBy("chrom", "bin").agg(
        F.min("pos").alias("first_pos"), *[F.sum(f"d{t}").alias(f"s{t}") for t in tracks]
    )
    along = Window.partitionBy("chrom").orderBy("bin")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    entering = per_bin.select(
        "chrom", "bin",
        F.lead("first_pos").over(along).alias("next_first"),
        *[F.coalesce(F.sum(f"s{t}").over(earlier), F.lit(0)).alias(f"e{t}") for t in tracks],
    )
    inside = Window.partitionBy("chrom", "bin").orderBy("pos")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    swept = points.select(
        "chrom", "bin", "pos",
        F.lead("pos").over(inside).alias("next_pos"),
        *[F.sum(f"d{t}").over(upto).alias(f"c{t}") for t in tracks],
    ).join(entering, ["chrom", "bin"])
    covered = [F.col(f"c{t}") + F.col(f"e{t}") > 0 for t in tracks]
    if n_tracks <= MASK_BITS:
        mask = F.lit(0).cast("bigint")
        for t in tracks:
            mask = mask + F.when(covered[t], F.lit(1 << t).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        keep = F.col("mask") > 0
    else:
        mask = F.array_compact(F.array(*[F.when(covered[t], F.lit(t)) for t in tracks]))
        keep = F.size("mask") > 0
    return swept.select(
        "chrom",
        F.col("pos").alias("start"),
        F.coalesce("next_pos", "next_first").alias("end"),
        mask.alias("mask"),
    ).where(keep & F.col("end").isNotNull())


def region_of(pos: Column, ref: Column, alt: Column) -> tuple[Column, Column]:
    """Search region of a variant (``pos`` is 1-based)."""
    deletion = F.length(ref) > 1
    start = F.when(deletion, pos).otherwise(pos - 1)
    end = (
        F.when(deletion, pos + F.length(ref) - 1)
        .when(F.length(alt) > 1, pos + 1)
        .otherwise(pos)
    )
    return start.cast("bigint"), end.cast("bigint")


def _over_bins(frame: DataFrame, start: str, end: str, width: int) -> DataFrame:
    last = F.floor((F.col(end) - 1) / F.lit(width))
    return frame.withColumn("bin", F.explode(F.sequence(_bin(F.col(start), width), last)))


def overlap_masks(regions: DataFrame, segments: DataFrame, bin_width: int = JOIN_BIN) -> DataFrame:
    """OR of the masks of all segments overlapping each distinct (chrom, r_start, r_end).

    Regions are made distinct first, so a position shared by a third of all variants is joined once; the
    segments are disjoint, so a bin holds at most ``bin_width`` of them. A segment met in two bins changes
    nothing because OR is idempotent.
    """
    array_mask = segments.schema["mask"].dataType.typeName() == "array"
    keyed = _over_bins(regions.select("chrom", "r_start", "r_end").distinct().where("r_end > r_start"), "r_start", "r_end", bin_width)
    pieces = _over_bins(segments.select("chrom", "start", "end", "mask"), "start", "end", bin_width)
    met = keyed.join(pieces, ["chrom", "bin"]).where(
        (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    )
    if array_mask:
        union = F.array_sort(F.array_distinct(F.flatten(F.collect_set("mask"))))
    else:
        union = F.bit_or("mask")
    return met.groupBy("chrom", "r_start", "r_end").agg(union.alias("mask"))


def annotate_overlaps(variants: DataFrame, segments: DataFrame, bin_width: int = JOIN_BIN) -> DataFrame:
    """Variants (CHROM, POS, REF, ALT, ...) with ``ANNOT``: mask 0 or an empty array where nothing overlaps."""
    r_start, r_end = region_of(F.col("POS").cast("bigint"), F.col("REF"), F.col("ALT"))
    placed = variants.withColumns({"r_start": r_start, "r_end": r_end})
    regions = placed.select(F.col("CHROM").alias("chrom"), "r_start", "r_end")
    masks = overlap_masks(regions, segments, bin_width).withColumnRenamed("chrom", "CHROM")
    array_mask = masks.schema["mask"].dataType.typeName() == "array"
    nothing = F.array().cast("array<int>") if array_mask else F.lit(0).cast("bigint")
    joined = placed.join(masks, ["CHROM", "r_start", "r_end"], "left")
    return joined.withColumn("ANNOT", F.coalesce("mask", nothing)).drop("mask", "r_start", "r_end")
