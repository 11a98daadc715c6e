"""Interval tracks, gene matrix, sample tables, category sets, and result files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varicube.domain import DIMENSIONS, CategoryDomain
from varicube.sources import bgzf

# Lines of an interval file that hold no interval: blank, comments, browser lines, and a line of column names.
NO_INTERVAL = r"(?i)^(?:\s*$|#|track\b|browser\b|[^\t]*\t(?:chrom)?start\t(?:chrom)?end(?:\t|$))"


def read_intervals(spark: SparkSession, path: str, contig: str | None = None) -> DataFrame:
    """A BED file (plain, gzip or blocked gzip): its first three columns. A line that is no interval and no header fails the read.

    Blocked gzip is read by many tasks; with an index beside it, only the wanted contig's blocks are read.
    """
    split = bgzf.split_lines(spark, path, contig)
    lines = (spark.read.text(path) if split is None else split).where(~F.col("value").rlike(NO_INTERVAL))
    cells = F.split("value", "\t", -1)

    def position(i: int):
        value = F.get(cells, i).try_cast("bigint")
        bad = F.raise_error(F.concat(F.lit("not an interval: "), "value")).cast("bigint")
        return F.when(value.isNull(), bad).otherwise(value)

    rows = lines.select(F.get(cells, 0).alias("chrom"), position(1).alias("start"), position(2).alias("end"))
    return rows.where(F.col("chrom") == contig) if contig else rows


def read_tracks(spark: SparkSession, files: list[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """All tracks in one frame with their number, from (path, name) pairs in mask order."""
    tracks = None
    for number, (path, _) in enumerate(files):
        one = read_intervals(spark, path).withColumn("track", F.lit(number))
        tracks = one if tracks is None else tracks.unionByName(one)
    if tracks is None:
        raise ValueError("no interval tracks given")
    return tracks, [name for _, name in files]


def write_segments(segments: DataFrame, names: list[str], out_dir: str) -> None:
    """Merged segments as parquet by chromosome, with the track names beside them."""
    segments.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").write.mode("overwrite").parquet(f"{out_dir}/segments")
    segments.sparkSession.createDataFrame(list(enumerate(names)), "track int, name string").coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/tracks")


def read_segments(spark: SparkSession, out_dir: str) -> tuple[DataFrame, list[str]]:
    names = [r["name"] for r in spark.read.parquet(f"{out_dir}/tracks").orderBy("track").collect()]
    return spark.read.parquet(f"{out_dir}/segments"), names


def read_gene_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(gene_name, gene_sets) and the set names; the last row of a repeated name wins.

    Only the text ``1`` marks membership. File order comes from the split-ordered row id.
    """
    wide = spark.read.csv(path, sep="\t", header=True)
    names = wide.columns[2:]
    sets = F.array_compact(F.array(*[F.when(F.col(f"`{n}`") == "1", F.lit(n)) for n in names]))
    rows = wide.select(F.col(f"`{wide.columns[1]}`").alias("gene_name"), sets.alias("gene_sets"), F.monotonically_increasing_id().alias("_row"))
    return rows.groupBy("gene_name").agg(F.max_by("gene_sets", "_row").alias("gene_sets")), names


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """SAMPLE, PHENOTYPE and, where present, FAMILY and SET."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(*[c for c in ("SAMPLE", "PHENOTYPE", "FAMILY", "SET") if c in rows.columns])


def read_adjustment(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True).select("SAMPLE", F.col("AdjustFactor").cast("double"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header and inferred types."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True)


def write_table(frame: DataFrame, path: str, gzip: bool = False, sep: str = "\t") -> None:
    frame.write.mode("overwrite").csv(path, sep=sep, header=True, compression="gzip" if gzip else "none")


def write_counts(counts: DataFrame, domain: CategoryDomain, out_dir: str) -> None:
    """Category counts as long parquet, and the domain that decodes them."""
    counts.write.mode("overwrite").parquet(f"{out_dir}/counts")
    text = json.dumps({"gene_sets": domain.gene_sets, "scores": domain.scores, "annotations": domain.annotations})
    counts.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out_dir}/domain")


def read_counts(spark: SparkSession, out_dir: str) -> tuple[DataFrame, CategoryDomain]:
    stored = json.loads(spark.read.text(f"{out_dir}/domain").first()[0])
    domain = CategoryDomain(*(tuple(stored[k]) for k in ("gene_sets", "scores", "annotations")))
    return spark.read.parquet(f"{out_dir}/counts"), domain


def with_codes(frame: DataFrame, domain: CategoryDomain) -> DataFrame:
    """Category codes, from the five term columns where the table has them, else from the Category key.

    A category outside the domain fails the read.
    """
    if set(DIMENSIONS) <= set(frame.columns):
        terms, shown = [F.col(name) for name in DIMENSIONS], F.concat_ws("_", *DIMENSIONS)
    else:
        terms, shown = domain.parse_key(F.col("Category")), F.col("Category")
    code = domain.encode(*terms)
    unknown = F.raise_error(F.concat(F.lit("category outside the domain: "), F.coalesce(shown, F.lit("null")))).cast("bigint")
    return frame.withColumn("code", F.when(code.isNull(), unknown).otherwise(code))


def choose_domains(wanted: str, flags: list[str]) -> list[str]:
    """``all``, ``run_all`` or a comma-separated, case-insensitive list of is_* names."""
    names = [f[3:] for f in flags if f.startswith("is_")]
    if wanted == "run_all":
        return ["all", *names]
    by_lower = {"all": "all", **{n.lower(): n for n in names}}
    chosen = []
    for item in wanted.split(","):
        key = item.strip().lower()
        if key not in by_lower:
            raise ValueError(f"invalid domain name: {item.strip()}")
        chosen.append(by_lower[key])
    return chosen
