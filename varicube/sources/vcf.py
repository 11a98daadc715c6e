"""Annotated variant files: header, INFO and CSQ parsing, and writing back."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varicube.sources import bgzf


@dataclass(frozen=True)
class VariantHeader:
    lines: tuple[str, ...]
    columns: tuple[str, ...]
    csq_fields: tuple[str, ...]
    tracks: tuple[str, ...]


def csq_field_names(line: str) -> list[str]:
    """Field names after ``Format:`` in the CSQ header line."""
    found = re.search(r"Format:\s*([^\">]+)", line)
    return found.group(1).strip().split("|") if found else []


def track_field_names(line: str) -> list[str]:
    """Track names after ``Key=`` in the ANNOT header line."""
    found = re.search(r"Key=([^\">\n]+)", line)
    return found.group(1).strip().split("|") if found else []


def column_names(line: str) -> list[str]:
    return line.strip().lstrip("#").split("\t")


def read_header(spark: SparkSession, path: str) -> VariantHeader:
    """Header lines of the first file under ``path``: the driver sees no variant row."""
    if bgzf.split_lines(spark, path) is not None:
        lines = bgzf.header_lines(path)
    else:
        first = sorted(spark.read.text(path).inputFiles())[0]
        lines = [r[0] for r in spark.read.text(first).where(F.startswith("value", F.lit("#"))).collect()]
    columns = next((column_names(x) for x in lines if x.startswith("#CHROM")), [])
    csq = next((csq_field_names(x) for x in lines if x.startswith("##INFO=<ID=CSQ")), [])
    tracks = next((track_field_names(x) for x in lines if x.startswith("##INFO=<ID=ANNOT")), [])
    return VariantHeader(tuple(lines), tuple(columns), tuple(csq), tuple(tracks))


def info_map(info: Column) -> Column:
    """``k=v;k=v`` as a map; a value may contain ``=``, a key without ``=`` maps to null."""

    def entry(item):
        cut = F.instr(item, "=")
        return F.struct(
            F.when(cut > 0, F.substring(item, F.lit(1), cut - 1)).otherwise(item),
            F.when(cut > 0, F.substring(item, cut + 1, F.length(item))),
        )

    return F.map_from_entries(F.transform(F.split(info, ";"), entry))


def csq_columns(csq: Column, names) -> list[Column]:
    """One column per CSQ field, by position."""
    parts = F.split(csq, r"\|", -1)
    return [F.get(parts, i).alias(name) for i, name in enumerate(names)]


def read_variants(
    spark: SparkSession, path: str, partitions: int | None = None, contig: str | None = None
) -> tuple[DataFrame, VariantHeader]:
    """Variants (of one contig if asked) with INFO keys and CSQ fields as columns (all text, ANNOT as BIGINT or track ids).

    Blocked gzip is read by many tasks, and with an index only the contig's blocks. A plain gzip file is one split, so a
    reader of few large files should pass ``partitions`` to spread rows before the wide work.
    """
    header = read_header(spark, path)
    split = bgzf.split_lines(spark, path, contig)
    rows = (spark.read.text(path) if split is None else split).where(~F.startswith("value", F.lit("#")))
    if contig is not None:
        rows = rows.where(F.startswith("value", F.lit(f"{contig}\t")))
    if partitions and split is None:
        rows = rows.repartition(partitions)
    cells = F.split("value", "\t", -1)
    table = rows.select(*[cells[i].alias(name) for i, name in enumerate(header.columns)])
    table = table.withColumn("_info", info_map(F.col("INFO")))
    keys = [k for k in _info_keys(table, header) if k not in ("CSQ", "ANNOT")]
    fixed = [F.col(c) for c in header.columns if c != "INFO"]
    extra = [F.try_element_at("_info", F.lit(k)).alias(k) for k in keys]
    csq = csq_columns(F.try_element_at("_info", F.lit("CSQ")), header.csq_fields)
    annot = []
    if header.tracks:
        text = F.try_element_at("_info", F.lit("ANNOT"))
        annot = [_annot_column(text, len(header.tracks))]
    return table.select(*fixed, *extra, *csq, *annot), header


def _info_keys(table: DataFrame, header: VariantHeader) -> list[str]:
    """INFO keys that the header declares, then those found in the rows only: one distinct over the keys."""
    declared = [m.group(1) for m in (re.search(r"^##INFO=<ID=([^,>]+)", line) for line in header.lines) if m]
    found = [r[0] for r in table.select(F.explode(F.map_keys("_info"))).distinct().collect()]
    others = sorted(k for k in found if k and k not in declared and k not in header.columns)
    keys = [*declared, *others]
    return keys if "SAMPLE" in keys else ["SAMPLE", *keys]


def _annot_column(text: Column, n_tracks: int) -> Column:
    """A mask as BIGINT, or with more than 62 tracks the comma-separated track numbers as an array."""
    if n_tracks <= 62:
        return text.cast("bigint").alias("ANNOT")
    numbers = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda t: t != "").cast("array<int>")
    return numbers.alias("ANNOT")


def annotated_lines(variants: DataFrame, columns) -> DataFrame:
    """Text lines of an annotated variant file: INFO extended with ``ANNOT=`` and the mask or the track numbers."""
    annot = F.col("ANNOT")
    if variants.schema["ANNOT"].dataType.typeName() == "array":
        value = F.array_join(annot.cast("array<string>"), ",")
    else:
        value = annot.cast("string")
    cells = [F.concat(F.col("INFO"), F.lit(";ANNOT="), value) if c == "INFO" else F.col(c) for c in columns]
    return variants.select(F.concat_ws("\t", *cells).alias("value"))


def annotated_header(header: VariantHeader, tracks) -> list[str]:
    """Header lines with the ANNOT key line placed before the column line."""
    key = f"##INFO=<ID=ANNOT,Key={'|'.join(tracks)}>"
    return [*header.lines[:-1], key, header.lines[-1]]


def write_annotated(variants: DataFrame, header: VariantHeader, tracks, out_dir: str) -> None:
    """Gzip text parts: the header as its own part that sorts first, rows in position order."""
    spark = variants.sparkSession
    head = spark.createDataFrame([("\n".join(annotated_header(header, tracks)),)], "value string")
    head.coalesce(1).write.mode("overwrite").option("compression", "gzip").text(f"{out_dir}/part=0")
    placed = variants.repartitionByRange(chromosome_rank(F.col("CHROM")), F.col("CHROM"), F.col("POS").cast("bigint"))
    placed = placed.sortWithinPartitions(chromosome_rank(F.col("CHROM")), F.col("CHROM"), F.col("POS").cast("bigint"))
    annotated_lines(placed, header.columns).write.mode("overwrite").option("compression", "gzip").text(f"{out_dir}/part=1")


def chromosome_rank(chrom: Column) -> Column:
    """Version order of chromosome names: numbers by value, then the rest."""
    return F.coalesce(F.regexp_extract(chrom, r"^(?:chr)?(\d+)$", 1).try_cast("int"), F.lit(1_000_000))
