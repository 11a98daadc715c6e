"""Category counts that grow with arriving variant files.

Each micro-batch writes its own counts under its batch number, so a replayed batch overwrites itself and
no state is kept between batches; readers sum the parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varicube.domain import CategoryDomain
from varicube.operators.cube import category_counts


def follow(termed_stream: DataFrame, domain: CategoryDomain, out_dir: str, progress_dir: str):
    """Count everything available in a stream of termed variants, then stop."""

    def count_batch(batch: DataFrame, number: int) -> None:
        category_counts(batch, domain).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    return (
        termed_stream.writeStream.foreachBatch(count_batch)
        .option("checkpointLocation", progress_dir).trigger(availableNow=True).start()
    )


def totals(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(out_dir).groupBy("SAMPLE", "code").agg(F.sum("n").alias("n"))
