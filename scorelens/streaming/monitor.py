"""Streaming score monitoring.

Everything fitted in batch (WOE maps, group maps, PSI edges) is a DataFrame,
so it can be the static side of a stream-static join.  ``band_counts_stream``
keeps the score-band distribution per period up to date as scored rows arrive
(a streaming aggregation; state = bands x periods, bounded).
``run_available`` drains what is available now (Trigger.AvailableNow) into a
sink with a fresh checkpoint under the shared checkpoint folder; every call
starts from the beginning of the stream.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.functions.bands import score_band
from scorelens.session import scratch_path


def band_counts_stream(stream: DataFrame, score: str = "score", sample_col: str = "sample",
                       n_bands: int = 20) -> DataFrame:
    """(sample, band, n) maintained incrementally; rows without a band are not counted."""
    return (stream.select(F.col(sample_col).alias("sample"), score_band(score, n_bands).alias("band"))
            .where(F.col("band").isNotNull()).groupBy("sample", "band").agg(F.count(F.lit(1)).alias("n")))


def woe_apply_stream(stream: DataFrame, wmap: DataFrame, features, fill: float = 0.0) -> DataFrame:
    """Apply a fitted WOE map to a stream (stream-static, size-checked broadcast joins)."""
    from scorelens.operators.woe import woe_apply

    return woe_apply(stream, wmap, features, fill=fill)


def run_available(spark: SparkSession, query: DataFrame, output_mode: str = "complete",
                  name: str | None = None) -> DataFrame:
    """Run a streaming query over all data available now and return its result as a batch DataFrame.

    Appended rows go to Parquet files in the shared folder, whatever their number.  Complete and
    update results are aggregates; they go to a memory table, so they must be small (band counts are
    bands x periods)."""
    write = query.writeStream.outputMode(output_mode).option("checkpointLocation", scratch_path(spark, "stream-ckpt")).trigger(availableNow=True)
    if output_mode == "append":
        path = scratch_path(spark, "stream-rows")
        write.format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(query.schema).parquet(path)
    name = name or f"scorelens_stream_{uuid.uuid4().hex[:8]}"
    write.format("memory").queryName(name).start().awaitTermination()
    return spark.table(name)


def orders_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """The orders parquet as a file stream (schema taken from the batch table)."""
    base = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{base}/orders.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    files = spark.read.parquet(f"{base}/orders.parquet").inputFiles()
    if files and all(f.rstrip("/").endswith("/orders.parquet") for f in files):
        # the table is one file: a stream watches its folder, filtered by name
        return stream.option("pathGlobFilter", "orders.parquet").parquet(base)
    return stream.parquet(f"{base}/orders.parquet")  # the table is a folder of part files
