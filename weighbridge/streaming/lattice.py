"""A lattice kept up to date by Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_root


def binned_stream(stream: DataFrame, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """signal, day_s, n_raw, bin_min, bin_max of a stream with ts, event_type, value; rows later than the watermark go."""
    w = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", width).alias("w"), F.col("event_type").alias("signal"))
    g = w.agg(F.count("value").alias("n_raw"), F.min("value").alias("bin_min"), F.max("value").alias("bin_max"))
    return g.select("signal", F.unix_seconds("w.start").alias("day_s"), "n_raw", "bin_min", "bin_max")


def run_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams the event files to their end and gives the lattice. Output and state lie in the shared folder."""
    base = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: one file or a folder of files

    def upsert(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{base}/lattice")

    q = binned_stream(stream).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{base}/lattice")
    last = rows.groupBy("signal", "day_s").agg(F.max_by(F.struct("n_raw", "bin_min", "bin_max"), "batch").alias("r"))
    return last.select("signal", "day_s", "r.*")
