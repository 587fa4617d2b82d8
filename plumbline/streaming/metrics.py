"""Metrics of a training run per window of steps, in batch and over a growing log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def step_windows(df: DataFrame, run: str, step: str, values: list[str], every: int) -> DataFrame:
    """(run, window, n, mean of each value) per ``every`` steps; nulls are not measured. The same
    aggregation serves a batch table and a stream in update mode."""
    return df.groupBy(run, F.floor(F.col(step) / every).alias("window")).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def follow(spark: SparkSession, source: str, schema: T.StructType, run: str, step: str, values: list[str], every: int, lateness: int, sink, checkpoint: str):
    """Keep the windows of a growing JSON-lines log current: changed windows go to ``sink(df, batch_id)``, with
    ``run``, ``window``, ``n`` and the means. Returns the finished query.

    Steps are the event time (one second each). A row up to ``lateness`` steps behind the furthest step of earlier
    batches still changes its window; windows further back are closed, their state is dropped and rows for them are
    left out. The furthest step is that of all runs, so ``lateness`` must cover how far runs are apart."""
    stream = spark.readStream.schema(schema).json(source).withColumn("_at", F.timestamp_seconds(F.col(step))).withWatermark("_at", f"{lateness} seconds")
    g = stream.groupBy(run, F.window("_at", f"{every} seconds").alias("_w")).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])
    out = g.select(run, (F.unix_timestamp("_w.start") / every).cast("bigint").alias("window"), "n", *[f"mean_{v}" for v in values])
    q = out.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
