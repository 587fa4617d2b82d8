"""Resumable stages: only keys absent from a stage's own sink are processed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose (composite) key has no finished row."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def poisoned(begun: DataFrame, finished: DataFrame, keys: list[str], tries: int = 2) -> DataFrame:
    """Keys begun at least ``tries`` times and never finished."""
    return begun.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= tries).join(finished.select(*keys).distinct(), keys, "left_anti")


def run_available(spark: SparkSession, source: str, schema: T.StructType, stage: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 100) -> None:
    """Process the files that arrived since the last run and stop. The checkpoint remembers which
    files are done, so a lost run continues and no file is processed twice."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    (stage(stream).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
