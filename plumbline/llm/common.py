"""Helpers shared by the operators of this package."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import scratch_path

#: Whitespace that separates words and is stripped from lines: space and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a missing id: smaller than every other.
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it again. Unlike blocks kept by executors
    it survives their loss, and unlike a checkpoint it is columnar and compressed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def whole(column: str = "text") -> Column:
    """A text; a missing one is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def in_fold(column: str, folds: int, fold: int = 0) -> Column:
    """Whether crc32 of an id written as text leaves ``fold`` modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds == fold


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
