"""Answers of user-supplied scorers, memoised by content."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of the rows a scorer gets at once, about.
PART_BYTES = 1 << 22


def cache_key(*parts: Column) -> Column:
    """sha256 over all parameters of a request, separated by a zero byte."""
    return F.sha2(F.concat_ws("\u0000", *[p.cast("string") for p in parts]), 256)


def score(df: DataFrame, make_scorer: Callable[[], Callable[[pd.DataFrame], pd.Series]], answer: str = "answer") -> DataFrame:
    """Any model over the rows of a table: ``make_scorer`` runs once per task, the scorer gets
    parts of Arrow batches as pandas tables, some megabytes each however long the texts are, and returns one answer
    text per row. The rows themselves pass as Arrow, without a copy."""
    schema = T.StructType([*df.schema.fields, T.StructField(answer, T.StringType())])

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = max(1, batch.num_rows * PART_BYTES // max(batch.nbytes, 1))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make_scorer()
        for batch in batches:
            for part in parts(batch):
                pdf = part.to_pandas()
                for c in pdf.columns:
                    if isinstance(pdf[c].dtype, pd.DatetimeTZDtype):  # in the session's time zone, as Spark hands them over
                        pdf[c] = pdf[c].dt.tz_localize(None)
                out = pdf.assign(**{answer: scorer(pdf)})[answer]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.Array.from_pandas(out, mask=out.isnull(), type=pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def score_missing(requests: DataFrame, cache: DataFrame, key: str, inputs: list[str], make_scorer, answer: str = "answer") -> DataFrame:
    """(key, answer) of the requests the cache does not hold; equal requests are scored once.

    Append the result to the cache, then join: see ``with_cache``."""
    todo = requests.join(cache.select(key), key, "left_anti").groupBy(key).agg(*[F.first(c).alias(c) for c in inputs])
    return score(todo, make_scorer, answer).select(key, answer)


def with_cache(requests: DataFrame, cache: DataFrame, fresh: DataFrame, key: str, answer: str = "answer") -> DataFrame:
    """Requests with their answer and whether it came from the cache."""
    both = cache.select(key, answer, F.lit(True).alias("cached")).unionByName(fresh.select(key, answer, F.lit(False).alias("cached")))
    return requests.join(both, key, "left")
