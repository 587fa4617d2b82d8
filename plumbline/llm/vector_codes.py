"""Compression of vectors to codes: each part of a vector becomes the number of its nearest codebook entry.

All arithmetic is on integers and exact. Dot products of integers go through float64 matrix products: the integers
are cut into limbs so short that no sum of products reaches 2^53, and the products of limbs are put together as
64-bit integers. Each round is one pass over the vectors; a task sends on one row per codebook entry it used, so
what is shuffled depends on the number of tasks and entries alone, and the codebook (parts x entries rows) is the
only thing the driver sees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.session import broadcast_if_small

PARTS = 4
#: Entries of one part's codebook; a code is one byte.
ENTRIES = 256
ROUNDS = 4
#: A component x counts as floor(SCALE * x).
SCALE = 1024
#: Vectors handled at once.
ROWS = 4096


def limbs(a: np.ndarray, width: int) -> list[np.ndarray]:
    """Integers as float64 limbs: a = sum of limb i times 2^(width i). All but the last are in [0, 2^width); the
    last one has the sign and is in [-2^width, 2^width)."""
    out, rest = [], a
    while rest.size and (rest.max() >= 1 << width or rest.min() < -(1 << width)):
        out.append((rest & ((1 << width) - 1)).astype(np.float64))
        rest = rest >> width
    return [*out, rest.astype(np.float64)]


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, exact where the result fits 64 bits. A product of two limbs is at most
    2^(2 width), and as many are added as there are columns; ``width`` keeps that sum within 2^53."""
    width = (53 - a.shape[1].bit_length()) // 2
    total = np.zeros((a.shape[0], b.shape[0]), np.int64)
    right = limbs(b, width)
    for i, x in enumerate(limbs(a, width)):
        for j, y in enumerate(right):
            if width * (i + j) < 64:
                total += (x @ y.T).astype(np.int64) << (width * (i + j))
    return total


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the first of the nearest entries, and the squared distance to it."""
    less = (entries * entries).sum(1) - 2 * exact_dot(x, entries)
    at = less.argmin(1)
    return at, (x * x).sum(1) + less[np.arange(len(x)), at]


def bounds(size: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive parts of a vector; equal ones where ``parts`` divides its size."""
    return [(size * i // parts, size * (i + 1) // parts) for i in range(parts)]


def _matrix(column: pa.Array, scale: int) -> np.ndarray:
    """Integer components of vectors of one size, none of them missing."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(column), -1 if len(flat) else 0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def usable(vector: str = "embedding") -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


class Codebooks:
    """``books``: for each part a matrix of entries. ``size``: components of the vectors they were made from."""

    def __init__(self, books: list[np.ndarray], size: int, scale: int = SCALE):
        self.books, self.size, self.scale = books, size, scale

    def numbers(self) -> str:
        """All components by part, entry and position, separated by commas."""
        return ",".join(str(v) for book in self.books for v in book.ravel().tolist())


def _sums(vectors: DataFrame, model: Codebooks) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """How many parts each entry is nearest to, and their sum by component."""
    books, scale = model.books, model.scale
    parts = bounds(model.size, len(books))
    most = max(b - a for a, b in parts)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(b), np.int64) for b in books]
        s = [np.zeros((len(b), most), np.int64) for b in books]
        for block in _blocks(batches):
            x = _matrix(block.column(0), scale)
            for p, (lo, hi) in enumerate(parts):
                at, _ = nearest(x[:, lo:hi], books[p])
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                n[p][used] += np.diff(np.append(first, len(at)))
                if hi > lo:
                    s[p][used, : hi - lo] += np.add.reduceat(x[order, lo:hi], first, axis=0)
        for p, count in enumerate(n):
            at = np.flatnonzero(count)
            yield pa.record_batch([pa.array(np.full(len(at), p), pa.int32()), pa.array(at, pa.int32()), pa.array(count[at]), *(pa.array(s[p][at, k].copy()) for k in range(most))],
                                  names=["part", "entry", "n", *(f"s{k}" for k in range(most))])

    columns = ["n", *(f"s{k}" for k in range(most))]
    found = vectors.mapInArrow(gather, "part int, entry int, " + ", ".join(f"{c} long" for c in columns)).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in columns])
    return {(r[0], r[1]): (r[2], np.array(r[3:], np.int64)) for r in found.collect()}  # parts x entries rows at most


def _of_size(vectors: DataFrame, vector: str, size: int) -> DataFrame:
    return vectors.where(usable(vector) & (F.size(vector) == size))


def fit(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all usable vectors, or None if there are none. They begin as the parts of
    the vectors with the ``entries`` smallest ids. Rows with one id follow each other in the order of their vectors, and
    rows without an id come last. The vectors' size is the most common one, of equally common ones the largest."""
    good = vectors.where(usable(vector))
    sizes = good.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n"), F.max(F.greatest(F.array_max(vector), -F.array_min(vector))).cast("double").alias("most"))
    top = sizes.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not top:
        return None
    size, most = top[0]["size"], top[0]["most"] or 0.0
    if 4 * math.ceil(most * scale + 1) ** 2 * max(size, 1) >= 1 << 62:
        raise ValueError(f"squared distances of components as large as {most} don't fit 64 bits")
    seeds = _of_size(vectors, vector, size).select(vec_id, vector).orderBy(F.col(vec_id).asc_nulls_last(), vector).limit(entries).collect()
    first = np.floor(np.array([r[1] for r in seeds], np.float64).reshape(len(seeds), size) * scale).astype(np.int64)
    model = Codebooks([first[:, a:b] for a, b in bounds(size, parts)], size, scale)
    for _ in range(rounds):
        books = [b.copy() for b in model.books]
        for (p, e), (n, s) in _sums(_of_size(vectors, vector, size).select(vector), model).items():
            books[p][e] = s[: books[p].shape[1]] // n
        model = Codebooks(books, size, scale)
    return model


def encode(vectors: DataFrame, model: Codebooks | None, carry: list[str], vector: str = "embedding") -> DataFrame:
    """The columns ``carry``, ``code`` (two hex digits a part) and ``error`` (squared distances summed over parts) of
    all usable vectors. A vector of another size than the codebooks' has neither: both are null."""
    kept = vectors.where(usable(vector)).select(*[F.col(f"`{c}`") for c in carry], F.col(vector).alias("__vector"))
    empty = kept.select(*carry, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if model is None:
        return empty
    books, scale, size = model.books, model.scale, model.size
    parts = bounds(size, len(books))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            column = block.column(block.num_columns - 1)
            fits = np.array([n == size for n in column.value_lengths().to_pylist()], bool)
            x = _matrix(column.filter(pa.array(fits)), scale)
            codes, errors = np.empty((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for p, (lo, hi) in enumerate(parts):
                codes[:, p], e = nearest(x[:, lo:hi], books[p])
                errors += e
            digits, step = codes.tobytes().hex(), 2 * len(books)
            at = np.cumsum(fits) - 1
            text = [digits[i * step : (i + 1) * step] if ok else None for i, ok in zip(at.tolist(), fits.tolist())]
            yield pa.record_batch([*block.columns[:-1], pa.array(text, pa.string()), pa.array(errors[at] if len(errors) else np.zeros(len(at), np.int64), mask=~fits)], names=[*carry, "code", "error"])

    return kept.mapInArrow(coded, empty.schema)


def compress(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", **fitted: int) -> DataFrame:
    """One row per usable vector: ``vec_id``, ``code``, ``error``, ``label_error`` (error summed over equal labels,
    missing ones together) and ``codebooks_sha256``.

    Rows whose vector is missing or holds a missing or non-finite component are left out. Repeated rows are rows
    like others; equally near entries give the smaller number. An empty table gives an empty result; other columns
    are left out, whatever their names."""
    src = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    model = fit(src, "vector", "vec_id", **fitted)
    rows = written(encode(src, model, ["vec_id", "label"], "vector"), "vector-codes")
    totals = written(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    totals = broadcast_if_small(totals.withColumnRenamed("label", "of"))
    digest = F.sha2(F.lit(model.numbers() if model else ""), 256)
    return rows.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in SQL, for tables whose vectors have one size."""
    near = lambda i: f"""a{i} AS MATERIALIZED (SELECT id, p, min(d) AS d, min(d * 65536 + e) % 65536 AS e FROM (
        SELECT x.id, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{i} b USING (p)) GROUP BY 1, 2)"""  # noqa: E731
    step = lambda i: f"""s{i} AS MATERIALIZED (SELECT p, e, list(m ORDER BY k) AS v FROM (
        SELECT p, e, k, floor(sum(c) / count(*))::BIGINT AS m FROM (SELECT a.p, a.e, unnest(x.v) AS c, generate_subscripts(x.v, 1) AS k FROM a{i - 1} a JOIN x USING (id, p)) GROUP BY 1, 2, 3) GROUP BY 1, 2),
        b{i} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.v, b.v) AS v FROM b{i - 1} b LEFT JOIN s{i} s USING (p, e))"""  # noqa: E731
    chain = ",\n".join([near(0), *(f"{step(i)},\n{near(i)}" for i in range(1, rounds + 1))])
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT id, p, v[(p * len(v)) // {parts} + 1 : ((p + 1) * len(v)) // {parts}] AS v FROM v, range({parts}) r(p)),
b0 AS MATERIALIZED (SELECT p, id - 1 AS e, v FROM x WHERE id <= {entries}),
{chain},
c AS (SELECT id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (id), h"""
