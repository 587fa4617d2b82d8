"""Toxic passages by maximum-scoring segments.

Words get a weight, the log-odds of toxic against clean labelled text with a symmetric Dirichlet prior; only
words in significantly more toxic texts than their share (signed root of the likelihood ratio) keep it, every
other word has the small negative weight of "none of those". A linear pass (Ruzzo and Tompa) finds all maximal segments of a text.
As weights are log-likelihood ratios, the best segment of m clean words follows an extreme-value law with scale
1: E = K m exp(-S). The significant segments of a text are combined by the law of the sum of the r best
(Karlin and Altschul), and that evidence becomes a probability by a two-parameter logistic fit on labelled
rows that had no part in the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import in_fold, key_id, whole, written
from plumbline.llm.words import MARKS, Words, blocks, int64, text_bytes

#: Bound of the labelled rows a model is fit on (a hash picks them if there are more).
MAX_LABELLED = 200_000
#: Bound of the words with a weight of their own: the most significant ones.
MAX_LEXICON = 1 << 14
#: Dirichlet prior: this many uses of every word in either class.
PRIOR = 0.5
MIN_DEVIATIONS = 4.0
MIN_TEXTS = 3
KARLIN_K = 0.1
SIGNIFICANT = 0.05
LEARN_FOLDS, HELD_OUT, CALIBRATE = 5, 0, 4


@dataclass
class Model:
    keys: np.ndarray  # sorted word hashes
    weights: np.ndarray
    other: float  # weight of all other words
    slope: float = 1.0
    shift: float = -3.0


def _marked(model: Model, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words of the lexicon and their weights."""
    if len(model.keys) == 0 or len(h) == 0:
        return np.empty(0, np.int64), np.empty(0)
    seen = np.zeros(1 << 20, bool)
    seen[model.keys >> np.uint64(44)] = True
    at = np.flatnonzero(seen[h >> np.uint64(44)])
    i = np.minimum(np.searchsorted(model.keys, h[at]), len(model.keys) - 1)
    ok = model.keys[i] == h[at]
    return at[ok], model.weights[i[ok]]


def segments(at: list[int], weights: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (first word, last word, score): one pass over the weighted words, where
    each gap of g other words costs g times ``other``. Open segments are kept with the running totals at their
    two ends; a segment is joined to the nearest earlier one that began lower, if it also ended lower. Each open
    segment knows where that one is, so a search steps from one to the next lower and all searches together are
    linear."""
    stack: list[list] = []  # [total before, total after, first, last, place of the nearest earlier one that began lower]
    total, previous = 0.0, -1
    for p, w in zip(at, weights):
        total += other * (p - previous - 1)
        seg, j = [total, total + w, p, p, -1], len(stack) - 1
        total, previous = total + w, p
        while j >= 0 and stack[j][0] >= seg[0]:
            j = stack[j][4]
        while j >= 0 and stack[j][1] < seg[1]:
            seg = [stack[j][0], seg[1], stack[j][2], seg[3], -1]
            below = stack[j][4]
            del stack[j:]
            j = below
        seg[4] = j
        stack.append(seg)
    return [(s[2], s[3], s[1] - s[0]) for s in stack]


def evidence(scores: list[float], m: int) -> tuple[float, int]:
    """-ln of the chance that m clean words hold segments like the r best, for the r that makes it least; and how
    many segments are significant alone."""
    if not scores:
        return 0.0, 0
    norm = sorted((s - math.log(KARLIN_K * max(m, 1)) for s in scores), reverse=True)
    best = -math.log(-math.expm1(-math.exp(-min(max(norm[0], -3.0), 600.0)))) if norm[0] < 30 else norm[0]
    total, many = norm[0], sum(x > -math.log(SIGNIFICANT) for x in norm)
    for r in range(2, many + 1):
        total += norm[r - 1]
        best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
    return best, many


def _evidence_of(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: evidence, number of significant passages, first and last byte of the best passage (-1: none)."""
    w = Words(column, MARKS, lower=True)
    n = len(column)
    x, many = np.zeros(n), np.zeros(n, np.int64)
    lo, hi = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    at, weight = _marked(model, w.hash)
    doc = w.doc[at]
    edges = np.flatnonzero(np.diff(doc, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(doc)]):
        d = doc[a]
        first = w.first[d]
        segs = segments((at[a:b] - first).tolist(), weight[a:b].tolist(), model.other)
        x[d], many[d] = evidence([s[2] for s in segs], int(w.first[d + 1] - first))
        best = max(segs, key=lambda s: s[2])
        lo[d], hi[d] = first + best[0], first + best[1]
    begin = text_bytes(column)[1][:-1]
    some = lo >= 0
    lo[some], hi[some] = w.start[lo[some]] - begin[some], w.end[hi[some]] - begin[some]
    return x, many, lo, hi


def _probability(model: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * x + model.shift, -500, 500)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch, 0):
            w = Words(b.column(0), MARKS, lower=True)
            label = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            key, group = np.unique(w.hash, return_inverse=True)
            k = len(key)
            pair = np.unique(w.doc * max(k, 1) + group)  # each word of a text once
            once, of = pair % max(k, 1), label[pair // max(k, 1)]
            cols = [np.bincount(x, minlength=k) for x in (group[label[w.doc]], group[~label[w.doc]], once[of], once[~of])]
            yield pa.record_batch([pa.array(int64(key)), *map(pa.array, cols)], names=["word", "n1", "n0", "t1", "t0"])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps with a weak pull towards slope 1."""
    slope, shift = 1.0, -3.0
    if len(x) == 0:
        return slope, shift
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -500, 500)))
        v = p * (1 - p)
        g = np.array([((p - y) * x).sum() + 0.1 * (slope - 1), (p - y).sum() + 0.01 * (shift + 3)])
        h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(slope, 1e-3)), float(shift)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from labelled rows outside the held-out fold, at most about ``max_labelled`` of them; of copies of
    one text, one. Rows without a label are not used; an id with several labels is toxic if one of them says so."""
    rows = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~in_fold(doc_id, LEARN_FOLDS, HELD_OUT))
    rows = rows.groupBy(key_id(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    share = min(1.0, max_labelled / max(rows.count(), 1))
    rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    src = docs.select(key_id(doc_id).alias("id"), whole(text).alias("text"))
    # Bounded by max_labelled: ids and labels only.
    found = src.join(F.broadcast(rows), "id").groupBy(F.xxhash64("text").alias("h")).agg(F.min("id").alias("id"), F.max("y").alias("y")).drop("h")
    chosen = written(found, "labelled")
    learn = src.join(F.broadcast(chosen.where(~in_fold("id", LEARN_FOLDS, CALIBRATE))), "id").select("text", "y")
    tune = src.join(F.broadcast(chosen.where(in_fold("id", LEARN_FOLDS, CALIBRATE))), "id").select("text", "y")

    counts = written(learn.mapInArrow(_counts, "word long, n1 long, n0 long, t1 long, t0 long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n1", "n0", "t1", "t0")]), "toxic-words")
    n1, n0, v = (x or 0 for x in counts.agg(F.sum("n1"), F.sum("n0"), F.count(F.lit(1))).first())
    d1, d0 = (x or 0 for x in chosen.where(~in_fold("id", LEARN_FOLDS, CALIBRATE)).agg(F.sum("y"), F.sum(1 - F.col("y"))).first())
    model = Model(np.empty(0, np.uint64), np.empty(0), -0.01)
    if n1 and n0:
        odds = F.log((F.col("n1") + PRIOR) / (n1 + PRIOR * v)) - F.log((F.col("n0") + PRIOR) / (n0 + PRIOR * v))
        e1 = (F.col("t1") + F.col("t0")) * (d1 / (d1 + d0))
        part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
        ratio = 2 * (part(F.col("t1"), e1) + part(F.col("t0"), F.col("t1") + F.col("t0") - e1))
        top = counts.where((F.col("t1") + F.col("t0") >= MIN_TEXTS) & (F.col("t1") > e1) & (odds > 0) & (ratio >= MIN_DEVIATIONS**2))
        top = top.select("word", "n1", "n0", odds.alias("odds"), ratio.alias("ratio")).orderBy(F.desc("ratio"), "word").limit(MAX_LEXICON).toPandas()
        keys = top["word"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        p1, p0 = (top["n1"].sum() + PRIOR) / (n1 + PRIOR * v), (top["n0"].sum() + PRIOR) / (n0 + PRIOR * v)
        model = Model(keys[order], top["odds"].to_numpy(np.float64)[order], min(-1e-4, math.log((1 - p1) / (1 - p0))))

    def evidence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, 0):
                yield pa.record_batch([pa.array(_evidence_of(model, b.column(0))[0]), b.column(1).cast(pa.int64())], names=["x", "y"])

    seen = tune.mapInArrow(evidence_rows, "x double, y long").toPandas()  # two numbers for each of a bounded sample
    model.slope, model.shift = _logistic(seen["x"].to_numpy(float), seen["y"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1), ``predicted``, ``passages`` (number of significant ones) and
    the byte range ``passage_start`` to ``passage_end`` of the best one (missing if no word has a weight).

    Missing and empty texts get the score of no evidence. Columns of ``docs`` with these names are replaced.
    Equal rows get equal scores; an empty table gives an empty result."""
    added = {"score": T.DoubleType(), "predicted": T.IntegerType(), "passages": T.LongType(), "passage_start": T.LongType(), "passage_end": T.LongType()}
    keep = [c for c in docs.columns if c not in added]
    src = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*src.schema.fields, *[T.StructField(k, v) for k, v in added.items()]])
    place = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, place):
                x, many, lo, hi = _evidence_of(model, b.column(place))
                p = _probability(model, x)
                none = lo < 0
                extra = [pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(many), pa.array(lo, mask=none), pa.array(hi, mask=none)]
                yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, *added])

    return src.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns only; cases as in ``score``."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, place):
                yield b.filter(pa.array(_probability(model, _evidence_of(model, b.column(place))[0]) < 0.5))

    return docs.mapInArrow(run, docs.schema)
