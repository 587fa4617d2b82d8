"""Quality by hierarchical empirical Bayes.

Document evidence is a logistic fit on how a text is written (letters, digits, symbols, case, repetition), learned
on a bounded sample of labelled rows. Where a document comes from is evidence too: each site has a rate of good
documents, estimated from the evidence of all its documents and shrunk towards the rate of all sites, and each
path of a site has one shrunk towards its site. A document found in several places has the evidence of each: of
every site against the prior, and of every path against its site. How strongly follows from how much sites and paths really differ
(moments of a beta-binomial), so sparse ones stay near the prior. A document's own evidence is left out of the
rates it is judged by. Rates are sums by group, combined before the shuffle; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import NO_ID, in_fold, key_id, whole, written
from plumbline.llm.words import MARKS, Words, blocks, text_bytes
from plumbline.session import broadcast_if_small

#: Bound of the labelled rows the evidence is fit on (a hash picks them if there are more).
MAX_LABELLED = 200_000
FOLDS, HELD_OUT = 5, 0
FEATURES = 10
_RIDGE = 1e-3


@dataclass
class Evidence:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: float
    prior: float  # share of good rows among those learned from


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` numbers per text."""
    data, at = text_bytes(column)
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    size = np.maximum(np.diff(at), 1)
    kinds = np.zeros(256, np.int64)
    kinds[48:58] = 1
    kinds[65:91] = 2
    kinds[97:123] = 3
    kinds[[*b"|{}<>[]\\_=~^"]] = 4
    kinds[[*b"%$&*#@!"]] = 5
    kinds[10] = 6
    by = np.bincount(doc * 7 + kinds[data], minlength=7 * n).reshape(n, 7)
    w = Words(column, MARKS, lower=True)
    words = np.diff(w.first)
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
    distinct = np.bincount(d[new], minlength=n)
    twice = np.zeros(n)
    if len(w.hash) > 1:
        same = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        twice = np.bincount(w.doc[1:][same], minlength=n)
    letters = by[:, 2] + by[:, 3]
    some = np.maximum(words, 1)
    return np.stack([np.sqrt(by[:, 1] / size), np.sqrt(by[:, 2] / np.maximum(letters, 1)), np.sqrt(by[:, 4] / size), np.sqrt(by[:, 5] / size), np.sqrt(by[:, 6] / size),
                     np.log1p(words), distinct / some, np.log1p(some) * (1 - distinct / some), np.sqrt(twice / some), np.minimum(size / some, 40) / 10], axis=1)


def _logit(p: np.ndarray | float):
    return np.log(p) - np.log1p(-p)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_labelled: int = MAX_LABELLED) -> Evidence:
    """Logistic fit on labelled rows outside the held-out fold, at most about ``max_labelled`` of them. Rows without
    a label are not used; an id with several labels is good if all say so."""
    rows = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~in_fold(doc_id, FOLDS, HELD_OUT))
    rows = rows.groupBy(key_id(doc_id).alias("id")).agg(F.min(F.col(label).cast("int")).alias("y"))
    share = min(1.0, max_labelled / max(rows.count(), 1))
    rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, 0):
                x = features(b.column(0)).astype(np.float32)
                yield pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32())), b.column(1).cast(pa.int32())], names=["x", "y"])

    found = docs.select(key_id(doc_id).alias("id"), whole(text).alias("text")).join(F.broadcast(rows), "id").select("text", "y")
    seen = found.mapInArrow(run, "x array<float>, y int").toPandas()  # a few numbers for each of a bounded sample
    if len(seen) == 0 or seen["y"].nunique() < 2:
        prior = float(np.clip(seen["y"].mean() if len(seen) else 0.5, 0.01, 0.99))
        return Evidence(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), _logit(prior), prior)
    x, y = np.stack(seen["x"].to_numpy()).astype(np.float64), seen["y"].to_numpy(float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    w = np.zeros(FEATURES + 1)
    w[-1] = _logit(prior)
    ridge = np.append(np.full(FEATURES, _RIDGE * len(y)), 1e-9)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (p - y) + ridge * np.append(w[:-1], 0))
        w -= step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return Evidence(mean, scale, w[:-1], float(w[-1]), prior)


def _shrinkage(groups: DataFrame, rate: str) -> float:
    """How many documents the prior of a group counts as: from the spread of the groups' rates around the prior
    ``rate`` in excess of what single documents explain."""
    r = groups.where(F.col("n") > 0).agg(F.sum((F.col("good") - F.col("n") * F.col(rate)) ** 2 / F.col("n") / (F.col(rate) * (1 - F.col(rate)))), F.count(F.lit(1)), F.sum("n")).first()
    spread, many, docs = (float(x or 0) for x in r)
    rho = (spread - many) / max(docs - many, 1.0)
    return 1e6 if rho <= 1e-6 else float(np.clip(1 / rho - 1, 1.0, 1e6))


def quality_scores(docs: DataFrame, places: DataFrame, evidence: Evidence, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``site``, ``path``, ``evidence`` (log-odds of the text alone),
    ``site_rate`` and ``path_rate`` (shrunk rates without the document itself), ``score`` (probability of being good)
    and ``kept`` (score of a half or more).

    ``places`` has ``doc_id``, ``site`` and ``path``; a document counts once in each of its places and sites, its rates
    combine those of all of them (log-odds against the prior, and against the site, are added), and ``site`` and
    ``path`` name the first in order. Documents without a place share one with a missing site. Missing and empty texts are judged like empty ones;
    repeated rows are rows of their own. An empty table gives an empty result; other columns are left out."""
    model = evidence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, 1):
                x = ((features(b.column(1)) - model.mean) / model.scale) @ model.weights + model.shift
                yield pa.record_batch([b.column(0), pa.array(np.clip(x, -30, 30))], names=["id", "evidence"])

    src = docs.select(key_id(doc_id).alias("id"), whole(text).alias("text")).mapInArrow(run, "id long, evidence double")
    of = places.select(key_id("doc_id").alias("id"), F.struct("site", "path").alias("at")).groupBy("id").agg(F.sort_array(F.collect_set("at")).alias("at"))
    rows = src.join(of, "id", "left").withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "evidence")
    # A row per place; of the paths of one site each has a share of what the site says.
    every = rows.select("row", "id", "evidence", "p", F.explode_outer("at").alias("a"), F.col("at").alias("all"))
    paths_here = F.greatest(F.size(F.filter("all", lambda x: x["site"].eqNullSafe(F.col("a.site")))), F.lit(1))
    every = every.select("row", "id", "evidence", "p", F.col("a.site").alias("site"), F.col("a.path").alias("path"), F.coalesce("a.site", F.lit("")).alias("s"), F.coalesce("a.path", F.lit("")).alias("t"), (1 / paths_here).alias("share"))

    total = rows.agg(F.avg("p")).first()[0]
    base = float(np.clip(total if total is not None else model.prior, 1e-3, 1 - 1e-3))
    paths = written(every.groupBy("s", "t").agg(F.sum("p").alias("good"), F.count(F.lit(1)).alias("n"), F.sum(F.col("p") * F.col("share")).alias("once"), F.sum("share").alias("n_once")), "paths")
    sites = written(paths.groupBy("s").agg(F.sum("once").alias("site_good"), F.sum("n_once").alias("site_n")), "sites")
    k = _shrinkage(sites.select(F.col("site_good").alias("good"), F.col("site_n").alias("n"), F.lit(base).alias("base")), "base")
    both = written(paths.drop("once", "n_once").join(sites, "s").withColumn("site_rate", (F.col("site_good") + k * base) / (F.col("site_n") + k)), "rates")
    k2 = _shrinkage(both, "site_rate")

    held = lambda rate: F.least(F.greatest(rate, F.lit(1e-3)), F.lit(1 - 1e-3))
    odds_of = lambda rate: F.log(rate / (1 - rate))
    r = every.join(broadcast_if_small(both.drop("site_rate")), ["s", "t"])
    r = r.withColumn("site_rate", held((F.col("site_good") - F.col("p") + k * base) / (F.greatest(F.col("site_n"), F.lit(1.0)) - 1 + k)))
    r = r.withColumn("path_rate", held((F.col("good") - F.col("p") + k2 * F.col("site_rate")) / (F.col("n") - 1 + k2)))
    prior = float(_logit(base))
    r = r.groupBy("row", "id", "evidence").agg(
        F.min(F.struct("site", "path")).alias("at"),
        F.sum((odds_of(F.col("site_rate")) - prior) * F.col("share")).alias("by_site"), F.sum(odds_of(F.col("path_rate")) - odds_of(F.col("site_rate"))).alias("by_path"))
    rate_of = lambda odds: 1 / (1 + F.exp(-odds))
    r = r.select("id", "evidence", "at.site", "at.path", rate_of(prior + F.col("by_site")).alias("site_rate"), rate_of(prior + F.col("by_site") + F.col("by_path")).alias("path_rate"), (F.col("evidence") + F.col("by_site") + F.col("by_path")).alias("odds"))
    odds = F.col("odds")
    r = r.withColumn("score", 1 / (1 + F.exp(-odds)))
    return r.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "site", "path", "evidence", "site_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("kept"))
