"""AUROC, clustered bootstrap intervals, agreement and exact tests as jobs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import AT_ONCE, numbered_picks, seeded_hex
from plumbline.functions.text import let
from plumbline.operators import resampling
from plumbline.operators.ranks import _join, hash_rank, running_totals
from plumbline.operators.resampling import poisson_thresholds
from plumbline.session import BROADCAST_LIMIT_BYTES, cut_lineage

# Fixed value: number of resamples.
RESAMPLES = 2000


def score_counts(df: DataFrame, groups: list[str], label: Column, score: Column, weight: Column | None = None) -> DataFrame:
    """(groups, score, pos, neg): ties collapsed before anything is ordered."""
    w = F.lit(1) if weight is None else weight
    return (df.select(*groups, score.cast("double").alias("score"), label.cast("boolean").alias("_y"), w.alias("_w"))
            .groupBy(*groups, "score").agg(F.sum(F.when(F.col("_y"), F.col("_w")).otherwise(0)).alias("pos"),
                                           F.sum(F.when(F.col("_y"), 0).otherwise(F.col("_w"))).alias("neg")))


def auroc_of_counts(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Mid-rank AUROC from (groups, score, pos, neg); null when a class is empty.

    Each positive beats the negatives below its score and half of the tied ones."""
    cum = running_totals(counts, groups, "score", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2))
    out = cum.groupBy(*groups).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("_u"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return out.withColumn("auroc", F.when(both, F.col("_u") / (F.col("n_pos") * F.col("n_neg")))).drop("_u")


def auroc(df: DataFrame, groups: list[str], label: Column, score: Column) -> DataFrame:
    """One row per group: n_pos, n_neg, auroc."""
    return auroc_of_counts(score_counts(df, groups, label, score), groups)


# ---- resampling -----------------------------------------------------------------------------


def with_poisson_weight(df: DataFrame, seed, draw: str, cluster: str, name: str = "_w") -> DataFrame:
    """How often a cluster enters one resample: Poisson(1) from a hash; rows of weight 0 drop.

    Independent of the number of clusters, so the draw needs no numbering, no join and no
    shuffle of clusters x draws; given its total it is the multinomial resample. The hash is
    a column of its own, computed once per row, and is compared as fixed-width hex text."""
    cuts = [f"{t:08x}" for t in poisson_thresholds() if t < 2**32]
    hashed = df.withColumn("_u", F.substring(seeded_hex(seed, F.col(draw), F.col(cluster)), 1, 8)).filter(F.col("_u") >= cuts[0])
    weight = F.lit(1)
    for t in cuts[1:]:
        weight = weight + F.when(F.col("_u") >= t, 1).otherwise(0)
    return hashed.withColumn(name, weight).drop("_u")


def draws(df: DataFrame, n_resamples: int, name: str = "draw") -> DataFrame:
    """Every row once per resample. The pre-aggregated rows are few and the work per row is
    not, so they are first dealt out to all cores (a small shuffle adaptive execution keeps)."""
    df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n_resamples))))


def interval(values: DataFrame, groups: list[str], value: str = "stat", alpha: float = 0.05) -> DataFrame:
    """Percentile interval over the draws of each group; undefined draws are left out. The
    exact percentile buffer holds at most one value per draw."""
    good = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))
    out = values.groupBy(*groups).agg(F.percentile(good, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("_ci"), F.count(good).alias("n_draws"))
    return out.select(*groups, F.col("_ci")[0].alias("lo"), F.col("_ci")[1].alias("hi"), "n_draws")


def resample_fixed(per_cluster: DataFrame, cluster: str, seed, n_resamples: int) -> DataFrame:
    """Resamples of exactly as many clusters as there are: (draw, the cluster's columns, times).

    Draw k of resample b takes cluster number ``hash(b:k) % n``; a pick is a row with ``times`` 1, so a cluster taken
    twice has two. Costs n x draws hashes, made in blocks by tasks; picks meet the clusters by a broadcast while those
    are few by their count, by one shuffle otherwise, and are never grouped. ``resampling.bootstrap`` is for anything
    larger."""
    numbered = cut_lineage(hash_rank(per_cluster, seed, [cluster], name="_no"))
    n = numbered.count()
    spark = per_cluster.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, draw = np.divmod(batch.column(0).to_numpy(), n_resamples)
            for at in np.unique(block).tolist():
                mine = draw[block == at] + 1
                found = numbered_picks([f"{seed}:{d}:" for d in mine], np.arange(at * AT_ONCE + 1, min((at + 1) * AT_ONCE, n) + 1))
                for i, (_, pick) in enumerate(found):
                    no = (pick % np.uint64(n)).astype(np.int64) + 1
                    yield pa.record_batch([pa.array(np.full(len(no), mine[i % len(mine)], np.int32)), pa.array(no)], names=["draw", "_no"])

    # a row per block of clusters and draw
    picks = spark.range(0, -(-n // AT_ONCE) * n_resamples, 1, tasks).mapInArrow(work, "draw int, _no long").withColumn("times", F.lit(1))
    few = n * (32 + numbered._jdf.schema().defaultSize()) <= BROADCAST_LIMIT_BYTES
    return picks.join(F.broadcast(numbered) if few else numbered.hint("shuffle_hash"), "_no").drop("_no")


def clustered_bootstrap(df: DataFrame, cluster: str, parts: dict[str, Column], statistic: Callable[[DataFrame, list[str]], DataFrame],
                        seed="0", n_resamples: int = RESAMPLES, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of a user statistic, resampling whole clusters.

    ``parts`` are per-cluster aggregates; ``statistic(rows, keys)`` maps weighted rows
    (columns of ``parts`` plus ``times``) to one ``stat`` per key, and is used both for the
    resamples and, with ``times`` 1, for the point estimate."""
    per = df.groupBy(cluster).agg(*[v.alias(k) for k, v in parts.items()])
    point = statistic(per.withColumn("times", F.lit(1)).withColumn("draw", F.lit(0)), ["draw"]).select(F.col("stat").alias("point"))
    stats = statistic(resample_fixed(per, cluster, seed, n_resamples), ["draw"])
    return point.join(F.broadcast(interval(stats, [], "stat", alpha)))


def ratio_statistic(num: str, den: str):
    def stat(rows: DataFrame, keys: list[str]) -> DataFrame:
        g = rows.groupBy(*keys).agg(F.sum(F.col(num) * F.col("times")).alias("_a"), F.sum(F.col(den) * F.col("times")).alias("_b"))
        return g.select(*keys, F.when(F.col("_b") > 0, F.col("_a") / F.col("_b")).alias("stat"))

    return stat


def mean_ci(df: DataFrame, groups: list[str], value: Column, cluster: str, seed="0", n_resamples: int = RESAMPLES, alpha: float = 0.05) -> DataFrame:
    """(groups, point, lo, hi, n): mean of a value with a cluster-resampled interval."""
    out = resampling.means(df, groups, cluster, {"mean": value}, seed=seed, n_resamples=n_resamples, alpha=alpha)
    return out.where("n > 0").select(*groups, "point", "lo", "hi", "n")


def rate_ci(df: DataFrame, groups: list[str], success: Column, cluster: str, **kw) -> DataFrame:
    return mean_ci(df, groups, success.cast("boolean").cast("int"), cluster, **kw)


def paired_difference_ci(df: DataFrame, groups: list[str], a: Column, b: Column, cluster: str, **kw) -> DataFrame:
    return mean_ci(df, groups, a.cast("double") - b.cast("double"), cluster, **kw)


def auroc_ci(df: DataFrame, groups: list[str], label: Column, score: Column, cluster: str, seed="0", n_resamples: int = RESAMPLES, alpha: float = 0.05) -> DataFrame:
    """(groups, n_pos, n_neg, auroc, lo, hi): rows collapse to (cluster, score, pos, neg) first;
    every draw re-weights those counts; a cluster's draws are hashed once, in whatever groups and scores it is."""
    per = score_counts(df, [*groups, cluster], label, score)
    point = auroc_of_counts(per.groupBy(*groups, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), groups)
    stats = resampling.auroc_draws(per, groups, cluster, seed, n_resamples)
    return _join(point, interval(stats, groups, "auroc", alpha), groups).drop("n_draws")


# ---- agreement ------------------------------------------------------------------------------


def cohens_kappa(df: DataFrame, groups: list[str], a: Column, b: Column) -> DataFrame:
    """(groups, n, kappa) of two raters; null when chance agreement is 1."""
    cells = df.select(*groups, a.cast("string").alias("_a"), b.cast("string").alias("_b")).dropna(subset=["_a", "_b"]).groupBy(*groups, "_a", "_b").agg(F.count("*").alias("_c"))
    total = cells.groupBy(*groups).agg(F.sum("_c").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_c")).otherwise(0)).alias("_same"))
    ma = cells.groupBy(*groups, F.col("_a").alias("_x")).agg(F.sum("_c").alias("_na"))
    mb = cells.groupBy(*groups, F.col("_b").alias("_x")).agg(F.sum("_c").alias("_nb"))
    chance = ma.join(mb, [*groups, "_x"]).groupBy(*groups).agg(F.sum(F.col("_na") * F.col("_nb")).alias("_e"))
    j = total.join(chance, groups, "left") if groups else total.join(F.broadcast(chance))
    obs, exp = F.col("_same") / F.col("n"), F.coalesce(F.col("_e"), F.lit(0)) / (F.col("n") * F.col("n"))
    return j.select(*groups, "n", F.when(exp != 1.0, (obs - exp) / (1.0 - exp)).alias("kappa"))


def first_label(df: DataFrame, item: str, rater: str, label: str, order: list[str]) -> DataFrame:
    """One label per (item, rater): the first one (map-side ``min_by``)."""
    return df.groupBy(item, rater).agg(F.min_by(label, F.struct(*order)).alias(label))


def fleiss_kappa(df: DataFrame, groups: list[str], item: str, rater: str, label: str, categories: list[str] | None = None) -> DataFrame:
    """(groups, n_items, kappa): items not rated by every rater are left out."""
    d = df.filter(F.col(label).isin(*categories)) if categories else df
    raters = df.select(rater).distinct().agg(F.count("*").alias("_r"))
    cells = d.groupBy(*groups, item, label).agg(F.count("*").alias("_c"))
    items = cells.groupBy(*groups, item).agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.col("_c")).alias("_q"))
    full = items.join(F.broadcast(raters)).filter("_n = _r AND _n >= 2")
    per = full.groupBy(*groups).agg(F.count("*").alias("n_items"), F.avg((F.col("_q") - F.col("_n")) / (F.col("_n") * (F.col("_n") - 1))).alias("_p"), F.first("_r").alias("_r"))
    marg = cells.join(full.select(*groups, item), [*groups, item], "left_semi").groupBy(*groups, label).agg(F.sum("_c").alias("_c"))
    share = _join(marg, per.select(*groups, "n_items", "_r"), groups).groupBy(*groups).agg(
        F.sum(F.pow(F.col("_c") / (F.col("n_items") * F.col("_r")), F.lit(2.0))).alias("_e"))
    j = _join(per, share, groups)
    return j.select(*groups, "n_items", F.when(F.col("_e") != 1.0, (F.col("_p") - F.col("_e")) / (1.0 - F.col("_e"))).alias("kappa"))


def majority(df: DataFrame, item: str, label: str, allowed: list[str] | None = None) -> DataFrame:
    """(item, majority): the label with a strict majority of the usable ones, else null."""
    usable = F.col(label).isin(*allowed) if allowed else F.col(label).isNotNull()
    counts = df.groupBy(item, label).agg(F.count(F.when(usable, 1)).alias("_c"))
    best = counts.groupBy(item).agg(F.sum("_c").alias("_n"), F.max_by(label, "_c").alias("_l"), F.max("_c").alias("_m"))
    return best.select(item, F.when(F.col("_m") * 2 > F.col("_n"), F.col("_l")).alias("majority"))


def agreement_report(labels: DataFrame, item: str, rater: str, label: str, order: list[str], categories: list[str], clean: str, skip: str,
                     verifier: DataFrame, strata: DataFrame, random_stratum: str) -> DataFrame:
    """Long report (statistic, value, n): kappas three-way, binarised, per stratum, human
    majority against the verifier on the random stratum, skipped and no-majority counts."""
    wide = first_label(labels, item, rater, label, order)
    binary = wide.withColumn(label, F.when(F.col(label) == clean, "clean").when(F.col(label).isin(*categories), "not_clean").otherwise(F.col(label)))
    major = majority(wide, item, label, categories)
    by = fleiss_kappa(wide.join(strata, item), ["stratum"], item, rater, label, categories)
    human = (major.filter("majority IS NOT NULL").join(verifier, item).join(strata.filter(F.col("stratum") == random_stratum), item)
             .filter("verifier IS NOT NULL"))
    cohen = cohens_kappa(human, [], F.col("majority") == clean, F.col("verifier"))

    def row(d, name, value, n):
        return d.select(name.alias("statistic"), value.cast("double").alias("value"), n.cast("bigint").alias("n"))

    out = row(fleiss_kappa(wide, [], item, rater, label, categories), F.lit("fleiss_all"), F.col("kappa"), F.col("n_items"))
    out = out.unionByName(row(fleiss_kappa(binary, [], item, rater, label, ["clean", "not_clean"]), F.lit("fleiss_binary"), F.col("kappa"), F.col("n_items")))
    out = out.unionByName(row(by, F.concat(F.lit("fleiss_"), "stratum"), F.col("kappa"), F.col("n_items")))
    out = out.unionByName(row(cohen, F.lit("cohen_human_vs_verifier"), F.col("kappa"), F.col("n")))
    out = out.unionByName(row(labels.agg(F.count(F.when(F.col(label) == skip, 1)).alias("c")), F.lit("skipped"), F.col("c"), F.col("c")))
    return out.unionByName(row(major.agg(F.count(F.when(F.col("majority").isNull(), 1)).alias("c")), F.lit("no_majority"), F.col("c"), F.col("c")))


# ---- tests ----------------------------------------------------------------------------------

# The series of ln(n!) less Stirling's formula.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def _stirling_rest(n: Column) -> Column:
    """ln(n!) less Stirling's formula: a table below 16, where the series is too coarse."""
    table = F.array(*[F.lit(math.lgamma(i + 1) - ((i + 0.5) * math.log(i) - i + 0.5 * math.log(2 * math.pi)) if i else 0.0) for i in range(16)])
    x = n.cast("double")
    series = sum((F.lit(c) / F.pow(x, F.lit(2.0 * i + 1)) for i, c in enumerate(_STIRLING)), F.lit(0.0))
    return F.when(n < 16, F.get(table, F.least(n, F.lit(15)).cast("int"))).otherwise(series)


def _deviance(k: Column, mean: Column) -> Column:
    """k ln(k / mean) - (k - mean), without cancellation near the mean."""
    v = (k - mean) / (k + mean)
    d = k - mean
    series = F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.struct((d * v).alias("s"), (2 * k * v).alias("e")),
                         lambda a, j: F.struct((a["s"] + a["e"] * v * v / (2 * j + 1)).alias("s"), (a["e"] * v * v).alias("e")))["s"]
    return F.when(k == 0, mean).when(F.abs(d) < 0.1 * (k + mean), series).otherwise(k * F.log(k / mean) - d)


def binomial_half_pmf(k: Column, n: Column) -> Column:
    """Chance of k heads in n fair tosses, by deviances from the mean: as exact for a million as for ten."""
    m, half = (n - k).cast("double"), n.cast("double") / 2
    rest = _stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - _deviance(k.cast("double"), half) - _deviance(m, half)
    inner = F.exp(rest) * F.sqrt(n / (F.lit(2 * math.pi) * k * m))
    return F.when((k == 0) | (k == n), F.exp(-n * math.log(2.0))).otherwise(inner)


def mcnemar_exact(df: DataFrame, keys: list[str], b: str, c: str) -> DataFrame:
    """Adds ``p``: exact two-sided binomial p of b against c discordant pairs.

    The tail is the regularised incomplete beta function at one half: the chance of exactly min(b, c) times a
    continued fraction, folded in place. It is worked out from the inside for as many steps as it takes to settle,
    which grows with the root of b + c; a finite fraction ends by itself."""
    n, k = (F.col(b) + F.col(c)).cast("bigint"), F.least(b, c).cast("bigint")
    p, q = (n - k).cast("double"), (k + 1).cast("double")  # tail = I_1/2(p, q)
    tiny = 1e-300

    def nonzero(x):
        return F.when(F.abs(x) < tiny, tiny).otherwise(x)

    def fraction(s, coefficient):
        d, e = nonzero(1 + coefficient * s["d"]), nonzero(1 + coefficient / s["e"])
        return F.struct((1 / d).alias("d"), e.alias("e"), (s["h"] * e / d).alias("h"))

    def step(s, j):
        j = j.cast("double")
        even = j * (q - j) / 2 / ((p + 2 * j - 1) * (p + 2 * j))
        odd = -(p + j) * (p + q + j) / 2 / ((p + 2 * j) * (p + 2 * j + 1))
        return let(fraction(s, even), lambda t: fraction(t, odd))

    first = 1 / nonzero(1 - (p + q) / 2 / (p + 1))
    steps = F.sequence(F.lit(1).cast("bigint"), F.ceil(F.sqrt(n) * 3) + 40)
    beta = F.aggregate(steps, F.struct(first.alias("d"), F.lit(1.0).alias("e"), first.alias("h")), step)["h"]
    # x^p (1 - x)^q / (p B(p, q)) at one half is half the chance of exactly k; two tails make it whole
    value = F.when(2 * k >= n, 1.0).otherwise(F.least(F.lit(1.0), binomial_half_pmf(k, F.greatest(n, F.lit(1))) * beta))
    return df.select(*keys, b, c, value.alias("p"))


def discordant_counts(a: DataFrame, b: DataFrame, key: list[str], groups: list[Column], correct: str = "correct") -> DataFrame:
    """Paired runs: n, both right, only a right (b), only b right (c), per group."""
    j = a.join(b.select(*key, F.col(correct).alias("_other")), key)
    x, y = F.col(correct).cast("boolean"), F.col("_other").cast("boolean")
    return j.groupBy(*groups).agg(F.count("*").alias("n"), F.count(F.when(x & y, 1)).alias("both"), F.count(F.when(x & ~y, 1)).alias("b"), F.count(F.when(~x & y, 1)).alias("c"))


def wald_interval(rate: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    half = F.lit(z) * F.sqrt(rate * (1 - rate) / n)
    return rate - half, rate + half


def log10_floor(p: Column) -> Column:
    """log10 of a tiny probability, floored at 1e-30."""
    return F.log10(F.greatest(p, F.lit(1e-30)))
