"""Global order, running totals and exact quantiles without a single-task window.

A window with no partition key, or one whose key holds a third of the rows, sorts all of it
in one task. The jobs here cut the order into buckets first: totals per bucket form a small
table, a window over that table gives each bucket's offset, and the fine window runs inside
(key, bucket) only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import seeded_hex

BUCKETS = 64
PREFIX = 3  # hex digits: 4096 equal buckets of a uniform hash


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    # without keys the right side is one row by construction
    return left.join(right, keys) if keys else left.join(F.broadcast(right))


def hash_rank(df: DataFrame, seed, keys: list[str], groups: list[str] | None = None, name: str = "rank", upto: int | None = None) -> DataFrame:
    """1-based rank of every row in the seeded hash order of ``keys``, over all rows or per group;
    ``upto``: only the rows up to that rank, those of later buckets leave before the shuffle.

    The first hex digits of the hash are both uniform and order-preserving, so they serve as
    range buckets and no bucket depends on the data's skew."""
    groups = groups or []
    marked = df.withColumn("_hx", seeded_hex(seed, *[F.col(k) for k in keys])).withColumn("_b", F.substring("_hx", 1, PREFIX))
    counts = marked.groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    if upto is not None:
        offsets = offsets.filter(F.col("_off") < upto)
    if not groups:
        offsets = F.broadcast(offsets)  # at most 16**PREFIX rows
    fine = Window.partitionBy(*groups, "_b").orderBy("_hx", *keys)
    ranked = (marked.join(offsets, [*groups, "_b"])
              .withColumn(name, F.col("_off") + F.row_number().over(fine)).drop("_hx", "_b", "_off"))
    return ranked if upto is None else ranked.filter(F.col(name) <= upto)


def first_by_hash(df: DataFrame, n: int, seed, keys: list[str]) -> DataFrame:
    """The first n rows in seeded hash order, by their rank: no task gathers all n."""
    return hash_rank(df, seed, keys, name="_first", upto=n).drop("_first")


def running_totals(df: DataFrame, groups: list[str], order: str, sums: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds ``cum_<s>``: inclusive totals in ascending ``order`` within each group.

    Expects at most one row per (group, order value), i.e. pre-aggregated input. Cut points
    come from a mergeable quantile sketch, so no task sees a whole group."""
    cuts = df.groupBy(*groups).agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10000).alias("_cuts"))
    marked = _join(df, cuts, groups).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    parts = marked.groupBy(*groups, "_b").agg(*[F.sum(s).alias(f"_p_{s}") for s in sums])
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*groups, "_b", *[F.coalesce(F.sum(f"_p_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums])
    fine = Window.partitionBy(*groups, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = marked.join(offsets, [*groups, "_b"])
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.col(f"_o_{s}") + F.sum(s).over(fine)).drop(f"_o_{s}")
    return out.drop("_b")


def exact_quantiles(df: DataFrame, groups: list[str], value: Column, quantiles: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group, distributed over value ranges; adds ``n``.

    ``percentile`` keeps every distinct value of a group in one buffer; here a group is only
    ever a set of (value, count) rows spread over buckets."""
    counts = df.select(*groups, value.cast("double").alias("_v")).filter("_v IS NOT NULL").groupBy(*groups, "_v").agg(F.count("*").alias("_c"))
    cum = running_totals(counts, groups, "_v", ["_c"])
    totals = counts.groupBy(*groups).agg(F.sum("_c").alias("n"))
    both = _join(cum, totals, groups)
    picks = [F.first("n").alias("n")]
    for name, q in quantiles.items():
        at = F.lit(q) * (F.col("n") - 1)
        lo, hi = F.floor(at), F.ceil(at)
        picks += [F.min(F.when(F.col("cum__c") > lo, F.col("_v"))).alias(f"_lo_{name}"),
                  F.min(F.when(F.col("cum__c") > hi, F.col("_v"))).alias(f"_hi_{name}")]
    out = both.groupBy(*groups).agg(*picks)
    for name, q in quantiles.items():
        at = F.lit(q) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out = out.withColumn(name, lo + (hi - lo) * (at - F.floor(at))).drop(f"_lo_{name}", f"_hi_{name}")
    return out


def upper_median(df: DataFrame, groups: list[str], value: Column, name: str) -> DataFrame:
    """Upper middle element (``sorted[n // 2]``) per group, exact; adds ``n``."""
    counts = df.select(*groups, value.cast("double").alias("_v")).filter("_v IS NOT NULL").groupBy(*groups, "_v").agg(F.count("*").alias("_c"))
    cum = running_totals(counts, groups, "_v", ["_c"])
    totals = counts.groupBy(*groups).agg(F.sum("_c").alias("n"))
    both = _join(cum, totals, groups)
    return both.groupBy(*groups).agg(F.min(F.when(F.col("cum__c") > F.floor(F.col("n") / 2), F.col("_v"))).alias(name), F.first("n").alias("n"))


def forward_fill(df: DataFrame, keys: list[str], order: str, value: str, name: str, chunk: int = 10_000) -> DataFrame:
    """Last non-null ``value`` at or before each row, along an integer ``order``.

    Long sequences are cut into chunks: the last value of each chunk is carried over a
    chunk-level window, rows only look back inside their chunk."""
    marked = df.withColumn("_k", F.floor(F.col(order) / chunk))
    ends = marked.groupBy(*keys, "_k").agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_k", F.last("_last", True).over(before).alias("_carry"))
    fine = Window.partitionBy(*keys, "_k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (marked.join(carry, [*keys, "_k"])
            .withColumn(name, F.coalesce(F.last(value, True).over(fine), F.col("_carry"))).drop("_k", "_carry"))


def with_group_stats(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Group aggregates joined back to the rows: partial aggregation first, then an equi-join
    whose hot side adaptive execution can split (an unordered window could not be split)."""
    return df.join(df.groupBy(*keys).agg(*aggs), keys)
