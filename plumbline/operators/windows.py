"""Ordered passes: ranks, positions, carried values, group-relative scores, batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import seeded_hex
from plumbline.operators.ranks import first_by_hash, hash_rank, running_totals, with_group_stats

# Gap and wording of ordinals.
MIN_GAP = 0.05
ORDINALS = ("first", "second", "third", "fourth", "fifth")


def per_label_cap(df: DataFrame, key: str, label: str, k: int, n: int, seed) -> DataFrame:
    """At most k rows per label in seeded order, then the first n overall. The rank filter is
    applied below the shuffle, so a hot label sends k rows per task."""
    w = Window.partitionBy(label).orderBy(seeded_hex(seed, F.col(key)), F.col(key))
    capped = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
    return first_by_hash(capped, n, seed, [key])


def left_to_right(df: DataFrame, image: str, x: Column, tie: str, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(image).orderBy(x, F.col(tie))))


def ordinal_positions(df: DataFrame, image: str, iid: str, centre: Column, size: float, axis: str, name: str) -> DataFrame:
    """0-based rank of every candidate along an axis and its phrase; null on an axis where two
    neighbouring centres are closer than 5 % of the frame."""
    w = Window.partitionBy(image)
    d = df.withColumn("_c", centre)
    d = (d.withColumn("_gap", F.col("_c") - F.lag("_c").over(w.orderBy("_c", iid))).withColumn("_k", F.row_number().over(w.orderBy("_c", iid)) - 1))
    d = d.withColumn("_n", F.count("*").over(w)).withColumn("_min", F.min("_gap").over(w))
    usable = (F.col("_n") > 1) & (F.col("_min") >= MIN_GAP * size)
    k, n = F.col("_k"), F.col("_n")
    nth = F.get(F.array(*[F.lit(o) for o in ORDINALS]), k)
    if axis == "x":
        text = (F.when(n == 2, F.concat(F.lit(f"is the {name} on the "), F.when(k == 0, "left").otherwise("right")))
                .when(k == n - 1, f"is the rightmost {name}").when(k == 0, f"is the leftmost {name}")
                .otherwise(F.concat(F.lit("is the "), nth, F.lit(f" {name} from the left"))))
    else:
        text = (F.when(n == 2, F.concat(F.lit("is the "), F.when(k == 0, "upper").otherwise("lower"), F.lit(f" {name}")))
                .when(k == 0, f"is the {name} nearest the top").when(k == n - 1, f"is the {name} nearest the bottom")
                .otherwise(F.concat(F.lit("is the "), nth, F.lit(f" {name} from the top"))))
    return d.withColumn("k", F.when(usable, k)).withColumn("phrase", F.when(usable, text)).drop("_c", "_gap", "_k", "_n", "_min")


def head_tail_means(df: DataFrame, run: str, order: str, values: list[str]) -> DataFrame:
    """Mean of the first and the last quarter of each run's records (at least one record)."""
    ranked = running_totals(df.withColumn("_one", F.lit(1)), [run], order, ["_one"])
    both = ranked.join(df.groupBy(run).agg(F.count("*").alias("_n")), run)
    k = F.greatest(F.lit(1), F.floor(F.col("_n") / 4))
    aggs = [F.first("_n").alias("n")]
    for v in values:
        aggs += [F.avg(F.when(F.col("cum__one") <= k, F.col(v))).alias(f"head_{v}"), F.avg(F.when(F.col("cum__one") > F.col("_n") - k, F.col(v))).alias(f"tail_{v}")]
    return both.groupBy(run).agg(*aggs)


def group_relative(df: DataFrame, group: list[str], score: str, negative: Column, neg_scale: float = 1.0, key: list[str] | None = None) -> DataFrame:
    """Adds ``advantage`` = scale * (r - mean) / (std + 1e-4) within the group; groups without
    spread are left out. With ``key`` also ``baseline``: r minus the mean of its key where that
    key has two or more values with spread."""
    r = F.col(score)
    s = with_group_stats(df, group, F.avg(score).alias("_m"), F.stddev_pop(score).alias("_sd"), (F.max(score) - F.min(score)).alias("_spread"))
    scale = F.when(negative, F.lit(neg_scale)).otherwise(1.0)
    out = s.filter(F.col("_spread") >= 1e-6).withColumn("advantage", scale * (r - F.col("_m")) / (F.col("_sd") + 1e-4)).drop("_m", "_sd", "_spread")
    if key:
        base = df.groupBy(*group, *key).agg(F.avg(score).alias("_bm"), F.count("*").alias("_bn"), (F.max(score) - F.min(score)).alias("_bs"))
        out = (out.join(base, [*group, *key]).withColumn("baseline", F.when((F.col("_bn") >= 2) & (F.col("_bs") > 1e-6), scale * (r - F.col("_bm"))))
               .drop("_bm", "_bn", "_bs"))
    return out


def scene_positive_rate(df: DataFrame, group: str, positive: Column, success: Column, name: str = "s_pos") -> DataFrame:
    """Success share of the scene's positive rows, on every row of the scene."""
    return with_group_stats(df, [group], F.avg(F.when(positive, success.cast("int"))).alias(name))


def round_robin(df: DataFrame, buckets: list[str], key: list[str], n: int, seed) -> DataFrame:
    """One row of each bucket in turn until n rows are taken (a distributed top-n)."""
    return hash_rank(df, seed, key, buckets, "turn").orderBy("turn", *buckets).limit(n)


def half_flag(df: DataFrame, source: str, key: list[str], seed, name: str = "half") -> DataFrame:
    """Flags the first ceil(n / 2) rows of each source in seeded order."""
    sizes = df.groupBy(source).agg(F.count("*").alias("_n"))
    return hash_rank(df, seed, key, [source], "_rk").join(sizes, source).withColumn(name, F.col("_rk") <= F.floor((F.col("_n") + 1) / 2)).drop("_rk", "_n")


def shape_batches(df: DataFrame, shape: list[str], key: list[str], size: int, seed) -> DataFrame:
    """Batch number within each exact shape."""
    return hash_rank(df, seed, key, shape, "_rk").withColumn("batch", F.floor((F.col("_rk") - 1) / size)).drop("_rk")


def scene_batches(scenes: DataFrame, scene: str, size: str, per_step: int, seed, digits: int = 2) -> DataFrame:
    """(scene, batch): whole scenes packed in seeded order, a batch closing when the next scene
    would exceed ``per_step`` items.

    Packing is a left-to-right pass, but its whole state is the fill of the open batch (0 to
    per_step). Each hash-range shard maps every possible fill to (fill, batches closed); the
    shard maps are chained over one row per shard; then each shard replays its scenes from its
    true start. Equal to one global pass, with no task holding more than a shard (one of
    16**digits equal hash ranges; scenes are two small columns)."""
    marked = scenes.select(scene, F.col(size).cast("int").alias("_s"), seeded_hex(seed, F.col(scene)).alias("_hx")).withColumn("_shard", F.substring("_hx", 1, digits))
    cap = per_step

    def step(fill: int, s: int) -> tuple[int, int]:
        return (min(s, cap), 1) if fill and fill + s > cap else (min(fill + s, cap), 0)

    def shard_map(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_hx", scene])
        ends, closed = [], []
        for start in range(cap + 1):
            fill, n = start, 0
            for s in pdf["_s"]:
                fill, c = step(fill, s)
                n += c
            ends.append(fill)
            closed.append(n)
        return pd.DataFrame({"_shard": [pdf["_shard"].iloc[0]], "ends": [ends], "closed": [closed]})

    maps = marked.groupBy("_shard").applyInPandas(shard_map, "_shard string, ends array<int>, closed array<bigint>")
    # one row per shard (16**digits at most): chained in one array fold
    chain = F.array_sort(F.collect_list(F.struct("_shard", "ends", "closed")))
    start = F.struct(F.lit(0).alias("fill"), F.lit(0).cast("bigint").alias("batch"), F.array().cast("array<struct<_shard:string,fill:int,batch:bigint>>").alias("out"))
    folded = maps.agg(chain.alias("c")).select(F.aggregate("c", start, lambda a, x: F.struct(
        F.get(x["ends"], a["fill"]).alias("fill"), (a["batch"] + F.get(x["closed"], a["fill"])).alias("batch"),
        F.concat(a["out"], F.array(F.struct(x["_shard"].alias("_shard"), a["fill"].alias("fill"), a["batch"].alias("batch")))).alias("out")))["out"].alias("o"))
    starts = folded.select(F.explode("o").alias("o")).select("o._shard", F.col("o.fill").alias("_f"), F.col("o.batch").alias("_b0"))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_hx", scene])
        fill, n, out = int(pdf["_f"].iloc[0]), int(pdf["_b0"].iloc[0]), []
        for s in pdf["_s"]:
            fill, c = step(fill, s)
            n += c
            out.append(n)
        return pd.DataFrame({scene: pdf[scene], "batch": out})

    kind = dict(scenes.dtypes)[scene]
    return marked.join(F.broadcast(starts), "_shard").groupBy("_shard").applyInPandas(replay, f"{scene} {kind}, batch bigint")


def side_stream(df: DataFrame, key: list[str], per_batch: int, seed) -> DataFrame:
    """Batch number of side rows that ride along, a fixed number per batch."""
    return hash_rank(df, seed, key, None, "_rk").withColumn("batch", F.floor((F.col("_rk") - 1) / per_batch)).drop("_rk")
