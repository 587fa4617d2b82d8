"""Seeded draws, splits and set operations on hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions.hashing import seeded_hex, seeded_int
from plumbline.operators.ranks import first_by_hash, hash_rank
from plumbline.session import broadcast_if_small

HINT_IOU = 0.5


def top_boxes(df: DataFrame, item: str, first: Column, area: Column, iid: str, box: str, k: int) -> DataFrame:
    """(item, hints): the described box, then the largest others that overlap no chosen box by
    half, at most k. The pass needs its rows in one place, and only they: rows arrive as one
    array per item, sorted, and a fold stops adding at k."""
    entry = F.struct(F.when(first, 0).otherwise(1).alias("f"), (-area).alias("a"), F.col(iid).alias("i"), F.col(box).alias("b"))
    rows = df.groupBy(item).agg(F.array_sort(F.collect_list(entry)).alias("_r"))
    kind = dict(df.dtypes)
    empty = F.array().cast(f"array<struct<i:{kind[iid]},b:{kind[box]}>>")
    fold = F.aggregate("_r", empty, lambda acc, x: F.when((F.size(acc) >= k) | F.exists(acc, lambda c: G.iou(x["b"], c["b"]) >= HINT_IOU), acc)
                       .otherwise(F.concat(acc, F.array(F.struct(x["i"].alias("i"), x["b"].alias("b"))))))
    return rows.select(item, fold.alias("hints"))


def hold_out_groups(df: DataFrame, group: str, n: int, seed, name: str = "held_out") -> DataFrame:
    """Flags the rows of the first n groups in seeded order; a group is never divided."""
    chosen = first_by_hash(df.select(group).distinct(), n, seed, [group]).withColumn(name, F.lit(True))
    return df.join(broadcast_if_small(chosen), group, "left").withColumn(name, F.coalesce(name, F.lit(False)))  # n rows


def split_by_fraction(df: DataFrame, group: str, fraction: float, seed, name: str = "train") -> DataFrame:
    """Flags the rows of round(fraction * groups) groups in seeded order."""
    groups = df.select(group).distinct()
    ranked = hash_rank(groups, seed, [group], name="_rk")
    total = groups.agg(F.count("*").alias("_n"))
    flags = ranked.join(F.broadcast(total)).select(group, (F.col("_rk") <= F.bround(F.col("_n") * fraction)).alias(name))
    return df.join(flags, group)


def reserve_slice(df: DataFrame, key: str, n: int, seed, slice_name: str) -> DataFrame:
    """Names a slice of n seeded rows and takes them out of scope."""
    chosen = first_by_hash(df.select(key), n, seed, [key]).withColumn("_in", F.lit(True))
    d = df.join(broadcast_if_small(chosen), key, "left")
    return (d.withColumn("dev_slice", F.when(F.col("_in"), slice_name)).withColumn("in_scope", F.col("in_scope") & F.col("_in").isNull()).drop("_in"))


def stratum_quotas(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """(stratum, size, quota): proportional floors, the remainder one each to the largest
    strata that still have rows; everything when the frame is not larger than n."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("_t"), F.sum(F.lit(0)).alias("_z"))
    d = sizes.join(F.broadcast(total)).withColumn("_q", F.floor(F.lit(n) * F.col("size") / F.col("_t")))
    left = d.agg((F.lit(n) - F.sum("_q")).alias("_left"))
    # windows over strata, not rows: one row per stratum
    order = Window.orderBy(F.col("size").desc(), F.col(stratum).asc_nulls_last())
    open_rank = F.sum(F.when(F.col("_q") < F.col("size"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    d = d.join(F.broadcast(left)).withColumn("_r", open_rank)
    quota = F.when(F.col("_t") <= n, F.col("size")).otherwise(F.col("_q") + F.when((F.col("_q") < F.col("size")) & (F.col("_r") <= F.col("_left")), 1).otherwise(0))
    return d.select(stratum, "size", quota.cast("bigint").alias("quota"))


def stratified_draw(df: DataFrame, key: str, stratum: str, n: int, seed) -> DataFrame:
    """Exactly n rows (or all), proportional to the strata, seeded inside each."""
    q = stratum_quotas(df, stratum, n)
    ranked = hash_rank(df, seed, [key], [stratum], "_rk")
    return ranked.join(q.select(stratum, "quota"), stratum).filter(F.col("_rk") <= F.col("quota")).drop("_rk", "quota")


def random_and_negative_draw(df: DataFrame, key: str, stratum: str, negative: Column, n_random: int, n_negative: int, seed) -> DataFrame:
    """A stratified draw, then a second one from the remaining negative rows."""
    first = stratified_draw(df, key, stratum, n_random, seed)
    rest = df.join(first.select(key), key, "left_anti").filter(negative)
    second = stratified_draw(rest, key, stratum, n_negative, seed)
    return first.withColumn("sample_stratum", F.lit("random")).unionByName(second.withColumn("sample_stratum", F.lit("negative")))


def eligible_frame(df: DataFrame, pair: str, key: str, correct: str, determined: Column) -> DataFrame:
    """One determined row per pair (the first key) among pairs correct at least once."""
    cols = [c for c in df.columns if c != pair]
    g = df.groupBy(pair).agg(F.bool_or(F.coalesce(F.col(correct), F.lit(False))).alias("_ok"), F.min_by(F.struct(*cols), F.when(determined, F.col(key))).alias("_row"))
    return g.filter("_ok AND _row IS NOT NULL").select(pair, "_row.*")


def rater_order(tasks: DataFrame, task: str, raters: list[str], seed) -> DataFrame:
    """(rater, task, place): every rater gets the same tasks in an order of their own."""
    d = tasks.select(task).withColumn("rater", F.explode(F.array(*[F.lit(r) for r in raters])))
    return hash_rank(d, seed, ["rater", task], ["rater"], "place")


def blind_ab(df: DataFrame, key: str, target: str, negative: str, seed) -> DataFrame:
    """Adds neg_is_a, text_a, text_b by a seeded coin."""
    coin = seeded_int(seed, F.col(key)) % 2 == 0
    return df.withColumn("neg_is_a", coin).withColumn("text_a", F.when(coin, F.col(negative)).otherwise(F.col(target))).withColumn(
        "text_b", F.when(coin, F.col(target)).otherwise(F.col(negative)))


def decode_ab(letter: Column, neg_is_a: Column) -> Column:
    """Found / not found from an A or B answer, else null."""
    return F.when(letter.isin("A", "B"), (letter == "A") == neg_is_a)


def training_order(df: DataFrame, group: str, kind: str, ranks: dict[str, int], key: str, seed) -> DataFrame:
    """Adds ``step_key``: groups in seeded order, fixed order of kinds inside a group. Writing the
    result sorted by it is a range partitioning, not a global sort in one task."""
    rank = F.coalesce(*[F.when(F.col(kind) == k, v) for k, v in ranks.items()], F.lit(len(ranks)))
    return df.withColumn("step_key", F.concat_ws(":", seeded_hex(seed, F.col(group)), F.col(group).cast("string"), rank.cast("string"), F.col(key).cast("string")))


def dev_test_split(df: DataFrame, task: str, key: str, dev: dict[str, int], test_end: dict[str, int | None], default_dev: int, default_end: int | None, seed) -> DataFrame:
    """Adds ``part``: first rows of each task in seeded order are dev, the next ones test, the
    rest null; limits per task with defaults."""
    d = hash_rank(df, seed, [key], [task], "_rk")

    def limit(table, default):
        return F.coalesce(*[F.when(F.col(task) == k, F.lit(v if v is not None else 1 << 60)) for k, v in table.items()], F.lit(default if default is not None else 1 << 60))

    return d.withColumn("part", F.when(F.col("_rk") <= limit(dev, default_dev), "dev").when(F.col("_rk") <= limit(test_end, default_end), "test")).drop("_rk")


def capped_extras(base: DataFrame, extras: list[tuple[DataFrame, int | None]], key: str, held_out: DataFrame, group: str, repeat: Column, times: int, seed) -> DataFrame:
    """Base rows plus extra sources, each capped in seeded order and without held-out groups;
    rows where ``repeat`` holds appear ``times`` times."""
    out = base
    for df, cap in extras:
        usable = df.join(held_out, group, "left_anti")
        out = out.unionByName(first_by_hash(usable, cap, seed, [key]) if cap else usable)
    return out.withColumn("copy", F.explode(F.when(repeat, F.sequence(F.lit(1), F.lit(times))).otherwise(F.array(F.lit(1)))))


def union_first_wins(sources: list[DataFrame], key: list[str], order: list[str] | None = None, last: bool = False) -> DataFrame:
    """Several result sets united; per key the earliest (or latest) row counts. Decided by
    ``min_by`` / ``max_by``, so duplicates of a hot key are combined before the shuffle."""
    tagged = [s.withColumn("_src", F.lit(i)) for i, s in enumerate(sources)]
    u = tagged[0]
    for s in tagged[1:]:
        u = u.unionByName(s, allowMissingColumns=True)
    rest = [c for c in u.columns if c not in key and c != "_src"]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct("_src", *(order or [])))
    return u.groupBy(*key).agg(pick.alias("_row")).select(*key, "_row.*")


def id_algebra(keep: list[DataFrame], drop: list[DataFrame], key: str) -> DataFrame:
    """Ids in every set of ``keep`` and in none of ``drop`` (semi and anti joins: no set is
    gathered anywhere)."""
    out = keep[0].select(key).distinct()
    for k in keep[1:]:
        out = out.join(k.select(key), key, "left_semi")
    for d in drop:
        out = out.join(d.select(key), key, "left_anti")
    return out
