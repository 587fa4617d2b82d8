"""Summary tables: wide conditional aggregates, grids of rules, votes, verdicts.

Every report is an aggregation that combines map-side; grids of thresholds or rules are
expanded from literal arrays next to the rows and summed again before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ranks import exact_quantiles

# Thresholds of the reports.
IOU_STEPS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
PASS_GRID = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
NULL_TYPES = ("none", "refusal")
GATE_THRESHOLD, Q75_REQUIRED, RUNG_REQUIRED, RUNG, FLOOR_AUROC, NULL_TOLERANCE = 0.60, 0.9, 0.7, 90, 0.7, 0.05


def share(flag: Column, where: Column | None = None) -> Column:
    """Mean of a flag over the rows of a denominator; null flags are not measured."""
    v = flag.cast("int")
    return F.avg(v if where is None else F.when(where, v))


def count_where(flag: Column) -> Column:
    return F.count(F.when(flag, 1))


def with_medians(table: DataFrame, df: DataFrame, groups: list[str], value: Column, name: str) -> DataFrame:
    return table.join(exact_quantiles(df, groups, value, {name: 0.5}).drop("n"), groups, "left")


def count_and_median(df: DataFrame, groups: list[str], value: Column, image: str) -> DataFrame:
    """Rows, distinct images and median per group."""
    counts = df.groupBy(*groups).agg(F.count("*").alias("n"), F.countDistinct(image).alias("n_images"))
    return with_medians(counts, df, groups, value, "median")


def gate_pass_table(df: DataFrame, gates: list[str]) -> DataFrame:
    """(gate, passed, measured, rate) over many three-valued columns, in one pass."""
    wide = df.agg(*[x for g in gates for x in (count_where(F.col(g)).alias(f"p_{g}"), F.count(g).alias(f"m_{g}"))])
    stack = ", ".join(f"'{g}', p_{g}, m_{g}" for g in gates)
    return wide.select(F.expr(f"stack({len(gates)}, {stack}) AS (gate, passed, measured)")).withColumn("rate", F.when(F.col("measured") > 0, F.col("passed") / F.col("measured")))


def eval_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, null rates and trace rates per group and over everything (``rollup``)."""
    neg, pos = F.col("n_gt") == 0, F.col("n_gt") > 0
    null = F.col("output_type").isin(*NULL_TYPES)
    out = df.rollup(*by).agg(
        F.count("*").alias("n"), share(F.col("correct"), neg).alias("rejection_acc"), count_where(neg).alias("rejection_n"),
        share(F.col("correct"), pos).alias("positive_acc"), count_where(pos).alias("positive_n"), share(null, pos).alias("positive_null_rate"),
        share(F.col("parse_ok")).alias("format_ok_rate"), F.grouping_id().alias("level"))
    return out.withColumn("net_rejection", F.col("rejection_acc") - F.col("positive_null_rate"))


def p_null_stats(df: DataFrame, groups: list[str], p: str) -> DataFrame:
    """Sum, median log10 (floored) and share of p >= 0.1 of small probabilities."""
    sums = df.filter(F.col(p).isNotNull()).groupBy(*groups).agg(F.count("*").alias("n"), F.sum(p).alias("p_sum"), share(F.col(p) >= 0.1).alias("p_ge_01"))
    j = with_medians(sums, df, groups, F.col(p), "_m")
    return j.withColumn("p_median_log10", F.log10(F.greatest(F.col("_m"), F.lit(1e-30)))).drop("_m")


def trace_rates(df: DataFrame, groups: list[str]) -> DataFrame:
    """Format, consistency and false-accusation rates of parsed traces."""
    return df.groupBy(*groups).agg(
        F.count("*").alias("n"), share(F.col("format_ok")).alias("format_ok_rate"), share(F.col("consistent")).alias("consistent_rate"),
        (F.sum("false_no") / F.greatest(F.lit(1), F.sum(F.when(F.col("false_no").isNotNull(), F.col("n_cells"))))).alias("false_no_cell_rate"),
        share(F.col("false_no") > 0).alias("false_no_item_rate"))


def eval_report(df: DataFrame, by: str, p: str) -> DataFrame:
    """``eval_summary`` by one column and over everything, with the statistics of small probabilities (``p``) and of
    traces beside it. The totals of the latter come from the rows once more, under a missing ``by``."""
    def key(level: Column) -> Column:
        return F.concat(level.cast("string"), F.when(level == 0, F.concat(F.lit(":"), F.coalesce(F.col(by).cast("string"), F.lit("")))).otherwise(""))

    levels = df.withColumn("_level", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_key", key(F.col("_level")))
    small = p_null_stats(levels, ["_key"], p).withColumnRenamed("n", "p_null_n")
    traces = trace_rates(levels, ["_key"]).drop("n").withColumnRenamed("format_ok_rate", "trace_format_ok_rate")
    return eval_summary(df, [by]).withColumn("_key", key(F.col("level"))).join(small, "_key", "left").join(traces, "_key", "left").drop("_key")


def accuracy_at_thresholds(df: DataFrame, by: list[str], iou: Column, steps=IOU_STEPS) -> DataFrame:
    """(by, n, threshold, accuracy) with totals; threshold null is the mean over all steps."""
    wide = df.rollup(*by).agg(F.count("*").alias("n"), F.grouping_id().alias("level"), *[share(iou >= t).alias(f"a{i}") for i, t in enumerate(steps)])
    mean = sum((F.col(f"a{i}") for i in range(1, len(steps))), F.col("a0")) / len(steps)
    stack = ", ".join(f"CAST({t} AS DOUBLE), a{i}" for i, t in enumerate(steps)) + ", CAST(NULL AS DOUBLE), mean"
    return wide.withColumn("mean", mean).select(*by, "level", "n", F.expr(f"stack({len(steps) + 1}, {stack}) AS (threshold, accuracy)"))


def candidate_arrays(df: DataFrame, item: str, pos: str, fields: list[Column]) -> DataFrame:
    """Candidates of an item (a handful) as one array in proposal order."""
    return df.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), *fields))).alias("cands"))


def grid_decision(cands: Column, rule: Column, t: Column) -> Column:
    """Chosen candidate: the first that passes t, or the best when it passes t; null if none."""
    passing = F.filter(cands, lambda c: c["p"] >= t)
    best = F.try_element_at(F.array_sort(passing, lambda a, b: F.when((a["p"] > b["p"]) | ((a["p"] == b["p"]) & (a["pos"] < b["pos"])), -1).otherwise(1)), F.lit(1))
    return F.when(rule == "first", F.try_element_at(passing, F.lit(1))).otherwise(best)


def threshold_grid(items: DataFrame, group: str, grid=PASS_GRID) -> DataFrame:
    """(group, rule, t, accuracy) of two decision rules; ``items`` has cands, n_gt, base_correct.

    A row with t null and rule "oracle" is the share of items with any correct candidate, rule
    "base" the accuracy of the baseline run."""
    points = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(t)).alias("t")) for r in ("first", "best") for t in grid]))
    d = items.select(group, "cands", "n_gt", points.alias("g")).select(group, "n_gt", "g.rule", "g.t", grid_decision(F.col("cands"), F.col("g.rule"), F.col("g.t")).alias("ans"))
    ok = F.when(F.col("n_gt") == 0, F.col("ans").isNull()).otherwise(F.coalesce(F.col("ans.hit"), F.lit(False)))
    out = d.groupBy(group, "rule", "t").agg(F.count("*").alias("n"), share(ok).alias("accuracy"))
    none = F.lit(None).cast("double")
    oracle = items.filter("n_gt > 0").groupBy(group).agg(F.count("*").alias("n"), share(F.exists("cands", lambda c: c["hit"])).alias("accuracy"))
    base = items.filter("base_correct IS NOT NULL").groupBy(group).agg(F.count("*").alias("n"), share(F.col("base_correct")).alias("accuracy"))
    for name, extra in (("oracle", oracle), ("base", base)):
        out = out.unionByName(extra.select(group, F.lit(name).alias("rule"), none.alias("t"), "n", "accuracy"))
    return out


def best_rejection(grid: DataFrame, group: str, positive: str, negative: str, margin: float) -> DataFrame:
    """Per rule: the threshold with the best rejection among those whose positives stay within
    ``margin`` of the baseline (a small table in, a small table out)."""
    pos = grid.filter((F.col(group) == positive) & F.col("t").isNotNull()).select("rule", "t", F.col("accuracy").alias("positives"))
    neg = grid.filter((F.col(group) == negative) & F.col("t").isNotNull()).select("rule", "t", F.col("accuracy").alias("rejection"))
    base = grid.filter((F.col(group) == positive) & (F.col("rule") == "base")).select(F.col("accuracy").alias("base"))
    d = pos.join(neg, ["rule", "t"]).join(F.broadcast(base)).filter(F.col("positives") >= F.col("base") - margin)
    return d.groupBy("rule").agg(F.max(F.struct("rejection", "t", "positives")).alias("b")).select("rule", F.lit(float(margin)).alias("margin"), "b.rejection", "b.t", "b.positives")


def operating_curve(df: DataFrame, score: Column, taus: list[float]) -> DataFrame:
    """(tau, rejection, null and net rates) when items with a "no" probability above tau are
    declined; items without a score keep their own answer."""
    d = df.withColumn("_s", score).withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    null = F.when(F.col("_s").isNotNull(), F.col("_s") > F.col("tau")).otherwise(F.col("output_type") != "box")
    neg, pos = F.col("n_gt") == 0, F.col("n_gt") > 0
    out = d.groupBy("tau").agg(share(null, neg).alias("rejection_acc"), share(null, pos).alias("positive_null_rate"), share(~null & (F.col("iou") >= 0.5), pos).alias("positive_acc"))
    return out.withColumn("net_rejection", F.col("rejection_acc") - F.col("positive_null_rate"))


def rule_rescoring(cands: Column, k: int, w: float, margin: bool) -> Column:
    """Candidate (struct with yes, no, pos) chosen when k "no" exclude, the rest scored
    yes - w * no; with ``margin`` a tie for the best gives null."""
    alive = F.filter(cands, lambda c: c["no"] < k)
    scored = F.transform(alive, lambda c: F.struct((c["yes"] - F.lit(w) * c["no"]).alias("s"), (-c["pos"]).alias("o"), c.alias("c")))
    top = F.array_max(F.transform(alive, lambda c: F.struct((c["yes"] - F.lit(w) * c["no"]).alias("s"), (-c["pos"]).alias("o"))))
    chosen = F.try_element_at(F.filter(scored, lambda x: (x["s"] == top["s"]) & (x["o"] == top["o"])), F.lit(1))["c"]
    ties = F.size(F.filter(scored, lambda x: x["s"] == top["s"]))
    return F.when(F.lit(not margin) | (ties == 1), chosen)


def veto_choice(cands: Column, rule: str) -> Column:
    """Candidate (struct with fits, n_match, pos): the first that fits; or candidate 1 unless
    vetoed, then nothing ("c1_only") or the fitting one with most matches ("veto_most")."""
    first = F.try_element_at(F.filter(cands, lambda c: c["fits"]), F.lit(1))
    if rule == "first_fit":
        return first
    c1 = F.try_element_at(cands, F.lit(1))
    keep1 = F.when(c1["fits"], c1)
    if rule == "c1_only":
        return keep1
    rest = F.filter(cands, lambda c, i: (i >= 1) & c["fits"])
    best = F.array_max(F.transform(rest, lambda c: F.struct(c["n_match"].alias("m"), (-c["pos"]).alias("o"))))
    return F.coalesce(keep1, F.try_element_at(F.filter(rest, lambda c: -c["pos"] == best["o"]), F.lit(1)))


def majority_cells(df: DataFrame, keys: list[str], sample: str, verdict: str, reason: str) -> DataFrame:
    """(keys, verdict, reason): majority over samples, a tie is unclear, the reason comes from
    the first sample with the winning verdict."""
    counts = df.groupBy(*keys, verdict).agg(F.count("*").alias("_c"), F.min_by(F.struct(F.col(reason).alias("r")), sample).alias("_r"))
    per = counts.groupBy(*keys).agg(F.max("_c").alias("_top"), F.collect_list(F.struct(F.col(verdict).alias("v"), F.col("_c").alias("c"), F.col("_r.r").alias("r"))).alias("_all"))
    win = F.filter("_all", lambda x: x["c"] == F.col("_top"))
    v = F.when(F.size(win) == 1, F.get(win, F.lit(0))["v"]).otherwise("unclear")
    return per.select(*keys, v.alias(verdict), F.try_element_at(F.filter("_all", lambda x: x["v"] == v), F.lit(1))["r"].alias(reason))


def pair_accuracy(df: DataFrame, group: str, kind: Column, correct: Column) -> DataFrame:
    """Pairs (groups with a positive and a negative) and the share with both correct."""
    g = df.groupBy(group).agg(F.max(F.when(kind == "positive", correct.cast("int"))).alias("_p"), F.max(F.when(kind == "negative", correct.cast("int"))).alias("_n"))
    pairs = g.filter("_p IS NOT NULL AND _n IS NOT NULL")
    return pairs.agg(F.count("*").alias("pair_n"), share((F.col("_p") == 1) & (F.col("_n") == 1)).alias("pair_acc"))


def verdict_table(rows: DataFrame, required: list[tuple[str, str]], hole: str, row: str, auroc: str, nulls: DataFrame, ladder: DataFrame) -> DataFrame:
    """(hole, max_auroc, argmax_row, missing, verdict): pass only when every required row ran,
    the maximum stays under the gate and the ladder and the nulls hold."""
    spark = rows.sparkSession
    need = spark.createDataFrame(required, f"{hole} string, {row} string")
    have = rows.join(F.broadcast(need), [hole, row], "left_semi").filter(F.col(auroc).isNotNull() & ~F.isnan(auroc))
    best = have.groupBy(hole).agg(F.max(auroc).alias("max_auroc"), F.max_by(row, F.struct(F.col(auroc))).alias("argmax_row"), F.countDistinct(row).alias("_have"))
    n_need = need.groupBy(hole).agg(F.count("*").alias("_need"))
    null_ok = nulls.groupBy(hole).agg(F.bool_and(F.coalesce(F.abs(F.col(auroc) - 0.5) <= NULL_TOLERANCE, F.lit(False))).alias("nulls_hold"))
    lad = ladder.groupBy(hole).agg(F.max(F.when(F.col("quality") == 75, F.col(auroc))).alias("_q75"), F.max(F.when(F.col("quality") == RUNG, F.col(auroc))).alias("_rung"))
    lad = lad.withColumn("sensitive", (F.col("_q75") > Q75_REQUIRED) & (F.col("_rung") >= RUNG_REQUIRED))
    d = n_need.join(best, hole, "left").join(null_ok, hole, "left").join(lad, hole, "left").withColumn("missing", F.col("_need") - F.coalesce("_have", F.lit(0)))
    verdict = (F.when(F.col("missing") > 0, "INCOMPLETE").when(F.col("max_auroc") > GATE_THRESHOLD, "FAIL")
               .when(~F.coalesce("sensitive", F.lit(False)) | ~F.coalesce("nulls_hold", F.lit(False)), "NOT DECISIVE").otherwise("PASS"))
    return d.select(hole, "max_auroc", "argmax_row", "missing", "nulls_hold", "sensitive", verdict.alias("verdict"))


def detection_floor(ladder: DataFrame, groups: list[str], quality: str, auroc: str) -> DataFrame:
    """Highest quality detected (AUROC >= 0.7) per group over all rows."""
    return ladder.groupBy(*groups).agg(F.max(F.when(F.col(auroc) >= FLOOR_AUROC, F.col(quality))).alias("floor"), F.max(auroc).alias("best"))
