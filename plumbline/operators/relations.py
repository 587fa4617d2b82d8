"""Predictions of one item under several conditions folded into three-valued relation flags,
the rates built on them, and the decision rules built on the rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions.text import let_all
from plumbline.operators import resampling
from plumbline.sources.schemas import OUTPUT_TYPES

# Thresholds of the relations and of the decision rules.
SAME_IOU, SAME_REGION_IOU, SHIFT_IOU, CORRECT_IOU = 0.5, 0.3, 0.5, 0.5
NONE_ON_REMOVE_MAX, BOX_ON_REMOVE_MAX, ABSTAIN_MAX, SHIFT_MAX = 0.60, 0.80, 0.30, 0.30
SHIFT_EXCESS, SAME_BOX_MIN, KAPPA_MIN, FRONTIER_SAME_BOX = 0.10, 0.20, 0.60, 0.05
CONDITIONS = ("ORIGINAL", "REMOVE", "CONTROL_OBJ", "CONTROL_BG", "T_NULL", "T_HEAD", "T_ATTR")
LOCALIZED = ("box", "point", "set")
TYPES = OUTPUT_TYPES
RATES = (("none_on_remove", "clean"), ("box_on_remove", "clean"), ("same_box_50", "frame"), ("same_box_r30", "frame"),
         ("shift_on_control_obj", "correct"), ("shift_on_control_bg", "correct"), ("abstain_on_control_obj", "all"), ("t_null_pass", "all"),
         ("t_null_prior_pass", "all"), ("t_head_pass", "all"), ("unresolved", "all"), ("redundant", "all"), ("undetermined", "all"))


def unknown() -> Column:
    return F.lit(None).cast("boolean")


def pivot_conditions(preds: DataFrame, keys: list[str], condition: str = "condition") -> DataFrame:
    """One row per key with a struct per condition. ``preds`` carries type, box, px, py; a key has
    one row per condition (the largest counts otherwise).

    A key's rows, as many as there are conditions, are put in one short array in one hash aggregation; each condition
    takes its own out of it. Fifty conditional aggregates instead would be more code than Spark compiles."""
    row = F.struct(F.col(condition).alias("c"), F.struct("type", "box", "px", "py").alias("p"))
    wide = preds.where(F.col(condition).isin(*CONDITIONS)).groupBy(*keys).agg(F.collect_list(row).alias("_rows"))

    def part(name: str) -> Column:
        own = F.array_max(F.filter("_rows", lambda r: r["c"] == name))["p"]
        return own.alias(name)

    return wide.select(*keys, *[part(c) for c in CONDITIONS])


def moved_from(pred: Column, reference: Column, threshold: float = SHIFT_IOU) -> Column:
    """No answer = moved; a box off the reference = moved; otherwise unknown or held."""
    return _moved(pred, reference, G.iou(pred["box"], reference), threshold)


def _moved(pred: Column, reference: Column, iou: Column, threshold: float = SHIFT_IOU) -> Column:
    return (F.when(pred.isNull(), unknown()).when(pred["type"] == "none", True)
            .when(pred["box"].isNull() | reference.isNull(), unknown()).otherwise(iou < threshold))


def relation_flags(d: DataFrame, gt: Column, region: Column, prior: Column, noun_count: Column, verifier_clean: Column) -> DataFrame:
    """Adds the flags; every flag is true, false or null (not measured).

    Overlaps of boxes are columns of their own first: spelled out in every flag they are more code than the JVM compiles."""
    orig, rem, obj = (F.col(c) for c in CONDITIONS[:3])
    t_null = F.col("T_NULL")
    pairs = [("ORIGINAL", "gt"), ("REMOVE", "region"), ("T_NULL", "prior"), *[(c, "ORIGINAL") for c in CONDITIONS[1:]]]
    boxes = {c: F.col(c)["box"] for c in CONDITIONS} | {"gt": gt, "region": region, "prior": prior}
    overlaps = {f"_iou_{a}_{b}": let_all(lambda s: G.iou(s["a"], s["b"]), a=boxes[a], b=boxes[b]) for a, b in pairs}
    d = d.withColumns(overlaps)

    def iou(a: str, b: str = "ORIGINAL") -> Column:
        return F.col(f"_iou_{a}_{b}")

    def off(c: str) -> Column:
        return _moved(F.col(c), orig["box"], iou(c))

    def placed(p):
        return p["type"].isin(*LOCALIZED) & (p["box"].isNotNull() | p["px"].isNotNull())

    boxed = placed(orig)
    d = d.withColumn("orig_correct", F.when(orig.isNull(), unknown())
                     .when(boxed & orig["box"].isNotNull() & gt.isNotNull(), iou("ORIGINAL", "gt") >= CORRECT_IOU)
                     .when(boxed & orig["px"].isNotNull() & gt.isNotNull(), G.point_in_box(orig["px"], orig["py"], gt)).otherwise(False))
    right = F.coalesce(F.col("orig_correct"), F.lit(False))
    unresolved = (F.when(orig.isNull() | obj.isNull(), unknown()).when(orig["type"] != obj["type"], True)
                  .when(orig["box"].isNotNull() & obj["box"].isNotNull(), iou("CONTROL_OBJ") < SHIFT_IOU)
                  .when(orig["px"].isNotNull() & obj["px"].isNotNull(), False).otherwise(True))
    both = rem["box"].isNotNull() & orig["box"].isNotNull()
    in_region = F.when(region.isNotNull(), G.point_in_box(rem["px"], rem["py"], region))
    gate = right & rem.isNotNull()
    by_point = gate & ~both & rem["px"].isNotNull()
    same50 = (F.when(gate & both, iou("REMOVE") >= SAME_IOU).when(by_point & orig["px"].isNotNull() & region.isNotNull(), in_region)
              .when(gate & ~both & rem["px"].isNull() & (rem["type"] == "none"), False))
    same30 = (F.when(gate & both, F.when(region.isNotNull(), iou("REMOVE", "region") >= SAME_REGION_IOU)).when(by_point, in_region)
              .when(gate & ~both & (rem["type"] == "none"), False))
    return (d.withColumn("unresolved", unresolved)
            .withColumn("none_on_remove", rem["type"] == "none").withColumn("box_on_remove", placed(rem))
            .withColumn("same_box_50", same50).withColumn("same_box_r30", same30)
            .withColumn("shift_on_control_obj", F.when(right, off("CONTROL_OBJ")))
            .withColumn("shift_on_control_bg", F.when(right, off("CONTROL_BG")))
            .withColumn("abstain_on_control_obj", obj["type"] == "none")
            .withColumn("t_null_pass", off("T_NULL"))
            .withColumn("t_null_prior_pass", F.when(t_null.isNotNull() & prior.isNotNull(), _moved(t_null, prior, iou("T_NULL", "prior"))))
            .withColumn("t_head_pass", off("T_HEAD")).withColumn("t_attr_moved", off("T_ATTR"))
            .withColumn("redundant", noun_count > 1).withColumn("remove_clean_verifier", verifier_clean)
            .withColumn("undetermined", verifier_clean.isNull()).drop(*overlaps))


def denominators(clean: str = "remove_clean_verifier") -> dict[str, Column]:
    is_clean = F.coalesce(F.col(clean), F.lit(False))
    right = F.coalesce(F.col("orig_correct"), F.lit(False))
    return {"all": F.lit(True), "clean": is_clean, "correct": right, "frame": is_clean & right & ~F.coalesce(F.col("unresolved"), F.lit(False))}


def conditional_rates(rel: DataFrame, groups: list[str], clean: str = "remove_clean_verifier") -> DataFrame:
    """Long table (groups, rate, point, n): every rate with its own denominator, in one pass.

    An unmeasured flag is outside its denominator, not false."""
    den = denominators(clean)
    aggs = []
    for name, frame in RATES:
        v = F.when(den[frame], F.col(name).cast("int"))
        aggs += [F.avg(v).alias(f"p_{name}"), F.count(v).alias(f"n_{name}")]
    wide = rel.groupBy(*groups).agg(F.count("*").alias("n_pairs"), *aggs)
    stack = ", ".join(f"'{n}', p_{n}, n_{n}" for n, _ in RATES)
    return wide.select(*groups, "n_pairs", F.expr(f"stack({len(RATES)}, {stack}) AS (rate, point, n)"))


def conditional_rate_cis(rel: DataFrame, groups: list[str], cluster: str, clean: str = "remove_clean_verifier", **kw) -> DataFrame:
    """Long table (groups, rate, n_pairs, point, lo, hi, n): the same rates with intervals that resample whole images.

    All rates share one scan and one set of draws; an unmeasured rate has no point, no interval and n = 0."""
    den = denominators(clean)
    named = {"n_pairs": F.lit(1.0)} | {name: F.when(den[frame], F.col(name).cast("int")) for name, frame in RATES}
    out = resampling.means(rel, groups, cluster, named, **kw)
    pairs = F.max(F.when(F.col("measure") == "n_pairs", F.col("n"))).over(Window.partitionBy(*groups))
    return out.withColumn("n_pairs", pairs).where("measure <> 'n_pairs'").select(*groups, F.col("measure").alias("rate"), "n_pairs", "point", "lo", "hi", "n")


def stop_rules(rates: DataFrame, protocol: str, model: str) -> DataFrame:
    """(protocol, rule, fires, fireable): a rule fires when at least two models all meet it."""
    wide = rates.groupBy(protocol, model).pivot("rate", [n for n, _ in RATES]).agg(F.first("point"))
    c = F.col
    tests = {
        "a": c("none_on_remove") > NONE_ON_REMOVE_MAX,
        "b": (c("box_on_remove") > BOX_ON_REMOVE_MAX) & (c("abstain_on_control_obj") > ABSTAIN_MAX),
        "b_prime": (c("box_on_remove") > BOX_ON_REMOVE_MAX) & (c("shift_on_control_obj") > SHIFT_MAX)
        & (c("shift_on_control_obj") - c("shift_on_control_bg") > SHIFT_EXCESS),
        "c": c("same_box_50") < SAME_BOX_MIN,
    }
    agg = wide.groupBy(protocol).agg(F.count("*").alias("n_models"), *[F.bool_and(F.coalesce(t, F.lit(False))).alias(f"f_{k}") for k, t in tests.items()])
    stack = ", ".join(f"'{k}', f_{k}" for k in tests)
    long = agg.select(protocol, "n_models", F.expr(f"stack({len(tests)}, {stack}) AS (rule, met)"))
    fireable = (~c("rule").isin("b", "b_prime")) | ((c("rule") == "b") & (c(protocol) == "secondary")) | ((c("rule") == "b_prime") & (c(protocol) == "primary"))
    return long.select(protocol, "rule", fireable.alias("fireable"), (fireable & c("met") & (c("n_models") >= 2)).alias("fires"))


def decisive_clean_column(kappa: Column) -> Column:
    return F.when(F.coalesce((kappa >= KAPPA_MIN) & ~F.isnan(kappa), F.lit(False)), "remove_clean_verifier").otherwise("remove_clean_human")


def with_decisive(rel: DataFrame, kappa: DataFrame, name: str = "decisive") -> DataFrame:
    """Adds the clean column that counts: the verifier's where people agree with it (``kappa``: one row), else theirs."""
    one = kappa.agg(F.max("kappa").alias("_kappa"))  # also no row gives one
    chosen = decisive_clean_column(F.col("_kappa"))
    return rel.join(F.broadcast(one)).withColumn(name, F.when(chosen == "remove_clean_verifier", F.col("remove_clean_verifier")).otherwise(F.col("remove_clean_human"))).drop("_kappa")
