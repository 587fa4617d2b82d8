"""Item tables: scope, derived columns, scene eligibility, conditions, scored answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import text as T
from plumbline.operators import greedy
from plumbline.operators.ranks import hash_rank
from plumbline.operators.windows import left_to_right

# Fixed values of scene hygiene and scope.
MAX_SCOPE_AREA = 0.30
MIN_SIBLING_AREA, MIN_TARGET_AREA, MAX_TARGET_ASPECT, MIN_TARGET_AREA_AT_BORDER = 0.0015, 0.01, 4.0, 0.04
MIN_CANDIDATES, MAX_CANDIDATES, MAX_NESTING, MAX_TARGET_OVERLAP, MAX_COVER = 3, 8, 0.7, 0.3, 0.6
NULL_EXPRESSION = "the object"
IMAGE_CONDITIONS, TEXT_CONDITIONS = ("REMOVE", "CONTROL_OBJ", "CONTROL_BG"), ("T_NULL", "T_HEAD", "T_ATTR")


def clean_boxes(boxes: DataFrame, min_area: float) -> DataFrame:
    """Single, real, confident boxes above an area floor, with their normalised area."""
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    return boxes.filter("is_group = 0 AND is_depiction = 0 AND confidence = 1").withColumn("area", area).filter(F.col("area") >= min_area)


def licence_pool(images: DataFrame, boxes: DataFrame, licence: str, lo: float, hi: float, n: int = 0, seed="pool") -> DataFrame:
    """Images with the licence that carry at least one clean box inside an area band, with their ``rank`` in a seeded
    order: those beyond the first ``n`` are the surplus to walk on with. Fewer than ``n`` images are an error of the
    job that reads them; ``n`` = 0 takes what there is."""
    good = clean_boxes(boxes, lo).filter(F.col("area") <= hi).select("image_id")
    pool = hash_rank(images.filter(F.col("licence").contains(licence)).join(good, "image_id", "left_semi"), seed, ["image_id"])
    if not n:
        return pool
    total = pool.agg(F.count("*").alias("_total"))
    short = F.raise_error(F.concat(F.lit(f"{n} images are asked for, and "), F.col("_total").cast("string"), F.lit(" have the licence and a box in the band"))).cast("boolean")
    # a row of its own that is never returned: it raises or goes, also where the pool is empty
    guard = total.where(F.when(F.col("_total") < n, short).otherwise(F.lit(False))).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in pool.schema])
    return pool.unionByName(guard)


def item_scope(df: DataFrame, box: Column, w, h, max_area: float = MAX_SCOPE_AREA) -> DataFrame:
    """Adds n_gt, area_frac and in_scope: positive single-box items of limited area."""
    frac = F.when(box.isNull(), 0.0).otherwise(F.abs(G.width(box) * G.height(box)) / (G.num(w) * G.num(h)).cast("double"))
    return df.withColumn("n_gt", F.when(box.isNull(), 0).otherwise(1)).withColumn("area_frac", frac).withColumn("in_scope", box.isNotNull() & (frac <= max_area))


def scene_flags(inst: DataFrame, image: str, w, h) -> DataFrame:
    """(image, reason): why a scene is not usable, from its referent and same-class siblings;
    null when it is. ``inst`` has iid, box, area_frac, is_target, allowed."""
    b = F.col("box")
    ref = inst.filter("is_target").select(image, F.col("box").alias("rb"), F.col("area_frac").alias("ra"), F.col("allowed"))
    sib = inst.filter(~F.col("is_target") & (F.col("area_frac") >= MIN_SIBLING_AREA)).select(image, b.alias("sb"))
    r = F.col("rb")
    bw, bh = F.greatest(G.width(r), F.lit(1.0)), F.greatest(G.height(r), F.lit(1.0))
    border = (r["x0"] <= 2) | (r["y0"] <= 2) | (r["x1"] >= G.num(w) - 2) | (r["y1"] >= G.num(h) - 2)
    j = ref.join(sib, image, "left")
    s = F.col("sb")
    agg = j.groupBy(image, "rb", "ra", "allowed").agg(
        F.bool_or(F.coalesce(G.containment(r, s) >= MAX_NESTING, F.lit(False))).alias("nested"), F.bool_or(F.coalesce(G.iou(r, s) > MAX_TARGET_OVERLAP, F.lit(False))).alias("overlaps"),
        F.bool_or(F.coalesce(G.width(s) * G.height(s) > F.lit(MAX_COVER) * G.num(w) * G.num(h), F.lit(False))).alias("covers"))
    reason = (F.when(~F.col("allowed"), "label").when(F.col("ra") < MIN_TARGET_AREA, "target_area").when(F.greatest(bw / bh, bh / bw) > MAX_TARGET_ASPECT, "aspect")
              .when(border & (F.col("ra") < MIN_TARGET_AREA_AT_BORDER), "border").when(F.col("nested"), "target_nested").when(F.col("overlaps"), "target_overlap").when(F.col("covers"), "cover"))
    return agg.select(image, reason.alias("reason"))


def build_scenes(inst: DataFrame, image: str, w: int, h: int) -> DataFrame:
    """Candidates of usable scenes with left-to-right ids: referent, then siblings that survive
    the hygiene pass, 3 to 8 in all, the largest when there are more."""
    from pyspark.sql import Window

    usable = scene_flags(inst, image, w, h).filter("reason IS NULL").select(image)
    d = inst.join(usable, image, "left_semi")
    ref = d.filter("is_target").select(image, F.col("box").alias("_rb"))
    sib = d.filter(~F.col("is_target") & (F.col("area_frac") >= MIN_SIBLING_AREA)).join(ref, image).filter(G.containment(F.col("box"), F.col("_rb")) < MAX_NESTING).drop("_rb")
    kept = greedy.greedy_keep(sib, image, "iid", "box", F.col("area_frac"), (w, h))
    both = d.filter("is_target").unionByName(kept)
    rank = Window.partitionBy(image).orderBy(F.when(F.col("is_target"), 0).otherwise(1), F.col("area_frac").desc(), F.col("iid"))
    capped = both.withColumn("_rk", F.row_number().over(rank)).filter(F.col("_rk") <= MAX_CANDIDATES).drop("_rk")
    enough = capped.groupBy(image).agg(F.count("*").alias("n_candidates")).filter(F.col("n_candidates") >= MIN_CANDIDATES)
    return left_to_right(capped.join(enough, image), image, F.col("box.x0"), "iid", "place")


def expand_conditions(items: DataFrame, conditions: tuple[str, ...]) -> DataFrame:
    """(item x condition) with the expression and edit operator to use, or a skip reason.

    Needs expr, head_noun, absent_category, attr_expr, hole_type. The condition list is a
    literal array next to the row, not a join."""
    c = F.col("condition")
    d = items.withColumn("condition", F.explode(F.array(*[F.lit(x) for x in conditions])))
    swap = T.swap_noun(F.col("expr"), F.col("head_noun"), F.col("absent_category"))
    d = d.withColumn("_swap", F.when(c == "T_HEAD", swap))
    missing = (F.coalesce("head_noun", F.lit("")) == "") | (F.coalesce("absent_category", F.lit("")) == "")
    reason = (F.when((c == "T_HEAD") & missing, "no_head_or_category").when((c == "T_HEAD") & (F.col("_swap.hits") == 0), "head_not_in_expression")
              .when((c == "T_ATTR") & (F.coalesce("attr_expr", F.lit("")) == ""), "no_attribute_rewrite"))
    expr = F.when(c == "T_NULL", NULL_EXPRESSION).when(c == "T_HEAD", F.col("_swap.text")).when(c == "T_ATTR", F.col("attr_expr")).otherwise(F.col("expr"))
    prefix = F.when(F.col("hole_type") == "mask", "").otherwise("RECT_")
    return (d.withColumn("skip_reason", reason).withColumn("sent_expr", F.when(F.col("skip_reason").isNull(), expr))
            .withColumn("operator", F.when(c.isin(*IMAGE_CONDITIONS), F.concat(prefix, c))).drop("_swap"))


def score_outputs(df: DataFrame, condition: Column, gt: Column, box: Column, px: Column, py: Column) -> DataFrame:
    """Adds iou_gt, point_in_gt and is_failure, defined on ORIGINAL rows with a true box only."""
    live = (condition == "ORIGINAL") & gt.isNotNull()
    by_box, by_point = live & box.isNotNull(), live & box.isNull() & px.isNotNull()
    d = df.withColumn("iou_gt", F.when(by_box, G.iou(box, gt))).withColumn("point_in_gt", F.when(by_point, G.point_in_box(px, py, gt)))
    return d.withColumn("is_failure", F.when(by_box, F.col("iou_gt") < 0.5).when(by_point, ~F.col("point_in_gt")).when(live, True))


def group_label(set_name: Column, dimension: Column, kind: Column, sub: Column) -> Column:
    """Benchmark group of a row."""
    return (F.when(set_name == "gme", F.when(dimension == "Rejection", "gme_rej").otherwise("gme_pos")).when(set_name == "refcoco", sub)
            .when(set_name == "prbench_dev", F.concat(F.lit("pr_"), sub)).when(set_name == "own", F.when(kind == "negative", "own_neg").otherwise("own_pos")))
