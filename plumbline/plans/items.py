"""Projections and predicates over derived items and instances."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import text as T
from plumbline.operators import items as IT
from plumbline.operators import joins as J
from plumbline.plans.geometry import gt, sql_iou
from plumbline.plans.registry import query
from plumbline.plans.tables import with_tables
from plumbline.plans.windows import INNER
from plumbline.session import hash_side

col = F.col

POOL = """
SELECT l_orderkey AS image_id, l_linenumber AS line, l_partkey AS pk, x0 / 1000.0e0 AS xmin, x1 / 1000.0e0 AS xmax, y0 / 800.0e0 AS ymin, y1 / 800.0e0 AS ymax, CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS is_group,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_depiction, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS confidence FROM (SELECT *, CAST((l_partkey * 37 + l_linenumber * 101) % 800 AS DOUBLE) AS x0,
  CAST((l_partkey * 37 + l_linenumber * 101) % 800 + 20 + l_partkey % 180 AS DOUBLE) AS x1, CAST((l_suppkey * 53 + l_linenumber * 71) % 650 AS DOUBLE) AS y0, CAST((l_suppkey * 53 + l_linenumber * 71) % 650 + 20 + (l_suppkey * 7) % 130 AS DOUBLE) AS y1 FROM lineitem) z"""
CLEAN = f"SELECT image_id, line, pk, (xmax - xmin) * (ymax - ymin) AS area FROM ({POOL}) p WHERE is_group = 0 AND is_depiction = 0 AND confidence = 1 AND (xmax - xmin) * (ymax - ymin) >= 0.005"


@query("clean_boxes", CLEAN)
def clean_boxes(t):
    return IT.clean_boxes(t.sql(POOL), 0.005).select("image_id", "line", "pk", "area")


@query("licence_filter_and_band", f"SELECT o_orderkey AS image_id, row_number() OVER (ORDER BY md5('pool:' || o_orderkey), o_orderkey) AS rank FROM orders WHERE o_orderpriority LIKE '%HIGH%' AND o_orderkey IN (SELECT image_id FROM ({CLEAN}) c WHERE area <= 0.02)")
def licence_filter_and_band(t):
    images = t.orders.select(col("o_orderkey").alias("image_id"), col("o_orderpriority").alias("licence"))
    return IT.licence_pool(images, t.sql(POOL), "HIGH", 0.005, 0.02, 5).select("image_id", "rank")


@query("item_scope", with_tables("items", """
WITH a AS (SELECT item_id, no_target, CASE WHEN no_target THEN 0.0e0 ELSE abs((gx1 - gx0) * (gy1 - gy0)) / CAST(200 * 160 AS DOUBLE) END AS area_frac FROM items)
SELECT item_id, CASE WHEN no_target THEN 0 ELSE 1 END AS n_gt, area_frac, NOT no_target AND area_frac <= 0.3 AS in_scope FROM a"""))
def item_scope(t):
    b = F.when(~col("no_target"), G.box(col("gx0"), col("gy0"), col("gx1"), col("gy1")))
    return IT.item_scope(t.items, b, 200, 160).select("item_id", "n_gt", "area_frac", "in_scope")


@query("derived_item_columns", with_tables("items", """
WITH s AS (SELECT *, greatest(gx1 - gx0, gy1 - gy0) AS s FROM items) SELECT item_id, CASE WHEN no_target THEN 0 ELSE 1 END AS n_gt, CASE WHEN no_target THEN NULL WHEN s < 32 THEN 'tiny' WHEN s < 96 THEN 'small' WHEN s < 224 THEN 'medium'
  WHEN s < 448 THEN 'large' ELSE 'xl' END AS size_bin, CASE WHEN NOT no_target THEN gx0 END AS first_x0, 'img/' || item_id || '.jpg' AS image_path FROM s"""))
def derived_item_columns(t):
    boxes = F.when(col("no_target"), F.array().cast("array<array<int>>")).otherwise(F.array(F.array(*[col(c).cast("int") for c in ("gx0", "gy0", "gx1", "gy1")])))
    d = t.items.select("item_id", F.transform(boxes, lambda b: F.transform(b, lambda v: v.cast("double"))).alias("boxes"), F.concat(F.lit("/data/root/img/"), col("item_id").cast("string"), F.lit(".jpg")).alias("p"))
    first = F.try_element_at("boxes", F.lit(1))
    return d.select("item_id", F.size("boxes").alias("n_gt"), G.size_bin(G.box_of_array(first)).alias("size_bin"), F.get(first, F.lit(0)).alias("first_x0"), F.regexp_replace("p", "^/data/root/", "").alias("image_path"))


@query("size_bin", with_tables("boxes", """
WITH s AS (SELECT image_id, line, partkey, suppkey, greatest(x1 - x0, (y1 - y0) * 3.5e0) AS s FROM boxes)
SELECT image_id, line, partkey, suppkey, CASE WHEN s < 32 THEN 'tiny' WHEN s < 96 THEN 'small' WHEN s < 224 THEN 'medium' WHEN s < 448 THEN 'large' ELSE 'xl' END AS size_bin FROM s"""))
def size_bin(t):
    b = G.box(col("x0"), 0, col("x1"), (col("y1") - col("y0")) * 3.5)
    return t.boxes.select("image_id", "line", "partkey", "suppkey", G.size_bin(b).alias("size_bin"))


@query("hole_area_bin", with_tables("boxes", """
WITH s AS (SELECT image_id, line, partkey, suppkey, (x1 - x0) * (y1 - y0) / 300000.0e0 AS f FROM boxes)
SELECT image_id, line, partkey, suppkey, CASE WHEN f < 0.01 THEN '0.5-1%' WHEN f < 0.02 THEN '1-2%' WHEN f < 0.05 THEN '2-5%' ELSE '5-15%' END AS hole_bin FROM s"""))
def hole_area_bin(t):
    return t.boxes.select("image_id", "line", "partkey", "suppkey", G.hole_area_bin(G.area(gt()) / 300000.0).alias("hole_bin"))


def scene_inst(t):
    i = t.inst.filter("source IN ('referent', 'same_class_other_instance')")
    return i.select("image_id", "iid", gt().alias("box"), "area_frac", (col("source") == "referent").alias("is_target"), (col("label") != "Brand#7").alias("allowed"))


SQL_FLAGS = f"""
r AS (SELECT * FROM inst WHERE source = 'referent'), s AS (SELECT * FROM inst WHERE source = 'same_class_other_instance' AND area_frac >= 0.0015),
f AS (SELECT r.image_id, bool_or(coalesce({INNER.replace('rk.', 'r.').replace('b.', 's.')} / greatest(1e-6, (r.x1 - r.x0) * (r.y1 - r.y0)) >= 0.7, false)) AS nested, bool_or(coalesce({sql_iou('r.', 's.')} > 0.3, false)) AS ov,
  bool_or(coalesce((s.x1 - s.x0) * (s.y1 - s.y0) > 0.6e0 * 1000 * 800, false)) AS cov FROM r LEFT JOIN s ON s.image_id = r.image_id GROUP BY 1),
fl AS (SELECT r.image_id, CASE WHEN label = 'Brand#7' THEN 'label' WHEN area_frac < 0.01 THEN 'target_area' WHEN greatest(greatest(x1 - x0, 1) / greatest(y1 - y0, 1), greatest(y1 - y0, 1) / greatest(x1 - x0, 1)) > 4 THEN 'aspect'
  WHEN (x0 <= 2 OR y0 <= 2 OR x1 >= 998 OR y1 >= 798) AND area_frac < 0.04 THEN 'border' WHEN nested THEN 'target_nested' WHEN ov THEN 'target_overlap' WHEN cov THEN 'cover' END AS reason FROM r JOIN f USING (image_id))"""


@query("scene_eligibility", with_tables("inst", f"""
WITH RECURSIVE {SQL_FLAGS.strip()}, u AS (SELECT image_id FROM fl WHERE reason IS NULL),
k AS (SELECT s.* FROM s JOIN r ON r.image_id = s.image_id WHERE s.image_id IN (SELECT image_id FROM u) AND {INNER.replace('rk.', 's.').replace('b.', 'r.')} / greatest(1e-6, (s.x1 - s.x0) * (s.y1 - s.y0)) < 0.7),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area_frac DESC, iid) AS rk FROM k),
g AS (SELECT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(iid BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[]) AS kept FROM u
 UNION ALL SELECT g.image_id, k + 1, CASE WHEN len(list_filter(kept, lambda b: {INNER} / greatest(1e-6, (rk.x1 - rk.x0) * (rk.y1 - rk.y0)) >= 0.7 OR {sql_iou('rk.', 'b.')} > 0.5)) > 0 THEN kept
   ELSE list_append(kept, {{'iid': rk.iid, 'x0': rk.x0, 'y0': rk.y0, 'x1': rk.x1, 'y1': rk.y1}}) END FROM g JOIN rk ON rk.image_id = g.image_id AND rk.rk = k + 1),
kp AS (SELECT image_id, z.iid AS iid FROM (SELECT image_id, unnest(arg_max(kept, k)) AS z FROM g GROUP BY 1) q),
a AS (SELECT i.*, CASE WHEN source = 'referent' THEN 0 ELSE 1 END AS o FROM inst i WHERE (source = 'referent' AND image_id IN (SELECT image_id FROM u)) OR (image_id, iid) IN (SELECT image_id, iid FROM kp)),
c AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY o, area_frac DESC, iid) AS q FROM a), e AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS n_candidates FROM c WHERE q <= 8)
SELECT image_id, iid, n_candidates, row_number() OVER (PARTITION BY image_id ORDER BY x0, iid) AS place FROM e WHERE n_candidates >= 3"""))
def scene_eligibility(t):
    return IT.build_scenes(scene_inst(t), "image_id", 1000, 800).select("image_id", "iid", "n_candidates", "place")


@query("area_band_filter", with_tables("inst", "SELECT image_id, iid, area_frac FROM inst WHERE area_frac > 0 AND area_frac BETWEEN 0.005 AND 0.015"))
def area_band_filter(t):
    return t.inst.filter((col("area_frac") > 0) & col("area_frac").between(0.005, 0.015)).select("image_id", "iid", "area_frac")


@query("operator_normalise", with_tables("boxes", """
WITH o AS (SELECT image_id, line, partkey, CASE WHEN suppkey % 2 = 0 THEN 'RECT_' ELSE '' END || CASE partkey % 4 WHEN 0 THEN 'REMOVE' WHEN 1 THEN 'CONTROL_OBJ' WHEN 2 THEN 'CONTROL_OBJ_2' ELSE 'CONTROL_BG' END AS op FROM boxes)
SELECT image_id, line, partkey, op, CASE WHEN replace(op, 'RECT_', '') IN ('REMOVE', 'CONTROL_OBJ') THEN replace(op, 'RECT_', '') END AS base FROM o"""))
def operator_normalise(t):
    op = F.concat(F.when(col("suppkey") % 2 == 0, "RECT_").otherwise(""), F.element_at(F.array(*[F.lit(x) for x in ("REMOVE", "CONTROL_OBJ", "CONTROL_OBJ_2", "CONTROL_BG")]), (col("partkey") % 4 + 1).cast("int")))
    return t.boxes.select("image_id", "line", "partkey", op.alias("op"), J.operator_class(op).alias("base"))


@query("verifiable_source", with_tables("inst", "SELECT image_id, iid, source, source NOT IN ('class_agnostic', 'background') AND iid % 3 > 0 AS verifiable FROM inst"))
def verifiable_source(t):
    src = F.when(col("iid") % 3 > 0, col("source"))
    return t.inst.select("image_id", "iid", "source", J.verifiable(src).alias("verifiable"))


@query("group_label", with_tables("evals", """
SELECT item_id, CASE grp % 4 WHEN 0 THEN CASE WHEN dimension = 'HIGH' THEN 'gme_rej' ELSE 'gme_pos' END WHEN 1 THEN lower(dimension) WHEN 2 THEN 'pr_' || lower(dimension) ELSE CASE WHEN kind = 'negative' THEN 'own_neg' ELSE 'own_pos' END END AS grp_label FROM evals"""))
def group_label(t):
    s = F.element_at(F.array(*[F.lit(x) for x in ("gme", "refcoco", "prbench_dev", "own")]), (col("grp") % 4 + 1).cast("int"))
    d = F.when(col("dimension") == "HIGH", "Rejection").otherwise(col("dimension"))
    return t.evals.select("item_id", IT.group_label(s, d, col("kind"), F.lower("dimension")).alias("grp_label"))


@query("head_noun_map", """
WITH l AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Land vehicle' WHEN 1 THEN 'Mammal' WHEN 2 THEN 'Coffee cup' ELSE p_type END AS label FROM part)
SELECT p_partkey, label, CASE label WHEN 'Land vehicle' THEN 'vehicle' WHEN 'Mammal' THEN 'animal' WHEN 'Coffee cup' THEN 'cup' ELSE lower(label) END AS noun FROM l""")
def head_noun_map(t):
    label = F.when(col("p_size") % 5 == 0, "Land vehicle").when(col("p_size") % 5 == 1, "Mammal").when(col("p_size") % 5 == 2, "Coffee cup").otherwise(col("p_type"))
    return t.part.select("p_partkey", label.alias("label"), T.head_noun(label).alias("noun"))


COND_ITEMS = """
SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'The cups by the door' ELSE 'A red lamp' END AS expr, CASE WHEN item_id % 4 > 0 THEN 'cup' END AS head_noun, CASE WHEN item_id % 7 > 0 THEN 'tractor' END AS absent_category,
  CASE WHEN item_id % 2 = 0 THEN 'A blue lamp' END AS attr_expr, CASE WHEN custkey % 2 = 0 THEN 'mask' ELSE 'rect' END AS hole_type FROM items"""


@query("condition_resolution", with_tables("items", f"""
WITH i AS ({COND_ITEMS}), x AS (SELECT i.*, condition FROM i, (VALUES ('ORIGINAL'), ('REMOVE'), ('CONTROL_OBJ'), ('CONTROL_BG'), ('T_NULL'), ('T_HEAD'), ('T_ATTR')) c(condition)),
r AS (SELECT *, CASE WHEN condition = 'T_HEAD' AND (head_noun IS NULL OR absent_category IS NULL) THEN 'no_head_or_category' WHEN condition = 'T_HEAD' AND expr NOT LIKE '%cups%' THEN 'head_not_in_expression'
  WHEN condition = 'T_ATTR' AND attr_expr IS NULL THEN 'no_attribute_rewrite' END AS skip_reason FROM x)
SELECT item_id, condition, skip_reason, CASE WHEN skip_reason IS NULL THEN CASE condition WHEN 'T_NULL' THEN 'the object' WHEN 'T_HEAD' THEN 'The tractor by the door' WHEN 'T_ATTR' THEN attr_expr ELSE expr END END AS sent_expr,
  CASE WHEN condition IN ('REMOVE', 'CONTROL_OBJ', 'CONTROL_BG') THEN CASE hole_type WHEN 'mask' THEN '' ELSE 'RECT_' END || condition END AS operator FROM r"""))
def condition_resolution(t):
    from plumbline.sources.schemas import CONDITIONS

    return IT.expand_conditions(t.sql(COND_ITEMS), CONDITIONS).select("item_id", "condition", "skip_reason", "sent_expr", "operator")


@query("output_row_scoring", with_tables("preds", f"""
WITH j AS (SELECT p.item_id, condition, proto, ptype, CASE WHEN condition <> 'ORIGINAL' OR no_target THEN NULL ELSE gx0 END AS gx0, gy0, gx1, gy1, p.x0, p.y0, p.x1, p.y1, condition = 'ORIGINAL' AND NOT no_target AS live FROM preds p JOIN items i ON i.item_id = p.item_id),
s AS (SELECT *, CASE WHEN live AND x0 IS NOT NULL AND h[['asp:' || item_id]] % 3 > 0 THEN {sql_iou('', 'g')} END AS iou_gt,
  CASE WHEN live AND x0 IS NOT NULL AND h[['asp:' || item_id]] % 3 = 0 THEN x0 + 30 BETWEEN gx0 AND gx1 AND y0 + 9 BETWEEN gy0 AND gy1 END AS point_in_gt FROM j)
SELECT item_id, condition, proto, iou_gt, point_in_gt, CASE WHEN iou_gt IS NOT NULL THEN iou_gt < 0.5 WHEN point_in_gt IS NOT NULL THEN NOT point_in_gt WHEN live THEN true END AS is_failure FROM s"""))
def output_row_scoring(t):
    i = t.sql("SELECT item_id, no_target, gx0, gy0, gx1, gy1, h[['asp:' || item_id]] % 3 = 0 AS as_point FROM items")
    d = t.preds.join(hash_side(i), "item_id")
    box = F.when((col("ptype") == "box") & ~col("as_point"), G.box(col("x0"), col("y0"), col("x1"), col("y1")))
    pt = (col("ptype") == "box") & col("as_point")
    g = F.when(~col("no_target"), G.box(col("gx0"), col("gy0"), col("gx1"), col("gy1")))
    return IT.score_outputs(d, col("condition"), g, box, F.when(pt, col("x0") + 30), F.when(pt, col("y0") + 9)).select("item_id", "condition", "proto", "iou_gt", "point_in_gt", "is_failure")
