"""Box and grid geometry over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import boxes as B
from plumbline.plans.registry import query
from plumbline.plans.tables import FRAME_H, FRAME_W, with_tables

KEYS = ["image_id", "line", "partkey", "suppkey"]


def gt():
    return G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))


def pred():
    return G.box(F.col("px0"), F.col("py0"), F.col("px1"), F.col("py1"))


INTER = ("greatest(0.0e0, least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) * "
         "greatest(0.0e0, least({a}y1, {b}y1) - greatest({a}y0, {b}y0))")


def sql_iou(a: str, b: str) -> str:
    """IoU in SQL; ``a`` and ``b`` prefix the coordinate names (``p`` or ``t.`` or ``t.p``)."""
    inter = INTER.format(a=a, b=b)
    def area(p):
        return f"greatest(0.0e0, {p}x1 - {p}x0) * greatest(0.0e0, {p}y1 - {p}y0)"
    union = f"({area(a)} + {area(b)} - {inter})"
    return f"CASE WHEN {a}x0 IS NULL OR {b}x0 IS NULL THEN NULL WHEN {union} > 0 THEN ({inter}) / {union} ELSE 0.0e0 END"


K = "image_id, line, partkey, suppkey"


@query("box_iou", with_tables("boxes", f"SELECT {K}, {sql_iou('p', '')} AS iou FROM boxes"))
def box_iou(t):
    return t.boxes.select(*KEYS, G.iou(pred(), gt()).alias("iou"))


@query("box_area_and_side", with_tables("boxes", f"""
SELECT {K}, greatest(0.0e0, px1 - x0) * greatest(0.0e0, py1 - y0) AS area, greatest(px1 - x0, py1 - y0) AS longer FROM boxes"""))
def box_area_and_side(t):
    b = G.box(F.col("x0"), F.col("y0"), F.col("px1"), F.col("py1"))
    return t.boxes.select(*KEYS, G.area(b).alias("area"), G.longer_side(b).alias("longer"))


@query("box_containment", with_tables("boxes", f"""
SELECT {K}, {INTER.format(a='p', b='')} / greatest(1e-6, (px1 - px0) * (py1 - py0)) AS contained,
  {INTER.format(a='p', b='')} >= 0.9e0 * (px1 - px0) * (py1 - py0) AS is_inside FROM boxes"""))
def box_containment(t):
    return t.boxes.select(*KEYS, G.containment(pred(), gt()).alias("contained"), G.inside(pred(), gt()).alias("is_inside"))


@query("box_clamp", with_tables("boxes", f"""
WITH c AS (SELECT {K}, greatest(0.0e0, least(px1 + 60, 1000.0e0)) AS xa, greatest(0.0e0, least(px0 - 10, 1000.0e0)) AS xb,
  greatest(0.0e0, least(py0 - 15, 800.0e0)) AS ya, greatest(0.0e0, least(py1 + 40, 800.0e0)) AS yb FROM boxes)
SELECT {K}, least(xa, xb) AS x0, least(ya, yb) AS y0, greatest(xa, xb) AS x1, greatest(ya, yb) AS y1 FROM c"""))
def box_clamp(t):
    rough = G.box(F.col("px1") + 60, F.col("py0") - 15, F.col("px0") - 10, F.col("py1") + 40)
    return t.boxes.select(*KEYS, *G.fields(G.clamp(rough, FRAME_W, FRAME_H)))


@query("coordinate_convert", with_tables("items", """
WITH c AS (SELECT *, CASE item_id % 3 WHEN 0 THEN 'relative_1000' WHEN 1 THEN 'percent_float' ELSE 'absolute_resized' END AS convention,
   500 + custkey % 300 AS sw, 400 + custkey % 200 AS sh FROM items),
s AS (SELECT *, CASE convention WHEN 'relative_1000' THEN w / 1000.0e0 WHEN 'percent_float' THEN w / 100.0e0 ELSE CAST(w AS DOUBLE) / sw END AS sx,
   CASE convention WHEN 'relative_1000' THEN h / 1000.0e0 WHEN 'percent_float' THEN h / 100.0e0 ELSE CAST(h AS DOUBLE) / sh END AS sy FROM c)
SELECT item_id, convention, gx0 * sx AS x0, gy0 * sy AS y0, gx1 * sx AS x1, gy1 * sy AS y1 FROM s"""))
def coordinate_convert(t):
    d = t.items.withColumn("convention", F.element_at(F.array(F.lit("relative_1000"), F.lit("percent_float"), F.lit("absolute_resized")),
                                                      (F.col("item_id") % 3 + 1).cast("int")))
    b = G.box(F.col("gx0"), F.col("gy0"), F.col("gx1"), F.col("gy1"))
    out = G.to_original_pixels(b, F.col("convention"), F.col("w"), F.col("h"), 500 + F.col("custkey") % 300, 400 + F.col("custkey") % 200)
    return d.select("item_id", "convention", out.alias("b")).select("item_id", "convention", *G.fields(F.col("b")))


@query("normalised_boxes_to_pixels", with_tables("boxes", """
SELECT image_id, x0 / 1000.0e0 * o_custkey AS x0, y0 / 1000.0e0 * (o_custkey + 50) AS y0, x1 / 1000.0e0 * o_custkey AS x1,
  y1 / 1000.0e0 * (o_custkey + 50) AS y1, lab.labels
FROM boxes JOIN orders ON image_id = o_orderkey
JOIN (SELECT image_id AS i2, string_agg(p_brand, '; ' ORDER BY p_brand) AS labels
      FROM (SELECT DISTINCT image_id, p_brand FROM boxes JOIN part ON partkey = p_partkey) d GROUP BY 1) lab ON lab.i2 = image_id
WHERE o_orderstatus <> 'P'"""))
def normalised_boxes_to_pixels(t):
    norm = [(F.col(c) / 1000.0).alias(c) for c in ("x0", "y0", "x1", "y1")]
    boxes = t.boxes.select("image_id", "partkey", *norm)
    part = t.part.select(F.col("p_partkey").alias("partkey"), F.col("p_brand").alias("label"))
    images = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("image_id"), F.col("o_custkey").alias("w"),
                                                            (F.col("o_custkey") + 50).alias("h"))
    return B.pool_to_items(boxes.join(part, "partkey"), images).select("image_id", *G.fields(F.col("box")), "labels")


@query("relative_1000", with_tables("items", """
SELECT item_id, least(1000, greatest(0, CAST(round_even(gx0 * 1000 / (custkey + 300), 0) AS INT))) AS r0,
  least(1000, greatest(0, CAST(round_even(gy0 * 1000 / (custkey + 200), 0) AS INT))) AS r1,
  least(1000, greatest(0, CAST(round_even(gx1 * 1000 / (custkey + 300), 0) AS INT))) AS r2,
  least(1000, greatest(0, CAST(round_even(gy1 * 1000 / (custkey + 200), 0) AS INT))) AS r3 FROM items"""))
def relative_1000(t):
    b = G.box(F.col("gx0"), F.col("gy0"), F.col("gx1"), F.col("gy1"))
    r = G.relative_1000(b, F.col("custkey") + 300, F.col("custkey") + 200)
    return t.items.select("item_id", *[r[i].alias(f"r{i}") for i in range(4)])


def _scaled(p, fx, fy):
    return f"SELECT *, {p}x0{fx} AS qx0, {p}y0{fy} AS qy0, {p}x1{fx} AS qx1, {p}y1{fy} AS qy1"


@query("best_of_readings", with_tables("boxes", f"""
WITH a AS (SELECT {K}, x0, y0, x1, y1, x0 + suppkey % 9 AS ax0, y0 * 1.25e0 AS ay0, x1 + suppkey % 9 AS ax1, y1 * 1.25e0 AS ay1 FROM boxes),
b AS (SELECT *, CASE WHEN greatest(ax0, ay0, ax1, ay1) <= 1 THEN ax0 * 1000.0e0 ELSE ax0 / 999 * 1000.0e0 END AS bx0,
  CASE WHEN greatest(ax0, ay0, ax1, ay1) <= 1 THEN ay0 * 800.0e0 ELSE ay0 / 999 * 800.0e0 END AS by0,
  CASE WHEN greatest(ax0, ay0, ax1, ay1) <= 1 THEN ax1 * 1000.0e0 ELSE ax1 / 999 * 1000.0e0 END AS bx1,
  CASE WHEN greatest(ax0, ay0, ax1, ay1) <= 1 THEN ay1 * 800.0e0 ELSE ay1 / 999 * 800.0e0 END AS by1,
  ax0 * (1000.0e0 / 1000.0e0) + 0.0e0 AS cx0, ay0 * (800.0e0 / 1000.0e0) + 0.0e0 AS cy0,
  ax1 * (1000.0e0 / 1000.0e0) + 0.0e0 AS cx1, ay1 * (800.0e0 / 1000.0e0) + 0.0e0 AS cy1 FROM a),
s AS (SELECT {K}, {sql_iou('a', '')} AS absolute, {sql_iou('b', '')} AS over_999, {sql_iou('c', '')} AS over_1000 FROM b)
SELECT *, greatest(absolute, over_999) AS oracle FROM s"""))
def best_of_readings(t):
    raw = G.box(F.col("x0") + F.col("suppkey") % 9, F.col("y0") * 1.25, F.col("x1") + F.col("suppkey") % 9, F.col("y1") * 1.25)
    r = {k: G.iou(v, gt()) for k, v in G.readings(raw, FRAME_W, FRAME_H).items()}
    return t.boxes.select(*KEYS, *[v.alias(k) for k, v in r.items()], F.greatest(r["absolute"], r["over_999"]).alias("oracle"))


@query("convention_probe", with_tables("boxes", """
WITH v AS (SELECT flag AS model, unnest([x0, y0, x1, y1]) AS big,
   unnest(CASE flag WHEN 'A' THEN [x0, y0, x1, y1] WHEN 'N' THEN [x0 * 0.5e0, y0 * 0.5e0, x1 * 0.5e0, y1 * 0.5e0]
          ELSE [x0 * 0.8e0, y0 * 0.8e0, x1 * 0.8e0, y1 * 0.8e0] END) AS small FROM boxes),
g AS (SELECT model, quantile_cont(small / big, 0.5) AS ratio, max(greatest(big, small)) AS largest, count(*) AS n FROM v WHERE big > 0 GROUP BY model)
SELECT *, CASE WHEN abs(ratio - 1) < 0.08 AND largest > 100 THEN 'relative_1000' WHEN abs(ratio - 1) < 0.08 THEN 'percent_float'
  WHEN abs(ratio - 0.5e0) < 0.12 THEN 'absolute_resized' ELSE 'UNDECIDED' END AS convention FROM g"""))
def convention_probe(t):
    factor = F.when(F.col("flag") == "A", 1.0).when(F.col("flag") == "N", 0.5).otherwise(0.8)
    pairs = t.boxes.select(F.col("flag").alias("model"), gt().alias("big"), G.scale_box(gt(), factor, factor).alias("small"))
    return B.convention_probe(pairs, ["model"], F.lit(0.5))


@query("point_in_box", with_tables("boxes", f"""
SELECT {K}, (px0 + px1) / 2 BETWEEN x0 AND x1 AND (py0 + py1) / 2 BETWEEN y0 AND y1 AS centre_hit,
  px0 BETWEEN x0 AND x1 AND py0 BETWEEN y0 AND y1 AS corner_hit FROM boxes"""))
def point_in_box(t):
    return t.boxes.select(*KEYS, G.point_in_box((F.col("px0") + F.col("px1")) / 2, (F.col("py0") + F.col("py1")) / 2, gt()).alias("centre_hit"),
                          G.point_in_box(F.col("px0"), F.col("py0"), gt()).alias("corner_hit"))


@query("boxes_overlap", with_tables("cand", """
SELECT a.image_id, a.iid AS a_iid, b.iid AS b_iid FROM cand a JOIN cand b ON a.image_id = b.image_id AND a.iid < b.iid
WHERE a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"""))
def boxes_overlap(t):
    c = t.cand.select("image_id", "iid", gt().alias("box"))
    return B.overlapping_pairs(c, "image_id", "iid", "box", FRAME_W, FRAME_H).select("image_id", "a_iid", "b_iid")


@query("point_and_box_scale", with_tables("boxes", f"""
SELECT {K}, x0 * 0.5e0 + suppkey AS x0, y0 * 0.75e0 + 12.5e0 AS y0, x1 * 0.5e0 + suppkey AS x1, y1 * 0.75e0 + 12.5e0 AS y1 FROM boxes"""))
def point_and_box_scale(t):
    return t.boxes.select(*KEYS, *G.fields(G.scale_box(gt(), 0.5, 0.75, F.col("suppkey"), 12.5)))


@query("spatial_relation", with_tables("boxes", f"""
SELECT {K}, CASE WHEN px1 <= x0 + 20.0e0 THEN 'yes' WHEN (px0 + px1) / 2 >= (x0 + x1) / 2 THEN 'no' END AS is_left,
  CASE WHEN px0 >= x1 - 20.0e0 THEN 'yes' WHEN (px0 + px1) / 2 <= (x0 + x1) / 2 THEN 'no' END AS is_right,
  CASE WHEN py1 <= y0 + 16.0e0 THEN 'yes' WHEN (py0 + py1) / 2 >= (y0 + y1) / 2 THEN 'no' END AS is_above,
  CASE WHEN py0 >= y1 - 16.0e0 THEN 'yes' WHEN (py0 + py1) / 2 <= (y0 + y1) / 2 THEN 'no' END AS is_below FROM boxes"""))
def spatial_relation(t):
    return t.boxes.select(*KEYS, *[G.side_verdict(pred(), gt(), s, FRAME_W, FRAME_H).alias(f"is_{s}") for s in ("left", "right", "above", "below")])


@query("prior_box", with_tables("items", """
WITH m AS (SELECT quantile_cont((gx1 - gx0) * (gy1 - gy0) / 800000.0e0, 0.5) AS ma, quantile_cont(greatest(gx1 - gx0, gy1 - gy0) / 1000.0e0, 0.5) AS ms
  FROM items WHERE NOT no_target),
d AS (SELECT DISTINCT custkey + 400 AS w, custkey + 300 AS h FROM items),
s AS (SELECT w, h, sqrt(ma * w * h) AS bw, CASE WHEN sqrt(ma * w * h) > 0 THEN ma * w * h / sqrt(ma * w * h) ELSE 0 END AS bh, ms * greatest(w, h) AS side FROM d, m)
SELECT w, h, round(w / 2.0e0 - bw / 2, 6) AS ax0, round(h / 2.0e0 - bh / 2, 6) AS ay0, round(w / 2.0e0 + bw / 2, 6) AS ax1, round(h / 2.0e0 + bh / 2, 6) AS ay1,
  round(w / 2.0e0 - side / 2, 6) AS sx0, round(h / 2.0e0 - side / 2, 6) AS sy0, round(w / 2.0e0 + side / 2, 6) AS sx1, round(h / 2.0e0 + side / 2, 6) AS sy1 FROM s"""))
def prior_box(t):
    sizes = t.items.select((F.col("custkey") + 400).alias("w"), (F.col("custkey") + 300).alias("h")).distinct()
    gts = t.items.filter(~F.col("no_target")).select(G.box(F.col("gx0"), F.col("gy0"), F.col("gx1"), F.col("gy1")).alias("box"), "w", "h")
    p = B.prior_boxes(sizes, gts)
    return p.select("w", "h", *[F.round(F.col(f"{k}.{c}"), 6).alias(f"{k[0]}{c}") for k in ("area_prior", "side_prior") for c in ("x0", "y0", "x1", "y1")])


@query("crop_window_box", with_tables("boxes", f"""
WITH w AS (SELECT {K}, x0, y0, x1, y1, CASE WHEN suppkey % 2 = 0 THEN 1600.0e0 ELSE 2400.0e0 END AS fw, CASE WHEN suppkey % 2 = 0 THEN 1200.0e0 ELSE 900.0e0 END AS fh,
  (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, x1 - x0 AS bw, y1 - y0 AS bh FROM boxes),
a AS (SELECT *, round_even(least(2048.0e0, greatest(768.0e0, 4.0e0 * greatest(bw, bh))), 0) AS side FROM w),
s AS (SELECT *, CAST(least(side, fw) AS DOUBLE) AS spx, CAST(least(side, fh) AS DOUBLE) AS spy FROM a),
e AS (SELECT *, greatest(0.0e0, least(CAST(round_even(cx - spx / 2, 0) AS DOUBLE), fw - spx)) AS ex0, greatest(0.0e0, least(CAST(round_even(cy - spy / 2, 0) AS DOUBLE), fh - spy)) AS ey0,
  CASE WHEN greatest(bw * 1.5e0, bh * 1.5e0) < 256 THEN 256.0e0 / greatest(bw * 1.5e0, bh * 1.5e0) ELSE 1.0e0 END AS g FROM s),
f AS (SELECT *, least(bw * 1.5e0 * g, fw) AS tw, least(bh * 1.5e0 * g, fh) AS th FROM e),
k AS (SELECT *, greatest(8.0e0, 1.5e0 * greatest(bw, bh)) AS ks FROM f),
k2 AS (SELECT *, greatest(0.0e0, least(CAST(round_even(cx - ks / 2, 0) AS DOUBLE), fw - 1)) AS kx0, greatest(0.0e0, least(CAST(round_even(cy - ks / 2, 0) AS DOUBLE), fh - 1)) AS ky0 FROM k)
SELECT {K}, ex0 AS win_x0, ey0 AS win_y0, ex0 + spx AS win_x1, ey0 + spy AS win_y1,
  least(greatest(0.0e0, cx - tw / 2), fw - tw) AS tight_x0, least(greatest(0.0e0, cy - th / 2), fh - th) AS tight_y0,
  least(greatest(0.0e0, cx - tw / 2), fw - tw) + tw AS tight_x1, least(greatest(0.0e0, cy - th / 2), fh - th) + th AS tight_y1,
  greatest(0.0e0, trunc(x0 - greatest(bw, 1) * 0.25e0)) AS close_x0, greatest(0.0e0, trunc(y0 - greatest(bh, 1) * 0.25e0)) AS close_y0,
  least(fw, trunc(x1 + greatest(bw, 1) * 0.25e0) + 1) AS close_x1, least(fh, trunc(y1 + greatest(bh, 1) * 0.25e0) + 1) AS close_y1,
  kx0 AS shown_x0, ky0 AS shown_y0, least(fw, greatest(kx0 + 1, CAST(round_even(cx + ks / 2, 0) AS DOUBLE))) AS shown_x1,
  least(fh, greatest(ky0 + 1, CAST(round_even(cy + ks / 2, 0) AS DOUBLE))) AS shown_y1 FROM k2"""))
def crop_window_box(t):
    even = F.col("suppkey") % 2 == 0
    w, h = F.when(even, 1600.0).otherwise(2400.0), F.when(even, 1200.0).otherwise(900.0)
    crops = {"win_": G.edit_window(gt(), w, h), "tight_": G.tight_crop(gt(), w, h), "close_": G.closeup(gt(), w, h), "shown_": G.shown_crop(gt(), w, h)}
    d = t.boxes.select(*KEYS, *[v.alias(k) for k, v in crops.items()])
    return d.select(*KEYS, *[c for k in crops for c in G.fields(F.col(k), k)])


@query("tile_grid", with_tables("", """
WITH s AS (SELECT c_custkey AS image_id, 300 + (c_custkey * 37) % 2400 AS w, 200 + (c_custkey * 53) % 1900 AS h FROM customer),
x AS (SELECT DISTINCT image_id, w, h, CASE WHEN w <= 512 THEN 0 ELSE least(i * 512, w - 512) END AS tx FROM s, range(0, 6) r(i) WHERE i < greatest(1, ceil(w / 512.0e0))),
y AS (SELECT DISTINCT image_id, CASE WHEN h <= 512 THEN 0 ELSE least(i * 512, h - 512) END AS ty FROM s, range(0, 6) r(i) WHERE i < greatest(1, ceil(h / 512.0e0)))
SELECT x.image_id, tx, ty, least(tx + 512, w) AS tx1, least(ty + 512, h) AS ty1 FROM x JOIN y USING (image_id)"""))
def tile_grid(t):
    c = F.col("c_custkey")
    images = t.customer.select(c.alias("image_id"), (300 + (c * 37) % 2400).alias("w"), (200 + (c * 53) % 1900).alias("h"))
    return B.tiles(images, 512).select("image_id", "tx", "ty", "tx1", "ty1")


def _cust_sizes(t):
    c = F.col("c_custkey")
    return t.customer.select(c.alias("image_id"), (300 + (c * 37) % 7400).alias("w"), (200 + (c * 53) % 4900).alias("h"))


CUST = "SELECT c_custkey AS image_id, 300 + (c_custkey * 37) % 7400 AS w, 200 + (c_custkey * 53) % 4900 AS h FROM customer"
CAPPED = """CASE WHEN w * h > 2457600 THEN greatest(1, CAST(round_even({s} * sqrt(2457600.0e0 / CAST(w * h AS DOUBLE)), 0) AS INT)) ELSE {s} END"""


@query("pixel_cap_size", f"""
WITH s AS ({CUST}) SELECT image_id, {CAPPED.format(s='w')} AS cap_w, {CAPPED.format(s='h')} AS cap_h,
  CASE WHEN greatest(w, h) > 1024 THEN greatest(1, CAST(round_even(w * (1024.0e0 / greatest(w, h)), 0) AS INT)) ELSE w END AS side_w,
  CASE WHEN greatest(w, h) > 1024 THEN greatest(1, CAST(round_even(h * (1024.0e0 / greatest(w, h)), 0) AS INT)) ELSE h END AS side_h FROM s""")
def pixel_cap_size(t):
    cw, ch = G.shrink_to_pixels(F.col("w"), F.col("h"))
    sw, sh = G.shrink_to_side(F.col("w"), F.col("h"), 1024)
    return _cust_sizes(t).select("image_id", cw.alias("cap_w"), ch.alias("cap_h"), sw.alias("side_w"), sh.alias("side_h"))


@query("visual_token_count", f"""
WITH s AS ({CUST}), c AS (SELECT image_id, {CAPPED.format(s='w')} AS cw, {CAPPED.format(s='h')} AS ch FROM s)
SELECT image_id, CAST(ceil(cw / 32.0e0) * ceil(ch / 32.0e0) AS BIGINT) AS tokens FROM c""")
def visual_token_count(t):
    return _cust_sizes(t).select("image_id", G.visual_tokens(F.col("w"), F.col("h")).alias("tokens"))


@query("point_grid", f"""
WITH s AS ({CUST}) SELECT image_id, gx, gy, (gx + 0.5e0) * (1.0e0 / 8) * w AS px, (gy + 0.5e0) * (1.0e0 / 8) * h AS py FROM s, range(0, 8) a(gx), range(0, 8) b(gy)""")
def point_grid(t):
    return B.point_grid(_cust_sizes(t), 8).select("image_id", "gx", "gy", "px", "py")


@query("matching_quantities", with_tables("cand", """
WITH m AS (SELECT *, (x1 - x0) * (y1 - y0) AS a, sqrt(((x0 + x1) / 2 - 500) * ((x0 + x1) / 2 - 500) + ((y0 + y1) / 2 - 400) * ((y0 + y1) / 2 - 400)) / sqrt(1640000.0e0) AS d FROM cand)
SELECT c.image_id, c.iid, c.a / r.a AS ratio, c.d - r.d AS delta FROM m c JOIN m r ON c.image_id = r.image_id AND r.iid = 1 WHERE c.iid > 1"""))
def matching_quantities(t):
    c = t.cand.select("image_id", "iid", gt().alias("box"), (F.col("iid") == 1).alias("is_referent"))
    return B.matching_quantities(c, "image_id", FRAME_W, FRAME_H).select("image_id", "iid", "ratio", "delta")
