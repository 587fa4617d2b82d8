"""Window-style operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import text as T
from plumbline.operators import greedy as GR
from plumbline.operators import ranks as R
from plumbline.operators import traces as TR
from plumbline.operators import windows as W
from plumbline.plans.registry import query
from plumbline.plans.geometry import gt, sql_iou
from plumbline.plans.tables import with_tables
from plumbline.session import dealt

col = F.col


@query("seeded_shuffle_rank", with_tables("", "SELECT o_orderkey AS image_id, row_number() OVER (ORDER BY md5('pool:' || o_orderkey), o_orderkey) AS rank FROM orders WHERE o_orderstatus <> 'P'"))
def seeded_shuffle_rank(t):
    ids = t.orders.filter("o_orderstatus <> 'P'").select(col("o_orderkey").alias("image_id"))
    return R.hash_rank(ids, "pool", ["image_id"])


@query("per_label_cap", with_tables("inst", """
WITH s AS (SELECT image_id, label FROM inst WHERE iid = 1), c AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('cap:' || image_id), image_id) AS rn FROM s)
SELECT image_id, label FROM c WHERE rn <= 20 ORDER BY md5('cap:' || image_id), image_id LIMIT 300"""))
def per_label_cap(t):
    return W.per_label_cap(t.inst.filter("iid = 1").select("image_id", "label"), "image_id", "label", 20, 300, "cap")


def sql_greedy(rank: str, conflict: str) -> str:
    """Greedy pass in SQL: kept rows carried as a list, one recursion step per rank."""
    return f"""
WITH RECURSIVE rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {rank}) AS rk FROM cand),
g AS (SELECT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(iid BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[]) AS kept FROM rk WHERE rk = 1
 UNION ALL SELECT g.image_id, k + 1, CASE WHEN len(list_filter(kept, lambda b: {conflict})) > 0 THEN kept
   ELSE list_append(kept, {{'iid': rk.iid, 'x0': rk.x0, 'y0': rk.y0, 'x1': rk.x1, 'y1': rk.y1}}) END FROM g JOIN rk ON rk.image_id = g.image_id AND rk.rk = k + 1),
f AS (SELECT image_id, arg_max(kept, k) AS kept FROM g GROUP BY 1)
SELECT image_id, u.iid AS iid FROM (SELECT image_id, unnest(kept) AS u FROM f) z"""


INNER = "(greatest(0.0e0, least(rk.x1, b.x1) - greatest(rk.x0, b.x0)) * greatest(0.0e0, least(rk.y1, b.y1) - greatest(rk.y0, b.y0)))"


@query("greedy_keep", with_tables("cand", sql_greedy("(x1 - x0) * (y1 - y0) DESC, iid", f"{INNER} / greatest(1e-6, (rk.x1 - rk.x0) * (rk.y1 - rk.y0)) >= 0.7 OR {sql_iou('rk.', 'b.')} > 0.5")))
def greedy_keep(t):
    c = t.cand.select("image_id", "iid", gt().alias("box"))
    return GR.greedy_keep(c, "image_id", "iid", "box", G.area(col("box"))).select("image_id", "iid")


@query("box_nms", with_tables("cand", sql_greedy("score DESC, iid", f"{sql_iou('rk.', 'b.')} > 0.1")))
def box_nms(t):
    c = t.cand.select("image_id", "iid", gt().alias("box"), "score")
    return GR.nms(c, "image_id", "iid", "box", col("score"), 0.1).select("image_id", "iid")


@query("left_to_right_ids", with_tables("cand", "SELECT image_id, iid, row_number() OVER (PARTITION BY image_id ORDER BY x0, iid) AS place FROM cand"))
def left_to_right_ids(t):
    return W.left_to_right(t.cand.select("image_id", "iid", "x0"), "image_id", col("x0"), "iid", "place").select("image_id", "iid", "place")


@query("ordinal_position", with_tables("cand", """
WITH a AS (SELECT image_id, iid, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM cand),
b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cx, iid) - 1 AS kx, row_number() OVER (PARTITION BY image_id ORDER BY cy, iid) - 1 AS ky,
  cx - lag(cx) OVER (PARTITION BY image_id ORDER BY cx, iid) AS dx, cy - lag(cy) OVER (PARTITION BY image_id ORDER BY cy, iid) AS dy, count(*) OVER (PARTITION BY image_id) AS n FROM a),
c AS (SELECT *, n > 1 AND min(dx) OVER (PARTITION BY image_id) >= 50 AS ux, n > 1 AND min(dy) OVER (PARTITION BY image_id) >= 40 AS uy FROM b)
SELECT image_id, iid, CASE WHEN ux THEN kx END AS kx, CASE WHEN ux THEN CASE WHEN n = 2 THEN 'is the box on the ' || CASE kx WHEN 0 THEN 'left' ELSE 'right' END WHEN kx = n - 1 THEN 'is the rightmost box'
   WHEN kx = 0 THEN 'is the leftmost box' ELSE 'is the ' || (['first', 'second', 'third', 'fourth', 'fifth'])[kx + 1] || ' box from the left' END END AS px,
  CASE WHEN uy THEN ky END AS ky, CASE WHEN uy THEN CASE WHEN n = 2 THEN 'is the ' || CASE ky WHEN 0 THEN 'upper' ELSE 'lower' END || ' box' WHEN ky = 0 THEN 'is the box nearest the top'
   WHEN ky = n - 1 THEN 'is the box nearest the bottom' ELSE 'is the ' || (['first', 'second', 'third', 'fourth', 'fifth'])[ky + 1] || ' box from the top' END END AS py FROM c"""))
def ordinal_position(t):
    c = t.cand.select("image_id", "iid", "x0", "y0", "x1", "y1")
    x = W.ordinal_positions(c, "image_id", "iid", (col("x0") + col("x1")) / 2, 1000, "x", "box").withColumnsRenamed({"k": "kx", "phrase": "px"})
    y = W.ordinal_positions(x, "image_id", "iid", (col("y0") + col("y1")) / 2, 800, "y", "box").withColumnsRenamed({"k": "ky", "phrase": "py"})
    return y.select("image_id", "iid", "kx", "px", "ky", "py")


@query("forward_fill_run", with_tables("", """
WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN event_type = 'error' THEN event_id END AS header FROM events)
SELECT event_id, user_id, last_value(header IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM e"""))
def forward_fill_run(t):
    e = t.events.select("event_id", "user_id", F.when(col("event_type") == "error", col("event_id")).alias("header"))
    return R.forward_fill(e, ["user_id"], "event_id", "header", "run", chunk=500).select("event_id", "user_id", "run")


@query("head_tail_means", with_tables("", """
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, max(n) AS n, round(avg(value) FILTER (rn <= greatest(1, n // 4)), 6) AS head_value, round(avg(value) FILTER (rn > n - greatest(1, n // 4)), 6) AS tail_value FROM r GROUP BY 1"""))
def head_tail_means(t):
    d = W.head_tail_means(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", ["value"])
    return d.select("user_id", "n", F.round("head_value", 6).alias("head_value"), F.round("tail_value", 6).alias("tail_value"))


@query("first_fitting_candidate", with_tables("verdicts", """
WITH c AS (SELECT image_id, iid, bool_or(verdict = 'no') AS bad FROM verdicts GROUP BY 1, 2)
SELECT image_id, min(iid) FILTER (NOT bad) AS chosen, count(*) FILTER (NOT bad) AS n_fit FROM c GROUP BY 1"""))
def first_fitting_candidate(t):
    c = t.verdicts.groupBy("image_id", "iid").agg(F.bool_or(col("verdict") == "no").alias("bad"))
    return c.groupBy("image_id").agg(F.min(F.when(~col("bad"), col("iid"))).alias("chosen"), F.count(F.when(~col("bad"), 1)).alias("n_fit"))


@query("most_yes_candidate", with_tables("verdicts", """
WITH c AS (SELECT image_id, iid, count(*) FILTER (verdict = 'yes') AS yes, bool_or(verdict = 'no') AS bad FROM verdicts GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY yes DESC, iid) AS rn FROM c WHERE NOT bad) SELECT image_id, iid AS chosen, yes FROM r WHERE rn = 1"""))
def most_yes_candidate(t):
    c = t.verdicts.groupBy("image_id", "iid").agg(F.count(F.when(col("verdict") == "yes", 1)).alias("yes"), F.bool_or(col("verdict") == "no").alias("bad"))
    best = c.filter(~col("bad")).groupBy("image_id").agg(F.max_by(F.struct("iid", "yes"), F.struct("yes", (-col("iid")).alias("o"))).alias("b"))
    return best.select("image_id", col("b.iid").alias("chosen"), "b.yes")


@query("ordered_and_capped_rows", with_tables("cand", """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN iid = 2 THEN 0 ELSE 1 END, (x1 - x0) * (y1 - y0) DESC, iid) AS rk FROM cand),
c AS (SELECT * FROM k WHERE rk <= 6), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN iid = 2 THEN 0 ELSE 1 END, iid) AS commit_pos,
  row_number() OVER (PARTITION BY image_id ORDER BY md5('o:' || image_id || ':' || iid), iid) AS random_pos, sum(CASE WHEN iid = 2 THEN 0 ELSE 1 END) OVER (PARTITION BY image_id) AS others,
  sum(CASE WHEN iid = 2 THEN 0 ELSE 1 END) OVER (PARTITION BY image_id ORDER BY md5('o:' || image_id || ':' || iid), iid ROWS UNBOUNDED PRECEDING) AS rr FROM c),
p AS (SELECT *, CASE WHEN iid = 2 THEN (CASE WHEN h[['o:' || image_id || ':coin']] % 2 = 0 OR others = 0 THEN 0 ELSE 1 + h[['o:' || image_id || ':slot']] % greatest(others, 1) END) + 0.5e0 ELSE rr END AS place FROM r)
SELECT image_id, iid, row_number() OVER (PARTITION BY image_id ORDER BY iid) AS iid_pos, commit_pos, random_pos, row_number() OVER (PARTITION BY image_id ORDER BY place, iid) AS coin_pos FROM p"""))
def ordered_and_capped_rows(t):
    first = col("iid") == 2
    d = TR.cap_rows(t.cand.select("image_id", "iid", gt().alias("box")), "image_id", first, G.area(col("box")), "iid")
    d = dealt(d.drop("box"), "image_id")
    for order in ("iid", "commit", "random", "coin"):
        d = TR.order_rows(d, "image_id", first, "iid", order, "o").withColumnRenamed("pos", f"{order}_pos")
    return d


@query("group_relative_score", with_tables("", """
WITH x AS (SELECT l_orderkey AS g, l_linenumber AS line, l_partkey AS pk, l_discount AS r, l_returnflag AS kind FROM lineitem),
s AS (SELECT g, avg(r) AS m, stddev_pop(r) AS sd, max(r) - min(r) AS sp FROM x GROUP BY 1), b AS (SELECT g, kind, avg(r) AS bm, count(*) AS bn, max(r) - min(r) AS bs FROM x GROUP BY 1, 2)
SELECT x.g, line, pk, x.kind, round(CASE WHEN x.kind = 'N' THEN 0.5e0 ELSE 1.0e0 END * (r - m) / (sd + 1e-4), 6) AS advantage,
  round(CASE WHEN bn >= 2 AND bs > 1e-6 THEN CASE WHEN x.kind = 'N' THEN 0.5e0 ELSE 1.0e0 END * (r - bm) END, 6) AS baseline
FROM x JOIN s USING (g) JOIN b ON b.g = x.g AND b.kind = x.kind WHERE sp >= 1e-6"""))
def group_relative_score(t):
    x = t.lineitem.select(col("l_orderkey").alias("g"), col("l_linenumber").alias("line"), col("l_partkey").alias("pk"), col("l_discount").alias("r"), col("l_returnflag").alias("kind"))
    d = W.group_relative(x, ["g"], "r", col("kind") == "N", 0.5, ["kind"])
    return d.select("g", "line", "pk", "kind", F.round("advantage", 6).alias("advantage"), F.round("baseline", 6).alias("baseline"))


@query("scene_positive_rate", with_tables("", """
WITH s AS (SELECT l_orderkey AS g, avg(CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_quantity >= 25 THEN 1.0e0 ELSE 0.0e0 END END) AS s_pos FROM lineitem GROUP BY 1)
SELECT g, l_linenumber AS line, l_partkey AS pk, s_pos FROM lineitem JOIN s ON g = l_orderkey WHERE l_returnflag = 'N'"""))
def scene_positive_rate(t):
    x = t.lineitem.select(col("l_orderkey").alias("g"), col("l_linenumber").alias("line"), col("l_partkey").alias("pk"), "l_returnflag", "l_quantity")
    return W.scene_positive_rate(x, "g", col("l_returnflag") == "A", col("l_quantity") >= 25).filter("l_returnflag = 'N'").select("g", "line", "pk", "s_pos")


@query("round_robin_pick", with_tables("", """
WITH r AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY md5('rr:' || o_orderkey), o_orderkey) AS turn FROM orders)
SELECT * FROM r ORDER BY turn, o_orderstatus, o_orderpriority LIMIT 500"""))
def round_robin_pick(t):
    return W.round_robin(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"], ["o_orderkey"], 500, "rr")


@query("half_subset_flag", with_tables("", """
WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('half:' || o_orderkey), o_orderkey) AS rk, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, rk <= (n + 1) // 2 AS half FROM r"""))
def half_subset_flag(t):
    return W.half_flag(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"], "half").select("o_orderkey", "o_orderstatus", "half")


@query("scene_batches", with_tables("", """
WITH RECURSIVE s AS (SELECT l_orderkey AS scene, count(*) AS size FROM lineitem GROUP BY 1),
o AS (SELECT list({'c': scene, 's': size} ORDER BY md5('batch:' || scene), scene) AS l FROM s),
f AS (SELECT l, list_reduce(list_prepend({'f': CAST(0 AS BIGINT), 'b': [CAST(0 AS BIGINT)]}, list_transform(l, lambda x: {'f': x.s, 'b': CAST([] AS BIGINT[])})),
   lambda a, x: CASE WHEN a.f > 0 AND a.f + x.f > 16 THEN {'f': x.f, 'b': list_append(a.b, a.b[-1] + 1)} ELSE {'f': a.f + x.f, 'b': list_append(a.b, a.b[-1])} END) AS r FROM o)
SELECT unnest(list_transform(l, lambda x: x.c)) AS scene, unnest(r.b[2:]) AS batch FROM f"""))
def scene_batches(t):
    s = t.lineitem.groupBy(col("l_orderkey").alias("scene")).agg(F.count("*").alias("size"))
    return W.scene_batches(s, "scene", "size", 16, "batch")


@query("shape_buckets", with_tables("", """
WITH r AS (SELECT c_custkey, c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY md5('shape:' || c_custkey), c_custkey) AS rk FROM customer)
SELECT c_custkey, c_nationkey, c_mktsegment, (rk - 1) // 8 AS batch FROM r"""))
def shape_buckets(t):
    return W.shape_batches(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"], ["c_custkey"], 8, "shape")
