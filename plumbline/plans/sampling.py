"""Seeded draws and set operations over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import sampling as SA
from plumbline.plans.geometry import gt, sql_iou
from plumbline.plans.registry import query
from plumbline.plans.tables import with_tables

col = F.col


@query("top_candidates", with_tables("cand", f"""
WITH RECURSIVE rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN iid = 1 THEN 0 ELSE 1 END, (x1 - x0) * (y1 - y0) DESC, iid) AS rk FROM cand),
g AS (SELECT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(iid BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[]) AS kept FROM rk WHERE rk = 1
 UNION ALL SELECT g.image_id, k + 1, CASE WHEN len(kept) >= 3 OR len(list_filter(kept, lambda b: {sql_iou('rk.', 'b.')} >= 0.5)) > 0 THEN kept
   ELSE list_append(kept, {{'iid': rk.iid, 'x0': rk.x0, 'y0': rk.y0, 'x1': rk.x1, 'y1': rk.y1}}) END FROM g JOIN rk ON rk.image_id = g.image_id AND rk.rk = k + 1)
SELECT image_id, array_to_string(list_transform(arg_max(kept, k), lambda b: b.iid), ',') AS hints FROM g GROUP BY 1"""))
def top_candidates(t):
    c = t.cand.select("image_id", "iid", gt().alias("box"))
    h = SA.top_boxes(c, "image_id", col("iid") == 1, G.area(col("box")), "iid", "box", 3)
    return h.select("image_id", F.array_join(F.transform("hints", lambda x: x["i"].cast("string")), ",").alias("hints"))


@query("group_split", with_tables("", """
WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('val:' || o_custkey), o_custkey) AS r1, row_number() OVER (ORDER BY md5('tr:' || o_custkey), o_custkey) AS r2, count(*) OVER () AS n
  FROM (SELECT DISTINCT o_custkey FROM orders) d)
SELECT o_orderkey, o_custkey, r1 <= 18 AS held_out, r2 <= round_even(n * 0.8e0, 0) AS train FROM orders JOIN g USING (o_custkey)"""))
def group_split(t):
    d = SA.hold_out_groups(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", 18, "val")
    return SA.split_by_fraction(d, "o_custkey", 0.8, "tr").select("o_orderkey", "o_custkey", "held_out", "train")


@query("reserve_slice", with_tables("items", """
WITH r AS (SELECT item_id, row_number() OVER (ORDER BY md5('dev:' || item_id), item_id) AS rk, NOT no_target AS s FROM items)
SELECT item_id, CASE WHEN rk <= 100 THEN 'dev_a' END AS dev_slice, s AND rk > 100 AS in_scope FROM r"""))
def reserve_slice(t):
    d = t.items.select("item_id", (~col("no_target")).alias("in_scope"))
    return SA.reserve_slice(d, "item_id", 100, "dev", "dev_a").select("item_id", "dev_slice", "in_scope")


SQL_DRAW = """
sz{i} AS (SELECT dimension, count(*) AS size FROM {src} GROUP BY 1), q{i} AS (SELECT *, floor({n} * size / (SELECT sum(size) FROM sz{i})) AS q, (SELECT sum(size) FROM sz{i}) AS t FROM sz{i}),
p{i} AS (SELECT *, {n} - (SELECT sum(q) FROM q{i}) AS lft, sum(CASE WHEN q < size THEN 1 ELSE 0 END) OVER (ORDER BY size DESC, dimension ROWS UNBOUNDED PRECEDING) AS r FROM q{i}),
k{i} AS (SELECT dimension, CASE WHEN t <= {n} THEN size ELSE q + CASE WHEN q < size AND r <= lft THEN 1 ELSE 0 END END AS quota FROM p{i}),
d{i} AS (SELECT item_id, s.dimension FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY md5('draw:' || item_id), item_id) AS rk FROM {src}) s JOIN k{i} USING (dimension) WHERE rk <= quota)"""


@query("stratified_draw", with_tables("evals", "WITH " + SQL_DRAW.format(i=1, src="evals", n=203) + ", rest AS (SELECT * FROM evals WHERE kind = 'negative' AND item_id NOT IN (SELECT item_id FROM d1)), "
       + SQL_DRAW.format(i=2, src="rest", n=97) + " SELECT item_id, dimension, 'random' AS sample_stratum FROM d1 UNION ALL SELECT item_id, dimension, 'negative' FROM d2"))
def stratified_draw(t):
    d = t.evals.select("item_id", "dimension", "kind")
    return SA.random_and_negative_draw(d, "item_id", "dimension", col("kind") == "negative", 203, 97, "draw").select("item_id", "dimension", "sample_stratum")


@query("rater_order", with_tables("", """
SELECT rater, doc_id, row_number() OVER (PARTITION BY rater ORDER BY md5('ord:' || rater || ':' || doc_id), rater, doc_id) AS place FROM labels, (VALUES ('ann'), ('ben'), ('cy')) r(rater)"""))
def rater_order(t):
    return SA.rater_order(t.labels, "doc_id", ["ann", "ben", "cy"], "ord").select("rater", "doc_id", "place")


@query("blind_ab_assignment", with_tables("", """
WITH c AS (SELECT doc_id, h[['ab:' || doc_id]] % 2 = 0 AS neg_is_a, upper(substr(regexp_extract(lower(text), '[a-z]+', 0), 1, 1)) AS letter FROM documents)
SELECT doc_id, neg_is_a, CASE WHEN neg_is_a THEN 'neg' || doc_id ELSE 'pos' || doc_id END AS text_a, letter, CASE WHEN letter IN ('A', 'B') THEN (letter = 'A') = neg_is_a END AS found FROM c"""))
def blind_ab_assignment(t):
    d = t.documents.select("doc_id", "text", F.concat(F.lit("pos"), col("doc_id")).alias("pos"), F.concat(F.lit("neg"), col("doc_id")).alias("neg"))
    ab = SA.blind_ab(d, "doc_id", "pos", "neg", "ab")
    letter = F.upper(F.substring(F.regexp_extract(F.lower("text"), "[a-z]+", 0), 1, 1))
    return ab.select("doc_id", "neg_is_a", "text_a", letter.alias("letter"), SA.decode_ab(letter, col("neg_is_a")).alias("found"))


@query("training_order", with_tables("evals", """
SELECT item_id, row_number() OVER (ORDER BY md5('ep:' || grp) || ':' || grp || ':' || CASE kind WHEN 'positive' THEN 0 ELSE 1 END || ':' || item_id) AS place FROM evals"""))
def training_order(t):
    from plumbline.operators.ranks import hash_rank  # noqa: F401  (same bucket idea, here on the ready-made key)

    d = SA.training_order(t.evals.select("item_id", "grp", "kind"), "grp", "kind", {"positive": 0, "negative": 1}, "item_id", "ep")
    return ordered_place(d, "step_key").select("item_id", "place")


def ordered_place(d, key):
    """Global position along a key that starts with uniform hex digits."""
    from pyspark.sql import Window

    b = d.withColumn("_b", F.substring(key, 1, 3))
    off = b.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return b.join(F.broadcast(off), "_b").withColumn("place", col("_o") + F.row_number().over(Window.partitionBy("_b").orderBy(key)))


@query("seeded_dev_test_split", with_tables("items", """
WITH r AS (SELECT item_id, dimension, row_number() OVER (PARTITION BY dimension ORDER BY md5('pr:' || item_id), item_id) AS rk FROM items)
SELECT item_id, dimension, CASE WHEN rk <= CASE dimension WHEN 'URGENT' THEN 300 ELSE 50 END THEN 'dev' WHEN dimension = 'URGENT' OR rk <= 250 THEN 'test' END AS part FROM r"""))
def seeded_dev_test_split(t):
    return SA.dev_test_split(t.items.select("item_id", "dimension"), "dimension", "item_id", {"URGENT": 300}, {"URGENT": None}, 50, 250, "pr")


@query("capped_extra_files", with_tables("", """
WITH b AS (SELECT o_orderkey AS id, o_custkey AS grp, 'positive' AS kind, 'base' AS src FROM orders WHERE o_orderstatus = 'F'),
x1 AS (SELECT o_orderkey AS id, o_custkey AS grp, 'negative' AS kind, 'x1' AS src FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)),
x2 AS (SELECT o_orderkey AS id, o_custkey AS grp, 'positive' AS kind, 'x2' AS src FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)),
u AS (SELECT * FROM b UNION ALL SELECT * FROM (SELECT * FROM x1 ORDER BY md5('ex:' || id), id LIMIT 150) a UNION ALL SELECT * FROM x2)
SELECT id, grp, kind, src, copy FROM u, range(1, 4) r(copy) WHERE copy = 1 OR kind = 'negative'"""))
def capped_extra_files(t):
    def part(status, kind, src):
        return t.orders.filter(col("o_orderstatus") == status).select(col("o_orderkey").alias("id"), col("o_custkey").alias("grp"), F.lit(kind).alias("kind"), F.lit(src).alias("src"))

    held = t.customer.filter("c_nationkey = 3").select(col("c_custkey").alias("grp"))
    return SA.capped_extras(part("F", "positive", "base"), [(part("O", "negative", "x1"), 150), (part("P", "positive", "x2"), None)], "id", held, "grp", col("kind") == "negative", 3, "ex")


@query("union_first_wins", with_tables("", """
WITH u AS (SELECT o_custkey AS id, 0 AS s, o_orderkey AS ord, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 1, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT c_custkey, 2, 0, c_acctbal FROM customer), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, ord) AS a, row_number() OVER (PARTITION BY id ORDER BY s DESC, ord DESC) AS b FROM u)
SELECT id, max(v) FILTER (a = 1) AS first_value, max(v) FILTER (b = 1) AS last_value FROM f GROUP BY 1"""))
def union_first_wins(t):
    o = t.orders.select(col("o_custkey").alias("id"), col("o_orderkey").alias("ord"), col("o_totalprice").alias("v"), "o_orderstatus")
    src = [o.filter("o_orderstatus = 'F'").drop("o_orderstatus"), o.filter("o_orderstatus = 'O'").drop("o_orderstatus"),
           t.customer.select(col("c_custkey").alias("id"), F.lit(0).cast("bigint").alias("ord"), col("c_acctbal").alias("v"))]
    a = SA.union_first_wins(src, ["id"], ["ord"]).select("id", col("v").alias("first_value"))
    b = SA.union_first_wins(src, ["id"], ["ord"], last=True).select("id", col("v").alias("last_value"))
    return a.join(b, "id")


@query("id_set_algebra", with_tables("", """
SELECT o_orderkey AS image_id FROM orders WHERE o_totalprice > 50000 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity > 10
EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'"""))
def id_set_algebra(t):
    keep = [t.orders.filter("o_totalprice > 50000").select(col("o_orderkey").alias("image_id")), t.lineitem.filter("l_quantity > 10").select(col("l_orderkey").alias("image_id"))]
    drop = [t.lineitem.filter("l_returnflag = 'R'").select(col("l_orderkey").alias("image_id")), t.orders.filter("o_orderpriority = '1-URGENT'").select(col("o_orderkey").alias("image_id"))]
    return SA.id_algebra(keep, drop, "image_id")
