"""Relation flags, their rates and the decision rules over derived predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import relations as RL
from plumbline.operators.resampling import sql_weights
from plumbline.operators.stats import cohens_kappa
from plumbline.plans.geometry import sql_iou
from plumbline.plans.registry import query
from plumbline.plans.tables import with_tables
from plumbline.session import cut_lineage

col = F.col
FLAGS = ("orig_correct", "none_on_remove", "box_on_remove", "same_box_50", "same_box_r30", "shift_on_control_obj", "shift_on_control_bg",
         "abstain_on_control_obj", "t_null_pass", "t_null_prior_pass", "t_head_pass", "t_attr_moved", "redundant", "unresolved", "undetermined")


def relations(t):
    box = F.when(col("ptype") == "box", G.box(col("x0"), col("y0"), col("x1"), col("y1")))
    none = F.lit(None).cast("double")
    p = t.preds.select("item_id", "condition", "proto", col("ptype").alias("type"), box.alias("box"), none.alias("px"), none.alias("py"))
    wide = RL.pivot_conditions(p, ["item_id", "proto"]).join(
        t.sql("SELECT item_id, custkey, no_target, gx0, gy0, gx1, gy1, h[['nn:' || item_id]] % 3 AS nouns, h[['vc:' || item_id]] % 4 AS vc FROM items"), "item_id")
    gt = F.when(~col("no_target"), G.box(col("gx0"), col("gy0"), col("gx1"), col("gy1")))
    region = G.box(col("gx0") + 30, col("gy0"), col("gx1") + 30, col("gy1"))
    clean = F.when(col("vc") == 0, RL.unknown()).otherwise(col("vc") > 1)
    return RL.relation_flags(wide, gt, region, G.box(450, 350, 550, 450), col("nouns"), clean)


def _pref(c, p):
    return f"max(x0) FILTER (condition = '{c}') AS {p}x0, max(y0) FILTER (condition = '{c}') AS {p}y0, max(x1) FILTER (condition = '{c}') AS {p}x1, max(y1) FILTER (condition = '{c}') AS {p}y1, max(ptype) FILTER (condition = '{c}') AS {p}t"


def _moved(p, r):
    return f"CASE WHEN {p}t IS NULL THEN NULL WHEN {p}t = 'none' THEN true WHEN {p}x0 IS NULL OR {r}x0 IS NULL THEN NULL ELSE {sql_iou(p, r)} < 0.5 END"


SQL_REL = f"""
pv AS (SELECT item_id, proto, {_pref('ORIGINAL', 'o')}, {_pref('REMOVE', 'r')}, {_pref('CONTROL_OBJ', 'c')}, {_pref('CONTROL_BG', 'b')}, {_pref('T_NULL', 'n')}, {_pref('T_HEAD', 'h')}, {_pref('T_ATTR', 'q')}
  FROM preds GROUP BY 1, 2),
pj AS (SELECT pv.*, custkey, CASE WHEN NOT no_target THEN gx0 END AS gx0, CASE WHEN NOT no_target THEN gy0 END AS gy0, CASE WHEN NOT no_target THEN gx1 END AS gx1, CASE WHEN NOT no_target THEN gy1 END AS gy1,
  gx0 + 30 AS ex0, gy0 AS ey0, gx1 + 30 AS ex1, gy1 AS ey1, 450.0e0 AS kx0, 350.0e0 AS ky0, 550.0e0 AS kx1, 450.0e0 AS ky1,
  h[['nn:' || item_id]] % 3 AS nouns, h[['vc:' || item_id]] % 4 AS vc FROM pv JOIN items USING (item_id)),
oc AS (SELECT *, CASE WHEN ox0 IS NOT NULL AND gx0 IS NOT NULL THEN {sql_iou('o', 'g')} >= 0.5 ELSE false END AS orig_correct FROM pj),
rel AS (SELECT item_id, proto, custkey, orig_correct, rt = 'none' AS none_on_remove, rx0 IS NOT NULL AS box_on_remove,
  CASE WHEN NOT orig_correct THEN NULL WHEN rx0 IS NOT NULL THEN {sql_iou('r', 'o')} >= 0.5 WHEN rt = 'none' THEN false END AS same_box_50,
  CASE WHEN NOT orig_correct THEN NULL WHEN rx0 IS NOT NULL THEN {sql_iou('r', 'e')} >= 0.3 WHEN rt = 'none' THEN false END AS same_box_r30,
  CASE WHEN orig_correct THEN {_moved('c', 'o')} END AS shift_on_control_obj, CASE WHEN orig_correct THEN {_moved('b', 'o')} END AS shift_on_control_bg, ct = 'none' AS abstain_on_control_obj,
  {_moved('n', 'o')} AS t_null_pass, {_moved('n', 'k')} AS t_null_prior_pass, {_moved('h', 'o')} AS t_head_pass, {_moved('q', 'o')} AS t_attr_moved,
  nouns > 1 AS redundant, CASE WHEN ot <> ct THEN true WHEN ox0 IS NOT NULL AND cx0 IS NOT NULL THEN {sql_iou('c', 'o')} < 0.5 ELSE true END AS unresolved, vc = 0 AS undetermined,
  CASE WHEN vc = 0 THEN NULL ELSE vc > 1 END AS remove_clean_verifier FROM oc)"""


@query("condition_pivot_relations", with_tables("preds", "WITH " + SQL_REL + " SELECT item_id, proto, " + ", ".join(FLAGS) + " FROM rel"))
def condition_pivot_relations(t):
    return relations(t).select("item_id", "proto", *FLAGS)


@query("moved_from", with_tables("preds", f"""
WITH w AS (SELECT *, ptype AS pt, x0 AS px0, y0 AS py0, x1 AS px1, y1 AS py1, {", ".join(f"max(CASE WHEN condition = 'ORIGINAL' THEN {c} END) OVER (PARTITION BY item_id, proto) AS o{c}" for c in ("x0", "y0", "x1", "y1"))},
  bool_or(condition = 'ORIGINAL') OVER (PARTITION BY item_id, proto) AS has FROM preds)
SELECT item_id, proto, condition, {_moved('p', 'o')} AS moved FROM w WHERE has AND condition <> 'ORIGINAL'"""))
def moved_from(t):
    # pivot and take apart again: one shuffle, where a join with the ORIGINAL rows takes two
    box = F.when(col("ptype") == "box", G.box(col("x0"), col("y0"), col("x1"), col("y1")))
    none = F.lit(None).cast("double")
    p = t.preds.select("item_id", "proto", "condition", col("ptype").alias("type"), box.alias("box"), none.alias("px"), none.alias("py"))
    wide = RL.pivot_conditions(p, ["item_id", "proto"]).filter("ORIGINAL IS NOT NULL")
    rest = F.array(*[F.struct(F.lit(c).alias("condition"), col(c).alias("pred")) for c in RL.CONDITIONS if c != "ORIGINAL"])
    d = wide.select("item_id", "proto", col("ORIGINAL.box").alias("ref"), F.explode(rest).alias("c")).filter("c.pred IS NOT NULL")
    return d.select("item_id", "proto", "c.condition", RL.moved_from(col("c.pred"), col("ref")).alias("moved"))


DEN = {"all": "true", "clean": "coalesce(remove_clean_verifier, false)", "correct": "orig_correct", "frame": "coalesce(remove_clean_verifier, false) AND orig_correct AND NOT coalesce(unresolved, false)"}
SQL_RATES = " UNION ALL ".join(f"SELECT proto, custkey % 3 AS model, '{n}' AS rate, avg(CASE WHEN {DEN[f]} THEN CAST({n} AS INT) END) AS point, count(CASE WHEN {DEN[f]} THEN {n} END) AS n, count(*) AS n_pairs FROM rel GROUP BY 1, 2"
                               for n, f in RL.RATES)


_PARTS = ", ".join(f"sum(CASE WHEN {DEN[f]} THEN CAST({n} AS INT) END) AS s_{n}, count(CASE WHEN {DEN[f]} THEN {n} END) AS n_{n}" for n, f in RL.RATES)
_DRAWS = ", ".join(f"sum(wt * s_{n}) / CAST(nullif(sum(wt * n_{n}), 0) AS DOUBLE) AS r_{n}, sum(n_{n}) AS n_{n}" for n, _ in RL.RATES)
SQL_RATE_CIS = ", per AS (SELECT proto, custkey % 3 AS model, custkey, count(*) AS pairs, " + _PARTS + " FROM rel GROUP BY ALL), st AS (SELECT proto, model, b, sum(pairs) AS pairs, " + _DRAWS + " FROM (" + sql_weights("per", "custkey", "rates", 2000) + ") GROUP BY ALL) " + " UNION ALL ".join(
    f"SELECT proto, model, '{n}' AS rate, CAST(max(pairs) AS BIGINT) AS n_pairs, round(max(r_{n}) FILTER (b = 0), 9) AS point, round(quantile_cont(r_{n}, 0.025) FILTER (b > 0), 9) AS lo, round(quantile_cont(r_{n}, 0.975) FILTER (b > 0), 9) AS hi, CAST(max(n_{n}) AS BIGINT) AS n FROM st GROUP BY 1, 2"
    for n, _ in RL.RATES)


@query("conditional_rates", with_tables("preds", "WITH " + SQL_REL + SQL_RATE_CIS))
def conditional_rates(t):
    """Every rate with its interval, by protocol and model; items of one customer are resampled together."""
    out = RL.conditional_rate_cis(relations(t).withColumn("model", col("custkey") % 3), ["proto", "model"], "custkey", seed="rates")
    return out.select("proto", "model", "rate", "n_pairs", "n", *[F.round(c, 9).alias(c) for c in ("point", "lo", "hi")])


# people judge most pictures like the verifier, but not enough of them
HUMAN = "CASE WHEN h[['hu:' || item_id]] % 20 = 0 THEN NULL WHEN h[['hv:' || item_id]] % 4 = 0 THEN vc <= 1 ELSE vc > 1 END"
SQL_DECISIVE = f""", hm AS (SELECT *, {HUMAN.replace('vc > 1', 'remove_clean_verifier').replace('vc <= 1', 'NOT remove_clean_verifier')} AS remove_clean_human FROM rel),
kp AS (SELECT avg(CASE WHEN a = b THEN 1.0e0 ELSE 0.0e0 END) AS o, CAST(sum(a) * sum(b) + sum(1 - a) * sum(1 - b) AS DOUBLE) / (count(*) * count(*)) AS e FROM (
  SELECT remove_clean_human::INT AS a, remove_clean_verifier::INT AS b FROM hm WHERE remove_clean_human IS NOT NULL AND remove_clean_verifier IS NOT NULL) z),
dc AS (SELECT *, CASE WHEN (SELECT (o - e) / (1 - e) FROM kp) >= 0.6 THEN remove_clean_verifier ELSE remove_clean_human END AS decisive FROM hm)"""


@query("stop_rules", with_tables("preds", "WITH " + SQL_REL + SQL_DECISIVE + ", ra AS (" + SQL_RATES.replace("remove_clean_verifier", "decisive").replace("FROM rel", "FROM dc") + """),
w AS (SELECT proto, model, max(point) FILTER (rate = 'none_on_remove') AS nr, max(point) FILTER (rate = 'box_on_remove') AS br, max(point) FILTER (rate = 'abstain_on_control_obj') AS ab,
  max(point) FILTER (rate = 'shift_on_control_obj') AS so, max(point) FILTER (rate = 'shift_on_control_bg') AS sb, max(point) FILTER (rate = 'same_box_50') AS sm FROM ra GROUP BY 1, 2),
g AS (SELECT proto, count(*) AS k, bool_and(nr > 0.6) AS fa, bool_and(br > 0.8 AND ab > 0.3) AS fb, bool_and(br > 0.8 AND so > 0.3 AND so - sb > 0.1) AS fp, bool_and(sm < 0.2) AS fc FROM w GROUP BY 1),
cl AS (SELECT CASE WHEN (o - e) / (1 - e) >= 0.6 THEN 'remove_clean_verifier' ELSE 'remove_clean_human' END AS clean FROM kp)
SELECT *, (SELECT clean FROM cl) AS clean FROM (SELECT proto, 'a' AS rule, true AS fireable, fa AND k >= 2 AS fires FROM g UNION ALL SELECT proto, 'b', proto = 'secondary', proto = 'secondary' AND fb AND k >= 2 FROM g
UNION ALL SELECT proto, 'b_prime', proto = 'primary', proto = 'primary' AND fp AND k >= 2 FROM g UNION ALL SELECT proto, 'c', true, fc AND k >= 2 FROM g)"""))
def stop_rules(t):
    """The rules on the clean column that people's agreement with the verifier decides on."""
    human = t.sql(f"SELECT item_id, {HUMAN} AS remove_clean_human FROM (SELECT item_id, h[['vc:' || item_id]] % 4 AS vc FROM items) z")
    rel = relations(t).withColumn("model", col("custkey") % 3).join(human, "item_id").withColumn("remove_clean_human", F.when(col("remove_clean_verifier").isNotNull(), col("remove_clean_human")))
    kappa = cohens_kappa(rel, [], col("remove_clean_human"), col("remove_clean_verifier"))
    kappa = cut_lineage(kappa)  # one row, of which the rates' plan should know nothing
    rates = RL.conditional_rates(RL.with_decisive(rel, kappa), ["proto", "model"], "decisive")
    out = RL.stop_rules(rates, "proto", "model")
    return out.join(F.broadcast(kappa.agg(RL.decisive_clean_column(F.max("kappa")).alias("clean"))))


@query("eligible_frame", with_tables("preds", "WITH " + SQL_REL + """, m AS (SELECT custkey, bool_or(orig_correct) AS ok FROM rel GROUP BY 1)
SELECT min(item_id * 10 + CASE proto WHEN 'primary' THEN 0 ELSE 1 END) AS row_key, rel.custkey AS pair FROM rel JOIN m USING (custkey) WHERE ok AND NOT undetermined GROUP BY 2"""))
def eligible_frame(t):
    from plumbline.operators.sampling import eligible_frame as frame

    r = relations(t).withColumn("row_key", col("item_id") * 10 + F.when(col("proto") == "primary", 0).otherwise(1)).select("row_key", col("custkey").alias("pair"), "orig_correct", "undetermined")
    return frame(r, "pair", "row_key", "orig_correct", ~col("undetermined")).select("row_key", "pair")
