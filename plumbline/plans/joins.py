"""Keyed joins over derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import text as T
from plumbline.operators import joins as J
from plumbline.operators import reports as RP
from plumbline.operators import stats as S
from plumbline.plans.geometry import gt, sql_iou
from plumbline.plans.registry import query
from plumbline.plans.tables import with_tables
from plumbline.plans.text import q

col = F.col

PRED = """
SELECT item_id AS image_id, CASE WHEN h[['pr:' || item_id]] % 7 > 0 THEN gx0 END AS px0, gy0 AS py0, gx1 AS px1, gy1 AS py1 FROM items"""


@query("assign_box_to_instance", with_tables("cand items", f"""
WITH p AS (SELECT image_id, iid AS pid, x0 + 12 AS px0, y0 + 8 AS py0, x1 + 20 AS px1, y1 AS py1 FROM cand),
v AS (SELECT p.image_id, pid, c.iid, coalesce({sql_iou('p.p', 'c.')}, 0) AS v FROM p JOIN cand c USING (image_id)), r AS (SELECT *, row_number() OVER (PARTITION BY image_id, pid ORDER BY v DESC, iid) AS rn FROM v)
SELECT image_id, pid, CASE WHEN v >= 0.5 THEN iid END AS iid, v AS iou FROM r WHERE rn = 1"""))
def assign_box_to_instance(t):
    p = t.cand.select("image_id", col("iid").alias("pid"), G.box(col("x0") + 12, col("y0") + 8, col("x1") + 20, col("y1")).alias("pred"))
    return J.assign_boxes(p, t.cand.select("image_id", "iid", gt().alias("box")), "image_id", ["image_id", "pid"], "pred", "iid", "box")


# ---- records ----


def hh(tag: str, extra: str = "") -> str:
    return f"h[['{tag}:' || item_id{extra}]]"


V = {(i, k): f"CASE {hh(f'v{i}{k}')} % 10 WHEN 0 THEN 'no' WHEN 1 THEN 'unclear' ELSE 'yes' END" if i == 1 else
     f"CASE {hh(f'v{i}{k}')} % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'unclear' ELSE 'yes' END" for i in (1, 2, 3) for k in (0, 1, 2)}
V2 = {k: f"CASE {hh(f'w{k}')} % 12 WHEN 0 THEN 'no' WHEN 1 THEN 'unclear' ELSE 'yes' END" for k in (0, 1, 2)}
NV = {i: f"CASE {hh(f'n{i}')} % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'unclear' ELSE 'no' END" for i in (1, 2, 3)}
RN = {i: f"CASE {hh(f'rn{i}')} % 8 WHEN 0 THEN 'yes' ELSE 'no' END" for i in (1, 2, 3)}
FLAT = f"""
SELECT item_id AS image_id, 1 AS target_iid, 'the cup ' || item_id AS expr_target, CASE WHEN {hh('en')} % 8 = 0 THEN 'THE CUP ' || item_id ELSE 'the mug ' || item_id END AS expr_neg,
  CASE WHEN {hh('fi')} % 4 < 3 THEN CAST({hh('fi')} % 4 AS INT) END AS flipped_idx, CASE WHEN {hh('fi')} % 4 < 3 THEN 'is blue' END AS clause_neg, {hh('w')} % 10 < 9 AS has_w,
  {hh('pt')} % 10 < 8 AS has_pt, nullif({hh('bt')} % 4, 0) AS t_iid, ({hh('it')} % 100) / 100.0e0 AS t_iou, {hh('pn')} % 10 < 8 AS has_pn, {hh('p2')} % 10 < 8 AS has_p2,
  CASE WHEN {hh('on')} % 5 < 4 THEN 'box' ELSE 'none' END AS n_type, 0.985e0 + ({hh('bn')} % 20) / 1000.0e0 AS n_pbox, nullif({hh('nn')} % 5, 0) AS n_iid,
  {hh('l')} % 10 < 8 AS has_l, {hh('uh')} % 5 > 0 AS unique_hit, CASE {hh('sh')} % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS sib_hit,
  {hh('c')} % 10 < 9 AS has_c, {hh('d')} % 10 < 6 AS has_d, {hh('sd')} % 2 = 0 AS sib_distinct, {hh('b')} % 10 < 7 AS has_b, CASE {hh('ff')} % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS found,
  {hh('r')} % 10 < 3 AS has_r, {hh('ra')} % 2 = 0 AS accepted, {hh('rb')} % 2 = 0 AS has_rb, {hh('rf')} % 2 = 0 AS r_found,
  {', '.join(f'{e} AS v{i}{k}' for (i, k), e in V.items())}, {', '.join(f'{e} AS w{k}' for k, e in V2.items())}, {', '.join(f'{e} AS n{i}' for i, e in NV.items())}, {', '.join(f'{e} AS r{i}' for i, e in RN.items())}
FROM items"""


def records(t):
    """Stage tables (with stale first versions to be overridden) and the joined records."""
    f = t.sql(FLAT)
    new, old = f.withColumn("ord", F.lit(2)), f.withColumn("ord", F.lit(1)).withColumn("expr_neg", F.lit("stale")).withColumn("unique_hit", F.lit(False)).withColumn("n_pbox", F.lit(0.0))
    both = new.unionByName(old)

    def inst(prefix, extra=True):
        return F.array(*[F.struct(F.lit(i).cast("bigint").alias("iid"), F.lit(i == 1).alias("is_target"), F.array(*[col(f"{prefix}{i}{k}") for k in range(3)]).alias("verdicts"),
                                  col(f"n{i}").alias("neg_verdict")) for i in (1, 2, 3)])

    all_yes = (col("v10") == "yes") & (col("v11") == "yes") & (col("v12") == "yes")
    zero = (col("n1") == "no") & (col("n2") == "no") & (col("n3") == "no")
    write = both.filter("has_w").select("image_id", "ord", "expr_target", "expr_neg", "flipped_idx", "clause_neg")
    checker = both.filter("has_c").select("image_id", "ord", inst("v").alias("instances"), all_yes.alias("target_all_yes"), col("sib_distinct").alias("siblings_distinct"), zero.alias("zero_satisfier"))
    second = F.array(F.struct(F.lit(1).cast("bigint").alias("iid"), F.lit(True).alias("is_target"), F.array("w0", "w1", "w2").alias("verdicts"), F.lit(None).cast("string").alias("neg_verdict")))
    stages = {
        "listener": both.filter("has_l").select("image_id", "ord", "unique_hit", col("sib_hit").alias("sibling_unique_hit")), "checker": checker,
        "checker2": new.filter("has_d").select("image_id", "ord", second.alias("instances")), "blind": new.filter("has_b").select("image_id", "ord", col("found").alias("found_flip")),
        "reflip": new.filter("has_r").select("image_id", "ord", "accepted", F.lit("flip_failed").alias("reason"), F.concat(F.lit("the jug "), col("image_id").cast("string")).alias("expr_neg"),
                                            F.lit(1).alias("flipped_idx"), F.lit("is odd").alias("clause_neg"), F.create_map(*[x for i in (1, 2, 3) for x in (F.lit(str(i)), col(f"r{i}"))]).alias("neg_verdicts"),
                                            F.when(col("has_rb"), F.struct(col("r_found").alias("found_flip"))).alias("blind")),
    }
    none = F.lit(None)

    def pol(df, which, flag, t_, p, i, iou):
        return df.filter(flag).select("image_id", "ord", F.lit(which).alias("which"), t_.alias("output_type"), p.cast("double").alias("p_box"), i.alias("boxed_iid"), iou.cast("double").alias("iou_target"))

    policy = (pol(both, "target", col("has_pt"), F.lit("box"), none, col("t_iid"), col("t_iou")).unionByName(pol(both, "neg", col("has_pn"), col("n_type"), col("n_pbox"), col("n_iid"), none))
              .unionByName(pol(new, "neg2", col("has_p2"), F.lit("box"), F.lit(0.995), col("t_iid"), none)))
    return J.build_records(f.select("image_id", "target_iid"), write, policy, stages)


def _others(i):
    return " AND ".join(f"(fx = {k} OR v{i}{k} IN ('yes', 'unclear'))" for k in range(3))


SQL_RECORDS = f"""
fl AS ({FLAT}), u AS (SELECT *, coalesce(has_r AND accepted, false) AS ov FROM fl WHERE has_w),
x AS (SELECT *, CASE WHEN ov THEN 'the jug ' || image_id ELSE expr_neg END AS en, CASE WHEN ov THEN 1 ELSE flipped_idx END AS fx, CASE WHEN ov THEN 'is odd' ELSE clause_neg END AS cn,
  CASE WHEN ov THEN r1 ELSE n1 END AS m1, CASE WHEN ov THEN r2 ELSE n2 END AS m2, CASE WHEN ov THEN r3 ELSE n3 END AS m3,
  CASE WHEN ov AND has_rb THEN r_found WHEN has_b THEN found END AS ff, CASE WHEN ov THEN has_p2 ELSE has_pn END AS hasn,
  CASE WHEN ov THEN true ELSE n_type = 'box' AND n_pbox >= 0.99 END AS nb, CASE WHEN ov THEN t_iid ELSE n_iid END AS ni FROM u),
y AS (SELECT *, (CASE WHEN v10 <> 'unclear' AND w0 <> 'unclear' THEN 1 ELSE 0 END + CASE WHEN v11 <> 'unclear' AND w1 <> 'unclear' THEN 1 ELSE 0 END + CASE WHEN v12 <> 'unclear' AND w2 <> 'unclear' THEN 1 ELSE 0 END) AS np,
  (CASE WHEN v10 <> 'unclear' AND v10 = w0 THEN 1 ELSE 0 END + CASE WHEN v11 <> 'unclear' AND v11 = w1 THEN 1 ELSE 0 END + CASE WHEN v12 <> 'unclear' AND v12 = w2 THEN 1 ELSE 0 END) AS ns,
  {' + '.join(f"CASE WHEN fx IS NOT NULL AND m{i} IN ('yes', 'unclear') AND {_others(i)} THEN 1 ELSE 0 END" for i in (1, 2, 3))} AS n_sat FROM x),
g AS (SELECT image_id, en, fx, cn, ov, coalesce(fx IS NOT NULL AND lower(en) <> lower(expr_target), false) AS flip_identified,
  CASE WHEN has_c THEN v10 = 'yes' AND v11 = 'yes' AND v12 = 'yes' END AS writer_target_all_yes,
  CASE WHEN has_c THEN (CASE v10 WHEN 'no' THEN 1 ELSE 0 END + CASE v11 WHEN 'no' THEN 1 ELSE 0 END + CASE v12 WHEN 'no' THEN 1 ELSE 0 END) <= 1 END AS writer_target_at_most_one_no,
  CASE WHEN has_c AND has_d AND np > 0 THEN ns / CAST(np AS DOUBLE) >= 0.8 END AS checkers_agree_on_target, CASE WHEN has_c THEN sib_distinct END AS siblings_distinct,
  CASE WHEN has_l THEN unique_hit END AS listener_unique_hit, CASE WHEN has_c THEN m1 = 'no' AND m2 = 'no' AND m3 = 'no' END AS zero_satisfier_gate,
  CASE WHEN has_c AND cn IS NOT NULL THEN n_sat = 0 END AS zero_satisfier_sentence, CASE WHEN has_pt THEN t_iou >= 0.5 END AS base_correct_on_target,
  CASE WHEN has_pt THEN t_iid IS NOT NULL AND t_iid <> 1 END AS base_wrong_on_target, CASE WHEN hasn THEN nb AND ni IS NOT NULL END AS base_boxes_on_neg, NOT ff AS blind_judge_fooled,
  CASE WHEN has_l THEN sib_hit END AS sibling_unique_hit, has_pt AND has_l AND has_c AS hard_known FROM y),
gates AS (SELECT *, CASE WHEN writer_target_all_yes IS NOT NULL AND listener_unique_hit IS NOT NULL AND zero_satisfier_gate IS NOT NULL AND base_boxes_on_neg IS NOT NULL
   THEN writer_target_all_yes AND listener_unique_hit AND zero_satisfier_gate AND base_boxes_on_neg AND flip_identified END AS negative_usable,
  CASE WHEN writer_target_all_yes IS NOT NULL AND listener_unique_hit IS NOT NULL AND zero_satisfier_sentence IS NOT NULL AND base_boxes_on_neg IS NOT NULL
   THEN writer_target_all_yes AND listener_unique_hit AND zero_satisfier_sentence AND base_boxes_on_neg AND flip_identified END AS negative_usable_sentence,
  CASE WHEN hard_known THEN base_wrong_on_target AND listener_unique_hit AND writer_target_all_yes END AS positive_hard FROM g)"""


@query("multi_stage_record_join", with_tables("items", f"WITH {SQL_RECORDS} SELECT image_id, en AS expr_neg, fx AS flipped_idx, cn AS clause_neg, CASE WHEN ov THEN 'flip_failed' END AS reflipped, zero_satisfier_gate AS zero_satisfier FROM gates"))
def multi_stage_record_join(t):
    return records(t).select("image_id", "expr_neg", "flipped_idx", "clause_neg", "reflipped", F.when(col("checker").isNotNull(), col("zero_satisfier")).alias("zero_satisfier"))


@query("gate_flags", with_tables("items", f"WITH {SQL_RECORDS} SELECT image_id, {', '.join(J.GATES)} FROM gates"))
def gate_flags(t):
    return J.gate_flags(records(t)).select("image_id", *J.GATES)


@query("gate_pass_table", with_tables("items", f"WITH {SQL_RECORDS}, s AS (" + " UNION ALL ".join(f"SELECT '{g}' AS gate, {g} AS v FROM gates" for g in J.GATES)
       + ") SELECT gate, count(*) FILTER (v) AS passed, count(v) AS measured, count(*) FILTER (v) / CAST(count(v) AS DOUBLE) AS rate FROM s GROUP BY 1"))
def gate_pass_table(t):
    return RP.gate_pass_table(J.gate_flags(records(t)), list(J.GATES))


# ---- edits ----

EDITS = """
SELECT image_id, CASE WHEN hole_type = 'rect' THEN 'RECT_' ELSE '' END || op AS operator, hole_type, CASE WHEN op = 'REMOVE' THEN NULL WHEN op = 'CONTROL_BG' THEN 'background' WHEN partkey % 4 = 0 THEN 'class_agnostic'
  WHEN partkey % 4 = 1 THEN 'other_class_instance' ELSE 'same_class_other_instance' END AS control_source, (x1 - x0) * (y1 - y0) / 800000.0e0 AS mask_area_frac, 'i' || 1 AS instance_id,
  CASE WHEN op LIKE 'CONTROL_OBJ%' THEN 'i' || iid END AS control_instance_id, image_id || ':' || op || ':' || hole_type AS sample_id
FROM cand JOIN (VALUES (1, 'REMOVE'), (2, 'CONTROL_OBJ'), (3, 'CONTROL_OBJ_2'), (4, 'CONTROL_BG')) o(k, op) ON iid = k JOIN (VALUES ('mask'), ('rect')) m(hole_type) ON 1 = 1"""
BIN = "CASE WHEN mask_area_frac < 0.01 THEN '0.5-1%' WHEN mask_area_frac < 0.02 THEN '1-2%' WHEN mask_area_frac < 0.05 THEN '2-5%' ELSE '5-15%' END"


@query("paired_contrast", with_tables("cand", f"""
WITH e AS ({EDITS}), p AS (SELECT * FROM e WHERE operator = 'RECT_REMOVE'), n AS (SELECT * FROM e WHERE operator = 'RECT_CONTROL_OBJ')
SELECT image_id, 1 AS label, operator, control_source, {BIN} AS hole_bin FROM p WHERE image_id IN (SELECT image_id FROM n) UNION ALL SELECT image_id, 0, operator, control_source, {BIN} FROM n WHERE image_id IN (SELECT image_id FROM p)"""))
def paired_contrast(t):
    d = J.paired_contrast(t.sql(EDITS), "rect", "REMOVE", "CONTROL_OBJ", ["control_source", "mask_area_frac"])
    return d.select("image_id", "label", "operator", "control_source", G.hole_area_bin(col("mask_area_frac")).alias("hole_bin"))


@query("null_pair_and_ladder", with_tables("cand", f"""
WITH e AS ({EDITS}), p AS (SELECT * FROM e WHERE operator = 'CONTROL_OBJ'), n AS (SELECT * FROM e WHERE operator = 'CONTROL_OBJ_2'), qq AS (SELECT unnest([75, 90, 92]) AS quality),
b AS (SELECT p.*, 1 AS label FROM p WHERE image_id IN (SELECT image_id FROM n) UNION ALL SELECT n.*, 0 FROM n WHERE image_id IN (SELECT image_id FROM p))
SELECT image_id, label, quality, CASE label WHEN 1 THEN quality ELSE 95 END AS damage, image_id || '_' || operator || CASE label WHEN 1 THEN '_q' || quality ELSE '_ref95' END AS sample_id FROM b, qq"""))
def null_pair_and_ladder(t):
    return J.ladder(t.sql(EDITS), "mask", "global", [75, 90, 92], 95, ["mask_area_frac"]).select("image_id", "label", "quality", "damage", "sample_id")


VERIFIED = f"SELECT *, CASE WHEN h[['vf:' || sample_id]] % 5 > 0 THEN true ELSE false END AS removed FROM ({EDITS}) e"
SCORES = f"SELECT sample_id, (h[['sc:' || sample_id]] % 50 + CASE WHEN operator LIKE '%REMOVE' THEN 8 ELSE 0 END) / 60.0e0 AS score FROM ({EDITS}) e WHERE h[['hs:' || sample_id]] % 11 > 0"


@query("verified_pairs", with_tables("cand", f"""
WITH v AS ({VERIFIED}), s AS ({SCORES}), r AS (SELECT * FROM v WHERE operator IN ('REMOVE', 'RECT_REMOVE') AND removed), c AS (SELECT * FROM v WHERE operator IN ('CONTROL_OBJ', 'RECT_CONTROL_OBJ') AND removed
  AND control_source NOT IN ('class_agnostic', 'background')), p AS (SELECT c.control_source AS source, s1.score AS sr, s2.score AS sc FROM r JOIN c USING (image_id, hole_type) JOIN s s1 ON s1.sample_id = r.sample_id JOIN s s2 ON s2.sample_id = c.sample_id),
l AS (SELECT source, sr AS score, 1 AS y FROM p UNION ALL SELECT source, sc, 0 FROM p), g AS (SELECT source, score, sum(y) AS pos, count(*) - sum(y) AS neg FROM l GROUP BY 1, 2),
w AS (SELECT *, sum(neg) OVER (PARTITION BY source ORDER BY score) - neg AS below FROM g)
SELECT source, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(sum(pos * (below + neg / 2)) / CAST(sum(pos) * sum(neg) AS DOUBLE), 9) AS auroc FROM w GROUP BY 1"""))
def verified_pairs(t):
    v = t.sql(VERIFIED).withColumn("operator", F.regexp_replace("operator", "^RECT_", ""))
    long = J.verified_pairs(v, t.sql(SCORES))
    return S.auroc(long, ["source"], col("label"), col("score")).withColumn("auroc", F.round("auroc", 9))


LABELLED = "SELECT image_id, 'i' || iid AS instance_id, CASE WHEN partkey % 4 = 0 THEN NULL ELSE label END AS label, iid FROM inst"


@query("question_table", with_tables("inst", f"""
WITH e AS ({EDITS}), l AS ({LABELLED}), x AS (SELECT *, replace(operator, 'RECT_', '') AS op FROM e),
a AS (SELECT *, CASE WHEN op = 'REMOVE' THEN instance_id ELSE control_instance_id END AS asked FROM x WHERE op IN ('REMOVE', 'CONTROL_OBJ'))
SELECT sample_id, op AS op_class, asked AS asked_id, l.label, CASE WHEN l.label IS NULL THEN 'no_label' END AS skip_reason FROM a LEFT JOIN (SELECT * FROM l WHERE label IS NOT NULL) l ON l.image_id = a.image_id AND l.instance_id = asked"""))
def question_table(t):
    labels = J.first_labels(t.sql(LABELLED), ["image_id", "instance_id"], "label", "iid")
    return J.question_table(t.sql(EDITS), labels).select("sample_id", "op_class", "asked_id", "label", "skip_reason")


@query("first_label_lookup", with_tables("inst", f"""
WITH l AS ({LABELLED}), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY iid) AS rn FROM l WHERE label IS NOT NULL) SELECT image_id, label FROM r WHERE rn = 1"""))
def first_label_lookup(t):
    return J.first_labels(t.sql(LABELLED), ["image_id"], "label", "iid")


@query("unambiguous_referents", with_tables("inst", """
SELECT r.image_id, r.label FROM inst r WHERE r.iid = 1 AND (SELECT count(*) FROM inst o WHERE o.image_id = r.image_id AND lower(o.label) = lower(r.label)) = 1"""))
def unambiguous_referents(t):
    return J.unambiguous(t.inst, "image_id", "label", col("iid") == 1)


@query("review_pool", with_tables("cand evals", f"""
WITH e AS ({EDITS}), cl AS (SELECT item_id AS image_id FROM evals WHERE correct), dr AS (SELECT item_id FROM evals WHERE ordinal)
SELECT image_id, coalesce(output_type = 'none', false) AS declined FROM cl JOIN evals ON item_id = image_id WHERE image_id NOT IN (SELECT item_id FROM dr)
 AND image_id IN (SELECT image_id FROM e WHERE operator = 'REMOVE') AND image_id IN (SELECT image_id FROM e WHERE operator = 'CONTROL_OBJ')"""))
def review_pool(t):
    ev = t.evals.withColumnRenamed("item_id", "image_id")
    e = t.sql(EDITS)
    flags = ev.select("image_id", (col("output_type") == "none").alias("declined"))
    return J.review_pool(ev.filter("correct").select("image_id"), [ev.filter("ordinal")], [e.filter("operator = 'REMOVE'"), e.filter("operator = 'CONTROL_OBJ'")], flags, "image_id")


@query("cross_group_pairs", with_tables("", """
WITH it AS (SELECT o_orderkey AS item, o_custkey AS grp, c_nationkey AS cat FROM orders JOIN customer ON o_custkey = c_custkey),
ring AS (SELECT c_custkey AS grp, c_nationkey AS cat, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('x:' || c_custkey), c_custkey) AS rk, count(*) OVER (PARTITION BY c_nationkey) AS m FROM customer),
j AS (SELECT item, it.grp, it.cat, rk, m, k FROM it JOIN ring r ON r.cat = it.cat AND r.grp = it.grp, range(0, 3) z(k) WHERE m > 1 AND k < least(3, m - 1))
SELECT item, j.grp AS src_grp, j.cat, r.grp FROM j JOIN ring r ON r.cat = j.cat AND r.rk = (j.rk + (hl[['x:' || item]] % greatest(j.m - 1, 1) + k) % (j.m - 1)) % j.m + 1"""))
def cross_group_pairs(t):
    scenes = t.customer.select(col("c_custkey").alias("grp"), col("c_nationkey").alias("cat"))
    items = t.orders.select(col("o_orderkey").alias("item"), col("o_custkey").alias("grp")).join(scenes, "grp")
    return J.cross_group_pairs(items, scenes, "cat", "grp", "item", 3, "x").select("item", "src_grp", "cat", "grp")


@query("exclude_keys", with_tables("", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""))
def exclude_keys(t):
    used = t.lineitem.filter("l_quantity > 45").select(col("l_orderkey").alias("o_orderkey"))
    held = t.customer.filter("c_acctbal < 0").select(col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(used, "o_orderkey", "left_anti").join(held, "o_custkey", "left_anti")


RUN_A = "SELECT item_id, dimension, h[['a:' || item_id]] % 10 < 6 AS correct FROM items WHERE h[['ina:' || item_id]] % 10 < 8"
RUN_B = "SELECT item_id, h[['b:' || item_id]] % 10 < 5 AS correct FROM items WHERE h[['inb:' || item_id]] % 10 < 8"


@query("paired_runs", with_tables("items", f"""
SELECT dimension, count(*) AS n, count(*) FILTER (a.correct AND b.correct) AS both, count(*) FILTER (a.correct AND NOT b.correct) AS b, count(*) FILTER (NOT a.correct AND b.correct) AS c
FROM ({RUN_A}) a JOIN ({RUN_B}) b USING (item_id) GROUP BY 1"""))
def paired_runs(t):
    return S.discordant_counts(t.sql(RUN_A), t.sql(RUN_B), ["item_id"], [col("dimension")])


@query("restrict_to_ids", with_tables("items", f"""
SELECT dimension, count(*) AS n, avg(CASE WHEN correct THEN 1.0e0 ELSE 0.0e0 END) AS acc FROM ({RUN_A}) a WHERE item_id IN (SELECT item_id FROM ({RUN_B}) b) GROUP BY 1"""))
def restrict_to_ids(t):
    return t.sql(RUN_A).join(t.sql(RUN_B), "item_id", "left_semi").groupBy("dimension").agg(F.count("*").alias("n"), RP.share(col("correct")).alias("acc"))


@query("sibling_self_join", with_tables("cand", f"""
WITH o AS (SELECT image_id, partkey % 3 AS cat, iid, x0, y0, x1, y1 FROM cand), r AS (SELECT *, row_number() OVER (PARTITION BY image_id, cat ORDER BY md5('sib:' || iid), iid) AS rk, count(*) OVER (PARTITION BY image_id, cat) AS m FROM o),
p AS (SELECT a.image_id, a.cat, a.iid, b.iid AS sibling, (b.rk - a.rk + a.m) % a.m AS place FROM r a JOIN r b ON a.image_id = b.image_id AND a.cat = b.cat AND a.iid <> b.iid WHERE {sql_iou('a.', 'b.')} < 0.3),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id, cat, iid ORDER BY place) AS rn FROM p) SELECT image_id, cat, iid, sibling, place FROM k WHERE rn <= 2"""))
def sibling_self_join(t):
    o = t.cand.select("image_id", (col("partkey") % 3).alias("cat"), "iid", gt().alias("box"))
    return J.siblings(o, ["image_id", "cat"], "iid", "box", 2, "sib")


@query("reference_objects", with_tables("inst", f"""
WITH o AS (SELECT * FROM inst WHERE source IN ('other_class_instance', 'class_agnostic')), c AS (SELECT * FROM inst WHERE source IN ('referent', 'same_class_other_instance')),
f AS (SELECT o.* FROM o WHERE (SELECT count(*) FROM o p WHERE p.image_id = o.image_id AND p.label = o.label) = 1 AND area_frac BETWEEN 0.005 AND 0.5 AND NOT EXISTS (SELECT 1 FROM c WHERE c.image_id = o.image_id AND {sql_iou('o.', 'c.')} >= 0.3)),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY iid) AS rn FROM f) SELECT image_id, iid, label FROM r WHERE rn <= 4"""))
def reference_objects(t):
    i = t.inst.withColumn("box", gt())
    o, c = i.filter("source IN ('other_class_instance', 'class_agnostic')"), i.filter("source IN ('referent', 'same_class_other_instance')")
    return J.reference_objects(o, c, "image_id", "iid", "label", "box", col("area_frac"), 4).select("image_id", "iid", "label")


TIGHT = """least(greatest(0.0e0, (x0 + x1) / 2 - sw / 2), 1000.0e0 - sw) AS tx0, least(greatest(0.0e0, (y0 + y1) / 2 - sh / 2), 800.0e0 - sh) AS ty0"""


@query("question_routing", with_tables("cand", f"""
WITH e AS (SELECT image_id, x0, y0, x1, y1, CASE WHEN greatest((x1 - x0) * 1.5e0, (y1 - y0) * 1.5e0) < 256 THEN 256.0e0 / greatest((x1 - x0) * 1.5e0, (y1 - y0) * 1.5e0) ELSE 1.0e0 END AS g FROM cand WHERE iid = 1),
s AS (SELECT *, least((x1 - x0) * 1.5e0 * g, 1000.0e0) AS sw, least((y1 - y0) * 1.5e0 * g, 800.0e0) AS sh FROM e), k AS (SELECT *, {TIGHT} FROM s),
b AS (SELECT k.*, floor(tx0) AS a0, floor(ty0) AS b0, ceil(tx0 + sw) AS a1, ceil(ty0 + sh) AS b1 FROM k),
f AS (SELECT b.image_id, bool_or(coalesce(n.x0 < b.x1 + 150 AND b.x0 - 150 < n.x1 AND n.y0 < b.y1 + 150 AND b.y0 - 150 < n.y1, false)) AS inw, bool_or(coalesce(n.x0 < a1 AND a0 < n.x1 AND n.y0 < b1 AND b0 < n.y1, false)) AS int_
  FROM b LEFT JOIN (SELECT * FROM cand WHERE iid > 1) n ON n.image_id = b.image_id GROUP BY 1),
r AS (SELECT image_id, CASE WHEN NOT inw THEN 'window' WHEN int_ THEN 'neighbour_in_both' ELSE 'tight_crop' END AS rule, h[['ans:' || image_id]] % 4 AS a FROM f)
SELECT image_id, rule, CASE rule WHEN 'window' THEN 'headnoun_window' WHEN 'tight_crop' THEN 'headnoun_tight_crop' END AS question,
  CASE WHEN rule = 'neighbour_in_both' THEN 'undetermined' WHEN a = 0 THEN 'clean' ELSE 'not_clean' END AS decision FROM r"""))
def question_routing(t):
    e = t.cand.filter("iid = 1").select("image_id", gt().alias("box"))
    win = G.box(col("box.x0") - 150, col("box.y0") - 150, col("box.x1") + 150, col("box.y1") + 150)
    r = J.route_questions(e, t.cand.filter("iid > 1").select("image_id", gt().alias("box")), "image_id", win, col("box"), 1000, 800)
    h = F.conv(F.substring(F.md5(F.concat(F.lit("ans:"), col("image_id").cast("string"))), 1, 8), 16, 10).cast("bigint") % 4
    answer = F.when(h == 0, "No.").when(h == 1, "yes it is").when(h == 2, "??").otherwise("maybe no")
    return r.select("image_id", "rule", "question", J.clean_decision(col("question"), answer).alias("decision"))


@query("merge_candidate_lists", with_tables("cand", f"""
WITH c1 AS (SELECT image_id, x0 + 5 AS gx0, y0 AS gy0, x1 + 5 AS gx1, y1 AS gy1 FROM cand WHERE iid = 1), o AS (SELECT c.image_id, iid, row_number() OVER (PARTITION BY c.image_id ORDER BY iid) AS rn FROM cand c JOIN c1 g ON g.image_id = c.image_id WHERE {sql_iou('c.', 'g.g')} < 0.7)
SELECT c1.image_id, CAST(1 + count(rn) FILTER (rn < 4) AS INT) AS n, string_agg(CAST(iid AS VARCHAR), ',' ORDER BY iid) FILTER (rn < 4) AS own FROM c1 LEFT JOIN o ON o.image_id = c1.image_id GROUP BY 1"""))
def merge_candidate_lists(t):
    b = G.box(col("x0"), col("y0"), col("x1"), col("y1"))
    tagged = F.transform(F.array_sort(F.collect_list(F.struct("iid", b.alias("b")))), lambda s: s["b"].withField("iid", s["iid"]))
    g = t.cand.groupBy("image_id").agg(tagged.alias("boxes"), F.max(F.when(col("iid") == 1, G.box(col("x0") + 5, col("y0"), col("x1") + 5, col("y1")).withField("iid", F.lit(0).cast("bigint")))).alias("c1"))
    m = J.merge_candidates(col("boxes"), col("c1"), 4)
    own = F.array_join(F.transform(F.slice("m", 2, 10), lambda x: x["iid"].cast("string")), ",")
    return g.select("image_id", m.alias("m")).select("image_id", F.size("m").alias("n"), F.when(F.size("m") > 1, own).alias("own"))


STOP = "[" + ", ".join(q(w) for w in T.ALIGN_STOP) + "]"


def _w(x):
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+', 0), lambda w: NOT list_contains({STOP}, w)))"


@query("token_jaccard_match", with_tables("", f"""
WITH c AS (SELECT conv_id, turn, text, {_w('text')} AS w FROM conversations), k AS (SELECT conv_id, list({{'t': turn, 'w': w}} ORDER BY turn) AS cs FROM c GROUP BY 1),
d AS (SELECT doc_id, {_w("text")} AS w FROM documents),
m AS (SELECT d.doc_id, list_transform(cs, lambda x: len(list_intersect(x.w, d.w)) / CAST(greatest(1, len(list_distinct(list_concat(x.w, d.w)))) AS DOUBLE)) AS s FROM d JOIN k ON k.conv_id = d.doc_id)
SELECT doc_id, CASE WHEN list_max(s) >= 0.3 THEN list_position(s, list_max(s)) END AS best FROM m"""))
def token_jaccard_match(t):
    conds = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    k = t.conversations.groupBy(col("conv_id").alias("doc_id")).agg(conds.alias("cs"))
    return t.documents.select("doc_id", "text").join(k, "doc_id").select("doc_id", T.align_clause(col("cs"), col("text")).alias("best"))


BANK = """SELECT image_id, iid, 'wearing a ' || CASE h[['k1:' || image_id || ':' || iid || ':' || clause]] % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' WHEN 2 THEN 'dark blue' ELSE 'green' END || ' '
  || CASE h[['k2:' || image_id || ':' || iid || ':' || clause]] % 3 WHEN 0 THEN 'cap' WHEN 1 THEN 'coat' ELSE 'shirt' END AS clause_text, verdict FROM verdicts"""


@query("shared_word_lookup", with_tables("verdicts", f"""
WITH b AS (SELECT DISTINCT image_id, iid, clause_text AS t, verdict, list_distinct(string_split(replace(clause_text, ' a ', ' '), ' ')) AS w FROM ({BANK}) z),
p AS (SELECT n.image_id, n.iid, n.t AS claim, y.t AS seen, len(list_intersect(n.w, y.w)) AS k FROM (SELECT DISTINCT image_id, iid, t, w FROM b WHERE verdict = 'no') n JOIN (SELECT DISTINCT image_id, iid, t, w FROM b WHERE verdict = 'yes') y USING (image_id, iid)
  WHERE n.t <> y.t AND len(list_intersect(n.w, y.w)) > 0 AND len(list_filter(y.w, lambda v: NOT list_contains(n.w, v))) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, iid, claim ORDER BY k DESC, seen) AS rn FROM p) SELECT image_id, iid, claim, seen FROM r WHERE rn = 1"""))
def shared_word_lookup(t):
    b = t.sql(BANK)
    return J.seen_from_bank(b.filter("verdict = 'no'").withColumnRenamed("clause_text", "claim"), b.filter("verdict = 'yes'").withColumnRenamed("clause_text", "clause"), ["image_id", "iid"], "claim", "clause")


@query("rationale_lookup", with_tables("verdicts", """
WITH x AS (SELECT image_id, iid, clause, verdict AS label, CASE h[['ba:' || image_id || ':' || iid || ':' || clause]] % 3 WHEN 0 THEN 'no' ELSE verdict END AS a,
  CASE h[['bb:' || image_id || ':' || iid || ':' || clause]] % 4 WHEN 0 THEN 'yes' ELSE verdict END AS b FROM verdicts)
SELECT count(*) AS cells, count(*) FILTER (a = b) AS same, count(*) FILTER (label = 'no') AS label_no, count(*) FILTER (label = 'no' AND a = 'no' AND b = 'no') AS both_no FROM x"""))
def rationale_lookup(t):
    x = t.sql("""SELECT image_id, iid, clause, verdict AS label, CASE h[['ba:' || image_id || ':' || iid || ':' || clause]] % 3 WHEN 0 THEN 'no' ELSE verdict END AS a,
      CASE h[['bb:' || image_id || ':' || iid || ':' || clause]] % 4 WHEN 0 THEN 'yes' ELSE verdict END AS b FROM verdicts""")

    def zipped(v):  # the per-instance zipped lists of a rationale file, exploded back to cells
        g = x.groupBy("image_id", "iid").agg(F.array_sort(F.collect_list(F.struct("clause", "label", col(v).alias("blind")))).alias("z"))
        return g.select("image_id", "iid", F.explode("z").alias("c")).select("image_id", "iid", "c.clause", "c.label", "c.blind")

    return J.compare_cells(zipped("a"), zipped("b"), ["image_id", "iid", "clause"], "label", "blind")
