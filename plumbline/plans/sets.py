"""Set construction over the long label table of the derived scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import text as T
from plumbline.operators import joins as J
from plumbline.operators import sets as SE
from plumbline.operators.windows import ordinal_positions
from plumbline.plans.geometry import gt
from plumbline.plans.joins import SQL_RECORDS, records
from plumbline.plans.registry import query
from plumbline.plans.tables import with_tables

col = F.col

CELLS = """
SELECT image_id * 2 + k AS item, image_id, iid, clause, verdict, k, CASE h[['nv:' || image_id || ':' || iid || ':' || clause]] % 5 WHEN 0 THEN 'yes' WHEN 1 THEN '??' ELSE 'no' END AS flipped_verdict,
  (iid * 37 + image_id) % 101 AS area FROM verdicts JOIN (VALUES (0), (1)) z(k) ON 1 = 1"""
MATRIX_ITEMS = """
SELECT DISTINCT image_id * 2 + k AS item, CASE WHEN k = 0 THEN 1 END AS answer_iid, 1 AS first_iid, CASE WHEN k = 1 THEN nullif(h[['fi:' || image_id]] % 6, 0) END AS flipped_idx FROM cand JOIN (VALUES (0), (1)) z(k) ON 1 = 1"""


@query("label_matrix", with_tables("verdicts", f"""
WITH c AS ({CELLS}), i AS ({MATRIX_ITEMS}), v AS (SELECT c.item, iid, area, answer_iid, CASE WHEN answer_iid = iid THEN 'yes' WHEN clause = flipped_idx AND iid = 1 THEN 'no' WHEN clause = flipped_idx THEN CASE WHEN flipped_verdict = '??' THEN 'unclear' ELSE flipped_verdict END
  ELSE verdict END AS v FROM c JOIN i USING (item)), r AS (SELECT item, iid, area, answer_iid, count(*) FILTER (v = 'no') AS n_no, count(*) FILTER (v = 'yes') AS n_yes FROM v GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY CASE WHEN iid = answer_iid THEN 0 ELSE 1 END, area DESC, iid) AS rn FROM r),
g AS (SELECT item, count(*) AS n_rows, count(*) FILTER (n_no = 0) AS n_fit, max(n_yes) FILTER (n_no = 0) AS top, max(n_yes) FILTER (n_no = 0 AND iid = answer_iid) AS ans FROM k WHERE rn <= 6 GROUP BY 1),
t AS (SELECT item, count(*) AS ties FROM k JOIN g USING (item) WHERE rn <= 6 AND n_no = 0 AND n_yes = top GROUP BY 1)
SELECT i.item, CASE WHEN answer_iid IS NULL AND flipped_idx IS NULL THEN 'no_flip' WHEN answer_iid IS NOT NULL AND NOT coalesce(ans = top AND ties = 1, false) THEN 'positive_not_unique' WHEN answer_iid IS NULL AND n_fit > 0 THEN 'negative_has_satisfier' ELSE 'ok' END AS reason,
  n_rows, n_fit FROM i JOIN g USING (item) LEFT JOIN t USING (item)"""))
def label_matrix(t):
    cells = t.sql(CELLS).select("item", "iid", "clause", "verdict", "flipped_verdict", "area")
    return SE.label_matrix(cells, t.sql(MATRIX_ITEMS))


REVIEW = "SELECT item_id AS image_id, CASE h[['rv:' || item_id]] % 9 WHEN 0 THEN 'ok' WHEN 1 THEN 'flip' WHEN 2 THEN 'bad' WHEN 3 THEN 'unsure' END AS verdict FROM items WHERE h[['rw:' || item_id]] % 5 > 0"
SIB = "CASE WHEN h[['es:' || image_id]] % 4 = 0 THEN NULL WHEN h[['es:' || image_id]] % 4 = 1 THEN 'The Cup ' || image_id ELSE 'the dish ' || image_id END"


@query("export_items", with_tables("items", f"""
WITH {SQL_RECORDS}, r AS (SELECT g.*, rv.verdict AS v, {SIB} AS es, 'the cup ' || g.image_id AS et FROM gates g LEFT JOIN ({REVIEW}) rv USING (image_id)),
a AS (SELECT *, coalesce(writer_target_all_yes, false) AND (coalesce(listener_unique_hit, false) OR coalesce(base_correct_on_target, false)) AS auto, v IS NULL OR v NOT IN ('bad', 'unsure') AS live, CASE WHEN v IS NULL THEN 'auto' ELSE 'reviewed' END AS source FROM r)
SELECT image_id, source, 'positive' AS kind, et AS expression, 1 AS target FROM a WHERE live AND (coalesce(v = 'ok', false) OR ((v IS NULL OR v = 'flip') AND auto))
UNION ALL SELECT image_id, source, 'sibling_positive', es, 2 FROM a WHERE live AND es IS NOT NULL AND lower(es) <> lower(et) AND coalesce(sibling_unique_hit, false)
UNION ALL SELECT image_id, source, 'negative', en, NULL FROM a WHERE live AND (coalesce(v = 'ok', false) OR (v IS NULL AND coalesce(negative_usable_sentence, false))) AND lower(en) <> lower(et)"""))
def export_items(t):
    rec = J.gate_flags(records(t))
    es = t.sql(f"SELECT item_id AS image_id, {SIB.replace('image_id', 'item_id')} AS e_s FROM items")
    d = rec.join(es, "image_id").withColumn("e_t", col("w.expr_target")).withColumn("e_neg", col("expr_neg")).withColumn("sibling_iid", F.lit(2))
    return SE.export_items(d, t.sql(REVIEW))


CHANCE = "SELECT image_id, iid, clause AS cand, CASE h[['sc:' || image_id || ':' || iid || ':' || clause]] % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'unclear' ELSE 'no' END AS new_verdict, h[['oo:' || image_id || ':' || iid]] % 3 > 0 AS others_open FROM verdicts"


@query("second_chance_select", with_tables("items verdicts", f"""
WITH {SQL_RECORDS}, c AS ({CHANCE}), f AS (SELECT o_orderkey AS image_id FROM orders WHERE o_totalprice > 400000),
td AS (SELECT image_id, CASE WHEN image_id IN (SELECT image_id FROM f) OR NOT flip_identified THEN 'flip_failed' WHEN NOT zero_satisfier_sentence THEN 'satisfied' END AS reason FROM gates),
s AS (SELECT image_id, cand, bool_or(new_verdict IN ('yes', 'unclear') AND others_open) AS sat FROM c GROUP BY 1, 2)
SELECT td.image_id, reason, min(cand) FILTER (NOT sat) AS chosen FROM td LEFT JOIN s ON s.image_id = td.image_id WHERE reason IS NOT NULL GROUP BY 1, 2"""))
def second_chance_select(t):
    forced = t.orders.filter("o_totalprice > 400000").select(col("o_orderkey").alias("image_id"))
    return SE.second_chance(J.gate_flags(records(t)), forced, t.sql(CHANCE))


@query("describe_job_select", with_tables("verdicts", """
WITH p AS (SELECT image_id, iid, count(*) FILTER (verdict = 'yes') AS facts FROM verdicts GROUP BY 1, 2), m AS (SELECT image_id FROM p GROUP BY 1 HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN iid = 1 + image_id % 3 THEN 0 ELSE 1 END, iid) AS rn FROM p WHERE facts >= 3 AND image_id IN (SELECT image_id FROM m)) SELECT image_id, iid, facts FROM r WHERE rn = 1"""))
def describe_job_select(t):
    targets = t.cand.filter("iid = 1 + image_id % 3").select("image_id", "iid")
    return SE.describe_jobs(t.verdicts, targets, "image_id", 3)


@query("sibling_choice", with_tables("inst", """
WITH b AS (SELECT DISTINCT image_id, nullif(h[['bx:' || image_id]] % 4, 0) AS boxed_iid FROM inst), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area_frac DESC, iid) AS rn FROM inst WHERE iid > 1)
SELECT b.image_id, CASE WHEN boxed_iid <> 1 THEN boxed_iid ELSE r.iid END AS iid, CASE WHEN boxed_iid <> 1 THEN 'boxed' ELSE 'largest' END AS reason FROM b LEFT JOIN r ON r.image_id = b.image_id AND rn = 1"""))
def sibling_choice(t):
    i = t.inst.select("image_id", "iid", col("area_frac").alias("area"), (col("iid") == 1).alias("is_target"))
    boxed = t.sql("SELECT DISTINCT image_id, nullif(h[['bx:' || image_id]] % 4, 0) AS boxed_iid FROM inst")
    return SE.sibling_choice(i, boxed, "image_id")


@query("unique_clause_items", with_tables("verdicts", """
WITH o AS (SELECT image_id, clause AS c1, CAST(NULL AS INT) AS c2, count(*) AS n, count(*) FILTER (verdict = 'yes') AS y, count(*) FILTER (verdict = 'no') AS x, max(iid) FILTER (verdict = 'yes') AS iid FROM verdicts GROUP BY 1, 2),
s AS (SELECT * FROM o WHERE n >= 2 AND y = 1 AND x = n - 1), p AS (SELECT a.image_id, a.clause AS c1, b.clause AS c2, count(*) AS n, count(*) FILTER (a.verdict = 'yes' AND b.verdict = 'yes') AS y,
  count(*) FILTER (NOT (a.verdict = 'yes' AND b.verdict = 'yes') AND (a.verdict = 'no' OR b.verdict = 'no')) AS x, max(a.iid) FILTER (a.verdict = 'yes' AND b.verdict = 'yes') AS iid
  FROM verdicts a JOIN verdicts b ON a.image_id = b.image_id AND a.iid = b.iid AND a.clause < b.clause WHERE a.image_id NOT IN (SELECT image_id FROM s) GROUP BY 1, 2, 3),
u AS (SELECT * FROM s UNION ALL SELECT * FROM p WHERE n >= 2 AND y = 1 AND x = n - 1), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY c1, c2) AS rn FROM u) SELECT image_id, c1, c2, iid FROM r WHERE rn <= 2"""))
def unique_clause_items(t):
    return SE.unique_clauses(t.verdicts, "image_id").select("image_id", "c1", "c2", "iid")


@query("clause_bank", with_tables("verdicts", """
WITH b AS (SELECT image_id, iid, clause // 2 AS k, arg_min(verdict, clause) AS verdict FROM verdicts GROUP BY 1, 2, 3), z AS (SELECT image_id, k, bool_and(verdict = 'no') AS flip FROM b GROUP BY 1, 2)
SELECT b.image_id, b.iid, b.k, b.verdict, flip AS verified_flip FROM b JOIN z ON z.image_id = b.image_id AND z.k = b.k"""))
def clause_bank(t):
    d = t.verdicts.withColumn("k", F.floor(col("clause") / 2).cast("int"))
    bank = SE.clause_bank(d, ["image_id", "iid", "k"], "clause")
    flips = SE.verified_flips(bank, "image_id", "k").withColumn("f", F.lit(True))
    return bank.join(flips, ["image_id", "k"], "left").select("image_id", "iid", "k", "verdict", F.coalesce("f", F.lit(False)).alias("verified_flip"))


CLAUSE_TEXT = "SELECT image_id, iid, verdict, (['red stripes', 'tall legs', 'wooden handle', 'open lid', 'left corner'])[clause] AS clause FROM verdicts"


@query("recomposed_items", with_tables("verdicts", f"""
WITH v AS ({CLAUSE_TEXT}), y AS (SELECT image_id, clause FROM v WHERE iid = 1 AND verdict = 'yes'), n AS (SELECT image_id, count(*) AS ny, least(3, count(*)) AS k FROM y GROUP BY 1 HAVING count(*) >= 2),
t AS (SELECT y.image_id, tr, clause, k, row_number() OVER (PARTITION BY y.image_id, tr ORDER BY md5('rc:' || y.image_id || ':' || tr || ':' || clause), clause) AS rn FROM y JOIN n USING (image_id), range(1, 81) z(tr)),
p AS (SELECT * FROM t WHERE rn <= k), o AS (SELECT p.image_id, tr, v.iid, bool_or(verdict = 'no') AS out, count(*) FILTER (verdict = 'yes') AS s FROM p JOIN v ON v.image_id = p.image_id AND v.clause = p.clause AND v.iid > 1 GROUP BY 1, 2, 3),
g AS (SELECT image_id, tr, bool_and(out) AS ok, sum(s) AS score FROM o GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, tr) AS rn FROM g WHERE ok)
SELECT b.image_id, string_agg(p.clause, ', ' ORDER BY p.rn) AS clauses, CAST(max(score) AS INT) AS score FROM b JOIN p ON p.image_id = b.image_id AND p.tr = b.tr WHERE b.rn = 1 GROUP BY 1"""))
def recomposed_items(t):
    arr = F.array(*[F.lit(s) for s in ("red stripes", "tall legs", "wooden handle", "open lid", "left corner")])
    v = t.verdicts.select("image_id", "iid", "verdict", F.element_at(arr, col("clause")).alias("clause"))
    return SE.recomposed(v, "image_id", 1, 3, 2, 80, "rc").select("image_id", F.array_join("clauses", ", ").alias("clauses"), "score")


@query("audit_row_items")
def audit_row_items(t):
    """Rows only: the pick depends on two nested greedy passes over words (see the tests)."""
    from plumbline.plans.joins import BANK

    b = t.sql(BANK)
    yes = b.filter("verdict = 'yes'").withColumnRenamed("clause_text", "clause")
    claims = b.filter("verdict = 'no'").withColumnRenamed("clause_text", "claim")
    seen = J.seen_from_bank(claims, yes, ["image_id", "iid"], "claim", "clause").withColumnRenamed("claim", "clause")
    return SE.audit_rows(yes, seen, ["image_id", "iid"], 6, 0.25, 2, "ar").select("image_id", "iid", "attempt", F.array_join("conds", "; ").alias("conds"), F.size("errs").alias("n_err"))


DETAILS = "SELECT image_id, clause AS idx, iid, iid = 1 AS is_target, CASE WHEN iid = 1 AND h[['dt:' || image_id || ':' || clause]] % 4 > 0 THEN 'yes' ELSE verdict END AS verdict FROM verdicts"
FLIPS = "SELECT image_id, clause AS flip, 1 + h[['fx:' || image_id || ':' || clause]] % 5 AS idx, iid, CASE WHEN h[['fz:' || image_id || ':' || clause]] % 2 = 0 THEN 'no' ELSE verdict END AS verdict FROM verdicts"


@query("style_items", with_tables("verdicts", f"""
WITH d AS ({DETAILS}), f AS ({FLIPS}), k AS (SELECT image_id, idx FROM d WHERE is_target AND verdict = 'yes'), e AS (SELECT image_id FROM k GROUP BY 1 HAVING count(*) >= 2), kk AS (SELECT * FROM k WHERE image_id IN (SELECT image_id FROM e)),
o AS (SELECT d.image_id, iid, bool_or(verdict = 'no') AS out FROM d JOIN kk ON kk.image_id = d.image_id AND kk.idx = d.idx WHERE NOT is_target GROUP BY 1, 2),
u AS (SELECT f.image_id, flip, f.idx FROM f GROUP BY 1, 2, 3 HAVING bool_and(verdict = 'no')), uk AS (SELECT u.* FROM u JOIN kk ON kk.image_id = u.image_id AND kk.idx = u.idx)
SELECT image_id, 'positive' AS kind, CAST(NULL AS INT) AS f1, CAST(NULL AS INT) AS f2 FROM e WHERE image_id NOT IN (SELECT image_id FROM o WHERE NOT out) UNION ALL SELECT image_id, 'negative', flip, NULL FROM uk
UNION ALL SELECT a.image_id, 'two_error', a.flip, b.flip FROM uk a JOIN uk b ON a.image_id = b.image_id AND a.flip < b.flip AND a.idx <> b.idx"""))
def style_items(t):
    return SE.style_items(t.sql(DETAILS), t.sql(FLIPS), "image_id", 2)


@query("spatial_pair_items")
def spatial_pair_items(t):
    """Rows only: the seeded pair needs verdict arrays of every condition (see the tests)."""
    c = t.cand.select("image_id", "iid", "x0", "y0", "x1", "y1").withColumn("_n", F.count("*").over(_by_image())).filter("_n BETWEEN 3 AND 6")
    ref = c.filter("iid = _n").select("image_id", G.box(col("x0"), col("y0"), col("x1"), col("y1")).alias("r"))
    cands = c.filter("iid < _n").drop("_n")
    d = ordinal_positions(cands, "image_id", "iid", (col("x0") + col("x1")) / 2, 1000, "x", "box")
    per = d.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("iid", "k", "phrase", gt().alias("b")))).alias("cs")).join(ref, "image_id")
    ords = per.filter(F.get("cs", F.lit(0))["k"].isNotNull()).select("image_id", F.explode("cs").alias("c"), "cs").select(
        "image_id", col("c.k").alias("cond"), F.lit("ord").alias("kind"), F.lit("x").alias("axis"), col("c.phrase").alias("text"),
        F.transform("cs", lambda x: F.when(x["k"] == col("c.k"), "yes").otherwise("no")).alias("verdicts"), F.lit(None).cast("string").alias("opp_text"), F.lit(None).cast("array<string>").alias("opp_verdicts"))
    opposite = {"left": "right", "right": "left", "above": "below", "below": "above"}
    wording = {"left": "is to the left of the lamp", "right": "is to the right of the lamp", "above": "is above the lamp", "below": "is below the lamp"}

    def verdicts(side):
        return F.transform("cs", lambda x: G.side_verdict(x["b"], col("r"), side, 1000, 800))

    sides = F.array(*[F.struct(F.lit(100 + i).cast("bigint").alias("cond"), F.lit(wording[s]).alias("text"), verdicts(s).alias("verdicts"), F.lit(wording[o]).alias("opp_text"),
                               verdicts(o).alias("opp_verdicts")) for i, (s, o) in enumerate(opposite.items())])
    rels = per.select("image_id", F.explode(sides).alias("s")).filter(F.forall("s.verdicts", lambda v: v.isNotNull())).select(
        "image_id", "s.cond", F.lit("rel").alias("kind"), F.lit("-").alias("axis"), "s.text", "s.verdicts", F.when(F.forall("s.opp_verdicts", lambda v: v.isNotNull()), col("s.opp_text")).alias("opp_text"), "s.opp_verdicts")
    p = SE.spatial_pairs(ords.unionByName(rels), "image_id", "sp")
    return p.select("image_id", "target", "a", "b", "neg_of", "neg_text", T.condition_phrase(F.lit("box"), F.array("a", "b")).alias("expression"))


def _by_image():
    from pyspark.sql import Window

    return Window.partitionBy("image_id")


ALTS = """SELECT image_id, clause AS alt, iid, iid = 1 AS is_target, CASE h[['av:' || image_id || ':' || iid || ':' || clause]] % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'unparsed' ELSE 'no' END AS alt_verdict,
  h[['no:' || image_id || ':' || iid]] % 5 AS n_others, h[['ob:' || image_id || ':' || iid]] % 2 = 0 AS others_not_no FROM verdicts"""


@query("alternative_negatives", with_tables("verdicts", f"""
WITH a AS ({ALTS}) SELECT image_id, alt FROM a GROUP BY 1, 2 HAVING bool_or(is_target AND alt_verdict = 'no') AND NOT bool_or(NOT is_target AND alt_verdict <> 'no' AND n_others > 0 AND others_not_no)"""))
def alternative_negatives(t):
    return SE.alternative_negatives(t.sql(ALTS), ["image_id", "alt"])


# the clauses of one scene asked of the instances of another: two images with neighbouring numbers
CROSS = """SELECT s.image_id AS src, c.image_id AS dst, c.iid, s.clause, CASE WHEN h[['cv:' || s.image_id || ':' || c.image_id || ':' || c.iid || ':' || s.clause]] % 10 < 7 THEN 'yes' WHEN h[['cu:' || c.image_id || ':' || c.iid || ':' || s.clause]] % 3 = 0 THEN 'unclear' ELSE 'no' END AS verdict
FROM (SELECT image_id, clause FROM verdicts WHERE iid = 1 AND verdict = 'yes') s JOIN cand c ON c.image_id = s.image_id + 1"""


@query("cross_scene_negatives", with_tables("verdicts", f"""
WITH c AS ({CROSS}), i AS (SELECT src, dst, iid, bool_and(verdict <> 'no') AS s FROM c GROUP BY 1, 2, 3)
SELECT src, dst, count(*) FILTER (s) AS n_satisfiers, count(*) FILTER (s) = 0 AS usable FROM i GROUP BY 1, 2"""))
def cross_scene_negatives(t):
    """What is true of one scene's target, checked on every instance of another scene: a negative where none fits."""
    return SE.cross_negatives(t.sql(CROSS), ["src", "dst"])


@query("mosaic_label_rows", with_tables("verdicts", """
WITH s AS (SELECT image_id, iid, bool_or(verdict = 'no') AS bad, count(*) FILTER (verdict = 'yes') AS n_yes FROM verdicts GROUP BY 1, 2), p AS (SELECT DISTINCT image_id AS pa, image_id + 1 AS pb FROM cand),
b AS (SELECT p.pa, p.pb, c.iid + 100 AS iid, c.x0 * 0.5e0 + 500.0e0 AS x0, n_yes, bad FROM p JOIN cand c ON c.image_id = p.pb JOIN s ON s.image_id = c.image_id AND s.iid = c.iid),
f AS (SELECT pa, pb FROM b GROUP BY 1, 2 HAVING bool_and(bad))
SELECT f.pa, f.pb, c.iid, c.x0, n_yes FROM f JOIN cand c ON c.image_id = f.pa JOIN s ON s.image_id = c.image_id AND s.iid = c.iid UNION ALL SELECT b.pa, b.pb, iid, x0, n_yes FROM b JOIN f ON f.pa = b.pa AND f.pb = b.pb"""))
def mosaic_label_rows(t):
    from plumbline.operators.traces import verdict_rows

    v = verdict_rows(t.verdicts, ["image_id", "iid"], "clause", "verdict")
    rows = t.cand.select("image_id", "iid", gt().alias("box")).join(v, ["image_id", "iid"])
    a = rows.select(col("image_id").alias("pa"), (col("image_id") + 1).alias("pb"), "iid", "box", "verdicts")
    b = rows.select((col("image_id") - 1).alias("pa"), col("image_id").alias("pb"), "iid", "box", "verdicts").join(a.select("pa", "pb").distinct(), ["pa", "pb"])
    m = SE.mosaic_rows(a, b, ["pa", "pb"], F.lit(0.5), F.lit(500.0))
    return m.select("pa", "pb", "iid", col("box.x0").alias("x0"), F.size(F.filter("verdicts", lambda x: x == "yes")).cast("bigint").alias("n_yes"))


@query("control_copies", """
SELECT item_id, control, control = 'gray' AS gray, CASE control WHEN 'null_expression' THEN 'the object' ELSE text END AS expr FROM benchmark, (VALUES ('none'), ('gray'), ('null_expression')) c(control)""")
def control_copies(t):
    return SE.control_copies(t.benchmark.select("item_id", col("text").alias("expr"))).select("item_id", "control", "gray", "expr")


@query("caption_sample_items", with_tables("", """
WITH b AS (SELECT p_partkey AS id, p_brand AS source, list_filter([p_name, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE 'a ' || p_type END, CASE WHEN p_partkey % 2 = 0 THEN 'the ' || p_name END], lambda c: c IS NOT NULL AND trim(c) <> '') AS cs, p_size AS w, p_partkey % 17 AS hh FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('cap:' || id), id) AS rn FROM b WHERE len(cs) > 0 AND w > 1 AND hh > 1) SELECT id, source, cs[1 + h[['cap:' || id || ':cap']] % len(cs)] AS caption FROM r WHERE rn <= 30"""))
def caption_sample_items(t):
    n, p = col("p_name"), col("p_partkey")
    caps = F.array(n, F.when(p % 3 == 0, " ").otherwise(F.concat(F.lit("a "), "p_type")), F.when(p % 2 == 0, F.concat(F.lit("the "), n)))
    d = t.part.select(p.alias("id"), col("p_brand").alias("source"), caps.alias("captions"), col("p_size").alias("w"), (p % 17).alias("h"))
    return SE.caption_sample(d, "id", F.col("captions"), "source", 30, "cap", col("w"), col("h")).select("id", "source", "caption")


OWN = "SELECT 'o' || item_id AS id, 'own:' || lower(dimension) AS source, kind FROM evals WHERE grp % 10 = 0"
HUM = "SELECT 'p' || item_id AS id, 'human:' || grp % 3 AS source FROM evals WHERE kind = 'positive' AND grp % 10 > 0"
TWIN = "SELECT 't' || item_id AS id, 'twin:' || grp % 3 AS source, 'e' || h[['ed:' || item_id]] % 4 AS edit, 'p' || item_id AS twin_of FROM evals WHERE kind = 'positive' AND grp % 10 > 0 AND h[['tw:' || item_id]] % 2 = 0"


@query("scoring_set", with_tables("evals", f"""
WITH o AS ({OWN}), p AS ({HUM}), t AS ({TWIN}), s AS (SELECT count(*) AS n, count(*) FILTER (kind = 'positive') AS np, count(*) FILTER (kind = 'negative') AS nn FROM o),
z AS (SELECT greatest(0, (greatest(0, 600 - n) + nn - np) // 2) AS n_pos, greatest(0, greatest(0, 600 - n) - greatest(0, (greatest(0, 600 - n) + nn - np) // 2)) AS n_twin FROM s),
tr AS (SELECT *, row_number() OVER (PARTITION BY source, edit ORDER BY md5('ss:' || id), id) AS turn FROM t), tk AS (SELECT *, row_number() OVER (ORDER BY turn, source, edit) AS g FROM tr), ct AS (SELECT * FROM tk WHERE g <= (SELECT n_twin FROM z)),
pn AS (SELECT p.*, CASE WHEN id IN (SELECT twin_of FROM ct) THEN 0 ELSE 1 END AS need FROM p), pk AS (SELECT *, row_number() OVER (ORDER BY need, md5('ss:' || id), id) AS g FROM pn),
u AS (SELECT id, source, kind, 0 AS need FROM o UNION ALL SELECT id, source, 'positive', need FROM pk WHERE g <= (SELECT n_pos FROM z) UNION ALL SELECT id, source, 'negative', 0 FROM ct)
SELECT id, source, kind, row_number() OVER (PARTITION BY source ORDER BY need, md5('ss:' || id), id) <= (count(*) OVER (PARTITION BY source) + 1) // 2 AS half FROM u"""))
def scoring_set(t):
    return SE.scoring_set(t.sql(OWN), t.sql(HUM), t.sql(TWIN), 600, "ss")


@query("pool_and_probe_items", with_tables("", """
WITH u AS (SELECT 'd' || doc_id AS id, text AS expr, 'docs' AS set FROM documents UNION ALL SELECT 'b' || item_id, text, 'bench' FROM benchmark UNION ALL SELECT 'c' || conv_id || '-' || turn, text, 'conv' FROM conversations)
SELECT id, set, length(expr) AS n_chars, row_number() OVER (PARTITION BY set ORDER BY md5('pb:' || id), id) <= 40 AS probe FROM u"""))
def pool_and_probe_items(t):
    def p(prefix, key, df):
        return df.select(F.concat(F.lit(prefix), key).alias("id"), col("text").alias("expr"))

    src = [("docs", p("d", col("doc_id").cast("string"), t.documents)), ("bench", p("b", col("item_id").cast("string"), t.benchmark)),
           ("conv", p("c", F.concat_ws("-", col("conv_id"), col("turn")), t.conversations))]
    return SE.probe_items(src, "id", 40, "pb").select("id", "set", F.length("expr").alias("n_chars"), "probe")


_NEG = "CASE l_suppkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'image' END"


@query("item_adapters", with_tables("", f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 10 = 0),
c AS (SELECT 'coco:doc' || o_custkey || '.json/' || (l_orderkey * 10 + l_linenumber) AS id, CASE WHEN l_partkey % 3 = 0 THEN 'scene ' || l_orderkey ELSE 'part ' || l_partkey END AS expr,
   CASE WHEN l_suppkey % 4 < 2 THEN 'neg_' || {_NEG} || '_t' || l_tax ELSE 'pos_level' || l_linenumber END AS "set", CASE WHEN l_suppkey % 4 < 2 THEN 0 ELSE 1 END AS n_gt, l_partkey + l_quantity AS x1,
   CASE WHEN l_suppkey % 4 = 1 THEN 'final_neg_images/neg_' ELSE 'images/' END || 'i' || l_orderkey || '_' || (l_suppkey % 4 = 1)::INT || '.jpg' AS image FROM l),
r AS (SELECT 'refs:' || (o_orderkey * 10 + k) AS id, 'ref ' || o_orderkey || ' ' || k AS expr, (['train', 'val', 'testA', 'testB'])[o_custkey % 4 + 1] AS split, o_orderkey % 5 AS none, 'o' || o_orderkey || '.jpg' AS image, o_orderkey,
   o_custkey + 50 AS x1 FROM orders, range(0, 2) z(k) WHERE o_orderkey % 7 > 0)
SELECT 'lines:' || doc_id AS id, 'the ' || lang AS expr, source AS "set", CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS n_gt, CASE WHEN doc_id % 3 > 0 THEN CAST(n_chars AS DOUBLE) END AS x1, 'd' || doc_id || '.jpg' AS image FROM documents
UNION ALL SELECT 'percent:' || lab || ':b' || item_id || '.jpg', 'item ' || item_id, lab, CASE lab WHEN 'none' THEN 0 ELSE 1 END, CASE lab WHEN 'single' THEN (item_id % 50 + 25) / 100.0e0 * 800 END, 'b' || item_id || '.jpg' FROM benchmark, (VALUES ('none'), ('single')) z(lab)
UNION ALL SELECT id, expr, "set", n_gt, CASE n_gt WHEN 1 THEN CAST(x1 AS DOUBLE) END, image FROM c
UNION ALL SELECT id, expr, split || CASE WHEN none < 2 THEN '_none' ELSE '_single' END, CASE WHEN none < 2 THEN 0 ELSE 1 END, CASE WHEN none >= 2 THEN CAST(x1 AS DOUBLE) END, image FROM r WHERE split <> 'train' AND (none < 2 OR split <> 'val' AND none < 4)"""))
def item_adapters(t):
    """Four published formats, each written from the tables and read by its own adapter."""
    from plumbline.session import scratch_path
    from plumbline.sources import adapters as A
    from plumbline.sources import sinks as W

    base, text = scratch_path(t.spark, "formats"), lambda *c: F.concat(*[x.cast("string") for x in c])
    d = t.documents
    boxes = F.when(col("doc_id") % 3 > 0, F.array(F.array(F.lit(0.0), F.lit(0.0), col("n_chars").cast("double"), F.lit(9.0)))).otherwise(F.array().cast("array<array<double>>"))
    d.select(col("doc_id").cast("string").alias("id"), text(F.lit("the "), col("lang")).alias("referring"), boxes.alias("answer_boxes"), col("source").alias("domain"), text(F.lit("d"), col("doc_id"), F.lit(".jpg")).alias("image_name")).write.json(f"{base}/lines")

    def array_of(df, folder, name, order):
        """Files that hold one JSON array each."""
        rows = df.groupBy(name).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "j"))), lambda x: x["j"]), ",\n").alias("j"))
        W.write_named(rows.select(name, F.concat(F.lit("["), "j", F.lit("]")).alias("value")), f"{base}/{folder}", name, ".json")

    i = col("item_id")
    part = F.struct(F.lit(800.0).alias("original_width"), F.lit(600.0).alias("original_height"), (i % 50).cast("double").alias("x"), F.lit(10.0).alias("y"), F.lit(25.0).alias("width"), F.lit(5.0).alias("height"))
    items = t.benchmark.select("item_id", F.to_json(F.struct(text(F.lit("b"), i, F.lit(".jpg")).alias("image"), text(F.lit("item "), i).alias("positive"), F.lit(1).alias("bbox_num"), F.array(part).alias("proposal"))).alias("j"))
    array_of(items.withColumn("file", F.concat(F.lit("f"), (i / 1000).cast("int").cast("string"))), "percent", "file", "item_id")

    o = t.orders.where("o_custkey % 10 = 0").select("o_orderkey", "o_custkey")
    lines = t.lineitem.join(o, col("l_orderkey") == col("o_orderkey"))
    cut = (col("l_suppkey") % 4 == 1).cast("int")
    name = F.concat(F.when(cut == 1, "neg_").otherwise(""), text(F.lit("i"), col("l_orderkey"), F.lit("_"), cut, F.lit(".jpg")))
    images = lines.select("o_custkey", F.struct((col("l_orderkey") * 2 + cut).alias("id"), name.alias("file_name"), text(F.lit("scene "), col("l_orderkey")).alias("caption")).alias("i")).groupBy("o_custkey").agg(F.collect_set("i").alias("images"))
    kind = F.when(col("l_suppkey") % 4 == 0, "text").when(col("l_suppkey") % 4 == 1, "image")
    words = text(F.lit("part "), col("l_partkey"))
    ann = F.struct((col("l_orderkey") * 10 + col("l_linenumber")).alias("id"), (col("l_orderkey") * 2 + cut).alias("image_id"), F.array(col("l_partkey").cast("double"), F.lit(1.0), col("l_quantity").cast("double"), F.lit(2.0)).alias("bbox"),
                   F.when(col("l_partkey") % 3 == 1, words).when(col("l_partkey") % 3 == 0, "").alias("expression"), F.when(col("l_partkey") % 3 == 2, words).alias("caption"), kind.alias("negative_cate"),
                   F.when(kind.isNotNull(), text(F.lit("t"), col("l_tax"))).alias("negative_type"), col("l_linenumber").alias("level"))
    coco = lines.groupBy("o_custkey").agg(F.collect_list(ann).alias("annotations")).join(images, "o_custkey")
    W.write_named(coco.select(text(F.lit("doc"), col("o_custkey")).alias("name"), F.to_json(F.struct("images", "annotations"), {"pretty": "true"}).alias("value")), f"{base}/coco", "name", ".json")

    k = col("o_orderkey")
    no = k % 5 < 2
    several = F.when(k % 5 == 4, F.array(k, k + 1)).otherwise(F.array(k))
    ref = F.struct(F.when(k % 5 == 0, F.array(F.lit(-1).cast("bigint"))).otherwise(several).alias("ann_id"), text(F.lit("o"), k, F.lit(".jpg")).alias("file_name"),
                   F.element_at(F.array(*[F.lit(x) for x in ("train", "val", "testA", "testB")]), (col("o_custkey") % 4 + 1).cast("int")).alias("split"), F.when(k % 5 == 1, True).alias("no_target"),
                   F.array(*[F.struct((k * 10 + n).alias("sent_id"), text(F.lit("ref "), k, F.lit(f" {n}")).alias("sent")) for n in (0, 1)]).alias("sentences"))
    refs = t.orders.select("o_orderkey", F.concat(F.lit("r"), (col("o_custkey") / 100).cast("int").cast("string")).alias("file"), F.to_json(ref).alias("j"))
    array_of(refs, "refs", "file", "o_orderkey")
    first = t.orders.select(F.concat(F.lit("n"), (k / 10000).cast("int").cast("string")).alias("file"), F.struct(k.alias("id"), F.array(col("o_custkey").cast("double"), F.lit(1.0), F.lit(50.0), F.lit(2.0)).alias("bbox")).alias("a"))
    W.write_named(first.groupBy("file").agg(F.to_json(F.struct(F.collect_list("a").alias("annotations"))).alias("value")), f"{base}/instances", "file", ".json")
    seen = t.orders.where("o_orderkey % 7 = 0").groupBy((col("o_custkey") % 3).cast("string").alias("name")).agg(F.collect_list(text(F.lit("o"), k, F.lit(".jpg"))).alias("names"))
    W.write_named(seen.select("name", F.to_json(F.create_map(F.concat(F.lit("set"), "name"), "names")).alias("value")), f"{base}/overlap", "name", ".json")

    out = A.unite([A.boxed_lines(t.spark, f"{base}/lines", "lines"), *[A.percent_boxes(t.spark, f"{base}/percent", "percent", x) for x in ("none", "single")], A.coco_negatives(t.spark, f"{base}/coco", "coco"),
                   A.refs_with_instances(t.spark, f"{base}/refs", f"{base}/instances", f"{base}/overlap", "refs")])
    return out.select("id", "expr", "set", "n_gt", F.get("gt_boxes", F.lit(0))["x1"].alias("x1"), "image")


@query("example_expansion", with_tables("cand", """
WITH n AS (SELECT image_id, count(*) AS n FROM cand GROUP BY 1) SELECT image_id, part FROM n, range(-1, 20) r(part) WHERE part <= n"""))
def example_expansion(t):
    n = t.cand.groupBy("image_id").agg(F.count("*").alias("n"))
    return SE.expand_examples(n, col("n")).select("image_id", "part")


LINES = """SELECT item_id, CASE h[['sp:' || item_id]] % 4 WHEN 0 THEN 'all_true' WHEN 1 THEN 'false_word' WHEN 2 THEN 'verdicts' ELSE 'none' END AS spec, CASE WHEN h[['fw:' || item_id]] % 3 = 0 THEN 'blue' ELSE 'red' END AS fw, CASE WHEN h[['l3:' || item_id]] % 2 = 0 THEN 'a red lid' ELSE 'two legs' END AS l3,
  CASE WHEN h[['va:' || item_id]] % 2 = 0 THEN 'yes' ELSE 'no' END AS va, CASE WHEN h[['vb:' || item_id]] % 3 = 0 THEN 'unclear' ELSE 'yes' END AS vb FROM items"""


@query("line_labels", with_tables("items", f"""
WITH x AS ({LINES}), k AS (SELECT *, CASE fw WHEN 'red' THEN 1 + CASE WHEN l3 LIKE '%red%' THEN 1 ELSE 0 END ELSE 0 END AS hits FROM x)
SELECT item_id, CASE spec WHEN 'all_true' THEN 0 WHEN 'false_word' THEN CASE WHEN hits = 1 THEN 1 END WHEN 'verdicts' THEN CASE va WHEN 'yes' THEN 0 ELSE 1 END END AS a,
  CASE spec WHEN 'all_true' THEN 0 WHEN 'false_word' THEN CASE WHEN hits = 1 THEN 0 END WHEN 'verdicts' THEN CASE vb WHEN 'yes' THEN 0 END END AS b,
  CASE spec WHEN 'all_true' THEN 0 WHEN 'false_word' THEN CASE WHEN hits = 1 THEN 0 END END AS c FROM k"""))
def line_labels(t):
    lines = F.array(F.lit("is Red all over"), F.lit("has a wooden handle"), col("l3"))
    lab = SE.line_labels(lines, col("spec"), col("fw"), F.array(F.lit("is red all over"), F.lit("a handle, wooden")), F.array("va", "vb"))
    return t.sql(LINES).select("item_id", lab.alias("l")).select("item_id", *[F.get("l", F.lit(i)).alias(n) for i, n in enumerate("abc")])


BASE_ITEMS = "SELECT item_id, grp, CASE WHEN item_id % 3 = 0 THEN 'sibling_positive' ELSE kind END AS kind, item_id % 4 = 0 AS reflipped FROM evals"
BASE_POLICY = """SELECT c_custkey AS grp, which, c_custkey * 10 + CASE which WHEN 'target' THEN 1 WHEN 'sibling' THEN 2 WHEN 'neg' THEN 3 ELSE 4 END AS answer FROM customer JOIN (VALUES ('target'), ('sibling'), ('neg'), ('neg2')) w(which) ON 1 = 1 WHERE c_acctbal > 0 OR which = 'target'"""


@query("base_answer_lookup", with_tables("evals", f"""
WITH i AS (SELECT *, CASE kind WHEN 'positive' THEN 'target' WHEN 'sibling_positive' THEN 'sibling' ELSE CASE WHEN reflipped THEN 'neg2' ELSE 'neg' END END AS which FROM ({BASE_ITEMS}) z) SELECT item_id, which, answer FROM i LEFT JOIN ({BASE_POLICY}) p USING (grp, which)"""))
def base_answer_lookup(t):
    return SE.base_answers(t.sql(BASE_ITEMS), t.sql(BASE_POLICY), "grp").select("item_id", "which", "answer")


SECOND = "SELECT image_id, iid, clause, CASE h[['ck:' || image_id || ':' || iid || ':' || clause]] % 6 WHEN 0 THEN 'no' WHEN 1 THEN 'unclear' ELSE verdict END AS verdict FROM verdicts"


@query("ab_checker_agreement", with_tables("verdicts", f"""
SELECT clause, count(*) AS n, avg(CASE WHEN a.verdict = b.verdict THEN 1.0e0 ELSE 0.0e0 END) AS agree FROM verdicts a JOIN ({SECOND}) b USING (image_id, iid, clause) WHERE a.verdict <> 'unclear' AND b.verdict <> 'unclear' GROUP BY 1"""))
def ab_checker_agreement(t):
    return SE.checker_agreement(t.verdicts, t.sql(SECOND), ["image_id", "iid", "clause"], ["clause"])
