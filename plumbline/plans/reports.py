"""Summary tables over derived evaluation rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import reports as RP
from plumbline.operators import stats as S
from plumbline.operators.ranks import exact_quantiles, upper_median
from plumbline.plans.geometry import sql_iou
from plumbline.plans.registry import query
from plumbline.plans.tables import with_tables
from plumbline.session import cut_lineage
from plumbline.plans.text import SQL_BOX, parsed_answers

col = F.col


def b(flag: str, where: str | None = None) -> str:
    """SQL mean of a flag over a denominator."""
    return f"avg(CASE WHEN {flag} THEN 1.0e0 ELSE 0.0e0 END)" + (f" FILTER ({where})" if where else "")


@query("collect_labels_and_boxes", with_tables("inst", """
SELECT image_id, array_to_string(list_sort(list_distinct(list(label))), '; ') AS labels, count(DISTINCT label) AS n_labels, count(*) AS n_boxes,
  string_agg(label || '@' || CAST(x0 AS INT) || ',' || CAST(y0 AS INT), ' ' ORDER BY iid) AS boxes, max(area_frac) AS largest FROM inst GROUP BY 1"""))
def collect_labels_and_boxes(t):
    from plumbline.operators.boxes import image_profile

    tag = F.concat("label", F.lit("@"), col("x0").cast("int").cast("string"), F.lit(","), col("y0").cast("int").cast("string"))
    p = image_profile(t.inst.withColumn("tag", tag), "image_id", "label", "iid", ["tag"], {"largest": F.max("area_frac")})
    return p.select("image_id", F.array_join("labels", "; ").alias("labels"), F.size("labels").cast("bigint").alias("n_labels"), "n_boxes",
                    F.array_join(F.transform("boxes", lambda x: x["tag"]), " ").alias("boxes"), "largest")


@query("count_and_median_table", with_tables("inst", """
SELECT source, coalesce(label, '-') AS label, count(*) AS n, count(DISTINCT image_id) AS n_images, round(quantile_cont(area_frac, 0.5), 9) AS median FROM inst GROUP BY 1, 2"""))
def count_and_median_table(t):
    d = t.inst.select("source", F.coalesce("label", F.lit("-")).alias("label"), "area_frac", "image_id")
    return RP.count_and_median(d, ["source", "label"], col("area_frac"), "image_id").withColumn("median", F.round("median", 9))


@query("success_by_class_source", with_tables("", """
WITH x AS (SELECT CASE WHEN l_returnflag = 'N' THEN 'REMOVE' ELSE 'CONTROL_OBJ' END AS op, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE 'src' || l_linenumber % 4 END AS src,
  h[['an:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey]] % 5 AS a FROM lineitem)
SELECT op, coalesce(src, CASE WHEN op = 'REMOVE' THEN '-' ELSE 'unknown' END) AS source, count(*) AS n, avg(CASE WHEN a IN (1, 2) THEN 1.0e0 ELSE 0.0e0 END) AS rate FROM x GROUP BY 1, 2"""))
def success_by_class_source(t):
    x = t.sql("""SELECT CASE WHEN l_returnflag = 'N' THEN 'REMOVE' ELSE 'CONTROL_OBJ' END AS op, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE 'src' || l_linenumber % 4 END AS src,
      CASE h[['an:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey]] % 5 WHEN 0 THEN 'Yes.' WHEN 1 THEN 'no' WHEN 2 THEN 'Nope, gone' WHEN 3 THEN '??' ELSE 'maybe' END AS answer FROM lineitem""")
    source = F.coalesce("src", F.when(col("op") == "REMOVE", "-").otherwise("unknown"))
    removed = F.coalesce(~T.yes_no(col("answer")), F.lit(False))
    return x.groupBy("op", source.alias("source")).agg(F.count("*").alias("n"), RP.share(removed).alias("rate"))


@query("eval_summary", with_tables("items answers evals", "WITH " + SQL_BOX + f"""
, s AS (SELECT i.dimension, CASE WHEN no_target THEN 0 ELSE 1 END AS n_gt, p.*, CASE WHEN no_target THEN output_type <> 'box'
   ELSE output_type = 'box' AND {sql_iou('p.', 'i.g')} >= 0.5 END AS correct FROM parsed p JOIN items i USING (item_id)),
g AS (SELECT dimension, count(*) AS n, {b('correct', 'n_gt = 0')} AS rejection_acc, count(*) FILTER (n_gt = 0) AS rejection_n, {b('correct', 'n_gt > 0')} AS positive_acc,
  count(*) FILTER (n_gt > 0) AS positive_n, {b("output_type IN ('none', 'refusal')", 'n_gt > 0')} AS positive_null_rate, {b("output_type <> 'invalid'")} AS format_ok_rate, GROUPING(dimension) AS level
  FROM s GROUP BY ROLLUP (dimension)),
ev AS (SELECT dimension, GROUPING(dimension) AS level, count(p_null) AS p_null_n, round(sum(p_null), 6) AS p_sum, round(log10(greatest(quantile_cont(p_null, 0.5), 1e-30)), 9) AS p_median_log10, {b('p_null >= 0.1', 'p_null IS NOT NULL')} AS p_ge_01,
  {b('parse_ok')} AS trace_format_ok_rate, {b('consistent')} AS consistent_rate, sum(false_no) / greatest(1, sum(n_cells) FILTER (false_no IS NOT NULL)) AS false_no_cell_rate, {b('false_no > 0', 'false_no IS NOT NULL')} AS false_no_item_rate FROM evals GROUP BY ROLLUP (dimension))
SELECT g.*, rejection_acc - positive_null_rate AS net_rejection, ev.* EXCLUDE (dimension, level) FROM g JOIN ev ON g.level = ev.level AND g.dimension IS NOT DISTINCT FROM ev.dimension"""))
def eval_summary(t):
    """Raw answers parsed, scored against the item's box and summarised by dimension with totals."""
    from plumbline.functions import geometry as G

    i = t.items.select("item_id", "dimension", col("no_target"), G.box(col("gx0"), col("gy0"), col("gx1"), col("gy1")).alias("gt"))
    p = parsed_answers(t).join(i, "item_id").withColumn("n_gt", F.when(col("no_target"), 0).otherwise(1))
    hit = (col("output_type") == "box") & (G.iou(col("box"), col("gt")) >= 0.5)
    p = p.withColumn("correct", F.when(col("n_gt") == 0, col("output_type") != "box").otherwise(F.coalesce(hit, F.lit(False))))
    extra = t.evals.select("item_id", "p_null", col("parse_ok").alias("format_ok"), "consistent", "false_no", "n_cells")
    out = RP.eval_report(p.join(extra, "item_id"), "dimension", "p_null")
    return out.withColumn("p_sum", F.round("p_sum", 6)).withColumn("p_median_log10", F.round("p_median_log10", 9))


@query("accuracy_at_thresholds", with_tables("evals", "WITH g AS (SELECT dimension, GROUPING(dimension) AS level, count(*) AS n, " + ", ".join(f"{b(f'iou >= {x}')} AS a{i}" for i, x in enumerate(RP.IOU_STEPS))
       + " FROM evals WHERE n_gt > 0 GROUP BY ROLLUP (dimension)), m AS (SELECT *, (" + " + ".join(f"a{i}" for i in range(10)) + ") / 10 AS mean FROM g) "
       + " UNION ALL ".join(f"SELECT dimension, level, n, CAST({x} AS DOUBLE) AS threshold, a{i} AS accuracy FROM m" for i, x in enumerate(RP.IOU_STEPS)) + " UNION ALL SELECT dimension, level, n, NULL, mean FROM m"))
def accuracy_at_thresholds(t):
    return RP.accuracy_at_thresholds(t.evals.filter("n_gt > 0"), ["dimension"], col("iou"))


@query("grouping_total_rows", with_tables("evals", f"""
SELECT dimension, size_bin, GROUPING(dimension) * 2 + GROUPING(size_bin) AS level, count(*) AS n, {b('correct')} AS acc FROM evals GROUP BY GROUPING SETS ((dimension, size_bin), (dimension), ())"""))
def grouping_total_rows(t):
    d = t.evals.rollup("dimension", "size_bin").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), RP.share(col("correct")).alias("acc"))
    return d


@query("precheck_report", with_tables("evals", f"""
SELECT dimension, count(*) AS n, count(*) FILTER (iou >= 0.5) AS correct, {b('iou >= 0.5')} AS acc, {b("output_type = 'none'")} AS declined, {b('ordinal')} AS ordinal,
  count(*) FILTER (NOT ordinal) AS kept, CAST(round_even(count(*) FILTER (NOT ordinal AND iou >= 0.5) * 0.6e0, 0) AS BIGINT) AS projected FROM evals WHERE n_gt = 1 GROUP BY ROLLUP (dimension)"""))
def precheck_report(t):
    hit = col("iou") >= 0.5
    d = t.evals.filter("n_gt = 1").rollup("dimension").agg(
        F.count("*").alias("n"), RP.count_where(hit).alias("correct"), RP.share(hit).alias("acc"), RP.share(col("output_type") == "none").alias("declined"),
        RP.share(col("ordinal")).alias("ordinal"), RP.count_where(~col("ordinal")).alias("kept"), RP.count_where(~col("ordinal") & hit).alias("_u"))
    return d.withColumn("projected", F.bround(col("_u") * 0.6).cast("bigint")).drop("_u")


@query("abstain_report", with_tables("preds", f"""
WITH o AS (SELECT item_id, proto, max(x0) FILTER (condition = 'ORIGINAL') AS ox0, max(y0) FILTER (condition = 'ORIGINAL') AS oy0, max(x1) FILTER (condition = 'ORIGINAL') AS ox1, max(y1) FILTER (condition = 'ORIGINAL') AS oy1,
  max(x0) FILTER (condition = 'CONTROL_OBJ') AS cx0, max(y0) FILTER (condition = 'CONTROL_OBJ') AS cy0, max(x1) FILTER (condition = 'CONTROL_OBJ') AS cx1, max(y1) FILTER (condition = 'CONTROL_OBJ') AS cy1,
  max(ptype) FILTER (condition = 'ORIGINAL') AS t0, max(ptype) FILTER (condition = 'REMOVE') AS t1, max(ptype) FILTER (condition = 'CONTROL_OBJ') AS t2 FROM preds GROUP BY 1, 2),
k AS (SELECT o.*, {sql_iou('o', 'c')} AS hold, (h[['pr:' || item_id || proto]] % 1000) / 1000.0e0 AS pr, (h[['pc:' || item_id || proto]] % 700) / 1000.0e0 AS pc FROM o JOIN items i USING (item_id)
  WHERE ox0 IS NOT NULL AND {sql_iou('o', 'g')} >= 0.5),
sc AS (SELECT proto, pr AS s, 1 AS y FROM k UNION ALL SELECT proto, pc, 0 FROM k), sg AS (SELECT proto, s, sum(y) AS pos, count(*) - sum(y) AS neg FROM sc GROUP BY 1, 2),
sw AS (SELECT *, sum(neg) OVER (PARTITION BY proto ORDER BY s) - neg AS below FROM sg), au AS (SELECT proto, sum(pos * (below + neg / 2)) / CAST(sum(pos) * sum(neg) AS DOUBLE) AS auroc FROM sw GROUP BY 1)
SELECT k.proto AS proto, count(*) AS n, {b("t0 = 'none'")} AS none_original, {b("t1 = 'none'")} AS none_remove, {b("t2 = 'none'")} AS none_control, {b('coalesce(hold >= 0.7, false)')} AS held_70,
  {b('coalesce(hold >= 0.5, false)')} AS held_50, round(auroc, 9) AS auroc FROM k JOIN au ON au.proto = k.proto GROUP BY k.proto, auroc"""))
def abstain_report(t):
    from plumbline.functions import geometry as G

    # plain numbers and flags of the three conditions, so that the rows of an item are one before they are shuffled
    used, xy = ("ORIGINAL", "REMOVE", "CONTROL_OBJ"), ("x0", "y0", "x1", "y1")
    own = lambda c, v: F.max(F.when(col("condition") == c, v))
    wide = t.preds.filter(col("condition").isin(*used)).groupBy("item_id", "proto").agg(
        *[own(c, col("ptype") == "none").alias(f"{c}_none") for c in used], *[own(c, F.when(col("ptype") == "box", col(v))).alias(f"{c}_{v}") for c in used[::2] for v in xy])
    box = lambda c: F.when(col(f"{c}_x0").isNotNull(), G.box(*[col(f"{c}_{v}") for v in xy]))
    g = t.sql("SELECT item_id, gx0, gy0, gx1, gy1 FROM items")
    k = wide.join(g, "item_id").filter(G.iou(box("ORIGINAL"), G.box(col("gx0"), col("gy0"), col("gx1"), col("gy1"))) >= 0.5)
    k = k.withColumn("hold", F.coalesce(G.iou(box("ORIGINAL"), box("CONTROL_OBJ")), F.lit(-1.0)))
    rates = k.groupBy("proto").agg(F.count("*").alias("n"), *[RP.share(col(f"{c}_none")).alias(n) for c, n in (("ORIGINAL", "none_original"), ("REMOVE", "none_remove"), ("CONTROL_OBJ", "none_control"))],
                                   RP.share(col("hold") >= 0.7).alias("held_70"), RP.share(col("hold") >= 0.5).alias("held_50"))
    def h(tag):
        return F.conv(F.substring(F.md5(F.concat(F.lit(f"{tag}:"), col("item_id").cast("string"), col("proto"))), 1, 8), 16, 10).cast("bigint")

    s = k.select("proto", F.explode(F.array(F.struct(((h("pr") % 1000) / 1000.0).alias("s"), F.lit(True).alias("y")), F.struct(((h("pc") % 700) / 1000.0).alias("s"), F.lit(False).alias("y")))).alias("e"))
    a = S.auroc(s, ["proto"], col("e.y"), col("e.s")).select("proto", F.round("auroc", 9).alias("auroc"))
    return rates.join(a, "proto")


AUDIT = """
SELECT image_id, iid, clause, verdict AS label, CASE h[['al:' || image_id || ':' || iid || ':' || clause]] % 4 WHEN 0 THEN 'mismatch' WHEN 1 THEN 'unsure' ELSE 'match' END AS answer,
  h[['nm:' || image_id || ':' || iid || ':' || clause]] % 3 > 0 AS named, h[['hit:' || image_id || ':' || iid]] % 3 = 0 AS hit FROM verdicts"""


@query("line_error_table", with_tables("verdicts", f"""
WITH a AS ({AUDIT}) SELECT 'c' || clause AS clause_type, CASE WHEN iid = 1 THEN 'described' ELSE 'distractor' END AS role, label, count(*) AS n,
  {b("(label = 'yes' AND answer = 'mismatch') OR (label = 'no' AND answer = 'match')")} AS wrong, {b("answer = 'unsure'")} AS unsure FROM a WHERE label IN ('yes', 'no') GROUP BY 1, 2, 3"""))
def line_error_table(t):
    a = t.sql(AUDIT).filter("label IN ('yes', 'no')")
    wrong = ((col("label") == "yes") & (col("answer") == "mismatch")) | ((col("label") == "no") & (col("answer") == "match"))
    return a.groupBy(F.concat(F.lit("c"), col("clause")).alias("clause_type"), F.when(col("iid") == 1, "described").otherwise("distractor").alias("role"), "label").agg(
        F.count("*").alias("n"), RP.share(wrong).alias("wrong"), RP.share(col("answer") == "unsure").alias("unsure"))


SQL_CANDS = f"""
a AS ({AUDIT}), c AS (SELECT image_id, iid, hit, bool_or(answer = 'mismatch' AND named) AS vetoed, count(*) FILTER (answer = 'match') AS n_match, count(*) FILTER (answer = 'mismatch' AND named) AS n_named FROM a GROUP BY 1, 2, 3)"""


def audited(t):
    a = t.sql(AUDIT)
    named = (col("answer") == "mismatch") & col("named")
    c = a.groupBy("image_id", "iid", "hit").agg(F.bool_or(named).alias("vetoed"), RP.count_where(col("answer") == "match").alias("n_match"), RP.count_where(named).alias("n_named"))
    return RP.candidate_arrays(c, "image_id", "iid", ["hit", (~col("vetoed")).alias("fits"), "n_match", "n_named"])


@query("first_candidate_stats", with_tables("verdicts evals", f"""
WITH {SQL_CANDS}, i AS (SELECT image_id, bool_or(hit) FILTER (iid = 1) AS c1, bool_or(vetoed) FILTER (iid = 1) AS v1, bool_or(hit) AS anyhit, arg_min(hit, iid) FILTER (NOT vetoed) AS fit_hit, count(*) FILTER (NOT vetoed) AS n_fit FROM c GROUP BY 1),
j AS (SELECT dimension, n_gt > 0 AS pos, i.*, base_correct, CASE WHEN n_gt = 0 THEN n_fit = 0 ELSE coalesce(fit_hit, false) END AS ok FROM i JOIN evals ON item_id = image_id)
SELECT dimension, pos, count(*) AS n, {b('base_correct')} AS base, {b('pos AND c1')} AS c1_ok, {b('pos AND anyhit')} AS any_ok, {b('ok')} AS acc, {b('v1', 'pos AND c1')} AS veto_given_ok, {b('NOT v1', 'NOT (pos AND c1)')} AS pass_given_wrong,
  {b('ok', 'pos AND v1')} AS rescued FROM j GROUP BY 1, 2"""))
def first_candidate_stats(t):
    c1 = F.get("cands", F.lit(0))
    d = audited(t).join(t.evals.select(col("item_id").alias("image_id"), "dimension", (col("n_gt") > 0).alias("pos"), "base_correct"), "image_id")
    chosen = RP.veto_choice(col("cands"), "first_fit")
    d = d.select("dimension", "pos", "base_correct", c1["hit"].alias("c1"), (~c1["fits"]).alias("v1"), F.exists("cands", lambda c: c["hit"]).alias("anyhit"),
                 F.when(col("pos"), F.coalesce(chosen["hit"], F.lit(False))).otherwise(chosen.isNull()).alias("ok"))
    good = col("pos") & col("c1")
    return d.groupBy("dimension", "pos").agg(F.count("*").alias("n"), RP.share(col("base_correct")).alias("base"), RP.share(good).alias("c1_ok"), RP.share(col("pos") & col("anyhit")).alias("any_ok"),
                                             RP.share(col("ok")).alias("acc"), RP.share(col("v1"), good).alias("veto_given_ok"), RP.share(~col("v1"), ~good).alias("pass_given_wrong"),
                                             RP.share(col("ok"), col("pos") & col("v1")).alias("rescued"))


PROBS = """
SELECT image_id, iid, clause, 1.0e0 - (h[['pp:' || image_id || ':' || iid || ':' || clause]] % 60) / 100.0e0 AS keep, h[['hit:' || image_id || ':' || iid]] % 3 = 0 AS hit FROM verdicts"""
SQL_GRID = f"""
pb AS ({PROBS}), cp AS (SELECT image_id, iid, hit, list_reduce(list_prepend(1.0e0, list(keep ORDER BY clause)), lambda a, x: a * x) AS p FROM pb GROUP BY 1, 2, 3),
gr AS (SELECT unnest([0.02e0, 0.05e0, 0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0, 0.95e0]) AS t),
it AS (SELECT item_id, CASE WHEN n_gt = 0 THEN 'rej' ELSE 'pos' END AS grp, n_gt, base_correct FROM evals WHERE item_id IN (SELECT image_id FROM cand)),
ch AS (SELECT image_id, t, arg_min(hit, iid) AS f_hit, arg_max(hit, p * 1000000 - iid / 1000000.0e0) AS b_hit FROM cp, gr WHERE p >= t GROUP BY 1, 2),
dd AS (SELECT it.*, gr.t, f_hit, b_hit FROM it CROSS JOIN gr LEFT JOIN ch ON ch.image_id = it.item_id AND ch.t = gr.t),
tb AS (SELECT grp, 'first' AS rule, t, count(*) AS n, {b('CASE WHEN n_gt = 0 THEN f_hit IS NULL ELSE coalesce(f_hit, false) END')} AS accuracy FROM dd GROUP BY 1, 3
 UNION ALL SELECT grp, 'best', t, count(*), {b('CASE WHEN n_gt = 0 THEN b_hit IS NULL ELSE coalesce(b_hit, false) END')} FROM dd GROUP BY 1, 3
 UNION ALL SELECT grp, 'oracle', NULL, count(*), {b('ah')} FROM it JOIN (SELECT image_id, bool_or(hit) AS ah FROM cp GROUP BY 1) z ON z.image_id = it.item_id WHERE n_gt > 0 GROUP BY 1
 UNION ALL SELECT grp, 'base', NULL, count(*), {b('base_correct')} FROM it GROUP BY 1)"""


def grid_items(t):
    pr = t.sql(PROBS).groupBy("image_id", "iid", "hit").agg(F.array_sort(F.collect_list(F.struct("clause", "keep"))).alias("k"))
    p = F.aggregate("k", F.lit(1.0), lambda a, x: a * x["keep"])
    c = RP.candidate_arrays(pr, "image_id", "iid", [p.alias("p"), col("hit")])
    e = t.evals.select(col("item_id").alias("image_id"), F.when(col("n_gt") == 0, "rej").otherwise("pos").alias("grp"), "n_gt", "base_correct")
    return c.join(e, "image_id")


MARGINS = (0.01, 0.03, 0.3)
SQL_BEST = " UNION ALL ".join(f"""SELECT 'rej' AS grp, 'best rejection, ' || rule AS rule, m[2] AS t, NULL AS n, m[1] AS accuracy, CAST({m} AS DOUBLE) AS margin, m[3] AS positives FROM (
  SELECT q.rule, max((r.accuracy, q.t, q.accuracy)) AS m FROM tb q JOIN tb r ON q.rule = r.rule AND q.t = r.t WHERE q.grp = 'pos' AND r.grp = 'rej' AND q.accuracy >= (SELECT accuracy FROM tb WHERE grp = 'pos' AND rule = 'base') - {m} GROUP BY 1) z""" for m in MARGINS)


@query("threshold_grid", with_tables("verdicts evals", f"WITH {SQL_GRID} SELECT *, CAST(NULL AS DOUBLE) AS margin, CAST(NULL AS DOUBLE) AS positives FROM tb UNION ALL {SQL_BEST}"))
def threshold_grid(t):
    """The grid, and per rule and margin the threshold with the best rejection at hardly fewer right positives."""
    grid = cut_lineage(RP.threshold_grid(grid_items(t), "grp"))  # a few rows, read again for each margin
    none = F.lit(None)
    out = grid.withColumn("margin", none.cast("double")).withColumn("positives", none.cast("double"))
    for m in MARGINS:
        best = RP.best_rejection(grid, "grp", "pos", "rej", m)
        out = out.unionByName(best.select(F.lit("rej").alias("grp"), F.concat(F.lit("best rejection, "), "rule").alias("rule"), "t", none.cast("bigint").alias("n"), col("rejection").alias("accuracy"), "margin", "positives"))
    return out


TAUS = [i / 20 for i in range(1, 20)]


@query("operating_curve", with_tables("evals", f"""
WITH d AS (SELECT e.*, tau, CASE WHEN commit_no IS NOT NULL THEN commit_no > tau ELSE output_type <> 'box' END AS nl FROM evals e, (SELECT unnest({[float(x) for x in TAUS]}) AS tau) g),
g AS (SELECT CAST(tau AS DOUBLE) AS tau, {b('nl', 'n_gt = 0')} AS rejection_acc, {b('nl', 'n_gt > 0')} AS positive_null_rate, {b('NOT nl AND iou >= 0.5', 'n_gt > 0')} AS positive_acc FROM d GROUP BY 1)
SELECT *, rejection_acc - positive_null_rate AS net_rejection FROM g"""))
def operating_curve(t):
    return RP.operating_curve(t.evals, col("commit_no"), TAUS)


RULES = (("current", 1, 0.0, False), ("k2", 2, 0.0, False), ("k2_w1", 2, 1.0, False), ("k2_w1_margin", 2, 1.0, True), ("k3_w1", 3, 1.0, False), ("k1_margin", 1, 0.0, True))


def _sql_rule(name, k, w, margin):
    s = f"yes - {w}e0 * no"
    return (f"SELECT image_id, '{name}' AS rule, CASE WHEN {'true' if not margin else f'count(*) FILTER (s = m) = 1'} THEN arg_max(iid, s * 1000 - iid) END AS chosen FROM "
            f"(SELECT *, {s} AS s, max({s}) OVER (PARTITION BY image_id) AS m FROM vc WHERE no < {k}) z GROUP BY 1")


@query("rule_rescoring", with_tables("verdicts", "WITH vc AS (SELECT image_id, iid, count(*) FILTER (verdict = 'yes') AS yes, count(*) FILTER (verdict = 'no') AS no FROM verdicts GROUP BY 1, 2), r AS ("
       + " UNION ALL ".join(_sql_rule(*r) for r in RULES) + "), i AS (SELECT DISTINCT image_id FROM cand), n AS (SELECT unnest([" + ", ".join(f"'{r[0]}'" for r in RULES)
       + "]) AS rule) SELECT i.image_id, n.rule, r.chosen FROM i CROSS JOIN n LEFT JOIN r ON r.image_id = i.image_id AND r.rule = n.rule"))
def rule_rescoring(t):
    v = t.verdicts.groupBy("image_id", "iid").agg(RP.count_where(col("verdict") == "yes").alias("yes"), RP.count_where(col("verdict") == "no").alias("no"))
    c = RP.candidate_arrays(v, "image_id", "iid", ["yes", "no"])
    per = F.array(*[F.struct(F.lit(n).alias("rule"), RP.rule_rescoring(col("cands"), k, w, m)["pos"].alias("chosen")) for n, k, w, m in RULES])
    return c.select("image_id", F.explode(per).alias("r")).select("image_id", "r.rule", "r.chosen")


@query("top_k_curve", with_tables("verdicts evals", f"""
WITH {SQL_CANDS}, k AS (SELECT unnest(range(1, 7)) AS k), f AS (SELECT image_id, k, arg_min(hit, iid) FILTER (NOT vetoed) AS h FROM c, k WHERE iid <= k GROUP BY 1, 2),
j AS (SELECT f.*, n_gt FROM f JOIN evals ON item_id = image_id) SELECT k, {b('h IS NULL', 'n_gt = 0')} AS rej, {b('coalesce(h, false)', 'n_gt > 0')} AS pos, {b('h IS NULL', 'n_gt > 0')} AS pos_null FROM j GROUP BY 1"""))
def top_k_curve(t):
    d = audited(t).join(t.evals.select(col("item_id").alias("image_id"), "n_gt"), "image_id").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(6))))
    ans = RP.veto_choice(F.filter("cands", lambda c: c["pos"] <= col("k")), "first_fit")
    neg, pos = col("n_gt") == 0, col("n_gt") > 0
    return d.withColumn("ans", ans).groupBy("k").agg(RP.share(col("ans").isNull(), neg).alias("rej"), RP.share(F.coalesce(col("ans.hit"), F.lit(False)), pos).alias("pos"),
                                                     RP.share(col("ans").isNull(), pos).alias("pos_null"))


@query("row_position_stats", with_tables("verdicts", f"""
WITH {SQL_CANDS}, i AS (SELECT image_id, min(iid) FILTER (hit) AS obj, min(iid) FILTER (NOT vetoed) AS chosen FROM c GROUP BY 1),
u AS (SELECT 'object' AS what, obj AS pos FROM i WHERE obj IS NOT NULL UNION ALL SELECT 'chosen', chosen FROM i WHERE chosen IS NOT NULL UNION ALL SELECT 'wrong', chosen FROM i WHERE chosen <> obj
  UNION ALL SELECT 'nulled', obj FROM i WHERE chosen IS NULL AND obj IS NOT NULL) SELECT what, pos, count(*) AS n FROM u GROUP BY 1, 2"""))
def row_position_stats(t):
    obj = F.try_element_at(F.filter("cands", lambda c: c["hit"]), F.lit(1))["pos"]
    chosen = RP.veto_choice(col("cands"), "first_fit")["pos"]
    d = audited(t).select(obj.alias("obj"), chosen.alias("chosen"))
    tags = F.array(F.struct(F.lit("object").alias("what"), col("obj").alias("pos")), F.struct(F.lit("chosen").alias("what"), col("chosen").alias("pos")),
                   F.struct(F.lit("wrong").alias("what"), F.when(col("chosen") != col("obj"), col("chosen")).alias("pos")),
                   F.struct(F.lit("nulled").alias("what"), F.when(col("chosen").isNull(), col("obj")).alias("pos")))
    return d.select(F.explode(tags).alias("x")).select("x.*").filter("pos IS NOT NULL").groupBy("what", "pos").agg(F.count("*").alias("n"))


@query("screen_diagnostics", with_tables("evals", f"""
SELECT dimension, size_bin, count(*) AS n, {b('correct')} AS acc, {b("NOT correct AND output_type <> 'box'")} AS null_rate, {b('coalesce(hint_iou >= 0.5, false)')} AS recall,
  count(*) FILTER (correct AND base_correct) AS both, count(*) FILTER (correct AND NOT base_correct) AS only_run, count(*) FILTER (NOT correct AND base_correct) AS only_base,
  count(*) FILTER (NOT correct AND output_type = 'box' AND coalesce(hint_iou >= 0.5, false)) AS wrong_box_hit FROM evals GROUP BY GROUPING SETS ((dimension), (size_bin), ())"""))
def screen_diagnostics(t):
    hit = F.coalesce(col("hint_iou") >= 0.5, F.lit(False))
    c, bc = col("correct"), col("base_correct")
    aggs = [F.count("*").alias("n"), RP.share(c).alias("acc"), RP.share(~c & (col("output_type") != "box")).alias("null_rate"), RP.share(hit).alias("recall"), RP.count_where(c & bc).alias("both"),
            RP.count_where(c & ~bc).alias("only_run"), RP.count_where(~c & bc).alias("only_base"), RP.count_where(~c & (col("output_type") == "box") & hit).alias("wrong_box_hit")]
    return t.evals.groupingSets([[col("dimension")], [col("size_bin")], []], "dimension", "size_bin").agg(*aggs)


RATIONALES = """
SELECT conv_id AS inst, turn AS clause, role, text AS reason, CASE h[['lb:' || conv_id || ':' || turn]] % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unclear' END AS label,
  CASE h[['bl:' || conv_id || ':' || turn]] % 4 WHEN 0 THEN 'unclear' WHEN 1 THEN 'yes' ELSE 'no' END AS blind, 'is a red thing of ' || role AS claim FROM conversations"""


@query("rationale_stats", with_tables("", f"""
WITH r AS ({RATIONALES}), n AS (SELECT *, lower(regexp_replace(reason, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS nr, len(list_filter(regexp_split_to_array(trim(reason), '\\s+'), lambda w: w <> '')) AS nw FROM r),
d AS (SELECT label, count(*) - count(DISTINCT inst || '|' || nr) AS reused FROM n GROUP BY 1)
SELECT label, count(*) AS cells, {b('label = blind')} AS agree, count(*) FILTER (label = blind) AS kept, max(reused) AS reused,
  quantile_cont(nw, 0.5) FILTER (label = blind) AS words_median, quantile_cont(nw, 0.9) FILTER (label = blind) AS words_p90 FROM n JOIN d USING (label) GROUP BY 1"""))
def rationale_stats(t):
    from plumbline.operators.sets import rationale_stats as stats

    return stats(t.sql(RATIONALES), "inst", "label", "blind", "reason")


@query("check_dump_stats", with_tables("verdicts", """
SELECT count(DISTINCT image_id) AS scenes, count(*) FILTER (clause <= 3 AND iid = 1) AS details, count(*) FILTER (clause <= 3 AND iid = 1 AND verdict = 'no') AS target_detail_no,
  count(*) FILTER (clause <= 3 AND iid = 1 AND verdict = 'unclear') AS target_detail_unclear, count(DISTINCT CASE WHEN clause > 3 THEN image_id * 10 + clause END) AS flips,
  (SELECT count(*) FROM (SELECT 1 FROM verdicts WHERE clause > 3 GROUP BY image_id, clause HAVING bool_and(verdict = 'no')) z) AS flip_no_on_all,
  count(*) FILTER (clause > 3 AND iid = 1 AND verdict = 'yes') AS flip_target_yes FROM verdicts"""))
def check_dump_stats(t):
    from plumbline.operators.sets import check_dump_stats as stats

    return stats(t.verdicts, "image_id", "iid", "clause", "verdict", col("iid") == 1, col("clause") > 3)


@query("mcq_summary", with_tables("", rf"""
WITH a AS (SELECT conv_id, turn, role, nullif(regexp_extract(upper(text), '(?:^|[^\p{{L}}\p{{N}}_])([A-D])(?:$|[^\p{{L}}\p{{N}}_])', 1), '') AS pred, substr('ABCD', CAST(1 + conv_id % 4 AS INT), 1) AS answer FROM conversations)
SELECT role AS category, count(*) AS n, {b('coalesce(pred = answer, false)')} AS acc, count(*) FILTER (pred IS NULL) AS unparsed FROM a GROUP BY ROLLUP (role)"""))
def mcq_summary(t):
    letter = F.regexp_extract(F.upper("text"), r"(?U)\b([A-D])\b", 1)
    d = t.conversations.select(col("role").alias("category"), F.when(letter != "", letter).alias("pred"), F.substring(F.lit("ABCD"), (1 + col("conv_id") % 4).cast("int"), F.lit(1)).alias("answer"))
    return d.rollup("category").agg(F.count("*").alias("n"), RP.share(F.coalesce(col("pred") == col("answer"), F.lit(False))).alias("acc"), RP.count_where(col("pred").isNull()).alias("unparsed"))


@query("verdict_matrix_summary", with_tables("verdicts", f"""
WITH v AS (SELECT CASE WHEN image_id % 2 = 0 THEN 'global' ELSE 'crop' END AS vw, iid % 3 AS scale, verdict, h[['tr:' || image_id || ':' || clause]] % 4 > 0 AS truth FROM verdicts)
SELECT vw, scale, count(*) FILTER (truth) AS true_clauses, {b("verdict = 'no'", 'truth')} AS false_no_rate, {b("verdict NOT IN ('yes', 'no')", 'truth')} AS unclear_rate,
  count(*) FILTER (NOT truth) AS flipped_clauses, {b("verdict = 'no'", 'NOT truth')} AS flip_detect_rate FROM v GROUP BY 1, 2"""))
def verdict_matrix_summary(t):
    v = t.sql("SELECT CASE WHEN image_id % 2 = 0 THEN 'global' ELSE 'crop' END AS vw, iid % 3 AS scale, verdict, h[['tr:' || image_id || ':' || clause]] % 4 > 0 AS truth FROM verdicts")
    no, true = col("verdict") == "no", col("truth")
    return v.groupBy("vw", "scale").agg(RP.count_where(true).alias("true_clauses"), RP.share(no, true).alias("false_no_rate"), RP.share(~col("verdict").isin("yes", "no"), true).alias("unclear_rate"),
                                        RP.count_where(~true).alias("flipped_clauses"), RP.share(no, ~true).alias("flip_detect_rate"))


@query("pair_accuracy", with_tables("evals", f"""
WITH g AS (SELECT grp, max(CAST(correct AS INT)) FILTER (kind = 'positive') AS p, max(CAST(correct AS INT)) FILTER (kind = 'negative') AS n FROM evals GROUP BY 1)
SELECT count(*) AS pair_n, {b('p = 1 AND n = 1')} AS pair_acc FROM g WHERE p IS NOT NULL AND n IS NOT NULL"""))
def pair_accuracy(t):
    return RP.pair_accuracy(t.evals, "grp", col("kind"), col("correct"))


@query("tile_to_image_score", with_tables("boxes", """
WITH s AS (SELECT image_id, line % 3 AS seed, max(score) AS mx, avg(score) AS mn FROM boxes GROUP BY 1, 2) SELECT image_id, max(mx) AS tile_max, round(avg(mx), 9) AS seed_mean_max, round(avg(mn), 9) AS seed_mean FROM s GROUP BY 1"""))
def tile_to_image_score(t):
    s = t.boxes.groupBy("image_id", (col("line") % 3).alias("seed")).agg(F.max("score").alias("mx"), F.avg("score").alias("mn"))
    return s.groupBy("image_id").agg(F.max("mx").alias("tile_max"), F.round(F.avg("mx"), 9).alias("seed_mean_max"), F.round(F.avg("mn"), 9).alias("seed_mean"))


@query("majority_label", with_tables("raters", """
WITH c AS (SELECT doc_id, label, count(*) AS c FROM raters GROUP BY 1, 2), m AS (SELECT doc_id, CASE WHEN max(c) * 2 > sum(c) THEN arg_max(label, c) END AS majority FROM c GROUP BY 1) SELECT doc_id, majority FROM m"""))
def majority_label(t):
    return S.majority(t.raters, "doc_id", "label", ["0", "1"])


@query("majority_vote_cells", with_tables("verdicts", """
WITH s AS (SELECT image_id, clause, iid, verdict, 'why ' || iid AS reason FROM verdicts), c AS (SELECT image_id, clause, verdict, count(*) AS c, arg_min(reason, iid) AS r FROM s GROUP BY 1, 2, 3),
m AS (SELECT image_id, clause, max(c) AS top FROM c GROUP BY 1, 2), w AS (SELECT image_id, clause, CASE WHEN count(*) = 1 THEN max(verdict) ELSE 'unclear' END AS verdict FROM c JOIN m USING (image_id, clause) WHERE c = top GROUP BY 1, 2)
SELECT w.image_id, w.clause, w.verdict, c.r AS reason FROM w LEFT JOIN c ON c.image_id = w.image_id AND c.clause = w.clause AND c.verdict = w.verdict"""))
def majority_vote_cells(t):
    s = t.verdicts.withColumn("reason", F.concat(F.lit("why "), col("iid").cast("string")))
    return RP.majority_cells(s, ["image_id", "clause"], "iid", "verdict", "reason")


GATES = """
SELECT l_returnflag AS arm, CASE WHEN l_linestatus = 'O' THEN 'mask' ELSE 'rect' END AS hole, 'row' || (l_linenumber % 3) AS gate_row, 75 + 15 * CAST(l_partkey % 2 AS INT) AS quality, l_discount AS score,
  CASE WHEN l_quantity + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 100 * l_discount ELSE 600 * l_discount END > 30 THEN 1 ELSE 0 END AS y FROM lineitem"""


def _sql_gate_auroc(keys, arm):
    return f"""(WITH c AS (SELECT {keys}, score, sum(y) AS pos, count(*) - sum(y) AS neg FROM gt WHERE arm = '{arm}' GROUP BY ALL), w AS (SELECT *, sum(neg) OVER (PARTITION BY {keys} ORDER BY score) - neg AS below FROM c)
    SELECT {keys}, sum(pos * (below + neg / 2)) / CAST(sum(pos) * sum(neg) AS DOUBLE) AS auroc FROM w GROUP BY ALL)"""


def gate_aurocs(t, keys, arm):
    return S.auroc(t.sql(GATES).filter(col("arm") == arm), keys, col("y") == 1, col("score"))


@query("verdict_max", with_tables("", f"""
WITH gt AS ({GATES}), r AS {_sql_gate_auroc('hole, gate_row', 'N')}, n AS {_sql_gate_auroc('hole, gate_row', 'A')}, l AS {_sql_gate_auroc('hole, gate_row, quality', 'R')},
b AS (SELECT hole, max(auroc) AS m, arg_max(gate_row, auroc) AS argmax_row FROM r GROUP BY 1), nh AS (SELECT hole, bool_and(abs(auroc - 0.5) <= 0.05) AS nulls_hold FROM n GROUP BY 1),
lh AS (SELECT hole, max(auroc) FILTER (quality = 75) > 0.9 AND max(auroc) FILTER (quality = 90) >= 0.7 AS sensitive FROM l GROUP BY 1)
SELECT hole, round(m, 9) AS max_auroc, argmax_row, CASE hole WHEN 'rect' THEN 1 ELSE 0 END AS missing, nulls_hold, sensitive,
  CASE WHEN hole = 'rect' THEN 'INCOMPLETE' WHEN m > 0.6 THEN 'FAIL' WHEN NOT sensitive OR NOT nulls_hold THEN 'NOT DECISIVE' ELSE 'PASS' END AS verdict FROM b JOIN nh USING (hole) JOIN lh USING (hole)"""))
def verdict_max(t):
    need = [("mask", f"row{i}") for i in range(3)] + [("rect", f"row{i}") for i in range(4)]
    v = RP.verdict_table(gate_aurocs(t, ["hole", "gate_row"], "N"), need, "hole", "gate_row", "auroc", gate_aurocs(t, ["hole", "gate_row"], "A"), gate_aurocs(t, ["hole", "gate_row", "quality"], "R"))
    return v.withColumn("max_auroc", F.round("max_auroc", 9))


@query("detection_floor", with_tables("", f"""
WITH gt AS ({GATES}), l AS {_sql_gate_auroc('hole, gate_row, quality', 'R')} SELECT hole, gate_row, max(quality) FILTER (auroc >= 0.7) AS floor, round(max(auroc), 9) AS best FROM l GROUP BY 1, 2"""))
def detection_floor(t):
    d = RP.detection_floor(gate_aurocs(t, ["hole", "gate_row", "quality"], "R"), ["hole", "gate_row"], "quality", "auroc")
    return d.withColumn("best", F.round("best", 9))


@query("usage_cost", with_tables("", """
WITH c AS (SELECT event_id, CAST(value * 100 AS BIGINT) AS pt, event_id % 300 AS ot FROM events), k AS (SELECT *, pt * 1250 + ot * 10000 AS nano FROM c),
r AS (SELECT *, sum(nano) OVER (ORDER BY event_id) AS cum FROM k)
SELECT count(*) AS calls, CAST(sum(pt) AS BIGINT) AS prompt_tokens, CAST(sum(ot) AS BIGINT) AS output_tokens, sum(nano) / 1e9 AS usd, min(event_id) FILTER (cum > 500000000) AS stop_at FROM r"""))
def usage_cost(t):
    from plumbline.operators.sets import usage_cost as cost

    c = t.events.select("event_id", F.round(col("value") * 100).cast("bigint").alias("prompt_tokens"), (col("event_id") % 300).alias("output_tokens"))
    return cost(c, "event_id", "prompt_tokens", "output_tokens", 0.5)


@query("scoreboard", with_tables("evals", f"""
WITH r AS (SELECT 'run' || grp % 4 AS tag, * FROM evals), g AS (SELECT tag, count(*) AS n, {b('correct', 'n_gt = 0')} AS rej, {b('correct', 'n_gt > 0')} AS pos, {b('coalesce(hint_iou >= 0.5, false)', 'n_gt > 0')} AS recall FROM r GROUP BY 1),
u AS (SELECT 'n' AS metric, tag, CAST(n AS DOUBLE) AS v FROM g UNION ALL SELECT 'rej', tag, rej FROM g UNION ALL SELECT 'pos', tag, pos FROM g UNION ALL SELECT 'recall', tag, recall FROM g)
SELECT metric, max(v) FILTER (tag = 'run0') AS run0, max(v) FILTER (tag = 'run1') AS run1, max(v) FILTER (tag = 'run2') AS run2, max(v) FILTER (tag = 'run3') AS run3 FROM u GROUP BY 1"""))
def scoreboard(t):
    r = t.evals.withColumn("tag", F.concat(F.lit("run"), (col("grp") % 4).cast("string")))
    neg, pos = col("n_gt") == 0, col("n_gt") > 0
    g = r.groupBy("tag").agg(F.count("*").cast("double").alias("n"), RP.share(col("correct"), neg).alias("rej"), RP.share(col("correct"), pos).alias("pos"),
                             RP.share(F.coalesce(col("hint_iou") >= 0.5, F.lit(False)), pos).alias("recall"))
    long = g.unpivot("tag", ["n", "rej", "pos", "recall"], "metric", "v")
    return long.groupBy("metric").pivot("tag", ["run0", "run1", "run2", "run3"]).agg(F.max("v"))


@query("area_and_order_reports", with_tables("items", """
SELECT dimension, count(*) AS n, count(*) FILTER (NOT no_target) AS positives, count(*) FILTER (no_target) AS rejections,
  count(*) FILTER (NOT no_target AND (gx1 - gx0) * (gy1 - gy0) / 800000.0e0 > 0.03) AS over_area, row_number() OVER (ORDER BY count(*) DESC, dimension) AS place FROM items GROUP BY 1"""))
def area_and_order_reports(t):
    from pyspark.sql import Window

    pos = ~col("no_target")
    g = t.items.groupBy("dimension").agg(F.count("*").alias("n"), RP.count_where(pos).alias("positives"), RP.count_where(~pos).alias("rejections"),
                                         RP.count_where(pos & ((col("gx1") - col("gx0")) * (col("gy1") - col("gy0")) / 800000.0 > 0.03)).alias("over_area"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(col("n").desc(), "dimension")))


@query("prompt_vs_prompt_pairs", with_tables("evals", """
WITH j AS (SELECT dimension, a.p_null AS pa, (1 + h[['p2:' || item_id]] % 1000) / 100000.0e0 AS pb, output_type = 'none' AS da, h[['d2:' || item_id]] % 3 = 0 AS db FROM evals a WHERE p_null IS NOT NULL)
SELECT dimension, count(*) AS n, avg(CASE WHEN da THEN 1.0e0 ELSE 0.0e0 END) AS declined_a, avg(CASE WHEN db THEN 1.0e0 ELSE 0.0e0 END) AS declined_b, avg(CASE WHEN pb > pa THEN 1.0e0 ELSE 0.0e0 END) AS rising,
  round(quantile_cont(pa, 0.5), 9) AS median_a, round(quantile_cont(pb, 0.5), 9) AS median_b FROM j GROUP BY 1"""))
def prompt_vs_prompt_pairs(t):
    a = t.evals.filter("p_null IS NOT NULL").select("item_id", "dimension", col("p_null").alias("pa"), (col("output_type") == "none").alias("da"))
    bb = t.sql("SELECT item_id, (1 + h[['p2:' || item_id]] % 1000) / 100000.0e0 AS pb, h[['d2:' || item_id]] % 3 = 0 AS db FROM items")
    j = a.join(bb, "item_id")
    g = j.groupBy("dimension").agg(F.count("*").alias("n"), RP.share(col("da")).alias("declined_a"), RP.share(col("db")).alias("declined_b"), RP.share(col("pb") > col("pa")).alias("rising"))
    for v, n in (("pa", "median_a"), ("pb", "median_b")):
        g = RP.with_medians(g, j, ["dimension"], col(v), n).withColumn(n, F.round(n, 9))
    return g
