"""Schema and rule checks over derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import text as T
from plumbline.operators import traces as TR
from plumbline.plans.registry import query
from plumbline.plans.tables import with_tables
from plumbline.plans.text import SQL_SCENE, scene_traces
from plumbline.sources import constraints as C
from plumbline.sources import schemas as S

col = F.col


def items_table(t):
    """Items in the declared shape, with deliberate defects by hash."""
    d = t.sql("SELECT i.*, h[['df:' || item_id]] % 50 AS df FROM items i")
    none = F.lit(None)
    box = F.array("gx0", "gy0", "gx1", "gy1")
    boxes = F.when(col("no_target"), F.array().cast("array<array<double>>")).otherwise(F.array(F.when(col("df") == 1, F.slice(box, 1, 3)).otherwise(box)))
    b = G.box(col("gx0"), col("gy0"), col("gx1"), col("gy1"))
    return d.select(
        F.when(col("df") == 9, none).otherwise(col("item_id").cast("string")).alias("item_id"), F.lit("s").alias("set"), none.cast("string").alias("split_half"),
        F.concat(F.lit("img/"), col("item_id").cast("string")).alias("image_path"), F.sha2(col("item_id").cast("string"), 256).alias("image_sha256"),
        F.when(col("df") == 2, F.lit("zz")).otherwise(F.substring(F.md5(col("item_id").cast("string")), 1, 16)).alias("image_phash"), F.lit("the thing").alias("expr"), boxes.alias("gt_boxes_xyxy_px"),
        F.when(col("df") == 3, 7).otherwise(F.size(boxes)).alias("n_gt"), F.when(col("df") == 4, F.lit("giant")).otherwise(G.size_bin(b)).alias("size_bin"), "dimension", F.lit(True).alias("in_kill_set"),
        none.cast("string").alias("dev_slice"), none.cast("string").alias("pair_id"), none.cast("double").alias("ceiling_iou_d4"), F.lit(1).alias("downscale_factor_d4"), col("df").alias("debug"), "no_target")


@query("check_fields", with_tables("items", """
WITH d AS (SELECT h[['df:' || item_id]] % 50 AS df FROM items)
SELECT 'downscale_factor_d4' AS "column", 'type int is not double' AS detail, 0 AS n UNION ALL SELECT 'debug', 'column not declared', 0
UNION ALL SELECT 'expr', 'column missing', 0 UNION ALL SELECT 'item_id', 'nulls in a required column', count(*) FROM d WHERE df = 9"""))
def check_fields(t):
    return C.check_fields(items_table(t).drop("no_target", "expr"), S.ITEMS)


@query("check_enums", with_tables("items preds", """
SELECT 'size_bin' AS "column", 'giant' AS "value", count(*) AS n FROM items WHERE h[['df:' || item_id]] % 50 = 4
UNION ALL SELECT 'condition', condition, count(*) FROM preds WHERE condition IN ('T_HEAD', 'T_ATTR') GROUP BY condition"""))
def check_enums(t):
    a = C.check_enums(items_table(t), {"size_bin": S.SIZE_BINS, "set": ("s",)})
    b = C.check_enums(t.preds, {"condition": ("ORIGINAL", "REMOVE", "CONTROL_OBJ", "CONTROL_BG", "T_NULL"), "proto": S.PROTOCOLS})
    return a.unionByName(b)


@query("check_item_rows", with_tables("items", """
WITH d AS (SELECT CASE WHEN df = 9 THEN NULL ELSE CAST(item_id AS VARCHAR) END AS k, df, no_target FROM (SELECT item_id, no_target, h[['df:' || item_id]] % 50 AS df FROM items) z)
SELECT 'n_gt' AS rule, count(*) AS n, min(k) AS first_key FROM d WHERE df = 3 UNION ALL SELECT 'box_numbers', count(*), min(k) FROM d WHERE df = 1 AND NOT no_target UNION ALL SELECT 'phash_hex', count(*), min(k) FROM d WHERE df = 2"""))
def check_item_rows(t):
    return C.count_violations(items_table(t), "item_id", C.item_rules())


@query("check_output_rows", with_tables("preds", """
WITH d AS (SELECT *, CAST(item_id AS VARCHAR) AS k, h[['od:' || item_id || condition || proto]] % 40 AS od FROM preds)
SELECT 'px_sent' AS rule, count(*) AS n, min(k) AS first_key FROM d WHERE od = 1 UNION ALL SELECT 'iou_original_only', count(*), min(k) FROM d WHERE od = 2 AND condition <> 'ORIGINAL'
UNION ALL SELECT 'box_numbers', count(*), min(k) FROM d WHERE od = 3 AND ptype = 'box' UNION ALL SELECT 'box_present', count(*), min(k) FROM d WHERE od = 4 AND ptype = 'box'"""))
def check_output_rows(t):
    d = t.sql("SELECT p.*, h[['od:' || item_id || condition || proto]] % 40 AS od FROM preds p")
    box = F.when(col("ptype") == "box", F.array("x0", "y0", "x1", "y1"))
    none = F.lit(None)
    o = d.select(col("item_id").cast("string").alias("item_id"), "condition", col("ptype").alias("output_type"),
                 F.when(col("od") == 4, none).when(col("od") == 3, F.slice(box, 1, 3)).otherwise(box).alias("box_xyxy_px"), none.cast("array<double>").alias("point_xy_px"),
                 F.when((col("condition") == "ORIGINAL") | (col("od") == 2), 0.5).alias("iou_gt"), none.cast("boolean").alias("point_in_gt"), none.cast("boolean").alias("is_failure"),
                 F.when(col("od") == 1, F.array(F.lit(0), F.lit(800))).otherwise(F.array(F.lit(1000), F.lit(800))).alias("image_px_sent"))
    return C.count_violations(o, "item_id", C.output_rules())


# one or two characters of the hash are replaced, so distances vary between 0 and 8 bits
HASHES = """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'dev' ELSE 'eval' END AS part,
  CASE h[['fl:' || doc_id]] % 3 WHEN 0 THEN substr(md5(CAST(doc_id // 4 AS VARCHAR(20))), 1, 16) WHEN 1 THEN '7' || substr(md5(CAST(doc_id // 4 AS VARCHAR(20))), 2, 15)
   ELSE substr(md5(CAST(doc_id // 4 AS VARCHAR(20))), 1, 8) || 'a3' || substr(md5(CAST(doc_id // 4 AS VARCHAR(20))), 11, 6) END AS ph FROM documents"""


def _bits(a, b):
    def half(x, i):
        return f"CAST('0x' || substr({x}, {i}, 8) AS BIGINT)"
    return f"bit_count(xor({half(a, 1)}, {half(b, 1)})) + bit_count(xor({half(a, 9)}, {half(b, 9)}))"


@query("near_duplicate_disjoint", with_tables("", f"""
WITH p AS ({HASHES}), d AS (SELECT * FROM p WHERE part = 'dev'), e AS (SELECT DISTINCT ph FROM p WHERE part = 'eval'),
m AS (SELECT doc_id, {_bits('d.ph', 'e.ph')} AS d FROM d, e) SELECT doc_id, count(*) AS n_hashes, CAST(min(d) AS INT) AS min_d FROM m WHERE d <= 4 GROUP BY 1"""))
def near_duplicate_disjoint(t):
    p = t.sql(HASHES.replace("doc_id // 4", "doc_id div 4").replace("VARCHAR(20)", "STRING"))
    return C.disjoint_violations(p.filter("part = 'dev'"), p.filter("part = 'eval'"), "doc_id", "ph")


@query("content_ledger", with_tables("", """
SELECT page_id, CASE WHEN page_id % 11 = 3 THEN 'missing' WHEN page_id % 11 = 5 THEN 'added' ELSE 'changed' END AS status FROM pages WHERE page_id % 11 IN (3, 5, 7)"""))
def content_ledger(t):
    m = col("page_id") % 11
    content = F.encode("html", "utf-8")
    ledger = t.pages.filter(m != 5).select("page_id", F.sha2(content, 256).alias("sha256"))
    now = t.pages.filter(m != 3).select("page_id", F.sha2(F.when(m == 7, F.concat(content, F.encode(F.lit("!"), "utf-8"))).otherwise(content), 256).alias("sha256"))
    return C.compare_ledger(ledger, now, "page_id", "sha256")


@query("run_admission", with_tables("evals", """
SELECT grp, count(*) AS n FROM evals WHERE grp IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1"""))
def run_admission(t):
    runs = t.customer.select(col("c_custkey").alias("grp"), (col("c_mktsegment") == "BUILDING").alias("non_eval"))
    return C.inadmissible_runs(t.evals, runs, "grp", "non_eval")


@query("snapshot_diff", with_tables("", """
SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'removed' WHEN 2 THEN 'added' WHEN 3 THEN 'changed' ELSE 'changed' END AS status FROM documents WHERE doc_id % 7 IN (1, 2, 3, 4)"""))
def snapshot_diff(t):
    m = col("doc_id") % 7
    a = t.documents.filter(m != 2).select("doc_id", F.when(m == 4, F.lit(None)).otherwise(F.md5("text")).alias("v"))
    b = t.documents.filter(m != 1).select("doc_id", F.when(m == 3, F.md5(F.concat("text", F.lit("x")))).when(m == 5, F.md5("text")).otherwise(F.md5("text")).alias("v"))
    return C.snapshot_diff(a, b, "doc_id", "v")


@query("set_digest", "WITH l AS (SELECT sha256(concat_ws('=', CAST(doc_id AS VARCHAR), coalesce(lang, chr(0)))) AS h FROM documents) SELECT sha256(concat_ws('|', CAST(count(*) AS VARCHAR), "
       + ", ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(8)) + ")) AS digest FROM l")
def set_digest(t):
    return C.set_digest(t.documents, "doc_id", "lang")


@query("request_budget", """
WITH s AS (SELECT 300 + (c_custkey * 37) % 7400 AS w, 200 + (c_custkey * 53) % 4900 AS h FROM customer),
c AS (SELECT w, h, CASE WHEN w * h > 2457600 THEN greatest(1, CAST(round_even(w * sqrt(2457600.0e0 / CAST(w * h AS DOUBLE)), 0) AS INT)) ELSE w END AS cw,
  CASE WHEN w * h > 2457600 THEN greatest(1, CAST(round_even(h * sqrt(2457600.0e0 / CAST(w * h AS DOUBLE)), 0) AS INT)) ELSE h END AS ch FROM s),
k AS (SELECT w * h AS px, CAST(ceil(cw / 32.0e0) * ceil(ch / 32.0e0) AS BIGINT) AS tk FROM c)
SELECT max(tk) AS max_tokens, count(*) FILTER (tk + 1650 > 4096) AS n_over_context, count(*) FILTER (px > 2457600) AS n_over_cap, quantile_cont(tk, 0.5) AS p50, round(quantile_cont(tk, 0.9), 6) AS p90,
  round(quantile_cont(tk, 0.99), 6) AS p99, count(*) AS n, count(*) FILTER (tk + 1650 > 4096) > 0 AS refused FROM k""")
def request_budget(t):
    from plumbline.plans.geometry import _cust_sizes

    d = _cust_sizes(t).withColumn("tk", G.visual_tokens(col("w"), col("h")))
    return C.request_budget(d, "tk", col("w") * col("h"), 1650, 4096, G.PIXEL_CAP).withColumn("p90", F.round("p90", 6)).withColumn("p99", F.round("p99", 6))


@query("label_roundtrip_check", with_tables("verdicts", "WITH " + SQL_SCENE + """,
r AS (SELECT CASE WHEN target_fits = 1 AND best = 1 THEN 'ok' WHEN target_fits = 1 THEN 'other_candidate' WHEN n_fit = 0 THEN 'ok' ELSE 'negative_has_satisfier' END AS reason FROM der) SELECT reason, count(*) AS n FROM r GROUP BY 1"""))
def label_roundtrip_check(t):
    p = scene_traces(t).select("image_id", T.trace_table(col("text"), F.lit(1000), F.lit(800)).alias("p"))
    same = TR.consistent(col("p"))
    reason = F.when(~col("p.format_ok"), "format").when(same, "ok").when(col("p.free_type") == "box", "other_candidate").otherwise("negative_has_satisfier")
    return p.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("drop_reason_counts", with_tables("inst", """
WITH r AS (SELECT source, CASE WHEN area_frac < 0.01 THEN 'area' WHEN greatest((x1 - x0) / (y1 - y0), (y1 - y0) / (x1 - x0)) > 4 THEN 'aspect' WHEN x0 <= 2 OR y0 <= 2 THEN 'border' END AS r FROM inst)
SELECT source, coalesce(r, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1, 2"""))
def drop_reason_counts(t):
    w, h = col("x1") - col("x0"), col("y1") - col("y0")
    d = C.drop_reasons(t.inst, [("area", col("area_frac") < 0.01), ("aspect", F.greatest(w / h, h / w) > 4), ("border", (col("x0") <= 2) | (col("y0") <= 2))])
    return C.reason_counts(d, ["source"])
