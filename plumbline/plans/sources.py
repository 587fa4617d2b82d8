"""Readers, writers and resumable stages over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.plans.registry import query
from plumbline.plans.tables import with_tables
from plumbline.session import cut_lineage, scratch_path
from plumbline.sources import adapters as A
from plumbline.sources import readers as R
from plumbline.sources import schemas as S
from plumbline.sources import scoring as SC
from plumbline.sources import sinks as W
from plumbline.streaming import incremental as INC
from plumbline.streaming import metrics as MET

col = F.col


@query("scan_metadata_csv", with_tables("", """
SELECT o_orderkey AS image_id, o_orderpriority AS licence, count(l_orderkey) AS n_boxes, round(sum(l_discount), 6) AS sum_x, count(DISTINCT p_brand) AS n_classes
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2"""))
def scan_metadata_csv(t):
    base = scratch_path(t.spark, "csv")
    none = F.lit(None).cast("string")
    t.orders.select(col("o_orderkey").cast("string").alias("ImageID"), col("o_orderpriority").alias("License"), *[none.alias(c) for c in S.IMAGES_CSV.names[2:]]).write.option("header", True).csv(f"{base}/images")
    one = F.lit(1)
    t.lineitem.select(col("l_orderkey").cast("string").alias("ImageID"), col("l_partkey").cast("string").alias("LabelName"), col("l_discount").alias("XMin"), F.lit(1.0).alias("XMax"), F.lit(0.0).alias("YMin"),
                      F.lit(1.0).alias("YMax"), F.lit(0).alias("IsGroupOf"), F.lit(0).alias("IsDepiction"), one.alias("Confidence")).write.option("header", True).csv(f"{base}/boxes")
    t.part.select(col("p_partkey").cast("string"), "p_brand").write.option("header", False).csv(f"{base}/classes")
    images, boxes, classes = R.metadata_tables(t.spark, f"{base}/images", f"{base}/boxes", f"{base}/classes")
    per = boxes.join(classes, "LabelName", "left").groupBy("ImageID").agg(F.count("*").alias("n_boxes"), F.round(F.sum("XMin"), 6).alias("sum_x"), F.countDistinct("Class").alias("n_classes"))
    d = images.join(per, "ImageID", "left")
    return d.select(col("ImageID").cast("bigint").alias("image_id"), col("License").alias("licence"), F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"), "sum_x", F.coalesce("n_classes", F.lit(0)).alias("n_classes"))


@query("scan_parquet_shards", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem GROUP BY 1")
def scan_parquet_shards(t):
    d = R.parquet_shards(t.spark, t.sf_dir, t.lineitem.schema, "lineitem*.parquet")
    return d.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query("scan_pruned_columns", "SELECT doc_id, lang, source FROM documents")
def scan_pruned_columns(t):
    return R.key_columns(t.scan("documents"), ["doc_id", "lang", "source"])


@query("scan_scenes_by_key", """
SELECT l_orderkey AS image_id, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1""")
def scan_scenes_by_key(t):
    d = t.scan("lineitem").select(col("l_orderkey").alias("image_id"), "l_partkey", "l_returnflag", F.col("_metadata.file_path").alias("file"))
    rows = R.scene_rows(d, "image_id", "file", col("l_returnflag") == "R")
    return rows.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


@query("scan_jsonl", "SELECT doc_id, length(text) AS n_chars, lang FROM documents")
def scan_jsonl(t):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
    path = scratch_path(t.spark, "jsonl")
    lines = t.documents.select(F.to_json(F.struct("doc_id", "text", "lang")).alias("value"))
    lines.unionByName(t.documents.select(F.lit("").alias("value"))).write.text(path)  # as many blank lines as records
    return R.json_lines(t.spark, path, schema).filter("doc_id IS NOT NULL").select("doc_id", F.length("text").alias("n_chars"), "lang")


@query("append_jsonl_sink", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
def append_jsonl_sink(t):
    path = scratch_path(t.spark, "append")
    for role in ("user", "assistant"):
        W.append_json(t.conversations.filter(col("role") == role).select("conv_id", "turn"), path)
    W.append_json(t.conversations.filter(~col("role").isin("user", "assistant")).select("conv_id", "turn"), path)
    return R.json_lines(t.spark, path, t.conversations.select("conv_id", "turn").schema).groupBy("conv_id").agg(F.count("*").alias("n"))


def outputs_table(t):
    """Outputs in the declared shape."""
    none = F.lit(None)
    box = F.when(col("ptype") == "box", F.array("x0", "y0", "x1", "y1"))
    orig = col("condition") == "ORIGINAL"
    values = {"run_id": F.lit("r1"), "model_id": F.lit("m1"), "item_id": col("item_id").cast("string"), "condition": col("condition"), "pair_id": none, "abstain_protocol": col("proto"), "prompt_version": F.lit("v1"),
              "raw_text": F.concat(F.lit("t"), col("item_id").cast("string")), "parse_ok": col("ptype") != "invalid", "output_type": col("ptype"), "n_boxes": F.when(col("ptype") == "box", 1).otherwise(0), "box_xyxy_px": box,
              "point_xy_px": none, "iou_gt": F.when(orig & box.isNotNull(), 0.5), "point_in_gt": none, "is_failure": F.when(orig, False), "image_px_sent": F.array(F.lit(1000), F.lit(800)), "latency_ms": F.lit(5),
              "tokens_in": none, "tokens_out": none}
    return t.preds.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in S.OUTPUTS])


@query("validated_parquet_sink", with_tables("preds", "SELECT condition, ptype AS output_type, count(*) AS n FROM preds GROUP BY 1, 2"))
def validated_parquet_sink(t):
    path = scratch_path(t.spark, "outputs")
    W.write_validated(outputs_table(t), path, "outputs")
    return t.spark.read.schema(S.OUTPUTS).parquet(path).groupBy("condition", "output_type").agg(F.count("*").alias("n"))


@query("extract_binary_column", "SELECT page_id, sha256(html || chr(10)) AS sha256, octet_length(encode(html)) + 1 AS n_bytes FROM pages")
def extract_binary_column(t):
    """Pages written as one file each, in two runs: the second finds what the first has stored and writes the rest."""
    path = scratch_path(t.spark, "payloads")
    for part in (t.pages.filter("page_id % 3 = 0"), t.pages):
        stored = R.files(t.spark, path, "*.html").select(F.regexp_extract("path", r"([0-9]+)\.html$", 1).cast("bigint").alias("page_id"))
        new = W.new_payloads(part, "page_id", F.encode("html", "utf-8"), stored)
        W.write_named(new.select("page_id", F.decode("content", "utf-8").alias("value")), path, "page_id", ".html")
    d = R.file_facts(R.files(t.spark, path, "*.html"))
    return d.select(F.regexp_extract("path", r"([0-9]+)\.html$", 1).cast("bigint").alias("page_id"), "sha256", "n_bytes")


@query("file_facts", """
SELECT lang, sha256(string_agg(replace(text, chr(10), ' '), chr(10) ORDER BY doc_id) || chr(10)) AS sha256, sum(octet_length(encode(text)) + 1)::BIGINT AS n_bytes, lang <> 'en' AS unchanged FROM documents WHERE lang <> 'de' GROUP BY lang""")
def file_facts(t):
    """Files of lines, one per language. After they are known, one is written anew, one is gone and one of another
    kind is there: only the changed one is read again."""
    path, other = scratch_path(t.spark, "texts"), scratch_path(t.spark, "texts")
    lines = t.documents.select("lang", "doc_id", F.translate("text", "\n", " ").alias("value"))
    W.write_named(lines, path, "lang", ".txt", ["doc_id"])
    W.write_named(lines.where("lang = 'fr'"), path, "lang", ".tmp", ["doc_id"])
    W.write_named(lines.where("lang = 'en'"), other, "lang", ".txt", ["doc_id"])
    known = cut_lineage(R.file_facts(R.files(t.spark, path, "*.txt")))
    lang = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    # the same files as they are later: the English one from elsewhere, the German one gone
    later = R.files(t.spark, path, "*.txt").where(~lang.isin("en", "de")).unionByName(R.files(t.spark, other, "*.txt"))
    facts = R.file_facts(later, known)
    return facts.join(known.select("path", F.lit(True).alias("unchanged")), "path", "left").select(lang.alias("lang"), "sha256", "n_bytes", F.coalesce("unchanged", F.lit(False)).alias("unchanged"))


@query("coco_json_explode", with_tables("boxes", """
WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity FROM lineitem)
SELECT o_custkey AS document, l_orderkey - 7 * o_custkey AS image_id, l_partkey AS ann_id, k, 'img' || l_orderkey || '.jpg' AS file_name, CAST(l_partkey + l_linenumber * 10 AS DOUBLE) AS x1, CASE k WHEN 0 THEN 'the part ' || l_partkey ELSE 'no ' || l_suppkey END AS expr
FROM l JOIN orders ON o_orderkey = l_orderkey, range(0, 2) r(k)"""))
def coco_json_explode(t):
    # one COCO document per customer, as annotation files are cut in practice; each numbers its images on its own
    def local(order):
        return col(order) - 7 * col("o_custkey")

    img = t.orders.groupBy("o_custkey").agg(F.collect_list(F.struct(local("o_orderkey").alias("id"), F.concat(F.lit("img"), col("o_orderkey").cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(1000).alias("width"),
                                                                   F.lit(800).alias("height"))).alias("images"))
    p = col("l_partkey")
    ann = t.lineitem.join(t.orders.select(col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").groupBy("o_custkey").agg(F.collect_list(F.struct(
        p.alias("id"), local("l_orderkey").alias("image_id"), F.array(p.cast("double"), F.lit(2.0), (col("l_linenumber") * 10).cast("double"), F.lit(4.0)).alias("bbox"),
        F.array(F.concat(F.lit("the part "), p.cast("string")), F.concat(F.lit("no "), col("l_suppkey").cast("string"))).alias("sentences"))).alias("annotations"))
    d = A.coco_items(img.join(ann, "o_custkey").withColumnRenamed("o_custkey", "document"), "document")
    return d.select("document", "image_id", "ann_id", "k", "file_name", col("box.x1").alias("x1"), "expr")


@query("csv_sidecar_sink", "SELECT doc_id, 'task ' || doc_id AS task, quality, toxic FROM labels")
def csv_sidecar_sink(t):
    base = scratch_path(t.spark, "tasks")
    d = t.labels.withColumn("task", F.concat(F.lit("task "), col("doc_id").cast("string")))
    W.write_sidecars(d, ["doc_id", "task"], ["doc_id", "quality", "toxic"], f"{base}/tasks", f"{base}/key")
    tasks = t.spark.read.schema("doc_id bigint, task string").json(f"{base}/tasks")
    key = t.spark.read.schema("doc_id bigint, quality int, toxic int").option("header", True).csv(f"{base}/key")
    return tasks.join(key, "doc_id").select("doc_id", "task", "quality", "toxic")


@query("scan_label_log", """
WITH l AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_id % 4 = 0 THEN 'undo' ELSE 'v' || event_id % 10 END AS label FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM l)
SELECT user_id, event_type, label FROM r WHERE rn = 1 AND label <> 'undo'""")
def scan_label_log(t):
    label = F.when(col("event_id") % 4 == 0, "undo").otherwise(F.concat(F.lit("v"), (col("event_id") % 10).cast("string")))
    return R.label_log(t.events.withColumn("label", label), "user_id", "event_type", ["ts", "event_id"], "label")


@query("scan_training_log", """
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS no, CASE WHEN event_type = 'error' THEN 'run' || event_id END AS nm, event_type FROM events), f AS (SELECT *, last_value(nm IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, no AS line_no, run, CASE WHEN event_type = 'click' THEN 'sft' ELSE 'grpo' END AS kind, CAST(event_id % 9 AS INT) AS step, CASE WHEN event_type = 'click' THEN (event_id % 100) / 10.0e0 END AS loss,
  CASE WHEN event_type <> 'click' AND event_id % 2 = 0 THEN (event_id % 50) / 10.0e0 END AS pos_r FROM f WHERE nm IS NULL AND run IS NOT NULL AND event_type IN ('click', 'view')""")
def scan_training_log(t):
    e = col("event_id")
    head = F.concat(F.lit("=== 10:11:12 [0] python -m x --name run"), e.cast("string"), F.lit(" --y"))
    sft = F.concat(F.lit("  epoch 1 step "), (e % 9).cast("string"), F.lit("/9 loss "), ((e % 100) / 10.0).cast("string"), F.lit(" lr 1e-04 2.5 min"))
    r = F.when(e % 2 == 0, ((e % 50) / 10.0).cast("string")).otherwise("nan")
    grpo = F.concat(F.lit("  epoch 1 step "), (e % 9).cast("string"), F.lit("/9 | neg: r 0.1 null nan ev 0.2 used 1.0 | cross: r nan null nan | pos: r "), r, F.lit(" null 0.0 fa 0.1 used 0.9 | bad 0.0 inc 0.1 | 3.5 min"))
    line = F.when(col("event_type") == "error", head).when(col("event_type") == "click", sft).when(col("event_type") == "view", grpo).otherwise("noise")
    # one log file per user, read back as text
    path = scratch_path(t.spark, "logs")
    W.write_named(t.events.select("user_id", "event_id", line.alias("value")), path, "user_id", ".log", ["event_id"])
    d = R.training_log(R.log_lines(t.spark, path))
    return d.select(F.regexp_extract("path", r"([0-9]+)\.log$", 1).cast("bigint").alias("user_id"), "line_no", "run", "kind", "step", "loss", "pos_r")


@query("report_table_sink", with_tables("evals", """
WITH g AS (SELECT dimension, count(*) AS n, count(*) FILTER (correct) AS ok FROM evals GROUP BY 1) SELECT dimension, '| ' || dimension || ' | ' || ok || ' | ' || n || ' | ' || CAST(round_even(100 * ok / CAST(n AS DOUBLE), 0) AS INT) || '% |' AS line FROM g"""))
def report_table_sink(t):
    g = t.evals.groupBy("dimension").agg(F.count("*").alias("n"), F.count(F.when(col("correct"), 1)).alias("ok"))
    pct = F.concat(F.bround(100 * col("ok") / col("n")).cast("int").cast("string"), F.lit("%"))
    return W.report_lines(g, [col("dimension"), col("ok"), col("n"), pct], ["dimension"])


@query("scan_result_files", """
SELECT 'gate__' || o_custkey || '.json' AS file_name, o_custkey % 3 = 0 AS broken, CASE WHEN o_custkey % 3 > 0 THEN count(*) END AS n, CASE WHEN o_custkey % 3 > 0 THEN round(sum(o_totalprice), 2) END AS lo FROM orders WHERE o_custkey % 10 = 0 GROUP BY o_custkey""")
def scan_result_files(t):
    """A result file per customer number that ends in 0; every third is cut off in the middle, and runs with a limit
    have left files with another prefix."""
    path = scratch_path(t.spark, "results")
    g = t.orders.where("o_custkey % 10 = 0").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("lo"))
    text = F.format_string('{"row": "r%d",\n "n": %d,\n "ci": {"lo": %s, "hi": null}}', "o_custkey", "n", col("lo").cast("string"))
    text = F.when(col("o_custkey") % 3 == 0, F.substring(text, 1, 20)).otherwise(text)
    for prefix in ("gate__", "limit8__gate__"):
        W.write_named(g.select(F.concat(F.lit(prefix), col("o_custkey").cast("string")).alias("name"), text.alias("value")), path, "name", ".json")
    from pyspark.sql import types as T

    ci = T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])
    found = R.result_files(t.spark, path, "gate__", T.StructType([T.StructField("row", T.StringType()), T.StructField("n", T.LongType()), T.StructField("ci", ci)]))
    good, bad = R.quarantined(found)
    none = F.lit(None)
    return good.select("file_name", F.lit(False).alias("broken"), "n", col("ci.lo").alias("lo")).unionByName(bad.select("file_name", F.lit(True).alias("broken"), none.cast("bigint").alias("n"), none.cast("double").alias("lo")).distinct())


def length_scorer():
    """A deterministic stand-in for a model."""
    return lambda pdf: pdf["text"].str.len().astype(str) + ":" + pdf["question"]


def requests(t):
    d = t.documents.select("doc_id", "text").withColumn("question", F.explode(F.array(F.lit("color"), F.lit("count"))))
    return d.withColumn("key", SC.cache_key(F.lit("model-1"), F.lit("v3"), F.sha2("text", 256), col("question")))


@query("cached_scoring", r"""
WITH q AS (SELECT doc_id, text, question, sha256('model-1' || chr(0) || 'v3' || chr(0) || sha256(text) || chr(0) || question) AS key FROM documents, (VALUES ('color'), ('count')) z(question))
SELECT doc_id, question, key, length(text) || ':' || question AS answer, substr(key, 1, 1) < '8' AS cached FROM q""")
def cached_scoring(t):
    req = requests(t)
    cache = SC.score(req.filter(F.substring("key", 1, 1) < "8").dropDuplicates(["key"]), length_scorer).select("key", "answer")
    fresh = SC.score_missing(req, cache, "key", ["text", "question"], length_scorer)
    return SC.with_cache(req, cache, fresh, "key").select("doc_id", "question", "key", "answer", "cached")


@query("user_scorer", """
SELECT doc_id, question, length(text) || ':' || question AS answer FROM documents, (VALUES ('color'), ('count')) z(question)""")
def user_scorer(t):
    return SC.score(requests(t).select("doc_id", "text", "question"), length_scorer).select("doc_id", "question", "answer")


@query("incremental_stage", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_orderkey = l.l_orderkey AND d.l_linenumber = l.l_linenumber AND d.l_quantity > 30) GROUP BY 1, 2""")
def incremental_stage(t):
    keys = ["l_orderkey", "l_linenumber"]
    return INC.pending(t.lineitem.select(*keys), t.lineitem.filter("l_quantity > 30"), keys).groupBy(*keys).agg(F.count("*").alias("n"))


@query("incremental_stage_stream", "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE event_type <> 'error' GROUP BY 1")
def incremental_stage_stream(t):
    """Events arrive in two portions of daily files; each run handles only the new files."""
    base = scratch_path(t.spark, "stream")
    day = F.dayofmonth("ts")
    e = t.events.withColumn("day", day)
    for part in (0, 1):
        e.filter(col("day") % 2 == part).write.mode("append").partitionBy("day").parquet(f"{base}/in")
        INC.run_available(t.spark, f"{base}/in", e.schema, lambda s: s.filter("event_type <> 'error'").select("event_type", "value"), f"{base}/out", f"{base}/checkpoint")
    return t.spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("poisoned_keys", """
SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE (l_suppkey, l_partkey) NOT IN (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1, 2 HAVING count(*) >= 2""")
def poisoned_keys(t):
    return INC.poisoned(t.lineitem, t.lineitem.filter("l_returnflag = 'R'"), ["l_suppkey", "l_partkey"])


@query("running_training_metrics", """
SELECT event_type AS run, event_id // 50 AS "window", count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2""")
def running_training_metrics(t):
    """The step log read as a growing stream, whose rows come up to 60 steps late; every changed window replaces its
    older row, and windows that are further back are closed."""
    base = scratch_path(t.spark, "steps")
    e = t.events.select(col("event_type").alias("run"), col("event_id").alias("step"), "value")
    half = (e.agg(F.max("step").alias("m")).first()["m"] or 0) // 2
    late = (col("step") >= half) | (col("step") >= half - 60) & (col("step") % 2 == 1)
    for part in (~late, late):
        e.filter(part).write.mode("append").json(f"{base}/log")

        def sink(df, batch_id):
            df.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(f"{base}/out")

        MET.follow(t.spark, f"{base}/log", e.schema, "run", "step", ["value"], 50, 120, sink, f"{base}/checkpoint")
    out = t.spark.read.parquet(f"{base}/out").groupBy("run", "window").agg(F.max_by("n", "batch").alias("n"), F.max_by("mean_value", "batch").alias("mean_value"))
    return out.select("run", "window", "n", F.round("mean_value", 6).alias("mean_value"))
