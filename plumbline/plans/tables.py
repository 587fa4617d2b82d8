"""Grounding-style tables derived from the driver's parquet tables.

Each derived table is one SELECT that means the same in Spark SQL and DuckDB, so queries
and their checking SQL start from equal rows. ``h[[x]]`` stands for the first 32 bits of
md5(x) as a bigint and is spelled for each engine by :func:`spell`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import spread

FRAME_W, FRAME_H = 1000, 800

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name -> SELECT over base tables or earlier names
DERIVED: dict[str, str] = {
    # one row per candidate box of an image; iid is dense from 1
    "cand": """
SELECT l_orderkey AS image_id,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                          l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS iid,
       l_partkey AS partkey, l_suppkey AS suppkey, l_linenumber AS line, l_discount AS score, l_quantity AS quantity,
       CAST((l_partkey * 37 + l_linenumber * 101) % 800 AS DOUBLE) AS x0,
       CAST((l_suppkey * 53 + l_linenumber * 71) % 650 AS DOUBLE) AS y0,
       CAST((l_partkey * 37 + l_linenumber * 101) % 800 + 20 + l_partkey % 180 AS DOUBLE) AS x1,
       CAST((l_suppkey * 53 + l_linenumber * 71) % 650 + 20 + (l_suppkey * 7) % 130 AS DOUBLE) AS y1
FROM lineitem""",
    # candidates without the per-image number: no shuffle
    "boxes": """
SELECT l_orderkey AS image_id, l_linenumber AS line, l_partkey AS partkey, l_suppkey AS suppkey,
       l_quantity AS quantity, l_discount AS score, l_returnflag AS flag, l_extendedprice AS price,
       CAST((l_partkey * 37 + l_linenumber * 101) % 800 AS DOUBLE) AS x0,
       CAST((l_suppkey * 53 + l_linenumber * 71) % 650 AS DOUBLE) AS y0,
       CAST((l_partkey * 37 + l_linenumber * 101) % 800 + 20 + l_partkey % 180 AS DOUBLE) AS x1,
       CAST((l_suppkey * 53 + l_linenumber * 71) % 650 + 20 + (l_suppkey * 7) % 130 AS DOUBLE) AS y1,
       CAST((l_partkey * 37 + l_linenumber * 101) % 800 + (l_suppkey % 60) - 30 AS DOUBLE) AS px0,
       CAST((l_suppkey * 53 + l_linenumber * 71) % 650 + (l_partkey % 40) - 20 AS DOUBLE) AS py0,
       CAST((l_partkey * 37 + l_linenumber * 101) % 800 + 20 + l_partkey % 180 + (l_suppkey % 60) - 30 AS DOUBLE) AS px1,
       CAST((l_suppkey * 53 + l_linenumber * 71) % 650 + 20 + (l_suppkey * 7) % 130 + (l_partkey % 40) - 20 AS DOUBLE) AS py1
FROM lineitem""",
    # instances of an image with roles and labels
    "inst": """
SELECT c.*, p.p_brand AS label,
       CASE WHEN iid = 1 THEN 'referent' WHEN partkey % 4 = 0 THEN 'class_agnostic'
            WHEN partkey % 4 = 1 THEN 'other_class_instance' ELSE 'same_class_other_instance' END AS source,
       (x1 - x0) * (y1 - y0) / 800000.0e0 AS area_frac
FROM cand c JOIN part p ON c.partkey = p.p_partkey""",
    # evaluation items: one order is one item
    "items": """
SELECT o_orderkey AS item_id, substr(o_orderpriority, 3) AS dimension, o_orderkey % 5 = 0 AS no_target,
       o_custkey AS custkey, o_orderstatus AS status,
       CAST((o_orderkey * 37 + o_custkey * 11) % 780 AS DOUBLE) AS gx0,
       CAST((o_orderkey * 53 + o_custkey * 7) % 640 AS DOUBLE) AS gy0,
       CAST((o_orderkey * 37 + o_custkey * 11) % 780 + 20 + (o_orderkey * 13 + o_custkey) % 200 AS DOUBLE) AS gx1,
       CAST((o_orderkey * 53 + o_custkey * 7) % 640 + 20 + (o_custkey * 17 + o_orderkey) % 140 AS DOUBLE) AS gy1,
       1000 AS w, 800 AS h
FROM orders""",
    # raw model answers, one per item, covering every parser branch
    "answers": """
SELECT item_id, form,
  CASE form
    WHEN 0 THEN '```json' || chr(10) || '{"bbox_2d": [' || r0 || ', ' || r1 || ', ' || r2 || ', ' || r3 || ']}' || chr(10) || '```'
    WHEN 1 THEN '{"bbox_2d": [' || r0 || ', ' || r1 || ', ' || r2 || ', ' || r3 || ']}'
    WHEN 2 THEN 'Sure. {"label": "it", "bbox_2d": [' || r0 || '.5, ' || r1 || ', ' || r2 || ', ' || r3 || '.25]} done'
    WHEN 3 THEN 'The box is ' || r0 || ', ' || r1 || ', ' || r2 || ', ' || r3 || ' in the image'
    WHEN 4 THEN '{"bbox_2d": null}'
    WHEN 5 THEN 'There is no such object, so none.'
    WHEN 6 THEN 'I cannot help with that request'
    WHEN 7 THEN '{"bbox_2d": [' || r0 || ', ' || r1 || ', ' || r2 || ']}'
    WHEN 8 THEN '{"bbox_2d": [' || r2 || ', ' || r1 || ', ' || r2 || ', ' || r3 || ']}'
    WHEN 9 THEN 'nonetheless nothing here'
    WHEN 10 THEN '{"bbox_2d": [' || r2 || ', ' || r3 || ', ' || r0 || ', ' || r1 || ']}'
    ELSE '{"bbox_2d": oops} first 1 2 3 4 then ' || r0 || ' ' || r1 || ' ' || r2 || ' ' || r3 END AS answer
FROM (SELECT item_id, form, CAST(gx0 + dx AS BIGINT) AS r0, CAST(floor(gy0 * 1.25e0) + dy AS BIGINT) AS r1, CAST(gx1 + dx AS BIGINT) AS r2, CAST(floor(gy1 * 1.25e0) + dy AS BIGINT) AS r3
      FROM (SELECT item_id, gx0, gy0, gx1, gy1, h[['raw:' || item_id]] % 12 AS form, h[['dx:' || item_id]] % 40 - 10 AS dx, h[['dy:' || item_id]] % 30 AS dy FROM items) q) r""",
    # predictions per condition; the type is box, none or invalid
    "preds": """
SELECT item_id, condition, proto, ptype,
       CASE WHEN ptype = 'box' THEN gx0 + dx END AS x0, CASE WHEN ptype = 'box' THEN gy0 + dy END AS y0,
       CASE WHEN ptype = 'box' THEN gx1 + dx END AS x1, CASE WHEN ptype = 'box' THEN gy1 + dy END AS y1
FROM (SELECT item_id, condition, proto, gx0, gy0, gx1, gy1,
        CASE WHEN ht < (CASE WHEN condition = 'REMOVE' THEN 4 ELSE 1 END) THEN 'none' WHEN ht = 9 THEN 'invalid' ELSE 'box' END AS ptype,
        CASE WHEN condition = 'REMOVE' THEN h[['x:' || item_id || proto]] % 120 ELSE h[['x:' || item_id || condition || proto]] % 25 END AS dx,
        h[['y:' || item_id || condition || proto]] % 20 AS dy
      FROM (SELECT item_id, gx0, gy0, gx1, gy1, condition, proto, h[['t:' || item_id || condition || proto]] % 10 AS ht FROM items JOIN (VALUES ('ORIGINAL'), ('REMOVE'), ('CONTROL_OBJ'), ('CONTROL_BG'), ('T_NULL'), ('T_HEAD'), ('T_ATTR')) c(condition) ON 1 = 1
      JOIN (VALUES ('primary'), ('secondary')) m(proto) ON 1 = 1) q) p""",
    # one evaluation row per item
    "evals": """
SELECT item_id, dimension, CASE WHEN no_target THEN 0 ELSE 1 END AS n_gt, output_type, iou, hint_iou, p_null, parse_ok, status AS size_bin,
  CASE WHEN no_target THEN output_type <> 'box' ELSE output_type = 'box' AND iou >= 0.5 END AS correct,
  h[['base:' || item_id]] % 10 < 5 AS base_correct, CASE WHEN no_target THEN 'negative' ELSE 'positive' END AS kind, custkey AS grp,
  CASE WHEN h[['fn:' || item_id]] % 4 > 0 THEN h[['fc:' || item_id]] % 3 END AS false_no, 5 AS n_cells, h[['cs:' || item_id]] % 8 > 0 AS consistent,
  h[['or:' || item_id]] % 6 = 0 AS ordinal, CASE WHEN h[['co:' || item_id]] % 5 > 0 THEN (h[['cp:' || item_id]] % 1000) / 1000.0e0 END AS commit_no
FROM (SELECT *, CASE WHEN ot < 2 THEN 'none' WHEN ot = 8 THEN 'refusal' WHEN ot = 9 THEN 'invalid' ELSE 'box' END AS output_type, ot <> 9 AS parse_ok, CASE WHEN no_target THEN 0.0e0 ELSE (h[['iou:' || item_id]] % 101) / 100.0e0 END AS iou,
   CASE WHEN no_target THEN NULL ELSE (h[['hi:' || item_id]] % 101) / 100.0e0 END AS hint_iou,
   CASE WHEN h[['pn:' || item_id]] % 17 > 0 THEN (1 + h[['pv:' || item_id]] % 1000) / 100000.0e0 END AS p_null FROM (SELECT *, h[['ot:' || item_id]] % 10 AS ot FROM items) q) z""",
    # clause verdicts in long form
    "verdicts": """
SELECT image_id, iid, clause,
       CASE WHEN iid = 1 AND h[['u:' || image_id]] % 3 > 0 THEN 'yes'
            WHEN hv < 5 THEN 'yes' WHEN hv < 9 THEN 'no' ELSE 'unclear' END AS verdict
FROM (SELECT image_id, iid, clause, h[['v:' || image_id || ':' || iid || ':' || clause]] % 10 AS hv FROM cand JOIN (VALUES (1), (2), (3), (4), (5)) k(clause) ON 1 = 1) z""",
    # two raters and a third, derived from the given labels
    "raters": """
SELECT doc_id, 'r1' AS rater, CAST(quality AS VARCHAR(3)) AS label FROM labels
UNION ALL SELECT doc_id, 'r2', CAST(toxic AS VARCHAR(3)) FROM labels
UNION ALL SELECT doc_id, 'r3', CAST(CASE WHEN h[['r3:' || doc_id]] % 5 = 0 THEN 1 - quality ELSE quality END AS VARCHAR(3)) FROM labels""",
    # scored binary rows with many tied scores, clustered by image
    "scored": """
SELECT l_orderkey AS image_id, l_linenumber AS line, l_discount AS score, l_returnflag AS grp,
       CASE WHEN l_quantity + l_discount * 200 > 35 THEN 1 ELSE 0 END AS label
FROM lineitem""",
}

DEPENDS = {"inst": ("cand",), "answers": ("items",), "preds": ("items",), "evals": ("items",), "verdicts": ("cand",)}

_H = re.compile(r"\b(hl?)\[\[(.*?)\]\]", re.S)


def spell(sql: str, engine: str) -> str:
    """Fill in the hash macros for ``spark`` or ``duck``: ``h`` has 32 bits, ``hl`` 60."""

    def form(m):
        digits = f"substr(md5({m[2]}), 1, {15 if m[1] == 'hl' else 8})"
        return f"CAST(conv({digits}, 16, 10) AS BIGINT)" if engine == "spark" else f"CAST('0x' || {digits} AS BIGINT)"

    return _H.sub(form, sql)


def with_tables(names: str, body: str) -> str:
    """DuckDB SQL: ``body`` preceded by the derived tables it uses."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, ()):
            add(d)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    ctes = [f"{n} AS ({DERIVED[n].strip()})" for n in order]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return spell("WITH RECURSIVE " + ",\n".join(ctes + [body[15:]]), "duck")
    if body.upper().startswith("WITH "):
        return spell("WITH " + ",\n".join(ctes + [body[5:]]), "duck")
    return spell(("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body, "duck")


class Tables:
    """Base and derived tables of one scale-factor folder, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in BASE:
                self._cache[name] = spread(self.scan(name))
            elif name == "cand":
                self._cache[name] = self._numbered(DERIVED[name])
            elif name in DERIVED:
                self._cache[name] = self.sql(DERIVED[name])
            else:
                raise AttributeError(name)
        return self._cache[name]

    def _numbered(self, text: str) -> DataFrame:
        """The rows of a SELECT that numbers the rows of a key, which is named before the shuffle and all else after it:
        the shuffle carries the bare columns, and what is grouped by the key later needs no other one."""
        found = re.search(r"row_number\(\) OVER \(PARTITION BY (\w+) ORDER BY ([^()]*)\) AS (\w+)", text)
        key, order, number = found.groups()
        named, table = re.search(rf"\b{key} AS (\w+)", text)[1], re.search(r"\bFROM (\w+)", text)[1]
        w = Window.partitionBy(named).orderBy(*[c.strip() for c in order.split(",")])
        rows = self.scan(table).withColumnRenamed(key, named).withColumn(number, F.row_number().over(w))
        rest = text.replace(found[0], number).replace(f"{key} AS {named}", named)
        return self.spark.sql(re.sub(rf"\bFROM {table}\b", "FROM {rows}", rest), rows=rows)

    def scan(self, name: str) -> DataFrame:
        """The bare file scan of a base table."""
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over base and derived names, without registering views."""
        text = spell(text, "spark").replace("{", "{{").replace("}", "}}")
        names = [n for n in (*BASE, *DERIVED) if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text, re.I)]
        for n in names:
            text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b(\s+(?:AS\s+)?)?(?=[a-z]\b)?", lambda m, n=n: m.group(0).replace(n, "{" + n + "}"), text, flags=re.I)
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})
