"""Free-text answers parsed into columns, over the driver's texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import text as T
from plumbline.operators import traces as TR
from plumbline.plans.registry import query
from plumbline.plans.tables import with_tables

col = F.col
EDGE_L, EDGE_R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def q(s: str) -> str:
    """A Python text as a SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def bounded(words: str) -> str:
    return q(EDGE_L + words + EDGE_R)


# ---- answers ----

SQL_BOX = r"""
a AS (SELECT item_id, answer, lower(answer) AS low, regexp_extract(answer, '(?s)\{[^{}]*"bbox_2d"[^{}]*\}', 0) AS js FROM answers),
b AS (SELECT *, low LIKE '%i cannot help%' OR low LIKE '%i can''t help%' OR low LIKE '%as an ai%' AS refusal,
   js <> '' AND json_valid(js) AS has_json,
   regexp_matches(low, '(^|[^a-z])(none|no such object|not present)($|[^a-z])') AS none_hit,
   regexp_extract_all(answer, '(-?\d+(?:\.\d+)?)[\s,]+(-?\d+(?:\.\d+)?)[\s,]+(-?\d+(?:\.\d+)?)[\s,]+(-?\d+(?:\.\d+)?)', 0) AS runs FROM a),
c AS (SELECT *, CASE WHEN has_json THEN json_type(js, '$.bbox_2d') END AS jt, CASE WHEN has_json THEN json_array_length(js, '$.bbox_2d') END AS jn FROM b),
d AS (SELECT *, CASE WHEN refusal THEN NULL WHEN has_json THEN (CASE WHEN jt = 'ARRAY' AND jn = 4 THEN CAST(json_extract(js, '$.bbox_2d') AS DOUBLE[]) END)
   WHEN none_hit THEN NULL WHEN len(runs) > 0 THEN list_transform(regexp_extract_all(runs[-1], '-?\d+(?:\.\d+)?', 0), lambda x: CAST(x AS DOUBLE)) END AS v FROM c),
e AS (SELECT *, greatest(0.0e0, least(v[1] * 1.0e0, 1000.0e0)) AS xa, greatest(0.0e0, least(v[3] * 1.0e0, 1000.0e0)) AS xb,
   greatest(0.0e0, least(v[2] * 0.8e0, 800.0e0)) AS ya, greatest(0.0e0, least(v[4] * 0.8e0, 800.0e0)) AS yb FROM d),
parsed AS (SELECT item_id, CASE WHEN refusal THEN 'refusal' WHEN has_json AND jt = 'NULL' THEN 'none' WHEN has_json AND v IS NULL THEN 'invalid'
   WHEN NOT has_json AND none_hit THEN 'none' WHEN v IS NULL THEN 'invalid' WHEN xa = xb OR ya = yb THEN 'invalid' ELSE 'box' END AS output_type,
   CASE WHEN v IS NULL THEN 0 ELSE 1 END AS n_boxes, CASE WHEN v IS NOT NULL THEN least(xa, xb) END AS x0, CASE WHEN v IS NOT NULL THEN least(ya, yb) END AS y0,
   CASE WHEN v IS NOT NULL THEN greatest(xa, xb) END AS x1, CASE WHEN v IS NOT NULL THEN greatest(ya, yb) END AS y1 FROM e)
"""


def parsed_answers(t):
    """(item_id, output_type, parse_ok, n_boxes, box) of every raw answer."""
    p = T.parse_box_answer(col("answer"), F.lit(1000), F.lit(800), none_patterns=T.NONE_PATTERNS)
    return t.answers.select("item_id", p.alias("p")).select("item_id", "p.*")


@query("parse_box_answer", with_tables("answers", "WITH " + SQL_BOX + "SELECT item_id, output_type, output_type <> 'invalid' AS parse_ok, n_boxes, x0, y0, x1, y1 FROM parsed"))
def parse_box_answer(t):
    return parsed_answers(t).select("item_id", "output_type", "parse_ok", "n_boxes", *G.fields(col("box")))


POINTS = """
SELECT item_id, CASE h[['pt:' || item_id]] % 7
  WHEN 0 THEN '<points coords="1 ' || a || ' ' || b || '"/>'
  WHEN 1 THEN 'here <points alt="x" coords="1 ' || a || ' ' || b || '; 2 ' || b || ' ' || a || '"/>'
  WHEN 2 THEN '<points coords=" "/>' WHEN 3 THEN '<points coords="1 1500 1600"/>'
  WHEN 4 THEN 'I see none of them' WHEN 5 THEN 'as an AI I can not'
  ELSE '<tracks coords="1 ' || a || ' ' || b || '"/> and <points coords="7 1200 300; 8 ' || b || ' 200" />' END AS answer
FROM (SELECT item_id, 100 + h[['pa:' || item_id]] % 900 AS a, 100 + h[['pb:' || item_id]] % 900 AS b FROM items) z"""


@query("parse_point_answer", with_tables("items", "WITH pts AS (" + POINTS + r"""),
a AS (SELECT item_id, lower(answer) AS low, regexp_extract_all(answer, '<(?:points|tracks)[^>]*?coords="([0-9\t:;, .]+)"\s*/?>', 1) AS tags FROM pts),
b AS (SELECT *, flatten(list_transform(tags, lambda c: regexp_extract_all(c, '([0-9]+) ([0-9]{3,4}) ([0-9]{3,4})', 0))) AS tr FROM a),
c AS (SELECT *, list_transform(tr, lambda s: {'x': CAST(split_part(s, ' ', 2) AS DOUBLE) * (1000.0e0 / 1000), 'y': CAST(split_part(s, ' ', 3) AS DOUBLE) * (800.0e0 / 1000)}) AS pts FROM b),
d AS (SELECT *, list_filter(pts, lambda p: p.x <= 1000 AND p.y <= 800) AS k, low LIKE '%as an ai%' AS refusal,
   regexp_matches(low, '(^|[^a-z])(none|no such object|not present)($|[^a-z])') AS none_hit FROM c)
SELECT item_id, CASE WHEN refusal THEN 'refusal' WHEN len(k) = 1 THEN 'point' WHEN len(k) > 1 THEN 'set' WHEN none_hit THEN 'none'
  WHEN len(tags) > 0 AND len(tr) = 0 THEN 'none' ELSE 'invalid' END AS output_type,
  CASE WHEN NOT refusal THEN k[1].x END AS x, CASE WHEN NOT refusal THEN k[1].y END AS y,
  CASE WHEN refusal THEN 0 WHEN len(k) > 0 THEN len(k) WHEN none_hit OR len(tr) = 0 THEN 0 ELSE len(tr) END AS n_points FROM d"""))
def parse_point_answer(t):
    p = T.parse_point_answer(col("answer"), F.lit(1000), F.lit(800), T.NONE_PATTERNS)
    return t.sql(POINTS).select("item_id", p.alias("p")).select("item_id", "p.output_type", "p.x", "p.y", "p.n_points")


TEXTS = """
SELECT 'd' || doc_id AS id, CASE h[['mix:' || doc_id]] % 6 WHEN 0 THEN text || ' As an AI I stop.' WHEN 1 THEN 'none. ' || text
   WHEN 2 THEN 'nonetheless ' || text WHEN 3 THEN 'Yep! ' || text WHEN 4 THEN '  NOPE ' || text ELSE text END AS text FROM documents
UNION ALL SELECT 'c' || conv_id || '-' || turn, CASE h[['mix:' || conv_id || turn]] % 4 WHEN 0 THEN 'Unclear, ' || text WHEN 1 THEN 'it is not present ' || text ELSE text END FROM conversations"""


@query("refusal_and_none_match", with_tables("", "WITH x AS (" + TEXTS + r""")
SELECT id, lower(text) LIKE '%i can''t help%' OR lower(text) LIKE '%i cannot help%' OR lower(text) LIKE '%i''m unable to%' OR lower(text) LIKE '%i am unable to%'
  OR lower(text) LIKE '%i can''t assist%' OR lower(text) LIKE '%i cannot assist%' OR lower(text) LIKE '%as an ai%' AS refusal,
  regexp_matches(lower(text), '(^|[^a-z])(none|no such object|not present)($|[^a-z])') AS abstains FROM x"""))
def refusal_and_none_match(t):
    return t.sql(TEXTS).select("id", T.looks_like_refusal(col("text")).alias("refusal"), T.matches_none(col("text")).alias("abstains"))


@query("first_word_verdict", with_tables("", "WITH x AS (" + TEXTS + r"""), w AS (SELECT id, regexp_extract(lower(text), '[a-z]+', 0) AS w FROM x)
SELECT id, nullif(w, '') AS word, CASE WHEN w IN ('yes', 'yeah', 'yep') THEN 'yes' WHEN w IN ('no', 'nope') THEN 'no' WHEN w LIKE 'unclear%' THEN 'unclear' ELSE 'unparsed' END AS verdict,
  CASE WHEN w IN ('yes', 'yeah', 'yep') THEN true WHEN w IN ('no', 'nope') THEN false END AS flag FROM w"""))
def first_word_verdict(t):
    x = col("text")
    return t.sql(TEXTS).select("id", T.first_word(x).alias("word"), T.verdict_word(x).alias("verdict"), T.yes_no(x).alias("flag"))


def _pick(seed: str, key: str, options: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options[:-1]))
    return f"CASE h[['{seed}:' || {key}]] % {len(options)} {cases} ELSE '{options[-1]}' END"


V3 = ["yes", "no", "unclear"]
NUMBERED = f"""
SELECT doc_id, '1: ' || {_pick('n1', 'doc_id', ['Yes', 'no', 'UNCLEAR'])} || chr(10) || text || chr(10) || '** 2) **' || {_pick('n2', 'doc_id', V3)} || ' | it is red.' || chr(10)
  || '3 - maybe' || chr(10) || '2: no | x' || chr(10) || ' 4. ' || {_pick('n4', 'doc_id', V3)} || '| a blue one ' || chr(10) || '9: yes' AS text FROM documents"""


def _duck_numbered(k: int, group: int) -> str:
    p = r"(?im)^\s*\**\s*" + str(k) + r"\s*[.:)\-]+\s*\**\s*(yes|no|unclear)\b[ \t]*\|?[ \t]*([^\n]*?)[ \t]*$"
    return f"regexp_extract(text, '{p}', {group})"


@query("numbered_verdict_lines", with_tables("", "WITH x AS (" + NUMBERED + ") SELECT doc_id, "
       + ", ".join(f"coalesce(nullif(lower({_duck_numbered(k, 1)}), ''), 'unparsed') AS v{k}" for k in (1, 2, 3, 4))
       + f", rtrim({_duck_numbered(2, 2)}, '.') AS s2, rtrim({_duck_numbered(4, 2)}, '.') AS s4, 'item ' || doc_id AS l1, CAST(NULL AS VARCHAR) AS l2, 'a quoted one' AS l3 FROM x"))
def numbered_verdict_lines(t):
    x = t.sql(NUMBERED)
    v, s = T.numbered_verdicts(col("text"), 4), T.numbered_verdicts_seen(col("text"), 4)
    listed = F.concat(F.lit("Here they are:\n1. item "), col("doc_id").cast("string"), F.lit(" \nnoise\n3. \"a quoted one\"\n1. again\n7. beyond"))
    return x.select("doc_id", v.alias("v"), s.alias("s"), T.numbered_lines(listed, 3).alias("l")).select("doc_id", *[col("v")[k - 1].alias(f"v{k}") for k in (1, 2, 3, 4)], *[col("l")[k - 1].alias(f"l{k}") for k in (1, 2, 3)],
                                                                col("s")[1]["seen"].alias("s2"), col("s")[3]["seen"].alias("s4"))


TAGGED = """
SELECT doc_id, regexp_replace(text, '[^a-z ]', '', 'g') AS plain FROM documents"""
TAGGED_SPARK = "SELECT doc_id, regexp_replace(text, '[^a-z ]', '') AS plain FROM documents"
TAGGED_BODY = """
SELECT doc_id, plain, 'head:  "' || trim(plain) || '"' || chr(10) || 'Clause: has ' || doc_id || ' stripes.' || chr(10) || 'noise' || chr(10) || 'CLAUSE: ' || chr(10) || 'CLAUSE: "' || trim(plain) || '"' AS dec,
  '"' || trim(plain) || '"' || chr(10) || 'Changed: red ' || doc_id || ' -> blue' AS flip,
  'OLD: red ' || doc_id || chr(10) || 'new1: "blue"' || chr(10) || 'NEW2: ' || trim(plain) || ' x' AS v2 FROM p"""


@query("tagged_line_fields", with_tables("", "WITH p AS (" + TAGGED + "), x AS (" + TAGGED_BODY + r""")
SELECT doc_id, trim(plain) AS head, CASE WHEN trim(plain) = '' THEN 1 ELSE 2 END AS n_clauses, 'has ' || doc_id || ' stripes' AS c1, nullif(trim(plain), '') AS c2,
  CASE WHEN trim(plain) = '' THEN '' ELSE trim(plain) END AS expr, 'red ' || doc_id AS old, 'blue' AS new, 'red ' || doc_id AS old2, 'blue' AS new1,
  CASE WHEN trim(plain) = '' THEN 'x' ELSE trim(plain) || ' x' END AS new2, trim(plain) AS line FROM x"""))
def tagged_line_fields(t):
    p = t.sql(TAGGED_SPARK)
    x = t.spark.sql(TAGGED_BODY.replace("FROM p", "FROM {p}"), p=p)
    d = x.select("doc_id", T.decomposition(col("dec")).alias("d"), T.flip_answer(col("flip")).alias("f"), T.old_new_spans(col("v2")).alias("o"), T.clean_line(col("flip")).alias("line"))
    return d.select("doc_id", col("d.head").alias("head"), F.size("d.clauses").alias("n_clauses"), F.get("d.clauses", F.lit(0)).alias("c1"), F.get("d.clauses", F.lit(1)).alias("c2"),
                    col("f.expr").alias("expr"), col("f.old").alias("old"), col("f.new").alias("new"), col("o.old").alias("old2"),
                    F.get("o.news", F.lit(0)).alias("new1"), F.get("o.news", F.lit(1)).alias("new2"), "line")


BLOCKS = """
SELECT doc_id, 'intro <description> ' || text || ' </description><details>' || chr(10) || '1. has a red frame.' || chr(10) || '2) number ' || doc_id || chr(10) || '</details>' AS d,
  '<version kind="A" detail="1">' || chr(10) || 'old: red' || chr(10) || 'new: blue' || chr(10) || 'detail: 1. has a blue frame.' || chr(10) || 'description: ' || text || chr(10) || '</version>'
  || '<version kind="B" detail="2">' || chr(10) || 'old: x' || chr(10) || 'new: y' || chr(10) || '</version><version kind="C" detail="' || (1 + doc_id % 3) || '">old: p'
  || chr(10) || 'new: q' || chr(10) || 'detail: is q' || chr(10) || 'description: the q</version>' AS v FROM documents"""


@query("tagged_blocks", with_tables("", r"""
SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS description, 2 AS n_details, 'has a red frame' AS d1, 'number ' || doc_id AS d2,
  CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS n_versions, 'A' AS kind1, 'has a blue frame' AS detail1, CASE WHEN doc_id % 3 > 0 THEN 'is q' END AS detail2,
  CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 3 AS INT) END AS idx2 FROM documents"""))
def tagged_blocks(t):
    x = t.sql(BLOCKS).select("doc_id", T.describe_answer(col("d")).alias("d"), T.version_blocks(col("v")).alias("v"))
    v0, v1 = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    return x.select("doc_id", "d.description", F.size("d.details").alias("n_details"), F.get("d.details", F.lit(0)).alias("d1"), F.get("d.details", F.lit(1)).alias("d2"),
                    F.size("v").alias("n_versions"), v0["kind"].alias("kind1"), v0["detail"].alias("detail1"), v1["detail"].alias("detail2"), v1["idx"].alias("idx2"))


# ---- traces ----


def scene_rows(t):
    """Capped candidate rows with verdict arrays: (image_id, iid, box, verdicts, pos)."""
    v = TR.verdict_rows(t.verdicts, ["image_id", "iid"], "clause", "verdict")
    box = G.box(col("x0"), col("y0"), col("x1"), col("y1"))
    rows = t.cand.select("image_id", "iid", box.alias("box")).join(v, ["image_id", "iid"])
    first = col("iid") == 1
    return TR.order_rows(TR.cap_rows(rows, "image_id", first, G.area(col("box")), "iid"), "image_id", first, "iid", "iid")


def conds():
    return F.array(*[F.lit(s) for s in ("is red", "has a handle", "is left of it", "reads 7", "is open")])


def scene_traces(t, style="yn"):
    """(image_id, text): one rendered trace per image."""
    cells = F.transform("verdicts", lambda v: F.struct(v.alias("verdict"), F.lit("it is blue, not red").alias("reason")))
    rows = TR.collect_rows(scene_rows(t), "image_id", [G.relative_1000(col("box"), 1000, 800).alias("rel"), cells.alias("cells")],
                           [F.max(F.when(col("iid") == 1, G.relative_1000(col("box"), 1000, 800))).alias("rel1"),
                            F.max(F.when((col("iid") == 1) & ~F.array_contains("verdicts", "no"), 1).otherwise(0)).alias("target_fits")])
    return rows.select("image_id", T.render_trace(conds(), col("rows"), F.when(col("target_fits") == 1, col("rel1")), style).alias("text"))


SQL_SCENE = """
ranked AS (SELECT image_id, iid, x0, y0, x1, y1, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN iid = 1 THEN 0 ELSE 1 END, (x1 - x0) * (y1 - y0) DESC, iid) AS rk FROM cand),
vc AS (SELECT image_id, iid, count(*) FILTER (verdict = 'no') AS n_no, count(*) FILTER (verdict = 'yes') AS n_yes FROM verdicts GROUP BY 1, 2),
sc AS (SELECT r.image_id, r.iid, n_no, n_yes, row_number() OVER (PARTITION BY r.image_id ORDER BY r.iid) AS pos,
   x0, round_even(y0 * 1000 / 800, 0) * 800 / 1000 AS y0, x1, round_even(y1 * 1000 / 800, 0) * 800 / 1000 AS y1
   FROM ranked r JOIN vc USING (image_id, iid) WHERE rk <= 6),
der AS (SELECT image_id, count(*) AS n_cand, count(*) FILTER (n_no = 0) AS n_fit, max(CASE WHEN iid = 1 AND n_no = 0 THEN 1 ELSE 0 END) AS target_fits,
   arg_min(pos, CASE WHEN n_no = 0 THEN -n_yes * 100 + pos ELSE 10000 + pos END) AS best FROM sc GROUP BY 1)"""


@query("trace_table_parse", with_tables("verdicts", "WITH " + SQL_SCENE + """
SELECT d.image_id, 5 AS n_conditions, n_cand, true AS format_ok, CASE WHEN target_fits = 1 THEN 'box' ELSE 'null' END AS free_type,
  CASE WHEN n_fit > 0 THEN 'box' ELSE 'null' END AS derived_type, CASE WHEN n_fit > 0 THEN best END AS derived_id,
  CASE WHEN n_fit > 0 THEN b.x0 END AS bx0, CASE WHEN n_fit > 0 THEN CAST(b.y0 AS DOUBLE) END AS by0, CASE WHEN n_fit > 0 THEN b.x1 END AS bx1, CASE WHEN n_fit > 0 THEN CAST(b.y1 AS DOUBLE) END AS by1
FROM der d JOIN sc b ON b.image_id = d.image_id AND b.pos = d.best"""))
def trace_table_parse(t):
    p = scene_traces(t).select("image_id", T.trace_table(col("text"), F.lit(1000), F.lit(800)).alias("p"))
    return p.select("image_id", F.size("p.conditions").alias("n_conditions"), F.size("p.candidates").alias("n_cand"), "p.format_ok", "p.free_type",
                    "p.derived_type", "p.derived_id", *G.fields(col("p.derived_box"), "b"))


AUDITS = f"""
SELECT doc_id, '<audit>' || chr(10) || '1. [color] is red | seen: ' || text_line || ' | ' || {_pick('a1', 'doc_id', ['match', 'Mismatch', 'unsure'])} || chr(10)
 || '2. [nope] has ' || doc_id || ' legs | seen:  | mismatch' || chr(10) || 'junk' || chr(10) || '</audit><verdict> fits </verdict>' AS a
FROM (SELECT doc_id, replace(replace(text, chr(10), ' '), '|', ' ') AS text_line FROM documents) z"""


@query("audit_lines_parse", with_tables("", rf"""
SELECT doc_id, 2 AS n_lines, 'color' AS type1, CAST(NULL AS VARCHAR) AS type2, regexp_replace(replace(replace(text, chr(10), ' '), '|', ' '), '^\s+|\s+$', '', 'g') AS seen1,
  lower({_pick('a1', 'doc_id', ['match', 'Mismatch', 'unsure'])}) AS verdict1, 'has ' || doc_id || ' legs' AS claimed2, '' AS seen2, 'fits' AS verdict, true AS format_ok FROM documents"""))
def audit_lines_parse(t):
    p = t.sql(AUDITS).select("doc_id", T.audit_lines(col("a")).alias("p"))
    l0, l1 = F.get("p.lines", F.lit(0)), F.get("p.lines", F.lit(1))
    return p.select("doc_id", F.size("p.lines").alias("n_lines"), l0["type"].alias("type1"), l1["type"].alias("type2"), l0["seen"].alias("seen1"), l0["verdict"].alias("verdict1"),
                    l1["claimed"].alias("claimed2"), l1["seen"].alias("seen2"), "p.verdict", "p.format_ok")


PHRASES = """
SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'no json' WHEN p_partkey % 11 = 1 THEN '{"head_noun": "", "noun_phrases": []}'
  ELSE 'Sure: {"head_noun": "' || upper(split_part(p_name, ' ', 2)) || '", "noun_phrases": ["' || p_name || '", " ' || p_type || ' ' || split_part(p_name, ' ', 2) || '", "a table", ""'
   || (CASE WHEN p_partkey % 3 = 0 THEN ', "' || split_part(p_name, ' ', 2) || '"' ELSE '' END) || ']} ok' END AS t,
  lower(split_part(p_name, ' ', 2)) AS hd, lower(p_name) AS nm FROM part"""


@query("json_head_and_phrases", with_tables("", "WITH x AS (" + PHRASES + """)
SELECT p_partkey, CASE WHEN p_partkey % 11 > 1 THEN hd END AS head, CASE WHEN p_partkey % 11 > 1 THEN 4 END AS n_phrases,
  CASE WHEN p_partkey % 11 > 1 THEN CASE WHEN p_partkey % 3 = 0 THEN nm ELSE hd END END AS first_phrase, CASE WHEN p_partkey % 11 > 1 THEN 'a table' END AS others FROM x"""))
def json_head_and_phrases(t):
    x = t.sql(PHRASES).select("p_partkey", T.json_phrases(col("t")).alias("p"))
    return x.select("p_partkey", "p.head", F.when(col("p").isNotNull(), F.size("p.phrases")).alias("n_phrases"), F.get("p.phrases", F.lit(0)).alias("first_phrase"),
                    F.array_join(T.other_phrases(col("p.head"), col("p.phrases")), ";").alias("others"))


NOUNS = """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'The ' ELSE '' END || text AS t FROM documents"""


@query("heuristic_noun_phrase", with_tables("", "WITH x AS (" + NOUNS + rf"""),
a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(t), '^\s+|\s+$', '', 'g'), '\.+$', ''), '^(the |a |an )', '') AS b FROM x),
c AS (SELECT doc_id, regexp_replace(regexp_replace(b, {q(r"(?s)(^|[^\p{L}\p{N}_])" + T.RELATIONAL_CUE[2:-2] + r"($|[^\p{L}\p{N}_].*)")}, '\1'), '^\s+|\s+$', '', 'g') AS ph FROM a),
d AS (SELECT doc_id, ph, regexp_extract_all(ph, '[a-z]+', 0) AS w FROM c)
SELECT doc_id, CASE WHEN len(w) > 0 THEN w[-1] END AS head, CASE WHEN len(w) > 0 THEN ph END AS phrase FROM d"""))
def heuristic_noun_phrase(t):
    return t.sql(NOUNS).select("doc_id", T.heuristic_phrase(col("t")).alias("p")).select("doc_id", "p.head", "p.phrase")


SWAPS = """
SELECT p_partkey, split_part(p_name, ' ', 2) AS noun, 'The ' || p_name || ' beside two ' || split_part(p_name, ' ', 2) || 's. ' || upper(substr(split_part(p_name, ' ', 2), 1, 1))
  || substr(split_part(p_name, ' ', 2), 2) || ' or ' || split_part(p_name, ' ', 2) || 'ed ' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS t,
  CASE p_partkey % 3 WHEN 0 THEN 'polar ' || split_part(p_name, ' ', 2) ELSE 'sundial' END AS r FROM part"""


@query("word_swap_counted", with_tables("", "WITH x AS (" + SWAPS + r""")
SELECT p_partkey, 3 AS hits, 'The ' || split_part(p_name, ' ', 1) || ' ' || r || ' beside two ' || r || '. ' || upper(substr(r, 1, 1)) || substr(r, 2) || ' or ' || noun || 'ed '
  || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS text FROM x JOIN part USING (p_partkey)"""))
def word_swap_counted(t):
    return t.sql(SWAPS).select("p_partkey", T.swap_noun(col("t"), col("noun"), col("r")).alias("s")).select("p_partkey", "s.hits", "s.text")


@query("substitute_once", with_tables("", rf"""
WITH x AS (SELECT doc_id, text, regexp_extract(lower(text), '[a-z]+', 0) AS old FROM documents),
c AS (SELECT *, len(regexp_extract_all(regexp_replace(text, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '(?i)(?:^|[^\p{{L}}\p{{N}}_])' || old || '(?:$|[^\p{{L}}\p{{N}}_])', 0)) AS n FROM x)
SELECT doc_id, CASE WHEN old <> '' AND old <> 'blue one' AND n = 1 THEN regexp_replace(text, '(?i)(^|[^\p{{L}}\p{{N}}_])' || old || '($|[^\p{{L}}\p{{N}}_])', '\1blue $1\2') END AS text FROM c"""))
def substitute_once(t):
    old = F.regexp_extract(F.lower("text"), "[a-z]+", 0)
    return t.documents.select("doc_id", T.substitute_once(col("text"), old, F.lit("blue $1")).alias("text"))


HUES = ["red", "blue", "green", "white"]
SPANS = f"""
SELECT item_id, x1, x2, x3, y, 'the ' || x1 || ' cup that is on the ' || x2 || ' table and near a ' || x3 || ' box' AS expr, 'is a ' || x1 || ' cup' AS c1, 'is on the ' || x2 || ' table' AS c2,
  'is near a ' || x3 || ' box' AS c3, 'is on the ' || x2 || ' table.' AS old, 'is on the ' || y || ' table' AS new
FROM (SELECT item_id, {_pick('s1', 'item_id', HUES)} AS x1, {_pick('s2', 'item_id', HUES)} AS x2, {_pick('s3', 'item_id', HUES)} AS x3, {_pick('s4', 'item_id', HUES)} AS y FROM items) z"""


@query("align_span", with_tables("items", "WITH s AS (" + SPANS + """),
a AS (SELECT *, CASE WHEN x2 = y THEN NULL WHEN x1 <> x2 AND x3 <> x2 THEN x2 WHEN x1 <> x2 THEN 'the ' || x2 ELSE x2 || ' table' END AS o,
  CASE WHEN x2 = y THEN NULL WHEN x1 <> x2 AND x3 <> x2 THEN y WHEN x1 <> x2 THEN 'the ' || y ELSE y || ' table' END AS n FROM s)
SELECT item_id, o AS old_span, n AS new_span, CASE WHEN o IS NOT NULL THEN 'the ' || x1 || ' cup that is on the ' || y || ' table and near a ' || x3 || ' box' END AS expr_neg,
  CASE WHEN o IS NOT NULL THEN 1 END AS flipped_idx, CASE WHEN o IS NOT NULL THEN 'is on the ' || y || ' table' END AS clause_neg FROM a"""))
def align_span(t):
    clauses = F.array("c1", "c2", "c3")
    x = t.sql(SPANS).withColumn("a", T.align_span(col("expr"), clauses, col("old"), col("new")))
    x = x.select("item_id", "a", T.flip_candidate(col("expr"), clauses, col("old"), col("new"), col("a")).alias("f"))
    return x.select("item_id", col("a.old").alias("old_span"), col("a.new").alias("new_span"), "f.expr_neg", "f.flipped_idx", "f.clause_neg")


@query("flipped_position", with_tables("items", f"""
WITH z AS (SELECT item_id, {_pick('s1', 'item_id', HUES)} AS a, {_pick('s2', 'item_id', HUES)} AS b, {_pick('s3', 'item_id', HUES)} AS c, {_pick('s4', 'item_id', HUES)} AS d FROM items)
SELECT item_id, CASE WHEN item_id % 7 = 0 THEN NULL WHEN a <> b AND c = d THEN 0 WHEN a = b AND c <> d THEN 2 END AS idx FROM z"""))
def flipped_position(t):
    x = t.sql(f"SELECT item_id, {_pick('s1', 'item_id', HUES)} AS a, {_pick('s2', 'item_id', HUES)} AS b, {_pick('s3', 'item_id', HUES)} AS c, {_pick('s4', 'item_id', HUES)} AS d FROM items")
    pos = F.array(col("a"), F.lit("same "), col("c"))
    neg = F.array(F.upper("b"), F.lit("Same"), col("d"))
    neg = F.when(col("item_id") % 7 == 0, F.slice(neg, 1, 2)).otherwise(neg)
    return x.select("item_id", T.flipped_position(pos, neg).alias("idx"))


@query("join_clauses", with_tables("cand", """
WITH c AS (SELECT image_id, count(*) AS n, string_agg('has part ' || partkey, ', ' ORDER BY iid) FILTER (iid < m) AS lead, max(CASE WHEN iid = m THEN 'has part ' || partkey END) AS last
  FROM (SELECT *, max(iid) OVER (PARTITION BY image_id) AS m FROM cand) z GROUP BY 1)
SELECT image_id, CASE WHEN n = 1 THEN 'the box that ' || last ELSE 'the box that ' || lead || ', and ' || last END AS expr,
  'The box that ' || CASE WHEN n = 1 THEN last ELSE replace(lead, ', ', ' and ') || ' and ' || last END || '.' AS phrase FROM c"""))
def join_clauses(t):
    packed = F.transform(F.array_sort(F.collect_list(F.struct("iid", F.concat(F.lit("has part "), col("partkey").cast("string")).alias("c")))), lambda s: s["c"])
    g = t.cand.groupBy("image_id").agg(packed.alias("cs"))
    return g.select("image_id", T.join_clauses(F.lit("box"), col("cs")).alias("expr"), T.condition_phrase(F.lit("box"), col("cs")).alias("phrase"))


def _b(pattern: str) -> str:
    """A bounded-word pattern for RE2: ASCII word edges replaced by Unicode-aware classes."""
    return pattern.replace(r"\b", "\0")


def _clause_sql(p: str) -> str:
    inner = p
    return "regexp_matches(low, " + q("(?:" + inner.replace(r"\b(", EDGE_L + "(", 1).replace(r")\b\s+\w+", r")\s+[\p{L}\p{N}_]").replace(r")\b", ")" + EDGE_R) + ")") + ")"


@query("clause_category", with_tables("", "WITH x AS (" + TEXTS + "), l AS (SELECT id, lower(text) AS low FROM x) SELECT id, CASE "
       + f"WHEN {_clause_sql(T.CLAUSE_RELATION)} THEN 'relation' WHEN {_clause_sql(T.CLAUSE_TEXT)} AND NOT {_clause_sql(T.CLAUSE_TEXT_NOT)} THEN 'text' "
       + f"WHEN {_clause_sql(T.CLAUSE_COLOR)} THEN 'color' WHEN {_clause_sql(T.CLAUSE_COUNT)} THEN 'count' WHEN {_clause_sql(T.CLAUSE_MATERIAL)} THEN 'material' "
       + f"WHEN {_clause_sql(T.CLAUSE_STATE)} THEN 'state' WHEN {_clause_sql(T.CLAUSE_SHAPE)} THEN 'shape' ELSE 'part' END AS audit_type, CASE "
       + " ".join(f"WHEN {_clause_sql(p)} THEN '{n}'" for n, p in T.LINE_CATEGORIES if n != "text").replace("WHEN regexp_matches(low, '(?:(^|[^\\p{L}\\p{N}_])(\\d+|one",
                  "WHEN low SIMILAR TO '.*' AND regexp_matches(low, " + q("\"|'|" + EDGE_L + "(text|reads|written|logo|sign|number)" + EDGE_R + "|" + EDGE_L + "letter") + ") THEN 'text' WHEN regexp_matches(low, '(?:(^|[^\\p{L}\\p{N}_])(\\d+|one")
       + " ELSE 'other' END AS line_type FROM l")
       .replace("low SIMILAR TO '.*' AND ", ""))
def clause_category(t):
    return t.sql(TEXTS).select("id", T.clause_category(col("text")).alias("audit_type"), T.line_category(col("text")).alias("line_type"))


NORM_WORDS = T.NORM_DROP[3:-3]
NEG_LIST = "[" + ", ".join(q(w) for w in T.NEGATIONS) + "]"


def _duck_norm(x: str) -> str:
    drop = "[" + ", ".join(q(w) for w in NORM_WORDS.split("|")) + "]"
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9 ]+', ' ', 'g'), ' '), lambda w: w <> '' AND NOT list_contains({drop}, w))"


@query("normalise_and_named_value", with_tables("", f"""
WITH x AS (SELECT c.conv_id, c.turn, c.text AS seen, d.text AS claimed FROM conversations c JOIN documents d ON d.doc_id = c.conv_id),
n AS (SELECT conv_id, turn, {_duck_norm('seen')} AS s, {_duck_norm('claimed')} AS c FROM x)
SELECT conv_id, turn, array_to_string(s, ' ') AS normed, len(list_filter(s, lambda w: NOT list_contains({NEG_LIST}, w))) > 0
  AND len(list_filter(s, lambda w: NOT list_contains({NEG_LIST}, w) AND NOT list_contains(c, w))) > 0 AS named FROM n"""))
def normalise_and_named_value(t):
    d = t.documents.select(col("doc_id").alias("conv_id"), col("text").alias("claimed"))
    x = t.conversations.join(d, "conv_id")
    return x.select("conv_id", "turn", T.norm(col("text")).alias("normed"), T.named_value(col("text"), col("claimed")).alias("named"))


FLIPS = f"""
SELECT item_id, {_pick('f1', 'item_id', ['the Red cup', 'a LEFT chair', 'third dog', 'red and red car', 'left hand', 'the plain box', 'blue front door'])}
  || CASE WHEN item_id % 2 = 0 THEN ' at the top' ELSE '' END AS t, CASE WHEN item_id % 3 = 0 THEN 'some blue thing' ELSE 'a thing' END AS cap FROM items"""


@query("rule_word_flip", with_tables("items", "WITH x AS (" + FLIPS + """),
o AS (SELECT item_id, t, h[['flip:' || item_id]] AS r, list_filter(['red', 'left', 'third', 'blue', 'front', 'top'], lambda w: len(list_filter(string_split(lower(t), ' '), lambda v: v = w)) = 1
   AND NOT (w = 'red' AND (cap LIKE '%blue%' OR t LIKE '%blue%'))) AS ws FROM x),
p AS (SELECT *, list_sort(list_transform(ws, lambda w: {'p': instr(lower(t), w), 'w': w})) AS s FROM o),
c AS (SELECT item_id, t, CASE WHEN len(s) > 0 AND t NOT LIKE 'left hand%' THEN s[1 + r % len(s)].w END AS w FROM p),
m AS (SELECT *, CASE w WHEN 'red' THEN 'blue' WHEN 'left' THEN 'right' WHEN 'third' THEN 'second' WHEN 'blue' THEN 'red' WHEN 'front' THEN 'back' WHEN 'top' THEN 'bottom' END AS n FROM c)
SELECT item_id, CASE WHEN w = 'red' AND t LIKE '%Red%' THEN replace(t, 'Red', 'Blue') WHEN w = 'left' AND t LIKE '%LEFT%' THEN replace(t, 'LEFT', 'RIGHT') ELSE replace(t, w, n) END AS text,
  w AS old_word, n AS new_word, CASE WHEN w IN ('red', 'blue') THEN 'colour' WHEN w = 'left' THEN 'left/right' WHEN w = 'third' THEN 'ordinal' WHEN w = 'front' THEN 'depth' WHEN w = 'top' THEN 'vertical' END AS kind FROM m"""))
def rule_word_flip(t):
    x = t.sql(FLIPS).select("item_id", T.word_flip(col("t"), F.array("cap", "t"), "flip", col("item_id")).alias("f"))
    return x.select("item_id", "f.text", col("f.from").alias("old_word"), col("f.to").alias("new_word"), "f.kind")


STOP_LIST = "[" + ", ".join(q(w) for w in T.PARAPHRASE_STOP) + "]"


def _duck_words(x: str, stop: str = STOP_LIST) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+', 0), lambda w: NOT list_contains({stop}, w)))"


@query("paraphrase_pairs", with_tables("", f"""
WITH x AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
w AS (SELECT conv_id, turn, {_duck_words('text')} AS a, {_duck_words('coalesce(nxt, text)')} AS b FROM x)
SELECT conv_id, turn, len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) >= 0.5 AS paraphrase FROM w"""))
def paraphrase_pairs(t):
    from pyspark.sql import Window

    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    x = t.conversations.select("conv_id", "turn", "text", F.coalesce(nxt, col("text")).alias("b"))
    return x.select("conv_id", "turn", T.paraphrase(col("text"), col("b")).alias("paraphrase"))


@query("ordinal_wording", with_tables("", "WITH x AS (" + TEXTS + ") SELECT id, regexp_matches(lower(text), " + q("|".join(T.ORDINAL_WORDS)) + ") AS ordinal FROM x"))
def ordinal_wording(t):
    return t.sql(TEXTS).select("id", T.ordinal_wording(col("text")).alias("ordinal"))


PROMPTS = """
SELECT item_id, '# note' || chr(10) || '# status: VERIFIED' || chr(10) || '# source: item ' || item_id || chr(10) || '#   second line' || chr(10) || chr(10) || 'Find {expr} in {{json}}.' || chr(10) || '# kept' || chr(10)
  || text || chr(10) AS p, text AS e FROM benchmark"""


@query("render_prompt", with_tables("", "WITH x AS (" + PROMPTS + r""")
SELECT item_id, 'VERIFIED' AS status, 'item ' || item_id || ' second line' AS source, regexp_replace('Find ' || e || ' in {json}.' || chr(10) || '# kept' || chr(10) || e, '^\s+|\s+$', '', 'g') AS rendered,
  sha256(p) AS version FROM x"""))
def render_prompt(t):
    x = t.sql(PROMPTS).select("item_id", "e", T.prompt_parts(col("p")).alias("p"))
    return x.select("item_id", F.element_at("p.meta", "status").alias("status"), F.element_at("p.meta", "source").alias("source"),
                    T.render_prompt(col("p.body"), {"expr": col("e")}).alias("rendered"), "p.version")


SQL_REL = "[CAST(x0 AS INT), CAST(round_even(y0 * 1000 / 800, 0) AS INT), CAST(x1 AS INT), CAST(round_even(y1 * 1000 / 800, 0) AS INT)]"


@query("render_label_text", with_tables("verdicts", """
WITH ranked AS (SELECT *, '[' || array_to_string(""" + SQL_REL + """, ', ') || ']' AS rel, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN iid = 1 THEN 0 ELSE 1 END, (x1 - x0) * (y1 - y0) DESC, iid) AS rk FROM cand),
vc AS (SELECT image_id, iid, count(*) FILTER (verdict = 'no') AS n_no, string_agg(clause || ': ' || verdict || CASE WHEN verdict = 'no' THEN ' (seen: it is blue, not red)' ELSE '' END, '; ' ORDER BY clause) AS cells FROM verdicts GROUP BY 1, 2),
sc AS (SELECT r.image_id, r.iid, rel, n_no, cells, row_number() OVER (PARTITION BY r.image_id ORDER BY r.iid) AS pos FROM ranked r JOIN vc USING (image_id, iid) WHERE rk <= 6),
tx AS (SELECT image_id, '<conditions>' || chr(10) || '1. is red' || chr(10) || '2. has a handle' || chr(10) || '3. is left of it' || chr(10) || '4. reads 7' || chr(10) || '5. is open' || chr(10) || '</conditions>' || chr(10) || '<candidates>' || chr(10)
  || string_agg('<object id="' || pos || '" bbox="' || rel || '">' || cells || CASE WHEN n_no = 0 THEN ' -> fits' ELSE ' -> excluded' END || '</object>', chr(10) ORDER BY pos)
  || chr(10) || '</candidates>' || chr(10) || '<answer>{"bbox_2d": ' || coalesce(max(CASE WHEN iid = 1 AND n_no = 0 THEN rel END), 'null') || '}</answer>' AS text
FROM sc GROUP BY image_id), au AS (SELECT image_id, '<audit>' || chr(10) || '1. is red | seen: ' || CASE WHEN image_id % 3 = 0 THEN 'is red' ELSE 'is blue' END || ' | ' || CASE image_id % 3 WHEN 0 THEN 'match' ELSE 'mismatch' END || chr(10)
  || '2. has a lid | seen: has a lid | ' || CASE image_id % 2 WHEN 0 THEN 'match' ELSE 'unsure' END || chr(10) || '</audit>' || chr(10) || '<verdict>' || CASE WHEN image_id % 3 = 0 THEN 'fits' ELSE 'mismatch on 1: is blue, not is red' END || '</verdict>' AS audit,
  '```json' || chr(10) || CASE WHEN image_id % 5 = 0 THEN '{"bbox_2d": null}' ELSE '{"bbox_2d": [' || image_id % 900 || ', 10, 950, 20]}' END || chr(10) || '```' AS target FROM (SELECT DISTINCT image_id FROM sc) z)
SELECT image_id, text, audit, target FROM tx JOIN au USING (image_id)"""))
def render_label_text(t):
    d = scene_traces(t, "obs").select("image_id", "text")
    i = col("image_id")
    words = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    audit = T.render_audit(words("is red", "has a lid"), words(F.when(i % 3 == 0, "yes").otherwise("no"), F.when(i % 2 == 0, "yes").otherwise("no")), words(F.when(i % 3 > 0, "is blue"), F.lit(None).cast("string")))
    rel = F.when(i % 5 > 0, F.array((i % 900).cast("int"), F.lit(10), F.lit(950), F.lit(20)))
    return d.select("image_id", "text", audit.alias("audit"), T.target_text(rel).alias("target"))


@query("clean_reason", with_tables("", r"""
WITH x AS (SELECT doc_id, trim(regexp_replace(text, '[;\n<>]', ',', 'g'), ' .,') AS s FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(s, '\s+'), lambda v: v <> '') AS ws FROM x)
SELECT doc_id, CASE WHEN len(ws) > 0 THEN array_to_string(ws[1:12], ' ') END AS reason FROM w"""))
def clean_reason(t):
    return t.documents.select("doc_id", T.clean_reason(col("text")).alias("reason"))


@query("replace_between_markers", with_tables("", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || '<tool_call>{"name": "image_zoom_in", "arguments": {"boxes": [[1, 2, ' || doc_id || ', 4]]}}</tool_call>'
  ELSE text || '<tool_call>{"name": "image_zoom_in", "arguments": {"boxes": [[1, 2, ' || doc_id || ', 4]]}}</tool_call>' || ' tail $1' END AS text,
  CASE WHEN doc_id > 1 AND doc_id <= 1000 THEN 1 ELSE 0 END AS n_boxes FROM documents"""))
def replace_between_markers(t):
    old = F.when(col("doc_id") % 3 == 0, col("text")).otherwise(F.concat("text", F.lit("<tool_call>old [9, 9]</tool_call> tail $1")))
    boxes = F.concat(F.lit("[[1, 2, "), col("doc_id").cast("string"), F.lit(", 4]]"))
    x = t.documents.select("doc_id", T.replace_tool_call(old, boxes).alias("text"))
    return x.withColumn("n_boxes", F.size(T.tool_boxes(col("text"), F.lit(1000), F.lit(800))))
