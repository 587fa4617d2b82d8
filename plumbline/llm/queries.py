"""The registered queries of this package and the SQL that some of them can be checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import decontamination
from plumbline.llm import exact_dedup as exact
from plumbline.llm import jaccard_join as jaccard
from plumbline.llm import language_model as lm
from plumbline.llm import line_dedup as lines
from plumbline.llm import mixing
from plumbline.llm import privacy, quality
from plumbline.llm import sentence_pieces as pieces
from plumbline.llm import spelling_variants as spelling
from plumbline.llm import substring_dedup as substrings
from plumbline.llm import toxicity
from plumbline.llm import vector_codes as codes
from plumbline.llm.common import in_fold, table
from plumbline.session import broadcast_if_small

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_line_dedup", r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op3_substring_dedup", r"""
WITH w AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos, len(t) AS n
           FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS t FROM documents)),
g AS (SELECT doc_id, pos, n, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)) AS h FROM w),
m AS (SELECT h, min(doc_id) AS least FROM g WHERE pos <= n - 12 GROUP BY h),
r AS (SELECT g.doc_id, g.pos FROM g JOIN m USING (h) WHERE g.pos <= g.n - 12 AND m.least < g.doc_id),
c AS (SELECT w.doc_id, w.pos, w.word, r.pos IS NOT NULL AS hit FROM w LEFT JOIN r USING (doc_id, pos)),
k AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM c),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s USING (doc_id)""")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", in_fold("doc_id", toxicity.LEARN_FOLDS).alias("held_out"), "score", "predicted", "passages", "passage_start", "passage_end")


#: A page's address: host, the path before its last numeric part, and that part: the number of the document it shows.
_PAGE = r"^(?i:[a-z][a-z0-9+.-]*)://([^/?#]+)(?:/+((?:[^?#]*[^/?#])?))??/+([0-9]{1,18})(?:\.[^/?#]*)?(?:/(?![^?#]*(?<=/)[0-9]{1,18}(?:[./?#]|$))[^?#]*)?(?:[?#]|$)"


def places_of_pages(pages: DataFrame) -> DataFrame:
    """``doc_id``, ``site`` and ``path`` of the pages whose address has a document number."""
    part = lambda i: F.regexp_extract("url", _PAGE, i)
    return pages.select(part(3).try_cast("long").alias("doc_id"), part(1).alias("site"), part(2).alias("path")).where(F.col("doc_id").isNotNull())


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pages = places_of_pages(table(spark, sf_dir, "pages"))
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    # Documents that no page shows come from their source.
    by_source = docs.select("doc_id", F.concat(F.lit("~"), F.coalesce("source", F.lit(""))).alias("site"), F.coalesce("lang", F.lit("")).alias("path"))
    by_source = by_source.join(broadcast_if_small(pages.select("doc_id").distinct()), "doc_id", "left_anti")
    out = quality.quality_scores(docs, pages.unionByName(by_source), model)
    return out.select("doc_id", in_fold("doc_id", quality.FOLDS).alias("held_out"), "site", "path", "evidence", "site_rate", "path_rate", "score", "kept")


@query("op6_jaccard_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
        ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)""")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query("op7_mixing", mixing.ORACLE)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_by_document(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


@query("op8_exact_dedup", """
WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(g.t) AS text_sha256 FROM documents JOIN g ON coalesce(text, '') = g.t""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


@query("op9_lm_scoring")
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("op11_spelling_variants", r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS crc),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS k, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (SELECT run, n, xor(list_reduce(flatten(list_transform(string_split(k, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x)::BIGINT // 64, 128 + unicode(x)::BIGINT % 64] END)),
      lambda c, b: xor(c // 256, crc[xor(c, b) % 256 + 1]), 4294967295), 4294967295) AS h FROM g, t),
o AS (SELECT CASE WHEN h % 199 = 0 THEN run[:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
c AS (SELECT word, n, p, word[:p - 1] AS a, word[p + 1:] AS b FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS p)),
e AS (SELECT x.word, y.word AS near, y.n AS near_n FROM c x JOIN c y USING (p, a, b) WHERE x.word <> y.word
      UNION SELECT x.word, y.word, y.n FROM c x JOIN w y ON x.a || x.b = y.word
      UNION SELECT y.word, x.word, x.n FROM c x JOIN w y ON x.a || x.b = y.word),
f AS (SELECT w.word, any_value(w.n) AS n, count(e.near) AS n_near, min((-e.near_n, e.near)) FILTER (e.near_n >= 5 * w.n) AS best FROM w LEFT JOIN e USING (word) GROUP BY w.word),
l AS (SELECT word, n, n_near, best[2] AS form, -best[1] AS form_n FROM f),
z AS (SELECT word, word AS root FROM l UNION SELECT z.word, l.form FROM z JOIN l ON z.root = l.word WHERE l.form IS NOT NULL)
SELECT l.word, l.form, z.root, l.n, l.n_near, l.form_n FROM l JOIN z USING (word) WHERE z.root NOT IN (SELECT word FROM l WHERE form IS NOT NULL)""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op12_vector_codes", codes.oracle())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


@query("op13_sentence_pieces")
def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    out = pieces.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces.read_model(path("piece_bpe_32k.model")))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
