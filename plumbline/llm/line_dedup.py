"""Lines repeated across documents, with built-in expressions only.

Lines are exploded with their position and hashed by their normalised key; a line found in at least
``min_docs`` documents is dropped everywhere but in the last of them. Positions to drop are gathered per
document and the text is put together again from the slices between them.

A line may be in a large part of all documents. Counting is combined before the shuffle, and the join back to
the lines treats such lines apart: at most ``HOT_PARTS`` lines can hold more than one ``HOT_PARTS``-th of all
rows each, so their list is small by construction and is broadcast; the others have few rows per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACES, key_id, lower_ascii, whole, written

MIN_CHARS = 40
MIN_DOCS = 5
#: Bound of the list of hot lines.
HOT_PARTS = 2000


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` with the text cleaned, and ``n_lines``, ``n_dropped`` (replaced where ``docs``
    has columns of these names).

    A missing or empty text is one empty line and stays empty. Rows with the same id count as one document
    that holds the lines of all of them; a missing id counts as the smallest. A document that holds a line more
    than once loses or keeps all of its copies. An empty table gives an empty result."""
    body = whole(text)
    src = docs.select(key_id(doc_id).alias("id"), F.xxhash64(body).alias("version"), F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))
    key = lower_ascii(F.btrim("line", F.lit(SPACES)))
    lines = src.select("id", "version", "pos", key.alias("key")).where(F.length("key") >= min_chars).select("id", "version", "pos", F.unhex(F.md5("key")).alias("h"))
    lines = written(lines, "lines")
    counts = lines.groupBy("h").agg(F.countDistinct("id").alias("docs"), F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where(F.col("docs") >= min_docs)
    counts = written(counts, "line-counts")
    hot_from = lines.count() / HOT_PARTS  # from the footers of the table just written
    hot = counts.where(F.col("n") > hot_from).select("h", F.col("keeper").alias("hot_keeper"))
    cold = counts.where(F.col("n") <= hot_from).select("h", "keeper")

    marked = lines.join(F.broadcast(hot), "h", "left")
    from_hot = marked.where(F.col("hot_keeper") != F.col("id")).select("id", "version", "pos")
    from_cold = marked.where(F.col("hot_keeper").isNull()).join(cold, "h").where(F.col("keeper") != F.col("id")).select("id", "version", "pos")
    drops = from_hot.unionByName(from_cold).groupBy("id", "version").agg(F.array_sort(F.collect_set("pos")).alias("drops"))

    keyed = docs.withColumns({"__id": key_id(doc_id), "__version": F.xxhash64(body)})
    joined = keyed.join(drops.select(F.col("id").alias("__id"), F.col("version").alias("__version"), F.col("drops").alias("__drops")), ["__id", "__version"], "left")
    parts = joined.withColumn("__lines", F.split(body, "\n", -1)).withColumn("__drops", F.coalesce("__drops", F.array().cast("array<int>")))
    # Slices of kept lines: from after one dropped position to before the next.
    kept = F.expr("""flatten(transform(sequence(0, size(__drops)), j ->
        slice(__lines, if(j = 0, 1, element_at(__drops, greatest(j, 1)) + 2),
              if(j = size(__drops), size(__lines), element_at(__drops, least(j + 1, size(__drops))))
              - if(j = 0, 0, element_at(__drops, greatest(j, 1)) + 1))))""")
    body_out = F.when(F.size("__drops") == 0, body).otherwise(F.array_join(kept, "\n"))
    out = parts.withColumns({text: body_out, "n_lines": F.size("__lines").cast("long"), "n_dropped": F.size("__drops").cast("long")})
    return out.drop("__id", "__version", "__lines", "__drops")
