"""Mixing sources to target weights, with built-in expressions only.

Texts are cut into blocks of words. Every source takes whole passes over its blocks and, for what is left of its
target, permuted blocks up to the exact word. How many of a source's blocks go to which output shard is drawn by
a splitting tree: the root holds the block counts of all sources, each node passes a multivariate hypergeometric
draw of its counts to its left half and the rest to its right half, so that all row and column sums are exact.
Then each source deals its permuted blocks, one disjoint run per shard, and every shard orders its blocks by hash.

Orders over a whole source never meet in one task: a hash cuts them into ``BUCKETS`` ranges whose totals are
summed first, and only the ranges themselves are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, whole, written
from plumbline.session import broadcast_if_small

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 512
SHARD_WORDS = 1 << 22
BUCKETS = 4096
SEED = "mix"


def sized(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``row_id``, ``doc_id``, ``source`` and ``size`` in words of every row, written to the shared folder."""
    words = F.regexp_count(whole(text), F.lit(WORD)).cast("long")
    return written(docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), words.alias("size")), "sized")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: number in order, ``total`` size and ``target``. Sources share the total by weight;
    none goes above ``max_epochs`` times its size, and what that leaves is shared again. The common level of
    target per weight is the largest of the levels that come out when the k most limited sources are capped."""
    s = rows.groupBy("source").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("docs"))
    s = s.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") - 1) % len(weights) + 1))
    s = s.withColumn("cap", F.col("total") * max_epochs)
    by_limit = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    everything = Window.partitionBy()
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("all", F.sum("total").over(everything)).withColumn("step", (F.col("all") - F.col("before")) / F.col("open"))
    s = s.withColumn("level", F.max("step").over(everything))
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
    s = s.withColumn("want", F.round("target").cast("long"))
    s = s.withColumn("full", F.when(F.col("total") > 0, F.expr("want div total")).otherwise(F.lit(0)).cast("int"))
    s = s.withColumn("rest", F.col("want") - F.col("full") * F.col("total"))
    return s.select("source", "source_no", "total", "target", "full", "rest")


def _hash60(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def _bucket(c: Column) -> Column:
    return F.shiftright(c, 48).cast("int")  # the top 12 of 60 bits: BUCKETS ranges


def _log_factorial(n: str) -> str:
    exact = f"ln(factorial(cast(least({n}, 20) as int)))"
    x = f"cast(greatest({n}, 21) as double)"
    return f"if({n} <= 20, {exact}, {x} * ln({x}) - {x} + 0.5 * ln(6.283185307179586 * {x}) + 1 / (12 * {x}) - 1 / (360 * {x} * {x} * {x}))"


def _drawn(k: str, n: str, m: str, seed: str) -> str:
    """SQL of a hypergeometric draw: how many of k marked blocks are among m drawn from n. The value with the
    largest log-probability plus Gumbel noise is an exact draw; values over 12 deviations off are left out."""
    p = f"(cast({k} as double) / greatest({n}, 1))"
    mean = f"({m} * {p})"
    sd = f"sqrt(greatest(0, {m} * {p} * (1 - {p}) * ({n} - {m}) / greatest({n} - 1, 1)))"
    low = f"greatest(0, {m} - ({n} - {k}), cast(floor({mean} - 12 * {sd} - 2) as bigint))"
    high = f"least({k}, {m}, cast(ceil({mean} + 12 * {sd} + 2) as bigint))"
    noise = f"(-ln(-ln((pmod(xxhash64({seed}, x), 1073741824) + 0.5) / 1073741824)))"
    terms = [_log_factorial(t) for t in ("x", f"({k} - x)", f"({m} - x)", f"({n} - {k} - {m} + x)")]
    return f"array_max(transform(sequence({low}, {high}), x -> named_struct('v', {noise} - ({' + '.join(terms)}), 'x', x))).x"


def quotas(counts: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """Splitting tree over one row per source (``source_no``, ``k`` blocks): rows ``shard``, ``source_no``,
    ``quota`` whose sums per source are the k and whose sums per shard are equal up to one block. A node is one
    row with one count per source; the levels are as many as the shards have binary digits."""
    node = counts.agg(F.array_sort(F.collect_list(F.struct("source_no", "k"))).alias("s")).select(
        F.lit(0).alias("lo"), F.lit(shards).alias("width"), F.expr("transform(s, e -> e.source_no)").alias("nos"), F.expr("transform(s, e -> cast(e.k as bigint))").alias("ks"))
    draw = _drawn("k", "acc.n", "acc.m", f"'{seed}', lo, width, size(acc.taken)")
    fold = f"""aggregate(ks, named_struct('taken', cast(array() as array<bigint>), 'n', total, 'm', share),
        (acc, k) -> element_at(transform(array({draw}), d -> named_struct('taken', concat(acc.taken, array(d)), 'n', acc.n - k, 'm', acc.m - d)), 1), acc -> acc.taken)"""
    for _ in range(max(shards - 1, 0).bit_length()):
        n = node.withColumn("total", F.expr("aggregate(ks, cast(0 as bigint), (a, k) -> a + k)"))
        n = n.withColumn("share", F.expr("total * (width div 2) div width")).withColumn("left", F.expr(fold))
        halves = F.expr("""if(width = 1, array(named_struct('lo', lo, 'width', width, 'ks', ks)), array(
            named_struct('lo', lo, 'width', cast(width div 2 as int), 'ks', left),
            named_struct('lo', cast(lo + width div 2 as int), 'width', cast(width - width div 2 as int), 'ks', zip_with(ks, left, (k, l) -> k - l))))""")
        node = n.select("nos", F.explode(halves).alias("h")).select("h.lo", "h.width", "nos", "h.ks")
    return node.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("nos", "ks")).alias("e")).select("shard", F.col("e.nos").alias("source_no"), F.col("e.ks").alias("quota"))


def takes(rows: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """The blocks that the mix takes: ``row_id``, ``doc_id``, ``source_no``, ``block``, ``epoch``, ``words``."""
    src = broadcast_if_small(sources.withColumnRenamed("source", "s"))
    b = rows.where("size > 0").join(src, F.col("source").eqNullSafe(F.col("s")))
    b = b.select("row_id", "doc_id", "source_no", "size", "full", "rest", F.explode(F.expr(f"sequence(0L, (size - 1) div {block_words})")).alias("block"))
    b = b.withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words))
    b = written(b.withColumn("key", _hash60(F.lit(seed), F.col("doc_id"), F.col("block"))).withColumn("bucket", _bucket(F.col("key"))), "blocks")

    per_bucket = b.where("rest > 0").groupBy("source_no", "bucket", "rest").agg(F.sum("words").alias("words"))
    run = F.sum("words").over(Window.partitionBy("source_no").orderBy("bucket"))
    edge = per_bucket.withColumn("before", run - F.col("words")).where("before < rest and rest <= before + words").select("source_no", F.col("bucket").alias("edge"), "before")
    part = b.where("rest > 0").join(broadcast_if_small(written(edge, "edges")), "source_no")
    below = part.where("bucket < edge").select("row_id", "doc_id", "source_no", "block", "full", "words")
    inside = part.where("bucket = edge")
    left = F.col("rest") - F.col("before") - (F.sum("words").over(Window.partitionBy("source_no", "bucket").orderBy("key", "doc_id", "block", "row_id")) - F.col("words"))
    inside = inside.withColumn("words", F.least(F.col("words"), left)).where("words > 0").select(*below.columns)
    last = below.unionByName(inside).withColumn("epoch", F.col("full") + 1).drop("full")
    whole_passes = b.where("full > 0").select("row_id", "doc_id", "source_no", "block", "words", F.explode(F.expr("sequence(1, full)")).alias("epoch"))
    return whole_passes.unionByName(last.select(*whole_passes.columns))


def mix(rows: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """``takes`` with the ``shard`` and ``place`` in the shard of every block."""
    taken = takes(rows, sources, block_words, seed)
    taken = written(taken.withColumn("deal", F.shiftright(F.xxhash64(F.lit(seed), "doc_id", "block", "epoch"), 4).bitwiseAND((1 << 60) - 1)).withColumn("bucket", _bucket(F.col("deal"))), "takes")
    words = taken.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    shards = max(1, -(-words // shard_words))

    counts = taken.groupBy("source_no", "bucket").agg(F.count(F.lit(1)).alias("n"))
    by_bucket = Window.partitionBy("source_no").orderBy("bucket")
    offsets = counts.withColumn("offset", F.sum("n").over(by_bucket) - F.col("n")).drop("n")
    per_source = counts.groupBy("source_no").agg(F.sum("n").alias("k"))
    dealt = quotas(per_source, shards, seed).withColumn("upto", F.sum("quota").over(Window.partitionBy("source_no").orderBy("shard")))
    dealt = dealt.withColumn("from", F.col("upto") - F.col("quota")).where("quota > 0").withColumn("width", F.expr(f"greatest(1L, max(upto) over (partition by source_no) div {shards})"))
    # Each shard's run of ranks, listed under the bins of equal width that it meets.
    bins = dealt.select("source_no", "shard", "from", "upto", "width", F.explode(F.expr("sequence(from div width, (upto - 1) div width)")).alias("bin"))
    widths = bins.select("source_no", "width").distinct()

    ranked = taken.join(offsets, ["source_no", "bucket"])
    rank = F.col("offset") + F.row_number().over(Window.partitionBy("source_no", "bucket").orderBy("deal", "doc_id", "block", "epoch", "row_id")) - 1
    ranked = ranked.withColumn("rank", rank).join(broadcast_if_small(written(widths, "widths")), "source_no").withColumn("bin", F.expr("rank div width")).drop("width")
    placed = ranked.join(bins, ["source_no", "bin"]).where((F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("upto")))
    order = Window.partitionBy("shard").orderBy(F.xxhash64("deal", "row_id"), "row_id", "block", "epoch")
    return placed.select("shard", F.row_number().over(order).alias("place"), "row_id", "doc_id", "source_no", "block", "epoch", "words")


def taken_by_document(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size``, ``source_size``, ``target`` and ``taken``, the words that
    the mix takes from it.

    A missing text has no words and is never taken; a missing source is a source of its own, the last one; a
    missing id is kept as it is. Rows repeated with the same id are rows of their own. Sources without words
    have target 0. An empty table gives an empty result; other columns are left out."""
    rows = sized(docs)
    sources = written(targets(rows), "targets")
    by_row = mix(rows, sources, block_words, shard_words, seed).groupBy("row_id").agg(F.sum("words").alias("taken"))
    src = broadcast_if_small(sources.select(F.col("source").alias("s"), F.col("total").alias("source_size"), "target"))
    out = rows.join(src, F.col("source").eqNullSafe(F.col("s")), "left").join(by_row, "row_id", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM s),
w AS (SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, total * 3 AS cap FROM r),
f AS (SELECT *, (sum(total) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(weight) OVER (ORDER BY cap / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS step FROM w),
g AS (SELECT *, least(cap::DOUBLE, weight * max(step) OVER ()) AS target FROM f),
h AS (SELECT *, round(target)::BIGINT AS want FROM g),
t AS (SELECT *, CASE WHEN total > 0 THEN want // total ELSE 0 END AS whole, want - CASE WHEN total > 0 THEN want // total ELSE 0 END * total AS rest FROM h),
b AS (SELECT d.doc_id, t.no, t.rest, unnest(range(0, (size + 511) // 512)) AS block, d.size FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE size > 0),
k AS (SELECT *, least(512, size - block * 512) AS words, ('0x' || substr(md5('mix:' || doc_id || ':' || block), 1, 15))::BIGINT AS key FROM b),
c AS (SELECT *, sum(words) OVER (PARTITION BY no ORDER BY key, doc_id, block ROWS UNBOUNDED PRECEDING) - words AS before FROM k),
p AS (SELECT doc_id, sum(greatest(0, least(words, rest - before)))::BIGINT AS part FROM c GROUP BY doc_id)
SELECT d.doc_id, d.size, t.total AS source_size, t.target, (t.whole * d.size + coalesce(p.part, 0))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN p USING (doc_id)"""
