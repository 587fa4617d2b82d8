"""Checks of tables against their declared schema and rules.

Each check is a DataFrame of problems (column, detail, n), so a run over any number of rows is
one aggregation; ``require`` turns a non-empty result into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import scratch_path
from pyspark.sql import types as T

from plumbline.functions.hashing import hash64_halves

PROBLEM = "column string, detail string, n bigint"


class ConstraintError(ValueError):
    """A table breaks its declared schema or rules."""


def check_fields(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Missing, mistyped, undeclared columns (from the plan) and nulls in required ones (one
    aggregation), all reported together."""
    have = {f.name: f.dataType for f in df.schema}
    static = []
    for f in schema:
        if f.name not in have:
            static.append((f.name, "column missing", 0))
        elif have[f.name].simpleString() != f.dataType.simpleString():
            static.append((f.name, f"type {have[f.name].simpleString()} is not {f.dataType.simpleString()}", 0))
    extra = sorted(set(have) - {f.name for f in schema})
    static += [(c, "column not declared", 0) for c in extra]
    out = df.sparkSession.createDataFrame(static, PROBLEM)
    need = [f.name for f in schema if not f.nullable and f.name in have]
    if need:
        counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in need])
        nulls = counts.unpivot([], need, "column", "n").filter("n > 0")
        out = out.unionByName(nulls.select("column", F.lit("nulls in a required column").alias("detail"), "n"))
    return out


def check_enums(df: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """(column, value, n) of values outside the allowed lists, in one pass over the table."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.when(~F.col(c).isin(*v), F.col(c)).alias("value")) for c, v in allowed.items() if c in df.columns])
    return df.select(F.explode(entries).alias("e")).select("e.*").filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))


def count_violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, n, first_key): rows that break each rule and the smallest offending key. A rule
    that evaluates to null counts as broken."""
    aggs = []
    for name, ok in rules.items():
        bad = ~F.coalesce(ok, F.lit(False))
        aggs += [F.count(F.when(bad, 1)).alias(f"n_{name}"), F.min(F.when(bad, F.col(key))).alias(f"k_{name}")]
    stack = ", ".join(f"'{n}', n_{n}, k_{n}" for n in rules)
    return df.agg(*aggs).select(F.expr(f"stack({len(rules)}, {stack}) AS (rule, n, first_key)")).filter("n > 0")


def item_rules() -> dict[str, Column]:
    boxes = F.coalesce("gt_boxes_xyxy_px", F.array().cast("array<array<double>>"))
    return {"n_gt": F.col("n_gt") == F.size(boxes), "box_numbers": F.forall(boxes, lambda b: F.size(b) == 4),
            "phash_hex": F.lower("image_phash").rlike("^[0-9a-f]{16}$"), "sha_length": F.length("image_sha256") == 64}


def output_rules() -> dict[str, Column]:
    c = F.col
    other = c("condition") != "ORIGINAL"
    px = c("image_px_sent")
    return {"px_sent": (F.size(px) == 2) & F.forall(px, lambda v: F.coalesce(v > 0, F.lit(False))),
            "iou_original_only": ~(other & c("iou_gt").isNotNull()), "point_original_only": ~(other & c("point_in_gt").isNotNull()),
            "failure_original_only": ~(other & c("is_failure").isNotNull()), "box_numbers": c("box_xyxy_px").isNull() | (F.size("box_xyxy_px") == 4),
            "point_numbers": c("point_xy_px").isNull() | (F.size("point_xy_px") == 2), "box_present": ~((c("output_type") == "box") & c("box_xyxy_px").isNull()),
            "point_present": ~((c("output_type") == "point") & c("point_xy_px").isNull())}


def require(problems: DataFrame, what: str) -> None:
    """Raise when there are problems: all of them go to a table in the shared folder, whose path and number of
    rows the error gives with the first few."""
    first = problems.take(20)
    if first:
        path = scratch_path(problems.sparkSession, "problems")
        problems.write.json(path)
        n = problems.sparkSession.read.text(path).count()
        raise ConstraintError(f"{what}: {n} problems, listed in {path}: " + "; ".join(str(r.asDict()) for r in first))


def passes(df: DataFrame, schema: T.StructType, allowed: dict[str, tuple[str, ...]], rules: dict[str, Column]) -> bool:
    """Whether a table has no problem of any kind: its fields from the plan, all rows in one count."""
    if {f.name: f.dataType.simpleString() for f in df.schema} != {f.name: f.dataType.simpleString() for f in schema} or len(df.columns) != len(schema):
        return False
    good = [F.col(f.name).isNotNull() for f in schema if not f.nullable]
    good += [F.coalesce(F.col(c).isin(*v), F.lit(True)) for c, v in allowed.items() if c in df.columns]
    good += [F.coalesce(ok, F.lit(False)) for ok in rules.values()]
    every = F.lit(True)
    for ok in good:
        every = every & ok
    return df.agg(F.count(F.when(~every, 1))).first()[0] == 0


def validate(df: DataFrame, kind: str) -> DataFrame:
    """The table itself when it passes fields, enumerations and row rules; otherwise an error. A table is read once to
    see whether it passes, and again, check by check, only to name what does not."""
    from plumbline.sources import schemas as S

    rules = item_rules() if kind == "items" else output_rules()
    if not passes(df, S.SCHEMAS[kind], S.ENUMS[kind], rules):
        require(check_fields(df, S.SCHEMAS[kind]), f"{kind} schema")
        require(check_enums(df, S.ENUMS[kind]), f"{kind} values")
        require(count_violations(df, "item_id", rules), f"{kind} rows")
    return df


# ---- near duplicates ------------------------------------------------------------------------


def hamming(a: Column, b: Column) -> Column:
    """Bit distance of two 16-digit hex hashes."""
    (a1, a2), (b1, b2) = hash64_halves(a), hash64_halves(b)
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def _bands(h: Column, n: int) -> Column:
    """The 64 bits in n bands: array<struct<band, bits>>."""
    hi, lo = hash64_halves(h)
    bits = F.concat(F.lpad(F.bin(hi), 32, "0"), F.lpad(F.bin(lo), 32, "0"))
    edges = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("band"), F.substring(bits, edges[i] + 1, edges[i + 1] - edges[i]).alias("bits")) for i in range(n)])


def near_duplicates(left: DataFrame, right: DataFrame, key: str, phash: str, distance: int = 4) -> DataFrame:
    """(left key, right key, d) of hashes within a bit distance, each pair once.

    Pigeonhole: at most ``distance`` differing bits leave one of distance + 1 bands equal, so
    an equi-join on (band, bits) finds every pair. Equal hashes are collapsed first and
    expanded last, so thousands of copies of one image meet as one row, and a pair is kept only
    in its first equal band."""
    lg = left.groupBy(F.col(phash).alias("a")).agg(F.count("*").alias("_n"))
    rg = right.groupBy(F.col(phash).alias("b")).agg(F.count("*").alias("_n"))
    n = distance + 1
    la = lg.select("a", F.explode(_bands(F.col("a"), n)).alias("x")).select("a", "x.band", "x.bits")
    rb = rg.select("b", F.explode(_bands(F.col("b"), n)).alias("x")).select("b", "x.band", "x.bits")
    ab, bb = _bands(F.col("a"), n), _bands(F.col("b"), n)
    first_equal = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(ab, i)["bits"] == F.get(bb, i)["bits"]), True) - 1
    pairs = (la.join(rb, ["band", "bits"]).withColumn("d", hamming(F.col("a"), F.col("b")))
             .filter((F.col("d") <= distance) & (F.col("band") == first_equal)).select("a", "b", "d"))
    l2 = left.select(F.col(key).alias(f"left_{key}"), F.col(phash).alias("a"))
    r2 = right.select(F.col(key).alias(f"right_{key}"), F.col(phash).alias("b"))
    return pairs.join(l2, "a").join(r2, "b").select(f"left_{key}", f"right_{key}", "d")


def disjoint_violations(dev: DataFrame, evaluation: DataFrame, key: str, phash: str, distance: int = 4) -> DataFrame:
    """Dev rows that have a near duplicate among the evaluation rows: (key, n_hashes, min_d).

    Counting per distinct hash keeps the result one row per dev row even when both sides hold
    a great many copies of one image."""
    e = evaluation.select(phash).distinct().withColumn(key, F.lit(0))
    hashes = near_duplicates(dev.select(phash).distinct().withColumn(key, F.col(phash)), e.withColumn(key, F.col(phash)), key, phash, distance)
    per = hashes.groupBy(F.col(f"left_{key}").alias(phash)).agg(F.count("*").alias("n_hashes"), F.min("d").alias("min_d"))
    return dev.select(key, phash).join(per, phash).select(key, "n_hashes", "min_d")


# ---- ledgers and snapshots ------------------------------------------------------------------


def compare_ledger(ledger: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status) of files that changed, vanished or appeared since the ledger was written."""
    j = ledger.select(key, F.col(digest).alias("_a")).join(current.select(key, F.col(digest).alias("_b")), key, "full_outer")
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "added").when(F.col("_a") != F.col("_b"), "changed")
    return j.select(key, status.alias("status")).filter("status IS NOT NULL")


def snapshot_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status) of added, removed and changed keys; null-safe."""
    x, y = a.select(key, F.col(value).alias("_a"), F.lit(1).alias("_in_a")), b.select(key, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    j = x.join(y, key, "full_outer")
    status = F.when(F.col("_in_b").isNull(), "removed").when(F.col("_in_a").isNull(), "added").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return j.select(key, status.alias("status")).filter("status IS NOT NULL")


def set_digest(df: DataFrame, key: str, value: str) -> DataFrame:
    """Order-independent digest of a keyed set: number of rows and the sums of the eight 32-bit parts of each
    row's sha-256, digested once more. Sums combine before the shuffle; nothing is collected."""
    line = F.concat_ws("=", F.col(key).cast("string"), F.coalesce(F.col(value).cast("string"), F.lit("\u0000")))
    d = df.select(F.sha2(line, 256).alias("_h"))
    parts = [F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"_s{i}") for i in range(8)]
    sums = d.agg(F.count("*").cast("string").alias("_n"), *parts)
    return sums.select(F.sha2(F.concat_ws("|", "_n", *[F.coalesce(f"_s{i}", F.lit("0")) for i in range(8)]), 256).alias("digest"))


def inadmissible_runs(table: DataFrame, runs: DataFrame, run: str, flag: str) -> DataFrame:
    """(run, n): rows of an evaluation table that come from runs flagged as not for evaluation."""
    return table.join(runs.filter(F.col(flag)).select(run), run, "left_semi").groupBy(run).agg(F.count("*").alias("n"))


def request_budget(tokens: DataFrame, visual: str, pixels: Column, prompt: int, max_len: int, cap: int) -> DataFrame:
    """Counts over limits, the largest request, exact percentiles and whether any is refused."""
    from plumbline.operators.ranks import exact_quantiles

    q = exact_quantiles(tokens, [], F.col(visual), {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    total = F.col(visual) + prompt
    a = tokens.agg(F.max(visual).alias("max_tokens"), F.count(F.when(total > max_len, 1)).alias("n_over_context"), F.count(F.when(pixels > cap, 1)).alias("n_over_cap"))
    return a.join(F.broadcast(q)).withColumn("refused", F.col("n_over_context") > 0)


def drop_reasons(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``drop_reason``: the first reason that holds, null for rows that stay."""
    out = None
    for name, cond in reasons:
        cond = F.coalesce(cond, F.lit(False))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return df.withColumn("drop_reason", out)


def reason_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
