"""Training and evaluation sets built from long label tables (item, candidate, clause, verdict)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import md5
from itertools import combinations
from math import comb
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators.ranks import exact_quantiles

#: Sets of clauses of a scene that are looked at before any is drawn.
SETS = 256
USD_PROMPT_NANO, USD_OUTPUT_NANO = 1250, 10000  # fixed values: price of one token in 1e-9 USD


def rationale_stats(df: DataFrame, inst: str, label: str, blind: str, reason: str) -> DataFrame:
    """Per label: cells, agreement of the blind verdict, kept reasons, reuse of one reason
    within an instance, word-count percentiles of the kept reasons."""
    kept = F.col(label) == F.col(blind)
    words = F.size(F.filter(F.split(T.strip(F.col(reason)), r"\s+"), lambda w: w != ""))
    d = df.withColumn("_nr", F.lower(F.regexp_replace(reason, r"(?U)\W+", " "))).withColumn("_nw", words)
    g = d.groupBy(label).agg(F.count("*").alias("cells"), F.avg(kept.cast("int")).alias("agree"), F.count(F.when(kept, 1)).alias("kept"))
    # distinct by two-step aggregation, so a label with a third of the cells is still spread
    uniq = d.groupBy(label, inst, "_nr").agg(F.count("*").alias("_c")).groupBy(label).agg(F.sum(F.col("_c") - 1).alias("reused"))
    q = exact_quantiles(d.filter(kept), [label], F.col("_nw"), {"words_median": 0.5, "words_p90": 0.9}).drop("n")
    return g.join(uniq, label).join(q, label, "left")


def check_dump_stats(df: DataFrame, scene: str, iid: str, clause: str, verdict: str, target: Column, is_flip: Column) -> DataFrame:
    """Counts over details and falsifications of checked scenes, in two aggregation levels."""
    v = F.col(verdict)
    per = df.groupBy(scene, clause).agg(
        F.max(is_flip.cast("int")).alias("_f"), F.count(F.when(target, 1)).alias("_t"), F.count(F.when(target & (v == "no"), 1)).alias("_tn"),
        F.count(F.when(target & (v == "unclear"), 1)).alias("_tu"), F.count(F.when(target & (v == "yes"), 1)).alias("_ty"), F.bool_and(v == "no").alias("_all"))
    scenes = per.select(scene).distinct().agg(F.count("*").alias("scenes"))
    det, flip = F.col("_f") == 0, F.col("_f") == 1
    out = per.agg(F.sum(F.when(det, F.col("_t"))).alias("details"), F.sum(F.when(det, F.col("_tn"))).alias("target_detail_no"), F.sum(F.when(det, F.col("_tu"))).alias("target_detail_unclear"),
                  F.count(F.when(flip, 1)).alias("flips"), F.count(F.when(flip & F.col("_all"), 1)).alias("flip_no_on_all"), F.sum(F.when(flip, F.col("_ty"))).alias("flip_target_yes"))
    return scenes.join(F.broadcast(out))


def usage_cost(df: DataFrame, order: str, prompt: str, output: str, cap_usd: float) -> DataFrame:
    """Calls, tokens, cost, and the first call whose running cost passes the cap."""
    from plumbline.operators.ranks import running_totals

    cost = df.withColumn("_nano", F.col(prompt) * USD_PROMPT_NANO + F.col(output) * USD_OUTPUT_NANO)
    cum = running_totals(cost, [], order, ["_nano"])
    cap = int(round(cap_usd * 1e9))
    return cum.agg(F.count("*").alias("calls"), F.sum(prompt).alias("prompt_tokens"), F.sum(output).alias("output_tokens"), (F.sum("_nano") / 1e9).alias("usd"),
                   F.min(F.when(F.col("cum__nano") > cap, F.col(order))).alias("stop_at"))


# ---- label tables ---------------------------------------------------------------------------


def label_rows(cells: DataFrame, items: DataFrame, key: str = "item") -> DataFrame:
    """Long cells (item, iid, clause, verdict, flipped_verdict, area) with the rules of the item
    applied: on a negative the flipped clause takes its own verdict and is false of the
    described object; on a positive the answer row is true throughout; unknown is unclear."""
    c, words = F.col, ("yes", "no", "unclear")
    # all of an item's cells are one row of plain lists when they are shuffled; verdicts and missing values are one number
    said = lambda name: F.coalesce(F.array_position(F.array(*[F.lit(w) for w in words]), c(name)).cast("smallint"), F.lit(0))
    rest = [x for x in cells.columns if x not in (key, "verdict", "flipped_verdict")]
    kinds, code = dict(cells.dtypes), said("verdict") + 4 * said("flipped_verdict")
    for k, x in enumerate(rest):
        code = code + F.when(c(x).isNull(), 16 << k).otherwise(0)
    lists = [F.collect_list(F.coalesce(c(x), F.lit(0).cast(kinds[x]))).alias(x) for x in rest]
    packed = cells.dropna(subset=[key]).groupBy(key).agg(F.collect_list(code.cast("smallint" if len(rest) < 11 else "bigint")).alias("_c"), *lists)
    d = packed.join(items.select(key, "answer_iid", "first_iid", "flipped_idx"), key)
    d = d.select(key, "answer_iid", "first_iid", "flipped_idx", F.inline(F.arrays_zip("_c", *rest)))
    d = d.withColumns({x: F.when(c("_c").bitwiseAND(16 << k) == 0, c(x)) for k, x in enumerate(rest)} | {"_v": c("_c").bitwiseAND(3), "_f": F.shiftright("_c", 2).bitwiseAND(3)}).drop("_c")
    word = lambda name: F.when(c(name) == 1, "yes").when(c(name) == 2, "no").otherwise("unclear")
    is_flip = F.coalesce(c("clause") == c("flipped_idx"), F.lit(False))
    v = (F.when(c("answer_iid").isNotNull() & (c("iid") == c("answer_iid")), "yes").when(is_flip & (c("iid") == c("first_iid")), "no").when(is_flip, word("_f")).otherwise(word("_v")))
    return d.withColumn("verdict", v).drop("_v", "_f")


def label_matrix(cells: DataFrame, items: DataFrame, max_rows: int = T.MAX_CANDIDATES, key: str = "item") -> DataFrame:
    """(item, reason, n_rows, n_fit): can the labels carry a consistent trace? Rows beyond
    ``max_rows`` go, answer row first and largest next."""
    c = F.col
    rows = (label_rows(cells, items, key).groupBy(key, "iid", "answer_iid").agg(F.max("area").alias("area"), F.count(F.when(c("verdict") == "no", 1)).alias("n_no"),
                                                                             F.count(F.when(c("verdict") == "yes", 1)).alias("n_yes")))
    w = Window.partitionBy(key).orderBy(F.when(F.coalesce(c("iid") == c("answer_iid"), F.lit(False)), 0).otherwise(1), c("area").desc(), c("iid"))
    rows = rows.withColumn("_rn", F.row_number().over(w)).filter(c("_rn") <= max_rows)
    fit = c("n_no") == 0
    per = rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.count(F.when(fit, 1)).alias("n_fit"), F.max(F.when(fit, c("n_yes"))).alias("_top"),
                                F.max(F.when(fit & (c("iid") == c("answer_iid")), c("n_yes"))).alias("_ans"))
    ties = rows.join(per.select(key, "_top"), key).filter(fit & (c("n_yes") == c("_top"))).groupBy(key).agg(F.count("*").alias("_ties"))
    j = items.join(per, key, "left").join(ties, key, "left")
    positive = c("answer_iid").isNotNull()
    reason = (F.when(~positive & c("flipped_idx").isNull(), "no_flip").when(c("n_rows").isNull(), "no_clauses")
              .when(positive & ~F.coalesce((c("_ans") == c("_top")) & (c("_ties") == 1), F.lit(False)), "positive_not_unique").when(~positive & (c("n_fit") > 0), "negative_has_satisfier").otherwise("ok"))
    return j.select(key, reason.alias("reason"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_fit", F.lit(0)).alias("n_fit"))


def export_items(rec: DataFrame, review: DataFrame, key: str = "image_id") -> DataFrame:
    """Records with gates to positive / sibling / negative items under the reviewer's verdict
    (ok, flip, bad, unsure or none)."""
    c = F.col
    d = rec.join(review.select(key, "verdict"), key, "left")
    v = c("verdict")

    def differs(a, b):
        return F.lower(T.strip(F.coalesce(a, F.lit("")))) != F.lower(T.strip(F.coalesce(b, F.lit(""))))

    def yes(x):
        return F.coalesce(x, F.lit(False))

    auto = yes(c("writer_target_all_yes")) & (yes(c("listener_unique_hit")) | yes(c("base_correct_on_target")))
    live = v.isNull() | ~v.isin("bad", "unsure")
    pos = live & (yes(v == "ok") | ((v.isNull() | yes(v == "flip")) & auto)) & (F.coalesce(c("e_t"), F.lit("")) != "")
    sib = live & (F.coalesce(c("e_s"), F.lit("")) != "") & differs(c("e_s"), c("e_t")) & yes(c("sibling_unique_hit"))
    neg = live & (yes(v == "ok") | (v.isNull() & yes(c("negative_usable_sentence")))) & (F.coalesce(c("e_neg"), F.lit("")) != "") & differs(c("e_neg"), c("e_t"))
    none = F.lit(None).cast("int")
    out = F.array(F.when(pos, F.struct(F.lit("positive").alias("kind"), c("e_t").alias("expression"), c("target_iid").cast("int").alias("target"))),
                  F.when(sib, F.struct(F.lit("sibling_positive").alias("kind"), c("e_s").alias("expression"), c("sibling_iid").cast("int").alias("target"))),
                  F.when(neg, F.struct(F.lit("negative").alias("kind"), c("e_neg").alias("expression"), none.alias("target"))))
    return d.select(key, F.when(v.isNull(), "auto").otherwise("reviewed").alias("source"), F.explode(F.filter(out, lambda x: x.isNotNull())).alias("x")).select(key, "source", "x.*")


def second_chance(rec: DataFrame, forced: DataFrame, cells: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, reason, chosen): failed scenes with their reason and the first replacement nobody
    satisfies. ``cells`` holds per candidate value and instance: cand, iid, new_verdict,
    others_open (every other detail yes or unclear)."""
    c = F.col
    d = rec.join(forced.select(key).withColumn("_f", F.lit(True)), key, "left")
    reason = F.when(F.coalesce("_f", F.lit(False)) | ~F.coalesce("flip_identified", F.lit(False)), "flip_failed").when(~c("zero_satisfier_sentence"), "satisfied")
    todo = d.select(key, reason.alias("reason")).filter("reason IS NOT NULL")
    sat = cells.groupBy(key, "cand").agg(F.bool_or(c("new_verdict").isin("yes", "unclear") & c("others_open")).alias("_sat"))
    first = sat.filter(~c("_sat")).groupBy(key).agg(F.min("cand").alias("chosen"))
    return todo.join(first, key, "left")


def describe_jobs(cells: DataFrame, targets: DataFrame, scene: str, min_facts: int = 4) -> DataFrame:
    """(scene, iid, facts): one instance per scene of two or more, an original target first, that
    has enough confirmed clauses."""
    per = cells.groupBy(scene, "iid").agg(F.count(F.when(F.col("verdict") == "yes", 1)).alias("facts"))
    many = per.groupBy(scene).agg(F.count("*").alias("_n")).filter("_n >= 2").select(scene)
    d = per.filter(F.col("facts") >= min_facts).join(many, scene, "left_semi").join(targets.select(scene, "iid").withColumn("_t", F.lit(0)), [scene, "iid"], "left")
    return d.groupBy(scene).agg(F.min_by(F.struct("iid", "facts"), F.struct(F.coalesce("_t", F.lit(1)).alias("t"), "iid")).alias("b")).select(scene, "b.*")


def sibling_choice(inst: DataFrame, boxed: DataFrame, scene: str) -> DataFrame:
    """(scene, iid, reason): the instance the model boxed when that was wrong, else the largest
    other one (first on ties). ``inst``: iid, area, is_target; ``boxed``: boxed_iid."""
    g = inst.groupBy(scene).agg(F.max(F.when(F.col("is_target"), F.col("iid"))).alias("_t"),
                                F.max_by(F.col("iid"), F.when(~F.col("is_target"), F.struct(F.col("area").alias("a"), (-F.col("iid")).alias("o")))).alias("_big"), F.count("*").alias("_n"))
    d = g.join(boxed.select(scene, "boxed_iid"), scene)
    wrong = F.coalesce(F.col("boxed_iid") != F.col("_t"), F.lit(False))
    big = F.when(F.col("_n") > 1, F.col("_big"))
    return d.select(scene, F.when(wrong, F.col("boxed_iid")).otherwise(big).alias("iid"), F.when(wrong, "boxed").otherwise("largest").alias("reason"))


def unique_clauses(cells: DataFrame, scene: str, per_scene: int = 2) -> DataFrame:
    """(scene, c1, c2, iid): clauses true of exactly one candidate and refuted for all others;
    where a scene has none, pairs of clauses with that property. First ``per_scene`` in order.

    Pairs are built inside one instance's verdict array (the clauses of one expression)."""
    c = F.col
    v = c("verdict")
    one = cells.groupBy(scene, "clause").agg(F.count("*").alias("n"), F.count(F.when(v == "yes", 1)).alias("y"), F.count(F.when(v == "no", 1)).alias("x"), F.max(F.when(v == "yes", c("iid"))).alias("iid"))
    multi = c("n") >= 2
    single = one.filter(multi & (c("y") == 1) & (c("x") == c("n") - 1)).select(scene, c("clause").alias("c1"), F.lit(None).cast("int").alias("c2"), "iid")
    rows = cells.join(single.select(scene).distinct(), scene, "left_anti").groupBy(scene, "iid").agg(F.array_sort(F.collect_list(F.struct("clause", "verdict"))).alias("a"))
    combos = F.flatten(F.transform("a", lambda p, i: F.transform(F.filter(c("a"), lambda q, j: j > i), lambda q: F.struct(
        p["clause"].alias("c1"), q["clause"].alias("c2"), ((p["verdict"] == "yes") & (q["verdict"] == "yes")).alias("both"), ((p["verdict"] == "no") | (q["verdict"] == "no")).alias("out")))))
    two = rows.select(scene, "iid", F.explode(combos).alias("q")).select(scene, "iid", "q.*").groupBy(scene, "c1", "c2").agg(
        F.count("*").alias("n"), F.count(F.when(c("both"), 1)).alias("y"), F.count(F.when(~c("both") & c("out"), 1)).alias("x"), F.max(F.when(c("both"), c("iid"))).alias("iid"))
    pair = two.filter(multi & (c("y") == 1) & (c("x") == c("n") - 1)).select(scene, "c1", "c2", "iid")
    w = Window.partitionBy(scene).orderBy("c1", "c2")
    return single.unionByName(pair).withColumn("_r", F.row_number().over(w)).filter(c("_r") <= per_scene).drop("_r")


def clause_bank(cells: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, verdict): clause x instance verdicts pooled over items, the first one counts."""
    return cells.groupBy(*keys).agg(F.min_by("verdict", order).alias("verdict"))


def verified_flips(cells: DataFrame, scene: str, clause: str) -> DataFrame:
    """Flipped clauses that every instance refutes."""
    return cells.groupBy(scene, clause).agg(F.bool_and(F.col("verdict") == "no").alias("_z")).filter("_z").drop("_z")


def _recomposed(k: int, tries: int, seed):
    """Of each scene's clauses the best of the seeded sets. Which instances a clause excludes is a set of bits; a set of
    clauses excludes all if the bits together are all of them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for scene, name, clauses, others in zip(*(c.to_pylist() for c in batch.columns)):
                bit: dict = {}
                excludes = [sum(1 << bit.setdefault(i, len(bit)) for i in c["no"]) for c in clauses]
                need, size, best = (1 << others) - 1, min(k, len(clauses)), (-1, None)
                # no set of this size has more, so a scene is done when it is reached and no try can fail for want of clauses
                most = sum(sorted((c["yes"] for c in clauses), reverse=True)[:size])
                certain = not any(len(c["alike"]) > 1 for c in clauses)
                tried = range(1, tries + 1) if len(bit) == others else ()
                if certain and tried and comb(len(clauses), size) <= SETS:
                    # of so few sets the best that excludes all others is known beforehand, and often there is none
                    fit = [sum(clauses[j]["yes"] for j in s) for s in combinations(range(len(clauses)), size) if reduce(or_, (excludes[j] for j in s), 0) == need]
                    most, tried = max(fit, default=0), tried if fit else ()
                for i in tried:
                    head = md5(f"{seed}:{name}:{i}:".encode())

                    def place(j, head=head):
                        h = head.copy()
                        h.update(clauses[j]["clause"].encode())
                        return h.digest(), clauses[j]["clause"]

                    picked: list[int] = []
                    for j in sorted(range(len(clauses)), key=place):
                        if not any(i in clauses[j]["alike"] for i in picked):
                            picked.append(j)
                            if len(picked) == size:
                                break
                    if len(picked) < size:
                        best = (-1, None)
                        break
                    score, covered = 0, 0
                    for j in picked:
                        covered |= excludes[j]
                        score += clauses[j]["yes"]
                    if covered == need and score > best[0]:
                        best = score, [clauses[j]["clause"] for j in picked]
                        if certain and score == most:
                            break
                if best[1] is not None:
                    out.append((scene, *best))
            kinds = [batch.schema.field(0).type, pa.int32(), pa.list_(pa.string())]
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["scene", "score", "clauses"])

    return work


def recomposed(cells: DataFrame, scene: str, target: int, k: int, min_k: int, tries: int, seed) -> DataFrame:
    """(scene, clauses, score): up to k mutually different clauses true of the target that jointly
    exclude every other instance; of ``tries`` seeded sets the one whose clauses the others
    satisfy most often one by one (of equal ones the first). ``cells``: iid, clause (text), verdict.

    A scene in which some try finds too few different clauses has no set, as in one without other instances. What a
    row carries is one target's true clauses and the instances each excludes."""
    c = F.col
    other = c("iid") != target
    per = cells.groupBy(scene, "clause").agg(F.max(F.when(c("iid") == target, c("verdict"))).alias("mine"), F.collect_set(F.when(other & (c("verdict") == "no"), c("iid"))).alias("no"),
                                             F.count_distinct(F.when(other & (c("verdict") == "yes"), c("iid"))).cast("int").alias("yes"))
    n = cells.where(other).groupBy(scene).agg(F.count_distinct("iid").cast("int").alias("others"))
    g = per.filter("mine = 'yes'").groupBy(scene).agg(F.array_sort(F.collect_list(F.struct("clause", "no", "yes"))).alias("cs")).filter(F.size("cs") >= min_k).join(n, scene)

    def entry(a):
        alike = F.filter(F.sequence(F.lit(0), F.size("cs") - 1), lambda j: T.paraphrase(a["clause"], F.get(c("cs"), j)["clause"]))
        return F.struct(a["clause"].alias("clause"), a["no"].alias("no"), a["yes"].alias("yes"), alike.alias("alike"))

    rows = g.select(scene, c(scene).cast("string").alias("_name"), F.transform("cs", entry).alias("_cs"), "others")
    return rows.mapInArrow(_recomposed(k, tries, seed), f"scene {dict(cells.dtypes)[scene]}, score int, clauses array<string>").withColumnRenamed("scene", scene).select(scene, "clauses", "score")


def audit_rows(yes: DataFrame, nos: DataFrame, keys: list[str], k: int, two_error_frac: float, per_instance: int, seed) -> DataFrame:
    """(keys, attempt, conds, errs): recomposed rows of an instance with one or two false clauses
    that have a known counter-value and true clauses that do not touch the same attribute.

    ``yes``: clause; ``nos``: clause, seen. Lists are those of one instance."""
    from plumbline.functions.hashing import seeded_unit

    c = F.col
    y = yes.groupBy(*keys).agg(F.array_sort(F.collect_set("clause")).alias("ys")).filter(F.size("ys") >= 3)
    n = nos.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("clause", "seen"))).alias("ns"))
    d = y.join(n, keys).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(per_instance))))
    ident = F.concat_ws(":", F.lit(str(seed)), *[c(x).cast("string") for x in keys], c("attempt").cast("string"))
    n_err = F.when((seeded_unit(seed, *[c(x) for x in keys], c("attempt")) < two_error_frac) & (F.size("ns") >= 2), 2).otherwise(1)
    d = d.withColumn("n_err", n_err)
    by_hash = lambda arr, f: F.array_sort(F.transform(arr, lambda x: F.struct(F.md5(F.concat(ident, F.lit(":"), f(x))).alias("h"), x.alias("v"))))
    d = d.withColumn("errs", F.transform(F.slice(by_hash(c("ns"), lambda x: x["clause"]), 1, c("n_err")), lambda x: x["v"]))

    def clash(cl):
        w = T.content_words(cl)
        return F.exists("errs", lambda e: T.paraphrase(cl, e["clause"]) | T.paraphrase(cl, e["seen"])
                        | (F.size(F.array_except(F.array_intersect(w, F.array_union(T.content_words(e["clause"]), T.content_words(e["seen"]))), F.array(F.lit("wearing")))) > 0))

    usable = F.filter(by_hash(c("ys"), lambda x: x), lambda x: ~clash(x["v"]))
    pool = F.aggregate(usable, F.array().cast("array<string>"), lambda acc, x: F.when((F.size(acc) >= F.lit(k) - c("n_err")) | F.exists(acc, lambda a: T.paraphrase(a, x["v"])), acc)
                       .otherwise(F.concat(acc, F.array(x["v"]))))
    d = d.withColumn("pool", pool).filter(F.size("pool") >= F.greatest(F.lit(2), F.least(F.lit(k), F.size("ys")) - c("n_err")))
    conds = F.transform(by_hash(F.concat("pool", F.transform("errs", lambda e: e["clause"])), lambda x: F.concat(F.lit("o"), x)), lambda x: x["v"])
    return d.select(*keys, "attempt", conds.alias("conds"), "errs")


def style_items(details: DataFrame, flips: DataFrame, scene: str, min_details: int, two_errors: bool = True) -> DataFrame:
    """(scene, kind, f1, f2): a positive of the kept details when every other instance fails one,
    a negative per falsification refuted on all instances whose detail was kept, and two-error
    negatives of two such falsifications of different details.

    ``details``: idx, iid, is_target, verdict; ``flips``: flip, idx, iid, verdict."""
    c = F.col
    keep = details.filter(c("is_target") & (c("verdict") == "yes")).select(scene, "idx")
    enough = keep.groupBy(scene).agg(F.count("*").alias("_n")).filter(c("_n") >= min_details).select(scene)
    keep = keep.join(enough, scene, "left_semi")
    others = details.filter(~c("is_target")).join(keep, [scene, "idx"], "left_semi").groupBy(scene, "iid").agg(F.bool_or(c("verdict") == "no").alias("_out"))
    bad = others.filter(~c("_out")).select(scene).distinct()
    none = F.lit(None).cast("int")
    pos = enough.join(bad, scene, "left_anti").select(scene, F.lit("positive").alias("kind"), none.alias("f1"), none.alias("f2"))
    usable = flips.groupBy(scene, "flip", "idx").agg(F.bool_and(c("verdict") == "no").alias("_z")).filter("_z").join(keep, [scene, "idx"], "left_semi")
    neg = usable.select(scene, F.lit("negative").alias("kind"), c("flip").alias("f1"), none.alias("f2"))
    out = pos.unionByName(neg)
    if two_errors:  # falsifications of one scene: a handful in one array
        arr = usable.groupBy(scene).agg(F.array_sort(F.collect_list(F.struct("flip", "idx"))).alias("a"))
        combos = F.flatten(F.transform("a", lambda p, i: F.transform(F.filter(c("a"), lambda q, j: (j > i) & (q["idx"] != p["idx"])), lambda q: F.struct(p["flip"].alias("f1"), q["flip"].alias("f2")))))
        out = out.unionByName(arr.select(scene, F.explode(combos).alias("q")).select(scene, F.lit("two_error").alias("kind"), "q.f1", "q.f2"))
    return out


def spatial_pairs(conds: DataFrame, scene: str, seed) -> DataFrame:
    """(scene, target, a, b, neg_of, neg_text): two conditions that only the target satisfies, and
    one of them replaced so that nobody satisfies both.

    ``conds``: cond, kind (ord / rel), axis, text, verdicts (by place), opp_text, opp_verdicts.
    The conditions of one scene (a few candidates and references) are one array."""
    c = F.col
    packed = F.array_sort(F.collect_list(F.struct("cond", "kind", "axis", "text", "verdicts", "opp_text", "opp_verdicts")))
    g = conds.groupBy(scene).agg(packed.alias("cs"))
    pairs = F.flatten(F.transform("cs", lambda a, i: F.transform(F.filter(c("cs"), lambda b, j: (j > i) & ((a["kind"] == "rel") | (b["kind"] == "rel"))), lambda b: F.struct(a.alias("a"), b.alias("b")))))

    def both(x, y):
        return F.transform(F.arrays_zip(x.alias("p"), y.alias("q")), lambda z: (z["p"] == "yes") & (z["q"] == "yes"))

    def alone(x):
        return F.size(F.filter(x, lambda v: v == "yes")) == 1

    p = g.select(scene, "cs", F.explode(pairs).alias("p")).withColumn("sat", both(c("p.a.verdicts"), c("p.b.verdicts")))
    p = p.filter((F.size(F.filter("sat", lambda s: s)) == 1) & ~(alone(c("p.a.verdicts")) & alone(c("p.b.verdicts")))).withColumn("target", F.array_position("sat", True).cast("int"))

    def flips(which, keep, tag):
        rel = F.when((which["kind"] == "rel") & which["opp_text"].isNotNull(), F.array(F.struct(F.lit(tag).alias("of"), which["opp_text"].alias("text"), which["opp_verdicts"].alias("v"))))
        ordn = F.when(which["kind"] == "ord", F.transform(F.filter(c("cs"), lambda x: (x["kind"] == "ord") & (x["axis"] == which["axis"]) & (x["cond"] != which["cond"])),
                                                          lambda x: F.struct(F.lit(tag).alias("of"), x["text"].alias("text"), x["verdicts"].alias("v"))))
        opts = F.coalesce(rel, ordn, F.array().cast("array<struct<of:string,text:string,v:array<string>>>"))
        return F.filter(opts, lambda o: ~F.exists(both(o["v"], keep["verdicts"]), lambda s: s))

    p = p.withColumn("neg", F.concat(flips(c("p.a"), c("p.b"), "a"), flips(c("p.b"), c("p.a"), "b"))).filter(F.size("neg") > 0)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), c(scene).cast("string"), c("p.a.cond").cast("string"), c("p.b.cond").cast("string")))
    best = p.groupBy(scene).agg(F.min_by(F.struct("target", c("p.a.text").alias("a"), c("p.b.text").alias("b"), c("p.a.verdicts").alias("va"), c("p.b.verdicts").alias("vb"), F.get("neg", F.lit(0)).alias("n")),
                                         F.struct(order.alias("o"), c("p.a.cond").alias("i"), c("p.b.cond").alias("j"))).alias("x"))
    return best.select(scene, "x.target", "x.a", "x.b", "x.va", "x.vb", c("x.n.of").alias("neg_of"), c("x.n.text").alias("neg_text"), c("x.n.v").alias("neg_v"))


def alternative_negatives(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys) of replacement values that are false of the target and complete the sentence for no
    other instance. ``cells``: is_target, alt_verdict, n_others, others_not_no."""
    c = F.col
    sat = ~c("is_target") & (c("alt_verdict") != "no") & (c("n_others") > 0) & c("others_not_no")
    g = cells.groupBy(*keys).agg(F.bool_or(c("is_target") & (c("alt_verdict") == "no")).alias("_t"), F.bool_or(sat).alias("_s"))
    return g.filter(c("_t") & ~c("_s")).select(*keys)


def cross_negatives(cells: DataFrame, pair: list[str]) -> DataFrame:
    """(pair, n_satisfiers, usable): pairs no candidate of the other scene satisfies."""
    inst = cells.groupBy(*pair, "iid").agg(F.bool_and(F.col("verdict") != "no").alias("_s"))
    g = inst.groupBy(*pair).agg(F.count(F.when(F.col("_s"), 1)).alias("n_satisfiers"))
    return g.withColumn("usable", F.col("n_satisfiers") == 0)


def mosaic_rows(a: DataFrame, b: DataFrame, pair: list[str], scale: Column, shift: Column) -> DataFrame:
    """Candidate rows of two scenes on one canvas: the second scene's boxes scaled and shifted,
    its ids offset by 100; pairs whose second scene has a fitting row are left out."""
    from plumbline.functions import geometry as G

    fits = b.groupBy(*pair).agg(F.bool_or(~F.array_contains("verdicts", "no")).alias("_f")).filter(~F.col("_f")).select(*pair)
    moved = b.join(fits, pair, "left_semi").withColumn("box", G.scale_box(F.col("box"), scale, scale, shift, 0.0)).withColumn("iid", F.col("iid") + 100)
    return a.join(fits, pair, "left_semi").select(*pair, "iid", "box", "verdicts").unionByName(moved.select(*pair, "iid", "box", "verdicts"))


def control_copies(items: DataFrame) -> DataFrame:
    """Every item as it is, with a gray image, and with the null expression (one difference each)."""
    d = items.withColumn("control", F.explode(F.array(F.lit("none"), F.lit("gray"), F.lit("null_expression"))))
    return d.withColumn("gray", F.col("control") == "gray").withColumn("expr", F.when(F.col("control") == "null_expression", "the object").otherwise(F.col("expr")))


def caption_sample(boxes: DataFrame, key: str, captions: str, source: str, n: int, seed, w: Column, h: Column) -> DataFrame:
    """One hashed caption per box of n seeded boxes per source, degenerate boxes dropped."""
    from plumbline.functions.hashing import seeded_hex, seeded_int

    good = F.filter(captions, lambda x: T.has_text(x))
    d = boxes.withColumn("_cs", good).filter((F.size("_cs") > 0) & (w > 1) & (h > 1))
    win = Window.partitionBy(source).orderBy(seeded_hex(seed, F.col(key)), F.col(key))
    d = d.withColumn("_r", F.row_number().over(win)).filter(F.col("_r") <= n)
    return d.withColumn("caption", F.get("_cs", (seeded_int(seed, F.col(key), F.lit("cap")) % F.size("_cs")).cast("int"))).drop("_cs", "_r")


def scoring_set(own: DataFrame, positives: DataFrame, twins: DataFrame, n: int, seed) -> DataFrame:
    """(id, source, kind, half): own items, rule-flipped twins (round robin over source and edit
    type) and human positives (those of chosen twins first), classes balanced over the whole.

    ``own``: id, source, kind; ``positives``: id, source; ``twins``: id, source, edit, twin_of.
    The two class sizes come from one small aggregate; both cuts are distributed top-n."""
    from plumbline.functions.hashing import seeded_hex
    from plumbline.operators.windows import round_robin

    c = F.col
    s = own.agg(F.count("*").alias("n"), F.count(F.when(c("kind") == "positive", 1)).alias("p"), F.count(F.when(c("kind") == "negative", 1)).alias("m")).first()
    rest = max(0, n - s["n"])
    n_pos = max(0, (rest + s["m"] - s["p"]) // 2)
    chosen = round_robin(twins, ["source", "edit"], ["id"], max(0, rest - n_pos), seed)
    need = chosen.select(c("twin_of").alias("id")).distinct().withColumn("_need", F.lit(0))
    pos = positives.join(need, "id", "left").withColumn("_need", F.coalesce("_need", F.lit(1))).orderBy("_need", seeded_hex(seed, c("id")), "id").limit(n_pos)
    u = (own.select("id", "source", "kind").withColumn("_need", F.lit(0)).unionByName(pos.select("id", "source", F.lit("positive").alias("kind"), "_need"))
         .unionByName(chosen.select("id", "source", F.lit("negative").alias("kind")).withColumn("_need", F.lit(0))))
    w = Window.partitionBy("source").orderBy("_need", seeded_hex(seed, c("id")), "id")
    sizes = u.groupBy("source").agg(F.count("*").alias("_n"))
    return u.withColumn("_r", F.row_number().over(w)).join(sizes, "source").select("id", "source", "kind", (c("_r") <= F.floor((c("_n") + 1) / 2)).alias("half"))


def probe_items(sources: list[tuple[str, DataFrame]], key: str, n: int, seed) -> DataFrame:
    """Several pools in one shape with a seeded sample of n per source flagged."""
    from plumbline.operators.ranks import hash_rank

    u = None
    for name, df in sources:
        d = df.withColumn("set", F.lit(name))
        u = d if u is None else u.unionByName(d, allowMissingColumns=True)
    return hash_rank(u, seed, [key], ["set"], "_r").withColumn("probe", F.col("_r") <= n).drop("_r")


def expand_examples(items: DataFrame, n_rows: Column) -> DataFrame:
    """Adds ``part``: 0 the turn example, 1..n one audit each, -1 the answer step."""
    parts = F.concat(F.array(F.lit(0)), F.when(n_rows > 0, F.sequence(F.lit(1), n_rows.cast("int"))).otherwise(F.array().cast("array<int>")), F.array(F.lit(-1)))
    return items.withColumn("part", F.explode(parts))


def line_labels(lines: Column, spec: Column, false_word: Column, clauses: Column, verdicts: Column) -> Column:
    """0 / 1 / null per line: all true, the one line that names the false word, or the verdict
    of the closest labelled clause."""
    hit = F.transform(lines, lambda x: F.regexp_count(x, F.concat(F.lit(r"(?iU)\b"), T.quoted(false_word), F.lit(r"\b"))) > 0)
    blank = F.transform(lines, lambda x: F.lit(None).cast("int"))
    by_word = T.let(hit, lambda hs: F.when(F.size(F.filter(hs, lambda b: b)) == 1, F.transform(hs, lambda b: b.cast("int"))).otherwise(blank))
    by_clause = F.transform(lines, lambda x: T.let(T.align_clause(clauses, x), lambda j: F.when(F.get(verdicts, j - 1) == "yes", 0).when(F.get(verdicts, j - 1) == "no", 1)))
    return F.when(spec == "all_true", F.transform(lines, lambda x: F.lit(0))).when(spec == "false_word", by_word).when(spec == "verdicts", by_clause).otherwise(blank)


def base_answers(items: DataFrame, policy: DataFrame, group: str) -> DataFrame:
    """Items with the base model's answer of the stage their kind refers to."""
    which = (F.when(F.col("kind") == "positive", "target").when(F.col("kind") == "sibling_positive", "sibling")
             .when((F.col("kind") == "negative") & F.coalesce("reflipped", F.lit(False)), "neg2").when(F.col("kind") == "negative", "neg"))
    return items.withColumn("which", which).join(policy, [group, "which"], "left")


def checker_agreement(a: DataFrame, b: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """(group, n, agree): equal verdicts of two checkers, unclear cells left out."""
    j = a.select(*keys, F.col("verdict").alias("_a")).join(b.select(*keys, F.col("verdict").alias("_b")), keys).filter("_a <> 'unclear' AND _b <> 'unclear'")
    return j.groupBy(*group).agg(F.count("*").alias("n"), F.avg((F.col("_a") == F.col("_b")).cast("int")).alias("agree"))
