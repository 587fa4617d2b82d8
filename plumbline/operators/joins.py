"""Keyed joins between scenes, instances, predictions, edits and runs.

Every join has an equi-key (image, pair, category and rank); pairs inside a group are never
enumerated: partners come from a grid of cells or from ring positions in a seeded order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import text as T
from plumbline.functions.hashing import seeded_pick
from plumbline.operators.boxes import CELL, grid_join, in_cells
from plumbline.operators.ranks import hash_rank
from plumbline.session import broadcast_if_small, cut_lineage

# Thresholds and class names of the rules.
ASSIGN_IOU, SIBLING_IOU, REFERENCE_IOU = 0.5, 0.3, 0.3
REFERENCE_AREA = (0.005, 0.5)
CLASSES = ("REMOVE", "CONTROL_OBJ")
UNVERIFIABLE = ("class_agnostic", "background")


def last_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key: the latest. Decided by ``max_by``, combined before the shuffle."""
    rest = [c for c in df.columns if c not in (*key, order)]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*key, "_row.*")


def assign_boxes(preds: DataFrame, instances: DataFrame, image: str, key: list[str], pred: str, iid: str, box: str, threshold: float = ASSIGN_IOU) -> DataFrame:
    """(key, iid, iou): the instance with the highest IoU to each predicted box, the first on
    ties; iid is null below the threshold, the IoU is still given (0 where nothing overlaps).

    Predictions meet only instances of the cells they touch, clipped to where their image has instances, so a
    crowded image or an endless box is never expanded to all pairs."""
    left = preds.select(*dict.fromkeys([image, *key]), F.col(pred).alias("_p"))
    right = instances.select(image, F.col(iid).alias("_i"), F.col(box).alias("_b"))
    b = F.col("_b")
    taken = right.groupBy(image).agg(F.min(b["x0"]).alias("_x0"), F.min(b["y0"]).alias("_y0"), F.max(b["x1"]).alias("_x1"), F.max(b["y1"]).alias("_y1"))
    p, v = F.col("_p"), G.iou(F.col("_p"), b)
    clip = G.box(F.greatest(p["x0"], "_x0"), F.greatest(p["y0"], "_y0"), F.least(p["x1"], "_x1"), F.least(p["y1"], "_y1"))
    clip = F.when((clip["x0"] < clip["x1"]) & (clip["y0"] < clip["y1"]), clip)
    near = in_cells(left.join(broadcast_if_small(taken), image, "left").withColumn("_c", clip), "_c", keep=True)
    met = near.join(in_cells(right, "_b"), [image, *CELL], "left").select(*key, F.col("_i").alias("i"), F.coalesce(v, F.lit(0.0)).alias("v"))
    best = met.groupBy(*key).agg(F.max_by(F.struct("i", "v"), F.struct("v", (-F.col("i")).alias("o"))).alias("_m"))
    score = F.col("_m.v")
    return best.select(*key, F.when((score >= threshold) & (score > 0), F.col("_m.i")).alias(iid), score.alias("iou"))


# ---- multi-stage records --------------------------------------------------------------------


def build_records(scenes: DataFrame, write: DataFrame, policy: DataFrame, stages: dict[str, DataFrame], key: str = "image_id", order: str = "ord") -> DataFrame:
    """Scenes with a written expression, left-joined to every stage (one struct per stage, last
    row wins), policy rows pivoted by ``which``, and an accepted second chance laid over the
    negative.

    All inputs meet on one key, so one hash partitioning serves the whole chain."""
    def packed(df: DataFrame, name: str) -> DataFrame:
        d = last_wins(df, [key], order)
        return d.select(key, F.struct(*[c for c in d.columns if c != key]).alias(name))

    d = scenes.join(packed(write, "w"), key)
    for name, df in stages.items():
        d = d.join(packed(df, name), key, "left")
    p = last_wins(policy, [key, "which"], order)
    row = F.struct(*[c for c in p.columns if c not in (key, "which")])
    wide = p.groupBy(key).agg(*[F.first(F.when(F.col("which") == w, row), ignorenulls=True).alias(f"p_{w}") for w in ("target", "neg", "neg2", "sibling")])
    d = d.join(wide, key, "left")
    use = F.coalesce(F.col("reflip.accepted"), F.lit(False))
    for f in ("expr_neg", "flipped_idx", "clause_neg"):
        d = d.withColumn(f, F.when(use, F.col(f"reflip.{f}")).otherwise(F.col(f"w.{f}")))
    by_iid = F.transform("checker.instances", lambda i: i.withField("neg_verdict", F.element_at(F.col("reflip.neg_verdicts"), i["iid"].cast("string"))))
    instances = F.when(use, by_iid).otherwise(F.col("checker.instances"))
    return (d.withColumn("instances_checked", instances)
            .withColumn("zero_satisfier", F.when(use & F.col("checker").isNotNull(), F.forall(instances, lambda i: F.coalesce(i["neg_verdict"] == "no", F.lit(False))))
                        .otherwise(F.col("checker.zero_satisfier")))
            .withColumn("found_flip", F.when(use & F.col("reflip.blind").isNotNull(), F.col("reflip.blind.found_flip")).otherwise(F.col("blind.found_flip")))
            .withColumn("p_neg_used", F.when(use, F.col("p_neg2")).otherwise(F.col("p_neg")))
            .withColumn("reflipped", F.when(use, F.col("reflip.reason"))))


def satisfiers(instances: Column, flipped_idx: Column) -> Column:
    """Candidates that may satisfy the whole negative sentence."""
    open_ = ("yes", "unclear")
    ok = F.filter(instances, lambda i: F.coalesce(i["neg_verdict"].isin(*open_), F.lit(False))
                  & _others_open(i["verdicts"], flipped_idx, open_))
    return F.when(instances.isNotNull() & flipped_idx.isNotNull(), F.transform(ok, lambda i: i["iid"]))


def _others_open(verdicts: Column, idx: Column, allowed) -> Column:
    marked = F.filter(verdicts, lambda v, k: (k != idx) & ~v.isin(*allowed))
    return F.size(marked) == 0


def all_measured_and(*parts: Column) -> Column:
    """AND that is null when any part was not measured (false AND null is null here)."""
    known, both = parts[0].isNotNull(), parts[0]
    for p in parts[1:]:
        known, both = known & p.isNotNull(), both & p
    return F.when(known, both)


def gate_flags(d: DataFrame) -> DataFrame:
    """Adds 16 three-valued gates to records."""
    c, lst = F.col, F.col("listener")
    target = F.try_element_at(F.filter("instances_checked", lambda i: i["is_target"]), F.lit(1))
    target2 = F.try_element_at(F.filter("checker2.instances", lambda i: i["is_target"]), F.lit(1))
    n_no = F.size(F.filter(target["verdicts"], lambda v: v == "no"))
    pairs = F.filter(F.arrays_zip(target["verdicts"].alias("a"), target2["verdicts"].alias("b")), lambda p: (p["a"] != "unclear") & (p["b"] != "unclear"))
    same_len = F.size(target["verdicts"]) == F.size(target2["verdicts"])
    agree = F.when(target.isNotNull() & target2.isNotNull() & same_len & (F.size(pairs) > 0), F.size(F.filter(pairs, lambda p: p["a"] == p["b"])) / F.greatest(F.size(pairs), F.lit(1)))
    has, pn, pt = c("checker").isNotNull(), c("p_neg_used"), c("p_target")
    differs = F.lower(T.strip(c("expr_neg"))) != F.lower(T.strip(c("w.expr_target")))
    sat = satisfiers(c("instances_checked"), c("flipped_idx"))
    gates = {
        "flip_identified": F.coalesce(c("flipped_idx").isNotNull() & (F.coalesce(c("expr_neg"), F.lit("")) != "") & differs, F.lit(False)),
        "writer_target_all_yes": c("checker.target_all_yes"), "writer_target_at_most_one_no": F.when(target.isNotNull(), n_no <= 1),
        "checkers_agree_on_target": agree >= 0.8, "siblings_distinct": c("checker.siblings_distinct"), "listener_unique_hit": lst["unique_hit"],
        "zero_satisfier_gate": F.when(has, c("zero_satisfier")), "zero_satisfier_sentence": F.when(has & c("clause_neg").isNotNull(), F.size(F.coalesce(sat, F.array().cast("array<bigint>"))) == 0),
        "base_correct_on_target": F.when(pt.isNotNull(), F.coalesce(pt["iou_target"], F.lit(0.0)) >= 0.5),
        "base_wrong_on_target": F.when(pt.isNotNull(), pt["boxed_iid"].isNotNull() & (F.coalesce(pt["boxed_iid"], F.lit(0)) != c("target_iid"))),
        "base_boxes_on_neg": F.when(pn.isNotNull(), (pn["output_type"] == "box") & (F.coalesce(pn["p_box"], F.lit(0.0)) >= 0.99) & pn["boxed_iid"].isNotNull()),
        "blind_judge_fooled": ~c("found_flip"), "sibling_unique_hit": lst["sibling_unique_hit"],
    }
    for k, v in gates.items():
        d = d.withColumn(k, v)
    core = [c(k) for k in ("writer_target_all_yes", "listener_unique_hit", "base_boxes_on_neg", "flip_identified")]
    d = d.withColumn("negative_usable", all_measured_and(*core, c("zero_satisfier_gate"))).withColumn("negative_usable_sentence", all_measured_and(*core, c("zero_satisfier_sentence")))
    hard = c("base_wrong_on_target") & c("listener_unique_hit") & c("writer_target_all_yes")
    return d.withColumn("positive_hard", F.when(pt.isNotNull() & lst.isNotNull() & has, hard))


GATES = ("flip_identified", "writer_target_all_yes", "writer_target_at_most_one_no", "checkers_agree_on_target", "siblings_distinct", "listener_unique_hit", "zero_satisfier_gate",
         "zero_satisfier_sentence", "base_correct_on_target", "base_wrong_on_target", "base_boxes_on_neg", "blind_judge_fooled", "sibling_unique_hit", "negative_usable",
         "negative_usable_sentence", "positive_hard")


# ---- edit contrasts -------------------------------------------------------------------------


def operator_class(op: Column) -> Column:
    """Operator without its rectangle prefix when it is one of the asked classes, else null."""
    base = F.regexp_replace(op, "^RECT_", "")
    return F.when(base.isin(*CLASSES), base)


def verifiable(source: Column) -> Column:
    return ~F.coalesce(source, F.lit(UNVERIFIABLE[0])).isin(*UNVERIFIABLE)


def paired_contrast(index: DataFrame, hole_type: str, positive: str, negative: str, fields: list[str], order: str = "sample_id") -> DataFrame:
    """(image_id, label, operator, fields): a positive and a negative row of every image that
    carries both operators; of several rows the last in ``order`` counts. One aggregation per image, no self-join."""
    prefix = "" if hole_type == "mask" else "RECT_"
    row = F.struct(F.col("operator"), *fields)

    def pick(op):
        return F.max_by(row, F.when(F.col("operator") == prefix + op, F.col(order)))

    both = index.filter(F.col("hole_type") == hole_type).groupBy("image_id").agg(pick(positive).alias("p"), pick(negative).alias("n")).filter("p IS NOT NULL AND n IS NOT NULL")
    sides = F.array(F.struct(F.lit(1).alias("label"), F.col("p").alias("r")), F.struct(F.lit(0).alias("label"), F.col("n").alias("r")))
    return both.select("image_id", F.explode(sides).alias("s")).select("image_id", "s.label", "s.r.*")


def ladder(index: DataFrame, hole_type: str, arm: str, qualities: list[int], reference: int, fields: list[str], order: str = "sample_id") -> DataFrame:
    """Two controls of one image per quality: one damaged (label 1), one at the reference."""
    base = paired_contrast(index, hole_type, "CONTROL_OBJ", "CONTROL_OBJ_2", fields, order)
    d = base.withColumn("quality", F.explode(F.array(*[F.lit(q) for q in qualities])))
    damage = F.when(F.col("label") == 1, F.col("quality")).otherwise(reference)
    suffix = F.when(F.col("label") == 1, F.concat(F.lit("_q"), F.col("quality").cast("string"))).otherwise(F.lit(f"_ref{reference}"))
    return d.withColumn("arm", F.lit(arm)).withColumn("damage", damage).withColumn("sample_id", F.concat(F.col("image_id").cast("string"), F.lit("_"), F.col("operator"), suffix))


def verified_pairs(verified: DataFrame, scores: DataFrame, order: str = "sample_id") -> DataFrame:
    """Long rows (source, label, score) of pairs whose both sides were verified removed, whose
    control can be verified and whose both sides have scores. Of several rows of a side the last in
    ``order`` counts; a control without a source is filed under ``unknown``."""
    row = F.struct("sample_id", "removed", "control_source")

    def side(op):
        return F.max_by(row, F.when(F.col("operator") == op, F.col(order)))

    pairs = verified.groupBy("image_id", "hole_type").agg(side("REMOVE").alias("r"), side("CONTROL_OBJ").alias("c")).filter("r.removed AND c.removed")
    pairs = pairs.withColumn("source", F.coalesce(F.col("c.control_source"), F.lit("unknown"))).filter(verifiable(F.col("source")))
    s1, s2 = scores.select(F.col("sample_id").alias("_r"), F.col("score").alias("sr")), scores.select(F.col("sample_id").alias("_c"), F.col("score").alias("sc"))
    d = pairs.select("source", F.col("r.sample_id").alias("_r"), F.col("c.sample_id").alias("_c")).join(s1, "_r").join(s2, "_c")
    sides = F.array(F.struct(F.lit(True).alias("label"), F.col("sr").alias("score")), F.struct(F.lit(False).alias("label"), F.col("sc").alias("score")))
    return d.select("source", F.explode(sides).alias("x")).select("source", "x.*")


def first_labels(instances: DataFrame, key: list[str], label: str, order: str) -> DataFrame:
    """Key to its first non-empty label."""
    return instances.filter(F.col(label).isNotNull() & (F.col(label) != "")).groupBy(*key).agg(F.min_by(label, order).alias(label))


def question_table(index: DataFrame, labels: DataFrame) -> DataFrame:
    """Edits with the label to ask about (the referent's or the control's) or a skip reason.

    Labels are keyed by (image, instance): instance ids repeat between images."""
    d = index.withColumn("op_class", operator_class(F.col("operator")))
    d = d.filter("op_class IS NOT NULL").withColumn("asked_id", F.when(F.col("op_class") == "REMOVE", F.col("instance_id")).otherwise(F.col("control_instance_id")))
    j = d.join(labels.withColumnRenamed("instance_id", "asked_id"), ["image_id", "asked_id"], "left")
    return j.withColumn("skip_reason", F.when(F.col("label").isNull(), "no_label"))


def unambiguous(instances: DataFrame, image: str, label: str, referent: Column) -> DataFrame:
    """Images whose referent's label occurs once (case-insensitive), with that label."""
    low = F.lower(F.col(label))
    per = instances.groupBy(image, low.alias("_l")).agg(F.count("*").alias("_n"), F.max(F.when(referent, F.col(label))).alias("_ref"))
    return per.filter((F.col("_n") == 1) & F.col("_ref").isNotNull()).select(image, F.col("_ref").alias(label))


def review_pool(clean: DataFrame, drop: list[DataFrame], need: list[DataFrame], flags: DataFrame, key: str) -> DataFrame:
    """Clean keys without the dropped ones, with every needed row; declined ones flagged."""
    out = clean
    for d in drop:
        out = out.join(d.select(key), key, "left_anti")
    for n in need:
        out = out.join(n.select(key), key, "left_semi")
    return out.join(flags, key, "left").withColumn("declined", F.coalesce("declined", F.lit(False)))


def cross_group_pairs(items: DataFrame, scenes: DataFrame, category: str, group: str, item: str, k: int, seed) -> DataFrame:
    """Each item with k other scenes of its category.

    Scenes stand on a ring per category in seeded order; an item starts at a seeded offset from
    its own scene and takes the next k. Only k rows per item are ever made, however large the
    category is, and the item's own scene is never reached."""
    ring = hash_rank(scenes.select(category, group), seed, [group], [category], "_rk")
    size = scenes.groupBy(category).agg(F.count("*").alias("_m"))
    own = items.join(ring.join(size, category), [category, group])
    m = F.col("_m")
    start = seeded_pick(seed, F.col(item)) % F.greatest(m - 1, F.lit(1))
    j = own.filter(m > 1).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(k).cast("bigint"), m - 1) - 1)))
    j = j.withColumn("_rk", (F.col("_rk") - 1 + 1 + (start + F.col("_j")) % (m - 1)) % m + 1).withColumnRenamed(group, f"src_{group}")
    return j.join(ring, [category, "_rk"]).drop("_rk", "_m", "_j")


def siblings(objects: DataFrame, keys: list[str], iid: str, box: str, k: int, seed, block: int = 4, max_iou: float = SIBLING_IOU) -> DataFrame:
    """Up to k objects of the same (image, category) with IoU below ``max_iou``, nearest first on
    a seeded ring: (keys, iid, sibling, place).

    Ring positions are tried a block at a time and an object leaves as soon as it has k
    partners, so a large group costs a few rows per object and not all pairs."""
    ring = cut_lineage(hash_rank(objects.select(*keys, iid, box), seed, [iid], keys, "_rk").join(objects.groupBy(*keys).agg(F.count("*").alias("_m")), keys))
    other = ring.select(*keys, F.col("_rk").alias("_rk2"), F.col(iid).alias("sibling"), F.col(box).alias("_b2"))
    open_, found, lo = ring.filter("_m > 1"), None, 1
    have = None
    while not open_.isEmpty():
        tries = open_.withColumn("place", F.explode(F.sequence(F.lit(lo).cast("bigint"), F.least(F.lit(lo + block - 1).cast("bigint"), F.col("_m") - 1))))
        hit = (tries.withColumn("_rk2", (F.col("_rk") - 1 + F.col("place")) % F.col("_m") + 1).join(other, [*keys, "_rk2"])
               .filter(G.iou(F.col(box), F.col("_b2")) < max_iou).select(*keys, iid, "sibling", "place"))
        hit = cut_lineage(hit)
        found = hit if found is None else found.unionByName(hit)
        have = found.groupBy(*keys, iid).agg(F.count("*").alias("_have"))
        lo, block = lo + block, block * 2
        open_ = cut_lineage(ring.filter(F.col("_m") > lo).join(have.filter(F.col("_have") >= k), [*keys, iid], "left_anti"))
    if found is None:
        return ring.select(*keys, iid, F.col(iid).alias("sibling"), F.lit(1).cast("bigint").alias("place")).limit(0)
    w = Window.partitionBy(*keys, iid).orderBy("place")
    return found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def reference_objects(objects: DataFrame, cands: DataFrame, image: str, iid: str, label: str, box: str, area_frac: Column, k: int, frame=(1000, 800)) -> DataFrame:
    """Objects whose label occurs once in the image, of medium area, clear of every candidate;
    at most k per image."""
    once = objects.groupBy(image, label).agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    ref = objects.filter(area_frac.between(*REFERENCE_AREA)).join(once, [image, label])
    hits = grid_join(ref.select(image, F.col(iid).alias("r"), F.col(box).alias("rb")), cands.select(image, F.col(iid).alias("c"), F.col(box).alias("cb")), [image], "rb", "cb")
    blocked = hits.filter(G.iou(F.col("rb"), F.col("cb")) >= REFERENCE_IOU).select(image, F.col("r").alias(iid)).distinct()
    free = ref.join(blocked, [image, iid], "left_anti")
    w = Window.partitionBy(image).orderBy(iid)
    return free.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def route_questions(edits: DataFrame, neighbours: DataFrame, image: str, window: Column, region: Column, w, h) -> DataFrame:
    """Adds ``rule`` and ``question``: the window when no neighbour is in it, else the tight crop
    when none is in that, else no question. Edits meet the neighbours in the cells of both areas."""
    def pixels(b):
        return G.box(F.floor(b["x0"]), F.floor(b["y0"]), F.ceil(b["x1"]), F.ceil(b["y1"]))

    def hit(b):
        return F.coalesce(G.overlap(F.col(b), F.col("_n")), F.lit(False))

    cols = edits.columns
    d = edits.withColumn("_w", window).withColumn("_t", G.tight_crop(region, w, h)).withColumn("_w", pixels(F.col("_w"))).withColumn("_t", pixels(F.col("_t")))
    both = G.box(*[f(F.col(f"_w.{c}"), F.col(f"_t.{c}")) for f, c in ((F.least, "x0"), (F.least, "y0"), (F.greatest, "x1"), (F.greatest, "y1"))])
    n = neighbours.select(image, F.col("box").alias("_n"))
    near = in_cells(d.withColumn("_both", both), "_both", cell=256, keep=True)
    j = near.join(in_cells(n, "_n", cell=256), [image, *CELL], "left").groupBy(*cols).agg(F.bool_or(hit("_w")).alias("_inw"), F.bool_or(hit("_t")).alias("_int"))
    rule = F.when(~F.col("_inw"), "window").when(F.col("_int"), "neighbour_in_both").otherwise("tight_crop")
    q = F.when(rule == "window", "headnoun_window").when(rule == "tight_crop", "headnoun_tight_crop")
    return j.withColumn("rule", rule).withColumn("question", q).drop("_inw", "_int")


def clean_decision(question: Column, answer: Column) -> Column:
    """"no" is clean, anything else not clean; undetermined without a question."""
    return F.when(question.isNull(), "undetermined").when(F.coalesce(T.yes_no(answer), F.lit(True)), "not_clean").otherwise("clean")


def merge_candidates(boxes: Column, given: Column, k: int, max_iou: float = 0.7) -> Column:
    """Given box first, then the own proposals that are not the same box, at most k."""
    return F.slice(F.concat(F.array(given), F.filter(boxes, lambda b: G.iou(b, given) < max_iou)), 1, k)


def _pairs_by_word(inst: np.ndarray, of: np.ndarray, word: np.ndarray, claim: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Claims and clauses of one instance that share a word: (claims, clauses, how many words), all of a claim at once
    and at most ``at_once`` meetings, unless one claim alone has more. ``of`` is the row of each word, ``inst`` and
    ``claim`` are the rows' instance and side."""
    meet = inst[of] * (int(word.max(initial=0)) + 1) + word  # instance and word
    told = np.flatnonzero(claim[of])
    found = np.flatnonzero(~claim[of])
    found = found[np.argsort(meet[found], kind="stable")]
    keys = meet[found]
    first, last = np.searchsorted(keys, meet[told], "left"), np.searchsorted(keys, meet[told], "right")
    n, a = last - first, 0
    total, begins = np.append(0, np.cumsum(n)), np.append(np.flatnonzero(np.append(True, of[told][1:] != of[told][:-1])[: len(told)]), len(told))
    while a < len(begins) - 1:
        b = max(a + 1, int(np.searchsorted(total[begins], total[begins[a]] + at_once, "right")) - 1)
        lo, hi = begins[a], begins[b]
        a, size = b, n[lo:hi]
        here = np.repeat(first[lo:hi] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pair = np.sort(np.repeat(of[told[lo:hi]], size) * len(inst) + of[found[here]])
        start = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
        yield pair[start] // len(inst), pair[start] % len(inst), np.diff(np.append(start, len(pair)))


def _seen(n_keys: int, at_once: int):
    """Of rows (keys, _claim, _t, _w) sorted by keys, side and text: the clause that answers each claim. Whole instances
    pass, as many at a time as a batch brings."""
    def best(rows: pa.RecordBatch, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        claim, text, words = (rows.column(n_keys + k) for k in range(3))
        sizes = words.value_lengths().to_numpy(zero_copy_only=False)
        word = words.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(np.arange(rows.num_rows), sizes)
        for told, seen, n in _pairs_by_word(np.cumsum(new), of, word, claim.to_numpy(zero_copy_only=False), at_once):
            # another text with a word of its own; most words first, and rows are in the order of their texts
            differs = pc.not_equal(text.take(pa.array(told)), text.take(pa.array(seen))).to_numpy(zero_copy_only=False)
            ok = differs & (n < sizes[seen])
            told, seen, n = told[ok], seen[ok], n[ok]
            order = np.lexsort((seen, -n, told))
            told, seen = told[order], seen[order]
            start = np.append(True, told[1:] != told[:-1])[: len(told)]
            told, seen = pa.array(told[start]), pa.array(seen[start])
            yield pa.record_batch([*(rows.column(k).take(told) for k in range(n_keys)), text.take(told), text.take(seen)], names=[*rows.schema.names[:n_keys], "_claim", "_seen"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            differs = np.zeros(batch.num_rows, bool)
            for c in batch.columns[:n_keys]:
                differs[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            follows = kept and all(kept[-1].column(k)[-1] == batch.column(k)[0] for k in range(n_keys))
            begins = np.flatnonzero(differs)
            cut = int(begins[-1]) if len(begins) else 0
            if len(begins) or not follows:
                yield from whole([*kept, batch.slice(0, cut)])
                kept = []
            kept.append(batch.slice(cut))
        yield from whole(kept)

    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [p for p in parts if p.num_rows]
        if parts:
            rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            new = np.ones(rows.num_rows, bool)
            new[1:] = False
            for c in rows.columns[:n_keys]:
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            yield from best(rows, new)

    return work


def seen_from_bank(claims: DataFrame, bank: DataFrame, keys: list[str], claim: str, clause: str, at_once: int = 1 << 22) -> DataFrame:
    """(keys, claim, seen): a confirmed clause of the same instance that shares a content word
    with the refuted claim and names something new; most shared words, first clause on ties.

    Both lists are dealt out by instance, one shuffle, and sorted there. A text is cut into words once. Claims and clauses
    meet by (instance, word), so only those that share a word ever meet, at most ``at_once`` at a time; a clause names
    something new if it has more words than it shares."""
    c = F.col
    told = claims.select(*keys, F.col(claim).alias("_t"), F.lit(True).alias("_claim")).unionByName(bank.select(*keys, F.col(clause).alias("_t"), F.lit(False).alias("_claim")))
    each = told.dropna(subset=keys).repartition(*keys).distinct().select(*keys, "_claim", "_t", T.content_words(c("_t")).alias("_w"))
    rows = each.sortWithinPartitions(*keys, "_claim", "_t")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.select(*keys).schema)
    return rows.mapInArrow(_seen(len(keys), at_once), f"{kinds}, _claim string, _seen string").select(*keys, c("_claim").alias(claim), c("_seen").alias("seen"))


def _compared():
    """Counts of the pairs of cells that two lists of a row have in common: all, those of one verdict, those labelled
    "no" and those of them that are "no" in both."""
    def codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both = pa.concat_arrays([a, b]).dictionary_encode()
        code = pc.fill_null(both.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return code[: len(a)], code[len(a) :], pc.fill_null(pc.equal(both.dictionary, "no"), False).to_numpy(zero_copy_only=False) if pa.types.is_string(both.dictionary.type) else None

    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        b = np.sort(b)
        return np.searchsorted(b, a, "right") - np.searchsorted(b, a, "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(k) for k in range(2)]
            a, b = (np.repeat(np.arange(batch.num_rows), c.value_lengths().to_numpy(zero_copy_only=False)) for c in lists)
            (*ka, label, va), (*kb, vb) = (c.flatten().flatten() for c in lists)
            ok_a, ok_b = np.ones(len(a), bool), np.ones(len(b), bool)
            for x, y in zip(ka, kb):
                p, q, _ = codes(x, y)
                ok_a, ok_b = ok_a & (p >= 0), ok_b & (q >= 0)
                # numbers are made dense again before the next key, so that they stay small
                size = max(p.max(initial=0), q.max(initial=0)) + 1
                _, dense = np.unique(np.concatenate([a * size + np.maximum(p, 0), b * size + np.maximum(q, 0)]), return_inverse=True)
                a, b = dense[: len(a)], dense[len(a) :]
            p, q, no = codes(va, vb)
            is_no = pc.fill_null(pc.equal(label, "no"), False).to_numpy(zero_copy_only=False)
            a, p, is_no, b, q = a[ok_a], p[ok_a], is_no[ok_a], b[ok_b], q[ok_b]
            met, known, size = pairs(a, b), p >= 0, len(no) + 1
            same = pairs((a * size + p)[known], (b * size + q)[q >= 0])
            yield pa.record_batch([pa.array([int(v)]) for v in (met.sum(), same.sum(), met[is_no].sum(), same[is_no[known] & no[p[known]]].sum())], names=["cells", "same", "label_no", "both_no"])

    return work


def compare_cells(a: DataFrame, b: DataFrame, keys: list[str], label: str, verdict: str) -> DataFrame:
    """Two rationale files cell by cell: shared cells, identical verdicts, both "no" on "no". The cells of one value of
    the first key meet as two lists, so files that lie by it are not shuffled."""
    first, *rest = keys
    listed = lambda df, name, *columns: df.dropna(subset=[first]).groupBy(first).agg(F.collect_list(F.struct(*rest, *columns)).alias(name))
    j = listed(a, "_a", F.col(label).alias("_l"), F.col(verdict).alias("_v")).join(listed(b, "_b", F.col(verdict).alias("_v")), first)
    counts = j.select("_a", "_b").mapInArrow(_compared(), "cells bigint, same bigint, label_no bigint, both_no bigint")
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cells", "same", "label_no", "both_no")])
