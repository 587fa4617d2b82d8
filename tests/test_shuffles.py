"""How often and how wide rows are shuffled, and helpers that work on shuffled rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import joins as J
from plumbline.operators import masks as M
from plumbline.operators import sets as SE
from plumbline.plans.tables import DERIVED, Tables, spell

LINE = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate date")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lines")
    rows = [(o, (o or 4) * 7 % 5, (o or 4) % 3, n % 4, float(n), 2.0, 0.5, 0.1, "R", "O", None) for o in (1, 2, 3, None) for n in range(6)]
    spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_numbered_candidates_are_those_of_the_select(spark, lines):
    t = Tables(spark, lines)
    spelled = spark.sql(spell(DERIVED["cand"], "spark").replace("FROM lineitem", "FROM {rows}"), rows=t.scan("lineitem"))
    assert t.cand.schema.names == spelled.schema.names and t.cand.dtypes == spelled.dtypes
    rows = lambda d: sorted(map(repr, d.collect()))
    assert rows(t.cand) == rows(spelled) and t.cand.count() == 24


def test_groups_of_candidates_are_not_shuffled_again(spark, lines):
    g = Tables(spark, lines).cand.groupBy("image_id", "iid").agg(F.collect_list("x0").alias("xs"))
    assert plan(g).count("Exchange hashpartitioning") == 1


def test_words_are_found_by_one_search(spark):
    d = spark.createDataFrame([("A red-hot CUP, the  cup\tis not 2 big\n",), ("",), (None,), ("the is",), ("İn Café",)], "t string")
    assert [r[0] for r in d.select(T.content_words(F.col("t"))).collect()] == [["red", "hot", "cup", "2", "big"], [], [], [], ["i", "n", "caf"]]
    assert [r[0] for r in d.select(T.norm_words(F.col("t"))).collect()] == [[w for w in r[0].split(" ") if w] if r[0] == "" else list(dict.fromkeys(r[0].split(" "))) for r in d.select(T.norm(F.col("t"))).collect()]
    found = plan(d.select(T.content_words(F.col("t"))))
    assert "regexp_extract_all" in found and "regexp_replace" not in found


def slow_seen(claims, bank):
    stop = {*T.NORM_DROP[3:-3].split("|"), *T.NEGATIONS}
    w = lambda t: set("".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split()) - stop
    out = set()
    for k, v, t in claims:
        fits = [(-len(w(t) & w(u)), u) for k2, v2, u in bank if (k2, v2) == (k, v) and k is not None and v is not None and t is not None and u is not None and u != t and w(t) & w(u) and w(u) - w(t)]
        if fits:
            out.add((k, v, t, min(fits)[1]))
    return out


@pytest.mark.parametrize("at_once", [1, 1 << 22])
def test_seen_from_bank_in_small_steps(spark, at_once):
    words = ["red cap", "a red cap", "blue coat", "red coat", "not red", "dark blue coat", "", None, "the", "cap", "Zebra cap", "é cap"]
    claims = [(k, v, words[(i * 5 + k) % 12]) for i in range(40) for k in (1, 2) for v in ("x", "y")] + [(None, "x", "red cap"), (3, None, "red cap")]
    bank = [(k, v, words[(i * 7 + k + len(v)) % 12]) for i in range(40) for k in (2, 1) for v in ("y", "x")] + [(None, "x", "red coat"), (3, None, "red coat")]
    a, b = (spark.createDataFrame(r, f"k bigint, v string, {n} string") for r, n in ((claims, "claim"), (bank, "clause")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3 if at_once == 1 else 10000)
    try:
        found = J.seen_from_bank(a, b, ["k", "v"], "claim", "clause", at_once=at_once).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == slow_seen(claims, bank) != set()


RECTS = "image_id int, mask int, x0 bigint, x1 bigint, y0 bigint, y1 bigint"


def random_masks(seed, images, masks, w, h):
    """Masks of two touching rectangles, their sources and their bitmaps."""
    r, rows, meta, drawn = random.Random(seed), [], [], {}
    for i in range(images):
        for m in range(masks):
            x, y = r.randrange(w - 60), r.randrange(h - 30)
            mine = [(x, x + 20, y, y + 12), (x + 20, x + r.randint(25, 60), y + 3, y + r.randint(8, 30))]
            rows += [(i, m, *v) for v in mine]
            meta.append((i, m, "referent" if m == 0 else r.choice(["labelled_other_class", "class_agnostic", "noun_phrase_instance", "same_class_other_instance", None])))
            drawn[i, m] = np.zeros((h, w), bool)
            for x0, x1, y0, y1 in mine:
                drawn[i, m][y0:y1, x0:x1] = True
    return rows, meta, drawn


@pytest.mark.parametrize("chunk", [1, 7, 1 << 22])
def test_damage_in_small_steps(monkeypatch, chunk):
    monkeypatch.setattr(M, "CHUNK", chunk)
    rows, meta, drawn = random_masks(3, 2, 9, 220, 90)
    keys = list(drawn)
    at = np.array([keys.index(r[:2]) for r in rows])
    image, ids, rects = np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.array([r[2:] for r in rows])
    n = np.array([-1 if k[1] == 0 else drawn[k].sum() for k in keys])
    # the hole of a mask is its rectangles, grown to the right and down; its own are those of every second one
    hole = rects + np.array([0, 9, 0, 5])
    own = np.isin(at, np.flatnonzero(ids % 2))
    touches, worst = M._worst(len(keys), np.append(at, at[own]), np.concatenate([hole, rects[own]]), np.repeat([False, True], [len(at), own.sum()]), image, ids, at, rects, image, ids, n)
    for p, k in enumerate(keys):
        shares, touched = [0.0], False
        for t, o in enumerate(keys):
            both = lambda a: sum(max(0, min(x[1], y[1]) - max(x[0], y[0])) * max(0, min(x[3], y[3]) - max(x[2], y[2])) for x in a for y in rects[at == t])
            if o[0] == k[0] and both(hole[at == p]):
                touched |= n[t] < 0
                if n[t] >= 0 and o != k:
                    shares.append((both(hole[at == p]) - (both(rects[at == p]) if ids[p] % 2 else 0)) / n[t])
        assert touches[p] == touched and worst[p] == max(shares)


@pytest.mark.parametrize("hole_type", ["mask", "rect"])
def test_controls_agree_with_the_violations_of_their_holes(spark, hole_type):
    w, h = 220, 90
    rows, meta, drawn = random_masks(5, 6, 9, w, h)
    spans, names = spark.createDataFrame([*rows, (None, 1, 0, 9, 0, 9), (1, None, 0, 9, 0, 9)], RECTS), spark.createDataFrame([*meta, *meta[:3], (None, 1, "referent"), (99, 1, "referent")], "image_id int, mask int, source string")
    facts = M.mask_facts(spans, M.KEYS, w, h).select(*M.KEYS, "area_frac").join(names, M.KEYS)
    bad = {(r.image_id, r["mask"]): r.reason for r in M.violations(M.holes(spans, M.KEYS, hole_type, w, h, 3), spans, spans, facts, M.KEYS, w, h, referent_px=4).collect()}
    got = M.control_candidates(spans, names, w, h, hole_type, 3, 4).collect()
    # every control meets every row of a referent, and the first image's referent and two others are named twice
    times = {k: sum((i, m) == k for i, m, _ in [*meta, *meta[:3]]) for k in drawn}
    assert sorted((r.image_id, r["mask"]) for r in got) == sorted((i, m) for i, m, s in [*meta, *meta[:3]] if s in M.CONTROL_TIERS for _ in range(times[i, 0]))
    seen = set()
    for r in got:
        ratio = drawn[r.image_id, r["mask"]].sum() / drawn[r.image_id, 0].sum()
        assert r.ratio == ratio
        want = {"touches the referent": "referent_contact", "bites another instance": "exclusion_overlap"}.get(bad.get((r.image_id, r["mask"])))
        assert r.reject == ("area" if not 0.5 <= ratio <= 2 else "centrality" if abs(r.delta) > 0.2 else want)
        seen.add(r.reject)
    assert {"referent_contact", "exclusion_overlap"} <= seen


def test_masks_that_lie_by_image_are_not_shuffled_to_meet_their_flags(spark):
    rows, meta, _ = random_masks(5, 2, 4, 220, 90)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        spans = spark.createDataFrame(rows, RECTS)
        spans = spans.withColumn("_n", F.row_number().over(Window.partitionBy("image_id").orderBy("mask", "x0"))).where("_n > 0")
        names = spark.createDataFrame(meta, "image_id int, mask int, source string").withColumn("_n", F.row_number().over(Window.partitionBy("image_id").orderBy("mask"))).where("_n > 0")
        for d in (M.control_candidates(spans, names, 220, 90), M.background_shifts(spans, names, 220, 90, "s")):
            assert plan(d).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_probes_of_violations_are_dealt_out_once(spark):
    rows, meta, _ = random_masks(5, 2, 4, 220, 90)
    spans, names = spark.createDataFrame(rows, RECTS), spark.createDataFrame([(*m, 0.1) for m in meta], "image_id int, mask int, source string, area_frac double")
    v = M.violations(M.holes(spans, M.KEYS, "rect", 220, 90), spans, spans, names, M.KEYS, 220, 90)
    probes = M._gathered_in_bands(spans, M.KEYS, True)
    assert "Exchange" not in plan(probes) and {tuple(r) for r in probes.select("image_id", "mask", "_band").collect()} == {(i, m, b) for i, m, x0, x1, _, _ in rows for b in range(x0 // 64, (x1 - 1) // 64 + 1)}
    assert v.count() > 0


def test_pairs_and_points_meet_where_their_image_lies(spark):
    rows, meta, drawn = random_masks(9, 3, 8, 220, 90)
    spans = spark.createDataFrame([*rows, (None, 1, 0, 9, 0, 9), (0, None, 0, 200, 0, 80)], RECTS)
    want = {(i, a, b): (drawn[i, a] & drawn[i, b]).sum() / (drawn[i, a] | drawn[i, b]).sum() for i in range(3) for a in range(8) for b in range(a + 1, 8) if (drawn[i, a] & drawn[i, b]).any()}
    found = M.mask_iou(spans)
    assert plan(found).count("Exchange") == 1 and "Join" not in plan(found)
    assert {(r.image_id, r.a, r.b): r.iou for r in found.collect()} == want

    r = random.Random(2)
    boxes = [(i, m, min(v[2] for v in rows if v[:2] == (i, m)) - 3, max(v[3] for v in rows if v[:2] == (i, m)) + 3.5, 2.0, 88.0) for i in range(3) for m in range(8)]
    points = [(i, r.randrange(30), r.choice([-5.0, r.random() * 240, float(r.randrange(220))]), r.random() * 100) for i in (0, 1, 2, 7, None) for _ in range(40)] + [(1, None, 50.0, 40.0), (1, 99, None, 40.0)]
    b = spark.createDataFrame([(i, m, (float(x0), 2.0, x1, y1)) for i, m, x0, x1, _, y1 in boxes], "image_id int, mask int, box struct<x0:double,y0:double,x1:double,y1:double>")
    p = spark.createDataFrame(points, "image_id int, pid int, x double, y double")
    got = M.point_hits(p, spans.where("mask IS NOT NULL"), b, ["image_id", "pid"], F.col("x"), F.col("y")).collect()
    hits = {}
    for i, k, x, y in points:
        if None not in (i, k, x, y):
            x, y = round(x), round(y)
            hits.setdefault((i, k), ([], []))[0].extend(m for m in range(8) if (i, m) in drawn and 0 <= x < 220 and 0 <= y < 90 and drawn[i, m][y, x])
            hits[i, k][1].extend(m for j, m, x0, x1, y0, y1 in boxes if j == i and x0 <= x <= x1 and y0 <= y <= y1)
    first = {k: min(m) if m else min(n, default=None) for k, (m, n) in hits.items()}
    same = lambda rows: sorted(rows, key=repr)
    assert same(tuple(r) for r in got) == same((i, k, first.get((i, k))) for i, k, _, _ in points)


def test_cells_of_two_files_are_compared_in_lists(spark):
    r = random.Random(1)
    rows = lambda: [(r.choice([1, 2, None]), r.choice([1, 2, 3, None]), r.choice(["a", "b", None]), r.choice(["no", "yes", None]), r.choice(["no", "yes", "unclear", None])) for _ in range(90)]
    x, y = rows(), rows()
    a, b = (spark.createDataFrame(d, "image int, iid int, clause string, label string, blind string") for d in (x, y))
    met = [(p, q) for p in x for q in y if p[:3] == q[:3] and None not in p[:3]]
    same = [(p, q) for p, q in met if p[4] is not None and p[4] == q[4]]
    want = (len(met), len(same), sum(p[3] == "no" for p, _ in met), sum(p[3] == "no" and p[4] == "no" for p, _ in same))
    d = J.compare_cells(a, b, ["image", "iid", "clause"], "label", "blind")
    assert plan(d).count("hashpartitioning(image") == 2 and "iid" not in "".join(x for x in plan(d).splitlines() if "hashpartitioning" in x)
    assert tuple(d.first()) == want
    assert tuple(J.compare_cells(a.where("image = 9"), b, ["image", "iid", "clause"], "label", "blind").first()) == (0, 0, 0, 0)


def test_cells_of_an_item_are_one_row_when_they_are_shuffled(spark):
    r = random.Random(4)
    cells = [(r.choice([1, 2, 3, None]), r.choice([1, 2, None]), r.choice([1, 2, 3, None]), r.choice(["yes", "no", "unclear", "??", None]), r.choice(["yes", "no", "odd", None]), r.choice([5, 7, None])) for _ in range(80)]
    items = [(1, 1, 1, None), (2, None, 1, 2), (3, None, None, None), (4, None, 1, 1)]
    c = spark.createDataFrame(cells, "item long, iid int, clause int, verdict string, flipped_verdict string, area long")
    i = spark.createDataFrame(items, "item long, answer_iid int, first_iid int, flipped_idx int")
    known = lambda v: v if v in ("yes", "no", "unclear") else "unclear"
    want = []
    for item, iid, clause, verdict, flipped, area in cells:
        for k, answer, first, idx in items:
            if k == item:
                flip = clause is not None and clause == idx
                v = "yes" if answer is not None and iid == answer else "no" if flip and iid is not None and iid == first else known(flipped) if flip else known(verdict)
                want.append((item, iid, clause, area, answer, first, idx, v))
    d = SE.label_rows(c, i).select("item", "iid", "clause", "area", "answer_iid", "first_iid", "flipped_idx", "verdict")
    assert "collect_list" in plan(d) and sorted(map(repr, map(tuple, d.collect()))) == sorted(map(repr, want))
    assert d.dtypes[1:4] == [("iid", "int"), ("clause", "int"), ("area", "bigint")]


def test_sets_of_clauses_that_cannot_do_are_not_drawn(monkeypatch):
    drawn = []
    monkeypatch.setattr(SE, "md5", lambda t: drawn.append(t) or hashlib.md5(t))
    clause = lambda name, no, yes, at: {"clause": name, "no": no, "yes": yes, "alike": [at]}
    scenes = [("x", "x", [clause("a", [2], 1, 0), clause("b", [3], 1, 1), clause("c", [4], 0, 2), clause("d", [2], 2, 3)], 3), ("y", "y", [clause("a", [2], 1, 0), clause("b", [2, 3], 0, 1), clause("c", [], 5, 2)], 2)]
    kind = pa.list_(pa.struct([("clause", pa.string()), ("no", pa.list_(pa.int32())), ("yes", pa.int32()), ("alike", pa.list_(pa.int32()))]))
    batch = pa.record_batch([pa.array([s[i] for s in scenes], t) for i, t in enumerate((pa.string(), pa.string(), kind, pa.int32()))], names=["scene", "_name", "_cs", "others"])
    out = [r for b in SE._recomposed(2, 80, "rc")(iter([batch])) for r in b.to_pylist()]
    # two of x's clauses never exclude all three others; of y's sets the best is "b" and "c"
    assert [(r["scene"], r["score"], sorted(r["clauses"])) for r in out] == [("y", 5, ["b", "c"])]
    assert 0 < len(drawn) < 80 and not any(t.startswith(b"rc:x:") for t in drawn)


@pytest.mark.parametrize("hole_type", ["mask", "rect"])
def test_masks_without_known_rectangles(spark, hole_type):
    """They are judged, but nothing is known of them, and they damage nothing."""
    rows = [(1, 0, 40, 60, 40, 60), (1, 1, 100, 120, 40, None), (1, 2, 100, 120, 40, 60), (2, 0, 4, None, 4, 6), (2, 1, 10, 20, 10, 20), (3, 0, 1, 9, 1, 9), (3, 3, 5, 9, None, 9)]
    meta = [(i, m, "referent" if m == 0 else "noun_phrase_instance") for i, m, *_ in rows]
    spans, names = spark.createDataFrame(rows, RECTS), spark.createDataFrame(meta, "image_id int, mask int, source string")
    got = {(r.image_id, r["mask"]): (r.ratio, r.reject) for r in M.control_candidates(spans, names, 160, 160, hole_type).collect()}
    assert got == {(1, 1): (None, None), (1, 2): (1.0, None), (2, 1): (None, None), (3, 3): (None, None)}
    assert {r.image_id for r in M.background_shifts(spans, names, 160, 160, "s", hole_type=hole_type).collect()} == {1, 3}
