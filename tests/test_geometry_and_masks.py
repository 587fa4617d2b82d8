"""Geometry properties, greedy passes, mask spans."""

import json
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import boxes as B
from plumbline.operators import components as C
from plumbline.operators import greedy as GR
from plumbline.operators import joins as J
from plumbline.operators import masks as M

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


@pytest.fixture(scope="module")
def boxes(spark):
    rnd = random.Random(3)
    data = []
    for image in range(3):
        for i in range(60):
            x, y = rnd.uniform(0, 800), rnd.uniform(0, 600)
            data.append((image, i, (x, y, x + rnd.uniform(5, 190), y + rnd.uniform(5, 190)), rnd.choice([0.1, 0.5, 0.9])))
    return data, spark.createDataFrame(data, f"image_id int, iid int, box {BOX}, score double")


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = max(0, w) * max(0, h)
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / u if u > 0 else 0.0


def test_grid_join_equals_all_pairs(boxes):
    data, df = boxes
    got = {(r.image_id, r.a_iid, r.b_iid) for r in B.overlapping_pairs(df, "image_id", "iid", "box", 1000, 800).collect()}
    want = {(a[0], a[1], b[1]) for a in data for b in data if a[0] == b[0] and a[1] < b[1] and iou(a[2], b[2]) > 0}
    assert got == want


def plain_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


def test_boxes_of_a_crowded_image_are_assigned(spark):
    r = random.Random(4)

    def some():
        x, y = r.randrange(-40, 960), r.randrange(-40, 760)
        return (float(x), float(y), float(x + r.randrange(1, 200)), float(y + r.randrange(1, 200)))

    inst = [("a", i, some()) for i in range(300)] + [("a", 300 + i, (0.0, 0.0, 64.0, 64.0)) for i in range(2)]
    preds = [("a", i, some()) for i in range(200)] + [("a", 900, (0.0, 0.0, 64.0, 64.0)), ("a", 901, (-1e12, -1e12, 1e12, 1e12)), ("a", 902, (5e8, 5e8, 6e8, 6e8)), ("a", 903, None), ("no instances", 1, some())]
    kind = "x0 double, y0 double, x1 double, y1 double"
    p, i = (spark.createDataFrame(rows, f"image_id string, {k} long, box struct<{kind}>") for rows, k in ((preds, "pid"), (inst, "iid")))
    got = {(x.image_id, x.pid): (x.iid, x.iou) for x in J.assign_boxes(p, i, "image_id", ["image_id", "pid"], "box", "iid", "box").collect()}
    want = {}
    for image, pid, b in preds:
        best = max(((plain_iou(b, o), -k) for m, k, o in inst if b and m == image), default=(0.0, 0))
        want[(image, pid)] = (-best[1] if best[0] >= 0.5 else None, pytest.approx(best[0]))
    assert got == want
    assert got[("a", 900)] == (300, 1.0)


def test_questions_are_routed_by_all_neighbours(spark):
    r = random.Random(6)
    kind = "struct<x0: double, y0: double, x1: double, y1: double>"

    def some(side):
        x, y = r.randrange(0, 940), r.randrange(0, 740)
        return (float(x), float(y), float(x + r.randrange(1, side)), float(y + r.randrange(1, side)))

    edits = [(i, some(60)) for i in range(60)]
    near = [(i, some(120)) for i in range(55) for _ in range(i % 5)]
    e, n = (spark.createDataFrame(rows, f"image_id long, box {kind}") for rows in (edits, near))
    b = F.col("box")
    window = G.box(b["x0"] - 150, b["y0"] - 150, b["x1"] + 150, b["y1"] + 150)
    got = {x.image_id: x.rule for x in J.route_questions(e, n, "image_id", window, b, 1000, 800).collect()}
    crops = {x.image_id: x.t for x in e.select("image_id", G.tight_crop(b, F.lit(1000), F.lit(800)).alias("t")).collect()}
    hit = lambda a, c: a[0] < c[2] and c[0] < a[2] and a[1] < c[3] and c[1] < a[3]
    for i, box in edits:
        others = [o for k, o in near if k == i]
        wide = (box[0] - 150, box[1] - 150, box[2] + 150, box[3] + 150)
        t = crops[i]
        tight = (np.floor(t.x0), np.floor(t.y0), np.ceil(t.x1), np.ceil(t.y1))
        want = "window" if not any(hit(wide, o) for o in others) else "neighbour_in_both" if any(hit(tight, o) for o in others) else "tight_crop"
        assert got[i] == want
    assert set(got.values()) == {"window", "neighbour_in_both", "tight_crop"}


def test_iou_is_symmetric_and_bounded(boxes):
    _, df = boxes
    p = B.overlapping_pairs(df, "image_id", "iid", "box", 1000, 800).select(G.iou(F.col("a_box"), F.col("b_box")).alias("u"), G.iou(F.col("b_box"), F.col("a_box")).alias("v"))
    assert p.filter("u <> v OR u <= 0 OR u > 1").count() == 0


def sequential(data, rank, conflict):
    kept = defaultdict(list)
    for d in sorted(data, key=rank):
        if not any(conflict(d[2], k[2]) for k in kept[d[0]]):
            kept[d[0]].append(d)
    return {(i, k[1]) for i, ks in kept.items() for k in ks}


def test_greedy_pass_equals_the_sequential_one(boxes):
    data, df = boxes
    want = sequential(data, lambda d: (d[0], -d[3], d[1]), lambda a, b: iou(a, b) > 0.2)
    for parts in (1, 5):
        assert {(r.image_id, r.iid) for r in GR.nms(df.repartition(parts), "image_id", "iid", "box", F.col("score"), 0.2).collect()} == want
    assert GR.nms(df.limit(0), "image_id", "iid", "box", F.col("score"), 0.2).count() == 0


def test_greedy_pass_over_one_chain_of_boxes(spark):
    """10,000 boxes of one image, each of which conflicts with the next: one component, and every other box stays
    where the better ones come first along the chain."""
    n = 10_000
    rows = [(1, i, (float(i * 4), 0.0, float(i * 4 + 10), 10.0), float(n - i)) for i in range(n)]
    df = spark.createDataFrame(rows, f"image_id int, iid int, box {BOX}, score double")
    got = sorted(r.iid for r in GR.nms(df, "image_id", "iid", "box", F.col("score"), 0.3, (n * 4 + 10, 10)).collect())
    assert got == list(range(0, n, 2))
    mixed = df.withColumn("score", F.xxhash64("iid") % 1000)
    data = [(r.image_id, r.iid, tuple(r.box), r.score) for r in mixed.collect()]
    alive, order = set(), sorted(data, key=lambda d: (-d[3], d[1]))
    for d in order:
        if d[1] - 1 not in alive and d[1] + 1 not in alive:
            alive.add(d[1])
    assert {r.iid for r in GR.nms(mixed, "image_id", "iid", "box", F.col("score"), 0.3, (n * 4 + 10, 10)).collect()} == alive


def test_components(spark):
    r = random.Random(2)
    links = [("g", i, i + 1) for i in range(0, 3000) if i % 500] + [("h", 7, r.randrange(100, 400)) for _ in range(900)] + [("h", 5, 5), (None, 1, 2), ("k", 1, None)]
    r.shuffle(links)
    df = spark.createDataFrame(links, "g string, u int, v int").repartition(7)
    got = {(x.g, x.node): x.component for x in C.components(df, ["g"], "u", "v").collect()}
    want = {("g", i): (i - 1) // 500 * 500 + 1 for i in range(1, 3001)}
    want |= {("h", v): 7 for g, u, v in links if g == "h" and v != 5} | {("h", 7): 7}
    assert got == want
    assert C.components(df.limit(0), ["g"], "u", "v").count() == 0


def test_window_that_does_not_fit_is_an_error(spark):
    df = spark.createDataFrame([((0.0, 0.0, 3000.0, 10.0),)], f"b {BOX}")
    with pytest.raises(Exception, match="does not fit"):
        df.select(G.edit_window(F.col("b"), 4000, 4000)).collect()


# an independent run-length codec on bitmaps


def codec(mask):
    flat, runs, last, n = mask.flatten(order="F"), [], 0, 0
    for v in flat:
        if v != last:
            runs.append(n)
            n, last = 0, v
        n += 1
    runs.append(n)
    out = ""
    for i, c in enumerate(runs):
        x = c - runs[i - 2] if i > 2 else c
        more = True
        while more:
            d = x & 31
            x >>= 5
            more = x != -1 if d & 16 else x != 0
            out += chr((d | 32 if more else d) + 48)
    return json.dumps({"size": list(mask.shape), "counts": out})


def bitmaps():
    rng = np.random.default_rng(5)
    a = np.zeros((40, 50), dtype=np.uint8)
    a[5:20, 10:30] = 1
    b = (rng.random((40, 50)) < 0.3).astype(np.uint8)
    c = np.ones((40, 50), dtype=np.uint8)
    d = np.zeros((40, 50), dtype=np.uint8)
    d[0, 0] = d[39, 49] = 1
    return [a, b, c, d]


def paint(rows, shape, n):
    out = [np.zeros(shape, dtype=np.uint8) for _ in range(n)]
    for r in rows:
        assert not out[r.mask][r.y0:r.y1, r.x0:r.x1].any()
        out[r.mask][r.y0:r.y1, r.x0:r.x1] = 1
    return out


def test_run_lengths_round_trip(spark):
    masks = bitmaps()
    df = spark.createDataFrame([(1, i, codec(m)) for i, m in enumerate(masks)], "image_id int, mask int, rle string")
    spans = M.decode_masks(df, M.KEYS, "rle")
    for got, want in zip(paint(spans.collect(), (40, 50), 4), masks):
        assert (got == want).all()
    back = {r.mask: json.loads(r.rle) for r in M.encode_masks(spans, M.KEYS, 40, 50).collect()}
    assert [back[i] for i in range(4)] == [json.loads(codec(m)) for m in masks]


def test_dilation_is_the_elliptic_kernel(spark):
    assert M.disc_half_heights(3) == [3, 2, 2, 1]
    df = spark.createDataFrame([(1, 0, 10, 11, 10, 11), (1, 1, 0, 1, 0, 1)], "image_id int, mask int, x0 bigint, x1 bigint, y0 bigint, y1 bigint")
    got = paint(M.dilate(df, M.KEYS, 2, 21, 21).collect(), (21, 21), 2)
    kernel = np.array([[0, 0, 1, 0, 0], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [0, 0, 1, 0, 0]])
    assert (got[0][8:13, 8:13] == kernel).all() and got[0].sum() == kernel.sum()
    assert (got[1][:3, :3] == kernel[2:, 2:]).all()


def test_mask_iou_against_bitmaps(spark):
    masks = bitmaps()
    df = spark.createDataFrame([(1, i, codec(m)) for i, m in enumerate(masks)], "image_id int, mask int, rle string")
    got = {(r.a, r.b): r.iou for r in M.mask_iou(M.decode_masks(df, M.KEYS, "rle")).collect()}
    for i in range(4):
        for j in range(i + 1, 4):
            inter = (masks[i] & masks[j]).sum()
            want = inter / (masks[i] | masks[j]).sum()
            assert got.get((i, j), 0.0) == pytest.approx(want)


def test_controls_respect_the_referent(spark):
    def rect(mask, x0, y0, x1, y1):
        return [(1, mask, x0, x1, y0, y1)]

    rows = rect(0, 40, 40, 60, 60) + rect(1, 65, 40, 85, 60) + rect(2, 100, 40, 120, 60) + rect(3, 40, 90, 60, 110)
    spans = spark.createDataFrame(rows, "image_id int, mask int, x0 bigint, x1 bigint, y0 bigint, y1 bigint")
    meta = spark.createDataFrame([(1, 0, "referent"), (1, 1, "labelled_other_class"), (1, 2, "noun_phrase_instance"), (1, 3, "class_agnostic")], "image_id int, mask int, source string")
    c = {r["mask"]: r["reject"] for r in M.control_candidates(spans, meta, 160, 160).collect()}
    assert c == {1: "referent_contact", 2: None, 3: None}
    picked = {r.place: r["mask"] for r in M.choose_controls(M.control_candidates(spans, meta, 160, 160), "s").collect()}
    assert picked == {1: 2, 2: 3}


def test_dilation_and_packing_against_bitmaps(spark):
    """Masks with holes, islands and edges at the frame, dilated by the rule's discs."""
    r = np.random.default_rng(4)
    masks = [r.random((60, 70)) < p for p in (0.002, 0.01, 0.3, 1.0)] + [np.zeros((60, 70), bool)]
    masks[0][0, 0] = masks[0][59, 69] = True
    df = spark.createDataFrame([(1, i, codec(m.astype(np.uint8))) for i, m in enumerate(masks)] + [(1, 9, None)], "image_id int, mask int, rle string")
    rects = M.decode_masks(df, M.KEYS, "rle").cache()
    for px in (1, 5, 16):
        half = M.disc_half_heights(px)
        got = paint(M.dilate(rects, M.KEYS, px, 70, 60).collect(), (60, 70), 5)
        for m, g in zip(masks, got):
            want = np.zeros((60, 70), bool)
            for d in range(-px, px + 1):
                for e in range(-half[abs(d)], half[abs(d)] + 1):
                    want[max(0, e) : 60 + min(0, e), max(0, d) : 70 + min(0, d)] |= m[max(0, -e) : 60 + min(0, -e), max(0, -d) : 70 + min(0, -d)]
            assert (g == want).all()
    back = {x.mask: x.rle for x in M.encode_masks(rects, M.KEYS, 60, 70).collect()}
    assert {i: json.loads(t) for i, t in back.items()} == {i: json.loads(codec(m.astype(np.uint8))) for i, m in enumerate(masks[:4])}
    full = {x.mask: (x.n, x.area) for x in rects.groupBy("mask").agg(F.count("*").alias("n"), F.sum(M.pixels()).alias("area")).collect()}
    assert full[3] == (1, 4200) and all(full[i][1] == masks[i].sum() for i in range(4))


def test_background_shifts_against_bitmaps(spark):
    """All 100 tries of crowded images, by painting."""
    from hashlib import md5

    r = random.Random(6)
    w, h, rows, meta = 120, 90, [], []
    for image in range(25):
        for mask in range(7):
            x, y = r.randrange(0, 100), r.randrange(0, 70)
            rows.append((image, mask, x, min(w, x + r.randrange(10, 70)), y, min(h, y + r.randrange(10, 50))))
            meta.append((image, mask, "referent" if mask == 0 else r.choice(["class_agnostic", "labelled_other_class"])))
    rects = spark.createDataFrame(rows, "image_id int, mask int, x0 bigint, x1 bigint, y0 bigint, y1 bigint")
    names = spark.createDataFrame(meta, "image_id int, mask int, source string")
    got = {x.image_id: (x["try"], x.dx, x.dy) for x in M.background_shifts(rects, names, w, h, "s", hole_px=2, referent_px=4).collect()}
    u32 = lambda *k: int(md5(":".join(map(str, k)).encode()).hexdigest()[:8], 16)

    def grown(m, px):
        half, out = M.disc_half_heights(px), np.zeros_like(m)
        for d in range(-px, px + 1):
            for e in range(-half[abs(d)], half[abs(d)] + 1):
                out[max(0, e) : h + min(0, e), max(0, d) : w + min(0, d)] |= m[max(0, -e) : h + min(0, -e), max(0, -d) : w + min(0, -d)]
        return out

    late = 0
    for image in range(25):
        painted = {}
        for i, mask, x0, x1, y0, y1 in rows:
            if i == image:
                painted[mask] = np.zeros((h, w), bool)
                painted[mask][y0:y1, x0:x1] = True
        kind = {m: s for i, m, s in meta if i == image}
        hole, ref = grown(painted[0], 2), grown(painted[0], 4)
        ys, xs = np.nonzero(hole)
        want = None
        for k in range(1, 101):
            dx = u32("s", image, k, "x") % (w - (xs.max() - xs.min())) - xs.min()
            dy = u32("s", image, k, "y") % (h - (ys.max() - ys.min())) - ys.min()
            moved = np.zeros_like(hole)
            moved[ys + dy, xs + dx] = True
            counted = [m for m in painted if m and not (kind[m] == "class_agnostic" and painted[m].mean() <= 0.005)]
            if not (moved & ref).any() and all((moved & painted[m]).sum() <= 0.1 * painted[m].sum() for m in counted):
                want = (k, dx, dy)
                break
        assert got.get(image) == want
        late += want is None or want[0] > 6
    assert late >= 3


def test_box_mask_has_a_row_per_pixel_column(spark):
    df = spark.createDataFrame([(1, 1, -3.5, 2.2, 2.1, 9.0), (1, 2, 5.0, 5.0, 5.0, 9.0)], "image_id long, mask long, x0 double, y0 double, x1 double, y1 double")
    d = M.column_spans(M.box_spans(df, M.KEYS, F.struct("x0", "y0", "x1", "y1"), 20, 8), M.KEYS)
    assert sorted(map(tuple, d.collect())) == [(1, 1, 0, 2, 8), (1, 1, 1, 2, 8), (1, 1, 2, 2, 8)]


def test_many_masks_are_dilated_in_one_pass():
    import numpy as np

    half, rng = np.array(M.disc_half_heights(3)), np.random.default_rng(5)
    masks = []
    for _ in range(40):
        x, y = rng.integers(-4, 34, 6), rng.integers(-4, 26, 6)
        masks.append(np.column_stack([x, x + rng.integers(1, 6, 6), y, y + rng.integers(1, 6, 6)]))
    of, rects = map(np.concatenate, zip(*M._dilated(np.concatenate(masks), np.full(40, 6), half, 32, 24)))
    for i, m in enumerate(masks):
        want, got = np.zeros((24, 32), int), np.zeros((24, 32), int)
        for x0, x1, y0, y1 in m:
            for x in range(max(x0 - 3, 0), min(x1 + 3, 32)):
                t = half[max(x0 - x, x - x1 + 1, 0)]
                want[max(y0 - t, 0) : max(y1 + t, 0), x] = 1
        for x0, x1, y0, y1 in rects[of == i]:
            got[y0:y1, x0:x1] += 1
        assert (want == got).all()


def test_gathered_rectangles_are_one_number_each(spark):
    rows = [(1, 1, 0, 65535, 0, 65535), (1, 1, 40000, 40001, 7, 9), (1, 2, 3, 4, 5, 6), (1, 2, 3, 4, None, 6)]
    df = spark.createDataFrame(rows, "image_id int, mask int, x0 long, x1 long, y0 long, y1 long")
    g = M.gathered(df, M.KEYS)
    assert dict(g.dtypes)["_r"] == "array<bigint>"
    back = g.select("mask", F.explode("_r").alias("r")).select("mask", *[M.corner(F.col("r"), c).alias(c) for c in M.RECT])
    assert sorted(tuple(r) for r in back.collect()) == sorted(r[1:] for r in rows[:3])
    with pytest.raises(Exception, match="outside"):
        M.gathered(df.withColumn("y1", F.lit(65536)), M.KEYS).collect()


@pytest.mark.parametrize("hole_type", ["mask", "rect"])
def test_violations_against_bitmaps_in_one_join(spark, hole_type):
    rnd, w, h, px, ref_px = random.Random(8), 200, 90, 2, 4
    rows, source = [], {}
    for image in range(3):
        for m in range(14):
            x, y = rnd.randrange(w - 60), rnd.randrange(h - 30)
            source[image, m] = "referent" if m == 0 else rnd.choice(["labelled_other_class", "class_agnostic", "same_class_other_instance"])
            rows += [(image, m, x, x + 20, y, y + 12), (image, m, x + 20, x + rnd.randint(25, 60), y + 3, y + rnd.randint(8, 30))]
    rects = spark.createDataFrame(rows, "image_id int, mask int, x0 long, x1 long, y0 long, y1 long")
    meta = spark.createDataFrame([(*k, s, 0.004 if k[1] % 5 == 0 else 0.1) for k, s in source.items()], "image_id int, mask int, source string, area_frac double")

    def bitmaps(of):
        out = defaultdict(lambda: np.zeros((h, w), bool))
        for r in of.collect():
            out[r.image_id, r["mask"]][r.y0 : r.y1, r.x0 : r.x1] = True
        return out

    holes = M.holes(rects, M.KEYS, hole_type, w, h, px)
    own, hole, wide = bitmaps(rects), bitmaps(holes), bitmaps(M.dilate(rects, M.KEYS, ref_px, w, h))
    counted = [k for k, s in source.items() if s != "referent" and not (s == "class_agnostic" and k[1] % 5 == 0)]
    for mine in (rects, None):
        want = {}
        for k in source:
            others = [o for o in counted if o[0] == k[0] and (mine is None or o != k) and (hole[k] & own[o]).any()]
            touches = bool((hole[k] & wide[k[0], 0]).any())
            damage = hole[k] if mine is None else hole[k] & ~own[k]
            if others or touches:
                want[k] = (touches, round(max([(damage & own[o]).sum() / own[o].sum() for o in others], default=0.0), 9))
        got = M.violations(holes, mine, rects, meta, M.KEYS, w, h, referent_px=ref_px)
        assert {(r.image_id, r["mask"]): (r.touches, round(r.worst, 9)) for r in got.collect()} == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert sum("Join" in line and "_band" in line for line in plan.splitlines()) == 1
