"""Boxes, grids and image sizes as column expressions.

A box is a ``struct<x0,y0,x1,y1>`` of doubles in original pixels. Every function takes and
returns Columns, so a whole chain stays inside one code-generated stage: the optimizer
folds the struct away and only the arithmetic remains.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and sizes the results depend on.
SIZE_BINS = ((32, "tiny"), (96, "small"), (224, "medium"), (448, "large"))
SIZE_BIN_LAST = "xl"
HOLE_AREA_EDGES = ((0.01, "0.5-1%"), (0.02, "1-2%"), (0.05, "2-5%"))
HOLE_AREA_LAST = "5-15%"
WINDOW_FACTOR, WINDOW_MIN_SIDE, WINDOW_MAX_SIDE = 4.0, 768, 2048
TIGHT_DILATION, TIGHT_MIN_SIDE = 0.5, 256
CLOSEUP_PAD = 0.25
SHOWN_CROP_FACTOR = 1.5
PIXEL_CAP = 2_457_600
TOKEN_CELL = 32
STAYS_PUT, SCALES, RELATIVE_FLOOR = 0.08, 0.12, 100.0
SIDE_MARGIN = 0.02
COORDINATE_DIVISORS = {"relative_1000": 1000.0, "percent_float": 100.0}


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def dbl(x) -> Column:
    return num(x).cast("double")


def box(x0, y0, x1, y1) -> Column:
    return F.struct(dbl(x0).alias("x0"), dbl(y0).alias("y0"), dbl(x1).alias("x1"), dbl(y1).alias("y1"))


def box_of_array(a: Column) -> Column:
    """``array<double>[4]`` at the edge of the system to the inner struct form."""
    return F.when(F.size(a) == 4, box(a[0], a[1], a[2], a[3]))


def xywh_box(x, y, w, h) -> Column:
    return box(x, y, num(x) + num(w), num(y) + num(h))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def longer_side(b: Column) -> Column:
    return F.greatest(width(b), height(b))


def area(b: Column) -> Column:
    """Area, 0 for a reversed box."""
    return F.greatest(F.lit(0.0), width(b)) * F.greatest(F.lit(0.0), height(b))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 when disjoint or degenerate, null when either is null."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(union > 0, inter / union).otherwise(0.0)


def containment(inner: Column, outer: Column) -> Column:
    """Share of the inner box that lies inside the outer one."""
    return intersection(inner, outer) / F.greatest(F.lit(1e-6), width(inner) * height(inner))


def inside(inner: Column, outer: Column, tolerance: float = 0.9) -> Column:
    return intersection(inner, outer) >= F.lit(tolerance) * width(inner) * height(inner)


def overlap(a: Column, b: Column) -> Column:
    """Strict overlap: a shared edge does not count."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def clamp(b: Column, w, h) -> Column:
    """Clip to the frame and put reversed corners in order."""
    def clip(v, hi):
        return F.greatest(F.lit(0.0), F.least(v, dbl(hi)))

    xa, xb, ya, yb = clip(b["x0"], w), clip(b["x1"], w), clip(b["y0"], h), clip(b["y1"], h)
    return box(F.least(xa, xb), F.least(ya, yb), F.greatest(xa, xb), F.greatest(ya, yb))


def coordinate_scale(convention: Column, original, sent=None) -> Column:
    """Factor from a model's coordinate frame to original pixels along one axis."""
    size = dbl(original)
    expr = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, divisor in COORDINATE_DIVISORS.items():
        expr = expr.when(convention == name, size / F.lit(divisor))
    resized = (F.raise_error(F.lit("absolute_resized needs the size that was sent")).cast("double") if sent is None else
               F.when(num(sent).isNull(), F.raise_error(F.lit("absolute_resized needs the size that was sent")).cast("double"))
               .otherwise(size / dbl(sent)))
    expr = expr.when(convention == "absolute_resized", resized)
    bad = F.concat(F.lit("unknown coordinate convention: "), F.coalesce(convention, F.lit("null")))
    return expr.otherwise(F.raise_error(bad).cast("double"))


def scale_box(b: Column, sx, sy, dx=0.0, dy=0.0) -> Column:
    """Affine map of a box: scale, then shift."""
    sx, sy, dx, dy = dbl(sx), dbl(sy), dbl(dx), dbl(dy)
    return box(b["x0"] * sx + dx, b["y0"] * sy + dy, b["x1"] * sx + dx, b["y1"] * sy + dy)


def to_original_pixels(b: Column, convention: Column, w, h, sent_w=None, sent_h=None) -> Column:
    sx, sy = coordinate_scale(convention, w, sent_w), coordinate_scale(convention, h, sent_h)
    return box(b["x0"] * sx, b["y0"] * sy, b["x1"] * sx, b["y1"] * sy)


def relative_1000(b: Column, w, h) -> Column:
    """Pixels to integers 0..1000, half-even, as ``array<int>``."""
    def rel(v, size):
        return F.least(F.lit(1000), F.greatest(F.lit(0), F.bround(v * 1000 / num(size)).cast("int")))

    return F.array(rel(b["x0"], w), rel(b["y0"], h), rel(b["x1"], w), rel(b["y1"], h))


def size_bin(b: Column) -> Column:
    side = longer_side(b)
    expr = None
    for edge, name in SIZE_BINS:
        expr = F.when(side < edge, name) if expr is None else expr.when(side < edge, name)
    return F.when(b.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(SIZE_BIN_LAST))


def hole_area_bin(frac: Column) -> Column:
    expr = None
    for edge, name in HOLE_AREA_EDGES:
        expr = F.when(frac < edge, name) if expr is None else expr.when(frac < edge, name)
    return expr.otherwise(HOLE_AREA_LAST)


def readings(b1000: Column, w, h) -> dict[str, Column]:
    """One answer read in three ways: as pixels, over 999 (or 0..1), and over 1000."""
    w, h = dbl(w), dbl(h)
    unit = F.greatest(b1000["x0"], b1000["y0"], b1000["x1"], b1000["y1"]) <= 1
    over_999 = F.when(unit, box(b1000["x0"] * w, b1000["y0"] * h, b1000["x1"] * w, b1000["y1"] * h)).otherwise(
        box(b1000["x0"] / 999 * w, b1000["y0"] / 999 * h, b1000["x1"] / 999 * w, b1000["y1"] / 999 * h))
    return {"absolute": b1000, "over_999": over_999, "over_1000": scale_box(b1000, w / 1000.0, h / 1000.0)}


def probe_convention(ratio: Column, frame_ratio: Column, largest: Column) -> Column:
    """Which frame a model answers in, from how far coordinates moved between two sizes."""
    return (F.when((F.abs(ratio - 1.0) < STAYS_PUT) & (largest > RELATIVE_FLOOR), "relative_1000")
            .when(F.abs(ratio - 1.0) < STAYS_PUT, "percent_float")
            .when(F.abs(ratio - frame_ratio) < SCALES, "absolute_resized")
            .otherwise("UNDECIDED"))


def point_in_box(x: Column, y: Column, b: Column) -> Column:
    return x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"])


def side_verdict(c: Column, r: Column, side: str, w, h) -> Column:
    """yes / no / null: does ``c`` lie on ``side`` of ``r``, with a 2 % margin."""
    lo, hi, size = ("x0", "x1", w) if side in ("left", "right") else ("y0", "y1", h)
    margin = F.lit(SIDE_MARGIN) * dbl(size)
    cc, rc = (c[lo] + c[hi]) / 2, (r[lo] + r[hi]) / 2
    if side in ("left", "above"):
        return F.when(c[hi] <= r[lo] + margin, "yes").when(cc >= rc, "no")
    return F.when(c[lo] >= r[hi] - margin, "yes").when(cc <= rc, "no")


def prior_box_from_area(w, h, median_area_frac: Column, aspect: float = 1.0) -> Column:
    """Centred box of the set's median area."""
    w, h = dbl(w), dbl(h)
    a = median_area_frac * w * h
    bw = F.sqrt(a * F.lit(aspect))
    bh = F.when(bw > 0, a / bw).otherwise(0.0)
    return box(w / 2 - bw / 2, h / 2 - bh / 2, w / 2 + bw / 2, h / 2 + bh / 2)


def prior_box_from_side(w, h, median_side_frac: Column) -> Column:
    """Centred square of the set's median longer side."""
    w, h = dbl(w), dbl(h)
    s = median_side_frac * F.greatest(w, h)
    return box(w / 2 - s / 2, h / 2 - s / 2, w / 2 + s / 2, h / 2 + s / 2)


def edit_window(hole: Column, w, h, factor: float = WINDOW_FACTOR, min_side: int = WINDOW_MIN_SIDE,
                max_side: int = WINDOW_MAX_SIDE, strict: bool = True) -> Column:
    """Square window around a hole: a multiple of its longer side within limits, slid inside
    the frame. A hole the window cannot cover is an error when ``strict``, else null."""
    side = F.least(F.lit(float(max_side)), F.greatest(F.lit(float(min_side)), F.lit(factor) * longer_side(hole)))

    def axis(centre, limit):
        span = F.least(F.bround(side), dbl(limit))
        lo = F.greatest(F.lit(0.0), F.least(F.bround(centre - span / 2), dbl(limit) - span))
        return lo, lo + span

    x0, x1 = axis((hole["x0"] + hole["x1"]) / 2, w)
    y0, y1 = axis((hole["y0"] + hole["y1"]) / 2, h)
    win = box(x0, y0, x1, y1)
    failed = F.raise_error(F.lit("the hole does not fit in its window")) if strict else F.lit(None)
    return F.when(window_contains(win, hole), win).otherwise(failed.cast("struct<x0:double,y0:double,x1:double,y1:double>"))


def window_contains(win: Column, b: Column) -> Column:
    e = F.lit(1e-6)
    return (b["x0"] >= win["x0"] - e) & (b["y0"] >= win["y0"] - e) & (b["x1"] <= win["x1"] + e) & (b["y1"] <= win["y1"] + e)


def tight_crop(region: Column, w, h, dilation: float = TIGHT_DILATION, min_side: int = TIGHT_MIN_SIDE) -> Column:
    """Region grown by half its size, at least 256 px on the longer side, slid inside."""
    sw, sh = width(region) * (1 + dilation), height(region) * (1 + dilation)
    grow = F.when(F.greatest(sw, sh) < min_side, F.lit(float(min_side)) / F.greatest(sw, sh)).otherwise(1.0)

    def axis(centre, extent, limit):
        span = F.least(extent, dbl(limit))
        lo = F.least(F.greatest(F.lit(0.0), centre - span / 2), dbl(limit) - span)
        return lo, lo + span

    x0, x1 = axis((region["x0"] + region["x1"]) / 2, sw * grow, w)
    y0, y1 = axis((region["y0"] + region["y1"]) / 2, sh * grow, h)
    return box(x0, y0, x1, y1)


def closeup(b: Column, w, h, pad: float = CLOSEUP_PAD) -> Column:
    """Integer crop with a quarter of the box as context on each side, clipped."""
    pw, ph = F.greatest(width(b), F.lit(1.0)) * pad, F.greatest(height(b), F.lit(1.0)) * pad

    def trunc(v):
        return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double")

    zero = F.lit(0.0)
    return box(F.greatest(zero, trunc(b["x0"] - pw)), F.greatest(zero, trunc(b["y0"] - ph)),
               F.least(dbl(w), trunc(b["x1"] + pw) + 1), F.least(dbl(h), trunc(b["y1"] + ph) + 1))


def shown_crop(b: Column, w, h, factor: float = SHOWN_CROP_FACTOR) -> Column:
    """Centred square crop of 1.5 times the longer side, clipped to at least one pixel."""
    side = F.greatest(F.lit(8.0), F.lit(factor) * longer_side(b))

    def axis(centre, limit):
        lo = F.greatest(F.lit(0.0), F.least(F.bround(centre - side / 2), F.greatest(F.lit(0.0), dbl(limit) - 1)))
        hi = F.least(dbl(limit), F.greatest(lo + 1, F.bround(centre + side / 2)))
        return lo, hi

    x0, x1 = axis((b["x0"] + b["x1"]) / 2, w)
    y0, y1 = axis((b["y0"] + b["y1"]) / 2, h)
    return box(x0, y0, x1, y1)


def tile_starts(length: Column, tile: int) -> Column:
    """Start offsets covering ``length``; the last tile is pulled back to the edge."""
    n = F.ceil(length / F.lit(tile)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
                         lambda i: F.least(i * tile, F.greatest(length.cast("int") - tile, F.lit(0))))
    return F.array_distinct(starts)


def shrink_to_pixels(w: Column, h: Column, cap: int = PIXEL_CAP) -> tuple[Column, Column]:
    """Downscale-only size under a pixel count."""
    s = F.sqrt(F.lit(float(cap)) / (w * h).cast("double"))
    over = w * h > cap

    def side(v):
        return F.when(over, F.greatest(F.lit(1), F.bround(v * s).cast("int"))).otherwise(v.cast("int"))

    return side(w), side(h)


def shrink_to_side(w: Column, h: Column, px: int) -> tuple[Column, Column]:
    """Downscale-only size under a longer side."""
    s = F.lit(float(px)) / F.greatest(w, h).cast("double")
    over = F.greatest(w, h) > px

    def side(v):
        return F.when(over, F.greatest(F.lit(1), F.bround(v * s).cast("int"))).otherwise(v.cast("int"))

    return side(w), side(h)


def visual_tokens(w: Column, h: Column, cap: int = PIXEL_CAP, cell: int = TOKEN_CELL) -> Column:
    cw, ch = shrink_to_pixels(w, h, cap)
    return (F.ceil(cw / F.lit(cell)) * F.ceil(ch / F.lit(cell))).cast("long")


def centre_distance(b: Column, w, h) -> Column:
    """Distance of the box centre from the image centre as a share of the diagonal."""
    w, h = dbl(w), dbl(h)
    dx, dy = (b["x0"] + b["x1"]) / 2 - w / 2, (b["y0"] + b["y1"]) / 2 - h / 2
    diag = F.sqrt(w * w + h * h)
    return F.when(diag > 0, F.sqrt(dx * dx + dy * dy) / diag).otherwise(0.0)


def area_ratio(candidate_area: Column, referent_area: Column) -> Column:
    return F.when(referent_area > 0, candidate_area / referent_area).otherwise(F.lit(float("inf")))


def fields(b: Column, prefix: str = "") -> list[Column]:
    """The four coordinates as flat, aliased columns."""
    return [b[k].alias(f"{prefix}{k}") for k in ("x0", "y0", "x1", "y1")]
