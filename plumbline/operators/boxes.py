"""DataFrame jobs over box tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators.ranks import exact_quantiles
from plumbline.session import broadcast_if_small


def pool_to_items(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """Normalised boxes to pixels of their image; images without a row in ``images`` are left
    out. ``labels`` is the image's sorted distinct labels as one text.

    Labels are aggregated per image first (map-side combined), then the image facts and the
    label text travel with one join on the image key.
    """
    labels = boxes.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_set("label")), "; ").alias("labels"))
    facts = images.join(labels, "image_id")
    b = G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return (boxes.join(facts, "image_id")
            .select("image_id", "label", "labels", "w", "h",
                    G.box(b["x0"] * F.col("w"), b["y0"] * F.col("h"), b["x1"] * F.col("w"), b["y1"] * F.col("h")).alias("box")))


def convention_probe(pairs: DataFrame, keys: list[str], frame_ratio: Column) -> DataFrame:
    """Median ratio of paired coordinates (``small`` over ``big``) and the frame it implies."""
    coords = ("x0", "y0", "x1", "y1")
    both = F.arrays_zip(F.array(*[F.col(f"big.{c}") for c in coords]).alias("big"),
                        F.array(*[F.col(f"small.{c}") for c in coords]).alias("small"))
    long = pairs.select(*keys, F.explode(both).alias("v")).select(*keys, F.col("v.big").alias("big"), F.col("v.small").alias("small"))
    usable = long.filter("big > 0")
    largest = usable.groupBy(*keys).agg(F.max(F.greatest("big", "small")).alias("largest"))
    stats = exact_quantiles(usable, keys, F.col("small") / F.col("big"), {"ratio": 0.5}).join(largest, keys)
    return stats.withColumn("convention", G.probe_convention(F.col("ratio"), frame_ratio, F.col("largest")))


def overlapping_pairs(df: DataFrame, image: str, iid: str, box: str, w: int, h: int, cell: int = 128) -> DataFrame:
    """Pairs of boxes of one image that overlap strictly, each pair once.

    A grid join: every box is put in the cells it touches and pairs meet on (image, cell), so
    a crowded image is spread over its cells instead of being expanded to all its pairs. A
    pair sharing several cells is kept only in the cell of its intersection's top-left corner.
    """
    def cells(lo, hi):
        return F.sequence(F.floor(lo / cell).cast("int"), F.greatest(F.floor(lo / cell), F.ceil(hi / cell) - 1).cast("int"))

    b = F.col(box)
    grid = (df.select(F.col(image), F.col(iid).alias("i"), b.alias("b"))
            .withColumn("gx", F.explode(cells(F.col("b.x0"), F.col("b.x1"))))
            .withColumn("gy", F.explode(cells(F.col("b.y0"), F.col("b.y1")))))
    left = grid.select(image, "gx", "gy", F.col("i").alias(f"a_{iid}"), F.col("b").alias("a_box"))
    right = grid.select(image, "gx", "gy", F.col("i").alias(f"b_{iid}"), F.col("b").alias("b_box"))
    home_x = F.floor(F.greatest(F.col("a_box.x0"), F.col("b_box.x0")) / cell)
    home_y = F.floor(F.greatest(F.col("a_box.y0"), F.col("b_box.y0")) / cell)
    return (left.join(right, [image, "gx", "gy"])
            .filter((F.col(f"a_{iid}") < F.col(f"b_{iid}")) & G.overlap(F.col("a_box"), F.col("b_box"))
                    & (F.col("gx") == home_x) & (F.col("gy") == home_y))
            .drop("gx", "gy"))


def prior_boxes(sizes: DataFrame, gts: DataFrame) -> DataFrame:
    """Centred prior boxes for every (w, h), from the medians of a set of ground-truth boxes."""
    b = F.col("box")
    by_area = exact_quantiles(gts, [], G.area(b) / (F.col("w") * F.col("h")).cast("double"), {"median_area": 0.5})
    by_side = exact_quantiles(gts, [], G.longer_side(b) / F.greatest("w", "h").cast("double"), {"median_side": 0.5})
    medians = by_area.drop("n").join(F.broadcast(by_side.drop("n")))
    # one row by construction, so a broadcast of fixed size
    return (sizes.join(F.broadcast(medians))
            .withColumn("area_prior", G.prior_box_from_area(F.col("w"), F.col("h"), F.col("median_area")))
            .withColumn("side_prior", G.prior_box_from_side(F.col("w"), F.col("h"), F.col("median_side")))
            .drop("median_area", "median_side"))


def tiles(images: DataFrame, tile: int) -> DataFrame:
    """One row per tile covering each image at native resolution."""
    t = F.lit(tile)
    return (images.withColumn("tx", F.explode(G.tile_starts(F.col("w"), tile)))
            .withColumn("ty", F.explode(G.tile_starts(F.col("h"), tile)))
            .withColumn("tx1", F.least(F.col("tx") + t, F.col("w")))
            .withColumn("ty1", F.least(F.col("ty") + t, F.col("h"))))


def point_grid(images: DataFrame, n: int) -> DataFrame:
    """n x n prompt points at cell centres of every image."""
    step = F.lit(1.0 / n)
    return (images.withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .withColumn("px", (F.col("gx") + 0.5) * step * F.col("w"))
            .withColumn("py", (F.col("gy") + 0.5) * step * F.col("h")))


def matching_quantities(cands: DataFrame, image: str, w, h) -> DataFrame:
    """Area ratio and signed centre-distance difference of each candidate to its referent."""
    facts = cands.withColumn("a", G.area(F.col("box"))).withColumn("d", G.centre_distance(F.col("box"), w, h))
    ref = facts.filter("is_referent").select(image, F.col("a").alias("ref_a"), F.col("d").alias("ref_d"))
    return (facts.filter(~F.col("is_referent")).join(broadcast_if_small(ref), image)
            .withColumn("ratio", G.area_ratio(F.col("a"), F.col("ref_a")))
            .withColumn("delta", F.col("d") - F.col("ref_d")))


def image_profile(df: DataFrame, image: str, label: str, order: str, fields: list[str], extra: dict[str, Column]) -> DataFrame:
    """Per image: sorted distinct labels, its boxes as an ordered array (the row of one image,
    bounded by what an annotator draws), counts and further aggregates."""
    boxes = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *fields)))
    return df.groupBy(image).agg(F.array_sort(F.collect_set(label)).alias("labels"), F.count("*").alias("n_boxes"), boxes.alias("boxes"), *[v.alias(k) for k, v in extra.items()])


#: Columns of a box's cell.
CELL = ("_gx", "_gy")


def in_cells(df: DataFrame, box: str, cell: int = 128, keep: bool = False) -> DataFrame:
    """Each row once for every cell that its box touches; ``keep``: rows without a box once, in no cell."""
    explode = F.explode_outer if keep else F.explode

    def cells(lo, hi):
        return F.sequence(F.floor(lo / cell).cast("int"), F.greatest(F.floor(lo / cell), F.ceil(hi / cell) - 1).cast("int"))

    b = F.col(box)
    return df.withColumn("_gx", explode(cells(b["x0"], b["x1"]))).withColumn("_gy", explode(cells(b["y0"], b["y1"])))


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], lbox: str, rbox: str, cell: int = 128) -> DataFrame:
    """Pairs of two tables on equal keys whose boxes overlap strictly, each pair once.

    Both sides meet on (keys, cell); a pair is kept in the cell of its intersection's corner."""
    a, b = F.col(lbox), F.col(rbox)
    return (in_cells(left, lbox, cell).join(in_cells(right, rbox, cell), [*keys, *CELL])
            .filter(G.overlap(a, b) & (F.col("_gx") == F.floor(F.greatest(a["x0"], b["x0"]) / cell)) & (F.col("_gy") == F.floor(F.greatest(a["y0"], b["y0"]) / cell)))
            .drop(*CELL))
