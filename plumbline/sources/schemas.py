"""Declared schemas and enumerations of the tables that are checked on write and read."""

from __future__ import annotations

from pyspark.sql import types as T

S, B, I, L, D = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType(), T.DoubleType()
BOX = T.ArrayType(D)


def fields(*spec) -> T.StructType:
    """(name, type, nullable) triples; nullable defaults to False."""
    return T.StructType([T.StructField(s[0], s[1], len(s) > 2 and s[2]) for s in spec])


ITEMS = fields(("item_id", S), ("set", S), ("split_half", S, True), ("image_path", S), ("image_sha256", S), ("image_phash", S), ("expr", S), ("gt_boxes_xyxy_px", T.ArrayType(BOX)),
               ("n_gt", I), ("size_bin", S, True), ("dimension", S, True), ("in_kill_set", B), ("dev_slice", S, True), ("pair_id", S, True), ("ceiling_iou_d4", D, True),
               ("downscale_factor_d4", D, True))
OUTPUTS = fields(("run_id", S), ("model_id", S), ("item_id", S), ("condition", S), ("pair_id", S, True), ("abstain_protocol", S), ("prompt_version", S), ("raw_text", S), ("parse_ok", B),
                 ("output_type", S), ("n_boxes", I), ("box_xyxy_px", BOX, True), ("point_xy_px", BOX, True), ("iou_gt", D, True), ("point_in_gt", B, True), ("is_failure", B, True),
                 ("image_px_sent", T.ArrayType(I)), ("latency_ms", L), ("tokens_in", L, True), ("tokens_out", L, True))
IMAGES_CSV = fields(*[(c, S, True) for c in ("ImageID", "License", "Author", "AuthorProfileURL", "OriginalURL", "OriginalLandingURL", "Title")])
BOXES_CSV = fields(("ImageID", S, True), ("LabelName", S, True), ("XMin", D, True), ("XMax", D, True), ("YMin", D, True), ("YMax", D, True), ("IsGroupOf", I, True), ("IsDepiction", I, True),
                   ("Confidence", I, True))
CLASSES_CSV = fields(("LabelName", S, True), ("Class", S, True))
LABEL_LOG = fields(("window_sha256", S, True), ("annotator_id", S, True), ("label", S, True), ("timestamp", S, True), ("sample_stratum", S, True), ("task_id", S, True))

# Allowed values of the enumerated columns.
CONDITIONS = ("ORIGINAL", "REMOVE", "CONTROL_OBJ", "CONTROL_BG", "T_NULL", "T_HEAD", "T_ATTR")
OUTPUT_TYPES = ("box", "point", "set", "none", "invalid", "refusal")
PROTOCOLS = ("primary", "secondary")
SIZE_BINS = ("tiny", "small", "medium", "large", "xl")
ENUMS = {"items": {"size_bin": SIZE_BINS}, "outputs": {"condition": CONDITIONS, "abstain_protocol": PROTOCOLS, "output_type": OUTPUT_TYPES}}
SCHEMAS = {"items": ITEMS, "outputs": OUTPUTS}
