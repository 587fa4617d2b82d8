"""Exact deduplication by content sort.

Rows are dealt to ranges of (opening characters, digest, id) by sampled splitters and sorted externally inside
each range, so equal texts are neighbours wherever they come from; the id in the key lets a group of copies of
any size spread over many ranges. One pass over each sorted range compares whole neighbouring texts and closes
runs of equal ones. Only a run at the edge of a range can go on in the next: those (two per range) are put
together by digest and whole text, and their totals are handed back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import NO_ID, key_id, whole, written

#: Characters of the text at the head of the sort key; splitters are sampled keys and so stay small.
OPENING = 32

_RUNS = "doc_id long, text_sha256 string, keep_id long, group_size long, last boolean, part int, run long, edge boolean, edge_text string"


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of equal neighbouring texts of one sorted range. Ids of the open run are kept until it ends (a run
    is a part of one range, so that is bounded by the range); texts are kept one at a time."""
    part, run, text, sha, ids = TaskContext.get().partitionId(), -1, None, None, []

    def close(edge: bool) -> pd.DataFrame:
        doc = np.concatenate(ids)
        n = len(doc)
        out = pd.DataFrame({"doc_id": doc, "text_sha256": sha, "keep_id": doc[-1], "group_size": n, "last": np.arange(n) == n - 1,
                            "part": np.int32(part), "run": run, "edge": edge, "edge_text": None})
        if edge:
            out["edge_text"] = pd.array([None] * (n - 1) + [text], dtype=object)
        return out

    for f in frames:
        if len(f) == 0:
            continue
        t, s, d = f["text"].to_numpy(), f["sha"].to_numpy(), f["id"].to_numpy()
        new = np.empty(len(f), bool)
        new[0] = text is None or s[0] != sha or t[0] != text
        new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        starts = np.flatnonzero(new)
        done = []
        if len(starts) == 0:
            ids.append(d)
            continue
        if starts[0] > 0:
            ids.append(d[: starts[0]])
        if ids:
            done.append(close(run == 0))
        # All runs that lie within this batch, in one go; the last stays open.
        a, b = starts[:-1], starts[1:]
        if len(a):
            first_edge = run == -1
            size = b - a
            lo, hi = a[0], b[-1]
            block = pd.DataFrame({"doc_id": d[lo:hi], "text_sha256": s[lo:hi], "keep_id": np.repeat(d[b - 1], size), "group_size": np.repeat(size, size),
                                  "last": np.isin(np.arange(lo, hi), b - 1), "part": np.int32(part), "run": np.repeat(run + 1 + np.arange(len(a)), size), "edge": False, "edge_text": None})
            if first_edge:
                block.loc[: size[0] - 1, "edge"] = True
                block["edge_text"] = pd.array([None] * (size[0] - 1) + [t[lo]] + [None] * (hi - lo - size[0]), dtype=object)
            done.append(block)
        run += len(starts)
        z = starts[-1]
        text, sha, ids = t[z], s[z], [d[z:]]
        if done:
            yield pd.concat(done, ignore_index=True)
    if ids:
        yield close(True)


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", normalise: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id`` (largest id among rows of equal text), ``group_size``,
    ``kept`` (one row of each group) and ``text_sha256``.

    ``normalise`` is the text to compare (default: unchanged). A missing text is empty and a missing id counts
    as the smallest. Rows repeated with the same id and text are copies like others: one of them stays. An empty
    table gives an empty result; other columns are left out, whatever their names."""
    value = whole(text) if normalise is None else normalise
    src = docs.select(key_id(doc_id).alias("id"), value.alias("text"))
    src = src.select("id", "text", F.substring("text", 1, OPENING).alias("head"), F.sha2("text", 256).alias("sha"))
    ranges = src.repartitionByRange("head", "sha", "id").sortWithinPartitions("head", "sha", "text", "id")
    runs = written(ranges.select("id", "text", "sha").mapInPandas(_runs, _RUNS), "exact-runs")

    # Two runs per range at most, so this table has at most twice as many rows as there are ranges.
    edges = runs.where(F.col("edge_text").isNotNull()).groupBy("text_sha256", "edge_text").agg(
        F.sum("group_size").alias("n"), F.max("keep_id").alias("keep"), F.max("part").alias("last_part"), F.collect_list(F.struct("part", "run")).alias("at"))
    edges = edges.select("n", "keep", "last_part", F.explode("at").alias("at")).select("at.part", "at.run", "n", "keep", "last_part")
    inside = runs.where(~F.col("edge")).select("doc_id", "keep_id", "group_size", F.col("last").alias("kept"), "text_sha256")
    outside = runs.where("edge").join(edges, ["part", "run"]).select(
        "doc_id", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), (F.col("last") & (F.col("part") == F.col("last_part"))).alias("kept"), "text_sha256")
    out = inside.unionByName(outside)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(known("doc_id").alias("doc_id"), known("keep_id").alias("keep_id"), "group_size", "kept", "text_sha256")
