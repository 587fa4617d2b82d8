"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark is a stated query set and is taken in blocks of a bounded number of items; the corpus is scanned
for each block and never shuffled. A first scan counts the block's words over all documents. From these counts
follows how often an n-gram (of one to three words) would turn up in a document by chance; the n-grams for which
that is rare are the item's seeds. A second scan looks for seeds, and every place where one is found is aligned
with the item word by word (Smith-Waterman with linear gaps), so that edited and paraphrased copies score by what
they still share. Corpus and benchmark meet in a hash join on seeds inside the scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import union, whole
from plumbline.llm.words import MARKS, Words, blocks, text_bytes

#: Items handled in one scan.
BLOCK_ITEMS = 20_000
#: Expected number of chance finds per document below which an n-gram is a seed.
RARE = 1e-4
SEED_WORDS = (1, 2, 3)
#: Seeds an item has at least (its rarest n-grams), if it has so many n-grams.
MIN_SEEDS = 8
MATCH, MISMATCH, GAP = 2, -1, 1
#: Share of the item's own score at which a document counts as leaking it.
THRESHOLD = 0.5
#: Shorter items have to be found whole.
MIN_WORDS = 8


@dataclass
class Block:
    ids: np.ndarray
    words: list[np.ndarray]
    keys: dict[int, np.ndarray]  # per seed length, sorted seed hashes
    item: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]


def _vocabulary(words: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(words)) if words else np.empty(0, np.uint64)


def _lookup(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions of h that are among the sorted keys."""
    if len(keys) == 0 or len(h) == 0:
        return np.empty(0, np.int64)
    seen = np.zeros(1 << 22, bool)
    seen[keys >> np.uint64(42)] = True
    at = np.flatnonzero(seen[h >> np.uint64(42)])
    i = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    return at[keys[i] == h[at]]


def _word_counts(docs: DataFrame, vocabulary: np.ndarray, text: str) -> tuple[dict[int, int], int, int]:
    """Uses of each word of a bounded vocabulary, of all words, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary) + 2, np.int64)
        for batch in batches:
            for b in blocks(batch, 0):
                h = Words(b.column(0), MARKS, lower=True).hash
                at = _lookup(vocabulary, h)
                total[:-2] += np.bincount(np.searchsorted(vocabulary, h[at]), minlength=len(vocabulary))
                total[-2:] += len(h), b.num_rows
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["w", "n"])

    rows = docs.select(whole(text).alias("text")).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toPandas()
    n = dict(zip(rows["w"].tolist(), rows["n"].tolist()))
    v = len(vocabulary)
    return {int(vocabulary[i]): c for i, c in n.items() if i < v}, n.get(v, 0), n.get(v + 1, 0)


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    w = Words(pa.array([], pa.string()))
    w.hash, w.doc = words, np.zeros(len(words), np.int64)
    return w.grams(n)[0]


def _prepare(ids: np.ndarray, words: list[np.ndarray], counts: dict[int, int], total: int, docs: int) -> Block:
    found: dict[int, list] = {n: [] for n in SEED_WORDS}
    for item, w in enumerate(words):
        if len(w) == 0:
            continue
        logp = np.log(np.array([max(counts.get(int(h), 0), 1) for h in w]) / max(total, 1))
        length = np.log(max(total, 1) / max(docs, 1))
        options = []
        for n in SEED_WORDS:
            chance = np.convolve(logp, np.ones(n), "valid") + length if len(w) >= n else np.empty(0)
            options += [(c, n, i) for i, c in enumerate(chance)]
        options.sort()
        for k, (c, n, i) in enumerate(options):
            if c < np.log(RARE) or k < MIN_SEEDS:
                found[n].append((int(_grams(w[i : i + n], n)[0]), item, i))
    keys, items, offsets = {}, {}, {}
    for n, rows in found.items():
        rows.sort()
        keys[n] = np.array([r[0] for r in rows], np.uint64)
        items[n], offsets[n] = (np.array([r[j] for r in rows], np.int64) for j in (1, 2))
    return Block(ids, words, keys, items, offsets)


def align(item: np.ndarray, passages: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of one item with each of several passages (rows padded to one width): score, and how
    many words of the item and of the passage lie before its end. Row by row over the item; along a row, the
    best of opening a gap at any earlier place is a running maximum."""
    c, width = passages.shape
    step = np.arange(width + 1) * GAP
    inside = np.arange(1, width + 1)[None, :] <= lengths[:, None]
    row = np.zeros((c, width + 1), np.int32)
    best, at_item, at_passage = np.zeros(c, np.int32), np.zeros(c, np.int64), np.zeros(c, np.int64)
    for i, w in enumerate(item):
        new = np.zeros_like(row)
        same = np.where((passages == w) & inside, MATCH, MISMATCH)
        new[:, 1:] = np.maximum(0, np.maximum(row[:, :-1] + same, row[:, 1:] - GAP))
        new = (np.maximum.accumulate(new + step, axis=1) - step).astype(np.int32)
        top = new.argmax(axis=1)
        value = new[np.arange(c), top]
        better = value > best
        best[better], at_item[better], at_passage[better] = value[better], i + 1, top[better]
        row = new
    return best, at_item, at_passage


def _find(block: Block, column: pa.Array) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first byte, byte after the last) of the best place of each item in each text."""
    w = Words(column, MARKS, lower=True)
    where, item, offset = [], [], []
    for n in SEED_WORDS:
        h, at = w.grams(n)
        hit = _lookup(block.keys[n], h)
        lo, hi = np.searchsorted(block.keys[n], h[hit], "left"), np.searchsorted(block.keys[n], h[hit], "right")
        many = hi - lo
        k = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        where.append(np.repeat(at[hit], many))
        item.append(block.item[n][k])
        offset.append(block.offset[n][k])
    where, item, offset = (np.concatenate(x) for x in (where, item, offset))
    if len(where) == 0:
        return []
    size = np.array([len(x) for x in block.words])
    doc = w.doc[where]
    start = where - offset  # where the item would begin
    order = np.lexsort((start, item, doc))
    where, item, doc, start = where[order], item[order], doc[order], start[order]
    # Finds of one item in one text that begin close together form one passage; long chains are cut.
    slack = size[item] // 2 + 4
    cell = (start - w.first[doc]) // np.maximum(slack, 1)
    new = np.ones(len(where), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (cell[1:] != cell[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(where)) - 1
    item, doc, slack = item[begin], doc[begin], slack[begin]
    lo = np.maximum(w.first[doc], start[begin] - slack)
    hi = np.minimum(w.first[doc + 1], start[last] + size[item] + slack)
    out: dict[tuple[int, int], tuple[float, int, int]] = {}
    for it in np.unique(item):
        words = block.words[it]
        rows = np.flatnonzero(item == it)
        for part in np.array_split(rows, -(-len(rows) // 512)):
            length = hi[part] - lo[part]
            cols = lo[part][:, None] + np.arange(length.max())[None, :]
            p = w.hash[np.minimum(cols, len(w.hash) - 1)]
            score, item_end, end = align(words, p, length)
            need = THRESHOLD if len(words) >= MIN_WORDS else 1.0
            for r in np.flatnonzero(score >= need * MATCH * len(words)):
                # The same alignment backwards from its end gives its beginning.
                e = int(end[r])
                back = align(words[: item_end[r]][::-1], p[r : r + 1, :e][:, ::-1], np.array([e]))
                a, z = int(lo[part][r] + e - back[2][0]), int(lo[part][r] + e - 1)
                key = (int(doc[part][r]), int(it))
                value = (float(score[r]) / (MATCH * len(words)), int(w.start[a]), int(w.end[z]))
                if key not in out or value[0] > out[key][0]:
                    out[key] = value
    text_at = text_bytes(column)[1].tolist()
    return [(d, i, s, a - text_at[d], z - text_at[d]) for (d, i), (s, a, z) in out.items()]


def _blocks(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, block_items: int) -> Iterator[Block]:
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), whole(item_text).alias("text")).distinct()
    many = max(1, -(-items.count() // block_items))
    for k in range(many):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(many)) == k).toPandas()  # one bounded block of the query set
        w = Words(pa.array(rows["text"].tolist(), pa.string()), MARKS, lower=True)
        words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        ids = rows["id"].astype("Int64").to_numpy(dtype=object, na_value=None)
        counts, total, n = _word_counts(docs, _vocabulary(words), text)
        yield _prepare(ids, words, counts, total, n)


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per document and item found in it: ``doc_id``, ``item_id``, ``score`` (alignment score over that of
    the item with itself) and the byte range ``start`` to ``end`` in the text.

    Missing texts and items without words match nothing; items repeated with the same id and text count once,
    rows of ``docs`` repeated are rows of their own; ids may be missing and are handed through. An empty corpus or
    benchmark gives an empty result; other columns are left out."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))
    schema = "doc_id long, item_id long, score double, start long, end long"

    def finder(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in blocks(batch, 1):
                    found = _find(block, b.column(1))
                    ids = b.column(0).to_pylist() if found else []
                    cols = [[ids[r[0]] for r in found], [block.ids[r[1]] for r in found], *([r[j] for r in found] for j in (2, 3, 4))]
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "item_id", "score", "start", "end"])

        return run

    return union([src.mapInArrow(finder(b), schema) for b in _blocks(docs, benchmark, text, item_id, item_text, block_items)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns and in the same files: a scan
    without a shuffle. Cases as in ``leaks``."""
    place = docs.columns.index(text)

    def keeper(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in blocks(batch, place):
                    clean = np.ones(b.num_rows, bool)
                    clean[[r[0] for r in _find(block, b.column(place))]] = False
                    yield b.filter(pa.array(clean))

        return run

    out = docs
    for block in _blocks(docs, benchmark, text, item_id, item_text, block_items):
        out = out.mapInArrow(keeper(block), docs.schema)
    return out
