"""Passages repeated across documents: seed and extend.

Seeds: every window of ``window`` words selects one of its short word runs (winnowing: the run of least hash), so
equal windows select equal anchors, and about one anchor in five words is enough. Anchors of all documents are
joined on their hash; those of one document only are put aside.
Extend: an anchor found in several documents is extended to both sides into each of the windows that selected it.
Equal windows are joined on a digest of all their words; a window that also starts in a document with a smaller id
is repeated, and neighbouring repeated windows run together into maximal repeats, which are removed.

Whole copies of a text with a smaller id are found first, by digest: all their windows are repeated, and what they
could tell others the first copy tells as well, so they are not extended.

A document is an id and a version. The version is 0 where all rows of the id have one text, as they nearly always
have, and a hash of the text where they differ; so texts that share an id, or have none, are cut each by its own
places and never share a key.

Every join is one shuffle on the digest followed by a pass over the sorted rows. Before a shuffle each block of
texts keeps one row per digest and settles the others, so that a passage found in a large part of all documents
brings one row per block and not one per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import NO_ID, key_id, whole, written
from plumbline.llm.words import Words, blocks, constants, id_column, int64, mix, text_bytes
from plumbline.session import broadcast_if_small

WINDOW = 13
ANCHOR = 5

#: A place in a document: 32 more bits of a digest and 32 of the position.
_PLACE = np.int64((1 << 32) - 1)
#: Instead of a place: the whole document is a copy.
_COPY = -1
_ROWS = "key long, id long, version long, place long, settled boolean"
_PLACES = "id long, version long, place long"


class _Windows:
    """Windows of some texts (``at``: number of the first word) and the anchors that they select."""

    def __init__(self, column: pa.Array, window: int, anchor: int):
        self.words = w = Words(column, fold=False)
        n, m = len(w.hash), len(w.hash) - window + 1
        if m <= 0:
            self.at = self.selected = np.empty(0, np.int64)
            self.gram = np.empty(0, np.uint64)
            return
        total = np.zeros(n - anchor + 1, np.uint64)
        for i, c in enumerate(constants(anchor, 7)):
            total += w.hash[i : i + n - anchor + 1] * c
        self.gram = mix(total)
        best, pick = self.gram[:m].copy(), np.zeros(m, np.int64)
        for o in range(1, window - anchor + 1):
            less = self.gram[o : o + m] < best
            np.copyto(best, self.gram[o : o + m], where=less)
            pick[less] = o
        self.at = np.flatnonzero(w.doc[:m] == w.doc[window - 1 :])
        self.selected = self.at + pick[self.at]

    def place(self, at: np.ndarray) -> np.ndarray:
        return at - self.words.first[self.words.doc[at]]


def _documents(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Id and version of each text of a block."""
    return id_column(b.column(0)), b.column(2).to_numpy(zero_copy_only=False)


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x) for x in columns], names=["key", "id", "version", "place", "settled"][: len(columns)])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _in_text_order(order: np.ndarray, key: np.ndarray, ids: np.ndarray, version: np.ndarray, place: np.ndarray, settled: np.ndarray, go: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The rows in the order of the texts, where neighbours are alike and compress well. Settled rows need no
    partner and are dealt out evenly; of those, ``go`` names the ones that also meet other blocks."""
    deal = np.where(settled, (ids << 8) ^ version ^ ((place & _PLACE) >> 6), key)
    back = np.argsort(order)
    yield _batch(*(x[back] for x in (deal, ids, version, place, settled)))
    if go is not None and len(go):
        yield _batch(key[go], ids[go], version[go], place[go], np.zeros(len(go), bool))


def _anchors(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, 1):
                x = _Windows(b.column(1), window, anchor)
                at = np.unique(x.selected)
                if len(at) == 0:
                    continue
                ids, version = (c[x.words.doc[at]] for c in _documents(b))
                key, place = int64(x.gram[at]), x.place(at)
                order = np.lexsort((version, ids, key))
                key, ids, version, place = key[order], ids[order], version[order], place[order]
                first = np.flatnonzero(_starts(key))
                size = np.diff(np.append(first, len(key)))
                # Of an anchor in several documents here, one row goes on for documents elsewhere; all are seeds.
                last = first + size - 1
                many = (ids[first] != ids[last]) | (version[first] != version[last])
                yield from _in_text_order(order, key, ids, version, place, np.repeat(many, size), first[many])

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text, keyed by its digest."""
    for batch in batches:
        for b in blocks(batch, 1):
            data, at = text_bytes(b.column(1))
            raw = b"".join(blake2b(data[lo:hi], digest_size=16).digest() for lo, hi in zip(at[:-1], at[1:]))
            h = np.frombuffer(raw, np.uint64).reshape(-1, 2)
            ids, version = _documents(b)
            key, place = int64(h[:, 0].copy()), int64((h[:, 1] >> np.uint64(32)) << np.uint64(32)) | np.arange(len(ids))
            yield from _in_text_order(*_first_settled(key, ids, version, place))


def _first_settled(key: np.ndarray, ids: np.ndarray, version: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows in order of (key, more, id); settled: a smaller id of this block has the same key."""
    more = place >> 32
    order = np.lexsort((ids, more, key))
    key, ids, version, place, more = key[order], ids[order], version[order], place[order], more[order]
    first = _starts(key, more)
    return order, key, ids, version, place, ids > ids[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, id, version): those whose key has several documents, and settled ones. Rows of the open
    key wait only while all are of one document, each place once, so they are no more than it has words."""
    none = np.empty(0, np.int64)
    wait, shared = (none,) * 4, None

    def out(rows: list[np.ndarray], at: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x[at]) for x in rows[1:]], names=["id", "version", "place"])

    for batch in batches:
        *rows, settled = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        if settled.any():
            yield out(rows, settled)
            rows = [x[~settled] for x in rows]
        if len(rows[0]) == 0:
            continue
        rows = [np.concatenate(x) for x in zip(wait, rows)]
        key, ids, version, place = rows
        first = np.flatnonzero(_starts(key))
        last = np.append(first[1:], len(key)) - 1
        many = (ids[first] != ids[last]) | (version[first] != version[last])
        if shared is not None:
            many |= key[first] == shared
        keep = np.repeat(many, last - first + 1)
        if keep.any():
            yield out(rows, keep)
        z = first[-1]
        if many[-1]:
            wait, shared = (none,) * 4, key[z]
        else:
            once = z + np.unique(place[z:], return_index=True)[1]
            wait, shared = tuple(x[once] for x in rows), None


def _candidates(window: int, anchor: int):
    """Windows whose anchor is a seed. Texts come with the places of their seeds."""
    weights = [constants(window, s) for s in (11, 13)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, 1):
                seeds = b.column(3)
                if seeds.null_count == len(seeds):
                    continue
                x = _Windows(b.column(1), window, anchor)
                lists = seeds.fill_null(pa.scalar([], seeds.type))
                many = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(len(lists)), many)
                place = lists.flatten().to_numpy(zero_copy_only=False)
                copy = np.zeros(len(lists), bool)
                copy[doc[place == _COPY]] = True
                own = ~copy[doc]
                chosen = np.zeros(len(x.words.hash) + 1, bool)
                chosen[x.words.first[doc[own]] + place[own]] = True
                at = x.at[chosen[x.selected]]
                if len(at) == 0:
                    continue
                h = []
                for c in weights:
                    total = np.zeros(len(at), np.uint64)
                    for i in range(window):
                        total += x.words.hash[at + i] * c[i]
                    h.append(mix(total))
                ids, version = (c[x.words.doc[at]] for c in _documents(b))
                key, place = int64(h[0]), int64((h[1] >> np.uint64(32)) << np.uint64(32)) | x.place(at)
                yield from _in_text_order(*_first_settled(key, ids, version, place))

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, more, id): those that are not of the first id of their key, and settled ones."""
    last = None
    for batch in batches:
        key, ids, version, place, settled = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        gone = settled.copy()
        at = np.flatnonzero(~settled)
        if len(at):
            k, i, more = key[at], ids[at], place[at] >> 32
            first = _starts(k, more)
            least = i[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))]
            if last is not None and last[:2] == (k[0], more[0]):
                n = int(np.flatnonzero(np.append(first[1:], True))[0]) + 1
                least[:n] = last[2]
            gone[at] = i > least
            last = (k[-1], more[-1], least[-1])
        yield pa.record_batch([pa.array(ids[gone]), pa.array(version[gone]), pa.array(place[gone] & _PLACE)], names=["id", "version", "place"])


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, 1):
                rows = {"text": [], "n_words": [], "n_removed": [], "removed": []}
                texts, starts = b.column(1).to_pylist(), b.column(3).to_pylist()
                for t, s in zip(texts, starts):
                    words = t.encode().split()
                    spans = []
                    if s and _COPY in s:
                        spans = [(0, len(words))] if len(words) >= window else []
                    elif s:
                        at = np.sort(np.array(s, np.int64))
                        cut = np.flatnonzero(np.diff(at) > window)
                        lo, hi = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + window
                        spans = list(zip(lo.tolist(), hi.tolist()))
                    gone = sum(h - l for l, h in spans)
                    left, done = [], 0
                    for l, h in spans:
                        left += words[done:l]
                        done = h
                    rows["text"].append(b" ".join(left + words[done:] if spans else words).decode())
                    rows["n_words"].append(len(words))
                    rows["n_removed"].append(gone)
                    rows["removed"].append([{"start": l, "end": h} for l, h in spans])
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(rows.values(), kinds)]], names=["id", *rows])

    return run


def with_version(docs: DataFrame) -> DataFrame:
    """Adds the ``version`` of each text to rows of ``id`` and ``text``."""
    texts = docs.select("id", F.xxhash64("text").alias("text")).distinct()
    several = written(texts.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("several")), "several-texts")
    version = F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return docs.join(broadcast_if_small(several), "id", "left").select("id", "text", version.alias("version"))


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text`` (kept words joined by one space), ``n_words``, ``n_removed``
    and ``removed`` (maximal ranges of removed words).

    A missing text has no words. A missing id counts as the smallest. Rows with one id do not remove each other's
    words, whether their texts are equal or differ. Texts shorter than a window lose nothing. An empty table
    gives an empty result; other columns are left out."""
    src = with_version(docs.select(key_id(doc_id).alias("id"), whole(text).alias("text")))
    columns = ["id", "text", "version"]
    own = ["id", "version"]

    def placed(rows: DataFrame) -> DataFrame:
        """The texts with the places of their own, each once."""
        return src.join(rows.groupBy(*own).agg(F.collect_set("place").alias("places")), own, "left").select(*columns, "places")

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key", F.shiftright("place", 32), "id").mapInArrow(_repeated, _PLACES)

    anchors = src.select(*columns).mapInArrow(_anchors(window, anchor), _ROWS)
    seeds = anchors.repartition("key").sortWithinPartitions("key", *own).mapInArrow(_shared, _PLACES)
    copies = repeated(src.select(*columns).mapInArrow(_texts, _ROWS)).select(*own).distinct()
    copies = written(copies.withColumn("place", F.lit(_COPY).cast("long")), "copies")
    found = repeated(placed(seeds.unionByName(copies)).mapInArrow(_candidates(window, anchor), _ROWS))
    out = placed(found.unionByName(copies)).mapInArrow(_cut(window), "id long, text string, n_words long, n_removed long, removed array<struct<start:long,end:long>>")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "text", "n_words", "n_removed", "removed")
