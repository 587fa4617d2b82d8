"""Language-model scoring by deleted interpolation.

The probability of a word after another is a mixture of the maximum-likelihood estimates of bigram and unigram
and of a uniform one, c(h,w)/c(h), c(w)/N and 1/(V+1). The weights depend on how frequent the context h is (one
bucket per power of two; only contexts never seen mix the latter two). They are learned by
expectation-maximisation on held-out counts: each training token is held out in turn, so its counts, and the
context's that decides the bucket, are taken less one.

Counts cover all training texts. What is frequent is looked up in lists that are bounded by their threshold (at
most ``FREQUENT`` words can each be more than one in ``FREQUENT`` tokens); everything else meets its counts in
shuffles of (word or word pair, document) rows, where a key's rows lie together in order: tokens after a word that
is not frequent by that word first, then tokens that are not frequent by themselves. Word pairs of many documents
are counted in a scan of their own and need no shuffle, so no key gathers a large part of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import NO_ID, in_fold, key_id, whole, written
from plumbline.llm.words import Words, blocks, id_column, int64, mix

HELD_OUT_FOLDS = 10
#: A word that makes up more than one token in FREQUENT is looked up; so there are at most FREQUENT of them.
FREQUENT = 1 << 18
#: If a number, only words that make up more than one token in CONTEXTS are contexts; None: every word is.
CONTEXTS: int | None = None
#: A word pair found in this share of a block's texts is counted in advance.
COMMON_PAIR = 1 / 64
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_EM_ROUNDS = 60
_PAIR = np.int64(1) << np.int64(62)
_N = (1 << 31) - 1
_BLOCK = 1 << 22


@dataclass
class Counts:
    total: int  # N
    distinct: int  # V
    texts: int
    words: np.ndarray  # sorted hashes of frequent words
    uses: np.ndarray
    context: np.ndarray  # per frequent word: its context number or -1
    context_uses: np.ndarray  # per context number; the last is the start of a text
    pairs: np.ndarray  # sorted (context number, frequent word) codes counted in advance
    pair_uses: np.ndarray
    every: bool  # words that are not frequent are contexts as well


class _Tokens:
    """Tokens of a block: hash, text and hash of the token before."""

    def __init__(self, column: pa.Array):
        w = Words(column)
        n = np.diff(w.first) + 1
        self.doc = np.repeat(np.arange(len(n)), n)
        self.hash = np.full(len(self.doc), END)
        self.hash[np.arange(len(w.hash)) + w.doc] = w.hash
        self.before = np.empty_like(self.hash)
        self.before[1:] = self.hash[:-1]
        self.before[np.cumsum(n) - n] = START
        self.size = n


def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Position of each x among sorted keys, -1 if it is not there."""
    out = np.full(len(x), -1, np.int64)
    if len(keys) and len(x):
        i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        ok = keys[i] == x
        out[ok] = i[ok]
    return out


def _ids(c: Counts, t: _Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Frequent-word number and context number of each token (-1: none)."""
    word = _find(c.words, t.hash)
    context = np.full(len(word), -1, np.int64)
    first = np.cumsum(t.size) - t.size
    start = np.zeros(len(word), bool)
    start[first] = True
    known = np.flatnonzero(~start)
    known = known[word[known - 1] >= 0]
    context[known] = c.context[word[known - 1]]
    context[start] = len(c.context_uses) - 1
    return word, context


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one block's words (kind 0), and its common pairs (kind 1)."""
    for batch in batches:
        for b in blocks(batch, 1, _BLOCK):
            t = _Tokens(b.column(1))
            key, n = np.unique(t.hash, return_counts=True)
            common, texts = np.unique(_distinct_pairs(t), return_counts=True)
            common = common[texts >= max(2, COMMON_PAIR * b.num_rows)]
            cols = (np.append(key, common), np.append(n, np.ones(len(common), np.int64)), np.append(np.zeros(len(key), np.int32), np.ones(len(common), np.int32)))
            yield pa.record_batch([pa.array(int64(cols[0])), pa.array(cols[1]), pa.array(cols[2].astype(np.int32))], names=["key", "n", "kind"])


def _pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(3) ^ word)


def _distinct_pairs(t: _Tokens) -> np.ndarray:
    """Each pair of neighbours once per text."""
    h = _pair_hash(t.before, t.hash)
    order = np.lexsort((h, t.doc))
    h, doc = h[order], t.doc[order]
    return h[np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))]


def _advance(c: Counts, wanted: np.ndarray):
    """Uses of the wanted pairs (kind 1), and of frequent words without a context (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = np.zeros(len(c.words) + 1, np.int64)
        codes, uses = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for b in blocks(batch, 1, _BLOCK):
                t = _Tokens(b.column(1))
                word, context = _ids(c, t)
                if not c.every:
                    alone += np.bincount(word[(context < 0) & (word >= 0)], minlength=len(alone))
                at = np.flatnonzero((context >= 0) & (word >= 0))
                at = at[_find(wanted, _pair_hash(t.before[at], t.hash[at])) >= 0]
                code = np.append(codes, context[at] << 32 | word[at])
                codes, back = np.unique(code, return_inverse=True)
                uses = np.bincount(back, weights=np.append(uses, np.ones(len(at))), minlength=len(codes)).astype(np.int64)
        some = np.flatnonzero(alone)
        yield pa.record_batch([pa.array(np.append(some, codes)), pa.array(np.append(alone[some], uses)), pa.array(np.append(np.zeros(len(some), np.int32), np.ones(len(codes), np.int32)).astype(np.int32))], names=["key", "n", "kind"])

    return run


def gather(train: DataFrame) -> tuple[Counts, dict[int, int]]:
    """Counts of ``train`` (``id``, ``text``), and uses of frequent words without a context."""
    rows = written(train.mapInArrow(_unigrams, "key long, n long, kind int").groupBy("kind", "key").agg(F.sum("n").alias("n")), "unigrams")
    words = rows.where("kind = 0")
    total, distinct = (x or 0 for x in words.agg(F.sum("n"), F.count(F.lit(1))).first())
    end = int(int64(np.array([END]))[0])
    top = words.where((F.col("n") * FREQUENT > total) | (F.col("key") == end)).select("key", "n").toPandas()  # at most FREQUENT + 1 rows
    keys, uses = top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    keys, uses = keys[order], uses[order]
    texts = int(uses[np.flatnonzero(keys == END)].sum())
    own = (keys != END) & (CONTEXTS is None or uses * CONTEXTS > total)
    context = np.where(own, np.cumsum(own) - 1, -1)
    c = Counts(total, distinct, texts, keys, uses, context, np.append(uses[own], texts), np.empty(0, np.int64), np.empty(0, np.int64), CONTEXTS is None)
    # Pairs common in some block. There are at most 64 times as many as pairs in a text, for each block; those of
    # several blocks are the same ones again.
    wanted = np.sort(rows.where("kind = 1").select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64))
    more = train.mapInArrow(_advance(c, wanted), "key long, n long, kind int").groupBy("kind", "key").agg(F.sum("n").alias("n")).toPandas()
    pairs = more[more["kind"] == 1].sort_values("key")
    c.pairs, c.pair_uses = pairs["key"].to_numpy(np.int64), pairs["n"].to_numpy(np.int64)
    alone = more[more["kind"] == 0]
    return c, dict(zip(alone["key"].tolist(), alone["n"].tolist()))


def _rows(c: Counts, after_rare: bool):
    """(key, other part of the pair, training or held-out uses, text) of tokens whose counts are not in the lists:
    ``after_rare``, those after a context that is not frequent, by context; else the others, by word or pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, 1):
                t = _Tokens(b.column(1))
                word, context = _ids(c, t)
                if after_rare:
                    at = np.flatnonzero(context < 0)
                elif c.every:
                    at = np.flatnonzero(context >= 0)
                else:
                    at = np.flatnonzero((word < 0) | (context >= 0))
                if not after_rare:
                    at = at[(word[at] < 0) | (_find(c.pairs, context[at] << 32 | word[at]) < 0)]
                # Equal pairs of a text next to each other, once.
                pair = mix(_pair_hash(t.before[at], t.hash[at]) ^ mix(t.doc[at].astype(np.uint64)))
                order = np.argsort(pair)
                pair = pair[order]
                first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, np.int64)
                n = np.diff(np.append(first, len(pair)))
                at = at[order[first]]
                doc, word, context = t.doc[at], word[at], context[at]
                if after_rare:
                    key, sub = int64(t.before[at] >> np.uint64(2)), int64(t.hash[at])
                else:
                    key, sub = np.where(word < 0, int64(t.hash[at] >> np.uint64(2)), _PAIR | context << 20 | np.maximum(word, 0)), context
                train = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)[doc]
                yield pa.record_batch([pa.array(key), pa.array(sub), pa.array(train << 62 | n), pa.array(id_column(b.column(0))[doc])], names=["key", "sub", "tag", "id"])

    return run


def _by_key(done):
    """``done`` of rows sorted by (key, sub), whole keys at a time. The rows of one key are at most as many as a word
    that is not frequent, or a pair that is not common, has uses; those of the open key wait for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[list[np.ndarray]] = []
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(4)]
            if len(rows[0]) == 0:
                continue
            last = rows[0][-1]
            cut = int(np.searchsorted(rows[0], last, "left"))
            if wait and wait[0][0][0] == last and cut == 0:
                wait.append(rows)
                continue
            head = [np.concatenate(x) for x in zip(*wait, [r[:cut] for r in rows])] if wait else [r[:cut] for r in rows]
            if len(head[0]):
                yield done(*head)
            wait = [[r[cut:] for r in rows]]
        if wait:
            yield done(*[np.concatenate(x) for x in zip(*wait)])

    return run


def _training_uses(key: np.ndarray, sub: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the training uses of its key, and of its key and sub."""
    new = np.append(True, key[1:] != key[:-1])
    group = np.cumsum(new) - 1
    part = np.cumsum(np.append(True, new[1:] | (sub[1:] != sub[:-1]))) - 1
    n = (tag & _N) * (tag >> 62)
    return tuple(np.bincount(x, weights=n).astype(np.int64)[x] for x in (group, part))


def _after_rare(c: Counts):
    """Of rows by context: those of frequent words with all counts (key -1), the others as rows by word that carry
    the uses of their context."""

    def done(key: np.ndarray, sub: np.ndarray, tag: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        uses, both = _training_uses(key, sub, tag)
        word = _find(c.words, sub.view(np.uint64))
        known = word >= 0
        cw = np.where(known, c.uses[word] if len(c.uses) else 0, 0)
        to = np.where(known, -1, int64(sub.view(np.uint64) >> np.uint64(2)))
        zero = lambda x: np.where(known, x, 0)
        cols = (to, np.where(known, 0, -1 - key), np.where(known, 0, tag | uses << 31), ids, zero(uses), cw, zero(both), zero(tag & _N))
        return pa.record_batch([*map(pa.array, cols), pa.array((tag >> 62).astype(bool))], names=["key", "sub", "tag", "id", "ch", "cw", "c2", "n", "train"])

    return _by_key(done)


def _counted(c: Counts):
    """Of rows by word or pair: each with its counts."""

    def done(key: np.ndarray, sub: np.ndarray, tag: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        uses, both = _training_uses(key, sub, tag)
        pair = key >= _PAIR
        word = np.where(pair, (key & ((1 << 20) - 1)), 0)
        uses = np.where(pair, c.uses[word] if len(c.uses) else 0, uses)
        of = np.where(sub >= 0, c.context_uses[np.maximum(sub, 0)], tag >> 31 & _N)
        return pa.record_batch([pa.array(ids), pa.array(of), pa.array(uses), pa.array(np.where(of > 0, both, 0)), pa.array(tag & _N), pa.array((tag >> 62).astype(bool))], names=["id", "ch", "cw", "c2", "n", "train"])

    return _by_key(done)


def bucket(n: np.ndarray) -> np.ndarray:
    """0 for no context, else 1 and more by the power of two."""
    return np.where(n > 0, np.frexp(np.maximum(n, 1).astype(np.float64))[1], 0)


def _weights(cells: list[tuple[int, float, float, float]], p0: float) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) per bucket from (bucket, bigram and unigram probability, tokens)."""
    lam = np.tile(np.array([0.3, 0.6, 0.1]), (65, 1))
    lam[0] = [0.0, 0.9, 0.1]
    table = np.array(cells, np.float64).reshape(-1, 4)
    for k in np.unique(table[:, 0]).astype(int).tolist():
        of = table[table[:, 0] == k]
        p = np.column_stack([of[:, 1:3], np.full(len(of), p0)])
        n = of[:, 3]
        w = lam[k].copy()
        for _ in range(_EM_ROUNDS):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * n[:, None]).sum(axis=0) / n.sum()
        w = np.maximum(w, [0.0 if k == 0 else 1e-9, 1e-9, 1e-6])
        lam[k] = w / w.sum()
    return lam


def _direct(c: Counts, lam: np.ndarray):
    """Sums per text over the tokens whose counts are in the lists, and the number of all tokens."""
    base_floor = np.log10(c.total + 0.1 * (c.distinct + 1)) if c.total else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, 1):
                t = _Tokens(b.column(1))
                word, context = _ids(c, t)
                at = np.flatnonzero(word >= 0)
                i = _find(c.pairs, context[at] << 32 | word[at])
                ok = (i >= 0) if c.every else (context[at] < 0) | (i >= 0)
                at, i = at[ok], i[ok]
                cw = c.uses[word[at]].astype(np.float64)
                con = context[at]
                ch = np.where(con >= 0, c.context_uses[con], 0)
                c2 = np.where(i >= 0, c.pair_uses[i] if len(c.pairs) else 0, 0)
                w = lam[bucket(ch)]
                p = w[:, 0] * c2 / np.maximum(ch, 1) + w[:, 1] * cw / max(c.total, 1) + w[:, 2] / (c.distinct + 1)
                n = len(t.size)
                doc = t.doc[at]
                cols = [id_column(b.column(0)), t.size, np.bincount(doc, minlength=n), np.bincount(doc, np.log10(cw + 0.1) - base_floor, n).astype(np.float64), np.bincount(doc, np.log10(p), n).astype(np.float64)]
                yield pa.record_batch([pa.array(x) for x in cols], names=["id", "n_tokens", "n_known", "base_score", "score"])

    return run


def lm_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = HELD_OUT_FOLDS) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Documents whose id leaves 0 modulo ``folds`` (crc32 of the id as text) are not learned from. A missing or empty
    text is its end alone. Rows that share an id are one document of several texts: one row with the sums. A
    missing id counts as the empty string, which is held out. Without training texts nothing is known and every
    token has the uniform probability of 1. An empty table gives an empty result; other columns are left out."""
    src = docs.select(key_id(doc_id).alias("id"), whole(text).alias("text"), (~in_fold(doc_id, folds)).alias("train"))
    c, alone = gather(src.where("train"))
    counted, keyed = "id long, ch long, cw long, c2 long, n long, train boolean", "key long, sub long, tag long, id long"
    in_order = lambda rows: rows.repartition("key").sortWithinPartitions("key", "sub")
    rows = src.mapInArrow(_rows(c, False), keyed)
    if c.every:
        after = in_order(src.mapInArrow(_rows(c, True), keyed))
        after = written(after.mapInArrow(_after_rare(c), f"{keyed}, ch long, cw long, c2 long, n long, train boolean"), "after-rare")
        rows = rows.unionByName(after.where("key >= 0").select("key", "sub", "tag", "id"))
    rows = written(in_order(rows).mapInArrow(_counted(c), counted), "token-counts")
    if c.every:
        rows = rows.unionByName(after.where("key < 0").select(*rows.columns))

    # Each training token held out in turn: its counts less one. Tokens of like probabilities share a cell.
    n, v = max(c.total, 2), c.distinct + 1
    level = lambda x: F.when(x > 0, F.floor(4 * F.log2(x))).cast("int")
    p2 = F.when(F.col("ch") > 1, (F.col("c2") - 1) / (F.col("ch") - 1)).otherwise(0.0)
    p1 = (F.col("cw") - 1) / (n - 1)
    held = rows.where("train").select(_bucket_of(F.col("ch") - 1).alias("b"), p2.alias("p2"), p1.alias("p1"), "n")
    held = held.groupBy("b", level(F.col("p2")).alias("l2"), level(F.col("p1")).alias("l1")).agg(*[(F.sum(F.col(x) * F.col("n")) / F.sum("n")).alias(x) for x in ("p2", "p1")], F.sum("n").alias("n"))
    cells = [(r["b"], r["p2"], r["p1"], float(r["n"])) for r in held.collect()]  # at most a power of two, by levels of p2 and p1: their logarithms' ranges bound them
    cells += [(0, 0.0, (c.uses[w] - 1) / (n - 1), float(k)) for w, k in alone.items()]
    for code, k in zip(c.pairs.tolist(), c.pair_uses.tolist()):
        ch = int(c.context_uses[code >> 32])
        cells.append((int(bucket(np.array([ch - 1]))[0]), (k - 1) / max(ch - 1, 1), (int(c.uses[code & 0xFFFFFFFF]) - 1) / (n - 1), float(k)))
    lam = _weights(cells, 1 / v)

    w = lambda j: F.element_at(F.array(*[F.lit(float(x)) for x in lam[:, j]]), _bucket_of(F.col("ch")) + 1)
    p = w(0) * F.col("c2") / F.greatest(F.col("ch"), F.lit(1)) + w(1) * F.col("cw") / max(c.total, 1) + w(2) / v
    base = F.log10((F.col("cw") + 0.1) / (c.total + 0.1 * v))
    far = rows.groupBy("id").agg(F.sum(F.when(F.col("cw") > 0, F.col("n")).otherwise(0)).alias("n_known"), F.sum(base * F.col("n")).alias("base_score"), F.sum(F.log10(p) * F.col("n")).alias("score"))
    near = src.select("id", "text").mapInArrow(_direct(c, lam), "id long, n_tokens long, n_known long, base_score double, score double")
    out = near.unionByName(far.withColumn("n_tokens", F.lit(0).cast("long")).select(*near.columns))
    out = out.groupBy("id").agg(*[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")])
    out = out.withColumn("doc_id", F.when(F.col("id") != NO_ID, F.col("id")))
    return out.select("doc_id", in_fold("doc_id", folds).alias("held_out"), "n_tokens", "n_known", F.lit(c.total).cast("long").alias("train_tokens"), "base_score", "score")


def _bucket_of(n: Column) -> Column:
    return F.when(n > 0, F.length(F.bin(n))).otherwise(0)
