"""Spelling variants: which words of a vocabulary differ by one code point, and the form each one stands for.

Words of lengths L and L + 1 meet where they agree outside one of three windows of L (one error leaves two thirds
untouched), so that only words that share that much of their letters are looked at together. Such a family is
indexed by bit sets: for each place of the window and each letter, which words have that letter there. A word is
then looked up letter by letter with three sets that move on together - no error so far, one letter replaced, one
letter put in (read one place further on) - so that one machine operation advances 64 words at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import lower_ascii, written
from plumbline.session import broadcast_if_small

#: Letters that make up words; only A-Z are lower-cased.
RUN = r"([A-Za-zÀ-ÿ]++)"
MIN_LETTERS = 6
MIN_COUNT = 5
#: A form is at least so many times as frequent.
RATIO = 5
#: Of the words of all documents one in so many loses a letter, chosen by crc32.
LOSSES = 199
#: Windows of a word; one error lies in one of them.
WINDOWS = 3
#: Words in one index. A larger family is indexed in blocks, and each of its words is looked up in all of them.
BLOCK = 1 << 14


def runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", losses: int = LOSSES, least: int = 1) -> DataFrame:
    """``word``: the runs of letters of all texts with at least ``least`` letters, A-Z lower-cased. Where
    ``losses`` divides h = crc32 of ``<doc_id>:<run>``, the run's letter at h modulo its length is left out.

    A missing or empty text has no runs; a missing id is written as nothing."""
    found = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(lower_ascii(F.col(text).cast("string")), F.lit(RUN), F.lit(1))).alias("run"))
    found = found.where(F.length("run") >= least)
    h = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    hit = found.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return hit.select(F.when(F.col("h") % losses == 0, short).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def vocabulary(words: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word`` and ``n``: the words long and frequent enough. Counts are combined before the shuffle."""
    return words.where(F.length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _families(words: DataFrame, min_letters: int) -> DataFrame:
    """One row per word, length class and window: what lies before and after the window, and the window."""
    m = F.length("word")
    classes = F.explode(F.filter(F.array(F.struct(m.alias("base"), F.lit(0).alias("more")), F.struct((m - 1).alias("base"), F.lit(1).alias("more"))), lambda c: c["base"] >= min_letters)).alias("c")
    each = words.select("word", "n", classes).select("word", "n", "c.base", "c.more").withColumn("window", F.explode(F.array(*[F.lit(i) for i in range(WINDOWS)])))
    edge = lambda i: F.expr(f"cast(({i}) * base div {WINDOWS} as int)")
    each = each.withColumn("from", edge("window")).withColumn("to", edge("window + 1") + F.col("more"))
    word = F.col("word")
    return each.select("base", "window", word.substr(F.lit(1), F.col("from")).alias("head"), word.substr(F.col("to") + 1, F.length("word")).alias("tail"),
                       word.substr(F.col("from") + 1, F.col("to") - F.col("from")).alias("middle"), "more", "n")


_FAMILY = ["base", "window", "head", "tail"]
_NEAR = "word string, near string, near_n long"


class _Index:
    """Bit sets over the words of a family: at each place of the window, which words have a letter."""

    def __init__(self, width: int):
        self.width, self.middles, self.counts = width, [], []
        self.places: list[dict[str, int]] = [{} for _ in range(width + 2)]
        self.longer = self.all = 0

    def add(self, middle: str, n: int) -> None:
        bit = 1 << len(self.middles)
        self.middles.append(middle)
        self.counts.append(n)
        self.all |= bit
        if len(middle) > self.width:
            self.longer |= bit
        for place, letter in zip(self.places, middle):
            place[letter] = place.get(letter, 0) | bit

    def near(self, middle: str) -> int:
        """The words that differ from one of this width by a replaced letter or by one letter more."""
        same, replaced, more = self.all, 0, self.all
        for j, letter in enumerate(middle):
            here = self.places[j].get(letter, 0)
            more = (more | same) & self.places[j + 1].get(letter, 0)
            replaced = replaced & here | same & ~here
            same &= here
        return replaced & ~self.longer | (more | same) & self.longer


def _members(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _agree(a: str, b: str) -> int:
    """How many letters two words have in common at their beginning."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of families that come one after the other, each with the words of its index first. A pair is
    told in the window that holds the first letter in which its words differ."""
    family, index, waiting = None, None, []
    out: tuple[list, list, list] = ([], [], [])

    def tell(word: str, near: str, n: int) -> None:
        out[0].append(word)
        out[1].append(near)
        out[2].append(n)

    def look_up(middle: str, n: int) -> None:
        base, window, head, tail = family[:4]
        start, stop = window * base // WINDOWS, (window + 1) * base // WINDOWS
        for i in _members(index.near(middle)):
            other = index.middles[i]
            at = min(start + _agree(middle + tail, other + tail), base - 1)
            if start <= at < stop:
                tell(head + middle + tail, head + other + tail, index.counts[i])
                if len(other) > len(middle):
                    tell(head + other + tail, head + middle + tail, n)

    def settle() -> None:
        for x in waiting:
            look_up(*x)
        waiting.clear()

    def flush() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "near_n"])
        for x in out:
            x.clear()
        return batch

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*_FAMILY, "block", "member", "middle", "more", "n")]
        for base, window, head, tail, block, member, middle, more, n in zip(*columns):
            key = (base, window, head, tail, block)
            if key != family:
                if family is not None:
                    settle()
                family, index = key, _Index((window + 1) * base // WINDOWS - window * base // WINDOWS)
            if member:
                index.add(middle, n)
                if not more:
                    waiting.append((middle, n))
            else:
                settle()
                look_up(middle, n)
            if len(out[0]) >= 1 << 14:
                yield flush()
    if family is not None:
        settle()
    yield flush()


def near_words(words: DataFrame, min_letters: int = MIN_LETTERS, block: int = BLOCK) -> DataFrame:
    """``word``, ``near``, ``near_n``: all ordered pairs of words of ``words`` (``word``, ``n``; each word once) that
    differ by exactly one inserted, deleted or replaced code point. ``min_letters`` is the length of the shortest
    word, three at least.

    A family of more than ``block`` words is dealt to blocks by the hash of its words, so that one index stays small."""
    rows = _families(words, min_letters)
    large = rows.groupBy(*_FAMILY).agg(F.count("*").alias("size")).where(F.col("size") > block)
    large = broadcast_if_small(written(large.select(*_FAMILY, F.expr(f"cast(ceil(size / {block}) as int)").alias("blocks")), "large-families"))
    rows = rows.join(large, _FAMILY, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("middle"), F.col("blocks")).cast("int"))
    # Of the words of the shorter length all blocks get a copy to look up; others are in their own index only.
    to = F.when(F.col("more") == 1, F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select(*_FAMILY, F.explode(to).alias("block"), "own", "middle", "more", "n").withColumn("member", F.col("block") == F.col("own"))
    rows = rows.repartition(*_FAMILY, "block").sortWithinPartitions(*_FAMILY, "block", F.desc("member"))
    return rows.select(*_FAMILY, "block", "member", "middle", "more", "n").mapInArrow(_pairs, _NEAR)


def _roots(links: DataFrame) -> DataFrame:
    """``word``, ``root`` of all words that have a form: pointers are doubled until none changes."""
    ends = written(links.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "forms")
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = written(ends.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        ends = step.select("word", "root")
        if step.where("moved").limit(1).count() == 0:
            return ends


def forms(words: DataFrame, ratio: int = RATIO, min_letters: int = MIN_LETTERS) -> DataFrame:
    """``word``, ``n``, ``n_near`` (near words), ``form`` (the most frequent near word, of equal ones the smallest, if
    it is ``ratio`` times as frequent), ``form_n`` and ``root`` (the last of the forms, or the word itself)."""
    words = written(words, "vocabulary")
    near = near_words(words, min_letters).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best: Column = -F.col("best.less")
    links = words.join(near, "word", "left").withColumn("enough", best >= ratio * F.col("n"))
    links = written(links.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("enough"), F.col("best.near")).alias("form"), F.when(F.col("enough"), best).alias("form_n")), "links")
    return links.join(_roots(links), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per word of the documents' vocabulary: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Missing and empty texts have no words and other columns are left out, whatever their names. Repeated rows count
    again; a text of any length is one row of runs. Of equally frequent near words the smallest in code-point order
    is the form. An empty table gives an empty result."""
    out = forms(vocabulary(runs(docs, text, doc_id, least=MIN_LETTERS)))
    return out.select("word", "form", "root", "n", "n_near", "form_n")
