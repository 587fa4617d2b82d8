"""Encoding and decoding with merge-type (BPE) SentencePiece vocabularies.

A text's symbols are its characters at first. An agenda holds all pairs of neighbouring symbols that together are a
piece, ordered by the piece's score and then from the left; the best pair is merged, and its new neighbours join the
agenda. Where no piece spans (a space mark after another character, or a character that is part of no longer piece)
pairs can never meet, so a text is cut there first and each distinct stretch is worked out once. What a
batch brings anew is checked against the sentencepiece library.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import blocks

#: Stands for a space in pieces.
MARK = "▁"
#: Stretches up to this length are remembered, and so many of them by one worker.
SHORT, REMEMBERED = 48, 1 << 20
#: The largest vocabulary file that is sent to all executors.
MODEL_BYTES = 64 << 20

# Numbers of the file format: kinds of models and pieces.
BPE = 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + size]
        at += size


class _Known(dict):
    """Ids of stretches; those of a new one are worked out."""

    def __init__(self, work_out):
        self.work_out = work_out

    def __missing__(self, s: str) -> list[int]:
        return self.work_out(s)


class Codec:
    """Encoder and decoder of a vocabulary file's bytes. Vocabularies of other kinds than BPE, without byte pieces,
    with user-defined or unused pieces, or with a normaliser that changes characters raise ValueError."""

    def __init__(self, model: bytes):
        pieces, trainer, normaliser = [], {}, {}
        for field, value in _fields(model):
            if field == 1:
                pieces.append(dict(_fields(value)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        self.pieces = [p[1].decode() for p in pieces]
        kinds = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3, 1) != BPE or {USER, UNUSED} & set(kinds) or kinds.count(BYTE) != 256 or trainer.get(24, 0):
            raise ValueError("only BPE vocabularies with all byte pieces and no user-defined or unused ones are read")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("only vocabularies that leave characters and white space as they are can be read")
        self.prefix = MARK if normaliser.get(3, 1) else ""
        self.end = next(i for i, p in enumerate(self.pieces) if kinds[i] == CONTROL and p == "</s>")
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        score = {p: struct.unpack("<f", pieces[i][2])[0] if 2 in pieces[i] else 0.0 for p, i in self.ids.items() if len(p) > 1}
        order = {v: r for r, v in enumerate(sorted(set(score.values()), reverse=True))}
        #: Of each longer piece: how many scores are better.
        self.rank = {p: order[v] for p, v in score.items()}
        self.byte = [0] * 256
        #: What each id stands for, as bytes; a single byte of a character for byte pieces.
        self.content = []
        for i, (p, kind) in enumerate(zip(self.pieces, kinds)):
            if kind == BYTE:
                self.byte[int(p[3:-1], 16)] = i
            self.content.append({CONTROL: b"", UNKNOWN: " ⁇ ".encode()}.get(kind, bytes([int(p[3:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode()))
        self.is_byte = [kind == BYTE for kind in kinds]
        self.control = [kind == CONTROL for kind in kinds]
        self.controls = {i for i, yes in enumerate(self.control) if yes}
        #: All pairs of characters that are neighbours in some piece.
        self.joined = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        self.stretches = self._stretches()
        self.known = _Known(self._remembered)
        #: Parts worked out since the last check.
        self.fresh: list[tuple[str, list[int]]] = []

    def _stretches(self):
        """A pattern of parts of a text that no piece goes beyond: characters that are part of longer pieces, with
        the space marks before them."""
        if any(p[1] == MARK != p[0] for p in self.joined):
            return re.compile(r"[\s\S]+")
        letters = "".join(map(re.escape, sorted(set("".join(self.joined)) - {MARK})))
        return re.compile(f"{MARK}*[{letters}]+|{MARK}+|[\\s\\S]")

    def merged(self, s: str) -> list[str]:
        """The symbols of a stretch after all merges. The agenda of a short stretch is a list of its pairs' ranks from
        left to right, of which the first smallest is taken; that of a long one is a heap."""
        if len(s) > SHORT:
            return self._merged_by_heap(s)
        rank, none = self.rank.get, len(self.rank)
        symbols = list(s)
        agenda = [rank(a + b, none) for a, b in zip(s, s[1:])]
        while agenda and (best := min(agenda)) < none:
            i = agenda.index(best)
            x = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(x + symbols[i + 1], none)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + x, none)
        return symbols

    def _merged_by_heap(self, s: str) -> list[str]:
        """An entry of the agenda is the rank of a piece's score and the place where the pair begins, as one number."""
        n, rank, shift = len(s), self.rank.get, len(s).bit_length()
        size, before = [1] * n, list(range(-1, n - 1))  # of the symbol that begins at a place (0: none does); where the one before it begins
        agenda = [r << shift | i for i in range(n - 1) if (r := rank(s[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            best = heappop(agenda)
            i = best & ((1 << shift) - 1)
            j = i + size[i]
            # Symbols only grow: a pair that has changed since is another piece or none.
            if j == i or j >= n or rank(s[i : (k := j + size[j])]) != best >> shift:
                continue
            size[i], size[j] = k - i, 0
            if k < n:
                before[k] = i
                if (q := rank(s[i : k + size[k]])) is not None:
                    heappush(agenda, q << shift | i)
            h = before[i]
            if h >= 0 and (q := rank(s[h:k])) is not None:
                heappush(agenda, q << shift | h)
        return [s[i : i + size[i]] for i in range(n) if size[i]]

    def _remembered(self, s: str) -> list[int]:
        """The ids of a stretch, by its parts: between two characters that are neighbours in no piece it is cut."""
        known, joined, start, ids = self.known, self.joined, 0, []
        for i in range(1, len(s) + 1):
            if i < len(s) and s[i - 1 : i + 1] in joined:
                continue
            part, start = s[start:i], i
            own = known.get(part)
            if own is None:
                own = self._ids(part)
                self.fresh.append((part, own))
                if len(part) <= SHORT:
                    known[part] = own
            ids += own
        if len(s) <= SHORT:
            known[s] = ids
        return ids

    def _ids(self, part: str) -> list[int]:
        ids = []
        for x in self.merged(part) if len(part) > 1 else [part]:
            i = self.ids.get(x)
            ids.extend([i] if i is not None else [self.byte[b] for b in x.encode()])
        return ids

    def encode(self, text: str, end: bool = True) -> list[int]:
        """The ids of a text, an end id last. An empty text has the end id only."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = self.stretches.findall(self.prefix + text.replace(" ", MARK)) if text else []
        ids = list(chain.from_iterable(map(self.known.__getitem__, found)))
        if end:
            ids.append(self.end)
        return ids

    def check(self, library) -> None:
        """Compare what has been worked out since the last check with the library's ids. A new line in front keeps
        the library from putting a space mark there, where no piece of the vocabulary holds one."""
        line = "\n" if not any("\n" in p for p in self.joined) else ""
        head = library.encode(line)
        for (part, ids), theirs in zip(self.fresh, library.encode([line + part for part, _ in self.fresh], num_threads=1)):
            if line and theirs != head + ids:
                raise ValueError(f"the library encodes {part!r} as {theirs[len(head):]} and not as {ids}")
        self.fresh.clear()

    def decode(self, ids: list[int]) -> str:
        """The text of some ids. A byte that is no part of a whole character becomes U+FFFD."""
        content = self.content
        while ids and self.control[ids[-1]]:
            ids = ids[:-1]
        first = next((i for i in ids if not self.control[i]), None)
        if first is None:
            return ""
        cut = bool(self.prefix) and not self.is_byte[first] and self.pieces[first].startswith(MARK)
        if self.controls.isdisjoint(ids):  # else bytes on both sides of a control id would run together
            try:
                return b"".join(map(content.__getitem__, ids)).decode()[cut:]
            except UnicodeDecodeError:
                pass
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += content[i]
                continue
            while run:  # whole characters as they are, every other byte by itself
                size = next((k for k in (1, 2, 3, 4) if _is_character(run[:k])), 0)
                out.append(run[:size].decode() if size else "�")
                del run[: size or 1]
            if i is not None:
                out.append(content[i].decode())
        return "".join(out)[cut:]


def _is_character(data: bytearray) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


_codecs: dict[bytes, tuple] = {}


def _codec(model: bytes) -> tuple:
    """One codec and one library processor of a vocabulary in each worker."""
    if model not in _codecs:
        import sentencepiece

        _codecs.clear()
        _codecs[model] = Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    return _codecs[model]


def read_model(path: str) -> bytes:
    """A vocabulary file, read on the driver; it must be small enough to be sent to all executors."""
    with open(path, "rb") as f:
        model = f.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    return model


def encode_and_decode(docs: DataFrame, model: bytes, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``ids`` (end id last) and ``decoded``. Every stretch that a worker
    meets for the first time is checked against the sentencepiece library; a difference is an error.

    A missing text is empty; an empty one has the end id only and decodes to an empty text. Texts are encoded whole.
    Repeated rows are rows like others, an empty table gives an empty result, and other columns are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, library = _codec(shared.value)
        for batch in batches:
            for block in blocks(batch, 1):
                texts = block.column(1).to_pylist()
                ids = [codec.encode(t) for t in texts]
                decoded = [codec.decode(x) for x in ids]
                codec.check(library)
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                yield pa.record_batch([block.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(decoded, pa.string())],
                                      names=["doc_id", "ids", "decoded"])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(coded, "doc_id long, ids array<int>, decoded string")
