"""Seeded, engine-independent pseudo-random numbers built on md5.

Generators that live on the driver or in a task cannot be replayed after an executor is
lost and cannot be repeated in SQL; ``md5(seed:key)`` can, so every "random" choice in the
library is an order over, or arithmetic on, such a hash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers hashed at once.
AT_ONCE = 8192
# The first state of md5, the rotations and constants of its 64 steps.
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def seeded_hex(seed, *keys) -> Column:
    """32 hex digits for (seed, keys): a uniform order key."""
    return F.md5(F.concat_ws(":", _text(seed), *[_text(k) for k in keys]))


def seeded_int(seed, *keys) -> Column:
    """Uniform integer in [0, 2^32) for (seed, keys)."""
    return F.conv(F.substring(seeded_hex(seed, *keys), 1, 8), 16, 10).cast("bigint")


def seeded_pick(seed, *keys) -> Column:
    """Uniform integer in [0, 2^60) for (seed, keys): for picks out of any number of rows."""
    return F.conv(F.substring(seeded_hex(seed, *keys), 1, 15), 16, 10).cast("bigint")


def numbered_picks(prefixes: list[str], numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``seeded_pick`` of many numbers at once: for every prefix, pairs of places in ``numbers`` and the first 60 bits
    of md5(prefix + number). Numbers of one length are worked on together, up to ``AT_ONCE``; what does not fit one
    block of md5 is hashed one by one."""
    written = numbers.astype(str)
    length = np.char.str_len(written) if len(numbers) else np.empty(0, int)
    for n in np.unique(length).tolist():
        places = np.flatnonzero(length == n)
        for first in range(0, len(places), AT_ONCE):
            at = places[first : first + AT_ONCE]
            digits = written[at].astype(f"S{n}").view(np.uint8).reshape(-1, n)
            for prefix in prefixes:
                yield at, _md5_picks(prefix.encode(), digits)


def _md5_picks(head: bytes, digits: np.ndarray) -> np.ndarray:
    size = len(head) + digits.shape[1]
    if size > 55:
        return np.frombuffer(b"".join(hashlib.md5(head + d.tobytes()).digest()[:8] for d in digits), ">u8").astype(np.uint64) >> np.uint64(4)
    block = np.zeros((len(digits), 64), np.uint8)
    block[:, : len(head)] = np.frombuffer(head, np.uint8)
    block[:, len(head) : size] = digits
    block[:, size] = 0x80
    block[:, 56:58] = np.array([8 * size], "<u2").view(np.uint8)
    m = np.ascontiguousarray(block.view("<u4").T)
    a, b, c, d = (np.full(len(digits), v, np.uint32) for v in START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += m[g]
        f += np.uint32(SINES[i])
        turned = f << np.uint32(TURNS[i])
        f >>= np.uint32(32 - TURNS[i])
        turned |= f
        turned += b
        a, d, c, b = d, c, b, turned
    a, b = a + np.uint32(START[0]), b + np.uint32(START[1])
    return (a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()) >> np.uint64(4)


def seeded_unit(seed, *keys) -> Column:
    """Uniform double in [0, 1) for (seed, keys)."""
    return seeded_int(seed, *keys) / F.lit(4294967296.0)


def hash64_halves(hex16: Column) -> tuple[Column, Column]:
    """A 16-digit hex string as two unsigned 32-bit halves (a signed long cannot hold it)."""
    return (F.conv(F.substring(hex16, 1, 8), 16, 10).cast("bigint"),
            F.conv(F.substring(hex16, 9, 8), 16, 10).cast("bigint"))
