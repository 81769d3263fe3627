"""Words of whole texts as 64-bit hashes, many documents at once.

A word is a run of ``[^\\x20\\x09-\\x0D]``. The bytes of a block of documents
lie in one numpy array; a word's hash is a difference of two prefix sums of a
polynomial modulo 2^64, so no Python object is made per word. Blocks hold
about ``BLOCK`` bytes; a longer text is walked in pieces and a word cut by a
piece's edge is joined again, so memory stays near ``BLOCK`` times a small
factor plus eight bytes a word of the text at hand.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def _space() -> np.ndarray:
    t = np.zeros(256, np.int8)
    t[[0x20, 9, 10, 11, 12, 13]] = 1
    return t


@lru_cache(maxsize=2)
def _letters(lower: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
    if lower:
        t[65:91] = t[97:123]
    return t


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up = np.full(BLOCK + 2, BASE, U64)
    down = np.full(BLOCK + 2, BASE_INV, U64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _piece(buf: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and raw hashes of the words of at most BLOCK + 1 bytes."""
    up, down = _powers()
    step = np.diff(_space()[buf], prepend=np.int8(1), append=np.int8(1))
    start, end = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(_letters(lower)[buf] * up[: len(buf)], out=total[1:])
    return start, end, (total[end] - total[start]) * down[start]


def _long(text: bytes, lower: bool) -> np.ndarray:
    """Raw hashes of the words of one text of any length."""
    out: list[np.ndarray] = []
    held, held_len = 0, 0  # the word that the last piece's edge cut
    for at in range(0, len(text), BLOCK):
        buf = np.frombuffer(text, np.uint8, min(BLOCK, len(text) - at), at)
        start, end, h = _piece(buf, lower)
        if held_len and (not len(start) or start[0] > 0):
            out.append(np.array([held], U64))
            held, held_len = 0, 0
        if held_len:
            held = (held + pow(BASE, held_len, 1 << 64) * int(h[0])) % (1 << 64)
            held_len += int(end[0])
            if end[0] == len(buf) and len(start) == 1:
                continue
            out.append(np.array([held], U64))
            start, end, h, held, held_len = start[1:], end[1:], h[1:], 0, 0
        if len(end) and end[-1] == len(buf):
            held, held_len = int(h[-1]), int(end[-1] - start[-1])
            h = h[:-1]
        out.append(h)
    if held_len:
        out.append(np.array([held], U64))
    return np.concatenate(out) if out else np.zeros(0, U64)


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (n + 1 bounds).

    Equal words have equal hashes wherever they stand; a null text is given as
    an empty one and has no words.
    """
    counts = np.zeros(len(texts) + 1, np.int64)
    if len(texts) == 1 and len(texts[0]) > BLOCK:
        h = _long(texts[0], lower)
        counts[1] = len(h)
    else:
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        start, _, h = _piece(np.frombuffer(b"\n".join(texts), np.uint8), lower)
        ends = np.cumsum(sizes)
        counts[1:] = np.diff(np.searchsorted(start, ends), prepend=0)
    return mix(h), np.cumsum(counts)


def blocks(texts: list[bytes], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes; a longer text stands alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) + 1 > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def shingles(h: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows and the position of their first word."""
    if len(h) < width:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    n = len(h) - width + 1
    x = np.zeros(n, U64)
    for i in range(width):
        x = x * U64(BASE) + h[i : i + n]
    own = owners(bounds)
    at = np.flatnonzero(own[:n] == own[width - 1 :])
    return mix(x[at]), at


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text (words lower-cased A-Z) and bounds.

    A text with fewer words than ``width`` has its whole word sequence as its
    one shingle; a text without words has none.
    """
    h, bounds = word_hashes(texts, lower=True)
    x, at = shingles(h, bounds, width)
    own = owners(bounds)[at] if len(at) else np.zeros(0, np.int64)
    n_words = np.diff(bounds)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        whole = np.empty(len(short), U64)
        for k, i in enumerate(short):
            v = 0
            for w in h[bounds[i] : bounds[i + 1]].tolist():
                v = (v * BASE + w) % (1 << 64)
            whole[k] = (v + int(n_words[i])) % (1 << 64)
        x, own = np.concatenate([x, mix(whole)]), np.concatenate([own, short])
    order = np.lexsort((x, own))
    x, own = x[order], own[order]
    if len(x):
        first = np.ones(len(x), bool)
        first[1:] = (x[1:] != x[:-1]) | (own[1:] != own[:-1])
        x, own = x[first], own[first]
    return x, np.searchsorted(own, np.arange(len(texts) + 1))
