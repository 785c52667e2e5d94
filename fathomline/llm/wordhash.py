"""Hashes of words and of word sequences, computed on whole Arrow batches with numpy.

A word is a longest run of letters and digits (Unicode L and N), lower-cased. A text's words are hashed by prefix sums
over its code points, so that no Python loop runs per word. Equal words always have equal hashes.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: Code points that are handled at once; longer texts are cut between words.
LIMIT = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Is it a letter or digit and a random number, by code point below 65536; powers of an odd base and of its inverse."""
    is_word = np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(1 << 16)), bool, 1 << 16)
    values = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    base = 0x2545F4914F6CDD1D
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(LIMIT + 1, base, np.uint64), np.full(LIMIT + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return is_word, values, np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x2545F4914F6CDD1D
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers by byte, and at least n powers of an odd base and of its inverse."""
    return _tables()[1][:256], *_powers(1 << max(n - 1, 1).bit_length())


def _block(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the words of a lower-case text of at most LIMIT code points."""
    is_word, values, up, down = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if points.max() < 1 << 16:
        inside, v = is_word[points], values[points]
    else:
        low = np.minimum(points, 0xFFFF)
        inside, v = is_word[low], values[low]
        high = np.flatnonzero(points > 0xFFFF)
        inside[high] = [unicodedata.category(text[i])[0] in "LN" for i in high]
        v[high] = mix(points[high].astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    sums = np.empty(len(points) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(v * up[: len(points)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _cut(text: str) -> list[str]:
    """A long text in parts of at most LIMIT code points, cut at a character that is in no word where there is one."""
    parts, at = [], 0
    while len(text) - at > LIMIT:
        end = at + LIMIT
        while end > at + LIMIT // 2 and unicodedata.category(text[end - 1])[0] in "LN":
            end -= 1
        parts.append(text[at:end])
        at = end
    return [*parts, text[at:]]


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of all texts one after another, and how many words each text has. Null is an empty text.

    A run of more than half a million letters without a break may be cut in two, the same way in equal texts.
    """
    counts = np.zeros(len(texts), np.int64)
    hashes: list[np.ndarray] = []
    block: list[str] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if block:
            starts, h = _block(" ".join(block))
            lengths = np.fromiter(map(len, block), np.int64, len(block)) + 1
            ends = np.searchsorted(starts, np.cumsum(lengths))
            np.add.at(counts, owners, np.diff(ends, prepend=0))
            hashes.append(h)
            block.clear()
            owners.clear()
            size = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        low = text.lower()
        for part in [low] if len(low) < LIMIT else _cut(low):
            if size + len(part) + 1 > LIMIT:
                flush()
            block.append(part)
            owners.append(i)
            size += len(part) + 1
    flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def sequences(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every run of n words within one text: its hash, its text's index and the place of its first word in hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero(owner[:m] == owner[n - 1 :])
    g = np.zeros(m, np.uint64)
    for k in range(n):
        g = (g ^ (g >> _U(29))) * _U(0xD1342543DE82EF95) + hashes[k : k + m]
    return mix(g[whole]), owner[whole], whole
