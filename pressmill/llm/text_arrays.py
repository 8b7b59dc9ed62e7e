"""Words of many texts at once as numpy arrays: no Python loop over words or characters.

Texts are joined, decoded to code points, and every word gets a 64-bit polynomial hash from prefix sums. A word is a maximal
run of letters or digits, lower-cased.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

CHARS_AT_ONCE, TEXTS_AT_ONCE = 1_000_000, 50_000
_BASE = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1
SPACE = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, b & _M, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@lru_cache(1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter or digit, and its random value."""
    word = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return word, mix(np.arange(1, 0x110001, dtype=np.uint64))


@lru_cache(1)
def lowered() -> np.ndarray:
    """By code point: its lower case where that is one character, else itself."""
    return np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x110000)), np.uint32, 0x110000)


def is_word(codes: np.ndarray) -> np.ndarray:
    return _kinds()[0][codes]


@dataclass
class Words:
    """Words of a chunk of texts. first[k]:first[k+1] are those of text k; start and end are character places in codes."""

    codes: np.ndarray
    text_at: np.ndarray
    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def chunks(texts: list[str | None]):
    """Slices of texts of at most TEXTS_AT_ONCE texts and CHARS_AT_ONCE characters together (a longer text alone)."""
    begin, total = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "") + 1
        if k > begin and (total + n > CHARS_AT_ONCE or k - begin >= TEXTS_AT_ONCE):
            yield begin, k
            begin, total = k, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a line feed, and where each begins."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or "") + 1 for t in texts], out=at[1:])
    joined = "\n".join([t or "" for t in texts] + [""])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), at


def words(texts: list[str | None], keep_case: bool = False) -> Words:
    """keep_case: codes are those of the texts as they are; hashes are of lower-cased words all the same."""
    if not keep_case:
        texts = [t.lower() if t else t for t in texts]
    codes, at = code_points(texts)
    kind, value = _kinds()
    inside = np.concatenate(([False], kind[codes], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    n = len(codes) + 1
    power, inverse = _powers(max(1 << 20, 1 << n.bit_length()))
    sums = np.zeros(n, np.uint64)
    np.cumsum(value[lowered()[codes] if keep_case else codes] * power[: n - 1], out=sums[1:])
    h = mix((sums[end] - sums[start]) * inverse[start])
    text = np.searchsorted(at, start, "right") - 1
    return Words(codes, at, h, text, start, end, np.searchsorted(text, np.arange(len(texts) + 1)))


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and the index of each run's first word."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(_BASE) + w.hash[j : j + n]
    at = np.flatnonzero(w.text[:n] == w.text[k - 1 :])
    return mix(h[at]), at
