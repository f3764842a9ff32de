"""Words of texts and their hashes, shared by the text operators. A word is a longest run of letters and digits."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
MASK = (1 << 64) - 1
#: Entries after which the memo of word hashes is emptied, so that a worker's memory stays bounded.
MEMO = 500_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Memo(dict):
    """Word to 64-bit hash."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def hashed(texts: Iterable[str], memo: Memo, form: Callable[[str], str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in a row, and each text's offsets into them (one more than texts)."""
    flat: list[int] = []
    offsets = [0]
    for text in texts:
        flat += [memo[w] for w in words(form(text) if form else text)]
        offsets.append(len(flat))
    return np.array(flat, np.uint64), np.array(offsets, np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A good 64-bit scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(flat: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive values, in order; the windows may span texts, so the caller masks those."""
    n = len(flat) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * MULTIPLIER + flat[i : i + n]
    return mix(out)


def inside(offsets: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of ``k`` at positions 0..n-1: which lie in one text, and the text of each position."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: max(n, 0)]
    ends = offsets[text + 1]
    return np.arange(len(text)) + k <= ends, text


def distinct(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values, sorted, in a row, with offsets."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((flat, text))
    f, t = flat[order], text[order]
    first = np.ones(len(f), bool)
    first[1:] = (f[1:] != f[:-1]) | (t[1:] != t[:-1])
    f, t = f[first], t[first]
    return f, np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(offsets) - 1))]).astype(np.int64)


def once(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's distinct values, by owner and value, and their owners."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[fresh], o[fresh]
