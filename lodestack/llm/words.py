"""Vectorised word scanning: words of whole batches of texts as 64-bit hashes.

A word is a maximal run of letters and digits of the lower-cased text.  The
scan works on code points in NumPy, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_tables: dict[str, np.ndarray] = {}


def _alnum_table() -> np.ndarray:
    if "alnum" not in _tables:
        _tables["alnum"] = np.fromiter((chr(i).isalnum() for i in range(0x10000)), dtype=bool, count=0x10000)
    return _tables["alnum"]


def _powers(n: int) -> np.ndarray:
    have = _tables.get("pow")
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(np.full(max(n, 256), _BASE, dtype=np.uint64))
        _tables["pow"] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole 64-bit word."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def slices(texts: list[str], chars: int = 1_500_000, rows: int = 1 << 14) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with at most so many characters (or one text) and rows, to bound the arrays of a scan."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and (size + len(text) > chars or i - start >= rows):
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def is_word_char(cps: np.ndarray) -> np.ndarray:
    table = _alnum_table()
    if len(cps) and cps.max() >= 0x10000:
        out = table[np.minimum(cps, 0xFFFF)]
        high = np.flatnonzero(cps >= 0x10000)
        values, back = np.unique(cps[high], return_inverse=True)
        out[high] = np.fromiter((chr(v).isalnum() for v in values), dtype=bool, count=len(values))[back]
        return out
    return table[cps]


def scan(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts at once: (hash, index of the text, start position in the joined string).

    ``texts`` must be lower-cased; positions count code points in ``"\\0".join(texts)``.
    """
    cps = code_points("\0".join(texts))
    if not len(cps):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    word = is_word_char(cps)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64), starts
    lengths = ends - starts
    chars = cps[word].astype(np.uint64)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(len(chars)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        total = np.add.reduceat((chars + np.uint64(1)) * _powers(int(lengths.max()))[within], first)
    bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return mix(total * _MULT), np.searchsorted(bounds, starts, side="right"), starts


def shingles(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n consecutive words inside one text, with the text's index."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    size = len(hashes) - n + 1
    with np.errstate(over="ignore"):
        h = np.zeros(size, np.uint64)
        for k in range(n):
            h = mix(h * _MULT + hashes[k : k + size] + np.uint64(k + 1))
    whole = owner[:size] == owner[n - 1 :]
    return h[whole], owner[:size][whole]
