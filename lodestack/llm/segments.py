"""Splitting oversized texts at natural boundaries by lexical cohesion.

A text is read as units (sentences and lines).  At every gap between units the words of the blocks
of units before and after it are compared; a valley of this similarity marks a change of topic, its
depth is how far the similarity rises to both sides.  A piece ends at the deepest valley inside its
size window; paragraphs count for more than lines, lines for more than sentences.  The next piece
begins the given overlap before that end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import words as W

BREAK = re.compile(r"(?P<para>[^\S\n]*\n(?:\s*\n)\s*)|(?P<line>[^\S\n]*\n\s*)|(?P<wide>[。！？]+[」』）]*)|(?<=[.!?…])[\"'”’»)\]]*(?P<sent>[^\S\n]+)|(?<=[.!?…][\"'”’»)\]])(?P<sent2>[^\S\n]+)")
WEIGHT = {"para": 0.5, "line": 0.25, "wide": 0.0, "sent": 0.0, "sent2": 0.0}
BLOCK = 4  # units on each side of a gap
DIMS = 64  # hashed dimensions of a unit's words
FILL = 0.5  # a piece is at least this full where a boundary allows it
SPAN = 4000  # units handled at once


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(position, weight) of the gaps between units; a position is the first character after the gap."""
    at, weight = [], []
    for m in BREAK.finditer(text):
        if 0 < m.end() < len(text):
            at.append(m.end())
            weight.append(WEIGHT[m.lastgroup])
    return np.array(at, np.int64), np.array(weight)


def depths(text: str, at: np.ndarray) -> np.ndarray:
    """Depth of the cohesion valley at each gap."""
    hashes, _, starts = W.scan([text.lower()]) if len(text.lower()) == len(text) else W.scan([text])
    unit = np.searchsorted(at, starts, side="right")
    cell = unit * DIMS + (hashes % np.uint64(DIMS)).astype(np.int64)
    counts = np.bincount(cell, minlength=(len(at) + 1) * DIMS).reshape(-1, DIMS).astype(np.float32)
    total = np.concatenate((np.zeros((1, DIMS), np.float32), np.cumsum(counts, axis=0)))
    gap = np.arange(1, len(at) + 1)
    left = total[gap] - total[np.maximum(gap - BLOCK, 0)]
    right = total[np.minimum(gap + BLOCK, len(at) + 1)] - total[gap]
    norm = np.sqrt((left * left).sum(1) * (right * right).sum(1))
    similarity = (left * right).sum(1) / np.maximum(norm, 1e-9)
    padded = np.pad(similarity, BLOCK, mode="edge")
    views = np.lib.stride_tricks.sliding_window_view(padded, BLOCK + 1)
    before, after = views[: len(at)].max(1), views[BLOCK : BLOCK + len(at)].max(1)
    return before + after - 2 * similarity


def _hard(text: str, start: int, low: int, high: int) -> int:
    """A cut without sentence or line boundary: after the last blank or punctuation mark, else at the limit."""
    window = text[low:high]
    for pattern in (r"\s(?=\S*$)", r"[,;:、，；：/&?=_-](?=[^,;:、，；：/&?=_-]*$)"):
        m = re.search(pattern, window)
        if m and m.end():
            return low + m.end()
    return high


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of the pieces: each at most ``limit`` characters, each beginning ``overlap`` before the end of the last.

    A text within the limit is one piece.  An overlap of the limit or more is cut to limit - 1.
    """
    size = len(text)
    if size <= limit:
        return [(0, size)]
    overlap = max(0, min(overlap, limit - 1))
    at, weight = boundaries(text)
    score = depths(text, at) + weight if len(at) else weight
    out, start = [], 0
    while size - start > limit:
        least = start + overlap + 1
        low, high = max(least, start + int(limit * FILL)), start + limit
        a, b = np.searchsorted(at, [low, high + 1])
        if a == b:  # no boundary in the fuller part of the window: the last one before it
            a = np.searchsorted(at, least)
            a, b = (b - 1, b) if b > a else (b, b)
        if a < b:
            best = a + int(np.flatnonzero(score[a:b] >= score[a:b].max() - 1e-6)[-1])
            end = int(at[best])
        else:
            end = _hard(text, start, least, high)
        out.append((start, end))
        start = end - overlap
    out.append((start, size))
    return out


def pieces(df: DataFrame, key: str, text: str, profile: str | None, limits: DataFrame, default: str = "default", unit_of: str = "textcontent", distinct: bool = True) -> DataFrame:
    """(key, piece, start, end, pieces, text): the ordered pieces of every text.

    ``limits`` holds (profile, applies_to, max_size, overlap_size); a null or unlisted profile means
    ``default``.  Texts within the limit are one piece; null texts have no row, an empty text is one
    empty piece.  A repeated (key, text, profile) counts once unless ``distinct``
    is off, which saves moving the texts.  The pieces without their overlaps
    joined give the text back.
    """
    rules = {
        r.profile: (r.max_size, r.overlap_size or 0)
        for r in limits.filter((F.col("applies_to") == unit_of) & (F.col("max_size") > 0)).select("profile", "max_size", "overlap_size").collect()  # a table of settings
    }
    kind = df.schema[key].dataType.simpleString()
    name = F.col(profile) if profile else F.lit(default)
    source = df.select(F.col(key).alias("key"), name.cast("string").alias("profile"), F.col(text).alias("text")).filter("text is not null")
    source = source.distinct() if distinct else source

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, p, t in zip(pdf["key"], pdf["profile"], pdf["text"], strict=True):
                ranges = cuts(t, *rules.get(p, rules[default]))
                out.extend((k, i, a, b, len(ranges), t[a:b]) for i, (a, b) in enumerate(ranges))
                if len(out) > SPAN:
                    yield pd.DataFrame(out, columns=["key", "piece", "start", "end", "pieces", "text"])
                    out = []
            yield pd.DataFrame(out, columns=["key", "piece", "start", "end", "pieces", "text"])

    return source.mapInPandas(split, f"key {kind}, piece int, start int, end int, pieces int, text string")
