"""Recursive character splitting of documents into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", " ", "")


def split(text: str, size: int = 1000, overlap: int = 20, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters (more only where nothing separates), trimmed, sharing up to ``overlap``.

    The coarsest separator that occurs cuts the text; parts that are still too long are cut by the
    finer ones, short ones are joined again up to the size.
    """
    if overlap > size:
        raise ValueError("the overlap may not exceed the chunk size")
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    parts = [p for p in (text.split(separator) if separator else list(text)) if p]
    out, short = [], []
    for part in parts:
        if len(part) < size or (not separator and len(part) <= size):
            short.append(part)
            continue
        out.extend(_join(short, separator, size, overlap))
        short = []
        out.extend(split(part, size, overlap, finer) if finer else [part])
    return out + _join(short, separator, size, overlap)


def _join(parts: list[str], separator: str, size: int, overlap: int) -> list[str]:
    out, held, length = [], [], 0
    gap = len(separator)
    for part in parts:
        if held and length + len(part) + gap > size:
            out.append(separator.join(held).strip())
            while held and (length > overlap or length + len(part) + gap > size):
                length -= len(held[0]) + (gap if len(held) > 1 else 0)
                held.pop(0)
        length += len(part) + (gap if held else 0)
        held.append(part)
    out.append(separator.join(held).strip())
    return [c for c in out if c]


def chunks(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 20, header: str | None = None, prefix: str = "") -> DataFrame:
    """(key, chunk_ix, chunk): chunks in order, each with the prefix and the row's header in front; null texts have none."""
    kind = df.schema[key].dataType.simpleString()
    head = F.coalesce(F.col(header), F.lit("")) if header else F.lit("")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, prefix + h + c) for k, h, t in zip(pdf["key"], pdf["header"], pdf["text"], strict=True) for i, c in enumerate(split(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["key", "chunk_ix", "chunk"])

    source = df.select(F.col(key).alias("key"), head.alias("header"), F.col(text).alias("text")).filter("text is not null")
    return source.mapInPandas(cut, f"key {kind}, chunk_ix int, chunk string")
