"""Embedding and scoring behind pluggable functions, with deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH, DIM = 25, 64


class Embedder(Protocol):
    """A model: texts in, one row of numbers a text out."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


def hashed(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Mean of signed hashed words, of length 1; a text without words is a zero vector."""
    out = np.zeros((len(texts), dim))
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = crc32(word.encode())
            out[i, h % dim] += 1 if h & 0x80000000 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def embed(df: DataFrame, text: str, model: Embedder = hashed, prefix: str = "", batch: int = BATCH) -> DataFrame:
    """``df`` with a column embedding (array<float>), batch by batch inside each task; null texts get null."""
    def one(texts: pd.Series) -> list:
        given = texts.notna()
        out: list = [None] * len(texts)
        places = np.flatnonzero(given.to_numpy())
        for at in range(0, len(places), batch):
            some = places[at : at + batch]
            for i, v in zip(some, model([prefix + texts.iloc[j] for j in some]), strict=True):
                out[i] = np.asarray(v, np.float32).tolist()
        return out

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(one(texts), dtype=object)

    return df.withColumn("embedding", run(F.col(text)))


MODELS: dict[str, Callable[[], Embedder]] = {"hashed": lambda: hashed}


def register(name: str, make: Callable[[], Embedder]) -> None:
    MODELS[name] = make
