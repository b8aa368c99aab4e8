"""Pluggable tool functions and summaries over long texts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

TOOLS: dict[str, tuple[Callable, str]] = {}


def tool(name: str, returns: str):
    """Register a Python function of values as a SQL function for sessions that ask for it; it runs in Arrow batches."""

    def add(f: Callable) -> Callable:
        TOOLS[name] = (f, returns)
        return f

    return add


def _series(f: Callable) -> Callable:
    def run(*arguments: pd.Series) -> pd.Series:
        return pd.Series([f(*values) for values in zip(*arguments, strict=True)])

    return run


def install(spark: SparkSession, *names: str) -> None:
    for name in names or tuple(TOOLS):
        f, returns = TOOLS[name]
        spark.udf.register(name, F.pandas_udf(_series(f), returns))


def summarise(text: str, window: int, model: Callable[[str], str], share: float = 0.45, carry: float = 0.05) -> str:
    """A running summary: pieces of ``share`` of the window, each after the end of the summary so far."""
    size, keep = max(1, int(window * share)), max(1, int(window * carry))
    summary = ""
    for at in range(0, len(text), size):
        summary = model((summary[-keep:] + "\n" if summary else "") + text[at : at + size])
    return summary
