"""Edits of texts that need not match in their indentation, and unified diffs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _indent(line: str) -> str:
    return line[: len(line) - len(line.lstrip())]


def _fitted(old: list[str], new: list[str], margin: str) -> list[str]:
    """The new lines with the indentation of the place they come to."""
    out = [margin + new[0].lstrip()]
    for i, line in enumerate(new[1:], 1):
        before, now = _indent(old[i]) if i < len(old) else "", _indent(line)
        out.append(margin + " " * max(0, len(now) - len(before)) + line.lstrip() if before and now else line)
    return out


def edit(text: str, old: str, new: str) -> str | None:
    """``text`` with the first place of ``old`` replaced: as it stands, else by lines that are equal when trimmed; None where there is none."""
    text, old, new = (x.replace("\r\n", "\n") for x in (text, old, new))
    if old in text:
        return text.replace(old, new, 1)
    wanted, lines = old.split("\n"), text.split("\n")
    bare = [w.strip() for w in wanted]
    stripped = [x.strip() for x in lines]
    for i in range(len(lines) - len(wanted) + 1):
        if stripped[i : i + len(wanted)] == bare:
            return "\n".join(lines[:i] + _fitted(wanted, new.split("\n"), _indent(lines[i])) + lines[i + len(wanted) :])
    return None


def unified(before: str, after: str, name: str = "file") -> str:
    """A unified diff with three lines of context, headed by the name."""
    a, b = (x.replace("\r\n", "\n").split("\n") for x in (before, after))
    return "\n".join(difflib.unified_diff(a, b, f"{name}\toriginal", f"{name}\tmodified", lineterm=""))


def edited(column: Column | str, old: str, new: str) -> Column:
    """:func:`edit` of a column; null where nothing matches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else edit(t, old, new))

    return run(F.col(column) if isinstance(column, str) else column)


def diff(before: Column, after: Column) -> Column:
    """Unified diff of two columns; null where either is."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else unified(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run(before, after)
