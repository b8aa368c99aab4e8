"""Evaluation texts leaking into training text.

The runs of ``n`` consecutive words of all test items form a hash set that is broadcast in blocks
of bounded size.  Each document's words are scanned once per block: words outside the items'
vocabulary end a run, the windows of the remaining runs are looked up by hash and verified word by
word.  Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestack.session import cut, keep

LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
SITE = re.compile(r"\[[a-z]+://[^\s\]]+[ \t]*([^\]]*)\]", re.I)
BREAK = re.compile(r"<(?:br|hr|p|div|li|td|tr)\b[^<>]*>", re.I)
BLANK = re.compile("&nbsp;")
INLINE = re.compile(r"</?[a-zA-Z][^<>]*>|'{2,}")
WORD = re.compile(r"[^\W_]+")
BLOCK = 1_000_000  # n-grams of the test items broadcast at once: at most 40 MB of arrays


def shown(text: str) -> str:
    """The words a reader sees: links by their label, no emphasis or inline tags, blanks for ``&nbsp;``."""
    if "[" in text:
        text = SITE.sub(r"\1", LINK.sub(r"\1", text))
    if "<" in text:
        text = BREAK.sub(" ", text)
    if "<" in text or "''" in text:
        text = INLINE.sub("", text)
    return text.replace("&nbsp;", " ") if "&nbsp;" in text else text


def words(text: str) -> list[str]:
    return WORD.findall(shown(text).lower())


class _Items:
    """The items that hold a gram, by its number."""

    def __init__(self, names: list, owner: np.ndarray, first: np.ndarray):
        self.names, self.owner, self.first = names, owner, first

    def __getitem__(self, gram: int) -> list:
        return [self.names[i] for i in self.owner[self.first[gram] : self.first[gram + 1]]]


class Grams:
    """Word n-grams of test items with the items that hold them, as sorted arrays."""

    def __init__(self, items: list[tuple[object, str]], n: int):
        self.n = n
        self.vocabulary: dict[str, int] = {}
        names = sorted({item for item, _ in items}, key=str)
        number = {item: i for i, item in enumerate(names)}
        parts, owners = [np.empty((0, n), np.int32)], [np.empty(0, np.int32)]
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int32)
            if len(ids) >= n:
                parts.append(np.lib.stride_tricks.sliding_window_view(ids, n))
                owners.append(np.full(len(ids) - n + 1, number[item], np.int32))
        windows, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.lexsort((owner, *windows.T[::-1]))
        windows, owner = windows[order], owner[order]
        fresh = np.concatenate(([True], (windows[1:] != windows[:-1]).any(1))) if len(windows) else np.empty(0, bool)
        pair = fresh | np.concatenate(([True], owner[1:] != owner[:-1])) if len(windows) else fresh
        gram = (np.cumsum(fresh) - 1)[pair]
        windows = windows[fresh]
        h = self._hash(windows)
        place = np.argsort(h, kind="stable")
        back = np.empty_like(place)
        back[place] = np.arange(len(place))
        by_gram = np.argsort(back[gram], kind="stable")
        self.hashes, self.windows = h[place], windows[place]
        self.items = _Items(names, owner[pair][by_gram], np.searchsorted(back[gram][by_gram], np.arange(len(windows) + 1)))

    @staticmethod
    def _hash(windows: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.zeros(len(windows), np.uint64)
            for k in range(windows.shape[1]):
                h = (h ^ windows[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        return h

    def hits(self, tokens: list[str]) -> list[tuple[int, int]]:
        """(position of the first word, gram) of every window of the tokens that is a gram of the items."""
        if len(tokens) < self.n or not len(self.hashes):
            return []
        find = self.vocabulary.get
        ids = np.fromiter((find(w, 0) for w in tokens), np.int32, len(tokens))
        strange = np.concatenate(([0], np.cumsum(ids == 0)))
        starts = np.flatnonzero(strange[self.n :] == strange[: -self.n])
        if not len(starts):
            return []
        windows = np.lib.stride_tricks.sliding_window_view(ids, self.n)[starts]
        h = self._hash(windows)
        out = []
        at = np.searchsorted(self.hashes, h)
        while True:  # equal hashes of different grams stand side by side
            inside = np.flatnonzero(at < len(self.hashes))
            same = inside[self.hashes[at[inside]] == h[inside]]
            if not len(same):
                return sorted(out)
            right = same[(self.windows[at[same]] == windows[same]).all(1)]
            out.extend(zip(starts[right].tolist(), at[right].tolist(), strict=True))
            rest = np.setdiff1d(same, right)
            starts, windows, h, at = starts[rest], windows[rest], h[rest], at[rest] + 1


def _blocks(items: DataFrame, item_key: str, item_text: str, n: int) -> Iterator[Grams]:
    """The items in blocks of at most about BLOCK n-grams; items are read by iterator, not gathered."""
    held, size = [], 0
    rows = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null").distinct()
    for row in rows.toLocalIterator():
        held.append((row.item, row.text))
        size += len(row.text) // 2
        if size > BLOCK:
            yield Grams(held, n)
            held, size = [], 0
    if held:
        yield Grams(held, n)


def leaked(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, n: int = 8) -> DataFrame:
    """(key, item, windows): the items each document gives away and how many of its windows do.

    Null or short texts and items have no row; repeated rows count once; a key with several texts
    gives away what any of them does.  An empty table of items gives an empty result.
    """
    kinds = {c: df.schema[name].dataType.simpleString() for c, df, name in (("key", docs, key), ("item", items, item_key))}
    schema = f"key {kinds['key']}, item {kinds['item']}, windows long"
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null")
    def scanned(shared) -> DataFrame:
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            grams = shared.value
            for pdf in batches:
                out: dict[tuple, int] = {}
                for k, t in zip(pdf["key"], pdf["text"], strict=True):
                    for _, gram in grams.hits(words(t)):
                        for item in grams.items[gram]:
                            out[k, item] = out.get((k, item), 0) + 1
                yield pd.DataFrame([(k, i, c) for (k, i), c in out.items()], columns=["key", "item", "windows"])

        return source.mapInPandas(scan, schema)

    found, context = None, docs.sparkSession.sparkContext
    blocks = _blocks(items, item_key, item_text, n)
    grams, after = next(blocks, None), next(blocks, None)
    while grams is not None:
        shared = context.broadcast(grams)
        part = scanned(shared)
        if after is not None or found is not None:  # several blocks: one at a time is held
            part = keep(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
        grams, after = after, next(blocks, None)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.groupBy("key", "item").agg(F.max("windows").alias("windows"))


def _traced(text: str) -> tuple[str, list[int]]:
    """``shown(text).lower()`` and the position in ``text`` of each of its characters."""
    places = list(range(len(text)))
    for pattern, fill in ((LINK, None), (SITE, None), (BREAK, " "), (INLINE, ""), (BLANK, " ")):
        parts, kept, at = [], [], 0
        for m in pattern.finditer(text):
            parts += text[at : m.start()], m.group(1) if fill is None else fill
            kept += places[at : m.start()] + (places[m.start(1) : m.end(1)] if fill is None else places[m.start() : m.start() + len(fill)])
            at = m.end()
        if at:
            text, places = "".join(parts) + text[at:], kept + places[at:]
    lower = text.lower()
    return lower, places if len(lower) == len(text) else [p for c, p in zip(text, places, strict=True) for _ in c.lower()]


def spans(text: str, *blocks: Grams) -> list[tuple[int, int]]:
    """Character ranges of a text that hold the items' n-grams of any block, merged where they overlap or touch."""
    seen, at = _traced(text)
    found = list(WORD.finditer(seen))
    tokens, places = [m.group() for m in found], [(at[m.start()], at[m.end() - 1] + 1) for m in found]
    out: list[tuple[int, int]] = []
    for first, n in sorted((first, g.n) for g in blocks for first, _ in g.hits(tokens)):
        start, end = places[first][0], places[first + n - 1][1]
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _marker(shared):
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def mark(texts: pd.Series, found: pd.Series) -> pd.Series:
        def one(t: str | None, before) -> list | None:
            held = [(r["start"], r["end"]) for r in before] if before is not None else []
            if t is None or not shared.value.hits(words(t)):
                return held
            return held + spans(t, shared.value)

        return pd.Series([one(t, f) for t, f in zip(texts, found, strict=True)])

    return mark


@F.pandas_udf(StringType())
def _without(texts: pd.Series, found: pd.Series) -> pd.Series:
    """The texts without the ranges, which may overlap."""

    def one(t: str | None, ranges) -> str | None:
        if t is None or ranges is None or not len(ranges):
            return t
        out, at = [], 0
        for start, end in sorted((r["start"], r["end"]) for r in ranges):
            if start > at:
                out.append(t[at:start])
            at = max(at, end)
        return "".join(out) + t[at:]

    return pd.Series([one(t, f) for t, f in zip(texts, found, strict=True)])


def remove_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, n: int = 8, mode: str = "spans") -> DataFrame:
    """``docs`` without leaked passages: mode ``spans`` cuts them out of the text column, ``documents`` drops the rows.

    Every block of items marks its passages in the whole text, and only then are they cut, so that
    the size of the blocks changes nothing; what a cut brings together may be a passage again, so
    rounds go on until no text holds one.  All other columns, rows with null texts and repeated
    rows stay as they are.
    """
    context = docs.sparkSession.sparkContext
    held = next(c for c in (f"_leaks{i}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    ranges = "array<struct<start:int,end:int>>"

    def marked(df: DataFrame) -> DataFrame:
        df = df.withColumn(held, F.array().cast(ranges))
        for grams in _blocks(items, item_key, item_text, n):
            shared = context.broadcast(grams)
            df = cut(df.withColumn(held, _marker(shared)(F.col(f"`{text}`"), F.col(held))))
            shared.destroy()
        return df

    blocks = _blocks(items, item_key, item_text, n)
    only, more = next(blocks, None), next(blocks, None)
    if only is None:
        return docs
    if mode == "documents":
        if more is None:
            found = docs.withColumn(held, _marker(context.broadcast(only))(F.col(f"`{text}`"), F.array().cast(ranges)))
        else:
            found = marked(docs)
        return found.filter(F.size(held) == 0).drop(held)
    if more is None:
        return docs.withColumn(text, _cutter(context.broadcast(only))(F.col(f"`{text}`")))
    kept = docs
    while True:
        found = marked(kept)
        kept = found.withColumn(text, _without(F.col(f"`{text}`"), F.col(held))).drop(held)
        if found.filter(F.size(held) > 0).isEmpty():
            return kept


def _cutter(shared):
    """All rounds of one block in one pass."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None or not shared.value.hits(words(t)):
                return t
            while ranges := spans(t, shared.value):
                for start, end in reversed(ranges):
                    t = t[:start] + t[end:]
            return t

        return texts.map(one)

    return clean
