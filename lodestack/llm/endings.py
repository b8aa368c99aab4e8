"""Where texts stop: structure at the end of a text and corpus evidence for complete endings.

A text whose last character closes a sentence, table row, code block or JSON value is complete by
its structure; of a closed JSON value, the strings that begin like sentences are looked at too, and
text that follows it is judged as prose.  For any other, the last words are held against how the same words go on in all
texts: words that sentences never end with, or a word no other text has, show a cut.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import words as W
from lodestack.llm.language import FUNCTION_WORDS

TOKEN = re.compile(r"https?://\S+|[^\W_]+(?:[’'-][^\W_]+)*|\n|[^\w\s]")
ITEM = re.compile(r"\s*(?:[-*•+]|\d+[.)])\s+")
# Marks that follow a cut.
NOTE = re.compile(r"\[(?:\.\.\.|…|[^\[\]\n]*\b(?:truncat|cut|tronqu|abgeschnitten)[^\[\]\n]*)\]", re.I)
GOES_ON = re.compile(r"\((?:\.\.\.|…|continued|suite|fortsetzung|continúa)\)?", re.I)
REMARK = re.compile(r"<!--[^<>]*-->")
CLOSED = re.compile(r"[.!?。！？:;][\"'”’»)\]*_]*$|^[\[(*_-].*[\])*_-]$")
STRING = re.compile(r'"(?:[^"\\]|\\.)*"(\s*:)?')
JSON = re.compile(r"(?:[^{}\[\]\n]*\n)?\s*(?:```\w*\s*)?(?=[{\[]\s*(?:[\"{\[\]}\d-]|$))")
FENCE = re.compile(r"\s*(?:```)?\s*")
PHONE = re.compile(r"(?:[+(]|\b)(?:\d[ ().\-/]{0,2}){8,14}\d(?: ?ext\.? ?\d{1,5})?$")
SUBJECT = re.compile(r"(?:^|[,;] )(?:subject|objet|betreff|asunto): [^.:]{3,80}$", re.I)
URL = re.compile(r"(?:https?://|www\.)\S+$")
BRACKET = re.compile(r'"(?:[^"\\]|\\.)*"|["{}\[\]]', re.S)
FLUSH = 4_000_000
LEAST_BITS, MOST_BITS, CHUNKS = 20, 28, 32  # size of the filter, by the number of grams; pieces it is merged in
FRAME_SHARE, WORD_SHARE = 0.3, 0.02  # least shares of a list item's frame and last word that end
STOPS, DOTS, BULLETS, MARKS = (np.array([ord(c) for c in x], np.uint32) for x in (".!?。！？", ".)", "-*•+", ",;:"))
_tables: dict[str, np.ndarray] = {}
MIN_SEEN, MIN_SHARE, PRIOR, SHORT_SEEN = 3, 0.08, 6, 20  # occurrences; share of them that end; weight of the shorter words' share; occurrences of the frame of a text of a few words
LINE, LINE_SHARE = 3, 0.8  # least words of a line's opening; share of the lines beginning like it that are it


def strip_added(text: str) -> tuple[str, str]:
    """The text without blanks and marks of a cut at its end, and those marks, however long they are."""
    end = len(text)
    while end:
        core = text[:end].rstrip("…\ufffd \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0")
        core = core.rstrip()
        last = core[-1:]
        start = -1
        if last == ">" and core.endswith("-->"):
            start, mark = core.rfind("<!--"), REMARK
        elif last == "]":
            start, mark = core.rfind("["), NOTE
        else:
            start, mark = core.rfind("(", len(core) - 16), GOES_ON  # the marks of this kind are shorter
        if start < 0 or not mark.fullmatch(core, start):
            if len(core) == end:
                break
            end = len(core)
            continue
        end = start
    return text[:end], text[end:].strip()


def json_state(text: str, at: int = 0) -> tuple[str, int] | None:
    """``closed`` or ``open`` for a text that from ``at`` on holds a JSON value after at most one line, and where the value ends; else None."""
    start = JSON.match(text, at)
    if not start:
        return None
    depth = 0
    for m in BRACKET.finditer(text, start.end()):
        c = m.group()
        if c in "{[":
            depth += 1
        elif c == '"':
            break  # a string without end
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return "closed", m.end()
    return "open", len(text)


def unfinished_strings(text: str) -> list[str]:
    """The strings of a JSON value that begin like a sentence (capital, three words) and have no end of one."""
    out = []
    for m in STRING.finditer(text):
        if m.group(1):
            continue  # a key
        try:
            value = json.loads(m.group())
        except ValueError:
            continue
        value = value.strip()
        if value[:1].isupper() and len(value) > 15 and len(value.split()) > 2 and not CLOSED.search(value) and not URL.search(value):
            out.append(value)
    return out


@dataclass
class Ending:
    """state: complete, cut or unsure; core: the text without what was added after it; item: in a list; style: how other items end, or ``short``."""

    state: str
    core: str = ""
    item: bool = False
    style: str = ""


def examine(text: str, short: int = 4) -> Ending:
    """Structure at the end of ``text``; the first of its endings."""
    return endings(text, short)[0]


def endings(text: str, short: int = 4) -> list[Ending]:
    """The endings of ``text`` that decide: one that is cut, else all that are unsure, else one that is complete.

    A text has its own ending and those of the strings in its JSON values.  Texts of at most
    ``short`` words may be answers of a word or two, so that nothing but evidence makes them cut.
    """
    core, tail = strip_added(text)
    if core.endswith("...") and len(core) > 3:
        core, tail = core[:-3].rstrip(), "..."
    at = end = 0
    while value := json_state(core, at):
        state, end = value
        if state == "open":
            return [Ending("cut")]
        at = FENCE.match(core, end).end()
    found = [_prose(core, tail, short)] if at < len(core) or not end else []
    for inner in unfinished_strings(core[:end]) if end else []:
        found.extend(endings(inner, 2))
    for state in ("cut", "unsure"):
        if some := [e for e in found if e.state == state]:
            return some if state == "unsure" else some[:1]
    return [Ending("complete")]


def _prose(core: str, tail: str, short: int) -> Ending:
    """The ending of a text that is not, or not only, a JSON value."""
    if core.count("```") % 2:
        return Ending("cut")
    if core.endswith("```"):
        return Ending("complete")
    lines = [line for line in core.split("\n") if line.strip()]
    if not lines:
        return Ending("complete")
    last = lines[-1].strip()
    if last.startswith("|"):
        header = next((x.strip() for x in reversed(lines[:-1]) if re.match(r"\s*\|[\s:|-]+\|\s*$", x)), None)
        whole = last.endswith("|") and (not header or last.count("|") >= header.count("|"))
        return Ending("complete" if whole else "cut")
    if last.startswith("#"):
        return Ending("complete")
    if "\ufffd" in tail:
        return Ending("cut")
    if not tail and (CLOSED.search(last) or URL.search(last)):
        return Ending("complete")
    if not tail and (last.endswith("|") or PHONE.search(last) or SUBJECT.search(last)):
        return Ending("complete")
    if last.rfind("[") > last.rfind("]") or last.rfind("{") > last.rfind("}"):
        return Ending("cut")
    tokens = [t for t in TOKEN.findall(core) if t != "\n"]
    plain = [t for t in tokens if t[0].isalnum()]
    if len(plain) <= short and not tail:
        return Ending("unsure", core, False, "short") if tokens and tokens[-1][0].isalnum() and len(plain) > 1 else Ending("complete")
    if tokens and not tail and tokens[-1] in "}])\"'»”>*_":
        return Ending("complete")
    if not tokens or not tokens[-1][0].isalnum():
        return Ending("complete" if tail == "..." and tokens and tokens[-1] in ".!?" else "cut")
    item = bool(ITEM.match(lines[-1]))
    style = ""
    if item:
        others = [x.rstrip() for x in lines[:-1] if ITEM.match(x)]
        style = "" if not others else "bare" if all(x[-1].isalnum() for x in others) else "stopped"
    return Ending("unsure", core, item, style)


def _table(name: str, test) -> np.ndarray:
    if name not in _tables:
        _tables[name] = np.fromiter((test(chr(i)) for i in range(0x10000)), dtype=bool, count=0x10000)
    return _tables[name]


def _at(name: str, test, cps: np.ndarray) -> np.ndarray:
    """``test`` of each code point; those beyond the first plane are tested one by one."""
    out = _table(name, test)[np.minimum(cps, 0xFFFF)]
    high = np.flatnonzero(cps >= 0x10000)
    if len(high):
        values, back = np.unique(cps[high], return_inverse=True)
        out[high] = np.fromiter((test(chr(v)) for v in values), dtype=bool, count=len(values))[back]
    return out


def _prefixes(codes: np.ndarray, first: np.ndarray, owner: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Hash of each run of codes from its first one up to each place; codes that are not kept do not change it.

    ``first`` has the place each run begins at, ``owner`` the run of each place.  The hash is a
    polynomial, so that runs of any length cost one sum over all places.
    """
    size = len(codes)
    if not size:
        return codes
    place = np.cumsum(kept) - kept
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        total = np.cumsum(np.where(kept, codes * up[place], np.uint64(0)))
        before = np.where(first > 0, total[first - 1], np.uint64(0))
        length = place + kept - place[first][owner]
        return W.mix((total - before[owner]) * down[place[first]][owner] + length.astype(np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get("powers")
    if have is None or have.shape[1] < n:
        base = np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            steps = [np.full(max(n, 4096), x, np.uint64) for x in (base, np.uint64(pow(int(base), -1, 1 << 64)))]
            for step in steps:
                step[0] = 1
            have = np.stack([np.multiply.accumulate(step) for step in steps])
        _tables["powers"] = have
    return have[0], have[1]


class Words:
    """The words of a batch of texts with what the evidence needs of them, as arrays."""

    def __init__(self, texts: list[str]):
        joined = "\0".join(texts)
        raw, self.owner, start = W.scan(texts)
        cps = np.append(W.code_points(joined), np.zeros(3, np.uint32))
        size = len(start)
        word = W.is_word_char(cps)
        stops = np.flatnonzero(word[:-1] & ~word[1:]) + 1
        end = stops[np.searchsorted(stops, start, side="right")] if size else start
        digit = np.add.reduceat(np.append(_at("digit", str.isdigit, cps[:-1]), False).astype(np.int32), np.ravel(np.column_stack((start, end))))[::2] > 0 if size else np.empty(0, bool)
        upper = _at("upper", str.isupper, cps[start])
        number = np.where(digit, np.uint64(1), raw)
        masked = np.where(digit, np.uint64(1), np.where(upper, np.uint64(2), raw))
        gap = cps[end].astype(np.uint64) if size else raw
        self.size, self.digit = size, digit
        first_of_text = np.concatenate(([True], self.owner[1:] != self.owner[:-1])) if size else np.empty(0, bool)
        last_of_text = np.append(first_of_text[1:], True) if size else first_of_text
        self.last = last_of_text
        self.raw = W.mix(raw ^ np.uint64(11))
        before, sign = np.roll(masked, 1), np.roll(gap, 1)
        self.pair = W.mix(W.mix(before * np.uint64(3) ^ np.uint64(12)) ^ sign ^ (masked << np.uint64(1)))
        self.has_pair = ~first_of_text
        self.triple = W.mix(W.mix(np.roll(masked, 2) * np.uint64(5) ^ np.roll(gap, 2)) ^ self.pair)
        self.has_triple = self.has_pair & np.roll(self.has_pair, 1) if size else self.has_pair
        lower_next = np.append(_at("lower", str.islower, cps[start[1:]]), False) & ~last_of_text if size else first_of_text
        after, second = cps[end], cps[end + 1] if size else cps[end]
        line_end = (after == 10) | (after == 13) | ((after == 32) & ((second == 10) | (second == 13)))
        self.stopped = np.isin(after, STOPS) & ~lower_next & ((second <= 32) | ~_at("alnum", str.isalnum, second))
        self.line = line_end & ~last_of_text
        self.counted = ~last_of_text | self.stopped
        self.frame = self._frames(raw, digit, upper, gap, first_of_text)
        breaks = np.cumsum((cps == 10) | (cps == 0))
        row = breaks[start] if size else start
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if size else np.empty(0, np.int64)
        self.length = np.diff(np.append(first, size))
        self.line_of = np.repeat(np.arange(len(first)), self.length)
        self.first = first
        begin = np.concatenate(([0], np.flatnonzero((cps[:-3] == 10) | (cps[:-3] == 0)) + 1))
        begin = begin[row[first]] if size else begin[:0]
        lead, lead2, lead3 = cps[begin], cps[np.minimum(begin + 1, len(cps) - 1)], cps[np.minimum(begin + 2, len(cps) - 1)]
        numbered = (lead >= 48) & (lead <= 57) & (np.isin(lead2, DOTS) | ((lead2 >= 48) & (lead2 <= 57) & np.isin(lead3, DOTS)))
        self.item = ((np.isin(lead, BULLETS) & (lead2 == 32)) | numbered)[self.line_of] if size else first_of_text
        within = np.arange(size) - first[self.line_of] if size else start
        self.opening = np.where(within >= LINE - 1, _prefixes(W.mix(number ^ np.uint64(13)), first, self.line_of, np.ones(size, bool)), np.uint64(0))
        self.whole = np.concatenate((row[1:] != row[:-1], [True])) if size else first_of_text

    def _frames(self, raw, digit, upper, gap, first_of_text) -> np.ndarray:
        """Hash of each sentence up to each word with all but function words, numbers and marks masked; a repeated mask counts once."""
        if "function" not in _tables:
            _tables["function"] = np.unique(W.scan(sorted({w for words in FUNCTION_WORDS.values() for w in words.split()}))[0])
        if not self.size:
            return np.zeros(0, np.uint64)
        kept = np.isin(raw, _tables["function"])
        code = np.where(digit, np.uint64(1), np.where(kept, raw, np.where(upper, np.uint64(2), np.uint64(3))))
        mark = np.where(np.isin(np.roll(gap, 1), MARKS), np.roll(gap, 1), np.uint64(0))
        code = W.mix(code * np.uint64(9) ^ mark)
        begins = first_of_text | np.roll(self.stopped | self.line, 1)
        begins[0] = True
        repeated = np.concatenate(([False], code[1:] == code[:-1])) & ~begins
        return _prefixes(code, np.flatnonzero(begins), np.cumsum(begins) - 1, ~repeated)


def last_grams(cores: list[str]) -> list[tuple[list[int], bool]]:
    """For each text (with at least one word): hashes of its last line (0 if of one or two words), last word, pair, triple and sentence frame; whether the word has digits."""
    out: list[tuple[list[int], bool]] = []
    for first, last in W.slices(cores):
        out.extend(_last_grams(cores[first:last]))
    return out


def _last_grams(cores: list[str]) -> list[tuple[list[int], bool]]:
    w = Words(cores)
    ends = np.flatnonzero(w.last)
    none = np.uint64(0)
    table = np.column_stack((w.opening[ends], w.raw[ends], np.where(w.has_pair[ends], w.pair[ends], none), np.where(w.has_triple[ends], w.triple[ends], none), w.frame[ends]))
    by_text = {int(o): (row.view(np.int64).tolist(), bool(d)) for o, row, d in zip(w.owner[ends], table, w.digit[ends], strict=True)}
    return [by_text.get(i, ([0] * 5, False)) for i in range(len(cores))]


def hash_filter(rows: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """(bits, packed bit array) of a filter that holds the hashes in an array column, sized by their number.

    Beyond 2^MOST_BITS / 16 hashes it lets more others pass.
    """
    hashes = rows.filter(F.size(column) > 0).select(F.col(column).alias("grams"))
    grams = hashes.agg(F.sum(F.size("grams"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * grams + 1))))
    step = (1 << bits) // 8 // CHUNKS

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = np.zeros(1 << bits, bool)
        for pdf in batches:
            if len(pdf):
                some[(W.mix(np.concatenate(pdf["grams"].to_numpy()).astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)] = True
        packed = np.packbits(some)
        for k in range(CHUNKS):
            if packed[k * step : (k + 1) * step].any():
                yield pd.DataFrame({"chunk": [k], "bits": [packed[k * step : (k + 1) * step].tobytes()]})

    def either(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]]).tobytes()]})

    packed = np.zeros((1 << bits) // 8, np.uint8)
    rows = hashes.mapInPandas(mark, "chunk int, bits binary").groupBy("chunk").applyInPandas(either, "chunk int, bits binary").collect()
    for row in rows:  # at most CHUNKS rows
        packed[row.chunk * step : (row.chunk + 1) * step] = np.frombuffer(row.bits, np.uint8)
    return bits, packed


def passes(wanted: tuple[int, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets pass."""
    bits, packed = wanted
    bit = W.mix(hashes) >> np.uint64(64 - bits)
    return packed[(bit >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8) & 1 == 1


def evidence(texts: DataFrame, column: str, unsure: DataFrame) -> DataFrame:
    """(gram, total, ends, bare) over all texts, of the grams that unsure endings have: how often a word,
    masked pair or triple occurs before the end of a text, ends a sentence or line, and ends a line
    outside lists without a stop; and how often lines open with some words and hold nothing else.

    Numbers count as one word, capitalised words in pairs and triples as another.  Grams are 64-bit
    hashes; the filter lets some others pass, which changes no count.
    """
    wanted = texts.sparkSession.sparkContext.broadcast(hash_filter(unsure, "grams"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []

        def keep(gram: np.ndarray, ends: np.ndarray, bare: np.ndarray) -> None:
            hit = passes(wanted.value, gram)
            held.append((gram[hit], ends[hit], bare[hit]))

        def rows() -> pd.DataFrame:
            gram, ends, bare = (np.concatenate(x) for x in zip(*held, strict=True))
            values, back = np.unique(gram, return_inverse=True)
            counts = [np.bincount(back, minlength=len(values)).astype(np.int64)] + [np.bincount(back, weights=x, minlength=len(values)).astype(np.int64) for x in (ends, bare)]
            return pd.DataFrame(dict(zip(("gram", "total", "ends", "bare"), (values.view(np.int64), *counts), strict=True)))

        for pdf in batches:
            texts_ = [strip_added(t)[0] for t in pdf["text"]]
            for first, last in W.slices(texts_):
                w = Words(texts_[first:last])
                if not w.size:
                    continue
                ends = w.stopped | w.line
                bare = w.line & ~w.item & ~w.stopped
                for gram, has in ((w.raw, True), (w.pair, w.has_pair), (w.triple, w.has_triple), (w.frame, True)):
                    use = np.flatnonzero(w.counted & has)
                    keep(gram[use], ends[use], bare[use])
                use = np.flatnonzero(w.opening)
                keep(w.opening[use], w.whole[use], w.whole[use])
            if sum(len(x[0]) for x in held) > FLUSH:
                yield rows()
                held.clear()
        if held:
            yield rows()

    counted = texts.select(F.col(column).alias("text")).filter("text is not null").mapInPandas(count, "gram long, total long, ends long, bare long")
    return counted.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("total", "ends", "bare")))


def decide(unsure: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``unsure`` (key columns, grams array<long>, digits, item, style) with columns ``cut`` and ``goes_on``.

    ``goes_on``: other sentences have the same beginning, with names, numbers and content words
    masked, and nearly all of them go on or close it with a mark, so this one is a shortened version.

    ``cut``: a short line that many texts have as it is, is complete.  Else the last three words decide,
    backed by the last two: outside lists they must end lines without a stop in MIN_SHARE of the
    cases, in lists end sentences or lines.  An item whose sentence frame (function words,
    numbers and marks, all else masked) often ends there, with a word that ends sentences, is whole.
    A last word that no text has elsewhere, or a bare item among items with stops, is cut.  A text of
    a few words is cut only where it ends with a word, and its frame and last words both go on in all other texts.
    """
    keys = unsure.select(*key, F.posexplode("grams").alias("n", "gram")).filter("gram <> 0")
    found = (
        keys.join(seen, "gram", "left")
        .groupBy(*key)
        .agg(*(F.coalesce(F.max(F.when(F.col("n") == n, F.col(c))), F.lit(0)).alias(f"{c}{n}") for n in range(5) for c in ("total", "ends", "bare")))
    )

    def hits(n: int):
        return F.when(F.col("item"), F.col(f"ends{n}")).otherwise(F.col(f"bare{n}"))

    pair = (hits(2) + PRIOR * MIN_SHARE / 2) / (F.col("total2") + PRIOR)
    triple = (hits(3) + PRIOR * pair) / (F.col("total3") + PRIOR)
    known = (F.col("total2") >= MIN_SEEN) | (F.col("total3") >= MIN_SEEN)
    goes_on = (F.col("total4") >= MIN_SEEN) & (hits(4) < MIN_SHARE * F.col("total4"))
    cut = (
        F.when((F.col("total0") >= MIN_SEEN) & (F.try_divide(F.col("ends0"), F.col("total0")) >= LINE_SHARE), False)
        .when(F.col("style") == "short", (F.col("total4") >= SHORT_SEEN) & (F.col("bare4") == 0) & ~F.col("digits") & ((F.col("total1") == 0) | ((F.col("total3") >= MIN_SEEN) & (F.col("bare3") == 0))))
        .when(F.col("item") & (F.col("style") == "stopped"), True)
        .when(~F.col("digits") & (F.col("total1") == 0), True)
        .when(F.col("item") & (F.col("total4") >= MIN_SEEN) & (F.try_divide(F.col("ends4"), F.col("total4")) >= FRAME_SHARE) & (F.try_divide(F.col("ends1"), F.col("total1")) >= WORD_SHARE), False)
        .when(known, triple < MIN_SHARE)
        .otherwise(~F.col("digits"))
    )
    return unsure.join(found, key).withColumns({"cut": cut, "goes_on": goes_on})
