"""Counts and cuts by the tokens of a public tokenizer, in Arrow batches.

The rank file is read by the driver and sent to the executors once; its path is a parameter.
"""

from __future__ import annotations

import base64
import math
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The splitting pattern of the default vocabulary, and from which size (in KB of two-byte characters) on a count is estimated.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ESTIMATE_FROM_KB, CHARS_A_TOKEN = 10, 8
_encodings: dict[int, object] = {}


def encoding(ranks: bytes):
    """The tokenizer of the content of a rank file, kept for the life of the process."""
    key = hash(ranks)
    if key not in _encodings:
        import tiktoken

        _encodings[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    return _encodings[key]


def _mapped(column: Column | str, kind: str, f, vocabulary: str) -> Column:
    shared = SparkSession.active().sparkContext.broadcast(Path(vocabulary).read_bytes())

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        code = encoding(shared.value)
        return texts.map(lambda t: None if t is None else f(code, t))

    return run(F.col(column) if isinstance(column, str) else column)


def count(column: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text: counted up to ESTIMATE_FROM_KB, an eighth of the characters beyond; null stays null."""

    def tokens(code, text: str) -> int:
        if 2 * len(text) // 1024 >= ESTIMATE_FROM_KB:
            return math.ceil(len(text) / CHARS_A_TOKEN)
        return len(code.encode_ordinary(text))

    return _mapped(column, "long", tokens, vocabulary)


def _decoded(code, tokens: list[int]) -> str:
    return code.decode_bytes(tokens).decode("utf-8", "replace")


def chunks(column: Column | str, size: int, vocabulary: str = VOCABULARY) -> Column:
    """The text in consecutive pieces of ``size`` tokens; a character cut apart shows as a replacement mark."""
    def cut(code, text: str) -> list[str]:
        tokens = code.encode_ordinary(text)
        return [_decoded(code, tokens[i : i + size]) for i in range(0, len(tokens), size)]

    return _mapped(column, "array<string>", cut, vocabulary)


def last(column: Column | str, size: int, vocabulary: str = VOCABULARY) -> Column:
    """The last ``size`` tokens of a text."""
    return _mapped(column, "string", lambda code, text: _decoded(code, code.encode_ordinary(text)[-size:] if size > 0 else []), vocabulary)


def middle_out(column: Column | str, target: int, marker: str = "\n\n--prompt truncated for brevity--\n\n", vocabulary: str = VOCABULARY) -> Column:
    """The text cut to ``target`` tokens by removing its middle; unchanged when short enough."""
    def cut(code, text: str) -> str:
        tokens = code.encode_ordinary(text)
        spare = len(tokens) - target
        if spare <= 0:
            return text
        middle, half = len(tokens) // 2, math.floor(spare / 2 + 0.5)
        return _decoded(code, tokens[: max(0, middle - half)]) + marker + _decoded(code, tokens[middle + half :])

    return _mapped(column, "string", cut, vocabulary)
