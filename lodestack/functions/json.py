"""JSON in string columns: paths, repair of truncated values, and model output."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def path(column: str | Column, where: str) -> Column:
    """The value at a path as text; null where the JSON is invalid or has nothing there."""
    return F.try_variant_get(F.try_parse_json(column), where, "string")


def without(column: str | Column, *keys: str) -> Column:
    """A flat JSON object without some keys, as text; values keep their JSON type."""
    pairs = F.from_json(column, "map<string,string>")
    return F.concat(
        F.lit("{"),
        F.array_join(F.transform(F.map_entries(F.map_filter(pairs, lambda k, _: ~k.isin(list(keys)))), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","),
        F.lit("}"),
    )


TOKEN = re.compile(r'(?P<string>"(?:[^"\\]|\\.)*")|(?P<open>[{\[])|(?P<end>[}\]])|(?P<torn>")|(?P<other>[^\s,:"{}\[\]]+)', re.S)


def close(text: str) -> str:
    """A truncated JSON text cut back to its last whole token, with what is open there closed.

    An unfinished string and trailing commas and colons are dropped; a key without a value stays, so that the text is no JSON then.
    """
    expected, whole = [], 0
    for m in TOKEN.finditer(text):
        if m.lastgroup == "torn":
            break
        if m.lastgroup == "open":
            expected.append("}" if m.group() == "{" else "]")
            continue
        if m.lastgroup == "end" and expected:
            expected.pop()
        whole = m.end()
    return text[:whole] + "".join(reversed(expected))


FENCED = re.compile(r"```(?:json)?\s*(\{.*\})\s*```", re.S)


def body(text: str) -> str:
    """The part of model output that should be JSON: inside a fence, else from the first brace to the last one, or to the end."""
    fenced = FENCED.search(text)
    held = fenced.group(1) if fenced else text
    start, end = held.find("{"), held.rfind("}")
    return held if start < 0 else held[start : end + 1] if end > start else held[start:]


def parse(text: str) -> dict | None:
    """The JSON object of model output (see :func:`body`), parsed as it is, else repaired; None if that fails."""
    held = body(text)
    for attempt in (held, close(held)):
        try:
            value = json.loads(attempt)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return None


def extract(column: str | Column) -> Column:
    """Struct (value, parse_error): the object as compact JSON with sorted keys, or the raw text and true."""

    @F.pandas_udf("struct<value:string,parse_error:boolean>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            found = None if text is None else parse(text)
            out.append((text, text is not None) if found is None else (json.dumps(found, sort_keys=True, ensure_ascii=False), False))
        return pd.DataFrame(out, columns=["value", "parse_error"])

    return run(F.col(column) if isinstance(column, str) else column)


def get(value: object, where: str) -> str:
    """Value at ``a.b[0]['c']`` of a parsed JSON value as text: objects as JSON, "" where there is nothing."""
    for dot, index, quoted in re.findall(r"([^.\[\]]+)|\[(\d+)\]|\[[\"']([^\"']+)[\"']\]", where):
        if index:
            value = value[int(index)] if isinstance(value, list) and int(index) < len(value) else None
        else:
            value = value.get(dot or quoted) if isinstance(value, dict) else None
        if value is None:
            return ""
    return json.dumps(value) if isinstance(value, dict | list) else str(value)


def substitute(template: str, variables: dict) -> str:
    """``${path}`` replaced by the value at the path; unknown paths stay as they are."""
    return re.sub(r"\$\{([^}]+)\}", lambda m: get(variables, m.group(1)) or m.group(0), template)
