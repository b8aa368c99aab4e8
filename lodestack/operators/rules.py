"""Routing rules kept as tables: conditions over properties of a request, the first rule by priority that holds.

rules: (rule_id, priority, enabled, logic, target), logic AND or OR; conditions: (rule_id, property,
comparator, value).  Rules are configuration: they are read once and become one column expression,
so that requests are evaluated where they stand.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_RULES = 10_000
TEXT_READ = 10_000  # characters of a text that a pattern is tried on, as in the rules' definition
NUMBERS = ("gt", "gte", "lt", "lte", "between")


def _pattern(spark: SparkSession, value: str) -> str | None:
    """The pattern of ``/pattern/flags`` or ``pattern`` (then without regard to case); None where it is none."""
    value = value.strip()
    m = re.fullmatch(r"/(.+)/([gimsuy]*)", value, re.S)
    body, flags = (m[1], m[2] or "i") if m else (value, "i")
    inline = "".join(f for f in "ims" if f in flags)
    if not body:
        return None
    pattern = f"(?{inline}){body}" if inline else body
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001  (any refusal by the pattern compiler)
        return None
    return pattern


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def condition(spark: SparkSession, subject: Column, numeric: bool, comparator: str, value: str) -> Column:
    """One condition; unknown comparators, bad patterns and values that are no numbers hold for nothing."""
    if numeric:
        n = subject.cast("double")
        if comparator == "between":
            parts = [_number(x) for x in value.split(",")]
            test = n.between(*parts) if len(parts) == 2 and None not in parts else F.lit(False)
        else:
            operand = _number(value)
            tests = {"gt": n > operand, "gte": n >= operand, "lt": n < operand, "lte": n <= operand, "eq": n == operand, "neq": n != operand} if operand is not None else {}
            test = tests.get(comparator, F.lit(False))
        return F.coalesce(test, F.lit(False))
    text = F.coalesce(subject.cast("string"), F.lit(""))
    low = F.lower(text)
    if comparator == "contains":
        words = [w for w in (x.strip().lower() for x in value.split(",")) if w]
        test = F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w)) if words else F.lit(False)
    elif comparator == "matches":
        pattern = _pattern(spark, value)
        test = F.substring(text, 1, TEXT_READ).rlike(pattern) if pattern else F.lit(False)
    else:
        test = {"eq": low == value.lower(), "neq": low != value.lower()}.get(comparator, F.lit(False))
    return test


def route(requests: DataFrame, rules: DataFrame, conditions: DataFrame, properties: dict[str, Column], numeric: tuple[str, ...] = (), fallback: str = "fallback") -> Column:
    """The target of the first enabled rule, by priority and id, whose conditions hold (a rule without any never does); else the fallback."""
    spark = requests.sparkSession
    held: dict = {}
    for c in conditions.limit(20 * MOST_RULES).collect():  # configuration, not data
        subject = properties.get(c.property)
        held.setdefault(c.rule_id, []).append(F.lit(False) if subject is None else condition(spark, subject, c.property in numeric, c.comparator, c.value or ""))
    out = F.lit(None).cast("string")
    steps = []
    for r in rules.filter("enabled").orderBy("priority", "rule_id").limit(MOST_RULES + 1).collect():
        tests = held.get(r.rule_id, [])
        if tests:
            met = tests[0]
            for t in tests[1:]:
                met = (met | t) if (r.logic or "AND").upper() == "OR" else (met & t)
            steps.append(F.when(met, F.lit(r.target)))
    if len(steps) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return F.coalesce(*steps, out, F.lit(fallback))
