"""Filters, lookups and pages over any table, as compositions of DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ABSENT = object()


class Once:
    """Rows of ``df`` without repeated deliveries, one a ``key``.

    Repeats of a key carry the same content, so a filter keeps all of them or none: filters go to the
    table itself, where the scan can use them, and repeats are dropped when anything else is asked.
    Columns that a query leaves out are not moved.
    """

    def __init__(self, df: DataFrame, key: str):
        self._df, self._key = df, key

    def filter(self, condition: Column | str) -> Once:
        return Once(self._df.filter(condition), self._key)

    def dropna(self, subset: Sequence[str]) -> Once:
        return Once(self._df.dropna(subset=list(subset)), self._key)

    def select(self, *columns: Column | str) -> DataFrame:
        if all(isinstance(c, str) for c in columns) and self._key in columns:
            return self._df.select(*columns).distinct()
        return self.rows().select(*columns)

    def rows(self) -> DataFrame:
        return self._df.dropDuplicates([self._key])

    def __getitem__(self, column: str) -> Column:
        return self._df[column]

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.rows(), name)


def where(df: DataFrame, **clause: Any) -> DataFrame:
    """Rows that equal the clause in every column: None means null, ABSENT means no condition, a list means any of."""
    for name, value in clause.items():
        column = F.col(f"`{name}`")
        if value is ABSENT:
            continue
        if isinstance(value, list | tuple | set):
            df = df.filter(column.isin(list(value)))
        else:
            df = df.filter(column.isNull() if value is None else column == F.lit(value))
    return df


def page(df: DataFrame, order: Sequence[Column], size: int, number: int = 0) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows in a total order; sizes under 1 count as 1."""
    size = max(1, size)
    return df.orderBy(*order).offset(max(0, number) * size).limit(size)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``; null keys are a key. Spark keeps n rows a key before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def first_delivery(df: DataFrame, key: str, arrived: str) -> DataFrame:
    """One row per key, the one that arrived first: a map-side aggregate, no window over a hot key."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    whole = F.struct(*columns)
    best = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(whole, F.coalesce(F.col(arrived), F.lit("9999-12-31").cast("timestamp"))).alias("_row"))
    return best.select("_row.*")


def lookup(df: DataFrame, other: DataFrame, on: Column, labels: dict[str, tuple[str, Any]]) -> DataFrame:
    """Left lookup: columns ``labels[new] = (column of other, default where nothing is found)``."""
    joined = df.join(other, on, "left")
    return joined.select(*[df[c] for c in df.columns], *[F.coalesce(other[c], F.lit(d)).alias(new) for new, (c, d) in labels.items()])


def counted(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, name: str = "children") -> DataFrame:
    """Each parent with the number of its children, zero included; children are counted before the join."""
    per = children.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_parent")).agg(F.count("*").alias(name))
    return parents.join(per, parents[parent_key] == per["_parent"], "left").drop("_parent").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys; null keys never match."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def stable(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order`` (duplicates dropped, first kept)."""
    return latest(df, keys, order, 1)
