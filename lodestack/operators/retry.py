"""Bounded retries over the rows that still fail, and chains of steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retry(df: DataFrame, passed: Column, step: Callable[[DataFrame], DataFrame], attempts: int) -> DataFrame:
    """``step`` applied up to ``attempts`` times to the rows that have not passed; a null test has not passed.

    The plan grows by a fixed number of branches (the bound is a constant), without actions.
    """
    ok = F.coalesce(passed, F.lit(False))
    done, left = df.filter(ok), df.filter(~ok)
    for turn in range(attempts):
        tried = step(left)
        if turn == attempts - 1:
            return done.unionByName(tried)
        done, left = done.unionByName(tried.filter(ok)), tried.filter(~ok)
    return df


def flow(df: DataFrame, blocks: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for block in blocks:
        df = block(df)
    return df
