"""Windows over keys that may be hot, budgets and sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StructField, StructType


def rolling_count(df: DataFrame, keys: Sequence[str], micros: Column, seconds: int, name: str = "recent") -> DataFrame:
    """Rows of the same key in the ``seconds`` up to and including each row's instant.

    Rows of one key and instant are counted first; the count up to an instant, less the count before
    the window's beginning, is the answer, so a key is cut into short ranges of time however hot it is.
    Rows without an instant count nothing and get null.
    """
    width = seconds * 1_000_000
    at = df.withColumn("_at", micros)
    instants = at.filter("_at is not null").groupBy(*keys, "_at").agg(F.count("*").alias("_n"))
    ends = F.array(
        F.struct((F.col("_at") - width).alias("_t"), F.lit(0).alias("_k"), F.lit(0).cast("long").alias("_m")),
        F.struct(F.col("_at").alias("_t"), F.lit(1).alias("_k"), F.col("_n").alias("_m")),
    )
    marks = instants.select(*keys, F.col("_at").alias("_of"), F.inline(ends))
    summed = running_sum(marks, keys, F.floor(F.col("_t") / max(1, width // 16)), ["_t", "_k"], F.col("_m"), "_upto")
    counts = summed.groupBy(*keys, "_of").agg(F.sum(F.when(F.col("_k") == 1, F.col("_upto") + F.col("_m")).otherwise(-F.col("_upto"))).alias("_count"))
    same = _same("r", "s", keys) & (F.col("r._at") == F.col("s._of"))
    return at.alias("r").join(counts.alias("s"), same, "left").select(*(F.col(f"r.`{c}`") for c in df.columns), F.col("s._count").alias(name))


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return test


def running_sum(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], amount: Column, name: str) -> DataFrame:
    """``name``: the sum of ``amount`` over the rows of the key before this one, null amounts as 0.

    ``bucket`` cuts the order into ranges (it must not fall while the order rises): a window holds
    one range of one key, and only the sums of ranges meet in a second, small window.  The columns
    of ``order`` must be free of nulls.
    """
    split = df.withColumn("_b", bucket).withColumn("_v", F.coalesce(amount, F.lit(0)))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = split.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    rows = split.withColumn("_inside", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    joined = rows.alias("r").join(sums.select(*keys, "_b", "_before").alias("s"), _same("r", "s", [*keys, "_b"]))
    return joined.select("r.*", (F.col("r._inside") + F.col("s._before")).alias(name)).drop("_b", "_v", "_inside")


def previous(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``name``: struct (value) of the row of the key before this one, null for the first; cut into ranges like :func:`running_sum`."""
    split = df.withColumn("_b", bucket).withColumn("_v", F.struct(value.alias("value")))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    last = split.groupBy(*keys, "_b").agg(F.max_by("_v", F.struct(*order)).alias("_last")).withColumn("_edge", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")))
    rows = split.withColumn("_inside", F.lag("_v").over(inside))
    joined = rows.alias("r").join(last.select(*keys, "_b", "_edge").alias("s"), _same("r", "s", [*keys, "_b"]))
    return joined.select("r.*", F.coalesce("r._inside", "s._edge").alias(name)).drop("_b", "_v", "_inside")


def within_budget(df: DataFrame, keys: Sequence[str], order: str, cost: Column, budget: int, width: int = 10_000) -> DataFrame:
    """Rows taken in the order of a whole number while the cost of the rows before is under the budget: the last may overshoot."""
    return running_sum(df, keys, F.floor(F.col(order) / width), [order], cost, "_before").filter(F.col("_before") < budget).drop("_before")


def sessions(df: DataFrame, keys: Sequence[str], micros: Column, gap_seconds: int, tie: str, days: int = 7) -> DataFrame:
    """``session``: number of the key's run of rows at most ``gap_seconds`` apart (a sliding time to live).

    Rows without an instant are left out; the time line of a key is cut into ranges of ``days``.
    """
    timed = df.withColumn("_at", micros).filter("_at is not null")
    bucket = F.floor(F.col("_at") / (days * 86_400_000_000))
    linked = previous(timed, keys, bucket, ["_at", tie], F.col("_at"), "_prev")
    fresh = F.coalesce((F.col("_at") - F.col("_prev.value") > gap_seconds * 1_000_000).cast("int"), F.lit(0))
    flagged = linked.withColumn("_new", fresh).drop("_prev")
    counted = running_sum(flagged, keys, bucket, ["_at", tie], F.col("_new"), "_sum")
    return counted.withColumn("session", (F.col("_sum") + F.col("_new")).cast("long")).drop("_at", "_new", "_sum")


def holds(df: DataFrame, keys: Sequence[str], micros: Column, ttl: Column, tie: str, days: int = 7) -> DataFrame:
    """(columns of ``df``, fresh): whether a row starts a hold of its key: the first row, and each one more than ``ttl`` microseconds after the last that did.

    Rows in between do not renew the hold.  A row more than ``ttl`` after the one before always starts one, so the time line of a key falls into runs that
    are walked on their own, in order, with nothing held but the last start.  Rows without an instant are left out.
    """
    timed = df.withColumn("_at", micros).withColumn("_ttl", ttl).filter("_at is not null")
    bucket = F.floor(F.col("_at") / (days * 86_400_000_000))
    linked = previous(timed, keys, bucket, ["_at", tie], F.col("_at"), "_prev")
    first = F.col("_prev").isNull() | (F.col("_at") - F.col("_prev.value") > F.col("_ttl"))
    flagged = linked.withColumn("_first", first).drop("_prev")
    run = running_sum(flagged, keys, bucket, ["_at", tie], F.col("_first").cast("int"), "_run").withColumn("_run", F.col("_run") + F.col("_first").cast("int"))
    columns, ordered = df.columns, run.repartition(*keys, "_run").sortWithinPartitions(*keys, "_run", "_at", tie)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0
        for pdf in batches:
            fresh = []
            for start, at, wait in zip(pdf["_first"], pdf["_at"], pdf["_ttl"], strict=True):
                new = start or at - last > wait
                last = at if new else last
                fresh.append(bool(new))
            yield pdf[columns].assign(fresh=fresh)

    return ordered.mapInPandas(walk, StructType([*df.schema.fields, StructField("fresh", BooleanType())]))


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable, start: object, state: str) -> DataFrame:
    """(columns of ``df``, before, after): a state carried through the rows of each key in order.

    ``step(state, row)`` gives the next state, ``row`` a tuple of the columns; ``state`` is its Spark type.  Rows
    stream through a task in order and only the state is held, so a key may have any number of rows.
    """
    columns = df.columns
    ordered = df.withColumn("_g", F.to_json(F.struct(*keys))).repartition("_g").sortWithinPartitions("_g", *order)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, start
        for pdf in batches:
            before, after = [], []
            for g, *row in zip(pdf["_g"], *(pdf[c] for c in columns), strict=True):
                if g != key:
                    key, now = g, start
                before.append(now)
                now = step(now, tuple(row))
                after.append(now)
            yield pdf[columns].assign(before=before, after=after)

    extra = StructType.fromDDL(f"before {state}, after {state}").fields
    return ordered.mapInPandas(walk, StructType([*df.schema.fields, *extra]))


def changes(df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: Column, days: int = 30) -> DataFrame:
    """Rows whose value differs from that of the row before (``previous``); the first row of a key is no change. Rows without an instant come last."""
    timed = df.withColumn("_at", F.coalesce(F.unix_micros(ts), F.lit(2**62)))
    place = F.floor(F.col(tie) / 10_000) if isinstance(df.schema[tie].dataType, NumericType) else F.ascii(tie) * 0x200000 + F.ascii(F.substring(tie, 2, 1))
    bucket = F.when(F.col("_at") < 2**62, F.floor(F.col("_at") / (days * 86_400_000_000))).otherwise(F.lit(2**42) + place)
    linked = previous(timed, keys, bucket, ["_at", tie], value, "_prev")
    changed = linked.filter(F.col("_prev").isNotNull() & ~value.eqNullSafe(F.col("_prev.value")))
    return changed.withColumn("previous", F.col("_prev.value")).drop("_prev", "_at")
