"""Text cut off by field limits.

For each source (and unit: characters or bytes) the hazard of a length is the share of the values
at least that long which end exactly there.  Each hazard is tested against the pooled hazards of
the neighbouring lengths by an exact binomial tail, with the false discovery rate held by the
Benjamini-Hochberg step-up rule, all as window functions over the counts.  Unfinished endings at significant lengths are cuts;
values cut in transfer, at no fixed length, are found by the ending alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestack.llm import endings
from lodestack.session import cut

NEIGHBOURS = 25  # lengths on either side that a hazard is held against
CLOSE = 3  # and the nearest of them, so that a hump of usual lengths is no spike
FDR = 0.001


@F.pandas_udf(DoubleType())
def _log10_tail(hits: pd.Series, at_risk: pd.Series, hazard: pd.Series) -> pd.Series:
    """log10 of the chance of at least ``hits`` ends among ``at_risk`` values at this hazard: the exact binomial tail."""
    k, n, p = (x.to_numpy(np.float64) for x in (hits, at_risk, hazard))
    p = np.clip(p, 1e-300, 1 - 1e-12)
    log = np.frompyfunc(math.lgamma, 1, 1)
    out = (log(n + 1) - log(k + 1) - log(n - k + 1)).astype(np.float64) + k * np.log(p) + (n - k) * np.log1p(-p)
    term, total, step = np.ones(len(k)), np.ones(len(k)), k.copy()
    going = k > n * p  # below its expectation nothing is a spike
    out[~going] = 0.0
    while going.any():
        term = np.where(going, term * (n - step) / (step + 1) * p / (1 - p), 0.0)
        total += term
        step += 1
        going = term > total * 1e-12
    return pd.Series(np.minimum(0.0, (out + np.log(total)) / math.log(10)))


def significant_lengths(lengths: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(source, length, hits, hazard, around) for the lengths of (source, length) at which values are cut.

    Values at risk are those of ``lengths``; with ``ends``, (source, length) of the unfinished ones,
    only these count as ends, so that a length at which many whole values happen to end is no limit.
    ``around`` is the greater of two pooled hazards: ends by values at risk over all NEIGHBOURS
    lengths on either side, and over the CLOSE ones.  Lengths that no value has count with the
    values at risk there.
    """
    source = Window.partitionBy("source")
    down = source.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    values = lengths.select("source", "length").withColumn("end", F.lit(1 if ends is None else 0)).withColumn("value", F.lit(1))
    if ends is not None:
        values = values.unionByName(ends.select("source", "length", F.lit(1).alias("end"), F.lit(0).alias("value")))
    counts = values.groupBy("source", "length").agg(F.sum("end").alias("hits"), F.sum("value").alias("values"))
    every = counts.select("source", F.explode(F.sequence(F.greatest(F.col("length") - NEIGHBOURS, F.lit(1)), F.col("length") + NEIGHBOURS)).alias("length")).distinct()
    risk = every.join(counts, ["source", "length"], "left").withColumn("hits", F.coalesce("hits", F.lit(0))).withColumn("at_risk", F.sum(F.coalesce("values", F.lit(0))).over(down))

    def pooled(width: int):
        near = source.orderBy("length").rangeBetween(-width, width)
        return (F.sum("hits").over(near) - F.col("hits") + 0.5) / F.greatest(F.sum("at_risk").over(near) - F.col("at_risk"), F.lit(1))

    tested = (
        risk.withColumn("around", F.greatest(pooled(NEIGHBOURS), pooled(CLOSE)))
        .filter("hits > 0")
        .withColumn("hazard", F.col("hits") / F.col("at_risk"))
        .withColumn("tail", _log10_tail("hits", "at_risk", "around"))
        .withColumn("tests", F.count("*").over(source))
        .withColumn("place", F.row_number().over(source.orderBy("tail", "length")))
        .withColumn("passes", F.col("tail") <= F.log10(F.lit(FDR) * F.col("place") / F.col("tests")))
        .withColumn("last", F.max(F.when(F.col("passes"), F.col("place"))).over(source))
    )
    return tested.filter(F.col("place") <= F.col("last")).select("source", "length", "hits", "hazard", "around")


def _values(df: DataFrame, key: str, source: str, fields: list[str]) -> DataFrame:
    """(key, field, origin, value), each delivered value once."""
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("origin"), F.explode(cells).alias("cell"))
    values = rows.select("key", "origin", "cell.field", "cell.value").filter("key is not null and value is not null").distinct()
    return values.withColumn("mark", F.xxhash64("value"))


def cut_values(df: DataFrame, key: str, source: str, fields: list[str]) -> DataFrame:
    """(key, field, origin, cut, at_limit) for every value of the fields that is not null.

    Empty values are complete; null keys and values have no row.  Null sources are one source.  A value is cut where its structure or
    its last words show it, or where it is unfinished at a length (characters or bytes) that the
    source cuts at.  Repeated rows count once.
    """
    values = cut(_values(df, key, source, fields))
    kind = df.schema[key].dataType.simpleString()

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = [endings.endings(v) for v in pdf["value"]]
            last = iter(endings.last_grams([e.core for found in ends for e in found if e.state == "unsure"]))
            unsure = [[(*next(last), e.item, e.style) for e in found if e.state == "unsure"] for found in ends]
            yield pd.DataFrame(
                {
                    "key": pdf["key"], "mark": pdf["mark"], "field": pdf["field"], "origin": pdf["origin"],
                    "state": [found[0].state for found in ends],
                    "ends": [[dict(zip(("grams", "digits", "item", "style"), e, strict=True)) for e in found] for found in unsure],
                    "chars": [len(v) for v in pdf["value"]], "bytes": [len(v.encode("utf-8", "replace")) for v in pdf["value"]],
                }
            )

    seen = cut(values.mapInPandas(look, f"key {kind}, mark long, field string, origin string, state string, ends array<struct<grams: array<long>, digits: boolean, item: boolean, style: string>>, chars int, bytes int"))
    units = F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")))
    name = F.concat_ws("\t", F.coalesce("origin", F.lit("\0")), "field", "u.unit")
    lengths = seen.filter("chars > 0").withColumn("u", F.explode(units)).select("mark", name.alias("source"), "u.length").distinct()
    limits = significant_lengths(lengths).select("source", "length")
    ids = ["key", "field", "mark"]
    unsure = seen.filter("state = 'unsure'").select(*ids, "origin", F.posexplode("ends").alias("which", "end")).select(*ids, "origin", "which", "end.*")
    decided = endings.decide(unsure, endings.evidence(values, "value", unsure), [*ids, "which"])
    judged = decided.groupBy(*ids, "origin").agg(F.bool_or("cut").alias("cut"))
    here = seen.withColumn("u", F.explode(units)).withColumn("source", name).select(*ids, "origin", "state", "source", F.col("u.length").alias("length"))
    limit = here.join(limits, ["source", "length"], "left_semi").select(*ids, "origin").distinct().withColumn("at_limit", F.lit(True))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*ids, "origin")]
    merged = seen.select(*ids, "origin", "state").alias("a").join(judged.alias("b"), same, "left").select("a.*", "b.cut")
    merged = merged.alias("a").join(limit.alias("b"), same, "left").select("a.*", F.coalesce("b.at_limit", F.lit(False)).alias("at_limit"))
    lost = (F.col("state") == "cut") | ((F.col("state") == "unsure") & (F.coalesce("cut", F.lit(False)) | F.col("at_limit")))
    return merged.select("key", "field", "origin", lost.alias("cut"), "at_limit").distinct()


def cut_rates(cuts: DataFrame) -> DataFrame:
    """(origin, field, total, cut, at_limit, rate): how often each source loses ends in each field."""
    counted = cuts.groupBy("origin", "field").agg(F.count("*").alias("total"), F.count_if("cut").alias("cut"), F.count_if(F.col("cut") & F.col("at_limit")).alias("at_limit"))
    return counted.withColumn("rate", F.round(F.col("cut") / F.col("total"), 6))
