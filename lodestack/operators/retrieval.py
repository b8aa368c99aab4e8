"""Similarity search, source windows and context assembly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.session import keep

QUERIES_AT_ONCE = 2_000  # query vectors broadcast in one block
BLOCKS_HELD = 8  # blocks of queries the driver holds at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a vector of length 0 or null."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similarity(distance: Column, compat: bool = False) -> Column:
    """Similarity of a cosine distance: null gives 0, a negative distance 1 - its size.

    ``compat`` gives distances of 1 and more the similarity 1, as the system users come from does;
    without it they give 1 - distance.
    """
    out = F.when(distance.isNull(), 0.0)
    if compat:
        out = out.when(distance >= 1, 1.0)
    return out.when(distance < 0, 1 - F.abs(distance)).otherwise(1 - distance)


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 4, same_namespace: bool = False) -> DataFrame:
    """(query_id, vec_id, distance, place): the ``top`` nearest vectors of each query by cosine distance.

    ``vectors`` has (namespace, vec_id, embedding), ``queries`` (query_id, embedding) and with
    ``same_namespace`` a namespace, whose vectors alone are searched.  Every vector is held against
    every query: queries, a stated set, are read and broadcast in blocks of about QUERIES_AT_ONCE,
    a batch of vectors meets a block in one matrix product, and only each task's nearest leave it,
    so no exchange moves a vector.  Vectors of length 0 have a null distance and come last; null
    vectors are left out; equal distances go by vec_id.
    """
    top = max(1, top)
    total = queries.count()
    blocks = max(1, -(-2 * total // QUERIES_AT_ONCE))
    found = None
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).filter("embedding is not null")
        rows = block.select("query_id", "embedding", (F.col("namespace") if same_namespace else F.lit("")).cast("string").alias("namespace")).collect()
        near, shared = _nearest_of(vectors, rows, top, same_namespace)
        if blocks > BLOCKS_HELD:  # the answers of a block are written, and its queries leave the driver
            near = keep(near)
            shared.destroy()
        found = near if found is None else found.unionByName(near)
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def _nearest_of(vectors: DataFrame, rows: list, top: int, same_namespace: bool) -> tuple:
    """The nearest vectors each task finds for one block of queries, and the block as it was sent."""
    ids = np.array([r.query_id for r in rows], np.int64)
    matrix = _unit(np.array([r.embedding for r in rows], np.float64)) if rows else np.empty((0, 0))
    spaces = np.array([r.namespace for r in rows], object)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix, spaces))

    def hold(batches):
        names, block, wanted = shared.value
        best_d = np.empty((len(names), 0))
        best_v = np.empty((len(names), 0), np.int64)
        for pdf in batches:
            given = pdf[pdf["embedding"].notna()]
            if not len(names) or not len(given):
                continue
            distance = np.round(1 - block @ _unit(np.stack(given["embedding"].to_numpy()).astype(np.float64)).T, 6) + 0.0
            number = given["vec_id"].to_numpy(np.int64)
            v = np.broadcast_to(number, distance.shape)
            if same_namespace:
                other = given["namespace"].to_numpy(object)[None, :] != wanted[:, None]
                distance, v = np.where(other, np.inf, distance), np.where(other, -1, v)
            d, v = np.concatenate((best_d, distance), 1), np.concatenate((best_v, v), 1)
            order = np.lexsort((v, d, v < 0), axis=1)[:, :top]
            best_d, best_v = np.take_along_axis(d, order, 1), np.take_along_axis(v, order, 1)
        if best_d.size:
            k = best_d.shape[1]
            out = pd.DataFrame({"query_id": np.repeat(names, k), "vec_id": best_v.ravel(), "distance": best_d.ravel()})
            out = out[out["vec_id"] >= 0] if same_namespace else out
            yield out.assign(distance=out["distance"].astype(object).where(out["distance"].notna(), None))

    space = F.col("namespace").cast("string").alias("namespace") if same_namespace else F.lit("").alias("namespace")
    return vectors.select("vec_id", "embedding", space).mapInPandas(hold, "query_id long, vec_id long, distance double"), shared


def search(vectors: DataFrame, queries: DataFrame, top: int = 4, threshold: float | None = 0.25, pinned: DataFrame | None = None, compat: bool = False, same_namespace: bool = False) -> DataFrame:
    """:func:`nearest` with a score: first the nearest ``top``, then the threshold, then pinned vectors removed, so fewer may be left."""
    scored = nearest(vectors, queries, top, same_namespace).withColumn("score", F.round(similarity(F.col("distance"), compat), 6))
    if threshold is not None:
        scored = scored.filter(F.col("score") >= threshold)
    return scored.join(pinned.select("vec_id").distinct(), "vec_id", "left_anti") if pinned is not None else scored


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, np.nan, norm)


def backfill(hits: DataFrame, history: DataFrame, n: int, pinned: DataFrame | None = None) -> DataFrame:
    """(key, id, score, text, origin): search hits first, then sources of the history newest first, at most ``n`` a key.

    hits: (key, id, score, text, place); history: (key, id, score, text, turn, place).  A source
    needs a score and a text, is taken once, and never where it is pinned: (key, id), or (id) for all keys.
    """
    a = hits.select("key", "id", "score", "text", F.lit(0).alias("origin"), F.lit(0).cast("long").alias("age"), F.col("place").cast("long").alias("place"))
    b = history.filter("score is not null and text is not null").select("key", "id", "score", "text", F.lit(1).alias("origin"), (-F.col("turn")).cast("long").alias("age"), F.col("place").cast("long").alias("place"))
    both = a.unionByName(b)
    if pinned is not None:
        on = [c for c in ("key", "id") if c in pinned.columns]
        both = both.join(pinned.select(*on).distinct(), on, "left_anti")
    first = both.groupBy("key", "id").agg(F.min(F.struct("origin", "age", "place", "score", "text")).alias("s")).select("key", "id", "s.*")
    place = F.row_number().over(Window.partitionBy("key").orderBy("origin", "age", "place", "id"))
    return first.withColumn("_n", place).filter(F.col("_n") <= n).select("key", "id", "score", "text", "origin")


def overlap_score(query: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: sigmoid of the number of the query's words the text has, less two."""
    words = F.array_distinct(F.filter(F.split(F.lower(query), r"[^a-z0-9]+"), lambda w: F.length(w) > 3))
    shared = F.size(F.array_intersect(words, F.array_distinct(F.split(F.lower(text), r"[^a-z0-9]+"))))
    return F.round(1 / (1 + F.exp(-(shared - 2).cast("double"))), 6)


def rerank(candidates: DataFrame, score: Column, keys: list[str], top: int = 4) -> DataFrame:
    """The best ``top`` candidates of each key by a score; equal scores by id."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return candidates.withColumn("score", score).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
