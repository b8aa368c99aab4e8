"""An inverted file over vectors: cells around centroids, of which a query looks into the nearest.

The centroids are fitted on at most SAMPLE vectors, chosen by a hash of their id; every vector is in
the index.  Neither vectors nor queries are gathered: both meet in their cells, and a cell with more
than PART vectors is cut into parts that its queries are sent to.  The share of the true nearest
vectors that is found (recall) grows with ``probes``; with as many as there are cells it is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.retrieval import nearest as nearest_of_all
from lodestack.session import keep

SAMPLE = 20_000  # vectors the centroids are fitted on, at most
MOST_CELLS = 4_096
ROUNDS = 10
PART = 50_000  # vectors of a cell that are compared in one task


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def fit(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Centroids of (vec_id, embedding), spherical k-means on a sample; about the root of the number of vectors unless given."""
    whole = vectors.filter("embedding is not null")
    rows = whole.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()  # bounded by ``sample``
    if not rows:
        return np.empty((0, 0))
    data = _unit(np.array([r.embedding for r in rows], np.float64))
    cells = min(len(data), MOST_CELLS, cells or math.ceil(math.sqrt(len(rows) if len(rows) < sample else whole.count())))
    centroids = data[np.random.default_rng(seed).choice(len(data), cells, replace=False)]
    for _ in range(ROUNDS):
        near = (data @ centroids.T).argmax(1)
        total = np.zeros_like(centroids)
        np.add.at(total, near, data)
        centroids = np.where(total.any(1, keepdims=True), _unit(total), centroids)
    return centroids


def _celled(rows: DataFrame, key: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """(key, embedding of length 1, cell): each row in its ``probes`` nearest cells."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            data = _unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
            near = np.argsort(-(data @ shared.value.T), axis=1, kind="stable")[:, :probes]
            at = np.repeat(np.arange(len(data)), near.shape[1])
            yield pd.DataFrame({key: pdf[key].to_numpy()[at], "embedding": list(data[at].astype(np.float32)), "cell": near.ravel().astype(np.int32)})

    return rows.filter("embedding is not null").select(key, "embedding").mapInPandas(place, f"{key} long, embedding array<float>, cell int")


def build(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The index: (vec_id, embedding, cell) of every vector that is not null, as a table in the shared folder."""
    return keep(_celled(vectors, "vec_id", centroids, 1))


def probes_for(index: DataFrame, centroids: np.ndarray, queries: DataFrame, top: int = 4, target: float = 0.95, sample: int = 200) -> int:
    """Cells a query must look into so that a share of ``target`` of the true nearest vectors is found.

    Measured on at most ``sample`` queries, chosen by a hash of their id, that are held against all vectors.
    """
    some = queries.filter("embedding is not null").orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    exact = nearest_of_all(index.select("vec_id", "embedding", F.lit("").alias("namespace")), some, top).select("query_id", "vec_id")
    where = exact.join(index.select("vec_id", "cell"), "vec_id").join(some, "query_id").select("cell", "embedding").collect()  # at most sample x top rows
    if not where:
        return 1
    near = np.argsort(np.argsort(-(_unit(np.array([r.embedding for r in where], np.float64)) @ centroids.T), axis=1, kind="stable"), axis=1)
    return 1 + int(np.quantile(near[np.arange(len(where)), [r.cell for r in where]], target, method="higher"))


def search(index: DataFrame, centroids: np.ndarray, queries: DataFrame, top: int = 4, probes: int = 8) -> DataFrame:
    """(query_id, vec_id, distance, place): of each query of (query_id, embedding) the ``top`` nearest vectors in its ``probes`` nearest cells.

    Distances are rounded to six places, equal ones go by vec_id.  Empty tables give an empty result.
    """
    schema = "query_id long, vec_id long, distance double"
    if not len(centroids):
        return queries.sparkSession.createDataFrame([], schema + ", place int")
    parts = index.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))  # at most MOST_CELLS rows
    held = index.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    asked = _celled(queries, "query_id", centroids, min(probes, len(centroids))).join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def nearest(vectors: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(wanted):
            return pd.DataFrame({"query_id": [], "vec_id": [], "distance": []})
        matrix, ids = np.stack(vectors["embedding"].to_numpy()).astype(np.float64), vectors["vec_id"].to_numpy(np.int64)
        k, out = min(top, len(ids)), []
        for at in range(0, len(wanted), 512):
            block = wanted.iloc[at : at + 512]
            distance = np.round(1 - np.stack(block["embedding"].to_numpy()).astype(np.float64) @ matrix.T, 6) + 0.0
            order = np.lexsort((np.broadcast_to(ids, distance.shape), distance), axis=1)[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(block["query_id"].to_numpy(np.int64), k), "vec_id": ids[order].ravel(), "distance": np.take_along_axis(distance, order, 1).ravel()}))
        return pd.concat(out)

    found = held.select("cell", "part", "vec_id", "embedding").groupBy("cell", "part").cogroup(asked.select("cell", "part", "query_id", "embedding").groupBy("cell", "part")).applyInPandas(nearest, schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("place", place).filter(F.col("place") <= top)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (query_id, vec_id) pairs that were found."""
    total = exact.select("query_id", "vec_id").distinct().count()
    return exact.select("query_id", "vec_id").intersect(found.select("query_id", "vec_id")).count() / total if total else 1.0
