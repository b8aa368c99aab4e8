"""The vector index against brute force, and token functions against the tokenizer itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.functions import tokens
from lodestack.io import load
from lodestack.operators import index
from lodestack.operators import retrieval as V
from lodestack.plans import catalog


def table(spark, data):
    return spark.createDataFrame([(i, x) for i, x in enumerate(data)], "vec_id long, embedding array<float>")


def clustered(n, seed=1, dims=16):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, dims))
    return (centres[r.integers(0, 12, n)] + 0.4 * r.standard_normal((n, dims))).tolist()


def test_recall_of_the_index_on_the_tables(spark, folder):
    vectors = load(spark, folder, "embeddings").select("vec_id", "embedding")
    queries = vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact = V.nearest(vectors.withColumn("namespace", F.lit("")), queries, 4)
    assert index.recall(catalog.queries()["op53_vector_index"](spark, folder), exact) >= 0.9


def test_every_vector_is_in_the_index_and_hot_cells_are_cut(spark, monkeypatch):
    monkeypatch.setattr(index, "PART", 40)
    vectors = table(spark, clustered(400) + [[1.0] * 16] * 200 + [None, [0.0] * 16])
    queries = vectors.filter("vec_id % 20 = 0 and embedding is not null").withColumnRenamed("vec_id", "query_id")
    centroids = index.fit(vectors)
    built = index.build(vectors, centroids)
    assert built.count() == 601
    whole = index.search(built, centroids, queries, 5, len(centroids))
    data = np.array([r.embedding for r in vectors.filter("embedding is not null").orderBy("vec_id").collect()])
    unit = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-30)
    for q in (0, 100, 420):
        got = [(r.vec_id, r.distance) for r in whole.filter(F.col("query_id") == q).orderBy("place").collect()]
        distance = np.round(1 - unit @ unit[q], 6)
        assert np.allclose([d for _, d in got], np.sort(distance)[:5], atol=2e-6) and len({v for v, _ in got}) == 5
    some = index.search(built, centroids, queries, 5, 8)
    assert index.recall(some, whole) >= 0.9


def test_empty_index(spark):
    none = table(spark, [])
    assert len(index.fit(none)) == 0 and index.search(none, index.fit(none), none.withColumnRenamed("vec_id", "query_id")).count() == 0


TEXTS = ["", "a b c", "The harbour office closed the old risk log.", "été 😀 " * 30, "x" * 6000, None]


def test_token_functions(spark):
    from pathlib import Path

    code = tokens.encoding(Path(tokens.VOCABULARY).read_bytes())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    rows = df.select("id", tokens.count("t").alias("n"), tokens.chunks("t", 7).alias("c"), tokens.last("t", 3).alias("l"), tokens.middle_out("t", 10, "|").alias("m")).orderBy("id").collect()
    for text, r in zip(TEXTS, rows, strict=True):
        if text is None:
            assert r.n is r.c is r.l is r.m is None
            continue
        ids = code.encode_ordinary(text)
        assert r.n == (750 if len(text) >= 5120 else len(ids)) and len(r.c) == -(-len(ids) // 7)
        if text.isascii():
            assert "".join(r.c) == text and text.endswith(r.l) and (r.m == text if len(ids) <= 10 else r.m.count("|") == 1)


@pytest.mark.parametrize("name", ["op64_conversation_token_count", "op65_message_token_count", "op95_token_count", "op99_token_windows", "op99_last_tokens", "op100_middle_out_tokens"])
def test_token_queries(spark, folder, name):
    from pathlib import Path

    code = tokens.encoding(Path(tokens.VOCABULARY).read_bytes())
    got = catalog.queries()[name](spark, folder)
    if name.startswith("op6"):
        chats = load(spark, folder, "workspace_chats").drop("ingested_at").dropDuplicates(["chat_id"]).collect()
        size = lambda t: len(code.encode_ordinary(t or ""))
        want = {}
        for c in chats:
            key = (c.workspace_id, c.thread_id) if name.startswith("op64") else (c.workspace_id,)
            want[key] = want.get(key, 0 if name.startswith("op64") else 5) + (size(c.message) + size(c.textresponse) if name.startswith("op64") else 3 + size(c.message))
        assert {tuple(r)[:-1]: r.tokens for r in got.collect()} == want
        return
    docs = {r.doc_id: r.text for r in load(spark, folder, "documents").filter("text is not null").select("doc_id", "text").collect()}
    rows = got.collect()
    assert {r.doc_id for r in rows} == {k for k, t in docs.items() if t or name != "op99_token_windows"}
    if name == "op99_token_windows":
        assert all(len(code.encode_ordinary(docs[r.doc_id])) > 200 * r.ix for r in rows)
