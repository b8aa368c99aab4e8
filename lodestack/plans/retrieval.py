"""Queries of similarity search and context assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import index
from lodestack.operators import relational as R
from lodestack.operators import retrieval as V
from lodestack.plans.registry import query
from lodestack.plans.relational import CHATS, chats

DISTANCE = "round(1 - list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 6)"


def vectors(t):
    return t.embeddings.select(F.col("label").alias("namespace"), "vec_id", "embedding")


def probes(t):
    """The query vectors: every vector whose id is divisible by 20."""
    return t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("namespace"))


def _near(condition: str, top: int, where: str = "true") -> str:
    return f"select q.vec_id as query_id, v.vec_id, v.label, {DISTANCE} as distance, row_number() over (partition by q.vec_id order by {DISTANCE}, v.vec_id) as place from embeddings v join embeddings q on {condition} where {where} qualify place <= {top}"


@query("op53_vector_topk", f"select query_id, vec_id, abs(distance) as distance, place::int as place from ({_near('q.vec_id % 20 = 0', 4)})")
def _(t):
    """The four nearest vectors of each query vector over the whole collection."""
    return V.search(vectors(t), probes(t).drop("namespace"), 4, None).select("query_id", "vec_id", F.abs("distance").alias("distance"), "place")


@query("op53_vector_index")
def _(t):
    """The same by an inverted file over all vectors; how many cells a query looks into is measured, for a recall of 0.95."""
    centroids, wanted = index.fit(vectors(t)), probes(t).select("query_id", "embedding")
    built = index.build(vectors(t), centroids)
    return index.search(built, centroids, wanted, 4, index.probes_for(built, centroids, wanted))


@query("op83_topn_then_threshold", f"select query_id, vec_id, round(1 - distance, 6) as score from ({_near('q.vec_id % 20 = 0 and q.label = v.label', 10)}) where round(1 - distance, 6) >= 0.2 and vec_id % 7 <> 3")
def _(t):
    pinned = t.embeddings.filter("vec_id % 7 = 3").select("vec_id")
    return V.search(vectors(t), probes(t), 10, 0.2, pinned, same_namespace=True).select("query_id", "vec_id", "score")


@query("op126_similarity_ladder", "select event_id, case when value is null then 0.0 when value / 50 - 0.5 < 0 then round(1 - abs(value / 50 - 0.5), 6) else round(1 - (value / 50 - 0.5), 6) end as sane, case when value is null then 0.0 when value / 50 - 0.5 >= 1 then 1.0 when value / 50 - 0.5 < 0 then round(1 - abs(value / 50 - 0.5), 6) else round(1 - (value / 50 - 0.5), 6) end as compat from events")
def _(t):
    d = F.col("value") / 50 - 0.5
    return t.events.select("event_id", F.round(V.similarity(d), 6).alias("sane"), F.round(V.similarity(d, True), 6).alias("compat"))


@query("op127_zero_is_null", "select event_id, nullif(round(value, 0), 0) as score from events")
def _(t):
    return t.events.select("event_id", F.nullif(F.round("value", 0), F.lit(0.0)).alias("score"))


@query("op128_parameter_fallback", "select workspace_id, case when similarity_threshold is null or isnan(similarity_threshold) or similarity_threshold < 0 or similarity_threshold > 1 then 0.25 else similarity_threshold end as threshold from workspaces")
def _(t):
    s = F.col("similarity_threshold")
    return t.workspaces.select("workspace_id", F.when(s.isNull() | F.isnan(s) | ~s.between(0, 1), 0.25).otherwise(s).alias("threshold"))


def _history(t, n: int, score: float, pinned=None):
    """Sources of each query's namespace, newest first: the newest ``n`` that are not pinned, as no more can be filled in (a window and its hits)."""
    held = vectors(t).select("namespace", "vec_id")
    if pinned is not None:
        held = held.join(pinned.select(F.col("id").alias("vec_id")), "vec_id", "left_anti")
    newest = R.latest(held, ["namespace"], [F.desc("vec_id")], n)
    return probes(t).select(F.col("query_id").alias("key"), "namespace").join(newest, "namespace").select("key", F.col("vec_id").alias("id"), F.lit(score).alias("score"), F.lit("past").alias("text"), F.col("vec_id").alias("turn"), F.lit(0).alias("place"))


@query(
    "op92_source_backfill",
    f"""with hits as (select query_id as key, vec_id as id, round(1 - distance, 6) as score, place from ({_near('q.vec_id % 20 = 0', 4)}) where 1 - distance >= 0.3 and vec_id % 5 <> 1),
    hist as (select q.vec_id as key, v.vec_id as id, 0.5 as score, v.vec_id as turn from embeddings q join embeddings v on v.label = q.label where q.vec_id % 20 = 0 and v.vec_id % 5 <> 1),
    b as (select key, id, score, 0 as origin, 0 as age, place from hits union all select key, id, score, 1, -turn, 0 from hist), f as (select *, row_number() over (partition by key, id order by origin, age, place) r from b),
    n as (select *, row_number() over (partition by key order by origin, age, place, id) k from f where r = 1) select key, id, score::double as score, origin::int as origin from n where k <= 8""",
)
def _(t):
    hits = V.search(vectors(t), probes(t).drop("namespace"), 4, 0.3).select(F.col("query_id").alias("key"), F.col("vec_id").alias("id"), "score", F.lit("hit").alias("text"), "place")
    pins = t.embeddings.filter("vec_id % 5 = 1").select(F.col("vec_id").alias("id"))
    past = _history(t, 8 + 4, 0.5, pins)
    return V.backfill(hits, past, 8, pins).select("key", "id", "score", "origin")


def _overlap_sql(q: str, x: str) -> str:
    words = f"list_distinct(list_filter(string_split_regex(lower({q}), '[^a-z0-9]+'), lambda w: length(w) > 3))"
    return f"round(1 / (1 + exp(-(len(list_intersect({words}, list_distinct(string_split_regex(lower({x}), '[^a-z0-9]+')))) - 2)::double)), 6)"


@query("op84_rerank", f"select workspace_id, id, score from (select w.workspace_id, c.chat_id as id, {_overlap_sql('w.title', 'c.message')} as score, row_number() over (partition by w.workspace_id order by {_overlap_sql('w.title', 'c.message')} desc, c.chat_id) as place from workspaces w join {CHATS} c using (workspace_id) where c.message is not null and w.title is not null) where place <= 4")
def _(t):
    """Chats of each workspace by a stand-in relevance score to its title, best four."""
    df = chats(t).filter("message is not null").join(t.workspaces.filter("title is not null").select("workspace_id", "title"), "workspace_id").select("workspace_id", "title", F.col("chat_id").alias("id"), "message")
    return V.rerank(df, V.overlap_score(F.col("title"), F.col("message")), ["workspace_id"]).select("workspace_id", "id", "score")


@query("op152_knowledge_block", f"select query_id, coalesce(string_agg('- From [' || label || ']: ' || vec_id, chr(10) order by place) filter (where 1 - distance >= 0.5), 'none found') as block from ({_near('q.vec_id % 20 = 0', 3)}) group by 1")
def _(t):
    near = V.search(vectors(t), probes(t).drop("namespace"), 3, None).join(t.embeddings.select("vec_id", "label"), "vec_id")
    line = F.when(F.col("score") >= 0.5, F.struct("place", F.concat(F.lit("- From ["), F.col("label").cast("string"), F.lit("]: "), F.col("vec_id").cast("string")).alias("text")))
    lines = near.groupBy("query_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))  # at most three a query
    return lines.select("query_id", F.when(F.size("lines") > 0, F.array_join(F.transform("lines", lambda x: x["text"]), "\n")).otherwise("none found").alias("block"))


@query("op153_research_query", "select workspace_id, 'Background on ' || coalesce(title, 'the tender') || ' (' || coalesce(chat_mode, 'general') || ')' as question from workspaces")
def _(t):
    return t.workspaces.select("workspace_id", F.concat(F.lit("Background on "), F.coalesce("title", F.lit("the tender")), F.lit(" ("), F.coalesce("chat_mode", F.lit("general")), F.lit(")")).alias("question"))


@query("op149_query_context")
def _(t):
    """Query-mode context of each question: pinned vectors, hits above the threshold, backfill, refusal where nothing is left."""
    hits = V.search(vectors(t), probes(t), 4, 0.3, same_namespace=True)
    source = hits.select(F.col("query_id").alias("key"), F.col("vec_id").alias("id"), "score", F.lit("hit").alias("text"), "place")
    past = _history(t, 6 + 4, 0.3)
    filled = V.backfill(source, past, 6).groupBy("key").agg(F.count("*").alias("sources"), F.round(F.max("score"), 6).alias("best"))
    return probes(t).select(F.col("query_id").alias("key")).join(filled, "key", "left").select("key", F.coalesce("sources", F.lit(0)).alias("sources"), "best", F.when(F.col("sources").isNull(), "no relevant information").alias("refusal"))
