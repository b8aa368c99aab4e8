"""Queries of document ingestion: chunks, caches, stores and their upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import embedding
from lodestack.functions import text as X
from lodestack.operators import chunking
from lodestack.plans.registry import query
from lodestack.plans.relational import chats
from lodestack.plans.scalars import RAW, RUNS, raw, runs

# Fixed value: the namespace of URL names in version 5 identifiers.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def cache_key(name):
    """Version 5 identifier of a name in the URL namespace, by SHA-1 in the JVM."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.concat_ws("-", *parts)


@query("op17_vector_cache", f"select raw_id from {RAW} where chunksource is not null and raw_id not in (select raw_id from raw_documents where docsource = 'upload')")
def _(t):
    """Documents whose cache key is not among those of the stored ones: only misses are embedded."""
    keyed = raw(t).filter("chunksource is not null").select("raw_id", "docsource", cache_key(F.concat(F.col("raw_id").cast("string"), F.col("chunksource"))).alias("cache_key"))
    stored = keyed.filter("docsource = 'upload'").select("cache_key")
    return keyed.join(stored, "cache_key", "left_anti").select("raw_id")


@query("op17_cache_keys")
def _(t):
    """The cache key of every stored name."""
    return raw(t).filter("chunksource is not null").select("raw_id", "chunksource").select("raw_id", "chunksource", cache_key(F.col("chunksource")).alias("cache_key"))


@query("op21_corpus_namespaces", f"select case when docsource in ('upload', 'mail export') then 'inbox' when docsource = 'policy library' then 'policies' else 'other' end as namespace, count(*) as documents, min(title) as first_title from {RAW} group by 1")
def _(t):
    names = F.when(F.col("docsource").isin("upload", "mail export"), "inbox").when(F.col("docsource") == "policy library", "policies").otherwise("other")
    return raw(t).groupBy(names.alias("namespace")).agg(F.count("*").alias("documents"), F.min("title").alias("first_title"))


@query("op28_vector_insert", "select label as namespace, count(*) as vectors, count(*) as bridged from embeddings group by 1")
def _(t):
    """Vectors and their bridge rows (document, vector), one document a vector."""
    bridge = t.embeddings.select(F.col("vec_id").alias("doc_id"), "vec_id")
    return t.embeddings.join(bridge, "vec_id").groupBy(F.col("label").alias("namespace")).agg(F.count("*").alias("vectors"), F.count("doc_id").alias("bridged"))


@query("op29_vector_delete", "select vec_id, label from embeddings where vec_id % 10 <> 4")
def _(t):
    """Vectors left after the documents divisible by ten, rest four, are deleted through the bridge."""
    gone = t.embeddings.select(F.col("vec_id").alias("doc_id"), "vec_id").filter("doc_id % 10 = 4").select("vec_id")
    return t.embeddings.join(gone, "vec_id", "left_anti").select("vec_id", "label")


@query("op54_first_match", f"select run_id, case when regexp_matches(lower(draft_proposal), 'metering|sensor') then 'field' when regexp_matches(lower(draft_proposal), 'payroll|budget') then 'finance' when length(draft_proposal) > 2000 then 'long' else 'none' end as rule from {RUNS} where draft_proposal is not null")
def _(t):
    """The first rule by priority whose condition holds."""
    draft = F.lower("draft_proposal")
    rules = [(2, "finance", draft.rlike("payroll|budget")), (1, "field", draft.rlike("metering|sensor")), (3, "long", F.length("draft_proposal") > 2000)]
    best = F.array_min(F.array_compact(F.array(*(F.when(hit, F.struct(F.lit(p).alias("p"), F.lit(name).alias("name"))) for p, name, hit in rules))))
    return runs(t).filter("draft_proposal is not null").select("run_id", F.coalesce(best["name"], F.lit("none")).alias("rule"))


RULES = [(1, 2, True, "AND", "field"), (2, 1, True, "OR", "urgent"), (3, 3, True, "AND", "long"), (4, 0, False, "AND", "off"), (5, 4, True, "AND", "never"), (6, 5, True, "AND", "broken")]
CONDITIONS = [(1, "prompt", "contains", "Metering, sensor ,"), (1, "source", "neq", "API"), (2, "prompt", "matches", "/^(quick|pls)/i"), (2, "prompt", "eq", "hello"), (3, "size", "between", "70,90"), (3, "size", "gte", "75"), (4, "size", "gt", "0"), (6, "prompt", "matches", "(["), (6, "size", "gt", "x")]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


@query(
    "op54_rule_tables",
    f"""with rules(rule_id, priority, enabled, logic, target) as (values {_values(RULES)}), conditions(rule_id, property, comparator, v) as (values {_values(CONDITIONS)}),
    c as (select chat_id, coalesce(message, '') as prompt, coalesce(chat_source, '') as source, length(message) as size from (select distinct * exclude (ingested_at) from workspace_chats)),
    met as (select chat_id, rule_id, case
        when property = 'size' then coalesce(case comparator when 'between' then size between split_part(v, ',', 1)::int and split_part(v, ',', 2)::int when 'gte' then size >= try_cast(v as int) when 'gt' then size > try_cast(v as int) end, false)
        when comparator = 'contains' then list_bool_or(list_transform(list_filter(list_transform(string_split(v, ','), lambda w: lower(trim(w))), lambda w: w <> ''), lambda w: contains(lower(prompt), w)))
        when comparator = 'matches' then v <> '([' and regexp_matches(lower(prompt), '^(quick|pls)')
        when comparator = 'eq' then lower(prompt) = lower(v) else lower(source) <> lower(v) end as hit from c, conditions),
    held as (select chat_id, rule_id, bool_and(hit) as all_met, bool_or(hit) as any_met from met group by 1, 2),
    best as (select chat_id, min_by(target, priority) as target from held join rules using (rule_id) where enabled and case logic when 'OR' then any_met else all_met end group by 1)
    select c.chat_id, coalesce(b.target, 'fallback') as target from c left join best b using (chat_id)""",
)
def _(t):
    """Rules and their conditions as tables, the first by priority that holds."""
    from lodestack.operators import rules

    spark = t._spark
    table = spark.createDataFrame(RULES, "rule_id int, priority int, enabled boolean, logic string, target string")
    conditions = spark.createDataFrame(CONDITIONS, "rule_id int, property string, comparator string, value string")
    requests = chats(t).select("chat_id", "message", "chat_source")
    properties = {"prompt": F.col("message"), "source": F.col("chat_source"), "size": F.length("message")}
    return requests.select("chat_id", rules.route(requests, table, conditions, properties, ("size",)).alias("target"))


@query("op55_branch_join", f"select a.run_id, a.requirements_size, b.draft_size from (select run_id, length(requirements) as requirements_size from {RUNS} where requirements is not null) a join (select run_id, length(draft_proposal) as draft_size from {RUNS} where draft_proposal is not null) b using (run_id)")
def _(t):
    left = runs(t).filter("requirements is not null").select("run_id", F.length("requirements").alias("requirements_size"))
    right = runs(t).filter("draft_proposal is not null").select("run_id", F.length("draft_proposal").alias("draft_size"))
    return left.join(right, "run_id")


@query("op96_recursive_split")
def _(t):
    """Chunks of every document with the header of its metadata in front."""
    docs = raw(t).withColumn("header", X.metadata_header("title", "published", "chunksource"))
    return chunking.chunks(docs, "raw_id", "textcontent", 1000, 20, "header").withColumnRenamed("key", "raw_id")


@query("op135_embed_chunks")
def _(t):
    """Embeddings of every chunk by the stand-in model, of length 1."""
    cut = chunking.chunks(raw(t), "raw_id", "textcontent", 1000, 20)
    return embedding.embed(cut, "chunk").select(F.col("key").alias("raw_id"), "chunk_ix", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 3).alias("norm"))


@query("op137_score_threshold", "select doc_id, round(length(regexp_replace(text, '[^!?]', '', 'g')) / length(text)::double, 6) as score from documents where length(text) > 0 and round(length(regexp_replace(text, '[^!?]', '', 'g')) / length(text)::double, 6) >= 0.01")
def _(t):
    """Scanner results over a threshold; the score is a stand-in (share of exclamation and question marks)."""
    score = F.round(F.length(F.regexp_replace("text", "[^!?]", "")) / F.length("text").cast("double"), 6)
    return t.documents.filter(F.length("text") > 0).select("doc_id", score.alias("score")).filter("score >= 0.01")


@query("op145_changed_content", "with d as (select doc_id, page_id, md5(coalesce(text, '')) as h, rev_ts, lag(md5(coalesce(text, ''))) over (partition by page_id order by rev_ts, doc_id) as before from documents) select doc_id, page_id from d where h is distinct from before")
def _(t):
    """Revisions whose text differs from the one before: only these are embedded again."""
    from lodestack.operators.windows import changes

    marked = t.documents.select("doc_id", "page_id", "rev_ts", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    first = marked.groupBy("page_id").agg(F.min(F.struct("rev_ts", "doc_id")).alias("m")).select("m.doc_id", "page_id")
    later = changes(marked, ["page_id"], "rev_ts", "doc_id", F.col("h")).select("doc_id", "page_id")
    return first.unionByName(later)


@query("op155_lifecycle", f"select raw_id, title, raw_id % 3 = 0 as pinned from {RAW} where raw_id % 11 <> 0")
def _(t):
    """Documents after a removal by key and an update of pins."""
    removed = t.raw_documents.select("raw_id").distinct().filter("raw_id % 11 = 0")
    return raw(t).join(removed, "raw_id", "left_anti").select("raw_id", "title", (F.col("raw_id") % 3 == 0).alias("pinned"))


def store_listing(t):
    from lodestack.operators.relational import counted

    return counted(t.workspaces.select("workspace_id", "title"), raw(t), "workspace_id", "workspace_id", "documents")


@query("op171_store_listing", f"select w.workspace_id, w.title, count(d.raw_id) as documents from workspaces w left join {RAW} d on d.workspace_id = w.workspace_id group by 1, 2 order by 1 limit 20")
def _(t):
    """The first 20 workspaces only; op171_store_listing_whole has every one."""
    return store_listing(t).orderBy("workspace_id").limit(20)


@query("op171_store_listing_whole", f"select w.workspace_id, w.title, count(d.raw_id) as documents from workspaces w left join {RAW} d on d.workspace_id = w.workspace_id group by 1, 2 order by 1")
def _(t):
    """Every workspace in one answer, as the listing has no further pages."""
    return store_listing(t).orderBy("workspace_id")
