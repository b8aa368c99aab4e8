"""Queries of relational operators: predicates, joins, aggregates, sorting and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import relational as R
from lodestack.operators import windows as W
from lodestack.plans.registry import query

CHATS = "(select distinct * exclude (ingested_at) from workspace_chats)"


def chats(t):
    return R.Once(t.workspace_chats.drop("ingested_at"), "chat_id")


@query("op15_table_scan", f"select chat_id, workspace_id, message from {CHATS} where workspace_id = 7 and feedback_score order by chat_id desc limit 20 offset 5")
def _(t):
    df = R.where(chats(t), workspace_id=7, feedback_score=True)
    return df.select("chat_id", "workspace_id", "message").orderBy(F.desc("chat_id")).offset(5).limit(20)


@query("op33_metadata_split", "select raw_id, textcontent as page_content, title, url, docsource from raw_documents where textcontent is not null")
def _(t):
    return t.raw_documents.filter("textcontent is not null").select("raw_id", F.col("textcontent").alias("page_content"), "title", "url", "docsource")


@query("op34_null_equality", f"select chat_id, workspace_id from {CHATS} where thread_id is null and api_session_id is null and chat_source is not null")
def _(t):
    df = R.where(chats(t), thread_id=None, api_session_id=None, user_id=R.ABSENT)
    return df.filter("chat_source is not null").select("chat_id", "workspace_id")


@query("op35_in_list", f"select chat_id, workspace_id from {CHATS} where workspace_id in (3, 7, 11)")
def _(t):
    return R.where(chats(t), workspace_id=[3, 7, 11]).select("chat_id", "workspace_id")


@query("op35_in_list_semi", f"select chat_id, workspace_id from {CHATS} where workspace_id in (select workspace_id from workspaces where chat_mode = 'query')")
def _(t):
    return chats(t).join(R.where(t.workspaces, chat_mode="query").select("workspace_id"), "workspace_id", "left_semi").select("chat_id", "workspace_id")


@query("op36_range_not", "select o_orderkey, o_totalprice from orders where o_totalprice >= 1000 and o_totalprice <= 90000 and o_orderstatus <> 'F'")
def _(t):
    return t.orders.filter("o_totalprice >= 1000 and o_totalprice <= 90000 and o_orderstatus <> 'F'").select("o_orderkey", "o_totalprice")


@query("op37_contains", f"select chat_id from {CHATS} where contains(message, 'risk')")
def _(t):
    return chats(t).filter(F.col("message").contains("risk")).select("chat_id")


@query(
    "op46_lookup_labels",
    f"select c.chat_id, coalesce(w.title, 'deleted workspace') as workspace_title, case when c.user_id is null then 'API' else 'user ' || c.user_id end as username from {CHATS} c left join workspaces w on w.workspace_id = c.workspace_id",
)
def _(t):
    df = chats(t).select("chat_id", "workspace_id", "user_id")
    named = R.lookup(df, t.workspaces, df["workspace_id"] == t.workspaces["workspace_id"], {"workspace_title": ("title", "deleted workspace")})
    return named.select("chat_id", "workspace_title", F.when(F.col("user_id").isNull(), "API").otherwise(F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("username"))


@query(
    "op47_multiway_join",
    "select l.l_orderkey, l.l_linenumber, o.o_custkey, c.c_name, n.n_name from lineitem l left join orders o on o.o_orderkey = l.l_orderkey left join customer c on c.c_custkey = o.o_custkey left join nation n on n.n_nationkey = c.c_nationkey where l.l_quantity > 45",
)
def _(t):
    lines = t.lineitem.filter("l_quantity > 45")
    df = lines.join(t.orders, lines["l_orderkey"] == t.orders["o_orderkey"], "left").join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return df.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("l_orderkey", "l_linenumber", "o_custkey", "c_name", "n_name")


@query("op48_semi_join", f"select workspace_id, title from workspaces w where exists (select 1 from {CHATS} c where c.workspace_id = w.workspace_id and c.user_id = 3)")
def _(t):
    return t.workspaces.join(t.workspace_chats.filter("user_id = 3").select("workspace_id"), "workspace_id", "left_semi").select("workspace_id", "title")


@query("op49_anti_join", "select distinct tender_filename from rfp_runs r where tender_filename is not null and not exists (select 1 from raw_documents d where lower(d.title) || '.pdf' = lower(r.tender_filename))")
def _(t):
    files = t.rfp_runs.filter("tender_filename is not null").select("tender_filename", F.lower("tender_filename").alias("k")).distinct()
    return files.join(t.raw_documents.select(F.concat(F.lower("title"), F.lit(".pdf")).alias("k")), "k", "left_anti").select("tender_filename")


@query(
    "op50_anti_join_union",
    "select distinct page_id from documents where page_id not in (select workspace_id from raw_documents where workspace_id is not null union select workspace_id from rfp_runs where workspace_id is not null) and regexp_matches(page_title, '^[A-M]')",
)
def _(t):
    used = t.raw_documents.select("workspace_id").union(t.rfp_runs.select("workspace_id")).filter("workspace_id is not null").distinct()
    pages = t.documents.filter(F.col("page_title").rlike("^[A-M]")).select("page_id").distinct()
    return pages.join(used, pages["page_id"] == used["workspace_id"], "left_anti")


@query(
    "op51_same_title_other_id",
    "with p as (select distinct page_id, page_title from documents where page_title is not null), m as (select page_title, min(page_id) lo, count(*) n from p group by 1 having count(*) > 1) select p.page_title, p.page_id, m.lo as first_page_id, m.n as pages from p join m using (page_title) where p.page_id <> m.lo",
)
def _(t):
    """Pages that share a title, each against the first one: a group is never paired with itself."""
    pages = t.documents.filter("page_title is not null").select("page_id", "page_title").distinct()
    shared = pages.groupBy("page_title").agg(F.min("page_id").alias("first_page_id"), F.count("*").alias("pages")).filter("pages > 1")
    return pages.join(shared, "page_title").filter("page_id <> first_page_id").select("page_title", "page_id", "first_page_id", "pages")


@query("op52_bridge_join", "select distinct d.doc_id, l.label_id, l.subject_area from documents d join subject_labels l on l.doc_id = d.doc_id where l.subject_area is not null")
def _(t):
    return t.documents.select("doc_id").join(t.subject_labels.filter("subject_area is not null"), "doc_id").select("doc_id", "label_id", "subject_area").distinct()


@query("op56_count", f"select count(*) as chats from {CHATS} where workspace_id = 7")
def _(t):
    return R.where(chats(t), workspace_id=7).agg(F.count("*").alias("chats"))


@query("op57_sum_default_zero", "select w.workspace_id, coalesce(sum(r.token_count_estimate), 0)::bigint as tokens from workspaces w left join (select distinct raw_id, workspace_id, token_count_estimate from raw_documents) r on r.workspace_id = w.workspace_id group by 1")
def _(t):
    docs = t.raw_documents.select("raw_id", "workspace_id", "token_count_estimate").distinct().groupBy("workspace_id").agg(F.sum("token_count_estimate").alias("s"))
    return t.workspaces.select("workspace_id").join(docs, "workspace_id", "left").select("workspace_id", F.coalesce("s", F.lit(0)).cast("long").alias("tokens"))


@query("op58_relation_count", f"select w.workspace_id, count(c.chat_id) as chats from workspaces w left join {CHATS} c on c.workspace_id = w.workspace_id group by 1")
def _(t):
    return R.counted(t.workspaces.select("workspace_id"), chats(t), "workspace_id", "workspace_id", "chats")


@query("op59_namespace_counts", "select label as namespace, count(*) as vectors from embeddings group by label")
def _(t):
    return t.embeddings.groupBy(F.col("label").alias("namespace")).agg(F.count("*").alias("vectors"))


@query(
    "op61_having_idle",
    f"select user_id, workspace_id, count(*) as chats, (epoch_us(max(created_at)))::bigint as last_us from {CHATS} where not coalesce(memory_processed, false) group by 1, 2 having count(*) >= 5 and max(created_at) < timestamp '2026-01-01' - interval 20 minute",
)
def _(t):
    open_chats = chats(t).filter("not coalesce(memory_processed, false)")
    per = open_chats.groupBy("user_id", "workspace_id").agg(F.count("*").alias("chats"), F.max("created_at").alias("last"))
    return per.filter("chats >= 5 and last < timestamp '2026-01-01' - interval 20 minutes").select("user_id", "workspace_id", "chats", F.unix_micros("last").alias("last_us"))


@query("op60_group_lists", f"select user_id, workspace_id, row_number() over (partition by user_id, workspace_id order by chat_id) - 1 as place, chat_id, message from {CHATS}")
def _(t):
    """The ordered list of chats of every (user, workspace), one row a place, so that no hot group is one value or one task."""
    rows = chats(t).select("user_id", "workspace_id", "chat_id", "message")
    return W.running_sum(rows, ["user_id", "workspace_id"], F.floor(F.col("chat_id") / 10_000), ["chat_id"], F.lit(1), "place").select("user_id", "workspace_id", F.col("place").cast("long"), "chat_id", "message")


@query(
    "op62_group_maps",
    "select docsource, array_to_string(list_sort(list(distinct workspace_id)), ',') as workspaces, count(distinct title) as titles from raw_documents where workspace_id is not null group by 1",
)
def _(t):
    """Each source of documents with the distinct workspaces that hold them: at most as many as there are workspaces."""
    docs = t.raw_documents.filter("workspace_id is not null")
    return docs.groupBy("docsource").agg(F.array_join(F.sort_array(F.collect_set("workspace_id")).cast("array<string>"), ",").alias("workspaces"), F.countDistinct("title").alias("titles"))


@query(
    "op63_directory_summary",
    "select docsource, count(*) filter (where textcontent is not null and textcontent <> '') as files, count(*) filter (where textcontent is null or textcontent = '') as empty_files, coalesce(sum(length(textcontent)), 0)::bigint as size from (select distinct raw_id, docsource, textcontent from raw_documents) group by 1",
)
def _(t):
    docs = t.raw_documents.select("raw_id", "docsource", F.xxhash64("textcontent").alias("h"), F.length("textcontent").alias("n")).distinct()
    return docs.groupBy("docsource").agg(F.count_if(F.col("n") > 0).alias("files"), F.count_if(F.coalesce("n", F.lit(0)) == 0).alias("empty_files"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("size"))


@query("op65_message_tokens", "select workspace_id, (count(*) * 3 + sum(ceil(length(coalesce(message, '')) / 4.0)) + 5)::bigint as tokens from " + CHATS + " group by 1")
def _(t):
    tokens = F.sum(F.ceil(F.length(F.coalesce("message", F.lit(""))) / 4.0))
    return chats(t).groupBy("workspace_id").agg((F.count("*") * 3 + tokens + 5).cast("long").alias("tokens"))


@query("op66_throughput", "select run_id, generation_attempts, round(length(draft_proposal) / nullif(generation_attempts, 0)::double, 6) as chars_per_attempt from (select distinct run_id, generation_attempts, draft_proposal from rfp_runs)")
def _(t):
    runs = t.rfp_runs.select("run_id", "generation_attempts", "draft_proposal").distinct()
    return runs.select("run_id", "generation_attempts", F.round(F.try_divide(F.length("draft_proposal").cast("double"), F.col("generation_attempts")), 6).alias("chars_per_attempt"))


@query(
    "op69_category_status",
    "select a.subject_area as category, count(distinct l.doc_id) as documents from subject_areas a left join subject_labels l on lower(trim(l.subject_area)) = a.subject_area group by 1",
)
def _(t):
    labels = t.subject_labels.select(F.lower(F.trim("subject_area")).alias("category"), "doc_id").groupBy("category").agg(F.countDistinct("doc_id").alias("documents"))
    return t.subject_areas.select(F.col("subject_area").alias("category")).join(labels, "category", "left").select("category", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))


@query("op80_order_take", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 10")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(25)


@query(
    "op81_page_flag",
    f"with c as (select count(*) n from {CHATS}) select chat_id, (c.n > 3 * 20) as has_more from {CHATS}, c order by chat_id desc limit 20 offset 40",
)
def _(t):
    base = chats(t)
    total = base.agg(F.count("*").alias("n"))
    rows = R.page(base.select("chat_id"), [F.desc("chat_id")], 20, 2)
    return rows.crossJoin(F.broadcast(total)).select("chat_id", (F.col("n") > 3 * 20).alias("has_more"))


@query("op82_clamped_limit", "select workspace_id from workspaces order by workspace_id limit 1")
def _(t):
    return R.page(t.workspaces.select("workspace_id"), [F.asc("workspace_id")], -4)


@query("op86_run_list", "select distinct run_id, run_status, epoch_us(created_at)::bigint as created_us from rfp_runs order by created_us desc, run_id")
def _(t):
    return t.rfp_runs.select("run_id", "run_status", F.unix_micros("created_at").alias("created_us")).distinct().orderBy(F.desc("created_us"), "run_id")


def listing_by_size(t):
    return t.raw_documents.groupBy("raw_id").agg(F.max(F.length("textcontent")).alias("size")).orderBy(F.desc_nulls_last("size"), "raw_id")


@query("op87_listing_by_size", "select raw_id, max(length(textcontent)) as size from raw_documents group by 1 order by size desc nulls last, raw_id limit 100")
def _(t):
    """The 100 largest documents only; op87_listing_by_size_whole has every one."""
    return listing_by_size(t).limit(100)


@query("op87_listing_by_size_whole", "select raw_id, max(length(textcontent)) as size from raw_documents group by 1 order by size desc nulls last, raw_id")
def _(t):
    return listing_by_size(t)


@query("op89_union_distinct", "select title as name from raw_documents where title is not null union select page_title from documents where page_title is not null")
def _(t):
    return t.raw_documents.select(F.col("title").alias("name")).union(t.documents.select("page_title")).filter("name is not null").distinct()


@query(
    "op90_union_all_ordered",
    f"select 0 as part, raw_id as id, title as body from (select distinct raw_id, title from raw_documents where workspace_id = 7) union all select 1, chat_id, message from {CHATS} where workspace_id = 7",
)
def _(t):
    pins = t.raw_documents.filter("workspace_id = 7").select(F.lit(0).alias("part"), F.col("raw_id").alias("id"), F.col("title").alias("body")).distinct()
    return pins.unionByName(R.where(chats(t), workspace_id=7).select(F.lit(1).alias("part"), F.col("chat_id").alias("id"), F.col("message").alias("body")))


@query("op91_dedupe_first", "select page_title, min(doc_id) as doc_id from documents where page_title is not null group by 1")
def _(t):
    return t.documents.filter("page_title is not null").groupBy("page_title").agg(F.min("doc_id").alias("doc_id"))


PASS_THROUGH = {
    "rollup": "select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by rollup (o_orderstatus, o_orderpriority)",
    "cube": "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)",
    "window": "select o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rk, ntile(4) over (partition by o_custkey order by o_totalprice, o_orderkey) as quarter from orders",
    "set_ops": "select c_custkey from customer where c_acctbal > 0 intersect select o_custkey from orders except select c_custkey from customer where c_mktsegment = 'BUILDING'",
    "join": "select n.n_name, count(*) as customers, round(avg(c.c_acctbal), 4) as balance from customer c join nation n on n.n_nationkey = c.c_nationkey group by n.n_name",
    "subquery": "select s_suppkey from supplier s where s_acctbal > (select avg(s_acctbal) from supplier) and exists (select 1 from lineitem l where l.l_suppkey = s.s_suppkey)",
    "grouping_sets": "select p_brand, p_size, count(*) as n from part group by grouping sets ((p_brand), (p_size), ())",
    "conditional": "select l_shipdate < timestamp '1997-01-01' as early, count(*) as n, sum(case when l_discount > 0.05 then 1 else 0 end) as discounted from lineitem group by 1",
}


def _pass_through(name: str, text: str) -> None:
    @query(f"op159_sql_{name}", text if name != "conditional" else text.replace("sum(case when l_discount > 0.05 then 1 else 0 end)", "sum(case when l_discount > 0.05 then 1 else 0 end)::bigint"))
    def _(t):
        from lodestack.sources.sql import run_select

        t.register("orders", "lineitem", "customer", "nation", "part", "supplier")
        return run_select(t._spark, text)


for _name, _text in PASS_THROUGH.items():
    _pass_through(_name, _text)
