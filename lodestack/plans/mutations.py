"""Queries of row-level changes in their batch form: a table in, the changed table out."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import relational as R
from lodestack.operators import windows as W
from lodestack.plans.registry import query
from lodestack.plans.relational import CHATS, chats
from lodestack.plans.scalars import RUNS, runs


@query("op161_soft_delete", f"select chat_id, not coalesce(workspace_id = 7 and thread_id is null, false) as include from {CHATS}")
def _(t):
    return chats(t).select("chat_id", (~F.coalesce((F.col("workspace_id") == 7) & F.col("thread_id").isNull(), F.lit(False))).alias("include"))


@query("op162_upsert", "select workspace_id, case when workspace_id % 10 = 0 then 'agent' else chat_mode end as chat_mode from workspaces")
def _(t):
    old = t.workspaces.select("workspace_id", "chat_mode")
    return R.upsert(old, old.filter("workspace_id % 10 = 0").withColumn("chat_mode", F.lit("agent")), ["workspace_id"])


@query("op163_tristate_feedback", f"select chat_id, case when chat_id % 3 = 0 then null else chat_id % 3 = 1 end as feedback from {CHATS}")
def _(t):
    given = F.when(F.col("chat_id") % 3 != 0, F.col("chat_id") % 3)
    return chats(t).select("chat_id", F.when(given.isNotNull(), given == 1).alias("feedback"))


@query("op164_change_capture", f"select run_id, workspace_id, previous from (select run_id, workspace_id, requirements, lag(requirements) over (partition by workspace_id order by created_at, run_id) as previous from {RUNS} where workspace_id is not null) where requirements is not null and previous is not null and requirements <> previous")
def _(t):
    rows = runs(t).filter("workspace_id is not null").select("run_id", "workspace_id", "created_at", "requirements")
    changed = W.changes(rows, ["workspace_id"], "created_at", "run_id", F.col("requirements"))
    return changed.filter("requirements is not null and previous is not null").select("run_id", "workspace_id", "previous")


@query("op165_history_lookup", f"select r.run_id, epoch_us(r.created_at)::bigint as created_us, w.title from {RUNS} r left join workspaces w using (workspace_id) order by created_us desc, run_id")
def _(t):
    return runs(t).join(t.workspaces.select("workspace_id", "title"), "workspace_id", "left").select("run_id", F.unix_micros("created_at").alias("created_us"), "title").orderBy(F.desc("created_us"), "run_id")


@query("op166_capacity", "select count(*) as active, count(*) < 40 as room from workspaces where chat_mode = 'chat' and workspace_id <> 7")
def _(t):
    return t.workspaces.filter("chat_mode = 'chat' and workspace_id <> 7").agg(F.count("*").alias("active")).select("active", (F.col("active") < 40).alias("room"))


@query("op167_mark_processed", f"select chat_id, coalesce(memory_processed, false) or chat_id % 4 = 0 as processed from {CHATS}")
def _(t):
    ids = t.workspace_chats.select("chat_id").distinct().filter("chat_id % 4 = 0").withColumn("hit", F.lit(True))
    return chats(t).join(ids, "chat_id", "left").select("chat_id", (F.coalesce("memory_processed", F.lit(False)) | F.coalesce("hit", F.lit(False))).alias("processed"))


@query("op168_owner_backfill", f"select chat_id, coalesce(user_id, 1) as user_id from {CHATS}")
def _(t):
    return chats(t).select("chat_id", F.coalesce("user_id", F.lit(1)).cast("long").alias("user_id"))


@query("op169_bulk_reorder", "select profile, coalesce(case profile when 'default' then 5 when 'embed_long' then 1 end, 9)::int as priority from size_limits")
def _(t):
    order = t._spark.createDataFrame([("default", 5), ("embed_long", 1)], "profile string, priority int")
    return t.size_limits.select("profile").join(F.broadcast(order), "profile", "left").select("profile", F.coalesce("priority", F.lit(9)).alias("priority"))


@query("op170_bulk_create", "select event_type, count(*) as n from (select event_type from events union all select event_type from events where value > 40) group by 1")
def _(t):
    return t.events.select("event_type").unionByName(t.events.filter("value > 40").select("event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("op154_memory_apply", f"select workspace_id, count(*) filter (where rn <= 20) as kept from (select workspace_id, row_number() over (partition by workspace_id order by chat_id) rn from {CHATS} where textresponse is not null and regexp_matches(textresponse, '\\S')) group by 1")
def _(t):
    """New entries of each scope up to its twenty slots, oldest first."""
    valid = chats(t).filter(F.col("textresponse").rlike(r"\S"))
    return R.latest(valid, ["workspace_id"], [F.asc("chat_id")], 20).groupBy("workspace_id").agg(F.count("*").alias("kept"))


_ACTION = "case when chat_id % 3 = 0 and thread_id is not null then 'update' else 'create' end"


@query("op154_memory_actions", f"select workspace_id, least(count(*) filter (where action = 'create' and scope = 'WORKSPACE'), 20)::bigint as workspace_created, least(count(*) filter (where action = 'create' and scope = 'GLOBAL'), 5)::bigint as global_created, count(*) filter (where action = 'update') as updated from (select workspace_id, {_ACTION} as action, case when chat_id % 4 = 0 then 'GLOBAL' else 'WORKSPACE' end as scope from {CHATS} where textresponse is not null and regexp_matches(textresponse, '\\S')) group by 1")
def _(t):
    """Extracted entries applied to each workspace: creations up to the slots of their scope, updates without a limit; blank ones count for nothing."""
    valid = chats(t).filter(F.col("textresponse").rlike(r"\S")).select("chat_id", "workspace_id", "thread_id")
    action = F.when((F.col("chat_id") % 3 == 0) & F.col("thread_id").isNotNull(), "update").otherwise("create")
    scope = F.when(F.col("chat_id") % 4 == 0, "GLOBAL").otherwise("WORKSPACE")
    entries = valid.select("workspace_id", action.alias("action"), scope.alias("scope"))
    created = {s: F.count_if((F.col("action") == "create") & (F.col("scope") == s)) for s in ("WORKSPACE", "GLOBAL")}
    return entries.groupBy("workspace_id").agg(F.least(created["WORKSPACE"], F.lit(20)).alias("workspace_created"), F.least(created["GLOBAL"], F.lit(5)).alias("global_created"), F.count_if(F.col("action") == "update").alias("updated"))


@query("op172_watch_group", "with g as (select title, count(*) filter (where docsource = 'upload') as queued from (select distinct raw_id, title, docsource from raw_documents where title is not null) group by 1) select d.raw_id, g.queued = 0 as watched from (select distinct raw_id, title from raw_documents where title is not null) d join g using (title)")
def _(t):
    """All rows of a title are watched unless one of them already is."""
    docs = t.raw_documents.filter("title is not null").select("raw_id", "title", "docsource").distinct()
    queued = docs.groupBy("title").agg(F.count_if(F.coalesce(F.col("docsource") == "upload", F.lit(False))).alias("queued"))
    return docs.select("raw_id", "title").distinct().join(queued, "title").select("raw_id", (F.col("queued") == 0).alias("watched"))
