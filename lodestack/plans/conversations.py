"""Queries of conversation history: windows, budgets, exports and set composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import tokens
from lodestack.operators import relational as R
from lodestack.operators import windows as W
from lodestack.plans.registry import query
from lodestack.plans.relational import CHATS, chats
from lodestack.plans.scalars import RAW, RUNS, raw, runs

VISIBLE = "replace(replace(coalesce({0}, ''), '\"', '\"\"'), chr(10), ' ')"


def _csv(column: str):
    return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit("\n"), F.lit(" ")), F.lit('"'))


@query("op24_export_csv", f"""select chat_id, '"' || chat_id || '","' || {VISIBLE.format('message')} || '","' || {VISIBLE.format('textresponse')} || '","' || {VISIBLE.format('chat_source')} || '"' as line from {CHATS}""")
def _(t):
    return chats(t).select("chat_id", F.concat_ws(",", *(_csv(c) for c in ("chat_id", "message", "textresponse", "chat_source"))).alias("line"))


@query("op24_export_csv_file", f"""select -1::bigint as row_order, 'id,workspace,prompt,response,sent_at,rating' as line union all select c.chat_id, '"' || c.chat_id || '","' || replace(coalesce(w.title, 'unknown workspace'), '"', '""') || '","' || {VISIBLE.format('message')} || '","' || {VISIBLE.format('textresponse')} || '","' || coalesce(strftime(c.created_at, '%Y-%m-%d %H:%M:%S'), '') || '","' || case when feedback_score is null then '--' when feedback_score then 'GOOD' else 'BAD' end || '"' from {CHATS} c left join workspaces w using (workspace_id)""")
def _(t):
    """The whole file: the five fixed columns and those the rows add as header, every cell quoted; the sink sorts by ``row_order``."""
    df = chats(t).join(t.workspaces.select("workspace_id", "title"), "workspace_id", "left").select("chat_id", F.coalesce("title", F.lit("unknown workspace")).alias("workspace"), F.col("message").alias("prompt"), F.col("textresponse").alias("response"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("sent_at"), _rating().alias("rating"))
    header = t._spark.createDataFrame([(-1, ",".join(["id", *df.columns[1:]]))], "row_order long, line string")
    return header.unionByName(df.select(F.col("chat_id").alias("row_order"), F.concat_ws(",", *(_csv(c) for c in df.columns)).alias("line")))


RATING = "case when feedback_score is null then '--' when feedback_score then 'GOOD' else 'BAD' end"


def _rating():
    return F.when(F.col("feedback_score").isNull(), "--").when(F.col("feedback_score"), "GOOD").otherwise("BAD")


@query("op25_export_json", f"""select c.chat_id, coalesce(w.title, 'unknown workspace') as workspace, case when c.user_id is not null then 'user ' || c.user_id when c.api_session_id is not null then 'API' else 'unknown user' end as username, {RATING} as rating, c.message as prompt, c.textresponse as response from {CHATS} c left join workspaces w using (workspace_id)""")
def _(t):
    df = chats(t).join(t.workspaces.select("workspace_id", "title"), "workspace_id", "left")
    return df.select("chat_id", F.coalesce("title", F.lit("unknown workspace")).alias("workspace"), F.when(F.col("user_id").isNotNull(), F.concat(F.lit("user "), F.col("user_id").cast("string"))).when(F.col("api_session_id").isNotNull(), "API").otherwise("unknown user").alias("username"), _rating().alias("rating"), F.col("message").alias("prompt"), F.col("textresponse").alias("response"))


@query("op26_export_alpaca", f"""select c.chat_id, 'You work in ' || coalesce(w.title, '-') || '.' || case when c.thread_id is not null then chr(10) || '[CONTEXT 0]:' || chr(10) || 'thread ' || c.thread_id || chr(10) || '[END CONTEXT 0]' else '' end as instruction, c.message as input, c.textresponse as output from {CHATS} c left join workspaces w using (workspace_id) where c.message is not null and c.textresponse is not null""")
def _(t):
    df = chats(t).filter("message is not null and textresponse is not null").join(t.workspaces.select("workspace_id", "title"), "workspace_id", "left")
    sources = F.filter(F.array(F.concat(F.lit("thread "), F.col("thread_id").cast("string"))), lambda x: x.isNotNull())
    blocks = F.transform(sources, lambda x, i: F.concat(F.lit("\n[CONTEXT "), i.cast("string"), F.lit("]:\n"), x, F.lit("\n[END CONTEXT "), i.cast("string"), F.lit("]")))
    return df.select("chat_id", F.concat(F.lit("You work in "), F.coalesce("title", F.lit("-")), F.lit("."), F.array_join(blocks, "")).alias("instruction"), F.col("message").alias("input"), F.col("textresponse").alias("output"))


@query("op27_export_jsonl", f"select workspace_id, 0 as chat_id, 0 as part, 'system' as role, 'You work in ' || coalesce(title, '-') || '.' as content from workspaces where workspace_id in (select workspace_id from {CHATS}) union all select workspace_id, chat_id, 1, 'user', message from {CHATS} where message is not null and textresponse is not null and workspace_id is not null union all select workspace_id, chat_id, 2, 'assistant', textresponse from {CHATS} where message is not null and textresponse is not null and workspace_id is not null")
def _(t):
    """Message rows in the order (workspace, chat, part): the sink sorts within its partitions, no workspace is gathered."""
    turns = chats(t).filter("message is not null and textresponse is not null and workspace_id is not null")
    pairs = turns.select("workspace_id", "chat_id", F.inline(F.array(F.struct(F.lit(1).alias("part"), F.lit("user").alias("role"), F.col("message").alias("content")), F.struct(F.lit(2).alias("part"), F.lit("assistant").alias("role"), F.col("textresponse").alias("content")))))
    used = t.workspace_chats.select("workspace_id").distinct()
    heads = t.workspaces.join(used, "workspace_id", "left_semi").select("workspace_id", F.lit(0).cast("long").alias("chat_id"), F.lit(0).alias("part"), F.lit("system").alias("role"), F.concat(F.lit("You work in "), F.coalesce("title", F.lit("-")), F.lit(".")).alias("content"))
    return heads.unionByName(pairs)


@query("op30_chart_payload", "select '[' || string_agg('{\"name\":\"' || event_type || '\",\"value\":' || n || '}', ',' order by event_type) || ']' as dataset from (select event_type, count(*) n from events where event_type is not null group by 1)")
def _(t):
    counts = t.events.filter("event_type is not null").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value"))
    return counts.agg(F.to_json(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("dataset"))


@query("op64_conversation_tokens", f"select workspace_id, thread_id, (sum(ceil(length(coalesce(message, '')) / 4.0) + ceil(length(coalesce(textresponse, '')) / 4.0)))::bigint as tokens from {CHATS} group by 1, 2")
def _(t):
    parts = [F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4.0) for c in ("message", "textresponse")]
    return chats(t).groupBy("workspace_id", "thread_id").agg(F.sum(parts[0] + parts[1]).cast("long").alias("tokens"))


@query("op64_conversation_token_count")
def _(t):
    """Tokens of each conversation, counted by a tokenizer."""
    rows = chats(t).select("chat_id", "workspace_id", "thread_id", "message", "textresponse")
    counted = rows.select("workspace_id", "thread_id", *(tokens.count(F.coalesce(c, F.lit(""))).alias(c) for c in ("message", "textresponse")))
    return counted.groupBy("workspace_id", "thread_id").agg(F.sum(F.col("message") + F.col("textresponse")).alias("tokens"))


@query("op65_message_token_count")
def _(t):
    """Three tokens a message, its own and five for the list, of each workspace."""
    counted = chats(t).select("chat_id", "workspace_id", "message").select("workspace_id", tokens.count(F.coalesce("message", F.lit(""))).alias("n"))
    return counted.groupBy("workspace_id").agg((3 * F.count("*") + F.sum("n") + 5).alias("tokens"))


@query("op71_latest_n", f"select workspace_id, thread_id, chat_id from (select *, row_number() over (partition by workspace_id, thread_id order by chat_id desc) rn from {CHATS}) where rn <= 20 order by chat_id")
def _(t):
    return R.latest(chats(t), ["workspace_id", "thread_id"], [F.desc("chat_id")], 20).select("workspace_id", "thread_id", "chat_id").orderBy("chat_id")


@query("op72_latest_then_filter", f"select user_id, workspace_id, chat_id from (select *, row_number() over (partition by user_id, workspace_id order by chat_id desc) rn from {CHATS}) where rn <= 5 and regexp_matches(coalesce(textresponse, ''), '\\S')")
def _(t):
    rows = R.latest(chats(t), ["user_id", "workspace_id"], [F.desc("chat_id")], 5)
    return rows.filter(F.coalesce("textresponse", F.lit("")).rlike(r"\S")).select("user_id", "workspace_id", "chat_id")


@query("op73_budgeted_prefix", f"select raw_id, workspace_id from (select raw_id, workspace_id, coalesce(sum(coalesce(token_count_estimate, 0)) over (partition by workspace_id order by raw_id rows between unbounded preceding and 1 preceding), 0) as before from {RAW}) where before < 1500")
def _(t):
    return W.within_budget(raw(t), ["workspace_id"], "raw_id", F.col("token_count_estimate"), 1500).select("raw_id", "workspace_id")


_ROLL = "count(*) over (partition by {0} order by ts range between interval 1 day preceding and current row)"


@query("op74_rolling_quota", f"select event_id, user_id, {_ROLL.format('user_id')} as recent, {_ROLL.format('user_id')} <= 8 as allowed from events where ts is not null")
def _(t):
    counted = W.rolling_count(t.events.filter("ts is not null"), ["user_id"], F.unix_micros("ts"), 86_400)
    return counted.select("event_id", "user_id", "recent", (F.col("recent") <= 8).alias("allowed"))


@query("op75_two_quotas", f"select event_id, {_ROLL.format('event_type')} as by_type, {_ROLL.format('event_type, user_id')} as by_user from events where ts is not null")
def _(t):
    at = F.unix_micros("ts")
    first = W.rolling_count(t.events.filter("ts is not null"), ["event_type"], at, 86_400, "by_type")
    return W.rolling_count(first, ["event_type", "user_id"], at, 86_400, "by_user").select("event_id", "by_type", "by_user")


@query("op76_consecutive_failures", f"select workspace_id, count(*) as recent, count(*) filter (where run_status = 'failed') as failed from (select *, row_number() over (partition by workspace_id order by created_at desc, run_id) rn from {RUNS}) where rn <= 5 group by 1")
def _(t):
    recent = R.latest(runs(t), ["workspace_id"], [F.desc_nulls_last("created_at"), F.asc("run_id")], 5)
    return recent.groupBy("workspace_id").agg(F.count("*").alias("recent"), F.count_if(F.col("run_status") == "failed").alias("failed"))


@query("op77_change_notices", f"select run_id, workspace_id, previous from (select run_id, workspace_id, generator_model, lag(generator_model) over w as previous, row_number() over w as rn from {RUNS} window w as (partition by workspace_id order by created_at, run_id)) where rn > 1 and generator_model is distinct from previous")
def _(t):
    df = runs(t).select("run_id", "workspace_id", "created_at", "generator_model")
    return W.changes(df, ["workspace_id"], "created_at", "run_id", F.col("generator_model")).select("run_id", "workspace_id", "previous")


@query("op78_fork_prefix", f"select chat_id, message from {CHATS} where workspace_id = 7 and chat_id <= 500 and textresponse is not null")
def _(t):
    return R.where(chats(t), workspace_id=7).filter("chat_id <= 500 and textresponse is not null").select("chat_id", "message")


@query("op79_suffix_delete", f"select chat_id from {CHATS} where not (coalesce(workspace_id = 7, false) and chat_id >= 500)")
def _(t):
    return chats(t).filter("not (coalesce(workspace_id = 7, false) and chat_id >= 500)").select("chat_id")


@query("op88_capped_selection", f"select workspace_id, chat_id from (select workspace_id, chat_id, row_number() over (partition by workspace_id order by feedback_score desc nulls last, chat_id desc) rn from {CHATS}) where rn <= 5")
def _(t):
    return R.latest(chats(t), ["workspace_id"], [F.desc_nulls_last("feedback_score"), F.desc("chat_id")], 5).select("workspace_id", "chat_id")


@query("op88_two_scopes", f"with m as (select workspace_id, user_id, chat_id, coalesce(thread_id % 2 = 0, false) as is_global from {CHATS}), g as (select coalesce(user_id, -1) as u, chat_id, row_number() over (partition by coalesce(user_id, -1) order by chat_id desc) rn from m where is_global), w as (select coalesce(user_id, -1) as u, workspace_id, chat_id, row_number() over (partition by coalesce(user_id, -1), workspace_id order by chat_id desc) rn from m where not is_global) select 'global' as scope, u as user_key, null::bigint as workspace_id, chat_id from g where rn <= 5 union all select 'workspace', u, workspace_id, chat_id from w where rn <= 5")
def _(t):
    """At most five entries of each user's own scope and five of each workspace, the newest."""
    rows = chats(t).select("chat_id", "workspace_id", "user_id", "thread_id").select("chat_id", "workspace_id", F.coalesce("user_id", F.lit(-1)).cast("long").alias("user_key"), F.coalesce(F.col("thread_id") % 2 == 0, F.lit(False)).alias("own"))
    own = R.latest(rows.filter("own"), ["user_key"], [F.desc("chat_id")], 5).select(F.lit("global").alias("scope"), "user_key", F.lit(None).cast("long").alias("workspace_id"), "chat_id")
    shared = R.latest(rows.filter("not own"), ["user_key", "workspace_id"], [F.desc("chat_id")], 5).select(F.lit("workspace").alias("scope"), "user_key", "workspace_id", "chat_id")
    return own.unionByName(shared)


@query("op93_fuzzy_union", f"select distinct kind, name from (select 'workspace' as kind, title as name from workspaces union all select 'document', title from {RAW}) where contains(lower(name), 'storage') or levenshtein(lower(name), 'risk log') <= 3")
def _(t):
    names = t.workspaces.select(F.lit("workspace").alias("kind"), F.col("title").alias("name")).unionByName(t.raw_documents.select(F.lit("document").alias("kind"), F.col("title").alias("name")))
    low = F.lower("name")
    return names.filter(low.contains("storage") | (F.levenshtein(low, F.lit("risk log")) <= 3)).distinct()


@query("op124_role_pairs", f"select chat_id, 0 as part, 'user' as role, message as content from {CHATS} where message is not null and textresponse is not null union all select chat_id, 1, 'assistant', textresponse from {CHATS} where message is not null and textresponse is not null")
def _(t):
    turns = chats(t).filter("message is not null and textresponse is not null")
    return turns.select("chat_id", F.inline(F.array(F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("message").alias("content")), F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("textresponse").alias("content")))))


@query("op150_history_budget", f"select workspace_id, thread_id, chat_id from (select workspace_id, thread_id, chat_id, sum(ceil(length(coalesce(message, '') || coalesce(textresponse, '')) / 4.0)) over (partition by workspace_id, thread_id order by chat_id desc rows between unbounded preceding and 1 preceding) as newer from {CHATS}) where coalesce(newer, 0) < 700")
def _(t):
    """The newest messages of each conversation that fit a history budget, walked from the newest."""
    cost = F.ceil(F.length(F.concat(F.coalesce("message", F.lit("")), F.coalesce("textresponse", F.lit("")))) / 4.0)
    turns = chats(t).withColumn("back", -F.col("chat_id"))
    return W.within_budget(turns, ["workspace_id", "thread_id"], "back", cost, 700).select("workspace_id", "thread_id", "chat_id")
