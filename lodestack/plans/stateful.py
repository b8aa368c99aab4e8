"""Queries of keyed state with a time to live, deduplication and folds over ordered events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import windows as W
from lodestack.plans.registry import query
from lodestack.plans.relational import CHATS, chats

US = "epoch_us(ts)"


@query("op139_sliding_ttl", f"with g as (select event_id, user_id, ts, case when {US} - lag({US}) over w > 21600000000 then 1 else 0 end as fresh from events where ts is not null window w as (partition by user_id order by ts, event_id)) select event_id, user_id, (sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding))::bigint as session from g")
def _(t):
    """Runs of a user's events with at most six hours between them: each hit renews the state."""
    return W.sessions(t.events.filter("ts is not null"), ["user_id"], F.unix_micros("ts"), 21_600, "event_id").select("event_id", "user_id", "session")


@query("op139_session_sizes", f"with g as (select event_id, user_id, ts, case when {US} - lag({US}) over w > 21600000000 then 1 else 0 end as fresh from events where ts is not null window w as (partition by user_id order by ts, event_id)), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g) select user_id, epoch_us(min(ts))::bigint as from_us, count(*) as events from s group by user_id, session")
def _(t):
    """The same sessions as aggregates: partial sessions merge, so a hot user is no window of its own."""
    gap = F.session_window(F.col("ts"), F.lit("6 hours 0.000001 seconds"))
    return t.events.filter("ts is not null and user_id is not null").groupBy("user_id", gap).agg(F.min("ts").alias("a"), F.count("*").alias("events")).select("user_id", F.unix_micros("a").alias("from_us"), "events")


def _held_sql(condition: str, ttl: int) -> str:
    """Events that start a hold of (user, type), by following from each start the first event later than the hold."""
    return f"""select event_id from (with recursive e as (select event_id, user_id, event_type, {US} as a from events where ts is not null and {condition}),
        n as (select event_id, min({{'a': a, 'id': event_id}}) over (partition by user_id, event_type order by a range between {ttl + 1} following and unbounded following) as later from e),
        c as (select min({{'a': a, 'id': event_id}}).id as event_id from e group by user_id, event_type union all select n.later.id from c join n using (event_id) where n.later is not null)
        select event_id from c)"""


@query("op140_cached_decisions", f"select event_id, event_id not in ({_held_sql(chr(39) + 'error' + chr(39) + ' = event_type', 30_000_000)} union all {_held_sql('event_type is distinct from ' + chr(39) + 'error' + chr(39), 3_600_000_000)}) as cached from events where ts is not null")
def _(t):
    """Whether the decision for (user, type) is still held since it was made: 30 seconds for failures, an hour otherwise; a use does not renew it."""
    ttl = F.when(F.col("event_type") == "error", 30_000_000).otherwise(3_600_000_000)
    events = t.events.select("event_id", "user_id", "event_type", "ts")
    return W.holds(events, ["user_id", "event_type"], F.unix_micros("ts"), ttl, "event_id").select("event_id", (~F.col("fresh")).alias("cached"))


@query("op141_route_order", "select event_id, coalesce(case when value > 80 then 'calculated' end, case when event_type = 'purchase' then 'model' end, case when user_id % 5 = 0 then 'sticky' end, 'fallback') as route from events")
def _(t):
    steps = [F.when(F.col("value") > 80, "calculated"), F.when(F.col("event_type") == "purchase", "model"), F.when(F.col("user_id") % 5 == 0, "sticky"), F.lit("fallback")]
    return t.events.select("event_id", F.coalesce(*steps).alias("route"))


@query("op142_exact_dedupe", f"select sha256(coalesce(chat_source, '') || chr(31) || coalesce(message, '')) as signature, min(chat_id) as chat_id from {CHATS} group by 1")
def _(t):
    signature = F.sha2(F.concat_ws("\x1f", F.coalesce("chat_source", F.lit("")), F.coalesce("message", F.lit(""))), 256)
    return chats(t).groupBy(signature.alias("signature")).agg(F.min("chat_id").alias("chat_id"))


@query("op142_cooldown", _held_sql("true", 30_000_000))
def _(t):
    """Events let through when each one blocks those of the same user and type for 30 seconds; a blocked one blocks nothing."""
    events = t.events.select("event_id", "user_id", "event_type", "ts")
    return W.holds(events, ["user_id", "event_type"], F.unix_micros("ts"), F.lit(30_000_000), "event_id").filter("fresh").select("event_id")


@query("op142_unique_once", "select event_type, user_id, min_by(event_id, (ts, event_id)) as event_id from events where ts is not null group by 1, 2")
def _(t):
    return t.events.filter("ts is not null").groupBy("event_type", "user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("op143_claim_slots", "select event_type, min_by(event_id, (ts, event_id)) as claimed from events where ts is not null and event_type not in (select event_type from events where value > 1e9) group by 1")
def _(t):
    """At most one open run a key: the earliest of each key that has none in flight."""
    busy = t.events.filter("value > 1e9").select("event_type")
    free = t.events.filter("ts is not null and event_type is not null").join(busy, "event_type", "left_anti")
    return free.groupBy("event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("claimed"))


# States of a job's runs and what changes them.
TRANSITIONS = {("idle", "signup"): "queued", ("queued", "click"): "running", ("queued", "error"): "failed", ("running", "view"): "completed", ("running", "error"): "failed", ("running", "purchase"): "timed_out"}
NEXT_RUN = "signup"
_STEP = " ".join(f"when (case when s in ('completed', 'failed', 'timed_out') and x = '{NEXT_RUN}' then 'idle' else s end) = '{a}' and x = '{e}' then '{b}'" for (a, e), b in TRANSITIONS.items())


@query("op143_job_states", f"select user_id, list_reduce(list_prepend('idle', list(event_type order by ts, event_id)), lambda s, x: case {_STEP} else s end) as state from events where ts is not null and event_type is not null group by 1")
def _(t):
    """State of each job after all its events: one run in flight at most, and none changes once it has ended."""
    table = TRANSITIONS

    def step(state: str, row: tuple) -> str:
        ended = state in ("completed", "failed", "timed_out")
        return table.get(("idle" if ended and row[1] == NEXT_RUN else state, row[1]), state)

    events = t.events.filter("ts is not null and event_type is not null").select("user_id", "event_type", "ts", "event_id")
    folded = W.fold(events, ["user_id"], ["ts", "event_id"], step, "idle", "string")
    return folded.groupBy("user_id").agg(F.max_by("after", F.struct("ts", "event_id")).alias("state"))


@query("op142_checks_in_order", f"""with c as ({{}}), e as (select event_id, user_id, event_type, value, ts, row_number() over (partition by user_id, event_type, value order by ts, event_id) as same, row_number() over (partition by user_id, event_type order by ts, event_id) as nth from events where ts is not null)
    select event_id, case when event_id not in (select event_id from c) then 'cooldown' when event_type = 'signup' and nth > 1 then 'once' when same > 1 then 'repeat' else 'pass' end as verdict from e""".format(_held_sql("true", 30_000_000)))
def _(t):
    """Why an event is held back: a cooldown still runs, then a thing done once, then the same arguments before; or that it passes."""
    events = t.events.select("event_id", "user_id", "event_type", "value", "ts")
    held = W.holds(events, ["user_id", "event_type"], F.unix_micros("ts"), F.lit(30_000_000), "event_id")
    first = F.struct("ts", "event_id")
    same = events.filter("ts is not null").groupBy("user_id", "event_type", "value").agg(F.min_by("event_id", first).alias("event_id")).select("event_id", F.lit(True).alias("fresh_value"))
    nth = events.filter("ts is not null").groupBy("user_id", "event_type").agg(F.min_by("event_id", first).alias("event_id")).select("event_id", F.lit(True).alias("fresh_type"))
    marked = held.select("event_id", "event_type", "fresh").join(same, "event_id", "left").join(nth, "event_id", "left")
    once = (F.col("event_type") == "signup") & F.col("fresh_type").isNull()
    return marked.select("event_id", F.when(~F.col("fresh"), "cooldown").when(once, "once").when(F.col("fresh_value").isNull(), "repeat").otherwise("pass").alias("verdict"))


@query("op146_merged_state", "select user_id, max_by(value, (ts, event_id)) as last_value, max_by(event_type, (ts, event_id)) as last_type, count(*) as steps from events where ts is not null and value is not null and event_type is not null group by 1")
def _(t):
    """State of each key after all its partial updates: the last value of every field, by aggregates that merge."""
    last = F.struct("ts", "event_id")
    events = t.events.filter("ts is not null and value is not null and event_type is not null")
    return events.groupBy("user_id").agg(F.max_by("value", last).alias("last_value"), F.max_by("event_type", last).alias("last_type"), F.count("*").alias("steps"))


@query("op148_bounded_retry", "select run_id, least(greatest(coalesce(attempts, 0), 0), 3)::int as attempts, coalesce(attempts, 0) < 3 as may_retry from (select run_id, max(generation_attempts) as attempts from rfp_runs group by 1)")
def _(t):
    from lodestack.operators.retry import retry

    state = t.rfp_runs.groupBy("run_id").agg(F.max("generation_attempts").alias("a")).select("run_id", F.coalesce("a", F.lit(0)).alias("goal"), F.lit(0).alias("attempts"))
    done = retry(state, F.col("attempts") >= F.col("goal"), lambda df: df.withColumn("attempts", F.col("attempts") + 1), 3)
    return done.select("run_id", "attempts", (F.col("goal") < 3).alias("may_retry"))


@query("op157_flow_chain", "select event_type, round(sum(value), 2) as total from events where value > 0 and event_type is not null group by 1")
def _(t):
    """A flow: blocks applied one after the other to a table."""
    from lodestack.operators.retry import flow

    return flow(t.events, [lambda df: df.filter("value > 0 and event_type is not null"), lambda df: df.groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("total"))])
