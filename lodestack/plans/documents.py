"""Queries of document conversion, templates, schedules and pluggable models."""

from __future__ import annotations

import json
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions import cron, edits, html, paths
from lodestack.functions import json as J
from lodestack.functions import text as X
from lodestack.operators import retrieval as V
from lodestack.operators.windows import running_sum
from lodestack.plans import pipeline
from lodestack.plans.registry import query
from lodestack.plans.relational import CHATS, chats
from lodestack.plans.scalars import RAW, RUNS, raw, runs


def _text(f, column: str | Column, kind: str = "string") -> Column:
    """A function of one text as a vectorised column; null stays null."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t))

    return run(F.col(column) if isinstance(column, str) else column)


@query("op10_link_kind", f"select raw_id, case when not regexp_matches(coalesce(chunksource, ''), '^link://') then 'none' when regexp_matches(chunksource, '(youtube[.]com|youtu[.]be)/') then 'video' when regexp_matches(lower(chunksource), '[.](pdf|docx|pptx|xlsx|txt|md|csv)$') then 'file' else 'web' end as kind from {RAW}")
def _(t):
    link = F.coalesce("chunksource", F.lit(""))
    kind = F.when(~link.startswith("link://"), "none").when(link.rlike("(youtube[.]com|youtu[.]be)/"), "video").when(F.lower(link).rlike("[.](pdf|docx|pptx|xlsx|txt|md|csv)$"), "file").otherwise("web")
    return raw(t).select("raw_id", kind.alias("kind"))


@query(
    "op11_html_to_markdown",
    """select workspace_id, case workspace_id % 4 when 0 then '# ' || title || chr(10) || chr(10) || 'See **' || slug || '**.' when 1 then 'Order: ' || slug || ' ' || title when 2 then '- ' || title || chr(10) || '- [' || slug || '](https://a.example/' || slug || ')' else '## ' || slug end as markdown
    from workspaces where title is not null and slug is not null""",
)
def _(t):
    """Four kinds of page around each title: a main part among navigation, a form, a list with a link, hidden and credited nodes."""
    def page(*parts):
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    title, slug = F.col("title"), F.col("slug")
    kinds = F.array(
        page("<html><nav>Menu</nav><main><h1>", title, "</h1><script>x()</script><p>See <b>", slug, "</b>.[3]</p></main><footer>End</footer></html>"),
        page("<html><div role='navigation'>Menu</div><form>Order: <button>", slug, "</button> <span class='citation'>", title, "</span></form><div aria-hidden='true'>x</div></html>"),
        page("<html><header>Top</header><article><ul><li>", title, "</li><li><a href='https://a.example/", slug, "'>", slug, "</a></li></ul><img src='https://a.example/", F.repeat(F.lit("y"), 220), "'></article></html>"),
        page("<html><p hidden>", title, "</p><h2>", slug, "<sup class='reference'>4</sup></h2><p style='display:none'>x</p><div class='reflist'>", title, "</div><div role='contentinfo'>y</div></html>"),
    )
    pages = t.workspaces.filter("title is not null and slug is not null").select("workspace_id", F.get(kinds, (F.col("workspace_id") % 4).cast("int")).alias("html"))
    return pages.select("workspace_id", html.html_to_markdown("html").alias("markdown"))


@query("op44_path_containment", f"select raw_id, coalesce(length(url) % 2 = 0, false) as inside from {RAW}")
def _(t):
    inner = F.when(F.length("url") % 2 == 0, F.concat(F.lit("/store/"), F.col("raw_id").cast("string"))).otherwise(F.concat(F.lit("/store/../"), F.col("raw_id").cast("string")))
    return raw(t).select("raw_id", _text(lambda p: paths.is_within("/store", p), inner, "boolean").alias("inside"))


@query("op85_batched_rerank", "with s as (select p_partkey as id, p_partkey % 5 as key, round(1 / (1 + exp(-((length(p_name) % 7) - 2)::double)), 6) as score from part) select key, id, score from (select *, row_number() over (partition by key order by score desc, id) as place from s) where place <= 15")
def _(t):
    """Scores by batch, then one global order a key; the partial top keeps the exchange small."""
    score = F.round(1 / (1 + F.exp(-((F.length("p_name") % 7) - 2).cast("double"))), 6)
    parts = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5).alias("key"), "p_name")
    return V.rerank(parts, score, ["key"], 15).select("key", "id", "score")


_ASKED, _BATCH, _CLIP = "change request budget schedule", 25, 1000
_HEAD = f"substring(textcontent, 1, {_CLIP})"
_CLIPPED = f"case when length(textcontent) <= {_CLIP} then textcontent when contains({_HEAD}, ' ') and length({_HEAD}) - position(' ' in reverse({_HEAD})) > {_CLIP * 8 // 10} then substring({_HEAD}, 1, length({_HEAD}) - position(' ' in reverse({_HEAD}))) else {_HEAD} end"


@query(
    "op85_tool_rerank",
    f"""with d as (select raw_id, {_CLIPPED} as shown, (row_number() over (order by raw_id) - 1) // {_BATCH} as batch from {RAW} where textcontent is not null),
    s as (select raw_id, batch, length(shown) as shown, round(1 / (1 + exp(-(len(list_intersect(['{"', '".join(_ASKED.split())}'], list_distinct(string_split_regex(lower(shown), '[^a-z0-9]+')))) - 2)::double)), 6) as score from d)
    select raw_id, batch::bigint as batch, shown::int as shown, score from s order by score desc, raw_id limit 15""",
)
def _(t):
    """Tools scored in batches of 25 by texts cut at a word's edge, and the best 15 of all batches together."""
    docs = raw(t).filter("textcontent is not null").select("raw_id", "textcontent")
    placed = running_sum(docs, [], F.floor(F.col("raw_id") / 10_000), ["raw_id"], F.lit(1), "place")
    shown = placed.select("raw_id", F.floor(F.col("place") / _BATCH).alias("batch"), X.clip_words("textcontent", _CLIP).alias("text"))
    scored = shown.select("raw_id", "batch", F.length("text").alias("shown"), V.overlap_score(F.lit(_ASKED), F.col("text")).alias("score"))
    return scored.orderBy(F.desc("score"), "raw_id").limit(15)


@query("op104_path_template", "select event_id, 'k=' || (props ->> '$.k') || ' ${missing}' as filled from events where json_valid(props) and (props ->> '$.k') is not null")
def _(t):
    held = t.events.filter("props is not null").filter(J.path("props", "$.k").isNotNull())
    return held.select("event_id", _text(lambda p: J.substitute("k=${k} ${missing}", json.loads(p)), "props").alias("filled"))


@query("op118_line_edit", f"select raw_id, regexp_replace(replace(textcontent, chr(13) || chr(10), chr(10)), 'risk log', 'risk register') as edited from {RAW} where contains(textcontent, 'risk log')")
def _(t):
    """The first place of a phrase replaced in every text that has it."""
    return raw(t).filter(F.col("textcontent").contains("risk log")).select("raw_id", edits.edited("textcontent", "risk log", "risk register").alias("edited"))


@query("op118_unified_diff")
def _(t):
    """The same edits as unified diffs."""
    both = raw(t).filter(F.col("textcontent").contains("risk log")).select("raw_id", "textcontent", edits.edited("textcontent", "risk log", "risk register").alias("edited"))
    return both.select("raw_id", edits.diff(F.col("textcontent"), F.col("edited")).alias("diff"))


@query("op121_json_repair")
def _(t):
    """Requirements that are no valid JSON, closed where they were cut, and whether that made them valid."""
    broken = runs(t).filter("requirements is not null").filter(F.try_parse_json("requirements").isNull())
    closed = broken.select("run_id", _text(lambda x: J.close(J.body(x)), "requirements").alias("closed"))
    return closed.select("run_id", "closed", F.try_parse_json("closed").isNotNull().alias("valid"))


@query("op131_next_run", "select workspace_id, case when workspace_id % 24 < 12 then strftime(timestamp '2026-01-02' + interval 1 hour * (workspace_id % 24)::int, '%Y-%m-%d %H:%M') else strftime(timestamp '2026-01-01' + interval 1 hour * (workspace_id % 24)::int, '%Y-%m-%d %H:%M') end as next_run from workspaces")
def _(t):
    plan = F.concat(F.lit("0 "), (F.col("workspace_id") % 24).cast("string"), F.lit(" * * *"))
    return t.workspaces.select("workspace_id", _text(lambda c: cron.next_run(c, datetime(2026, 1, 1, 11, 30)).strftime("%Y-%m-%d %H:%M"), plan).alias("next_run"))


@query("op138_model_classes", f"select chat_id, case when length(message) % 3 = 0 then 'short' when length(message) % 3 = 1 then 'long' end as label from {CHATS} where message is not null")
def _(t):
    """Labels by a pluggable model; the stand-in answers by the length of the message, or nothing."""
    model = lambda m: ("short", "long", None)[len(m) % 3]
    return chats(t).filter("message is not null").select("chat_id", _text(model, "message").alias("label"))


@query("op144_orphan_recovery", f"select run_id, case when run_status in ('queued', 'running') then 'failed' else run_status end as run_status from {RUNS}")
def _(t):
    return runs(t).select("run_id", F.when(F.col("run_status").isin("queued", "running"), "failed").otherwise(F.col("run_status")).alias("run_status"))


@query("op147_embedding_progress", f"select workspace_id, raw_id, row_number() over (partition by workspace_id order by raw_id) as done, count(*) over (partition by workspace_id) as total from {RAW} where textcontent is not null")
def _(t):
    docs = raw(t).filter("textcontent is not null").select("workspace_id", "raw_id")
    sizes = docs.groupBy(F.col("workspace_id").alias("w")).agg(F.count("*").alias("total"))
    placed = running_sum(docs, ["workspace_id"], F.floor(F.col("raw_id") / 10_000), ["raw_id"], F.lit(1), "before").withColumn("done", (F.col("before") + 1).cast("long"))
    return placed.join(sizes, F.col("workspace_id").eqNullSafe(F.col("w"))).select("workspace_id", "raw_id", "done", "total")


@query("op151_running_summary")
def _(t):
    """Running summaries of every document by a stand-in model that keeps first and last words."""
    model = lambda s: " ".join((s.split() or [""])[:3] + ["..."] + (s.split() or [""])[-3:])
    return raw(t).filter("textcontent is not null").select("raw_id", _text(lambda s: pipeline.summarise(s, 2000, model), "textcontent").alias("summary"))


@query("op156_tool_function", "select workspace_id, upper(slug) as shouted from workspaces where slug is not null")
def _(t):
    pipeline.tool("shout_text", "string")(lambda s: None if s is None else s.upper())
    pipeline.install(t._spark, "shout_text")
    return t.workspaces.filter("slug is not null").select("workspace_id", F.expr("shout_text(slug)").alias("shouted"))
