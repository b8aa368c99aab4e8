"""Queries of text, JSON, array and date functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lodestack.functions import json as J
from lodestack.functions import text as X
from lodestack.functions import tokens
from lodestack.operators import relational as R
from lodestack.plans.registry import query
from lodestack.plans.relational import CHATS, chats
from lodestack.sources import sql as S

RAW = "(select distinct * exclude (ingested_at) from raw_documents)"
RUNS = "(select distinct * exclude (ingested_at) from rfp_runs)"


def raw(t):
    return R.Once(t.raw_documents.drop("ingested_at"), "raw_id")


def runs(t):
    return R.Once(t.rfp_runs.drop("ingested_at"), "run_id")


@query(
    "op01_extension_dispatch",
    f"""select raw_id, case when regexp_matches(coalesce(chunksource, ''), '^link://') then 'web' when lower(chunksource) like '%.txt' or lower(chunksource) like '%.md' then 'text' when lower(chunksource) like '%.pdf' then 'pdf' else 'fallback' end as converter from {RAW}""",
)
def _(t):
    from lodestack.sources.files import converter

    return raw(t).select("raw_id", converter(F.col("chunksource")).alias("converter"))


_HEAD = "substring(textcontent, 1, 1024)"


@query(
    "op02_text_likeness",
    rf"""select raw_id, (length({_HEAD}) - length(regexp_replace({_HEAD}, '[\x01-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) < length({_HEAD}) * 0.1 or length({_HEAD}) = 0) as is_text from {RAW}""",
)
def _(t):
    return raw(t).select("raw_id", X.is_text("textcontent").alias("is_text"))


def _slug_sql(c: str) -> str:
    for symbol, word in X.SLUG_WORDS:
        c = f"replace({c}, '{symbol}', '{word}')"
    c = f"replace(replace(replace(replace(strip_accents(replace(replace(lower({c}), 'ß', 'ss'), 'ø', 'o')), 'æ', 'ae'), 'œ', 'oe'), 'ł', 'l'), 'đ', 'd')"
    return rf"regexp_replace(regexp_replace(regexp_replace({c}, '[^a-z0-9\s-]', '', 'g'), '[\s-]+', '-', 'g'), '^-|-$', '', 'g')"


@query("op09_raw_text_ingest", f"select raw_id, {_slug_sql('title')} || '.txt' as file_title, coalesce(url, 'file://' || {_slug_sql('title')} || '.txt') as file_url, coalesce(docauthor, 'no author found') as author, coalesce(description, 'No description found.') as about from {RAW}")
def _(t):
    name = F.concat(X.slug("title"), F.lit(".txt"))
    return raw(t).select("raw_id", name.alias("file_title"), F.coalesce("url", F.concat(F.lit("file://"), name)).alias("file_url"), F.coalesce("docauthor", F.lit("no author found")).alias("author"), F.coalesce("description", F.lit("No description found.")).alias("about"))


@query(
    "op13_connection_parts",
    "select workspace_id, 'postgresql' as scheme, 'u' || workspace_id as username, slug || '.example' as host, 5432 as port, slug as endpoint, slug || '.example:5432,backup.example' as hosts, 's@cret' as password, 'true' as ssl from workspaces",
)
def _(t):
    uri = F.concat(F.lit("postgresql://u"), F.col("workspace_id").cast("string"), F.lit(":s%40cret@"), F.col("slug"), F.lit(".example:5432,backup.example/"), F.col("slug"), F.lit("?ssl=true"))
    return t.workspaces.select("workspace_id", *S.connection_columns(uri))


@query("op14_catalog")
def _(t):
    t.register("orders", "customer", "nation")
    return S.table_schema(t._spark, "orders")


STORED = ("raw_id", "url", "title", "docauthor", "description", "docsource", "chunksource", "published", "wordcount", "token_count_estimate")


@query("op16_document_store", f"select {', '.join(STORED)} from {RAW} where {' and '.join(f'{c} is not null' for c in (*STORED, 'textcontent'))}")
def _(t):
    """Stored documents that have every field of the canonical form, without their text."""
    return raw(t).dropna(subset=[*STORED, "textcontent"]).select(*STORED)


FORM = (("id", "raw_id"), ("url", "url"), ("title", "title"), ("docAuthor", "docauthor"), ("description", "description"), ("docSource", "docsource"), ("chunkSource", "chunksource"), ("published", "published"), ("wordCount", "wordcount"), ("pageContent", "textcontent"), ("token_count_estimate", "token_count_estimate"))


@query("op23_document_json", "select raw_id, to_json({" + ", ".join(f"'{name}': {column}" for name, column in FORM) + "})::varchar as document from " + RAW)
def _(t):
    """Every document in its canonical form as one JSON value; what is missing is null."""
    columns = list(dict.fromkeys(c for _, c in FORM))
    return raw(t).select(*columns).select("raw_id", F.to_json(F.struct(*(F.col(c).alias(n) for n, c in FORM)), {"ignoreNullFields": "false"}).alias("document"))


@query("op32_draft_files", rf"select run_id, regexp_replace(coalesce(tender_filename, run_id), '[.][A-Za-z0-9]+$', '') || '-draft.md' as file_name, draft_proposal as content from {RUNS} where draft_proposal is not null and trim(draft_proposal) <> ''")
def _(t):
    """Every draft that has text as a Markdown file named after its tender."""
    drafts = runs(t).filter("draft_proposal is not null and trim(draft_proposal) <> ''").select("run_id", "tender_filename", "draft_proposal")
    name = F.concat(F.regexp_replace(F.coalesce("tender_filename", "run_id"), r"[.][A-Za-z0-9]+$", ""), F.lit("-draft.md"))
    return drafts.select("run_id", name.alias("file_name"), F.col("draft_proposal").alias("content"))


@query("op03_plain_files", f"select raw_id, textcontent as text from {RAW} where textcontent is not null")
def _(t):
    """Every text as the bytes of a file and read again by the converter of its extension."""
    from lodestack.sources import files

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: files.convert("text", bytes(b))[0][1])

    return raw(t).filter("textcontent is not null").select("raw_id", "textcontent").select("raw_id", read(F.encode("textcontent", "utf-8")).alias("text"))


@query(
    "op18_head_tail",
    f"""with l as (select raw_id, string_split(textcontent, chr(10)) as lines from {RAW} where textcontent is not null)
    select raw_id, array_to_string(lines[1:2], chr(10)) as head, array_to_string(lines[greatest(len(lines) - 1, 1):len(lines)], chr(10)) as tail from l""",
)
def _(t):
    lines = F.split("textcontent", "\n")
    size = F.size(lines)
    return raw(t).filter("textcontent is not null").select("raw_id", F.array_join(F.slice(lines, 1, 2), "\n").alias("head"), F.array_join(F.slice(lines, F.greatest(size - 1, F.lit(1)), F.lit(2)), "\n").alias("tail"))


@query(
    "op19_content_search",
    f"""with l as (select raw_id, unnest(string_split(textcontent, chr(10))) as content, generate_subscripts(string_split(textcontent, chr(10)), 1) as line from {RAW} where textcontent is not null)
    select raw_id, line::int as line, content from l where regexp_matches(content, '(?i)signature book')""",
)
def _(t):
    hits = raw(t).filter(F.col("textcontent").rlike("(?i)signature book")).select("raw_id", F.posexplode(F.split("textcontent", "\n")).alias("at", "content"))
    return hits.filter(F.col("content").rlike("(?i)signature book")).select("raw_id", (F.col("at") + 1).alias("line"), "content")


@query(
    "op22_delimiter_sniff",
    f"""with l as (select raw_id, string_split(textcontent, chr(10))[1] as line from {RAW} where textcontent is not null), n as (select raw_id, length(line) - length(replace(line, ',', '')) as c, length(line) - length(replace(line, ';', '')) as s, length(line) - length(replace(line, chr(9), '')) as t, length(line) - length(replace(line, '|', '')) as p from l)
    select raw_id, case when c >= s and c >= t and c >= p then ',' when s >= t and s >= p then ';' when t >= p then chr(9) else '|' end as delimiter from n""",
)
def _(t):
    return raw(t).filter("textcontent is not null").select("raw_id", X.delimiter("textcontent").alias("delimiter"))


@query("op38_text_comparators", f"select chat_id, (contains(lower(message), 'risk') or contains(lower(message), 'annex')) as contains_any, regexp_matches(substring(message, 1, 10000), '(?i)lot [0-9]+') as matched, lower(chat_source) = 'api' as same from {CHATS} where message is not null")
def _(t):
    m = F.col("message")
    return chats(t).filter("message is not null").select("chat_id", X.matches_any("message", F.lit("Risk, annex,")).alias("contains_any"), F.substring(m, 1, 10000).rlike("(?i)lot [0-9]+").alias("matched"), (F.lower("chat_source") == "api").alias("same"))


@query("op39_number_comparators", "select event_id, coalesce(value between 10 and 50, false) as within, coalesce(value > 25, false) as above, coalesce(value <> 3, false) as differs from events")
def _(t):
    return t.events.select("event_id", X.numeric_compare("value", "between", "10,50").alias("within"), X.numeric_compare("value", "gt", "25").alias("above"), X.numeric_compare("value", "neq", "3").alias("differs"))


@query("op40_condition_combine", "select event_id, (value > 20 and event_type = 'click') as all_met, (value > 20 or event_type = 'click') as any_met, false as none_given from events where value is not null and event_type is not null")
def _(t):
    met = F.array(F.col("value") > 20, F.col("event_type") == "click")
    empty = F.array().cast("array<boolean>")
    events = t.events.filter("value is not null and event_type is not null")
    return events.select("event_id", F.forall(met, lambda c: c).alias("all_met"), F.exists(met, lambda c: c).alias("any_met"), ((F.size(empty) > 0) & F.forall(empty, lambda c: c)).alias("none_given"))


@query("op41_predicate_errors", f"select run_id, case when not regexp_matches(lower(tender_filename), '[.](pdf|docx)$') then 'extension' else '' end || case when coalesce(length(requirements), 0) < 100 then ' too small' else '' end as errors from {RUNS} where tender_filename is not null")
def _(t):
    errors = F.array_compact(F.array(F.when(~F.lower("tender_filename").rlike("[.](pdf|docx)$"), "extension"), F.when(F.coalesce(F.length("requirements"), F.lit(0)) < 100, " too small")))
    return runs(t).filter("tender_filename is not null").select("run_id", F.array_join(errors, "").alias("errors"))


@query("op42_can_watch", f"select raw_id, (starts_with(chunksource, 'link://') and ends_with(chunksource, '.html')) or regexp_matches(chunksource, '^(youtube|confluence|github|gitlab)://') as watchable from {RAW} where chunksource is not null")
def _(t):
    return raw(t).filter("chunksource is not null").select("raw_id", X.can_watch("chunksource").alias("watchable"))


@query("op43_url_validity", f"select raw_id, regexp_matches(url, '^https?://[^/?#\\s]+') as valid, raw_id % 4 = 3 as address_valid from {RAW} where url is not null")
def _(t):
    """URLs of the table, and addresses of four kinds: private ones, another scheme and public ones."""
    hosts = F.array(*map(F.lit, ("http://10.0.0.", "http://192.168.1.", "ftp://8.8.4.", "http://8.8.4.")))
    address = F.concat(F.get(hosts, (F.col("raw_id") % 4).cast("int")), (F.col("raw_id") % 9).cast("string"))
    return raw(t).filter("url is not null").select("raw_id", X.is_public_url("url").alias("valid"), X.is_public_url(address).alias("address_valid"))


@query("op45_allow_list", f"select chat_id, coalesce(chat_source in ('api', 'embed'), false) as allowed, coalesce(regexp_matches(api_session_id, '^[0-9a-f-]{{36}}$'), false) as session_ok from {CHATS}")
def _(t):
    return chats(t).select("chat_id", F.coalesce(F.col("chat_source").isin("api", "embed"), F.lit(False)).alias("allowed"), F.coalesce(F.col("api_session_id").rlike("^[0-9a-f-]{36}$"), F.lit(False)).alias("session_ok"))


@query("op67_pattern_findings", f"select raw_id, len(regexp_extract_all(textcontent, '{X.EMAIL}'))::int as emails, len(regexp_extract_all(textcontent, '{X.PHONE}'))::int as phones from {RAW} where regexp_matches(textcontent, '{X.EMAIL}') or regexp_matches(textcontent, '{X.PHONE}')")
def _(t):
    counted = raw(t).select("raw_id", F.regexp_count("textcontent", F.lit(X.EMAIL)).alias("emails"), F.regexp_count("textcontent", F.lit(X.PHONE)).alias("phones"))
    return counted.filter("emails > 0 or phones > 0")


@query("op68_key_points", f"select chat_id, len(list_filter(string_split(textresponse, chr(10)), lambda x: regexp_matches(x, '\\S')))::int as points from {CHATS} where textresponse is not null")
def _(t):
    return chats(t).filter("textresponse is not null").select("chat_id", F.size(F.filter(F.split("textresponse", "\n"), lambda x: x.rlike(r"\S"))).alias("points"))


@query("op70_column_counts", f"with l as (select raw_id, unnest(string_split(textcontent, chr(10))) as line from {RAW} where contains(textcontent, ';')) select raw_id, min(len(string_split(line, ';')))::int as least, max(len(string_split(line, ';')))::int as most from l where trim(line) <> '' group by 1")
def _(t):
    sizes = F.transform(F.filter(F.split("textcontent", "\n"), lambda x: F.trim(x) != ""), lambda x: F.size(F.split(x, ";")))
    return raw(t).filter(F.col("textcontent").contains(";")).select("raw_id", F.array_min(sizes).alias("least"), F.array_max(sizes).alias("most"))


@query("op94_word_counts", r"select doc_id, len(string_split(text, ' '))::int as by_blank, len(string_split_regex(text, '\s+'))::int as by_space, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::int as words from documents where text is not null")
def _(t):
    a, b, c = X.word_counts("text")
    return t.documents.filter("text is not null").select("doc_id", a.alias("by_blank"), b.alias("by_space"), c.alias("words"))


@query("op95_token_estimate", "select doc_id, (case when length(text) >= 5120 then ceil(length(text) / 8.0) else ceil(length(text) / 4.0) end)::bigint as tokens from documents where text is not null")
def _(t):
    return t.documents.filter("text is not null").select("doc_id", X.token_estimate("text").alias("tokens"))


@query("op95_token_count")
def _(t):
    """Tokens of every text: counted by a tokenizer, estimated where it is long."""
    return t.documents.filter("text is not null").select("doc_id", tokens.count("text").alias("tokens"))


@query("op97_max_chunk", "select profile, least(coalesce(max_size, 1000), 1024)::int as chunk_size from size_limits")
def _(t):
    return t.size_limits.select("profile", F.least(F.coalesce("max_size", F.lit(1000)), F.lit(1024)).alias("chunk_size"))


@query(
    "op98_metadata_header",
    f"""with l as (select raw_id, concat_ws(chr(10), 'sourceDocument: ' || title, 'published: ' || published, 'source: ' || case when regexp_matches(chunksource, '^(link|youtube)://') then regexp_replace(chunksource, '^(link|youtube)://', '') end) as x from {RAW})
    select raw_id, case when x <> '' then '<document_metadata>' || chr(10) || x || chr(10) || '</document_metadata>' || chr(10) || chr(10) else '' end as header from l""",
)
def _(t):
    return raw(t).select("raw_id", X.metadata_header("title", "published", "chunksource").alias("header"))


@query("op99_token_chunks", r"with w as (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as words from documents where text is not null), c as (select doc_id, words, unnest(range(0, ((len(words) + 49) // 50)::bigint)) as ix from w) select doc_id, ix::int as ix, array_to_string(words[ix * 50 + 1:ix * 50 + 50], ' ') as chunk from c")
def _(t):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return t.documents.filter("text is not null").select("doc_id", F.posexplode(X.array_chunks(words, 50)).alias("ix", "c")).select("doc_id", "ix", F.array_join("c", " ").alias("chunk"))


@query(
    "op100_middle_out",
    r"""with w as (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from documents where text is not null), h as (select *, round((len(w) - 60) / 2.0)::int as half, floor(len(w) / 2.0)::int as mid from w)
    select doc_id, array_to_string(case when len(w) <= 60 then w else list_concat(w[1:greatest(mid - half, 0)], ['--prompt truncated--'], w[mid + half + 1:len(w)]) end, ' ') as prompt from h""",
)
def _(t):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return t.documents.filter("text is not null").select("doc_id", F.array_join(X.middle_out(words, 60), " ").alias("prompt"))


@query("op99_token_windows")
def _(t):
    """Pieces of 200 tokens of every text."""
    return t.documents.filter("text is not null").select("doc_id", F.posexplode(tokens.chunks("text", 200)).alias("ix", "chunk"))


@query("op99_last_tokens")
def _(t):
    """The last 100 tokens of every text."""
    return t.documents.filter("text is not null").select("doc_id", tokens.last("text", 100).alias("tail"))


@query("op100_middle_out_tokens")
def _(t):
    """Every text cut to 120 tokens by removing its middle."""
    return t.documents.filter("text is not null").select("doc_id", tokens.middle_out("text", 120).alias("prompt"))


@query("op101_fuzzy_match", "with q(term) as (values ('storage'), ('vendor list'), ('gate')) select w.workspace_id, q.term from workspaces w, q where contains(lower(w.title), q.term) or levenshtein(lower(w.title), q.term) <= 3")
def _(t):
    terms = t._spark.createDataFrame([("storage",), ("vendor list",), ("gate",)], "term string")
    title = F.lower("title")
    return t.workspaces.join(F.broadcast(terms), title.contains(F.col("term")) | (F.levenshtein(title, "term") <= 3)).select("workspace_id", "term")


@query("op102_preset_expansion", f"select chat_id, regexp_replace(message, '(^|\\s)@agent(\\s|$)', '\\1Please act as an agent.\\2', 'g') as expanded from {CHATS} where message like '%@agent%'")
def _(t):
    return chats(t).filter(F.col("message").contains("@agent")).select("chat_id", F.regexp_replace("message", r"(^|\s)@agent(\s|$)", "$1Please act as an agent.$2").alias("expanded"))


PRESETS = [("/sum", "Summarise:"), ("/sum2", "Summarise twice:"), ("List", "Enumerate")]


@query(
    "op102_preset_table",
    "select chat_id, regexp_replace(regexp_replace(regexp_replace(message, '(^|\\s)/sum(\\s|$)', '\\1Summarise:\\2', 'g'), '(^|\\s)/sum2(\\s|$)', '\\1Summarise twice:\\2', 'g'), '(^|\\s)List(\\s|$)', '\\1Enumerate\\2', 'g') as expanded from " + CHATS + " where message is not null",
)
def _(t):
    """Commands kept as a table, applied in its order where they stand as words of their own."""
    table = t._spark.createDataFrame([(i, c, p) for i, (c, p) in enumerate(PRESETS)], "created int, command string, prompt string")
    return chats(t).filter("message is not null").select("chat_id", "message").select("chat_id", X.expand_presets(F.col("message"), table).alias("expanded"))


VARIABLES = [("date", "2026-01-01", None), ("motto", "to the point", None), ("user.name", None, "user_id"), ("workspace.name", None, "title"), ("workspace.slug", None, "slug")]


@query("op103_variable_table", f"select c.chat_id, '2026-01-01: ' || coalesce(c.user_id::varchar, '[User name]') || ' in ' || coalesce(w.title, '[Workspace name]') || ' (' || coalesce(w.slug, '[Workspace slug]') || '), to the point {{unknown}} [User bio]' as prompt from {CHATS} c left join workspaces w using (workspace_id)")
def _(t):
    """Variables kept as a table: fixed texts, and properties of the user and the workspace; what has no value shows its name."""
    table = t._spark.createDataFrame(VARIABLES, "key string, value string, source string")
    df = chats(t).select("chat_id", "workspace_id", "user_id").join(t.workspaces.select("workspace_id", "title", "slug"), "workspace_id", "left")
    values = {r.key: F.lit(r.value) if r.source is None else F.col(r.source).cast("string") for r in table.limit(1_000).collect()}  # settings, not data
    return df.select("chat_id", X.fill_template(F.lit("{date}: {user.name} in {workspace.name} ({workspace.slug}), {motto} {unknown} {user.bio}"), values).alias("prompt"))


@query("op103_template_expansion", f"select c.chat_id, 'Hi ' || coalesce(c.user_id::varchar, '') || ' in ' || coalesce(w.title, '') || ', {{date}}: [User bio]' as prompt from {CHATS} c left join workspaces w using (workspace_id)")
def _(t):
    df = chats(t).select("chat_id", "workspace_id", "user_id").join(t.workspaces.select("workspace_id", "title"), "workspace_id", "left")
    return df.select("chat_id", X.expand_template(F.lit("Hi {user.id} in {workspace.name}, {date}: {user.bio}"), {"user.id": F.col("user_id"), "workspace.name": F.col("title")}).alias("prompt"))


@query("op105_slug", f"select distinct page_id, page_title, {_slug_sql('page_title')} as made, {_slug_sql(chr(39) + 'Größe & Œuvre: ' + chr(39) + ' || page_title')} as accented from documents where page_title is not null")
def _(t):
    titles = t.documents.filter("page_title is not null").select("page_id", "page_title").distinct()
    return titles.select("page_id", "page_title", X.slug("page_title").alias("made"), X.slug(F.concat(F.lit("Größe & Œuvre: "), F.col("page_title"))).alias("accented"))


@query(
    "op106_collection_name",
    r"with c as (select page_id, page_title, regexp_replace(substring(regexp_replace(regexp_replace(regexp_replace(page_title, '[^A-Za-z0-9._-]+', '-', 'g'), '\.{2,}', '.', 'g'), '^[^A-Za-z0-9]+', ''), 1, 63), '[^A-Za-z0-9]+$', '') as n from documents where page_title is not null) select distinct page_id, page_title, case when length(n) >= 3 then n else 'ns-' || n || '0' end as collection from c",
)
def _(t):
    return t.documents.filter("page_title is not null").select("page_id", "page_title", X.collection_name("page_title").alias("collection")).distinct()


@query("op107_file_name", rf"""select raw_id, regexp_replace(coalesce(url, ''), '[<>:"/\\|?*\x00-\x1F]', '', 'g') as file_name from {RAW}""")
def _(t):
    return raw(t).select("raw_id", X.file_name(F.coalesce("url", F.lit(""))).alias("file_name"))


_THINK = "(?is)<(?:think|thinking|thought|thought_chain|reasoning)>.*?</(?:think|thinking|thought|thought_chain|reasoning)>"


@query("op108_strip_thoughts", rf"select chat_id, regexp_replace(regexp_replace(textresponse, '{_THINK}', '', 'g'), '^\s+|\s+$', '', 'g') as answer from {CHATS} where contains(textresponse, '<think')")
def _(t):
    return chats(t).filter(F.col("textresponse").contains("<think")).select("chat_id", X.strip_thoughts("textresponse").alias("answer"))


@query("op109_entities", "select doc_id, replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') as decoded from documents where contains(text, '&')")
def _(t):
    return t.documents.filter(F.col("text").contains("&")).select("doc_id", X.decode_entities("text").alias("decoded"))


@query("op110_human_size", "select doc_id, case when n_chars < 1024 then n_chars || ' B' when n_chars < 1048576 then round(n_chars / 1024.0::double, 2) || ' KB' else round(n_chars / 1048576.0::double, 2) || ' MB' end as size from documents where n_chars is not null")
def _(t):
    return t.documents.filter("n_chars is not null").select("doc_id", X.human_size("n_chars").alias("size"))


_SECTIONS = "[" + ", ".join(f"'{s}'" for s in X.SECTIONS) + "]"


@query("op111_missing_sections", f"select run_id, array_to_string(list_filter({_SECTIONS}, lambda s: not contains(lower(draft_proposal), lower(s))), ', ') as missing from {RUNS} where draft_proposal is not null")
def _(t):
    return runs(t).filter("draft_proposal is not null").select("run_id", F.array_join(X.missing_sections("draft_proposal"), ", ").alias("missing"))


@query("op112_first_email", f"select raw_id, regexp_extract(textcontent, '{X.EMAIL}') as email from {RAW} where regexp_matches(textcontent, '{X.EMAIL}')")
def _(t):
    return raw(t).filter(F.col("textcontent").rlike(X.EMAIL)).select("raw_id", F.regexp_extract("textcontent", X.EMAIL, 0).alias("email"))


@query("op113_canonical_url", f"select raw_id, regexp_replace(case when regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://') then trim(url) else 'https://' || trim(url) end, '/$', '') as canonical from {RAW} where url is not null")
def _(t):
    return raw(t).filter("url is not null").select("raw_id", X.canonical_url("url").alias("canonical"))


@query("op114_video_id", "select page_id, case when page_id % 2 = 0 then lpad(page_id::varchar, 11, 'x') end as video from (select distinct page_id from documents)")
def _(t):
    name = F.lpad(F.col("page_id").cast("string"), 11, "x")
    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://www.youtube.com/watch?t=3&v="), name, F.lit("&list=1"))).otherwise(F.concat(F.lit("https://example.org/watch?v="), name))
    return t.documents.select("page_id").distinct().select("page_id", X.video_id(link).alias("video"))


@query("op115_split_source", f"select raw_id, nullif(regexp_extract(chunksource, '^([A-Za-z]+)://', 1), '') as kind, regexp_replace(chunksource, '^[A-Za-z]+://', '') as source from {RAW} where chunksource is not null")
def _(t):
    kind, source = X.split_source("chunksource")
    return raw(t).filter("chunksource is not null").select("raw_id", kind.alias("kind"), source.alias("source"))


@query("op116_source_key", f"select raw_id, 'title:' || title || '-timestamp:' || published as source_key from {RAW}")
def _(t):
    return raw(t).select("raw_id", X.source_key("title", "published").alias("source_key"))


@query(
    "op117_clip_context",
    f"""with h as (select raw_id, textcontent as t, substring(textcontent, 1, 500) as h from {RAW} where textcontent is not null), l as (select *, length(h) - length(list_last(string_split(h, chr(10)))) as last from h)
    select raw_id, case when length(t) <= 500 then t when contains(h, chr(10)) and last > 400 then substring(h, 1, last - 1) else h end as clipped from l""",
)
def _(t):
    return raw(t).filter("textcontent is not null").select("raw_id", X.clip_context("textcontent", 500).alias("clipped"))


@query("op119_safe_json", f"select run_id, case when json_valid(requirements) then requirements ->> '$.scope_summary' end as scope from {RUNS} where requirements is not null")
def _(t):
    return runs(t).filter("requirements is not null").select("run_id", J.path("requirements", "$.scope_summary").alias("scope"))


@query("op120_llm_json")
def _(t):
    """Requirements extracted from fenced, prefixed or truncated model output; parse_error where repair fails."""
    return runs(t).filter("requirements is not null").select("run_id", J.extract("requirements").alias("x")).select("run_id", "x.*")


@query("op122_json_path", f"select run_id, case when json_valid(requirements) then requirements ->> '$.deadlines.submission_deadline' end as deadline, case when json_valid(requirements) then requirements ->> '$.deliverables[0]' end as first_deliverable from {RUNS} where requirements is not null")
def _(t):
    return runs(t).filter("requirements is not null").select("run_id", J.path("requirements", "$.deadlines.submission_deadline").alias("deadline"), J.path("requirements", "$.deliverables[0]").alias("first_deliverable"))


@query("op123_array_chunks", "with w as (select workspace_id, string_split(title, ' ') as words from workspaces where title is not null), c as (select *, unnest(range(0, ((len(words) + 1) // 2)::bigint)) as ix from w) select workspace_id, ix::int as ix, array_to_string(words[ix * 2 + 1:ix * 2 + 2], ' ') as piece from c")
def _(t):
    return t.workspaces.filter("title is not null").select("workspace_id", F.posexplode(X.array_chunks(F.split("title", " "), 2)).alias("ix", "c")).select("workspace_id", "ix", F.array_join("c", " ").alias("piece"))


@query("op125_drop_json_key", "select event_id, (json_merge_patch(props, '{\"k\": null}'))::varchar as rest from events where props is not null")
def _(t):
    return t.events.filter("props is not null").select("event_id", J.without("props", "k").alias("rest"))


@query("op129_context_budget", "select profile, floor(max_size * 0.15)::int as system_part, floor(max_size * 0.15)::int as user_part, floor(max_size * 0.7)::int as history_part from size_limits")
def _(t):
    return t.size_limits.select("profile", *(F.floor(F.col("max_size") * F.lit(s)).cast("int").alias(n) for s, n in ((0.15, "system_part"), (0.15, "user_part"), (0.7, "history_part"))))


@query("op130_next_sync", f"select raw_id, (epoch_us(created_at) + greatest(604800000, 3600000)::bigint * 1000)::bigint as next_us from {RAW} where created_at is not null")
def _(t):
    return raw(t).filter("created_at is not null").select("raw_id", (F.unix_micros("created_at") + max(604_800_000, 3_600_000) * 1000).alias("next_us"))


@query("op132_date_formats", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as plain, strftime(ts, '%H:%M:%S') as clock, strftime(ts, '%B %-d, %Y') as long_date, strftime(ts, '%A, %B %-d, %Y %-I:%M %p') as full_date from events where ts is not null")
def _(t):
    formats = (("plain", "yyyy-MM-dd HH:mm:ss"), ("clock", "HH:mm:ss"), ("long_date", "MMMM d, yyyy"), ("full_date", "EEEE, MMMM d, yyyy h:mm a"))
    return t.events.filter("ts is not null").select("event_id", *(F.date_format("ts", f).alias(n) for n, f in formats))


@query(
    "op133_cell_kind",
    rf"""select raw_id, case when published is null or trim(published) = '' then 'empty' when lower(trim(published)) in ('true', 'false') then 'boolean' when regexp_matches(trim(published), '^-?[0-9]+(\.[0-9]+)?$') then 'number'
    when regexp_matches(trim(published), '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}})$') then 'date' else 'text' end as kind from {RAW}""",
)
def _(t):
    return raw(t).select("raw_id", X.cell_kind("published").alias("kind"))


@query("op134_signature", f"select chat_id, sha256(coalesce(chat_source, '') || chr(31) || coalesce(message, '')) as signature from {CHATS}")
def _(t):
    return chats(t).select("chat_id", F.sha2(F.concat_ws("\x1f", F.coalesce("chat_source", F.lit("")), F.coalesce("message", F.lit(""))), 256).alias("signature"))
