"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.io import load
from lodestack.llm import leaks, near_duplicates, packing, personal, prompt_pairs, segments, subjects, truncation


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """raw_documents.textcontent and rfp_runs.draft_proposal as (table_name, record_key, text)."""
    raw = load(spark, folder, "raw_documents").select(F.lit("raw_documents").alias("table_name"), F.col("raw_id").cast("string").alias("record_key"), F.col("textcontent").alias("text"))
    runs = load(spark, folder, "rfp_runs").select(F.lit("rfp_runs").alias("table_name"), F.col("run_id").alias("record_key"), F.col("draft_proposal").alias("text"))
    return raw.unionByName(runs)


def _defects(spark: SparkSession, folder: str) -> DataFrame:
    models = load(spark, folder, "workspaces").select("workspace_id", "chat_model")
    chats = load(spark, folder, "workspace_chats").join(models, "workspace_id", "left")
    return prompt_pairs.evidence(chats, "chat_id", "message", "textresponse", [F.col("chat_source"), F.col("chat_model")])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _defects(spark, folder).select(F.col("key").alias("chat_id"), "defect_type").distinct()


def p1_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """How many pairs each set of rules makes defective."""
    rules = _defects(spark, folder).groupBy("key", "defect_type").agg(F.array_join(F.sort_array(F.collect_set("rule")), "+").alias("rules"))  # at most five a pair
    return rules.groupBy("defect_type", "rules").agg(F.count("*").alias("pairs"))


def _cuts(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_values(load(spark, folder, "rfp_runs"), "run_id", "intake_source", ["requirements", "draft_proposal"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cuts(spark, folder).filter("cut").select(F.col("key").alias("run_id"), F.col("field").alias("field_name")).distinct()


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_rates(_cuts(spark, folder)).withColumnsRenamed({"origin": "intake_source", "field": "field_name"})


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = near_duplicates.near_pairs(_texts(spark, folder), "record_key", "text", "table_name")
    return pairs.select(F.col("part").alias("table_name"), "first_key", "second_key")


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_duplicates.near_groups(_texts(spark, folder), "record_key", "text", "table_name")
    return groups.select(F.col("part").alias("table_name"), F.col("key").alias("record_key"), "group_id", "links")


def _pieces(spark: SparkSession, folder: str, distinct: bool) -> DataFrame:
    return segments.pieces(load(spark, folder, "raw_documents"), "raw_id", "textcontent", "embed_profile", load(spark, folder, "size_limits"), distinct=distinct)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder, False).filter("pieces > 1 and piece = 0").select(F.col("key").alias("raw_id")).distinct()


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder, True).select(F.col("key").alias("raw_id"), "piece", "start", "end", "pieces", F.col("text").alias("piece_text"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = personal.findings(_texts(spark, folder), "record_key", "text", "table_name")
    return found.select(F.col("part").alias("table_name"), F.col("key").alias("record_key"), "pii_type", "start_pos").distinct()


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return personal.redacted(_texts(spark, folder).distinct(), "text")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_profiles(load(spark, folder, "documents"), "doc_id", "text", load(spark, folder, "size_limits"), ["pack_train", "pack_eval"])


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).select("profile", "container", F.col("key").alias("doc_id"), "piece", "token_start", "tokens")


def p6_usage(spark: SparkSession, folder: str) -> DataFrame:
    return packing.usage(_packed(spark, folder), load(spark, folder, "size_limits"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(load(spark, folder, "documents"), "doc_id", "text", load(spark, folder, "eval_items"), "item_id", "item_text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"))


def p7_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("documents"), F.sum("windows").alias("windows"))


def p7_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text")
    clean = leaks.remove_leaks(docs, "doc_id", "text", load(spark, folder, "eval_items"), "item_id", "item_text")
    return clean.select("doc_id", F.length("text").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    areas = sorted(r.subject_area for r in load(spark, folder, "subject_areas").select("subject_area").collect())  # eight rows
    return subjects.subjects(load(spark, folder, "documents"), "doc_id", "text", load(spark, folder, "subject_labels"), "doc_id", "subject_area", areas)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder).select(F.col("key").alias("doc_id"), F.col("area").alias("subject_area"))


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each subject area by source and lang."""
    docs = load(spark, folder, "documents").select("doc_id", "source", "lang")
    found = _subjects(spark, folder).withColumnRenamed("key", "doc_id")
    return found.join(docs, "doc_id").groupBy(F.col("area").alias("subject_area"), "source", "lang").agg(F.countDistinct("doc_id").alias("documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_evidence, p2_found, p2_rates, p3_found, p3_groups, p4_found, p4_pieces, p5_found, p5_redacted, p6_containers, p6_usage, p7_found, p7_leaked_items, p7_cleaned, p8_found, p8_composition)}


_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_SHOWN = r"""replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]', '\1', 'g'),
    '(?i)\[[a-z]+://[^\s\]]+[ \t]*([^\]]*)\]', '\1', 'g'), '(?i)<(?:br|hr|p|div|li|td|tr)\b[^<>]*>', ' ', 'g'), '</?[a-zA-Z][^<>]*>|''{{2,}}', '', 'g'), '&nbsp;', ' ')"""


def _eight_words(table: str, key: str, text: str) -> str:
    words = f"select {key}, {_WORDS.format(_SHOWN.format(text))} as w from {table} where {text} is not null"
    return f"select distinct {key}, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) as g from ({words})"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""
            with texts as (
                select distinct 'raw_documents' as t, raw_id::varchar as k, textcontent as x from raw_documents where textcontent is not null
                union all select distinct 'rfp_runs', run_id, draft_proposal from rfp_runs where draft_proposal is not null),
            words as (select t, k, {_WORDS.format("x")} as w from texts),
            grams as (select distinct t, k, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from words where len(w) >= 20),
            sizes as (select t, k, count(*) as n from grams group by 1, 2),
            shared as (select a.t, a.k as first_key, b.k as second_key, count(*) as s from grams a join grams b on a.t = b.t and a.g = b.g and a.k < b.k group by 1, 2, 3)
            select s.t as table_name, s.first_key, s.second_key from shared s
            join sizes x on x.t = s.t and x.k = s.first_key join sizes y on y.t = s.t and y.k = s.second_key
            where 2 * s.s >= x.n + y.n - s.s
        """,
        "p4_found": """
            select distinct r.raw_id from raw_documents r
            join size_limits d on d.profile = 'default' and d.applies_to = 'textcontent'
            left join size_limits s on s.profile = r.embed_profile and s.applies_to = 'textcontent'
            where length(r.textcontent) > coalesce(s.max_size, d.max_size)
        """,
        "p7_found": f"""
            with d as ({_eight_words("documents", "doc_id", "text")}), i as ({_eight_words("eval_items", "item_id", "item_text")})
            select distinct d.doc_id, i.item_id from d join i using (g)
        """,
    }
