"""Sinks: canonical documents, vectors by namespace, chat exports and drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the fields of a canonical document.
CANONICAL = ("id", "url", "title", "docAuthor", "description", "docSource", "chunkSource", "published", "wordCount", "pageContent", "token_count_estimate")


def write_documents(df: DataFrame, folder: str, columns: dict[str, str] | None = None) -> None:
    """Documents as JSON lines with the canonical field names; ``columns`` maps field to column."""
    names = {f: f for f in CANONICAL} | (columns or {})
    df.select(*(F.col(c).alias(f) for f, c in names.items() if c in df.columns)).write.mode("append").json(folder)


def write_vectors(df: DataFrame, folder: str, namespace: str = "namespace") -> None:
    """Vectors in Parquet, a folder a namespace, so that reads of one namespace open only its files."""
    df.write.mode("append").partitionBy(namespace).parquet(folder)


def write_lines(df: DataFrame, line: str, folder: str, order: list[str]) -> None:
    """Text lines ordered across the files of the folder by a range partitioning, without one task for all."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(line).alias("value")).write.mode("overwrite").text(folder)


def write_conversations(messages: DataFrame, folder: str) -> None:
    """Role and content rows as JSON lines in the order (workspace_id, chat_id, part)."""
    order = ["workspace_id", "chat_id", "part"]
    rows = messages.withColumn("line", F.to_json(F.struct("workspace_id", "role", "content"), {"ignoreNullFields": "false"}))
    write_lines(rows, "line", folder, order)


def write_drafts(df: DataFrame, key: str, draft: str, folder: str) -> None:
    """Markdown drafts, a line-preserving text per key, a folder a key's first character."""
    df.filter(F.col(draft).isNotNull()).select(F.substring(key, 1, 1).alias("part"), F.col(draft).alias("value")).write.mode("overwrite").partitionBy("part").option("lineSep", "\n\n").text(folder)
