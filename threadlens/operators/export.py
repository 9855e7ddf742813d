"""Exports of a session: raw lines, markdown, prose and one JSON document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import not_blank, utc_text


def raw_lines(files: DataFrame, path: str) -> DataFrame:
    """The source's lines as they are."""
    return files.where(F.col("path") == path).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n", -1)).alias("seq", "line")).orderBy("seq")


def prose(chunks: DataFrame) -> DataFrame:
    """(session_id, document): chunk texts in order under a heading each."""
    part = F.concat(F.lit("--- chunk seq "), F.col("start_seq").cast("string"), F.lit(".."), F.col("end_seq").cast("string"), F.lit(" ---\n"), F.col("text"), F.lit("\n\n"))
    parts = F.array_sort(F.collect_list(F.struct("start_seq", part.alias("p"))))
    return chunks.groupBy("session_id").agg(F.array_join(F.transform(parts, lambda x: x["p"]), "").alias("document"))


SESSION_FIELDS = ("id", "project_path", "cwd", "git_branch", "started_at", "ended_at", "message_count", "turn_count", "status", "first_user_text", "last_user_text")
CHUNK_FIELDS = ("id", "start_seq", "end_seq", "start_ts", "end_ts", "approx_tokens", "text")


def json_document(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(session_id, document): {"session": 11 fields, "chunks": [7 fields each, in order]}."""
    parts = F.array_sort(F.collect_list(F.struct("start_seq", F.struct(*CHUNK_FIELDS).alias("c"))))
    listed = chunks.groupBy("session_id").agg(F.transform(parts, lambda x: x["c"]).alias("chunks"))
    rows = sessions.select(F.col("id").alias("session_id"), F.struct(*[c for c in SESSION_FIELDS if c in sessions.columns]).alias("session")).join(listed, "session_id", "left")
    return rows.select("session_id", F.to_json(F.struct("session", F.coalesce("chunks", F.array()).alias("chunks")), {"ignoreNullFields": "false"}).alias("document"))


def _heading(who: str) -> Column:
    return F.concat(F.lit(f"\n## {who}  _"), utc_text("ts"), F.lit("_\n\n"))


def markdown(events: DataFrame) -> DataFrame:
    """(session_id, document): a heading an event; tool calls with their input, tool results as a placeholder.

    Events of both formats have the same columns, so both are rendered; each tool call is rendered once.
    """
    texts = F.filter("blocks", lambda b: (b["type"] == "text") & not_blank(b["text"]))
    results = F.size(F.filter("blocks", lambda b: b["type"] == "tool_result"))
    said = F.array_join(F.transform(texts, lambda b: F.concat(b["text"], F.lit("\n"))), "")
    user = F.when(F.size(texts) > 0, F.concat(_heading("User"), said)).otherwise(F.repeat(F.lit("\n> _tool result (omitted)_\n\n"), results))
    calls = F.filter(F.try_variant_get("raw", "$.message.content", "array<variant>"), lambda b: F.try_variant_get(b, "$.type", "string") == "tool_use")
    call = lambda b: F.concat(F.lit("### Tool · "), F.coalesce(F.try_variant_get(b, "$.name", "string"), F.lit("?")), F.lit("\n```json\n"), F.coalesce(F.to_json(F.try_variant_get(b, "$.input", "variant")), F.lit("{}")), F.lit("\n```\n"))
    tools = F.coalesce(F.array_join(F.transform(calls, call), ""), F.lit(""))
    spoken = F.array_join(F.transform(texts, lambda b: F.concat(b["text"], F.lit("\n\n"))), "")
    assistant = F.when((F.size(texts) > 0) | (tools != ""), F.concat(_heading("Assistant"), spoken, tools)).otherwise("")
    rows = events.where(F.col("type").isin("user", "assistant")).select("session_id", "seq", "path", F.when(F.col("type") == "user", user).otherwise(assistant).alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("seq", "part")))
    head = F.concat(F.lit("# Session "), F.col("session_id"), F.lit("\n**File:** `"), F.col("path"), F.lit("`\n\n"))
    return rows.groupBy("session_id").agg(F.max("path").alias("path"), F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("body")).select("session_id", F.concat(head, "body").alias("document"))


def source_path(stored: Column, stored_exists: Column, root: Column, project: Column, session: Column) -> Column:
    """The stored path if the file is there, else where the project keeps it."""
    return F.when(stored_exists, stored).otherwise(F.concat(root, F.lit("/"), project, F.lit("/"), session, F.lit(".jsonl")))


def resolve_source(sessions: DataFrame, listing: DataFrame, root: str, session_id: str) -> str:
    """Where a session's transcript is, by the files that are listed; a session that is not indexed is an error."""
    there = listing.select(F.col("path").alias("source_path"), F.lit(True).alias("_there"))
    row = sessions.where(F.col("id") == session_id).join(there, "source_path", "left")
    found = row.select(source_path(F.col("source_path"), F.coalesce("_there", F.lit(False)), F.lit(root), F.col("project_path"), F.col("id"))).first()
    if found is None:
        raise ValueError(f"session not in index: {session_id}")
    return found[0]


def document(fmt: str, session_id: str, sessions: DataFrame, chunks: DataFrame, events: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """One session in a format: md or markdown, json, prose as (session_id, document), jsonl as the source's (seq, line)."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}; one of {', '.join(FORMATS)}")
    path = resolve_source(sessions, files, root, session_id)
    if fmt == "jsonl":
        return raw_lines(files, path)
    if fmt in ("md", "markdown"):
        return markdown(events.where(F.col("session_id") == session_id))
    own = chunks.where(F.col("session_id") == session_id)
    return prose(own) if fmt == "prose" else json_document(sessions.where(F.col("id") == session_id), own)


FORMATS = ("md", "markdown", "json", "jsonl", "prose")
