"""Session lists and reports."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import display_title, duration_label, normal_remote, project_key, short_cwd, stats_blurb, status_icon


def active_at() -> Column:
    return F.coalesce("last_active_at", "started_at")


def in_range(sessions: DataFrame, start: Column, end: Column, limit: int | None = 80) -> DataFrame:
    """Sessions active in the range, oldest first; the limit cuts after the sort."""
    rows = sessions.where(active_at().between(start, end)).orderBy(active_at(), "id")
    return rows if limit is None else rows.limit(limit)


def by_project(rows: DataFrame) -> DataFrame:
    """The report's groups: sessions, turns, first start and last activity of each project, most turns first."""
    keyed = rows.withColumn("project", project_key(F.col("cwd"), F.col("project_path")))
    return keyed.groupBy("project").agg(F.count(F.lit(1)).alias("sessions"), F.sum("turn_count").alias("turns"), F.min("started_at").alias("first_at"), F.max("last_active_at").alias("last_at")).orderBy(F.desc("turns"), "project")


def full_list(sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every session, newest first, with its chunk count and display columns."""
    counts = chunks.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("chunk_count"))
    span = duration_label(F.col("started_at"), F.col("last_active_at"))
    return sessions.join(counts, "id", "left").withColumns({
        "chunk_count": F.coalesce("chunk_count", F.lit(0)), "duration": span, "blurb": stats_blurb(F.col("turn_count"), span, F.col("cost_usd")), "icon": status_icon(F.col("status")),
        "title": display_title(F.col("summary_title"), F.col("summary_short"), F.col("first_user_text")), "short_cwd": short_cwd(F.col("cwd")),
    }).orderBy(active_at().desc(), "id")


def detail(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.where(F.col("id") == session_id).select("first_user_text", "last_user_text", "summary_long", "source_path", "derived_branches")


def recent_open(sessions: DataFrame, limit: int = 25) -> DataFrame:
    return sessions.where("status <> 'completed'").orderBy(F.desc("started_at"), "id").limit(limit)


def find_by_prefix(sessions: DataFrame, prefix: str) -> DataFrame:
    """At most two rows: none, the session, or proof that the prefix is ambiguous."""
    return sessions.where(F.lower("id").startswith(prefix.lower())).orderBy("id").limit(2)


def the_one(sessions: DataFrame, prefix: str):
    """The session a prefix names, None without one; an ambiguous prefix is an error."""
    rows = find_by_prefix(sessions, prefix).collect()
    if len(rows) > 1:
        raise ValueError(f"session prefix is ambiguous: {prefix}")
    return rows[0] if rows else None


def show(sessions: DataFrame, chunks: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Metadata and chunks in order of the sessions that a prefix matches."""
    hit = sessions.where(F.lower("id").startswith(prefix.lower()))
    return hit, chunks.join(hit.select(F.col("id").alias("session_id")), "session_id", "left_semi").orderBy("session_id", "start_seq")


def browse_filter(rows: DataFrame, text: str, columns: tuple[str, ...] = ("id", "cwd", "title", "first_user_text", "git_branch")) -> DataFrame:
    """Rows that hold the text, in any case, in one of five columns."""
    tests = [F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False)) for c in columns if c in rows.columns]
    return rows.where(reduce(or_, tests, F.lit(False))) if text else rows


def select_where(sessions: DataFrame, *tests: Column | None, everything: bool = False) -> DataFrame:
    """All given tests together; without any, nothing unless everything is asked for."""
    given = [t for t in tests if t is not None]
    return sessions.where(reduce(and_, given)) if given else sessions.where(F.lit(everything))


def triage_candidates(sessions: DataFrame, recipes: DataFrame, classifications: DataFrame, now: datetime, since: timedelta | None = None, status: str | None = "active", with_branches: bool = False, again: bool = False, most: int | None = None) -> DataFrame:
    """Session and recipe pairs without a verdict, newest session first; a limit reads four times as many sessions, 200 at least.

    Recipes are a handful of configuration rows, so the product is bounded by the sessions.
    """
    hit = select_where(
        sessions, F.col("status") == status if status else None, F.col("started_at") >= F.lit(now - since) if since else None, F.col("derived_branches").isNotNull() if with_branches else None, everything=True
    ).orderBy(F.desc("started_at"), "id")
    hit = hit if most is None else hit.limit(max(4 * most, 200))
    pairs = hit.crossJoin(F.broadcast(recipes.select("recipe_id")))
    if not again:
        pairs = pairs.join(classifications.select(F.col("session_id").alias("id"), "recipe_id"), ["id", "recipe_id"], "left_anti")
    pairs = pairs.orderBy(F.desc("started_at"), "id", "recipe_id")
    return pairs if most is None else pairs.limit(most)


def needs_summary() -> Column:
    """No summary yet, or made at another turn count."""
    return F.col("summary_short").isNull() | ~F.col("summary_turn_count").eqNullSafe(F.col("turn_count"))


def summarise_candidates(sessions: DataFrame, now: datetime, prefix: str | None = None, all_active: bool = False, since: timedelta | None = None, stale_only: bool = False, everything: bool = False) -> DataFrame:
    """Sessions chosen for a summary; those still in use within 30 minutes are left out of a stale-only choice."""
    if prefix:
        return sessions.where(F.lower("id").startswith(prefix.lower()))
    return select_where(
        sessions, F.col("status") == "active" if all_active else None, F.col("started_at") >= F.lit(now - since) if since else None,
        F.col("last_active_at").isNull() | (F.col("last_active_at") < F.lit(now - timedelta(minutes=30))) if stale_only else None, everything=everything,
    ).orderBy(F.desc("started_at"), "id")


def active_without_summary(sessions: DataFrame) -> DataFrame:
    return sessions.where((F.col("status") == "active") & needs_summary()).orderBy(F.desc("started_at"), "id")


def any_summary(sessions: DataFrame) -> bool:
    return not sessions.where("summary_short is not null").limit(1).isEmpty()


def recipe_overview(recipes: DataFrame, sessions: DataFrame, judged: DataFrame, now: datetime) -> DataFrame:
    """The recipes with the number of sessions they have judged and of candidates they have not."""
    count = lambda rows, name: rows.groupBy("recipe_id").agg(F.count(F.lit(1)).alias(name))
    rows = recipes.join(count(judged, "judged"), "recipe_id", "left").join(count(triage_candidates(sessions, recipes, judged, now), "candidates"), "recipe_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("judged", "candidates")})


def index_coverage(chunks: DataFrame, vectors: DataFrame, model_id: str) -> DataFrame:
    """Per session its chunks, those with a vector of the model, and whether that is all."""
    mine = vectors.where(F.col("model_id") == model_id).select("chunk_id", F.lit(True).alias("has"))
    rows = chunks.where("session_id is not null").select("chunk_id", "session_id").join(mine, "chunk_id", "left")
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("has").alias("embedded")).withColumn("complete", F.col("chunks") == F.col("embedded"))


def repo_identity(sessions: DataFrame, lookups: DataFrame) -> DataFrame:
    """Sessions with the repository they worked in: the normalised remote of their folder, else the root of its work tree, else null.

    lookups (cwd, remote, top_level): what a host has found out about folders, a row a folder."""
    told = lambda c: F.when(F.trim(c) != "", F.trim(c))
    found = lookups.select("cwd", F.coalesce(normal_remote(told("remote")), told("top_level")).alias("repo"))
    return sessions.join(found, "cwd", "left")
