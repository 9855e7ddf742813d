"""Ingestion: changed files to sessions, chunks, usage and cursors in a store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.models import Embedder, embed_table
from ..schemas import PROVIDER_A, PROVIDER_B
from ..sources import transcripts
from ..sources.state import written
from . import blocks, enrich, listings, projection, search, store, usage


@dataclass(frozen=True)
class Options:
    roots_a: list[tuple[str, str]]
    root_b: str | None = None
    full: bool = False
    limit: int | None = None
    dry_run: bool = False
    metadata_only: bool = False
    exclusions: dict = field(default_factory=dict)


@dataclass
class Projected:
    """What a set of files gives; outcome: a row a file with its session, exclusion and cursor value."""

    outcome: DataFrame
    sessions: DataFrame
    chunks: DataFrame
    usage: DataFrame


def project(files: DataFrame, exclusions: dict | None = None, events: DataFrame | None = None) -> Projected:
    events = projection.session_keys(transcripts.events(files)) if events is None else events
    # Several files of one session: the last by time counts.
    paths = events.select("session_id", "path").distinct().join(files.select("path", "mtime_unix"), "path")
    events = events.join(store.latest_file(paths).select("path"), "path", "left_semi")
    turns = projection.turns_a(events.where(F.col("provider") == PROVIDER_A)).unionByName(projection.turns_b(events.where(F.col("provider") == PROVIDER_B)))
    meta, active = projection.session_meta(events), projection.last_active(turns)
    out = projection.excluded(events, turns, **(exclusions or {}))
    rows = meta.join(active, "session_id", "left").join(out, "session_id", "left").join(projection.derived_branches(events), "session_id", "left")
    rows = rows.withColumn("drop", F.coalesce(F.col("internal") | F.col("automated"), F.lit(False)))
    outcome = rows.select("session_id", F.col("source_path").alias("path"), "drop", F.coalesce("turn_count", F.lit(0)).alias("turn_count"), projection.cursor_outcome(F.col("drop"), F.col("turn_count")).alias("last_seq"))
    keep = rows.where(~F.col("drop") & (F.coalesce("turn_count", F.lit(0)) > 0))
    sessions = keep.select(F.col("session_id").alias("id"), "project_path", "cwd", "git_branch", "derived_branches", "started_at", "ended_at", F.coalesce("last_turn_at", "ended_at").alias("last_active_at"),
        "message_count", "turn_count", "first_user_text", "last_user_text", "provider", "source_path", "account")
    chunks = projection.chunks(turns.join(keep.select("session_id"), "session_id", "left_semi"))
    used = usage.rollup(usage.dedup(usage.observations(events))).withColumn("updated_at", F.current_timestamp())
    return Projected(outcome, sessions, chunks, used)


def ingest(spark: SparkSession, base: str, options: Options) -> dict[str, int] | DataFrame:
    """One incremental run. Returns counters, or with dry_run the sessions it would write, previewed.

    Unchanged files are skipped by their cursors, without being opened; a changed file's session is replaced whole, a
    session now left out is pruned with its usage kept, and one without turns keeps its old row. Files are parsed once, into
    a table of events that everything else is projected from. Only buckets with a changed session are written, and all of
    it is seen with the commit or not at all. While another run writes, nothing is done: {"skipped": 1}.
    """
    tables = store.Store(spark, base)
    if options.dry_run:
        todo = written(_todo(tables.begin(), options), "todo")
        found = project(todo, options.exclusions, projection.session_keys(transcripts.line_events(transcripts.changed_lines(spark, options.roots_a, options.root_b, todo))))
        return found.sessions.join(found.chunks.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("chunks"), F.substring(F.min_by("text", "start_seq"), 1, 600).alias("preview")), "id", "left")
    with tables.lock() as held:
        return tables.commit(lambda run: _ingest(run, options)) if held else {"skipped": 1}


def _todo(run: store.Transaction, options: Options) -> DataFrame:
    """The files to read, listed without being opened."""
    listing = transcripts.transcript_files(run.spark, options.roots_a, options.root_b, content=False)
    todo = listing if options.full or options.metadata_only else transcripts.changed(listing, run.read("files"))
    return transcripts.limited(todo, options.limit).drop("value")


def _ingest(run: store.Transaction, options: Options) -> dict[str, int]:
    spark, folder = run.spark, f"_run-{run.run}"

    def once(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{run.base}/{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{run.base}/{folder}/{name}")

    try:
        todo = once("todo", _todo(run, options))
        parsed = once("events", projection.session_keys(transcripts.line_events(transcripts.changed_lines(spark, options.roots_a, options.root_b, todo))))
        found = project(todo, options.exclusions, parsed)
        # Counted while the outcome is written.
        counts, number = Observation(), lambda test: F.count(F.when(test, 1))
        observed = found.outcome.observe(counts, F.count(F.lit(1)).alias("files"), number(F.col("drop")).alias("excluded"), number(F.col("last_seq") == -1).alias("empty"), number(F.col("last_seq") >= 0).alias("sessions"))
        outcome = once("outcome", observed)
        if not counts.get["files"] and todo.isEmpty():
            return counts.get | {"buckets": 0}
        touched = run.buckets_of("sessions", outcome, "session_id")
        old = {t: run.read(t, touched) for t in ("sessions", "chunks", "chunk_vectors", "session_usage")}
        pruned = store.delete_sessions(old, outcome.where("drop"))
        run.replace("session_usage", store.replace_by_session(pruned["session_usage"], found.usage, found.usage), touched)
        run.replace("sessions", usage.session_cost(store.merge_sessions(pruned["sessions"], found.sessions), run.read("session_usage", touched)), touched)
        if not options.metadata_only:
            chunks, done = once("chunks", found.chunks), outcome.where("last_seq >= 0")
            dead = old["chunks"].join(outcome.where("drop or last_seq >= 0").select("session_id"), "session_id", "left_semi").select(F.col("id").alias("chunk_id"))
            run.replace("chunk_vectors", old["chunk_vectors"].join(dead, "chunk_id", "left_anti"), touched)
            run.replace("chunks", store.replace_by_session(pruned["chunks"], chunks, done), touched)
            run.add_segment(chunks, dead)
            cursors = todo.join(outcome.select("path", "last_seq", "session_id"), "path", "left").select("path", "size", "mtime_unix", F.col("size").alias("last_offset"), F.coalesce("last_seq", F.lit(-1)).alias("last_seq"), "session_id")
            paths = run.buckets_of("files", todo)
            run.replace("files", store.latest_wins(run.read("files", paths), cursors, ["path"]), paths)
        return counts.get | {"buckets": len(touched)}
    finally:
        run.store.delete(folder)


def refresh(spark: SparkSession, base: str, options: Options, embedder: Callable[[], Embedder] | None = None, runner: Callable | None = None, model: str = "") -> dict[str, int]:
    """Ingest, then embed the chunks without a vector of this model, then, where summaries are in use, renew the stale ones.

    Each step is a commit of its own and writes only buckets that change."""
    counts = ingest(spark, base, options)
    tables = store.Store(spark, base)
    if "skipped" not in counts:
        if embedder is not None:
            tables.commit(lambda run: embed(run, embedder))
        if runner is not None and listings.any_summary(tables.read("sessions")):
            tables.commit(lambda run: summarise(run, runner, model))
    return counts


def embed(run: store.Transaction, embedder: Callable[[], Embedder]) -> None:
    """Vectors of this model for the chunks that have none."""
    model_id = embedder().model_id
    chunks, vectors = run.read("chunks"), run.read("chunk_vectors")
    bare = chunks.join(vectors.where(F.col("model_id") == model_id).select(F.col("chunk_id").alias("id")), "id", "left_anti")
    if touched := run.buckets_of("chunks", bare):
        new = embed_table(bare, "id", "text", embedder).join(bare.select(F.col("id").alias("chunk_id"), "session_id"), "chunk_id")
        run.replace("chunk_vectors", store.upsert_vectors(run.read("chunk_vectors", touched), new.withColumn("embedded_at", F.current_timestamp())), touched)


def summarise(run: store.Transaction, runner: Callable, model: str) -> None:
    """Summaries of active sessions whose summary is missing or stale."""
    stale = listings.active_without_summary(run.read("sessions")).select("id")
    if touched := run.buckets_of("sessions", stale):
        sessions = run.read("sessions", touched)
        new = enrich.summarise(sessions.join(stale, "id", "left_semi"), run.read("chunks", touched), runner, model)
        run.replace("sessions", store.latest_wins(sessions, new.select(*sessions.columns), ["id"]), touched)


def set_status(spark: SparkSession, base: str, prefix: str, status: str) -> None:
    """Set by hand in a store, for every session whose id starts with the prefix; only their buckets are written."""

    def work(run: store.Transaction) -> None:
        hit = run.read("sessions").where(F.lower("id").startswith(prefix.lower()))
        touched = run.buckets_of("sessions", hit)
        run.replace("sessions", store.set_status(run.read("sessions", touched), prefix, status), touched)

    store.Store(spark, base).commit(work)


def lexical(spark: SparkSession, base: str, query: str, k: int = 50, include_completed: bool = False) -> DataFrame:
    """BM25 ranks over a store, from its term blocks: chunks' texts are not read, nor blocks that hold no hit."""
    run = store.Store(spark, base).begin()
    chunks, sessions = run.read("chunks").withColumnRenamed("id", "chunk_id"), run.read("sessions").withColumnRenamed("id", "session_id")
    return blocks.lexical(*run.postings(), chunks, sessions, query, k, include_completed)[0]


def hybrid(spark: SparkSession, base: str, query: str, embedder: Embedder | None = None, query_vector: list[float] | None = None, model_id: str | None = None, pool: int = 50, include_completed: bool = False, **more) -> DataFrame:
    """search.hybrid_search() over a store, from its term blocks and vector cells: texts are read for the hits only."""
    run = store.Store(spark, base).begin()
    chunks, sessions = run.read("chunks").withColumnRenamed("id", "chunk_id"), run.read("sessions").withColumnRenamed("id", "session_id")
    if query_vector is None and embedder is not None:
        query_vector, model_id = [float(x) for x in embedder.embed([query], "query")[0]], embedder.model_id
    fts, vec = blocks.lexical(*run.postings(), chunks, sessions, query, pool, include_completed)[0], None
    if query_vector is not None and model_id is not None:
        vec = search.semantic(None, chunks, sessions, query_vector, pool, include_completed, run.nearest(model_id, query_vector, pool)[0])
    return search.hybrid_search(chunks, sessions, query, include_completed=include_completed, pool=pool, fts=fts, vec=vec, **more)
