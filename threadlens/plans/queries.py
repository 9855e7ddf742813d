"""Named queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranges, scalars
from ..functions.models import HashingEmbedder, OverlapReranker, embed_table
from ..operators import enrich, export, listings, projection, search, store, usage
from ..sources.state import shared_dir
from ..streaming import streams
from . import views

QUERY = "Is worthless, pathetic of-the token the password éré?"
TERMS = (("worthless",), ("pathetic",), ("of", "the"), ("token",), ("password",), ("ere",))
VECTOR_ID, POOL, NOW = 7, 50, datetime(2024, 1, 20, tzinfo=timezone.utc)
NOW_S = int(NOW.timestamp())


def long(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("long").alias(name or c)


def seconds(c: str) -> Column:
    return F.unix_timestamp(c).cast("long").alias(c)


def _query_vector(vectors: DataFrame) -> list[float]:
    """One row, chosen by id; its components are the query."""
    row = vectors.where(F.col("chunk_id") == VECTOR_ID).select("embedding").first()
    return [float(x) for x in row[0]] if row else []


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, sessions, _ = views.corpus(spark, sf_dir)
    return search.lexical(chunks, sessions, QUERY, POOL).select("chunk_id", "session_id", F.round("bm25", 6).alias("bm25"), long("fts_rank"))


def bm25_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, sessions, _ = views.corpus(spark, sf_dir)
    top = search.lexical(chunks, sessions, QUERY, POOL)
    return usage.latest_first(top, ["session_id"], F.asc("fts_rank")).select("chunk_id", "session_id", F.round("bm25", 6).alias("bm25"))


def bm25_from_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, _, _ = views.corpus(spark, sf_dir)
    return search.bm25_postings(*search.build_postings(chunks), QUERY).select("chunk_id", F.round("bm25", 6).alias("bm25"))


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, vectors = views.corpus(spark, sf_dir)
    return search.nearest(vectors, _query_vector(vectors), POOL).select("chunk_id", F.round("dist", 6).alias("dist"))


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, sessions, vectors = views.corpus(spark, sf_dir)
    fused = search.fuse(search.lexical(chunks, sessions, QUERY, POOL), search.semantic(vectors, chunks, sessions, _query_vector(vectors), POOL))
    return fused.select("chunk_id", long("fts_rank"), long("vec_rank"), F.round("fused", 9).alias("fused"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, sessions, vectors = views.corpus(spark, sf_dir)
    hits = search.hybrid_search(chunks, sessions, QUERY, vectors, query_vector=_query_vector(vectors), limit=10, max_per_session=2, dedup_before_cut=True)
    return hits.select(long("pos"), "chunk_id", "session_id", F.round("fused", 9).alias("fused"), F.round("bm25", 6).alias("bm25"), F.round("dist", 6).alias("dist"), long("matched"))


def hybrid_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, sessions, vectors = views.corpus(spark, sf_dir)
    hits = search.hybrid_search(chunks, sessions, QUERY, vectors, query_vector=_query_vector(vectors), limit=25, dedup_before_cut=True)
    return search.distinct_sessions(hits).select("pos", "chunk_id", "session_id", search.snippet_display(F.col("snippet")).alias("snippet"))


def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, sessions, _ = views.corpus(spark, sf_dir)
    hits = search.hybrid_search(chunks, sessions, QUERY, limit=5, reranker=OverlapReranker, pool=POOL)
    return hits.select("pos", "chunk_id", "session_id", "score", "matched")


def related_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, sessions, vectors = views.corpus(spark, sf_dir)
    hits = search.hybrid_search(chunks, sessions, QUERY, vectors, query_vector=_query_vector(vectors), limit=14, include_completed=True, dedup_before_cut=True)
    repo = F.concat(F.lit("r"), (F.length("session_id") % 2).cast("string"))
    return search.related(hits.withColumn("repo", repo), "src3", "r1").select("session_id", "same_repo", long("pos"))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, _, _ = views.corpus(spark, sf_dir)
    return embed_table(chunks, "chunk_id", "text", HashingEmbedder).select("chunk_id", F.size("embedding").alias("dim"), "model_id", F.round(search.distance(F.col("embedding"), [0.0] * 64), 4).alias("norm"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.turns_a(views.events(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("session_id", long("seq"), "user_text", "assistant_text", seconds("user_ts"), seconds("assistant_ts"))


def turn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("session_id", long("seq"), long("approx_tokens", "tokens"))


def turns_rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.turns_b(views.events(spark, sf_dir)).select("session_id", long("seq"), "user_text", "assistant_text", seconds("user_ts"), seconds("assistant_ts"))


def _chunks(spark: SparkSession, sf_dir: str, target: int = projection.TARGET_TOKENS) -> DataFrame:
    return projection.chunks(_turns(spark, sf_dir), target)


def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("session_id", long("start_seq"), long("end_seq"), long("approx_tokens", "tokens"), seconds("start_ts"), seconds("end_ts"))


def chunk_bounds_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, 300).select("session_id", long("start_seq"), long("end_seq"), long("approx_tokens", "tokens"), seconds("start_ts"), seconds("end_ts"))


def session_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sessions(spark, sf_dir).select("id", "project_path", "cwd", "git_branch", seconds("started_at"), seconds("ended_at"), long("message_count"))


def last_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sessions(spark, sf_dir).select("id", seconds("last_active_at"), long("turn_count"), "first_user_text", "last_user_text")


def usage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.dedup(views.usage_rows(spark, sf_dir)).select("session_id", "key", "model", "seq", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.rollup(usage.dedup(views.usage_rows(spark, sf_dir)), views.PRICES)


def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir).withColumn("turns", F.col("turns").cast("long"))


def session_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = views.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id")).distinct()
    return usage.session_cost(users, _rollup(spark, sf_dir)).select("id", F.round("cost_usd", 6).alias("cost_usd"))


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.totals(_rollup(spark, sf_dir))


def recent_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end, _ = ranges.parse_range("2024-01-01..2024-01-09", NOW)
    rows = listings.by_project(listings.in_range(views.sessions(spark, sf_dir), F.lit(start), F.lit(end)))
    return rows.select("project", long("sessions"), long("turns"), seconds("first_at"), seconds("last_at"))


def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings.full_list(views.sessions(spark, sf_dir), _chunks(spark, sf_dir))
    return rows.select("id", long("chunk_count"), "duration", "blurb", "icon", "title", "short_cwd")


def session_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.detail(views.sessions(spark, sf_dir), "12").select("first_user_text", "last_user_text", F.array_join("derived_branches", ",").alias("branches"))


def recent_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.recent_open(views.sessions(spark, sf_dir)).select("id", "status", seconds("started_at"))


def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.find_by_prefix(views.sessions(spark, sf_dir), "1").select("id", "cwd")


def browse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.browse_filter(views.sessions(spark, sf_dir), "R3/B", ("id", "cwd", "summary_title", "first_user_text", "git_branch")).select("id", "cwd")


def _recipes(spark: SparkSession) -> DataFrame:
    return enrich.recipes_table(spark, [enrich.parse_recipe(t) for _, t in sorted(enrich.BUILT_IN.items())])


def triage_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.sessions(spark, sf_dir)
    judged = s.where(F.col("id").cast("long") % 6 == 2).select(F.col("id").alias("session_id"), F.lit("merged").alias("recipe_id"))
    return listings.triage_candidates(s, _recipes(spark), judged, NOW, ranges.parse_duration("19d"), with_branches=True).select("id", "recipe_id")


def needs_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.active_without_summary(views.sessions(spark, sf_dir)).select("id", long("turn_count"))


def summarise_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.summarise_candidates(views.sessions(spark, sf_dir), NOW, all_active=True, since=ranges.parse_duration("18d"), stale_only=True).select("id")


def duration_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    end = F.timestamp_seconds(F.unix_timestamp("o_orderdate") + F.pmod(F.col("o_orderkey") * 7919, F.lit(3_000_000)))
    return o.select("o_orderkey", scalars.duration_label(F.col("o_orderdate").cast("timestamp"), end).alias("label"))


def transcript_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.transcripts(_chunks(spark, sf_dir, 300), views.sessions(spark, sf_dir), "tail", 500)


def transcript_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.transcripts(_chunks(spark, sf_dir, 300), views.sessions(spark, sf_dir), "head", 500)


TEMPLATE = "{{ session_id }}|{{cwd|truncate(4)}}|{{ git_branch }}|{{ candidate_branches }}|{{ turn_count }}|{{ first_user_message | truncate(20) }}|{{ other }}"


def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sessions(spark, sf_dir).withColumn("transcript", F.lit("")).select("id", enrich.render(TEMPLATE).alias("prompt"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id").cast("long")
    good = F.concat(F.lit('So: {"status": "s'), (n % 4).cast("string"), F.lit('", "evidence": "it said \\"{done}\\" ok"} and more }'))
    text = F.when(n % 4 == 3, "  no object here ").when(n % 4 == 2, '{"status": "s2"').otherwise(good)
    status, evidence = scalars.verdict(text)
    return views.sessions(spark, sf_dir).select(F.col("id").alias("session_id"), status.alias("status"), evidence.alias("evidence"), F.lit(0).alias("ts"))


def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).drop("ts")


def status_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.apply_verdicts(views.sessions(spark, sf_dir), _answers(spark, sf_dir), {"s0": "completed"}, F.lit(NOW)).select("id", "status", "status_source")


def manual_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.set_status(views.sessions(spark, sf_dir), "1", "completed", F.lit(NOW)).select("id", "status", "status_source")


def session_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = views.sessions(spark, sf_dir), F.col("id").cast("long")
    new = s.where(n % 3 != 0).select(F.concat(F.when(n % 7 == 1, "n").otherwise(""), "id").alias("id"), F.when(n % 2 == 0, "/new").alias("cwd"), F.lit("again").alias("first_user_text"), F.lit("last").alias("last_user_text"), (F.col("turn_count") + 1).alias("turn_count"), F.lit("").alias("provider"))
    return store.merge_sessions(s, new).select("id", "cwd", "first_user_text", "last_user_text", long("turn_count"), "status", "provider")


def incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.transcripts import changed

    files = views.events(spark, sf_dir).groupBy("path").agg(F.sum(F.length("text")).alias("size"), F.max(F.unix_timestamp("ts")).alias("mtime_unix"))
    cursors = files.withColumn("size", F.col("size") + F.when(F.col("size") % 3 == 0, 1).otherwise(0)).where("mtime_unix % 4 <> 1")
    return changed(files, cursors).select("path", "size")


def export_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.prose(_chunks(spark, sf_dir, 300))


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document, its session as text and the number of its chunks."""
    got = export.json_document(views.sessions(spark, sf_dir), _chunks(spark, sf_dir))
    return got.select("session_id", F.get_json_object("document", "$.session").alias("session"), long(F.json_array_length(F.get_json_object("document", "$.chunks")), "chunks"))


#: Ways of naming a branch NEW, and commands that name none.
BRANCH_COMMANDS = (
    "git worktree add ../p NEW", "git worktree add --force NEW", "cd x; git  worktree add -b NEW ../p", "git checkout -b NEW && git push -u origin KIND", "(git switch -c NEW)", "git switch NEW; git checkout main",
    "git checkout NEW | git checkout \"q\"", "git push --set-upstream origin NEW", "gh pr checkout NEW", "git checkout deadbeef; git checkout a/b.txt; git checkout origin/x; legit checkout y",
)


def branch_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, new = F.col("event_id"), F.concat(F.lit("n"), F.col("event_id").cast("string"))
    command = F.element_at(F.lit(list(BRANCH_COMMANDS)), (n % len(BRANCH_COMMANDS) + 1).cast("int"))
    command = F.replace(F.replace(command, F.lit("NEW"), new), F.lit("KIND"), F.col("event_type"))
    return views.table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_distinct(projection.branches_in(command)), ",").alias("branches"))


def remote_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    url = F.concat(F.when(n % 3 == 0, "git@Host.org:").when(n % 3 == 1, "https://host.org/").otherwise("ssh://git@host.org/"), "c_mktsegment", F.when(n % 2 == 0, ".git").otherwise("/"))
    return views.table(spark, sf_dir, "customer").select("c_custkey", scalars.normal_remote(url).alias("remote"))


def session_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = views.sessions(spark, sf_dir), _chunks(spark, sf_dir, 300)
    tables = {"sessions": s, "chunks": c, "chunk_vectors": c.select(F.col("id").alias("chunk_id")), "lengths": c.select(F.col("id").alias("chunk_id")), "session_usage": s.select(F.col("id").alias("session_id"))}
    left = store.delete_sessions(tables, s.where(F.col("id").cast("long") % 6 == 1).select(F.col("id").alias("session_id")))
    counts = [t.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n")) for name, t in sorted(left.items())]
    return reduce(DataFrame.union, counts)


def usage_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _rollup(spark, sf_dir)
    new = old.where(F.col("session_id").cast("long") % 3 == 0).groupBy("session_id").agg(F.lit("again").alias("model"), F.round(2 * F.sum("cost_usd"), 4).alias("cost_usd"))
    spent, sessions = store.replace_usage(old, old.select(F.col("session_id").alias("id")).distinct(), new)
    rows = spent.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("models"))
    return sessions.join(rows, "id").select("id", "models", F.round("cost_usd", 6).alias("cost_usd"))


def cursor_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.events(spark, sf_dir).groupBy("path").agg(F.sum(F.length("text")).alias("size"), F.max("seq").cast("long").alias("last_seq"))
    new = files.where("size % 2 = 0").select(F.concat(F.when(F.col("size") % 3 == 0, "/new").otherwise(""), "path").alias("path"), (F.col("size") + 1).alias("size"), F.lit(-1).cast("long").alias("last_seq"))
    return store.latest_wins(files, new, ["path"])


def summary_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = views.sessions(spark, sf_dir), F.col("id").cast("long")
    new = F.struct(F.concat(F.lit("T"), "id").alias("title"), F.lit("S").alias("short"), F.lit("L").alias("long"))
    rows = store.set_summaries(s, s.where(n % 2 == 0).select(F.col("id").alias("session_id"), F.when(n % 4 != 0, new).alias("summary")), "m", F.lit(NOW))
    return rows.select("id", "summary_title", "summary_short", "summary_long", "summary_model", long("summary_turn_count"))


def slash_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a slash are commands; one without, or with other characters, leaves the text as it is."""
    c, k = views.table(spark, sf_dir, "conversations"), F.col("turn") % 5
    name = F.when(k == 0, "/do").when(k == 1, "do").when(k == 2, "/a.b").when(k == 3, " /x:y-z_1\n").otherwise("/é")
    tag = F.concat(F.lit("<command-message>m</command-message>\n<command-name>"), name, F.lit("</command-name>\n<command-args>a\nb</command-args> "))
    text = F.when(F.col("turn") % 3 == 0, tag).when(F.col("turn") % 3 == 1, F.concat(tag, "text", F.lit(" \u00a0"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", scalars.slash_command(text).alias("prompt"))


def summary_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    text = F.concat(F.lit('x {"title": " t'), n.cast("string"), F.lit('", "short": "'), F.when(n % 3 == 0, " ").otherwise("s"), F.lit('", "long": "l {} "'), F.when(n % 4 == 0, "").otherwise("}"))
    got = views.table(spark, sf_dir, "customer").select("c_custkey", scalars.summary(text).alias("s"))
    return got.select("c_custkey", "s.title", "s.short", "s.long")


def session_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    cwd = F.when(n % 7 != 0, F.concat(F.lit("/w/"), F.repeat(F.lit("it's.a_b/"), (n % 6).cast("int")), "c_name"))
    sid = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(n.cast("string"), (11 + n % 2).cast("int"), F.lit("0")))
    return views.table(spark, sf_dir, "customer").select("c_custkey", scalars.project_dir(cwd).alias("folder"), scalars.short_cwd(cwd).alias("short"), scalars.is_session_id(sid).alias("is_id"), scalars.resume_command(cwd, sid, "go").alias("resume"))


def hit_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.sessions(spark, sf_dir).withColumnRenamed("id", "session_id")
    hits = s.where("turn_count % 2 = 0 or session_id like '%7'").select("session_id", "turn_count")
    return search.enrich(hits, s, _chunks(spark, sf_dir, 300)).select("session_id", long("turn_count"), long("chunk_count"), "duration")


def related_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sessions(spark, sf_dir).select("id", search.related_query(*map(F.col, ("summary_title", "summary_short", "first_user_text", "last_user_text"))).alias("query"))


def snippet_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", search.snippet_display(F.col("text")).alias("shown"))


def show_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, chunks = listings.show(views.sessions(spark, sf_dir), _chunks(spark, sf_dir, 300), "1")
    return chunks.join(s.select(F.col("id").alias("session_id"), "status"), "session_id").select("session_id", "status", long("start_seq"), long("end_seq"))


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("session_id").cast("long")
    e = views.events(spark, sf_dir).withColumns({"entrypoint": F.when((n % 9 == 0) & (F.col("seq") > 1), "SDK-run").when(n % 9 == 1, "cli"), "prompt_source": F.when(n % 11 == 0, "Sdk"), "subagent": F.lit(False)})
    return projection.excluded(e, projection.turns_a(e), openers=("W", "D"), commands=("the ", "in "), loop=("a", "b"))


def _stream(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Run a stream over the events table to its end; results are written to the shared folder and read back."""
    run, path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", f"{sf_dir}/events.parquet"
    like = spark.read.parquet(path)
    # A stream reads a folder; a table that is one file is picked out of its own.
    single = like.inputFiles()[0].endswith("/events.parquet")
    source = spark.readStream.schema(like.schema).option("pathGlobFilter", "events.parquet" if single else "*.parquet").parquet(sf_dir if single else path)
    out = make(source.withColumn("ts", F.col("ts").cast("timestamp")))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(f"{run}/out")

    query = out.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{run}/out")


def stream_events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir, streams.tumbling, "complete")
    return rows.select(seconds("start"), "event_type", "n", F.round("value", 4).alias("value"))


def stream_events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, streams.sliding, "complete").select(seconds("start"), "event_type", "n")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The watermark covers the whole table, so that a pair counts once however far apart its events are.
    return _batch_counts(_stream(spark, sf_dir, lambda events: streams.deduplicated(events, ["user_id", "event_type"], "36500 days"), "append"))


def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, lambda events: streams.session_windows(events, "6 hours"), "complete").select(seconds("start"), seconds("end"), "user_id", "n")


def _batch_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("users"))


_TOKENS = "regexp_extract_all(translate(lower(coalesce(text, '')), 'äçèéêíñóöüáàâãåëìîïòôõùúûýÿ', 'aceeeinoouaaaaaeiiiooouuuyy'), '[\\p{L}\\p{N}]+')"
_COUNTS = ", ".join(
    (f"len(list_filter(t, lambda x: x = '{p[0]}'))" if len(p) == 1 else f"len(list_filter(range(1, len(t)), lambda i: t[i] = '{p[0]}' and t[i + 1] = '{p[1]}'))") + f" as f{i}" for i, p in enumerate(TERMS)
)
_IDF = "case when ln((docs - n{i} + 0.5) / (n{i} + 0.5)) <= 0 then 1e-6::double else ln((docs - n{i} + 0.5) / (n{i} + 0.5)) end"
_SCORE = " + ".join(f"({_IDF.format(i=i)}) * f{i} * 2.2::double / (f{i} + 1.2::double * (0.25::double + 0.75::double * len / average))" for i in range(len(TERMS)))
BM25 = f"""{views.CORPUS},
b_tokens as (select chunk_id, session_id, {_TOKENS} as t from c_chunks),
b_counts as (select chunk_id, session_id, len(t) as len, {_COUNTS} from b_tokens),
b_stats as (select count(*)::double as docs, avg(len) as average, {", ".join(f"count(*) filter (f{i} > 0) as n{i}" for i in range(len(TERMS)))} from b_counts),
b_scores as (select chunk_id, session_id, round(-({_SCORE}), 9) as bm25 from b_counts, b_stats where {" or ".join(f"f{i} > 0" for i in range(len(TERMS)))}),
b_top as (select chunk_id, session_id, bm25 from b_scores join c_sessions using (session_id) where status <> 'completed' order by bm25, chunk_id limit {POOL}),
b_ranked as (select *, row_number() over (order by bm25, chunk_id) - 1 as fts_rank from b_top)"""
KNN = f"""k_near as (select v.chunk_id, round(list_distance(v.embedding::double[], q.embedding::double[]), 9) as dist from c_vectors v, (select embedding from c_vectors where chunk_id = {VECTOR_ID}) q order by dist, chunk_id limit {POOL}),
k_ranked as (select chunk_id, dist, row_number() over (order by dist, chunk_id) - 1 as vec_rank from k_near join c_chunks using (chunk_id) join c_sessions using (session_id) where status <> 'completed')"""
FUSED = """f_all as (select coalesce(b.chunk_id, k.chunk_id) as chunk_id, bm25, fts_rank, dist, vec_rank, round(coalesce(1.0::double / (61 + fts_rank), 0) + coalesce(1.0::double / (61 + vec_rank), 0), 12) as fused
  from b_ranked b full join k_ranked k on b.chunk_id = k.chunk_id)"""
_LABEL = """case when s is null or s < 60 then '' when s < 3600 then (s // 60) || 'm' when s < 86400 then (s // 3600) || 'h' when s < 1209600 then (s // 86400) || 'd' else (s // 604800) || 'w' end"""
_SESSIONS_CHUNKS = views.SESSIONS + ",\n" + views.chunk_fold(projection.TARGET_TOKENS)
_SMALL_CHUNKS = views.SESSIONS + ",\n" + views.chunk_fold(300)


def _transcript(order: str) -> str:
    return f"""with recursive {_SMALL_CHUNKS}, budget as (select *, sum(tokens) over (partition by session_id order by start_seq {order} rows unbounded preceding) as total from v_chunks),
whole as (select session_id, string_agg(text, chr(10) || chr(10) order by start_seq) as transcript from budget where total <= 500 group by session_id)
select id as session_id, coalesce(transcript, '(no transcript)') as transcript from v_sessions left join whole on id = session_id"""


def _bounds(target: int) -> str:
    return f"with recursive {views.TURNS}, {views.chunk_fold(target)} select session_id, start_seq, end_seq, tokens, start_ts, end_ts from v_chunks"


_RANGE = (int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp()), int(datetime(2024, 1, 10, tzinfo=timezone.utc).timestamp()))
_ANSWER = """a_text as (select *, case when n % 4 in (0, 1) then 's' || (n % 4) end as verdict, case n % 4 when 3 then 'no object here' when 2 then '{"status": "s2"' else 'it said "{done}" ok' end as evidence from v_sessions)"""

SQL = {
    "bm25_topk": f"with {BM25} select chunk_id, session_id, round(bm25, 6) as bm25, fts_rank from b_ranked",
    "bm25_dedup": f"with {BM25} select chunk_id, session_id, round(bm25, 6) as bm25 from b_ranked qualify row_number() over (partition by session_id order by fts_rank) = 1",
    "bm25_from_postings": f"with {BM25} select chunk_id, round(bm25, 6) as bm25 from b_scores",
    "knn_topk": f"with {views.CORPUS}, {KNN} select chunk_id, round(dist, 6) as dist from k_near",
    "rrf_hybrid": f"with {BM25}, {KNN}, {FUSED} select chunk_id, fts_rank, vec_rank, round(fused, 9) as fused from f_all",
    "hybrid_search": f"""with {BM25}, {KNN}, {FUSED}, pool as (select * from f_all order by fused desc, fts_rank nulls last, vec_rank nulls last limit {POOL}),
hits as (select p.*, session_id, count(*) over (partition by session_id) as matched, row_number() over (partition by session_id order by fused desc, fts_rank nulls last, vec_rank nulls last) as k from pool p join c_chunks using (chunk_id)),
placed as (select *, row_number() over (order by fused desc, fts_rank nulls last, vec_rank nulls last) as pos from hits where k <= 2)
select pos, chunk_id, session_id, round(fused, 9) as fused, round(coalesce(bm25, 0), 6) as bm25, round(coalesce(dist, 0), 6) as dist, matched from placed where pos <= 10""",
    "turns": f"with {views.TURNS} select session_id, seq, user_text, assistant_text, user_ts, assistant_ts from v_turns",
    "turn_tokens": f"with {views.TURNS} select session_id, seq, tokens from v_turns",
    "turns_rollout": f"""with {views.EVENTS}, rows as (select *, lag(type) over w as before, lead(type) over w as after, last_value(case when type = 'user' then seq end ignore nulls) over (partition by session_id order by seq rows unbounded preceding) as asked
  from v_events where type in ('user', 'assistant') window w as (partition by session_id order by seq)),
kept as (select r.*, (r.type = 'user' or before = 'user') as carries, p.text as prompt, p.ts as prompt_ts from rows r left join v_events p on p.session_id = r.session_id and p.seq = r.asked where r.type = 'assistant' or coalesce(after, '') <> 'assistant')
select session_id, row_number() over (partition by session_id order by seq) - 1 as seq, case when carries then prompt else '' end as user_text, case when type = 'assistant' then text else '' end as assistant_text,
  case when carries then prompt_ts end as user_ts, case when type = 'assistant' then ts end as assistant_ts from kept""",
    "chunk_bounds": _bounds(projection.TARGET_TOKENS),
    "chunk_bounds_small": _bounds(300),
    "session_meta": f"with {views.SESSIONS} select id, project_path, cwd, git_branch, started_at, ended_at, message_count from v_sessions",
    "last_active": f"with {views.SESSIONS} select id, last_active_at, turn_count, first_user_text, last_user_text from v_sessions",
    "usage_dedup": f"with {views.USAGE} select * from u_messages",
    "usage_rollup": f"with {views.USAGE} select * from u_rollup",
    "session_cost": f"with {views.USAGE}, ids as (select distinct cast(user_id as varchar) as id from events) select id, round(coalesce(sum(cost_usd), 0), 6) as cost_usd from ids left join u_rollup on session_id = id group by id",
    "usage_totals": f"with {views.USAGE} select count(*) as rows, round(sum(cost_usd), 2) as cost_usd from u_rollup",
    "recent_by_project": f"""with {views.SESSIONS}, hit as (select * from v_sessions where last_active_at >= {_RANGE[0]} and last_active_at < {_RANGE[1]} order by last_active_at, id limit 80)
select substr(cwd, 4) as project, count(*) as sessions, sum(turn_count)::bigint as turns, min(started_at) as first_at, max(last_active_at) as last_at from hit group by cwd""",
    "session_list": f"""with recursive {_SESSIONS_CHUNKS}, counts as (select session_id, count(*) as c from v_chunks group by session_id),
rows as (select *, last_active_at - started_at as s, coalesce(c, 0) as chunk_count from v_sessions left join counts on session_id = id), labelled as (select *, {_LABEL} as duration from rows)
select id, chunk_count, duration, turn_count || 't' || case when duration <> '' then ' · ' || duration else '' end || case when cost_usd >= 10 then ' · $' || cast(round(cost_usd) as bigint) when cost_usd > 0.005 then ' · $' || printf('%.2f', cost_usd) else '' end as blurb,
  case status when 'completed' then '✓' when 'archived' then '·' else ' ' end as icon,
  coalesce(summary_title, summary_short, case when length(first_user_text) > 90 then replace(substr(first_user_text, 1, 90), chr(10), ' ') || '…' else replace(first_user_text, chr(10), ' ') end, '(no prompt)') as title, cwd as short_cwd from labelled""",
    "session_detail": f"with {views.SESSIONS} select first_user_text, last_user_text, array_to_string(derived_branches, ',') as branches from v_sessions where id = '12'",
    "recent_open": f"with {views.SESSIONS} select id, status, started_at from v_sessions where status <> 'completed' order by started_at desc, id limit 25",
    "prefix_lookup": f"with {views.SESSIONS} select id, cwd from v_sessions where id like '1%' order by id limit 2",
    "browse_filter": f"with {views.SESSIONS} select id, cwd from v_sessions where concat_ws(chr(1), id, cwd, summary_title, first_user_text, git_branch) ilike '%r3/b%'",
    "triage_candidates": f"""with {views.SESSIONS}, recipes as (select unnest(['merged', 'resolved']) as recipe_id)
select id, recipe_id from v_sessions, recipes where status = 'active' and started_at >= {NOW_S - 19 * 86400} and derived_branches is not null and not (n % 6 = 2 and recipe_id = 'merged')""",
    "needs_summary": f"with {views.SESSIONS} select id, turn_count from v_sessions where status = 'active' and (summary_short is null or summary_turn_count is distinct from turn_count)",
    "summarise_candidates": f"with {views.SESSIONS} select id from v_sessions where status = 'active' and started_at >= {NOW_S - 18 * 86400} and last_active_at < {NOW_S - 1800}",
    "duration_label": f"with d as (select o_orderkey, (o_orderkey * 7919) % 3000000 as s from orders) select o_orderkey, {_LABEL} as label from d",
    "transcript_tail": _transcript("desc"),
    "transcript_head": _transcript("asc"),
    "prompt_render": f"""with {views.SESSIONS}, b as (select *, list_filter(list_distinct(list_concat(case when git_branch is null then [] else [git_branch] end, coalesce(derived_branches, []))), lambda x: x <> 'main') as found from v_sessions)
select id, id || '|' || substr(cwd, 1, 4) || '…|' || coalesce(git_branch, '') || '|' || case when git_branch is not null and derived_branches is not null then git_branch || ', ' || derived_branches[2] else coalesce(git_branch, derived_branches[2], '') end
  || '|' || turn_count || '|' || case when length(first_user_text) > 20 then substr(first_user_text, 1, 20) || '…' else coalesce(first_user_text, '') end || '|{{{{other}}}}' as prompt from b""",
    "verdict_parse": f"with {views.SESSIONS}, {_ANSWER} select id as session_id, verdict as status, evidence from a_text",
    "status_apply": f"with {views.SESSIONS}, {_ANSWER} select id, case when verdict = 's0' and status_source <> 'manual' then 'completed' else status end as status, status_source from a_text",
    "manual_status": f"with {views.SESSIONS} select id, case when id like '1%' then 'completed' else status end as status, case when id like '1%' then 'manual' else status_source end as status_source from v_sessions",
    "session_merge": f"""with {views.SESSIONS}, fresh as (select case when n % 7 = 1 then 'n' else '' end || id as id, case when n % 2 = 0 then '/new' end as cwd, turn_count + 1 as turn_count from v_sessions where n % 3 <> 0)
select coalesce(f.id, s.id) as id, coalesce(f.cwd, s.cwd) as cwd, coalesce(s.first_user_text, case when f.id is not null then 'again' end) as first_user_text, case when f.id is not null then 'last' else s.last_user_text end as last_user_text,
  case when f.id is not null then f.turn_count else s.turn_count end as turn_count, coalesce(s.status, 'active') as status, 'claude-code' as provider from v_sessions s full join fresh f on s.id = f.id""",
    "incremental_skip": """with files as (select '/p/' || (conv_id % 4) || '/' || conv_id || '.jsonl' as path, sum(length(text))::bigint as size, max(1704067200 + 60 * (97 * conv_id + 7 * turn)) as mtime from conversations group by conv_id)
select path, size from files where size % 3 = 0 or mtime % 4 = 1""",
    "export_prose": f"""with recursive {_SMALL_CHUNKS} select session_id, string_agg('--- chunk seq ' || start_seq || '..' || end_seq || ' ---' || chr(10) || text || chr(10) || chr(10), '' order by start_seq) as document from v_chunks group by session_id""",
    "export_json": f"""with recursive {_SESSIONS_CHUNKS}, stamped as (select *, strftime(make_timestamp(started_at * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') as a, strftime(make_timestamp(ended_at * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') as b from v_sessions)
select id as session_id, {{'id': id, 'project_path': project_path, 'cwd': cwd, 'git_branch': git_branch, 'started_at': a, 'ended_at': b, 'message_count': message_count, 'turn_count': turn_count, 'status': status,
  'first_user_text': first_user_text, 'last_user_text': last_user_text}}::json::varchar as session, coalesce((select count(*) from v_chunks c where c.session_id = s.id), 0) as chunks from stamped s""",
    "branch_names": "select event_id, case event_id % 10 when 9 then '' when 3 then 'n' || event_id || ',' || event_type else 'n' || event_id end as branches from events",
    "remote_names": "select c_custkey, 'host.org/' || lower(c_mktsegment) as remote from customer",
    "stream_events_tumbling": "select cast(floor(epoch(ts) / 86400) * 86400 as bigint) as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2",
    "stream_events_sliding": "with w as (select cast(floor(epoch(ts) / 86400) * 86400 as bigint) as day, event_type from events), b as (select day as start, event_type from w union all select day - 86400, event_type from w) select start, event_type, count(*) as n from b group by 1, 2",
    "stream_bursts": """with a as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from events),
b as (select *, sum(case when before is null or ts - before > interval 6 hours then 1 else 0 end) over (partition by user_id order by ts) as burst from a)
select cast(floor(epoch(min(ts))) as bigint) as start, cast(floor(epoch(max(ts))) as bigint) + 21600 as "end", user_id, count(*) as n from b group by user_id, burst""",
    "session_delete": f"""with recursive {_SMALL_CHUNKS}, left_over as (select count(*) as c from v_chunks where session_id::bigint % 6 <> 1)
select 'chunk_vectors' as "table", c as n from left_over union all select 'chunks', c from left_over union all select 'lengths', c from left_over union all select 'session_usage', count(*) from v_sessions union all select 'sessions', count(*) from v_sessions where n % 6 <> 1""",
    "usage_replace": f"""with {views.USAGE}, per as (select session_id as id, count(*) as models, sum(cost_usd) as cost_usd from u_rollup group by session_id)
select id, case when id::bigint % 3 = 0 then 1 else models end as models, round(case when id::bigint % 3 = 0 then round(2 * cost_usd, 4) else cost_usd end, 6) as cost_usd from per""",
    "cursor_upsert": f"""with {views.EVENTS}, files as (select '/p/' || (conv_id % 4) || '/' || conv_id || '.jsonl' as path, sum(length(text))::bigint as size, max(seq)::bigint as last_seq from v_events group by conv_id)
select path, size, last_seq from files where size % 2 <> 0 or size % 3 = 0 union all select case when size % 3 = 0 then '/new' else '' end || path, size + 1, -1 from files where size % 2 = 0""",
    "summary_update": f"""with {views.SESSIONS}, s as (select *, n % 4 = 2 as fresh from v_sessions)
select id, case when fresh then 'T' || id else summary_title end as summary_title, case when fresh then 'S' else summary_short end as summary_short, case when fresh then 'L' end as summary_long,
  case when fresh then 'm' end as summary_model, case when fresh then turn_count else summary_turn_count end as summary_turn_count from s""",
    "slash_commands": """with c as (select *, case turn % 5 when 0 then '/do' when 1 then 'do' when 2 then '/a.b' when 3 then ' /x:y-z_1' || chr(10) else '/é' end as name from conversations),
t as (select *, '<command-message>m</command-message>' || chr(10) || '<command-name>' || name || '</command-name>' || chr(10) || '<command-args>a' || chr(10) || 'b</command-args> ' as tag, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) as rest from c)
select conv_id, turn, case when turn % 3 = 2 then text when turn % 5 in (1, 2) then tag || case when turn % 3 = 1 then text || ' ' || chr(160) else '' end
  else trim(name, ' ' || chr(10)) || case when turn % 3 = 1 and rest <> '' then ' ' || rest else '' end end as prompt from t""",
    "summary_parse": """select c_custkey, case when ok then 't' || c_custkey end as title, case when ok then 's' end as short, case when ok then 'l {}' end as long from (select *, c_custkey % 3 <> 0 and c_custkey % 4 <> 0 as ok from customer)""",
    "session_labels": """with c as (select c_custkey, case when c_custkey % 7 <> 0 then '/w/' || repeat('it' || chr(39) || 's.a_b/', c_custkey % 6) || c_name end as cwd, '00000000-0000-0000-0000-' || lpad(cast(c_custkey as varchar), cast(11 + c_custkey % 2 as int), '0') as sid from customer)
select c_custkey, regexp_replace(cwd, '[^A-Za-z0-9]', '-', 'g') as folder, case when cwd is null then '' when length(cwd) > 36 then '…' || right(cwd, 35) else cwd end as short, c_custkey % 2 = 1 as is_id,
  case when cwd is null then '' else 'cd ' || chr(39) || replace(cwd, chr(39), chr(39) || chr(92) || chr(39) || chr(39)) || chr(39) || ' && ' end || 'go ' || chr(39) || sid || chr(39) as resume from c""",
    "hit_details": f"""with recursive {_SESSIONS_CHUNKS.replace(views.chunk_fold(projection.TARGET_TOKENS), views.chunk_fold(300))}, counts as (select session_id, count(*) as c from v_chunks group by session_id),
rows as (select *, last_active_at - started_at as s from v_sessions left join counts on session_id = id where turn_count % 2 = 0 or id like '%7')
select id as session_id, turn_count, coalesce(c, 0) as chunk_count, {_LABEL} as duration from rows""",
    "related_text": f"""with {views.SESSIONS}, t as (select id, nullif(trim(summary_title), '') as title, summary_short as short, case when trim(first_user_text) <> '' then first_user_text end as first, case when trim(last_user_text) <> '' then last_user_text end as last from v_sessions)
select id, concat_ws('. ', title, short, case when title is null and short is null then first end, last) as query from t""",
    "snippet_texts": """with t as (select doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) as flat from documents) select doc_id, case when length(flat) > 200 then substr(flat, 1, 200) || '…' else flat end as shown from t""",
    "show_session": f"with recursive {_SMALL_CHUNKS} select session_id, status, start_seq, end_seq from v_chunks join v_sessions on id = session_id where id like '1%'",
    "exclusions": f"""with {views.TURNS}, t as (select session_id, seq, user_text, lower(user_text) as low, lower(ltrim(user_text)) as head from v_turns),
seen as (select session_id, bool_or(seq = 0 and (user_text like 'W%' or user_text like 'D%')) as internal, bool_or(seq < 6 and (head like 'the %' or head like 'in %')) as commanded, bool_or(seq < 6 and head like 'a%') as looped, bool_or(seq < 6 and low like '%b%') as referred from t group by session_id),
l as (select session_id, case when conv_id % 9 = 0 and seq > 1 then 'sdk-run' when conv_id % 9 = 1 then 'cli' end as e, case when conv_id % 11 = 0 then 'sdk' end as p, seq from v_events where type = 'user'),
launch as (select session_id, arg_min({{'e': e, 'p': p}}, seq) as l from l where e is not null or p is not null group by session_id)
select session_id, internal, coalesce(l.e like 'sdk%' or l.p = 'sdk', l.e like 'sdk%', l.p = 'sdk', false) or commanded or (looped and referred) as automated from seen left join launch using (session_id)""",
    "related_rank": f"""with {BM25.replace("where status <> 'completed' ", "")}, {KNN.replace(" where status <> 'completed'", "")}, {FUSED}, pool as (select * from f_all order by fused desc, fts_rank nulls last, vec_rank nulls last limit {POOL}),
hits as (select p.*, session_id, row_number() over (partition by session_id order by fused desc, fts_rank nulls last, vec_rank nulls last) as k from pool p join c_chunks using (chunk_id) where session_id is not null),
placed as (select *, row_number() over (order by fused desc, fts_rank nulls last, vec_rank nulls last) as pos from hits where k = 1)
select session_id, length(session_id) % 2 = 1 as same_repo, pos from placed where pos <= 14 and session_id <> 'src3' order by same_repo desc, pos limit 8""",
    "rerank_overlap": f"""with {BM25}, words as (select r.*, text, list_slice(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), 1, 500) as w from b_ranked r join c_chunks using (chunk_id)),
scored as (select *, len(list_intersect(list_distinct(w), ['is', 'worthless', 'pathetic', 'of', 'the', 'token', 'password', 'éré'])) / 8.0::double as score, count(*) over (partition by session_id) as matched from words),
firsts as (select *, row_number() over (partition by session_id order by score desc, fts_rank) as k from scored), placed as (select *, row_number() over (order by score desc, fts_rank) as pos from firsts where k = 1)
select pos, chunk_id, session_id, score, matched from placed where pos <= 5""",
    "stream_dedup": "select event_type, count(distinct user_id) as users from events group by event_type",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        hybrid_search, bm25_topk, bm25_dedup, bm25_from_postings, knn_topk, rrf_hybrid, hybrid_snippets, rerank_overlap, related_rank, embedded, turns, turn_tokens, turns_rollout, chunk_bounds,
        chunk_bounds_small, session_meta, last_active, usage_dedup, usage_rollup, session_cost, usage_totals, recent_by_project, session_list, session_detail, recent_open, prefix_lookup, browse_filter,
        triage_candidates, needs_summary, summarise_candidates, duration_label, transcript_tail, transcript_head, prompt_render, verdict_parse, status_apply, manual_status, session_merge, incremental_skip,
        export_prose, export_json, branch_names, remote_names, stream_events_tumbling, stream_events_sliding, stream_dedup, stream_bursts, session_delete, usage_replace, cursor_upsert, summary_update,
        slash_commands, summary_parse, session_labels, hit_details, related_text, snippet_texts, show_session, exclusions,
    )
    return {f.__name__: f for f in every}
