"""The engine's inputs over the driver's tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200  # 2024-01-01 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcript events of format A."""
    c = table(spark, sf_dir, "conversations")
    cwd = F.concat(F.lit("/w/r"), (F.col("conv_id") % 7).cast("string"), F.lit("/b"), (F.col("conv_id") % 3).cast("string"))
    return c.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), F.col("role").alias("type"),
        F.timestamp_seconds(EPOCH + 60 * (97 * F.col("conv_id") + 7 * F.col("turn"))).alias("ts"),
        F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("blocks"), "text",
        F.concat(F.lit("/p/"), (F.col("conv_id") % 4).cast("string"), F.lit("/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"),
        F.lit("claude-code").alias("provider"), F.lit("legacy").alias("account"), cwd.alias("cwd"),
        F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("b"), (F.col("conv_id") % 3).cast("string"))).alias("git_branch"))


EVENTS = """v_events as (select cast(conv_id as varchar) as session_id, turn as seq, role as type, text, 1704067200 + 60 * (97 * conv_id + 7 * turn) as ts,
  '/w/r' || (conv_id % 7) || '/b' || (conv_id % 3) as cwd, case when conv_id % 2 = 0 then 'b' || (conv_id % 3) end as git_branch, conv_id from conversations)"""

TURNS = EVENTS + """,
v_anchored as (select *, max(case when type = 'user' then seq end) over (partition by session_id order by seq rows unbounded preceding) as anchor
  from v_events where type in ('user', 'assistant')),
v_folded as (select session_id, anchor, max(case when type = 'user' then text end) as user_text,
  coalesce(string_agg(case when type = 'assistant' then text end, chr(10) || chr(10) order by seq), '') as assistant_text,
  max(case when type = 'user' then ts end) as user_ts, min(case when type = 'assistant' then ts end) as assistant_ts
  from v_anchored where anchor is not null group by session_id, anchor),
v_rendered as (select *, row_number() over (partition by session_id order by anchor) - 1 as seq,
  'USER: ' || user_text || case when assistant_text <> '' then chr(10) || chr(10) || 'ASSISTANT: ' || assistant_text else '' end as body from v_folded),
v_turns as (select session_id, seq, user_text, assistant_text, user_ts, assistant_ts, body, (length(body) + 3) // 4 as tokens from v_rendered)"""


def chunk_fold(target: int) -> str:
    """SQL: the windows of v_turns by a recursive fold."""
    return f"""v_fold as (
  select session_id, 0::bigint as k, 0::bigint as start, tokens as total, tokens as prev, null::bigint as first, null::bigint as last from v_turns where seq = 0
  union all
  select t.session_id, t.seq, case when f.total + t.tokens <= {target} then f.start when t.seq - f.start > 1 and f.prev + t.tokens <= {target} then t.seq - 1 else t.seq end,
    case when f.total + t.tokens <= {target} then f.total + t.tokens when t.seq - f.start > 1 and f.prev + t.tokens <= {target} then f.prev + t.tokens else t.tokens end, t.tokens,
    case when f.total + t.tokens > {target} then f.start end, case when f.total + t.tokens > {target} then t.seq - 1 end
  from v_fold f join v_turns t on t.session_id = f.session_id and t.seq = f.k + 1),
v_windows as (select session_id, first, last from v_fold where first is not null
  union all select session_id, start, k from v_fold f where k = (select max(seq) from v_turns t where t.session_id = f.session_id)),
v_chunks as (select w.session_id, w.first as start_seq, w.last as end_seq, string_agg(t.body, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by t.seq) as text, sum(t.tokens)::bigint as tokens,
  min(t.user_ts) as start_ts, max(coalesce(t.assistant_ts, t.user_ts)) as end_ts
  from v_windows w join v_turns t on t.session_id = w.session_id and t.seq between w.first and w.last group by w.session_id, w.first, w.last)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the conversations: metadata, last activity, and status, cost, summary and branches by rule."""
    from ..operators import projection

    e = events(spark, sf_dir)
    meta, active = projection.session_meta(e), projection.last_active(projection.turns_a(e))
    n = F.col("session_id").cast("long")
    return meta.join(active, "session_id", "left").select(
        F.col("session_id").alias("id"), "project_path", "cwd", "git_branch", F.when(n % 4 == 0, F.array(F.lit("main"), F.concat(F.lit("f"), (n % 5).cast("string")))).alias("derived_branches"),
        "started_at", "ended_at", F.coalesce("last_turn_at", "ended_at").alias("last_active_at"), "message_count", F.coalesce("turn_count", F.lit(0)).alias("turn_count"), "first_user_text", "last_user_text",
        F.when(n % 5 == 0, "completed").when(n % 5 == 1, "archived").otherwise("active").alias("status"), F.when(n % 3 == 0, "manual").otherwise("auto").alias("status_source"), F.lit(None).cast("timestamp").alias("status_set_at"),
        "provider", (n % 40 * 0.5).cast("double").alias("cost_usd"), "source_path", "account",
        F.when(n % 3 == 1, F.concat(F.lit("t"), F.col("session_id"))).alias("summary_title"), F.when(n % 3 == 1, F.lit("short one")).alias("summary_short"), F.lit(None).cast("string").alias("summary_long"), F.lit(None).cast("string").alias("summary_model"),
        F.lit(None).cast("timestamp").alias("summary_at"), F.when(n % 3 == 1, (n % 4).cast("int")).alias("summary_turn_count"))


SESSIONS = TURNS + """,
v_meta as (select session_id as id, conv_id as n, arg_min(cwd, seq) as cwd, arg_min(git_branch, seq) as git_branch, arg_min(ts, seq) as started_at, arg_max(ts, seq) as ended_at,
  count(*) filter (type in ('user', 'assistant')) as message_count from v_events group by session_id, conv_id),
v_active as (select session_id as id, count(*) as turn_count, substr(arg_min(user_text, seq), 1, 500) as first_user_text, substr(arg_max(user_text, seq), 1, 500) as last_user_text,
  coalesce(arg_max(assistant_ts, seq) filter (assistant_text <> '' and assistant_ts is not null), arg_max(user_ts, seq)) as last_turn_at from v_turns group by session_id),
v_sessions as (select m.id, n, '' || (n % 4) as project_path, cwd, git_branch, case when n % 4 = 0 then ['main', 'f' || (n % 5)] end as derived_branches, started_at, ended_at, coalesce(last_turn_at, ended_at) as last_active_at,
  message_count, coalesce(turn_count, 0) as turn_count, first_user_text, last_user_text, case n % 5 when 0 then 'completed' when 1 then 'archived' else 'active' end as status,
  case when n % 3 = 0 then 'manual' else 'auto' end as status_source, (n % 40) * 0.5 as cost_usd, case when n % 3 = 1 then 't' || m.id end as summary_title,
  case when n % 3 = 1 then 'short one' end as summary_short, case when n % 3 = 1 then n % 4 end as summary_turn_count from v_meta m left join v_active a on a.id = m.id)"""


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, sessions, vectors) for retrieval: documents, their sources, embeddings of the same ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("session_id"), "text")
    number = F.try_to_number(F.regexp_extract("session_id", "([0-9]+)$", 1), F.lit("999999999")).cast("long")
    found = docs.select("session_id").where("session_id is not null").distinct().withColumn("status", F.when(number % 5 == 0, "completed").otherwise("active"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.lit("given").alias("model_id"))
    return docs, found, vectors


CORPUS = """c_chunks as (select doc_id as chunk_id, source as session_id, text from documents),
c_sessions as (select distinct source as session_id, case when cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 5 = 0 then 'completed' else 'active' end as status from documents where source is not null),
c_vectors as (select vec_id as chunk_id, embedding from embeddings)"""


def usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream events as usage observations; errors play the synthetic model."""
    e = table(spark, sf_dir, "events")
    model = F.when(F.col("event_type") == "error", F.concat(F.lit("<synthetic>"), "event_type")).otherwise(F.col("event_type"))
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.expr("event_id div 3").cast("string").alias("key"), model.alias("model"), F.col("event_id").alias("seq"), (F.col("event_id") % 1000).alias("input_tokens"),
        F.floor(F.col("value") * 100).cast("long").alias("output_tokens"), (F.col("event_id") % 77).alias("cache_read_tokens"), (F.col("event_id") % 31).alias("cache_write_tokens"))


USAGE = """u_rows as (select cast(user_id as varchar) as session_id, cast(event_id // 3 as varchar) as key, case when event_type = 'error' then '<synthetic>error' else event_type end as model, event_id as seq,
  event_id % 1000 as input_tokens, cast(floor(value * 100) as bigint) as output_tokens, event_id % 77 as cache_read_tokens, event_id % 31 as cache_write_tokens from events),
u_messages as (select session_id, key, model, seq, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens from u_rows where model not like '%synthetic%'
  qualify row_number() over (partition by session_id, key order by output_tokens desc, seq desc) = 1),
u_sums as (select session_id, model, count(*) as turns, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, sum(cache_read_tokens)::bigint as cache_read_tokens,
  sum(cache_write_tokens)::bigint as cache_write_tokens from u_messages group by session_id, model),
u_priced as (select *, case when model like '%purchase%' then 10.0::double when model like '%c%' then 3.0::double when model like '%sign%' then 2.0::double else 5.0::double end as i,
  case when model like '%purchase%' then 50.0::double when model like '%c%' then 15.0::double when model like '%sign%' then 10.0::double else 25.0::double end as o from u_sums),
u_rollup as (select session_id, model, turns, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens,
  round_even((input_tokens * i + output_tokens * o + cache_read_tokens * i * 0.1::double + cache_write_tokens * i * 1.25::double) / 1e6, 4) as cost_usd from u_priced)"""
PRICES = (("purchase", 10, 50), ("c", 3, 15), ("sign", 2, 10))
