"""Named queries through indexes and stores: term blocks, vector cells, commits and segments."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, cells, ingest, store
from ..sources.state import shared_dir, written
from . import views
from .queries import SQL as PLAIN_SQL
from .queries import BM25, POOL, QUERY, _query_vector, long


def _store(spark: SparkSession, buckets: int = 8) -> store.Store:
    return store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", buckets)


def bm25_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_topk, from blocks of which those that cannot reach the best hits are not read."""
    chunks, sessions, _ = views.corpus(spark, sf_dir)
    made, lengths = blocks.build(chunks)
    top, _ = blocks.lexical(written(made, "blocks"), lengths, chunks, sessions, QUERY, POOL)
    return top.select("chunk_id", "session_id", F.round("bm25", 6).alias("bm25"), long("fts_rank"))


def knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest to every vector whose id is divisible by 100, itself among them."""
    _, _, vectors = views.corpus(spark, sf_dir)
    queries = vectors.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    found, _ = cells.nearest(spark, cells.build(spark, vectors), queries, 10)
    return found.select("query_id", "chunk_id", F.round("dist", 6).alias("dist"), long("rank"))


def store_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and usage of a store after two commits, the second of some sessions only, read through the manifest; a third run ends without one."""
    s, n = views.sessions(spark, sf_dir), F.col("id").cast("long")
    tables = _store(spark)
    used = s.select(F.col("id").alias("session_id"), F.lit("m").alias("model"), (n % 5).cast("int").alias("turns"))

    def first(run: store.Transaction) -> None:
        run.replace("sessions", s)
        run.replace("session_usage", used)

    def second(run: store.Transaction, step: int = 1) -> None:
        new = s.where(n % 10 == 3).select("id", (F.col("turn_count") + step).alias("turn_count"), F.lit("last").alias("last_user_text"), F.lit("").alias("provider"))
        touched = run.buckets_of("sessions", new)
        run.replace("sessions", store.merge_sessions(run.read("sessions", touched), new), touched)
        again = used.where(F.col("session_id").cast("long") % 10 == 3).withColumn("turns", F.lit(100 * step))
        run.replace("session_usage", store.replace_by_session(run.read("session_usage", touched), again, again), touched)

    tables.commit(first)
    tables.commit(second)
    second(tables.begin(), 7)  # written and not committed
    turns = tables.read("session_usage").select(F.col("session_id").alias("id"), long("turns"))
    return tables.read("sessions").join(turns, "id").select("id", "cwd", long("turn_count"), "last_user_text", "status", "turns")


def store_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over a store's live postings after commits that add, replace and remove documents."""
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    tables, ids = _store(spark), lambda rows: rows.select(F.col("id").alias("chunk_id"))
    none, again = docs.where("id is null"), docs.where("id % 10 = 0").withColumn("text", F.concat(F.lit("worthless token "), F.coalesce("text", F.lit(""))))
    steps = [(docs.where("id % 2 = 0"), none), (docs.where("id % 4 = 1"), none), (docs.where("id % 4 = 3"), none), (again, again), (none, docs.where("id % 100 = 7"))]
    for new, gone in steps:
        tables.commit(lambda run, new=new, gone=gone: run.add_segment(new, ids(gone)))
    top, _ = blocks.topk(*tables.postings(), QUERY, 200)
    return top.select("chunk_id", F.round("bm25", 6).alias("bm25"))


def hybrid_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hybrid_search over a store: documents in two commits, vectors indexed between them, so that half of the vectors come from cells."""
    chunks, sessions, vectors = views.corpus(spark, sf_dir)
    tables = _store(spark)
    held = chunks.withColumnRenamed("chunk_id", "id")
    of_session = vectors.join(chunks.select("chunk_id", "session_id"), "chunk_id", "left")

    def add(run: store.Transaction, buckets: list[int]) -> None:
        run.replace("chunks", held.where(run.bucket("chunks").isin(buckets)), buckets)
        run.replace("chunk_vectors", of_session.where(run.bucket("chunk_vectors").isin(buckets)), buckets)
        run.add_segment(held.where(run.bucket("chunks").isin(buckets)), held.where("id is null").select(F.col("id").alias("chunk_id")))

    tables.commit(lambda run: run.replace("sessions", sessions.withColumnRenamed("session_id", "id")))
    tables.commit(lambda run: add(run, [0, 1, 2, 3]))
    tables.commit(lambda run: run.index_vectors("given"))
    tables.commit(lambda run: add(run, [4, 5, 6, 7]))
    hits = ingest.hybrid(spark, tables.base, QUERY, query_vector=_query_vector(vectors), model_id="given", pool=POOL, limit=10, max_per_session=2, dedup_before_cut=True)
    return hits.select(long("pos"), "chunk_id", "session_id", F.round("fused", 9).alias("fused"), F.round("bm25", 6).alias("bm25"), F.round("dist", 6).alias("dist"), long("matched"))


_CHANGED = "select doc_id as chunk_id, source as session_id, case when doc_id % 10 = 0 then 'worthless token ' || coalesce(text, '') else text end as text from documents where doc_id % 100 <> 7"
SQL = {
    "bm25_topk_blocks": PLAIN_SQL["bm25_topk"],
    "hybrid_store": PLAIN_SQL["hybrid_search"],
    "knn_cells": """with d as (select q.vec_id as query_id, v.vec_id as chunk_id, round(list_distance(v.embedding::double[], q.embedding::double[]), 9) as dist from embeddings v, embeddings q where q.vec_id % 100 = 0 and v.embedding is not null),
r as (select *, row_number() over (partition by query_id order by dist, chunk_id) - 1 as rank from d) select query_id, chunk_id, round(dist, 6) as dist, rank from r where rank < 10""",
    "store_commits": f"""with {views.SESSIONS} select id, cwd, case when n % 10 = 3 then turn_count + 1 else turn_count end as turn_count, case when n % 10 = 3 then 'last' else last_user_text end as last_user_text, status,
  case when n % 10 = 3 then 100 else n % 5 end as turns from v_sessions""",
    "store_segments": "with " + BM25.replace("select doc_id as chunk_id, source as session_id, text from documents", _CHANGED) + " select chunk_id, round(bm25, 6) as bm25 from b_scores order by b_scores.bm25, chunk_id limit 200",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (bm25_topk_blocks, knn_cells, store_commits, store_segments, hybrid_store)}
