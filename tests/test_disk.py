"""What term blocks and stores move and leave on disk."""

import random

import pytest
from pyspark.sql import functions as F

from threadlens.operators import blocks, search, store


@pytest.fixture(scope="module")
def chunks(spark):
    rnd = random.Random(8)
    rows = [(i, f"s{i % 9}", " ".join(rnd.choice(["kuzu", "foo-bar", "élan", "the", "rare" if i % 50 == 0 else "x"]) for _ in range(rnd.randrange(40)))) for i in range(600)]
    return spark.createDataFrame(rows, "id long, session_id string, text string")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def kept_shuffles(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName(): files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().endswith(".data")}


def test_blocks_are_made_of_texts_that_move_once(spark, chunks):
    made, lengths = blocks.build(chunks, "id", size=16)
    assert exchanges(made) == 1
    whole = search.build_postings(chunks, "id")
    key = lambda df: sorted((r.term, r.chunk_id, tuple(r.positions)) for r in df.collect())
    assert key(blocks.postings(made)) == key(whole[0]) and sorted(map(tuple, lengths.collect())) == sorted(map(tuple, whole[1].collect()))
    assert made.groupBy("term", "block").count().where("count > 1").isEmpty()


def test_merges_move_postings_once_in_slices(spark, chunks, tmp_path, monkeypatch):
    made, lengths = blocks.build(chunks, "id")
    parts = list(blocks.repacked(made.withColumn("seq", F.lit(1)), lengths, None, slices=3, size=16))
    assert [exchanges(p) for p in parts] == [2, 2, 2] and all(not p.isEmpty() for p in parts)  # one of texts, one of postings
    monkeypatch.setattr(store.Transaction, "SLICE_ROWS", 400)
    tables, ids = store.Store(spark, f"file://{tmp_path}/s", buckets=2), F.col("id").alias("chunk_id")
    none, again = chunks.where("id is null"), chunks.where("id % 3 = 0").withColumn("text", F.concat(F.lit("new élan "), "text"))
    for new, gone in [(chunks.where("id % 2 = 0"), none), (chunks.where("id % 4 = 1"), none), (chunks.where("id % 4 = 3"), none), (again, again)]:
        tables.commit(lambda run, new=new, gone=gone: run.add_segment(new, gone.select(ids)))
    assert len(tables.manifest()["segments"]) == 1 and not tables.manifest()["dead"]
    live = chunks.where("id % 3 <> 0").unionByName(again)
    whole, (found, lengths) = search.build_postings(live, "id"), tables.postings()
    key = lambda df: sorted((r.term, r.chunk_id, tuple(r.positions)) for r in df.collect())
    assert key(blocks.postings(found)) == key(whole[0]) and sorted(map(tuple, lengths.collect())) == sorted(map(tuple, whole[1].collect()))
    assert found.groupBy("term", "block").count().where("count > 1").isEmpty()


def test_stores_leave_no_shuffles(spark, chunks, tmp_path):
    tables, before = store.Store(spark, f"file://{tmp_path}/s", buckets=2), kept_shuffles(spark)
    rows, none = chunks.repartition(3, "text"), chunks.where("id is null").select(F.col("id").alias("chunk_id"))
    tables.write("chunks", rows)
    assert set(kept_shuffles(spark)) <= set(before)
    tables.commit(lambda run: run.add_segment(rows, none))
    assert all(n < 4000 for f, n in kept_shuffles(spark).items() if f not in before)  # counts by length, but no texts
    assert all(f.endswith(".zstd.parquet") for f in [*tables.read("chunks").inputFiles(), *tables.postings()[0].inputFiles()])


def test_segments_move_texts_in_parts(spark, chunks, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "SLICE_TOKENS", 4000)
    parts, lengths = blocks.sliced(chunks, "id", size=16)
    moved = [p.select(F.explode("postings.chunk_id").alias("id")).distinct().count() for p in parts]
    assert [exchanges(p) for p in parts] == [1] * 4 and 0 < max(moved) < 0.4 * sum(moved)
    tables, kept, write = store.Store(spark, f"file://{tmp_path}/s", buckets=2), [], store.Transaction._write_segment
    monkeypatch.setattr(store.Transaction, "_write_segment", lambda run, made, *rest: write(run, kept.extend(made) or kept, *rest))
    tables.commit(lambda run: run.add_segment(chunks, chunks.where("id is null").select(F.col("id").alias("chunk_id"))))
    whole, (found, lengths) = search.build_postings(chunks, "id"), tables.postings()
    key = lambda df: sorted((r.term, r.chunk_id, tuple(r.positions)) for r in df.collect())
    assert len(kept) == 4 and key(blocks.postings(found)) == key(whole[0]) and sorted(map(tuple, lengths.collect())) == sorted(map(tuple, whole[1].collect()))
    assert found.groupBy("term", "block").count().where("count > 1").isEmpty()
