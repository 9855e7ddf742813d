"""Commits, buckets and segments of a store; term blocks against the plain scores."""

import os
import random

import pytest
from pyspark.sql import functions as F

from test_engine import assistant, sessions_df, text, user, write
from threadlens.operators import blocks, ingest, search, store

WORDS = ["foo", "bar", "foo-bar", "the", "élan", "kuzu", "x_y", "rare", "plain"]


def files_below(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def rows_of(tables, table="sessions", column="turn_count"):
    return {r.id: r[column] for r in tables.read(table).collect()}


def test_commit_is_all_or_nothing(spark, tmp_path):
    tables = store.Store(spark, f"file://{tmp_path}/s", buckets=4)
    ids = [f"s{i}" for i in range(20)]
    tables.write("sessions", sessions_df(spark, [{"id": i, "turn_count": 1} for i in ids]))

    def work(stop):
        def steps(run):
            rows = sessions_df(spark, [{"id": i, "turn_count": 2} for i in ids])
            usage = spark.createDataFrame([(i, "m", 1.0) for i in ids], "session_id string, model string, cost_usd double")
            chunks = spark.createDataFrame([(k, i, "kuzu") for k, i in enumerate(ids)], "id long, session_id string, text string")
            for k, step in enumerate([lambda: run.replace("sessions", rows), lambda: run.replace("session_usage", usage), lambda: run.replace("chunks", chunks), lambda: run.add_segment(chunks, chunks.select(F.col("id").alias("chunk_id")))]):
                step()
                if k == stop:
                    raise RuntimeError("killed")

        return steps

    for stop in range(4):
        with pytest.raises(RuntimeError):
            tables.commit(work(stop))
        assert set(rows_of(tables).values()) == {1} and tables.read("session_usage").isEmpty() and tables.postings()[0].isEmpty()
    assert len(files_below(tmp_path / "s" / "data")) == len(tables.read("sessions").inputFiles())  # nothing is left behind
    tables.commit(work(None))
    assert set(rows_of(tables).values()) == {2} and tables.read("session_usage").count() == 20 and tables.postings()[1].count() == 20
    # A run that is killed without a word leaves files that no one reads; they are swept when they are old.
    lost = tables.begin()
    lost.replace("sessions", sessions_df(spark, [{"id": "x"}]))
    assert set(rows_of(tables).values()) == {2} and tables.sweep() == 0 and tables.sweep(older=-1) == 1 and set(rows_of(tables).values()) == {2}


def test_two_writers(spark, tmp_path):
    tables = store.Store(spark, f"file://{tmp_path}/s", buckets=8)
    tables.write("sessions", sessions_df(spark, [{"id": f"s{i}", "turn_count": 0} for i in range(30)]))
    where = {r.id: r.b for r in tables.read("sessions").select("id", tables.begin().bucket("sessions").alias("b")).collect()}
    one, other = sorted(set(where.values()))[:2]
    raised = lambda run, b: run.replace("sessions", run.read("sessions", [b]).withColumn("turn_count", F.col("turn_count") + 1), [b])
    first, second, third = tables.begin(), tables.begin(), tables.begin()
    raised(first, one), raised(second, other), raised(third, one)
    assert first.commit() == 2 and second.commit() == 3  # the second builds upon the first
    with pytest.raises(store.Conflict):
        third.commit()
    third.clear()
    assert rows_of(tables) == {i: int(b in (one, other)) for i, b in where.items()}
    tries = []

    def again(run):
        raised(run, one)
        tries.append(1)
        if len(tries) == 1:
            late = tables.begin()
            raised(late, one)
            late.commit()

    tables.commit(again)
    assert len(tries) == 2 and rows_of(tables) == {i: 3 if b == one else int(b == other) for i, b in where.items()}
    assert len(tables._names("_manifests")) == store.Store.KEEP
    with pytest.raises(ValueError, match="outside"):
        tables.begin().replace("sessions", tables.read("sessions"), [one])


def test_lock_is_taken_over_once(spark, tmp_path):
    tables = store.Store(spark, f"file://{tmp_path}/s")
    with tables.lock() as first:
        made = os.path.getmtime(tmp_path / "s" / "_lock")
        with tables.lock(lease=-1) as a:
            os.utime(tmp_path / "s" / "_lock", (made, made))  # a third run still sees the dead run's lock
            with tables.lock(lease=-1) as b:
                assert first and a and not b
    with tables.lock() as c:
        assert c


def test_only_touched_buckets_are_written(spark, tmp_path):
    for i in range(24):
        write(tmp_path / "in" / "proj" / f"s{i}.jsonl", [user(f"hello {WORDS[i % 9]} {i}", 1), assistant(text("hi kuzu"), minute=2, mid="m", model="haiku", usage={"input_tokens": 10, "output_tokens": 3})])
    base, roots = f"file://{tmp_path}/store", [("legacy", str(tmp_path / "in"))]
    store.Store(spark, base, buckets=16).write("sessions", sessions_df(spark, []))
    assert ingest.ingest(spark, base, ingest.Options(roots))["sessions"] == 24
    tables = store.Store(spark, base)
    before = {t: set(tables.read(t).inputFiles()) for t in ("sessions", "chunks", "session_usage", "files")}
    segments = tables.manifest()["segments"]
    write(tmp_path / "in" / "proj" / "s3.jsonl", [user("hello again", 1), assistant(text("yes élan"), minute=4)])
    counts = ingest.ingest(spark, base, ingest.Options(roots))
    assert (counts["files"], counts["buckets"]) == (1, 1)
    for t, old in before.items():
        new = set(tables.read(t).inputFiles())
        assert len(old - new) == 1 and len(new - old) <= 1, t  # one bucket's file goes, one comes
    now = tables.manifest()
    assert now["segments"][:-1] == segments and now["segments"][-1]["rows"] < segments[0]["rows"] / 5 and len(now["dead"]) == 1
    assert {r.session_id for r in ingest.lexical(spark, base, "élan again").collect()} >= {"s3"} and "s3" not in {r.session_id for r in ingest.lexical(spark, base, "kuzu").collect()}
    assert counts == ingest.ingest(spark, base, ingest.Options(roots)) | {"files": 1, "sessions": 1, "buckets": 1}
    ingest.set_status(spark, base, "s3", "completed")
    assert {r.id for r in tables.read("sessions").where("status = 'completed'").collect()} == {"s3"}


def test_segments_equal_a_rebuild(spark, tmp_path):
    rnd, tables, live = random.Random(4), store.Store(spark, f"file://{tmp_path}/s", buckets=2), {}
    frame = lambda rows: spark.createDataFrame([(i, t) for i, t in rows.items()], "id long, text string")
    written, empty = [], spark.createDataFrame([], "id long, text string")
    for step in range(7):
        new = {rnd.randrange(60): " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(0, 30))) for _ in range(30 if not step else 5)}
        gone = set(new) | ({rnd.choice(sorted(live))} if live else set())
        dead = [(i,) for i in gone if i in live]
        tables.commit(lambda run: run.add_segment(frame(new), spark.createDataFrame(dead, "chunk_id long")))
        live = {i: t for i, t in live.items() if i not in gone} | new
        found, lengths = tables.postings()
        whole = search.build_postings(frame(live), "id")
        key = lambda df: sorted((r.term, r.chunk_id, tuple(r.positions)) for r in df.collect())
        assert key(blocks.postings(found)) == key(whole[0])
        assert sorted(map(tuple, lengths.collect())) == sorted(map(tuple, whole[1].collect()))
        for query in ("kuzu rare", 'the "foo-bar" élan'):
            want = search.bm25(frame(live), query, "id").orderBy("bm25", "chunk_id").limit(9).collect()
            assert [tuple(r) for r in blocks.topk(found, lengths, query, 9)[0].orderBy("bm25", "chunk_id").collect()] == [tuple(r) for r in want]
        written.append(len(tables.manifest()["segments"]))
    assert max(written) <= store.Transaction.MERGE and 1 in written[1:] or min(written[3:]) < max(written)
    tables.commit(lambda run: run.add_segment(empty, frame(live).select(F.col("id").alias("chunk_id"))))
    assert tables.postings()[0].isEmpty() and tables.postings()[1].isEmpty()


def test_vectors_written_after_their_cells_are_found(spark, tmp_path):
    rnd = random.Random(9)
    tables = store.Store(spark, f"file://{tmp_path}/s", buckets=4)
    rows = {(i, f"s{i % 40}"): [rnd.gauss(8 * (i % 5), 1) for _ in range(4)] for i in range(400)}
    frame = lambda some: spark.createDataFrame([(*k, v, "m") for k, v in some.items()], "chunk_id long, session_id string, embedding array<float>, model_id string")
    tables.write("chunk_vectors", frame(rows))
    tables.commit(lambda run: run.index_vectors("m", 20))

    def check(share):
        query = list(rows[(7, "s7")])
        found, counts = tables.begin().nearest("m", query, 15)
        assert [tuple(r) for r in found.collect()] == [tuple(r) for r in search.nearest(tables.read("chunk_vectors"), query, 15).collect()]
        assert counts["read"] <= share * 20

    check(0.7)
    touched = tables.begin().buckets_of("chunk_vectors", frame({(0, "s7"): [0.0] * 4}))
    moved = {k: [x + 0.01 for x in v] if k[1] == "s7" else v for k, v in rows.items()}
    rows.update(moved)
    tables.commit(lambda run: run.replace("chunk_vectors", frame(rows).where(run.bucket("chunk_vectors").isin(touched)), touched))
    check(0.9)
    tables.write("chunk_vectors", frame(rows))  # all of it: no bucket is in the cells any more
    check(0)


def test_blocks_skip_ranges(spark):
    """A word that a few short chunks hold often: most ranges that hold it cannot reach the best hits."""
    rnd = random.Random(6)
    rows = [(i, f"s{i % 50}", " ".join(rnd.choice(["kuzu", "a1", "b2", "c3", "d4"] if i % 40 else ["kuzu", "kuzu", "rare"]) for _ in range(rnd.randrange(3, 12) if not i % 40 else rnd.randrange(3, 200)))) for i in range(4000)]
    chunks = spark.createDataFrame(rows, "chunk_id long, session_id string, text string")
    sessions = spark.createDataFrame([(f"s{i}", "completed" if i % 4 == 0 else "active") for i in range(50)], "session_id string, status string")
    made, lengths = (df.cache() for df in blocks.build(chunks, size=32))
    assert made.agg(F.max("n")).first()[0] < 100 and made.where("n <> size(postings)").isEmpty()
    for query in ("kuzu rare", "kuzu", "rare a1", "a1-b2 kuzu", "nothing here", "?"):
        want = search.lexical(chunks, sessions, query, 20).orderBy("fts_rank").collect()
        top, read = blocks.lexical(made, lengths, chunks, sessions, query, 20)
        assert [(r.chunk_id, r.session_id, r.bm25, r.fts_rank) for r in top.orderBy("fts_rank").collect()] == [(r.chunk_id, r.session_id, r.bm25, r.fts_rank) for r in want], query
        assert read["read"] <= read["ranges"]
        if query == "kuzu rare":
            assert read["read"] < read["ranges"] / 2, read
