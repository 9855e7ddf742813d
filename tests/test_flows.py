"""Streams with state against the same over all rows at once: late rows, restarts, timers, the store behind a stream."""

from datetime import timedelta

from pyspark.sql import functions as F

from test_engine import T0, assistant, text, user, write
from threadlens.operators import ingest, projection, store
from threadlens.plans import flows as plans
from threadlens.streaming import flows, streams


def rows(spark, some):
    return spark.createDataFrame([(i, T0 + timedelta(minutes=m), u, k, 1.0) for i, m, u, k in some], "event_id long, ts timestamp, user_id long, event_type string, value double")


def test_late_rows_are_dropped_and_counted(spark):
    day = 24 * 60
    first = [(1, 10, 1, "view"), (2, 100, 1, "purchase"), (3, 5 * day, 1, "view"), (4, 5 * day, 2, "purchase")]
    late = [(5, 20, 1, "purchase"), (6, 5 * day + 60, 1, "purchase"), (7, 4 * day + 30, 1, "view"), (8, 5 * day + 1, 2, "view")]
    found, dropped = flows.fed(spark, [rows(spark, first), rows(spark, late), rows(spark, [(9, 20 * day, 1, "view"), (10, 20 * day, 1, "purchase")])], plans.view_purchases)
    assert dropped == 1 and sorted((r.left_id, r.right_id) for r in found.collect()) == [(1, 2), (3, 6), (9, 10)]
    found, dropped = flows.fed(spark, [rows(spark, first), rows(spark, late), rows(spark, [(9, 20 * day, 1, "view")])], streams.tumbling)
    got = {((r.start.replace(tzinfo=T0.tzinfo) - T0).days, r.event_type): r.n for r in found.collect()}
    assert dropped == 1 and got == {(0, "view"): 1, (0, "purchase"): 1, (4, "view"): 1, (5, "view"): 2, (5, "purchase"): 2}


def test_turns_go_on_after_a_restart(spark, tmp_path):
    """Each batch is a query of its own that goes on from the checkpoint; turns are cut between batches; a timer closes the last."""
    events = [user("one", 0), assistant(text("a"), minute=1), assistant({"type": "tool_use"}, minute=2), assistant(text("b"), minute=3), user([{"type": "tool_result"}], 4), assistant(text("dropped"), minute=5), user("two", 6),
              user("three", 7), assistant(text("c"), minute=8), user("four", 200), assistant(text("d"), minute=201)]
    write(tmp_path / "in" / "p" / "s.jsonl", events)
    write(tmp_path / "in" / "p" / "t.jsonl", [user("other", 3), user("more", 190), assistant(text("e"), minute=191)])
    from threadlens.sources import transcripts

    parsed = projection.session_keys(transcripts.events(transcripts.transcript_files(spark, [("legacy", str(tmp_path / "in"))])))
    want = sorted((r.session_id, r.seq, r.user_text, r.assistant_text, r.user_ts, r.assistant_ts) for r in projection.turns_a(parsed).collect())
    feed = flows.turn_events(parsed)
    minute = (F.unix_timestamp("ts") - int(T0.timestamp())) / 60
    cuts = [(0, 2), (2, 6), (6, 8), (8, 100), (100, 1000)]
    batches = [feed.where((minute >= a) & (minute < b)) for a, b in cuts]
    found, late = flows.fed(spark, [*batches, flows.far_future(spark, feed)], flows.turns)
    assert late == 0 and sorted(tuple(r) for r in found.collect()) == want
    # Without what moves the watermark the last turns stay open.
    found, _ = flows.fed(spark, batches, flows.turns)
    assert sorted(r.user_text for r in found.collect()) == sorted({w[2] for w in want} - {"four", "more"})


def test_a_stream_feeds_the_store(spark, tmp_path):
    write(tmp_path / "a" / "p" / "s1.jsonl", [user("hello"), assistant(text("hi"), minute=1)])
    b = {"type": "event_msg", "timestamp": "2024-01-01T00:00:00Z", "payload": {"type": "user_message", "message": "ask"}}
    uuid = "0a1b2c3d-0000-1111-2222-333344445555"
    write(tmp_path / "b" / "2024" / f"rollout-x-{uuid}.jsonl", [{"type": "session_meta", "payload": {"cwd": "/w"}}, b])
    base, options = f"file://{tmp_path}/store", ingest.Options([("legacy", str(tmp_path / "a"))], str(tmp_path / "b"))
    follow = lambda: flows.follow_store(spark, base, options, f"file://{tmp_path}/state")
    follow()
    tables = store.Store(spark, base)
    assert {r.id for r in tables.read("sessions").collect()} == {"s1", uuid}
    first = tables.manifest()["number"]
    follow()
    assert tables.manifest()["number"] == first  # nothing new, nothing written
    write(tmp_path / "a" / "q" / "s2.jsonl", [user("again")])
    follow()
    assert {r.id for r in tables.read("sessions").collect()} == {"s1", "s2", uuid} and tables.manifest()["number"] == first + 1
