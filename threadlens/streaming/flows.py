"""Streams with state: turns by session with timers, joins of two streams, windows by finality, and the store fed by new files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators import ingest
from ..operators.projection import BLOCK_JOIN, user_text
from ..functions.scalars import block_text
from ..sources.state import shared_dir

TURNS = "session_id string, seq long, user_text string, assistant_text string, user_ts timestamp, assistant_ts timestamp"
_OPEN = "prompt string, user_ts timestamp, parts array<string>, assistant_ts timestamp, open boolean"
_LISTED = "path string, modificationTime timestamp, length long, content binary"
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TurnFold(StatefulProcessor):
    """The open turn of a session and the number of the next one; a timer closes a turn when nothing comes for `idle` seconds.

    A batch's events of a session are taken in the order of seq, and batches bring a session's events in order, as a log that grows
    does. Prose that comes after the timer belongs to no turn.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn, self.next, self.timer = handle.getValueState("turn", _OPEN), handle.getValueState("next", "n long"), handle.getValueState("timer", "at long")

    def _close(self, key: tuple) -> Iterator[Row]:
        """The open turn, if it has a prompt; one of tool results alone gives none."""
        turn = self.turn.get()
        if turn is not None and turn[4]:
            prompt, user_ts, parts, assistant_ts = turn[:4]
            if prompt is not None:
                n = (self.next.get() or (0,))[0]
                self.next.update((n + 1,))
                yield Row(session_id=key[0], seq=n, user_text=prompt, assistant_text=BLOCK_JOIN.join(parts), user_ts=user_ts, assistant_ts=assistant_ts)
            self.turn.update((None, None, [], None, False))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        latest = 0
        for r in sorted(rows, key=lambda r: r.seq):
            latest = max(latest, r.at or 0)
            if r.type == "user":
                yield from self._close(key)
                self.turn.update((r.prompt, r.ts, [], None, True))
            elif r.type == "assistant" and (turn := self.turn.get()) is not None and turn[4]:
                prompt, user_ts, parts, first, _ = turn
                self.turn.update((prompt, user_ts, [*parts, *([r.prose] if r.prose is not None else [])], first if first is not None else r.ts, True))
        if latest:
            at, before = 1000 * (latest + self.idle), self.timer.get()
            if before is None or before[0] < at:
                if before is not None:
                    self.handle.deleteTimer(before[0])
                self.handle.registerTimer(at)
                self.timer.update((at,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._close(key)
        self.timer.clear()

    def close(self) -> None:
        pass


def turn_events(events: DataFrame) -> DataFrame:
    """What the fold needs of events of format A: prompts of users, prose of assistants."""
    is_user, is_assistant = F.col("type") == "user", F.col("type") == "assistant"
    return events.where(is_user | is_assistant).select(
        "session_id", "seq", "type", "ts", F.unix_timestamp("ts").alias("at"),
        F.when(is_user, user_text(F.col("blocks"))).alias("prompt"), F.when(is_assistant, block_text(F.col("blocks"), BLOCK_JOIN)).alias("prose"))


def turns(events: DataFrame, late: str = "1 minute", idle: int = 3600) -> DataFrame:
    """Turns of a stream of turn_events(), as each is closed by the next prompt or by a timer. Events without a time are not timed."""
    keyed = events.withWatermark("ts", late).groupBy("session_id")
    return keyed.transformWithState(statefulProcessor=TurnFold(idle), outputStructType=TURNS, outputMode="Append", timeMode="EventTime")


def within(left: DataFrame, right: DataFrame, key: str, span: str, late: str = "1 day") -> DataFrame:
    """(key, left_id, right_id, left_ts, right_ts) of rows (id, key, ts) of two streams, the right one at most `span` after the left one.

    State leaves when the watermark, the lesser of both sides', passes what can still match; later rows are dropped and counted."""
    a = left.select(F.col("id").alias("left_id"), F.col(key).alias("left_key"), F.col("ts").alias("left_ts")).withWatermark("left_ts", late)
    b = right.select(F.col("id").alias("right_id"), F.col(key).alias("right_key"), F.col("ts").alias("right_ts")).withWatermark("right_ts", late)
    near = (F.col("left_key") == F.col("right_key")) & (F.col("right_ts") >= F.col("left_ts")) & (F.col("right_ts") <= F.col("left_ts") + F.expr(f"interval {span}"))
    return a.join(b, near).select(F.col("left_key").alias(key), "left_id", "right_id", "left_ts", "right_ts")


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """State that is keyed and timed needs this store; the session's setting is put back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def fed(spark: SparkSession, batches: Iterable[DataFrame], make: Callable[[DataFrame], DataFrame], folder: str | None = None) -> tuple[DataFrame, int]:
    """(results, late rows dropped) of a stream to which the batches arrive one by one; after each the query ends, and the next one
    goes on from its checkpoint. A micro-batch's results replace those of a try that failed."""
    run, late, schema = folder or f"{shared_dir(spark)}/fed-{uuid.uuid4().hex}", 0, None
    for rows in batches:
        rows.write.mode("append").parquet(f"{run}/in")
        with _rocks(spark):
            out = make(spark.readStream.schema(rows.schema).parquet(f"{run}/in"))
            schema = out.schema
            query = out.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{run}/out/batch={n}")).option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start()
            query.awaitTermination()
        late += sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    return spark.read.schema(schema or StructType()).parquet(f"{run}/out/*"), late


def follow_store(spark: SparkSession, base: str, options: ingest.Options, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Ingest whenever files of either format come; a micro-batch is one commit of the store, whose cursors skip what is unchanged.

    Without `seconds` what is there is ingested and the stream ends; with them it looks again after so many. Files that grow are no new files
    to a stream, so each micro-batch lists the roots anew."""
    roots = [f"{root}/*" for _, root in options.roots_a] + ([options.root_b] if options.root_b else [])
    streams = [spark.readStream.format("binaryFile").schema(_LISTED).option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).load(r).select("path") for r in roots]
    every = streams[0]
    for s in streams[1:]:
        every = every.unionAll(s)
    writer = every.writeStream.foreachBatch(lambda _, n: ingest.ingest(spark, base, options)).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
    if not seconds:
        query.awaitTermination()
    return query


def far_future(spark: SparkSession, like: DataFrame) -> DataFrame:
    """One row of a session of its own, after everything else: it moves the watermark, so that timers fire and windows end."""
    values = {"session_id": F.lit("~"), "ts": F.lit(datetime(2100, 1, 1, tzinfo=timezone.utc))}
    return spark.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])
