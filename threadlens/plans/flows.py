"""Named queries over streams that keep state, and over a source of lines that is cut into splits."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import transcripts
from ..sources.state import shared_dir
from ..streaming import flows, streams
from . import views
from .queries import SQL as BATCH_SQL
from .queries import long, seconds


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _arrival() -> Column:
    """Events come in batches of ten days; every seventh comes a batch late."""
    return F.least(F.lit(3), F.floor((F.dayofmonth("ts") - 1) / 10) + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0))


def stream_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of format A from a stream in four batches by time, sessions cut between them; timers close the last ones."""
    events = flows.turn_events(views.events(spark, sf_dir))
    low, high = events.agg(F.min("at"), F.max("at")).first()
    span = (high or 0) - (low or 0) + 1
    part = F.floor((F.col("at") - (low or 0)) * 4 / span)
    found, _ = flows.fed(spark, [*[events.where(part == k) for k in range(4)], flows.far_future(spark, events)], flows.turns)
    return found.select("session_id", long("seq"), "user_text", "assistant_text", seconds("user_ts"), seconds("assistant_ts"))


def stream_windows_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that the watermark has passed, each told once; events that come after their day is told are dropped."""
    rows, at = _events(spark, sf_dir), _arrival()
    found, _ = flows.fed(spark, [rows.where(at == k) for k in range(4)], streams.tumbling)
    return found.select(seconds("start"), "event_type", "n", F.round("value", 4).alias("value"))


def view_purchases(events: DataFrame) -> DataFrame:
    kind = lambda name: events.where(F.col("event_type") == name).withColumnRenamed("event_id", "id")
    return flows.within(kind("view"), kind("purchase"), "user_id", "3 hours")


def stream_view_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within three hours of a view by the same user, of two streams; what comes behind the watermark is dropped."""
    rows, at = _events(spark, sf_dir), _arrival()
    found, _ = flows.fed(spark, [rows.where(at == k) for k in range(4)], view_purchases)
    return found.select("user_id", F.col("left_id").alias("view_id"), F.col("right_id").alias("purchase_id"))


def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as text files, a file for each 500, and read back by splits."""
    c, folder = views.table(spark, sf_dir, "conversations"), f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    rows = c.select(F.floor(F.col("conv_id") / 500).cast("long").alias("file"), "conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, "\r").otherwise("")).alias("value"))
    count = rows.select("file").distinct().count()
    rows.repartitionByRange(max(count, 1), "file").sortWithinPartitions("file", "conv_id", "turn").select("file", "value").write.partitionBy("file").text(folder)
    found = transcripts.split_lines(spark, f"{folder}/*/*.txt")
    return found.select(F.regexp_extract("path", r"/file=(\d+)/", 1).cast("long").alias("file"), "seq", "start", "end", long(F.length("line"), "chars"))


_ARRIVALS = """e as (select *, least(3, (day(ts) - 1) // 10 + case when event_id % 7 = 0 then 1 else 0 end) as batch from events)"""
SQL = {
    "stream_turns": BATCH_SQL["turns"],
    "stream_windows_final": f"""with {_ARRIVALS}, w as (select b.batch, (select max(ts) - interval 1 day from e where e.batch < b.batch) as mark from (select distinct batch from e) b),
kept as (select e.*, date_trunc('day', ts) as start from e join w using (batch) where mark is null or date_trunc('day', ts) + interval 1 day > mark)
select cast(epoch(start) as bigint) as start, event_type, count(*) as n, round(sum(value), 4) as value from kept where start + interval 1 day <= (select max(ts) - interval 1 day from e) group by all""",
    "stream_view_purchase": f"""with {_ARRIVALS}, w as (select b.batch, (select least(max(ts) filter (event_type = 'view'), max(ts) filter (event_type = 'purchase')) - interval 1 day from e where e.batch < b.batch) as mark from (select distinct batch from e) b),
kept as (select e.* from e join w using (batch) where mark is null or ts > mark)
select v.user_id, v.event_id as view_id, p.event_id as purchase_id from kept v join kept p on v.user_id = p.user_id and v.event_type = 'view' and p.event_type = 'purchase' and p.ts between v.ts and v.ts + interval 3 hours""",
    "line_offsets": """with f as (select conv_id // 500 as file, string_agg(coalesce(text, '') || case when turn % 3 = 0 then chr(13) else '' end || chr(10), '' order by conv_id, turn) as body from conversations group by 1),
l as (select file, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) - 1 as seq, len(string_split(body, chr(10))) as lines from f),
o as (select *, sum(strlen(line) + 1) over (partition by file order by seq) as stop from l where seq < lines - 1)
select file, seq, (stop - strlen(line) - 1)::bigint as start, stop::bigint as "end", length(regexp_replace(line, '\\r$', '')) as chars from o where trim(regexp_replace(line, '\\r$', '')) <> ''""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (stream_turns, stream_windows_final, stream_view_purchase, line_offsets)}
