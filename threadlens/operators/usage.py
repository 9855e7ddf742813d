"""Token usage and cost: one row a message, rolled up by session and model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import json_long, json_string

#: Dollars per million tokens (input, output) by the first key that a model's name contains.
PRICES = (("fable", 10, 50), ("mythos", 10, 50), ("opus", 5, 25), ("sonnet-4-6", 3, 15), ("sonnet", 2, 10), ("haiku", 1, 5))
DEFAULT_PRICE, CACHE_READ, CACHE_WRITE = (5, 25), 0.1, 1.25


def observations(events: DataFrame) -> DataFrame:
    """Usage that assistant events report; keyed by message, then event, then place in the file."""
    v = F.col("raw")
    counts = {c: json_long(v, f"$.message.usage.{c}") for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")}
    usage = F.startswith(F.schema_of_variant(F.try_variant_get(v, "$.message.usage", "variant")), F.lit("OBJECT"))
    key = F.coalesce(F.nullif(json_string(v, "$.message.id"), F.lit("")), F.nullif(F.col("uuid"), F.lit("")), F.concat_ws("#", "path", F.col("seq").cast("string")))
    return events.where((F.col("type") == "assistant") & F.coalesce(usage, F.lit(False))).select(
        "session_id", key.alias("key"), json_string(v, "$.message.model").alias("model"), "seq", counts["input_tokens"].alias("input_tokens"), counts["output_tokens"].alias("output_tokens"),
        counts["cache_read_input_tokens"].alias("cache_read_tokens"), counts["cache_creation_input_tokens"].alias("cache_write_tokens"))


def dedup(rows: DataFrame) -> DataFrame:
    """The observation of most output tokens for each message, the later one on a tie; synthetic and unnamed models are left out.

    A maximum over a struct combines before the shuffle, so no key's rows are gathered.
    """
    sound = rows.where((F.coalesce("model", F.lit("")) != "") & ~F.contains(F.lower("model"), F.lit("synthetic")))
    best = F.max(F.struct("output_tokens", "seq", "model", "input_tokens", "cache_read_tokens", "cache_write_tokens")).alias("b")
    return sound.groupBy("session_id", "key").agg(best).select("session_id", "key", "b.*")


def price(model: Column, book: tuple[tuple[str, float, float], ...] = PRICES, default: tuple[float, float] = DEFAULT_PRICE) -> tuple[Column, Column]:
    """(input, output) price by the first entry whose key the model contains, in the book's order."""
    low = F.lower(model)
    out = []
    for k in (0, 1):
        c = F
        for key, *prices in book:
            c = c.when(low.contains(key.lower()), float(prices[k]))
        out.append(c.otherwise(float(default[k])))
    return out[0], out[1]


def cost(model: Column, book=PRICES, default=DEFAULT_PRICE) -> Column:
    i, o = price(model, book, default)
    return (F.col("input_tokens") * i + F.col("output_tokens") * o + F.col("cache_read_tokens") * i * CACHE_READ + F.col("cache_write_tokens") * i * CACHE_WRITE) / 1e6


def rollup(messages: DataFrame, book=PRICES, default=DEFAULT_PRICE) -> DataFrame:
    """Turns, tokens and cost (4 decimals, half to even) by session and model."""
    sums = messages.groupBy("session_id", "model").agg(
        F.count(F.lit(1)).cast("int").alias("turns"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")])
    return sums.withColumn("cost_usd", F.bround(cost(F.col("model"), book, default), 4))


def session_cost(sessions: DataFrame, usage: DataFrame) -> DataFrame:
    """cost_usd of each session from its rounded rows, 0 without any."""
    sums = usage.groupBy(F.col("session_id").alias("id")).agg(F.sum("cost_usd").alias("sum"))
    return sessions.drop("cost_usd").join(sums, "id", "left").withColumn("cost_usd", F.coalesce("sum", F.lit(0.0))).drop("sum")


def totals(usage: DataFrame) -> DataFrame:
    return usage.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("cost_usd"), 2).alias("cost_usd"))


def latest_first(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
