"""Mixing sources to target weights (operator 9).

Every source's words form a stream of fixed-length blocks. The mix's slots are dealt to output shards: each shard draws
multinomial source counts from what the targets leave over, and the j-th slot of a source takes block perm(j mod n) of
its j div n-th epoch, perm being a keyed Feistel permutation of the source's n blocks. Slots and blocks are joined by
(source, index). A block is taken at most once an epoch, so no document exceeds the cap.

Cases: null text counts no words, a null source is a source of its own (last); a text of any length is many blocks, and
a document's blocks are numbers until they are joined; empty and repeated rows and equal ids keep their own place in the
stream, in the order of their sizes; without words all targets are 0; an empty table gives an empty result; other columns
may have any name. Sources are few (a table of them is held by the driver); documents are not, and doc_id tells them
apart: rows of one doc_id are ordered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Kept, arrow_map, attached_rows, handing_back, in_batches, mix64, parts_for, raw

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
#: Words of a block; sources of under 64 such blocks get shorter ones. Slots of an output shard, and most shards.
BLOCK, LEAST_BLOCKS, SHARD_SLOTS, MOST_SHARDS = 32, 64, 4096, 4096
#: Slots that one row is expanded to at a time, and slots of a task that expands them.
RUN, TASK_SLOTS = 4096, 500_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """share of all words dealt out by weight; what is above cap times a source's size is dealt out again."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, rest, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(w[i] for i in sorted(open_))
        given = {i: rest * w[i] / total for i in sorted(open_)}
        full = [i for i in given if given[i] > cap * sizes[i]]
        if not full:
            for i in given:
                out[i] = given[i]
            break
        for i in full:
            out[i] = cap * sizes[i]
            rest -= out[i]
            open_.discard(i)
    return out


@dataclass(frozen=True)
class SourcePlan:
    source: str | None
    size: int
    target: float
    block: int
    blocks: int
    slots: int


def plan_sources(totals: list[tuple[str | None, int]]) -> list[SourcePlan]:
    """Order by code point, null last; block length, block count and slots of each source."""
    order = sorted(totals, key=lambda t: (t[0] is None, t[0] or ""))
    out = []
    for (source, size), target in zip(order, targets([n for _, n in order])):
        block = max(1, min(BLOCK, size // LEAST_BLOCKS))
        blocks = -(-size // block)
        out.append(SourcePlan(source, size, target, block, blocks, min(int(CAP) * blocks, round(target * blocks / size)) if size else 0))
    return out


def deal(plans: list[SourcePlan], seed: int) -> list[tuple[int, int, int, int]]:
    """(shard, source number, first slot of the source, slots): multinomial counts per output shard."""
    rng, left = np.random.default_rng(seed), np.array([p.slots for p in plans], np.int64)
    total = int(left.sum())
    per = max(SHARD_SLOTS, -(-total // MOST_SHARDS))
    first, out = np.zeros(len(plans), np.int64), []
    for shard in range(-(-total // per)):
        want, counts = min(per, int(left.sum())), np.zeros(len(plans), np.int64)
        while (missing := want - int(counts.sum())) > 0:  # a draw beyond what a source has left is drawn again
            rest = left - counts
            counts = np.minimum(left, counts + rng.multinomial(missing, rest / rest.sum()))
        out += [(shard, k, int(first[k]), int(counts[k])) for k in np.flatnonzero(counts).tolist()]
        first, left = first + counts, left - counts
    return out


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1 at each index: a Feistel network, walked until it lands inside."""
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask, x, n64 = (np.uint64(1) << bits) - np.uint64(1), index.astype(np.uint64), n.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        y, b, m, k = x[todo], bits[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = y >> b, y & m
        for turn in range(4):
            left, right = right, left ^ (mix64(right * np.uint64(0x9E3779B97F4A7C15) + k + np.uint64(turn * 0x51ED27)) & m)
        x[todo] = (left << b) | right
        todo[todo] = x[todo] >= n64[todo]
    return x.astype(np.int64)


def _permuted(index: Column, n: Column, key: Column) -> Column:
    @F.pandas_udf("long")
    def f(i: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(permute(i.to_numpy(np.int64), n.to_numpy(np.int64), k.to_numpy(np.int64)))

    return f(index, n, key)


def document_sizes(df: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = pa.array([len(t.split()) for t in raw(batch.column("text"))], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), sizes], names=["doc_id", "source", "size"])

    slim = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return arrow_map(slim, run, "doc_id long, source string, size long")


def mix(spark: SparkSession, df: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, slots, spans).

    Per document doc_id, size, source_size, target, taken; per slot its shard, source and block; per taken piece of a
    document its place in the source's stream, its epoch and its words [low, high).
    """
    kept = Kept(spark)
    docs = kept.keep("sizes", document_sizes(df))
    plans = plan_sources([(r.source, r.n) for r in docs.groupBy("source").agg(F.sum("size").alias("n")).collect()])
    kinds = "k int, source string, source_size long, target double, block long, blocks long"
    sources = spark.createDataFrame([(k, p.source, p.size, p.target, p.block, p.blocks) for k, p in enumerate(plans)], kinds)
    buckets = max(64, docs.count() // 20_000)
    # Offsets in a source's stream in two steps, so that no task orders a whole source.
    placed = docs.join(sources.withColumnRenamed("source", "name"), F.expr("source <=> name")).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("k", "bucket").agg(F.sum("size").alias("n")).select("k", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("k", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["k", "bucket"]).withColumn("at", F.col("base") + F.col("within"))

    # Runs of slots are dealt out before they are expanded: the table they come from is tiny.
    runs = spark.createDataFrame(deal(plans, seed), "shard int, k int, first long, n long").select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})")).alias("run"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(p.slots for p in plans) // TASK_SLOTS)
    runs = runs.select("shard", "k", "run", F.expr(f"first + run * {RUN}").alias("low"), F.expr(f"first + least(n, (run + 1) * {RUN}) - 1").alias("high")).repartition(tasks, "shard", "k", "run")
    slots = runs.join(F.broadcast(sources.select("k", "blocks")), "k").select("shard", "k", "blocks", F.explode(F.expr("sequence(low, high)")).alias("j"))
    epoch = F.expr("j div blocks")
    slots = slots.select("shard", "k", "j", epoch.alias("epoch"), _permuted(F.expr("j % blocks"), F.col("blocks"), F.xxhash64("k", epoch, F.lit(seed))).alias("index"))
    times = slots.groupBy("k", "index").agg(F.count(F.lit(1)).alias("times"))
    pieces = placed.where("size > 0").select("doc_id", "k", "at", "size", "block", F.explode(F.expr("sequence(at div block, (at + size - 1) div block)")).alias("index"))
    overlap = F.expr("least(at + size, (index + 1) * block) - greatest(at, index * block)")
    taken = pieces.join(times, ["k", "index"]).groupBy("k", "at").agg(F.sum(overlap * F.col("times")).alias("taken"))
    # Only documents with words lie at a place of their own.
    spans = pieces.join(slots.select("k", "index", "epoch"), ["k", "index"]).select(
        "doc_id", "k", "at", "size", "epoch", (F.greatest("at", F.expr("index * block")) - F.col("at")).alias("low"), (F.least(F.expr("at + size"), F.expr("(index + 1) * block")) - F.col("at")).alias("high"))
    out = placed.withColumn("place", F.when(F.col("size") > 0, F.col("at"))).join(taken.select(F.col("k").alias("k2"), F.col("at").alias("place2"), "taken"), F.expr("k = k2 and place = place2"), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), slots, spans


def mixed(spark: SparkSession, df: DataFrame, seed: int = 1) -> DataFrame:
    """The mix as rows of the table itself (doc_id, text, source and any other columns).

    A document gives a row for each epoch in which words of it are taken; the row's text is those words in order, and
    n_chars, if there is such a column of whole numbers, its length. Rows of one doc_id take the places of their size one by one.
    """
    spans = mix(spark, df, seed)[2]
    side = ("k", "at", "size", "epoch", "low", "high")
    # The table's own columns travel in one, so that no name of theirs can clash.
    whole = F.struct(*[df[f"`{c}`"] for c in df.columns])
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("kind"), *[F.lit(None).cast("long").alias(c) for c in side], whole.alias("row"))
    pieces = spans.select("doc_id", F.lit(0).alias("kind"), *[F.col(c).cast("long").alias(c) for c in side], F.lit(None).cast(df.schema).alias("row"))
    parts = parts_for(spark, df)
    rows = texts.union(pieces).repartition(parts, "doc_id").sortWithinPartitions("doc_id", "kind")
    schema = to_arrow_schema(df.schema)
    counted = {f.name for f in schema if f.name == "n_chars" and pa.types.is_integer(f.type)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            last, used = None, set()
            for batch, t, found in attached_rows(batches, side):
                doc = batch.column("doc_id")[t].as_py()
                if last != doc:
                    last, used = doc, set()
                if not len(found["k"]):
                    continue
                row = batch.column("row")[t].as_py()
                words = (row["text"] or "").encode().split()
                mine = found["size"] == len(words)
                free = sorted({*zip(found["k"][mine].tolist(), found["at"][mine].tolist())} - used)
                if not free:
                    continue
                used.add(free[0])
                mine &= (found["k"] == free[0][0]) & (found["at"] == free[0][1])
                for epoch in np.unique(found["epoch"][mine]).tolist():
                    now = np.flatnonzero(mine & (found["epoch"] == epoch))
                    now = now[np.argsort(found["low"][now])]
                    text = b" ".join([w for a, b in zip(found["low"][now].tolist(), found["high"][now].tolist()) for w in words[a:b]]).decode()
                    new = {"text": text} | dict.fromkeys(counted, len(text))
                    yield tuple(new[c] if c in new else row[c] for c in schema.names)

        yield from in_batches(out(), schema)

    return rows.mapInArrow(handing_back(run), df.schema)
