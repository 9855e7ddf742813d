"""Shared pieces: column selection, Arrow slicing, lineage cuts in the shared folder, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.state import shared_dir, shuffles_released

#: Words, in every contract here, are separated by space and U+0009 to U+000D, which is where bytes.split() cuts.
SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20


def pick(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """The needed columns only, under fixed names; whatever else the table holds cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c) for c in more])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds few rows and few bytes (one row at least)."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            part = np.cumsum(sizes[at : at + SLICE_ROWS])
            n = max(1, int(np.searchsorted(part, max_bytes, side="right")))
            yield batch.slice(at, n)
            at += n
        del batch  # not held while the next one is read


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, b"" for null; bytes.split() then yields exactly the contract's words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


class WordHashes:
    """64-bit hashes of words. Hashing a word anew takes half the time of finding it among many, and no memory."""

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


_MULT, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def gram_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words; empty with fewer words."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, np.uint64(k))
    for j in range(k):
        h = h * _MULT + word_hashes[j : j + n]
    return mix64(h)


def let_go() -> None:
    """Hand freed memory back to the system: workers outlive their tasks, and their neighbours need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library; its own thresholds hold
        pass


def handing_back(run: Callable) -> Callable:
    """run, a function for mapInArrow, that lets go of its task's memory when the task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            let_go()

    return whole


def arrow_map(df: DataFrame, fn: Callable, schema: str | StructType, column: str = "text", max_bytes: int = SLICE_BYTES, state: bool = False) -> DataFrame:
    """mapInArrow of fn, from a batch to batches, over small slices; with state, fn() makes that function in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = fn() if state else fn
        for part in slices(batches, column, max_bytes):
            yield from one(part)
            del part

    return df.mapInArrow(handing_back(run), schema)


class Kept:
    """Tables written to the shared folder to cut lineage; drop() removes those no longer needed.

    A result still reads the last of them, so they stay in their cut-* folder until the run's shared folder is cleared.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.paths = spark, f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}", {}

    def keep(self, name: str, df: DataFrame, parts: tuple[str, ...] = ()) -> DataFrame:
        path = self.paths[name] = f"{self.base}/{name}"
        with shuffles_released(self.spark):
            df.write.partitionBy(*parts).option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*[n for n in self.paths if n not in names])

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)


def parts_for(spark: SparkSession, df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Partitions for a shuffle of about the input's size: at least the session's, more as the input grows.

    The size is Catalyst's estimate, known without a job; a plan without one reports an absurd size, a petabyte or more.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // bytes_each if size < 1 << 50 else 0)


def connected_components(spark: SparkSession, edges: DataFrame, kept: Kept | None = None) -> DataFrame:
    """(id, component_id) for every id on an edge (a, b): component_id is the smallest id reachable.

    Alternating large-star and small-star steps, each round written to the shared folder. The minimum of a node is combined
    before the shuffle; where it is joined back, a hub's edges are split by the adaptive skew join, both sides being read
    from a shuffle of their own.
    """
    kept = kept or Kept(spark)
    now = kept.keep("cc0", edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    turn = 0
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        turn += 1
        after = kept.keep(f"cc{turn}", small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        # A fixed point is a star forest: every node has one edge, to a centre that has no smaller neighbour.
        stars = after.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() == 0
        if stars and after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count() == 0:
            kept.drop(f"cc{turn - 1}")
            centres = after.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
            return after.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(centres)
        kept.drop(f"cc{turn - 1}")
        now = after


def attached_rows(batches: Iterator[pa.RecordBatch], side: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, int, dict[str, np.ndarray]]]:
    """(batch, row number, side columns) for each text row of a stream sorted by (doc_id, kind).

    Rows of kind 0 carry side columns of their document and come before its text rows, of kind 1. Only one document's
    side rows are held between batches.
    """
    held, held_key = {c: np.empty(0, np.int64) for c in side}, None
    for batch in batches:
        key = np.asarray(pa.compute.fill_null(batch.column("doc_id"), -(1 << 63)))
        small = batch.column("kind").to_numpy(zero_copy_only=False) == 0
        columns = {c: np.asarray(pa.compute.fill_null(batch.column(c), 0)) for c in side}
        if not len(key):
            continue
        for t in np.flatnonzero(~small).tolist():
            lo = int(np.searchsorted(key, key[t], side="left"))
            here = np.flatnonzero(small[lo:t]) + lo
            rows = {c: v[here] for c, v in columns.items()}
            if held_key == key[t]:
                rows = {c: np.concatenate([held[c], v]) for c, v in rows.items()}
            yield batch, t, rows
        lo = int(np.searchsorted(key, key[-1], side="left"))
        here = np.flatnonzero(small[lo:]) + lo
        same = held_key == key[-1]
        held = {c: np.concatenate([held[c], v[here]]) if same else v[here] for c, v in columns.items()}
        held_key = key[-1]


def attached(batches: Iterator[pa.RecordBatch], side: tuple[str, ...]) -> Iterator[tuple[int | None, bytes, dict[str, np.ndarray]]]:
    """(doc_id, text, side columns) of attached_rows()."""
    for batch, t, rows in attached_rows(batches, side):
        yield batch.column("doc_id")[t].as_py(), (batch.column("text")[t].as_py() or "").encode(), rows


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of a stream of tuples."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if len(held) >= size or n >= max_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


#: Rows of packed_keys().
KEYS = "key long, doc long, more binary, salt int"
#: Documents of a key in one batch beyond which all but two go around the key's partition, and the most in one such row.
ASIDE, ASIDE_ROW = 16, 1024


def meetings(kept: Kept, name: str, keys: DataFrame, parts: int) -> DataFrame:
    """From rows of packed_keys() the rows (key, doc, first) of every key that two documents or more share.

    first is the key's smallest document. It is found in two steps: the rows of salt 0, at most a few ids of a key from each
    map-side batch, meet in the key's partition, which is sorted and streamed, so a key of any frequency needs no memory.
    Rows of other salts hold the many other documents of a frequent key; they are spread over all partitions, and learn the
    key's first from a join. The table `name` is kept and may be dropped once the result has been written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_first = None
        shared, held = False, None  # whether the last key's rows are being passed on; its one row if not yet
        names = ["key", "doc", "first", "more"]
        for batch in batches:
            salted = pa.compute.greater(batch.column("salt"), 0)
            aside, batch = batch.filter(salted), batch.filter(pa.compute.invert(salted))
            if aside.num_rows:
                yield pa.RecordBatch.from_arrays([aside.column("key"), aside.column("doc"), pa.nulls(aside.num_rows, pa.int64()), aside.column("more")], names=names)
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy(zero_copy_only=False)
            doc = batch.column("doc").to_numpy(zero_copy_only=False)
            more = batch.column("more").to_pylist() if batch.column("more").null_count < batch.num_rows else None
            if held is not None:
                key, doc, more = np.r_[held[0], key], np.r_[held[1], doc], ([None] + more if more is not None else None)
            start = np.r_[True, key[1:] != key[:-1]]
            at = np.flatnonzero(start)
            run_of = np.cumsum(start) - 1
            first = doc[at].copy()
            ends = np.r_[at[1:], len(key)]
            several = doc[ends - 1] != first  # sorted by doc within a key
            if more is not None:
                several[[run_of[i] for i, m in enumerate(more) if m]] = True
            if held is None and last_key is not None and key[0] == last_key:
                first[0], several[0] = last_first, True
            last_key, last_first, shared = key[-1], first[-1], bool(several[-1])
            held = None if shared else (key[-1], doc[-1])
            pick_ = several[run_of]
            k, d, f = key[pick_], doc[pick_], first[run_of][pick_]
            if more is not None:
                extra = [(key[i], first[run_of[i]], np.frombuffer(m, np.int64)) for i, m in enumerate(more) if m]
                if extra:
                    sizes = [len(e[2]) for e in extra]
                    k = np.r_[k, np.repeat([e[0] for e in extra], sizes)]
                    f = np.r_[f, np.repeat([e[1] for e in extra], sizes)]
                    d = np.r_[d, np.concatenate([e[2] for e in extra])]
            for i in range(0, len(k), 100_000):
                part = [pa.array(v[i : i + 100_000]) for v in (k, d, f)]
                yield pa.RecordBatch.from_arrays([*part, pa.nulls(len(part[0]), pa.binary())], names=names)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "more", 4 << 20):
            sizes = np.asarray(pa.compute.binary_length(batch.column("more"))) // 8
            key, first = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("key", "first"))
            doc = np.frombuffer(b"".join(batch.column("more").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(first)], names=["key", "doc", "first"])

    spread = keys.repartition(parts, "key", "salt").sortWithinPartitions("salt", "key", "doc")
    found = kept.keep(name, spread.mapInArrow(handing_back(run), "key long, doc long, first long, more binary"))
    met, aside = found.where("more is null").select("key", "doc", "first"), found.where("more is not null").select("key", "more")
    # A key whose documents went aside has two in its own partition, so that its first is among the rows met there.
    firsts = met.where("doc = first").join(aside.select("key").distinct(), "key", "left_semi").select("key", "first").distinct()
    return met.union(aside.join(firsts, "key").mapInArrow(handing_back(unpack), "key long, doc long, first long"))


def packed_keys(key: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """Rows (key, doc, more, salt) for meetings(): of salt 0, one per key of the batch, with its smallest document and the others.

    Of a key with more than ASIDE others, all but one go in rows of their own, of other salts.
    """
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    ends = np.r_[at[1:], len(key)].astype(np.int64)
    more, aside = [None] * len(at), []
    for i in np.flatnonzero(ends - at > 1).tolist():
        others = doc[at[i] + 1 : ends[i]]
        if len(others) <= ASIDE:
            more[i] = others.tobytes()
            continue
        more[i] = others[:1].tobytes()
        for s in range(1, len(others), ASIDE_ROW):
            aside.append((at[i], others[s : s + ASIDE_ROW].tobytes(), 1 + int(others[s]) % 1021))
    rows = np.r_[at, np.array([a for a, _, _ in aside], np.int64)]
    salt = np.r_[np.zeros(len(at), np.int32), np.array([s for _, _, s in aside], np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(doc[rows]), pa.array(more + [m for _, m, _ in aside], pa.binary()), pa.array(salt, pa.int32())], names=["key", "doc", "more", "salt"])


def cuts_of(rows: DataFrame, keys: list[str], cap: int, size: Column | None = None, most: int = 1) -> DataFrame:
    """keys and cuts of the groups of more than `cap` rows or more than `most` bytes, by the size of a row."""
    cuts = F.greatest(F.ceil(F.count(F.lit(1)) / cap), F.ceil(F.sum(size if size is not None else F.lit(0)) / most))
    return rows.groupBy(*keys).agg(cuts.cast("int").alias("cuts")).where("cuts > 1")


def blocked(large: DataFrame, rows: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """rows with part, i, j: a group in `large` is cut into its number of parts, and each pair of parts becomes a task.

    A row goes to the tasks (i, j), i <= j, that its part takes part in; a pair of rows meets in exactly one of them.
    """
    cut = rows.join(large, keys, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("cuts")), F.lit(0)).cast("int"))
    cut = cut.withColumn("other", F.explode(F.expr("sequence(0, coalesce(cuts, 1) - 1)")))
    return cut.select("*", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).drop("cuts", "other")


#: A class with more than this share of all rows is joined by broadcast: there are fewer such classes than its inverse.
HOT_SHARE = 1e-4


def with_class(rows: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of their class, each row having one; classes are unique by keys and carry their weight in rows.

    The largest classes, at most 1 / HOT_SHARE, are broadcast and their rows not moved; the others' keys are small.
    """
    total = classes.agg(F.sum("weight")).first()[0] or 0
    hot = F.broadcast(classes.where(F.col("weight") > max(2, total * HOT_SHARE)))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(classes, keys))


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each group of a stream sorted by the keys."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        edge = np.zeros(batch.num_rows, bool)
        edge[0] = True
        for c in columns:
            edge[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(edge).tolist()
        for a, b in zip(at, [*at[1:], batch.num_rows]):
            here = tuple(c[a].item() for c in columns)
            if here != key:
                if held:
                    yield key, pa.Table.from_batches(held).combine_chunks()
                held, key = [], here
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1, the smallest node each is joined to by the links (a, b)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if np.array_equal(low, root):
            return root
        root = low
