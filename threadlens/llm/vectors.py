"""Embedding near-dup by a subspace pigeonhole join (operator 4).

Unit vectors are turned by a fixed random rotation and split into blocks of few dimensions. Cosine >= t means a squared
distance of at most 2 - 2t, so in some block the squared distance is at most the block's share, which is proportional
to its dimensions. Each block is range-joined under its budget: slabs of its first coordinate, as wide as the radius,
with the next slab's border replicated; slabs of many vectors are cut into parts whose pairs are tasks. Candidates are
verified in double precision, and a pair counts in the one block where it uses the least of its budget, so the union
over blocks needs no pairs to be moved: tasks return counts and a spanning forest.

Cases: null, zero and non-finite vectors, and vectors with null components, link with nothing, nor do rows without an
id; vectors of different lengths do not link; equal vectors (by a 128-bit hash) are joined once and counted as often as
they occur; a cosine of exactly the threshold links; equal ids are rows of their own in the result and one node in the
links; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import Kept, blocked, connected_components, cuts_of, groups, handing_back, local_roots, parts_for, with_class

THRESHOLD, BLOCK_DIMS, TILE = 0.9, 16, 1024
#: Rows and bytes of a slab's part; linking pairs that a task holds before it counts them.
CAP, TASK_BYTES, PAIRS = 32_000, 64 << 20, 500_000


def rotation(dims: int) -> np.ndarray:
    """A fixed rotation of that many dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int, threshold: float) -> list[tuple[int, int, float]]:
    """(first, end, squared-distance budget) of each block."""
    cuts = np.linspace(0, dims, max(1, -(-dims // BLOCK_DIMS)) + 1).astype(int)
    return [(int(a), int(b), (2 - 2 * threshold) * (b - a) / dims) for a, b in zip(cuts, cuts[1:])]


def _unit(data: list[bytes], dims: int) -> np.ndarray:
    """Unit vectors in double precision of bodies that hold single or double components."""
    x = np.frombuffer(b"".join(data), f"<f{len(data[0]) // dims}").reshape(len(data), dims).astype("<f8", copy=False)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: Single-precision distances may be off by this much; what they let through is verified.
SLACK = 1e-4


def _place(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (dims,), table in groups(iter([batch]), ("dims",)):
                y = _unit(table["body"].to_pylist(), dims) @ rotation(dims)
                ids, body, weight = table["vec_id"].combine_chunks(), table["body"].combine_chunks(), table["weight"].combine_chunks()
                for k, (a, _, budget) in enumerate(blocks_of(dims, threshold)):
                    radius = np.sqrt(budget) + SLACK
                    slab = np.floor(y[:, a] / radius).astype(np.int64)
                    # As wide as the radius: a slab's partners are in it and in the next one, all of whose rows come too.
                    for at in (slab, slab - 1):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(y), dims)), pa.array(np.full(len(y), k)), pa.array(at), pa.array(at != slab), *(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (ids, weight, body))],
                            names=["dims", "block", "slab", "border", "vec_id", "weight", "body"],
                        )

    return run


def _pairs(x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, block: int, blocks: list[tuple[int, int, float]], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of left, row of right) that link and whose block this is; the same rows on both sides are paired once.

    Both sides come ordered by the block's first coordinate. One product of vectors with two more components each gives
    half the threshold's margin: a.b - |a|^2 / 2 - |b|^2 / 2.
    """
    a, b, budget = blocks[block]
    radius, same = np.sqrt(budget) + SLACK, left is right

    def widened(rows: np.ndarray, last: bool) -> np.ndarray:
        sub = y[rows, a:b].astype(np.float32)
        half, one = -(sub * sub).sum(axis=1, keepdims=True) / 2, np.ones((len(rows), 1), np.float32)
        return np.hstack([sub, one, half] if last else [sub, half, one])

    u, v = widened(left, False), np.ascontiguousarray(widened(right, True).T)
    first, other = y[left, a], y[right, a]
    for s in range(0, len(left), TILE):
        e = min(len(left), s + TILE)
        low = s if same else int(np.searchsorted(other, first[s] - radius, side="left"))
        high = int(np.searchsorted(other, first[e - 1] + radius, side="right"))
        for t in range(low, high, TILE):
            near = u[s:e] @ v[:, t : min(high, t + TILE)] >= -(budget + SLACK) / 2
            i, j = np.nonzero(near) if near.any() else (np.empty(0, np.int64),) * 2
            i, j = i + s, j + t
            if same:
                i, j = i[i < j], j[i < j]
            for c in range(0, len(i), 50_000):
                p, q = left[i[c : c + 50_000]], right[j[c : c + 50_000]]
                good = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                p, q = p[good], q[good]
                if len(p):
                    square = (y[p] - y[q]) ** 2
                    mine = np.stack([square[:, f:g].sum(axis=1) / w for f, g, w in blocks]).argmin(axis=0) == block
                    yield p[mine], q[mine]


class Links:
    """Weighted links of each row, and what the links join, counted a bounded number of pairs at a time."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.n, self.root = weight, np.zeros(len(weight)), np.arange(len(weight))
        self.held, self.size = [], 0

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        self.held.append((p, q))
        self.size += len(p)
        if self.size >= PAIRS:
            self.count()

    def count(self) -> None:
        if self.size:
            p, q = (np.concatenate(z) for z in zip(*self.held))
            rows = len(self.n)
            self.n += np.bincount(p, weights=self.weight[q], minlength=rows) + np.bincount(q, weights=self.weight[p], minlength=rows)
            self.root = local_roots(np.r_[p, np.arange(rows)], np.r_[q, self.root], rows)
        self.held, self.size = [], 0


def _join(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dims, block, _, i, j), table in groups(batches, ("dims", "block", "slab", "i", "j")):
            if table.num_rows < 2:
                continue
            x = _unit(table["body"].to_pylist(), dims)
            y = x @ rotation(dims)
            blocks = blocks_of(dims, threshold)
            ids, border, part = table["vec_id"].to_numpy(), table["border"].to_numpy(), table["part"].to_numpy()
            weight = table["weight"].to_numpy()
            # Ties are ordered by id, so that every task computes a pair the same way round.
            order = np.lexsort((ids, y[:, blocks[block][0]]))
            x, y, ids, border, part, weight = x[order], y[order], ids[order], border[order], part[order], weight[order]

            home = [np.flatnonzero(~border & (part == k)) for k in (i, j)]
            edge = [np.flatnonzero(border & (part == k)) for k in (i, j)]
            # Two vectors of the next slab are joined there, and two of one part in that part's own task.
            sides = [(home[0], home[0]), (home[0], edge[0])] if i == j else [(home[0], home[1]), (home[0], edge[1]), (edge[0], home[1])]
            links = Links(weight)
            for a, b in sides:
                for p, q in _pairs(x, y, a, b, block, blocks, threshold):
                    links.add(p, q)
            links.count()
            hit = np.flatnonzero(links.n)
            if not len(hit):
                continue
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, links.root, ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links.n[hit].astype(np.int64)), pa.array(least[links.root[hit]])], names=["vec_id", "n", "root"])

    return run


def near(spark: SparkSession, df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", cap: int = CAP) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    kept = Kept(spark)
    given = df.schema[vector_col].dataType
    single = isinstance(given, ArrayType) and isinstance(given.elementType, FloatType)
    vector = F.col(vector_col).cast("array<float>" if single else "array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = kept.keep("rows", rows.select("vec_id", F.when(F.coalesce(sound, F.lit(False)), F.col("v")).alias("v")))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                lists = [None if v is None else np.asarray(v, "<f8") + 0.0 for v in part.column("v").to_pylist()]  # -0 becomes 0
                # Squares of single-precision numbers are finite in double precision, so these are moved as they came;
                # others are scaled first, so that the squares of very large or small numbers stay finite.
                data = [None if v is None else (v.astype("<f4") if single else v / np.abs(v).max()).tobytes() for v in lists]
                sig = [None if d is None else xxhash.xxh3_128_intdigest(d) for d in data]
                halves = [pa.array([None if s is None else f(s) - (1 << 63) for s in sig], pa.int64()) for f in (lambda s: s >> 64, lambda s: s & ((1 << 64) - 1))]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([None if v is None else len(v) for v in lists], pa.int64()), *halves, pa.array(data, pa.binary())], names=["vec_id", "dims", "sig_a", "sig_b", "body"])

    whole = kept.keep("whole", rows.mapInArrow(handing_back(bodies), "vec_id long, dims long, sig_a long, sig_b long, body binary"))
    sound = F.col("body").isNotNull() & F.col("vec_id").isNotNull()
    keys = ["dims", "sig_a", "sig_b"]
    classes = whole.where(sound).groupBy(*keys).agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"), F.first("body").alias("body"))
    heads = kept.keep("heads", classes)
    kept.drop("rows")
    slabs = heads.select("vec_id", "dims", "weight", "body").mapInArrow(handing_back(_place(threshold)), "dims long, block long, slab long, border boolean, vec_id long, weight long, body binary")
    slab = ["dims", "block", "slab"]
    tasks = blocked(kept.keep("large", cuts_of(slabs, slab, cap, F.length("body"), TASK_BYTES)), slabs, slab, "vec_id")
    parts = max(parts_for(spark, heads), 64)
    found = tasks.repartition(parts, *slab, "i", "j").sortWithinPartitions(*slab, "i", "j").mapInArrow(handing_back(_join(threshold)), "vec_id long, n long, root long")
    found = kept.keep("found", found)
    components = connected_components(spark, found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), kept)
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    # Joined once a class, then to the vectors.
    per_class = heads.select(*keys, F.col("vec_id").alias("head"), "weight").join(counts.withColumnRenamed("vec_id", "head"), "head", "left").join(components.withColumnRenamed("id", "head"), "head", "left")
    per_class = kept.keep("classes", per_class.select(*keys, "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("component_id", "head").alias("component_id")))
    kept.drop_all_but("whole", "classes")
    bare = whole.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = with_class(whole.where(sound).select("vec_id", *keys), per_class, keys).select("vec_id", "n_links", "component_id").union(bare)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
