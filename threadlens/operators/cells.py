"""Vector cells: nearest neighbours that skip cells by the triangle inequality, exactly.

Centres come from k-means over a bounded sample; every vector goes to its nearest centre and keeps its distance to it. A
cell is a ball of known radius, so no member is nearer to a query than their distance less the radius, and no member
nearer than the difference of the two distances to the centre. The k-th distance from the nearest cells decides what else is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.state import written

#: Rows that the centres are fitted on, those of the smallest id hashes; cells at most; rows of a cell, and queries, that meet in one task.
FIT_ROWS, MOST_CELLS, PART, QUERIES = 50_000, 4096, 20_000, 2_000
#: What rounding may add to or take from a distance.
SLACK = 2e-9


@dataclass
class Cells:
    """members: (cell, part, chunk_id, to_centre, v); centres, radii, sizes and parts are by cell, on the driver, MOST_CELLS at most."""

    members: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    #: (cell, chunk_id, to_centre, v, kept columns) as they were placed.
    placed: DataFrame | None = None

    @property
    def parts(self) -> np.ndarray:
        return -(-self.sizes // PART)


def _distances(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    """From each row of m to v, from differences, so that equal vectors are at 0."""
    d = m - v
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def build(spark: SparkSession, vectors: DataFrame, cells: int | None = None, seed: int = 1, keep: str = "") -> Cells:
    """Cells of (chunk_id, embedding), and a whole-number column to keep; about the square root of the rows, if not given. Null vectors are left out."""
    rows = vectors.where("embedding is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("v"), *([F.col(keep).cast("int")] if keep else []))
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(FIT_ROWS).select(array_to_vector("v").alias("features"))
    wanted = min(cells or max(1, round(n**0.5)), MOST_CELLS, max(n, 1))
    if not n:
        return Cells(rows.select(F.lit(0).alias("cell"), F.lit(0).alias("part"), "chunk_id", F.lit(0.0).alias("to_centre"), "v"), np.empty((0, 0)), np.empty(0), np.empty(0, np.int64))
    centres = np.array(KMeans(k=wanted, maxIter=5, seed=seed).fit(sample).clusterCenters()) if wanted > 1 else np.array([sample.first()[0].toArray()])
    sent = spark.sparkContext.broadcast(centres)  # MOST_CELLS rows at most

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cell, far = [], []
            for v in f["v"]:
                d = _distances(sent.value, np.asarray(v))
                cell.append(int(d.argmin()))
                far.append(float(d.min()))
            yield f.assign(cell=cell, to_centre=far)

    return of_placed(written(rows.mapInPandas(assign, "chunk_id long, v array<double>, " + f"{keep} int, " * bool(keep) + "cell int, to_centre double"), "cells"), centres)


def of_placed(placed: DataFrame, centres: np.ndarray) -> Cells:
    """Cells of rows that have theirs: radii and sizes are those of the rows given."""
    found = {r.cell: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("to_centre").alias("radius")).collect()}  # a row a cell
    sizes = np.array([found[c].n if c in found else 0 for c in range(len(centres))], np.int64)
    radii = np.array([found[c].radius if c in found else 0.0 for c in range(len(centres))])
    out = Cells(placed, centres, radii, sizes, placed)
    parts = F.element_at(F.lit(np.maximum(out.parts, 1).tolist()), F.col("cell") + 1)
    out.members = placed.select("cell", F.pmod(F.xxhash64("chunk_id"), parts).cast("int").alias("part"), "chunk_id", "to_centre", "v")
    return out


def _meet(pairs: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(query_id, chunk_id, dist): of each pair of a query and a cell's part, the k nearest members within the query's reach."""
    counts = {r["cell"]: r["count"] for r in pairs.groupBy("cell").count().collect()}  # a row a cell
    blocks = [max(1, -(-counts.get(c, 0) // QUERIES)) for c in range(len(cells.sizes))]
    of_cell = lambda values: F.element_at(F.lit([int(v) for v in values]), F.col("cell") + 1)
    asked = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), of_cell(np.maximum(cells.parts, 1)) - 1))).withColumn("block", F.pmod(F.xxhash64("query_id"), of_cell(blocks)).cast("int"))
    some = cells.members.where(F.col("cell").isin(sorted(counts)))  # the other cells' vectors do not move
    held = some.withColumn("block", F.explode(F.sequence(F.lit(0), of_cell(blocks) - 1)))

    def nearest(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            ids, m, far = rows["chunk_id"].to_numpy(), np.stack(rows["v"].to_numpy()), rows["to_centre"].to_numpy()
            for q, v, d, reach in zip(queries["query_id"], queries["v"], queries["d"], queries["reach"]):
                near = np.flatnonzero(np.abs(far - d) <= reach + SLACK)
                dist = np.round(_distances(m[near], np.asarray(v)), 9)
                near, dist = near[dist <= reach + SLACK], dist[dist <= reach + SLACK]
                best = np.lexsort((ids[near], dist))[:k]
                out += [(q, int(ids[near[b]]), float(dist[b])) for b in best]
        return pd.DataFrame(out, columns=["query_id", "chunk_id", "dist"])

    keys = ["cell", "part", "block"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(nearest, "query_id long, chunk_id long, dist double")


def nearest(spark: SparkSession, cells: Cells, queries: DataFrame, k: int = 50) -> tuple[DataFrame, dict[str, int]]:
    """(query_id, chunk_id, dist, rank) of the k nearest to each (query_id, embedding), ties by chunk_id, ranks from 0; and how many pairs of a
    query and a cell there are and were read."""
    asked = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    if not len(cells.sizes):
        return asked.select("query_id", F.lit(0).cast("long").alias("chunk_id"), F.lit(0.0).alias("dist"), F.lit(0).alias("rank")).where(F.lit(False)), {"pairs": 0, "read": 0}
    sent = spark.sparkContext.broadcast((cells.centres, cells.radii, cells.sizes))

    def reachable(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cells that may hold one of a query's k nearest: the first ones hold k members, all within `most`."""
        centres, radii, sizes = sent.value
        for f in frames:
            for q, v in zip(f["query_id"], f["v"]):
                d = _distances(centres, np.asarray(v))
                order = np.argsort(d, kind="stable")
                first = order[: int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1]
                most = (d + radii)[first].max() if sizes.sum() >= k else np.inf
                some = np.flatnonzero((d - radii <= most + SLACK) & (sizes > 0))
                yield pd.DataFrame({"query_id": q, "v": [v] * len(some), "cell": some, "first": np.isin(some, first), "d": d[some], "low": (d - radii)[some], "reach": most})

    pairs = written(asked.mapInPandas(reachable, "query_id long, v array<double>, cell int, first boolean, d double, low double, reach double"), "pairs")
    start = written(_meet(pairs.where("first"), cells, k), "near")
    best = lambda rows: rows.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "chunk_id"))), 1, k).alias("near"))  # noqa: E731  k rows a part at most
    reach = best(start).select("query_id", F.when(F.size("near") >= k, F.element_at("near", -1)["dist"]).alias("kth"))
    more = pairs.where("not first").join(reach, "query_id", "left").withColumn("reach", F.least("reach", F.coalesce("kth", "reach"))).where(F.col("low") <= F.col("reach") + SLACK).drop("kth")
    more = written(more, "more")
    rows = best(start.unionByName(_meet(more, cells, k)))
    counts = {"pairs": asked.count() * int((cells.sizes > 0).sum()), "read": pairs.where("first").count() + more.count()}
    return rows.select("query_id", F.posexplode("near").alias("rank", "p")).select("query_id", "p.chunk_id", "p.dist", "rank"), counts
