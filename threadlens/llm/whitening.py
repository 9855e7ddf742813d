"""Whitening of embeddings (operator 12).

Entries become whole numbers x, so sums S are exact, and rows are centred exactly as n * x - S before anything is
multiplied. Spark MLlib's RowMatrix over the centred rows gives the Gramian, combined in a tree; divided by n it is the covariance,
whose eigenvectors are found on the driver, a matrix of dimension by dimension. The scaled vectors are broadcast, dimension by
components numbers, and rows are projected in batches. The covariance of what came out is measured in the same way.

Cases: vectors that are null or hold null or non-finite entries are left out; an empty vector has no components, so no rows;
vectors of different lengths (MOST_LENGTHS at most, else an error) are fitted apart; eigenvalues under NOISE of the largest
are zero in double precision (one vector, equal vectors, dimensions that depend on others), and their components are left out; equal
eigenvalues come in the order of the solver, the same for all rows; repeated rows and null ids count and are returned row by row;
an empty table gives an empty result; other columns are ignored. Whole numbers that a long does not hold raise an error, under ANSI
arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept

COMPONENTS, SCALE, SHIFT, NOISE, MOST_LENGTHS = 32, 64.0, 1_000_000, 1e-11, 16
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole and finite; x holds floor(SCALE * entry) + SHIFT."""
    entries = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), entries.alias("v")).where(F.col("v").isNotNull() & ~bad)
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(F.lit(SCALE) * c) + F.lit(SHIFT).cast("long")).alias("x"))


def gramian(rows: DataFrame, column: Column) -> np.ndarray:
    """Sum of the outer products of an array column's rows."""
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("row")), "row")).computeGramianMatrix().toArray()


def per_entry(rows: DataFrame, column: str, size: int, fold) -> list:
    """One aggregate for each entry of an array column, combined before it is moved."""
    return list(rows.agg(*[fold(F.col(column)[i]).alias(f"a{i}") for i in range(size)]).first())


def scaled_axes(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors over the square roots of their eigenvalues, by falling eigenvalue, and each one's share of the trace."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    there = values > NOISE * max(values[0], 0.0)
    values, vectors = values[there], vectors[:, there]
    return vectors / np.sqrt(values), values / np.trace(covariance)


def _of_length(spark: SparkSession, rows: DataFrame, n: int, size: int, most: int) -> DataFrame | None:
    """Rows of the result for n vectors of one length."""
    sums = per_entry(rows, "x", size, F.sum)
    exact = F.zip_with("x", F.lit(sums), lambda x, s: F.lit(n).cast("long") * x - s)
    centred = rows.select("vec_id", exact.alias("y"))
    covariance = gramian(centred, F.transform("y", lambda y: y / F.lit(float(n)))) / n
    axes, explained = scaled_axes(covariance, most)
    if not len(explained):
        return None
    sent = spark.sparkContext.broadcast(axes)

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"vec_id": f["vec_id"], "deviation": f["deviation"], "w": list(np.stack(f["y"].to_numpy()) / n @ sent.value)})

    deviation = F.aggregate("y", F.lit(0).cast("long"), lambda total, y: total + y * y)
    white = Kept(spark).keep("white", centred.withColumn("deviation", deviation).mapInPandas(project, "vec_id long, deviation long, w array<double>"))
    means = per_entry(white, "w", len(explained), F.avg)
    again = gramian(white, F.zip_with("w", F.lit(means), lambda w, m: w - m)) / n
    error = float(np.abs(again - np.eye(len(explained))).max())
    each = white.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.lit(explained.tolist())[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )


def components(spark: SparkSession, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Per vector and component: vec_id, component from 1 by falling eigenvalue, n, deviation (the exact sum of
    (n * x - S)^2), whitened, explained (its share of the variance) and identity_error (the largest entry of the covariance of whitened less the identity)."""
    rows = whole_numbers(df, id_col, vec_col)
    lengths = rows.groupBy(F.size("x").alias("size")).count().orderBy("size").limit(MOST_LENGTHS + 1).collect()
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    fitted = [_of_length(spark, rows.where(F.size("x") == r["size"]), r["count"], r["size"], most) for r in lengths if r["size"]]
    return reduce(DataFrame.unionAll, [f for f in fitted if f is not None], spark.createDataFrame([], SCHEMA))
