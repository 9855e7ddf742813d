"""Nearest neighbours by cells against all distances."""

import numpy as np
from pyspark.sql import functions as F

from threadlens.operators import cells


def brute(rows, queries, k):
    ids, m = np.array([i for i, v in rows if v is not None]), np.array([v for _, v in rows if v is not None])
    out = []
    for q, v in queries:
        d = np.round(np.sqrt(((m - np.array(v)) ** 2).sum(1)), 9)
        out += [(q, int(ids[b]), float(d[b]), r) for r, b in enumerate(np.lexsort((ids, d))[:k])]
    return out


def test_cells(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    hubs = rnd.normal(size=(12, 8)) * 4
    rows = [(i, (hubs[i % 12] + rnd.normal(size=8) * 0.3).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(70)] + [(3000, None)]
    queries = [(i, v) for i, v in rows if v is not None and i % 100 == 0] + [(9001, (hubs[0] * 50).tolist()), (9002, [0.0] * 8)]
    monkeypatch.setattr(cells, "PART", 40)
    monkeypatch.setattr(cells, "QUERIES", 2)
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("v", "cell", "part")})
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    made = cells.build(spark, df, 30)
    assert made.sizes.sum() == 1570 and len(made.sizes) == 30
    for k in (1, 10, 60):
        got, read = cells.nearest(spark, made, asked, k)
        assert sorted((r.query_id, r.chunk_id, r.dist, r.rank) for r in got.collect()) == sorted(brute(rows, queries, k))
        assert read["pairs"] == 30 * len(queries) and (k > 10 or read["read"] < read["pairs"] / 3), read
    few = df.limit(0), df.where("chunk_id = 3000"), df.where("chunk_id = 5")
    for some, n in zip(few, (0, 0, len(queries))):
        got, _ = cells.nearest(spark, cells.build(spark, some), asked, 10)
        assert got.count() == n
