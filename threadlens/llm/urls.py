"""URL filter: rules first, then a character language-model ratio (operator 5).

Two variable-order Markov models (orders 0 to ORDER, Witten-Bell interpolation) are counted over all URLs that the rules
accept or reject. Counts are exact: a gram of order k is its k + 1 bytes, and the tables are Spark tables that grow with
the distinct grams; nothing of the model is gathered or broadcast. The log ratio of a character depends on its gram of
the highest order only, so it is worked out once a gram, order by order, and each chunk of URLs fetches by join the
ratios of its distinct grams. A URL's score is the mean ratio of its characters; the threshold is calibrated on a
held-out fold of the labelled URLs, over all of its rows; if no fold can be held out, on all of them.

Cases: a URL of any length is counted and scored whole; a score of exactly the threshold is allowed; a null URL or one
without "://" has an empty host and path, fits no rule and is scored by its text (an empty one scores 0); repeated rows
are judged alike; without labelled rows of both kinds the method allows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, groups, handing_back, parts_for

#: Fixed values: (verdict, host, path) of the rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
ORDER, FOLDS, BINS, SPAN = 4, 5, 4096, 8.0
#: URLs that fetch their ratios together.
CHUNK = 5000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract has them; both empty without "://"."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(df: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, url, host, path, rule and ruled (its verdict) by the longest rule that fits."""
    host, path = parts(F.col("url"))
    rows = df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer rule wraps the shorter ones
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rows.withColumns({"rule": rule, "ruled": verdict})


def _grams(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """URL number and gram of each character: its bytes and those of the ORDER characters before, as one number."""
    data = [(u or "").encode() for u in urls]
    pad = b"\0" * ORDER
    x = np.frombuffer(b"".join(pad + d + b"\1" for d in data), np.uint8).astype(np.int64)
    sizes = np.array([len(d) + 1 + ORDER for d in data], np.int64)
    owner = np.repeat(np.arange(len(data)), sizes)
    real = np.ones(len(x), bool)
    starts = np.cumsum(sizes) - sizes
    for k in range(ORDER):
        real[starts + k] = False
    at = np.flatnonzero(real)
    gram = np.zeros(len(at), np.int64)
    for k in range(ORDER, -1, -1):
        gram = (gram << 8) | x[at - k]
    return owner[at], gram


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per distinct gram of a batch, how often each class has it; rows of no class (-1) name theirs with counts of 0."""
    for batch in batches:
        owner, gram = _grams(batch.column("url").to_pylist())
        cls = batch.column("cls").to_numpy()[owner]
        keys, at = np.unique(gram, return_inverse=True)
        n = [np.bincount(at[cls == c], minlength=len(keys)) for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n[0]), pa.array(n[1])], names=["g", "n0", "n1"])


def _ratios(grams: DataFrame) -> DataFrame:
    """(g, ratio): log likelihood under the accepted class less that under the rejected one, of each gram of order ORDER.

    A gram has at most 256 neighbours by its context or by its suffix, so no key of these joins is large.
    """
    last = None
    for k in range(ORDER + 1):
        mask = F.lit((1 << 8 * (k + 1)) - 1).cast("long")
        rows = grams.groupBy(F.col("g").bitwiseAND(mask).alias("g")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).withColumn("ctx", F.shiftright("g", 8))
        context = rows.groupBy("ctx").agg(*[f(c) for c in (0, 1) for f in (lambda c: F.sum(f"n{c}").alias(f"all{c}"), lambda c: F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"kinds{c}"))])
        rows = rows.join(context, "ctx")
        if last is None:
            rows = rows.withColumns({"p0": F.lit(1 / 256), "p1": F.lit(1 / 256)})
        else:
            rows = rows.withColumn("suffix", F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long"))).join(last.withColumnRenamed("g", "suffix"), "suffix")
        p = [F.when(F.col(f"all{c}") > 0, (F.col(f"n{c}") + F.col(f"kinds{c}") * F.col(f"p{c}")) / (F.col(f"all{c}") + F.col(f"kinds{c}"))).otherwise(F.col(f"p{c}")) for c in (0, 1)]
        last = rows.select("g", p[0].alias("p0"), p[1].alias("p1"))
    return last.select("g", (F.log(F.greatest("p1", F.lit(1e-12))) - F.log(F.greatest("p0", F.lit(1e-12)))).alias("ratio"))


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct grams of each chunk of URLs (again if a chunk is cut by batches)."""
    for (chunk,), table in groups(batches, ("chunk",)):
        g = np.unique(_grams(table["url"].to_pylist())[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), chunk)), pa.array(g)], names=["chunk", "g"])


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, table in groups(batches, ("chunk",)):
        told = pc.is_null(table["url"])
        told_rows, urls = table.filter(told), table.filter(pc.invert(told))["url"].to_pylist()
        g, ratio = told_rows["g"].to_numpy(), told_rows["ratio"].to_numpy()
        order = np.argsort(g, kind="stable")
        owner, gram = _grams(urls)
        values = ratio[order][np.searchsorted(g[order], gram)]
        scores = np.bincount(owner, weights=values, minlength=len(urls)) / np.bincount(owner, minlength=len(urls))
        yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(scores)], names=["url", "score"])


def scored(spark: SparkSession, kept: Kept, labelled: DataFrame) -> DataFrame:
    """(url, score) of each distinct URL of rows (url, cls): 0 rejected, 1 accepted, -1 only to be scored."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = labelled.where("url <> ''")
    ratios = _ratios(kept.keep("grams", some.mapInArrow(handing_back(_count), "g long, n0 long, n1 long").groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))))
    urls = kept.keep("urls", some.select("url").distinct().select("url", F.floor(F.monotonically_increasing_id() / CHUNK).alias("chunk")))
    told = urls.mapInArrow(handing_back(_wanted), "chunk long, g long").join(ratios, "g").select("chunk", "g", "ratio", F.lit(None).cast("string").alias("url"))
    both = told.union(urls.select("chunk", F.lit(None).cast("long"), F.lit(None).cast("double"), "url"))
    return kept.keep("scores", both.repartition(max(parts, parts_for(spark, urls)), "chunk").sortWithinPartitions("chunk").mapInArrow(handing_back(_score), "url string, score double"))


def cut_off(scores: DataFrame) -> float | None:
    """The threshold by rows (cls, score): least balanced error; none unless both classes have rows."""
    at = F.floor((F.col("score") + SPAN) * (BINS / (2 * SPAN)))
    hist = np.zeros((2, BINS))
    for r in scores.groupBy("cls", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), at)).alias("bin")).count().collect():
        hist[r["cls"], r["bin"]] += r["count"]
    if not hist.sum(1).min() > 0:
        return None
    # Least balanced error of "allow from this bin on"; the middle of equally good bins.
    miss = np.r_[0, np.cumsum(hist[1])] / hist[1].sum() + 1 - np.r_[0, np.cumsum(hist[0])] / hist[0].sum()
    best = np.flatnonzero(miss <= miss.min() + 1e-12)
    return float(best[len(best) // 2] * 2 * SPAN / BINS - SPAN)


def held_out(labelled: DataFrame) -> int | None:
    """The first fold that has rows of both classes and leaves some of both; none if no fold does."""
    n = np.zeros((FOLDS, 2), np.int64)
    for r in labelled.where("cls >= 0").groupBy("fold", "cls").count().collect():
        n[r["fold"], r["cls"]] = r["count"]
    fit = np.flatnonzero(((n > 0) & (n < n.sum(axis=0))).all(axis=1))
    return int(fit[0]) if len(fit) else None


def judge(spark: SparkSession, df: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the method's score for every row."""
    kept, ruled = Kept(spark), with_rules(df, rules)
    cls, fold = F.coalesce((F.col("ruled") == "allow").cast("long"), F.lit(-1).cast("long")), F.pmod(F.xxhash64("url"), F.lit(FOLDS))
    labelled = ruled.select("url", cls.alias("cls"), fold.alias("fold"))
    fold = held_out(labelled)
    held = F.lit(True) if fold is None else F.col("fold") == fold
    scores = scored(spark, kept, labelled.select("url", F.when(held & F.lit(fold is not None), -1).otherwise(F.col("cls")).cast("long").alias("cls")))
    threshold = cut_off(labelled.where(held & (F.col("cls") >= 0)).join(scores, "url"))
    said = F.lit("allow") if threshold is None else F.when(F.col("score") >= threshold, "allow").otherwise("block")
    rows = ruled.join(scores, "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", said).alias("verdict"), "score")
