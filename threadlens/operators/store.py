"""Tables on plain Parquet with replace-by-key semantics, committed together.

Files are never changed. A manifest names the files of every table, and a commit is the creation of the next manifest, which
only one writer can create: readers see all of a run or nothing of it, whenever it ends. Rows lie in buckets by the hash of
their session (of their path, for files), and a run writes the buckets it touches and no others. Postings are kept in segments,
newest last: a run adds one segment and the ids of the chunks it replaced, and segments of like size are merged.
The merges of rows are DataFrame operations, so each is one join by key.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import truncate
from ..schemas import BUCKET_KEYS, KEYS, PROVIDER_A, SEGMENTS, TABLES
from ..sources.state import shuffles_released, written
from . import blocks, cells, search
from .usage import session_cost


class Conflict(Exception):
    """Another run has changed what this one read; its files are left behind and nothing has happened."""


class Store:
    """Tables below a folder of any Hadoop file system; made by a newer version of this code, they are refused.

    `buckets` counts when the first manifest is written; a bucket should hold what one task or a few can write.
    """

    #: 2: postings and lengths beside the chunks. 3: manifests, buckets and segments.
    VERSION = 3
    #: Manifests that stay for readers that have begun.
    KEEP = 2

    def __init__(self, spark: SparkSession, base: str, buckets: int = 64):
        self.spark, self.base, self._new_buckets = spark, base.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._path, self._conf = self._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.base).getFileSystem(self._conf)
        if (made := self.version()) > self.VERSION:
            raise ValueError(f"the store is of version {made}, this code reads up to {self.VERSION}")
        if 0 < made < 3:
            raise ValueError(f"the store is of version {made}, which has no manifests: ingest into a new folder")

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.base}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def version(self) -> int:
        """The largest version stamped, 0 in a new store; columns that older files lack read as null."""
        found = self._fs.globStatus(self._path(f"{self.base}/_version-*")) or []
        return max((int(s.getPath().getName().rsplit("-", 1)[1]) for s in found), default=0)

    @contextmanager
    def lock(self, lease: float = 6 * 3600) -> Iterator[bool]:
        """Whether this run is the one writer: a file that only one can create. A lock older than the lease is a dead run's.

        It is taken over by the one run that creates the file named after that very lock. The lock spares work that would
        be thrown away; that results are right is the commit's concern.
        """
        path, taken = self._path(f"{self.base}/_lock"), None
        if self._fs.exists(path) and (made := self._fs.getFileStatus(path).getModificationTime()) < (time.time() - lease) * 1000:
            taken = self._path(f"{self.base}/_taken-{made}")
            if self._fs.createNewFile(taken):
                self._fs.delete(path, False)
        held = self._fs.createNewFile(path)
        try:
            yield held
        finally:
            if held:
                self._fs.delete(path, False)
                if taken is not None:
                    self._fs.delete(taken, False)

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(f"{self.base}/{path}"), True)

    def manifest(self, number: int | None = None) -> dict:
        """The latest manifest, or that of a number."""
        if number is None:
            number = max((int(n.split(".")[0]) for n in self._names("_manifests") if n.endswith(".json") and n[0] != "."), default=0)
        if not number:
            return {"number": 0, "buckets": self._new_buckets, "tables": {}, "segments": [], "dead": [], "sequence": 0}
        stream = self._fs.open(self._path(f"{self.base}/_manifests/{number:012}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _create(self, manifest: dict) -> bool:
        """Whether the manifest was written under its number; False if another run was first. It appears whole or not at all."""
        new, path = self._path(f"{self.base}/_manifests/.new-{uuid.uuid4().hex}"), self._path(f"{self.base}/_manifests/{manifest['number']:012}.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # a rename would replace; a link does not
                at = lambda p: self._jvm.java.nio.file.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0))
                self._jvm.java.nio.file.Files.createLink(at(path), at(new))
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
                context.rename(self._fs.makeQualified(new), self._fs.makeQualified(path), self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.toString()):
                raise
            return False
        finally:
            self._fs.delete(new, False)

    def begin(self) -> "Transaction":
        return Transaction(self)

    def read(self, table: str) -> DataFrame:
        """A table as the latest manifest has it."""
        return self.begin().read(table)

    def postings(self) -> tuple[DataFrame, DataFrame]:
        """(term blocks, lengths) of the chunks that live."""
        return self.begin().postings()

    def write(self, table: str, df: DataFrame) -> None:
        """The whole table anew, in a commit of its own."""
        self.commit(lambda run: run.replace(table, df))

    def commit(self, work: Callable[["Transaction"], object], tries: int = 3) -> object:
        """Do the work on what is there and commit it, again from the start if another run changes what it read."""
        for left in reversed(range(tries)):
            run = self.begin()
            try:
                out = work(run)
                run.commit()
                return out
            except Conflict:
                if not left:
                    raise
            finally:
                run.clear()

    def sweep(self, older: float = 24 * 3600) -> int:
        """Delete files that no kept manifest names, of runs that ended without a commit; younger ones may still be committed."""
        kept = {f.split("/", 3)[2] for n in self._names("_manifests") if n[0] != "." and n.endswith(".json") for f in files_of(self.manifest(int(n.split(".")[0])))}
        gone = 0
        for table in self._names("data"):
            for run in self._names(f"data/{table}"):
                age = time.time() - self._fs.getFileStatus(self._path(f"{self.base}/data/{table}/{run}")).getModificationTime() / 1000
                if run not in kept and age >= older:
                    self.delete(f"data/{table}/{run}")
                    gone += 1
        return gone


def files_of(manifest: dict) -> set[str]:
    """Every folder that a manifest names, as data/table/run[/bucket=k]."""
    tables = {f for t in manifest["tables"].values() for f in t.values()}
    return tables | {s[k] for s in manifest["segments"] for k in ("blocks", "lengths")} | {d["path"] for d in [*manifest["dead"], *manifest.get("cells", {}).values()]}


class Transaction:
    """What one run reads, all from one manifest, and writes; commit() makes its writes the next manifest."""

    #: Segments of like size that are merged into one.
    MERGE = 4
    #: Postings that a merge moves at a time, about, and times that it reads the segments for that at most.
    SLICE_ROWS, SLICES = 8_000_000, 8

    def __init__(self, store: Store):
        self.store, self.spark, self.base, self.seen = store, store.spark, store.base, store.manifest()
        self.run, self.buckets = uuid.uuid4().hex, self.seen["buckets"]
        self.tables: dict[str, dict[str, str]] = {}  # what was written: folders by bucket
        self.touched: dict[str, set[str]] = {}
        self.segments: list[dict] = []
        self.merged: list[str] = []
        self.dead: dict | None = None
        self.cells: dict[str, dict] = {}

    def bucket(self, table: str, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(key or BUCKET_KEYS[table]).cast("string")), F.lit(self.buckets)).cast("int")

    def buckets_of(self, table: str, rows: DataFrame, key: str | None = None) -> list[int]:
        """The buckets that the rows' keys fall into."""
        return sorted(r[0] for r in rows.select(self.bucket(table, key)).distinct().collect())  # at most self.buckets numbers

    def _folders(self, table: str) -> dict[str, str]:
        return self.tables.get(table, self.seen["tables"].get(table, {}))

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The table's rows in these buckets, or all; columns that older files lack are null."""
        folders = self._folders(table)
        wanted = sorted(folders) if buckets is None else [str(b) for b in buckets if str(b) in folders]
        self.touched.setdefault(table, set()).update(map(str, range(self.buckets) if buckets is None else buckets))
        if not wanted:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*[f"{self.base}/{folders[b]}" for b in wanted])

    def replace(self, table: str, df: DataFrame, buckets: list[int] | None = None) -> None:
        """The rows become what these buckets hold, or the whole table; the others' files stay as they are."""
        path = f"data/{table}/{self.run}-{uuid.uuid4().hex[:8]}"
        wanted = self.spark.createDataFrame([], TABLES[table]).schema
        columns = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]
        # Rebalanced, so that a bucket of any size is written by as many tasks as its bytes need.
        rows = df.select(*columns).withColumn("bucket", self.bucket(table)).hint("rebalance", "bucket")
        with shuffles_released(self.spark):
            rows.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.base}/{path}")
        written = {n.split("=")[1]: f"{path}/{n}" for n in self.store._names(path) if n.startswith("bucket=")}
        given = set(map(str, range(self.buckets) if buckets is None else buckets))
        if not set(written) <= given:
            raise ValueError(f"rows of {table} outside the buckets they replace")
        self.touched.setdefault(table, set()).update(given)
        self.tables[table] = {b: f for b, f in self._folders(table).items() if b not in given} | written

    def _segments(self) -> list[dict]:
        return [s for s in self.seen["segments"] if s["blocks"] not in self.merged] + self.segments

    def _dead(self) -> list[dict]:
        return self.seen["dead"] + ([self.dead] if self.dead else [])

    def _live(self, segments: list[dict], kind: str) -> DataFrame:
        """Rows of the segments with their sequence number."""
        parts = [self.spark.read.schema(SEGMENTS[kind]).parquet(f"{self.base}/{s[kind]}").withColumn("seq", F.lit(s["seq"])) for s in segments]
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], SEGMENTS[kind] + ", seq int")

    def _died(self) -> DataFrame:
        """(chunk_id, died): the number of the last run that replaced the chunk; older segments' rows of it are void."""
        parts = [self.spark.read.schema("chunk_id long").parquet(f"{self.base}/{d['path']}").withColumn("died", F.lit(d["seq"])) for d in self._dead()]
        rows = reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], "chunk_id long, died int")
        return rows.groupBy("chunk_id").agg(F.max("died").alias("died"))

    def postings(self, segments: list[dict] | None = None) -> tuple[DataFrame, DataFrame]:
        """(term blocks, lengths) of the segments' chunks that live; all segments, if none are given."""
        self.touched.setdefault("segments", set()).add("*")
        segments = self._segments() if segments is None else segments
        found, lengths = self._live(segments, "blocks"), self._live(segments, "lengths")
        if not any(d["seq"] > s["seq"] for d in self._dead() for s in segments):
            return found.drop("seq"), lengths.drop("seq")
        died = self._died()
        alive = F.col("died").isNull() | (F.col("seq") >= F.col("died"))
        return blocks.without(found, died), lengths.join(died, "chunk_id", "left").where(alive).select("chunk_id", "len")

    def index_vectors(self, model_id: str, count: int | None = None) -> None:
        """Cells over the vectors of a model. Buckets that are written later are not in them until they are made anew."""
        folders = self._folders("chunk_vectors")
        vectors = self.read("chunk_vectors").where(F.col("model_id") == model_id).withColumn("bucket", self.bucket("chunk_vectors"))
        made, path = cells.build(self.spark, vectors, count, keep="bucket"), f"data/cells/{self.run}"
        if made.placed is not None:
            made.placed.write.option("compression", "zstd").parquet(f"{self.base}/{path}/members")
            self.spark.createDataFrame([(c, v.tolist()) for c, v in enumerate(made.centres)], "cell int, v array<double>").write.parquet(f"{self.base}/{path}/centres")
            self.cells[model_id] = {"path": path, "of": dict(folders)}

    def nearest(self, model_id: str, query: list[float], k: int = 50) -> tuple[DataFrame, dict[str, int]]:
        """(chunk_id, dist) of the k nearest vectors of a model, and the pairs of a query and a cell read: from its cells, and for
        buckets written since, from their vectors."""
        index, folders = self.seen.get("cells", {}).get(model_id), self._folders("chunk_vectors")
        same = sorted(int(b) for b, f in folders.items() if index and index["of"].get(b) == f)
        late = [int(b) for b in folders if int(b) not in same]
        mine = F.col("model_id") == model_id
        found, counts = search.nearest(self.read("chunk_vectors", late).where(mine), query, k), {"pairs": 0, "read": 0}
        if same:
            placed = self.spark.read.schema("chunk_id long, v array<double>, bucket int, cell int, to_centre double").parquet(f"{self.base}/{index['path']}/members")
            centres = self.spark.read.schema("cell int, v array<double>").parquet(f"{self.base}/{index['path']}/centres").orderBy("cell").collect()  # cells.MOST_CELLS rows
            alive = placed if len(same) == len(index["of"]) else placed.where(F.col("bucket").isin(same))
            asked = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, embedding array<double>")
            near, counts = cells.nearest(self.spark, cells.of_placed(alive, np.array([r.v for r in centres])), asked, k)
            found = found.unionByName(near.select("chunk_id", "dist")).orderBy("dist", "chunk_id").limit(k)
        return found, counts

    def _write_segment(self, made: Iterable[DataFrame], lengths: DataFrame, seq: int) -> dict:
        folder = f"{self.run}-{uuid.uuid4().hex[:8]}"
        paths = {"blocks": f"data/blocks/{folder}", "lengths": f"data/lengths/{folder}"}
        with shuffles_released(self.spark):
            lengths.write.option("compression", "zstd").parquet(f"{self.base}/{paths['lengths']}")
            for part in made:
                part.write.mode("append").option("compression", "zstd").parquet(f"{self.base}/{paths['blocks']}")
        count = lambda kind, value: self.spark.read.schema(SEGMENTS[kind]).parquet(f"{self.base}/{paths[kind]}").agg(F.coalesce(F.sum(value), F.lit(0))).first()[0]
        return paths | {"seq": seq, "rows": count("blocks", F.col("n")), "chunks": count("lengths", F.lit(1))}

    def add_segment(self, chunks: DataFrame, dead: DataFrame) -> None:
        """Postings of new chunks (id, text), and chunk_ids of those that they or nothing replace."""
        seq = self.seen["sequence"] + 1
        if self.seen["segments"]:
            path = f"data/dead/{self.run}"
            dead.select(F.col("chunk_id").cast("long")).distinct().write.parquet(f"{self.base}/{path}")
            if not self.spark.read.schema("chunk_id long").parquet(f"{self.base}/{path}").isEmpty():
                self.dead = {"seq": seq, "path": path}
        made = self._write_segment(*blocks.sliced(chunks, "id"), seq)
        self.segments = [made] if made["chunks"] else []
        self._merge()

    def _merge(self) -> None:
        """The newest segments become one when MERGE of them are of like size, so that a posting is moved a logarithm of times."""
        every = self._segments()
        if not every:
            return
        total, at = every[-1]["rows"] + 1, len(every) - 1
        while at and every[at - 1]["rows"] <= self.MERGE * total:
            at -= 1
            total += every[at]["rows"]
        if len(every) - at < self.MERGE:
            return
        self.touched.setdefault("segments", set()).add("*")
        group, gone = every[at:], None
        lengths = self._live(group, "lengths")
        if any(d["seq"] > s["seq"] for d in self._dead() for s in group):
            gone = written(lengths.join(self._died(), "chunk_id").where("died > seq").select("chunk_id", "seq"), "gone")
            lengths = lengths.join(gone, ["chunk_id", "seq"], "left_anti")
        lengths = written(lengths.select("chunk_id", "len"), "lengths")
        slices = min(self.SLICES, -(-total // self.SLICE_ROWS))
        whole = self._write_segment(blocks.repacked(self._live(group, "blocks"), lengths, gone, slices), lengths, group[-1]["seq"])
        self.merged = [s["blocks"] for s in group]
        self.segments = [whole] if whole["chunks"] else []

    def _next(self, onto: dict) -> dict:
        """The manifest that follows `onto`, with this run's writes."""
        tables = dict(onto["tables"])
        for table, folders in self.tables.items():
            given = self.touched[table]
            tables[table] = {b: f for b, f in onto["tables"].get(table, {}).items() if b not in given} | {b: f for b, f in folders.items() if b in given}
        segments = [s for s in onto["segments"] if s["blocks"] not in self.merged] + self.segments
        # Ids of replaced chunks are needed while there are segments older than they.
        dead = [d for d in onto["dead"] + ([self.dead] if self.dead else []) if any(s["seq"] < d["seq"] for s in segments)]
        sequence = onto["sequence"] + 1 if self.segments or self.dead or self.merged else onto["sequence"]
        return {"version": self.store.VERSION, "number": onto["number"] + 1, "buckets": self.buckets, "tables": tables, "segments": segments, "dead": dead, "sequence": sequence, "cells": onto.get("cells", {}) | self.cells}

    def _unchanged(self, now: dict) -> bool:
        """Whether what this run read or replaces is in `now` what it was."""
        indexes = self.segments or self.dead or self.merged or "segments" in self.touched
        if now["buckets"] != self.buckets or indexes and (now["sequence"], now["segments"]) != (self.seen["sequence"], self.seen["segments"]):
            return False
        return all(now["tables"].get(t, {}).get(b) == self.seen["tables"].get(t, {}).get(b) for t, given in self.touched.items() for b in given if t != "segments")

    def commit(self) -> int:
        """The number of the new manifest. If others have committed since, theirs is built upon, unless they changed what was read: then Conflict."""
        store, now = self.store, self.seen
        store._fs.mkdirs(store._path(f"{self.base}/_manifests"))
        store._fs.createNewFile(store._path(f"{self.base}/_version-{store.VERSION}"))
        while not store._create(new := self._next(now)):
            now = store.manifest()
            if not self._unchanged(now):
                raise Conflict(f"manifest {now['number']} changes what this run read")
        self.run = ""  # its files are named now
        self._retire(new["number"])
        return new["number"]

    def _retire(self, number: int) -> None:
        """Drop the manifest that readers are no longer kept for, and the files that only it names."""
        old = number - self.store.KEEP
        if old > 0 and f"{old:012}.json" in self.store._names("_manifests"):
            gone = files_of(self.store.manifest(old)) - files_of(self.store.manifest(old + 1))
            self.store.delete(f"_manifests/{old:012}.json")
            for f in gone:
                self.store.delete(f)

    def clear(self) -> None:
        """Delete what was written without a commit."""
        if self.run:
            for table in self.store._names("data"):
                for name in self.store._names(f"data/{table}"):
                    if name.startswith(self.run):
                        self.store.delete(f"data/{table}/{name}")


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


#: Columns of a session that keep their old value when the new one is missing, and those that keep it always.
NEW_FIRST, OLD_FIRST = ("cwd", "git_branch"), ("started_at", "first_user_text")
#: Columns that ingestion does not know and must not touch.
KEPT = ("status", "status_source", "status_set_at", "cost_usd", "summary_title", "summary_short", "summary_long", "summary_model", "summary_at", "summary_turn_count")


def merge_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by id, column by column."""
    new = new.withColumns({c: truncate(F.col(c), 500) for c in ("first_user_text", "last_user_text") if c in new.columns})
    new = new.withColumn("provider", F.coalesce(F.nullif(F.trim("provider"), F.lit("")), F.lit(PROVIDER_A)))
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer")
    columns = []
    for c in old.columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else None
        if c == "id":
            value = F.coalesce(b, a)
        elif b is None or c in KEPT:
            value = F.coalesce(a, F.lit("active")) if c == "status" else a
        elif c in NEW_FIRST:
            value = F.coalesce(b, a)
        elif c in OLD_FIRST:
            value = F.coalesce(a, b)
        else:
            value = F.when(F.col("n._new"), b).otherwise(a)
        columns.append(value.alias(c))
    return both.select(*columns)


def replace_by_session(old: DataFrame, new: DataFrame, touched: DataFrame, key: str = "session_id") -> DataFrame:
    """All rows of the touched sessions go, the new ones come."""
    return old.join(touched.select(F.col("session_id").alias(key)).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_sessions(tables: dict[str, DataFrame], gone: DataFrame, keep_usage: bool = True) -> dict[str, DataFrame]:
    """Sessions with their chunks, and the chunks' vectors and postings; usage outlives them unless asked otherwise."""
    ids = gone.select(F.col("session_id")).distinct()
    dead = tables["chunks"].join(ids, "session_id", "left_semi").select(F.col("id").alias("chunk_id"))
    out = dict(tables) | {t: tables[t].join(dead, "chunk_id", "left_anti") for t in ("chunk_vectors", "postings", "lengths") if t in tables}
    out["chunks"] = tables["chunks"].join(ids, "session_id", "left_anti")
    out["sessions"] = tables["sessions"].join(ids.withColumnRenamed("session_id", "id"), "id", "left_anti")
    if not keep_usage:
        out["session_usage"] = tables["session_usage"].join(ids, "session_id", "left_anti")
    return out


def replace_usage(usage: DataFrame, sessions: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usage, sessions): the new rows' sessions lose their old usage, and every session's cost is its rows' sum."""
    spent = replace_by_session(usage, new, new)
    return spent, session_cost(sessions, spent)


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    return latest_wins(old, new, KEYS["chunk_vectors"])


def apply_verdicts(sessions: DataFrame, verdicts: DataFrame, status_map: dict[str, str], now: Column | None = None) -> DataFrame:
    """Verdicts mapped to session statuses; statuses set by hand stay, as do those whose verdict has no mapping."""
    pairs = [F.lit(x) for kv in sorted(status_map.items()) for x in kv]
    mapped = F.try_element_at(F.create_map(*pairs), "verdict") if pairs else F.lit(None).cast("string")
    by_id = verdicts.groupBy(F.col("session_id").alias("id")).agg(F.max_by("status", "ts").alias("verdict"))
    rows = sessions.join(by_id, "id", "left").withColumn("_to", mapped)
    take = F.col("_to").isNotNull() & F.coalesce(F.col("status_source") != "manual", F.lit(True))
    when = now if now is not None else F.current_timestamp()
    return rows.withColumns({
        "status": F.when(take, F.col("_to")).otherwise(F.col("status")), "status_source": F.when(take, F.lit("auto")).otherwise(F.col("status_source")),
        "status_set_at": F.when(take, when).otherwise(F.col("status_set_at")),
    }).drop("_to", "verdict")


def set_status(sessions: DataFrame, prefix: str, status: str, now: Column | None = None, exact: bool = False) -> DataFrame:
    """By hand, for every session whose id starts with the prefix (or equals it)."""
    hit = F.col("id") == prefix if exact else F.lower("id").startswith(prefix.lower())
    when = now if now is not None else F.current_timestamp()
    return sessions.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in (("status", F.lit(status)), ("status_source", F.lit("manual")), ("status_set_at", when))})


def set_summaries(sessions: DataFrame, summaries: DataFrame, model: str, now: Column | None = None) -> DataFrame:
    """summaries: (session_id, summary struct(title, short, long)); null summaries change nothing."""
    new = summaries.where("summary is not null").select(F.col("session_id").alias("id"), "summary")
    when = now if now is not None else F.current_timestamp()
    got = F.col("summary").isNotNull()
    values = {"summary_title": F.col("summary.title"), "summary_short": F.col("summary.short"), "summary_long": F.col("summary.long"), "summary_model": F.lit(model), "summary_at": when, "summary_turn_count": F.col("turn_count")}
    return sessions.join(new, "id", "left").withColumns({c: F.when(got, v).otherwise(F.col(c)) for c, v in values.items()}).drop("summary")


def latest_file(rows: DataFrame) -> DataFrame:
    """Of several files with one session id the last by time and path."""
    w = Window.partitionBy("session_id").orderBy(F.desc("mtime_unix"), F.desc("path"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
