"""Transcript files: roots, listings, lines and events of both formats."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import json_string
from ..schemas import PROVIDER_A, PROVIDER_B


def account_roots(primary: str, registry: str | None = None, primary_is_default: bool = True, isolated: bool = False) -> list[tuple[str, str]]:
    """(account, root): the primary as "legacy", then each folder that a sorted *.configdir file names; one entry a path."""
    found = [("legacy", str(Path(primary)))]
    if registry and Path(registry).is_dir() and not isolated and primary_is_default:
        for f in sorted(Path(registry).glob("*.configdir")):
            named = f.read_text().strip()
            if named.startswith("/"):
                found.append((f.stem, str(Path(named) / "projects")))
    seen: set[str] = set()
    return [(a, p) for a, p in found if not (p in seen or seen.add(p))]


FILES = "value string, path string, size long, mtime_unix long, provider string, account string"


def _files(spark: SparkSession, path: str, provider: str, account: str, content: bool, only: list[str] | None = None, **options: str) -> DataFrame | None:
    """None if nothing is at the path. Without content, files are listed and not opened."""
    reader = spark.read.format("text").option("wholetext", True) if content else spark.read.format("binaryFile")
    meta = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.unix_timestamp("_metadata.file_modification_time").alias("mtime_unix")]
    try:
        df = reader.options(**options).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if only is not None:  # prunes files when the scan is planned
        df = df.where(F.col("_metadata.file_path").isin(only))
    df = df.select("value" if content else F.lit(None).cast("string").alias("value"), *meta)
    return df.withColumns({"provider": F.lit(provider), "account": F.lit(account)})


def transcript_files(spark: SparkSession, roots_a: list[tuple[str, str]], root_b: str | None = None, content: bool = True, only: list[str] | None = None) -> DataFrame:
    """One row a file: format A exactly one folder below each root, format B's rollout-*.jsonl at any depth.

    A transcript is one session and one row; missing roots give no rows. `only` keeps the files of these paths.
    """
    found = [_files(spark, f"{root}/*/*.jsonl", PROVIDER_A, account, content, only) for account, root in roots_a]
    if root_b:
        found.append(_files(spark, root_b, PROVIDER_B, "legacy", content, only, recursiveFileLookup="true", pathGlobFilter="rollout-*.jsonl"))
    out = spark.createDataFrame([], FILES)
    for df in found:
        out = out.unionByName(df) if df is not None else out
    return out


def contents(spark: SparkSession, roots_a: list[tuple[str, str]], root_b: str | None, listed: DataFrame) -> DataFrame:
    """The listed files with their content; one that has changed since it was listed is left to the next run.

    Only they are opened. Their paths are held by the driver, as the listing itself is."""
    paths = [r.path for r in listed.select("path").collect()]
    files = transcript_files(spark, roots_a, root_b, only=paths)
    return files.join(listed.select("path", "size", "mtime_unix"), ["path", "size", "mtime_unix"], "left_semi")


SPLIT = "path string, file_size long, mtime_unix long, block long, n long, at long, bytes long, line string"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers and byte offsets of lines within their split; a task's lines come in order, split after split."""
    key, n, at = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        path, block = batch.column("path"), batch.column("block").to_numpy()
        edge = np.r_[True, (block[1:] != block[:-1]) | np.asarray(pa.compute.not_equal(path[1:], path[:-1]))]
        sizes = np.asarray(pa.compute.binary_length(batch.column("line")), np.int64) + 1
        ends = np.cumsum(sizes)
        places, starts = np.arange(len(sizes)), ends - sizes
        begins = np.maximum.accumulate(np.where(edge, places, 0))
        number, offset = places - begins, starts - starts[begins]
        if key == (path[0].as_py(), int(block[0])):
            same = begins == 0
            number[same] += n
            offset[same] += at
        key, n, at = (path[-1].as_py(), int(block[-1])), int(number[-1]) + 1, int(offset[-1] + sizes[-1])
        columns = {"n": number, "at": offset, "bytes": sizes}
        yield pa.RecordBatch.from_arrays([pa.array(columns[f]) if f in columns else batch.column(f) for f in SPLIT_NAMES], names=SPLIT_NAMES)


SPLIT_NAMES = [f.split()[0] for f in SPLIT.split(", ")]


def split_lines(spark: SparkSession, paths: str | list[str], only: list[str] | None = None, listed: DataFrame | None = None, cursors: DataFrame | None = None, **options: str) -> DataFrame:
    """(path, seq, start, end, line) of files that are cut into splits, so that several tasks read one: the line's number in
    the file, its first byte, and the byte after its LF. One trailing CR is cut, blank lines are skipped, a last partial line is dropped.

    `only` keeps the files of these paths; `listed` (path, size, mtime_unix) those that are still as they were listed; `cursors` (path,
    last_offset) lines that begin at the file's cursor or later. Splits know where they begin; a first pass counts the lines and
    bytes of each, a row a split, so that the texts themselves are not moved.
    """
    rows = spark.read.format("text").option("lineSep", "\n").options(**options).load(paths)
    if only is not None:
        rows = rows.where(F.col("_metadata.file_path").isin(only))
    rows = rows.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_size"), F.unix_timestamp("_metadata.file_modification_time").alias("mtime_unix"),
        F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    splits = rows.groupBy("path", "file_size", "mtime_unix", "block").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("line") + 1).alias("long"))
    if listed is not None:
        splits = splits.join(listed.select("path", F.col("size").alias("file_size"), "mtime_unix"), ["path", "file_size", "mtime_unix"], "left_semi")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a file's splits
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    splits = splits.select("path", "block", total("lines").alias("first"), total("long").alias("base"))
    if cursors is not None:
        splits = splits.join(cursors.select("path", "last_offset"), "path", "left")
    placed = rows.select("*", *[F.lit(0).cast("long").alias(c) for c in ("n", "at", "bytes")]).select(*SPLIT_NAMES).mapInArrow(_placed, SPLIT)
    start = F.col("base") + F.col("at")
    kept = placed.join(splits, ["path", "block"]).where(start + F.col("bytes") <= F.col("file_size"))
    if cursors is not None:
        kept = kept.where(start >= F.coalesce("last_offset", F.lit(0)))
    return kept.select("path", (F.col("first") + F.col("n")).alias("seq"), start.alias("start"), (start + F.col("bytes")).alias("end"), F.regexp_replace("line", "\r$", "").alias("line")).where(F.trim("line") != "")


def changed_lines(spark: SparkSession, roots_a: list[tuple[str, str]], root_b: str | None, listed: DataFrame) -> DataFrame:
    """Lines of the listed files of both formats, with provider and account; only those files are opened, by as many tasks as their bytes need."""
    paths = [r.path for r in listed.select("path").collect()]
    sources = [(f"{root}/*/*.jsonl", PROVIDER_A, account, {}) for account, root in roots_a]
    sources += [(root_b, PROVIDER_B, "legacy", {"recursiveFileLookup": "true", "pathGlobFilter": "rollout-*.jsonl"})] if root_b else []
    out = spark.createDataFrame([], "path string, seq long, start long, end long, line string, provider string, account string")
    for path, provider, account, options in sources:
        try:
            found = split_lines(spark, path, paths, listed, **options)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out = out.unionByName(found.withColumns({"provider": F.lit(provider), "account": F.lit(account)}))
    return out


def all_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """Every *.jsonl below a root, sidechains included, for the usage scan; the session is the file's stem."""
    df = _files(spark, root, PROVIDER_A, "legacy", True, recursiveFileLookup="true", pathGlobFilter="*.jsonl")
    df = spark.createDataFrame([], FILES) if df is None else df
    return df.withColumn("session_id", file_stem(F.col("path")))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def lines(files: DataFrame) -> DataFrame:
    """(path, ..., seq, line) of whole files in rows: split at LF, one trailing CR cut, blank lines skipped, a last partial line dropped."""
    cut = F.split(F.col("value"), "\n", -1)
    whole = F.slice(cut, F.lit(1), F.size(cut) - 1)
    rest = [c for c in files.columns if c != "value"]
    return files.select(*rest, F.posexplode(whole).alias("seq", "line")).withColumn("line", F.regexp_replace("line", "\r$", "")).where(F.trim("line") != "")


def _blocks(v: Column) -> Column:
    content = F.try_variant_get(v, "$.message.content", "variant")
    kind = F.schema_of_variant(content)
    plain = F.array(F.struct(F.lit("text").alias("type"), F.try_variant_get(content, "$", "string").alias("text")))
    objects = F.filter(F.try_variant_get(content, "$", "array<variant>"), lambda b: F.startswith(F.schema_of_variant(b), F.lit("OBJECT")))

    def block(b: Column) -> Column:
        what = F.coalesce(json_string(b, "$.type"), F.lit("other"))
        text = F.when(what == "text", json_string(b, "$.text")).when(what == "thinking", json_string(b, "$.thinking"))
        return F.struct(what.alias("type"), text.alias("text"))

    none = F.array().cast("array<struct<type:string,text:string>>")
    return F.when(kind == "STRING", plain).when(F.startswith(kind, F.lit("ARRAY")), F.transform(objects, block)).otherwise(none)


def _objects(rows: DataFrame) -> DataFrame:
    """Lines that hold a JSON object, parsed; others are skipped."""
    return rows.withColumn("raw", F.try_parse_json("line")).where(F.startswith(F.schema_of_variant("raw"), F.lit("OBJECT")))


def events_a(rows: DataFrame) -> DataFrame:
    """Format A: scalar fields, role and content blocks."""
    v = F.col("raw")
    return _objects(rows).select(
        "path", "provider", "account", F.col("seq").cast("long").alias("seq"),
        F.coalesce(json_string(v, "$.type"), F.lit("unknown")).alias("type"), json_string(v, "$.sessionId").alias("event_session"),
        json_string(v, "$.uuid").alias("uuid"), json_string(v, "$.parentUuid").alias("parent_uuid"),
        F.try_to_timestamp(json_string(v, "$.timestamp")).alias("ts"), json_string(v, "$.cwd").alias("cwd"), json_string(v, "$.gitBranch").alias("git_branch"),
        json_string(v, "$.version").alias("version"), json_string(v, "$.message.role").alias("role"), _blocks(v).alias("blocks"),
        json_string(v, "$.entrypoint").alias("entrypoint"), json_string(v, "$.promptSource").alias("prompt_source"), F.lit(False).alias("subagent"), "raw",
    )


def events_b(rows: DataFrame) -> DataFrame:
    """Format B: {type, timestamp, payload} mapped to the same columns."""
    v = F.col("raw")
    what, inner, item = json_string(v, "$.type"), json_string(v, "$.payload.type"), F.lower(json_string(v, "$.payload.item.type"))
    message = (what == "event_msg") & inner.isin("user_message", "agent_message")
    done = (what == "event_msg") & (inner == "item_completed") & item.isin("usermessage", "agentmessage")
    kind = F.when(message, F.when(inner == "user_message", "user").otherwise("assistant")).when(done, F.when(item == "usermessage", "user").otherwise("assistant"))
    parts = F.filter(F.try_variant_get(v, "$.payload.item.content", "array<variant>"), lambda b: F.lower(json_string(b, "$.type")) == "text")
    texts = F.transform(parts, lambda b: F.struct(F.lit("text").alias("type"), json_string(b, "$.text").alias("text")))
    none = F.array().cast("array<struct<type:string,text:string>>")
    blocks = F.when(message, F.array(F.struct(F.lit("text").alias("type"), json_string(v, "$.payload.message").alias("text")))).when(done, F.coalesce(texts, none)).otherwise(none)
    meta, context = what == "session_meta", what == "turn_context"
    null = F.lit(None).cast("string")
    return _objects(rows).select(
        "path", "provider", "account", F.col("seq").cast("long").alias("seq"),
        F.coalesce(kind, what, F.lit("unknown")).alias("type"), F.when(meta, json_string(v, "$.payload.id")).alias("event_session"),
        F.when(done, json_string(v, "$.payload.item.id")).alias("uuid"), null.alias("parent_uuid"), F.try_to_timestamp(json_string(v, "$.timestamp")).alias("ts"),
        F.when(meta | context, json_string(v, "$.payload.cwd")).alias("cwd"), F.when(meta, json_string(v, "$.payload.git.branch")).alias("git_branch"),
        F.when(meta, json_string(v, "$.payload.cli_version")).alias("version"), kind.alias("role"), blocks.alias("blocks"),
        F.when(meta, json_string(v, "$.payload.originator")).alias("entrypoint"), null.alias("prompt_source"),
        F.coalesce(meta & F.try_variant_get(v, "$.payload.source.subagent", "variant").isNotNull(), F.lit(False)).alias("subagent"), "raw",
    )


def events(files: DataFrame) -> DataFrame:
    """Events of both formats, by each file's provider."""
    return line_events(lines(files))


def line_events(rows: DataFrame) -> DataFrame:
    return events_a(rows.where(F.col("provider") == PROVIDER_A)).unionByName(events_b(rows.where(F.col("provider") == PROVIDER_B)))


def changed(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """Files whose (path, size, mtime) no cursor holds."""
    return files.join(cursors.select("path", "size", "mtime_unix"), ["path", "size", "mtime_unix"], "left_anti")


def limited(files: DataFrame, n: int | None) -> DataFrame:
    """The first n files to ingest, by time and path; skipped files do not count."""
    return files if n is None else files.orderBy("mtime_unix", "path").limit(n)
