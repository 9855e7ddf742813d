"""Substring dedup with repeated-phrase automata (operator 8).

1. Anchors: of the 5-word grams in each 13-word window the one of least hash is the window's anchor, so that two equal
   windows have equal anchors. Anchors that two documents share are found by one sorted shuffle of hashes.
2. Excerpts: only stretches of windows with shared anchors leave their document; they go to the group of the anchor's
   first document. Groups of many words are cut again by buckets of anchors, and a bucket that is still large (a few
   anchors in very many documents) into slices whose recurring windows are agreed on across slices.
3. Confirmed passages: in a group, the windows that two documents hold, with the document that holds them first.
4. Automata: each group (or slice) compiles an Aho-Corasick automaton of its confirmed windows, streams its excerpts
   through it and reports the words of every occurrence.
5. Each document drops the reported words.

Cases: null text has no words; documents of under 13 words stay as they are; a document's own repeats and repeated rows
of one doc_id do not count as earlier copies, nor do rows without a doc_id; texts of any length are cut into excerpts; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEYS, Kept, WordHashes, arrow_map, attached, gram_hashes, handing_back, in_batches, meetings, packed_keys, parts_for, pick, raw

WINDOW, GRAM = 13, 5
#: Words of excerpts that one automaton's task holds; larger groups are sliced. Windows of an excerpt, which is cut beyond.
SLICE_WORDS, EXCERPT = 200_000, 20_000


def anchor_positions(grams: np.ndarray) -> np.ndarray:
    """For each window the position of its anchor among the grams."""
    span = WINDOW - GRAM + 1
    if len(grams) < span:
        return np.empty(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(len(grams) - span + 1)


def _anchors(hashes: WordHashes, batch: pa.RecordBatch) -> pa.RecordBatch:
    keys, docs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for doc, text in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text"))):
        grams = gram_hashes(hashes.of(text.split()), GRAM)
        at = anchor_positions(grams) if doc is not None else ()
        if len(at):
            found = np.unique(grams[at]).view(np.int64)
            keys.append(found)
            docs.append(np.full(len(found), doc, np.int64))
    return packed_keys(np.concatenate(keys), np.concatenate(docs))


def anchors(docs: DataFrame) -> DataFrame:
    hashes = WordHashes()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield _anchors(hashes, batch)

    return arrow_map(docs, run, KEYS, max_bytes=16 << 20)


SPLIT = "what string, doc_id long, uid long, src long, start long, n_words long, body binary, sha string"
_SPLIT = pa.schema([("what", pa.string()), ("doc_id", pa.int64()), ("uid", pa.int64()), ("src", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("body", pa.binary()), ("sha", pa.string())])


def _signed(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """done: documents that lose nothing; wait: the others; part: excerpts with shared anchors."""
    hashes = WordHashes()

    def rows() -> Iterator[tuple]:
        for doc, text, side in attached(batches, ("key", "first")):
            words = text.split()
            runs = []
            if len(side["key"]):
                grams = gram_hashes(hashes.of(words), GRAM)
                at = anchor_positions(grams)
                order = np.argsort(side["key"])
                known, first = side["key"][order], side["first"][order]
                mine = grams[at].view(np.int64)
                i = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                hit = known[i] == mine
                src = np.where(hit, first[i], -1)
                edge = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1]) | (src[1:] != src[:-1])]) if len(hit) else []
                runs = [(c, min(b, c + EXCERPT), int(src[a])) for a, b in zip(edge, [*edge[1:], len(hit)]) if hit[a] for c in range(a, b, EXCERPT)]
            uid = _signed(text)
            for a, b, s in runs:
                part = words[a : b + WINDOW - 1]
                yield "part", doc, uid, s, int(a), len(part), b" ".join(part), None
            if any(s < doc for _, _, s in runs):
                yield "wait", doc, uid, None, None, len(words), text, None
            else:
                yield "done", doc, uid, None, None, len(words), None, hashlib.sha256(b" ".join(words)).hexdigest()

    return in_batches(rows(), _SPLIT)


class Excerpts:
    """A group's excerpts as strings with one letter a word; the alphabet is the group's own."""

    def __init__(self) -> None:
        self.letters: dict[bytes, str] = {}
        self.rows: list[tuple[int, int, int, str]] = []

    def spell(self, body: bytes) -> str:
        get, out = self.letters.get, []
        for w in body.split(b" "):
            c = get(w)
            if c is None:
                n = len(self.letters) + 0x100
                c = self.letters[w] = chr(n if n < 0xD800 else n + 0x800)
            out.append(c)
        return "".join(out)


def confirm(rows: list[tuple[int, int, int, str]]) -> list[tuple[int, str]]:
    """(first document, window) for each distinct window that two documents hold."""
    docs = np.array([r[0] for r in rows], np.int64)
    sizes = np.array([len(r[3]) for r in rows], np.int64)
    text = "".join([r[3] for r in rows])
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    hashes = gram_hashes(letters, WINDOW)
    row = np.repeat(np.arange(len(rows)), sizes)[: len(hashes)]
    at = np.arange(len(hashes))
    at = at[at + WINDOW <= np.cumsum(sizes)[row]]
    doc, h = docs[row[at]], hashes[at]
    order = np.lexsort((doc, h))
    hs, ds = h[order], doc[order]
    new = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]]) if len(hs) else np.empty(0, np.int64)
    ends = np.r_[new[1:], len(hs)].astype(np.int64)
    new = new[ds[new] != ds[ends - 1]]
    return [(first, text[p : p + WINDOW]) for first, p in zip(ds[new].tolist(), at[order[new]].tolist())]


def locate(windows: list[tuple[int, str]], rows: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, int, int]]:
    """(doc_id, uid, start, end) of every stretch covered by windows that an earlier document holds."""
    if not windows:
        return
    machine = ahocorasick.Automaton()
    for first, window in windows:
        machine.add_word(window, first)
    machine.make_automaton()
    for doc, uid, start, text in rows:
        a = b = -1
        for end, first in machine.iter(text):
            if first >= doc:
                continue
            if end - WINDOW + 1 > b:
                if b > 0:
                    yield doc, uid, start + a, start + b
                a = end - WINDOW + 1
            b = end + 1
        if b > 0:
            yield doc, uid, start + a, start + b


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of each (src, bucket, slice) of a sorted stream."""
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if key != (row["src"], row["bucket"], row["slice"]):
                if held:
                    yield held
                held, key = [], (row["src"], row["bucket"], row["slice"])
            held.append(row)
    if held:
        yield held


_SPANS = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_WINDOWS = pa.schema([("src", pa.int64()), ("bucket", pa.int64()), ("slice", pa.int32()), ("hash", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("body", pa.binary())])


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def spans() -> Iterator[tuple]:
        for group in _groups(batches):
            own = Excerpts()
            rows = [(r["doc_id"], r["uid"], r["start"], own.spell(r["body"])) for r in group if r["kind"]]
            agreed = [(r["first"], own.spell(r["body"])) for r in group if not r["kind"]]
            yield from locate(agreed if group[0]["sliced"] else confirm(rows), rows)

    return in_batches(spans(), _SPANS, 20_000)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct window of a slice once, with its smallest and largest document."""
    hashes = WordHashes()

    def rows() -> Iterator[tuple]:
        for group in _groups(batches):
            found: dict[int, list] = {}
            for r in group:
                words = r["body"].split(b" ")
                for i, h in enumerate(gram_hashes(hashes.of(words), WINDOW).view(np.int64).tolist()):
                    seen = found.get(h)
                    if seen is None:
                        found[h] = [r["doc_id"], r["doc_id"], words[i : i + WINDOW]]
                    else:
                        seen[0], seen[1] = min(seen[0], r["doc_id"]), max(seen[1], r["doc_id"])
            for h, (a, b, words) in found.items():
                yield group[0]["src"], group[0]["bucket"], group[0]["slice"], h, a, b, b" ".join(words)

    return in_batches(rows(), _WINDOWS, 20_000)


def _recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Excerpts cut again where the bucket of the windows' anchors changes; equal windows have equal anchors."""
    hashes = WordHashes()

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                words = r["body"].split(b" ")
                grams = gram_hashes(hashes.of(words), GRAM)
                bucket = (grams[anchor_positions(grams)] % np.uint64(r["buckets"])).astype(np.int64)
                edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist()
                for a, b in zip(edge, [*edge[1:], len(bucket)]):
                    part = words[a : b + WINDOW - 1]
                    yield r["src"], int(bucket[a]), r["doc_id"], r["uid"], r["start"] + a, len(part), b" ".join(part)

    return in_batches(rows(), _PIECES, 20_000)


_PIECES = pa.schema([("src", pa.int64()), ("bucket", pa.int64()), ("doc_id", pa.int64()), ("uid", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("body", pa.binary())])


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for doc, text, side in attached(batches, ("uid", "start", "end")):
            words = text.split()
            edge = np.zeros(len(words) + 1, np.int64)
            mine = side["uid"] == _signed(text)
            np.add.at(edge, side["start"][mine], 1)
            np.add.at(edge, side["end"][mine], -1)
            gone = np.cumsum(edge)[: len(words)] > 0
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
            yield doc, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
    return in_batches(rows(), schema)


def dedup(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_words: int = SLICE_WORDS) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, and kept_text where words were removed (else null)."""
    kept, docs = Kept(spark), pick(df, id_col, text_col)
    parts = parts_for(spark, docs)
    # Rows without an id have no routes, and are spread by their text.
    routes = meetings(kept, "routes", anchors(docs), parts)
    null = lambda kind: F.lit(None).cast(kind)
    both = docs.select("doc_id", F.lit(1).alias("kind"), null("long").alias("key"), null("long").alias("first"), "text").union(
        routes.select(F.col("doc").alias("doc_id"), F.lit(0), "key", "first", null("string")))
    split = kept.keep("split", both.repartition(parts, F.coalesce("doc_id", F.xxhash64("text"))).sortWithinPartitions("doc_id", "kind").mapInArrow(handing_back(_split), SPLIT), ("what",))
    kept.drop("routes")
    excerpts = split.where("what = 'part'")
    sized = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n_words").alias("n")).where(F.col("n") > slice_words)
    wide = kept.keep("wide", sized(excerpts, "src").select("src", F.ceil(F.col("n") * 4 / slice_words).cast("int").alias("buckets")))
    small = excerpts.join(wide, "src", "left_anti").select(F.col("src"), F.lit(-1).cast("long").alias("bucket"), "doc_id", "uid", "start", "n_words", "body")
    again = excerpts.join(wide, "src").select("src", "buckets", "doc_id", "uid", "start", "body")
    pieces = kept.keep("pieces", again.repartition(parts).mapInArrow(handing_back(_recut), "src long, bucket long, doc_id long, uid long, start long, n_words long, body binary"))
    large = kept.keep("large", sized(pieces, "src", "bucket").select("src", "bucket", F.ceil(F.col("n") / slice_words).cast("int").alias("slices")))
    dealt = small.union(pieces).join(large, ["src", "bucket"], "left").select("src", "bucket", F.coalesce(F.pmod(F.xxhash64("doc_id", "start"), F.col("slices")), F.lit(0)).cast("int").alias("slice"),
        F.col("slices").isNotNull().alias("sliced"), F.lit(1).alias("kind"), "doc_id", "uid", "start", null("long").alias("first"), "body")
    windows = dealt.where("sliced").repartition(parts, "src", "bucket", "slice").sortWithinPartitions("src", "bucket", "slice").mapInArrow(handing_back(_windows), "src long, bucket long, slice int, hash long, first long, last long, body binary")
    # A window is agreed on across slices, and goes back to those that hold it.
    agreed = windows.groupBy("src", "bucket", "hash").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("body").alias("body"), F.collect_list("slice").alias("held")).where("first <> last")
    copies = agreed.select("src", "bucket", F.explode("held").alias("slice"), F.lit(True), F.lit(0), null("long"), null("long"), null("long"), "first", "body")
    spans = dealt.union(copies).repartition(parts, "src", "bucket", "slice").sortWithinPartitions("src", "bucket", "slice", "kind").mapInArrow(handing_back(_locate), "doc_id long, uid long, start long, end long")
    waiting = split.where("what = 'wait'").select("doc_id", F.lit(1).alias("kind"), null("long").alias("uid"), null("long").alias("start"), null("long").alias("end"), F.col("body").cast("string").alias("text"))
    rows = waiting.union(spans.select("doc_id", F.lit(0), "uid", "start", "end", null("string")))
    shorter = rows.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "kind").mapInArrow(handing_back(_drop), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return split.where("what = 'done'").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), null("string").alias("kept_text")).union(shorter)
