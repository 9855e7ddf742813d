"""Periodic run detection over words (operator 11).

A run is a longest stretch of words with smallest period q, at least LEAST words and REPEATS periods long. The documents
of a slice get one suffix tree: suffixes are sorted by prefix doubling, starting from (document, word), and the intervals of
their longest common prefixes are its nodes. At a node of depth D, the leaves outside the largest child are asked for a
partner D words on or back in the same node; where the words behind the pair differ, a tandem repeat of period D branches
there. Each leaf is asked for at most log2(n) nodes. A branching repeat is the last rotation of its run: rotating it to the left, word
by word, for as long as the period holds merges the repeats into the run. Repeats of a repeat (period 2q and so on) end where the run of
period q ends and lie within it, and are left out.

A run repeats SHARED words or more, so documents without two equal windows of that length need no tree; windows are
compared by hashes, which never miss an equal pair.

Cases: null, empty or blank text has no words, no runs and collapses to the empty text; a very long text is a slice of its
own, held as a few numbers a word; ties between runs are settled by start, then period; repeated rows are treated
row by row; a null doc_id plants no tail; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, gram_hashes, mix64, pick, raw
from .quality import LEVEL_BYTES, LONG_TEXT, prefixes_in_order

LEAST, REPEATS = 24, 3
#: Words that a run's first and second period share at least: max(LEAST, REPEATS * q) - q for the q where that is least.
SHARED = min(max(LEAST, REPEATS * q) - q for q in range(1, LEAST + 1))
#: Words beyond two periods that a run has at least.
BEYOND = min(max(LEAST, REPEATS * q) - 2 * q for q in range(1, LEAST + 1))
#: Pairs of a node and a leaf examined at once; words joined at once.
PAIRS, JOINED = 1 << 20, 1 << 16
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sorted_suffixes(ids: np.ndarray, doc: np.ndarray, level_bytes: int = LEVEL_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes in order, document by document, and each one's common prefix with the one before it."""
    n = len(ids)
    key = doc.astype(np.int64) * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    sizes = np.diff(np.r_[first, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, sizes)
    small = np.int32 if n < 1 << 31 else np.int64
    levels, tied, h = [rank.astype(small)], order[np.repeat(sizes, sizes) > 1], 1
    while len(tied):
        after = np.minimum(tied + h, n - 1)
        second = np.where((tied + h < n) & (doc[after] == doc[tied]), rank[after], -1)
        by = np.lexsort((second, rank[tied]))
        tied, one, two = tied[by], rank[tied][by], second[by]
        new_one = np.r_[True, one[1:] != one[:-1]]
        new = new_one | np.r_[True, two[1:] != two[:-1]]
        at = np.arange(len(tied))
        rank[tied] = one + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_one, at, 0))
        h *= 2
        levels = [*levels, rank.astype(small)] if levels and (len(levels) + 1) * levels[0].nbytes <= level_bytes else []
        sizes = np.diff(np.r_[np.flatnonzero(new), len(tied)])
        tied = tied[np.repeat(sizes, sizes) > 1]
    pos = np.empty(n, np.int64)
    pos[rank] = np.arange(n)
    if not levels:
        return pos, np.r_[0, prefixes_in_order(ids, doc, pos)]
    i, j, shared = pos[:-1].copy(), pos[1:].copy(), np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        both = np.flatnonzero((i < n) & (j < n))
        same = both[levels[k][i[both]] == levels[k][j[both]]]
        for at in (i, j):
            at[same] += 1 << k
        shared[same + 1] += 1 << k
    return pos, shared


def inner_nodes(shared: np.ndarray) -> np.ndarray:
    """Inner nodes but the root, as columns: depth, first and last leaf, first and last leaf of the largest child."""
    found = [array("q") for _ in range(5)]
    stack = [[0, 0, 0, 0]]  # depth, first leaf, largest child

    def close(last: int, depth: int) -> None:
        while stack[-1][0] > depth:
            d, a, low, high = stack.pop()
            for column, v in zip(found, (d, a, last, low, high)):
                column.append(v)
            if stack[-1][0] < depth:
                stack.append([depth, a, a, last])
            elif last - a > stack[-1][3] - stack[-1][2]:
                stack[-1][2:] = a, last

    for base in range(0, len(shared), JOINED):
        for k, depth in enumerate(shared[base : base + JOINED].tolist(), base):
            if k and depth != stack[-1][0]:
                close(k - 1, depth)
                if stack[-1][0] < depth:
                    stack.append([depth, k - 1, k - 1, k - 1])
    close(len(shared) - 1, 0)
    return np.stack([np.frombuffer(c, np.int64) for c in found]) if found[0] else np.empty((5, 0), np.int64)


def branching_repeats(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every tandem repeat that cannot be rotated to the right; ends is the end of each word's document."""
    n = len(ids)
    pos, shared = sorted_suffixes(ids, doc)
    rank = np.empty(n, np.int64)
    rank[pos] = np.arange(n)
    depth, first, last, low, high = inner_nodes(shared)
    lengths = ends - np.searchsorted(doc, doc, side="left")
    fits = REPEATS * depth <= lengths[pos[first]]
    depth, first, last, low, high = (c[fits] for c in (depth, first, last, low, high))
    # The leaves to ask: those of the node before and behind its largest child.
    node, start, size = np.tile(np.arange(len(depth)), 2), np.r_[first, high + 1], np.r_[low - first, last - high]
    some = size > 0
    node, start, size = node[some], start[some], size[some]
    upto, at, out = np.cumsum(size), 0, []
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        of, sizes = node[at:stop], size[at:stop]
        leaf = np.repeat(start[at:stop] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        v, leaf, at = np.repeat(of, sizes), pos[leaf], stop
        for i in (leaf, leaf - depth[v]):
            j = i + depth[v]
            ok = (i >= 0) & (j < n)
            ok[ok] &= doc[i[ok]] == doc[j[ok]]
            other = np.where(i[ok] == leaf[ok], j[ok], i[ok])
            ok[ok] &= (rank[other] >= first[v[ok]]) & (rank[other] <= last[v[ok]])
            i, q = i[ok], depth[v[ok]]
            end = i + 2 * q
            out.append(np.stack([i, q])[:, (end == ends[i]) | (ids[np.minimum(end, n - 1)] != ids[i + q])])
    both = np.unique(np.concatenate([np.empty((2, 0), np.int64), *out], axis=1), axis=1)
    return both[0], both[1]


def rotated(ids: np.ndarray, least: int, start: int, period: int) -> int:
    """The first word, not before least, from which the period holds up to start."""
    step = 64
    while start > least:
        a = max(least, start - step)
        differ = np.flatnonzero(ids[a:start] != ids[a + period : start + period])
        if len(differ):
            return a + int(differ[-1]) + 1
        start, step = a, 2 * step
    return start


def find_runs(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows (document, start, length, period), starts counted in the document; doc is non-decreasing."""
    ids, doc = np.asarray(ids, np.int64), np.asarray(doc, np.int64)
    grams = gram_hashes(mix64(ids.astype(np.uint64) + np.uint64(1)), SHARED)
    inside = np.flatnonzero(doc[: len(grams)] == doc[len(doc) - len(grams) :])
    key = mix64(grams[inside] + mix64(doc[inside].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    again = order[1:][key[order][1:] == key[order][:-1]]
    repeats = np.isin(doc, np.unique(doc[inside[again]]))
    if not repeats.any():
        return np.empty((0, 4), np.int64)
    ids, doc = ids[repeats], doc[repeats]
    begins, ends = np.searchsorted(doc, doc, side="left"), np.searchsorted(doc, doc, side="right")
    start, period = branching_repeats(ids, doc, ends)
    for t in range(1, BEYOND + 1):  # most repeats end here
        go_on = (start - t >= begins[start]) & (ids[start - t] == ids[start - t + period])
        start, period = start[go_on], period[go_on]
    runs, at_end, at = [], [], -1
    order = np.lexsort((period, start + 2 * period))
    for i, q in zip(start[order].tolist(), period[order].tolist()):
        end = i + 2 * q
        if end != at:
            at_end, at = [], end
        if any(q % p == 0 and length >= 2 * q for p, length in at_end):
            continue  # a repeat of a repeat
        a = rotated(ids, int(begins[i]), i, q)
        if end - a >= max(LEAST, REPEATS * q):
            at_end.append((q, end - a))
            runs.append((int(doc[i]), a - int(begins[i]), end - a, q))
    return np.array(sorted(runs, key=lambda r: (r[0], r[1], r[3])), np.int64).reshape(-1, 4)


class LongWords(Sequence):
    """Words of a long text by their places, cut out when asked for."""

    def __init__(self, text: bytes):
        places = np.fromiter((x for m in _WORD.finditer(text) for x in m.span()), np.int64)
        self.text, self.starts, self.ends = text, places[::2], places[1::2]

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, k: int) -> bytes:
        return self.text[self.starts[k] : self.ends[k]]


def planted_order(doc_id: int | None, n: int) -> np.ndarray:
    """Numbers of the words that stand at 0 to n - 1: every tenth document, by the checksum of its id, gets a tail that repeats."""
    order = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        order[a:] = a + (order[a:] - a) % p
    return order


def joined(words: Sequence[bytes], order: np.ndarray) -> bytes:
    """Words in the order given, joined by one space."""
    parts = (b" ".join([words[k] for k in order[at : at + JOINED].tolist()]) for at in range(0, len(order), JOINED))
    return b" ".join(parts)


def scan(df: DataFrame, planted: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, its runs by start, then period, and the text without what repeats a run's first period.

    With planted, tails of every tenth document are made to repeat first (see planted_order), so that there is something to find.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [LongWords(t) if len(t) > LONG_TEXT else t.split() for t in raw(batch.column("text"))]
        orders = [planted_order(d, len(t)) if planted else np.arange(len(t)) for d, t in zip(batch.column("doc_id").to_pylist(), texts)]
        number: dict[bytes, int] = {}
        codes = [np.fromiter((number.setdefault(w, len(number)) for w in t), np.int64, len(t))[o] for t, o in zip(texts, orders)]
        sizes = [len(t) for t in texts]
        found = find_runs(np.concatenate(codes), np.repeat(np.arange(len(sizes)), sizes))
        per_doc = np.split(found[:, 1:], np.searchsorted(found[:, 0], np.arange(1, len(sizes))))
        collapsed = []
        for words, order, runs in zip(texts, orders, per_doc):
            if len(runs):
                edge = np.zeros(len(order) + 1, np.int64)
                np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
                np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
                order = order[np.cumsum(edge[:-1]) == 0]
            collapsed.append(joined(words, order))
        spans = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], names=["start", "length", "period"])
        runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, per_doc)]), pa.int32()), spans)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return arrow_map(pick(df, id_col, text_col), run, SCHEMA, max_bytes=2 << 20)


def digest(found: DataFrame) -> DataFrame:
    """Of scan(): doc_id, the number of runs, the run of greatest exponent (ties: smallest start, then period), hashes of runs and text."""
    # Runs come by start, then period: a later one wins only with a greater exponent, compared as products.
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda best, r: F.when(better(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"), "collapsed").select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
