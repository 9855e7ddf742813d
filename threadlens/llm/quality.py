"""Quality rules with suffix-array repetition (operator 7).

Each slice of documents gets one generalised suffix array over words: ranks start from (document, word), so equal
suffixes always lie in one document, and prefix doubling re-sorts only suffixes that still tie. Neighbouring
suffixes' longest common prefixes delimit the maximal repeated substrings; their spans are united, and the covered
fraction and the longest repeat are limited.

Cases: null, empty or blank text has no words and fails (n_words < 20); a very long text is a slice of its own, whose words
are numbered one by one and whose prefixes are measured in text order, so memory stays at a few numbers a word; ties and
repeated rows are judged row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from .common import arrow_map, pick, raw

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_words long, longest_repeat long"
)
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: The method's own limits: repeats of min_repeat words or more may cover so much, and none may be longer.
MIN_REPEAT, MAX_COVERED_PERCENT, MAX_LONGEST, MAX_LONGEST_PERCENT = 6, 30, 64, 15

#: Bytes of ranks kept for measuring prefixes by level; beyond them prefixes are measured in text order. Bytes of a text
#: that is cut into words in one go.
LEVEL_BYTES, LONG_TEXT = 64 << 20, 16 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def prefixes_in_order(ids: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Longest common prefix of each of the sorted suffixes pos with the one before it.

    In text order a suffix shares with its neighbour at most one word less than the suffix before it did.
    """
    before = np.full(len(ids), -1, np.int64)
    before[pos[1:]] = pos[:-1]
    ends = np.searchsorted(doc, doc, side="right")
    length, shared = np.zeros(len(ids), np.int64), 0
    for i in np.sort(pos).tolist():
        j = int(before[i])
        # The neighbour of a suffix that is not among these shares too little to build on.
        shared = max(0, shared - 1) if i and before[i - 1] >= 0 else 0
        if j < 0 or doc[i] != doc[j]:
            shared = 0
            continue
        room, step = int(min(ends[i] - i, ends[j] - j)), 16
        while shared < room:
            n = min(step, room - shared)
            same = ids[i + shared : i + shared + n] == ids[j + shared : j + shared + n]
            if not same.all():
                shared += int(same.argmin())
                break
            shared, step = shared + n, 2 * step
        length[i] = shared
    return length[pos[1:]]


def repeat_lengths(ids: np.ndarray, doc: np.ndarray, least: int, level_bytes: int = LEVEL_BYTES) -> np.ndarray:
    """For each position, the longest prefix of its suffix that also starts elsewhere in the document.

    Lengths under ``least`` come back as 0. ids and doc are equally long; doc is non-decreasing.
    """
    n = len(ids)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    key = doc.astype(np.int64) * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    start = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    first = np.flatnonzero(start)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    small = np.int32 if n < 1 << 31 else np.int64
    levels, h = [rank.astype(small)], 1
    sizes = np.diff(np.r_[first, n])
    active = order[np.repeat(sizes, sizes) > 1]
    # All that repeat over the largest power of two within `least` words; only their prefixes are measured.
    watched = active.copy() if least < 2 else None
    while len(active):
        nxt = active + h
        second = np.full(len(active), -1, np.int64)
        inside = nxt < n
        inside[inside] &= doc[nxt[inside]] == doc[active[inside]]
        second[inside] = rank[nxt[inside]]
        r = rank[active]
        o = np.lexsort((second, r))
        a, r, s = active[o], r[o], second[o]
        new_r = np.r_[True, r[1:] != r[:-1]]
        new = new_r | np.r_[True, s[1:] != s[:-1]]
        at = np.flatnonzero(new)
        index = np.arange(len(a))
        group = np.maximum.accumulate(np.where(new_r, index, 0))
        sub = np.maximum.accumulate(np.where(new, index, 0))
        rank[a] = r + (sub - group)
        h *= 2
        levels = [*levels, rank.astype(small)] if levels and (len(levels) + 1) * levels[0].nbytes <= level_bytes else []
        sizes = np.diff(np.r_[at, len(a)])
        active = a[np.repeat(sizes, sizes) > 1]
        if watched is None and (h * 2 > least or not len(active)):
            watched = active.copy()
    if watched is None or not len(watched):
        return out
    pos = watched[np.argsort(rank[watched], kind="stable")]
    i, j = pos[:-1].copy(), pos[1:].copy()
    lcp = np.zeros(len(i), np.int64) if levels else prefixes_in_order(ids, doc, pos)
    for level in range(len(levels) - 1, -1, -1):
        ok = (i < n) & (j < n)
        same = np.zeros(len(i), bool)
        same[ok] = levels[level][i[ok]] == levels[level][j[ok]]
        step = 1 << level
        lcp[same] += step
        i[same] += step
        j[same] += step
    np.maximum.at(out, pos[:-1], lcp)
    np.maximum.at(out, pos[1:], lcp)
    out[out < least] = 0
    return out


def covered(lengths: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Words of each document in the union of the spans [i, i + lengths[i])."""
    n = len(lengths)
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(lengths)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + lengths[at], -1)
    return np.bincount(doc, weights=np.cumsum(edge[:-1]) > 0, minlength=docs).astype(np.int64)


def duplicate_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.split():
            seen.add(line)
    return n


def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The verdict columns for a slice with doc_id and text."""
    texts = raw(batch.column("text"))
    chars = np.asarray(pa.compute.fill_null(pa.compute.utf8_length(batch.column("text")), 0), dtype=np.int64)
    number: dict[bytes, int] = {}
    known = number.setdefault
    counts, letters, ids = [], [], []
    for text in texts:
        if len(text) > LONG_TEXT:  # no list of all its words
            ids.append(np.fromiter((known(m[0], len(number)) for m in _WORD.finditer(text)), np.int64))
            letters.append(len(text.translate(None, b"\x20\x09\x0a\x0b\x0c\x0d")))
        else:
            words = text.split()
            letters.append(sum(map(len, words)))
            ids.append(np.fromiter((known(w, len(number)) for w in words), np.int64, len(words)))
        counts.append(len(ids[-1]))
    n_words = np.array(counts, np.int64)
    docs = len(texts)
    doc = np.repeat(np.arange(docs), n_words)
    lengths = repeat_lengths(np.concatenate(ids) if ids else np.empty(0, np.int64), doc, MIN_REPEAT)
    windows = np.where(lengths >= WINDOW, WINDOW, 0)
    n_repeat, n_covered = covered(windows, doc, docs), covered(lengths, doc, docs)
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, doc, lengths)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    too_much = (100 * n_covered > MAX_COVERED_PERCENT * n_words) | ((longest > MAX_LONGEST) & (100 * longest > MAX_LONGEST_PERCENT * n_words))
    sizes = np.array([len(t) for t in texts], np.int64)
    columns = {
        "doc_id": batch.column("doc_id"),
        "n_words": n_words,
        "word_chars": np.array(letters, np.int64) - (sizes - chars),
        "n_symbols": np.array([len(t) - len(t.translate(None, b"#*$%&|<>")) for t in texts], np.int64),
        "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": ~failed & ~too_much,
        "covered_words": n_covered,
        "longest_repeat": longest,
    }
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], names=list(columns))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: word, symbol, line and repetition counts, and the verdict."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield judge(batch)

    return arrow_map(pick(df, id_col, text_col), run, SCHEMA)


def keep(df: DataFrame) -> DataFrame:
    """The rows of a table with doc_id and text that the rules keep, with all their columns; nothing is shuffled.

    Null, empty and blank texts have no words and go; rows with a null doc_id and repeated rows are judged like any other.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(judge(batch).column("kept"))

    return arrow_map(df, run, df.schema)
