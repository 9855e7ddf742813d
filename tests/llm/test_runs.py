"""Periodic runs (operator 11) against brute force over words."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.llm import quality, runs
from threadlens.llm.entry import op11_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute(words):
    """Every (start, length, period): stretches that hold a period and grow no further, the smallest period of each."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if (length := j + q - i) >= max(24, 3 * q):
                out.setdefault((i, length), q)
            i = j
    return sorted((a, n, q) for (a, n), q in out.items())


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def want(doc_id, text, plant=True):
    words = WORD.findall(text or "")
    words = planted(doc_id, words) if plant and doc_id is not None else words
    found = brute(words)
    gone = {k for a, n, q in found for k in range(a + q, a + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def odd_words(rnd):
    """Runs next to each other, within each other, at the ends, of repeats of repeats, and stretches just too short."""
    unit = lambda: [rnd.choice("abc") for _ in range(rnd.choice((1, 1, 2, 3, 5, 8, 9, 13)))]
    out = []
    for _ in range(rnd.randrange(1, 6)):
        u = unit()
        if rnd.random() < 0.3:
            u = u * rnd.randrange(2, 30) + unit()
        n = rnd.choice((0, 23, 24, 25, 3 * len(u) - 1, 3 * len(u), 3 * len(u) + 1, rnd.randrange(1, 90)))
        out += (u * (n // len(u) + 1))[:n] + [rnd.choice("abxyz") for _ in range(rnd.randrange(4))]
    return out


def test_runs_brute():
    rnd = random.Random(3)
    for _ in range(400):
        docs = [odd_words(rnd) for _ in range(rnd.randrange(1, 5))]
        code = {w: k for k, w in enumerate("abcxyz")}
        ids, doc = np.array([code[w] for d in docs for w in d], np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        got = runs.find_runs(ids, doc)
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, d in enumerate(docs) for r in brute(d)]


def test_tree_by_both_ways():
    """Sorted suffixes, prefixes and nodes by brute force, with prefixes by level and in text order."""
    rnd = random.Random(8)
    for _ in range(100):
        sizes = [rnd.randrange(1, 30) for _ in range(3)]
        doc, ids = np.repeat(np.arange(3), sizes), np.array([rnd.randrange(2) for _ in range(sum(sizes))])
        ends = np.searchsorted(doc, doc, side="right")
        suffix = [(int(doc[i]), *ids[i : ends[i]].tolist()) for i in range(len(ids))]
        order = sorted(range(len(ids)), key=suffix.__getitem__)
        common = [0]
        for a, b in zip(order, order[1:]):
            same = [x == y for x, y in zip(suffix[a], suffix[b])]
            common.append(max(0, (same + [False]).index(False) - 1))
        for level_bytes in (1 << 20, 0):
            pos, shared = runs.sorted_suffixes(ids, doc, level_bytes)
            assert pos.tolist() == order and shared.tolist() == common
        nodes = set()
        for k in range(1, len(common)):
            if common[k]:
                a = max([j for j in range(k) if j == 0 or common[j] < common[k]])
                b = min([j for j in range(k, len(common) + 1) if j == len(common) or common[j] < common[k]]) - 1
                nodes.add((common[k], a, b))
        got = runs.inner_nodes(np.array(common))
        assert {tuple(c) for c in got[:3].T.tolist()} == nodes and got.shape[1] == len(nodes)
        for d, a, b, low, high in got.T.tolist():
            children = [(x, y) for _, x, y in nodes if a <= x and y <= b and (x, y) != (a, b)]
            assert high - low == max([y - x for x, y in children], default=0) and a <= low <= high <= b and (high == low or (low, high) in children)


def test_long_repeats_stay_fast():
    n = 300_000
    one = np.zeros(n, np.int64)
    assert runs.find_runs(one, one).tolist() == [[0, 0, n, 1]]
    three = np.arange(n) % 3
    assert runs.find_runs(three, one).tolist() == [[0, 0, n, 3]]
    fib = [np.array([0]), np.array([0, 1])]
    while len(fib[-1]) < 20_000:
        fib.append(np.r_[fib[-1], fib[-2]])
    got = runs.find_runs(fib[-1], np.zeros(len(fib[-1]), np.int64))
    assert len(got) and all((fib[-1][a : a + m - q] == fib[-1][a + q : a + m]).all() for _, a, m, q in got)


def columns(r):
    return (r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text) < 30_000}
    got = [r for r in op11_periodic_runs(spark, SF).collect() if r.doc_id in texts]
    assert sorted(map(columns, got)) == sorted(want(d, t) for d, t in texts.items())
    assert sum(r.n_runs > 0 for r in got) > 5


@pytest.mark.parametrize("long_text", [quality.LONG_TEXT, 10])
def test_cases(spark, monkeypatch, long_text):
    monkeypatch.setattr(runs, "LONG_TEXT", long_text)  # functions of a test session are pickled by name, so call them here too
    rnd = random.Random(9)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "ñ " * 24), (5, "ñ " * 23), (None, "a b\x0b" * 30), (None, None), (6, "x" * 100_000), (7, "a\x1cb c\xa0d\n" * 40)]
    rows += [(10 + k, " ".join(odd_words(rnd))) for k in range(60)]
    rows += [rows[3]] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("runs", "start", "n_words", "best", "collapsed", "lines")})
    key = lambda r: (str(r[0]), r[-1])
    for plant in (False, True):
        got = runs.digest(runs.scan(df, planted=plant)).collect()
        assert sorted(map(columns, got), key=key) == sorted((want(d, t, plant) for d, t in rows), key=key)
    assert runs.digest(runs.scan(df.limit(0))).collect() == []
    for text in (b" a  bb\tccc\n", b"", b"   "):
        long = runs.LongWords(text)
        assert [long[k] for k in range(len(long))] == text.split() and runs.joined(long, np.arange(len(long))) == b" ".join(text.split())
