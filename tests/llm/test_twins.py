"""Brute-force twins of what the methods add to the base: repeats (7), the URL verdict (5), the mix (9), long excerpts (8)."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from test_scan_mix import brute_url_score

from threadlens.llm import mixing, quality, substring, urls


def brute_repeats(words):
    """For each position the longest run from there that also starts elsewhere."""
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while j != i and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def test_quality_verdict():
    rnd = random.Random(4)
    texts = []
    for _ in range(60):
        words = [f"w{rnd.randrange(rnd.choice((4, 40, 4000)))}" for _ in range(rnd.randrange(1, 160))]
        for _ in range(rnd.randrange(3)):  # paste a stretch of it again
            a, n = rnd.randrange(len(words)), rnd.choice((5, 6, 7, 9, 66))
            at = rnd.randrange(len(words) + 1)
            words[at:at] = words[a : a + n]
        texts.append(" ".join(words))
    got = quality.judge(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])).to_pylist()
    verdicts = set()
    for r, text in zip(got, texts):
        words = text.split()
        lengths = [k if k >= 6 else 0 for k in brute_repeats(words)]
        covered = {p for i, k in enumerate(lengths) for p in range(i, i + k)}
        longest = max(lengths)
        too_much = 100 * len(covered) > 30 * len(words) or (longest > 64 and 100 * longest > 15 * len(words))
        assert (r["covered_words"], r["longest_repeat"], r["kept"]) == (len(covered), longest, not (r["base_failed"] or too_much))
        verdicts.add((r["base_failed"], r["kept"]))
    assert verdicts == {(True, False), (False, True), (False, False)}


def test_prefixes_in_text_order():
    """Beyond the bytes kept for ranks, the same lengths are found in text order."""
    rnd = np.random.default_rng(2)
    for n in (1, 2, 7, 50, 400):
        for letters in (1, 2, 30):
            doc, ids = np.sort(rnd.integers(0, 3, n)), rnd.integers(0, letters, n)
            for least in (1, 3, 6):
                assert np.array_equal(quality.repeat_lengths(ids, doc, least, 0), quality.repeat_lengths(ids, doc, least))


def test_very_long_text():
    part = "".join(f"word{i} " for i in range(400_000))
    text = part + "gap " + part[: len(part) // 2] + "x " * 2_000_000
    assert len(text) > quality.LONG_TEXT // 2
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text * 2, "short"])], names=["doc_id", "text"])
    r = quality.judge(batch.slice(0, 1)).to_pylist()[0]
    words = (text * 2).split()
    assert (r["n_words"], r["word_chars"], r["kept"]) == (len(words), sum(map(len, words)), False) and r["longest_repeat"] == len(words) // 2


def test_url_verdict(spark):
    rnd = random.Random(8)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(5))
    rows = [(f"http://{word('abcdef')}.com/{word('abcxy')}", 1) for _ in range(60)] + [(f"http://{word('defxyz')}.net/es/{word('bcxyz')}", 0) for _ in range(60)] + [(f"http://{word('abcdefxyz')}.org/{word('abcxyz')}", -1) for _ in range(60)]
    fold = lambda u: (xxhash.xxh64_intdigest(u.encode(), 42) ^ (1 << 63)) - (1 << 63)  # noqa: E731  signed
    held = next(k for k in range(5) if all(0 < sum(c == cls and fold(u) % 5 == k for u, c in rows) < 60 for cls in (0, 1)))
    counts = [defaultdict(Counter), defaultdict(Counter)]
    for url, cls in rows:
        x = b"\0" * 4 + url.encode() + b"\1"
        for t in range(4, len(x) if cls >= 0 and fold(url) % 5 != held else 0):
            for k in range(5):
                counts[cls][x[t - k : t]][x[t]] += 1
    score = {u: brute_url_score(u, counts) for u, _ in rows}
    tried = []
    for b in range(urls.BINS + 1):
        edge = b * 2 * urls.SPAN / urls.BINS - urls.SPAN
        sides = [[score[u] >= edge for u, c in rows if c == cls and fold(u) % 5 == held] for cls in (0, 1)]
        tried.append((1 - np.mean(sides[1]) + np.mean(sides[0]), edge))
    best = [edge for miss, edge in tried if miss <= min(tried)[0] + 1e-12]
    threshold = best[len(best) // 2]
    got = urls.judge(spark, spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")).collect()
    for r in got:
        url, cls = rows[r.page_id]
        assert abs(r.score - score[url]) < 1e-9
        assert r.verdict == ("allow" if cls == 1 or cls < 0 and score[url] >= threshold else "block")
    assert len({r.verdict for r in got if rows[r.page_id][1] < 0}) == 2


def feistel(i, n, key):
    """One index at a time, in plain numbers."""
    bits = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = (1 << bits) - 1
    while True:
        left, right = i >> bits, i & mask
        for turn in range(4):
            mixed = int(mixing.mix64(np.array([(right * 0x9E3779B97F4A7C15 + key + turn * 0x51ED27) % (1 << 64)], np.uint64))[0])
            left, right = right, left ^ (mixed & mask)
        i = (left << bits) | right
        if i < n:
            return i


def test_mix(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(f"w{k}" for k in range(rnd.choice((0, 3, 40, 700)))), rnd.choice(["a", "b", "c", None])) for i in range(80)]
    docs, slots, spans = (t.collect() for t in mixing.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")))
    size = Counter()
    for _, text, source in rows:
        size[source] += len(text.split())
    plans = mixing.plan_sources(list(size.items()))
    assert [p.source for p in plans] == ["a", "b", "c", None]
    # Each source's slots are dealt out whole and once, and its j-th slot takes the permuted block of its epoch.
    dealt = mixing.deal(plans, 1)
    for k, p in enumerate(plans):
        assert sorted(j for _, s, a, n in dealt if s == k for j in range(a, a + n)) == list(range(p.slots))
    key = {(r.k, r.e): r.h for r in spark.createDataFrame([(k, e) for k in range(4) for e in range(2)], "k int, e long").selectExpr("k", "e", "xxhash64(k, e, 1) as h").collect()}
    taken = {(k, j // p.blocks, feistel(j % p.blocks, p.blocks, key[k, j // p.blocks] % (1 << 64))) for k, p in enumerate(plans) for j in range(p.slots)}
    assert taken == {(r.k, r.epoch, r["index"]) for r in slots} and len(slots) == len(taken)
    # The documents of a source lie side by side, and a taken block takes the words in it.
    place = {r.doc_id: (r.k, r.at, r["size"]) for r in spans}
    lines = defaultdict(list)
    for k, at, n in place.values():
        lines[k].append((at, at + n))
    assert all(b <= c for spans_ in lines.values() for (_, b), (c, _) in zip(sorted(spans_), sorted(spans_)[1:]))
    want = Counter()
    for d, (k, at, n) in place.items():
        for k2, _, index in taken:
            if k2 == k:
                want[d] += max(0, min(at + n, (index + 1) * plans[k].block) - max(at, index * plans[k].block))
    assert {r.doc_id: r.taken for r in docs if r.taken} == dict(want)


def test_substring_long_excerpts(spark):
    """A shared passage far longer than an excerpt."""
    passage = " ".join(f"p{i}" for i in range(2 * substring.EXCERPT + 500))
    rows = [(1, "a b c " + passage + " end"), (2, passage), (3, "x " + passage + " y z"), (4, "alone")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), slice_words=30_000).collect()}
    n = 2 * substring.EXCERPT + 500
    assert got == {1: (n + 4, 0), 2: (n, n), 3: (n + 3, n), 4: (1, 0)}
