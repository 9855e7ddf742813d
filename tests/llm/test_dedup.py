"""Substring dedup (8) against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from threadlens.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute_substring(rows):
    first = defaultdict(set)
    for doc, text in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - 12):
            first[tuple(w[i : i + 13])].add(doc)
    out = []
    for doc, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - 12):
            if min(first[tuple(w[i : i + 13])]) < doc:
                gone |= set(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def made_up(seed, n=120, vocabulary=400):
    rnd = random.Random(seed)
    words = [f"w{i}é" for i in range(vocabulary)]
    passages = [[rnd.choice(words) for _ in range(rnd.randrange(10, 60))] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "short one"), (3, "a " * 300), (4, "a " * 200), (5, "x" * 3000)]
    for i in range(6, n):
        body = [rnd.choice(words) for _ in range(rnd.randrange(40))]
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            body += p[a : a + rnd.randrange(5, 60)] + [rnd.choice(words) for _ in range(rnd.randrange(5))]
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(body)))
    rnd.shuffle(rows)
    return rows + [rows[7], (rows[8][0], rows[9][1])]


def as_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("body", F.lit(1)).withColumn("src", F.lit(1)).repartition(5)


def run_substring(spark, rows, **more):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(spark, as_table(spark, rows), **more).collect())


def test_substring_made_up(spark):
    rows = made_up(1)
    assert run_substring(spark, rows) == brute_substring(rows)


def test_substring_sliced_groups(spark):
    rows = made_up(2, 60)
    assert run_substring(spark, rows, slice_words=60) == brute_substring(rows)


def test_substring_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert run_substring(spark, rows) == brute_substring(rows)


def test_substring_empty(spark):
    assert run_substring(spark, []) == []


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def brute_jaccard(rows):
    sets = {}
    for doc, text in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    docs = sorted(sets)
    links = []
    for x, a in enumerate(docs):
        for b in docs[x + 1 :]:
            if sets[a] and sets[b] and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])):
                inter = len(sets[a] & sets[b])
                if 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
                    links.append((a, b))
    root = components(docs, links)
    return sorted((d, len(sets[d]), root[d]) for d, _ in rows)


def near_copies(seed, groups=6, size=25):
    """Chains and stars of near copies around the threshold, exact copies, and a line that all share."""
    rnd = random.Random(seed)
    words = [f"W{i}é" for i in range(900)]
    line = [rnd.choice(words) for _ in range(15)]
    rows = [(0, None), (1, ""), (2, "Three little words"), (3, "three LITTLE words"), (4, " \n"), (5, "one two three four five"), (6, "a " * 500)]
    n = 7
    for _ in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.randrange(30, 120))] + line
        for k in range(size):
            doc = list(base)
            for _ in range(rnd.randrange(5)):
                doc[rnd.randrange(len(doc))] = rnd.choice(words)
            if k % 5 == 0:
                base = doc
            rows.append((n, " ".join(doc)))
            n += 1
    rows += [(n + i, " ".join([rnd.choice(words) for _ in range(40)] + line)) for i in range(40)]
    rows.append((n + 50, rows[10][1].upper().replace("É", "é")))
    rnd.shuffle(rows)
    return rows


def run_jaccard(spark, rows, **more):
    from threadlens.llm import jaccard

    table = as_table(spark, rows).withColumn("n", F.lit(1))
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(spark, table, **more).collect())


def test_jaccard_near_copies(spark):
    for seed in (1, 2):
        rows = near_copies(seed)
        assert run_jaccard(spark, rows) == brute_jaccard(rows)


def test_jaccard_cut_regions(spark):
    rows = near_copies(3, 2, 60)
    assert run_jaccard(spark, rows, caps=(20, 7)) == brute_jaccard(rows)


def test_jaccard_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert run_jaccard(spark, rows) == brute_jaccard(rows)
    assert run_jaccard(spark, []) == []


def brute_links(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    close = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    return sorted((d, sum(close(a, b) for j, b in enumerate(sets) if j != i)) for i, ((d, _), a) in enumerate(zip(rows, sets)))


def test_jaccard_counts_every_link(spark):
    from threadlens.llm import jaccard

    rows = near_copies(4, 3, 90)
    rnd = random.Random(11)
    body = [f"v{i}" for i in range(120)]
    for i in range(70):  # one group of which nearly all pairs link
        doc = list(body)
        for _ in range(rnd.randrange(4)):
            doc[rnd.randrange(len(doc))] = f"x{rnd.randrange(10**6)}"
        rows.append((8000 + i, " ".join(doc)))
    rows += [rows[20], (9000, rows[21][1]), (9001, rows[21][1])]
    want = brute_links(rows)
    assert max(n for _, n in want) > 10
    for caps in ((16_000, 3_000), (50, 20)):
        got = sorted((r.doc_id, r.n_links) for r in jaccard.similar(spark, as_table(spark, rows), caps=caps).collect())
        assert got == want


def test_region_counts_each_link_once():
    import numpy as np

    from threadlens.llm import jaccard

    rnd = random.Random(10)
    base = [set(rnd.sample(range(4000), 60)) for _ in range(12)]
    sets = []
    for _ in range(400):
        s = set(rnd.choice(base))
        for _ in range(rnd.randrange(8)):
            s.discard(rnd.choice(sorted(s)))
            s.add(rnd.randrange(4000))
        sets.append(s)
    region = jaccard.Region([np.array(sorted(s), np.uint64) for s in sets], 80)
    region.join(np.arange(len(sets)))
    assert region.links.tolist() == [sum(100 * len(a & b) >= 80 * len(a | b) for b in sets) - 1 for a in sets]


def test_region_recursion():
    import numpy as np

    from threadlens.llm import jaccard

    rnd = random.Random(9)
    for _ in range(4):
        sets, base = [], [set(rnd.sample(range(4000), 60)) for _ in range(12)]
        for _ in range(300):
            s = set(rnd.choice(base))
            for _ in range(rnd.randrange(8)):
                s.discard(rnd.choice(sorted(s)))
                s.add(rnd.randrange(4000))
            sets.append(s)
        docs = np.array(rnd.sample(range(1000), len(sets)))
        links = [(int(docs[i]), int(docs[j])) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        want = components(docs.tolist(), links)
        got = dict(jaccard.join_sets(docs, [np.array(sorted(s), np.uint64) for s in sets], 80))
        assert {d: got.get(d, d) for d in docs.tolist()} == want


def brute_vectors(rows):
    import numpy as np

    ok = {}
    for i, (_, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x = np.array(v, float)
            x /= np.abs(x).max()
            ok[i] = x / np.linalg.norm(x)
    links = [(i, j) for i in ok for j in ok if i < j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= 0.9]
    n = defaultdict(int)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    root = components([r[0] for r in rows], [(rows[i][0], rows[j][0]) for i, j in links])
    return sorted((r[0], n[i], root[r[0]], root[r[0]] == r[0]) for i, r in enumerate(rows))


def test_vectors(spark):
    import numpy as np

    from threadlens.llm import vectors

    rng = np.random.default_rng(1)
    rows = [(0, None), (1, []), (2, [0.0] * 64), (3, [None] + [1.0] * 63), (4, [float("nan")] * 64), (5, [float("inf")] + [0.0] * 63), (6, [1.0, 0.0]), (7, [2.0, 0.1]), (8, [1e300] * 64), (9, [1e-300] * 64)]
    for i in range(30):
        c = rng.standard_normal(64)
        for k in range(10):
            rows.append((len(rows), (c + rng.standard_normal(64) * rng.choice([0, 0.2, 0.4, 0.6])).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("weight", F.lit(1)).repartition(3)
    for cap in (12_000, 40):
        got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near(spark, df, cap=cap).collect())
        assert got == brute_vectors(rows)
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near(spark, spark.read.parquet(f"{SF}/embeddings.parquet")).collect())
    assert got == brute_vectors(data)
    assert vectors.near(spark, df.limit(0)).collect() == []


def test_meetings(spark):
    """Every key's documents with its smallest one, whether the key is rare, in many batches, or in most rows of one."""
    from threadlens.llm.common import KEYS, Kept, handing_back, meetings, packed_keys

    rng = np.random.default_rng(3)
    rows = [(7, d) for d in range(5000, 100, -1)] + [(8, d) for d in range(0, 5000, 250)] + [(9, 11), (10, 12), (10, 12)]
    rows += [(int(k) - 50, int(d)) for k, d in zip(rng.integers(0, 100, 8000) ** 2, rng.integers(-300, 3000, 8000))]
    rng.shuffle(rows)
    rows = [(int(k), int(d)) for k, d in rows]

    def pack(batches):
        for b in batches:
            yield packed_keys(b.column("key").to_numpy(), b.column("doc").to_numpy())

    docs = {}
    for k, d in rows:
        docs.setdefault(k, set()).add(d)
    want = {(k, d, min(ds)) for k, ds in docs.items() if len(ds) > 1 for d in ds}
    for files in (1, 7, 300):
        keys = spark.createDataFrame(rows, "key long, doc long").repartition(files).mapInArrow(handing_back(pack), KEYS)
        found = meetings(Kept(spark), "met", keys, 5).collect()
        assert {tuple(r) for r in found} - {(10, 12, 12)} == want
        if files < 300:  # few batches hold nearly every key often
            assert max(len(r.more or b"") for r in keys.where("salt = 0").collect()) <= 16 * 8
    assert meetings(Kept(spark), "met", keys.limit(0), 5).collect() == []
