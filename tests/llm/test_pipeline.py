"""The pipeline stage by stage against brute force on the smallest table and on odd rows."""

import re
from collections import Counter

from test_dedup import brute_jaccard
from test_text_ops import brute_quality, brute_secrets

import corpus_pipeline
from threadlens.llm import bpe, mixing, secrets
from threadlens.llm.entry import tokenizer_path

SF = "/root/testdata/sf0.001"


def through(spark, docs, tmp_path):
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], SF).write.parquet(str(tmp_path / str(k)))
        out.append(spark.read.parquet(str(tmp_path / str(k))))
    return out


def test_stages(spark, tmp_path):
    tables = through(spark, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path)
    docs, kept, unique, masked, mix, ids = [t.collect() for t in tables]
    assert all(t.columns == tables[0].columns for t in tables[:5])
    text = {r.doc_id: r.text for r in docs}
    assert {r.doc_id for r in kept} <= {d for d, t in text.items() if not brute_quality(t)[5]}
    assert len(kept) > 0.7 * len(docs)
    groups = {d: c for d, _, c in brute_jaccard([(r.doc_id, r.text) for r in kept])}
    assert sorted(r.doc_id for r in unique) == sorted(d for d, c in groups.items() if d == c)
    assert sorted(r.doc_id for r in masked) == sorted(r.doc_id for r in unique)
    for r in masked:
        assert r.n_chars == len(r.text) and not brute_secrets(r.text)
        assert (r.text == text[r.doc_id]) == (not secrets.scan_block([text[r.doc_id].encode()])[0])
    want = {r.doc_id: r.taken for r in mixing.mix(spark, tables[3])[0].collect()}
    got = Counter()
    whole = {r.doc_id: r.text.split() for r in masked}
    for r in mix:
        words = r.text.encode().split()
        got[r.doc_id] += len(words)
        assert not Counter(words) - Counter(w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", " ".join(whole[r.doc_id])))
    assert {d: n for d, n in want.items() if n} == dict(got)
    own = bpe.WordBpe(tokenizer_path("word_bpe_49k.json"))
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids) == Counter((r.doc_id, tuple(own.encode(r.text))) for r in mix)
    assert corpus_pipeline.run(spark, SF).count() == len(mix)


def test_odd_tables(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept string, ids int"
    words = " ".join(f"w{i}" for i in range(200))
    rows = [(1, None, None, None, None, "x", 1), (2, "", "en", "a", 0, "x", 1), (3, words, "en", "a", 5, "x", 1), (3, words, "en", "a", 5, "x", 1), (4, words + " end token=abcdefghijklmnop", None, None, None, None, None)]
    rows += [(None, " ".join(f"v{i}" for i in range(100)), "en", "b", 5, "x", 1)] * 2 + [(None, None, None, "b", None, None, None)]
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    out = [t.collect() for t in through(spark, spark.createDataFrame(rows, kind), tmp_path / "a")]
    ids = lambda rows: sorted((r.doc_id for r in rows), key=str)
    assert ids(out[1]) == [3, 3, 4, None, None] and ids(out[2]) == ids(out[3]) == [3, 3, None, None]
    assert {r.doc_id for r in out[5]} == {3, None} and sum(len(r.text.split()) for r in out[4] if r.doc_id is None) >= 200
    assert [t.count() for t in through(spark, spark.createDataFrame([], kind), tmp_path / "b")] == [0] * 6
