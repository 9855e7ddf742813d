"""Odd tables through every operator: empty, null in any column, repeated rows, and extra columns with clashing names."""

import numpy as np
import pytest

from threadlens.llm import bpe, entry, jaccard, mixing, packing, pii, quality, secrets, substring, urls, vectors

#: Names that the operators use inside.
CLASHES = "kind k at size epoch low high key doc first more p uid start end row found weight n sig_a component_id class_id taken part i j what n_chars _stay lang".split()
WORDS = " ".join(f"w{i}" for i in range(60))
SECRET = "mail a.b@example.com token=abcdefghijklmnop "
TEXTS = [(1, SECRET + WORDS, "s"), (1, SECRET + WORDS, "s"), (2, SECRET + WORDS, None), (None, WORDS, "s"), (3, None, "s"), (4, "", "t"), (5, " \n\t ", "t"), (None, None, None), (6, WORDS, "u")]


def table(spark, rows, first):
    kinds = ", ".join(f"{n} {t}" for n, t in first) + ", " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], kinds)


def documents(spark, rows):
    return table(spark, rows, [("doc_id", "long"), ("text", "string"), ("source", "string")])


OVER_TEXTS = {
    "pack": lambda spark, d: packing.pack(d, lambda: lambda text: np.frombuffer(text.encode(), np.uint8).astype(np.int64)),
    "similar": lambda spark, d: jaccard.similar(spark, d),
    "one_of_each": lambda spark, d: jaccard.one_of_each(spark, d),
    "pii": lambda spark, d: pii.scan(d),
    "secrets": lambda spark, d: secrets.scan(d),
    "mask": lambda spark, d: secrets.mask(d),
    "quality": lambda spark, d: quality.quality(d),
    "keep": lambda spark, d: quality.keep(d),
    "substring": lambda spark, d: substring.dedup(spark, d),
    "mix": lambda spark, d: mixing.mix(spark, d)[0],
    "mixed": lambda spark, d: mixing.mixed(spark, d),
    "bpe": lambda spark, d: bpe.encode_documents(d, entry.tokenizer_path("word_bpe_49k.json")),
}
ROW_BY_ROW = {"similar", "pii", "secrets", "mask", "quality", "substring", "mix", "bpe"}


@pytest.mark.parametrize("name", OVER_TEXTS)
def test_texts(spark, name):
    got = OVER_TEXTS[name](spark, documents(spark, TEXTS)).collect()
    if name in ROW_BY_ROW:
        assert sorted(str(r.doc_id) for r in got) == sorted(str(t[0]) for t in TEXTS)
    if name == "similar":
        by = {r.doc_id: r for r in got if r.doc_id is not None}
        assert [(d, by[d].component_id, by[d].n_links) for d in (1, 2, 3, 4, 5, 6)] == [(1, 1, 3), (2, 1, 3), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 1, 3)]  # rows, repeated ones too
        assert all(r.component_id is None and r.n_links == 0 for r in got if r.doc_id is None)
    if name == "one_of_each":
        assert sorted((r.doc_id for r in got), key=str) == [1, 1, 3, 4, 5, None, None]
    if name == "substring":
        assert {(r.doc_id, r.n_removed) for r in got if r.doc_id in (1, 2, 6)} == {(1, 0), (2, 63), (6, 60)}
        assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    if name == "mixed":
        assert got and all(r.kind == "x" and r.k == "x" and r.n_chars == "x" for r in got)
    if name in ("keep", "mask", "mixed", "one_of_each"):
        assert set(got[0].asDict()) == {"doc_id", "text", "source", *CLASHES}
    assert OVER_TEXTS[name](spark, documents(spark, [])).collect() == []


def test_vectors(spark):
    near = [1.0] * 20
    rows = [(1, near), (1, near), (2, near), (None, near), (3, [1.0, None]), (4, None), (5, []), (6, [0.0] * 20), (7, [float("nan")] * 20), (8, [1.0] * 19 + [1.5]), (9, [2.0])]
    make = lambda rows: table(spark, rows, [("vec_id", "long"), ("embedding", "array<double>")])
    got = vectors.near(spark, make(rows)).collect()
    assert len(got) == len(rows)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id in (1, 2, 8)} == {(1, 3, 1, True), (2, 3, 1, False), (8, 3, 1, False)}
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if r.vec_id not in (1, 2, 8))
    assert vectors.near(spark, make([])).collect() == []


def test_single_precision_vectors(spark):
    rows = [(1, [3e38, 3e38]), (2, [1e-45, 1e-45]), (3, [-0.0, 1.0]), (4, [0.0, 1.0]), (5, [float("inf"), 1.0]), (6, [0.0, 0.0]), (7, None)]
    got = vectors.near(spark, table(spark, rows, [("vec_id", "long"), ("embedding", "array<float>")])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 0, 6), (7, 0, 7)]


def test_urls(spark):
    make = lambda rows: table(spark, rows, [("page_id", "long"), ("url", "string")])
    rows = [(1, None), (None, "http://a.com/x"), (2, ""), (3, "no scheme"), (4, "http://b.net/es/" + "y" * 100_000), (4, "http://b.net/es/" + "y" * 100_000), (5, "http://c.org/q"), (6, "http://c.org/q")]
    got = urls.judge(spark, make(rows)).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in rows)
    by = {r.page_id: r for r in got}
    assert (by[1].host, by[1].path, by[1].rule) == ("", "", None) and by[4].verdict == "block" and by[None].verdict == "allow"
    assert by[5].score == by[6].score and by[5].verdict == by[6].verdict
    assert urls.judge(spark, make([])).collect() == []


def test_ids_beyond_the_width_are_refused(spark):
    wide = lambda: lambda text: np.full(len(text), 70_000)
    with pytest.raises(Exception, match="pack with wide=True"):
        packing.pack(documents(spark, [(1, "abc", "s")]), wide).collect()
    assert packing.pack(documents(spark, [(1, "abc", "s")]), wide, wide=True).count() == 1
