"""Harmonic packing (operator 13): pieces against the library's ids, bins and padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadlens.llm import harmonic
from threadlens.llm.entry import op13_harmonic_packing, tokenizer_path

SF = "/root/testdata/sf0.001"


def library():
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, want, most_padding):
    """rows: pieces with ids or their checksum; want: (doc_id, ids) of every document, ids being unlike or doc_ids unique."""
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    assert set(pieces) == {d for d, _ in want}
    copies = defaultdict(list)
    for d, ids in want:
        copies[d].append(ids)
    for d, all_ids in copies.items():
        ids, n = all_ids[0], len(all_ids)
        assert all(i == ids for i in all_ids)
        at = 0
        own = sorted(pieces[d], key=lambda r: (r["start"], r["length"]))
        for r in own[::n]:
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    padding = total = 0
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        total += at
    assert padding <= most_padding * (padding + total)
    return padding / max(1, padding + total)


def test_whole_table(spark):
    ids = library()
    docs = [(r.doc_id, ids(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [r.asDict() for r in op13_harmonic_packing(spark, SF).collect()]
    check(rows, docs, 0.01)
    assert len(rows) < 6 * len(docs)


def test_cases(spark):
    ids = library()
    odd = ["Hello wörld's  <|endoftext|> x1234 ÀÉ ﬁ don't", "<|startoftext|><|endoftext|>a<|b", "á ́b", "ΟΔΟΣ Σ", "a\x1cb\x85c\xa0d", "İstanbul ẞ", "日本語 🙂🙂 ​", "가각", "x" * 3000]
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a null id"), (4, "same words " * 700), (4, "same words " * 700), (5, "w " * 2047), (6, "w " * 2048), (7, "word ñu\x0b" * 200_000)]
    rows += [(10 + k, t) for k, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("ids", "start", "length", "offset", "sequence_id", "kind")})
    path = tokenizer_path("word_bpe_49k.json")
    for parts, make in ((1, harmonic.word_ids), (3, harmonic.word_ids), (2, harmonic.text_ids)):
        got = harmonic.pack(df.repartition(parts), make(path))
        rows_ = [r.asDict() | {"ids_crc32": zlib.crc32(r.ids)} for r in got.collect()]
        check(rows_, [(d, ids(t)) for d, t in rows], 0.02)
        assert [r.asDict() for r in got.collect()] == [r.asDict() for r in got.collect()]
    assert harmonic.pack(df.limit(0), harmonic.word_ids(path)).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        harmonic.Packer(1000)


def test_lengths():
    worst = 0
    for limit in (64, 2048):
        for rest in range(limit):
            cut = harmonic.rest_lengths(rest, limit)
            assert sum(cut) == rest and all(cut) and len(cut) <= 8
            if limit == 2048:
                worst = max([worst, *[1 - (limit // n) * n / limit for n in cut]])
    assert worst < 0.025


def test_bins_hold_a_fixed_number_of_pieces():
    """Whatever comes, a sequence is full by count, holds one class, or is a power of two; few bins wait."""
    rnd = random.Random(2)
    for longest in (3, 60, 5000):
        packer, n, out = harmonic.Packer(), 0, []
        for d in range(800):
            length = rnd.randrange(1, longest)
            n += length
            out += list(packer.add((d, 0, b"\0" * 4 * length, length)))
            assert sum(len(p[2]) // 4 for b in packer.open.values() for p in b) <= 2048 * len(packer.open)
        for b in out:
            assert len({2048 // (len(p[2]) // 4) for p in b}) == 1 and len(b) == 2048 // (len(b[0][2]) // 4)
        last = list(packer.finish())
        for b in last:
            size = sum(len(p[2]) // 4 for p in b)
            assert size & (size - 1) == 0 or len(b) == 2048 // (len(b[0][2]) // 4)
        assert sum(len(p[2]) // 4 for b in out + last for p in b) == n


def test_every_way_of_encoding(monkeypatch):
    """Chunks, forgetting, every white space, odd words: the ids are the library's for the whole text."""
    path, ids = tokenizer_path("word_bpe_49k.json"), library()
    spaces = [chr(c) for c in range(0x10000) if chr(c).isspace()] + ["\u180e", "\u200b", "\ufeff", "\x00"]
    parts = ["ab ", "ünï\n", "x" * 70 + " ", "c\x1cd ", "don't", "\xa0", "ǅ ", "Σς ", "e\u0301 ", "<|endoftext|>", "ª² ", "İ ", "日本 ", "ﬁ,", "٣٤ ", "A1b2 ", "…", "𝐚b "]
    texts = ["a" + s + "b" + s + s + "c" for s in spaces] + ["".join(random.Random(k).choices(parts, k=400)) for k in range(8)] + ["", " ", None]
    for chunk, most in ((4 << 20, 150_000), (100, 150_000), (100, 3), (1, 1)):
        monkeypatch.setattr(harmonic, "CHUNK", chunk)
        monkeypatch.setattr(harmonic, "MOST_PIECES", most)
        harmonic.words.cache_clear()
        for t in texts[-11:-3]:
            assert "".join(harmonic.chunks(t)) == t
        for some in (texts, [t for t in texts if not t or not set(t) & set("\x1c\x1d\x1e\x1f")], *[[t] for t in texts]):
            got = [np.frombuffer(i, "<u4").tolist() for i in harmonic.word_ids(path)()(pa.array(some, pa.string()).slice(0))]
            assert got == [ids(t)[:-1] for t in some]
        assert [np.frombuffer(i, "<u4").tolist() for i in harmonic.word_ids(path)()(pa.array(texts, pa.string()).slice(3, 9))] == [ids(t)[:-1] for t in texts[3:12]]
        known = harmonic.words(path)
        assert all(len(w) <= harmonic.LONGEST for w in {**known.young, **known.old})
    harmonic.words.cache_clear()
