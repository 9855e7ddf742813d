"""BPE encoding and decoding with a contiguous rank array (operator 10).

A short word keeps two flat arrays: part boundaries and the rank of each adjacent pair. The smallest rank is found by
scanning, its boundary is deleted, and only the two neighbouring ranks are looked up again. Scanning costs the square of
the length, so a piece of more than LONG symbols (text without spaces) keeps its ranks in a heap over linked parts
instead; the merges are the same. New words of a slice are encoded together: the arrays of pieces of one length are the
rows of a matrix, and a round merges once in each.

The vocabulary file's path is a parameter. A task remembers a bounded number of words and lets them go when it
ends. Cases: null text is empty and gives no tokens; texts of any length are split at white space, and a long
unbroken word costs n log n; of equal ranks the leftmost pair merges first; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_map, pick

#: Bits of a symbol's number; symbols of a piece that is scanned.
BITS, LONG = 24, 256
#: Pieces of one length that pay for being merged together.
FEW = 16
MASK, NO_RANK = (1 << BITS) - 1, 1 << 60
#: The usual pattern of pieces, in which a word of letters alone is one piece.
CLIP = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space as the vocabulary's pattern has it. str.split() also cuts at U+001C to U+001F, which are not in it.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def merge_parts(parts: list[int], merges: dict[int, int]) -> list[int]:
    """Merge adjacent parts by least rank, leftmost first, until no pair has a rank.

    Parts are numbers of symbols; merges has rank << BITS | merged part by left part << BITS | right part.
    """
    if len(parts) > LONG:
        return merge_long(parts, merges)
    get = merges.get
    ranks = [get(a << BITS | b, NO_RANK) for a, b in zip(parts, parts[1:])]
    while ranks:
        low = min(ranks)
        if low == NO_RANK:
            break
        i = ranks.index(low)
        parts[i] = new = low & MASK
        del parts[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = get(new << BITS | parts[i + 1], NO_RANK)
        if i:
            ranks[i - 1] = get(parts[i - 1] << BITS | new, NO_RANK)
    return parts


def merge_long(parts: list[int], merges: dict[int, int]) -> list[int]:
    """The same merges for a long piece: a heap of (rank, place) over linked parts; entries that no longer hold are passed over."""
    n, get, gone = len(parts), merges.get, -1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := get(a << BITS | b)) is not None]
    heapify(heap)
    while heap:
        r, i = heappop(heap)
        if parts[i] == gone or (j := after[i]) == n or get(parts[i] << BITS | parts[j]) != r:
            continue
        parts[i], parts[j], after[i] = r & MASK, gone, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) < n and (new := get(parts[a] << BITS | parts[b])) is not None:
                heappush(heap, (new, a))
    return [p for p in parts if p != gone]


def merge_rows(parts: np.ndarray, pairs: np.ndarray, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same merges for pieces of one length, a piece a row: (rows, their parts) as they come to an end.

    Each round merges every row's leftmost pair of least rank and takes up one column. pairs: the keys of merges, sorted; found: their values.
    """

    def rank(keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
        return np.where(pairs[at] == keys, found[at], NO_RANK)

    rows, each = np.arange(len(parts)), np.arange(len(parts))
    ranks = rank(parts[:, :-1] << BITS | parts[:, 1:])
    while ranks.shape[1]:
        at = ranks.argmin(axis=1)
        low = ranks[each, at]
        if (ends := low == NO_RANK).any():
            yield rows[ends], parts[ends]
            rows, parts, ranks, at, low = (a[~ends] for a in (rows, parts, ranks, at, low))
            each = np.arange(len(rows))
        columns = np.arange(ranks.shape[1])
        parts = np.where(columns <= at[:, None], parts[:, :-1], parts[:, 1:])
        ranks = np.where(columns[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
        parts[each, at] = new = low & MASK
        left, right = np.flatnonzero(at > 0), np.flatnonzero(at < ranks.shape[1])
        ranks[left, at[left] - 1] = rank(parts[left, at[left] - 1] << BITS | new[left])
        ranks[right, at[right]] = rank(new[right] << BITS | parts[right, at[right] + 1])
    yield rows, parts


def byte_letters() -> list[str]:
    """The printable letter for each byte value: printable Latin-1 stays, the rest follows from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class WordBpe:
    """A word-level BPE vocabulary in the JSON form of the tokenizers library: NFC, lower case, word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.names = {i: s for s, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        # Symbols by number: the vocabulary's ids, and what only merges name behind them.
        number = dict(self.vocab)
        of = lambda symbol: number.setdefault(symbol, len(number) + extra)
        extra = max(self.vocab.values(), default=0) + 1
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(of(left) << BITS | of(right), rank << BITS | of(left + right))
        self.suffix = model.get("end_of_word_suffix") or ""
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pieces = regex.compile(splits[0]["pattern"]["Regex"], regex.V0)
        self.by_letters = splits[0]["pattern"]["Regex"] == CLIP
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # The first number of each byte's letter, inside a piece and at its end.
        letters = byte_letters()
        self.inner, self.last = [of(c) for c in letters], [of(c + self.suffix) for c in letters]
        # By number; empty for what only merges name.
        self.ids, self.tokens = [""] * (len(number) + extra), [""] * (len(number) + extra)
        for token, i in self.vocab.items():
            self.ids[i], self.tokens[i] = str(i), token
        # The same as arrays, for many pieces at once.
        keys, values = np.fromiter(self.merges, np.int64), np.fromiter(self.merges.values(), np.int64)
        order = np.argsort(keys)
        self.pairs, self.found = keys[order], values[order]

    def normal(self, word: str) -> str:
        norm = word if word.isascii() else unicodedata.normalize("NFC", word)
        # Only a capital sigma is lowered by what is around it.
        return norm.lower() if norm.isascii() or "\u03a3" not in norm else "".join([c.lower() for c in norm])

    def piece(self, piece: str) -> tuple[int, str, str]:
        """Count, ids and tokens of a piece of a normal word; ids and tokens joined by a space."""
        data, inner = piece.encode(), self.inner
        parts = [inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        return self._entry(merge_parts(parts, self.merges))

    def _entry(self, parts: list[int]) -> tuple[int, str, str]:
        ids, tokens = [self.ids[p] for p in parts], [self.tokens[p] for p in parts]
        if "" in ids:
            ids, tokens = [i for i in ids if i], [t for i, t in zip(ids, tokens) if i]
        return len(ids), " ".join(ids), " ".join(tokens)

    def entries(self, pieces: list[str]) -> Iterator[tuple[str, tuple[int, str, str]]]:
        """Each of different pieces with its entry, those of one length together; rare lengths and long pieces one by one."""
        inner, last, by_length = np.array(self.inner), np.array(self.last), {}
        for piece in pieces:
            by_length.setdefault(len(data := piece.encode()), []).append((piece, data))
        for length, some in by_length.items():
            if len(some) < FEW or length > LONG or not len(self.pairs):
                yield from ((piece, self.piece(piece)) for piece, _ in some)
                continue
            data = np.frombuffer(b"".join([d for _, d in some]), np.uint8).reshape(-1, length)
            parts = inner[data]
            parts[:, -1] = last[data[:, -1]]
            for rows, ends in merge_rows(parts, self.pairs, self.found):
                yield from ((some[r][0], self._entry(p)) for r, p in zip(rows.tolist(), ends.tolist()))

    def digest_parts(self, text: str, known: "Remembered | None" = None) -> tuple[int, str, str]:
        """Number of tokens, decimal ids joined by a space, decoded text."""
        known = Remembered(self) if known is None else known
        if self.special_split is not None and "<|" in text:
            entries = []
            for k, part in enumerate(self.special_split.split(text)):
                entries += [(1, str(self.special[part]), part)] if k % 2 else known.words(part)
        else:
            entries = known.words(text)
        return joined(entries)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.digest_parts(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as a vocabulary without a decoder is read back; unknown ids are left out."""
        return " ".join([self.names[i] for i in ids if i in self.names])


def joined(entries: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    """The entry of what the entries make up; those without a token are passed over."""
    some = [e for e in entries if e[0]]
    return sum([e[0] for e in some]), " ".join([e[1] for e in some]), " ".join([e[2] for e in some])


def split(text: str) -> list[str]:
    return text.split() if not _ODD_SPACE.search(text) else [w for w in _SPACE.split(text) if w]


class Remembered:
    """Encoded words and the pieces they are made of, in two generations; what the older one still holds costs more look-ups.

    A word that is one normal piece is the same entry as the piece. Strings of more than LONGEST characters are rare and
    large, and are not held: an entry has at most a kilobyte, and a third of one on average.
    """

    MOST, LONGEST = 150_000, 64

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.young: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def _put(self, key: str, entry: tuple[int, str, str]) -> tuple[int, str, str]:
        if len(key) <= self.LONGEST:
            if len(self.young) >= self.MOST:
                self.old, self.young = self.young, {}
            self.young[key] = entry
        return entry

    def _piece(self, piece: str) -> tuple[int, str, str]:
        return self.young.get(piece) or self._put(piece, self.old.get(piece) or self.bpe.piece(piece))

    def _word(self, word: str) -> tuple[int, str, str]:
        entry = self.old.get(word) or self.young.get(word)
        if entry is None:
            pieces = self.bpe.pieces.findall(self.bpe.normal(word))
            if len(pieces) == 1:
                entry = self._piece(pieces[0])
            else:
                entry = joined([self._piece(p) for p in pieces])
        return self._put(word, entry)

    def learn(self, texts: list[str]) -> None:
        """Remember the texts' words: the pieces of those that are new are encoded together. What is not held, words() encodes by itself."""
        young, old, bpe = self.young, self.old, self.bpe
        words = [w for w in set().union(*map(split, texts)) if w not in young and len(w) <= self.LONGEST]
        new = [w for w in words if w not in old]
        for word in words:
            if entry := old.get(word):
                self._put(word, entry)
        # A blank joins no sign to its neighbours, so the words are made normal in one string.
        cut = bpe.pieces.findall
        pieces = [[n] if bpe.by_letters and n.isalpha() else cut(n) for n in bpe.normal(" ".join(new)).split(" ")] if new else []
        known = {p: young.get(p) or old.get(p) for some in pieces for p in some}
        known.update(bpe.entries([p for p, entry in known.items() if entry is None]))
        for piece, entry in known.items():
            self._put(piece, entry)
        for word, some in zip(new, pieces):
            if len(some) != 1 or some[0] != word:
                self._put(word, known[some[0]] if len(some) == 1 else joined([known[p] for p in some]))

    def words(self, text: str) -> list[tuple[int, str, str]]:
        get, new = self.young.get, self._word
        return [get(w) or new(w) for w in split(text)]


@lru_cache(maxsize=1)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Per row: n_tokens, ids (array of int, if asked for), and SHA-256 of the ids and of the decoded text."""

    def start():
        bpe = load(path)
        known = Remembered(bpe)
        return lambda batch: run(batch, bpe, known)

    def run(batch: pa.RecordBatch, bpe: WordBpe, known: Remembered) -> Iterator[pa.RecordBatch]:
        n, id_sums, text_sums, all_ids = [], [], [], []
        texts = [text or "" for text in batch.column("text").to_pylist()]
        known.learn(texts)
        for text in texts:
            count, listed, decoded = bpe.digest_parts(text, known)
            n.append(count)
            id_sums.append(hashlib.sha256(listed.encode()).hexdigest())
            text_sums.append(hashlib.sha256(decoded.encode()).hexdigest())
            if ids:
                all_ids.append(np.fromstring(listed, dtype=np.int32, sep=" "))
        arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if ids:
            offsets = pa.array(np.cumsum([0, *map(len, all_ids)]), pa.int32())
            arrays, names = [*arrays, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int32), *all_ids])))], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    return arrow_map(pick(df, id_col, text_col), start, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids, max_bytes=1 << 20, state=True)
