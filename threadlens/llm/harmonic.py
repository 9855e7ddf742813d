"""Harmonic packing of token ids into fixed-length sequences (operator 13).

A piece of length n belongs to class k = limit // n, the reciprocal of its share of a sequence, and a bin of class k takes
k pieces, whatever else there is: a worker keeps one open bin a class, so workers pack their partitions independently,
nothing is shuffled, and what waits is bounded by one sequence a class.

Documents may be cut, so little is padded. Whole sequences are cut off first. A rest that fills its class's bins to
1 - 1 / FILL or better stays whole; from another the exact share of the next class is cut off, and the remainder goes on.
Bins that are still open at a worker's end are cut into powers of two and dealt to the classes of those; what then remains
makes sequences of a power of two, which are not padded.

Cases: null and empty texts are the end id alone; texts of any length are encoded and cut chunk by chunk of their words; pieces of one
class are packed in the order of the partition; repeated rows are packed as often as they occur; a null doc_id is carried; an empty table
gives no rows; other columns are ignored. A recomputed partition gives the same rows.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .bpe import byte_letters, load
from .common import handing_back, in_batches, pick, slices

LIMIT, END_ID, FILL = 2048, 1, 64
#: Bytes from which a text is encoded in parts; pieces that a generation remembers, and the longest of them.
CHUNK, MOST_PIECES, LONGEST = 4 << 20, 150_000, 64
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_SPACE = re.compile("[ \t-\r]")
#: doc_id, start, ids (four bytes each), tokens of the document
Piece = tuple[int | None, int, bytes, int]


@lru_cache(maxsize=4096)
def rest_lengths(rest: int, limit: int = LIMIT) -> tuple[int, ...]:
    """Lengths that a rest of fewer than `limit` tokens is cut into."""
    out = []
    while rest:
        k = limit // rest
        out.append(rest if FILL * k * rest >= (FILL - 1) * limit else limit // (k + 1))
        rest -= out[-1]
    return tuple(out)


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def powers(length: int) -> list[int]:
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def cut(piece: Piece, lengths: list[int] | tuple[int, ...]) -> Iterator[Piece]:
    """The piece cut into the lengths given."""
    doc, start, ids, total = piece
    at = 0
    for n in lengths:
        yield doc, start + at, ids[4 * at : 4 * (at + n)], total
        at += n


class Packer:
    """Open bins of one worker; a full one leaves as a list of pieces."""

    def __init__(self, limit: int = LIMIT):
        if limit & (limit - 1):
            raise ValueError("a sequence's limit is a power of two")
        self.limit, self.open = limit, defaultdict(list)

    def _put(self, piece: Piece) -> Iterator[list[Piece]]:
        k = self.limit // (len(piece[2]) // 4)
        self.open[k].append(piece)
        if len(self.open[k]) == k:
            yield self.open.pop(k)

    def add(self, document: Piece) -> Iterator[list[Piece]]:
        """Sequences that a document's pieces fill."""
        n = len(document[2]) // 4
        for piece in cut(document, [self.limit] * (n // self.limit) + list(rest_lengths(n % self.limit, self.limit))):
            yield from self._put(piece)

    def finish(self) -> Iterator[list[Piece]]:
        """What is open, cut into powers of two."""
        left, self.open = [p for k in sorted(self.open) for p in self.open[k]], defaultdict(list)
        for piece in left:
            for part in cut(piece, powers(len(piece[2]) // 4)):
                yield from self._put(part)
        for k in sorted(self.open):
            at = 0
            for n in powers(len(self.open[k])):
                yield self.open[k][at : at + n]
                at += n


def pack(df: DataFrame, tokenizer: Callable[[], Callable[[pa.Array], Iterator[bytes]]], limit: int = LIMIT, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start in its document, length, ids (little-endian, four bytes each), tokens of the document with
    the end id, sequence_id, and offset in the sequence. tokenizer(), called in each worker, gives a function from a column of texts to each one's ids."""
    end = pack_ids([end_id])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encode, packer, made = tokenizer(), Packer(limit), TaskContext.get().partitionId() << 36

        def documents() -> Iterator[Iterator[list[Piece]]]:
            for part in slices(batches):
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text"))):
                    yield packer.add((doc, 0, ids + end, len(ids) // 4 + 1))
            yield packer.finish()

        for sequences in documents():
            for sequence in sequences:
                offset = 0
                for doc, start, ids, total in sequence:
                    yield doc, start, len(ids) // 4, ids, total, made, offset
                    offset += len(ids) // 4
                made += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(rows(batches), _ARROW)

    return pick(df, id_col, text_col).mapInArrow(handing_back(run), SCHEMA)


class Words:
    """Ids of words as four bytes each; the pieces that words are made of are remembered, in two generations."""

    def __init__(self, path: str):
        self.library, self.spec = Tokenizer.from_file(path), load(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.letters = self.library.model, byte_letters()
        self.packed = [pack_ids([i]) for i in range(max(self.spec.names, default=-1) + 1)]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            symbols = piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode()])
            ids = b"".join([self.packed[t.id] for t in self.model.tokenize(symbols)])
        if len(piece) <= LONGEST:
            if len(self.young) >= MOST_PIECES:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def ids(self, word: str) -> bytes:
        """Ids of a word, or of a text whose white space need not be ASCII."""
        normal = word.lower() if word.isascii() else self.spec.normal(word)
        if normal.isalpha():  # one piece
            return self.young.get(normal) or self._piece(normal)
        if (core := normal[:-1]).isalpha() and (mark := normal[-1]) in ".,;:!?":  # two
            return (self.young.get(core) or self._piece(core)) + (self.young.get(mark) or self._piece(mark))
        if any(token in word for token in self.spec.special):
            return pack_ids(self.library.encode(word, add_special_tokens=False).ids)
        return b"".join([self.young.get(p) or self._piece(p) for p in self.spec.pieces.findall(normal)])

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind another, and where each text's begin. Words are looked up once, however often they occur.

        Texts are cut at white space of ASCII; other white space within a word is left out with its pieces.
        """
        split = pa.compute.ascii_split_whitespace(pa.compute.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        found = coded.dictionary
        # One string cut at line feeds is quicker than a string a word.
        each_word = pa.compute.binary_join(pa.ListArray.from_arrays([0, len(found)], found), "\n")[0].as_py().split("\n") if len(found) else []
        number, each = coded.indices.to_numpy(), list(map(self.ids, each_word))
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        known, begins = np.frombuffer(b"".join(each), "<u4"), np.cumsum(sizes) - sizes
        of_word = sizes[number]
        upto = np.cumsum(np.r_[0, of_word])
        where = np.repeat(begins[number] - upto[:-1], of_word) + np.arange(upto[-1])
        return known[where], upto[split.offsets.to_numpy() - split.offsets[0].as_py()]


@lru_cache(maxsize=1)
def words(path: str) -> Words:
    return Words(path)


def chunks(text: str) -> Iterator[str]:
    """The text in parts of about CHUNK characters that end where a word does."""
    at = 0
    while len(text) - at > CHUNK and (space := _SPACE.search(text, at + CHUNK)):
        yield text[at : space.start()]
        at = space.start()
    yield text[at:]


def word_ids(path: str) -> Callable[[], Callable[[pa.Array], Iterator[bytes]]]:
    """Ids by a vocabulary file of the tokenizers library whose words are encoded by themselves: NFC, lower case, white space dropped,
    words split by a pattern into pieces of byte letters."""

    def encode(texts: pa.Array) -> Iterator[bytes]:
        if len(texts) == 1 and texts[0].is_valid and len(texts[0].as_buffer()) > CHUNK:
            yield b"".join([words(path).of(pa.array([part]))[0].tobytes() for part in chunks(texts[0].as_py())])
            return
        ids, at = words(path).of(texts)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield ids[a:b].tobytes()

    return lambda: encode


def text_ids(path: str) -> Callable[[], Callable[[pa.Array], Iterator[bytes]]]:
    """Ids by any vocabulary file of the tokenizers library, from whole texts."""

    def make() -> Callable[[pa.Array], Iterator[bytes]]:
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        return lambda texts: (pack_ids(library.encode(t or "", add_special_tokens=False).ids) for t in texts.to_pylist())

    return make
