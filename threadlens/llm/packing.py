"""Token-id packing into fixed-length rows (operator 1).

Documents are tokenized, overlong ones split into pieces without loss, and the pieces of a shard are packed by
best-fit decreasing: a segment tree over remaining capacities finds the fullest row that still has room. A row is
written as a binary id vector of the row length (so a file is an id matrix), cumulative segment lengths, position ids
that restart at each segment, and for each segment its document and offset in that document.

A shard is a bounded run of tokens within an input partition, so memory is bounded and nothing is shuffled; a
recomputed partition gives the same rows. Cases: null and empty texts have no tokens and take no place; texts of any
length are split; pieces of equal length are placed in the order of the shard; repeated rows are packed as often as they
occur; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import handing_back, pick, slices

ROW_TOKENS, SHARD_TOKENS = 2048, 2 << 20
SCHEMA = "pack_id long, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, piece_starts array<long>"


class CapacityTree:
    """Segment tree over remaining capacities 0..limit; a node counts the rows below it."""

    def __init__(self, limit: int):
        self.leaves = 1 << limit.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(limit + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, row) of least capacity that holds `need`."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up until a right sibling has rows
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                node += not count[node]
        capacity = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Rows of piece numbers; every length is from 1 to limit."""
    tree, rows = CapacityTree(limit), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            rows.append([i])
            left = limit - n
            tree.add(left, len(rows) - 1)
        else:
            rows[found[1]].append(i)
            tree.add(found[0] - n, found[1])
    return rows


def _pack(docs: list[tuple[int, np.ndarray]], limit: int, base: int, dtype: np.dtype) -> pa.RecordBatch:
    pieces = [(doc, at, ids[at : at + limit]) for doc, ids in docs for at in range(0, len(ids), limit)]
    rows = best_fit_decreasing(np.array([len(p[2]) for p in pieces], np.int64), limit)
    out: dict[str, list] = {k: [] for k in ("pack_id", "n_tokens", "ids", "position_ids", "cu_seqlens", "doc_ids", "piece_starts")}
    for r, row in enumerate(rows):
        ids, positions, cuts = np.zeros(limit, dtype), np.zeros(limit, np.uint32 if limit > 65536 else np.uint16), [0]
        for i in row:
            a, b = cuts[-1], cuts[-1] + len(pieces[i][2])
            ids[a:b], positions[a:b] = pieces[i][2], np.arange(b - a)
            cuts.append(b)
        for k, v in zip(out, (base + r, cuts[-1], ids.tobytes(), positions.tobytes(), cuts, [pieces[i][0] for i in row], [pieces[i][1] for i in row])):
            out[k].append(v)
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))


def pack(df: DataFrame, tokenizer: Callable[[], Callable[[str], np.ndarray]], limit: int = ROW_TOKENS, shard_tokens: int = SHARD_TOKENS, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows; ids are little-endian uint16, or uint32 if wide. tokenizer() is called in each worker."""
    dtype = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, docs, n, made = tokenizer(), [], 0, TaskContext.get().partitionId() << 36
        for part in slices(batches, max_bytes=1 << 20):
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = encode(text or "")
                if len(ids) and int(ids.max()) > np.iinfo(dtype).max:
                    raise ValueError(f"token id {int(ids.max())} does not fit {dtype}: pack with wide=True")
                ids = ids.astype(dtype, copy=False)
                if len(ids):
                    docs.append((doc, ids))
                    n += len(ids)
                if n >= shard_tokens:
                    batch = _pack(docs, limit, made, dtype)
                    made, docs, n = made + batch.num_rows, [], 0
                    yield from (batch.slice(i, 256) for i in range(0, batch.num_rows, 256))
        if docs:
            yield _pack(docs, limit, made, dtype)

    return pick(df, id_col, text_col).mapInArrow(handing_back(run), SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Parquet files of packed rows; the ids column of a file is its id matrix, row after row."""
    packed.write.mode("errorifexists").option("compression", "zstd").parquet(path)


@lru_cache(maxsize=2)
def _byte_bpe(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def byte_bpe_tokenizer(path: str, pattern: str) -> Callable[[], Callable[[str], np.ndarray]]:
    """Ids of a byte-level rank file; every text is told apart from its ids alone."""
    return lambda: lambda text: _byte_bpe(path, pattern).encode_to_numpy(text, allowed_special=set(), disallowed_special=())


def byte_bpe_text(path: str, pattern: str, ids: np.ndarray) -> str:
    return _byte_bpe(path, pattern).decode(ids.tolist())
