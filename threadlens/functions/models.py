"""Pluggable models: embedder and reranker interfaces, deterministic offline ones, batched inference and runner routing."""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")


class Embedder(Protocol):
    model_id: str
    dim: int

    def embed(self, texts: list[str], kind: str) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, query: str, documents: list[str]) -> list[float]: ...


def pool_and_normalise(token_vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over unmasked tokens, then unit length; vectors shorter than 1e-12 stay as they are."""
    mean = (token_vectors * mask[..., None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1)
    norm = np.linalg.norm(mean, axis=1, keepdims=True)
    return np.where(norm < 1e-12, mean, mean / np.maximum(norm, 1e-12))


def area_batches(lengths: list[int], most: int, area: int) -> Iterator[list[int]]:
    """Indices in batches by length: at most `most` texts and `area` padded tokens, one text at least."""
    held: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        if held and (len(held) == most or (len(held) + 1) * lengths[i] > area):
            yield held
            held = []
        held.append(i)
    if held:
        yield held


class HashingEmbedder:
    """Deterministic stand-in: signed hashing of lower-cased words, with a prefix per kind, truncated like a real model."""

    def __init__(self, dim: int = 64, max_tokens: int = 2048, batch: int = 8, area: int = 16384, prefixes: dict[str, str] | None = None):
        self.dim, self.max_tokens, self.batch, self.area = dim, max_tokens, batch, area
        self.prefixes = prefixes or {}
        self.model_id = f"hashing-{dim}"

    def embed(self, texts: list[str], kind: str = "document") -> np.ndarray:
        tokens = [_WORD.findall((self.prefixes.get(kind, "") + t).lower())[: self.max_tokens] for t in texts]
        out = np.zeros((len(texts), self.dim))
        for group in area_batches([len(t) for t in tokens], self.batch, self.area):
            for i in group:
                for w in tokens[i]:
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    out[i, h % self.dim] += 1 if h >> 63 else -1
        return pool_and_normalise(out[:, None, :], np.ones((len(texts), 1)))


class OverlapReranker:
    """Deterministic stand-in: share of the query's words in the document; the query takes a quarter of the tokens at most."""

    def __init__(self, max_tokens: int = 512):
        self.max_tokens = max_tokens

    def score(self, query: str, documents: list[str]) -> list[float]:
        q = _WORD.findall(query.lower())[: self.max_tokens // 4]
        room = self.max_tokens - len(q) - 3
        return [len(set(q) & set(_WORD.findall(d.lower())[:room])) / max(1, len(set(q))) for d in documents]


def embed_table(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Embedder], kind: str = "document") -> DataFrame:
    """(chunk_id, embedding, model_id, dim); the model is made once in each worker task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            v = model.embed([t or "" for t in batch.column(1).to_pylist()], kind).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v.tolist(), pa.list_(pa.float32())), pa.array([model.model_id] * len(v)), pa.array([model.dim] * len(v), pa.int32())], names=["chunk_id", "embedding", "model_id", "dim"])

    return df.select(F.col(id_col).cast("long").alias("chunk_id"), F.col(text_col).alias("text")).mapInArrow(run, "chunk_id long, embedding array<float>, model_id string, dim int")


def rerank_column(make: Callable[[], Reranker], query: str):
    """Pandas UDF over document texts; meant for the bounded candidate pool only."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for t in texts:
            yield pd.Series(model.score(query, t.fillna("").tolist()))

    return score


def route(allowed_tools: list[str], default: Callable, with_tools: Callable) -> Callable:
    """Requests that need tools go to the backend that has them, others to the default one."""
    return with_tools if allowed_tools else default


def command_runner(argv: list[str], timeout: float = 300.0) -> Callable[[], Callable[[str], str]]:
    """A runner that writes each prompt to a program's input and reads its answer: the "result" of a JSON envelope, else the output.

    A program that fails or takes longer than the timeout is ended and gives no answer.
    """

    def ask(prompt: str) -> str:
        done = subprocess.run(argv, input=prompt, capture_output=True, text=True, timeout=timeout, check=True)
        try:
            envelope = json.loads(done.stdout)
        except ValueError:
            return done.stdout
        result = envelope.get("result") if isinstance(envelope, dict) else None
        return result if isinstance(result, str) else done.stdout

    return lambda: ask


def run_prompts(df: DataFrame, prompt_col: str, out_col: str, runner: Callable[[], Callable[[str], str]], concurrency: int = 4, error_col: str | None = None) -> DataFrame:
    """Answers of a runner for each row, at most `concurrency` tasks at a time; null where the runner fails, and why in `error_col`."""

    @F.pandas_udf("answer string, error string")
    def ask(prompts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = runner()

        def one(p: str) -> tuple[str | None, str | None]:
            try:
                return call(p), None
            except Exception as e:  # one failed answer must not end the others
                return None, f"{type(e).__name__}: {e}"[:500]

        for part in prompts:
            yield pd.DataFrame([one(p) for p in part], columns=["answer", "error"], dtype=object)

    asked = df.repartition(concurrency).withColumn("_asked", ask(prompt_col)).withColumn(out_col, F.col("_asked.answer"))
    return (asked.withColumn(error_col, F.col("_asked.error")) if error_col else asked).drop("_asked")
