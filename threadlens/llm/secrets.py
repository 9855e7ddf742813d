"""Secret scans through a trigram inverted index (operator 6).

Each rule's pattern is parsed into a Boolean query of trigrams that any match must contain (AND over a sequence, OR
over alternatives, characters folded to lower case). Each block of documents gets an inverted index of the trigrams
that the queries use: postings are found in one vectorised pass over the block's bytes, intersected and united by the
query, and only candidate documents are verified with the pattern. Rules whose pattern yields no mandatory trigram
scan every document.

Cases: null text is empty; very long texts are one block; rules that match at one place are listed in their order;
repeated rows are scanned row by row; an empty table gives an empty result; other columns are ignored. Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as _c
from re import _parser as _p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, pick, raw


@dataclass(frozen=True)
class Rule:
    """kind, pattern, least length of the group that holds the secret, and whether it is one of the base kinds."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False
    base: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.A | (re.I if self.fold else 0))


# A private key is masked whole: to the matching END line, with no other boundary between, or else over the base64 lines
# (runs of 16 characters or more wherever they stand, and whole lines) behind the header and its fields, line breaks
# escaped or quoted too. All runs are possessive, so that a header costs no more than the text up to the next boundary.
_BREAK = r"(?:\r?\n|\\r\\n|\\n)"
_BETWEEN = r"""(?:[\s"'>#*|,;]|\\[nrt]|-(?!-)|\+(?=[\s"']))*+"""
_FIELD = rf"{_BREAK}[A-Za-z-]++:\x20[^\n\\]*+"
_LINE = rf"{_BETWEEN}[A-Za-z0-9+/]{{16,}}+={{0,2}}|{_BETWEEN}[A-Za-z0-9+/]++={{1,2}}|{_BREAK}[\x20\t]*+[A-Za-z0-9+/]++={{0,2}}(?=[\x20\t\"',;]*+(?:{_BREAK}|\Z))"
_PEM = rf"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END \1PRIVATE KEY-----|(?:{_FIELD})*+(?:{_LINE})*+)"

#: The three base kinds in order, then public token formats.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, False, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, False, True),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", _PEM),
)

# A query is True (no condition), a trigram, or ("and" | "or", frozenset of queries).


def _all(queries) -> object:
    parts = {q for q in queries if q is not True}
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def _any(queries) -> object:
    parts = set(queries)
    return True if True in parts or not parts else next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _grams(text: bytes) -> object:
    return _all(text[i : i + 3] for i in range(len(text) - 2))


#: A class or alternation is spelled out while it gives so few strings; longer ones break the run of known letters.
SPELL_OUT = 16


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query implied by a pattern, over ASCII lower-cased UTF-8."""

    def cross(left: set[bytes], right: set[bytes]) -> set[bytes]:
        return {a + b for a in left for b in right}

    def walk(items) -> tuple[set[bytes] | None, object]:
        """The exact strings an expression matches (None: too many), and its query."""
        run: set[bytes] | None = {b""}
        found, spelled = [], True
        for op, arg in items:
            exact, query = one(op, arg)
            if exact is not None and run is not None and len(run) * len(exact) <= SPELL_OUT:
                run = cross(run, exact)
                continue
            spelled = False
            if run is not None:
                found.append(_any(_grams(s) for s in run))
            found.append(query)
            run = exact if exact is not None else {b""}
        found.append(_any(_grams(s) for s in run))
        return (run if spelled else None), _all(found)

    def one(op, arg) -> tuple[set[bytes] | None, object]:
        if op is _c.LITERAL:
            s = {chr(arg).lower().encode() if arg < 128 else chr(arg).encode()}
            return s, True
        if op is _c.IN and all(o is _c.LITERAL for o, _ in arg) and len(arg) <= SPELL_OUT:
            return {chr(a).lower().encode() if a < 128 else chr(a).encode() for _, a in arg}, True
        if op is _c.SUBPATTERN:
            return walk(arg[3])
        if op is _c.BRANCH:
            both = [walk(b) for b in arg[1]]
            exact = None if any(e is None for e, _ in both) else set().union(*(e for e, _ in both))
            return (exact if exact is not None and len(exact) <= SPELL_OUT else None), _any(q for _, q in both)
        if op in (_c.MAX_REPEAT, _c.MIN_REPEAT, _c.POSSESSIVE_REPEAT):
            low, high, body = arg
            exact, query = walk(body)
            if exact is not None and (low, high) == (0, 1) and len(exact) < SPELL_OUT:
                return exact | {b""}, True
            if exact is not None and low == high and len(exact) ** low <= SPELL_OUT:
                out = {b""}
                for _ in range(low):
                    out = cross(out, exact)
                return out, _any(_grams(s) for s in out)
            return None, query if low else True
        return None, True

    return walk(_p.parse(pattern))[1]


def trigrams_of(query: object) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*(trigrams_of(q) for q in query[1]))


class BlockIndex:
    """Postings of the wanted trigrams in one block of texts."""

    def __init__(self, texts: list[bytes], wanted: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.n, self.postings = len(texts), {g: np.zeros(len(texts), bool) for g in wanted}
        data = np.frombuffer(b"".join(texts), np.uint8)
        if len(data) < 3 or not wanted:
            return
        lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
        code = (lower[:-2] << 16) | (lower[1:-1] << 8) | lower[2:]
        table = np.zeros(1 << 24, bool)
        codes = {int.from_bytes(g, "big"): g for g in wanted}
        table[list(codes)] = True
        at = np.flatnonzero(table[code])
        ends = np.cumsum(sizes)
        doc = np.searchsorted(ends, at, side="right")
        inside = at + 3 <= ends[doc]  # a trigram across two documents is none
        at, doc = at[inside], doc[inside]
        hit = code[at]
        for c in np.unique(hit):
            self.postings[codes[int(c)]][doc[hit == c]] = True

    def candidates(self, query: object) -> np.ndarray:
        if query is True:
            return np.ones(self.n, bool)
        if isinstance(query, bytes):
            return self.postings[query]
        found = [self.candidates(q) for q in query[1]]
        return np.logical_and.reduce(found) if query[0] == "and" else np.logical_or.reduce(found)


@lru_cache(maxsize=4)
def _plan(rules: tuple[Rule, ...]) -> tuple[list[tuple[Rule, re.Pattern, object]], list[bytes]]:
    rows = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
    return rows, sorted(set().union(*(trigrams_of(q) for _, _, q in rows)))


def scan_block(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """Per text, the spans (start, end, rule number), ordered by start and then rule."""
    rows, wanted = _plan(rules)
    index = BlockIndex(texts, wanted)
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    decoded: dict[int, str] = {}
    for k, (rule, pattern, query) in enumerate(rows):
        for i in np.flatnonzero(index.candidates(query)).tolist():
            text = decoded.get(i)
            if text is None:
                text = decoded[i] = texts[i].decode()
            for m in pattern.finditer(text):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    spans[i].append((m.start(), m.end(), k))
    for found in spans:
        found.sort(key=lambda s: (s[0], s[2]))
    return spans


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and spans, an array of (kind, start, end) over all rules, ordered by start and then rule."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [[{"kind": rules[k].kind, "start": a, "end": b} for a, b, k in spans] for spans in scan_block(raw(batch.column("text")), rules)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "found"])

    return arrow_map(pick(df, id_col, text_col), run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def masked(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of its first span in brackets."""
    out, last = [], 0
    for a, b, k in spans:
        if a >= last:
            out += [text[last:a], f"[{rules[k].kind}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def mask(df: DataFrame, rules: tuple[Rule, ...] = RULES, length_col: str = "n_chars") -> DataFrame:
    """All rows and columns of a table with doc_id and text, secrets masked and the length column, if there is one of whole numbers, brought up to date."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column("text").to_pylist()
        found = scan_block([(t or "").encode() for t in texts], rules)
        new = [masked(t, spans, rules) if spans else t for t, spans in zip(texts, found)]
        columns = {"text": pa.array(new, pa.string())}
        if length_col in batch.schema.names and pa.types.is_integer(batch.schema.field(length_col).type):
            columns[length_col] = pa.array([len(n) if spans else old for n, spans, old in zip(new, found, batch.column(length_col).to_pylist())], batch.schema.field(length_col).type)
        yield pa.RecordBatch.from_arrays([columns.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    return arrow_map(df, run, df.schema)
