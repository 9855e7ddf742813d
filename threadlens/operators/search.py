"""Hybrid retrieval: BM25 over phrases, nearest vectors, reciprocal-rank fusion, rerank, per-session dedup.

Texts are read and cut into tokens once for matching, into a narrow table of counts; ranks carry ids and scores only, and texts are joined to the few candidates at the
end. A postings table, clustered by term, serves many queries over one corpus without reading it again.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import Embedder, Reranker, rerank_column
from ..functions.scalars import duration_label
from ..sources.state import written

K1, B, IDF_FLOOR, RRF = 1.2, 0.75, 1e-6, 60
#: Words that a query leaves out.
STOP_WORDS = frozenset("""a an and are as at be but by did do does for from had has have how i in into is it its of on or our
should so than that the their them these they this to was we were what when where which who why will with you your""".split())
# Accented letters and what the index folds them to.
_ACCENTED, _PLAIN = "äçèéêíñóöüáàâãåëìîïòôõùúûýÿ", "aceeeinoouaaaaaeiiiooouuuyy"


def query_terms(text: str) -> list[str]:
    """Terms of a query: cut at spaces only, single characters and stop words left out."""
    cleaned = re.sub(r"[^\w\s\-./]", " ", text)
    return [t for t in cleaned.split(" ") if len(t) > 1 and t.lower() not in STOP_WORDS]


def match_expression(text: str) -> str:
    """The terms as quoted phrases joined by OR."""
    return " OR ".join(f'"{t}"' for t in query_terms(text))


def fold(text: str) -> str:
    return text.lower().translate(str.maketrans(_ACCENTED, _PLAIN))


def phrases(text: str) -> list[list[str]]:
    """Each term as the tokens the index holds for it."""
    found = [re.findall(r"[^\W_]+", fold(t)) for t in query_terms(text)]
    return [p for p in found if p]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), _ACCENTED, _PLAIN), F.lit(r"[\p{L}\p{N}]+"), 0)


def phrase_count(toks: Column, phrase: list[str]) -> Column:
    """Occurrences of a phrase in an array of tokens, which should be a column that is already there."""
    alone = F.size(toks) - F.size(F.array_remove(toks, phrase[0]))
    if len(phrase) == 1:
        return alone
    here = lambda i: reduce(and_, [F.get(toks, i + k) == p for k, p in enumerate(phrase)])
    return F.when(alone > 0, F.size(F.filter(F.sequence(F.lit(0), F.size(toks) - 1), lambda i: F.coalesce(here(i), F.lit(False))))).otherwise(0)


def phrase_counts(chunks: DataFrame, terms: list[list[str]], id_col: str = "chunk_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, kept columns, len, f0, f1, ...): tokens of each text and occurrences of each phrase, in one pass.

    The tokens come out of a generator, which the optimizer neither copies into the counts nor pushes filters through.
    """
    rows = chunks.select(F.col(id_col).alias("chunk_id"), *keep, F.explode(F.array(tokens(F.col(text_col)))).alias("t"))
    return rows.select("chunk_id", *keep, F.size("t").alias("len"), *[phrase_count(F.col("t"), p).alias(f"f{i}") for i, p in enumerate(terms)])


def _score(f: Column, n: Column, docs: Column, length: Column, average: Column) -> Column:
    idf = F.log((docs - n + 0.5) / (n + 0.5))
    idf = F.when(idf <= 0, IDF_FLOOR).otherwise(idf)
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / average))


def bm25(chunks: DataFrame, query: str, id_col: str = "chunk_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, kept columns, bm25) of every chunk that holds a phrase; smaller is better. Statistics are over all chunks.

    The counts, a few numbers a chunk, are written to the shared folder, for both the statistics and the scores need them.
    """
    terms = phrases(query)
    if not terms:
        return chunks.select(F.col(id_col).alias("chunk_id"), *keep, F.lit(0.0).alias("bm25")).where(F.lit(False))
    counted = written(phrase_counts(chunks, terms, id_col, text_col, keep), "bm25")
    stats = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("average"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))])
    hit = counted.where(" or ".join(f"f{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))  # stats is one row
    score = sum((_score(F.col(f"f{i}"), F.col(f"n{i}"), F.col("docs"), F.col("len"), F.col("average")) for i in range(len(terms))), F.lit(0.0))
    return hit.select("chunk_id", *keep, F.round(-score, 9).alias("bm25"))


def build_postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(postings, lengths): (term, chunk_id, positions) and (chunk_id, len), one shuffle-free pass each."""
    rows = chunks.select(F.col(id_col).alias("chunk_id"), tokens(F.col(text_col)).alias("t"))
    each = rows.select("chunk_id", F.posexplode("t").alias("at", "term"))
    postings = each.groupBy("term", "chunk_id").agg(F.sort_array(F.collect_list("at")).alias("positions"))
    return postings, rows.select("chunk_id", F.size("t").alias("len"))


def bm25_postings(postings: DataFrame, lengths: DataFrame, query: str) -> DataFrame:
    """The same scores from a postings table: only the query's terms are read."""
    terms = phrases(query)
    wanted = sorted({t for p in terms for t in p})
    if not wanted:
        return lengths.select("chunk_id", F.lit(0.0).alias("bm25")).where(F.lit(False))
    rows = postings.where(F.col("term").isin(wanted)).groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m"))
    none = F.array().cast("array<int>")

    def count(phrase: list[str]) -> Column:
        at = [F.coalesce(F.try_element_at("m", F.lit(t)), none) for t in phrase]
        return F.size(F.filter(at[0], lambda i: reduce(and_, [F.array_contains(a, i + k) for k, a in enumerate(at[1:], 1)], F.lit(True))))

    counted = rows.select("chunk_id", *[count(p).alias(f"f{i}") for i, p in enumerate(terms)]).where(" or ".join(f"f{i} > 0" for i in range(len(terms))))
    totals = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("average"))
    df = counted.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))])
    hit = counted.join(lengths, "chunk_id").crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(df))  # one row each
    score = sum((_score(F.col(f"f{i}"), F.col(f"n{i}"), F.col("docs"), F.col("len"), F.col("average")) for i in range(len(terms))), F.lit(0.0))
    return hit.select("chunk_id", F.round(-score, 9).alias("bm25"))


def active(sessions: DataFrame, include_completed: bool = False) -> DataFrame:
    """Sessions a search may show: archived ones stay."""
    return sessions if include_completed else sessions.where("status <> 'completed'")


def lexical(chunks: DataFrame, sessions: DataFrame, query: str, k: int = 50, include_completed: bool = False, scores: DataFrame | None = None) -> DataFrame:
    """(chunk_id, session_id, bm25, fts_rank): the status filter comes before the limit; ranks from 0."""
    found = bm25(chunks, query, keep=("session_id",)) if scores is None else scores.join(chunks.select("chunk_id", "session_id"), "chunk_id")
    top = found.join(active(sessions, include_completed).select("session_id"), "session_id", "left_semi").orderBy("bm25", "chunk_id").limit(k)
    return top.withColumn("fts_rank", F.row_number().over(Window.orderBy("bm25", "chunk_id")) - 1)  # k rows


def distance(v: Column, q: list[float]) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(v.cast("array<double>"), F.array(*[F.lit(float(x)) for x in q]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, query: list[float], k: int = 50) -> DataFrame:
    """(chunk_id, dist) of the k nearest vectors by Euclidean distance."""
    return vectors.select("chunk_id", F.round(distance(F.col("embedding"), query), 9).alias("dist")).orderBy("dist", "chunk_id").limit(k)


def semantic(vectors: DataFrame | None, chunks: DataFrame, sessions: DataFrame, query: list[float], k: int = 50, include_completed: bool = False, found: DataFrame | None = None) -> DataFrame:
    """(chunk_id, dist, vec_rank): the status filter comes after the limit, so fewer than k may remain; ranks are dense again.

    found: the k nearest (chunk_id, dist), where an index has them."""
    near = chunks.select("chunk_id", "session_id").join(F.broadcast(nearest(vectors, query, k) if found is None else found), "chunk_id")  # k rows
    left = near.join(active(sessions, include_completed).select("session_id"), "session_id", "left_semi")
    return left.select("chunk_id", "dist", (F.row_number().over(Window.orderBy("dist", "chunk_id")) - 1).alias("vec_rank"))  # at most k rows


def fuse(fts: DataFrame, vec: DataFrame) -> DataFrame:
    """(chunk_id, bm25, fts_rank, dist, vec_rank, fused): sum of 1 / (60 + rank + 1) over both lists."""
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c) + 1), F.lit(0.0))
    both = fts.select("chunk_id", "bm25", "fts_rank").join(vec, "chunk_id", "full_outer")
    return both.withColumn("fused", F.round(part("fts_rank") + part("vec_rank"), 12))


def _best(fused: DataFrame) -> list[Column]:
    return [F.desc("fused"), F.asc_nulls_last("fts_rank"), F.asc_nulls_last("vec_rank")]


def hybrid_search(
    chunks: DataFrame, sessions: DataFrame, query: str, vectors: DataFrame | None = None, embedder: Embedder | None = None, query_vector: list[float] | None = None, limit: int = 5,
    include_completed: bool = False, reranker: Callable[[], Reranker] | None = None, pool: int = 50, max_per_session: int = 1, dedup_before_cut: bool = False, scores: DataFrame | None = None,
    fts: DataFrame | None = None, vec: DataFrame | None = None,
) -> DataFrame:
    """Hits in order: pos, chunk_id, session_id, fused, bm25, dist, score, matched, snippet and the session's columns.

    Without a reranker the fused list is cut to `limit` before the per-session dedup, so results can be short; with
    dedup_before_cut the pool is deduplicated instead. fts and vec are the ranks of lexical() and semantic(), where indexes have given them.
    """
    if query_vector is None and embedder is not None and vectors is not None:
        query_vector = np.asarray(embedder.embed([query], "query")[0], float).tolist()
    fts = lexical(chunks, sessions, query, pool, include_completed, scores) if fts is None else fts
    if vec is not None:
        pass
    elif vectors is not None and query_vector is not None:
        vec = semantic(vectors, chunks, sessions, query_vector, pool, include_completed)
    else:
        vec = fts.select("chunk_id", F.lit(0.0).alias("dist"), F.lit(0).alias("vec_rank")).where(F.lit(False))
    fused = fuse(fts, vec)
    cut = fused.orderBy(*_best(fused)).limit(pool if reranker or dedup_before_cut else limit)
    hits = chunks.join(F.broadcast(cut), "chunk_id")  # at most `pool` rows
    order = _best(fused)
    if reranker:
        hits = hits.withColumn("score", rerank_column(reranker, query)("text"))
        order = [F.desc("score"), *order]
    else:
        hits = hits.withColumn("score", F.col("fused"))
    per = Window.partitionBy("session_id")
    hits = hits.withColumn("matched", F.count(F.lit(1)).over(per)).withColumn("_n", F.row_number().over(per.orderBy(*order))).where(F.col("_n") <= max_per_session)
    hits = hits.withColumn("pos", F.row_number().over(Window.orderBy(*order))).where(F.col("pos") <= limit)
    text = F.when(F.col("fts_rank").isNotNull(), snippet_column(query)("text")).otherwise(F.substring("text", 1, 240))
    out = hits.select("pos", "chunk_id", "session_id", "fused", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("dist", F.lit(0.0)).alias("dist"), "score", "matched", text.alias("snippet"))
    return sessions.join(F.broadcast(out), "session_id").orderBy("pos")


def enrich(hits: DataFrame, sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their session's chunk count and duration."""
    counts = chunks.join(hits.select("session_id").distinct(), "session_id", "left_semi").groupBy("session_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    spans = sessions.select("session_id", duration_label(F.col("started_at"), F.col("last_active_at")).alias("duration"))
    return hits.join(counts, "session_id", "left").join(spans, "session_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def snippet(text: str, query: str, size: int = 12, marks: tuple[str, str] = ("«", "»"), gap: str = "…") -> str:
    """The window of `size` tokens that the full-text index would show, with the phrases in it marked.

    A window is tried from each phrase, centred over the phrases that start in it, and from the start of its sentence; the
    first occurrence of a phrase in a window is worth 1000, a further one 1, the start of a sentence 100, of the text 120.
    The first of the best windows is shown.
    """
    found = [(m.start(), m.end(), fold(m[0])) for m in re.finditer(r"[^\W_]+", text)]
    words, hits = [f[2] for f in found], []
    for k, p in enumerate(phrases(query)):
        hits += [(i, k, len(p)) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    hits.sort()
    if not hits:
        return text if len(found) <= size else text[: found[size - 1][1]] + gap
    starts = [i for i in range(len(found)) if i == 0 or re.search(r"[.:][ \t\r\n]+\Z", text[found[i - 1][1] : found[i][0]])]

    def inside(a: int) -> list[tuple[int, int, int]]:
        return [h for h in hits if a <= h[0] < a + size]

    def worth(some: list[tuple[int, int, int]]) -> int:
        return 999 * len({k for _, k, _ in some}) + len(some)

    best, a = 0, 0
    for i, _, _ in hits:
        some = inside(i)
        if (value := worth(some)) > best:
            spread = some[-1][0] + some[-1][2] - some[0][0]
            best, a = value, max(0, min(some[0][0] - int((size - spread) / 2), len(found) - size))
        sentence = starts[bisect_right(starts, i) - 1]
        if len(found) > size and sentence < i and (value := worth(inside(sentence)) + (100 if sentence else 120)) > best:
            best, a = value, sentence
    b = min(len(found), a + size)
    spans: list[list[int]] = []  # of phrases that start in the window, overlapping ones united
    for i, _, n in hits:
        if spans and i < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], i + n)
        else:
            spans.append([i, i + n])
    out, at = [gap] if a else [], found[a][0] if a else 0
    for i, j in spans:
        if a <= i < b:
            first, last = found[i][0], found[min(j, b) - 1][1]
            out += [text[at:first], marks[0], text[first:last], marks[1]]
            at = last
    return "".join([*out, text[at:] if b == len(found) else text[at : found[b - 1][1]] + gap])


def snippet_column(query: str):
    """Pandas UDF over the few hits' texts."""

    @F.pandas_udf("string")
    def f(texts):
        return texts.map(lambda t: snippet(t or "", query))

    return f


def snippet_display(c: Column, n: int = 200) -> Column:
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def distinct_sessions(hits: DataFrame) -> DataFrame:
    """The best hit of each session."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy("pos"))).where("_n = 1").drop("_n")


def related_query(title: Column, short: Column, first: Column, last: Column) -> Column:
    """Title and summary, else the first prompt, then the last prompt, joined by ". "."""
    some = lambda c: F.when(F.trim(c) != "", c)
    return F.concat_ws(". ", some(title), some(short), F.when(some(title).isNull() & some(short).isNull(), some(first)), some(last))


def related(hits: DataFrame, source_id: str, source_repo: str | None, limit: int = 8) -> DataFrame:
    """Hits without the source session; those of its repository first, else in their order."""
    same = F.coalesce(F.col("repo") == source_repo, F.lit(False)) if source_repo else F.lit(False)
    return hits.where(F.col("session_id") != source_id).withColumn("same_repo", same).orderBy(F.desc("same_repo"), "pos").limit(limit)


def porcelain(hits: DataFrame) -> DataFrame:
    """id, folder or "-", title, and 0 or 1, separated by tabs."""
    title = F.regexp_replace(F.coalesce("summary_title", "first_user_text", F.substring("session_id", 1, 8)), r"\r\n|\n|\r", " ")
    return hits.select(F.concat_ws("\t", "session_id", F.coalesce(F.nullif(F.col("cwd"), F.lit("")), F.lit("-")), title, F.when(F.col("same_repo"), "1").otherwise("0")).alias("line"))


def has_embeddings(vectors: DataFrame, model_id: str) -> bool:
    return not vectors.where(F.col("model_id") == model_id).limit(1).isEmpty()
