"""Term blocks: postings in ranges of chunks, with bounds by which a search skips blocks that cannot reach its best hits.

Chunks are put into ranges of about SIZE by length and hash, the same for all terms, so the bounds of a range add up over
terms. A block is one row: a term's postings within a range, the most occurrences and the shortest chunk among them. The
bounds are read without the postings. A file holds whole ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.state import written
from . import search

SIZE = 128
#: Tokens that a range holds, if more than one chunk, and those that a task makes blocks of; about.
RANGE_TOKENS, TASK_TOKENS = 500_000, 1_000_000
#: Tokens whose texts are moved at a time when blocks are made in parts, about, and parts at most.
SLICE_TOKENS, SLICES = 8_000_000, 8
#: Length classes a doubling of the length is cut into; a range's number is its class and its place in the class, whose first digits are its part.
CLASSES, PLACES = 4, 1 << 32
#: Ranges scored first, and times as many in each further round until there are enough hits; what rounding may add to a score.
FIRST, MORE, SLACK = 32, 8, 2e-9


def build(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(blocks, lengths) of chunks. A text moves once, to the task of its range, where the range's blocks are made; postings do not move."""
    (made,), lengths = sliced(chunks, id_col, text_col, size, most=1)
    return made, lengths


def sliced(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", size: int = SIZE, most: int = SLICES) -> tuple[list[DataFrame], DataFrame]:
    """(parts of the blocks, lengths) of chunks, which are read once a part: written one after the other, only one part's texts are moved
    at a time. A part has about SLICE_TOKENS tokens, or more where that would be more than `most` parts; a range lies in one part."""
    tokens = search.tokens(F.col("text"))
    rows = chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text"))
    lengths = written(rows.select("chunk_id", F.size(tokens).alias("len")), "lengths")
    parts = max(1, min(most, -(-(lengths.agg(F.sum("len")).first()[0] or 0) // SLICE_TOKENS)))
    made = []
    for k in range(parts):
        # Told by the id alone, so that no other part's text is cut into tokens.
        mine = lambda df: df.where(F.pmod(F.xxhash64(F.lit("part"), "chunk_id"), F.lit(parts)) == k) if parts > 1 else df  # noqa: B023, E731
        block, tasks = _ranges(mine(lengths), size)
        # The length comes out of a generator, so that the optimizer does not copy it into each of its uses.
        near = mine(rows).select("chunk_id", "text", F.explode(F.array(F.size(tokens))).alias("len")).withColumn("block", block + k * (PLACES // most)).repartition(tasks, "block")
        each = near.select("block", "chunk_id", "len", F.posexplode(tokens).alias("at", "term"))
        postings = each.groupBy("block", "term", "chunk_id", "len").agg(F.sort_array(F.collect_list("at")).alias("positions"))
        made.append(_packed(postings))
    return made, lengths


def _ranges(lengths: DataFrame, size: int) -> tuple[Column, int]:
    """The range of a chunk, from its chunk_id and len, and the tasks that all ranges are dealt to."""
    length_class = F.floor(F.log2(F.col("len") + 1) * CLASSES).cast("long")
    found = lengths.groupBy(length_class.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("tokens")).collect()  # a hundred classes or so
    parts = {r["c"]: max(-(-r["n"] // size), -(-r["tokens"] // RANGE_TOKENS)) for r in found}
    of_class = F.create_map(*[F.lit(x) for kv in sorted(parts.items()) for x in kv]) if parts else F.create_map().cast("map<bigint,bigint>")
    place = F.pmod(F.xxhash64("chunk_id"), F.coalesce(F.try_element_at(of_class, length_class).cast("long"), F.lit(1)))
    return length_class * PLACES + place, max(1, -(-sum(r["tokens"] for r in found) // TASK_TOKENS))


def repacked(blocks: DataFrame, lengths: DataFrame, gone: DataFrame | None, slices: int = 1, size: int = SIZE) -> Iterator[DataFrame]:
    """Blocks with a column seq, and the (chunk_id, len) that stay, as blocks of new ranges: a slice of the ranges after the other, so
    that only one slice's postings move at a time. gone: (chunk_id, seq) of the postings that are left out."""
    block, tasks = _ranges(lengths, size)
    rows = blocks.select("term", "seq", F.explode("postings").alias("p")).select("term", "seq", "p.*")
    rows = rows if gone is None else rows.join(gone, ["chunk_id", "seq"], "left_anti")
    for k in range(slices):
        some = rows.withColumn("block", block).where(F.pmod(F.xxhash64("block"), F.lit(slices)) == k)
        yield _packed(some.select("block", "term", "chunk_id", "len", "positions").repartition(-(-tasks // slices), "block"))


def _packed(postings: DataFrame) -> DataFrame:
    """(block, term, chunk_id, len, positions) rows, those of a range in one task, as blocks; a block holds at most about SIZE postings.

    Sorted by term and range within a task's file, so that a search reads the pages of its terms only.
    """
    rows = postings.select("block", "term", F.struct("chunk_id", "len", "positions").alias("p"))
    made = rows.groupBy("block", "term").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max(F.size("p.positions")).alias("max_f"), F.min("p.len").alias("min_len"), F.array_sort(F.collect_list("p")).alias("postings"))
    return made.select("term", "block", "n", "max_f", "min_len", "postings").sortWithinPartitions("term", "block")


def unpacked(blocks: DataFrame) -> DataFrame:
    """(term, block, chunk_id, len, positions)."""
    return blocks.select("term", "block", F.explode("postings").alias("p")).select("term", "block", "p.*")


def without(blocks: DataFrame, died: DataFrame) -> DataFrame:
    """Blocks with a column seq without the postings that died later: those are taken out of the blocks that hold them, the
    others stay as they are."""
    ids = blocks.select("term", "block", "seq", F.explode("postings.chunk_id").alias("chunk_id"))
    gone = ids.join(died, "chunk_id").where("died > seq").groupBy("term", "block", "seq").agg(F.collect_list("chunk_id").alias("gone"))
    rows = blocks.join(gone, ["term", "block", "seq"], "left")
    left = F.when(F.col("gone").isNull(), F.col("postings")).otherwise(F.filter("postings", lambda p: ~F.array_contains("gone", p["chunk_id"])))
    return rows.select("term", "block", F.size(left).alias("n"), "max_f", "min_len", left.alias("postings")).where("n > 0")


def postings(blocks: DataFrame) -> DataFrame:
    """The postings table that the blocks hold."""
    return unpacked(blocks).select("term", "chunk_id", "positions")


def _counts(rows: DataFrame, terms: list[list[str]]) -> DataFrame:
    """(block, chunk_id, len, f0, f1, ...) of the chunks that hold a phrase."""
    by_chunk = rows.groupBy("chunk_id").agg(F.first("block").alias("block"), F.first("len").alias("len"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m"))
    none = F.array().cast("array<int>")

    def count(phrase: list[str]) -> Column:
        at = [F.coalesce(F.try_element_at("m", F.lit(t)), none) for t in phrase]
        return F.size(F.filter(at[0], lambda i: reduce(and_, [F.array_contains(a, i + k) for k, a in enumerate(at[1:], 1)], F.lit(True))))

    return by_chunk.select("block", "chunk_id", "len", *[count(p).alias(f"f{i}") for i, p in enumerate(terms)]).where(" or ".join(f"f{i} > 0" for i in range(len(terms))))


def topk(blocks: DataFrame, lengths: DataFrame, query: str, k: int = 50, allowed: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
    """The k best (chunk_id, bm25) of those in `allowed` (chunk_id), ties by chunk_id, and how many ranges there are and were read.

    Ranges are scored in the order of their bounds until k hits are found; then those whose bound reaches the k-th score.
    Blocks, segments of one store among them, may hold a range in several rows. A phrase of several words is counted in all ranges that hold its words, for its
    weight depends on it.
    """
    terms = search.phrases(query)
    wanted = sorted({t for p in terms for t in p})
    if not wanted:
        return lengths.select("chunk_id", F.lit(0.0).alias("bm25")).where(F.lit(False)), {"ranges": 0, "read": 0}
    mine = blocks.where(F.col("term").isin(wanted))
    totals = lengths.agg(F.count(F.lit(1)), F.avg("len")).first()
    docs, average = float(totals[0]), float(totals[1] or 1)
    held = {r["term"]: r["n"] for r in mine.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a word of the query
    weight = []
    for p in terms:
        n = held.get(p[0], 0)
        if len(p) > 1:
            words = sorted(set(p))
            both = mine.where(F.col("term").isin(words)).groupBy("block").agg(F.count_distinct("term").alias("c")).where(F.col("c") == len(words))
            n = _counts(unpacked(mine.where(F.col("term").isin(words)).join(both, "block", "left_semi")), [p]).count()
        weight.append(n)
    ns, lit = [F.lit(float(n)) for n in weight], F.lit
    # A range's bound: each phrase as often as its rarest word at most, in the shortest chunk.
    per_word = mine.groupBy("block", "term").agg(F.max("max_f").alias("max_f"), F.min("min_len").alias("min_len"))
    head = per_word.groupBy("block").agg(F.min("min_len").alias("len"), F.map_from_entries(F.collect_list(F.struct("term", "max_f"))).alias("m"))
    often = lambda p: reduce(F.least, [F.coalesce(F.try_element_at("m", lit(t)), lit(0)) for t in p])
    bound = sum((F.when(often(p) > 0, search._score(often(p), ns[i], lit(docs), F.col("len"), lit(average))).otherwise(0.0) for i, p in enumerate(terms)), lit(0.0))
    bounds = written(head.select("block", (bound + SLACK).alias("bound")).where(F.col("bound") > SLACK), "bounds")
    ranges = bounds.count()

    def scored(some: DataFrame) -> DataFrame:
        found = _counts(unpacked(mine.join(some.select("block"), "block", "left_semi")), terms)
        score = sum((search._score(F.col(f"f{i}"), ns[i], lit(docs), F.col("len"), lit(average)) for i in range(len(terms))), lit(0.0))
        found = found.select("chunk_id", F.round(-score, 9).alias("bm25"))
        return found if allowed is None else found.join(allowed.select("chunk_id"), "chunk_id", "left_semi")

    best, least, size, read = None, None, FIRST, 0
    while True:
        first = bounds.orderBy(F.desc("bound"), "block").limit(size)
        best = written(scored(first).orderBy("bm25", "chunk_id").limit(k), "hits")
        read = min(size, ranges)
        worst = best.agg(F.max("bm25"), F.count(F.lit(1))).first()
        if worst[1] >= k or size >= ranges:
            break
        size *= MORE
    if read < ranges:
        least = -worst[0]
        rest = bounds.where(F.col("bound") >= least).join(first.select("block"), "block", "left_anti")
        rest = written(rest, "rest")
        if more := rest.count():
            best = best.unionByName(scored(rest)).orderBy("bm25", "chunk_id").limit(k)
            read += more
    return best, {"ranges": ranges, "read": read}


def lexical(blocks: DataFrame, lengths: DataFrame, chunks: DataFrame, sessions: DataFrame, query: str, k: int = 50, include_completed: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """search.lexical() from blocks, and the ranges read: the status filter comes before the limit; ranks from 0."""
    names = chunks.select("chunk_id", "session_id").join(search.active(sessions, include_completed).select("session_id"), "session_id", "left_semi")
    top, read = topk(blocks, lengths, query, k, names)
    top = top.join(names, "chunk_id")  # k rows on the left
    return top.select("chunk_id", "session_id", "bm25", (F.row_number().over(Window.orderBy("bm25", "chunk_id")) - 1).alias("fts_rank")), read
