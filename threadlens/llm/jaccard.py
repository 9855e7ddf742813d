"""N-gram Jaccard join in metric space (operator 2).

Jaccard distance is a metric, but unrelated documents are all at distance 1 from nearly every pivot, so pivots are
elected where documents can meet at all:

1. Documents with equal shingle sets form a class, represented by its smallest doc_id.
2. A document whose distance to another is at most 1 - t shares with it one of its first n - ceil(t n) + 1 shingles in
   any global order. Shingles that are frequent over all documents (a bounded table of the heaviest, counted over
   everything) come last in the order, which only saves work. At each shingle the smallest document is elected pivot,
   and the pivot's region is all documents that meet it. Every linked pair has met, so it is in some region whole.
3. Coarse windows: distances to the empty set (sizes) and to the cells of a partition of all shingles (a sketch of cell
   counts) are 1-Lipschitz, so a pair whose sketches differ by more than the threshold allows cannot link. Members with
   no partner left leave the region before any set is moved.
4. Region join: the most central member becomes the pivot, exact distances to it are taken, and triangle-inequality
   windows prune the rest. Large regions are split into the Voronoi cells of several pivots; boundary documents (within
   twice the threshold of the nearest pivot's distance) are replicated, and the cells are joined by recursion.
   Every pair that the windows leave is verified, so a group of n near copies takes about n^2 / 2 comparisons. Each
   linked pair is counted once: in the cell where its first member is at home, and of the regions and parts where both
   meet, in the region of the smallest pivot and the one part or pair of parts that holds them.
   Regions beyond a size are cut into parts and each pair of parts is a task.
5. Links of representatives, each weighted by the size of the other's class, give n_links; those that span give
   components; classes give every document its component.

Cases: null, empty and blank texts have no shingles and link with nothing, nor do rows without a doc_id; with fewer than five words the whole
sequence is one shingle; a text of any length is one set, and tasks are bounded by rows and bytes, one set at least;
similarity of exactly the threshold links; repeated rows are one class, returned row by row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEYS, Kept, WordHashes, arrow_map, attached, blocked, connected_components, cuts_of, gram_hashes, groups, handing_back, in_batches, meetings, mix64, packed_keys, parts_for, pick, raw, with_class

GRAM, PERCENT = 5, 80
#: Cells of a sketch: at least these, and about one for each four to eight shingles up to 2 ** MOST_BITS.
LEAST_BITS, MOST_BITS = 6, 14
#: Most shingles in the table of frequent ones; it orders shingles and never decides a link.
FREQUENT = 200_000
#: Rows of a region task before it is cut, with sketches and with whole sets, and bytes of either.
SKETCH_CAP, SET_CAP, TASK_BYTES = 16_000, 3_000, 24 << 20
LEAF, PIVOTS = 64, 8


def shingles(hashes: WordHashes, text: bytes) -> np.ndarray:
    words = text.lower().split()  # bytes: A-Z only
    return np.unique(gram_hashes(hashes.of(words), min(GRAM, len(words)))) if words else np.empty(0, np.uint64)


def links(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def prefix(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The shingles by which a document can be reached: rare ones first, then by hash."""
    n = len(found)
    take = n - -(-percent * n // 100) + 1
    weight = np.zeros(n, np.int64)
    keys, counts = frequent
    if len(keys):
        i = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        weight = np.where(keys[i] == found, counts[i], 0)
    return found[np.lexsort((mix64(found), weight))[:take]]


def cell_counts(found: np.ndarray) -> np.ndarray:
    """Shingles in each cell of a partition by leading hash bits, clipped at 255; larger sets have finer partitions."""
    bits = min(MOST_BITS, max(LEAST_BITS, (len(found) // 8).bit_length()))
    counts = np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8)


def fold(cells: np.ndarray, width: int) -> np.ndarray:
    """Counts of a finer partition as those of a coarser one; clipping first or last is the same."""
    return np.minimum(cells.reshape(len(cells), width, -1).sum(axis=2, dtype=np.int32), 255).astype(np.int16)


_FACTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("sketch", pa.binary()), ("key", pa.int64()), ("seen", pa.int64())])


def _facts(hashes: WordHashes, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows, every = [], []
    for doc, text in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text"))):
        found = shingles(hashes, text)
        every.append(found)
        digest = xxhash.xxh3_128_intdigest(found.tobytes())
        sketch = cell_counts(found).tobytes()
        rows.append((doc, len(found), (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63), sketch, None, None))
    keys, n = np.unique(np.concatenate(every), return_counts=True) if every else (np.empty(0, np.uint64), np.empty(0, np.int64))
    often = n > 1
    rows += [(None, None, None, None, None, k, c) for k, c in zip(keys[often].view(np.int64).tolist(), n[often].tolist())]
    yield from in_batches(iter(rows), _FACTS, 100_000)


def partners(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, part: np.ndarray | None, percent: int, alive: np.ndarray) -> None:
    """Mark rows a (cells x) and b (cells y) that have a partner within the coarse windows; with parts, in another part."""
    order = np.argsort(n[b], kind="stable")
    y, b = y[order], b[order]
    by_size = n[b]
    rows = 16
    tile = max(16, 2_000_000 // (rows * x.shape[1]))
    order = np.argsort(n[a], kind="stable")
    x, a = x[order], a[order]
    for s in range(0, len(a), rows):
        block = a[s : s + rows]
        # Sizes are distances to the empty set: partners of the block lie in one window of the order.
        low = int(np.searchsorted(by_size, n[block[0]] * percent / 100, side="left"))
        high = int(np.searchsorted(by_size, n[block[-1]] * 100 / percent, side="right"))
        for t in range(low, high, tile):
            other = b[t : min(high, t + tile)]
            gap = np.abs(x[s : s + rows, None, :] - y[None, t : t + len(other), :]).sum(axis=2, dtype=np.int32)
            total = n[block][:, None] + n[other][None, :]
            # |A xor B| = total - 2 inter, and a link needs (100 + t) inter >= t total.
            near = ((100 + percent) * (total - gap) >= 2 * percent * total) & (block[:, None] != other[None, :])
            if part is not None:
                near &= part[block][:, None] != part[other][None, :]
            alive[block] |= near.any(axis=1)
            alive[other] |= near.any(axis=0)


def _prune(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (p, i, j), table in groups(batches, ("p", "i", "j")):
            n, part, doc, sketch = table["n"].to_numpy(), table["part"].to_numpy(), table["doc"].to_numpy(), table["sketch"].to_pylist()
            width = np.array([len(c) for c in sketch])
            cells = {w: np.frombuffer(b"".join([sketch[k] for k in np.flatnonzero(width == w)]), np.uint8).reshape(-1, w) for w in np.unique(width).tolist()}
            alive = np.zeros(len(n), bool)
            # Sizes of partners differ by a quarter at most, so partitions differ by one step at most.
            for w in cells:
                for v in (w, 2 * w):
                    if v in cells:
                        a, b = np.flatnonzero(width == w), np.flatnonzero(width == v)
                        partners(fold(cells[w], w), fold(cells[v], w), a, b, n, part if i != j else None, percent, alive)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(alive.sum()), p)), pa.array(doc[alive])], names=["p", "doc"])

    return run


class Flat:
    """Sets of numbers side by side: how many members others have of one."""

    def __init__(self, sets: list[np.ndarray]):
        keys, self.flat, self.seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.n = np.array([len(s) for s in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.mark = np.zeros(len(keys), bool)

    def inter(self, i: int, others: np.ndarray) -> np.ndarray:
        mine = self.flat[self.at[i] : self.at[i + 1]]
        self.mark[mine] = True
        n = self.n[others]
        ends = np.cumsum(n)
        if 4 * len(others) > len(self.n):
            total = np.concatenate([[0], np.cumsum(self.mark[self.flat])])
            out = total[self.at[others + 1]] - total[self.at[others]]
        else:
            where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[others] - ends + n, n)
            total = np.concatenate([[0], np.cumsum(self.mark[self.flat[where]])])
            out = total[ends] - total[ends - n]
        self.mark[mine] = False
        return out


class Region:
    """Verified links of shingle sets: components, and for each set the weight of those it links with.

    before holds for each set the regions of smaller pivots it is in (a pair that shares one is verified there), part its
    part of the region (pairs of one part are verified in that part's own task, if there are two here).
    """

    def __init__(self, sets: list[np.ndarray], percent: int, weight: np.ndarray | None = None, before: list[np.ndarray] | None = None, part: np.ndarray | None = None):
        self.percent, self.far = percent, 1 - percent / 100
        self.sets = Flat(sets)
        self.n = self.sets.n
        self.central = np.add.reduceat(self.sets.seen[self.sets.flat], self.sets.at[:-1]) / self.n
        self.parent = np.arange(len(sets))
        self.weight = weight if weight is not None else np.ones(len(sets), np.int64)
        self.before = Flat(before) if before is not None and any(map(len, before)) else None
        self.part, self.links = part, np.zeros(len(sets), np.int64)

    def distances(self, i: int, others: np.ndarray, inter: np.ndarray) -> np.ndarray:
        return 1 - inter / (self.n[i] + self.n[others] - inter)

    def link(self, i: int, others: np.ndarray, inter: np.ndarray) -> None:
        near = others[links(inter, self.n[i], self.n[others], self.percent)]
        if not len(near):
            return
        if (self.parent[near] != self.parent[i]).any():
            roots = np.unique(self.parent[np.r_[near, i]])
            self.parent[np.isin(self.parent, roots)] = roots[0]
        self.links[i] += self.weight[near].sum()
        self.links[near] += self.weight[i]

    def join(self, members: np.ndarray, home: np.ndarray | None = None) -> None:
        """home says which members are here by their nearest pivot; a pair counts where its smaller number is at home."""
        home = np.ones(len(members), bool) if home is None else home
        order = np.argsort(-self.central[members], kind="stable")
        members, home = members[order], home[order]
        if len(members) <= LEAF:
            return self.leaf(members, home)
        distances, pivots = [], []
        pivot = members[0]
        for _ in range(PIVOTS):  # the most central document, then each time the one farthest from all pivots
            pivots.append(pivot)
            distances.append(self.distances(pivot, members, self.sets.inter(pivot, members)))
            pivot = members[np.argmax(np.min(distances, axis=0))]
            if pivot in pivots:
                break
        d = np.array(distances)
        reach = d <= d.min(axis=0) + 2 * self.far + 1e-12
        if reach.sum(axis=1).max() > 0.8 * len(members):
            return self.leaf(members, home, d)  # the windows cover nearly all: no use in splitting
        nearest = d.argmin(axis=0)
        for k, r in enumerate(reach):
            if r.sum() > 1 and (home & (nearest == k)).any():
                self.join(members[r], (home & (nearest == k))[r])
        return None

    def leaf(self, members: np.ndarray, home: np.ndarray, known: np.ndarray | None = None) -> None:
        """Each member at home in turn is pivot for those of larger number that the windows leave."""
        order = np.argsort(members)
        members, home = members[order], home[order]
        d = known[:, order] if known is not None else np.zeros((0, len(members)))
        sizes = self.n[members]
        for k in np.flatnonzero(home[:-1]).tolist():
            i, rest = members[k], np.arange(k + 1, len(members))
            rest = rest[100 * np.minimum(sizes[k], sizes[rest]) >= self.percent * np.maximum(sizes[k], sizes[rest])]
            if self.part is not None:
                rest = rest[self.part[members[rest]] != self.part[i]]
            if len(rest) and len(d):
                rest = rest[(np.abs(d[:, rest] - d[:, [k]]) <= self.far + 1e-12).all(axis=0)]
            if len(rest) and self.before is not None and self.before.n[i]:
                rest = rest[self.before.inter(i, members[rest]) == 0]
            if not len(rest):
                continue
            inter = self.sets.inter(i, members[rest])
            self.link(i, members[rest], inter)
            if len(d) < PIVOTS and len(rest) == len(members) - k - 1:
                got = self.distances(i, members[rest], inter)
                d = np.vstack([d, np.r_[np.zeros(k + 1), got]])  # a window needs distances to all that follow


def join_all(docs: np.ndarray, region: Region) -> list[tuple[int, int]]:
    """Links that span the components of the sets: (document, smallest document of its component)."""
    region.join(np.arange(len(docs)))
    least: dict[int, int] = {}
    for doc, root in zip(docs.tolist(), region.parent.tolist()):
        least[root] = min(least.get(root, doc), doc)
    return [(doc, least[root]) for doc, root in zip(docs.tolist(), region.parent.tolist()) if doc != least[root]]


def join_sets(docs: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    return join_all(docs, Region(sets, percent))


def _regions(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

        def rows() -> Iterator[tuple]:
            for (_, i, j), table in groups(batches, ("p", "i", "j")):
                # A repeated row of a table repeats its set; it counts by weight.
                body, once = table["body"].to_pylist(), {}
                for k, key in enumerate(zip(table["doc"].to_pylist(), body)):
                    once.setdefault(key, k)
                if len(once) > 1:
                    at = np.fromiter(once.values(), np.int64)
                    doc, weight, part = (table[c].to_numpy()[at] for c in ("doc", "weight", "part"))
                    before = table["before"].to_pylist()
                    region = Region([np.frombuffer(body[k], np.uint64) for k in at], percent, weight, [np.frombuffer(before[k], np.int64) for k in at], part if i != j else None)
                    yield from ((a, b, None) for a, b in join_all(doc, region))
                    some = np.flatnonzero(region.links)
                    yield from ((a, None, n) for a, n in zip(doc[some].tolist(), region.links[some].tolist()))

        yield from in_batches(rows(), schema, 20_000)

    return run


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set once for each of its regions, with the regions before it."""
    hashes = WordHashes()

    def rows() -> Iterator[tuple]:
        for doc, text, side in attached(batches, ("p", "weight")):
            if len(side["p"]):
                body, every = shingles(hashes, text).tobytes(), np.unique(side["p"]).astype(np.int64)
                for k, p in enumerate(every.tolist()):
                    yield p, doc, int(side["weight"][0]), body, every[:k].tobytes()

    yield from in_batches(rows(), pa.schema([("p", pa.int64()), ("doc", pa.int64()), ("weight", pa.int64()), ("body", pa.binary()), ("before", pa.binary())]))


def similar(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, caps: tuple[int, int] = (SKETCH_CAP, SET_CAP)) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, class_id (the smallest doc_id with the same shingles), n_links.

    n_links counts the other documents (rows) that link with the row's, those of its own class included.
    """
    kept, docs = Kept(spark), pick(df, id_col, text_col)
    parts = parts_for(spark, docs)
    hashes = WordHashes()
    facts = kept.keep("facts", arrow_map(docs, lambda b: _facts(hashes, b), "doc_id long, n long, sig_a long, sig_b long, sketch binary, key long, seen long", max_bytes=16 << 20))
    heavy = facts.where("key is not null").groupBy("key").agg(F.sum("seen").alias("n")).orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    keys, counts = heavy["key"].to_numpy().view(np.uint64), heavy["n"].to_numpy()
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], counts[order]))  # at most FREQUENT rows
    every = facts.where("key is null").select("doc_id", "n", "sig_a", "sig_b", "sketch")
    heads = kept.keep("heads", every.where("n > 0 and doc_id is not null").groupBy("sig_a", "sig_b", "n", "sketch").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("weight")))

    def prefixes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, owner = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for doc, text in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text"))):
            found = shingles(hashes, text) if doc is not None else ()
            if len(found):
                keys.append(prefix(found, frequent.value, percent).view(np.int64))
                owner.append(np.full(len(keys[-1]), doc, np.int64))
        yield packed_keys(np.concatenate(keys), np.concatenate(owner))

    met = meetings(kept, "meetings", arrow_map(docs, prefixes, KEYS, max_bytes=16 << 20), parts).where("doc <> first").select(F.col("first").alias("p"), "doc").distinct()
    met = kept.keep("met", met)
    kept.drop("meetings")
    # Documents with equal sets meet at the same shingles, so a region needs representatives only.
    members = met.union(met.select("p", F.col("p").alias("doc")).distinct()).join(heads.select("doc", "n", "sketch"), "doc")
    large = kept.keep("large_met", cuts_of(members, ["p"], caps[0], F.length("sketch"), TASK_BYTES))
    tasks = blocked(large, members, ["p"], "doc").repartition(parts, "p", "i", "j").sortWithinPartitions("p", "i", "j")
    alive = kept.keep("alive", tasks.mapInArrow(handing_back(_prune(percent)), "p long, doc long").distinct())
    kept.drop("met")
    null = lambda kind: F.lit(None).cast(kind)
    weighted = alive.join(heads.select("doc", "weight", "n"), "doc")
    both = docs.where("doc_id is not null").select("doc_id", F.lit(1).alias("kind"), null("long").alias("p"), null("long").alias("weight"), "text").union(weighted.select(F.col("doc").alias("doc_id"), F.lit(0), "p", "weight", null("string")))
    sets = both.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "kind").mapInArrow(handing_back(_with_sets), "p long, doc long, weight long, body binary, before binary")
    large = kept.keep("large", cuts_of(weighted, ["p"], caps[1], 8 * F.col("n"), TASK_BYTES))
    cut = blocked(large, sets, ["p"], "doc")
    found = kept.keep("found", cut.repartition(parts, "p", "i", "j").sortWithinPartitions("p", "i", "j", "doc").mapInArrow(handing_back(_regions(percent)), "a long, b long, links long"))
    components = connected_components(spark, found.where("b is not null").select("a", "b"), kept)
    counts = found.where("links is not null").groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("links"))
    # Joined once a class, then to the documents.
    per_class = heads.select("sig_a", "sig_b", F.col("doc").alias("class_id"), "weight").join(components.withColumnRenamed("id", "class_id"), "class_id", "left").join(counts, "class_id", "left")
    per_class = kept.keep("classes", per_class.select("sig_a", "sig_b", "weight", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    kept.drop_all_but("facts", "classes")
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id", "n_links"]
    bare = every.where("n = 0 or doc_id is null").withColumns({"component_id": F.col("doc_id"), "class_id": F.col("doc_id"), "n_links": F.lit(0).cast("long")})
    return with_class(every.where("n > 0 and doc_id is not null"), per_class, ["sig_a", "sig_b"]).select(*columns).union(bare.select(*columns))


def one_of_each(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The rows of a table with doc_id and text whose document is the smallest of its component; rows of one doc_id stay or go together.

    Rows without a doc_id name no document that another could be a copy of, and all stay. Null, empty and blank texts link with
    nothing and stay; of equal texts the smallest doc_id stays; an empty table gives no rows; all columns are kept.
    """
    stay = similar(spark, df).where("doc_id = component_id").select("doc_id").distinct()
    return df.alias("d").join(stay.alias("s"), F.col("d.doc_id") == F.col("s.doc_id"), "left_semi").unionAll(df.where("doc_id is null"))
