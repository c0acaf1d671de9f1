"""N-gram Jaccard join in metric space: exact links at a Jaccard similarity of 0.9 or more, and their classes.

Jaccard distance is a metric, so a document at distance a from a pivot can only be linked to documents whose
distance from it lies in the window [a - r, a + r], r = 1 - similarity.

1. Every text becomes its set of distinct word shingles. Equal sets are one point of the space.
2. Pivots. Nearly all pairs of documents lie at distance 1, where no window separates anything, so document pivots taken
   at random would replicate everything everywhere. Pivots are therefore taken where the space is dense, in two steps.
   The empty set is the first pivot: by distance from it (their size) sets lie in rings, linked sets at most one
   ring apart, so each set stands in its own ring and in the window of the next. In a ring the shingles are dealt
   by hash into parts, one more than linked sets can differ by shingles. The difference of two sets is the sum of
   their differences over the parts, so linked sets are at distance 0 in one part at least: they share that part's
   region. Below 0.9 many parts are empty and would put unlike sets in one region, so there are as many parts more as sets of the
   ring may have empty ones: a set with no more than these shares a part that is not empty, and leaves its empty ones out. Of the sets there the one of smallest id is the pivot document, and the others fall in its region. Pivots that
   share several parts are near each other, and their regions become one.
3. A region joins recursively. Pivots far from each other are measured against all its sets; whatever is within
   r of a pivot is linked to it. The sets fall into the cell of their nearest (Voronoi) pivot, and each cell is widened
   by the windows of the triangle inequality: a set that is linked to one in the cell of p is no further than r
   beyond that cell's radius from p, and no further than 2 r beyond its own nearest pivot. Cells recurse without the pivots. A
   cell of one class is done, as only classes are asked for. Where cells don't shrink, the pairs that the distances
   from all pivots leave open, |d(x, p) - d(y, p)| <= r, are measured. This holds at every size, from two sets on.
4. Regions above a bounded number of shingles do the same step as a job of its own: their sets are dealt to tasks, each
   of which gets the region's pivots (those that share most parts). Sets that are linked to the cell's pivot are of
   one class, so of these only the window of the others goes on with the cell. What doesn't shrink is dealt as
   blocks of pairs.
5. Links become classes through connected components.

Copies are reduced to one per task before anything is sent. A part's region is sent as packed arrays of about 12 bytes
per part and set, and only texts that share a region are sent themselves. What grows with the corpus is never broadcast,
so the joins have one form at every size.

Defined cases. Null or empty text, or white space only: empty set, n_shingles 0, linked with nothing,
component_id is its own doc_id. Fewer words than a shingle: the whole sequence is its one shingle. Copies and repeated
rows: one point, one class, every row returned. Rows that share a doc_id count as one document. Null doc_id: the
row is returned with a null component. Very long texts are read whole. Extra columns are ignored. Empty table: no rows.
Shingles are compared by 56-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import CHUNK_BYTES, chunks, partitions, saved, skew_join, table
from palimpsest.llm.components import components
from palimpsest.llm.words import combine, mix, split, windows

WORDS, PERCENT = 3, 90
#: Shingles of one block of a region, pivots of one step of its recursion, steps as jobs, and how much larger than a
#: region its cells may be together.
BLOCK_SHINGLES, PIVOTS, STEPS, GROWTH = 1 << 21, 6, 8, 1.5
#: Shingles that a shard of parts stands for; bounds its task's memory.
SHARD_SHINGLES = 4 << 20
#: Shared parts from which two pivots' regions are joined as one.
NEAR_PARTS = 3
_B, _RING_BITS = np.uint64(8), np.uint64(8)


def shingles(texts: pa.LargeStringArray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(56-bit shingles of all texts, bounds of the texts in them), repeated ones included."""
    w = split(texts, lower=True)
    h = w.hashes()
    tri, at = windows(h, w.bounds, words)
    bounds = np.searchsorted(at, w.bounds)
    few = np.flatnonzero((np.diff(w.bounds) > 0) & (np.diff(w.bounds) < words))
    if len(few):
        whole = []
        for i in few.tolist():
            one = h[w.bounds[i] : w.bounds[i] + 1]
            for k in range(w.bounds[i] + 1, w.bounds[i + 1]):
                one = combine(one, h[k : k + 1])
            whole.append(combine(one, np.array([w.bounds[i + 1] - w.bounds[i]], np.uint64))[0])
        tri = np.insert(tri, bounds[few], whole)
        more = np.zeros(len(bounds), np.int64)
        more[few + 1] = 1
        bounds = bounds + np.cumsum(more)
    return tri >> _B, bounds


def _sets(texts: pa.LargeStringArray, words: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(all distinct shingles of each text in turn, their numbers, two 64-bit sums that name each set)."""
    ids, bounds = shingles(texts, words)
    sets = [np.unique(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else ids[:0]
    every = mix(flat)
    start = np.concatenate([[0], np.cumsum(n)])
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (every, mix(every + np.uint64(1)))]
    return flat, n, [x[start[1:]] - x[start[:-1]] for x in sums]


def describe(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, s1 and s2 (a 128-bit digest of the set; null if empty)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                _, n, sums = _sets(texts, words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n), *(pa.array(x.view(np.int64), mask=n == 0) for x in sums)], ["doc_id", "n", "s1", "s2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long")


def _pack(shard: int, sig: np.ndarray, doc: np.ndarray, name: np.ndarray) -> tuple[int, bytes]:
    planes = lambda x: x.view(np.uint8).reshape(-1, 8).T.tobytes()
    raw = np.int64(len(sig)).tobytes() + planes(np.diff(sig, prepend=np.uint64(0))) + planes(doc) + planes(name & np.uint64((1 << 40) - 1))
    return shard, zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    sig, doc, name = (np.frombuffer(raw[8 + 8 * n * k : 8 + 8 * n * (k + 1)], np.uint8).reshape(8, n).T.copy().view(np.uint64).ravel() for k in range(3))
    return np.cumsum(sig, dtype=np.uint64), doc.view(np.int64), name


def _parts(words: int, percent: int, shards: int):
    """Packed (part of a ring with its content, doc_id, name of the set) of every distinct set, by shard."""
    width = np.log(100 / percent * 1.0001)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text", 2 * CHUNK_BYTES):
                ids = part.column("doc_id").cast(pa.int64())
                there = np.array(ids.is_valid())
                doc = ids.fill_null(0).to_numpy()
                flat, n, sums = _sets(texts, words)
                first = np.zeros(len(n), np.bool_)  # one of each set, the smallest id
                order = np.lexsort((doc, sums[1], sums[0]))
                order = order[(n > 0)[order] & there[order]]
                first[order[np.append(True, (np.diff(sums[0][order]) != 0) | (np.diff(sums[1][order]) != 0))[: len(order)]]] = True
                flat, n, doc, name = flat[np.repeat(first, n)], n[first], doc[first], sums[0][first]
                if not len(n):
                    continue
                owner = np.repeat(np.arange(len(n)), n)
                place, value = mix(flat ^ np.uint64(0x5BD1E995)) >> np.uint64(32), mix(flat + np.uint64(0x51ED27))
                home = np.floor(np.log(n) / width).astype(np.int64)
                sigs, docs, names = [], [], []
                for ring in (home, home + 1):
                    most = np.ceil(np.exp((ring + 1) * width)).astype(np.int64) + 1
                    m = 2 * most * (100 - percent) // (100 + percent) + 1
                    least = np.exp((ring - 1) * width)
                    spare = np.rint(4 * m * (1 - 1 / m) ** least).astype(np.int64) * (m > 1)
                    m = m + spare
                    start = np.cumsum(m) - m
                    at = start[owner] + (place * m[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
                    content = np.zeros(m.sum(), np.uint64)
                    np.add.at(content, at, value)
                    of = np.repeat(np.arange(len(n)), m)
                    number = (np.arange(len(of)) - start[of]).astype(np.uint64)
                    void = np.ones(len(of), np.bool_)
                    void[at] = False
                    sent = ~(void & (np.bincount(of, void, len(n)) <= spare)[of])
                    content, of, number = content[sent], of[sent], number[sent]
                    sigs.append(combine(content, number, ring[of].astype(np.uint64)) & ~np.uint64(255) | ring[of].astype(np.uint64) & np.uint64(255))
                    docs.append(doc[of])
                    names.append(name[of])
                sig, doc, name = np.concatenate(sigs), np.concatenate(docs), np.concatenate(names)
                order = np.argsort(sig)
                sig, doc, name = sig[order], doc[order], name[order]
                shard = ((sig >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                cut = np.searchsorted(shard, np.arange(shards + 1))
                rows = [_pack(k, sig[a:b], doc[a:b], name[a:b]) for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "blob"])

    return run


def _meet(percent: int):
    """pivot, rep, n (about) and number of shared parts of the sets that share one."""
    width = np.log(100 / percent * 1.0001)

    def run(group: pa.Table) -> pa.Table:
        sig, doc, name = (np.concatenate(x) for x in zip(*map(_unpack, group.column("blob").to_pylist()), strict=True))
        order = np.lexsort((doc, name, sig))
        sig, doc, name = sig[order], doc[order], name[order]
        new = np.append(True, (sig[1:] != sig[:-1]) | (name[1:] != name[:-1]))
        sig, doc = sig[new], doc[new]
        start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        size = np.diff(np.append(start, len(sig)))
        pivot = np.repeat(np.minimum.reduceat(doc, start), size)
        keep = np.repeat(size > 1, size)
        n = np.exp(((sig & np.uint64(255)).astype(np.float64) + 1) * width).astype(np.int64)
        pairs, parts = np.unique(np.stack([pivot[keep], doc[keep], n[keep]]), axis=1, return_counts=True)
        return pa.table({"pivot": pairs[0], "rep": pairs[1], "n": pairs[2], "parts": parts})

    return run


class Forest:
    """Classes of a region's sets, and how many links pivots and the windows of cells have given."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.by_pivot = self.by_window = self.cells = 0

    def link(self, i: int, others: np.ndarray) -> None:
        for r in np.unique(self.root[others]):
            if r != self.root[i]:
                self.root[self.root == r] = self.root[i]

    def one(self, group: np.ndarray) -> bool:
        """Whether a group is one class."""
        return bool((self.root[group] == self.root[group[0]]).all())


def _overlaps(one: np.ndarray, flat: np.ndarray, start: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a set with each of several; all as numbers below len(scratch)."""
    scratch[one] = 1
    out = np.add.reduceat(scratch[flat], start, dtype=np.int64)
    scratch[one] = 0
    return out


def voronoi(d: np.ndarray, r: float) -> list[np.ndarray]:
    """d: distances of pivots (rows) from points. Which points each pivot's cell has with its windows; empty cells are left out."""
    near, home = d.min(0), d.argmin(0)
    cells = []
    for k in range(len(d)):
        own = home == k
        if own.any():
            cells.append(own | (d[k] <= near + 2 * r) & (d[k] <= d[k][own].max() + r))
    return cells


def join_region(sets: list[np.ndarray], percent: int) -> Forest:
    """Classes of the linked sets; none is empty."""
    forest = Forest(len(sets))
    if len(sets) < 2:
        return forest
    flat = np.concatenate(sets)
    vocabulary, number = np.unique(flat, return_inverse=True)
    size = np.array([len(s) for s in sets])
    start = np.concatenate([[0], np.cumsum(size)])
    scratch = np.zeros(len(vocabulary), np.int8)
    r = 1 - percent / 100 + 1e-9

    def members(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([number[start[i] : start[i + 1]] for i in group]), np.concatenate([[0], np.cumsum(size[group])[:-1]])

    def measure(i: int, group: np.ndarray, own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances of a group from set i, its sets that are linked to i)"""
        shared = _overlaps(number[start[i] : start[i + 1]], own, at, scratch)
        union = size[i] + size[group] - shared
        return 1 - shared / union, group[100 * shared >= percent * union]

    todo = [np.arange(len(sets))]
    while todo:
        group = todo.pop()
        if len(group) < 2 or forest.one(group):
            continue
        own, at = members(group)
        far, rows, pivot = np.full(len(group), np.inf), [], 0
        rest = np.ones(len(group), np.bool_)
        while len(rows) < min(PIVOTS, len(group) - 1) and rest[pivot]:
            d, near = measure(group[pivot], group, own, at)
            rows.append(d)
            rest[pivot] = False
            far = np.minimum(far, d)
            forest.by_pivot += len(near) - 1
            forest.link(group[pivot], near)
            if forest.one(group):
                break
            pivot = int(np.argmax(np.where(rest, far, -1)))
        if forest.one(group):
            continue
        d, group = np.stack(rows)[:, rest], group[rest]
        cells = voronoi(d, r)
        forest.cells += len(cells)
        if sum(c.sum() for c in cells) <= GROWTH * len(group):
            todo += [group[c] for c in cells]
            continue
        own, at = members(group)
        for k, i in enumerate(group[:-1].tolist()):
            later = group[k + 1 :]
            if forest.one(group[k:]):
                break
            open_ = (forest.root[later] != forest.root[i]) & (np.abs(d[:, k + 1 :] - d[:, k : k + 1]).max(0) <= r)
            open_ &= (100 * size[later] >= percent * size[i]) & (100 * size[i] >= percent * size[later])
            if open_.any():
                some = later[open_]
                _, near = measure(i, some, *members(some))
                forest.by_window += len(near)
                forest.link(i, near)
    return forest


def _join(words: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                root = join_region(sets, percent).root
                doc = np.array(ids, np.int64)
                out = doc[root]
                linked = out != doc
                if linked.any():
                    yield pa.RecordBatch.from_pydict({"a": out[linked], "b": doc[linked]})

        for batch in batches:
            for part, texts in chunks(batch, "text"):
                flat, bounds = shingles(texts, words)
                keys = zip(*(part.column(c).to_pylist() for c in ("pivot", "bi", "bj")), strict=True)
                for i, (k, doc) in enumerate(zip(keys, part.column("rep").to_pylist(), strict=True)):
                    if k != key:
                        yield from flush()
                        key, ids, sets = k, [], []
                    ids.append(doc)
                    sets.append(np.unique(flat[bounds[i] : bounds[i + 1]]))
        yield from flush()

    return run


def _pivot_distances(words: int, percent: int):
    """Of the sets of a part of a region from the region's pivots, which stand before them (role 0): a row for each cell
    that a set is in. linked: to the cell's pivot."""
    r = 1 - percent / 100 + 1e-9

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivots, names = None, [], []
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                flat, bounds = shingles(texts, words)
                rows = zip(*(part.column(c).to_pylist() for c in ("pivot", "salt", "role", "rep", "n", "parts")), strict=True)
                out: list[tuple] = []
                for i, (region, salt, role, rep, n, parts) in enumerate(rows):
                    if (region, salt) != key:
                        key, pivots, names = (region, salt), [], []
                    own = np.unique(flat[bounds[i] : bounds[i + 1]])
                    if role == 0:
                        pivots.append(own)
                        names.append(rep)
                        continue
                    shared = np.array([len(np.intersect1d(own, p, assume_unique=True)) for p in pivots])
                    union = np.array([len(p) for p in pivots]) + len(own) - shared
                    d = 1 - shared / union
                    for k in np.flatnonzero(d <= d.min() + 2 * r).tolist():
                        out.append((region, names[k], rep, n, parts, float(d[k]), bool(d[k] == d.min()), bool(100 * shared[k] >= percent * union[k])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], [c.split()[0] for c in _CELL.split(", ")])

    return run


_CELL = "pivot long, centre long, rep long, n long, parts long, d double, own boolean, linked boolean"


def split_regions(docs: DataFrame, regions: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """regions: pivot, rep, n, parts. Returns the regions with those above BLOCK_SHINGLES taken apart into cells, as far as cells
    shrink, and the links found on the way (a, b)."""
    spark = docs.sparkSession
    r = 1 - percent / 100 + 1e-9
    done, links, todo = [], [spark.range(0).selectExpr("id as a", "id as b")], regions
    for step in range(STEPS):
        large = todo.groupBy("pivot").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).alias("g")).where("g > 1")
        if large.isEmpty():
            break
        done.append(skew_join(todo, large, "pivot", "rep", "left_anti"))
        own = saved(skew_join(todo, large, "pivot", "rep"), "members")
        bucket = F.pmod(F.xxhash64("rep", F.lit(step)), F.lit(PIVOTS))
        centres = own.groupBy("pivot", "g", bucket.alias("bucket")).agg(F.max(F.struct("parts", F.xxhash64("rep", F.lit(1)), "rep")).alias("best"))
        centres = centres.select("pivot", F.col("best.rep").alias("rep"), F.lit(0).alias("role"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("parts"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("salt"))
        rows = own.select("pivot", "rep", F.lit(1).alias("role"), "n", "parts", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("g")).alias("salt")).unionByName(centres)
        texts = docs.join(rows.hint("shuffle_hash"), docs["doc_id"] == rows["rep"]).select("pivot", "salt", "role", "rep", "n", "parts", "text")
        dealt = texts.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role", "rep")
        cells = saved(dealt.mapInArrow(_pivot_distances(words, percent), _CELL), "cells")
        links.append(cells.where("linked and centre != rep").select(F.col("centre").alias("a"), F.col("rep").alias("b")))
        # A cell goes on with what is not linked to its centre, and of the rest with what such a one could be linked to.
        rest = cells.groupBy("pivot", "centre").agg(F.min(F.when(~F.col("linked"), F.col("d"))).alias("least"), F.max(F.when(F.col("own"), F.col("d"))).alias("radius")).where("least is not null and radius is not null")
        keyed = lambda x: x.withColumn("cell", F.xxhash64("pivot", "centre", F.lit(step)))
        going = skew_join(keyed(cells), keyed(rest).drop("pivot", "centre"), "cell", "rep").where(f"(not linked or d >= least - {r}) and d <= radius + {r} and rep != centre")
        going = saved(going.select("pivot", "cell", "rep", "n", "parts").distinct(), "going")
        before, after = own.groupBy("pivot").agg(F.sum("n").alias("before")), going.groupBy("pivot").agg(F.sum("n").alias("after"))
        stuck = before.join(after, "pivot").where(F.col("after") > GROWTH * F.col("before")).select("pivot")
        done.append(skew_join(own.drop("g"), stuck, "pivot", "rep", "left_semi"))
        todo = saved(skew_join(going, stuck, "pivot", "rep", "left_anti").select(F.col("cell").alias("pivot"), "rep", "n", "parts"), "todo")
    found, pairs = todo, links[0]
    for x in done:
        found = found.unionByName(x)
    for x in links[1:]:
        pairs = pairs.unionByName(x)
    return (saved(found, "regions") if done else found), pairs


def jaccard_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = saved(describe(docs, words), "sets")
    points = known.where("n > 0 and doc_id is not null")
    reps = points.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    shards = max(partitions(spark), (points.agg(F.sum("n")).first()[0] or 0) // SHARD_SHINGLES)
    shared = docs.mapInArrow(_parts(words, percent, shards), "shard int, blob binary").groupBy("shard").applyInArrow(_meet(percent), "pivot long, rep long, n long, parts long")
    met = saved(shared.groupBy("pivot", "rep").agg(F.max("n").alias("n"), F.sum("parts").alias("parts")), "met")
    # Regions whose pivots are near each other become one, so that a text of a dense group is sent once, not once per pivot.
    near = met.where(F.col("parts") >= NEAR_PARTS).where("rep != pivot").join(met.select(F.col("pivot").alias("rep")).distinct().hint("merge"), "rep", "left_semi")
    merged = components(near.select(F.col("pivot").alias("a"), F.col("rep").alias("b"))).select(F.col("node").alias("pivot"), "component")
    regions = skew_join(met, merged, "pivot", "rep", "left").groupBy(F.coalesce("component", "pivot").alias("pivot"), "rep").agg(F.max("n").alias("n"), F.sum("parts").alias("parts"))
    regions, links = split_regions(docs, saved(regions, "regions"), words, percent)
    large = regions.groupBy("pivot").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).alias("g")).where("g > 1")
    block = F.pmod(F.xxhash64("rep"), F.col("g"))
    placed = skew_join(regions, large, "pivot", "rep", "left").withColumn("g", F.coalesce("g", F.lit(1).cast("long")))
    placed = placed.select("pivot", "rep", block.alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("o"))
    placed = placed.select("pivot", "rep", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"))
    texts = docs.join(placed.hint("shuffle_hash"), docs["doc_id"] == placed["rep"]).select("pivot", "bi", "bj", "rep", "text")
    dealt = texts.repartition("pivot", "bi", "bj").sortWithinPartitions("pivot", "bi", "bj", "rep")
    # Written once: the steps below read the links twice.
    links = saved(links.unionByName(dealt.mapInArrow(_join(words, percent), "a long, b long")), "links")
    classes = components(links).select(F.col("node").alias("rep"), "component")
    named = reps.select("s1", "s2", "rep").join(classes.hint("merge"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    found = known.select("doc_id", "n", "s1", "s2").join(named.hint("merge"), ["s1", "s2"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, whole: of each class the document of smallest doc_id, once."""
    gone = jaccard_classes(docs, words, percent).where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    kept = docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["gone"], "left_anti")
    return kept.dropDuplicates(["doc_id", "text"])


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
ORACLE_SQL = {
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)""",
}
