"""Suffix-array dedup: removes every byte covered by a string of LENGTH bytes that also starts in an earlier document.

One suffix array over a corpus cannot be dealt out, and most of a corpus is unique. So:

1. Texts are dealt to groups by a hash of the whole text; equal texts become one unit there (of the smallest doc_id;
   later copies go whole). A unit that half of all documents share is dealt once per task.
2. Anchors: of the SPAN strings of GRAM bytes inside each string of LENGTH bytes, those of smallest hash. Equal strings have
   equal anchors. Distinct anchor hashes meet in shards, which tell each group which of its anchors others have.
3. Contexts of shared anchors (all strings of LENGTH bytes that such an anchor stands for) go to the shard of their
   anchor, each distinct one once per group. Contexts that are equal in several groups are settled at once. The others
   with the same anchor form the shard's text: its suffix array is built by induced sorting, and neighbours in it
   whose permuted common prefix reaches LENGTH hold the same string.
4. Each group gets its verdicts, removes the covered bytes and digests the rest.

The number of groups and shards follows the bytes of the texts. Everything between tasks is packed arrays: about 5 bytes
per anchor, and the contexts, compressed. The texts are
shuffled once (compressed): all three stages read the same exchange.

Defined cases. Null text: empty. Texts below LENGTH bytes: nothing is removed. Equal doc_ids: none is smaller, so neither
loses bytes to the other. Null doc_id: after all others. Copies and repeated rows: see 1. Very long texts are
treated whole. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import chunks, partitions, strings, table
from palimpsest.llm.suffix import permuted_lcp, suffix_array
from palimpsest.llm.words import hash_ranges, mix

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1
#: Bytes of the texts of one packed row, of one suffix array, and of the texts whose anchors are found at once.
PACK_BYTES, SHARD_BYTES, STEP_BYTES = 8 << 20, 1 << 19, 1 << 19
#: Bytes of the texts of one group; bounds a task's memory at every size of the corpus.
GROUP_BYTES = 16 << 20
_LAST = np.uint64((1 << 64) - 1)
_NO_ID = (1 << 63) - 1
_BYTE = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_STEP = mix(np.arange(301, 309, dtype=np.uint64)) | np.uint64(1)
_Q = np.uint64(29)


def _dump(*parts) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts, protocol=5))


def _load(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _planes(x: np.ndarray) -> bytes:
    """Differences of ascending numbers, byte plane by byte plane: high planes vanish in compression."""
    return np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick over each n neighbours."""
    k = 1
    while 2 * k <= n:
        x = pick(x[:-k], x[k:])
        k *= 2
    return pick(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit hash, position) of the anchors of several texts."""
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x, made, k = _BYTE[data], {}, 1
    made[1] = x
    for i in range(4):  # grams of 2, 4, 8, 16 bytes
        x = x[:-k] * _STEP[i] + x[k:]
        x ^= x >> _Q
        k *= 2
        made[k] = x
    eight = made[8][16:]
    x = mix(made[16][: len(eight)] * _STEP[4] + eight)
    stop = np.repeat(offsets[1:], np.diff(offsets))
    here = np.arange(len(data))
    x[here[: len(x)] + GRAM > stop[: len(x)]] = _LAST
    least = _slide(x, SPAN, np.minimum)
    least[here[: len(least)] + LENGTH > stop[: len(least)]] = 0
    pad = np.zeros(SPAN - 1, np.uint64)
    chosen = _slide(np.concatenate([pad, least, pad]), SPAN, np.maximum)[: len(x)]
    at = np.flatnonzero((chosen == x) & (x != _LAST) & (x != 0))
    # Chosen hashes are small ones: mixed again, they spread evenly over shards.
    return mix(x[at] ^ _BYTE[0]) >> np.uint64(16), at


class Units:
    """The distinct texts of a group, by smallest doc_id."""

    def __init__(self, blobs: Iterable[bytes]):
        docs: dict[bytes, list[np.ndarray]] = {}
        for blob in blobs:
            raw, sizes, ids, counts = _load(blob)
            at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            own = np.split(ids, np.cumsum(counts)[:-1])
            for i, d in enumerate(own):
                docs.setdefault(raw[at[i] : at[i + 1]], []).append(d)
        units = sorted((int(min(x.min() for x in d)), t, d) for t, d in docs.items())
        self.first = np.array([u[0] for u in units], np.int64)
        self.docs = [np.concatenate(u[2]) for u in units]
        self.data = np.frombuffer(b"".join(u[1] for u in units), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(u[1]) for u in units])]).astype(np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, position in data) of all anchors."""
        parts, i, n = [], 0, len(self.first)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + STEP_BYTES, "right")) - 1)
            base = self.offsets[i]
            h, at = anchors(self.data[base : self.offsets[j]], self.offsets[i : j + 1] - base)
            parts.append((h, at + base))
            i = j
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def unit(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1


def _distinct(units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position) of all anchors, the distinct hashes, the number of each anchor's, and whether several units have it."""
    h, at = units.anchors()
    known, number = np.unique(h, return_inverse=True)
    unit = units.unit(at)
    low, high = np.full(len(known), len(units.first)), np.full(len(known), -1)
    np.minimum.at(low, number, unit)
    np.maximum.at(high, number, unit)
    return h, at, known, number, low < high


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Of ascending 48-bit hashes; ascending."""
    return ((h >> np.uint64(16)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _cuts(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of ascending shard numbers."""
    if len(shard):
        start = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        yield from zip(shard[start].tolist(), start.tolist(), [*start[1:].tolist(), len(shard)], strict=True)


_ROW = "q int, p int, blob binary"


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    q, p, blob = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.table({"q": pa.array(q, pa.int32()), "p": pa.array(p, pa.int32()), "blob": pa.array(blob, pa.binary())})


def _deal(groups: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in chunks(batch, "text", PACK_BYTES):
                texts = strings(part.column("text")).cast(pa.large_binary()).to_pylist()
                ids = part.column("doc_id").cast(pa.int64()).fill_null(_NO_ID).to_pylist()
                docs: dict[bytes, list[int]] = {}
                for t, i in zip(texts, ids, strict=True):
                    docs.setdefault(t, []).append(i)
                dealt: dict[int, list[bytes]] = {}
                for t in docs:
                    dealt.setdefault(xxhash.xxh3_64_intdigest(t, 7) % groups, []).append(t)
                rows = [(q, -1, _dump(b"".join(ts), np.array([len(t) for t in ts], np.int64), np.array([i for t in ts for i in docs[t]], np.int64), np.array([len(docs[t]) for t in ts], np.int64))) for q, ts in dealt.items()]
                yield from _rows(rows).to_batches()

    return run


def _announce(shards: int):
    def run(group: pa.Table) -> pa.Table:
        q = group.column("q")[0].as_py()
        _, _, known, _, several = _distinct(Units(group.column("blob").to_pylist()))
        return _rows([(q, p, _dump(_planes(known[a:b]), np.packbits(several[a:b]))) for p, a, b in _cuts(_shard(known, shards))])

    return run


def _answer(group: pa.Table) -> pa.Table:
    """Which of a group's anchors another unit has."""
    p = group.column("p")[0].as_py()
    parts = [_load(b) for b in group.column("blob").to_pylist()]
    hashes = [_unplanes(x[0]) for x in parts]
    every, number, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    shared = count > 1
    several = np.concatenate([np.unpackbits(x[1], count=len(h)) for x, h in zip(parts, hashes, strict=True)]).astype(np.bool_)
    bits = np.split(shared[number] | several, np.cumsum([len(h) for h in hashes])[:-1])
    return _rows([(q, p, _dump(np.packbits(b), len(b))) for q, b in zip(group.column("q").to_pylist(), bits, strict=True)])


def _contexts(shards: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _rows([])
        q = texts.column("q")[0].as_py()
        units = Units(texts.column("blob").to_pylist())
        h, at, known, number, _ = _distinct(units)
        shared = np.zeros(len(known), np.bool_)
        told = {p: _load(b) for p, b in zip(answers.column("p").to_pylist(), answers.column("blob").to_pylist(), strict=True)}
        for p, a, b in _cuts(_shard(known, shards)):
            bits, n = told[p]
            shared[a:b] = np.unpackbits(bits, count=n)
        keep = shared[number]
        h, at = h[keep], at[keep]
        unit = units.unit(at)
        low = np.maximum(units.offsets[unit], at - (SPAN - 1))
        high = np.minimum(units.offsets[unit + 1], at + LENGTH)
        digest = hash_ranges(units.data, low, high)
        order = np.lexsort((low, unit, digest))
        h, unit, low, high, digest = (x[order] for x in (h, unit, low, high, digest))
        new = np.append(True, digest[1:] != digest[:-1]) if len(h) else np.zeros(0, np.bool_)
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        later = units.first[unit] > units.first[unit[first]][group] if len(h) else new
        # One context of each kind is sent, in text order within its shard.
        shard = _shard(h[first], shards)
        sent = np.lexsort((low[first], shard))
        place = np.empty(len(first), np.int64)
        place[sent] = np.arange(len(first))
        mine = ~later
        rows = [(q, -1, _dump((low[later], high[later]), (place[group[mine]], low[mine])))]
        f, shard = first[sent], shard[sent]
        raw = units.data.tobytes()
        for p, a, b in _cuts(shard):
            k = f[a:b]
            rows.append((q, p, _dump(b"".join(raw[s:e] for s, e in zip(low[k].tolist(), high[k].tolist(), strict=True)), (high[k] - low[k]).astype(np.uint8), h[k], units.first[unit[k]])))
        return _rows(rows)

    return run


def _judge(group: pa.Table) -> pa.Table:
    """A bit for each string of LENGTH bytes of each context: an earlier unit has it."""
    if group.column("p")[0].as_py() < 0:
        return group.select(["q", "p", "blob"])
    p, qs = group.column("p")[0].as_py(), group.column("q").to_pylist()
    parts = [_load(b) for b in group.column("blob").to_pylist()]
    data = np.frombuffer(b"".join(x[0] for x in parts), np.uint8)
    parts = [(None, *x[1:]) for x in parts]
    size, h, doc = (np.concatenate([x[k] for x in parts]).astype(t) for k, t in ((1, np.int64), (2, np.uint64), (3, np.int64)))
    start = np.cumsum(size) - size
    every = ((np.int64(1) << (size - LENGTH + 1)) - 1).astype(np.int64)
    digest = hash_ranges(data, start, start + size)
    order = np.lexsort((doc, digest, h))
    oh, od, odoc = h[order], digest[order], doc[order]
    new = np.append(True, (oh[1:] != oh[:-1]) | (od[1:] != od[:-1]))
    first = np.flatnonzero(new)
    kind = np.cumsum(new) - 1
    mask = np.zeros(len(h), np.int64)
    later = odoc > odoc[first][kind]
    mask[order[later]] = every[order[later]]
    # Anchors with several kinds of context.
    kh = oh[first]
    alone = np.append(kh[1:] != kh[:-1], True) & np.append(True, kh[1:] != kh[:-1])
    pick = order[first[~alone]]
    mask_kind = np.zeros(len(first), np.int64)
    mask_kind[~alone] = _suffix_verdicts(data, start[pick], size[pick], doc[pick], h[pick])
    same = ~later
    mask[order[same]] = mask_kind[kind[same]]
    return _rows([(q, p, _dump(m.astype(np.uint32))) for q, m in zip(qs, np.split(mask, np.cumsum([len(x[1]) for x in parts])[:-1]), strict=True)])


def _suffix_verdicts(data: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """By suffix arrays over blocks of contexts; those of one anchor are in one block."""
    out = np.zeros(len(start), np.int64)
    a = 0
    total = np.cumsum(size)
    while a < len(start):
        b = int(np.searchsorted(total, total[a] - size[a] + SHARD_BYTES, "right"))
        b = int(np.searchsorted(h, h[max(b - 1, a)], "right"))
        n = size[a:b] + 1  # and a separator
        base = np.cumsum(n) - n
        owner = np.repeat(np.arange(b - a), n)
        inside = np.arange(n.sum()) - base[owner]
        source = np.minimum(start[a:b][owner] + inside, len(data) - 1)
        text = data[source].astype(np.int64) + 2
        text[base + n - 1] = 1
        order = suffix_array(text)
        whole = inside + LENGTH <= size[a:b][owner]
        order = order[whole[order]]
        plcp = permuted_lcp((text - 2).astype(np.uint8), order, LENGTH)
        cut = np.append(True, plcp[order[1:]] < LENGTH)
        groups = np.cumsum(cut) - 1
        own = doc[a:b][owner[order]]
        hit = order[own > np.minimum.reduceat(own, np.flatnonzero(cut))[groups]]
        np.bitwise_or.at(out[a:b], owner[hit], np.int64(1) << inside[hit])
        a = b
    return out


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(texts: pa.Table, verdicts: pa.Table) -> pa.Table:
    out: dict[str, list] = {k.split()[0]: [] for k in _RESULT.split(", ")}
    units = Units(texts.column("blob").to_pylist())
    change = np.zeros(len(units.data) + 1, np.int64)
    masks = {}
    for p, b in sorted(zip(verdicts.column("p").to_pylist(), verdicts.column("blob").to_pylist(), strict=True)):
        if p < 0:
            (low, high), (place, at) = _load(b)
        else:
            masks[p] = _load(b)[0]
    if verdicts.num_rows:
        np.add.at(change, low, 1)
        np.add.at(change, high, -1)
        mask = np.concatenate([masks[p] for p in sorted(masks)]) if masks else np.zeros(0, np.uint32)
        bits = mask[place]
        for j in range(SPAN):
            hit = at[(bits >> np.uint32(j)) & np.uint32(1) == 1] + j
            np.add.at(change, hit, 1)
            np.add.at(change, hit + LENGTH, -1)
    covered = np.cumsum(change[:-1]) > 0
    begins = covered.copy()
    begins[1:] &= ~covered[:-1]
    edges = units.offsets[:-1][units.offsets[:-1] < units.offsets[1:]]
    begins[edges] = covered[edges]
    gone, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (covered, begins))
    kept = units.data[~covered].tobytes()
    empty = hashlib.sha256(b"").hexdigest()
    for i, docs in enumerate(units.docs):
        a, b = units.offsets[i], units.offsets[i + 1]
        n, removed = int(b - a), int(gone[b] - gone[a])
        first = (n, removed, int(spans[b] - spans[a]), hashlib.sha256(kept[a - gone[a] : b - gone[b]]).hexdigest())
        copy = (n, n, 1, empty) if n >= LENGTH else first
        for d in docs.tolist():
            for column, v in zip(out.values(), (None if d == _NO_ID else d, *(first if d == units.first[i] else copy)), strict=True):
                column.append(v)
    return pa.table({k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = groups = max(2 * partitions(docs.sparkSession), size // GROUP_BYTES)
    dealt = docs.select("doc_id", "text").mapInArrow(_deal(groups), _ROW)
    said = dealt.groupBy("q").applyInArrow(_announce(shards), _ROW)
    answers = said.groupBy("p").applyInArrow(_answer, _ROW)
    contexts = dealt.groupBy("q").cogroup(answers.groupBy("q")).applyInArrow(_contexts(shards), _ROW)
    # What a group keeps for itself (p below 0) passes through by its own key.
    verdicts = contexts.selectExpr("q", "p", "blob", "if(p < 0, -1 - q, p) as k").groupBy("k").applyInArrow(_judge, _ROW)
    return dealt.groupBy("q").cogroup(verdicts.groupBy("q")).applyInArrow(_remove, _RESULT)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLE_SQL = {
    "op4_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
first_ AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM win JOIN first_ USING (s) WHERE f < doc_id),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit)),
span AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, run),
gap AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM span
  UNION ALL SELECT doc_id, max(b), NULL FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN gap.b IS NULL THEN substr(h, 2 * gap.a + 1) ELSE substr(h, 2 * gap.a + 1, 2 * (gap.b - gap.a)) END, '' ORDER BY gap.a) AS h FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
total AS (SELECT doc_id, sum(b - a) AS n, count(*) AS k FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(total.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(total.k, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN total USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
