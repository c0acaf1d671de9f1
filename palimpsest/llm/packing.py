"""Packing by lexical retrieval: each window starts with a seed document and is filled with its BM25 neighbours.

1. Tokenise every whole text once, into a table in the shared folder, with a routing value: a min-hash of 63 bits of a
   document's id pairs, so that like documents have the same one with the probability of their resemblance, however many
   documents there are. Each task also leaves, in the same table, how many of its documents hold each token id, and
   how many tokens it saw. Both are of fixed size.
2. The table is ordered by routing value, then by a hash of the document, over as many tasks as it has SHARD_TOKENS
   tokens, so that a group of copies of any size is dealt out. A task cuts its rows into shards of about that size; what
   the last window of one holds, if not full, goes to the next.
3. Each shard builds an inverted index with BM25 weights from the document frequencies of all documents. A document
   of a window or more fills windows of its own; what is left of it joins the rest. Seeds, longest first, query
   with all their ids; unused neighbours, best first, fill the window. The last one is cut where
   the window ends and its remainder goes back. Without neighbours the next unused document is taken. So only the last
   window of a task is not full. A seed sees its own shard only.

Sequences are padded to the window, unless their length is a power of two.

Defined cases. Null or empty text: the end id alone. Repeated rows and copies: each is packed. Ties: smaller
routing value, then smaller doc_id.
Texts longer than a window: cut, every id in one piece. Null doc_id: packed like others. Extra columns are ignored.
Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import chunks, saved, table
from palimpsest.llm.tokens import WordTokenizer
from palimpsest.llm.words import mix

WINDOW, END_ID, VOCABULARY = 4096, 2, 1 << 16
SHARD_TOKENS = 3_000_000
K1, B = 1.2, 0.75
#: Ids that more than one in so many documents of a shard hold are kept as whole rows of weights.
DENSE = 8
_PIECES = 16
_KEPT: dict[str, WordTokenizer] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenise(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Rows of kind 0: doc_id, ids (uint16, with the end id), route. Rows of kind 1: a piece of a task's counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _KEPT.setdefault(tokenizer, None) or WordTokenizer(tokenizer)
        _KEPT[tokenizer] = coder
        held = np.zeros(VOCABULARY + _PIECES, np.int64)
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                ids, bounds = coder.encode(texts)
                ids = np.insert(ids, bounds[1:], END_ID)
                bounds = bounds + np.arange(len(bounds))
                order = mix(ids.astype(np.uint64) + np.uint64(7))
                # A route: the smallest hash of an id pair, so that frequent ids alone don't decide.
                pair = order.copy()
                pair[:-1] = mix(order[:-1] + np.uint64(3) * order[1:])
                pair[bounds[1:] - 1] |= np.uint64(1 << 63)
                route = (mix(np.minimum.reduceat(pair, bounds[:-1])) >> np.uint64(1)).astype(np.int64)
                held[VOCABULARY] += len(ids)
                raw = []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    held[np.unique(ids[a:b])] += 1
                    raw.append(ids[a:b].tobytes())
                n = len(raw)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), part.column("doc_id").cast(pa.int64()), pa.array(route), pa.array(raw, pa.binary())], ["kind", "doc_id", "route", "ids"])
        every = np.split(held, _PIECES)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(_PIECES, np.int32)), pa.nulls(_PIECES, pa.int64()), pa.array(np.arange(_PIECES)), pa.array([x.tobytes() for x in every], pa.binary())], ["kind", "doc_id", "route", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, doc_id long, route long, ids binary")


def _add(piece: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"route": [piece["route"].iloc[0]], "ids": [sum(np.frombuffer(x, np.int64) for x in piece["ids"]).tobytes()]})


class _Index:
    """A shard's inverted index."""

    def __init__(self, docs: list[np.ndarray], held: np.ndarray, total: int, mean: float):
        size = np.array([len(d) for d in docs])
        key = np.repeat(np.arange(len(docs), dtype=np.int64), size) * VOCABULARY + np.concatenate(docs)
        key, tf = np.unique(key, return_counts=True)
        doc, term = key // VOCABULARY, key % VOCABULARY
        idf = np.log1p((total - held + 0.5) / (held + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / max(mean, 1)))
        self.query, self.bounds = term, np.searchsorted(doc, np.arange(len(docs) + 1))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(VOCABULARY + 1))
        self.rows: dict[int, np.ndarray] = {}
        for t in np.flatnonzero(np.diff(self.start) * DENSE > len(docs)).tolist():
            a, b = self.start[t], self.start[t + 1]
            self.rows[t] = np.zeros(len(docs))
            self.rows[t][self.doc[a:b]] = self.weight[a:b]

    def scores(self, seed: int, n: int) -> np.ndarray:
        """BM25 of all documents for all ids of the seed."""
        out = np.zeros(n)
        for t in self.query[self.bounds[seed] : self.bounds[seed + 1]].tolist():
            if (row := self.rows.get(t)) is not None:
                out += row
            else:
                a, b = self.start[t], self.start[t + 1]
                out[self.doc[a:b]] += self.weight[a:b]
        return out


def pack_shard(docs: list[np.ndarray], held: np.ndarray, total: int, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset)."""
    pieces, sequence = [], 0
    size = np.array([len(d) for d in docs], np.int64)
    done = np.zeros(len(docs), np.int64)
    for i in np.flatnonzero(size >= window).tolist():
        for _ in range(size[i] // window):
            pieces.append((i, int(done[i]), window, sequence, 0))
            done[i] += window
            sequence += 1
    left = size - done
    index = _Index(docs, held, total, mean)
    order = np.argsort(-left, kind="stable")
    at = 0
    while True:
        while at < len(order) and left[order[at]] == 0:
            at += 1
        if at == len(order):
            return pieces
        seed, space = int(order[at]), window
        scores = index.scores(seed, len(docs))
        near = np.flatnonzero((scores > 0) & (left > 0))
        near = near[np.argsort(-scores[near], kind="stable")]
        for i in _then(seed, near.tolist(), order, at, left):
            take = min(int(left[i]), space)
            pieces.append((i, int(done[i]), take, sequence, window - space))
            done[i] += take
            left[i] -= take
            space -= take
            if not space:
                break
        sequence += 1


def _then(seed: int, near: list[int], order: np.ndarray, at: int, left: np.ndarray) -> Iterator[int]:
    yield seed
    for i in near:
        if left[i]:
            yield i
    for i in order[at:].tolist():
        if left[i]:
            yield i


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_to."""
    coded = saved(tokenise(docs, tokenizer or default_tokenizer()), "tokens")
    counts = np.zeros(VOCABULARY + _PIECES, np.int64)
    for r in coded.where("kind = 1").select("route", "ids").groupBy("route").applyInPandas(_add, "route long, ids binary").collect():
        part = np.frombuffer(bytes(r["ids"]), np.int64)
        counts[r["route"] * len(part) : (r["route"] + 1) * len(part)] = part
    held, tokens_seen = counts[:VOCABULARY], int(counts[VOCABULARY])
    total = int(held[END_ID])  # every document has the end id
    mean, target = tokens_seen / max(total, 1), SHARD_TOKENS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back: list[tuple[int | None, np.ndarray, int]] = []  # (doc_id, ids, first id not packed)
        first, filled = TaskContext.get().partitionId() << 32, 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal first, filled, held_back
            if not held_back:
                return
            rows = np.array(pack_shard([d[at:] for _, d, at in held_back], held, total, mean, window), np.int64)
            tokens = np.bincount(rows[:, 3], rows[:, 2]).astype(np.int64)
            full = rows[:, 3] < len(tokens) - (not last and tokens[-1] < window)
            later = [(held_back[i][0], held_back[i][1], held_back[i][2] + s) for i, s in rows[~full, :2].tolist()]
            rows = rows[full]
            if len(rows):
                of = rows[:, 0]
                starts = rows[:, 1] + np.array([at for _, _, at in held_back], np.int64)[of]
                crc = [zlib.crc32(held_back[i][1][s : s + n].astype("<u4").tobytes()) for i, s, n in zip(of.tolist(), starts.tolist(), rows[:, 2].tolist(), strict=True)]
                long = tokens[rows[:, 3]]
                own = np.array([len(d) for _, d, _ in held_back], np.int64)[of]
                padded = np.where(long & (long - 1) == 0, long, window)
                names = pa.array([name for name, _, _ in held_back], pa.int64()).take(pa.array(of))
                yield pa.RecordBatch.from_pydict({"doc_id": names, "start": starts, "length": rows[:, 2], "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": own, "sequence_id": first + rows[:, 3], "offset": rows[:, 4], "sequence_tokens": long, "padded_to": padded})
                first += int(rows[:, 3].max()) + 1
            held_back, filled = later, sum(len(d) - at for _, d, at in later)

        for b in batches:
            for name, ids in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                held_back.append((name, np.frombuffer(ids, np.uint16), 0))
                filled += len(held_back[-1][1])
                if filled >= target:
                    yield from flush(False)
        yield from flush(True)

    coded_docs = coded.where("kind = 0").select("route", "doc_id", "ids")
    dealt = coded_docs.repartitionByRange(max(1, -(-tokens_seen // target)), "route", F.xxhash64("doc_id", "ids")).sortWithinPartitions("route", "doc_id", F.crc32("ids"))
    kinds = ", ".join(f"{k} long" for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_to"))
    return dealt.mapInArrow(run, kinds)


def op9_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_bm25_packing": op9_bm25_packing}
ORACLE_SQL: dict[str, str] = {}
