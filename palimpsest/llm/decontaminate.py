"""Benchmark decontamination by template windows.

Texts become templates: words in lower case without punctuation, with typed placeholders for numbers, for units that
follow a number, and for names (capitalised words inside a sentence, a run of them as one; a second form keeps names as
words, for texts whose capitals were changed; a third takes words that begin a sentence as names too if capitalised, for
names in that place). Windows of WORDS template tokens of all documents are hash-joined to those of the benchmark. A
window with fewer than MIN_LITERAL literal words would fit anything as a template, so it is joined with its values.

Hits of a document on an item are then aligned. Those whose shift (place in the document less place in the item) differs by
few tokens make an occurrence, in which the values of the slots are checked: one value of the item must always stand for
one value of the document and the other way round, over all its shifts. Windows that break this do not count. An item is
found if the windows that count in one occurrence cover LEAST percent of its tokens; reparameterised tells whether a slot
holds another value than in the item in every such occurrence.

One pass over the documents serves a benchmark of any size: a bitmap of fixed size says which windows can be in it,
and only these, with the values of their slots, are written and joined. Hot windows are dealt to many tasks.

Defined cases. Null or empty text: nothing is found in it. Null or empty items, and items without words: never found. Items
below WORDS tokens: one window of their own length, with its values; those of one or two tokens are found only in documents that have
no other tokens. Null item_id: found like others. Equal items: each is found; repeated rows of the benchmark count once. Copies and
repeated rows of documents, and null doc_ids: each row is judged. Very long texts are scanned whole. Extra columns are
ignored. An empty table on either side: no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import chunks, saved, skew_join, table, text_buffer
from palimpsest.llm.words import _LOWER, hash_ranges, mix, windows

WORDS, LEAST, MIN_LITERAL = 5, 80, 3
#: Items of fewer tokens are only found in documents of nothing else.
SHORT = 3
#: Tokens by which the shifts of an occurrence may differ, or a part of the item's tokens.
SLACK, SLACK_PART = 3, 10
#: Bits of the bitmap of the benchmark's windows.
BITS = 1 << 25
LITERAL, NUMBER, UNIT, NAME = range(4)
_PLACE = np.array([0, 0xA1, 0xA2, 0xA3], np.uint64)
# Units.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons lb lbs oz pound pounds ounce ounces "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks "
    "month months year years percent dollar dollars cent cents euro euros pesos francs degree degrees "
    "hz khz mhz ghz v volt volts w watt watts kw j joule joules pa kb mb gb tb mph kmh"
).split()

_INNER = np.zeros(256, np.bool_)
_INNER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, np.bool_)
_DIGIT[48:58] = True
_POINT = np.zeros(256, np.bool_)
_POINT[[0x2C, 0x2E]] = True
_ENDER = np.zeros(256, np.bool_)
_ENDER[list(b".!?:\n")] = True


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer("".join(UNITS).encode(), np.uint8)
    end = np.cumsum([len(u) for u in UNITS])
    return np.sort(hash_ranges(raw, np.concatenate([[0], end[:-1]]), end))


@dataclass
class Templates:
    data: np.ndarray  # bytes in lower case
    start: np.ndarray  # of each token in data
    end: np.ndarray
    kind: np.ndarray
    hash: np.ndarray  # of the token, a placeholder's by its kind
    word: np.ndarray  # hash of the token with its kind and value
    bounds: np.ndarray  # of the texts in the tokens
    head: np.ndarray  # whether the token begins a sentence

    def value(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def templates(texts: pa.LargeStringArray, names: bool = True, heads: bool = False) -> Templates:
    """names: capitalised words inside a sentence become placeholders; heads: those that begin one too."""
    data, offsets = text_buffer(texts)
    inner = _INNER[data]
    digit = _DIGIT[data]
    if len(data) > 2:  # a point or comma between digits
        inner[1:-1] |= _POINT[data[1:-1]] & digit[:-2] & digit[2:]
    first, last = inner.copy(), inner.copy()
    first[1:] &= ~inner[:-1]
    last[:-1] &= ~inner[1:]
    if len(data) > 1:  # 5kg is a number and a unit
        turn = digit[:-1] & inner[1:] & ~digit[1:] & ~_POINT[data[1:]]
        first[1:] |= turn
        last[:-1] |= turn
    full = offsets[:-1] < offsets[1:]
    edges, ends = offsets[:-1][full], offsets[1:][full] - 1
    first[edges], last[ends] = inner[edges], inner[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    capital = (data >= 65) & (data <= 90)
    accented = np.zeros(len(data), np.bool_)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    lower = _LOWER[data]
    lower[accented] += 0x20
    h = hash_ranges(lower, start, end)
    kind = np.zeros(len(start), np.int8)
    inside = np.ones(len(start), np.bool_)
    if len(start):
        kind[digit[start]] = NUMBER
        units = _unit_hashes()
        unit = units[np.minimum(np.searchsorted(units, h), len(units) - 1)] == h
        unit[1:] &= kind[:-1] == NUMBER
        unit[0] = False
        kind[unit] = UNIT
        enders = np.concatenate([[0], np.cumsum(_ENDER[data], dtype=np.int64)])
        inside[1:] = enders[start[1:]] == enders[end[:-1]]
        texts_start = np.searchsorted(start, offsets[:-1])
        inside[texts_start[texts_start < len(start)]] = False
        upper = capital[start] | accented[np.minimum(start + 1, len(data) - 1)] & (end - start > 1)
        if names:
            kind[upper & (inside | heads) & (kind == LITERAL)] = NAME
        kind[texts_start[texts_start < len(start)]] *= kind[texts_start[texts_start < len(start)]] != UNIT
        run = np.zeros(len(start), np.bool_)  # a name after a name is part of it
        run[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & inside[1:]
        run[texts_start[texts_start < len(start)]] = False
        if run.any():
            keep = np.flatnonzero(~run)
            end = end[np.append(keep[1:], len(start)) - 1]
            start, kind, inside = start[keep], kind[keep], inside[keep]
            h = hash_ranges(lower, start, end)
    return Templates(lower, start, end, kind, np.where(kind == LITERAL, h, _PLACE[kind]), mix(h ^ _PLACE[kind]), np.searchsorted(start, offsets), ~inside)


#: Names as placeholders, and those that begin a sentence too.
FORMS = ((True, False), (False, False), (True, True))
_WINDOW = "id long, key long, form int, n int, at long, size long, hash long, slots binary"


def template_windows(t: Templates, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first token) of the windows of n tokens."""
    h, at = windows(t.hash, t.bounds, n)
    exact, _ = windows(t.word, t.bounds, n)
    literal = np.concatenate([[0], np.cumsum(t.kind == LITERAL)])
    generic = (literal[at + n] - literal[at] < MIN_LITERAL) | (n < WORDS)
    return np.where(generic, mix(exact + np.uint64(n)), h), at


def _slots(t: Templates, at: int, n: int, places: list[int]) -> bytes:
    """Place in the window, kind, whether it begins a sentence, and value of each slot."""
    out = []
    for i in places:
        value = t.value(i)
        out.append(bytes([i - at, t.kind[i] | (4 if t.head[i] else 0)]) + len(value).to_bytes(4, "little") + value)
    return b"".join(out)


def _read_slots(raw: bytes) -> list[tuple[int, int, bytes]]:
    out, at = [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at + 2 : at + 6], "little")
        out.append((raw[at], raw[at + 1], raw[at + 6 : at + 6 + size]))
        at += 6 + size
    return out


def _windows(lengths: list[int] | None, bits: np.ndarray | None):
    """id, key, text -> the windows of each text in each form. Of items (no lengths given): windows of their own length, at most
    WORDS. Of documents: windows of the given lengths that the bitmap has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                for form, (names, heads) in enumerate(FORMS):
                    t = templates(texts, names, heads)
                    size = np.diff(t.bounds)
                    slot = np.flatnonzero(t.kind != LITERAL)
                    for n in lengths or range(1, WORDS + 1):
                        h, at = template_windows(t, n)
                        h = mix(h + np.uint64(1000 * form + n))
                        owner = np.searchsorted(t.bounds, at, "right") - 1
                        keep = np.minimum(size[owner], WORDS) == n if bits is None else bits[(h & np.uint64(BITS - 1)).astype(np.int64)]
                        if n < SHORT:
                            keep = keep & (size[owner] == n)
                        k = np.flatnonzero(keep)
                        if not len(k):
                            continue
                        h, at, owner = h[k], at[k], owner[k]
                        a, b = np.searchsorted(slot, at).tolist(), np.searchsorted(slot, at + n).tolist()
                        slots = [_slots(t, p, n, slot[x:y].tolist()) for p, x, y in zip(at.tolist(), a, b, strict=True)]
                        own = [part.column(c).take(pa.array(owner)) for c in ("id", "key")]
                        numbers = [pa.array(np.full(len(k), x, np.int32)) for x in (form, n)]
                        yield pa.RecordBatch.from_arrays([*own, *numbers, pa.array(at - t.bounds[owner]), pa.array(size[owner].astype(np.int64)), pa.array(h.view(np.int64)), pa.array(slots, pa.binary())], [c.split()[0] for c in _WINDOW.split(", ")])

    return run


def _bitmap(windows_: DataFrame) -> np.ndarray:
    """BITS flags, of which those of the windows' hashes are set; packed on the executors."""
    pieces = 64

    def pack(group: pa.Table) -> pa.Table:
        flags = np.zeros(BITS // pieces, np.bool_)
        flags[group.column("bit").to_numpy() % (BITS // pieces)] = True
        return pa.table({"piece": group.column("piece").slice(0, 1), "flags": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    bit = windows_.select(F.expr(f"pmod(hash, {BITS})").alias("bit")).distinct()
    rows = bit.select("bit", F.expr(f"cast(bit div {BITS // pieces} as int)").alias("piece")).groupBy("piece").applyInArrow(pack, "piece int, flags binary").collect()
    out = np.zeros(BITS, np.bool_)
    for r in rows:
        out[r["piece"] * (BITS // pieces) : (r["piece"] + 1) * (BITS // pieces)] = np.unpackbits(np.frombuffer(bytes(r["flags"]), np.uint8)).astype(np.bool_)
    return out


def _pair(x: tuple[int, int, bytes], y: tuple[int, int, bytes]) -> tuple[int, bytes, bytes]:
    """(kind, value in the item, value in the document). A name behind the same first word of a sentence stands alone."""
    kind, head = x[1] & 3, x[1] & y[1] & 4
    if head and kind == NAME:
        (a, *rest), (b, *other) = x[2].split(None, 1), y[2].split(None, 1)
        if a == b and rest and other:
            return kind, rest[0], other[0]
    return kind, x[2], y[2]


def occurrence(hits: list[tuple[int, int, list[tuple[int, bytes, bytes]]]]) -> tuple[set[int], bool]:
    """hits: (place in the item, tokens, slots), in order of trust. The item's tokens in windows whose slots agree with each other,
    and whether a value differs."""
    covered: set[int] = set()
    there: dict = {}
    back: dict = {}
    other = False
    for at, n, slots in hits:
        own, inverse = dict(there), dict(back)
        if all(own.setdefault((k, x), y) == y and inverse.setdefault((k, y), x) == x for k, x, y in slots):
            there, back = own, inverse
            other |= any(x != y for _, x, y in slots)
            covered.update(range(at, at + n))
    return covered, other


def best_occurrence(hits: list[tuple[int, int, int, list]], size: int) -> tuple[int, bool] | None:
    """hits: (shift, place in the item, tokens, slots). (percent, reparameterised) of the best occurrence that reaches LEAST."""
    shifts: dict[int, list] = defaultdict(list)
    for shift, at, n, slots in hits:
        shifts[shift].append((at, n, slots))
    slack, best = max(SLACK, size // SLACK_PART), None
    for main in sorted(shifts, key=lambda x: (-len(shifts[x]), x)):
        near = sorted((s for s in range(main - slack, main + slack + 1) if s in shifts), key=lambda s: (abs(s - main), s))
        own = [h for s in near for h in sorted(shifts[s], key=lambda h: h[0])]
        if 100 * len({i for at, n, _ in own for i in range(at, at + n)}) < LEAST * size:
            continue
        covered, other = occurrence(own)
        percent = 100 * len(covered) // size
        if 100 * len(covered) >= LEAST * size and (best is None or (not other, percent) > (not best[1], best[0])):
            best = percent, other
    return best


def _judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined windows in order of document, item, form and place -> found items."""
    key, rows = None, []

    def flush() -> list[tuple]:
        best, copies = None, 1
        for form in range(len(FORMS)):
            own = [r for r in rows if r[0] == form]
            if not own:
                continue
            distinct = dict.fromkeys(r[:5] for r in own)
            if len(distinct) < len(own):  # repeated rows of a document
                copies = sum(r[:5] == own[0][:5] for r in own)
            slots = {r[:5]: r[5:] for r in own}
            hits = [(at - place, place, n, [_pair(x, y) for x, y in zip(_read_slots(b), _read_slots(a), strict=True)]) for (_, n, at, place, _), (a, b) in slots.items()]
            if (one := best_occurrence(hits, own[0][4])) and (best is None or (not one[1], one[0]) > (not best[1], best[0])):
                best = one
        return [(key[0], key[1], key[3], *best)] * copies if best else []

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], [c.split()[0] for c in _FOUND.split(", ")])

    for batch in batches:
        found: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("id", "key", "item_key", "item_id", "form", "n", "at", "place", "size", "slots", "item_slots")]
        for row in zip(*columns, strict=True):
            if row[:4] != key:
                if key is not None:
                    found += flush()
                key, rows = row[:4], []
            rows.append(row[4:])
        if found:
            yield batch_of(found)
    if key is not None and (found := flush()):
        yield batch_of(found)


_FOUND = "doc_id long, key long, item_id long, covered long, reparameterised boolean"


def found_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), item_id, covered (percent), reparameterised, for each row of docs."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("id"), F.xxhash64("item_id", "text").alias("key"), "text").distinct()
    known = saved(items.mapInArrow(_windows(None, None), _WINDOW), "items")
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), "text")
    hits = saved(texts.mapInArrow(_windows(lengths or [WORDS], _bitmap(known)), _WINDOW), "windows").select("id", "key", "form", "n", "at", "hash", "slots")
    known = known.select("hash", F.col("id").alias("item_id"), F.col("key").alias("item_key"), F.col("at").alias("place"), "size", F.col("slots").alias("item_slots"))
    joined = skew_join(hits, known, "hash", "at")
    dealt = joined.repartition("id", "key", "item_key").sortWithinPartitions("id", "key", "item_key", "item_id", "form", "at", "place")
    return dealt.mapInArrow(_judge, _FOUND)


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, covered (percent), reparameterised."""
    return found_items(docs, benchmark).drop("key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those in which an item is found; rows keep all their columns."""
    found = found_items(docs, benchmark)
    gone = saved(found.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct(), "gone")
    same = docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_key"])
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_template_decontamination": op1_template_decontamination}
ORACLE_SQL: dict[str, str] = {}
