"""Line diffs: Myers' O(ND) difference algorithm in linear space (1986), over interned lines."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

#: (start_a, start_b, deleted_a, inserted_b)
Item = tuple[int, int, int, int]


def _middle(a: Sequence[int], b: Sequence[int], a0: int, a1: int, b0: int, b1: int) -> tuple[int, int]:
    """A point that an optimal path passes, of ranges that neither begin nor end alike."""
    n, m = a1 - a0, b1 - b0
    delta = n - m
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or k != d and ahead[k - 1] < ahead[k + 1] else ahead[k - 1] + 1
            while x < n and 0 <= x - k < m and a[a0 + x] == b[b0 + x - k]:
                x += 1
            ahead[k] = x
            if delta % 2 and -(d - 1) <= delta - k <= d - 1 and x + back[delta - k] >= n:
                return a0 + x, b0 + x - k
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or k != d and back[k - 1] < back[k + 1] else back[k - 1] + 1
            while x < n and 0 <= x - k < m and a[a1 - 1 - x] == b[b1 - 1 - x + k]:
                x += 1
            back[k] = x
            if not delta % 2 and -d <= delta - k <= d and x + ahead[delta - k] >= n:
                return a1 - x, b1 - x + k
    raise AssertionError("paths always meet")


def _changes(a: Sequence[int], b: Sequence[int]) -> tuple[list[bool], list[bool]]:
    """Which elements of a are deleted and which of b are inserted."""
    gone, new = [False] * len(a), [False] * len(b)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
        if a0 == a1 or b0 == b1:
            gone[a0:a1] = [True] * (a1 - a0)
            new[b0:b1] = [True] * (b1 - b0)
        else:
            x, y = _middle(a, b, a0, a1, b0, b1)
            todo += [(a0, x, b0, y), (x, a1, y, b1)]
    return gone, new


def _slide(values: Sequence[int], changed: list[bool]) -> None:
    """Moves each run of changes down while its first value equals the one after it."""
    at = 0
    while at < len(values):
        if not changed[at]:
            at += 1
            continue
        end = at
        while end < len(values) and changed[end]:
            end += 1
        if end < len(values) and values[at] == values[end]:
            changed[at], changed[end] = False, True
        else:
            at = end


def _items(gone: list[bool], new: list[bool]) -> list[Item]:
    items, i, j = [], 0, 0
    while i < len(gone) or j < len(new):
        if i < len(gone) and j < len(new) and not gone[i] and not new[j]:
            i, j = i + 1, j + 1
            continue
        start_a, start_b = i, j
        while i < len(gone) and (gone[i] or j >= len(new)):
            i += 1
        while j < len(new) and (new[j] or i >= len(gone)):
            j += 1
        items.append((start_a, start_b, i - start_a, j - start_b))
    return items


def diff_values(a: Sequence[int], b: Sequence[int]) -> list[Item]:
    return _items(*_changes(a, b))


def _interned(texts: tuple[str, str], trim: bool, blanks: bool, case: bool) -> list[list[int]]:
    numbers: dict[str, int] = {}
    out = []
    for text in texts:
        lines = text.replace("\r", "").split("\n")
        if trim:
            lines = [x.strip() for x in lines]
        if blanks:
            lines = [re.sub(r"\s+", " ", x) for x in lines]
        if case:
            lines = [x.lower() for x in lines]
        out.append([numbers.setdefault(x, len(numbers)) for x in lines])
    return out


def diff_text(a: str, b: str, trim: bool = False, blanks: bool = False, case: bool = False, slide: bool = True) -> list[Item]:
    """Items between the lines of two texts; trim, one blank for several, and lower case on demand. slide: runs of
    changes move down as far as they can."""
    left, right = _interned((a, b), trim, blanks, case)
    gone, new = _changes(left, right)
    if slide:
        _slide(left, gone)
        _slide(right, new)
    return _items(gone, new)


def apply(items: list[Item], a: list, b: list) -> list:
    """The second sequence, from the first and the items' own insertions."""
    out, at = [], 0
    for start_a, start_b, deleted, inserted in items:
        out += a[at:start_a] + b[start_b : start_b + inserted]
        at = start_a + deleted
    return out + a[at:]


def diff_pairs(pairs: DataFrame, **options: bool) -> DataFrame:
    """pairs: key columns, a, b. The keys with items array<struct<start_a, start_b, deleted_a, inserted_b>>.
    Null texts are empty. Rows stay where they are; each needs only its own two texts."""
    keys = [f for f in pairs.schema.fields if f.name not in ("a", "b")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [[dict(zip(("start_a", "start_b", "deleted_a", "inserted_b"), i, strict=True)) for i in diff_text(a or "", b or "", **options)] for a, b in zip(f["a"], f["b"], strict=True)]
            yield f[[k.name for k in keys]].assign(items=found)

    schema = ", ".join(f"{k.name} {k.dataType.simpleString()}" for k in keys)
    return pairs.mapInPandas(run, f"{schema}, items array<struct<start_a:int,start_b:int,deleted_a:int,inserted_b:int>>")
