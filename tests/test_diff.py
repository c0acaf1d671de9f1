import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.operators import blame, diff

ALL = "a,b,c,d,e,f,g,h,i,j,k,l"
# Scripts deleted.inserted.start_a.start_b.
SCRIPTS = [
    (ALL, "0,1,2,3,4,5,6,7,8,9", "12.10.0.0*"),
    (ALL, ALL, ""),
    ("a,b,c,d,e,f", "b,c,d,e,f,x", "1.0.0.0*0.1.6.5*"),
    ("c1,a,c2,b,c,d,e,g,h,i,j,c3,k,l", "C1,a,C2,b,c,d,e,I1,e,g,h,i,j,C3,k,I2,l", "1.1.0.0*1.1.2.2*0.2.7.7*1.1.11.13*0.1.13.15*"),
    ("F", "0,F,1,2,3,4,5,6,7", "0.1.0.0*0.7.1.2*"),
    ("HELLO\nWORLD", "\n\nhello\n\n\n\nworld\n", "2.8.0.0*"),
    ("a,b,-,c,d,e,f,f", "a,b,x,c,e,f", "1.1.2.2*1.0.4.4*1.0.6.5*"),
]
@pytest.mark.parametrize("a,b,script", SCRIPTS)
def test_scripts(a, b, script):
    # The last script was recorded before runs were moved down.
    found = diff.diff_text(a.replace(",", "\n"), b.replace(",", "\n"), slide=script != SCRIPTS[-1][2])
    assert "".join(f"{d}.{i}.{s}.{t}*" for s, t, d, i in found) == script


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from(["red", "green", "blue", "sky"]), max_size=14), st.lists(st.sampled_from(["red", "green", "blue", "sea"]), max_size=14))
def test_words_are_patched(a, b):
    x, y = blame.wrapped_lines(" ".join(a), 1), blame.wrapped_lines(" ".join(b), 1)
    keys: dict[str, int] = {}
    left, right = ([keys.setdefault(w.strip(), len(keys)) for w in ws] for ws in (x, y))
    assert [w.strip() for w in diff.apply(diff.diff_values(left, right), x, y)] == b


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25))
def test_minimal_and_exact(a, b):
    items = diff.diff_values(a, b)
    assert diff.apply(items, a, b) == b
    assert sum(d for _, _, d, _ in items) == len(a) - longest(a, b)


def test_options():
    assert diff.diff_text(" A  b\r\nc", "a b\nC", trim=True, blanks=True, case=True) == []


def test_fold_attributes_lines():
    texts = ["a\nb\n", "a\nx\nb\n", "a\nb\nc\n", "a\nx\nb\n"]
    assert blame.fold(texts) == [("a\n", 0), ("x\n", 1), ("b\n", 0)]
    # A revert to the first text is credited to its author only if the first text is indexed.
    back = ["a\nb\n", "z\n", "a\nb\n"]
    assert blame.fold(back) == [("a\n", 2), ("b\n", 2)]
    assert blame.fold(back, index_first=True) == [("a\n", 0), ("b\n", 0)]


def test_fold_random_texts():
    rng = random.Random(1)
    for _ in range(50):
        texts = ["\n".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(6)]
        assert [x.strip() for x, _ in blame.fold(texts) if x.strip()] == texts[-1].split()


def test_fold_diffs_only_what_changed(monkeypatch):
    """Lines above and below a change are not looked at again by the diff."""
    seen = []

    def values(a, b):
        seen.append((len(a), len(b)))
        return diff.diff_values(a, b)

    monkeypatch.setattr(blame, "diff_values", values)
    texts = ["".join(f"{k}\n" for k in range(n, -1, -1)) for n in range(60)]
    assert blame.fold(texts) == [(f"{k}\n", k) for k in range(59, -1, -1)]
    assert max(max(x) for x in seen) == 1


def test_pages_stream(spark):
    """Pages over several Arrow batches, a null page and a null place in the history, times as they were."""
    rng = random.Random(2)
    history = [(page, seq, f"u{seq}", "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 6))), seq) for page in (1, 2, None, 7) for seq in (5, 9, None, 1, 3, 30, 4)]
    df = spark.createDataFrame(history, "page_id int, rev_seq long, contributor string, text string, t long").selectExpr("page_id", "rev_seq", "contributor", "text", "timestamp_seconds(t) AS ts", "t % 2 = 0 AS minor")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = {tuple(r) for r in blame.blame(df).selectExpr("page_id", "line_no", "line", "rev_no", "rev_seq", "contributor", "unix_seconds(ts)", "minor").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = set()
    for page in (1, 2, None, 7):
        own = sorted((h for h in history if h[0] == page), key=lambda h: (h[1] is None, h[1]))
        for k, (line, n) in enumerate(blame.fold([h[3] for h in own]), 1):
            seq = own[n][1]
            expected.add((page, k, line, n + 1, seq, own[n][2], seq, None if seq is None else seq % 2 == 0))
    assert found == expected and len(found) > 8
