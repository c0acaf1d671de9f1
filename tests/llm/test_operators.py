"""Every operator against brute force and on the awkward cases: nulls, empty and long texts, ties, repeated rows, empty
tables, extra columns."""

import base64
import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat, decontaminate, jaccard, langid, licenses, packing, quality, secrets, substrings, suffix, urls
from palimpsest.llm.components import components
from palimpsest.llm.suffix import permuted_lcp, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, shard int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, 2) for i, t, lang in rows], SCHEMA).repartition(3)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    for i in range(0, n, 3):  # near copies, with one word changed
        words = texts[i].split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    line = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts += [t + "\n" + line for t in texts[:8]] + [texts[0], texts[0], texts[1].upper(), "", " \n\t ", "one", "ONE", "two words", "the " * 3000, None, None]
    return [(i, t, "xy"[i % 2] if i % 5 else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, n=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def classes(rows, percent=90):
    sets, root = {i: shingles(t) for i, t, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_is_exact(docs, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(docs).collect()}
    assert got == classes(corpus())
    assert jaccard.jaccard_classes(empty).count() == 0
    kept = {r["doc_id"] for r in jaccard.keep_one(docs.unionByName(docs.limit(5))).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_jaccard_is_exact_below_0_9(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(150):
        words = [str(rng.randrange(10_000)) for _ in range(rng.choice([3, 5, 6, 8, 12, 20, 40, 90]))]
        for _ in range(3):
            other = [str(rng.randrange(10_000)) if rng.random() < 0.03 else w for w in words] + ["end"] * rng.randrange(2)
            rows.append((len(rows), " ".join(other), None))
    sets = [shingles(t, 5) for _, t, _ in rows]
    want = list(range(len(rows)))
    for i in want[:]:
        for j in range(i):
            if want[i] != want[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_classes(frame(spark, rows), 5, 80).collect()}
    assert got == dict(enumerate(want)) and 150 < len(set(want)) < 440


def brute_classes(sets, percent):
    want = list(range(len(sets)))
    sets = [set(x.tolist()) for x in sets]
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                old, new = want[i], want[j]
                want = [new if x == old else x for x in want]
    return want


def test_region_join_is_exact_at_every_size():
    rng = np.random.default_rng(0)
    by_window = by_pivot = cells = 0
    for trial in range(60):
        sets = []
        for _ in range(rng.integers(1, 14)):
            base = rng.choice(100_000, rng.integers(3, 80), replace=False)
            for _ in range(rng.integers(1, 12)):
                s = base.copy()
                s[: rng.integers(0, 6)] = rng.integers(100_000, 200_000)
                base = s if rng.random() < 0.3 else base
                sets.append(np.unique(s).astype(np.uint64))
        sets = [sets[k] for k in rng.permutation(len(sets))]
        percent = (90, 80)[trial % 2]
        found = jaccard.join_region(sets, percent)
        want = brute_classes(sets, percent)
        assert len(set(zip(found.root.tolist(), want))) == len(set(want)) == len(set(found.root.tolist()))
        by_pivot, by_window, cells = by_pivot + found.by_pivot, by_window + found.by_window, cells + found.cells
    assert by_pivot and by_window and cells
    two = [np.arange(20, dtype=np.uint64), np.arange(1, 21, dtype=np.uint64)]
    pair = jaccard.join_region(two, 90)
    assert pair.by_pivot == 1 and pair.one(np.arange(2))


def test_large_regions_are_taken_apart(spark, monkeypatch):
    """Regions above the block size: a star of near copies, which a pivot settles, and a chain, which cells and blocks do."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 300)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(80)]
    rows = [" ".join(base)]
    for _ in range(40):
        w = base[:]
        w[rng.randrange(80)] = word()
        rows.append(" ".join(w))
    w = [word() for _ in range(70)]
    for _ in range(50):
        w[rng.randrange(70)] = word()
        rows.append(" ".join(w))
    rng.shuffle(rows)
    rows = [(i, t, None) for i, t in enumerate(rows)]
    found, links = [], []
    inner = jaccard.split_regions

    def kept(*args):
        out = inner(*args)
        links.append(out[1].count())
        found.append(out[0].count())
        return out

    monkeypatch.setattr(jaccard, "split_regions", kept)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(frame(spark, rows)).collect()}
    assert got == classes(rows) and links[0] > 40


def test_pivots_and_windows_give_the_links_of_the_test_table(monkeypatch):
    """Regions of the test table: every link comes from a pivot or a window."""
    import os

    import pyarrow.parquet as pq

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("needs the test tables")
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).combine_chunks()
    flat, bounds = jaccard.shingles(t.column("text").combine_chunks().cast("large_string").fill_null(""), 3)
    sets = [np.unique(flat[a:b]) for a, b in zip(bounds, bounds[1:]) if b > a]
    sets = list({x.tobytes(): x for x in sets}.values())
    found = jaccard.join_region(sets, 90)
    classes = len(set(found.root.tolist()))
    assert found.by_pivot + found.by_window >= len(sets) - classes > 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(120)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("bucket", [1, 256])
def test_suffix_arrays(monkeypatch, bucket):
    """Both ways of inducing, and strings whose names repeat over several levels."""
    monkeypatch.setattr(suffix, "BUCKET", bucket)
    rng = np.random.default_rng(0)
    levels = []
    real = suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda s: levels.append(len(s)) or real(s))
    passage = rng.integers(1, 200, 300)
    s = np.concatenate([np.tile(passage, 12), rng.integers(1, 4, 2000), passage])
    t = s.tolist()
    assert suffix.suffix_array(s).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    assert len(levels) > 3 and levels == sorted(levels, reverse=True)
    for _ in range(150):
        s = rng.integers(1, rng.integers(2, 6), rng.integers(1, 50))
        t = s.tolist()
        order = suffix_array(s)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        plcp = permuted_lcp(s.astype(np.uint8), order, 9)
        for x, y in zip(order.tolist(), order.tolist()[1:]):
            k = 0
            while k < 9 and max(x, y) + k < len(t) and t[x + k] == t[y + k]:
                k += 1
            assert plcp[y] == k


def test_repeats_are_removed(docs, empty):
    seen, want = {}, {}
    for i, t, _ in corpus():
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if seen.setdefault(raw[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want[i] = (len(raw), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.remove_repeats(docs).collect()}
    assert got == want
    assert substrings.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("size", [1 << 30, 200])
def test_repeats_of_equal_and_null_doc_ids(spark, monkeypatch, size):
    """The result does not depend on the number of groups."""
    monkeypatch.setattr(substrings, "GROUP_BYTES", size)
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(12))
    own = [" ".join(word() for _ in range(9)) for _ in range(12)]
    rows = [(1, f"{own[k]} {passage} {own[k][::-1]}") for k in range(6)]
    rows += [(0, own[6]), (2, passage), (2, own[7] + passage), (None, "x" + passage), (None, own[8] + " " + passage), (3, own[6]), (None, own[9]), (3, own[6]), (4, "z" * 49), (5, "z" * 49)]
    first = {}
    key = lambda i: (i is None, i or 0)
    for i, text in rows:
        for k in range(len(text) - 49):
            first[text[k : k + 50]] = min(first.get(text[k : k + 50], key(i)), key(i))
    want = []
    for i, text in rows:
        gone = bytearray(len(text))
        for k in range(len(text) - 49):
            if first[text[k : k + 50]] < key(i):
                gone[k : k + 50] = b"\1" * 50
        want.append((i, len(text), sum(gone), hashlib.sha256("".join(c for c, g in zip(text, gone) if not g).encode()).hexdigest()))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(frame(spark, [(i, x, None) for i, x in rows])).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def base_rules(t):
    w = WORD.findall(t or "")
    tri = list(zip(w, w[1:], w[2:]))
    n = collections.Counter(tri)
    twice = {k + j for k, x in enumerate(tri) if n[x] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(twice)


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)] + [(None, 1, 0), (0, None, None)], "doc_id long, quality int, toxic int")
    counting, checking = quality.trusted_ids(labels)
    ratio = quality.fit(docs, counting)
    least = quality.threshold(docs, ratio, checking)
    got = {r["doc_id"]: r for r in quality.rate(docs, ratio, least).collect()}
    for i, t, _ in corpus():
        r = got[i]
        n, *_, repeat = want = base_rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= least)
    # Score, threshold and verdict of every text from plain counts of hashed words and pairs.
    from palimpsest.llm.words import combine, hash_ranges

    def buckets(t):
        w = [re.sub(b"[A-Z]", lambda m: m[0].lower(), x.encode()) for x in WORD.findall(t or "")]
        h = [hash_ranges(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)])) for x in w]
        return [int(x[0] % quality.BUCKETS) for x in h + [combine(a, b) for a, b in zip(h, h[1:])]]

    own = {i: buckets(t) for i, t, _ in corpus()}
    raw, target = collections.Counter(), collections.Counter()
    for i, b in own.items():
        raw.update(b)
        if i in counting:
            target.update(b)
    share = lambda c, b: c[b] / c.total() + quality.SMOOTHING / quality.BUCKETS
    score = {i: sum(np.log(share(target, x) / share(raw, x)) for x in b) / max(len(b), 1) for i, b in own.items()}
    assert set(counting) | set(checking) == {i for i in range(40) if i % 3} and not set(counting) & set(checking)
    assert all(abs(got[i]["score"] - score[i]) < 1e-9 for i in score)
    trusted = sorted(score[i] for i in checking if base_rules(corpus()[i][1])[0] >= quality.MIN_WORDS)
    assert abs(least - (trusted[int(quality.TRUSTED_LOSS * len(trusted))] - quality.MARGIN)) < 1e-9
    assert len({r["kept"] for r in got.values() if not r["base_failed"]}) == 2
    twice = quality.rate(frame(spark, [(5, corpus()[5][1], None)] * 2 + [(None, corpus()[5][1], None)]), ratio, least).collect()
    assert [r["score"] for r in twice] == [got[5]["score"]] * 3
    no = quality.trusted_ids(labels.limit(0))[0]
    assert not quality.fit(docs, no).any() and quality.rate(empty, ratio, least).count() == 0


def test_quality_counts_every_trusted_document(spark, tmp_path):
    """The documents are those of the last 300 hashes of 30,000 trusted ids."""
    from palimpsest.llm.words import combine, hash_ranges

    labels = spark.range(30_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    last = sorted((r["h"], r["doc_id"]) for r in labels.select("doc_id", F.xxhash64("doc_id").alias("h")).collect())[-300:]
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    good, bad = [word() for _ in range(200)], [word() for _ in range(200)]
    texts = {i: " ".join(rng.choice(good) for _ in range(60)) for _, i in last} | {-1 - k: " ".join(rng.choice(bad) for _ in range(60)) for k in range(100)}
    rows = [*texts.items(), (None, texts[-1])]
    frame(spark, [(i, t, None) for i, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    def buckets(t):
        h = [hash_ranges(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)])) for x in t.encode().split()]
        return [int(x[0] % quality.BUCKETS) for x in h + [combine(a, b) for a, b in zip(h, h[1:])]]

    own = {i: buckets(t) for i, t in texts.items()}
    raw, target = collections.Counter(own[-1]), collections.Counter()
    for b in own.values():
        raw.update(b)
    for h, i in last:
        if h % 2 == 0:
            target.update(own[i])
    share = lambda c, n, b: c[b] / n + quality.SMOOTHING / quality.BUCKETS
    n_raw, n_target = raw.total(), target.total()
    score = {i: sum(np.log(share(target, n_target, x) / share(raw, n_raw, x)) for x in b) / len(b) for i, b in own.items()}
    checked = sorted(score[i] for h, i in last if h % 2)
    least = checked[int(quality.TRUSTED_LOSS * len(checked))] - quality.MARGIN
    got = {r["doc_id"]: r for r in quality.op2_quality_llr(spark, str(tmp_path)).collect()}
    assert all(abs(got[i]["score"] - score[i]) < 1e-9 for i in score) and got[None]["score"] == got[-1]["score"]
    assert {i for i, r in got.items() if r["kept"]} == {i for i in score if not got[i]["base_failed"] and score[i] >= least}
    assert not any(got[i]["kept"] for i in range(-100, 0)) and sum(r["kept"] for r in got.values()) > 200


def test_quality_threshold_is_an_exact_quantile(spark):
    rng = random.Random(4)
    for values in ([1.5], [2.0] * 40, [0.0] * 30 + [1e-300, -1e9, 3.0], [rng.gauss(0, 1) for _ in range(500)] + [-1.0] * 100):
        scores = spark.createDataFrame([(v,) for v in values], "score double").persist()
        for part in (0.0, 0.002, 0.3, 0.97):
            assert quality._quantile(scores, part) == sorted(values)[int(part * len(values))]
    assert quality._quantile(scores.limit(0), 0.5) is None


def test_language(spark, empty):
    rng = random.Random(1)
    words = {"x": ["alpha", "beta", "gamma", "delta", "omega"], "y": ["uno", "dos", "tres", "cuatro", "cinco"]}
    rows = [(i, " ".join(rng.choice(words[k]) + rng.choice("ab") for _ in range(40)), k) for i in range(80) for k in ["xy"[i % 2]]]
    train, test = frame(spark, rows[:60]), frame(spark, [*rows[60:], (100, None, None), (101, "12 34 !", None), (102, "", "x")])
    model = langid.learn(train)
    got = {r["doc_id"]: r for r in langid.identify(test, model).collect()}
    assert all(got[i]["lang_pred"] == k and 0 <= got[i]["score"] <= 1 for i, _, k in rows[60:])
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and all(got[i]["rejected"] for i in (100, 101, 102))
    kept = langid.keep_identified(test, model)
    assert kept.columns == test.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["rejected"]}
    # Long, mixed and repetitive texts, ties, repeated rows.
    word = {k: [t for _, t, lang in rows[60:] if lang == k] for k in "xy"}
    odd = [(0, " ".join(word["x"] * 200), "y"), (1, " ".join(word["x"] * 3 + word["y"]), None), (2, "uno dosa " * 20_000, "x"), (3, "zzzz", None), (4, word["y"][0], "x"), (4, word["y"][0], "x")]
    odd = langid.identify(frame(spark, odd), model).collect()
    assert sorted((r["doc_id"], r["lang_pred"]) for r in odd if r["doc_id"] != 3) == [(0, "x"), (1, "x"), (2, "y"), (4, "y"), (4, "y")]
    assert [(r["score"], r["rejected"]) for r in langid.identify(frame(spark, [(0, word["x"][0], None)]), {"a": model["x"], "b": model["x"]}).collect()] == [(0.0, True)]
    assert langid.learn(empty) == {} and langid.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(test, {}).collect()} == {"und"}


def test_language_of_held_out_documents(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("needs the test tables")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred != 'und'")
    right, n = found.selectExpr("sum(int(lang = lang_pred))", "count(*)").first()
    assert n > 200 and right >= 0.95 * n


def test_packing_round_trip(docs, empty, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SHARD_TOKENS", 2000)
    coder = Tokenizer.from_file(packing.default_tokenizer())
    rows = [r.asDict() for r in packing.pack(docs, window=256).collect()]
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t, _ in corpus():
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == own[0]["sequence_tokens"] <= 256 and own[0]["padded_to"] in (at, 256)
    assert sum(1 for own in by_sequence.values() if own[0]["sequence_tokens"] < 256) <= len({k >> 32 for k in by_sequence})
    assert packing.pack(empty).count() == 0


def test_packing_copies_meet_in_any_number_of_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 500)
    texts = [" ".join(f"{chr(97 + (i * 7 + j * (i + 3)) % 26)}{chr(97 + (i + j * j) % 26)}" for j in range(30)) for i in range(60)]
    rows = [(2 * i + k, t) for i, t in enumerate(texts) for k in (0, 1)]
    made = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), window=128).collect()
    shards: dict[int, set] = {}
    for r in made:
        shards.setdefault(r["doc_id"], set()).add(r["sequence_id"] >> 32)
    assert len(set.union(*shards.values())) > 8
    together = sum(bool(shards[2 * i] & shards[2 * i + 1]) for i in range(60))
    assert together >= 45  # apart only where a shard ends between the two


def test_packing_takes_neighbours():
    held = np.ones(packing.VOCABULARY, np.int64)
    docs = [np.array([10 + k % 2 * 50 + j for j in range(20)] + [2], np.uint16) for k in range(8)]
    pieces = packing.pack_shard(docs, held, 8, 21.0, 84)
    first = [i for i, _, _, s, _ in pieces if s == 0]
    assert len({i % 2 for i in first}) == 1  # a window of like documents


def test_packing_queries_with_all_ids():
    rng = np.random.default_rng(2)
    long = np.arange(100, 300)  # the seed: 24 rare ids, 176 others
    docs = [long, np.concatenate([long[:12], np.arange(1000, 1188)]), np.concatenate([long[24:], np.arange(2000, 2020)])]
    docs = [np.append(d, 2).astype(np.uint16) for d in docs + [rng.integers(3000, 3100, 150) for _ in range(40)]]
    held = np.full(packing.VOCABULARY, 20, np.int64)
    held[100:124] = 5
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    index = packing._Index(docs, held, 1000, mean)
    counts = [collections.Counter(d.tolist()) for d in docs]
    for seed in (0, 5):
        want = []
        for d, own in zip(docs, counts):
            shared = [t for t in counts[seed] if t in own]
            want.append(sum(np.log1p((1000 - held[t] + 0.5) / (held[t] + 0.5)) * own[t] * (packing.K1 + 1) / (own[t] + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) for t in shared))
        assert np.allclose(index.scores(seed, n), want)
    assert index.rows and [i for i, *_ in packing.pack_shard(docs, held, 1000, mean, 402)][:2] == [0, 2]


ITEM = "Tom bought 5 apples for Anna. How many apples does Anna have after 3 days, if Tom eats 2 apples a day?"


def test_decontamination(spark, empty):
    bench = spark.createDataFrame([(1, ITEM, 0), (2, None, 0), (3, "too short", 0), (4, "", 0), (5, ITEM, 0)], "item_id long, text string, doc_id int")
    rows = [
        (0, "Say. " + ITEM + " End.", None),
        (1, "So Tom bought 7 apples for Mary. How many apples does Mary have after 4 days, if Tom eats 9 apples a day? x", None),
        (2, "Tom bought 7 apples for Mary. How many apples does Jim have after 7 days, if Tom eats 7 apples a day?", None),
        (3, ITEM.upper().replace("?", ""), None),
        (4, "Nothing of this kind is in here at all, for 5 apples.", None),
        (5, None, None),
        (6, "", None),
        (7, "x " * 5000 + ITEM.lower(), None),
    ]
    d = frame(spark, rows)
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontaminate.find_contamination(d, bench).collect()}
    assert {k for k in got if k[0] in (0, 1, 7)} == {(i, j) for i in (0, 1, 7) for j in (1, 5)} and not {k for k in got if k[0] in (2, 4, 5, 6)}
    assert got[0, 1] is False and got[1, 1] is True and got[7, 1] is False and (3, 1) in got
    kept = decontaminate.drop_contaminated(d, bench)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, *_ in rows} - {i for i, _ in got}
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(d, bench.limit(0)).count() == 0


def test_decontamination_of_names_that_begin_sentences(spark):
    item = "Tom has 5 apples. Anna has 3 apples. How many apples do Tom and Anna have together?"
    only = "Tom has 5 red apples in a box. Anna takes 3 apples out of the box. How many apples are in the box?"
    bench = spark.createDataFrame([(1, item), (2, only)], "item_id long, text string")
    texts = [
        item.replace("Tom", "Mary").replace("Anna", "Jane").replace("5", "8").replace("3", "6"),
        "Read this. " + only.replace("Tom", "Mary").replace("Anna", "Jane").replace("5", "8"),
        item,
        "Mary has 5 apples. Jane has 3 apples. How many apples do Kate and Paul have together?",
        "Jane has 5 pears. How many days has a week? Mary and Jane have 3 of them.",
    ]
    found = decontaminate.find_contamination(frame(spark, [(i, t, None) for i, t in enumerate(texts)]), bench)
    assert {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in found.collect()} == {(0, 1): True, (1, 2): True, (2, 1): False}


def test_decontamination_of_short_and_numeric_items(spark):
    items = ["12 34 56 78 90 11 22 33", "Compute 12 15 + 17 19 with 21 22 now", "ab cd ef", "go", ITEM]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, "Null ids are found as all the others are."), (4, ITEM)], "item_id long, text string")
    rows = [(i, f"so {t} and so on", None) for i, t in enumerate(items)]
    rows += [
        (10, "12 34 56 78 99 11 22 33", None),
        (11, "Compute 12 15 + 17 18 with 21 23 now", None),
        (12, "ab cd eg", None),
        (13, "GO!", None),
        (14, "Here null ids are found as all the others are.", None),
        # One value for several of the item, with and without a word in between.
        (15, "Tom bought 7 apples for Mary. How many apples does Jim have after 7 days, if Tom eats 7 apples a day?", None),
        (16, "Tom bought 7 apples for Mary. And how many apples does Jim have after 7 days, if Tom eats 7 apples a day?", None),
        (17, "Tom bought 7 apples for Mary. And how many apples does Mary have after 4 days, if Tom eats 9 apples a day?", None),
        # The two halves far from each other.
        (18, "Tom bought 5 apples for Anna. How many apples " + "x y z " * 50 + "does Anna have after 3 days, if Tom eats 2 apples a day?", None),
        (19, ITEM, None),
        (19, ITEM, None),
        (19, "another text", None),
        (None, ITEM, None),
    ]
    d = frame(spark, rows)
    got = sorted(((str(r["doc_id"]), str(r["item_id"]), r["reparameterised"]) for r in decontaminate.find_contamination(d, bench).collect()))
    want = [("0", "0", False), ("1", "1", False), ("2", "2", False), ("4", "4", False), ("13", "3", False), ("14", "None", False), ("17", "4", True), ("19", "4", False), ("19", "4", False), ("None", "4", False)]
    assert got == sorted(want)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in decontaminate.drop_contaminated(d, bench).collect())
    bad = {i for i, *_ in want} - {"19", "None"}
    assert kept == sorted((str(i), t) for i, t, _ in rows if str(i) not in bad and t != ITEM)


def brute_tokens(text, names, heads):
    """Templates in plain Python, for ASCII texts: (kind, word, begins a sentence)."""
    out = []
    for m in re.finditer(r"[0-9](?:[0-9]|[.,](?=[0-9]))*(?=[A-Za-z])|(?:[0-9A-Za-z]|(?<=[0-9])[.,](?=[0-9]))+", text):
        w, before = m[0], text[out[-1][3] if out else 0 : m.start()]
        head = not out or any(c in ".!?:\n" for c in before)
        kind = 0
        if w[0].isdigit():
            kind = 1
        elif out and out[-1][0] == 1 and w.lower() in decontaminate.UNITS:
            kind = 2
        elif w[0].isupper() and names and (heads or not head):
            kind = 3
        if kind == 3 and out and out[-1][0] == 3 and not head:
            out[-1] = (3, text[out[-1][4] : m.end()].lower(), out[-1][2], m.end(), out[-1][4])
        else:
            out.append((kind, w.lower(), head, m.end(), m.start()))
    return [x[:3] for x in out]


def brute_found(text, item):
    """Whether an item is in a text, by all pairs of windows."""
    n = decontaminate.WORDS
    for form in decontaminate.FORMS:
        d, b = brute_tokens(text, *form), brute_tokens(item, *form)
        if len(b) < n:
            continue
        hits = []
        for i in range(len(b) - n + 1):
            for j in range(len(d) - n + 1):
                x, y = b[i : i + n], d[j : j + n]
                generic = sum(k == 0 for k, *_ in x) < decontaminate.MIN_LITERAL
                if [(k, w if generic or not k else "") for k, w, _ in x] == [(k, w if generic or not k else "") for k, w, _ in y]:
                    hits.append((j - i, i, n, [decontaminate._pair((0, p[0] | 4 * p[2], p[1].encode()), (0, q[0] | 4 * q[2], q[1].encode())) for p, q in zip(x, y) if p[0]]))
        if decontaminate.best_occurrence(hits, len(b)):
            return True
    return False


def test_decontamination_against_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = "the a of box apple red how many takes out day has left in is boy".split()
    names = ["Tom", "Anna", "Jim", "Eve"]

    def sentence(k):
        return " ".join(rng.choice([*rng.choices(vocabulary, k=8), rng.choice(names), str(rng.randint(1, 99)), f"{rng.randint(1, 9)} kg"]) for _ in range(k)) + rng.choice(".?")

    items = [" ".join(sentence(rng.randint(6, 12)) for _ in range(rng.randint(1, 3))) for _ in range(25)]

    def changed(t):
        who = dict(zip(names, rng.sample(names, 4)))
        t = re.sub("|".join(names), lambda m: who[m[0]] if rng.random() < 0.97 else "Zoe", t)
        t = re.sub("[0-9]+", lambda m: str(int(m[0]) + 7) if rng.random() < 0.9 else m[0], t)
        return t if rng.random() < 0.5 else t.replace(" ", " well ", 1)

    texts = [sentence(20) + " " + changed(rng.choice(items)) + " " + sentence(9) for _ in range(60)] + [sentence(40) for _ in range(30)] + items[:5]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(frame(spark, [(i, t, None) for i, t in enumerate(texts)]), bench).collect()}
    want = {(i, j) for i, t in enumerate(texts) for j, b in enumerate(items) if brute_found(t, b)}
    assert got == want and 20 < len({i for i, _ in got}) < 90


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2, "big")) + body


KEY = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + b"\5\0") + der(4, bytes(range(200))))
SSH = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(32)))
JWT = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": 1})) + ".c2ln"


def test_secrets(spark, empty):
    b64 = lambda x: base64.b64encode(x).decode()
    pem = f"-----BEGIN PRIVATE KEY-----\n{b64(KEY)}\n-----END PRIVATE KEY-----"
    texts = [
        "é password: abcdefghijkl Api_Key='0123456789abcdef' secret=short",
        "AKIA" + "A" * 14 + " AKIA123 deadbeefdeadbeef",
        "password: secret: abcdefghijklmnop",
        "paſſword=abcdefghijklmnop",
        JWT + " and " + JWT[5:],
        pem,
        pem.replace("\nMI", "\nMA", 1),
        "ssh " + b64(SSH) + " " + b64(SSH[:-1]),
        b64(KEY) + " " + KEY.hex().upper(),
        None,
        "",
        "a" * 50000 + " AKIA" * 2000,
    ]
    d = frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan_secrets(d).collect()}
    assert got[0] == [("assign", 2, 24), ("assign", 25, 50), ("hex", 34, 50)]
    assert [k for k, *_ in got[1]] == ["access", "hex"] and got[1][0] == ("access", 0, 18)
    assert got[2] == [] and got[3] == []
    assert [k for k, *_ in got[4]] == ["jwt"]
    assert [k for k, *_ in got[5]] == ["pem"] and "pem" not in [k for k, *_ in got[6]]
    assert [k for k, *_ in got[7]] == ["ssh"]
    assert [k for k, *_ in got[8] if k != "hex"] == ["der", "der"]
    assert got[9] == got[10] == [] and [k for k, *_ in got[11]] == ["hex"]
    twice = secrets.scan_secrets(d.unionByName(d)).collect()
    assert sorted((r["doc_id"], str(r["spans"])) for r in twice) == sorted((r["doc_id"], str(r["spans"])) for r in secrets.scan_secrets(d).collect() for _ in range(2))
    clean = {r["doc_id"]: r for r in secrets.redact_secrets(d).collect()}
    assert clean[0]["text"] == "é [assign removed] [assign removed]' secret=short" and clean[0]["n_chars"] == len(clean[0]["text"])
    assert clean[2]["text"] == texts[2] and clean[9]["text"] is None
    assert secrets.scan_secrets(empty).count() == 0


def test_secrets_in_every_encoding():
    b64 = lambda x: base64.b64encode(x).decode()
    wrap = lambda x, n=64: "\n".join(x[k : k + n] for k in range(0, len(x), n))
    ec = lambda oid, n: der(0x30, der(2, b"\0") + der(0x30, oid) + der(4, der(0x30, der(2, b"\1") + der(4, bytes(range(n))))))
    p256 = ec(bytes.fromhex("06072a8648ce3d020106082a8648ce3d030107"), 32)
    k256 = ec(bytes.fromhex("06072a8648ce3d020106052b8104000a"), 32)
    ed448 = der(0x30, der(2, b"\0") + der(0x30, bytes.fromhex("06032b6571")) + der(4, der(4, bytes(57))))
    assert [b64(x)[:8] for x in (p256, k256, ed448)] == ["MEECAQAw", "MD4CAQAw", "MEcCAQAw"]
    pem = f"-----BEGIN PRIVATE KEY-----\n{wrap(b64(KEY))}\n-----END PRIVATE KEY-----\n"
    high = der(0x30, der(2, b"\0") + der(0x30, b"\5\0") + der(4, bytes(range(255, 50, -1))))  # + and / in base64
    url = base64.urlsafe_b64encode(high).decode().rstrip("=")
    assert "-" in url and "_" in url
    locked = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{}\n\n{}\n-----END RSA PRIVATE KEY-----".format("0A" * 16, wrap(b64(bytes(range(64)))))
    plain = pem.replace("-----\n", "-----\nComment: x,y-z\n\n", 1).strip()
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-rsa", b"\1\0\1", bytes(range(1, 250))))
    whole = [(x, k) for x, k in [(b64(p256), "der"), (b64(k256), "der"), (b64(ed448), "der"), (wrap(b64(KEY)), "der"), (wrap(b64(KEY)).replace("\n", "\r\n  "), "der"), (url, "der"), (wrap(url), "der"), (b64(pem.encode()), "pem"), (wrap(b64(pem.encode()), 76), "pem"), (locked, "pem"), (plain, "pem"), (pem.strip().replace("\n", "\\n"), "pem"), (wrap(b64(ssh), 70), "ssh")]]
    for x, kind in whole:
        for before, after in (("", ""), ("key: ", "\nand words"), ("'", "', x")):
            found = [(secrets.KINDS[k], s, e) for s, k, e in secrets.spans_of(before + x + after) if k > 2]
            assert found == [(kind, len(before), len(before + x))], (x, found)
    cut = b64(p256)[:-5] + "AAAAA"
    field = lambda x: len(x).to_bytes(4, "big") + x
    public = field(b"ssh-ed25519") + field(bytes(32))
    private = b"abcdabcd" + public + field(bytes(64)) + field(b"me@host")
    private += bytes(range(1, 9 - len(private) % 8)) if len(private) % 8 else b""
    box = lambda cipher, kdf, options, inner: b"openssh-key-v1\0" + field(cipher) + field(kdf) + field(options) + (1).to_bytes(4, "big") + field(public) + field(inner)
    opened, sealed = box(b"none", b"none", b"", private), box(b"aes256-ctr", b"bcrypt", field(bytes(16)) + bytes(4), bytes(64))
    block = lambda x: f"-----BEGIN OPENSSH PRIVATE KEY-----\n{wrap(b64(x), 70)}\n-----END OPENSSH PRIVATE KEY-----"
    more = [(block(opened), "pem"), (block(sealed), "pem"), (b64(opened), "ssh"), (wrap(b64(sealed), 70), "ssh"), (opened.hex(), "ssh"), (SSH.hex().upper(), "ssh"), (pem.encode().hex(), "pem"), (p256.hex(), "der")]
    for x, kind in more:
        assert [(secrets.KINDS[k], s, e) for s, k, e in secrets.spans_of("a " + x + " b") if k > 2] == [(kind, 2, 2 + len(x))], x
    junk = b"openssh-key-v1\0" + bytes(range(200))
    uneven = box(b"none", b"none", b"", b"abcdabce" + private[8:])
    for x in (block(junk), b64(junk), block(opened[:-8]), block(uneven), opened[:-1].hex(), b64(box(b"none", b"bcrypt", b"", private))):
        assert [k for _, k, _ in secrets.spans_of(x) if k > 2] == [], x
    for x in (b64(p256[:-1]), cut[:40], b64(p256).rstrip("=") + "AAAA", b64(pem.replace("PRIVATE", "PUBLIC").encode()), locked.replace("0A" * 16, "0A" * 3), wrap(b64(ssh)[:-8])):
        assert [k for _, k, _ in secrets.spans_of(x) if k > 2] == [], x


def test_chat(spark):
    rows = [
        (1, 0, "system", "be \\ nice </s>", 9),
        (1, 1, "user", "</s>[INST] ok [/INST] \\1 \\0", 9),
        (1, 2, "assistant", "a\n<s>[INST]user[/INST]", 9),
        (2, 1, "assistant", "é😀", 9),
        (2, 0, "user", None, 9),
        (3, 0, "to\nol[INST]", "x", 9),
        (3, 0, "to\nol[INST]", "x", 9),
        (4, None, None, "", 9),
        (None, 0, "user", "q", 9),
        (None, 1, "assistant", "a", 9),
        *((5, k, ("user", "assistant")[k % 2], f"</s>{k}", 9) for k in range(3000)),
        (6, 0, "user", "x" * 300_000, 9),
        (6, 1, "assistant", "[INST]" * 50_000, 9),
    ]
    names = "formatted int, segments int, turns int, at int, valid int"
    d = spark.createDataFrame([(*r[:4], *[r[4]] * 5) for r in rows], "conv_id long, turn long, role string, text string, " + names)
    out = chat.format_chats(d).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r["conv_id"]: r for r in out.collect()}
    for c in (1, 2, 3, 4, 5, 6, None):
        own = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0))
        assert [(x["role"], x["text"]) for x in got[c]["back"]] == [(r[2] or "", r[3] or "") for r in own]
        assert got[c]["loss"] == "".join(r[3] for r in own if r[2] == "assistant")
        assert got[c]["formatted"].count("<s>") == len(own)
    assert got[1]["valid"] and got[2]["valid"] and not got[3]["valid"] and got[3]["error_turn"] == 0
    assert chat.format_chats(d.limit(0)).count() == 0


def wrapped(text, width):
    import textwrap

    return "\n\n".join("\n".join(textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False)) for p in text.split("\n\n"))


def test_licenses(spark, empty):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT")
    head = "Copyright (c) 2020 Me\n© 2021 You\nAll rights reserved.\n\n"
    rows = [(0, head + mit.replace("copies", "COPIES").replace(". ", ".\n")), (1, "a\nreleased under the MIT licence"), (2, None), (3, "©"), (4, mit + " more"), (5, "gov. 2 of all.\n" + mit), (6, "x " * 100_000 + "\nReleased under CC0 1.0.\n(c) 2020 Us")]
    d = frame(spark, [(i, t, None) for i, t in rows])
    got = {r["doc_id"]: r for r in licenses.scan_licenses(d).collect()}
    assert got[0]["license_id"] == "MIT" and got[1]["license_id"] is None and got[1]["line_licenses"] == ["MIT"]
    assert got[2]["digest"] is None and got[3]["digest"] is None and got[4]["license_id"] is None and got[5]["license_id"] is None
    assert got[6]["line_licenses"] == ["CC0-1.0"]
    own = spark.createDataFrame([("Z", "A b!"), ("Y", "a  B")], "license_id string, text string")
    few = frame(spark, [(0, "a-b", None), (0, "x\na b\n", None), (None, "a b", None), (None, None, None), (1, "", None)])
    want = [("None", "Y", ["Y"]), ("None", None, []), ("0", "Y", ["Y"]), ("0", None, ["Y"]), ("1", None, [])]
    found = [(str(r["doc_id"]), r["license_id"], r["line_licenses"]) for r in licenses.scan_licenses(few, own).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert licenses.scan_licenses(empty).count() == 0 and licenses.scan_licenses(empty, own).count() == 0


def test_rows_of_one_doc_id_keep_their_own_licenses(spark):
    d = frame(spark, [(2, "Released under CC0 1.0.", None), (2, "Released under the MIT License.", None), (None, "Released under the MIT License.\nx", None), (2, "Released under CC0 1.0.", None)])
    assert sorted(str((r["doc_id"], r["line_licenses"])) for r in licenses.scan_licenses(d).collect()) == ["(2, ['CC0-1.0'])"] * 2 + ["(2, ['MIT'])", "(None, ['MIT'])"]


def test_licenses_at_every_width(spark):
    whole = [(i, t) for i, t in licenses.KNOWN if "\n" in t]
    assert len({i for i, _ in whole}) >= 7 and len({i for i, *_ in licenses.DIGESTS}) >= 10
    rows = [(k * 1000 + w, "Copyright 1999 Me\n\n" + wrapped(t, w), i) for k, (i, t) in enumerate(whole) for w in range(40, 101, 5)]
    rows += [(90_000 + k, f"{title}\n\nCopyright (c) 2001, Me.\n\n" + wrapped(t, 72), i) for k, (i, title) in enumerate(licenses.TITLES) for j, t in whole if i == j]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert got == {k: i for k, _, i in rows}


def fixed_rule(host, path):
    best = None
    for verdict, h, p in urls.FIXED_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (verdict, h + p)
    return best


def brute_rules(sets):
    """items, verdict -> (lift, confidence), from (tokens, blocked) of labelled urls, by every subset of tokens."""
    import itertools

    n, both = collections.Counter(), collections.Counter()
    for t, blocked in sets:
        for k in range(1, len(t) + 1):
            for c in itertools.combinations(sorted(t), k):
                n[c] += 1
                both[c, "block" if blocked else "allow"] += 1
    share = {v: sum(b == (v == "block") for _, b in sets) / len(sets) for v in ("block", "allow")}
    least = max(urls.MIN_SUPPORT * len(sets), urls.MIN_COUNT)
    return {(c, v): (m / n[c] / share[v], m / n[c]) for (c, v), m in both.items() if m >= least and m / n[c] / share[v] >= urls.MIN_LIFT}


def brute_verdict(rules, tokens):
    fits = [(lift, v == "allow", confidence, v) for (c, v), (lift, confidence) in rules.items() if set(c) <= set(tokens)]
    return (max(fits)[3], max(fits)[2]) if fits else ("allow", None)


def test_urls(spark):
    rng = random.Random(0)
    pages = []
    for i in range(400):
        bad = i % 2 == 0
        host = rng.choice(["M.", "www.", ""]) + ("Spam" if bad else rng.choice(["a", "b"])) + ".example." + rng.choice(["com", "net", "org", "info"])
        pages.append((i, f"http://{host}/{rng.choice(['en', 'de', 'es'])}/{rng.randint(1, 99)}" + rng.choice(["", "?q=1", "#top", ".html"])))
    pages += [(900, None), (901, ""), (902, "no scheme/en/"), (903, "https://com?x"), (904, pages[0][1]), (904, pages[1][1]), (905, "x://HOST.com/en/\n://"), (906, "http://spam.example.info/" + "long/" * 30_000), (None, pages[0][1])]
    p = spark.createDataFrame([(i, u, "x", 1) for i, u in pages], "page_id long, url string, host string, salt_ int")
    labelled = p.select("url", (F.col("page_id") % 2 == 0).alias("blocked")).where("page_id < 400")
    mined = urls.mine_rules(labelled)
    rules = {(tuple(r["items"]), r["verdict"]): (r["lift"], r["confidence"]) for r in mined.collect()}
    assert rules == brute_rules([(r["t"], r["blocked"]) for r in labelled.select(urls.tokens_of(F.col("url")).alias("t"), "blocked").collect()])
    assert {v for _, v in rules} == {"block", "allow"}
    fixed = spark.createDataFrame([(v, h, q) for v, h, q in urls.FIXED_RULES], "verdict string, host string, path string")
    got = collections.defaultdict(list)
    for r in urls.judge(p, fixed, mined).collect():
        got[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"], r["confidence"]))
    tokens = {r["url"]: r["t"] for r in p.select("url", urls.tokens_of(F.col("url")).alias("t")).collect()}
    want = collections.defaultdict(list)
    for i, u in pages:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", rest)[0])
            path = re.split("[?#]", rest[len(host) :])[0]
        best = fixed_rule(host, path)
        verdict, confidence = brute_verdict(rules, tokens[u])
        want[i].append((host, path, *((best[1], best[0]) if best else (None, verdict)), confidence))
    assert {i: sorted(v, key=str) for i, v in got.items()} == {i: sorted(v, key=str) for i, v in want.items()}
    assert [v[3] for v in got[906]] == ["block"]
    none = urls.mine_rules(labelled.limit(0))
    assert none.count() == 0 and {r["verdict"] for r in urls.judge(p, fixed.limit(0), none).collect()} == {"allow"}
    assert urls.mine_rules(labelled.where("not blocked")).count() == 0
    assert urls.judge(p.limit(0), fixed, mined).count() == 0


def test_skew_join(spark):
    from palimpsest.llm.common import skew_join

    rows = [(1, k) for k in range(3000)] + [(2, k) for k in range(5)] + [(None, 7), (3, 8)]
    side = [(1, "a"), (1, "b"), (2, "c"), (4, "d")]
    left, right = spark.createDataFrame(rows, "k int, v int"), spark.createDataFrame(side, "k int, w string")
    want = sorted(str((k, v, w)) for k, v in rows for j, w in side if j == k)
    assert sorted(str((r["k"], r["v"], r["w"])) for r in skew_join(left, right, "k", "v").collect()) == want
    want += [str((k, v, None)) for k, v in rows if k in (None, 3)]
    assert sorted(str((r["k"], r["v"], r["w"])) for r in skew_join(left, right, "k", "v", "left").collect()) == sorted(want)


def test_url_rule_of_four_tokens(spark, tmp_path):
    import itertools

    kinds = [("abcd", 1)] * 25 + [("".join(c), 0) for c in itertools.combinations("abcd", 3)] * 140 + [("xyz", k % 5 == 0) for k in range(700)]
    pages = [(i, "http://h.info/" + "/".join(k), bad) for i, (k, bad) in enumerate(kinds)] + [(9000, "http://h.info/d/c/b/a", None), (9001, "http://h.info/a/b/c", None)]
    spark.createDataFrame([p[:2] for p in pages], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, 1, int(bad)) for i, _, bad in pages if bad is not None], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    tokens = lambda url: sorted({"label=h", "label=info", *(f"dir={x}" for x in url.split("/")[3:])})
    rules = brute_rules([(tokens(url), bool(bad)) for _, url, bad in pages if bad is not None])
    four = {c for c, v in rules if v == "block" and "dir=a" in c}
    assert four and min(map(len, four)) == 4
    got = {r["page_id"]: (r["verdict"], r["confidence"]) for r in urls.op7_url_rules(spark, str(tmp_path)).collect()}
    assert got == {i: brute_verdict(rules, tokens(url)) for i, url, _ in pages}
    assert {i for i, (v, _) in got.items() if v == "block" and i < 585} == set(range(25)) and got[9000][0] == "block" and got[9001][0] == "allow"
