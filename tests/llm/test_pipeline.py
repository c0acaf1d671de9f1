"""The pipeline, stage by stage, on a small corpus with planted cases."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(5)
    words = {"x": ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(300)], "y": ["".join(rng.choice("uvwxyz") for _ in range(5)) for _ in range(300)]}
    texts = [(i, " ".join(rng.choice(words["xy"[i % 2]]) for _ in range(120)), "xy"[i % 2]) for i in range(60)]
    item = " ".join(rng.choice(words["x"]) for _ in range(25))
    texts += [
        (100, texts[0][1], "x"),
        (101, texts[1][1].replace(" ", "  ", 3) + " more", "y"),
        (102, texts[2][1] + " " + item, "x"),
        (103, " ".join(rng.choice(words["y"]) for _ in range(120)) + " password=abcdefghijklmnop", "y"),
        (104, "123 456", None),
        (105, None, None),
    ]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        if name == "secret scans":
            assert "[assign removed]" in docs.where("doc_id = 103").first()["text"]
    clean = set(range(60))
    assert seen[0] == clean | {100, 101, 102, 103}
    assert seen[1] == clean | {102, 103} and seen[2] == clean | {103} == seen[3] == seen[4]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen[4]


def test_near_copies_of_similarity_0_8_go(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    one, two, three = ([word() for _ in range(100)] for _ in range(3))
    edited = [*one[:30], word(), *one[31:70], word(), *one[71:]]  # 5-word similarity 0.81, 3-word 0.88
    longer = two + [word() for _ in range(20)]  # 0.83
    apart = three + [word() for _ in range(30)]  # 0.76
    rows = [(i, " ".join(t), "x") for i, t in enumerate([one, two, three, edited, longer, apart])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {0, 1, 2, 5}
