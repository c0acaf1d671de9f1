import datetime as dt
import random

import pytest

from palimpsest.operators import blame, graph
from palimpsest.operators.selectors import WikiTables
from palimpsest.plans.session import WikiSession
from palimpsest.plans.storage import written
from palimpsest.sinks import files
from palimpsest.streaming import trending


@pytest.fixture(scope="module")
def session(spark):
    t = WikiTables(
        page=spark.createDataFrame([(1, 0, "A_2", False), (2, 0, "B_1", False), (3, 1, "A_2", False), (4, 14, "Top", False)], "page_id long, ns int, title string, is_redirect boolean"),
        category=spark.createDataFrame([("t", "Top"), ("s", "Sub")], "cat_id string, title string"),
        subcat=spark.createDataFrame([("t", "s"), ("s", "t")], "parent string, child string"),
        catarticle=spark.createDataFrame([("t", 1), ("s", 1), ("s", 3)], "category string, page long"),
        templatelink=spark.createDataFrame([(1, "Stub")], "page_id long, template string"),
        pagelink=spark.createDataFrame([(1, 2), (3, 2), (2, 99)], "src long, dst long"),
        extlink=spark.createDataFrame([(2, "http://x")], "page_id long, url string"),
    )
    views = spark.createDataFrame([("en", 1, 3), ("en", 2, 9), ("de", 1, 50)], "project string, page_id long, views long")
    return WikiSession(spark, t, views)


def test_commands(session):
    do = session.command
    with pytest.raises(ValueError):
        do("* ns 0")
    assert do("= ns main") == 2
    assert do("set x") == "x"
    assert do("+ category top") == 3  # the cycle of categories ends
    assert do("? duplicates top") == 1
    assert do("? catre ^S") == 2
    assert do("- template stub") == 2
    assert do("* pagelink 2") == 1
    assert do("? pagelink 99") == 1  # a missing page can be a target
    assert do("? pagelink B 1") == 2
    for line in ("? pagelink Nowhere", "? category Nowhere", "? template Nowhere", "? ns nowhere", "page Nowhere"):
        with pytest.raises(ValueError, match="no such"):
            do(line)
    assert do("page A 2") == ["Sub", "Top"] and do("page B 1") == ["(uncategorized)"]
    assert do("category top") == {"above": ["Sub"], "below": ["Sub"], "pages": 1}
    assert do("wantedarticles") == [(99, 1)] and do("wantedarticles 1") == [(99, 1)]
    assert do("cycles") == [(2, ["s", "t"])]
    assert do("furthestfrom B 1") == [(1, 1), (1, 3)] and do("longestpaths") == [(2, [1, 2, 99]), (2, [3, 2, 99])]
    assert do("~ extlink http") == 1
    assert do("get x") and do("count") == 2  # a snapshot
    assert do("sort [0-9]+") and do("list") == ["B_1", "A_2"]
    assert do("transform _([0-9]) -${1}") and do("list 1") == ["B-1"]
    assert do("popular 0 en") == [(2, 9), (1, 3)]
    assert do("vars") == ["x"] and do("unset x") and do("vars") == []
    assert do("sort [") is None and "quit" in do("help") and do("quit") is None
    with pytest.raises(ValueError):
        do("jump")


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src long, dst long")
    assert {r["node"] for r in graph.cycle_members(e).collect()} == {1, 2, 3, 5}
    assert {r["node"] for r in graph.cycle_members(e, spark.createDataFrame([(1,)], "node long")).collect()} == {1, 2, 3}
    assert {(r["start"], tuple(r["nodes"])) for r in graph.cycles(e).collect()} == {(1, (1, 2, 3)), (5, (5,))}
    none = spark.createDataFrame([], "page_id long")
    paths = graph.paths_to(4, e, none).collect()
    assert [(r["dist"], r["path"]) for r in paths] == [(3, [1, 2, 3, 4])]
    assert {(r["src"], r["dst"], r["dist"]) for r in graph.longest_shortest_paths(e, none).collect()} == {(1, 4, 3)}
    with pytest.raises(ValueError):
        graph.longest_shortest_paths(e, none, max_nodes=2)
    assert graph.longest_shortest_paths(e.limit(0), none).count() == 0


def test_blame_sinks(spark, tmp_path):
    h = spark.createDataFrame([(1, 1, "ann", "a\nb\n"), (1, 2, "bob", "a\n<x>\nb\n")], "page_id long, rev_seq long, contributor string, text string")
    lines = blame.blame(h)
    assert [(r["line"], r["contributor"]) for r in lines.orderBy("line_no").collect()] == [("a\n", "ann"), ("<x>\n", "bob"), ("b\n", "ann")]
    assert [(r["contributor"], r["lines"], r["place"]) for r in blame.contributors(lines).orderBy("place").collect()] == [("ann", 2, 1), ("bob", 1, 2)]
    assert "&lt;x&gt;" in blame.blame_html(lines, 1)
    files.write_blame(lines, str(tmp_path / "b"))
    files.write_blame_html(lines, 1, str(tmp_path / "h"))
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "b").glob("part-*")) == 3
    files.write_wanted(spark.createDataFrame([(7, 2)], "dst long, wanted_by long"), str(tmp_path / "w"))
    assert "2;7" in "".join(p.read_text() for p in (tmp_path / "w").glob("part-*"))


def test_blame_file_folds_once(spark, tmp_path):
    """The lines are made once, though their ranges are found before they are written."""
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            made.add(len(f))
            yield f

    lines = blame.blame(spark.createDataFrame([(k % 5, k, "ann", f"{k}\n") for k in range(20)], "page_id long, rev_seq long, contributor string, text string"))
    files.write_blame(lines.mapInPandas(counted, lines.schema), str(tmp_path / "b"))
    rows = [x for p in sorted((tmp_path / "b").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x.split("\t")[-1] for x in rows] == ["15", "16", "17", "18", "19"] and made.value == 5


@pytest.mark.parametrize("paths", [0, 1_000_000])
def test_cycle_members(spark, monkeypatch, paths):
    """By paths and by colours, against reachability, on a graph with several components that touch."""
    monkeypatch.setattr(graph, "PATHS", paths)
    rng = random.Random(3)
    pairs = {(rng.randrange(24), rng.randrange(24)) for _ in range(26)} | {(30, 31), (31, 30), (31, 40), (40, 41), (41, 40)}
    reach = set(pairs)
    while more := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
        reach |= more
    found = [r["node"] for r in graph.cycle_members(spark.createDataFrame(sorted(pairs), "src long, dst long")).collect()]
    assert sorted(found) == sorted(a for a, b in reach if a == b)


def test_long_cycle(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROUNDS", 2)
    e = spark.createDataFrame([(k, (k + 1) % 7) for k in range(7)] + [(3, 10), (10, 11)], "src long, dst long")
    assert [(r["length"], r["nodes"]) for r in graph.cycles(e).collect()] == [(7, list(range(7)))]
    assert graph.cycles(e, max_length=6).count() == 0
    none = spark.createDataFrame([], "page_id long")
    assert {r["node"]: r["dist"] for r in graph.distances_to(11, e, none).collect()} == {11: 0, 10: 1, 3: 2, 2: 3, 1: 4, 0: 5, 6: 6, 5: 7, 4: 8}


@pytest.mark.parametrize("paths", [0, 1_000_000])
def test_rounds_stay_off_the_driver(spark, monkeypatch, paths):
    """No round gathers rows of the graph in the driver, as a broadcast would."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(graph, "written", seen)
    monkeypatch.setattr(graph, "PATHS", paths)
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 9), (5, 9)], "src long, dst long")
    pages = spark.createDataFrame([(4,)], "page_id long")
    assert {(r["node"], r["dist"], tuple(r["path"])) for r in graph.paths_to(9, e, pages).collect()} == {(1, 3, (1, 2, 3, 4, 9))}
    assert [r["nodes"] for r in graph.cycles(e).collect()] == [[1, 2, 3]]
    assert {r["node"] for r in graph.cycle_members(e, spark.createDataFrame([(2,)], "node long")).collect()} == {1, 2, 3}
    assert sum("Join" in p for p in plans) > 10 and not [p for p in plans if "Broadcast" in p]


def test_paths_over_redirects(spark):
    """Furthest nodes and their paths where some links cost nothing, against plain relaxation."""
    rng = random.Random(8)
    pairs = sorted({(k, rng.randrange(max(0, k - 4), k)) for k in range(1, 30)} | {(rng.randrange(30), rng.randrange(30)) for _ in range(6)})
    free = {k for k in range(30) if k % 3 == 0}
    best = {0: 0}
    for _ in range(30):
        for a, b in pairs:
            if b in best:
                best[a] = min(best.get(a, 99), best[b] + (a not in free))
    most = max(best.values())
    found = graph.paths_to(0, spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(k,) for k in sorted(free)], "page_id long")).collect()
    assert {(r["node"], r["dist"]) for r in found} == {(k, most) for k, d in best.items() if d == most} and most > 3
    for r in found:
        path = r["path"]
        assert path[0] == r["node"] and path[-1] == 0 and set(zip(path, path[1:])) <= set(pairs)
        assert sum(k not in free for k in path[:-1]) == most


def test_streaming(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trending, "EVERY", 1)
    (tmp_path / "in").mkdir()
    row = '{{"project":"en","title":"{}","ts":"{}","views":{}}}\n'
    (tmp_path / "in" / "1.json").write_text(row.format("A", "2024-01-01T10:00:00Z", 2) + row.format("A", "2024-01-01T11:00:00Z", 3))

    def run():
        trending.maintain(trending.read_views(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
        return {(r["title"], r["day"]): r["views"] for r in trending.current(spark, str(tmp_path / "out")).collect()}

    day = dt.date(2024, 1, 1)
    assert run() == {("A", day): 5}
    (tmp_path / "in" / "2.json").write_text(row.format("A", "2024-01-01T12:00:00Z", 4) + row.format("B", "2024-01-02T12:00:00Z", 1))
    assert run() == {("A", day): 9, ("B", dt.date(2024, 1, 2)): 1}
    (tmp_path / "in" / "3.json").write_text(row.format("B", "2024-01-02T13:00:00Z", 2))
    assert run() == {("A", day): 9, ("B", dt.date(2024, 1, 2)): 3}
    folders = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert "batch=0" not in folders and len([x for x in folders if x.startswith("upto=")]) == 2
