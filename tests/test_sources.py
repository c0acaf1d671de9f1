import datetime as dt
import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text, titles
from palimpsest.operators import links, trending
from palimpsest.operators.userstats import user_edit_stats
from palimpsest.sinks import files
from palimpsest.sources import jdbc, plain, resolve, sevenzip, sqldump, xmldump

XML = """<mediawiki><siteinfo><sitename>W</sitename><base>b</base><dbname>d</dbname><generator>g</generator><case>first-letter</case>
<namespaces><namespace key="0"></namespace><namespace key="1">Talk</namespace><namespace key="14">Category</namespace></namespaces></siteinfo>
<page><title>Talk:One</title><ns>1</ns><id>7</id>
<revision><id>1</id><timestamp>2024-01-01T00:00:00Z</timestamp><contributor><username>Ann</username><id>5</id></contributor><comment>hi</comment><text>a</text></revision>
<revision><id>2</id><parentid>1</parentid><timestamp>2024-01-01T00:20:00Z</timestamp><minor/><contributor><username>Anna</username><id>5</id></contributor><text>ab\U0001f600</text></revision>
<revision><id>3</id><parentid>2</parentid><timestamp>2024-01-01T00:40:01Z</timestamp><contributor><username>Ann</username><id>5</id></contributor><text>abc</text></revision>
<revision><id>4</id><timestamp>2024-01-02T00:00:00Z</timestamp><contributor><ip>1.2.3.4</ip></contributor><text>abc</text></revision>
<revision><id>5</id><timestamp>2024-01-02T00:01:00Z</timestamp><contributor><ip>1.2.3.4</ip></contributor><text>abc</text></revision>
<revision><id>6</id><timestamp>2024-01-03T00:00:00Z</timestamp><contributor deleted="deleted"/><text>x</text></revision></page>
<page><title>2001: A title</title><ns>0</ns><id>8</id><redirect title="x"/>
<revision><id>9</id><timestamp>2024-01-03T00:00:00Z</timestamp><contributor><ip>1.2.3.4</ip></contributor><text>y</text></revision></page></mediawiki>"""


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("xml") / "dump.xml"
    p.write_text(XML)
    site = xmldump.read_namespaces(spark, str(p))
    assert site == {0: "", 1: "Talk", 14: "Category"}
    return xmldump.read_history(spark, str(p), site)


def test_history(history):
    rows = sorted(history.collect(), key=lambda r: r["rev_id"])
    assert [r["contributor"] for r in rows] == ["id:5"] * 3 + ["ip:1.2.3.4"] * 2 + ["ip:#deleted#", "ip:1.2.3.4"]
    assert [r["ns"] for r in rows] == [1] * 6 + [0]
    assert rows[-1]["title"] == " A title" and rows[-1]["is_redirect"]  # an integer that is no namespace: Main, prefix dropped
    assert [r["minor"] for r in rows[:3]] == [False, True, False]
    assert rows[0]["parent_id"] == 0 and rows[1]["comment"] == ""


def test_user_stats(spark, history, tmp_path):
    names = xmldump.display_names(history)
    assert {r["contributor"]: r["name"] for r in names.collect()}["id:5"] == "Ann"
    bots = spark.createDataFrame([("id:5",)], "name string")
    stats = user_edit_stats(history, dt.datetime(2024, 1, 31), bots=bots, namespaces=[0, 1, 14])
    rows = {(r["contributor"], r["group_name"]): r for r in stats.collect()}
    ann = rows["id:5", "talk"]
    # Equality with the limit continues a span, one second more ends it.
    assert (ann["revisions"], ann["edits"], ann["minors"], ann["dsize"], ann["new_pages"], ann["is_bot"]) == (3, 2, 1, 3, 1, True)
    ip = rows["ip:1.2.3.4", "total"]
    assert (ip["revisions"], ip["edits"], ip["new_pages"], ip["recent_edits"]) == (2, 2, 1, 2)  # one null edit
    assert rows["ip:#deleted#", "main"]["revisions"] == 0 and rows["ip:#deleted#", "main"]["first_edit"] is None
    files.write_user_stats(stats, names, str(tmp_path / "stats"))
    out = "".join(p.read_text() for p in (tmp_path / "stats").glob("part-*"))
    assert "<userstats>" in out and 'name="Ann"' in out and "<averagespan>1.50000</averagespan>" in out and files.NEVER in out


def test_incomplete_page_raises(spark, tmp_path):
    p = tmp_path / "bad.xml"
    p.write_text("<mediawiki><page><title>T</title><id>1</id><revision><id>1</id><contributor><ip>1</ip></contributor><text>x</text></revision></page></mediawiki>")
    with pytest.raises(Exception, match="incomplete revision"):
        xmldump.read_history(spark, str(p)).collect()


DUMP = "-- head\n/*!40000 ALTER TABLE `t` DISABLE KEYS */;\nINSERT INTO `t` (a,b) VALUES (1,'a\\'b',NULL,-1.5e3),(2,'x),(y;','q\\\\','it''s\r');\nINSERT INTO `t` VALUES (3,'\\n','',0);\n\n/*!40000 */\n"


@pytest.mark.parametrize("packed", [False, True])
def test_dump(spark, tmp_path, packed):
    p = tmp_path / ("t.sql.gz" if packed else "t.sql")
    p.write_bytes(gzip.compress(DUMP.encode()) if packed else DUMP.encode())
    assert resolve.find(spark, str(tmp_path / "t")) == str(p)
    rows = [r["values"] for r in resolve.read_table(spark, str(tmp_path / "t")).collect()]
    assert sorted(rows, key=lambda r: r[0]) == [["1", "a'b", None, "-1.5e3"], ["2", "x),(y;", "q\\", "it's"], ["3", "n", "", "0"]]


def test_dump_modes():
    assert sqldump.split_insert("INSERT INTO t VALUES ('a\\nb',NULL);", "mysql", "<NULL>") == [["a\nb", "<NULL>"]]
    with pytest.raises(ValueError):
        sqldump.split_insert("INSERT INTO t VALUES (abc);")


def test_loaders(spark):
    def rows(*r):
        return spark.createDataFrame([(list(x),) for x in r], "values array<string>")

    page = links.load_pages(rows(["1", "0", "A", "", "1"] + ["0"] * 8, ["2", "14", "C", "", "1"] + ["0"] * 8))
    assert {(r["page_id"], r["ns"], r["is_redirect"]) for r in page.collect()} == {(1, 0, True), (2, 14, False)}
    cl = links.load_links(rows(["1", "C"] + [""] * 5, ["1", "Gone"] + [""] * 5, ["9", "C"] + [""] * 5), "categorylinks")
    found = links.resolve(cl, page, links.MISSING_CATEGORY)
    assert {(r["title"], r["to_id"]) for r in found.collect()} == {("C", 2), ("Gone", -1)}
    assert [r["from_id"] for r in links.broken_sources(cl, page).collect()] == [9]
    sub, art = links.split_members(found, page)
    assert sub.count() == 0 and art.count() == 2
    with pytest.raises(Exception, match="expected 4 columns"):
        links.load_links(rows(["1"]), "pagelinks").collect()


def test_seven_zip(spark, tmp_path):
    data = "\n".join(f"line {i} é" for i in range(900)).encode()
    assert sevenzip.unpack(sevenzip.pack(data)) == data
    (tmp_path / "x.7z").write_bytes(sevenzip.pack(data))
    assert [r["line"] for r in sevenzip.read_7z(spark, str(tmp_path / "x.7z")).collect()] == data.decode().split("\n")
    large = bytes(range(256)) * 3000
    assert sevenzip.unpack(sevenzip.pack(large)) == large and sevenzip.unpack(sevenzip.pack(b"")) == b""
    with pytest.raises(ValueError):
        sevenzip.unpack(b"PK")


def test_kinds():
    assert [resolve.kind_of(x) for x in (b"\x1f\x8b", b"7z\xbc\xaf", b"-- x", b"<mediawiki", b"abc", b"\0\1", b"")] == ["gzip", "7z", "sql", "xml", "text", None, None]


def test_plain(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a").write_text("en Talk:A 3 1\nen Talk:A 2 1\nde Talk:A 9 1\nen No 1 1\n")
    pages = spark.createDataFrame([(1, 1, "A")], "page_id long, ns int, title string")
    known, unknown = plain.read_page_views(spark, str(tmp_path / "v"), ["en"], pages)
    assert [tuple(r) for r in known.collect()] == [(1, 5)] and [tuple(r) for r in unknown.collect()] == [("No", 1)]
    (tmp_path / "f").write_text("# note\n-cat|P|C # x\n\n")
    assert [tuple(r) for r in plain.read_fixups(spark, str(tmp_path / "f")).collect()] == [("P", "C")]
    (tmp_path / "b").write_text(" Bot \n\nBot\n")
    assert [r[0] for r in plain.read_names(spark, str(tmp_path / "b")).collect()] == ["Bot"]
    lines = spark.createDataFrame([("cs a%20b+c 4",), ("cs  1",), ("en x 1",)], "value string")
    assert [tuple(r) for r in trending.page_counts(lines, "cs").collect()] == [("A b+c", 4)]
    with pytest.raises(Exception, match="not three fields"):
        trending.page_counts(spark.createDataFrame([("cs a",)], "value string"), "cs").collect()


def test_jdbc(spark):
    assert jdbc.translate("mysql://u:p%40@h:1/db/page") == ("jdbc:mysql://h:1/db", {"user": "u", "password": "p@"}, ["page"])
    with pytest.raises(ValueError):
        jdbc.translate("mysql-pipe://h/db/page")
    page = spark.createDataFrame([(1, 0, "A", 0)], "page_id int, page_namespace int, page_title string, page_is_redirect int")
    rev = spark.createDataFrame([(1, None, "20240101000000", 0, 0, "1.1.1.1", None, 1, 5), (2, 1, "20240102000000", 1, 3, "Ann", "c", 1, 6)], "rev_id int, rev_parent_id int, rev_timestamp string, rev_minor_edit int, rev_user int, rev_user_text string, rev_comment string, rev_page int, rev_text_id int")
    c = zlib.compressobj(wbits=-15)
    txt = spark.createDataFrame([(5, bytearray(b"plain"), "utf-8"), (6, bytearray(c.compress(b"zipped") + c.flush()), "utf-8,gzip")], "old_id int, old_text binary, old_flags string")
    rows = jdbc.join_history(page, rev, txt, "A").orderBy("rev_id").collect()
    assert [(r["contributor"], r["text"], r["comment"]) for r in rows] == [("ip:1.1.1.1", "plain", ""), ("id:3", "zipped", "c")]
    assert jdbc.join_history(page, rev, txt, first="20240102000000").count() == 1


def test_keyed_reads(spark, monkeypatch):
    """Against a database in memory: ranges of a key side by side, every row once."""
    monkeypatch.setattr(jdbc, "PART_KEYS", 100)
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    url, properties = "jdbc:derby:memory:palimpsest;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(-5, 995, 3).selectExpr("id as K", "cast(id * 2 as string) as V").coalesce(1).write.jdbc(url, "t", "overwrite", properties)
    rows = jdbc.read_keyed(spark, url, "t", properties, "K")
    assert rows.rdd.getNumPartitions() == 10
    assert sorted(map(tuple, rows.selectExpr("k", "cast(v as long)").collect())) == [(k, 2 * k) for k in range(-5, 995, 3)]
    assert jdbc.read_keyed(spark, url, "t", properties).count() == rows.count()
    spark.range(0).selectExpr("id as K").write.jdbc(url, "none_", "overwrite", properties)
    assert jdbc.read_keyed(spark, url, "none_", properties, "K").count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([("Talk:x",), (":Category:X",), ("::x",), ("2001: y",), ("",)], "s string")
    got = [tuple(r) for r in df.select(titles.parse_title(F.col("s"), {}).alias("t")).select("t.*").collect()]
    assert got == [(1, "x"), (14, "X"), (0, "x"), (0, " y"), (0, "")]
    got = [r["t"] and tuple(r["t"]) for r in df.select(titles.parse_engine_title(F.col("s")).alias("t")).collect()]
    assert got == [(1, "x"), (0, "Category:X"), (0, ":x"), (2001, " y"), None]
    one = spark.createDataFrame([("a😀<&", "20240131", "2024013112")], "a string, b string, c string")
    r = one.select(text.utf16_length(F.col("a")), text.html_escape(F.col("a")), text.parse_date_time(F.col("b")).isNotNull(), text.parse_date_time(F.col("c")).isNull(), text.thousands(F.lit(1234.5)), titles.namespace_name(F.lit(999)), titles.normalise_name(F.lit("é b"))).first()
    assert tuple(r) == (5, "a😀&lt;&amp;", True, True, "1,234.50000", "999", "É_b")
