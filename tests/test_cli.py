from palimpsest import cli
from palimpsest.sources import sevenzip
from test_sources import XML


def dump(rows):
    body = ",".join("(" + ",".join(str(v) if isinstance(v, int) else "'" + v + "'" for v in r) + ")" for r in rows)
    return f"INSERT INTO `t` VALUES {body};\n"


def test_statistics_and_blame(spark, tmp_path):
    (tmp_path / "d.xml").write_text(XML)
    (tmp_path / "bots").write_text("Ann\n")
    assert cli.main(["userstats", "--date0=20240131", f"--botlist={tmp_path}/bots", "--pernamespace", f"{tmp_path}/d", f"{tmp_path}/out"]) == 0
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert '<group name="ns1">' in text and "<bot" in text
    assert cli.main(["blame", "--from=20240101", "--to=20240102", f"{tmp_path}/d", f"{tmp_path}/b"]) == 0
    text = "".join(p.read_text() for p in (tmp_path / "b").glob("part-*"))
    assert "abc" in text and "\t  2024-01-0" in text
    (tmp_path / "z.xml.7z").write_bytes(sevenzip.pack(XML.encode()))
    assert cli.main(["blame", "--from=20240101", "--to=20240102", "--firstpage", f"{tmp_path}/z", f"{tmp_path}/zb"]) == 0
    assert "abc" in "".join(p.read_text() for p in (tmp_path / "zb").glob("part-*"))


def test_browse(spark, tmp_path):
    rest = ["0"] * 8
    tables = {
        "page": [[1, 0, "A", "", 0, *rest], [2, 14, "Top", "", 0, *rest], [3, 14, "Sub", "", 0, *rest], [4, 0, "B", "", 0, *rest]],
        "categorylinks": [[3, "Top", *[""] * 5], [1, "Sub", *[""] * 5], [4, "Top", *[""] * 5]],
        "templatelinks": [[1, 10, "Stub", 0], [4, 2, "Stub", 0]],
        "pagelinks": [[1, 0, "B", 0], [4, 0, "Gone", 0]],
        "externallinks": [[4, "http://x", "i"]],
    }
    for name, rows in tables.items():
        (tmp_path / f"w-{name}.sql").write_text(dump(rows))
    (tmp_path / "fix").write_text("-cat|B|Category:Top\n")
    (tmp_path / "views").mkdir()
    (tmp_path / "views" / "h1").write_text("en A 3 0\nen B 5 0\nde A 9 0\n")
    s = cli.open_session(spark, f"{tmp_path}/w", views=f"{tmp_path}/views")
    assert s.command("? template User:Stub") == 1 and s.command("= ns 0") == 2 and s.command("popular 0 en") == [(4, 5), (1, 3)]
    assert s.command("= category top") == 2 and s.command("* template stub") == 1 and s.command("? pagelink 4") == 1
    assert s.command("? pagelink Gone") == 1 and s.command("? pagelink B") == 1 and s.command("wantedarticles") == [("0:Gone", 1)]
    assert cli.open_session(spark, f"{tmp_path}/w", f"{tmp_path}/fix").command("= category top") == 1
