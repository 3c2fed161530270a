import ast
import json
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from plumbline.__main__ import NAMES, main, parser
from plumbline.plans import registry
from plumbline.sources.cache import PageCache, allowed, spaced

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


def cells(rows):
    plain = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_give_what_their_sql_gives(spark, name):
    got = registry.queries()[name](spark, SF)
    rows = cells(got.select(*sorted(got.columns)).collect())
    if name in registry.oracle_sql():
        con = duckdb.connect()
        for f in Path(SF).glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        cursor = con.execute(registry.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        assert sorted(names) == sorted(got.columns)
        assert rows == cells(tuple(r[k] for k in order) for r in cursor.fetchall())
    else:
        assert rows


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "plumbline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


def test_entry_works_without_them(tmp_path):
    shutil.copytree(ROOT / "plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    names = ast.literal_eval(run.stdout.split("] [")[0] + "]")
    assert names == sorted(registry.queries()) and not any(n.startswith("op") for n in names)


def test_command_line(tmp_path, capsys):
    assert len(NAMES) == 14
    (tmp_path / "a.txt").write_text("x")
    assert main(["inspect_image", "--path", str(tmp_path / "a.txt")]) == 1 and main(["inspect_image", "--path", str(tmp_path / "none")]) == 3
    (tmp_path / "a.msg").write_text("x")
    assert main(["extract_document", "--path", str(tmp_path / "a.msg"), "--format", "json"]) == 2
    assert "error" in json.loads(capsys.readouterr().err.splitlines()[-1])
    got = parser().parse_args(["inspect_http", "--url", "u", "--headers", "A: b", "--body", "x"])
    assert got.headers == [("A", "b")] and got.body == b"x"
    (tmp_path / "i.gif").write_bytes(b"GIF89a\x03\x00\x04\x00")
    assert main(["inspect_image", "--path", str(tmp_path / "i.gif"), "--output", str(tmp_path / "o.md")]) == 0 and "3×4" in (tmp_path / "o.md").read_text()


def test_page_cache_and_robots(spark, tmp_path):
    cache = PageCache(spark, str(tmp_path / "cache"), ttl=100)
    pages = spark.createDataFrame([("http://a/1", "one"), ("http://a/2", "two")], "url string, html string")
    cache.put(pages, 1000)
    cache.put(pages.where("url LIKE '%1'").selectExpr("url", "'newer' AS html"), 1050)
    got = lambda now: {r.url: r.html for r in cache.get(pages.select("url"), now).collect()}
    assert got(1060) == {"http://a/1": "newer", "http://a/2": "two"} and got(1120) == {"http://a/1": "newer", "http://a/2": None}
    assert tuple(cache.stats(1060).first()) == (2, 8, 60)
    cache.delete(pages.where("url LIKE '%1'").select("url"), 1070)
    assert got(1080) == {"http://a/1": None, "http://a/2": "two"}
    robots = spark.createDataFrame([("a", "User-agent: *\nDisallow: /1")], "host string, text string")
    urls = spark.createDataFrame([("http://a/1",), ("http://a/2",), ("http://b/1",)], "url string")
    assert {r.url: r.allowed for r in allowed(urls, robots).collect()} == {"http://a/1": False, "http://a/2": True, "http://b/1": True}
    assert {r.url: r.wait for r in spaced(urls, 2.0).collect()} == {"http://a/1": 0.0, "http://a/2": 2.0, "http://b/1": 0.0}


def test_header_filter_takes_every_event(spark):
    got = registry.queries()["header_filter"](spark, "/root/testdata/sf0.01")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.01/events.parquet").count() > 300
