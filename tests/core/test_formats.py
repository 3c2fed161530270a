import json
import re
import struct
import subprocess
import time
import zipfile
import zlib
from html import unescape

import pytest
from pyspark.sql import functions as F

from plumbline.errors import BadInput, FetchError, GitError, MissingDependency, NotFound
from plumbline.functions.shapes import json_digest, shape, xml_outline
from plumbline.operators import deps, html
from plumbline.plans import tools
from plumbline.sources import documents, files, git, manifests, notebooks, pycode, specs


def test_shapes():
    assert shape({"a": [1, 2], "b": {"c": {"d": {"e": 1}}}, "f": None, "g": 1.5, "h": True}) == "{a: array[2] → integer, b: {c: {d: {...}}}, f: null, g: number, h: boolean}"
    assert shape({str(k): 1 for k in range(12)}).endswith("... +2 more}") and shape([]) == "array[]" and shape({}) == "{}"
    d = json_digest('{"total": 3, "items": [{"a": 1}, {"a": 2}]}')
    assert (d["array_len"], d["depth"], d["sample"]) == (2, 4, '[{"a": 1}, {"a": 2}]') and json_digest("{")["parse_error"]
    xml = '<f:a xmlns:f="u" k="1"><b>text</b><c/><d x="1" y="2" z="3" w="4"/><e/><e/><e/></f:a>'
    assert xml_outline(xml).split("\n") == ['<a k="1"> (6 children)', "  <b> 'text'", "  <c />", '  <d x="1" y="2" z="3" ... +1 />', "  <e />", "  <e />", "  ... +1 more <e>"]
    assert xml_outline("<a").startswith("<xml parse error")


PAGE = f"""<html><head><title>A &amp; B</title><meta name="author" content="N. N."></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<article><h1>Head</h1><p>{'Long text of the article. ' * 30}</p><ul><li>one</li><li><b>two</b></li></ul><pre>code
  here</pre><table><tr><th>k</th><th>v</th></tr><tr><td>1</td></tr></table><p><a href="/rel">link</a> <img src="i.png"></p></article>
<footer>foot</footer><script>x()</script></body></html>"""


def test_pages():
    page = html.extract(PAGE, "https://host/dir/")
    assert page["title"] == "A & B" and page["author"] == "N. N." and page["extractor"] == "article" and page["warnings"] == []
    md = page["content_markdown"]
    for part in ("# Head", "- one\n- **two**", "```\ncode\n  here\n```", "| k   | v   |", "[link](https://host/rel)"):
        assert part in md
    assert "Menu" not in md and "foot" not in md and "i.png" not in md
    assert "link" in html.extract(PAGE, "", links=False)["content_markdown"] and "](" not in html.extract(PAGE, "", links=False)["content_markdown"]
    thin = html.extract("<p>short</p>")
    assert thin["extractor"] == "raw" and thin["content_text"] == "short" and thin["warnings"] and html.extract(None)["content_text"] == ""


def test_page_dates_and_charsets():
    assert html.extract('<meta name="Date" content="2024-05-06T07:00Z"><p>x</p>')["date"] == "2024-05-06" and html.extract("<time datetime='2020-01-02'>")["date"] == "2020-01-02"
    assert html.extract("<p>x</p>")["date"] is None
    for raw in ("<meta charset=latin-1><p>é</p>".encode("latin-1"), "<p>é</p>".encode(), "<p>é</p>".encode("cp1252"), "\ufeff<p>é</p>".encode(), "<p>é</p>".encode("utf-16")):
        assert html.extract(raw)["content_text"] == "é"


def test_nested_marks_lists_and_tables():
    show = lambda s: html.markdown(html.tree(s))
    assert show("<b>a<i>b<b>c</b></i></b> d<b> </b>e") == "**a*bc*** d e"
    assert show("<ul><li>a<ol><li>b</li><li>c</li></ol></li><li>d</ul>") == "- a\n\n  1. b\n  2. c\n\n- d"
    assert show("<blockquote>a<p>b</p></blockquote>c") == "> a\n>\n> b\n\nc"
    assert show("<table><tr><th>a<th>b|c<tr><td><table><tr><td>x<td>y</table></table>") == "| a   | b\\|c |\n|-----|------|\n| x y |"
    assert show("<h2> a <br> b </h2><hr><pre>c\n d</pre>") == "## a b\n\n---\n\n```\nc\n d\n```"
    deep = show("<ul><li>x" * 60)
    assert deep.count("- x") == 60 and max(map(len, deep.split("\n"))) < 60


@pytest.mark.parametrize("unit", ["<", "<b>", "<b><i>", "![", "<a href=x>", "<div><blockquote>", "<table><tr><td>", "<ul><li>x", "<!--", "</", "<a b='", "&#", "<pre>", "<p>x"])
def test_pages_take_time_by_their_length(unit):
    def seconds(n):
        began = time.process_time()
        html.extract(unit * n + "x")
        return time.process_time() - began

    assert seconds(40_000) < 30 * max(0.05, seconds(5_000))


def test_main_text_of_whole_tables():
    """Where a page has one article without other parts in it, its text is what stands outside tags there."""
    import duckdb

    n = 0
    for url, page in duckdb.sql("SELECT url, html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html IS NOT NULL").fetchall():
        began = time.process_time()
        got = html.extract(page, url)
        assert time.process_time() - began < 1
        part = re.findall(r"(?s)<article>(.*?)</article>", page)
        if got["extractor"] == "article" and len(part) == 1 and not re.search(r"<(script|style|form|nav|aside|header|footer|button)", part[0]):
            n += 1
            assert "".join(got["content_text"].split()) == "".join(unescape(re.sub("<[^>]+>", "", part[0])).split())
            assert got["title"] == " ".join(unescape(re.search(r"(?s)<title>(.*?)</title>", page)[1]).split())
    assert n > 100


def test_batches_of_pages(spark, tmp_path):
    from plumbline.sources.cache import PageCache

    pages = [("host/a", PAGE, "text/html"), ("ftp://x", PAGE, "text/html"), ("http://no/x", PAGE, "text/html"), ("http://h/none", None, "text/html"), ("http://h/i", "x", "image/png")]
    given = spark.createDataFrame(pages, "url string, html string, content_type string")
    robots = spark.createDataFrame([("no", "User-agent: *\nDisallow: /")], "host string, text string")
    cache = PageCache(spark, str(tmp_path / "cache"))
    cache.clear()
    got = {r.url: r for r in tools.fetch_pages(given, 100, cache, robots).collect()}
    assert len(got) == 5 and got["https://host/a"].title == "A & B" and not got["https://host/a"].from_cache and got["https://host/a"].error is None
    assert {u: r.error for u, r in got.items() if r.error} == {"ftp://x": "not an http(s) URL", "http://no/x": "robots don't allow it", "http://h/none": "the page couldn't be had", "http://h/i": "can't extract text from image/png"}
    again = {r.url: r for r in tools.fetch_pages(given.withColumn("html", F.lit(None).cast("string")), 200, cache, robots).collect()}
    assert again["https://host/a"].from_cache and again["https://host/a"].title == "A & B"


def test_options_of_the_tools(spark, tmp_path, monkeypatch):
    import io

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("k,v\n" + "".join(f"{i},{'x' * 50}{i % 3}\n" for i in range(9)))
    (tmp_path / "d" / "b.csv").write_text('k,v\n1,"two\nlines"\n')
    d = json.loads(tools.summarize_data(spark, str(tmp_path / "d" / "a.csv"), format="json", head=2, tail=1, max_columns=1))
    assert len(d["tables"][0]["head"]) == 2 and len(d["tables"][0]["tail"]) == 1 and len(d["tables"][0]["columns"]) == 1
    assert "x" * 19 + "…" in tools.summarize_data(spark, str(tmp_path / "d" / "a.csv"), max_cell_width=20)
    both = tools.summarize_data(spark, str(tmp_path / "d"), globs="*.csv")
    assert both.count("# Data Summary") == 2 and "two lines" in both
    with pytest.raises(BadInput):
        tools.summarize_data(spark, "-")
    monkeypatch.setattr("sys.stdin", io.StringIO("ERROR one\nERROR two\n" + "INFO same\n" * 9))
    d = json.loads(tools.summarize_log(spark, "-", format="json", max_errors=1, no_dedup=True))
    assert d["source"] == "stdin" and len(d["errors"]) == 1 and d["overflow_errors"] == 1 and d["suppressed_lines"] == 0
    (tmp_path / "d" / "x.log").write_text("ERROR z\n")
    assert tools.summarize_log(spark, str(tmp_path / "d")).count("# Log Summary") == 1
    tree = lambda **o: tools.smart_file_tree(spark, str(tmp_path / "d"), **o)
    assert "a.csv" in tree(min_size="100") and "b.csv" not in tree(min_size="100") and "a.csv" not in tree(max_size="0.1KB") and ".csv" not in tree(dirs_only=True)
    assert ".csv" not in tree(modified_before="2001-01-01") and "a.csv" in tree(files_only=True)
    (tmp_path / "d" / ".gitignore").write_text("a.*\n")
    assert "a.csv" not in tree() and "a.csv" in tree(no_gitignore=True)


def test_audit_from_files(spark, tmp_path):
    (tmp_path / "requirements.txt").write_text("fastapi==0.1\n")
    (tmp_path / "poetry.lock").write_text(LOCK)
    (tmp_path / "latest.jsonl").write_text('{"ecosystem": "pypi", "name": "fastapi", "latest": "0.9"}\n')
    (tmp_path / "adv.jsonl").write_text('{"ecosystem": "pypi", "name": "fastapi", "vuln_id": "G-1", "advisory": {"aliases": ["CVE-1"], "severity": [{"score": "8.5"}], "summary": "bad"}}\n')
    d = json.loads(tools.inspect_dependencies(spark, str(tmp_path), format="json", latest_file=str(tmp_path / "latest.jsonl"), advisories_file=str(tmp_path / "adv.jsonl")))
    assert d["ecosystems"]["pypi"]["direct"][0]["outdated"] is True
    assert [(a["id"], a["severity"], a["summary"]) for a in d["advisories"]] == [("CVE-1", "high", "bad")]


def test_ignore_rules(tmp_path):
    rules = files.Ignore.of(["*.t[xy]", "logs/", "!build", "/docs/*.md", "!keep.tx", "a[!b]c", "\\#x"])
    out = lambda p, is_dir=False: rules.path(p, is_dir)
    assert out("a.tx") and out("d/a.ty") and not out("a.tz") and not out("keep.tx") and out("logs", True) and not out("logs") and out("logs/x")
    assert out("build", True) and out("node_modules/x") and out("docs/a.md") and not out("docs/b/a.md") and out("axc") and not out("abc") and out("#x")


def test_markdown_cleaning():
    assert html.clean("a\n\n\n\nb  \n#Head\n[](x) ![i](y)") == "a\n\nb\n# Head"
    assert html.unescaped("\\[a\\]\n```\n\\[b\\]\n```") == "[a]\n```\n\\[b\\]\n```"
    assert html.without_link_lists("x\n- [a](1)\n- [b](2)\ny\n- [a](1) and more\n- [b](2)") == "x\ny\n- [a](1) and more\n- [b](2)"


def test_web_tools(spark):
    out = tools.fetch_url(spark, "host/dir/", PAGE)
    assert out.startswith("# A & B") and "https://host/dir/" in out
    for bad, error in ((("ftp://x", PAGE), BadInput), (("host", None), FetchError), (("host", PAGE, "image/png"), BadInput)):
        with pytest.raises(error):
            tools.fetch_url(spark, *bad)
    heads = [("Content-Type", "application/json; charset=utf-8"), ("Set-Cookie", "s=1; Path=/"), ("X-Junk", "1"), ("Authorization", "Bearer t")]
    d = json.loads(tools.inspect_http(spark, "u", 200, heads, b'{"items": [1, 2, 3]}', format="json"))
    assert d["format"] == "json" and d["array_len"] == 3 and [h["value"] for h in d["headers"]] == ["application/json; charset=utf-8", "s=<redacted>; Path=/", "<redacted>"]
    kinds = {b"\x89PNG\x00": ("application/octet-stream", "binary"), b"<!DOCTYPE html><title>T</title>": ("", "html"), b"<a><b/></a>": ("", "xml"), b"plain": ("text/plain", "text"), b"{bad": ("application/problem+json", "json")}
    for body, (kind, want) in kinds.items():
        got = json.loads(tools.inspect_http(spark, "u", 200, [("content-type", kind)] if kind else [], body, format="json"))
        assert got["format"] == want and bool(got["warnings"]) == (body == b"{bad")


LOCK = '[[package]]\nname = "fastapi"\nversion = "0.1"\n[package.dependencies]\nStarlette = "*"\npydantic = ">=2"\n[[package]]\nname = "starlette"\nversion = "0.2"\n[[package]]\nname = "pydantic"\nversion = "2.0"\n[[package]]\nname = "pytest"\nversion = "8.0"\ncategory = "dev"\n'


def test_pypi_project(spark, tmp_path):
    (tmp_path / "pyproject.toml").write_text('[project]\nname = "x"\ndependencies = ["FastAPI[all]>=0.1; python_version > \'3\'", "Pydantic>=2"]\n[project.optional-dependencies]\ndev = ["pytest", "ruff"]\n')
    (tmp_path / "poetry.lock").write_text(LOCK)
    d = json.loads(tools.inspect_dependencies(spark, str(tmp_path), format="json"))["ecosystems"]["pypi"]
    by = {p["name"]: p for p in d["direct"]}
    assert by["FastAPI"]["resolved"] == "0.1" and by["FastAPI"]["declared"] == "[all]>=0.1" and by["ruff"]["resolved"] is None and by["pytest"]["dev"]
    assert d["transitive_count"] == 1 and d["top_transitives"][0]["name"] == "starlette"
    own = deps.resolve(*manifests.read_project(spark, tmp_path)[:3])
    assert {r["name"]: r["parent"] for r in own.where("NOT direct").collect()} == {"starlette": "fastapi"}
    assert "pytest" not in [r["name"] for r in deps.resolve(*manifests.read_project(spark, tmp_path)[:3], include_dev=False).collect()]
    latest = spark.createDataFrame([("pypi", "FastAPI", "0.10"), ("pypi", "Pydantic", "2.0")], "ecosystem string, name string, latest string")
    assert {r["name"]: r["outdated"] for r in deps.with_latest(own, latest).collect()} == {"FastAPI": True, "Pydantic": False, "pytest": None, "ruff": None, "starlette": None}
    with pytest.raises(NotFound):
        tools.inspect_dependencies(spark, str(tmp_path / "none"))


def test_advisories(spark):
    text = {"aliases": ["GHSA-1", "CVE-9"], "summary": "", "details": " long ", "severity": [{"score": "8.5"}], "affected": [{"severity": [{"score": "CVSS:3.1/AV:N"}], "ranges": [{"events": [{"introduced": "0"}, {"fixed": "0.116.0"}]}]}], "references": [{"type": "FIX", "url": "f"}, {"type": "WEB", "url": "w"}]}
    raw = spark.createDataFrame([("pypi", "a", "V1"), ("pypi", "a", "V1"), ("pypi", "b", "V2"), ("pypi", "c", "V3")], "ecosystem string, name string, vuln_id string")
    details = spark.createDataFrame([("V1", json.dumps(text)), ("V2", json.dumps({"database_specific": {"severity": "MODERATE"}}))], "vuln_id string, text string")
    got = [tuple(r)[1:] for r in deps.by_severity(deps.normal_advisories(raw, details)).collect()]
    assert got == [("a", "CVE-9", "high", "long", "0.116.0", "w"), ("b", "V2", "medium", "(no summary)", None, None), ("c", "V3", "unknown", "(no summary)", None, None)]
    assert deps.by_severity(deps.normal_advisories(raw, details), ["High"]).count() == 1


def test_manifest_formats():
    text = "-r base.txt\nrequests>=2 # note\n# comment\n-e .\ngit+https://x/y#egg=egg&a=b\nDjango; extra == 'x'\n-r missing.txt\n"
    rows, notes = manifests.requirements(text, {"base.txt": "six\n-r deeper.txt\n"}.get)
    assert [r[0] for r in rows] == ["six", "requests", "egg", "Django"] and rows[1][1] == ">=2" and len(notes) == 3
    lock = {"lockfileVersion": 3, "packages": {"": {"dependencies": {"react": "1"}}, "node_modules/react": {"version": "1.0", "dependencies": {"loose-envify": "1"}}, "node_modules/react/node_modules/loose-envify": {"version": "2", "dev": True}}}
    rows, edges = manifests.package_lock(json.dumps(lock))
    assert rows == [("react", "1.0", False, False), ("loose-envify", "2", True, False)] and edges == [("<root>", "react"), ("react", "loose-envify")]
    rows, edges = manifests.package_lock(json.dumps({"dependencies": {"a": {"version": "1", "dependencies": {"b": {"version": "2"}}}}}))
    assert [r[0] for r in rows] == ["a", "b"] and edges == [("a", "b")]
    assert manifests.pnpm_key("/@scope/name@1.2.3(peer@4)") == ("@scope/name", "1.2.3") and manifests.pnpm_key("plain") == ("plain", None)
    assert manifests.pipfile_lock(json.dumps({"default": {"a": {"version": "==1"}}, "develop": {"b": {}}}))[0] == [("a", "1", False, False), ("b", None, True, False)]
    assert [r[0] for r in manifests.pyproject('[tool.poetry.dependencies]\npython = "3"\nrich = "^1"\n[tool.poetry.group.dev.dependencies]\nmypy = {version = "1"}\n')] == ["rich", "mypy"]
    assert [r[2] for r in manifests.package_json(json.dumps({"dependencies": {"a": "1"}, "devDependencies": {"b": None}}))] == [False, True]


OPENAPI = {
    "openapi": "3.0.3", "info": {"title": "Pets", "version": 1}, "servers": [{"url": "https://x"}],
    "components": {"schemas": {"Pet": {"type": "object", "title": "Pet", "properties": {"id": {"type": "integer", "format": "int64"}, "tags": {"type": "array", "items": {"$ref": "#/components/schemas/Tag"}}, "self": {"$ref": "#/components/schemas/Pet"}}}, "Tag": {"properties": {"n": {"type": "string"}}}},
                   "requestBodies": {"Body": {"content": {"text/x": {"schema": {"$ref": "#/components/schemas/Pet"}}}}}},
    "paths": {"/pets/{id}": {"parameters": [{"name": "id", "in": "path", "required": True, "schema": {"type": "string"}}],
              "get": {"summary": "One", "tags": ["p"], "parameters": [{"name": "id", "in": "path", "schema": {"type": "integer"}}], "responses": {"200": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Pet"}}}}, "404": {"description": "none"}, "500": {}}},
              "post": {"requestBody": {"$ref": "#/components/requestBodies/Body"}, "deprecated": True, "responses": {}}}},
}


def test_openapi(spark, tmp_path):
    rows = list(specs.Api(OPENAPI).endpoints())
    get, post = rows
    assert get[7] == [("id", "path", False, "integer", None)] and get[9] == {"200": "Pet {id: integer(int64), tags: array[Tag], self: Pet}", "404": "none", "500": "—"}
    assert post[8].startswith("Pet {") and post[5]
    path = tmp_path / "api.json"
    path.write_text(json.dumps(OPENAPI))
    assert "/pets/{id}" in tools.extract_api_spec(spark, str(path)) and "POST" not in tools.extract_api_spec(spark, str(path))
    d = json.loads(tools.extract_api_spec(spark, str(path), detail=True, include_deprecated=True, method="post", format="json"))
    assert [e["method"] for e in d["endpoints"]] == ["POST"]
    two = {"swagger": "2.0", "host": "h", "basePath": "/b", "definitions": {"A": {"type": "object"}}, "paths": {"/a": {"put": {"parameters": [{"name": "x", "in": "body", "schema": {"$ref": "#/definitions/A"}}, {"name": "q", "in": "query", "type": "string"}], "responses": {"200": {"schema": {"type": "boolean"}}}}}}}
    (row,) = specs.Api(two).endpoints()
    assert row[7][0][:4] == ("q", "query", False, "string") and row[8] == "object" and row[9] == {"200": "boolean"} and specs.Api(two).servers() == ["https://h/b"]
    assert specs.Api({}).schema({"allOf": [{"type": "string"}, {"oneOf": [{"type": "null"}, {}]}]}) == "string & null | any"
    assert specs.detect("x", "openapi: 3") == "openapi-yaml" and specs.detect("x", "type Query {") == "graphql"
    with pytest.raises(BadInput):
        specs.detect("x", "nothing")


SDL = '"""Root"""\nschema { query: RootQuery }\ntype RootQuery implements A & B @d(x: [1, {k: "v"}]) { "about" pets(first: Int = 10, tag: [String!]!): [Pet!]! other: Date @deprecated }\ninterface A { id: ID! }\ninput In { a: Int = 3 }\nunion U = | Pet | RootQuery\nenum E { ONE TWO }\nscalar Date\ndirective @d(x: Int) repeatable on FIELD | OBJECT\ntype Pet { name: String }\nextend type Pet { age: Int }'


def test_graphql(spark):
    by = {t[0]: t for t in specs.Sdl(SDL).types()}
    assert by["RootQuery"][1:3] == ("object", "query") and by["RootQuery"][4][0] == ("pets", "[Pet!]!", ["first: Int", "tag: [String!]!"], "about")
    assert by["U"][4][0][1] == "Pet | RootQuery" and [f[0] for f in by["E"][4]] == ["ONE", "TWO"] and [f[0] for f in by["Pet"][4]] == ["name", "age"]
    assert {n: t[1] for n, t in by.items()} == {"RootQuery": "object", "A": "interface", "In": "input", "U": "union", "E": "enum", "Date": "scalar", "Pet": "object"}
    assert "pets(first: Int" in tools.extract_api_spec(spark, "s.graphql", text=SDL)
    for bad in ("type {", "type A { x }", "nonsense", "type A { x: Int"):
        with pytest.raises(BadInput):
            specs.Sdl(bad).types()


def png(width, height):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IEND", b"")


def test_notebook(spark, tmp_path):
    import base64

    image = base64.b64encode(png(40, 30)).decode()
    stream = "".join(f"step {k}\n" for k in range(200))
    cells = [
        {"cell_type": "markdown", "source": ["# T\n", "text"]}, {"cell_type": "code", "source": "1+1", "execution_count": 1, "metadata": {"tags": ["keep"]}, "outputs": [{"output_type": "execute_result", "data": {"text/plain": ["2"]}}]},
        {"cell_type": "code", "source": "plot", "outputs": [{"output_type": "display_data", "data": {"image/png": image}}]}, {"cell_type": "code", "source": "run", "outputs": [{"output_type": "stream", "text": stream}]},
        {"cell_type": "code", "source": "x", "outputs": [{"output_type": "error", "ename": "E", "evalue": "v", "traceback": ["\x1b[31mred\x1b[0m"]}, {"output_type": "display_data", "data": {"text/html": "<b>hi</b>"}}]},
    ]
    path = tmp_path / "t.ipynb"
    path.write_text(json.dumps({"cells": cells, "metadata": {"kernelspec": {"display_name": "Py", "language": "python"}}}))
    own = json.loads(tools.extract_notebook(spark, str(path), format="json"))["cells"]
    assert own[2]["outputs"][0]["image"].startswith("<image: png 40×30") and own[3]["outputs"][0]["suppressed"] == 197 and own[3]["outputs"][0]["text"] == "step 0\nstep 1\nstep 2"
    assert own[4]["outputs"][0]["text"] == "E: v\nred" and own[4]["outputs"][1]["text"] == "**hi**"
    pick = lambda **k: [c["idx"] for c in json.loads(tools.extract_notebook(spark, str(path), format="json", **k))["cells"]]
    assert pick(cells="1:3") == [1, 2] and pick(code_only=True) == [1, 2, 3, 4] and pick(markdown_only=True) == [0] and pick(tags=["keep"]) == [1] and pick(cells="-1") == [4]
    assert notebooks.read_notebooks(spark, str(tmp_path / "*.ipynb")).count() == 5
    assert notebooks.shown_stream("10%\r50%\r100%\n") == ("100%", 0)
    with pytest.raises(BadInput):
        tools.extract_notebook(spark, str(tmp_path / "x.txt"))


LOG = "\x00h1\x1fs1\x1fAnn\x1fa@x\x1f2025-01-02T03:04:05+00:00\x1fsubject\x1fbody line\n\na.py\nb.py\n\n 2 files changed, 5 insertions(+), 1 deletion(-)\n\x00h2\x1fs2\x1fBo\x1fb@x\x1f2025-01-01T00:00:00+00:00\x1fsecond\x1f\n"
DIFF = "diff --git a/a.py b/a.py\nindex 1..2\n--- a/a.py\n+++ b/a.py\n@@ -1,3 +1,4 @@ def f\n x\n-y\n+z\n+w\n@@ -10 +11 @@\n-q\ndiff --git a/o.py b/n.py\nsimilarity index 90%\nrename from o.py\nrename to n.py\ndiff --git a/i.png b/i.png\nnew file mode 100644\nBinary files /dev/null and b/i.png differ\n"
STATUS = "# branch.oid 1\n# branch.head main\n# branch.upstream origin/main\n# branch.ab +3 -1\n1 M. N... 1 1 1 a b staged.py\n1 .M N... 1 1 1 a b un staged.py\n2 R. N... 1 1 1 a b R90 new.py\told.py\n? new.txt\n"


def test_git_parsers():
    a, b = git.parse_log(LOG)
    assert a[0] == "h1" and a[6:] == ("body line", ["a.py", "b.py"], 5, 1) and b[6:] == (None, [], 0, 0)
    changed, lines = git.parse_diff(DIFF)
    assert changed == [("a.py", None, "modified", False), ("n.py", "o.py", "renamed", False), ("i.png", None, "added", True)]
    assert [(x[1], x[3], x[5], x[6]) for x in lines] == [(0, " ", 1, 1), (0, "-", 1, 1), (0, "+", 1, 1), (0, "+", 1, 1), (1, "-", 10, 11)] and lines[0][7] == "def f"
    s = git.parse_status(STATUS)
    assert (s["branch"], s["ahead"], s["behind"], s["staged"], s["unstaged"], s["untracked"]) == ("main", 3, 1, ["staged.py", "new.py"], ["un staged.py"], ["new.txt"])
    assert git.renamed("a/{b => c}/d.py") == "a/c/d.py" and git.renamed("x => y") == "y" and git.parse_shortlog("  3  Ann <a@x>\n 1\tBo\n") == [("Ann", 3), ("Bo", 1)]
    blame = git.parse_blame("a" * 40 + " 1 1 2\nauthor Ann\nauthor-time 100\nsummary s\n\tone\n" + "a" * 40 + " 2 2\n\ttwo\n")
    assert [(x[0], x[1], x[3], x[4]) for x in blame] == [(1, "one", "Ann", 100), (2, "two", "Ann", 100)]


def test_git_tools(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    run("init", "-b", "main")
    for k in range(3):
        (tmp_path / "a.py").write_text("line\n" * (k + 1))
        (tmp_path / "b.py").write_text(str(k))
        run("add", ".")
        run("commit", "-m", f"commit {k}")
    (tmp_path / "a.py").write_text("changed\n")
    d = json.loads(tools.git_file_context(spark, str(tmp_path / "a.py"), format="json"))
    assert len(d["commits"]) == 3 and d["related"] == [{"path": "b.py", "n": 3}] and d["authors"][0]["author"] in ("Ann", "Not Committed Yet") and d["base"] == "HEAD~1"
    d = json.loads(tools.git_repo_context(spark, str(tmp_path), format="json"))
    assert d["status"]["unstaged"] == ["a.py"] and [(c["path"], c["part"]) for c in d["changes"]] == [("a.py", "unstaged")] and d["diff"] and d["active"][0]["commits"] == 3 and "## Recent commits" in tools.git_repo_context(spark, str(tmp_path))
    with pytest.raises(GitError):
        tools.git_repo_context(spark, "/")


def test_tree_and_index(spark, tmp_path):
    tree = {"src/a.py": "import os\nfrom . import b\nMAX = 1\nclass C(Base):\n    '''Doc.'''\n    async def m(self, x: int = 'a long default value', *args, k=1, **kw) -> int: ...\ndef f(a, /, b): ...\n", "src/bad.py": "def (", "src/n.js": "x\n", "node_modules/x.js": "", "skip.tmp": "", "keep.tmp": "", "big.bin": "\x00" * 10, "empty.txt": "", ".hidden": ""}
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / ".gitignore").write_text("*.tmp\n!keep.tmp\n# note\n")
    out = tools.smart_file_tree(spark, str(tmp_path))
    assert "node_modules" not in out and "skip.tmp" not in out and "keep.tmp" in out and ".hidden" not in out and "src/  (3 files)" in out and "[empty, recent]" in out
    assert tools.smart_file_tree(spark, str(tmp_path), focus="**/*.py").count(".py") == 2 and "a.py" in tools.smart_file_tree(spark, str(tmp_path), focus="src")
    stored = {r["path"]: r["is_dir"] for r in files.stored_tree(spark, str(tmp_path / "src")).collect()}
    assert stored == {"a.py": False, "bad.py": False, "n.js": False}
    d = json.loads(tools.index_codebase(spark, str(tmp_path), format="json"))
    by = {f["path"]: f for f in d["files"]}
    a = by["src/a.py"]
    assert [i["module"] for i in a["imports"]] == ["os", "."] and a["constants"] == ["MAX"] and a["functions"][0]["signature"] == "def f(a, /, b)"
    assert a["classes"][0]["methods"][0]["signature"] == "async def m(self, x: int='a long default valu..., *args, k=1, **kw) -> int" and by["src/bad.py"]["error"] and "big.bin" not in by
    assert "class C(Base)" in tools.index_codebase(spark, str(tmp_path)) and "- src/a.py" in tools.index_codebase(spark, str(tmp_path), detail="low")
    assert len(pycode.signature(__import__("ast").parse("def g(" + ", ".join(f"argument{k}" for k in range(30)) + "): ...").body[0])) < 20


def test_documents(tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    with zipfile.ZipFile(tmp_path / "r.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    text = tools.extract_document(str(tmp_path / "r.docx"))
    assert text.startswith("# Title\n\nPara\n\n| c") and documents.read_document(tmp_path / "r.docx", 5).truncated
    (tmp_path / "i.png").write_bytes(png(16, 9))
    assert "16×9" in tools.inspect_image(str(tmp_path / "i.png")) and json.loads(tools.inspect_image(str(tmp_path / "i.png"), "json"))["mode"] == "RGB"
    assert documents.image_info(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4, "P", "GIF")
    assert documents.image_info(b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xc0\x00\x11\x08\x00\x05\x00\x06\x03" + b"\x00" * 9)[:4] == (6, 5, "RGB", "JPEG")
    for name, error in (("x.pdf", BadInput), ("x.zzz", BadInput), ("x.msg", MissingDependency)):
        (tmp_path / name).write_text("x")
        with pytest.raises(error):
            documents.read_document(tmp_path / name)
    with pytest.raises((BadInput, NotFound)):
        tools.inspect_image(str(tmp_path / "x.pdf"))
    assert documents.page_set("1-3,7,x,9", 8) == [1, 2, 3, 7] and documents.clean_page("ﬁ hy-\nphen\x00\n\n\n\nx ") == "fi hyphen\n\nx"
    assert documents.joined_paragraphs("x" * 50 + "\nmore\nend.\nnew") == "x" * 50 + " more end.\nnew"
    assert documents.mean_confidence([("a", 90), (" ", 99), ("b", 10), ("c", 50)]) == ("a c", 70.0)
