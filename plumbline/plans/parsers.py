"""Queries that run the parsers of single documents over documents made from the tables' rows, with SQL that says what is in them."""

from __future__ import annotations

import zipfile
from io import BytesIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DigestError
from ..functions import shapes, text as texts, values, web
from ..operators import deps, html, logs, repo
from ..sources import documents, files, git, manifests, notebooks, pycode, specs
from ..sources.cache import PageCache, allowed, spaced
from ..sources.each import parse_each
from ..sources.scratch import new_folder
from . import tools
from .sqlguard import check_options, check_select

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(template: str, **parts: Column | str) -> Column:
    """A text with columns in place of {names}; doubled braces aren't needed."""
    out, rest = [], template
    while rest:
        at = min(((rest.index("{" + n + "}"), n) for n in parts if "{" + n + "}" in rest), default=None)
        if at is None:
            out.append(F.lit(rest))
            break
        head, (_, tail) = rest[: at[0]], (0, rest[at[0] + len(at[1]) + 2 :])
        out += [F.lit(head), F.col(parts[at[1]]).cast("string") if isinstance(parts[at[1]], str) else parts[at[1]].cast("string")]
        rest = tail
    return F.concat(*out)


def customers(spark: SparkSession, sf_dir: str, template: str, **parts) -> DataFrame:
    """k and text: a document for each customer."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), filled(template, k="c_custkey", n="c_nationkey", **parts).alias("text"))


# --- manifests, lockfiles and versions

DECLARED = "name string, `constraint` string, dev boolean, optional boolean"
LOCKED = "name string, version string, dev boolean, optional boolean"


@query(
    """SELECT c_custkey AS k, u.name, u.c AS "constraint" FROM customer, LATERAL (VALUES ('Pkg_' || c_custkey, '[x]>=1.' || c_custkey), ('inc.' || c_custkey, NULL),
      ('egg' || c_custkey, 'git+https://h/x#egg=egg' || c_custkey), ('last', '~= 2')) AS u(name, c)"""
)
def requirement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "# head\nPkg_{k}[x]>=1.{k} ; python_version > '3'  # why\n--hash=no\n-r more.txt\ngit+https://h/x#egg=egg{k}\nhttps://no/egg\n\nlast ~= 2\n"
    own = customers(spark, sf_dir, text)
    key = lambda t: t.split("Pkg_")[1].split("[")[0]
    parse = lambda t: [d[:2] for d in manifests.requirements(t, lambda name: f"inc.{key(t)}\n-r deeper.txt" if name == "more.txt" else None)[0]]
    return parse_each(own, ["k"], "text", parse, "name string, `constraint` string")


@query(
    """SELECT c_custkey AS k, count(*) AS n FROM customer, LATERAL (VALUES (1), (2), (3)) AS u(x) GROUP BY 1"""
)
def requirement_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = customers(spark, sf_dir, "-r a{k}.txt\n-r none.txt\nb")
    parse = lambda t: [(note,) for note in manifests.requirements(t, lambda name: "-r c.txt\nd" if name.startswith("a") else None)[1]]
    return parse_each(own, ["k"], "text", parse, "note string").groupBy("k").agg(F.count("note").alias("n"))


@query(
    """SELECT c_custkey AS k, u.* FROM customer, LATERAL (VALUES ('a' || c_custkey, '>=1', false, false), ('t', NULL, true, true), ('o', '==' || c_nationkey, false, true),
      ('P', '^' || c_custkey, false, false), ('q', '2', false, false), ('python', '3', true, false)) AS u(name, "constraint", dev, optional)"""
)
def pyproject_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        '[project]\nname = "x"\ndependencies = ["a{k} >=1"]\n[project.optional-dependencies]\ntest = ["t"]\nother = ["o=={n}"]\n'
        '[tool.poetry.dependencies]\npython = "^3"\nP = "^{k}"\n[tool.poetry.group.main.dependencies]\nq = {version = "2", extras = ["z"]}\n[tool.poetry.dev-dependencies]\npython = "3"\n'
    )
    return parse_each(customers(spark, sf_dir, text), ["k"], "text", manifests.pyproject, DECLARED)


@query("""SELECT c_custkey AS k, u.* FROM customer, LATERAL (VALUES ('a', '==' || c_custkey, false, false), ('b', '*', false, false), ('c', NULL, true, false)) AS u(name, "constraint", dev, optional)""")
def pipfile_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '[packages]\na = "=={k}"\nb = {version = "*"}\n[dev-packages]\nc = {git = "g"}\n'
    return parse_each(customers(spark, sf_dir, text), ["k"], "text", manifests.pipfile, DECLARED)


@query("""SELECT c_custkey AS k, u.* FROM customer, LATERAL (VALUES ('a', '^' || c_custkey, false, false), ('b', '1', true, false), ('p', '>=2', false, false), ('o', 'x', false, true)) AS u(name, "constraint", dev, optional)""")
def package_json_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '{"dependencies": {"a": "^{k}"}, "devDependencies": {"b": 1}, "peerDependencies": {"p": ">=2"}, "optionalDependencies": {"o": "x"}, "scripts": {"s": "t"}}'
    return parse_each(customers(spark, sf_dir, text), ["k"], "text", manifests.package_json, DECLARED)


@query("""SELECT c_custkey AS k, u.* FROM customer, LATERAL (VALUES ('a', '1.' || c_custkey, false, false), ('b', '2', true, true)) AS u(name, version, dev, optional)""")
def toml_lock_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '[[package]]\nname = "a"\nversion = "1.{k}"\n[package.dependencies]\nb = "*"\n[[package]]\nname = "b"\nversion = "2"\ncategory = "dev"\noptional = true\n'
    return parse_each(customers(spark, sf_dir, text), ["k"], "text", lambda t: manifests.toml_lock(t)[0], LOCKED)


@query("SELECT c_custkey AS k, u.* FROM customer, LATERAL (VALUES ('a', 'b'), ('a', 'c' || c_custkey), ('b', 'd')) AS u(parent, child)")
def toml_lock_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '[[package]]\nname = "a"\nversion = "1"\ndependencies = [{name = "b"}, {name = "c{k}"}]\n[[package]]\nname = "b"\nversion = "2"\n[package.dependencies]\nd = "*"\n'
    return parse_each(customers(spark, sf_dir, text), ["k"], "text", lambda t: manifests.toml_lock(t)[1], "parent string, child string")


@query("""SELECT c_custkey AS k, u.* FROM customer, LATERAL (VALUES ('a', '1.' || c_custkey, false, false), ('b', NULL, false, false), ('c', '3', true, false)) AS u(name, version, dev, optional)""")
def pipfile_lock_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '{"_meta": {}, "default": {"a": {"version": "==1.{k}"}, "b": {"git": "x"}}, "develop": {"c": {"version": "==3"}}}'
    return parse_each(customers(spark, sf_dir, text), ["k"], "text", lambda t: manifests.pipfile_lock(t)[0], LOCKED)


NPM = (
    '{"lockfileVersion": 3, "packages": {"": {"dependencies": {"a": "^1"}}, "node_modules/a": {"version": "1.{k}", "dependencies": {"b": "2"}}, '
    '"node_modules/a/node_modules/b": {"version": "2", "dev": true}, "node_modules/@s/c": {"version": "3", "optional": true}}}'
)


@query("""SELECT c_custkey AS k, u.* FROM customer, LATERAL (VALUES ('a', '1.' || c_custkey, false, false), ('b', '2', true, false), ('@s/c', '3', false, true)) AS u(name, version, dev, optional)""")
def npm_lock_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_each(customers(spark, sf_dir, NPM), ["k"], "text", lambda t: manifests.package_lock(t)[0], LOCKED)


@query("SELECT c_custkey AS k, u.* FROM customer, LATERAL (VALUES ('<root>', 'a'), ('a', 'b')) AS u(parent, child)")
def npm_lock_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_each(customers(spark, sf_dir, NPM), ["k"], "text", lambda t: manifests.package_lock(t)[1], "parent string, child string")


@query("""SELECT c_custkey AS k, u.* FROM customer, LATERAL (VALUES ('a', '1.' || c_custkey, false, false), ('b', '2', true, false)) AS u(name, version, dev, optional)""")
def npm_lock_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '{"lockfileVersion": 1, "dependencies": {"a": {"version": "1.{k}", "dependencies": {"b": {"version": "2", "dev": true}}}}}'
    return parse_each(customers(spark, sf_dir, text), ["k"], "text", lambda t: manifests.package_lock(t)[0], LOCKED)


@query("SELECT c_custkey AS k, '@s/n' || c_custkey AS name, '1.2.' || c_custkey AS version FROM customer")
def pnpm_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_each(customers(spark, sf_dir, "/@s/n{k}@1.2.{k}(peer@4)"), ["k"], "text", lambda t: [manifests.pnpm_key(t)], "name string, version string")


@query("SELECT c_custkey AS k, 'a-b-c' || c_custkey AS name FROM customer")
def package_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir, "A_b.-C{k}").select("k", texts.package_name(F.col("text")).alias("name"))


@query(
    """SELECT c_custkey AS k, '1.' || (c_custkey % 12) || '.0' AS resolved, CASE WHEN c_custkey % 5 <> 0 THEN '1.' || (c_custkey * 7 % 12) || '.0' END AS latest,
      CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 12 < c_custkey * 7 % 12 END AS outdated FROM customer"""
)
def versions_outdated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lit("pypi").alias("ecosystem"), F.col("c_name").alias("name"), F.col("c_custkey").alias("k"))
    own = c.withColumn("resolved", F.concat(F.lit("1."), (F.col("k") % 12).cast("string"), F.lit(".0")))
    latest = c.where("k % 5 <> 0").select("ecosystem", "name", F.concat(F.lit("1."), (F.col("k") * 7 % 12).cast("string"), F.lit(".0")).alias("latest"))
    return deps.with_latest(own, latest).select("k", "resolved", "latest", "outdated")


@query("SELECT 'pypi' AS ecosystem, c_mktsegment AS key, min(c_custkey) AS ord, arg_min(c_name, c_custkey) AS \"constraint\" FROM customer GROUP BY c_mktsegment")
def dep_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lit("pypi").alias("ecosystem"), F.lower("c_mktsegment").alias("name"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("constraint"))
    return deps.first_wins(c).select("ecosystem", F.upper("key").alias("key"), "ord", "constraint")


@query("SELECT 'npm' AS ecosystem, c_mktsegment AS name, arg_max(c_custkey::VARCHAR, c_custkey) AS version, count(DISTINCT c_custkey) AS n_versions FROM customer GROUP BY 2")
def dep_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lit("npm").alias("ecosystem"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("ord"), F.col("c_custkey").cast("string").alias("version"), F.lit(False).alias("dev"), F.lit(False).alias("optional"))
    return deps.last_wins(c).select("ecosystem", "name", "version", F.size("versions").cast("long").alias("n_versions"))


def _project(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as packages: even keys are declared, all but multiples of 7 locked, each needs the next."""
    c = table(spark, sf_dir, "customer").select(F.lit("pypi").alias("ecosystem"), F.col("c_custkey").cast("int").alias("ord"), F.col("c_custkey").alias("k"))
    name = lambda x: F.concat(F.lit("p-"), x.cast("string"))
    declared = c.where("k % 2 = 0").select("ecosystem", "ord", name(F.col("k")).alias("name"), F.lit(">=1").alias("constraint"), (F.col("k") % 3 == 0).alias("dev"), F.lit(False).alias("optional"))
    lock = c.where("k % 7 <> 0").select("ecosystem", "ord", name(F.col("k")).alias("name"), F.col("k").cast("string").alias("version"), (F.col("k") % 5 == 0).alias("dev"), F.lit(False).alias("optional"))
    return declared, lock, c.select("ecosystem", "ord", name(F.col("k")).alias("parent"), name(F.col("k") + 1).alias("child"))


PROJECT = """SELECT 'p-' || c_custkey AS name, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey::VARCHAR END AS resolved, c_custkey % 2 = 0 AS direct,
  (c_custkey % 2 = 0 AND c_custkey % 3 = 0) OR (c_custkey % 7 <> 0 AND c_custkey % 5 = 0) AS dev,
  CASE WHEN c_custkey % 7 <> 0 AND EXISTS (FROM customer p WHERE p.c_custkey = c.c_custkey - 1) THEN 1 ELSE 0 END AS in_edges
  FROM customer c WHERE c_custkey % 2 = 0 OR c_custkey % 7 <> 0"""


@query(f"SELECT name, resolved, direct, in_edges FROM ({PROJECT}) WHERE NOT dev")
def dep_without_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.resolve(*_project(spark, sf_dir), include_dev=False).select("name", "resolved", "direct", "in_edges")


@query("SELECT 'p-' || c_custkey AS name, '>=1' AS declared, c_custkey % 3 = 0 AS dev FROM customer WHERE c_custkey % 2 = 0")
def dep_direct_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.resolve(*_project(spark, sf_dir), direct_only=True).select("name", "declared", "dev")


@query(
    """SELECT 'p' || c_custkey AS name, CASE c_custkey % 3 WHEN 0 THEN 'CVE-2024-' || c_custkey ELSE 'V' || c_custkey END AS id, CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'unknown' END AS severity,
      CASE c_custkey % 3 WHEN 0 THEN 'S ' || c_custkey WHEN 1 THEN 'D ' || c_custkey ELSE '(no summary)' END AS summary,
      CASE WHEN c_custkey % 3 = 0 THEN '1.' || c_custkey END AS fixed_in, CASE WHEN c_custkey % 3 = 0 THEN 'https://a/' || c_custkey END AS url FROM customer"""
)
def dep_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    raw = c.select(F.lit("npm").alias("ecosystem"), filled("p{k}", k="k").alias("name"), filled("V{k}", k="k").alias("vuln_id"))
    full = filled(
        '{"aliases": ["GHSA-x", "CVE-2024-{k}"], "summary": "S {k}", "severity": [{"score": "7.5"}], "references": [{"type": "PACKAGE", "url": "no"}, {"type": "WEB", "url": "https://a/{k}"}], '
        '"affected": [{"ranges": [{"events": [{"introduced": "0"}, {"fixed": "1.{k}"}]}]}]}', k="k",
    )
    short = filled('{"summary": "", "details": "D {k}", "database_specific": {"severity": "MODERATE"}}', k="k")
    details = c.where("k % 3 < 2").select(filled("V{k}", k="k").alias("vuln_id"), F.when(F.col("k") % 3 == 0, full).otherwise(short).alias("text"))
    return deps.normal_advisories(raw.union(raw), details).select("name", "id", "severity", "summary", "fixed_in", "url")


@query("SELECT 'p' || c_custkey AS name, CASE c_custkey % 4 WHEN 0 THEN 'critical' ELSE 'low' END AS severity FROM customer WHERE c_custkey % 4 IN (0, 3)")
def dep_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, ["critical", "high", "medium", "low"])), (F.col("c_custkey") % 4 + 1).cast("int"))
    own = table(spark, sf_dir, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("name"), level.alias("severity"), F.lit("i").alias("id"))
    return deps.by_severity(own, ["LOW", "critical"]).select("name", "severity")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS place, 'p' || c_custkey AS name, c_acctbal AS answer FROM customer")
def dep_answers_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    asked = c.select((F.col("c_custkey") * 2).alias("place"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("name"))
    return deps.zipped(asked, "place", c.select((F.col("c_custkey") * 3).alias("at"), F.col("c_acctbal").alias("answer")), "at")


# --- history

LOG = "\x00{k}aaaa\x1f{k}a\x1fAnn\x1fa@x\x1f2024-01-02T03:04:05+00:00\x1fsubject {k}\x1fbody line\n\nmore {k}\x1f\n3\t{n}\tsrc/{old => new}/a.py\n-\t-\tlogo.png\n\x00ffff\x1ff\x1fBob\x1fb@x\x1f2024-01-01T00:00:00+00:00\x1finitial\x1f\x1f\n"


@query(
    """SELECT c_custkey AS k, u.* FROM customer, LATERAL (VALUES (c_custkey || 'aaaa', 'Ann', 'subject ' || c_custkey, 'body line' || chr(10) || chr(10) || 'more ' || c_custkey, 'src/new/a.py,logo.png', 3::BIGINT, c_nationkey::BIGINT),
      ('ffff', 'Bob', 'initial', NULL, '', 0, 0)) AS u(hash, author, subject, body, files, insertions, deletions)"""
)
def git_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parse = lambda t: [(r[0], r[2], r[5], r[6], ",".join(r[7]), r[8], r[9]) for r in git.parse_log(t)]
    return parse_each(customers(spark, sf_dir, LOG), ["k"], "text", parse, "hash string, author string, subject string, body string, files string, insertions long, deletions long")


BLAME = "{h} 1 1 2\nauthor Ann\nauthor-time 17{k}\nsummary first\nfilename a.py\n\tx = {k}\n{h} 2 2\n\ty = 2\n" + "b" * 40 + " 3 3 1\nauthor Bob\nauthor-time 9\nsummary second\n\tz\n"


@query(
    """SELECT c_custkey AS k, u.* FROM customer, LATERAL (VALUES (1::BIGINT, 'x = ' || c_custkey, 'Ann', ('17' || c_custkey)::BIGINT, 'first'), (2, 'y = 2', 'Ann', ('17' || c_custkey)::BIGINT, 'first'),
      (3, 'z', 'Bob', 9, 'second')) AS u(line_number, content, author, ts, subject)"""
)
def git_blame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = customers(spark, sf_dir, BLAME, h=F.lpad(F.col("c_custkey").cast("string"), 40, "a"))
    parse = lambda t: [(r[0], r[1], r[3], r[4], r[5]) for r in git.parse_blame(t)]
    return parse_each(own, ["k"], "text", parse, "line_number long, content string, author string, ts long, subject string")


DIFF = (
    "diff --git a/a{k}.py b/a{k}.py\nindex 1..2 100644\n--- a/a{k}.py\n+++ b/a{k}.py\n@@ -1,2 +1,3 @@ def f\n same\n-old {k}\n+new {k}\n+more\n@@ -9 +10 @@\n-gone\n"
    "diff --git a/o.txt b/n.txt\nsimilarity index 90%\nrename from o.txt\nrename to n.txt\ndiff --git a/i.png b/i.png\nnew file mode 100644\nBinary files /dev/null and b/i.png differ\n"
)


@query(
    """SELECT c_custkey AS k, u.* FROM customer, LATERAL (VALUES ('a' || c_custkey || '.py', NULL, 'modified', false), ('n.txt', 'o.txt', 'renamed', false), ('i.png', NULL, 'added', true)) AS u(path, old_path, status, is_binary)"""
)
def git_diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_each(customers(spark, sf_dir, DIFF), ["k"], "text", lambda t: git.parse_diff(t)[0], git.DIFF_FILES)


@query(
    """SELECT c_custkey AS k, u.* FROM customer, LATERAL (VALUES (0, 0, ' ', 'same', 1, 1), (0, 1, '-', 'old ' || c_custkey, 2, NULL), (0, 2, '+', 'new ' || c_custkey, NULL, 2), (0, 3, '+', 'more', NULL, 3),
      (1, 0, '-', 'gone', 9, NULL)) AS u(hunk, place, type, content, old_no, new_no)"""
)
def git_diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = parse_each(customers(spark, sf_dir, DIFF), ["k"], "text", lambda t: git.parse_diff(t)[1], git.DIFF_LINES)
    numbered = repo.number_diff_lines(own.withColumn("path", F.concat_ws("/", F.col("k").cast("string"), "path")))
    return numbered.select("k", "hunk", "place", "type", "content", F.col("old_no").cast("int").alias("old_no"), F.col("new_no").cast("int").alias("new_no"))


@query(
    """SELECT c_custkey AS k, 'b' || c_custkey AS branch, 'origin/m' AS upstream, c_nationkey AS ahead, 2 AS behind, 's.py,b.py,new' || c_custkey AS staged, 'b.py,u.py' AS unstaged, 'x y.txt' AS untracked FROM customer"""
)
def git_status_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        "# branch.oid 1\n# branch.head b{k}\n# branch.upstream origin/m\n# branch.ab +{n} -2\n1 M. N... 1 1 1 a a s.py\n1 MM N... 1 1 1 a a b.py\n1 .M N... 1 1 1 a a u.py\n"
        "2 R. N... 1 1 1 a a R100 new{k}\told\n? x y.txt\n"
    )

    def parse(t: str) -> list[tuple]:
        s = git.parse_status(t)
        return [(s["branch"], s["upstream"], s["ahead"], s["behind"], *(",".join(s[x]) for x in ("staged", "unstaged", "untracked")))]

    return parse_each(customers(spark, sf_dir, text), ["k"], "text", parse, "branch string, upstream string, ahead int, behind int, staged string, unstaged string, untracked string")


@query("SELECT c_custkey AS k, u.* FROM customer, LATERAL (VALUES ('Ann B', c_custkey::BIGINT), ('Bob', 2)) AS u(author, n)")
def git_shortlog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_each(customers(spark, sf_dir, "  {k}\tAnn B <a@x>\n     2\tBob\n"), ["k"], "text", git.parse_shortlog, "author string, n long")


@query(
    """SELECT c_custkey AS k, u.* FROM customer, LATERAL (VALUES ('a.py', 'staged'), ('s' || c_custkey, 'staged'), ('w.py', 'unstaged')) AS u(path, part)"""
)
def git_uncommitted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), filled("s{k}", k="c_custkey").alias("s"))
    rows = lambda *paths: c.select("k", F.explode(F.array(*paths)).alias("path"))
    staged, whole = rows(F.lit("a.py"), F.col("s")), rows(F.lit("a.py"), F.lit("w.py"), F.col("s"))
    return repo.uncommitted(staged, whole, ["k", "path"]).select("k", "path", "part")


# --- specifications

API = (
    '{"openapi": "3.0.3", "info": {"title": "T", "version": "1"}, "components": {"schemas": {"Pet": {"title": "Pet", "type": "object", "properties": {"id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}, "next": {"$ref": "#/components/schemas/Pet"}}}}, '
    '"responses": {"Gone": {"description": "gone"}}, "requestBodies": {"B": {"content": {"text/x": {"schema": {"type": "string"}}, "application/json": {"schema": {"$ref": "#/components/schemas/Pet"}}}}}}, '
    '"paths": {"/pets/{id}": {"parameters": [{"name": "id", "in": "path", "required": true, "schema": {"type": "integer", "format": "int64"}}], '
    '"get": {"summary": "one {k}", "tags": ["pets"], "operationId": "get{k}", "responses": {"200": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Pet"}}}}, "404": {"$ref": "#/components/responses/Gone"}}}, '
    '"put": {"deprecated": true, "tags": ["pets", "old"], "requestBody": {"$ref": "#/components/requestBodies/B"}, "responses": {"204": {"description": "done"}}}}, "/n{n}": {"post": {"responses": {}}}}}'
)
ENDPOINT = "method string, path string, summary string, tags string, deprecated boolean, operation_id string, parameters string, request_body string, responses string"


def _endpoints(text: str) -> list[tuple]:
    kind, data = specs.load("api", text)
    shown = lambda p: f"{p[0]}:{p[1]}:{p[2]}:{p[3]}"
    rows = specs.Api(data).endpoints()
    return [(m, p, s, ",".join(t), d, o, ";".join(map(shown, q)), b, ";".join(f"{c}={a}" for c, a in r.items())) for m, p, s, _, t, d, o, q, b, r in rows]


def _api(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir, API.replace("/pets/{id}", "/pets/{id}"))


PET = "Pet {id: integer, tags: array[string], next: Pet}"


@query(
    f"""SELECT c_custkey AS k, u.* FROM customer, LATERAL (VALUES
      ('GET', '/pets/{{id}}', 'one ' || c_custkey, 'pets', false, 'get' || c_custkey, 'id:path:True:integer(int64)', NULL, '200={PET};404=gone'),
      ('PUT', '/pets/{{id}}', NULL, 'pets,old', true, NULL, 'id:path:True:integer(int64)', '{PET}', '204=done'), ('POST', '/n' || c_nationkey, NULL, '', false, NULL, '', NULL, ''))
      AS u(method, path, summary, tags, deprecated, operation_id, parameters, request_body, responses)"""
)
def spec_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_each(_api(spark, sf_dir), ["k"], "text", _endpoints, ENDPOINT)


@query("SELECT c_custkey AS k, 'GET' AS method, '/pets/{id}' AS path FROM customer")
def spec_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = parse_each(_api(spark, sf_dir), ["k"], "text", _endpoints, ENDPOINT).withColumn("tags", F.split("tags", ","))
    kept = specs.filter_endpoints(own, tags=["pets"], path="pets", methods=["get", "put"], detail=False)
    return kept.select("k", "method", "path") if "responses" not in kept.columns else own.limit(0)


@query(
    """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'openapi-json' WHEN 1 THEN 'openapi-yaml' WHEN 2 THEN 'graphql' ELSE 'none' END AS kind FROM customer"""
)
def spec_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, '{"swagger": "2.0"}').when(k == 1, "# c\nopenapi: 3.0.0\n").when(k == 2, "type Query { a: Int }").otherwise("plain")

    def parse(t: str) -> list[tuple]:
        try:
            return [(specs.detect("x", t),)]
        except DigestError:
            return [("none",)]

    return parse_each(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), text.alias("text")), ["k"], "text", parse, "kind string")


@query(
    """SELECT c_custkey AS k, u.* FROM customer, LATERAL (VALUES ('Q' || c_custkey, 'object', 'query', 'about', 'one(id: ID!): [T!]!;n: Int'), ('T', 'object', NULL, NULL, 'a: Int;b: String'),
      ('E', 'enum', NULL, NULL, 'X: enum_value;Y: enum_value'), ('U', 'union', NULL, NULL, 'members: T | Z'), ('In', 'input', NULL, NULL, 'f: [Float]'), ('S', 'scalar', NULL, NULL, '')) AS u(name, kind, operation, description, fields)"""
)
def graphql_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        'schema { query: Q{k} }\n"""about"""\ntype Q{k} implements N & M { "one" one(id: ID! = 3 @d): [T!]! @x(a: {b: [1]}) n: Int }\ntype T { a: Int }\nextend type T { b: String } # end\nenum E { X Y @deprecated }\n'
        "union U = | T | Z\ninput In { f: [Float] = [1.5] }\nscalar S\ndirective @x(a: Int) repeatable on FIELD | OBJECT\n"
    )

    def parse(t: str) -> list[tuple]:
        shown = lambda f: f[0] + (f"({', '.join(f[2])})" if f[2] else "") + f": {f[1]}"
        return [(n, kind, op, about, ";".join(map(shown, fields))) for n, kind, op, about, fields in specs.Sdl(t).types()]

    return parse_each(customers(spark, sf_dir, text), ["k"], "text", parse, "name string, kind string, operation string, description string, fields string")


@query("SELECT u.kind, count(*) * u.n AS n FROM customer, (VALUES ('enum', 1), ('object', 2)) AS u(kind, n) GROUP BY u.kind, u.n")
def graphql_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = parse_each(customers(spark, sf_dir, "type A{k} { a: Int } type B { b: A{k} } enum C { D }"), ["k"], "text", lambda t: [(x[1],) for x in specs.Sdl(t).types()], "kind string")
    return own.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# --- notebooks

NOTEBOOK = (
    '{"metadata": {"kernelspec": {"display_name": "Python 3", "language": "python"}}, "cells": [{"cell_type": "markdown", "source": ["# T", " {k}"]}, '
    '{"cell_type": "code", "execution_count": {n}, "metadata": {"tags": ["a"]}, "source": "x", "outputs": [{"output_type": "stream", "text": ["1 a\\n2 a\\n3 a\\n4 a\\n5 a\\n", "b\\r\\u001b[1mc\\n"]}, '
    '{"output_type": "execute_result", "data": {"text/html": "<b>h{k}</b>"}}, {"output_type": "display_data", "data": {"image/png": "iVBORw0KGgoAAAANSUhEUgAAACgAAAAe", "text/plain": "no"}}, '
    '{"output_type": "error", "ename": "E", "evalue": "v", "traceback": ["\\u001b[31mred\\u001b[0m"]}]}, {"cell_type": "raw", "source": "r"}, {"cell_type": "code", "source": "y", "metadata": {"tags": ["b"]}, "outputs": []}]}'
)


@query(
    """SELECT c_custkey AS k, u.* FROM customer, LATERAL (VALUES (0, 'markdown', '# T ' || c_custkey, NULL, ''), (1, 'code', 'x', c_nationkey, 'a'), (2, 'raw', 'r', NULL, ''), (3, 'code', 'y', NULL, 'b')) AS u(idx, cell_type, source, execution_count, tags)"""
)
def notebook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    parse = lambda t: [(r[1], r[2], r[3], r[4], ",".join(r[5])) for r in notebooks.cells_of("n", t)[0]]
    return parse_each(customers(spark, sf_dir, NOTEBOOK), ["k"], "text", parse, "idx int, cell_type string, source string, execution_count int, tags string")


@query(
    """SELECT c_custkey AS k, u.* FROM customer, LATERAL (VALUES ('stream', '1 a' || chr(10) || '2 a' || chr(10) || '3 a' || chr(10) || chr(27) || '[1mc', NULL, 2), ('execute_result', '**h' || c_custkey || '**', NULL, 0),
      ('display_data', NULL, '<image: png 40×30, 0.0 KB>', 0), ('error', 'E: v' || chr(10) || 'red', NULL, 0)) AS u(type, text, image, suppressed)"""
)
def notebook_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = customers(spark, sf_dir, NOTEBOOK).withColumnRenamed("text", "body")
    return parse_each(own, ["k"], "body", lambda t: [(o[0], o[1], o[2], o[4]) for r in notebooks.cells_of("n", t)[0] for o in r[6]], "type string, text string, image string, suppressed int")


@query("SELECT c_custkey AS k, 1 AS idx FROM customer UNION ALL SELECT c_custkey, 3 FROM customer")
def notebook_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parse = lambda t: [(r[1], r[2], r[5]) for r in notebooks.cells_of("n", t)[0]]
    own = parse_each(customers(spark, sf_dir, NOTEBOOK), ["k"], "text", parse, "idx int, cell_type string, tags array<string>")
    return notebooks.filter_cells(own, notebooks.parse_slice("1:"), 4, code_only=True, tags=["a", "b"]).select("k", "idx")


# --- documents, images, trees, code

@query(
    """SELECT c_custkey AS k, '<root a="' || c_custkey || '"> (3 children)' || chr(10) || '  <b> ''t' || c_nationkey || '''' || chr(10) || '  <c />' || chr(10) || '  <d> (1 children)' || chr(10) || '    <e />' AS outline FROM customer"""
)
def xml_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir, '<root a="{k}"><b>t{n}</b><c/><d><e/></d></root>').select("k", shapes.xml_outlines(F.col("text")).alias("outline"))


@query(
    """SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN c_nationkey WHEN 1 THEN c_nationkey * 1024 WHEN 2 THEN (c_nationkey + 0.5) * 1048576 WHEN 3 THEN c_nationkey * 1073741824::BIGINT END::BIGINT AS n FROM customer"""
)
def size_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey") % 5, F.col("c_nationkey").cast("string")
    text = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(" KB"))).when(k == 2, F.concat(n, F.lit(".5mb"))).when(k == 3, F.concat(F.lit(" "), n, F.lit("Gb "))).otherwise("much")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), texts.size_bytes(text).alias("n"))


@query(
    """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'float' WHEN 2 THEN 'datetime' ELSE 'float' END AS kind FROM customer"""
)
def declared_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    declared = F.when(k == 0, "bigint").when(k == 1, "DECIMAL(3)").when(k == 2, "timestamp").otherwise("varchar")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), values.sql_kind(declared, F.when(k == 3, "float").otherwise("mixed")).alias("kind"))


CODE = (
    'import os, sys as s\nfrom ..a import b, c\nLIMIT = {k}\nx: int = 2\nNAME: str = "n"\n\n@mark\ndef f(a, /, b=1, *c, d: int = {n}, **e) -> str:\n    """Doc."""\n\n'
    'async def g(): ...\n\nclass K(Base, metaclass=M):\n    """About {k}."""\n    def m(self): ...\n'
)


@query(
    """SELECT CASE WHEN c_custkey % 3 = 0 THEN 'b' ELSE 'a' || c_custkey END || '.' || CASE WHEN c_custkey % 5 = 0 THEN 'sql' ELSE 'py' END AS path, c_custkey AS k,
      CASE WHEN c_custkey % 5 = 0 THEN 'sql' ELSE 'python' END AS language, 15::BIGINT AS lines, CASE WHEN c_custkey % 5 <> 0 THEN 'os,sys,..a' ELSE '' END AS imports,
      CASE WHEN c_custkey % 5 <> 0 THEN 'def f(a, /, b=1, *c, d: int=' || c_nationkey || ', **e) -> str|async def g()' ELSE '' END AS functions,
      CASE WHEN c_custkey % 5 <> 0 THEN 'K(Base):About ' || c_custkey || '.:def m(self)' ELSE '' END AS classes, CASE WHEN c_custkey % 5 <> 0 THEN 'LIMIT,NAME' ELSE '' END AS constants FROM customer"""
)
def python_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    path = F.concat(F.when(F.col("c_custkey") % 3 == 0, "b").otherwise(filled("a{k}", k="c_custkey")), F.when(F.col("c_custkey") % 5 == 0, ".sql").otherwise(".py"))
    own = c.select(F.concat_ws("/", F.col("c_custkey").cast("string"), path).alias("path"), filled(CODE, k="c_custkey", n="c_nationkey").alias("text"))
    found = pycode.index_texts(own)
    k, name = F.substring_index("path", "/", 1).cast("long"), F.substring_index("path", "/", -1)
    heads = F.transform("classes", lambda x: F.concat_ws(":", F.concat(x["name"], F.lit("("), F.array_join(x["bases"], ","), F.lit(")")), x["docstring"], F.array_join(F.transform(x["methods"], lambda m: m["signature"]), "|")))
    return found.select(
        name.alias("path"), k.alias("k"), "language", "lines", F.array_join(F.transform("imports", lambda i: i["module"]), ",").alias("imports"),
        F.array_join(F.transform("functions", lambda f: f["signature"]), "|").alias("functions"), F.array_join(heads, ",").alias("classes"), F.array_join("constants", ",").alias("constants"),
    )


@query("SELECT count(*) AS files, sum(2 + c_custkey % 3)::BIGINT AS lines FROM customer")
def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("a\nb\n"), F.repeat(F.lit("c\n"), (F.col("c_custkey") % 3).cast("int")))
    own = table(spark, sf_dir, "customer").select(filled("f{k}.md", k="c_custkey").alias("path"), text.alias("text"))
    return pycode.index_totals(pycode.index_texts(own))


@query("SELECT c_custkey AS k, 'Ann' AS who, c_custkey % 2 = 1 AS error FROM customer")
def python_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("c_custkey") % 2 == 1, "def (:\n").otherwise("def f(): pass\n")
    found = pycode.index_texts(table(spark, sf_dir, "customer").select(filled("{k}.py", k="c_custkey").alias("path"), text.alias("text")))
    return found.select(F.substring_index("path", ".", 1).cast("long").alias("k"), F.lit("Ann").alias("who"), F.col("error").isNotNull().alias("error"))


@query("SELECT CASE c_custkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'c++' WHEN 2 THEN 'yaml' END AS language, count(*) AS n FROM customer WHERE c_custkey % 4 <> 3 GROUP BY 1")
def lang_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, [".py", ".CPP", ".yml", ".none"])), (F.col("c_custkey") % 4 + 1).cast("int"))
    return files.language_histogram(table(spark, sf_dir, "customer").select(F.concat(F.lit("d.d/"), "c_name", ext).alias("path")))


@query(
    """SELECT c_custkey AS k, c_custkey % 8 IN (0, 1, 2, 4) AS ignored FROM customer"""
)
def tree_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ["a/node_modules/x.js", "logs/{k}.txt", "{k}.tmp", "src/logs", "a/build", "keep.tmp", "src/{k}.py", "docs/a/b.md"]
    path = F.element_at(F.array(*(filled(p, k="c_custkey") for p in paths)), (F.col("c_custkey") % 8 + 1).cast("int"))
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), path.alias("path"), (F.col("c_custkey") % 8 == 3).alias("file"))
    rules = files.Ignore.of(["*.t[am]p", "!keep.tmp", "!build", "logs/", "/docs/*.md"])
    return own.select("k", rules.column(F.col("path"), F.lit(False)).alias("ignored"))


@query(
    """SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'empty' WHEN 1 THEN 'large,recent' ELSE 'binary' END AS flags, CASE c_custkey % 3 WHEN 0 THEN '0 B' WHEN 1 THEN '2.0 MB' ELSE '1.0 KB' END AS size FROM customer"""
)
def tree_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    size, at = F.when(k == 0, 0).when(k == 1, 2 << 20).otherwise(1024).cast("long"), F.when(k == 1, 990_000).otherwise(1)
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(False).alias("is_dir"), size.alias("size"), at.alias("mtime"), (k == 2).alias("is_binary"))
    return repo.annotate(own, 1_000_000).select("k", F.array_join("flags", ",").alias("flags"), F.col("size_text").alias("size"))


@query(
    """SELECT c_custkey AS k, c_custkey::INT AS width, c_nationkey + 1 AS height, CASE c_custkey % 2 WHEN 0 THEN 'RGB' ELSE 'P' END AS mode, CASE c_custkey % 2 WHEN 0 THEN 'PNG' ELSE 'GIF' END AS format FROM customer WHERE c_custkey < 65536"""
)
def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("c_custkey"), F.col("c_nationkey") + 1
    big = lambda x: F.unhex(F.lpad(F.hex(x), 8, "0"))
    little = lambda x: F.unhex(F.concat(F.lpad(F.hex(x % 256), 2, "0"), F.lpad(F.hex(F.floor(x / 256)), 2, "0")))
    bytes_ = lambda s: F.unhex(F.lit(s))
    png = F.concat(bytes_("89504E470D0A1A0A0000000D49484452"), big(w), big(h), bytes_("0802000000"))
    gif = F.concat(bytes_("474946383961"), little(w), little(h), bytes_("F70000"))
    own = table(spark, sf_dir, "customer").where("c_custkey < 65536").select(F.col("c_custkey").alias("k"), F.when(w % 2 == 0, png).otherwise(gif).alias("data"))
    return parse_each(own, ["k"], "data", lambda b: [documents.image_info(bytes(b))], "width int, height int, mode string, format string")


WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


@query("SELECT n_nationkey AS k, '# ' || n_name || chr(10) || chr(10) || 'one two ' || n_regionkey || chr(10) || chr(10) || '- item' AS markdown FROM nation")
def office_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda style, text: f"<w:p>{style}<w:r><w:t>{text}</w:t></w:r></w:p>"
    heading, item = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>', "<w:pPr><w:numPr/></w:pPr>"
    xml = f'<w:document xmlns:w="{WORD}"><w:body>{p(heading, "{name}")}{p("", "one two {r}")}{p(item, "item")}</w:body></w:document>'
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), filled(xml, name="n_name", r="n_regionkey").alias("text"))

    def parse(text: str) -> list[tuple]:
        with zipfile.ZipFile(held := BytesIO(), "w") as z:
            z.writestr("word/document.xml", text)
        return [(documents.docx(held),)]

    return parse_each(own, ["k"], "text", parse, "markdown string")


@query("SELECT c_custkey AS k, 'words and more of a line that is long enough ' || c_custkey || ' goes on.' || chr(10) || 'fine next' AS text FROM customer")
def pdf_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = customers(spark, sf_dir, "words and mo-\nre of a line that is long enough {k}\r\ngoes on.  \nﬁne\x00 next\n\n\n").withColumnRenamed("text", "raw")
    return parse_each(own, ["k"], "raw", lambda t: [(documents.joined_paragraphs(documents.clean_page(t)),)], "text string")


@query("SELECT c_custkey AS k, '1,2,3,' || (c_nationkey + 7) AS pages FROM customer")
def pdf_page_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = customers(spark, sf_dir, "1-3,x,{p},2,99", p=F.col("c_nationkey") + 7)
    return parse_each(own, ["k"], "text", lambda t: [(",".join(map(str, documents.page_set(t, 40))),)], "pages string")


@query("SELECT c_custkey AS k, 'a' || c_custkey || ' c' AS words, (60 + c_nationkey + 40) / 2 AS confidence FROM customer")
def word_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = customers(spark, sf_dir, "a{k}:{p},b:29, :90,c:40", p=F.col("c_nationkey") + 60)
    parse = lambda t: [documents.mean_confidence([(w, float(c)) for w, c in (x.split(":") for x in t.split(","))])]
    return parse_each(own, ["k"], "text", parse, "words string, confidence double")


# --- pages, responses and statements

@query(
    """SELECT c_custkey AS k, '# H ' || c_custkey || chr(10) || chr(10) || 'a [t](https://h/d/p' || c_custkey || ') **b**' || chr(10) || chr(10) || '- x' || chr(10) || '- y' || chr(10) || chr(10) || '| c   |' || chr(10) || '|-----|' || chr(10) || '| 1   |' AS markdown FROM customer"""
)
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '<h1>H {k}</h1><p>a <a href="p{k}">t</a> <b>b</b><img src=i></p><ul><li><a href="/m">menu</a></li></ul><ul><li>x<li>y</ul><table><tr><th>c</th></tr><tr><td>1</td></tr></table>'
    return parse_each(customers(spark, sf_dir, text), ["k"], "text", lambda t: [(html.markdown(html.tree(t), "https://h/d/"),)], "markdown string")


@query(
    """SELECT c_custkey AS k, 200 AS status, CASE c_custkey % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'xml' WHEN 2 THEN 'text' ELSE 'binary' END AS format,
      CASE WHEN c_custkey % 4 = 0 THEN '{a: integer, b: array[2] → integer}' END AS shape, CASE WHEN c_custkey % 4 = 0 THEN 2 END::BIGINT AS array_len,
      CASE c_custkey % 4 WHEN 1 THEN '<r> ''' || c_custkey || '''' WHEN 2 THEN 'line' || repeat(chr(10) || 'line', 49) WHEN 3 THEN '<binary: image/x, 0.0 KB>' END AS preview,
      CASE WHEN c_custkey % 4 = 2 THEN 10 ELSE 0 END::BIGINT AS suppressed_lines FROM customer"""
)
def http_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    kind = F.when(k == 0, "application/json").when(k == 1, "text/xml").when(k == 2, "text/plain").otherwise("image/x")
    body = F.when(k == 0, filled('{"a": {k}, "b": [1, 2]}', k="c_custkey")).when(k == 1, filled("<r>{k}</r>", k="c_custkey")).when(k == 2, F.lit("\n".join(["line"] * 60))).otherwise("x")
    none = F.array().cast("array<struct<name:string,value:string>>")
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("url"), F.lit(200).alias("status"), none.alias("headers"), kind.alias("content_type"), body.cast("binary").alias("body"))
    return tools.inspect_responses(own).select(F.col("url").cast("long").alias("k"), "status", "format", "shape", "array_len", "preview", F.col("suppressed_lines").cast("long").alias("suppressed_lines"))


@query("SELECT c_custkey AS k, c_custkey % 5 < 3 AS ok FROM customer")
def page_downloadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["Text/HTML; charset=x", "text/plain", "application/xhtml+xml", "image/png", "application/pdf"]))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), web.is_downloadable(F.element_at(kinds, (F.col("c_custkey") % 5 + 1).cast("int"))).alias("ok"))


@query("SELECT c_custkey AS k, c_nationkey % 2 = 1 OR c_custkey % 3 <> 0 AS allowed FROM customer")
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    path = F.when(F.col("c_custkey") % 3 == 0, "/no/x").otherwise("/yes")
    urls = c.select(F.concat(filled("http://h{n}", n="c_nationkey"), path, F.lit("?k="), F.col("c_custkey").cast("string")).alias("url"))
    robots = table(spark, sf_dir, "nation").select(filled("h{n}", n="n_nationkey").alias("host"), F.when(F.col("n_nationkey") % 2 == 0, "User-agent: *\nDisallow: /no").alias("text"))
    return allowed(urls, robots).select(F.substring_index("url", "=", -1).cast("long").alias("k"), "allowed")


@query("SELECT 'http://h' || c_nationkey || '/' || lpad(c_custkey::VARCHAR, 9, '0') AS url, 2.0 * (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::DOUBLE AS wait FROM customer")
def fetch_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "customer").select(F.concat(filled("http://h{n}/", n="c_nationkey"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("url"))
    return spaced(urls, 2.0).select("url", F.col("wait").cast("double").alias("wait"))


@query("SELECT count(*) AS entries, sum(CASE WHEN page_id % 4 = 0 THEN 3 ELSE strlen(html) END)::BIGINT AS bytes, max(CASE WHEN page_id % 4 = 0 THEN 500 ELSE 1000 END)::BIGINT AS oldest_age FROM (SELECT * FROM pages WHERE page_id % 3 <> 0)")
def page_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("url"), "html")
    cache = PageCache(spark, new_folder(spark, "cache"))
    cache.put(pages.select("url", "html"), 1000)
    cache.put(pages.where("page_id % 4 = 0").select("url", F.lit("new").alias("html")), 1500)
    cache.delete(pages.where("page_id % 3 = 0").select("url"), 1600)
    cache.compact()
    return cache.stats(2000)


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN html END AS html FROM pages")
def page_cache_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("url"), "html")
    cache = PageCache(spark, new_folder(spark, "cache"), ttl=600)
    cache.put(pages.select("url", "html"), 1000)
    cache.put(pages.where("page_id % 4 = 0").select("url", "html"), 1500)
    return cache.get(pages.select("page_id", "url"), 2000).select("page_id", "html")


STATEMENTS = [
    ("SELECT * FROM t{k}", True), ("  -- note\nselect 1;", True), ("/* a */ WITH a(x) AS (SELECT ')' AS x), b AS (SELECT 1) SELECT * FROM a", True), ("WITH RECURSIVE r AS (SELECT {k}) SELECT * FROM r", True),
    ("DROP TABLE t{k}", False), ("SELECT 1; SELECT 2", False), ("", False), ("WITH a AS (SELECT 1) DELETE FROM a", False), ("SELECT ';'", False), ("PRAGMA x", False), ("INSERT INTO t SELECT {k}", False), ("EXPLAIN SELECT 1", False),
]


@query(f"SELECT c_custkey AS k, c_custkey % {len(STATEMENTS)} IN ({', '.join(str(i) for i, (_, ok) in enumerate(STATEMENTS) if ok)}) AS accepted FROM customer")
def sql_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*(filled(s, k="c_custkey") if s else F.lit("") for s, _ in STATEMENTS)), (F.col("c_custkey") % len(STATEMENTS) + 1).cast("int"))

    def parse(statement: str) -> list[tuple]:
        try:
            check_select(statement)
            return [(True,)]
        except DigestError:
            return [(False,)]

    return parse_each(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), text.alias("text")), ["k"], "text", parse, "accepted boolean")


@query("SELECT c_custkey AS k, c_custkey % 3 = 0 OR c_custkey % 2 = 1 AS accepted FROM customer")
def sql_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    def parse(k: int) -> list[tuple]:
        try:
            check_options(None if k % 2 else "SELECT 1", table=None if k % 3 == 0 else "t")
            return [(True,)]
        except DigestError:
            return [(False,)]

    return parse_each(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("key")), ["k"], "key", parse, "accepted boolean")


# --- logs of tests and training

@query(
    """SELECT event_id AS line_number, CASE event_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'error' ELSE 'info' END AS category FROM events WHERE event_id % 5 <> 2
    UNION ALL SELECT event_id, 'warning' FROM events WHERE event_id % 5 = 2"""
)
def log_parse_pytest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    raw = F.when(k == 0, filled("FAILED t.py::test_{k} - boom", k="event_id")).when(k == 1, "ERROR t.py::test_x - setup").when(k == 2, "WARNINGS: 3 old").when(k == 3, "PASSED t.py::ok").otherwise("collected 3 items")
    own = table(spark, sf_dir, "events").select(F.lit("p").alias("source"), F.col("event_id").alias("line_number"), raw.alias("raw"))
    return logs.parse_lines(own, "pytest").select("line_number", "category")


@query("SELECT event_id AS line_number, 'FAILED t.py::test_' || event_id || ' - boom' AS message FROM events WHERE event_id % 5 = 0")
def log_key_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, filled("FAILED t.py::test_{k} - boom", k="event_id")).otherwise("all is well")
    own = table(spark, sf_dir, "events").select(F.lit("p").alias("source"), F.col("event_id").alias("line_number"), raw.alias("raw"))
    return logs.key_events(logs.parse_lines(own, "pytest").withColumn("suppressed", F.lit(False)), "pytest").select("line_number", "message")


@query("SELECT event_id AS line_number, CASE WHEN event_id % 4 < 3 THEN 'metric' ELSE 'info' END AS category FROM events")
def log_parse_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    raw = F.when(k == 0, filled("loss=0.{k}", k="event_id")).when(k == 1, "Epoch 3/9").when(k == 2, filled("STEP {k}", k="event_id")).otherwise("saved")
    own = table(spark, sf_dir, "events").select(F.lit("t").alias("source"), F.col("event_id").alias("line_number"), raw.alias("raw"))
    return logs.parse_lines(own, "training").select("line_number", "category")


@query("SELECT 'tests' AS source, 'pytest' AS log_format, 1.0::DOUBLE AS score")
def log_detect_pytest(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 2 == 0, filled("PASSED t.py::test_{k}", k="event_id")).otherwise("==== short test summary info ====")
    own = table(spark, sf_dir, "events").select(F.lit("tests").alias("source"), (F.col("event_id") + 1).alias("line_number"), raw.alias("raw"))
    return logs.detect_formats(own).select("source", "log_format", "score")
