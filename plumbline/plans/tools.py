"""The library's fourteen tools: each reads its input, runs a plan and renders what is left."""

from __future__ import annotations

import re
import sys
import time
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadInput, DigestError, FetchError, NotFound
from ..functions import web
from ..functions.shapes import json_digests, xml_outlines
from ..functions.text import UNITS, age
from ..functions.values import sql_kind
from ..operators import deps, html, logs, repo
from ..operators.profile import Options, head_tail, pick_columns, text_profile, to_cells, top_values, typed_profile
from ..sources import documents, files, git, lines, manifests, notebooks, pycode, specs, tabular
from ..sources.cache import PageCache, allowed
from . import render
from .sqlguard import check_options

FORMAT_HINTS = {"pytest": "pytest", "python": "python_logging", "training": "training", "json": "json_lines", "webserver": "webserver", "generic": "generic"}


def rows(df: DataFrame) -> list[dict]:
    """A small result as dictionaries."""
    return [r.asDict(recursive=True) for r in df.collect()]


def extract_pdf_text(pdf_path: str, pages: str | None = None, force_ocr: bool = False) -> str:
    return "\n\n".join(f"<!-- page {k} -->\n\n{text}" for k, text in documents.read_pdf(pdf_path, pages, force_ocr))


def index_codebase(spark: SparkSession, repo_path: str = ".", detail: str = "normal", format: str = "markdown", include_extensions: list[str] | None = None, exclude_patterns: list[str] | None = None) -> str:
    extensions = tuple("." + e.lower().lstrip(".") for e in include_extensions or ())
    index, skipped = pycode.index_folder(spark, repo_path, extensions, tuple(exclude_patterns or ()))
    own = rows(index)
    digest = {"root": str(repo_path), "file_count": len(own), "lines": sum(f["lines"] for f in own), "files": own, "skipped": skipped}
    return render.index(digest, format, detail)


def moment(text: str, now: float) -> float:
    """A time such as 7d (ago) or 2025-01-31, in seconds."""
    for unit in sorted(UNITS, key=len, reverse=True):
        if text.endswith(unit) and text[: -len(unit)].isdigit():
            return now - int(text[: -len(unit)]) * UNITS[unit]
    try:
        return datetime.fromisoformat(text).timestamp()
    except ValueError as e:
        raise BadInput(f"neither a duration nor a date: {text}") from e


def size_of(text: str) -> int:
    """Bytes of a text such as 500, 10KB or 1.5MB."""
    m = re.fullmatch(r"\s*([0-9.]+)\s*(B|KB|MB|GB)?\s*", text.upper())
    try:
        return int(float(m[1]) * {None: 1, "B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}[m[2]])
    except (TypeError, ValueError) as e:
        raise BadInput(f"not a size: {text}") from e


def smart_file_tree(
    spark: SparkSession, path: str | None = None, depth: int | None = None, format: str = "tree", focus: str | None = None, modified_after: str | None = None,
    exclude_patterns: list[str] | None = None, include_extensions: list[str] | None = None, sort: str = "alpha", dotfiles: bool = False, now: float | None = None,
    modified_before: str | None = None, min_size: str | None = None, max_size: str | None = None, dirs_only: bool = False, files_only: bool = False,
    no_gitignore: bool = False, max_files: int = 50,
) -> str:
    root, now = Path(path or "."), time.time() if now is None else now
    if not root.exists():
        raise NotFound(f"no such folder: {root}")
    glob = focus if focus and any(c in focus for c in "*?") else None
    if focus and not glob:
        root = root / focus
    ignore = files.Ignore(root, gitignore=not no_gitignore, extra=tuple(exclude_patterns or ()))
    nodes = files.tree(spark, root, ignore=ignore, max_depth=depth, dotfiles=dotfiles, cap=None)
    since, until = (moment(x, now) if x else None for x in (modified_after, modified_before))
    least, most = (size_of(x) if x else None for x in (min_size, max_size))
    kind = "dirs" if dirs_only else "files" if files_only or glob else None
    kept = repo.filter_nodes(nodes, since=since, until=until, min_size=least, max_size=most, extensions=include_extensions, focus=glob, kind=kind)
    shown = repo.annotate(repo.limit_children(kept, max_files), int(now)).join(repo.roll_up(nodes).select("path", "n_files"), "path", "left")
    totals = rows(repo.tree_totals(kept, int(now)))[0]
    return render.tree({"root": str(root), "nodes": rows(shown), **totals}, "compact" if kind == "files" and format == "tree" else format, sort)


def fetch_url(spark: SparkSession, url: str, html_text: str | None = None, content_type: str = "text/html", include_links: bool = True, format: str = "markdown") -> str:
    """A page's main content. The page comes from the caller: the library doesn't reach the network."""
    one = spark.createDataFrame([(url, html_text, content_type)], "url string, html string, type string")
    about = one.select(web.normal_url(F.col("url")).alias("url"), web.is_downloadable(F.col("type")).alias("ok"), web.needs_script(F.col("html")).alias("script")).first()
    if about.url is None:
        raise BadInput(f"not an http(s) URL: {url!r}")
    if html_text is None:
        raise FetchError("pages are fetched by the caller; pass html_text")
    if not about.ok:
        raise BadInput(f"can't extract text from {content_type}")
    page = html.extract(html_text, about.url, include_links) | {"url": about.url}
    page["warnings"] = page["warnings"] + ["the page may need scripts to show its content"] * bool(about.script)
    return render.page(page, format)


def fetch_pages(pages: DataFrame, now: int, cache: PageCache | None = None, robots: DataFrame | None = None, include_links: bool = True) -> DataFrame:
    """url, error, from_cache, title, author, date, content_markdown, warnings of a table of pages that the caller has fetched:
    url, html (null: couldn't be had), content_type.

    Every URL has a row: what fails says why and stops no other. Robots' rules (host, text) apply to pages
    that aren't kept; pages come from the cache where it has them, and new ones go into it.
    """
    own = pages.select(web.normal_url(F.col("url")).alias("_url"), F.col("url").alias("given"), "html", "content_type")
    own = own.withColumnRenamed("_url", "url")
    if cache is not None:
        kept = cache.get(own.select("url").where("url IS NOT NULL").distinct(), now).select("url", F.col("html").alias("_kept"))
        own = own.join(kept, "url", "left")
    else:
        own = own.withColumn("_kept", F.lit(None).cast("string"))
    may = allowed(own.select("url").where("url IS NOT NULL").distinct(), robots).select("url", "allowed") if robots is not None else None
    own = own.join(may, "url", "left") if may is not None else own.withColumn("allowed", F.lit(True))
    error = (
        F.when(F.col("url").isNull(), "not an http(s) URL").when(F.col("_kept").isNotNull(), None).when(~F.coalesce("allowed", F.lit(True)), "robots don't allow it")
        .when(F.col("html").isNull(), "the page couldn't be had").when(~web.is_downloadable(web.content_type(F.col("content_type"))), F.concat(F.lit("can't extract text from "), "content_type"))
    )
    own = own.withColumns({"error": error, "from_cache": F.col("_kept").isNotNull()}).withColumn("html", F.when(F.col("error").isNull(), F.coalesce("_kept", "html")))
    if cache is not None:
        cache.put(own.where("error IS NULL AND NOT from_cache").select("url", "html"), now)
    done = html.extract_pages(own.where("error IS NULL"), links=include_links).select("url", "given", "error", "from_cache", "page.*")
    about = ["title", "author", "date", "content_markdown", "warnings"]
    failed = own.where("error IS NOT NULL").select("url", "given", "error", "from_cache")
    return done.unionByName(failed, allowMissingColumns=True).select(F.coalesce("url", "given").alias("url"), "error", "from_cache", *about)


def log_digest(spark: SparkSession, source: DataFrame, name: str, format_hint: str | None = None, errors_only: bool = False, max_errors: int = 50, max_warnings: int = 20, max_tracebacks: int = 10, max_metrics: int = 30, max_frames: int = 5, threshold: int = 3) -> dict:
    """The digest of one source's lines."""
    if format_hint and format_hint not in FORMAT_HINTS:
        raise BadInput(f"unknown format {format_hint!r}")
    best = logs.detect_formats(source).first()
    kind = FORMAT_HINTS[format_hint] if format_hint else best.log_format if best else "generic"
    marked = logs.suppressed_lines(logs.parse_lines(source, kind), threshold)
    total = logs.overflow(marked, max_errors, max_warnings).first()
    blank = {"total_lines": 0, "suppressed_lines": 0, "overflow_errors": 0, "overflow_warnings": 0}
    out = {"source": name, "format": kind, **({k: total[k] for k in blank} if total else blank)}
    pick = lambda c, cap: rows(logs.capped(marked, c, cap).select("line_number", "message", "level", "timestamp").orderBy("line_number"))
    out["errors"], out["warnings"] = pick("error", max_errors), [] if errors_only else pick("warning", max_warnings)
    out["overflow_warnings"] = 0 if errors_only else out["overflow_warnings"]
    out["tracebacks"] = rows(logs.tracebacks(source, max_frames).orderBy("start_line").limit(max_tracebacks))
    out["groups"] = rows(logs.repeat_groups(marked, threshold).orderBy(F.desc("count"), "first_line").drop("source"))
    out["key_events"] = rows(logs.key_events(marked, kind).select("line_number", "message").orderBy("line_number"))
    out["metrics"] = []
    if kind == "training" and not errors_only:
        found = logs.metrics(marked.where("NOT suppressed AND category = 'metric'").select("source", "line_number", "raw"))
        out["metrics"] = rows(found.orderBy("line_number", "place").limit(max_metrics).drop("source"))
        odd = rows(logs.metric_anomalies(found, max_metrics).select("line_number", "message", "level").orderBy("line_number"))
        out["errors"] += [{**a, "timestamp": None} for a in odd[: max(0, max_errors - len(out["errors"]))]]
    return out


def summarize_log(
    spark: SparkSession, path: str, format_hint: str | None = None, errors_only: bool = False, tail: int | None = None, head: int | None = None, format: str = "markdown",
    max_errors: int = 50, max_warnings: int = 20, max_tracebacks: int = 10, max_metrics: int = 30, max_frames: int = 5, no_dedup: bool = False, dedup_threshold: int = 3,
    pattern: str = "*.log", recursive: bool = False,
) -> str:
    """A log's digest; `-` is the standard input, and of a folder each file that matches has one."""
    caps = {"max_errors": max_errors, "max_warnings": max_warnings, "max_tracebacks": max_tracebacks, "max_metrics": max_metrics, "max_frames": max_frames, "threshold": 1 << 30 if no_dedup else dedup_threshold}
    if path == "-":
        source, name = lines.lines_of(spark, sys.stdin.read()), "stdin"
    elif Path(path).is_dir():
        return "\n".join(summarize_logs(spark, path, pattern, recursive, format=format, format_hint=format_hint, errors_only=errors_only))
    elif not Path(path).exists():
        raise NotFound(f"File not found: {path}")
    else:
        source, name = lines.read_lines(spark, path), path
    return render.log(log_digest(spark, lines.window_of(source, head, tail), name, format_hint, errors_only, **caps), format)


def summarize_logs(spark: SparkSession, folder: str, pattern: str = "*.log", recursive: bool = False, **options) -> list[str]:
    return [summarize_log(spark, str(p), **options) for p in lines.log_files(Path(folder), pattern, recursive)]


def git_file_context(spark: SparkSession, file_path: str, base: str | None = None, commits: int = 10, no_blame: bool = False, now: int | None = None, format: str = "markdown") -> str:
    root = git.root_of(file_path)
    path = Path(file_path).resolve().relative_to(root.resolve()).as_posix()
    now = int(time.time()) if now is None else now
    if not git.is_tracked(root, path):
        raise BadInput(f"{path} isn't tracked")
    own = git.commits(spark, root, commits, path)
    against = git.base_of(root, base)
    changed, text = git.diff(spark, root, against, "--", path)
    cut = rows(repo.within_budget(text, "path", ["hunk", "place"]).orderBy("hunk", "place"))
    touched = git.commits(spark, root, 200).select(F.col("hash").alias("commit"), F.explode("files").alias("path"))
    d = {
        "path": path, "branch": git.facts(root)["branch"], "base": against, "commits": _aged(own, now), "diff": cut, "diff_cut": any(x["cut"] for x in cut),
        "related": rows(repo.related_files(touched, path)), "authors": [], "ages": {}, "changes": rows(changed),
    }
    if not no_blame:
        blame = git.blame(spark, root, path)
        d["authors"] = rows(repo.author_shares(blame).orderBy(F.desc("lines"), "author"))
        d["ages"] = rows(repo.age_histogram(blame, now))[0]
    return render.file_history(d, format)


def _aged(commits: DataFrame, now: int) -> list[dict]:
    at = F.unix_timestamp(F.to_timestamp("at"))
    return rows(commits.withColumn("age", age(F.lit(now) - at)).select("hash", "short_hash", "author", "subject", "body", "files", "insertions", "deletions", "age"))


def git_repo_context(spark: SparkSession, repo_path: str = ".", commits: int = 10, now: int | None = None, format: str = "markdown") -> str:
    root, now = git.root_of(repo_path), int(time.time()) if now is None else now
    own = git.commits(spark, root, commits)
    touched = own.select(F.col("hash").alias("commit"), F.explode("files").alias("path"))
    status = git.parse_status(git.git(root, "status", "--porcelain=v2", "--branch"))
    changes, text = _uncommitted(spark, root)
    cut = rows(repo.within_budget(text.withColumn("all", F.lit(1)), "all", ["part", "path", "hunk", "place"]).orderBy("part", "path", "hunk", "place"))
    d = {
        "root": str(root), "status": status, "in_progress": git.in_progress(root), "commits": _aged(own, now), "active": rows(repo.active_files(touched)), **git.facts(root),
        "changes": rows(changes.orderBy("part", "path")), "diff": cut, "diff_cut": any(x["cut"] for x in cut),
    }
    return render.repo_history(d, format)


def _uncommitted(spark: SparkSession, root: Path) -> tuple[DataFrame, DataFrame]:
    """Files and lines of what isn't committed, with part: staged, or changed beside that."""
    staged, staged_lines = git.diff(spark, root, "--cached")
    head = git.git(root, "rev-parse", "--verify", "--quiet", "HEAD", check=False).strip()
    whole, whole_lines = git.diff(spark, root, "HEAD") if head else git.diff(spark, root)
    files_ = repo.uncommitted(staged, whole)
    rest = whole_lines.join(staged.select("path"), "path", "left_anti")
    return files_, staged_lines.withColumn("part", F.lit("staged")).unionByName(rest.withColumn("part", F.lit("unstaged")))


def table_digest(t: tabular.Table, options: Options, stats: bool = True) -> dict:
    """Columns, samples and notes of one table."""
    names = pick_columns(t.columns, options)
    cells = "raw" in t.rows.columns and "col_ord" in t.rows.columns and t.columns and "raw" not in t.columns
    kept = t.rows if options.max_rows is None else t.rows.where(F.col("row_id") <= options.max_rows)
    seen = t.row_count if cells else kept.agg(F.count(F.lit(1))).first()[0]
    whole = t.row_count if t.row_count is not None else t.rows.agg(F.count(F.lit(1))).first()[0]
    if not names:
        columns = []
    elif cells:
        bound = min(whole, options.max_rows or whole)
        columns = rows(text_profile(kept.where(F.col("column").isin(names)), options, bound).orderBy("col_ord"))
    elif t.text:
        profiled = text_profile(to_cells(kept, "row_id", names), options)
        if t.declared:
            known = F.create_map(*(F.lit(x) for pair in t.declared.items() for x in pair))
            profiled = profiled.withColumn("dtype", sql_kind(F.try_element_at(known, F.col("column")), F.col("dtype")))
        columns = rows(profiled.orderBy("col_ord"))
    else:
        place = {n: k for k, n in enumerate(names)}
        columns = sorted(rows(typed_profile(kept.select(*(f"`{n}`" for n in names)), options)), key=lambda c: place[c["column"]])
    wide = kept.groupBy("row_id").pivot("column", names).agg(F.first("raw")) if cells and names else kept
    frequent = [c["column"] for c in columns if c["dtype"] not in ("int", "float", "datetime", "null")] if stats else []
    top: dict[str, list] = {}
    if frequent:
        for r in rows(top_values(wide, frequent, options.top_k, F.col("row_id")).orderBy("column", "rank")):
            top.setdefault(r["column"], []).append((r["value"], r["n"]))
    sample = rows(head_tail(wide, "row_id", options.head, options.tail).orderBy("row_id")) if names else []
    part = lambda p: [{n: r[n] for n in names} for r in sample if r["part"] == p]
    return {
        "name": t.name, "row_count": whole, "truncated": bool(options.max_rows and whole > options.max_rows), "columns": columns, "top_values": top,
        "head": part("head"), "tail": part("tail"), "notes": t.notes, "rows_seen": seen,
    }


def summarize_data(
    spark: SparkSession, path: str, format_hint: str | None = None, table: str | None = None, sample: int = 5, columns: list[str] | None = None, no_stats: bool = False,
    max_rows: int | None = 100_000, query: str | None = None, median: bool = False, format: str = "markdown", head: int | None = None, tail: int | None = None,
    max_distinct: int = 100, top_k: int = 5, max_columns: int = 50, max_cell_width: int = 80, all_tables: bool = False, max_tables: int = 20,
    globs: str = "*", recursive: bool = False,
) -> str:
    """A data file's digest; of a folder each file that matches one of the globs has one. head and tail go before sample."""
    at = Path(path)
    check_options(query, table=table, columns=columns, all_tables=all_tables)
    if path == "-":
        raise BadInput("tables are read from files, not from the standard input")
    if not at.exists():
        raise NotFound(f"File not found: {path}")
    if at.is_dir() and not format_hint and at.suffix.lower() not in tabular.EXTENSIONS:  # a folder of part files is one table
        same = {"sample": sample, "columns": columns, "no_stats": no_stats, "max_rows": max_rows, "median": median, "head": head, "tail": tail, "max_distinct": max_distinct, "top_k": top_k, "max_columns": max_columns, "max_cell_width": max_cell_width, "all_tables": all_tables, "max_tables": max_tables}
        done, warnings = summarize_folder(spark, path, globs, recursive, format, **same)
        return "\n".join([*done, *(f"> {w}" for w in warnings)])
    kind = {"xlsx": "excel"}.get(format_hint or "", format_hint) or tabular.detect(at)
    options = Options(
        head=sample if head is None else head, tail=sample if tail is None else tail, max_rows=max_rows, columns=tuple(columns) if columns else None, median=median,
        max_distinct=max_distinct, top_k=top_k, max_columns=max_columns, max_tables=1 << 30 if all_tables else max_tables,
    )
    if query is not None and kind != "sqlite":
        raise BadInput("a query needs an SQLite file")
    names, warnings, structures, found = [table] if table else None, [], [], []
    if kind in ("csv", "tsv"):
        found = [tabular.read_csv(spark, at, "," if kind == "csv" else "\t")]
    elif kind == "jsonl":
        found = [tabular.read_jsonl(spark, at)]
    elif kind == "json":
        one, structures = tabular.read_json(spark, at, options.max_json_bytes)
        found = [one] if one else []
    elif kind == "parquet":
        found = [tabular.read_parquet(spark, at)]
    elif kind == "sqlite":
        found, warnings = tabular.read_sqlite(spark, at, names, query, options.max_tables)
    elif kind == "excel":
        found, warnings = tabular.read_excel(spark, at, names, options.max_tables)
    else:
        raise BadInput(f"unknown format {kind!r}")
    d = {"source": path, "format": kind, "bytes": at.stat().st_size, "tables": [table_digest(t, options, not no_stats) for t in found], "structures": structures, "warnings": warnings}
    return render.data(d, format, max_cell_width)


def summarize_folder(spark: SparkSession, folder: str, globs: str = "*", recursive: bool = False, format: str = "markdown", **options) -> tuple[list[str], list[str]]:
    """Digests of a folder's data files that match comma-separated globs and no ignore rule, and warnings of those that
    can't be read."""
    done, warnings = [], []
    for path in tabular.data_files(Path(folder), globs, recursive):
        try:
            done.append(summarize_data(spark, str(path), format=format, **options))
        except (DigestError, ValueError) as e:
            warnings.append(f"{path.name}: {e}")
    return done, warnings


def inspect_dependencies(
    spark: SparkSession, path: str, ecosystem: str | None = None, no_dev: bool = False, direct_only: bool = False, severity: list[str] | None = None,
    latest: DataFrame | None = None, advisories: DataFrame | None = None, details: DataFrame | None = None, format: str = "markdown",
    latest_file: str | None = None, advisories_file: str | None = None,
) -> str:
    """A project's packages. What registries and advisory services know comes from the caller as tables: latest
    (ecosystem, name, latest), advisories (ecosystem, name, vuln_id) and details (vuln_id, text)."""
    if latest_file:  # lines of JSON: ecosystem, name, latest
        latest = spark.read.schema("ecosystem string, name string, latest string").json(latest_file)
    if advisories_file:  # lines of JSON: ecosystem, name, vuln_id, and the advisory as advisory
        told = spark.read.text(advisories_file).where("trim(value) <> ''").select(F.parse_json("value").alias("v"))
        field = lambda n: F.variant_get("v", f"$.{n}", "string").alias(n)
        advisories = told.select(field("ecosystem"), field("name"), field("vuln_id"))
        details = told.select(field("vuln_id"), F.to_json(F.variant_get("v", "$.advisory", "variant")).alias("text")).dropDuplicates(["vuln_id"])
    declared, lock, edges, notes = manifests.read_project(spark, path)
    own = deps.resolve(declared, lock, edges, not no_dev, direct_only)
    own = own.where(F.col("ecosystem") == ecosystem) if ecosystem else own
    own = deps.with_latest(own, latest) if latest is not None else own
    every = rows(own.orderBy("ecosystem", "name"))
    top = rows(deps.top_transitives(own).orderBy("ecosystem", "rank"))
    ecosystems = {}
    for eco in sorted({r["ecosystem"] for r in every}):
        mine = [r for r in every if r["ecosystem"] == eco]
        direct = [r for r in mine if r["direct"]]
        ecosystems[eco] = {"direct": direct, "transitive_count": len(mine) - len(direct), "top_transitives": [t for t in top if t["ecosystem"] == eco]}
    found = []
    if advisories is not None and details is not None:
        known = advisories.join(own.select("ecosystem", "name"), ["ecosystem", "name"], "left_semi")
        found = rows(deps.by_severity(deps.normal_advisories(known, details), severity))
    return render.dependencies({"source": path, "ecosystems": ecosystems, "advisories": found, "notes": notes}, format)


def extract_notebook(
    spark: SparkSession, path: str, cells: str | None = None, code_only: bool = False, markdown_only: bool = False, tags: list[str] | None = None,
    no_outputs: bool = False, max_output_lines: int = 30, format: str = "markdown",
) -> str:
    own, info = notebooks.read_notebook(spark, path, max_lines=max_output_lines, outputs=not no_outputs)
    within = notebooks.parse_slice(cells) if cells else None
    kept = notebooks.filter_cells(own, within, info["total"], code_only, markdown_only, tags)
    return render.notebook({"source": path, **info, "cells": rows(kept.orderBy("idx"))}, format)


def extract_document(path: str, max_chars: int = documents.MAX_CHARS, format: str = "markdown") -> str:
    d = documents.read_document(path, max_chars)
    return render.emit(d.__dict__, [d.markdown, "", *(f"> {w}" for w in d.warnings)], format)


def extract_api_spec(spark: SparkSession, source: str, endpoint: str | None = None, method: str | None = None, tag: str | None = None, detail: bool = False, include_deprecated: bool = False, text: str | None = None, content_type: str | None = None, format: str = "markdown") -> str:
    """An API's endpoints or types, from a file, or from a text that the caller has fetched."""
    if text is None:
        if not Path(source).exists():
            raise NotFound(f"File not found: {source}")
        text = Path(source).read_text(encoding="utf-8")
    kind, parsed = specs.load(source, text, content_type)
    d = {"source": source, "title": None, "version": None, "servers": [], "endpoints": [], "types": [], "detail": detail, "warnings": []}
    if kind == "graphql":
        return render.spec({**d, "types": rows(specs.graphql_types(spark, source, parsed).orderBy("ord"))}, format)
    api = specs.Api(parsed)
    info = parsed.get("info") or {}
    own = specs.filter_endpoints(specs.endpoints(spark, source, parsed), include_deprecated, [tag] if tag else None, endpoint, method.split(",") if method else None, detail)
    d |= {"title": info.get("title"), "version": info.get("version"), "servers": api.servers(), "endpoints": rows(own.orderBy("ord")), "warnings": api.warnings}
    return render.spec(d, format)


def inspect_responses(responses: DataFrame, sample: int = 5, lines_shown: int = 50, shape_only: bool = False, redact: bool = True, all_headers: bool = False) -> DataFrame:
    """Digests of a table of responses: url, status, headers (array of name, value), content_type, body (binary)."""
    own = responses.select("url", "status", web.kept_headers(F.col("headers"), all_headers, redact).alias("headers"), web.content_type(F.col("content_type")).alias("content_type"), "body")
    text = F.decode("body", "UTF-8")
    own = own.withColumns({"format": web.body_format(F.col("content_type"), F.col("body")), "text": F.when(~web.is_binary(F.col("content_type"), F.col("body")), text), "bytes": F.octet_length("body")})
    is_ = lambda k: F.col("format") == k
    own = own.withColumns({"j": json_digests(F.when(is_("json"), F.col("text"))), "x": xml_outlines(F.when(is_("xml"), F.col("text"))), "p": web.preview(F.col("text"), lines_shown)})
    plain = ~is_("xml") & ~(is_("json") & F.col("j.parse_error").isNull())
    return own.select(
        "url", "status", "headers", "content_type", "format", "bytes", "j.shape", "j.array_len", (F.lit(None).cast("string") if shape_only else F.col("j.sample")).alias("sample"),
        F.when(is_("html"), web.html_title(F.col("text"))).alias("title"), F.when(is_("xml"), F.col("x")).when(is_("binary"), F.format_string("<binary: %s, %.1f KB>", "content_type", F.col("bytes") / 1024)).when(plain, F.col("p.text_preview")).alias("preview"),
        F.when(plain & ~is_("binary"), F.col("p.suppressed_lines")).otherwise(0).alias("suppressed_lines"), F.when(is_("json"), F.col("j.parse_error")).alias("parse_error"),
    )


def inspect_http(spark: SparkSession, url: str, status: int = 200, headers: list[tuple[str, str]] = (), body: bytes = b"", max_array_items: int = 5, shape_only: bool = False, no_redact_cookies: bool = False, show_all_headers: bool = False, format: str = "markdown") -> str:
    """A response's digest. The response comes from the caller: the library doesn't reach the network."""
    kind = next((v for n, v in headers if n.lower() == "content-type"), None)
    schema = "url string, status int, headers array<struct<name:string,value:string>>, content_type string, body binary"
    one = spark.createDataFrame([(url, status, list(headers), kind, bytearray(body))], schema)
    d = rows(inspect_responses(one, max_array_items, shape_only=shape_only, redact=not no_redact_cookies, all_headers=show_all_headers))[0]
    warnings = [f"the body isn't the JSON that its type says: {d['parse_error']}"] if d["parse_error"] else []
    return render.response({**d, "warnings": warnings}, format)


def inspect_image(path: str, format: str = "markdown") -> str:
    at = Path(path)
    if not at.exists():
        raise NotFound(f"File not found: {path}")
    with at.open("rb") as f:
        width, height, mode, kind = documents.image_info(f.read(1 << 20))
    d = {"path": path, "width": width, "height": height, "mode": mode, "format": kind, "bytes": at.stat().st_size}
    return render.emit(d, [f"# {at.name}", "", f"- Size: {width}×{height}", f"- Mode: {mode}", f"- Format: {kind}", f"- File: {render.size(d['bytes'])}"], format)
