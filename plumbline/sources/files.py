"""Files and folders as rows of nodes, with the rules for what to leave out."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.repo import glob_regex

# Names that are always left out, languages by extension, sizes that the index takes.
ALWAYS = (
    ".git", ".hg", ".svn", "__pycache__", "*.pyc", "*.pyo", "*.pyd", ".venv", "venv", "env", ".env", "node_modules", ".pnp",
    "dist", "build", "target", "_build", "site", "*.egg-info", ".eggs", ".tox", ".nox", ".pytest_cache", ".mypy_cache", ".ruff_cache",
    ".DS_Store", "Thumbs.db", "*.min.js", "*.min.css", "*.lock", "*.map", "coverage", ".coverage", "htmlcov",
)
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust",
    ".java": "java", ".cs": "c#", ".cpp": "c++", ".c": "c", ".h": "c", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".md": "markdown",
    ".rst": "restructuredtext", ".txt": "text", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".json": "json", ".sh": "shell", ".bash": "shell",
    ".zsh": "shell", ".sql": "sql", ".html": "html", ".css": "css", ".scss": "scss",
}
MAX_INDEXED, BINARY_PREFIX = 500_000, 8192
NODES = "path string, parent string, name string, is_dir boolean, depth int, size long, mtime double, is_binary boolean"


class Rule(NamedTuple):
    pattern: str
    back: bool
    folders: bool


class Ignore:
    """What to leave out: fixed and extra rules always, then those of ignore files, of which later ones win.

    In these ! takes back, a trailing / means folders only, a / elsewhere roots a rule at the top. What lies
    below a folder that is left out is left out too.
    """

    def __init__(self, root: Path, gitignore: bool = True, tool_file: str = ".treeignore", extra: tuple[str, ...] = ()):
        lines = []
        for name in ([".gitignore"] if gitignore else []) + [tool_file]:
            if (root / name).is_file():
                lines += (root / name).read_text(errors="replace").splitlines()
        self._set(lines, extra)

    @classmethod
    def of(cls, lines: list[str], extra: tuple[str, ...] = ()) -> Ignore:
        """Rules from the lines of an ignore file."""
        own = cls.__new__(cls)
        own._set(lines, extra)
        return own

    def _set(self, lines: list[str], extra: tuple[str, ...]) -> None:
        self.hard = [rule(p) for p in (*ALWAYS, *extra)]
        self.own = [rule(line) for line in (raw.strip() for raw in lines) if line and not line.startswith("#")]
        self.compiled = [[(re.compile(r.pattern), r) for r in rules] for rules in (self.hard, self.own)]

    def path(self, rel: str, is_dir: bool = True) -> bool:
        """Whether a path, or a folder above it, is left out."""
        parts = rel.split("/")
        return any(self._one("/".join(parts[:k]), is_dir or k < len(parts)) for k in range(1, len(parts) + 1))

    def _one(self, rel: str, is_dir: bool) -> bool:
        hard, own = self.compiled
        if any(p.match(rel) and (is_dir or not r.folders) for p, r in hard):
            return True
        out = False
        for pattern, r in own:
            if (is_dir or not r.folders) and pattern.match(rel):
                out = not r.back
        return out

    def column(self, path: Column, is_dir: Column) -> Column:
        """path() as a Column, for trees that are listed by a plan."""
        parts = F.split(path, "/")

        def one(k: Column) -> Column:
            rel, folder = F.concat_ws("/", F.slice(parts, F.lit(1), k)), is_dir | (k < F.size(parts))
            hit = lambda r: rel.rlike(r.pattern) & (folder if r.folders else F.lit(True))
            out = F.lit(False)
            for r in self.own:
                out = F.when(hit(r), not r.back).otherwise(out)
            plain, folders = ("|".join(r.pattern for r in self.hard if r.folders == kind) for kind in (False, True))
            for pattern, applies in ((plain, F.lit(True)), (folders, folder)):
                out = out | (applies & rel.rlike(pattern)) if pattern else out
            return out

        return F.exists(F.sequence(F.lit(1), F.size(parts)), one)


def rule(line: str) -> Rule:
    back = line.startswith("!")
    body = line[1:] if back else line
    folders, body = body.endswith("/"), body.rstrip("/")
    rooted = "/" in body
    pattern = glob_regex(body.removeprefix("/")).removeprefix("^").removesuffix("$")
    return Rule(f"^{'' if rooted else '(.*/)?'}{pattern}$", back, folders)


def walk(root: Path, ignore: Ignore | None = None, max_depth: int | None = None, dotfiles: bool = False, cap: int | None = 50) -> Iterator[tuple]:
    """NODES below root, folders before files by lower-cased name; a folder's files beyond cap + 1 aren't looked at."""
    ignore = ignore or Ignore(root)
    todo = [(root, "", 1)]
    while todo:
        folder, rel, depth = todo.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: (not e.is_dir(follow_symlinks=False), e.name.lower(), e.name))
        except OSError:
            continue
        files, below = 0, []
        for e in entries:
            path, is_dir = f"{rel}/{e.name}".lstrip("/"), e.is_dir(follow_symlinks=False)
            if ignore.path(path, is_dir) or (e.name.startswith(".") and not dotfiles) or (e.is_symlink() and e.is_dir()):
                continue
            files += not is_dir
            if not is_dir and cap is not None and files > cap + 1:
                continue
            try:
                stat = e.stat(follow_symlinks=False)
            except OSError:
                continue
            yield (path, rel, e.name, is_dir, depth, 0 if is_dir else stat.st_size, stat.st_mtime, not is_dir and _looks_binary(e.path))
            if is_dir and (max_depth is None or depth < max_depth):
                below.append((Path(e.path), path, depth + 1))
        todo += below[::-1]


def tree(spark: SparkSession, root: str | Path, **options) -> DataFrame:
    """The nodes below a folder that the driver sees."""
    return spark.createDataFrame(list(walk(Path(root), **options)), NODES)


def stored_tree(spark: SparkSession, root: str) -> DataFrame:
    """The nodes below a folder of any store that Spark reads: files as it lists them, folders from their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content")
    base = F.lit(root.rstrip("/").partition("://")[2] or root.rstrip("/"))
    path = F.regexp_replace(F.substring("path", F.instr("path", root.rstrip("/").partition("://")[2] or root.rstrip("/")), 100_000), F.concat(F.lit("^"), base, F.lit("/")), "")
    own = files.select(path.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").cast("double").alias("mtime"))
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda k: F.concat_ws("/", F.slice(F.split("path", "/"), F.lit(1), k)))
    folders = own.where(F.col("path").contains("/")).select(F.explode(above).alias("path")).distinct()
    folders = folders.select("path", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("mtime"))
    both = own.withColumn("is_dir", F.lit(False)).unionByName(folders)
    name = F.substring_index("path", "/", -1)
    parent = F.when(F.col("path").contains("/"), F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)")).otherwise("")
    return both.select("path", parent.alias("parent"), name.alias("name"), "is_dir", F.size(F.split("path", "/")).alias("depth"), "size", "mtime")


def language_of(name: str) -> str | None:
    return LANGUAGES.get(os.path.splitext(name)[1].lower())


def language(path):
    """The language of a path by its extension, as a Column."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def language_histogram(nodes: DataFrame) -> DataFrame:
    """language, n: how many files (path) there are in each language that an extension tells."""
    return nodes.select(language(F.col("path")).alias("language")).where("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def is_binary(path: Path) -> bool:
    with path.open("rb") as f:
        return b"\x00" in f.read(BINARY_PREFIX)


def _looks_binary(path: str) -> bool:
    try:
        return is_binary(Path(path))
    except OSError:
        return False


def code_files(root: Path, extensions: tuple[str, ...] = (), max_size: int = MAX_INDEXED, ignore: Ignore | None = None) -> tuple[list[Path], list[str]]:
    """Text files to index, sorted, and those skipped for their size."""
    rules = ignore or Ignore(root, tool_file=".indexignore")
    kept, skipped = [], []
    for path, _, name, is_dir, _, size, _, binary in walk(root, rules, dotfiles=True, cap=None):
        if is_dir or (extensions and os.path.splitext(name)[1].lower() not in extensions):
            continue
        if size > max_size:
            skipped.append(path)
        elif not binary:
            kept.append(root / path)
    return sorted(kept), skipped
