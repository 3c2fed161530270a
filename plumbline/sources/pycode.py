"""Source files as rows: imports, functions, classes and constants of Python, line counts of the rest."""

from __future__ import annotations

import ast
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import MAX_INDEXED, Ignore, code_files, language_of

MAX_DEFAULT, MAX_SIGNATURE = 20, 120
_function = "struct<name:string,signature:string,docstring:string,decorators:array<string>,is_async:boolean,line:int>"
INDEX = (
    "path string, language string, lines long, bytes long, imports array<struct<module:string,names:array<string>,alias:string,relative:boolean>>, "
    f"functions array<{_function}>, classes array<struct<name:string,bases:array<string>,docstring:string,decorators:array<string>,line:int,methods:array<{_function}>>>, "
    "constants array<string>, error string"
)
Functions = (ast.FunctionDef, ast.AsyncFunctionDef)


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """A function's head; long defaults are cut, and a head that is too long loses its parameters."""
    a = node.args
    short = lambda e: (text := ast.unparse(e))[:MAX_DEFAULT] + "..." * (len(text) > MAX_DEFAULT)

    def one(arg: ast.arg, default: ast.expr | None = None, mark: str = "") -> str:
        note = f": {ast.unparse(arg.annotation)}" if arg.annotation else ""
        return mark + arg.arg + note + (f"={short(default)}" if default is not None else "")

    plain = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    parts = [one(x, d) for x, d in zip(plain, defaults)]
    if a.posonlyargs:
        parts.insert(len(a.posonlyargs), "/")
    parts += [one(a.vararg, mark="*")] if a.vararg else ["*"] if a.kwonlyargs else []
    parts += [one(x, d) for x, d in zip(a.kwonlyargs, a.kw_defaults)]
    parts += [one(a.kwarg, mark="**")] if a.kwarg else []
    word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    back = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    whole = f"{word} {node.name}({', '.join(parts)}){back}"
    return whole if len(whole) <= MAX_SIGNATURE else f"{word} {node.name}(...){back}"


def _function_row(node) -> tuple:
    marks = [ast.unparse(d) for d in node.decorator_list]
    return (node.name, signature(node), ast.get_docstring(node) or None, marks, isinstance(node, ast.AsyncFunctionDef), node.lineno)


def index_text(path: str, text: str) -> tuple:
    """INDEX of one file. Python that can't be parsed has its error; other languages their size only."""
    lang, lines, size = language_of(path), len(text.splitlines()), len(text.encode("utf-8", "surrogatepass"))
    if lang != "python":
        return (path, lang, lines, size, [], [], [], [], None)
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError) as e:
        return (path, lang, lines, size, [], [], [], [], f"{type(e).__name__}: {e}")
    imports = [(a.name, [], a.asname, False) for n in body if isinstance(n, ast.Import) for a in n.names]
    imports += [("." * n.level + (n.module or ""), [a.name for a in n.names], None, n.level > 0) for n in body if isinstance(n, ast.ImportFrom)]
    classes = []
    for n in (n for n in body if isinstance(n, ast.ClassDef)):
        methods = [_function_row(m) for m in n.body if isinstance(m, Functions)]
        classes.append((n.name, [ast.unparse(b) for b in n.bases], ast.get_docstring(n) or None, [ast.unparse(d) for d in n.decorator_list], n.lineno, methods))
    targets = [t for n in body for t in (n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else [])]
    constants = list(dict.fromkeys(t.id for t in targets if isinstance(t, ast.Name) and t.id.isupper()))
    return (path, lang, lines, size, imports, [_function_row(n) for n in body if isinstance(n, Functions)], classes, constants, None)


def index_folder(spark: SparkSession, root: str | Path, extensions: tuple[str, ...] = (), exclude: tuple[str, ...] = (), max_size: int = MAX_INDEXED) -> tuple[DataFrame, list[str]]:
    """INDEX of a folder's files, parsed by tasks, and the files skipped for their size."""
    root = Path(root)
    files, skipped = code_files(root, extensions, max_size, Ignore(root, tool_file=".indexignore", extra=exclude))
    texts = [(p.relative_to(root).as_posix(), p.read_text(encoding="utf-8", errors="replace")) for p in files]
    return index_texts(spark.createDataFrame(texts, "path string, text string")).orderBy("path"), skipped


def index_texts(texts: DataFrame) -> DataFrame:
    """INDEX of a table of path and text. Each file is parsed on its own, in Arrow batches."""
    names = ["path", "language", "lines", "bytes", "imports", "functions", "classes", "constants", "error"]

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([index_text(p, t or "") for p, t in zip(frame["path"], frame["text"])], columns=names)

    return texts.select("path", "text").mapInPandas(run, INDEX)


def index_totals(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


def token_estimate(text: str) -> int | None:
    """Tokens of a text by a public encoding; None where its file can't be had."""
    try:
        import tiktoken

        return len(tiktoken.get_encoding("cl100k_base").encode(text))
    except Exception:  # noqa: BLE001 - the encoding is fetched from the network, which may be out of reach
        return None
