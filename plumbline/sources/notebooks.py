"""Notebooks as rows of cells with processed outputs."""

from __future__ import annotations

import base64
import json
import re
import struct
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadInput, NotFound
from ..operators.html import markdown, tree

# Image types in order, repeats that are shown, lines of an output.
IMAGES = ("image/png", "image/jpeg", "image/gif", "image/svg+xml")
REPEATS, MAX_LINES = 3, 30
CELLS = (
    "source string, idx int, cell_type string, text string, execution_count int, tags array<string>, "
    "outputs array<struct<type:string,text:string,image:string,truncated:boolean,suppressed:int>>"
)
ANSI = re.compile(r"\x1b\[[0-9;]*m")


def joined(value: object) -> str:
    return "".join(value) if isinstance(value, list) else str(value or "")


def shown_stream(text: str) -> tuple[str, int]:
    """A stream as a terminal leaves it, without lines beyond the first three of a run of like ones, and their number."""
    out, last, run, left = [], None, 0, 0
    for line in text.split("\n"):
        line = next((p for p in reversed(line.split("\r")) if p), "")
        key = re.sub(r"\d+", "#", re.sub(r"\s+", " ", ANSI.sub("", line)).strip())
        run = run + 1 if key == last else 1
        last = key
        if run > REPEATS:
            left += 1
        else:
            out.append(line)
    return "\n".join(out[:-1] if text.endswith("\n") and out and not out[-1] else out), left


def image_note(mime: str, data: str) -> str:
    """A line in place of an image: its kind, its size if the header tells, its bytes."""
    try:
        raw = base64.b64decode(data[:64] + "=" * (-len(data[:64]) % 4))
        size = "{}×{}".format(*struct.unpack(">II", raw[16:24])) if raw.startswith(b"\x89PNG") else "unknown dims"
    except (ValueError, struct.error):
        size = "unknown dims"
    return f"<image: {mime.rpartition('/')[2].partition('+')[0]} {size}, {len(data) * 3 / 4 / 1024:.1f} KB>"


def output(out: dict, max_lines: int = MAX_LINES, dedup: bool = True) -> tuple | None:
    """type, text, image, truncated, suppressed of one output; images before HTML, HTML only without plain text."""

    def cut(kind: str, text: str, left: int = 0) -> tuple:
        lines = text.splitlines()
        return (kind, "\n".join(lines[:max_lines]), None, len(lines) > max_lines, left)

    kind = out.get("output_type")
    if kind == "stream":
        text, left = shown_stream(joined(out.get("text"))) if dedup else (joined(out.get("text")), 0)
        return cut(kind, text, left)
    if kind in ("display_data", "execute_result"):
        data = out.get("data") or {}
        for mime in IMAGES:
            if mime in data:
                return (kind, None, image_note(mime, joined(data[mime])), False, 0)
        if "text/html" in data and "text/plain" not in data:
            return cut(kind, markdown(tree(joined(data["text/html"]))) or "<HTML output>")
        done = cut(kind, joined(data.get("text/plain")))
        return (kind, done[1] or None, *done[2:])
    if kind == "error":
        trace = [ANSI.sub("", line) for line in out.get("traceback") or []]
        text = f"{out.get('ename', 'Error')}: {out.get('evalue', '')}\n" + "\n".join(trace[:max_lines])
        return (kind, text, None, len(trace) > max_lines, 0)
    return None


def cells_of(source: str, text: str, max_lines: int = MAX_LINES, outputs: bool = True, dedup: bool = True) -> tuple[list[tuple], dict]:
    """CELLS rows and metadata (kernel, language, total) of a notebook."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise BadInput(f"{source} isn't a notebook: {e}") from e
    meta = data.get("metadata") or {}
    kernel = meta.get("kernelspec") or {}
    rows = []
    for k, c in enumerate(data.get("cells") or []):
        kind = c.get("cell_type", "raw")
        done = [o for x in c.get("outputs") or [] if (o := output(x, max_lines, dedup))] if kind == "code" and outputs else []
        rows.append((source, k, kind, joined(c.get("source")), c.get("execution_count"), list((c.get("metadata") or {}).get("tags") or []), done))
    info = {"kernel": kernel.get("display_name") or kernel.get("name"), "language": kernel.get("language") or (meta.get("language_info") or {}).get("name"), "total": len(rows)}
    return rows, info


def read_notebook(spark: SparkSession, path: str | Path, **options) -> tuple[DataFrame, dict]:
    path = Path(path)
    if path.suffix != ".ipynb":
        raise BadInput(f"not a notebook: {path}")
    if not path.exists():
        raise NotFound(f"File not found: {path}")
    rows, info = cells_of(str(path), path.read_text(encoding="utf-8"), **options)
    return spark.createDataFrame(rows, CELLS), info


def read_notebooks(spark: SparkSession, pattern: str, max_lines: int = MAX_LINES) -> DataFrame:
    """Cells of all notebooks that a path pattern of any store names, parsed where they are read."""
    whole = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [r for s, v in zip(frame["source"], frame["value"]) for r in cells_of(s, v, max_lines)[0]]
            yield pd.DataFrame(rows, columns=["source", "idx", "cell_type", "text", "execution_count", "tags", "outputs"]).astype({"execution_count": "Int32"})

    return whole.mapInPandas(run, CELLS)


def parse_slice(text: str) -> slice:
    """A slice such as 3, 2:5, :4 or 10:."""
    parts = text.split(":")
    try:
        numbers = [int(p) if p.strip() else None for p in parts]
    except ValueError as e:
        raise BadInput(f"not a slice: {text}") from e
    if len(numbers) == 1 and numbers[0] is not None:
        return slice(numbers[0], numbers[0] + 1 if numbers[0] != -1 else None)
    return slice(*numbers[:2])


def filter_cells(cells: DataFrame, within: slice | None = None, total: int = 0, code_only: bool = False, markdown_only: bool = False, tags: list[str] | None = None) -> DataFrame:
    """Cells of a slice, then of a kind (raw ones go with markdown), then with any of the tags."""
    if within is not None:
        low, high, _ = within.indices(total)
        cells = cells.where((F.col("idx") >= low) & (F.col("idx") < high))
    if code_only:
        cells = cells.where("cell_type = 'code'")
    if markdown_only:
        cells = cells.where("cell_type IN ('markdown', 'raw')")
    return cells.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else cells
