"""Tables from CSV, TSV, JSON, JSON Lines, Parquet, SQLite and Excel files, with rows numbered in source order.

Every reader gives a Table: a DataFrame with row_id (from 1), the source's columns in order, and
whether its values are untyped text. Text formats are read by Spark in splits; numbering them takes one
small count for each split, not a sort.
"""

from __future__ import annotations

import json
import re
import sqlite3
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from pathlib import Path
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import BadInput, NotFound
from ..plans.sqlguard import check_select
from .files import Ignore
from .numbers import numbered

# Formats by extension; the beginning of an SQLite file; bytes that tell a format.
EXTENSIONS = {
    ".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet", ".pq": "parquet",
    ".sqlite": "sqlite", ".sqlite3": "sqlite", ".db": "sqlite", ".xlsx": "excel", ".xlsm": "excel",
}
SQLITE_MAGIC = b"SQLite format 3\x00"
SNIFF, LINE = 2048, 4096


@dataclass
class Table:
    name: str
    rows: DataFrame
    columns: list[str]
    text: bool = True
    declared: dict[str, str] = field(default_factory=dict)
    row_count: int | None = None
    notes: list[str] = field(default_factory=list)


def detect(path: Path, hint: str | None = None) -> str:
    """A file's format: as told, by its extension, else by its first bytes."""
    if hint:
        return hint
    if path.suffix.lower() in EXTENSIONS:
        return EXTENSIONS[path.suffix.lower()]
    if not path.exists():
        raise NotFound(f"File not found: {path}")
    with path.open("rb") as f:
        head = f.read(SNIFF)
    if head.lstrip()[:1] in (b"{", b"["):
        return "json"
    if head.startswith(SQLITE_MAGIC):
        return "sqlite"
    first = head.split(b"\n", 1)[0]
    if b"," in first and len(first) < LINE:
        return "csv"
    raise BadInput(f"can't tell the format of {path}")


def _position() -> Column:
    """Where a row stood, for rows straight from a scan: its task's number and place in it."""
    return F.monotonically_increasing_id()


def read_csv(spark: SparkSession, path: str | Path, sep: str = ",") -> Table:
    """A CSV file with a header: all values text, empty ones null; short rows are padded, long ones cut."""
    with Path(path).open(encoding="utf-8", errors="replace", newline="") as f:
        if not f.readline().strip("\r\n﻿"):
            raise BadInput(f"empty CSV file: {path}")
    # a line with an odd number of quotes opens or closes a value with line ends in it; without one the file is read in splits
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    broken = spark.read.text(str(path)).where(quotes % 2 == 1).limit(1).count() > 0
    raw = spark.read.csv(str(path), header=True, sep=sep, multiLine=broken, escape='"', nullValue="", mode="PERMISSIVE", enforceSchema=True)
    names = [c.strip().removeprefix("﻿") for c in raw.columns]
    rows = raw.toDF(*names).withColumn("_at", _position())
    rows = numbered(rows, [F.shiftright("_at", 33), F.col("_at")]).drop("_at")
    return Table(Path(path).stem, rows.select("row_id", *names), names)


def _long_records(records: DataFrame) -> DataFrame:
    """row_id, pos, key, raw of records (row_id, v VARIANT): a row for each key of each object."""
    spark = records.sparkSession
    records.createOrReplaceTempView("_plumbline_records")
    return spark.sql(
        """SELECT row_id, e.pos, e.key, CASE WHEN is_variant_null(e.value) THEN NULL
          WHEN schema_of_variant(e.value) LIKE 'OBJECT%' OR schema_of_variant(e.value) LIKE 'ARRAY%' THEN to_json(e.value) ELSE try_cast(e.value AS STRING) END AS raw
        FROM _plumbline_records, LATERAL variant_explode(v) AS e"""
    )


def records_table(name: str, records: DataFrame, count: int) -> Table:
    """Records as cells (row_id, col_ord, column, raw): columns in the order in which keys are first seen."""
    long = _long_records(records)
    firsts = long.groupBy("key").agg(F.min(F.struct("row_id", "pos")).alias("at"))
    # a row for each key: the driver holds the names of a table's columns
    order = firsts.select("key", (F.row_number().over(Window.orderBy("at")) - 1).alias("col_ord"))
    keys = [r["key"] for r in order.orderBy("col_ord").collect()]
    cells = long.join(order, "key").select("row_id", "col_ord", F.col("key").alias("column"), "raw")
    return Table(name, cells, keys, row_count=count)


def read_jsonl(spark: SparkSession, path: str | Path) -> Table:
    """Lines of JSON objects as cells. Blank lines don't count; lines that aren't objects are skipped and counted."""
    lines = spark.read.option("lineSep", "\n").text(str(path)).withColumn("_at", _position()).where(F.trim("value") != "")
    lines = numbered(lines, [F.shiftright("_at", 33), F.col("_at")]).withColumn("v", F.try_parse_json("value"))
    good = lines.where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT")).select("row_id", "v")
    total, kept = lines.count(), good.count()
    table = records_table(Path(path).stem, good, kept)
    if total > kept:
        table.notes.append(f"{total - kept} malformed lines skipped")
    return table


def read_json(spark: SparkSession, path: str | Path, max_bytes: int = 50 << 20) -> tuple[Table | None, list[dict]]:
    """An array of objects as cells, or the structure of any other document: key, type and size of each top-level entry."""
    if Path(path).stat().st_size > max_bytes:
        raise BadInput(f"JSON document larger than {max_bytes} bytes; use JSON Lines")
    whole = spark.read.text(str(path), wholetext=True).select(F.try_parse_json("value").alias("v"))
    document = json.loads(Path(path).read_text(encoding="utf-8", errors="replace"))
    if isinstance(document, list) and document and all(isinstance(x, dict) for x in document):
        whole.createOrReplaceTempView("_plumbline_array")
        rows = spark.sql("SELECT cast(e.pos + 1 AS bigint) AS row_id, e.value AS v FROM _plumbline_array, LATERAL variant_explode(v) AS e")
        return records_table(Path(path).stem, rows, len(document)), []
    return None, structure(document)


def structure(document: object) -> list[dict]:
    """key, type and size of each top-level entry of a document that isn't a table."""
    names = ((bool, "boolean"), (dict, "object"), (list, "array"), (str, "string"), (int, "integer"), (float, "number"))
    label = lambda v: "null" if v is None else next(n for t, n in names if isinstance(v, t))
    size = lambda v: len(v) if isinstance(v, (dict, list, str)) else None
    pairs = document.items() if isinstance(document, dict) else [("(root)", document)]
    return [{"key": str(k), "type": label(v), "size": size(v)} for k, v in pairs]


def read_parquet(spark: SparkSession, path: str | Path) -> Table:
    rows = spark.read.parquet(str(path))
    names = rows.columns
    rows = numbered(rows.withColumn("_at", _position()), [F.shiftright("_at", 33), F.col("_at")]).drop("_at")
    return Table(Path(path).stem, rows.select("row_id", *names), names, text=False)


class SqliteSource(DataSource):
    """spark.read.format("sqlite"): options path, and table or query; numPartitions splits a table by rowid."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _target(self) -> str:
        if query := self.options.get("query"):
            check_select(query)
            return query.strip().removesuffix(";")
        return "SELECT * FROM " + self._table()

    def _table(self) -> str:
        return '"' + self.options["table"].replace('"', '""') + '"'

    def schema(self) -> T.StructType:
        with connect(self.options["path"]) as db:
            names = [d[0] for d in db.execute(self._target()).description]
        return T.StructType([T.StructField("row_id", T.LongType()), *(T.StructField(n, T.StringType()) for n in unique(names))])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(self.options, self._target(), None if self.options.get("query") else self._table())


@dataclass
class RowidRange(InputPartition):
    low: int | None
    high: int | None
    before: int


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], select: str, table: str | None):
        self.path, self.select, self.table, self.limit = options["path"], select, table, options.get("limit")
        self.parts = int(options.get("numpartitions", options.get("numPartitions", "1")))

    def partitions(self) -> list[RowidRange]:
        if self.table is None or self.parts <= 1:
            return [RowidRange(None, None, 0)]
        with connect(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
            except sqlite3.Error:  # a table without rowid
                return [RowidRange(None, None, 0)]
            if low is None:
                return [RowidRange(None, None, 0)]
            step, out, before = max(1, -(-(high - low + 1) // self.parts)), [], 0
            for start in range(low, high + 1, step):
                n = db.execute(f"SELECT count(*) FROM {self.table} WHERE rowid >= ? AND rowid < ?", (start, start + step)).fetchone()[0]
                out.append(RowidRange(start, start + step, before))
                before += n
            return out

    def read(self, part: RowidRange) -> Iterator[tuple]:
        where = "" if part.low is None else f" WHERE rowid >= {part.low} AND rowid < {part.high} ORDER BY rowid"
        with connect(self.path) as db:
            for k, row in enumerate(islice(db.execute(self.select + where), int(self.limit) if self.limit else None), part.before + 1):
                yield (k, *(None if v is None else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v) for v in row))


def connect(path: str) -> sqlite3.Connection:
    """A connection that can't write."""
    if not Path(path).exists():
        raise NotFound(f"File not found: {path}")
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def sqlite_tables(path: str | Path) -> list[str]:
    with connect(str(path)) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def read_sqlite(spark: SparkSession, path: str | Path, tables: list[str] | None = None, query: str | None = None, max_tables: int = 20, limit: int | None = None, parts: int = 1) -> tuple[list[Table], list[str]]:
    """Tables of a database (all, or those named, up to a cap), or the result of one SELECT; and warnings."""
    spark.dataSource.register(SqliteSource)
    base = spark.read.format("sqlite").option("path", str(path))
    base = base.option("limit", str(limit)) if limit else base
    if query is not None:
        check_select(query)
        try:
            rows = base.option("query", query).load()
        except Exception as e:
            raise BadInput(f"Query failed: {str(e).splitlines()[-1]}") from e
        return [Table("query result", rows, rows.columns[1:])], []
    every = sqlite_tables(path)
    wanted = [t for t in tables if t in every] if tables else every
    warnings = [f"table not found: {t}" for t in tables or [] if t not in every]
    if len(wanted) > max_tables:
        warnings.append(f"only the first {max_tables} of {len(wanted)} tables are shown")
    out = []
    with connect(str(path)) as db:
        for t in wanted[:max_tables]:
            q = '"' + t.replace('"', '""') + '"'
            declared = {r[1]: r[2] for r in db.execute(f"PRAGMA table_info({q})")}
            rows = base.option("table", t).option("numPartitions", str(parts)).load()
            out.append(Table(t, rows, rows.columns[1:], declared=declared, row_count=db.execute(f"SELECT count(*) FROM {q}").fetchone()[0]))
    return out, warnings


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def excel_sheets(path: str | Path) -> list[tuple[str, list[list[str | None]]]]:
    """Names and rows of a workbook's sheets, from its zipped XML; values as they are stored."""
    if not zipfile.is_zipfile(path):
        raise BadInput(f"{path} is no workbook")
    with zipfile.ZipFile(path) as z:
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        links = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            rid = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
            target = links[rid].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for r in root.iter(f"{{{_NS['m']}}}row"):
                cells: dict[int, str | None] = {}
                for k, c in enumerate(r.findall("m:c", _NS)):
                    ref = re.match("[A-Z]+", c.get("r", ""))
                    cells[column_number(ref[0]) if ref else k] = cell_value(c, strings)
                rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
            out.append((sheet.get("name", ""), rows))
        return out


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def cell_value(c: ET.Element, strings: list[str]) -> str | None:
    kind, v = c.get("t"), c.find("m:v", _NS)
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return strings[int(v.text)]
    return {"0": "FALSE", "1": "TRUE"}.get(v.text, v.text) if kind == "b" else v.text


def read_excel(spark: SparkSession, path: str | Path, sheets: list[str] | None = None, max_tables: int = 20) -> tuple[list[Table], list[str]]:
    every = excel_sheets(path)
    names = [n for n, _ in every]
    warnings = [f"sheet not found: {s}" for s in sheets or [] if s not in names]
    out = []
    for name, rows in [x for x in every if not sheets or x[0] in sheets][:max_tables]:
        if not rows:
            out.append(Table(name, spark.createDataFrame([], "row_id long"), [], row_count=0, notes=["empty sheet"]))
            continue
        width = max(map(len, rows))
        header = unique([h if h not in (None, "") else f"col_{k}" for k, h in enumerate(rows[0] + [None] * (width - len(rows[0])))])
        schema = T.StructType([T.StructField("row_id", T.LongType()), *(T.StructField(h, T.StringType()) for h in header)])
        body = [(k, *(r + [None] * (width - len(r)))) for k, r in enumerate(rows[1:], 1)]
        out.append(Table(name, spark.createDataFrame(body, schema), header))
    return out, warnings


def data_files(root: Path, globs: str = "*", recursive: bool = False) -> list[Path]:
    """Files of a folder that match one of comma-separated globs and no ignore rule, each once, sorted."""
    ignore = Ignore(root)
    find = root.rglob if recursive else root.glob
    found = {p for g in globs.split(",") for p in find(g.strip()) if p.is_file()}
    return sorted(p for p in found if not ignore.path(p.relative_to(root).as_posix(), False))
