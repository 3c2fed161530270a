"""Read-only SQL: one SELECT over named tables, checked by its words and again by its plan."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..errors import BadInput

_token = re.compile(r"""(?P<skip>\s+|--[^\n]*(?:\n|$)|/\*.*?(?:\*/|$))|(?P<quoted>'(?:[^']|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`)|(?P<word>\w+)|(?P<mark>.)""", re.S)


def _tokens(sql: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m.group()) for m in _token.finditer(sql) if m.lastgroup != "skip"]


def check_select(sql: str) -> None:
    """Raise BadInput unless sql is a single SELECT, with common table expressions before it or not.

    A semicolon may end it; any other, even in a literal, counts as a second statement.
    """
    text = sql.strip()
    if not text:
        raise BadInput("the query must not be empty")
    if ";" in text.removesuffix(";"):
        raise BadInput("the query must be a single SELECT statement")
    tokens = _tokens(text.removesuffix(";"))
    words = [(kind, t.lower()) for kind, t in tokens]
    if words[:1] == [("word", "with")]:
        words = _after_expressions(words[1:])
    if words[:1] != [("word", "select")]:
        raise BadInput("only SELECT statements can run, WITH ... SELECT included; tables are not changed here")


def _after_expressions(words: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """What follows `[RECURSIVE] name [(columns)] AS (query), ...`; nothing if that isn't what there is."""
    if words[:1] == [("word", "recursive")]:
        words = words[1:]
    while True:
        if not words or words[0][0] != "word":
            return []
        words = _past_parentheses(words[1:])
        if words[:1] != [("word", "as")] or words[1:2] != [("mark", "(")]:
            return []
        words = _past_parentheses(words[1:])
        if words[:1] != [("mark", ",")]:
            return words
        words = words[1:]


def _past_parentheses(words: list[tuple[str, str]]) -> list[tuple[str, str]]:
    if words[:1] != [("mark", "(")]:
        return words
    depth = 0
    for k, (kind, t) in enumerate(words):
        depth += (kind, t) == ("mark", "(")
        depth -= (kind, t) == ("mark", ")")
        if not depth:
            return words[k + 1 :]
    return []


def check_options(query: str | None, **others: object) -> None:
    """A query goes with no choice of tables or columns."""
    if query is not None and (named := [k for k, v in others.items() if v]):
        raise BadInput(f"a query cannot be combined with {', '.join(named)}")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def run_select(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The result of one SELECT over the given tables, as a plan; columns that share a name get a suffix.

    While the statement is analysed, tables are views of the session; what had their names before gets
    them back.
    """
    check_select(sql)
    held = {n: spark.table(quoted(n)) for n in tables if _is_view(spark, n)}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(quoted(name))
        out = spark.sql(sql.strip().removesuffix(";"))
        if "Command" in out._jdf.queryExecution().analyzed().getClass().getSimpleName():
            raise BadInput("only SELECT statements can run")
    except PySparkException as e:
        raise BadInput(f"Query failed: {str(e).splitlines()[0]}") from e
    finally:
        for name in tables:
            if name in held:
                held[name].createOrReplaceTempView(quoted(name))
            else:
                spark.catalog.dropTempView(name)
    seen: dict[str, int] = {}
    names = []
    for c in out.columns:
        seen[c] = seen.get(c, 0) + 1
        names.append(c if seen[c] == 1 else f"{c}_{seen[c]}")
    return out.toDF(*names)


def _is_view(spark: SparkSession, name: str) -> bool:
    return any(t.isTemporary and t.name.lower() == name.lower() for t in spark.catalog.listTables())
