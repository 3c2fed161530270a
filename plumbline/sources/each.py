"""Parsers of single documents over tables of documents: each text where it is, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def parse_each(df: DataFrame, keep: list[str], text: str, parse: Callable[[object], Iterable[tuple]], columns: str) -> DataFrame:
    """Columns `keep` of each row with each of the rows that parse() gives for its text, as `columns` (DDL).

    Nothing is shuffled, and no text is held longer than its batch. Rows whose text is null give none.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    names = [*keep, *(f.name for f in _fields(df, columns))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for *own, value in frame.itertuples(index=False, name=None):
                if value is not None:
                    rows += [(*own, *r) for r in parse(value)]
            yield pd.DataFrame(rows, columns=names, dtype="object")

    return df.select(*keep, text).mapInPandas(run, f"{kinds}, {columns}")


def _fields(df: DataFrame, columns: str):
    return df.sparkSession.createDataFrame([], columns).schema.fields
