"""Scans over whole texts: pattern search by line, line windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkindex.functions.batches import arrow_map

MOST_HITS = 50
SHOWN = 160


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, line) of every line, numbered from 1."""
    split = F.split(F.regexp_replace(F.col(text), "\\r\\n?", "\n"), "\n")
    numbered = texts.select(key, F.posexplode(split).alias("at", "line"), F.size(split).alias("size"))
    return numbered.where((F.col("line") != "") | (F.col("at") + 1 < F.col("size"))).select(key, (F.col("at") + 1).alias("n"), "line")


def grep(texts: DataFrame, pattern: str, key: str = "path", text: str = "text", python_syntax: bool = False) -> DataFrame:
    """(key, n, shown) of lines that match; shown is the line, trimmed and cut for display.

    Patterns are Java regular expressions, matched in the JVM line by line;
    python_syntax matches with Python's `re` instead.
    """
    rows = lines(texts, key, text)
    if python_syntax:
        re.compile(pattern)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = re.compile(pattern)
            for batch in batches:
                yield batch.filter(pa.array([found.search(x.as_py()) is not None for x in batch.column("line")], pa.bool_()))

        hits = arrow_map(rows, run, rows.schema)
    else:
        hits = rows.where(F.col("line").rlike(pattern))
    return hits.select(key, "n", F.substring(F.trim("line"), 1, SHOWN).alias("shown"))


def grep_report(texts: DataFrame, pattern: str, key: str = "path", text: str = "text", most: int = MOST_HITS) -> str:
    """The first hits as `path:n: line`, and a remark where there are more or none."""
    try:
        re.compile(pattern)
    except re.error as error:
        return f"not a regular expression: {error}"
    hits = grep(texts, pattern, key, text, python_syntax=True).orderBy(key, "n").take(most + 1)
    shown = [f"{r[0]}:{r.n}: {r.shown}" for r in hits[:most]]
    if len(hits) > most:
        shown.append(f"({most} lines are shown, others match as well)")
    return "\n".join(shown or ["(no line matches)"])


def line_window(text: Column, start: int, end: int, most: int = 200) -> Column:
    """Lines start to end as `n: line`, at most `most` of them."""
    last = min(end, start + most - 1)
    numbered = F.transform(F.split(text, "\n"), lambda line, i: F.concat((i + 1).cast("string"), F.lit(": "), line))
    return F.array_join(F.slice(numbered, F.lit(max(start, 1)), F.lit(max(last - max(start, 1) + 1, 0))), "\n")
