"""Value-level snapshots of an index and their differences; ids and times do not count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkindex.model import Index

TABLES = ("files", "symbols", "refs")


def snapshot(index: Index) -> dict[str, DataFrame]:
    """The three sets of rows that two equal indexes share."""
    path = index.files.select("file_id", "path")
    parents = index.symbols.select(F.col("symbol_id").alias("parent_id"), F.col("qualified_name").alias("parent_qualified_name"))
    targets = index.symbols.select(F.col("symbol_id").alias("resolved_symbol_id"), F.col("qualified_name").alias("resolved_qualified_name"), F.col("file_id").alias("target_id"))
    target_paths = path.select(F.col("file_id").alias("target_id"), F.col("path").alias("resolved_path"))
    symbols = index.symbols.join(path, "file_id").join(parents, "parent_id", "left")
    refs = index.refs.join(path, "file_id").join(targets, "resolved_symbol_id", "left").join(target_paths, "target_id", "left")
    return {
        "files": index.files.select("path", "language", "content_hash").distinct(),
        "symbols": symbols.select("path", "name", "qualified_name", "kind", "start_line", "end_line", "signature", "parent_qualified_name").distinct(),
        "refs": refs.select("path", "name", "line", "confidence", "resolved_path", "resolved_qualified_name").distinct(),
    }


def difference(expected: DataFrame, actual: DataFrame, table: str) -> DataFrame:
    """(table, side, row): what is missing from actual, and what is extra in it."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.lit(table).alias("table"), F.lit(name).alias("side"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("row"))

    return side(expected.exceptAll(actual), "missing").unionByName(side(actual.exceptAll(expected), "extra"))


def drift(expected: Index, actual: Index) -> DataFrame:
    """All differences between an index and a rebuilt one; empty if they agree."""
    a, b = snapshot(expected), snapshot(actual)
    out = None
    for table in TABLES:
        rows = difference(a[table], b[table], table)
        out = rows if out is None else out.unionByName(rows)
    return out


def stale_paths(index: Index, present: DataFrame) -> DataFrame:
    """Indexed paths that are not among present (path)."""
    return index.files.select("path").join(present.select("path"), "path", "left_anti")
