"""Lookups over an index: definitions, usages, outlines, the map of the repository.

Those that take a list of names answer them all in one plan; with one name it is the same
plan with one row. Limits hold for each name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkindex.functions.text import like
from sparkindex.model import Index, file_id, is_definition

SYMBOL_ROW = ["symbol_id", "ordinal", "name", "qualified_name", "kind", "path", "start_line", "end_line", "signature"]


def symbol_rows(index: Index) -> DataFrame:
    """Every symbol with its file's path."""
    return index.symbols.join(index.files.select("file_id", "path"), "file_id").select(*SYMBOL_ROW)


def first_by_path(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy("path", "start_line", "ordinal").limit(limit)


def lookup_exact(index: Index, name: str, limit: int = 50) -> DataFrame:
    """Symbols of any kind whose name or qualified name is `name`."""
    return first_by_path(symbol_rows(index).where((F.col("name") == name) | (F.col("qualified_name") == name)), limit)


def lookup_like(index: Index, pattern: str, limit: int = 200) -> DataFrame:
    """Symbols whose name matches a LIKE pattern."""
    return first_by_path(symbol_rows(index).where(like(F.col("name"), pattern)), limit)


def find_definition(index: Index, name: str, limit: int = 50) -> DataFrame:
    """Definitions whose name or qualified name is `name`."""
    return first_by_path(symbol_rows(index).where(is_definition(F.col("kind")) & ((F.col("name") == name) | (F.col("qualified_name") == name))), limit)


def find_definitions(index: Index, names: DataFrame, limit: int = 50) -> DataFrame:
    """(query, .. symbol row) for each query of names (query)."""
    rows = symbol_rows(index).where(is_definition(F.col("kind")))
    asked = names.select("query").distinct()
    hits = rows.join(asked, rows["name"] == asked["query"]).unionByName(rows.join(asked, (rows["qualified_name"] == asked["query"]) & (rows["qualified_name"] != rows["name"])))
    order = Window.partitionBy("query").orderBy("path", "start_line", "ordinal")
    return hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit).select("query", *SYMBOL_ROW)


def find_references(index: Index, name: str, limit: int = 200) -> DataFrame:
    """Uses that resolve to a definition of `name`, then unresolved ones of its last part."""
    return find_all_references(index, index.spark.createDataFrame([(name,)], "query string"), limit).drop("query").orderBy(F.col("resolved_qualified_name").isNull(), "path", "line").limit(limit)


def narrowed(index: Index, name: str, definition_limit: int = 50) -> Index:
    """The index with only the references that find_references(index, name) can return. The
    definitions' ids, definition_limit at most, are collected first, so that they reach the
    scan of a stored table as a filter; for an index that is computed anew this costs more."""
    ids = [r.symbol_id for r in find_definition(index, name, definition_limit).select("symbol_id").collect()]
    open_ = F.col("resolved_symbol_id").isNull() & (F.col("name") == name.rsplit(".", 1)[-1])
    return Index(index.files, index.symbols, index.refs.where(open_ | F.col("resolved_symbol_id").isin(ids)))


def find_all_references(index: Index, names: DataFrame, limit: int = 200, definition_limit: int = 50) -> DataFrame:
    """(query, path, line, name, confidence, resolved_path, resolved_qualified_name)."""
    ids = find_definitions(index, names, definition_limit).select("query", F.col("symbol_id").alias("resolved_symbol_id"), F.col("path").alias("resolved_path"), F.col("qualified_name").alias("resolved_qualified_name"))
    columns = ["query", "file_id", "line", "name", "confidence", "resolved_path", "resolved_qualified_name"]
    resolved = index.refs.join(ids, "resolved_symbol_id").select(*columns)
    bare = names.select("query", F.element_at(F.split("query", "\\."), -1).alias("name")).distinct()
    open_ = index.refs.where("resolved_symbol_id is null").join(bare, "name").select("query", "file_id", "line", "name", "confidence", F.lit(None).cast("string").alias("resolved_path"), F.lit(None).cast("string").alias("resolved_qualified_name"))
    hits = resolved.unionByName(open_).join(index.files.select("file_id", "path"), "file_id")
    order = Window.partitionBy("query").orderBy(F.col("resolved_qualified_name").isNull(), "path", "line", "name")
    return hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit).select("query", "path", "line", "name", "confidence", "resolved_path", "resolved_qualified_name")


def outline(index: Index) -> DataFrame:
    """Every file's symbols with their parents' qualified names."""
    parents = index.symbols.select(F.col("symbol_id").alias("parent_id"), F.col("qualified_name").alias("parent"))
    return index.symbols.join(parents, "parent_id", "left").join(index.files.select("file_id", "path"), "file_id").select("path", "ordinal", "name", "qualified_name", "kind", "start_line", "end_line", "signature", "parent")


def outline_file(index: Index, path: str) -> DataFrame:
    """One file's symbols in source order; both filters reach the scans."""
    only = Index(index.files.where(F.col("path") == path), index.symbols.where(F.col("file_id") == file_id(F.lit(path))), index.refs)
    return outline(only).orderBy("start_line", "qualified_name", "ordinal").drop("ordinal")


def file_record(index: Index, path: str) -> DataFrame:
    return index.files.where(F.col("path") == path)


def indexed_paths(index: Index) -> DataFrame:
    return index.files.select("path").distinct()


def stats(index: Index) -> DataFrame:
    """One row: how many files, symbols and references."""
    counts = [frame.agg(F.count(F.lit(1)).alias(name)) for name, frame in (("files", index.files), ("symbols", index.symbols), ("refs", index.refs))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each


def index_age_ms(index: Index, now: float) -> DataFrame:
    """Milliseconds from the newest indexing to `now`, epoch seconds; 0 if empty."""
    return index.files.agg(F.greatest(F.lit(0), F.coalesce(F.floor((F.lit(now) - F.max("indexed_at")) * 1000), F.lit(0))).cast("long").alias("index_age_ms"))


def symbol_counts(index: Index) -> DataFrame:
    return index.symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("symbol_count"))


def inbound_counts(index: Index) -> DataFrame:
    """References from other files that resolve into a file. Counted per target symbol
    and source file first, so a symbol used everywhere is joined as few rows."""
    used = index.refs.where("resolved_symbol_id is not null").groupBy("resolved_symbol_id", "file_id").agg(F.count(F.lit(1)).alias("n"))
    targets = index.symbols.select(F.col("symbol_id").alias("resolved_symbol_id"), F.col("file_id").alias("target"))
    return used.join(targets, "resolved_symbol_id").where("file_id <> target").groupBy("target").agg(F.sum("n").alias("incoming_refs")).withColumnRenamed("target", "file_id")


def top_symbols(index: Index, per_file: int = 10) -> DataFrame:
    """(file_id, top_symbols): the first symbols of each file that have no parent."""
    order = Window.partitionBy("file_id").orderBy("start_line", "ordinal")
    top = index.symbols.where("parent_id is null and kind <> 'import'").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_file)
    ordered = F.array_sort(F.collect_list(F.struct("nth", "qualified_name")))
    return top.groupBy("file_id").agg(F.transform(ordered, lambda x: x["qualified_name"]).alias("top_symbols"))


def repo_map(index: Index, limit: int = 50, per_file: int = 10) -> DataFrame:
    """Files by inbound references, with their size and first symbols."""
    ranked = index.files.select("file_id", "path", "language").join(symbol_counts(index), "file_id", "left").join(inbound_counts(index), "file_id", "left")
    ranked = ranked.select("file_id", "path", "language", F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"), F.coalesce("incoming_refs", F.lit(0)).alias("incoming_refs")).orderBy(F.desc("incoming_refs"), "path").limit(limit)
    kept = Index(index.files, index.symbols.join(ranked.select("file_id"), "file_id", "left_semi"), index.refs)
    mapped = ranked.join(top_symbols(kept, per_file), "file_id", "left")
    return mapped.select("path", "language", "symbol_count", "incoming_refs", F.coalesce("top_symbols", F.array().cast("array<string>")).alias("top_symbols")).orderBy(F.desc("incoming_refs"), "path")
