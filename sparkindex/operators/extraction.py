"""Files to symbols and references: the scanners as a DataFrame operator and in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkindex.extract import extract
from sparkindex.functions.batches import arrow_map
from sparkindex.model import file_id, symbol_id

_SYMBOL = pa.struct([("ordinal", pa.int32()), ("name", pa.string()), ("qualified_name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("parent_ordinal", pa.int32())])
_REFERENCE = pa.struct([("name", pa.string()), ("line", pa.int32())])
SCHEMA = "path string, symbols array<struct<ordinal:int,name:string,qualified_name:string,kind:string,start_line:int,end_line:int,signature:string,parent_ordinal:int>>, refs array<struct<name:string,line:int>>"


def rows_of(source: bytes, language: str) -> tuple[list[tuple], list[tuple[str, int]]]:
    """Symbols as (ordinal, .., parent ordinal) and references of one file. The parent is
    the first earlier symbol with the qualified name of the scope."""
    symbols, references = extract(source, language)
    first: dict[str, int] = {}
    rows = []
    for ordinal, (name, qualified, kind, start, end, signature, parent) in enumerate(symbols):
        rows.append((ordinal, name, qualified, kind, start, end, signature, first.get(parent) if parent else None))
        first.setdefault(qualified, ordinal)
    return rows, references


def extracted(sources: DataFrame) -> DataFrame:
    """(path, symbols, refs) for each source (path, language, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, refs = [], []
            for language, content in zip(batch.column("language"), batch.column("content"), strict=True):
                rows, found = rows_of(content.as_py() or b"", language.as_py())
                symbols.append([dict(zip(_SYMBOL.names, r, strict=True)) for r in rows])
                refs.append([{"name": n, "line": at} for n, at in found])
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(symbols, pa.list_(_SYMBOL)), pa.array(refs, pa.list_(_REFERENCE))], ["path", "symbols", "refs"])

    return arrow_map(sources.select("path", "language", "content"), run, SCHEMA)


def symbols_of(found: DataFrame) -> DataFrame:
    s = found.select("path", F.explode("symbols").alias("s")).select("path", "s.*")
    parent = F.when(F.col("parent_ordinal").isNotNull(), symbol_id(F.col("path"), F.col("parent_ordinal")))
    return s.select(symbol_id(F.col("path"), F.col("ordinal")).alias("symbol_id"), file_id(F.col("path")).alias("file_id"), "ordinal", "name", "qualified_name", "kind", "start_line", "end_line", "signature", parent.alias("parent_id"))


def refs_of(found: DataFrame) -> DataFrame:
    return found.select(file_id(F.col("path")).alias("file_id"), F.explode("refs").alias("r")).select("file_id", "r.name", "r.line")


def register_table_function(spark: SparkSession, name: str = "extract_symbols") -> None:
    """SQL: SELECT t.* FROM files, LATERAL extract_symbols(content, language) t"""

    @F.udtf(returnType="what string, name string, qualified_name string, kind string, start_line int, end_line int, signature string, parent string")
    class Extract:
        def eval(self, content: bytes, language: str):
            symbols, references = extract(bytes(content), language)
            for n, q, kind, start, end, signature, parent in symbols:
                yield "symbol", n, q, kind, start, end, signature, parent
            for n, line in references:
                yield "reference", n, None, None, line, line, None, None

    spark.udtf.register(name, Extract)
