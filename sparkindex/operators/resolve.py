"""Reference resolution: the file itself, then its imports, then the only definition.

All three tiers but the choice of the enclosing definition depend on (file, name) alone,
so references are grouped by that key first: definitions and imports of the file join on
the same partitioning, and names that most files use are shuffled once per file, not once
per use. Per-key groups are no larger than a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkindex.functions.paths import import_candidates
from sparkindex.model import Index, file_id, is_definition


def names_of(symbols: DataFrame) -> DataFrame:
    """(file_id, name, own, signature): a file's definitions of each name, and the target
    of its first import of that name. All tiers read this one aggregate."""
    one = F.struct("start_line", "ordinal", "end_line", "symbol_id")
    own = F.collect_list(F.when(is_definition(F.col("kind")), one))
    first = F.min_by(F.when(F.col("kind") == "import", F.col("signature")), F.when((F.col("kind") == "import") & F.col("signature").isNotNull(), F.col("ordinal")))
    return symbols.groupBy("file_id", "name").agg(own.alias("own"), first.alias("signature"))


def follow_imports(files: DataFrame, names: DataFrame) -> DataFrame:
    """(file_id, name, import_id): what the import leads to, in one hop, if anything."""
    asked = names.where("signature is not null").join(files.select("file_id", "language", "path"), "file_id")
    asked = asked.select("file_id", "name", F.posexplode(import_candidates(F.col("signature"), F.col("language"), F.col("path"))).alias("nth", "c"))
    asked = asked.select(F.col("file_id").alias("from_id"), F.col("name").alias("as_name"), "nth", file_id(F.col("c.path")).alias("file_id"), F.col("c.name").alias("name"))
    earliest = names.where(F.size("own") > 0).select("file_id", "name", F.array_min("own")["symbol_id"].alias("symbol_id"))
    found = asked.join(earliest, ["file_id", "name"]).groupBy("from_id", "as_name").agg(F.min_by("symbol_id", "nth").alias("import_id"))
    return found.select(F.col("from_id").alias("file_id"), F.col("as_name").alias("name"), "import_id")


def only_definitions(names: DataFrame) -> DataFrame:
    """(name, only_id) of names that are defined exactly once."""
    found = names.where(F.size("own") > 0).groupBy("name").agg(F.sum(F.size("own")).alias("n"), F.min(F.get("own", F.lit(0))["symbol_id"]).alias("only_id"))
    return found.where("n = 1").select("name", "only_id")


def pick(candidates, line):
    """The innermost definition around the line, else the earliest, of an array of
    (start_line, ordinal, end_line, symbol_id); ties go to the first in the file."""
    around = F.filter(candidates, lambda d: (d["start_line"] <= line) & (line <= d["end_line"]))
    inner = F.array_max(F.transform(around, lambda d: F.struct(d["start_line"].alias("s"), (-d["ordinal"]).alias("o"), d["symbol_id"].alias("id"))))
    return F.coalesce(inner["id"], F.array_min(candidates)["symbol_id"])


def resolve(files: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """refs (file_id, name, line) with resolved_symbol_id and confidence."""
    used = refs.groupBy("file_id", "name").agg(F.collect_list("line").alias("lines"))
    names = names_of(symbols)
    keyed = used.join(names.select("file_id", "name", "own"), ["file_id", "name"], "left").join(follow_imports(files, names), ["file_id", "name"], "left").join(only_definitions(names), "name", "left")
    each = keyed.select("file_id", "name", F.explode("lines").alias("line"), F.when(F.size("own") > 0, F.col("own")).alias("own"), "import_id", "only_id")
    exact = F.when(F.col("own").isNotNull(), pick(F.col("own"), F.col("line")))
    return each.select(
        "file_id",
        "name",
        "line",
        F.coalesce(exact, "import_id", "only_id").alias("resolved_symbol_id"),
        F.when(F.col("own").isNotNull(), "exact").when(F.col("import_id").isNotNull(), "import").otherwise("name-only").alias("confidence"),
    )


def with_resolution(files: DataFrame, symbols: DataFrame, refs: DataFrame) -> Index:
    return Index(files, symbols, resolve(files, symbols, refs.select("file_id", "name", "line")))
