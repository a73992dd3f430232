"""Token budgets: the prefix of an answer that fits, and its metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkindex.functions.text import token_estimate

MAX_TOKENS = 700


def within_budget(lines: DataFrame, max_tokens: int = MAX_TOKENS, by: tuple[str, ...] = (), order: str = "rn") -> DataFrame:
    """The first lines (.., rn, line) of each answer whose estimates sum to the budget at
    most; the first line always stays."""
    window = Window.partitionBy(*by).orderBy(order)
    spent = lines.withColumn("nth", F.row_number().over(window)).withColumn("spent", F.sum(token_estimate(F.col("line"))).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return spent.where((F.col("nth") == 1) | (F.col("spent") <= max_tokens)).drop("nth", "spent")


@dataclass(frozen=True)
class Answer:
    """Lines and what a reader must know about them."""

    lines: tuple[str, ...]
    truncated: bool
    total_matches: int
    index_age_ms: int
    notes: tuple[str, ...] = ()

    def render(self) -> str:
        cut = [f"truncated: true, total_matches: {self.total_matches}"] if self.truncated else []
        return "\n".join([*self.lines, *cut, f"index_age_ms: {self.index_age_ms}", *self.notes])


def answer(lines: DataFrame, total: int, age_ms: int, max_tokens: int = MAX_TOKENS, notes: tuple[str, ...] = ()) -> Answer:
    """An answer of lines (rn, line); only what fits the budget reaches the driver."""
    kept = tuple(r.line for r in within_budget(lines, max_tokens).orderBy("rn").collect())
    return Answer(kept, len(kept) < total, total, age_ms, notes)


def miss(reason: str) -> str:
    """What to say when there is nothing to show."""
    return f"sparkindex: {reason}. Try grep or ripgrep instead: the text may exist without being indexed."


def symbol_line(detail=("qualified_name", "kind", "path", "start_line", "signature")):
    name, kind, path, line, signature = (F.col(c) for c in detail)
    return F.concat(name, F.lit("  "), kind, F.lit("  "), path, F.lit(":"), line.cast("string"), F.when(F.coalesce(signature, F.lit("")) != "", F.concat(F.lit("  "), signature)).otherwise(F.lit("")))


def reference_line(with_target: bool = True):
    base = F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit("  "), "name", F.lit("  ["), "confidence", F.lit("]"))
    target = F.when(F.col("resolved_qualified_name").isNotNull(), F.concat(F.lit("  -> "), "resolved_qualified_name", F.lit(" ("), "resolved_path", F.lit(")"))).otherwise(F.lit(""))
    return F.concat(base, target) if with_target else base


def outline_line(with_signature: bool = True):
    base = F.concat(F.col("start_line").cast("string"), F.lit("  "), "qualified_name", F.lit("  "), "kind")
    detail = F.when(F.coalesce("signature", F.lit("")) != "", F.concat(F.lit("  "), "signature")).otherwise(F.lit(""))
    return F.concat(base, detail) if with_signature else base


def indented_outline_line():
    """An outline line for a terminal, indented by its depth."""
    depth = F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.size(F.split("parent", "\\.")))
    return F.concat(F.lpad(F.col("start_line").cast("string"), 5, " "), F.lit("  "), F.repeat(F.lit("  "), depth), "name", F.lit("  "), "kind", F.lit("  "), F.coalesce("signature", "qualified_name"))


def map_line():
    top = F.when(F.size("top_symbols") == 0, F.lit("-")).otherwise(F.array_join("top_symbols", ", "))
    return F.concat("path", F.lit("  ("), "language", F.lit(", "), F.col("symbol_count").cast("string"), F.lit(" symbols, "), F.col("incoming_refs").cast("string"), F.lit(" inbound)  "), top)
