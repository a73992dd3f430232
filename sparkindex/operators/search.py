"""Symbol search: token index with BM25, match tiers, features, ranking.

The token rules: a query's `\\w+` runs are phrases; a phrase's tokens are its letters-and-
digits runs, folded, and its last token is a prefix. A phrase occurs in a column where its
tokens stand consecutively; a symbol matches if every phrase occurs in some column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkindex.functions.paths import shared_directories
from sparkindex.functions.text import folded_text, search_tokens
from sparkindex.model import Index
from sparkindex.operators.lookups import SYMBOL_ROW, lookup_exact, lookup_like, symbol_rows

#: Match tiers, kind weights, and how many recent files count for locality (fixed values).
EXACT, PREFIX, SUBSTRING, TOKENS = 3, 2, 1, 0
KIND_WEIGHTS = {"function": 1.0, "class": 1.0, "method": 0.9, "const": 0.6, "import": 0.3}
OTHER_KIND = 0.5
RECENT_FILES = 20
COLUMNS = ("name", "qualified_name", "signature")
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Weights:
    """Weights of the linear score."""

    match: float = 3.0
    kind: float = 1.0
    popularity: float = 1.0
    locality: float = 0.5
    recency: float = 0.5


def phrases(text: str) -> list[list[str]]:
    """The folded tokens of each phrase of a query."""
    runs = (re.findall(r"[^\W_]+", folded_text(run)) for run in re.findall(r"\w+", text))
    return [run for run in runs if run]


def occurrences(tokens: Column, phrase: list[str]) -> Column:
    """How often a phrase occurs in an array of tokens; its last token is a prefix."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t.startswith(phrase[0])))
    last = len(phrase) - 1

    def here(_, i: Column) -> Column:
        match = F.coalesce(F.get(tokens, i + last).startswith(phrase[-1]), F.lit(False))
        for k, word in enumerate(phrase[:-1]):
            match = match & F.coalesce(F.get(tokens, i + k) == word, F.lit(False))
        return match

    return F.size(F.filter(tokens, here))


def token_matches(index: Index, text: str) -> DataFrame:
    """(.. symbol row, score) of the symbols that match every phrase; lower is better.

    One scan: the counts that the scores need are windows over nothing, computed as
    one partial aggregate, not by moving the symbols.
    """
    asked = phrases(text)
    rows = symbol_rows(index)
    if not asked:
        return rows.limit(0).withColumn("score", F.lit(0.0))
    tokened = rows.withColumns({f"t_{c}": search_tokens(F.col(c)) for c in COLUMNS})
    counted = tokened.withColumns({f"f{k}": sum((occurrences(F.col(f"t_{c}"), p) for c in COLUMNS), F.lit(0)) for k, p in enumerate(asked)})
    counted = counted.withColumn("d", sum((F.size(f"t_{c}") for c in COLUMNS), F.lit(0)))
    totals = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("avg_d"), *[F.count(F.when(F.col(f"f{k}") > 0, 1)).alias(f"n{k}") for k in range(len(asked))])
    matched = counted
    for k in range(len(asked)):
        matched = matched.where(F.col(f"f{k}") > 0)
    score = F.lit(0.0)
    for k in range(len(asked)):
        idf = F.log((F.col("n") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5))
        f = F.col(f"f{k}")
        score = score - F.when(idf > 0, idf).otherwise(F.lit(1e-6)) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("d") / F.col("avg_d")))
    return matched.crossJoin(F.broadcast(totals)).select(*SYMBOL_ROW, score.alias("score"))  # totals is one row


def token_search(index: Index, text: str, limit: int = 50) -> DataFrame:
    return token_matches(index, text).orderBy("score", "path", "start_line", "ordinal").limit(limit)


def candidates(index: Index, text: str, limit: int = 200) -> DataFrame:
    """Symbols that match in some way, each once with its best tier; every source is cut
    at the limit first."""
    sources = [
        (lookup_exact(index, text, limit), EXACT),
        (lookup_like(index, text + "%", limit), PREFIX),
        (lookup_like(index, "%" + text + "%", limit), SUBSTRING),
        (token_search(index, text, limit).drop("score"), TOKENS),
    ]
    found = None
    for rows, tier in sources:
        rows = rows.withColumn("match_tier", F.lit(tier))
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy(*SYMBOL_ROW).agg(F.max("match_tier").alias("match_tier"))


def kind_weight(kind: Column) -> Column:
    weight = F.lit(OTHER_KIND)
    for name, value in KIND_WEIGHTS.items():
        weight = F.when(kind == name, F.lit(value)).otherwise(weight)
    return weight


def recency(files: DataFrame) -> DataFrame:
    """(path, recency): a file's place by mtime, from 0 to 1; a single file has 0.

    Places are counted by ranges of mtime: counts of each range on the driver side of one
    window over ranges, ranks only within a range.
    """
    ranged = files.select("path", "mtime").repartitionByRange("mtime", "path").withColumn("part", F.spark_partition_id())
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("mtime", "path"))
    return ranged.withColumn("nth", nth).join(before, "part").select("path", ((F.col("before") + F.col("nth") - 1) / F.greatest(F.col("total") - 1, F.lit(1))).alias("recency"))


def features(index: Index, found: DataFrame, recent_files: int = RECENT_FILES) -> DataFrame:
    """Candidates with kind weight, popularity, locality and recency."""
    uses = index.refs.where("resolved_symbol_id is not null").join(F.broadcast(found.select(F.col("symbol_id").alias("resolved_symbol_id"))), "resolved_symbol_id", "left_semi")
    popularity = uses.groupBy(F.col("resolved_symbol_id").alias("symbol_id")).agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("uses"))
    recent = index.files.orderBy(F.desc("mtime"), "path").limit(recent_files).agg(F.collect_list("path").alias("recent"))
    rows = found.join(popularity, "symbol_id", "left").join(recency(index.files), "path").crossJoin(F.broadcast(recent))
    most = F.max("uses").over(Window.partitionBy())
    near = F.array_max(F.transform("recent", lambda r: F.when(r == F.col("path"), F.lit(1.0)).otherwise(shared_directories(F.col("path"), r))))
    return rows.select(*SYMBOL_ROW, "match_tier", kind_weight(F.col("kind")).alias("kind_weight"), F.coalesce(F.col("uses") / most, F.lit(0.0)).alias("popularity"), F.coalesce(near, F.lit(0.0)).alias("locality"), "recency")


def scored(rows: DataFrame, weights: Weights = Weights()) -> DataFrame:  # noqa: B008
    w = weights
    total = F.lit(w.match) * F.col("match_tier") / F.lit(float(EXACT)) + F.lit(w.kind) * F.col("kind_weight") + F.lit(w.popularity) * F.col("popularity") + F.lit(w.locality) * F.col("locality") + F.lit(w.recency) * F.col("recency")
    return rows.withColumn("score", total)


def ranked_search(index: Index, text: str, limit: int = 20, weights: Weights = Weights(), pool: int = 200) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """The best symbols, and one row (total) with how many candidates there were."""
    found = candidates(index, text, pool)
    best = scored(features(index, found), weights).orderBy(F.desc("score"), "path", "start_line", "ordinal").limit(limit)
    return best, found.agg(F.count(F.lit(1)).alias("total"))
