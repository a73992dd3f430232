"""The library's front: one object with every command, and the command line.

Answers are text for a reader; only what fits a token budget or a limit is collected.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import threading
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkindex.operators import budget, lookups
from sparkindex.operators.search import candidates, features, scored, token_search
from sparkindex.plans import indexing
from sparkindex.plans.store import Store
from sparkindex.sources.records import cache_root, repository_id


class CodeIndex:
    """The index of one source tree."""

    def __init__(self, spark: SparkSession, root: str, where: str | None = None):
        self.spark, self.root = spark, root
        self.where = where or os.path.join(cache_root(), repository_id(root))
        self.store = Store(spark, self.where)

    def build(self) -> indexing.Built:
        return indexing.build(self.spark, self.root, self.store, time.time())

    def refresh(self, *paths: str) -> dict[str, str]:
        asked = self.spark.createDataFrame([(p,) for p in paths], "path string")
        return {r.path: r.outcome for r in indexing.refresh(self.spark, self.root, self.store, asked, time.time()).collect()}

    def sweep(self) -> dict[str, str]:
        return {r.path: r.outcome for r in indexing.sweep(self.spark, self.root, self.store, time.time()).toLocalIterator()}

    def check(self) -> DataFrame:
        return indexing.check(self.spark, self.root, self.store)

    def stats(self) -> dict[str, int]:
        return lookups.stats(self.store.read()).first().asDict()

    def age_ms(self) -> int:
        return lookups.index_age_ms(self.store.read(), time.time()).first()[0]

    def _answer(self, rows: DataFrame, line, order: list, total: int | None, none: str, max_tokens: int) -> str:
        """The rows' lines that fit; one job finds them, how many there were, and the age."""
        if not self.store.exists():
            return budget.miss(f"{self.root} has not been indexed")
        every = Window.partitionBy()
        numbered = rows.select(F.row_number().over(Window.orderBy(*order)).alias("rn"), line.alias("line")).withColumn("n", F.count(F.lit(1)).over(every))  # at most a limit's rows
        kept = budget.within_budget(numbered, max_tokens)
        age = lookups.index_age_ms(self.store.read(), time.time())
        found = age.join(kept, F.lit(True), "left").orderBy("rn").collect()  # age is one row
        lines = tuple(r.line for r in found if r.rn is not None)
        if not lines:
            return budget.Answer((), False, 0, found[0].index_age_ms, (budget.miss(none),)).render()
        known = found[0].n if total is None else total
        return budget.Answer(lines, len(lines) < known, known, found[0].index_age_ms).render()

    def search_symbols(self, query: str, max_tokens: int = budget.MAX_TOKENS, limit: int = 100) -> str:
        """Ranked symbols that match a query by name."""
        index = self.store.read()
        found = candidates(index, query).cache()  # at most four times the pool
        try:
            best = scored(features(index, found)).orderBy(F.desc("score"), "path", "start_line", "ordinal").limit(limit)
            return self._answer(best, budget.symbol_line(), [F.desc("score"), F.col("path"), F.col("start_line"), F.col("ordinal")], found.count(), f"no symbol is named like {query!r}", max_tokens)
        finally:
            found.unpersist()

    def find_definition(self, name: str, max_tokens: int = budget.MAX_TOKENS) -> str:
        rows = lookups.find_definition(self.store.read(), name)
        return self._answer(rows, budget.symbol_line(), ["path", "start_line", "ordinal"], None, f"nothing defines {name!r}", max_tokens)

    def find_references(self, name: str, max_tokens: int = budget.MAX_TOKENS) -> str:
        rows = lookups.find_references(lookups.narrowed(self.store.read(), name), name)
        return self._answer(rows, budget.reference_line(), [F.col("resolved_qualified_name").isNull(), "path", "line", "name"], None, f"nothing uses {name!r}", max_tokens)

    def outline_file(self, path: str, max_tokens: int = budget.MAX_TOKENS) -> str:
        rows = lookups.outline_file(self.store.read(), path.replace(os.sep, "/"))
        return self._answer(rows, budget.outline_line(), ["start_line", "qualified_name"], None, f"{path!r} has no symbols; paths start at the root of the tree", max_tokens)

    def repo_map(self, max_tokens: int = budget.MAX_TOKENS) -> str:
        rows = lookups.repo_map(self.store.read())
        return self._answer(rows, budget.map_line(), [F.desc("incoming_refs"), "path"], None, "the index has no files", max_tokens)

    def tools(self) -> dict:
        """The five read-only lookups by name, for agents."""
        return {f.__name__: f for f in (self.search_symbols, self.find_definition, self.find_references, self.outline_file, self.repo_map)}


def _rows(index: CodeIndex, args) -> tuple[DataFrame, object]:
    held = index.store.read()
    if args.repo_map:
        return lookups.repo_map(held, args.limit), budget.map_line()
    if args.outline:
        return lookups.outline_file(held, args.name), budget.indented_outline_line()
    if args.references:
        return lookups.find_references(lookups.narrowed(held, args.name), args.name, args.limit), budget.reference_line()
    found = lookups.find_definition(held, args.name, args.limit)
    return (token_search(held, args.name, args.limit) if found.isEmpty() else found), budget.symbol_line()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Commands index, query, stats, check and serve; the exit code."""
    parser = argparse.ArgumentParser(prog="sparkindex")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "query", "stats", "check", "serve"):
        sub = commands.add_parser(name)
        sub.add_argument("--repo", default=".")
        sub.add_argument("--store")
        sub.add_argument("--json", action="store_true")
        if name == "query":
            sub.add_argument("name", nargs="?")
            sub.add_argument("--references", action="store_true")
            sub.add_argument("--outline", action="store_true")
            sub.add_argument("--repo-map", action="store_true", dest="repo_map")
            sub.add_argument("--limit", type=int, default=20)
        if name == "serve":
            sub.add_argument("--events", required=True)
            sub.add_argument("--checkpoint", required=True)
            sub.add_argument("--produce", action="store_true", help="write the events, too, by looking at the tree")
    args = parser.parse_args(argv)
    if not os.path.isdir(args.repo):
        print(f"not a directory: {args.repo}", file=sys.stderr)
        return 1
    if args.command == "query" and not args.repo_map and not args.name:
        print("query needs a name", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("sparkindex").getOrCreate()
    index = CodeIndex(spark, args.repo, args.store)
    if args.command == "index":
        began = time.time()
        report = vars(index.build()) | {"seconds": round(time.time() - began, 3)}
        print(json.dumps(report) if args.json else ", ".join(f"{k}: {v}" for k, v in report.items()))
        return 0
    if args.command == "serve":
        from sparkindex.streaming.watch import Producer, read_events, sweep_every, watch

        os.makedirs(args.events, exist_ok=True)
        stop = threading.Event()
        if args.produce:
            threading.Thread(target=Producer(args.repo, args.events).run, args=(stop,), daemon=True).start()
        queries = [watch(spark, args.repo, index.store, read_events(spark, args.events), f"{args.checkpoint}/events"), sweep_every(spark, args.repo, index.store, f"{args.checkpoint}/sweep")]
        try:
            spark.streams.awaitAnyTermination()
        finally:
            stop.set()
            for query in queries:
                query.stop()
        return 0
    if not index.store.exists():
        print(f"no index for {args.repo}; run `sparkindex index --repo {args.repo}` first", file=sys.stderr)
        return 1
    if args.command == "stats":
        report = index.stats()
        print(json.dumps(report) if args.json else ", ".join(f"{k}: {v}" for k, v in report.items()))
        return 0
    if args.command == "check":
        found = index.check().orderBy("table", "side", "row").limit(1000).collect()
        print(json.dumps([r.asDict() for r in found]) if args.json else "\n".join(f"{r.table} {r.side}: {r.row}" for r in found) or "no drift")
        return 1 if found else 0
    rows, line = _rows(index, args)
    if args.json:
        print(json.dumps([json.loads(x) for x in (r[0] for r in rows.select(F.to_json(F.struct(*[c for c in rows.columns if c not in ("symbol_id", "ordinal")]), {"ignoreNullFields": "false"})).collect())]))
    else:
        print("\n".join(r[0] for r in rows.select(line).collect()))
    return 0
