"""Building an index and keeping it up to date.

Whatever the way, the result is a function of the files: a refreshed index equals a
rebuilt one on everything but times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkindex.model import MAX_FILE_BYTES, Index, file_id
from sparkindex.operators.extraction import extracted, refs_of, symbols_of
from sparkindex.operators.resolve import with_resolution
from sparkindex.operators.snapshot import drift, stale_paths
from sparkindex.plans.store import Store
from sparkindex.sources.tree import read_paths, read_tree


@dataclass(frozen=True)
class Built:
    indexed: int
    skipped_large: int
    failed: int
    removed: int


def file_rows(sources: DataFrame, now: float) -> DataFrame:
    return sources.select(file_id(F.col("path")).alias("file_id"), "path", "language", "content_hash", "mtime", F.lit(now).alias("indexed_at"))


def index_of(sources: DataFrame, now: float, store: Store | None = None) -> Index:
    """The index of source rows (path, language, content_hash, mtime, content). With a
    store, what the scanners find is written there first, so files are parsed once."""
    found = extracted(sources)
    if store is not None:
        found = store.stage(found)
    return with_resolution(file_rows(sources, now), symbols_of(found), refs_of(found))


def outcomes(known: DataFrame, current: DataFrame) -> DataFrame:
    """(path, outcome) of current file states (path, content_hash, state) against the
    indexed files (path, content_hash): unchanged, updated, removed or absent."""
    old = known.select("path", F.col("content_hash").alias("old_hash"))
    there = F.col("state") == "ok"
    outcome = F.when(~there & F.col("old_hash").isNull(), "absent").when(~there, "removed").when(F.col("old_hash") == F.col("content_hash"), "unchanged").otherwise("updated")
    return current.join(old, "path", "left").select("path", outcome.alias("outcome"))


def replaced(index: Index, drop: DataFrame, fresh: Index | None) -> Index:
    """The index without the paths of drop and with fresh files, resolved anew."""
    gone = drop.select(file_id(F.col("path")).alias("file_id"))
    files, symbols, refs = (t.join(gone, "file_id", "left_anti") for t in (index.files, index.symbols, index.refs))
    refs = refs.select("file_id", "name", "line")
    if fresh is not None:
        files, symbols, refs = files.unionByName(fresh.files), symbols.unionByName(fresh.symbols), refs.unionByName(fresh.refs.select("file_id", "name", "line"))
    return with_resolution(files, symbols, refs)


def build(spark: SparkSession, root: str, store: Store, now: float, max_bytes: int = MAX_FILE_BYTES, use_git: bool = True) -> Built:
    """Index a whole tree: every file is read and extracted, none is kept from before."""
    sources = read_tree(spark, root, max_bytes, use_git).cache()
    try:
        counts = {r["state"]: r["n"] for r in sources.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
        removed = stale_paths(store.read(), sources.where("state = 'ok'")).count()
        store.write(index_of(sources.where("state = 'ok'"), now, store))
    finally:
        sources.unpersist()
    return Built(counts.get("ok", 0), counts.get("large", 0), counts.get("failed", 0) + counts.get("gone", 0), removed)


def refresh(spark: SparkSession, root: str, store: Store, paths: DataFrame, now: float, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Bring some paths (path) up to date; (path, outcome) of each. A version is published
    only if something changed, and with its references resolved."""
    return _apply(store, read_paths(spark, root, paths, max_bytes), now, False)


def sweep(spark: SparkSession, root: str, store: Store, now: float, max_bytes: int = MAX_FILE_BYTES, use_git: bool = True) -> DataFrame:
    """Bring the whole tree up to date, reading every file but extracting changed ones only."""
    return _apply(store, read_tree(spark, root, max_bytes, use_git), now, True)


def _apply(store: Store, current: DataFrame, now: float, whole: bool) -> DataFrame:
    """Publish what has changed; the outcomes are a table beside the snapshots, so that
    the driver never holds one row for each file."""
    current = current.cache()
    try:
        index = store.read()
        found = outcomes(index.files, current)
        if whole:
            found = found.unionByName(stale_paths(index, current).withColumn("outcome", F.lit("removed")))
        found = store.keep(found, "outcomes")
        changed = found.where("outcome in ('updated', 'removed')")
        kinds = {r["outcome"] for r in changed.select("outcome").distinct().collect()}
        if kinds:
            fresh = None
            if "updated" in kinds:
                updated = current.join(found.where("outcome = 'updated'").select("path"), "path", "left_semi")
                fresh = index_of(updated, now, store)
            store.write(replaced(index, changed, fresh))
    finally:
        current.unpersist()
    return found


def check(spark: SparkSession, root: str, store: Store, max_bytes: int = MAX_FILE_BYTES, use_git: bool = True) -> DataFrame:
    """Differences between the stored index and one built from the files now."""
    sources = read_tree(spark, root, max_bytes, use_git).where("state = 'ok'")
    return drift(index_of(sources, 0.0), store.read())
