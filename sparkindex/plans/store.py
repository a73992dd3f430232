"""Versioned index snapshots in Parquet.

A version is a folder with the three tables; a manifest, written beside and renamed to
its number, makes it visible. Readers see whole versions only, a failed writer leaves
folders that nothing reads, and two writers cannot publish the same version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkindex.model import FILES, RESOLVED, SCHEMA_VERSION, SYMBOLS, Index

TABLES = {"files": FILES, "symbols": SYMBOLS, "refs": RESOLVED}
#: What a table's files are sorted by, and the columns with Bloom filters: a lookup of one
#: name, id or path skips pages by the order and row groups by the filters. Rows stay in their
#: partitions, so no name that is used everywhere gathers in one.
ORDER = {"files": ["path"], "symbols": ["name"], "refs": ["resolved_symbol_id", "name"]}
FILTERED = {"files": ["path"], "symbols": ["name", "qualified_name", "file_id"], "refs": ["resolved_symbol_id", "name"]}


class Store:
    """The snapshots under one root, on any file system that Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._staging = f"staging/{uuid.uuid4().hex}"  # a writer's own, so that none removes another's
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("manifests")
        if not fs.exists(folder):
            return []
        names = (status.getPath().getName() for status in fs.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int) -> dict:
        stream = self._fs().open(self._path(f"manifests/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def exists(self) -> bool:
        """Whether there is a version of this schema; an older schema counts as none, so
        it is rebuilt."""
        found = self.versions()
        return bool(found) and self.manifest(found[-1])["schema_version"] == SCHEMA_VERSION

    def read(self, version: int | None = None) -> Index:
        if version is None:
            if not self.exists():
                return self.empty()
            version = self.versions()[-1]
        folder = self.manifest(version)["folder"]
        return Index(*(self.spark.read.schema(schema).parquet(f"{self.root}/{folder}/{name}") for name, schema in TABLES.items()))

    def empty(self) -> Index:
        return Index(*(self.spark.createDataFrame([], schema) for schema in TABLES.values()))

    def stage(self, frame: DataFrame) -> DataFrame:
        """Write an intermediate table under the root; its publication removes it."""
        return self.keep(frame, self._staging)

    def keep(self, frame: DataFrame, folder: str) -> DataFrame:
        """Write a table into a folder of the root and read it back."""
        path = f"{self.root}/{folder}/{uuid.uuid4().hex}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def write(self, index: Index) -> int:
        """Publish a version; the tables may be computed from earlier ones."""
        found = self.versions()
        version = found[-1] + 1 if found else 1
        folder = f"v{version:012d}-{uuid.uuid4().hex[:8]}"
        for name, schema in TABLES.items():
            frame = getattr(index, name).select(*[f.name for f in schema])
            filters = {f"parquet.bloom.filter.enabled#{column}": "true" for column in FILTERED[name]}
            frame.sortWithinPartitions(*ORDER[name]).write.options(**filters | {"parquet.bloom.filter.adaptive.enabled": "true"}).parquet(f"{self.root}/{folder}/{name}")
        fs = self._fs()
        draft, final = self._path(f"manifests/.{folder}"), self._path(f"manifests/{version:012d}.json")
        fs.mkdirs(draft.getParent())
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps({"schema_version": SCHEMA_VERSION, "version": version, "folder": folder}).encode()))
        stream.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"version {version} was published by another writer")
        fs.delete(self._path(self._staging), True)
        return version

    def prune(self, keep: int = 2) -> None:
        """Delete all but the newest versions, old outcomes and what writers have left staged;
        for a time when nobody writes."""
        fs = self._fs()
        for version in self.versions()[:-keep]:
            folder = self.manifest(version)["folder"]
            fs.delete(self._path(f"manifests/{version:012d}.json"), False)
            fs.delete(self._path(folder), True)
        for folder in ("outcomes", "staging"):
            fs.delete(self._path(folder), True)
