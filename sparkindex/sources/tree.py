"""Source trees: discovery, and a Spark data source that reads them.

Spark's own file sources pass over names that begin with `_` or `.`, so they would miss
every `__init__.py`; this source lists a tree itself, never entering ignored directories,
and its tasks read the files. The root must be reachable from all executors.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkindex.functions.hashing import content_hash
from sparkindex.model import IGNORED, LANGUAGES, MAX_FILE_BYTES

#: Files that one task reads, at most; each is at most the size cap.
SPLIT_FILES = 500
SCHEMA = "path string, language string, content_hash string, mtime double, length long, content binary, state string"


def language_of(path: str) -> str | None:
    return LANGUAGES.get(os.path.splitext(path)[1].lower())


def in_ignored_directory(path: str) -> bool:
    """Whether a directory part of a relative path is on the ignore list."""
    return any(part in IGNORED for part in path.split("/")[:-1])


def _filesystem(root: str):
    """(file system, path in it): a local one, or whatever the URI names."""
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(root)
    return fs.FileSystem.from_uri(root)


def git_listing(root: str) -> list[str] | None:
    """Tracked and untracked but not ignored paths; None if git can't tell."""
    if not os.path.exists(os.path.join(root, ".git")):
        return None
    try:
        done = subprocess.run(["git", "ls-files", "--cached", "--others", "--exclude-standard", "-z"], cwd=root, capture_output=True, timeout=60, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return [p for p in done.stdout.decode("utf-8", "replace").split("\0") if p] if done.returncode == 0 else None


def walk(root: str) -> Iterator[str]:
    """Relative paths under root, sorted by name, ignored directories left out."""
    from pyarrow import fs

    system, top = _filesystem(root)
    if isinstance(system, fs.LocalFileSystem):
        for folder, folders, names in os.walk(top):
            folders[:] = sorted(f for f in folders if f not in IGNORED)
            for name in sorted(names):
                yield os.path.relpath(os.path.join(folder, name), top).replace(os.sep, "/")
        return
    waiting = [top]
    while waiting:
        for info in sorted(system.get_file_info(fs.FileSelector(waiting.pop())), key=lambda i: i.path):
            if info.type == fs.FileType.Directory:
                if info.base_name not in IGNORED:
                    waiting.append(info.path)
            else:
                yield os.path.relpath(info.path, top)


def listed(root: str, use_git: bool = True) -> Iterator[str]:
    """Relative paths of the source files under root."""
    local = "://" not in root
    found = git_listing(root) if use_git and local else None
    for path in walk(root) if found is None else sorted(found):
        if language_of(path) is not None and not in_ignored_directory(path):
            yield path


def ignored(root: str, paths: list[str]) -> set[str]:
    """Those of the paths that the same rule leaves out; git is asked once, where there is
    a repository, and where it can't answer nothing more is ignored."""
    out = {path for path in paths if in_ignored_directory(path)}
    rest = [path for path in paths if path not in out]
    if rest and os.path.exists(os.path.join(root, ".git")):
        try:
            told = subprocess.run(["git", "check-ignore", "--stdin", "-z"], cwd=root, input="\0".join(rest).encode("utf-8", "surrogateescape"), capture_output=True, timeout=60, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return out
        out |= {path for path in told.stdout.decode("utf-8", "surrogateescape").split("\0") if path}
    return out


def is_ignored(root: str, path: str) -> bool:
    return path in ignored(root, [path])


def read_file(root: str, path: str, max_bytes: int = MAX_FILE_BYTES) -> tuple:
    """(path, language, content_hash, mtime, length, content, state) of one file: state is
    ok, large, failed or gone; only an ok file has content."""
    from pyarrow import fs

    system, top = _filesystem(root)
    language = language_of(path)
    try:
        info = system.get_file_info(f"{top}/{path}")
        if info.type != fs.FileType.File:
            return path, language, None, None, None, None, "gone"
        mtime = info.mtime_ns / 1e9 if info.mtime_ns is not None else 0.0
        if info.size > max_bytes:
            return path, language, None, mtime, info.size, None, "large"
        with system.open_input_stream(f"{top}/{path}") as stream:
            data = stream.read()
    except OSError:
        return path, language, None, None, None, None, "failed"
    return path, language, content_hash(data), mtime, len(data), data, "ok"


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.max_bytes = int(options.get("maxbytes", MAX_FILE_BYTES))
        self.use_git = options.get("git", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        """Files dealt to tasks by count; sizes are only known where files are read."""
        paths = list(listed(self.root, self.use_git))
        step = max(1, min(SPLIT_FILES, -(-len(paths) // 64)))
        return [_Files(paths[k : k + step]) for k in range(0, len(paths), step)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield read_file(self.root, path, self.max_bytes)


class SourceTree(DataSource):
    """spark.read.format("sourcetree").option("git", ..).option("maxBytes", ..).load(root)"""

    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_tree(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES, use_git: bool = True) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return spark.read.format("sourcetree").option("maxBytes", str(max_bytes)).option("git", str(use_git).lower()).load(root)


def read_paths(spark: SparkSession, root: str, paths: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """The state of the given paths (path) now. What discovery would not list is gone."""

    def run(frames):
        import pandas as pd

        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for frame in frames:
            rows = []
            out = ignored(root, list(frame["path"]))
            for path in frame["path"]:
                known = language_of(path) is not None and path not in out
                rows.append(read_file(root, path, max_bytes) if known else (path, language_of(path), None, None, None, None, "gone"))
            yield pd.DataFrame(rows, columns=names)

    return paths.select("path").distinct().mapInPandas(run, SCHEMA)
