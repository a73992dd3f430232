"""The relations of an index and the constants that its operators share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1
#: Kinds of symbols that count as definitions; `import` is the fifth kind.
DEFINITION_KINDS = ("function", "class", "method", "const")
#: Lower-cased suffix to language (fixed values).
LANGUAGES = {
    ".py": "python", ".pyi": "python",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".tsx": "tsx",
}
JS_LANGUAGES = ("javascript", "typescript", "tsx")
#: What a relative JavaScript import may stand for, in order (fixed values).
JS_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
#: Directories that discovery never enters (fixed values).
IGNORED = (".git", ".hg", ".svn", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "venv", "node_modules", "dist", "build")
MAX_FILE_BYTES = 1_048_576

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}


def _struct(columns: str) -> T.StructType:
    """A schema of plain types; executors import this module, so no JVM may be asked."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


FILES = _struct("file_id long, path string, language string, content_hash string, mtime double, indexed_at double")
SYMBOLS = _struct("symbol_id long, file_id long, ordinal int, name string, qualified_name string, kind string, start_line int, end_line int, signature string, parent_id long")
REFS = _struct("file_id long, name string, line int")
RESOLVED = _struct("file_id long, name string, line int, resolved_symbol_id long, confidence string")


@dataclass
class Index:
    """files, symbols and resolved references; ids are hashes of values."""

    files: DataFrame
    symbols: DataFrame
    refs: DataFrame

    @property
    def spark(self):
        return self.files.sparkSession


def file_id(path):
    return F.xxhash64(path)


def symbol_id(path, ordinal):
    return F.xxhash64(path, ordinal)


def is_definition(kind):
    return kind.isin(*DEFINITION_KINDS)
