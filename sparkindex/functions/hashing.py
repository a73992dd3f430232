"""Content hashes."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_hash(data: bytes) -> str:
    """BLAKE2b with a digest of 16 bytes, as 32 hexadecimal characters."""
    return hashlib.blake2b(data, digest_size=16).hexdigest()


@F.pandas_udf(T.StringType())
def blake2b(content: pd.Series) -> pd.Series:
    """content_hash over a column, in Arrow batches: Spark has no BLAKE2b."""
    return content.map(lambda data: None if data is None else content_hash(bytes(data)))


def repository_id(real_path: Column) -> Column:
    """The first 16 hexadecimal characters of the path's SHA-256."""
    return F.substring(F.sha2(real_path, 256), 1, 16)
