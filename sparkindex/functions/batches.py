"""Arrow batches for Python workers, bounded by bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes that a worker is sent at a time, unless the session sets a bound itself.
BATCH_BYTES = 8 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow whose batches do not grow with the length of texts or files."""
    if df.sparkSession.conf.get(_BOUND, None) is None:
        df.sparkSession.conf.set(_BOUND, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)
