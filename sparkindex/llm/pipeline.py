"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and returns a DataFrame.

Decisions are made row by row: a row is numbered while a stage works on it, so repeated or
null ids neither drop nor keep another row. All stages but the last return the columns of
documents, whatever other columns the table has.

Null and empty texts are scored, compared and packed like others. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkindex.llm.common import discard, map_batches, materialize, table
from sparkindex.llm.minhash import SHARED_ROWS, repeats
from sparkindex.llm.packing import pack, pieces
from sparkindex.llm.positional import search, write_index
from sparkindex.llm.quality import THRESHOLD, fit, matrix, statistics, training, with_statistics

#: Rows of a file are numbered in so many bits, files in what is left.
FILE_BITS = 40


def fresh(name: str, docs: DataFrame) -> str:
    """A column name that docs does not have."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def stored(docs: DataFrame) -> bool:
    """Whether docs is a Parquet table just as it lies in its files."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().toString() == "Parquet"


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row that stays the same, and the name of that column. Rows
    of a stored table are numbered by file and place in it, which every scan finds alike, so no
    text is written again; others are written with their numbers."""
    name = fresh("row", docs)
    if not stored(docs):
        return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name
    path, file = fresh("path", docs), fresh("file", docs)
    known = docs.metadataColumn("_metadata")
    rows = docs.select("*", known["file_path"].alias(path), known["row_index"].alias(name))
    files = sorted(r[0] for r in rows.select(path).distinct().collect())
    ranks = docs.sparkSession.createDataFrame(pa.table({path: pa.array(files, pa.string()), file: pa.array(range(len(files)), pa.int64())}))
    placed = rows.join(F.broadcast(ranks), path)
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], (F.shiftleft(F.col(file), FILE_BITS) + F.col(name)).alias(name)), name


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores below its threshold go. The score depends on the
    text alone, so of equal texts all or none stay; null counts as empty."""
    labels = table(spark, sf_dir, "labels")
    marked = materialize(training(labels).select("id").distinct(), "labelled-ids")
    marked = F.broadcast(marked) if marked.count() <= SHARED_ROWS else marked
    learnt = docs.select(docs["doc_id"].alias("id"), docs["text"].alias("text")).join(marked, "id", "left_semi")
    shared = spark.sparkContext.broadcast(fit(with_statistics(learnt, "id"), labels))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = pa.array([statistics(x.as_py()) for x in batch.column(at)], pa.list_(pa.float64()))
                yield batch.filter(pa.array(shared.value.score(matrix(values)) >= THRESHOLD))

    return map_batches(docs, keep, docs.schema)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose sets of five-word shingles have similarity 0.8 or more are linked, and of
    each group that links connect one row stays: the one that the table has first, by
    files and places in them. Links come from the SimHash operator, checked on whole texts,
    and what its fingerprints cannot reach from MinHash bands, checked likewise. All texts
    without words, null ones too, are one group."""
    rows, row = numbered(docs)
    gone = repeats(rows, row).withColumnRenamed("id", row)
    gone = F.broadcast(gone) if gone.count() <= SHARED_ROWS else gone
    return rows.join(gone, row, "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a window of the benchmark go; a null or empty text has none and stays."""
    rows, row = numbered(docs)
    index = write_index(rows, row)
    found = search(index, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(F.col("id").alias(row))
    found = materialize(found, "contaminated")
    discard(index)
    return rows.join(found, row, "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, cut and packed; a null or empty text is its closing id alone."""
    return pack(pieces(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", good_quality),
    ("near duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
#: The classifier, the fingerprints and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, made = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if made is not None:
            discard(made)
        made = docs
    return STAGES[-1][1](spark, docs, sf_dir)
