"""What the operators of this subpackage share: shared storage and graph components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in spark.checkpoint.dir.

    Where neither that setting nor the context names one, it is a temporary folder in
    local mode and the warehouse on a cluster, whose machines share no temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        option = context._jsc.sc().getCheckpointDir()
        if option.isDefined():
            named = option.get()
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="sparkindex-"))
            named = context._jsc.sc().getCheckpointDir().get()
        else:
            named = spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/sparkindex/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost
    executor costs no recomputation of what came before."""
    path = new_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/sparkindex/" in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of texts that a Python worker is sent at a time.
BATCH_BYTES = 8 << 20


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with batches bounded by bytes as well as by rows, so that long texts
    need no more memory than short ones. A bound the session sets itself is kept."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(bound, None) is None:
        df.sparkSession.conf.set(bound, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b: long): a row (node, comp) for each node,
    comp being the smallest node of its component.

    Every round hooks each component to its smallest neighbour, shortens the pointers
    to their roots and contracts the edges, so edges at least halve; all is joins and
    map-side combined minima, nothing is gathered on the driver but emptiness.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "hook")
        while True:
            parent = up.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
            jumped = materialize(up.join(parent, "comp").select("node", F.col("above").alias("comp"), (F.col("above") != F.col("comp")).alias("moved")), "jump")
            discard(up)
            up = jumped.select("node", "comp")
            if jumped.where("moved").isEmpty():
                break
        if label is None:
            label = up
        else:
            old = label
            label = materialize(old.join(up.select(F.col("node").alias("comp"), F.col("comp").alias("above")), "comp", "left").select("node", F.coalesce("above", "comp").alias("comp")), "label")
        ends = edges.join(up.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b")
        rest = materialize(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(edges)
        edges = rest
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return label
