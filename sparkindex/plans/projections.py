"""Tables of other kinds as index relations, so that every operator runs on any data.

Star schema as a code graph: a supplier is a file, a part a definition in the file of its
number, imported by the next five files; a line item is a use of the part in the file of
its supplier. Events are an episode log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkindex.model import Index, file_id, symbol_id
from sparkindex.operators.resolve import with_resolution

NOW = 1_800_000_000.0
IMPORTERS = 5
#: Suppliers up to which their paths are broadcast (some 100 bytes each); more are shuffled.
BROADCAST_ROWS = 100_000


_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its footer is read once in a session, its rows by every query."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _TABLES[key]


def since_epoch(column: str, unit: str):
    """Whole units since 1970, whatever the session's time zone."""
    return F.expr(f"timestampdiff({unit}, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def star_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(suppkey, s_name, path) of each supplier."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    placed = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return placed.select(F.col("s_suppkey").alias("suppkey"), "s_name", F.concat("r_name", F.lit("/"), "n_name", F.lit("/"), "s_name", F.lit(".py")).alias("path"))


def star_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation files; a file's time is that of its last line item."""
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("suppkey")).agg(F.max("l_shipdate").alias("last"))
    return star_paths(spark, sf_dir).join(shipped, "suppkey", "left").select(
        file_id(F.col("path")).alias("file_id"),
        "path",
        F.lit("python").alias("language"),
        F.md5("s_name").alias("content_hash"),
        F.coalesce(since_epoch("last", "SECOND").cast("double"), F.lit(0.0)).alias("mtime"),
        F.lit(NOW - 60).alias("indexed_at"),
    )


def kind_of(p_type):
    return F.when(p_type == "STANDARD", "function").when(p_type == "MEDIUM", "class").when(p_type == "PROMO", "method").otherwise("const")


def star_relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files, symbols and unresolved references."""
    files_n = table(spark, sf_dir, "supplier").count()
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" "), "p_brand").alias("name"), "p_type", "p_size", (F.col("p_partkey") % files_n).alias("home"))
    paths = star_paths(spark, sf_dir).select("suppkey", "path")
    if files_n <= BROADCAST_ROWS:
        paths = F.broadcast(paths)
    homes = part.join(paths, F.col("home") == F.col("suppkey")).select(part.columns + ["path"])
    defined = homes.select("path", "p_partkey", "name", F.concat("p_type", F.lit("."), "name").alias("qualified_name"), kind_of(F.col("p_type")).alias("kind"), (F.col("p_partkey") % 40 + 1).cast("int").alias("start_line"), (F.col("p_partkey") % 40 + 1 + F.col("p_size")).cast("int").alias("end_line"), F.lit(None).cast("string").alias("signature"))
    breadcrumb = F.concat(F.regexp_replace(F.regexp_replace("path", "\\.py$", ""), "/", "."), F.lit("."), "name")
    spread = homes.select("p_partkey", "name", breadcrumb.alias("signature"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(IMPORTERS)), lambda j: (F.col("home") + j) % files_n)).alias("suppkey"))
    imported = spread.join(paths, "suppkey").select("path", "p_partkey", "name", F.col("name").alias("qualified_name"), F.lit("import").alias("kind"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), "signature")
    order = Window.partitionBy("path").orderBy("start_line", "qualified_name", "p_partkey")
    ordered = defined.unionByName(imported).withColumn("ordinal", (F.row_number().over(order) - 1).cast("int"))
    symbols = ordered.select(symbol_id(F.col("path"), F.col("ordinal")).alias("symbol_id"), file_id(F.col("path")).alias("file_id"), "ordinal", "name", "qualified_name", "kind", "start_line", "end_line", "signature", F.lit(None).cast("long").alias("parent_id"))
    used = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_orderkey") % 60 + 1).cast("int").alias("line"))
    refs = used.join(part.select("p_partkey", "name"), F.col("l_partkey") == F.col("p_partkey")).join(paths, F.col("l_suppkey") == F.col("suppkey")).select(file_id(F.col("path")).alias("file_id"), "name", "line").distinct()
    return star_files(spark, sf_dir), symbols, refs


def star_index(spark: SparkSession, sf_dir: str) -> Index:
    return with_resolution(*star_relations(spark, sf_dir))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines: half are model turns, a quarter tool calls, a quarter results."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    what = F.col("event_id") % 4
    kind = F.when(what < 2, "model").when(what == 2, "tool").otherwise("result")
    return events.select(
        (since_epoch("ts", "MICROSECOND") / 1e6).alias("ts"),
        F.concat(F.lit("task"), (F.col("user_id") % 8).cast("string")).alias("task"),
        F.col("event_type").alias("contestant"),
        (F.floor(F.col("user_id") / 8) % 3).cast("int").alias("rep"),
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        F.when(kind == "model", F.floor("value").cast("long")).alias("prompt_tokens"),
        F.when(kind == "model", k).alias("completion_tokens"),
        F.when(kind == "tool", F.when(F.col("event_id") % 16 == 14, "grep").otherwise("read_file")).alias("name"),
        F.when((kind == "tool") & (F.col("event_id") % 32 != 2), F.concat(F.lit("src/f"), (k % 5).cast("string"), F.lit(".py"))).alias("path"),
        F.when(kind == "result", F.concat(F.lit("see src\\f"), (k % 5).cast("string"), F.lit(".py, line "), k.cast("string"))).alias("answer"),
        F.when((kind == "result") & (F.col("event_id") % 16 == 15), "step-cap").alias("failure"),
    )


CHECK = "struct<type:string,file:string,line_between:array<int>,values:array<string>,pattern:string>"
#: id, split, question, check: the tasks that event logs are scored against.
TASKS = [
    ("task0", "dev", "where is it", ("location", "src/f0.py", None, None, None)),
    ("task1", "dev", "where is it", ("location", "src/f1.py", [1, 60], None, None)),
    ("task2", "holdout", "which files", ("contains_all", None, None, ["src/f", ".py"], None)),
    ("task3", "dev", "which line", ("regex", None, None, None, "line [0-9]*[02468]$")),
    ("task4", "holdout", "which files", ("contains_all", None, None, ["src/f4", "line"], None)),
    ("task5", "dev", "where is it", ("location", "src/f2.py", [10, 99], None, None)),
    ("task6", "dev", "which line", ("regex", None, None, None, "f[13]\\.py")),
]


def tasks(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(TASKS if rows is None else rows, f"id string, split string, question string, check {CHECK}")
