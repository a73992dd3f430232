"""Episode logs, task files, recordings and dataset manifests."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = (
    "ts double, task string, contestant string, rep int, step int, kind string, prompt_tokens long, completion_tokens long, answered boolean, tool_calls array<string>, "
    "name string, arguments struct<path:string>, result_chars long, answer string, failure string, success boolean, total_tokens long, wasted_reads int, wall_seconds double, task_id string, repetition int"
)
CHECK = "struct<type:string,file:string,line_between:array<int>,values:array<string>,pattern:string>"
TASKS = f"repository string, tasks array<struct<id:string,split:string,question:string,check:{CHECK}>>"
TURN = "struct<tool_calls:array<struct<name:string,arguments:map<string,string>>>,answer:string,prompt_tokens:bigint,completion_tokens:bigint>"


def read_log(spark: SparkSession, paths) -> DataFrame:
    """Log lines of some JSONL files, blank lines skipped; seq is the order of writing:
    by file name, then by place in the file."""
    rows = spark.read.schema(LOG).json(paths)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", F.col("arguments.path").alias("path"), at.alias("seq")).where("task is not null")


def write_log(log: DataFrame, path: str) -> None:
    """One JSON object a line, times with three decimals."""
    kept = [f.split()[0] for f in LOG.split(", ") if f.split()[0] in log.columns]
    rounded = [F.round("ts", 3).alias("ts") if name == "ts" else F.col(name) for name in kept]
    log.select(F.to_json(F.struct(*rounded)).alias("value")).write.mode("append").text(path)


def read_tasks(spark: SparkSession, paths) -> DataFrame:
    """(id, repository, split, question, check) of every task of some task files."""
    rows = spark.read.option("multiLine", True).schema(TASKS).json(paths)
    return rows.select("repository", F.explode("tasks").alias("t")).select("t.id", "repository", "t.split", "t.question", "t.check")


def read_recording(spark: SparkSession, paths) -> DataFrame:
    """(id, nth, tool_calls, answer, prompt_tokens, completion_tokens): recorded turns."""
    texts = spark.read.text(paths, wholetext=True)
    episodes = F.from_json("value", f"struct<episodes:map<string,struct<turns:array<{TURN}>>>>")["episodes"]
    rows = texts.select(F.explode(episodes).alias("id", "episode"))
    return rows.select("id", F.posexplode("episode.turns").alias("nth", "t")).select("id", "nth", "t.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, url, commit, valid): a commit is 40 hexadecimal digits."""
    rows = spark.read.option("multiLine", True).schema("repositories array<struct<name:string,url:string,commit:string>>").json(path)
    return rows.select(F.explode("repositories").alias("d")).select("d.*", F.coalesce(F.col("d.commit").rlike("^[0-9a-f]{40}$"), F.lit(False)).alias("valid"))


def repository_id(root: str) -> str:
    """A stable id of a checkout: of its real path."""
    return hashlib.sha256(os.path.normcase(os.path.realpath(root)).encode()).hexdigest()[:16]


def cache_root(environment=os.environ) -> str:
    """Where indexes are kept unless a folder is given."""
    if os.name == "nt" and environment.get("LOCALAPPDATA"):
        return os.path.join(environment["LOCALAPPDATA"], "sparkindex")
    named = environment.get("XDG_CACHE_HOME", "")
    return os.path.join(named if os.path.isabs(named) else os.path.join(os.path.expanduser("~"), ".cache"), "sparkindex")
