"""Change streams: events on paths keep an index fresh.

Events (path, dest_path, ts, op, is_directory) come from a stream of JSON files, which
Producer or any other watcher of the tree writes. A
micro-batch coalesces its events to one refresh of each path, so a storm on a path costs
one; an event that is late or repeated finds the file as it is now and changes nothing.
Events that never come are made good by a sweep.
"""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkindex.model import IGNORED, MAX_FILE_BYTES
from sparkindex.plans.indexing import refresh, sweep
from sparkindex.plans.store import Store
from sparkindex.sources.tree import listed

EVENTS = "path string, dest_path string, ts timestamp, op string, is_directory boolean"


def tree_state(root: str) -> dict[str, tuple[int, int]]:
    """(mtime in ns, size) of each source file under a local root."""
    found = {}
    for path in listed(root):
        try:
            status = os.stat(os.path.join(root, path))
        except OSError:  # gone since it was listed
            continue
        found[path] = (status.st_mtime_ns, status.st_size)
    return found


class Producer:
    """Tells the changes of a local tree as events: a file of JSON lines for each look at
    it that found some. Started with the state that the index has, nothing is missed."""

    def __init__(self, root: str, folder: str):
        self.root, self.folder, self.seen = root, folder, tree_state(root)
        os.makedirs(folder, exist_ok=True)

    def look(self) -> int:
        """How many events there were since the last look."""
        now = tree_state(self.root)
        ops = {path: "created" if path not in self.seen else "modified" for path, state in now.items() if self.seen.get(path) != state}
        ops |= dict.fromkeys(self.seen.keys() - now.keys(), "deleted")
        if ops:
            stamp = datetime.now(timezone.utc).isoformat()
            name = uuid.uuid4().hex
            with open(f"{self.folder}/.{name}", "w", encoding="utf-8") as file:
                file.writelines(json.dumps({"path": path, "ts": stamp, "op": op, "is_directory": False}) + "\n" for path, op in sorted(ops.items()))
            os.rename(f"{self.folder}/.{name}", f"{self.folder}/{name}.json")
        self.seen = now
        return len(ops)

    def run(self, stop: threading.Event, interval: float = 1.0) -> None:
        while not stop.wait(interval):
            self.look()


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).json(folder)


def touched_paths(events: DataFrame) -> DataFrame:
    """(path, ts) of both ends of each event on a file; outside or ignored parts dropped."""
    ends = events.where(~F.coalesce("is_directory", F.lit(False))).select(F.explode(F.array("path", "dest_path")).alias("path"), "ts").where("path is not null")
    parts = F.split("path", "/")
    inside = ~F.col("path").startswith("/") & ~F.array_contains(parts, "..")
    return ends.where(inside & ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in IGNORED])))


def debounced(touched: DataFrame, gap: str = "100 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(path, start, end, events): bursts of events on a path, closed once the path has
    been quiet for the gap; state is kept only for the lateness."""
    bursts = touched.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "path").agg(F.count(F.lit(1)).alias("events"))
    return bursts.select("path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def watch(spark: SparkSession, root: str, store: Store, events: DataFrame, checkpoint: str, max_bytes: int = MAX_FILE_BYTES, once: bool = False) -> StreamingQuery:
    """Start refreshing from a stream of events; stop() ends it. With once, the events at
    hand are worked off and the query ends by itself."""

    def each(batch: DataFrame, _: int) -> None:
        paths = batch.select("path").distinct()
        if not paths.isEmpty():
            refresh(spark, root, store, paths, time.time(), max_bytes)

    writer = touched_paths(events).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="100 milliseconds")).start()


def sweep_every(spark: SparkSession, root: str, store: Store, checkpoint: str, interval: str = "30 seconds") -> StreamingQuery:
    """A sweep at once and then at every interval, driven by a rate stream."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def each(_: DataFrame, __: int) -> None:
        sweep(spark, root, store, time.time())

    return ticks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


__all__ = ["EVENTS", "Producer", "debounced", "read_events", "sweep_every", "touched_paths", "watch"]
