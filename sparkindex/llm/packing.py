"""Best-fit packing by minimum bin slack over the histogram of lengths.

Documents are tokenized whole and closed by id 0; a null text counts as empty. Only a
document longer than the capacity is cut, in pieces of exactly the capacity but for the
first, which takes what is left over. Repeated rows are packed like any others; an
empty table gives no rows.

A bin is planned from the lengths still available: the longest opens it, then a bitset
subset-sum dynamic program over the available lengths finds the fullest combination for
the rest, and the bin is taken as often as the lengths last. So the plan depends only
on how many pieces there are of each of at most `capacity` lengths, and at least one
length runs out with each pattern: its size is bounded whatever the input. A piece
finds its place from its rank among the pieces of its length, counted in salted groups,
so a length that most pieces share is spread over many tasks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkindex.llm.common import map_batches, materialize

CAPACITY = 2048
END = 0
#: Pieces that one salted group holds about, if all pieces have the same length.
GROUP_ROWS = 1000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(vocabulary: str):
    """str -> ids as the tokenizers library gives them for the vocabulary file.

    A byte-level BPE file may have the same vocabulary beside it as merge ranks; they
    give the same ids (the tests compare them) in a quarter of the time.
    """
    import base64
    import os

    import public_tokenizers

    ranks_file = vocabulary.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks_file):
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def cuts(n: int, capacity: int) -> list[int]:
    """Where the pieces of a document of n tokens start, and n."""
    first = n % capacity or capacity
    return [0, *range(first, n + 1, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32 [, ids]) for each piece of each document."""
    kind, name = docs.schema[id_col].dataType, vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        encode = encoder(name or default_vocabulary())
        columns = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        types = [to_arrow_type(kind), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.asarray([*encode(text.as_py() or ""), END], "<u4")
                at = cuts(len(ids), capacity)
                for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    rows.append((i.as_py(), k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b])[: len(columns)])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), types, strict=False)], columns)

    fields = [T.StructField("id", kind), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return map_batches(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, T.StructType(fields))


def fullest(room: int, lengths: list[int], left: dict[int, int]) -> dict[int, int]:
    """Length to copies of the fullest combination that fits in room; long ones first.

    reach has bit s set if some combination of the lengths seen so far sums to s.
    """
    reach, mask, seen = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        if length > room:
            continue
        n = min(left[length], room // length)
        if not n:
            continue
        seen.append((length, n, reach))
        step = 1
        while n:
            copies = min(step, n)
            reach |= (reach << (copies * length)) & mask
            n -= copies
            step *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, n, before in reversed(seen):
        for copies in range(n + 1):
            if copies * length <= total and before >> (total - copies * length) & 1:
                break
        if copies:
            chosen[length] = copies
            total -= copies * length
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Segments (length, first rank, ranks, copies a bin, first bin, offset), and the bins."""
    left = {length: n for length, n in histogram.items() if n}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError("a length is not between 1 and the capacity")
    used = dict.fromkeys(left, 0)
    segments, bins = [], 0
    lengths = sorted(left, reverse=True)
    while lengths:
        top = lengths[0]
        left[top] -= 1
        chosen = fullest(capacity - top, lengths, left)
        left[top] += 1
        chosen[top] = chosen.get(top, 0) + 1
        times = min(left[length] // copies for length, copies in chosen.items())
        offset = 0
        for length, copies in sorted(chosen.items(), reverse=True):
            segments.append((length, used[length], copies * times, copies, bins, offset))
            used[length] += copies * times
            left[length] -= copies * times
            offset += copies * length
        bins += times
        lengths = [length for length in lengths if left[length]]
    return segments, bins


def pack(cut: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """cut (id, piece, length, ...) with sequence_id and offset of each piece."""
    cut = materialize(cut, "pieces")
    salts = max(1, math.ceil(cut.count() / group_rows))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    counts = materialize(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments, _ = plan_bins(histogram, capacity)
    plan: dict[int, np.ndarray] = {}
    for segment in segments:
        plan.setdefault(segment[0], []).append(segment[1:])
    shared = cut.sparkSession.sparkContext.broadcast({length: np.asarray(rows, np.int64) for length, rows in plan.items()})
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(within)).join(before, ["length", "salt"])
    ranked = ranked.select(*cut.columns, (F.col("before") + F.col("rank") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                size = int(length[rows[0]])
                first, _, copies, bin_, start = bins[size].T
                k = np.searchsorted(first, rank[rows], "right") - 1
                nth = rank[rows] - first[k]
                at[rows] = bin_[k] + nth // copies[k]
                offset[rows] = start[k] + nth % copies[k] * size
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(at), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    fields = [*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return map_batches(ranked, place, T.StructType(fields))


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces that carry their ids: (sequence_id,
    ids); at most the capacity is gathered for each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
