"""Benchmark decontamination over a distributed positional inverted index.

Words are the maximal runs of characters outside the ASCII separators, with A-Z
lower-cased. Documents are read whole into shards of about `shard_bytes`, numbered when
the index is written. The index has a row for each term and shard, with the sorted places
of the term, and a row for each shard (its term is empty) with its documents and their
lengths. It is a table and can be searched again by any benchmark; building it shuffles
nothing, and a term, however common, is cut by shards.

A search window is `size` consecutive words of an item; an item of fewer words, but not
none, is one window. Windows are a table too, of any size. One that has a word which no
document has is dropped; the others are joined with the index on their rarest word, which
tells the shards that may hold them, and only the postings of words of such windows
are read. Per shard a window starts from the places of its rarest word, moved back by
that word's offset, and intersects the lists of the other words, moved likewise, from rare
to common. A start from which every word stands at its offset is an exact match; a start
for which every word stands within `slop` words of its offset is a proximity match.
Neither depends on how documents are sharded or windows grouped.

A null or empty text has no words and is clean. Repeated rows and ids each keep their
row. Items without words, or whose id is null, match nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkindex.llm.common import map_batches, materialize

SIZE = 10
SLOP = 2
SHARD_BYTES = 4 << 20
#: Windows that meet a shard at a time, about.
GROUP_WINDOWS = 50_000

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: A-Z to a-z, then every separator to a space.
_TO_WORDS = bytes.maketrans(_SEPARATORS, bytes(c + 32 if 65 <= c <= 90 else 32 for c in _SEPARATORS))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def _binary(data: np.ndarray, stops: np.ndarray) -> pa.Array:
    """A binary column of the consecutive slices of data that end at stops."""
    offsets = np.concatenate([[0], stops]).astype(np.int64) * data.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index rows: (shard, term, n, places) with the steps between the n places of a
    term, and for each shard a row of the empty term with ids and lengths, in words, of its
    documents. To be written before it is read more than once: rows are numbered as read."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        id_kind = to_arrow_type(kind)
        shards = count(TaskContext.get().partitionId() << 33)

        def rows(ids: list, lengths: list[int], terms: dict[bytes, int], places: list[np.ndarray]) -> pa.RecordBatch:
            names = sorted(terms)
            rank = np.empty(len(names), np.int64)
            rank[[terms[x] for x in names]] = np.arange(len(names))
            flat = rank[np.concatenate(places)]
            order = np.argsort(flat, kind="stable")
            n = np.bincount(flat, minlength=len(names))
            stops = np.cumsum(n)
            steps = np.diff(order, prepend=0)
            steps[stops - n] = order[stops - n] if len(stops) else 0  # the first place of each term itself
            size = len(names) + 1
            none = pa.nulls(len(names), pa.list_(id_kind))
            columns = [
                pa.array(np.full(size, next(shards))),
                pa.array([b"", *names], pa.binary()),
                pa.array(np.concatenate([[len(ids)], n]).astype(np.int32)),
                pa.concat_arrays([pa.array([b""], pa.binary()), _binary(steps.astype(np.int32), stops)]),
                pa.concat_arrays([pa.array([ids], pa.list_(id_kind)), none]),
                pa.concat_arrays([pa.array([lengths], pa.list_(pa.int32())), pa.nulls(len(names), pa.list_(pa.int32()))]),
            ]
            return pa.RecordBatch.from_arrays(columns, ["shard", "term", "n", "places", "ids", "lengths"])

        size = 0
        ids, lengths, places = [], [], []
        terms: dict[bytes, int] = defaultdict(count().__next__)
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                ids.append(i.as_py())
                lengths.append(len(words))
                places.append(np.fromiter(map(terms.__getitem__, words), np.int64, len(words)))
                size += 8 + 6 * len(words)
                if size >= shard_bytes:
                    yield rows(ids, lengths, terms, places)
                    size = 0
                    ids, lengths, places = [], [], []
                    terms = defaultdict(count().__next__)
        if ids:
            yield rows(ids, lengths, terms, places)

    fields = [("shard", T.LongType()), ("term", T.BinaryType()), ("n", T.IntegerType()), ("places", T.BinaryType()), ("ids", T.ArrayType(kind)), ("lengths", T.ArrayType(T.IntegerType()))]
    return map_batches(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, T.StructType([T.StructField(n, k) for n, k in fields]))


def write_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    return materialize(build_index(docs, id_col, text_col, shard_bytes), "postings", compression="zstd")


def windows_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(item, terms) for each window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.binary())
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                found = [words[k : k + size] for k in range(max(1, len(words) - size + 1) if words else 0)]
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(found), pa.string()), pa.array(found, kind)], ["item", "terms"])

    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[text_col].alias("text")).where("item is not null and text is not null")
    return map_batches(items, run, "item string, terms array<binary>")


def matches(window: np.ndarray, listed: list[np.ndarray], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, whether exact) of a window of word numbers, given the places of each word."""
    order = sorted(range(len(window)), key=lambda k: len(listed[window[k]]))
    shifts = np.arange(-slop, slop + 1)[:, None]  # the rarest word itself may be displaced
    found = listed[window[order[0]]] - order[0]
    starts = (found + shifts).ravel()
    exact = np.repeat(shifts.ravel() == 0, len(found))
    for at in order[1:]:
        places = listed[window[at]]
        want = starts + at
        right = np.searchsorted(places, want)
        after = places[np.minimum(right, len(places) - 1)] - want
        before = want - places[np.maximum(right - 1, 0)]
        near = ((after >= 0) & (after <= slop)) | ((before >= 0) & (before <= slop))
        exact &= after == 0
        if not near.all():
            starts, exact = starts[near], exact[near]
        if not len(starts):
            break
    return starts, exact


def _in_shard(slop: int):
    """(shard, windows) met with the shard's postings: (shard, doc, w, exact, spans) for each
    window in each document; spans are the exact matches' words (first, after last)."""
    names = ["shard", "doc", "w", "exact", "spans"]
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), span], strict=True)))

    def run(key: tuple, asked: pa.Table, postings: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        out: list[tuple] = []
        flat = asked.column("windows").combine_chunks().flatten()
        if len(flat) and postings.num_rows:
            terms = postings.column("term").combine_chunks()
            head = pc.index(terms, pa.scalar(b"", pa.binary())).as_py()
            lengths = np.asarray(postings.column("lengths")[head].values, np.int64)
            wanted = flat.field("terms")
            number = pc.index_in(wanted.flatten(), value_set=terms).fill_null(-1).to_numpy()
            sizes = np.asarray(wanted.value_lengths(), np.int64)
            gap = int(sizes.max()) + 2 * slop + 1  # so that no match reaches from one document to another
            begins = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            starts = begins + gap * np.arange(len(lengths))
            listed: list[np.ndarray] = [np.empty(0, np.int64)] * len(terms)
            packed = postings.column("places")
            for k in np.unique(number[number >= 0]).tolist():
                at = np.cumsum(np.frombuffer(packed[k].as_py(), np.int32), dtype=np.int64)
                listed[k] = at + gap * (np.searchsorted(begins, at, "right") - 1)
            stop = 0
            for w, size in zip(flat.field("w").to_pylist(), sizes.tolist(), strict=True):
                window = number[stop : stop + size]
                stop += size
                if window.min() < 0:
                    continue
                at, exact = matches(window, listed, slop)
                # a displaced start may lie before its document, never beyond the gap
                doc = np.searchsorted(starts, at + slop, "right") - 1
                for d in np.unique(doc).tolist():
                    hits = at[(doc == d) & exact] - starts[d]
                    out.append((shard, d, w, bool(len(hits)), [{"a": a, "b": a + size} for a in hits.tolist()]))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 5, schema.types, strict=True)], schema=schema)

    return run


def search(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = SIZE, slop: int = SLOP, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """(id, n_words, n_hit, items, near_items) for each document of a written index: how
    many of its words lie in an exact match, the items matched exactly, and those matched in
    proximity only, each sorted as strings."""
    every = materialize(windows_of(benchmark, item_col, text_col, size), "windows")
    windows = materialize(every.select("terms").distinct().withColumn("w", F.monotonically_increasing_id()), "windows")
    item_of = materialize(every.join(windows, "terms").select("w", "item").distinct(), "window-items")
    # the frequency of each word, and the windows of which every word occurs
    words = windows.select("w", "terms", F.explode("terms").alias("term"))
    asked = materialize(words.select("term").distinct(), "words")
    known = index.where("term <> X''").select("term", "n").join(asked, "term").groupBy("term").agg(F.sum("n").alias("n"))
    known = materialize(known, "frequencies")
    planned = words.join(known, "term").groupBy("w", "terms").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("n", "term")).alias("rarest")).where(F.col("found") == F.size("terms"))
    planned = materialize(planned.select("w", "terms", F.col("rarest.term").alias("term")), "plan")
    groups = max(1, -(-planned.count() // group_windows))
    group = F.pmod(F.xxhash64("w"), F.lit(groups)).cast("int")
    by_term = planned.groupBy("term", group.alias("g")).agg(F.collect_list(F.struct("w", "terms")).alias("windows"))
    met = index.select("term", "shard").join(by_term, "term").select(F.col("shard").alias("met_shard"), F.col("g").alias("met_g"), "windows")
    needed = materialize(planned.select(F.explode("terms").alias("term")).distinct(), "words")
    some = index.join(needed, "term", "left_semi").unionByName(index.where("term = X''"))
    every_group = F.sequence(F.lit(0), F.lit(groups - 1))
    postings = some.select("shard", F.explode(every_group).alias("g") if groups > 1 else F.lit(0).alias("g"), "term", "places", "lengths")
    found = met.groupBy("met_shard", "met_g").cogroup(postings.groupBy("shard", "g")).applyInArrow(_in_shard(slop), "shard long, doc int, w long, exact boolean, spans array<struct<a:long,b:long>>")
    found = materialize(found, "matches")
    joined = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda seen, s: F.struct((seen["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], seen["end"]))).alias("n"), F.greatest(seen["end"], s["b"]).alias("end")),
        lambda seen: seen["n"],
    )
    hits = found.where("exact").groupBy("shard", "doc").agg(joined.alias("n_hit"))
    items = found.join(item_of, "w").groupBy("shard", "doc").agg(F.collect_set(F.when(F.col("exact"), F.col("item"))).alias("exact"), F.collect_set("item").alias("every"))
    items = items.join(hits, ["shard", "doc"], "left").select("shard", "doc", "n_hit", F.array_sort("exact").alias("items"), F.array_sort(F.array_except("every", "exact")).alias("near_items"))
    rows = index.where("term = X''").select("shard", F.posexplode(F.arrays_zip("ids", "lengths")).alias("doc", "of"))
    none = F.array().cast("array<string>")
    return rows.join(items, ["shard", "doc"], "left").select(
        F.col("of.ids").alias("id"), F.col("of.lengths").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, slop: int = SLOP) -> DataFrame:
    """Build the index of docs, keep it as a table, and search it for the benchmark."""
    return search(write_index(docs, id_col, text_col), benchmark, size=size, slop=slop)
