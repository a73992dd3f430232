"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

Words are the runs between ASCII white space of the text with A-Z lower-cased; a
shingle is `words` of them joined by one space, repeats counted (fewer words: the whole
sequence). A bit of the fingerprint is set if it is set in over half of the shingles'
XXH64 values (seed 42). A text that is null or has no word has fingerprint zero and is
linked like any other. Two rows are linked if their fingerprints differ in at most
`radius` bits; equal rows are therefore always linked. An empty table gives no rows.
Rows whose id is null keep their row; they count in a component but do not name it,
and a component of such rows alone has a null id.

Finding links. Equal fingerprints collapse to one node first, so copies are never
paired. The 64 bits are cut in radius + k blocks: two fingerprints at distance radius
or less agree on at least k blocks, so joining on every choice of k blocks misses none.
k is 2 or more, the least for which unrelated fingerprints rarely share k blocks at their
number: 15 keys of 21 bits up to 67 million, then 35 of 27, then 70 of 32.
A bucket of more than `crowd` fingerprints is not joined with itself: each of its
fingerprints instead names every value within radius / 2 bits of it, and two
fingerprints are within radius exactly if they name a common value. That path is exact
and linear in the bucket's size, and at most 2,081 fingerprints can name one value.

With `reach`, which an exact check of the texts should follow, each fingerprint of a
bucket is also linked to the bucket's smallest if they differ in at most that many bits.
That finds many pairs beyond the radius, with the same keys and linear in the bucket's size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkindex.llm.common import components, map_batches, materialize

SEED = 42
WORDS = 4
RADIUS = 4
CROWD = 512
#: Unrelated fingerprints that share a key, about, before keys are made of more blocks.
SHARED = 64
#: Shingles whose bits are counted at a time, so that a very long text needs no more memory.
CHUNK = 1 << 15


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def digests(tokens: list[bytes], words: int = WORDS, seed: int = SEED) -> Iterator[bytes]:
    """The hashes of the shingles, repeats included, some at a time; none without words."""
    if not tokens:
        return
    joined = b" ".join(tokens)
    stops = list(accumulate(len(token) + 1 for token in tokens))
    digest = xxhash.xxh64_digest
    if len(tokens) <= words:
        starts, ends = [0], [len(joined) + 1]
    else:
        starts, ends = [0, *stops], stops[words - 1 :]
    for k in range(0, len(ends), CHUNK):
        yield b"".join([digest(joined[a : b - 1], seed) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=False)])


def fingerprint(digested: Iterable[bytes]) -> int:
    """The fingerprint of all these hashes, as an unsigned integer; zero of none."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in digested:
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
        n += len(bits)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def simhash(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    return fingerprint(digests(tokens_of(text), words, seed))


def with_fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp) for each row of df; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())])
    return map_batches(df.select(df[id_col].alias("id"), df[text_col].alias("text")), run, schema)


def agreeing(n: int, radius: int = RADIUS) -> int:
    """How many blocks a key joins on, given n distinct fingerprints."""
    k = 2
    while k < 4 and n >> sum(sorted(block_widths(radius, k))[:k]) >= SHARED:
        k += 1
    return k


def block_widths(radius: int, k: int = 2) -> list[int]:
    n = radius + k
    return [64 // n + (b < 64 % n) for b in range(n)]


def block_keys(fp, radius: int = RADIUS, k: int = 2):
    """An array of (choice of k blocks, the bits of those blocks)."""
    widths = block_widths(radius, k)
    starts = [0, *accumulate(widths)]
    cut = [F.shiftrightunsigned(fp, starts[b]).bitwiseAND(F.lit((1 << w) - 1)) for b, w in enumerate(widths)]

    def joined(blocks):
        key, at = F.lit(0).cast("long"), 0
        for b in blocks:
            key, at = key.bitwiseOR(F.shiftleft(cut[b], at)), at + widths[b]
        return key

    return F.array(*[F.struct(F.lit(t).alias("t"), joined(blocks).alias("key")) for t, blocks in enumerate(combinations(range(len(widths)), k))])


def flips(bits: int) -> list[int]:
    """Every signed 64-bit mask with at most that many ones."""
    masks = [sum(1 << b for b in chosen) for n in range(bits + 1) for chosen in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(nodes: DataFrame, radius: int = RADIUS, crowd: int = CROWD, k: int | None = None, reach: int = 0) -> DataFrame:
    """Edges (a, b) between the distinct longs of nodes.fp that, taken together, connect
    exactly what pairs at Hamming distance <= radius connect, and with `reach` some more."""
    if radius % 2:
        raise ValueError("radius must be even")
    keyed = nodes.select("fp", F.explode(block_keys(F.col("fp"), radius, k or agreeing(nodes.count(), radius))).alias("k")).select("fp", "k.t", "k.key")
    counted = [F.count(F.lit(1)).alias("n"), *([F.min("fp").alias("least")] if reach > radius else [])]
    sizes = materialize(keyed.groupBy("t", "key").agg(*counted).where("n > 1"), "sizes")  # written, so that a skewed join with it can be split
    shared = materialize(keyed.join(sizes, ["t", "key"]), "blocks")
    few = shared.where(F.col("n") <= crowd)
    a, b = few.select("t", "key", F.col("fp").alias("a")), few.select("t", "key", F.col("fp").alias("b"))
    near = a.join(b, (a.t == b.t) & (a.key == b.key) & (a.a < b.b) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    many = shared.where(F.col("n") > crowd).select("fp").distinct()
    masks = F.array(*[F.lit(m).cast("long") for m in flips(radius // 2)])
    named = many.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("value"))
    met = named.groupBy("value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    found = near.unionByName(stars)
    if reach > radius:
        wider = shared.where((F.col("fp") != F.col("least")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= reach))
        found = found.unionByName(wider.select(F.col("least").alias("a"), F.col("fp").alias("b")))
    return found.distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(id, fp, component_id) for each row of df: component_id is the smallest id that can
    be reached over links, its own included."""
    return grouped(materialize(with_fingerprint(df, id_col, text_col, words), "fingerprints"), radius, crowd)


def grouped(prints: DataFrame, radius: int = RADIUS, crowd: int = CROWD, reach: int = 0) -> DataFrame:
    """(id, fp, component_id) for each row (id, fp) of a written table."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    comps = components(links(nodes.select("fp"), radius, crowd, reach=reach))
    joined = materialize(nodes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"), "first"), "joined")
    # written before the join with it, so that a component that most texts are in can be split
    named = materialize(joined.groupBy("comp").agg(F.min("first").alias("component_id")), "named")
    of_fp = materialize(joined.join(named, "comp").select("fp", "component_id"), "classes")
    return prints.join(of_fp, "fp").select("id", "fp", "component_id")
