"""Near copies by Jaccard similarity: SimHash groups, then MinHash bands for what these
cannot reach; exact sets for every link.

Words are the runs between ASCII white space of the text with A-Z lower-cased; a
shingle is `words` of them in a row (fewer: the whole sequence), and the similarity of
two texts is that of their sets of shingles. Two rows are linked if it is `least` or
more; texts without words are linked to one another. Every link is checked on the whole
texts.

Rows of equal word sequences collapse to one node first. The nodes' SimHash fingerprints,
of the same shingles, are linked and grouped by the operator (`simhash.grouped`: blocks,
Hamming check, components) and every member's text is compared with that of its group's
first: what is alike is one component and not compared again. Similar sets often differ in
more bits than blocks can find (0.8: in ten of 64 on average), so fingerprints alone would
lose links. The rest is found by BANDS bands of ROWS minima each: a pair of similarity 0.8
meets in at least one with probability 1 - 7e-5, a pair of 0.9 with 1 - 1e-9.

In each bucket, all nodes are compared with the one that shares most buckets with others,
which of near copies is the one nearest to all, but for those in its component already; what
that links is one component too. Last come the nodes of buckets that hold different
components. Two sets of n and m shingles that are alike share (n + m) *
least / (1 + least) of them, so, each set put in one order for all, rare shingles first, they
share one so near the beginnings of both that enough can follow it; and the place of a
shingle bounds the sizes of sets that its own can be linked to over it. Joined by such
shingles and size classes, nodes outside a shingle's largest component are compared with
the others. Near copies that are too far from the middle of their group begin with what is
theirs alone and so meet no one: a large group costs comparisons in proportion. Of nodes
that met in a bucket every pair is compared, or in one component, or shown to be below
`least`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkindex.llm.common import components, discard, map_batches, materialize
from sparkindex.llm.simhash import digests, fingerprint, grouped, tokens_of

WORDS = 5
LEAST = 0.8
#: Bits in which fingerprints that share blocks may differ before their texts are compared.
REACH = 10
BANDS, ROWS = 24, 5
SEED = 42
#: Shingles whose minima are taken at a time.
CHUNK = 1 << 8
#: Size classes: two sizes of one class differ by at most this factor.
STEP = 1.02
#: Counters that say which shingles are rare. The order they give costs or saves comparisons;
#: it does not change what is linked.
COUNTERS = 1 << 20
#: Row numbers, keys or pairs of them that are sent to all executors at once; more are joined
#: by a shuffle.
SHARED_ROWS = 1_000_000
#: Sets that a task keeps, since pairs that follow one another often share a text.
KEPT = 8

_random = np.random.default_rng(SEED)
_TIMES = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2)


def distinct(digested: list[bytes]) -> np.ndarray:
    """The sorted set of hashes."""
    return np.unique(np.frombuffer(b"".join(digested), np.uint64)) if digested else np.zeros(0, np.uint64)


def shingles(tokens: list[bytes], words: int = WORDS) -> np.ndarray:
    """The sorted set of the hashes of the shingles."""
    return distinct(list(digests(tokens, words, SEED)))


def bands(hashes: np.ndarray) -> list[int]:
    """One signed long for each band; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[None, k : k + CHUNK] * _TIMES + _PLUS).min(1), out=least)
    cut = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(cut[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def _marked(rows: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, prints, sizes, keys = [], [], [], []
            for text in batch.column(1):
                tokens = tokens_of(text.as_py())
                hashes = list(digests(tokens, words, SEED))
                found = distinct(hashes)
                same.append(xxhash.xxh3_128_digest(b" ".join(tokens)))
                prints.append(fingerprint(hashes))
                sizes.append(len(found))
                keys.append(bands(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["node", "same", "fp", "n", "bands"])

    return map_batches(rows.select("node", "text"), run, "node long, same binary, fp long, n long, bands array<long>")


def _few(numbers: DataFrame) -> DataFrame:
    """A written table of numbers, to be sent to all executors while it is small."""
    return F.broadcast(numbers) if numbers.count() <= SHARED_ROWS else numbers.hint("shuffle_hash")


def _linked(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) of a written table whose texts are alike; best with few different a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def of(node: int, text) -> np.ndarray:
            if node not in kept:
                if len(kept) >= KEPT:
                    del kept[next(iter(kept))]
                kept[node] = shingles(tokens_of(text.as_py()), words)
            return kept[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            like = [jaccard(of(x, s), of(y, t)) >= least for x, y, s, t in zip(a, b, batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(like, pa.bool_()))

    firsts = _few(materialize(pairs.select(F.col("a").alias("node")).distinct(), "firsts"))
    one = texts.join(firsts, "node", "left_semi").select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).join(_few(pairs), "b")
    return map_batches(two.join(one, "a").select("a", "b", "text_a", "text_b"), run, "a long, b long")


def _by_fingerprint(nodes: DataFrame, least: float) -> DataFrame:
    """(a, b): each node b of a group of fingerprints with the group's first, if their sizes
    allow that they are alike."""
    groups = grouped(nodes.select(F.col("node").alias("id"), "fp"), reach=REACH).where("id <> component_id")
    groups = materialize(groups.select(F.col("component_id").alias("a"), F.col("id").alias("b")), "groups")
    sizes = nodes.select(F.col("node").alias("a"), F.col("n").alias("m")).join(_few(groups.select("a").distinct()), "a", "left_semi")
    members = nodes.select(F.col("node").alias("b"), "n").join(_few(groups), "b")
    pairs = materialize(members.join(sizes, "a").where(_near_size("n", "m", least)).select("a", "b"), "alike")
    discard(groups)
    return pairs


def _near_size(n: str, m: str, least: float):
    return F.least(n, m) >= least * F.greatest(n, m)


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one component."""
    of = [_few(comps.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}"))) for x in "ab"]
    known = pairs.join(of[0], "a", "left").join(of[1], "b", "left")
    return known.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")


def _shared_most(shared: DataFrame) -> DataFrame:
    """(key, a, m): the node of each bucket that meets most others over all its buckets, and
    how many shingles it has."""
    met = materialize(shared.groupBy("node", "n").agg(F.sum("size").alias("met")), "met")
    named = shared.select("key", "node").join(met, "node")
    return named.groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("minus"), "n")).alias("f")).select("key", (-F.col("f.minus")).alias("a"), F.col("f.n").alias("m"))


def _counts(texts: DataFrame, words: int) -> np.ndarray:
    """About how many of the texts have a shingle: a counter for each hash modulo COUNTERS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(shingles(tokens_of(text.as_py()), words) % np.uint64(COUNTERS), minlength=COUNTERS)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 16)]), pa.array(total[at[k : k + (1 << 16)]])], ["slot", "c"])

    found = map_batches(texts.select("text"), run, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    total = np.zeros(COUNTERS, np.int64)
    total[found.column("slot").to_numpy()] = found.column("c").to_numpy()
    return total


def in_order(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set, rare shingles first."""
    return hashes[np.lexsort((hashes, counts[hashes % np.uint64(COUNTERS)]))]


def _beginnings(texts: DataFrame, words: int, least: float) -> DataFrame:
    """(node, n, h, at) of the shingles one of which each linked pair shares, by their place."""
    shared = texts.sparkSession.sparkContext.broadcast(_counts(texts, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1), strict=True):
                found = shingles(tokens_of(text.as_py()), words)
                n = len(found)
                first = in_order(found, shared.value)[: n - int(np.ceil(least * n - 1e-6)) + 1]
                same = [pa.array(np.full(len(first), x)) for x in (node.as_py(), n)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(first.view(np.int64)), pa.array(np.arange(1, len(first) + 1))], ["node", "n", "h", "at"])

    return map_batches(texts.select("node", "text"), run, "node long, n long, h long, at long")


def _size_class(size):
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(float(np.log(STEP))))


def _across(members: DataFrame, key: str) -> DataFrame:
    """members (key, comp, ..) of keys that several components share, with the component
    that most of the key's members are in."""
    parts = members.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = materialize(parts.groupBy(key).agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("c", "comp")).alias("most")).where("parts > 1").select(key, F.col("most.comp").alias("most")), "mixed")
    return members.join(mixed, key)


def repeats(rows: DataFrame, id_col: str, text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(id) of all rows but the one with the smallest id of each group that links connect;
    ids are longs, unique and not null."""
    rows = rows.select(rows[id_col].alias("node"), rows[text_col].alias("text"))
    marks = materialize(_marked(rows, words), "marks")
    alike = materialize(marks.groupBy("same").agg(F.min("node").alias("node")).select("node"), "alike")
    copies = materialize(marks.select("node").join(alike, "node", "left_anti"), "copies")
    nodes = materialize(marks.join(_few(copies), "node", "left_anti").select("node", "fp", "n", "bands"), "nodes")
    groups = _by_fingerprint(nodes, least)
    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    sizes = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    met = materialize(keyed.join(_few(sizes), "key"), "met-buckets")
    middles = materialize(_shared_most(met), "middles")
    shared = materialize(met.join(middles, "key").select("key", "node", "n", "a", "m"), "buckets")
    both = shared.select("node").union(groups.select("a")).union(groups.select("b")).distinct()
    texts = materialize(rows.join(_few(materialize(both, "met")), "node", "left_semi"), "texts")  # of nodes that met another
    first = materialize(_linked(groups, texts, words, least), "linked")
    comps = components(first)
    stars = shared.where((F.col("node") != F.col("a")) & _near_size("n", "m", least)).select("a", F.col("node").alias("b"))
    stars = materialize(_apart(stars.distinct(), comps), "stars")
    linked = materialize(first.unionByName(_linked(stars, texts, words, least)), "linked")
    comps = components(linked)
    tried = groups.unionByName(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    members = shared.select("key", "node").join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    members = materialize(members, "members")
    left = materialize(_across(members, "key").select("node", "comp").distinct(), "left")
    begun = materialize(_beginnings(texts.join(_few(left.select("node")), "node", "left_semi"), words, least), "beginnings")
    placed = materialize(begun.join(left, "node"), "begun")
    discard(begun)
    inside = materialize(_across(placed, "h"), "begun-alike")
    discard(placed)
    # sets of n and m shingles share (n + m) * ratio; behind place `at` of n there are n - at more
    ratio = least / (1 + least)
    high = F.least(F.floor(F.col("n") / least + 1e-6), F.floor((F.col("n") - F.col("at") + 1) / ratio - F.col("n") + 1e-6))
    low = F.ceil(F.col("n") * least - 1e-6)
    x = inside.where("comp <> most").select("h", F.col("node").alias("x"), "n", F.col("comp").alias("cx"), F.col("at").alias("at_x"), low.alias("low"), high.alias("high")).where("low <= high")
    x = x.withColumn("class", F.explode(F.sequence(_size_class(F.col("low")), _size_class(F.col("high")))))
    y = inside.select("h", _size_class(F.col("n")).alias("class"), F.col("node").alias("y"), F.col("n").alias("m"), F.col("comp").alias("cy"), F.col("at").alias("at_y"))
    enough = F.least(x.n - x.at_x, y.m - y.at_y) + 1 >= (x.n + y.m) * ratio - 1e-6
    pairs = x.join(y, (x.h == y.h) & (x["class"] == y["class"]) & (x.cx != y.cy) & enough & y.m.between(x.low, x.high))
    pairs = materialize(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    more = materialize(_linked(pairs, texts, words, least), "linked")
    if not more.isEmpty():
        comps = components(linked.unionByName(more))
    behind = comps.where("node <> comp").select("node")
    out = materialize(copies.unionByName(behind).withColumnRenamed("node", "id"), "repeats")
    for used in (marks, alike, copies, nodes, groups, sizes, met, middles, shared, texts, first, stars, linked, members, left, inside, pairs, more):
        discard(used)
    return out
