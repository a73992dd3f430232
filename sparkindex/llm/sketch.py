"""Threshold-scaled sketches: every shingle hash below a fixed fraction is kept.

Words are the runs between ASCII white space of the text with A-Z lower-cased; a shingle
is five consecutive words (fewer: the whole sequence). Shingles are hashed by XXH64 over
their words' hashes, and the sketch is the sorted set of hashes below 1 / SCALE of the
hash range, whatever the length of the text, and nothing else. A sketch of more text
therefore contains the sketches of its parts: sketches merge by set union, and the share
of one sketch inside another estimates the share of one text inside another, however
unequal the texts. Every excerpt of five words or more has containment 1 in its source,
or null where the excerpt is so short that its sketch is empty.

Beside the sketch stands the least hash of all, null only for texts without words. It is no
part of the sketch: it tells texts of empty sketches apart in the fingerprint, and two of
them have likeness 1 if it is equal (which short texts of Jaccard J have with probability J),
else 0. Two texts without words are alike; a text without words and another one are not. A
null text counts as empty.

All of it is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkindex.llm.common import ascii_lower

WORDS = 5
SCALE = 8
#: Text that one window of neighbouring documents holds about.
WINDOW_BYTES = 4 << 20
MAX_WINDOWS = 1 << 14


def hashes(text: Column, words: int = WORDS) -> Column:
    """The hashes of all shingles of a text, as longs of a halved, non-negative range."""
    cleaned = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+", " "))
    tokens = F.transform(F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " ", -1)), lambda w: F.xxhash64(w))

    def shingled(t: Column) -> Column:
        n = F.size(t)
        starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(n - (words - 1), F.lit(1))))
        return F.transform(starts, lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(t, i + k - 1) for k in range(words)]), 1))

    return _once(tokens, shingled)


def _once(value: Column, function) -> Column:
    """function(value) with value computed once: a transform over an array of one value
    stands for a variable."""
    return F.transform(F.array(value), function)[0]


def _kept(all_hashes: Column, scale: int) -> Column:
    limit = F.lit((1 << 63) // scale - 1).cast("long")
    return F.array_sort(F.array_distinct(F.filter(all_hashes, lambda h: h <= limit)))


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """The sketch of a text, a sorted array of longs."""
    return _once(hashes(text, words), lambda h: _kept(h, scale))


def print_of(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """A struct of a text's sketch (kept) and its least hash of all (least)."""
    return _once(hashes(text, words), lambda h: F.struct(_kept(h, scale).alias("kept"), F.array_min(h).alias("least")))


def as_text(one: Column) -> Column:
    """A print as one string: 16 hexadecimal digits for each hash kept, or the least hash
    after a sign where none is."""
    digits = F.array_join(F.transform(one["kept"], _hex), "")
    return F.when((F.size(one["kept"]) > 0) | one["least"].isNull(), digits).otherwise(F.concat(F.lit("~"), _hex(one["least"])))


def _hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two texts, from their prints."""
    both = F.size(F.array_intersect(a["kept"], b["kept"]))
    either = F.size(a["kept"]) + F.size(b["kept"]) - both
    return F.when(either == 0, a["least"].eqNullSafe(b["least"]).cast("double")).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """The estimated share of the first text's shingles that the second has, from their
    sketches; null where the first sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(sketches: Column) -> Column:
    """The sketch of all texts together, from an array of their sketches."""
    return F.array_sort(F.array_distinct(F.flatten(sketches)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window_bytes: int = WINDOW_BYTES, of_text=None) -> DataFrame:
    """(id, text, of, next_text, next_of): the text of the next row by descending id, and
    for the last row that of the first; of and next_of are of_text(text) of both texts,
    computed once a row. Null ids come last; equal ids are ordered by a hash of the text.

    Rows are cut by id into windows of about equal size, and an id that fills windows by
    itself is cut by the hash too. A cut is a value that occurs, so the first row of each
    window is known beforehand and is sent to the window before it as well; each text is
    shuffled once and no window needs another. Only rows equal in id and text share a
    window whatever their number.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    tie = F.shiftrightunsigned(F.xxhash64(text), 11)
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))).alias("key"), tie.alias("tie"))
    n = max(1, min(MAX_WINDOWS, math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / window_bytes)))
    shares = [k / n for k in range(1, n)]
    found = Counter(rows.agg(F.percentile_approx("key", F.lit(shares), 100 * n).alias("c")).first().c or [] if shares else [])
    cuts = [(c, (1 << 63) - 1) for c, times in found.items() if times == 1]
    if hot := {c: times for c, times in found.items() if times > 1}:
        parts = max(hot.values()) + 1
        cut = F.percentile_approx("tie", F.lit([k / parts for k in range(1, parts)]), 100 * parts)
        cuts += [(r.key, c) for r in rows.where(F.col("key").isin(list(hot))).groupBy("key").agg(cut.alias("c")).toLocalIterator() for c in r.c]
    # the largest row of each window, which is there, as the approximate cut need not be
    tops = rows.groupBy(_below(sorted(cuts)).alias("w")).agg(F.max(F.struct("key", "tie")).alias("top")).select("top.*").collect()
    tops = sorted((r.key, r.tie) for r in tops)
    window, is_top = _below(tops), F.lit(False)
    if tops:
        keys, ties = _longs(k for k, _ in tops), _longs(t for _, t in tops)
        is_top = (F.get(keys, F.col("w")) == F.col("key")) & (F.get(ties, F.col("w")) == F.col("tie"))
    of = F.lit(None).cast("int") if of_text is None else of_text(F.col("text"))
    placed = rows.withColumns({"w": window, "of": of})
    # as a donor, a window's top row also closes the window above it; that of the top window closes the lowest
    above = F.when(is_top, F.when(F.col("w") == len(tops) - 1, F.lit(0)).otherwise(F.col("w") + 1))
    copies = F.filter(F.array(F.struct(F.col("w").alias("w"), F.lit(0).alias("donor")), F.struct(above.alias("w"), F.lit(1).alias("donor"))), lambda c: c["w"].isNotNull())
    dealt = placed.select("id", "text", "key", "tie", "of", F.explode(copies).alias("c")).select("id", "text", "key", "tie", "of", "c.w", "c.donor")
    order = Window.partitionBy("w").orderBy("donor", F.desc("key"), F.desc("tie"), "text")
    after = dealt.withColumns({"next_text": F.lead("text").over(order), "next_of": F.lead("of").over(order)})
    return after.where("donor = 0").select("id", "text", "of", "next_text", "next_of")


def _below(bounds: list[tuple[int, int]]) -> Column:
    """How many of the sorted pairs are below the row's (key, tie), by halving."""
    if not bounds:
        return F.lit(0)
    keys, ties = _longs(k for k, _ in bounds), _longs(t for _, t in bounds)
    last = 1 << (len(bounds) - 1).bit_length()
    steps = F.array(*[F.lit(last >> k) for k in range(last.bit_length())])

    def beyond(at: Column) -> Column:
        return (F.get(keys, at) < F.col("key")) | ((F.get(keys, at) == F.col("key")) & (F.get(ties, at) < F.col("tie")))

    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(beyond(at + step - 1), step).otherwise(F.lit(0)))


def _longs(values) -> Column:
    """A constant array, as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """For each row: its length in code points, its print, that of its edited text (the
    last half replaced by as much of the next document's beginning), that of the next
    document, and the likenesses."""
    rows = with_next(docs, id_col, text_col, of_text=lambda text: print_of(text, words, scale)).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.expr("n_chars div 2").cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("of").alias("own"), print_of(F.col("edited"), words, scale).alias("edit"), F.col("next_of").alias("next"))
    return rows.select("id", "n_chars", "edited_sha256", "own", "edit", "next", likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
