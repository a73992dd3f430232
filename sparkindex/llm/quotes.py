"""Chat formatting by quotation linking.

A message is read line by line: leading `>` signs, with or without spaces between them,
give the quote level; lines of one level that follow one another, without a blank line
between, form a passage. A line such as `On Monday X wrote:` right before a quote is its
attribution. Passages are normalised (white space to one space, ASCII lower case,
trimmed) and hashed, and so is each of their sentences where they have several. A quoted
passage is joined on its hash to the first message of its conversation, by turn, that says
it in its own words, as a passage or a sentence; only earlier turns count. Where nobody
said the passage as a whole, its sentences are joined in the same way, each for itself, so
part of a paragraph and parts of several are found as well. A message
replies to the message that most of its first-level quoted text comes from (by length;
on ties to the later turn), or else to the one that deeper quotes come from in the same
way. Replies so form trees; a conversation is ordered by the turn of the tree's first
message, then by depth, then by turn, so every message follows what it replies to, and
its text is given without quotes and attributions.

A passage that only quotes, or that nobody said before, links nothing. A null text counts
as empty. Rows with a null conversation or turn link to nothing and come last. Repeated
rows are kept; they are ordered by role and text. A message cannot reply to its own turn.

Reply trees are followed by doubling joins and positions are counted over sorted ranges,
so neither a long conversation nor a deep tree meets in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkindex.llm.common import discard, map_batches, materialize

_QUOTE = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.S)
_ATTRIBUTION = re.compile(r"(?:on|am|le|el)\b.{0,200}\b(?:wrote|writes|said|schrieb|écrit|escribió)[ \t]*:[ \t]*\Z|.{1,100}\b(?:wrote|writes|schrieb|écrit|escribió)[ \t]*:[ \t]*\Z", re.I)


def passages(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The message without quotes, and its passages (level, normalised text)."""
    own: list[str] = []
    found: list[tuple[int, list[str]]] = []
    open_ = False
    lines = (text or "").replace("\r\n", "\n").split("\n")
    for k, line in enumerate(lines):
        m = _QUOTE.match(line)
        level, body = (m[1].count(">"), m[2]) if m else (0, line)
        if not m:
            after = next((x for x in lines[k + 1 : k + 3] if x.strip()), "")
            if _ATTRIBUTION.match(line.strip()) and _QUOTE.match(after):
                open_ = False
                continue
            own.append(line.rstrip())
        elif _ATTRIBUTION.match(body.strip()) and (n := _QUOTE.match(lines[k + 1] if k + 1 < len(lines) else "")) and n[1].count(">") > level:
            open_ = False
            continue
        if not body.strip():
            open_ = False
        elif open_ and found[-1][0] == level:
            found[-1][1].append(body)
        else:
            found.append((level, [body]))
            open_ = True
    joined = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip()
    return joined, [(level, normal) for level, parts in found if (normal := " ".join(" ".join(parts).split()).translate(_LOWER))]


_LOWER = {c: c + 32 for c in range(65, 91)}


_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]* (?=\S)")


def sentences(passage: str) -> list[str]:
    """The sentences of a normalised passage; the passage itself if it is one."""
    return [x for x in _SENTENCE.split(passage) if x]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def marks(parts: list[tuple[int, str]]) -> list[dict]:
    """What is joined on: nth passage, its level, whole or a sentence, hash, size."""
    found = []
    for nth, (level, passage) in enumerate(parts):
        found.append({"nth": nth, "level": level, "whole": True, "hash": _hash(passage), "size": len(passage)})
        inside = sentences(passage)
        if len(inside) > 1:
            found += [{"nth": nth, "level": level, "whole": False, "hash": _hash(x), "size": len(x)} for x in inside]
    return found


def parse_messages(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Each row with a number of its own, its text without quotes and its passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("nth", pa.int32()), ("level", pa.int32()), ("whole", pa.bool_()), ("hash", pa.int64()), ("size", pa.int64())]))
        for batch in batches:
            own, found = [], []
            for text in batch.column("text"):
                clean, parts = passages(text.as_py())
                own.append(clean)
                found.append(marks(parts))
            kept = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(own, pa.string()), pa.array(found, kind)], [*kept.schema.names, "text", "passages"])

    rows = messages.select(F.monotonically_increasing_id().alias("row"), messages[conv_col].cast("long").alias("conv"), messages[turn_col].cast("long").alias("turn"), messages[role_col].cast("string").alias("role"), messages[text_col].alias("text"))
    return map_batches(rows, run, "row long, conv long, turn long, role string, text string, passages array<struct<nth:int,level:int,whole:boolean,hash:long,size:long>>")


def link_quotes(parsed: DataFrame) -> DataFrame:
    """(row, parent, parent_turn, linked) for each message that replies to another."""
    said = parsed.where("conv is not null and turn is not null").select("row", "conv", "turn", F.explode("passages").alias("p")).select("row", "conv", "turn", "p.*")
    quoted = said.where("level > 0")
    wanted = materialize(quoted.select("conv", "hash").distinct(), "wanted")
    first = materialize(said.where("level = 0").join(wanted, ["conv", "hash"], "left_semi").groupBy("conv", "hash").agg(F.min(F.struct("turn", "row")).alias("f")).select("conv", "hash", F.col("f.turn").alias("parent_turn"), F.col("f.row").alias("parent")), "said")
    met = materialize(quoted.join(first, ["conv", "hash"]).where("parent_turn < turn"), "met")
    whole = met.where("whole").select("row", "nth").distinct()
    met = met.where("whole").unionByName(met.where("not whole").join(whole, ["row", "nth"], "left_anti"))
    weighed = met.groupBy("row", "parent", "parent_turn").agg(F.sum(F.when(F.col("level") == 1, F.col("size")).otherwise(F.lit(0))).alias("near"), F.sum("size").alias("all"), F.collect_set("nth").alias("nths"))
    best = weighed.groupBy("row").agg(F.max(F.struct("near", "all", "parent_turn", "parent")).alias("b"), F.size(F.array_distinct(F.flatten(F.collect_list("nths")))).alias("linked"))
    return best.select("row", F.col("b.parent").alias("parent"), F.col("b.parent_turn").alias("parent_turn"), "linked")


def thread(links: DataFrame) -> DataFrame:
    """(row, root, depth) of each message that replies, from (row, parent)."""
    up = materialize(links.select("row", F.col("parent").alias("root"), F.lit(1).alias("depth")), "up")
    while True:
        above = up.select(F.col("row").alias("root"), F.col("root").alias("higher"), F.col("depth").alias("more"))
        jumped = up.join(above, "root", "left").select("row", F.coalesce("higher", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved"))
        jumped = materialize(jumped, "up")
        discard(up)
        up = jumped
        if up.where("moved").isEmpty():
            return up.select("row", "root", "depth")


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, position, turn, role, text, reply_to, root_turn, depth, n_quotes, n_linked) for
    each message: its place in its conversation, from 0, and its text without quotes."""
    parsed = materialize(parse_messages(messages, conv_col, turn_col, role_col, text_col), "parsed")
    links = materialize(link_quotes(parsed), "links")
    roots = thread(links)
    root_turns = roots.join(parsed.select(F.col("row").alias("root"), F.col("turn").alias("root_turn")), "root").select("row", "root_turn", "depth")
    replies = materialize(links.select("row", "parent_turn", "linked").join(root_turns, "row"), "replies")
    quotes = F.size(F.filter("passages", lambda p: p["whole"] & (p["level"] > 0)))
    every = parsed.select("row", "conv", "turn", "role", "text", quotes.alias("n_quotes")).join(replies, "row", "left")
    every = every.select("conv", "turn", "role", "text", F.col("parent_turn").alias("reply_to"), F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), "n_quotes", F.coalesce("linked", F.lit(0)).cast("int").alias("n_linked"))
    keys = [F.col("conv").asc_nulls_last(), F.col("root_turn").asc_nulls_last(), F.col("depth"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    dealt = materialize(every.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = materialize(counts.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")), "before")
    ranked = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*keys[1:])))
    placed = ranked.join(before, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return placed.select("conv", (F.col("before") + F.col("nth") - 1).alias("position"), "turn", "role", "text", "reply_to", "root_turn", "depth", "n_quotes", "n_linked")
