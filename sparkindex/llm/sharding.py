"""Sharding by balanced label propagation.

Rows start in shards drawn by a hash of their row's number. In each round every linked
row looks at the shards of the rows it is linked to, over a join of the links with the
current shards, and asks to move to the one with room that most of them are in, if that
gains links (all but a hundredth of a shard may be taken so). Of two linked rows that both ask only the one drawn first may move, so
each move adds to the links within shards and the rounds end by themselves: when nothing
that asks could be granted. A shard takes movers only up to its capacity, the strongest
pull first; the cut is found from counts in a bounded number of priority classes, so
no shard's requests meet in one task. Groups that are still split then (their rows being
equally drawn to shards that are full) are moved as wholes, again by counts, until none
fits in any shard. At the end every shard gives up what it holds over its exact size,
unlinked rows before linked ones and linked ones group by group, to shards that are
short: counts are then at most one apart.

In a text's own links, documents of equal text form a group, linked by a star around the
group's smallest id; a null text is a text of its own, shared by all null texts, of
size zero plus the overhead. A group larger than a shard, or than what is left in any, is
split, and so may groups be where linked rows alone overfill the shards they start in.
Repeated ids are separate rows and are each placed. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkindex.llm.common import discard, materialize

SHARDS = 24
#: Priority classes of the requests to one shard: by the strength of the pull, then drawn.
PULLS, DRAWS = 8, 4096
#: A shard counts as full to single rows when it has room for less than this share.
LEFT = 0.01
#: Ranges of groups, and slices of each, in which rows are counted to number them.
RANGES, SLICE_ROWS = 64, 2000
OVERHEAD = 8


def text_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) of rows (node, mark): each row to the smallest node of equal mark."""
    hubs = materialize(rows.groupBy("mark").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("mark", "b"), "hubs")
    return rows.join(hubs, "mark").where("node <> b").select(F.col("node").alias("a"), "b")


def start_shard(node, shards: int):
    return F.pmod(F.xxhash64(node, F.lit(11)), F.lit(shards)).cast("int")


def room_in(labels: DataFrame, shards: int, capacity: int) -> list[int]:
    """What each shard may still take of labels (.., shard)."""
    sizes = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [max(0, capacity - sizes.get(k, 0)) for k in range(shards)]


def _at(values: list[int], shard) -> F.Column:
    return F.element_at(F.array(*[F.lit(x).cast("long") for x in values]), shard + 1)


def admitted(asked: DataFrame, room: list[int]) -> DataFrame:
    """The requests (.., to, rank, draw, weight) that their shards take: whole classes of
    equal rank from the lowest while they fit, and where not even the first does, the
    one request of it that is drawn first; each request fits by itself."""
    counts = asked.groupBy("to", "rank").agg(F.sum("weight").alias("n"), F.min("draw").alias("draw"))
    order = Window.partitionBy("to").orderBy("rank")
    summed = counts.select("to", "rank", F.sum("n").over(order).alias("n"), F.first("draw").over(order).alias("draw"))
    cut = summed.groupBy("to").agg(F.max(F.when(F.col("n") <= _at(room, F.col("to")), F.col("rank"))).alias("rank"), F.first("draw").alias("draw")).collect()
    last, single = [-1] * len(room), [-1] * len(room)
    for r in cut:
        if r["rank"] is None:
            single[r["to"]] = r["draw"]
        else:
            last[r["to"]] = r["rank"]
    return asked.where((F.col("rank") <= _at(last, F.col("to"))) | (F.col("draw") == _at(single, F.col("to"))))


def _rank(strength, step: int):
    """Priority class and draw of a request; draws are not negative."""
    draw = F.shiftrightunsigned(F.xxhash64("node", F.lit(step + 100)), 1)
    pull = F.least(F.lit(PULLS - 1), F.floor(F.log2(strength.cast("double"))))
    return {"rank": ((F.lit(PULLS - 1) - pull) * DRAWS + F.pmod(draw, F.lit(DRAWS))).cast("int"), "draw": draw}


def propagate(nodes: DataFrame, links: DataFrame, shards: int, capacity: int) -> DataFrame:
    """(node, shard): every node of nodes (node) where the rounds leave it; no shard takes
    a node while it holds `capacity` of them."""
    labels = materialize(nodes.select("node", start_shard(F.col("node"), shards).alias("shard")), "labels")
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    step = 0
    while True:
        room = [n if n >= LEFT * capacity else 0 for n in room_in(labels, shards, capacity)]
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("shard").alias("to")), "b")
        pull = seen.groupBy("a", "to").agg(F.count(F.lit(1)).alias("links")).withColumnRenamed("a", "node").join(labels, "node")
        open_ = F.when((_at(room, F.col("to")) > 0) & (F.col("to") != F.col("shard")), F.struct("links", (-F.col("to")).alias("minus")))
        best = pull.groupBy("node").agg(F.max(open_).alias("m"), F.coalesce(F.max(F.when(F.col("to") == F.col("shard"), F.col("links"))), F.lit(0)).alias("kept"))
        gain = F.col("m.links") - F.col("kept")
        asked = best.where(gain > 0).select("node", (-F.col("m.minus")).alias("to"), F.lit(1).alias("weight"), *[c.alias(name) for name, c in _rank(gain, step).items()])
        asked = materialize(asked, "asked")
        if asked.isEmpty():
            discard(asked)
            return labels
        near = both.join(asked.select(F.col("node").alias("b"), F.struct("draw", "node").alias("p")), "b").groupBy("a").agg(F.max("p").alias("p")).withColumnRenamed("a", "node")
        free = materialize(asked.join(near, "node", "left").where("p is null or draw > p.draw or (draw = p.draw and node > p.node)").drop("p"), "free")
        moves = admitted(free, room).select("node", "to")
        moved = materialize(labels.join(moves, "node", "left").select("node", F.coalesce("to", "shard").alias("shard")), "labels")
        for old in (labels, asked, free):
            discard(old)
        labels, step = moved, step + 1


def gather(labels: DataFrame, shards: int, capacity: int) -> DataFrame:
    """labels (node, mark, shard) with groups of equal mark that are split moved to the shard
    that holds most of them and has room for the rest, as long as there is one."""
    labels, step = materialize(labels, "gathered"), 0
    while True:
        room = room_in(labels, shards, capacity)
        parts = labels.groupBy("mark", "shard").agg(F.count(F.lit(1)).alias("n"))
        groups = parts.groupBy("mark").agg(F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("held")).where(F.size("held") > 1)
        every = F.sequence(F.lit(0), F.lit(shards - 1))
        fits = F.filter(every, lambda k: F.col("size") - F.coalesce(F.element_at("held", k), F.lit(0)) <= _at(room, k))
        # the most held first, then drawn
        best = F.array_max(F.transform(fits, lambda k: F.struct(F.coalesce(F.element_at("held", k), F.lit(0)).alias("n"), F.xxhash64("mark", k, F.lit(step)).alias("draw"), k.alias("to"))))
        asked = groups.select(F.xxhash64("mark").alias("node"), "mark", "size", best.alias("best")).where("best is not null").withColumn("weight", F.col("size") - F.col("best.n"))
        asked = materialize(asked.select("mark", F.col("best.to").alias("to"), "weight", *[c.alias(name) for name, c in _rank(F.greatest(F.col("best.n"), F.lit(1)), step).items()]), "asked")
        if asked.isEmpty():
            discard(asked)
            return labels
        moves = admitted(asked, room).select("mark", "to")
        moved = materialize(labels.join(moves, "mark", "left").select("node", "mark", F.coalesce("to", "shard").alias("shard")), "labels")
        for old in (labels, asked):
            discard(old)
        labels, step = moved, step + 1


def numbered(rows: DataFrame, by: str, total: int) -> DataFrame:
    """rows (.., range, tie) with slot: the row's number within its `by`, from 0, in the
    order of range; counted in slices, so that a large range is spread over many tasks."""
    slices = max(1, -(-total // SLICE_ROWS))
    cut = rows.withColumn("slice", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(slices)))
    counts = materialize(cut.groupBy(by, "range", "slice").agg(F.count(F.lit(1)).alias("n")), "counts")
    whole = counts.groupBy(by, "range").agg(F.sum("n").alias("n"))
    before = whole.select(by, "range", F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = counts.select(by, "range", "slice", F.coalesce(F.sum("n").over(Window.partitionBy(by, "range").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inner"))
    starts = materialize(within.join(before, [by, "range"]).select(by, "range", "slice", (F.col("base") + F.col("inner")).alias("start")), "starts")
    order = Window.partitionBy(by, "range", "slice").orderBy("tie", "node")
    ranked = cut.withColumn("nth", F.row_number().over(order)).join(starts, [by, "range", "slice"])
    return ranked.withColumn("slot", F.col("start") + F.col("nth") - 1).drop("slice", "nth", "start")


def settle(labels: DataFrame, total: int, shards: int = SHARDS) -> DataFrame:
    """(node, shard, slot) of labels (node, mark, shard, linked) with counts at most one
    apart; nodes of equal mark stay together where they can."""
    group = F.xxhash64("mark", F.lit(3))
    held = labels.withColumn("range", F.when(F.col("linked"), F.shiftrightunsigned(group, 58)).otherwise(F.lit(RANGES)).cast("int"))
    held = materialize(numbered(held.select("node", "shard", "range", group.alias("tie")), "shard", total), "held")
    sizes = {r["shard"]: r["n"] for r in held.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = [total // shards + (k < total % shards) for k in range(shards)]
    gaps, over, at = [], {}, 0
    for k in range(shards):
        over[k] = at
        at += max(0, sizes.get(k, 0) - want[k])
    at = 0
    for k in range(shards):
        short = want[k] - min(want[k], sizes.get(k, 0))
        if short:
            gaps.append((at, k, want[k] - short))
            at += short
    wanted = F.element_at(F.array(*[F.lit(n) for n in want]), F.col("shard") + 1)
    if not gaps:
        return held.select("node", "shard", "slot")
    first = F.element_at(F.array(*[F.lit(over[k]) for k in range(shards)]), F.col("shard") + 1)
    nth = first + F.col("slot") - wanted  # of the rows that have to go, over all shards
    to, slot = F.lit(gaps[0][1]), nth + F.lit(gaps[0][2])
    for start, k, filled in gaps[1:]:
        to = F.when(nth >= start, F.lit(k)).otherwise(to)
        slot = F.when(nth >= start, nth - F.lit(start) + F.lit(filled)).otherwise(slot)
    goes = F.col("slot") >= wanted
    return held.select("node", F.when(goes, to).otherwise(F.col("shard")).alias("shard"), F.when(goes, slot).otherwise(F.col("slot")).alias("slot"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, links: DataFrame | None = None) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row of docs. Other links (a, b) than
    those of equal texts may be given between ids, if these are unique longs; groups are
    equal texts all the same."""
    text = F.coalesce(docs[text_col], F.lit(""))
    node = F.monotonically_increasing_id() if links is None else docs[id_col].cast("long")
    rows = docs.select(docs[id_col].alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha1(text.cast("binary"))).alias("mark"), node.alias("node"))
    rows = materialize(rows, "rows")
    total = rows.count()
    links = materialize(text_links(rows.select("node", "mark")) if links is None else links, "pairs")
    linked = materialize(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct(), "linked")
    moved = propagate(linked, links, shards, total // shards)
    moved = gather(rows.select("node", "mark").join(moved, "node"), shards, total // shards).select("node", "shard")
    every = rows.select("node", "mark").join(moved, "node", "left")
    labels = every.select("node", "mark", F.coalesce("shard", start_shard(F.col("node"), shards)).alias("shard"), F.col("shard").isNotNull().alias("linked"))
    placed = settle(labels, total, shards)
    return rows.join(placed, "node").select("id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
