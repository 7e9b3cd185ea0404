"""Sharding by balanced label propagation.

Documents of equal text are linked. Their labels, the shards, start evenly, in a hash's order. In each round every group of linked documents counts its members by shard
and moves those elsewhere towards the shard of most of its members that still has room; a shard takes no more than its quota, smaller groups' turns
going by a hash. The rounds work on the counts of (group, shard), so a group of any size is at most as many rows as there are shards. Documents without
a link then fill every shard to its exact quota. Law ``rows``: the shards' row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.llm.ranks import running
from tapeworks.llm.scratch import Scratch

SHARDS, ROUNDS = 8, 12


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def by_interval(position: Column, sizes: list[int]) -> Column:
    """Which of consecutive intervals of these sizes a position lies in; the number of sizes is the number of shards."""
    out, end = None, 0
    for k, n in enumerate(sizes):
        end += n
        out = F.when(position < end, k) if out is None else out.when(position < end, k)
    return out


def propagate(groups: DataFrame, room: list[int], scratch: Scratch, rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """(g, shard, n) and each shard's sum of n, after rounds of moves; room: the most that each shard may hold."""
    shards = len(room)
    groups = scratch.keep(groups, "groups")
    count = groups.count()
    sums = {r[0]: r[1] for r in groups.groupBy("shard").agg(F.sum("n")).collect()}  # as many rows as shards
    load = [int(sums.get(k, 0)) for k in range(shards)]
    for _ in range(rounds):
        free = [r - x for r, x in zip(room, load, strict=True)]
        can = F.array(*(F.lit(f) for f in free))
        # a group's goal: its fullest shard with room; members of a fuller shard without room stay, unless the goal has room for the whole group
        best = groups.groupBy("g").agg(
            F.max(F.when(F.element_at(can, F.col("shard") + 1) > 0, F.struct("n", (-F.pmod(F.xxhash64("g", "shard"), F.lit(1 << 20))).alias("tie"), "shard"))).alias("goal"),
            F.sum("n").alias("all"),
        ).where("goal is not null").select("g", "all", F.col("goal.shard").alias("to"), F.col("goal.n").alias("there"), F.col("goal.tie").alias("tie"))
        wish = groups.join(best, "g").where("shard <> to").withColumn("mine", -F.pmod(F.xxhash64("g", "shard"), F.lit(1 << 20)))
        full = F.element_at(can, F.col("shard") + 1) <= 0
        wish = wish.where((F.col("n") < F.col("there")) | ((F.col("n") == F.col("there")) & (F.col("mine") < F.col("tie"))) | (full & ((F.col("n") == F.col("there")) | (F.col("all") <= F.element_at(can, F.col("to") + 1)))))
        wish = scratch.keep(wish.select("g", "shard", "n", "to", F.md5(F.concat(F.hex("g"), F.lit("-"), F.col("shard").cast("string"))).alias("turn")), "wishes")
        if wish.isEmpty():
            break
        turns = running(wish, ["to"], "turn", "g", F.col("n"), count)
        moved = F.greatest(F.lit(0), F.least(F.col("n"), F.element_at(can, F.col("to") + 1) - F.col("start")))
        moves = scratch.keep(turns.select("g", "shard", "to", moved.cast("long").alias("moved")).where("moved > 0"), "moves")
        change = moves.select("g", "shard", (-F.col("moved")).alias("n")).union(moves.select("g", F.col("to").alias("shard"), F.col("moved").alias("n")))
        flow = {r[0]: r[1] for r in change.groupBy("shard").agg(F.sum("n")).collect()}
        fresh = scratch.keep(groups.select("g", "shard", "n").union(change).groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "groups")
        scratch.drop(wish, groups)
        groups, load = fresh, [x + int(flow.get(k, 0)) for k, x in enumerate(load)]
        if not any(flow.values()) and moves.isEmpty():
            break
    return groups, load


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row of docs.

    size is the text's UTF-8 bytes and 1 more; a null text has size 1, the checksum of no bytes, and no link; empty texts are linked as equal. Slots count
    from 0 within a shard, in an order that a hash gives. An empty table gives no rows. Columns beside key and text are ignored.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    raw = F.col(text).cast("string").cast("binary")
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).alias("text_crc32"),
        F.unhex(F.md5(raw)).alias("g"),
    ).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.keep(rows.withColumn("turn", F.md5(F.concat_ws("-", F.lit("shard"), "doc_id", "row"))), "rows")
    total = rows.count()
    room = quotas(total, shards)
    linked = rows.where("g is not null").groupBy("g").agg(F.count("*").alias("members")).where("members > 1")
    linked = scratch.keep(linked, "linked")
    member = scratch.keep(rows.join(linked, "g").select("row", "g", "turn"), "members")
    begin = running(member, [], "turn", "row", F.lit(1), total).withColumn("shard", by_interval(F.col("rank"), quotas(member.count(), shards)))
    start = begin.groupBy("g", "shard").agg(F.count("*").alias("n"))
    groups, load = propagate(start, room, scratch, rounds) if total else (start, [0] * shards)
    # members take their group's places in a hash's order
    span = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = groups.withColumn("lo", F.coalesce(F.sum("n").over(span), F.lit(0))).withColumn("hi", F.col("lo") + F.col("n"))
    ranked = running(member.withColumn("gh", F.hex("g")), ["gh"], "turn", "row", F.lit(1), total)
    placed = ranked.join(places.select(F.hex("g").alias("gh"), "shard", "lo", "hi"), "gh").where("rank >= lo and rank < hi").select("row", "shard")
    single = scratch.keep(rows.join(linked, "g", "left_anti").select("row", "turn"), "single")
    left = [r - x for r, x in zip(room, load, strict=True)]
    filled = running(single, [], "turn", "row", F.lit(1), total).select("row", by_interval(F.col("rank"), left).alias("shard"))
    at = scratch.keep(rows.drop("g").join(placed.union(filled), "row"), "placed")
    out = running(at, ["shard"], "turn", "row", F.lit(1), total)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("rank").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, eight shards."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
