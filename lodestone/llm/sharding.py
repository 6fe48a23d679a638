"""Sharding by balanced label propagation, with counts of the shards at most one apart.

Documents with equal texts are linked (each to its group, not to each other). Every document starts in a shard by the
hash of its id. In each round a linked document wants to be where most of its group is, among shards that still have
room for linked documents; how many may move into a shard is its quota, so movers are drawn by hash with the share that
fits (a small group as one, a large one document by document). Documents without links go wherever room is left and
thereby pay for the moves. At the end the rows that a shard has above its share go to shards below theirs, unlinked
ones first, and each row gets its slot.

A round is one partial aggregation by group and shard, one by shard (one row a shard comes to the driver) and one join by
group and shard, in which a group of over a thousandth of the rows is joined by broadcast (spread_join), so a group of
any size spreads over all tasks.

Law: `rows`. Defined results: null and empty texts are one group; texts of any length count whole; repeated rows (same id
and text) each get their own slot, and only they are numbered in one sort; a null id is an id; ties go to the smaller
shard; an empty table gives an empty table; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, discard, keyed, ranked, spread_join, unit_hash


def _quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (1 if s < total % shards else 0) for s in range(shards)]


def propagate(rows: DataFrame, shards: int, quota: int, rounds: int) -> DataFrame:
    """rows (doc_id, dup, group, shard, ...; only linked ones; written by cut) with the shards that label propagation gives them."""
    for k in range(rounds):
        places = cut(rows.groupBy("group", "shard").agg(F.count("*").alias("n")))
        room = [quota] * shards
        for r in places.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # one row a shard
            room[r["shard"]] -= r["n"]
        free = F.element_at(F.array(*[F.lit(max(0, x)) for x in room]), F.col("shard") + 1)
        # a group that is not in one shard gathers where most of it is, among shards that have room (over a sixteenth of a shard)
        key = F.struct("n", -F.col("shard"))
        best = places.groupBy("group").agg(F.max_by("shard", F.struct(free > quota // 16, key)).alias("to"), F.max(F.struct(free > quota // 16, key.alias("k"))).getField("k").alias("most"), F.sum("n").alias("size"), F.count("*").alias("spread"))
        # one that fits a few times into a shard moves whole; of larger ones each document moves by itself, and only to where more of it is
        whole = F.col("size") <= max(1, quota // 8)
        moves = (F.col("spread") > 1) & (whole | (key < F.col("most")))
        wish = places.join(best, "group").select("group", "shard", "n", F.when(moves, F.col("to")).otherwise(F.col("shard")).alias("goal"), whole.alias("whole"))
        linked = spread_join(rows, keyed(wish), ["group", "shard"]).drop("n")
        draw = F.when(F.col("whole"), unit_hash("group", F.lit(k))).otherwise(unit_hash("doc_id", "dup", F.lit(k)))
        linked = cut(linked.withColumn("draw", draw).drop("whole"))
        asked = {r["goal"]: r["n"] for r in linked.where("goal <> shard").groupBy("goal").agg(F.count("*").alias("n")).collect()}  # one row a shard
        if not asked:
            break
        fits = [min(1.0, max(0, room[s]) / asked[s]) if s in asked else 0.0 for s in range(shards)]
        share = F.element_at(F.array(*[F.lit(x) for x in fits]), F.col("goal") + 1)
        moves = (F.col("goal") != F.col("shard")) & (F.col("draw") < share)
        spent, rows = rows, cut(linked.withColumn("shard", F.when(moves, F.col("goal")).otherwise(F.col("shard"))).drop("goal", "draw"))
        discard(linked, places, *[spent] * (k > 0))
    return rows


def shard(df: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", rounds: int = 6) -> DataFrame:
    """(doc_id, size, text_crc32, group, group_size, law, shard, slot) for each row; shards from 0, slots from 0 without gaps."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    base = df.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("group"))
    base = cut(base)
    groups = keyed(base.groupBy("group").agg(F.count("*").alias("n")))
    rows = spread_join(base, groups, "group").withColumnRenamed("n", "group_size")
    # repeated ids of one group are told apart by a number
    again = base.groupBy("doc_id", "group").agg(F.count("*").alias("m")).where("m > 1").limit(1).count()
    if again:
        rows = rows.withColumn("dup", F.row_number().over(Window.partitionBy("doc_id", "group").orderBy("size")) - 1)
    else:
        rows = rows.withColumn("dup", F.lit(0))
    rows = cut(rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "dup"), F.lit(shards)).cast("int")))
    total = rows.count()
    quotas = _quotas(total, shards)
    linked = propagate(cut(rows.where("group_size > 1")), shards, max(1, total // shards), rounds)
    placed = rows.where("group_size = 1").unionByName(linked)
    # linked rows first, so that rows above a shard's share are unlinked ones if it has any
    order = ranked(placed.withColumn("single", F.col("group_size") == 1), ["shard", "single", "group", "doc_id", "dup"], "place")
    order = cut(order)
    counts = [0] * shards
    for r in order.groupBy("shard").agg(F.count("*").alias("n")).collect():  # one row a shard
        counts[r["shard"]] = r["n"]
    # the larger shares go to the fullest shards
    by_count = sorted(range(shards), key=lambda s: (-counts[s], s))
    share = [0] * shards
    for s, q in zip(by_count, quotas, strict=True):
        share[s] = q
    start, over, under, a, b, c = [], [], [], 0, 0, 0
    for s in range(shards):
        start.append(a)
        over.append(b)
        under.append(c)
        a += counts[s]
        b += max(0, counts[s] - share[s])
        c += max(0, share[s] - counts[s])
    of = lambda v: F.element_at(F.array(*[F.lit(x).cast("long") for x in v]), F.col("shard") + 1)
    slot = F.col("place") - of(start)
    rest = F.col("slot") - of(share)  # from 0 for rows above the share
    spare = [(s, under[s], share[s] - counts[s], counts[s]) for s in range(shards) if share[s] > counts[s]]
    k = of(over) + rest  # number among all rows that must move
    to, at = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s, low, n, filled in spare:
        here = (F.col("k") >= low) & (F.col("k") < low + n)
        to, at = F.when(here, F.lit(s)).otherwise(to), F.when(here, F.col("k") - low + filled).otherwise(at)
    out = order.withColumn("slot", slot).withColumn("k", F.when(rest >= 0, k))
    out = out.withColumn("to", to).withColumn("at", at)
    return out.select("doc_id", "size", "text_crc32", "group", "group_size", F.lit("rows").alias("law"), F.coalesce("to", "shard").alias("shard"), F.coalesce("at", "slot").alias("slot"))
