"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tauscope.llm.common import crc, digest, let


def ring(shards: int, virtual: int, seed: int) -> list[tuple[int, int]]:
    """``(position, shard)`` of every virtual node, clockwise. A shard's nodes do not depend on the others."""
    hashed = [(int(hashlib.md5(f"{seed}|node|{s}|{v}".encode()).hexdigest()[:15], 16), s) for s in range(shards) for v in range(virtual)]
    return sorted(hashed)


def _arc(position: Column, points: Column, n: int) -> Column:
    """Index of the first point at or after ``position``, by halving; n wraps to 0."""
    steps = [1 << b for b in reversed(range(n.bit_length()))]

    def halve(acc: Column, step: Column) -> Column:
        inside = acc + step <= n
        return F.when(inside & (F.element_at(points, F.when(inside, acc + step).otherwise(1)) < position), acc + step).otherwise(acc)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve) % n


def _plan(arcs: DataFrame, nodes: list[tuple[int, int]], shards: int) -> Column:
    """One struct of arrays, by arc: keys that its own shard takes, their first slot, overflow before it; and who takes the overflow.

    Works on one row per arc. Shards may hold the rounded mean; a shard's own keys come first, arc
    by arc. Overflow walks clockwise, twice round at most, and fills the room that shards have left:
    a fold over the ring.
    """
    n = len(nodes)
    owner = F.array(*[F.lit(s) for _, s in nodes])
    counts = arcs.select(F.map_from_entries(F.collect_list(F.struct("_arc", "_n"))).alias("m"))
    counts = counts.select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda a: F.coalesce(F.try_element_at("m", a), F.lit(0).cast("long"))).alias("c"))
    flat = counts.select(F.aggregate("c", F.lit(0).cast("long"), lambda x, y: x + y).alias("all"), F.posexplode("c").alias("arc", "n"))
    flat = flat.withColumn("shard", F.element_at(owner, F.col("arc") + 1))
    flat = flat.withColumn("cap", F.floor(F.col("all") / shards) + F.when(F.col("shard") < F.col("all") % shards, 1).otherwise(0))
    earlier = Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    flat = flat.withColumn("had", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")))
    flat = flat.withColumn("own", F.greatest(F.lit(0), F.least("n", F.col("cap") - F.col("had"))).cast("long"))
    flat = flat.withColumn("first", F.least("had", "cap").cast("long")).withColumn("over", F.col("n") - F.col("own"))
    held = flat.groupBy("shard").agg(F.sum("own").alias("own"), F.first("cap").alias("cap"))
    held = held.select(F.transform(F.array_sort(F.collect_list(F.struct("shard", "own", "cap"))), lambda h: F.struct(h["own"].cast("long").alias("used"), h["cap"].cast("long").alias("cap"))).alias("held"))
    rows = flat.select(F.array_sort(F.collect_list(F.struct("arc", "shard", "own", "first", "over"))).alias("arcs")).crossJoin(held)
    laps = F.concat(F.col("arcs"), F.transform("arcs", lambda a: F.struct(a["arc"].alias("arc"), a["shard"].alias("shard"), a["own"].alias("own"), a["first"].alias("first"), F.lit(0).cast("long").alias("over"))))
    kinds = "struct<used:array<long>,carry:long,passed:long,takes:array<struct<start:long,size:long,shard:int,slot:long>>>"
    start = F.struct(F.transform("held", lambda h: h["used"]).alias("used"), F.lit(0).cast("long").alias("carry"), F.lit(0).cast("long").alias("passed"),
                     F.array().cast("array<struct<start:long,size:long,shard:int,slot:long>>").alias("takes")).cast(kinds)

    def step(acc: Column, arc: Column) -> Column:
        def taken(t: Column) -> Column:
            used = F.transform(acc["used"], lambda u, i: F.when(i == arc["shard"], u + t).otherwise(u))
            took = F.array(F.struct(acc["passed"].alias("start"), t.alias("size"), arc["shard"].alias("shard"), F.element_at(acc["used"], arc["shard"] + 1).alias("slot")))
            takes = F.when(t > 0, F.concat(acc["takes"], took)).otherwise(acc["takes"])
            return F.struct(used.alias("used"), (acc["carry"] - t + arc["over"]).alias("carry"), (acc["passed"] + t).alias("passed"), takes.alias("takes")).cast(kinds)

        room = F.element_at(F.col("held"), arc["shard"] + 1)["cap"] - F.element_at(acc["used"], arc["shard"] + 1)
        return let(F.least(room, acc["carry"]), taken)

    sums = F.aggregate("arcs", F.array(F.lit(0).cast("long")), lambda acc, a: F.concat(acc, F.array(F.element_at(acc, -1) + a["over"])))
    return rows.select(F.struct(
        F.transform("arcs", lambda a: a["own"]).alias("own"), F.transform("arcs", lambda a: a["first"]).alias("first"),
        sums.alias("before"), F.aggregate(laps, start, step)["takes"].alias("takes"),
    ).alias("plan")).scalar()


def shard(docs: DataFrame, shards: int = 8, virtual: int = 64, seed: int = 29) -> DataFrame:
    """Put every document into one of ``shards`` shards whose counts are at most one apart.

    Returns ``doc_id, size, text_crc32, shard, slot, home``. A document's key is a hash of its id;
    its home is the shard of the next virtual node clockwise. A shard holds the mean number of
    documents, rounded so that all add up; what overflows it goes on clockwise to the next shard
    with room. So a document is away from home only if its home is full. Only counts per arc of the
    ring (``shards x virtual`` numbers) meet in one place; numbers within an arc come from ranges of a second
    hash, so a crowded arc is spread over many tasks. The text does not leave the task that reads it.

    Null texts have size 1 and the checksum of the empty text; documents without an id share one
    key; repeated rows are documents of their own; an empty table gives no rows.
    """
    nodes = ring(shards, virtual, seed)
    n = len(nodes)
    points, owner = F.array(*[F.lit(p) for p, _ in nodes]), F.array(*[F.lit(s) for _, s in nodes])
    ranges = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = docs.select("doc_id", "text").withColumn("_h2", digest(F.lit(seed + 1), "doc_id"))
    hashed = hashed.withColumn("_arc", _arc(digest(F.lit(seed), "doc_id"), points, n)).withColumn("_range", F.floor(F.col("_h2") / (2**60 // ranges + 1)).cast("int"))
    counts = hashed.groupBy("_arc", "_range").agg(F.count("*").alias("_n"))
    plan = _plan(counts.groupBy("_arc").agg(F.sum("_n").alias("_n")), nodes, shards)
    before = Window.partitionBy("_arc").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_arc", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    text = F.coalesce("text", F.lit(""))
    rows = hashed.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), crc(text).alias("text_crc32"), "_arc", "_range", "_h2")
    place = Window.partitionBy("_arc", "_range").orderBy("_h2", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("_row", F.row_number().over(place) - 1).join(offsets, ["_arc", "_range"])
    rows = rows.withColumn("_rank", F.col("_before") + F.col("_row")).withColumn("_plan", plan)
    rows = rows.select("doc_id", "size", "text_crc32", "_rank", "_arc", F.element_at(owner, F.col("_arc") + 1).alias("home"), *[
        F.element_at(F.col("_plan")[c], F.col("_arc") + 1).alias(f"_{c}") for c in ("own", "first", "before")], F.col("_plan")["takes"].alias("_takes"))
    over = F.col("_before") + F.col("_rank") - F.col("_own")
    rows = rows.withColumn("_o", F.when(F.col("_rank") >= F.col("_own"), over))
    rows = rows.withColumn("_take", F.when(F.col("_o").isNotNull(), F.filter("_takes", lambda t: (F.col("_o") >= t["start"]) & (F.col("_o") < t["start"] + t["size"]))[0]))
    return rows.select(
        "doc_id", "size", "text_crc32", F.coalesce(F.col("_take")["shard"], "home").cast("int").alias("shard"),
        F.coalesce(F.col("_take")["slot"] + F.col("_o") - F.col("_take")["start"], F.col("_first") + F.col("_rank")).alias("slot"), "home",
    )
