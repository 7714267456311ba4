"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Shards stand at VNODES places each on a ring of SLOTS slots; a row goes to the slot of the hash of its
doc_id, size and CRC, and from there clockwise to the first shard that has room.  Capacities are exact:
n rows over s shards leave room for ``n // s`` or one more, so shards differ by one row at most
(law ``rows``).  Rows move on in rounds: in round h every row still without a shard tries the
h-th virtual node after its slot, arcs in ring order, rows of an arc in order of their slots.

Only counts reach the driver: one number for each slot, and the plan sent back has at most
SLOTS + shards * (VNODES + 1) lines, both fixed by parameters.  Equal rows are counted before they
are shuffled and stand for a range of ranks in their slot; the ranges are cut by the plan's lines and
only then laid out as rows, at most STRETCH at a time.  So no key is too hot: rows without an id, or
with one and the same, are dealt by their texts, and equal rows travel as one.

Native: DataFrame functions alone; the driver's Python sees the counts of slots.

Defined results: a null text has 0 bytes (size 16) and CRC 0; rows with null or repeated doc_ids are
dealt by size and CRC; equal rows are interchangeable; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapsieve.llm.common import stored

SLOTS = 1 << 16
VNODES = 128
STRETCH = 1 << 16


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(slot, shard) of every virtual node, in ring order; a taken slot moves the later node on by one."""
    if shards * vnodes > SLOTS:
        raise ValueError("more virtual nodes than slots")
    at: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            slot = int.from_bytes(hashlib.blake2b(f"{shard}:{v}".encode(), digest_size=8).digest(), "big") % SLOTS
            while slot in at:
                slot = (slot + 1) % SLOTS
            at[slot] = shard
    return sorted(at.items())


def plan(counts: dict[int, int], shards: int, vnodes: int = VNODES) -> list[tuple[int, int, int, int, int, int]]:
    """Lines (slot, first rank, last rank, shard, place of rank 0, home shard) that cover the ranks 1.. of every slot."""
    nodes = ring(shards, vnodes)
    places = [s for s, _ in nodes]
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    full = list(room)
    arcs: list[list[int]] = [[] for _ in nodes]
    for slot in sorted(counts):
        arcs[bisect_left(places, slot) % len(nodes)].append(slot)
    # rows of an arc in slot order; the wrap-around arc starts with the slots after the last node
    arcs[0].sort(key=lambda s: (s <= places[0], s))
    left = [sum(counts[s] for s in arc) for arc in arcs]
    done = [0] * len(nodes)
    parts: list[list[tuple[int, int, int, int]]] = [[] for _ in nodes]
    live = [a for a in range(len(nodes)) if left[a]]
    hop = 0
    while live:
        for a in live:
            shard = nodes[(a + hop) % len(nodes)][1]
            if take := min(left[a], room[shard]):
                parts[a].append((done[a], done[a] + take, shard, full[shard] - room[shard]))
                done[a] += take
                left[a] -= take
                room[shard] -= take
        live = [a for a in live if left[a]]
        hop += 1
    lines = []
    for a, arc in enumerate(arcs):
        at, k = 0, 0
        for slot in arc:
            end = at + counts[slot]
            while k < len(parts[a]) and parts[a][k][0] < end:
                first, last, shard, base = parts[a][k]
                lo, hi = max(first, at), min(last, end)
                lines.append((slot, lo - at + 1, hi - at, shard, base + lo - first - (lo - at), nodes[a][1]))
                if last > end:
                    break
                k += 1
            at = end
    return lines


def slot_of(*key) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 48).cast("int")


def shard(docs: DataFrame, shards: int = 40, vnodes: int = VNODES) -> DataFrame:
    """Every row of (doc_id, text) with its shard 0 .. shards - 1 and its slot in the shard (gapless from 0)."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    key = ["doc_id", "size", "text_crc32"]
    # measured once: the counts that make the plan and the ranks that it is applied to must be of the same rows
    kinds = stored(rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("place", slot_of(*key)))
    counts = {r.place: r.n for r in kinds.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    lines = plan(counts, shards, vnodes) or [(-1, 0, 0, 0, 0, 0)]
    names = ("place", "lo", "hi", "shard", "base", "home_shard")
    told = spark.range(1).select(F.explode(F.split(F.lit(";".join(",".join(map(str, x)) for x in lines)), ";")).alias("line"))
    routes = told.select(F.split("line", ",").alias("x")).select(*(F.col("x")[i].cast("long" if k in ("lo", "hi", "base") else "int").alias(k) for i, k in enumerate(names)))
    ranked = kinds.withColumn("last", F.sum("n").over(Window.partitionBy("place").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)))
    found = ranked.join(F.broadcast(routes), "place").withColumns({"lo": F.greatest("lo", F.col("last") - F.col("n") + 1), "hi": F.least("hi", "last")}).filter("lo <= hi")
    stretch = found.withColumn("lo", F.explode(F.sequence("lo", "hi", F.lit(STRETCH).cast("long"))))
    each = stretch.withColumn("rank", F.explode(F.sequence("lo", F.least("hi", F.col("lo") + STRETCH - 1))))
    return each.select(*key, F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home_shard")
