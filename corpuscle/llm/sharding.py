"""Sharding by Karmarkar-Karp differencing: byte balance for indivisible groups.

Rows with equal text form a group that stays in one shard. Groups larger than ``1 / (shards * fine)``
of all bytes are items of their own (so at most ``shards * fine`` of them exist); all others are
gathered into a fixed number of hash bins. Texts are read once, for their sizes and hashes. Differencing then works on that bounded list: it takes the
two partial partitions of largest spread again and again and joins them oppositely ordered.

Defined cases: a null text has no bytes (size 1) and a null ``text_crc32``; all null texts form one
group. Repeated rows are rows of the same group and get slots of their own. A null id is kept; slots
follow id order (nulls first) within hash buckets. An empty table gives no rows. One group that
outweighs a shard's share cannot be split: its shard is as large as that group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import stash


def differencing(sizes: Iterable[int], shards: int) -> list[int]:
    """Shard of each size, by the largest differencing method for any number of shards."""
    heap = []
    for i, size in enumerate(sizes):
        loads = [(0, ())] * (shards - 1) + [(size, (i,))]
        heap.append((-size, i, loads))
    if not heap:
        return []
    out, serial = [0] * len(heap), len(heap)
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = sorted(((x + y, (s, t)) for (x, s), (y, t) in zip(a, reversed(b), strict=True)), key=lambda p: p[0])
        low = joined[0][0]
        heapq.heappush(heap, (low - joined[-1][0], serial, joined if low == 0 else [(x - low, m) for x, m in joined]))
        serial += 1
    for shard, (_, members) in enumerate(heap[0][2]):
        stack = [members]
        while stack:
            for m in stack.pop():
                if isinstance(m, tuple):
                    stack.append(m)
                else:
                    out[m] = shard
    return out


def shard_table(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", bins: int = 2048, fine: int = 32, slot_buckets: int = 256
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    What reaches the driver is one row a bin and one a large group: ``bins + shards * fine`` at most.
    Slots come from row numbers in ``shards * slot_buckets`` hash buckets plus the buckets' offsets.
    """
    text = F.col(text_col)
    read = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("g"),
    )
    rows = stash(read, "sizes")
    total = rows.agg(F.sum("size").alias("s")).first()["s"] or 0
    limit = max(1, total // (shards * fine))
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"))
    large = F.col("bytes") > limit
    items = (
        groups.groupBy(large.alias("large"), F.when(large, F.col("g")).otherwise(F.pmod("g", F.lit(bins))).alias("item"))
        .agg(F.sum("bytes").alias("bytes"))
        .collect()
    )
    items.sort(key=lambda r: (-r["bytes"], r["large"], r["item"]))
    shard_of = differencing([r["bytes"] for r in items], shards)
    spark = docs.sparkSession
    placed = spark.createDataFrame([(r["large"], r["item"], s) for r, s in zip(items, shard_of, strict=True)], "large boolean, item long, shard int")
    own = placed.filter("large").select(F.col("item").alias("g"), F.col("shard").alias("own_shard"))
    binned = placed.filter("not large").select(F.col("item").alias("bin"), F.col("shard").alias("bin_shard"))
    spread = (
        rows.join(F.broadcast(own), "g", "left")
        .withColumn("bin", F.pmod("g", F.lit(bins)))
        .join(F.broadcast(binned), "bin", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "bin_shard").alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slot_buckets)).cast("int").alias("bucket"))
    )
    counts = spread.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    return (
        spread.withColumn("rn", F.row_number().over(place))
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rn") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
