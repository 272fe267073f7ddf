"""Minimax contiguous partition: order atomic groups, find the smallest feasible shard capacity by binary search, cut there.

Rows of equal text are one group and stay together. Groups stand in the order of the first 60 bits of their text's SHA-256, so
that the order is fixed by the data alone and neighbours are unrelated (two texts that agree in those bits count as one group).
The driver never sees all groups: it gets the totals of contiguous segments of that order (at most MOST_SEGMENTS at a time,
whatever the input), narrows the capacity down with them, and splits only the segments in which a cut can still fall, until every
such segment is a single group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, tasks, texts, written

SHARDS = 40
OVERHEAD = 16
BITS = 60
#: Totals fetched at a time: 2^16 rows of four longs, 2 MB.
MOST_SEGMENTS = 1 << 16


def greedy_cuts(sizes: np.ndarray, shards: int, capacity: int) -> list[int] | None:
    """Ends (exclusive) of each shard when each takes all it can; None if `shards` of them don't suffice."""
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    ends, at = [], 0
    for _ in range(shards):
        at = int(np.searchsorted(total, total[at] + capacity, side="right")) - 1
        ends.append(at)
        if at == len(sizes):
            break
    return ends if at == len(sizes) else None


def minimax_capacity(sizes: np.ndarray, shards: int) -> int:
    """The smallest capacity for which greedy_cuts succeeds."""
    if not len(sizes):
        return 0
    low, high = max(int(sizes.max()), -(-int(sizes.sum()) // shards)), int(sizes.sum())
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy_cuts(sizes, shards, mid) is not None else (mid + 1, high)
    return low


def even_cuts(sizes: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Ends of each shard, none over the capacity, each as near to its equal share of the total as that allows.

    Filling every shard to the capacity would leave the last ones nearly empty.
    """
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    least, at = [0] * shards, len(sizes)  # from least[k] on, the shards after k can hold the rest
    for k in range(shards - 1, -1, -1):
        least[k] = at
        at = int(np.searchsorted(total, total[at] - capacity, side="left"))
    if at > 0:
        raise ValueError(f"{shards} shards of {capacity} don't hold {int(total[-1])}")
    ends, start = [], 0
    for k in range(shards):
        share = total[-1] * (k + 1) / shards
        near = int(np.searchsorted(total, share))
        if near > 0 and near <= len(sizes) and share - total[near - 1] < total[min(near, len(sizes))] - share:
            near -= 1
        most = int(np.searchsorted(total, total[start] + capacity, side="right")) - 1
        start = min(max(near, least[k], start), most)
        ends.append(start)
    return ends


def may_cut(sizes: np.ndarray, low: int, high: int, shards: int) -> np.ndarray:
    """Segments in or at the start of which a greedy cut can fall for some capacity from low to high, wherever their inner cuts lie."""
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    hit = np.zeros(len(sizes), bool)
    lo = hi = 0
    for _ in range(shards):
        # cuts move right with the capacity; the boundary before segment `first` is within reach for all of them
        first = int(np.searchsorted(total, lo + low, side="right")) - 1
        last = min(int(np.searchsorted(total, hi + high, side="right")) - 1, len(sizes) - 1)
        if first >= len(sizes):
            break
        hit[first : last + 1] = True
        lo, hi = int(total[first]), min(hi + high, int(total[-1]))
    return hit


def find_cuts(groups: DataFrame, rows: int, shards: int) -> list[int]:
    """The keys at which shards 1, 2, ... start. groups: one row per group, key long in [0, 2^BITS) and size long."""
    spark = groups.sparkSession

    def fetch(df: DataFrame, width: int):
        return df.groupBy(F.shiftright("key", width).alias("segment")).agg(F.sum("size").alias("size"), F.count("*").alias("groups"), F.max("size").alias("most")).orderBy("segment").toPandas()

    width = BITS - int(np.clip(np.ceil(np.log2(max(rows, 1))), 8, np.log2(MOST_SEGMENTS)))
    got = fetch(groups, width)
    if got.empty:
        return []
    start, size, count, most = (got[c].to_numpy(np.int64) for c in ("segment", "size", "groups", "most"))
    start, most = start << width, int(most.max())
    while True:
        low = max(most, -(-int(size.sum()) // shards))
        high = max(low, minimax_capacity(size, shards))  # segments are coarser than groups, so this is enough
        open_ = may_cut(size, low, high, shards) & (count > 1)
        if not open_.any():
            break
        ids = start[open_] >> width
        finer = max(0, width - max(1, int(np.log2(MOST_SEGMENTS / len(ids)))))
        asked = F.broadcast(spark.createDataFrame([(int(x),) for x in ids], "segment long"))
        got = fetch(groups.withColumn("segment", F.shiftright("key", width)).join(asked, "segment").drop("segment"), finer)
        start = np.concatenate([start[~open_], got["segment"].to_numpy(np.int64) << finer])
        size, count = np.concatenate([size[~open_], got["size"].to_numpy(np.int64)]), np.concatenate([count[~open_], got["groups"].to_numpy(np.int64)])
        order = np.argsort(start, kind="stable")
        start, size, count, width = start[order], size[order], count[order], finer
    ends = even_cuts(size, shards, max(low, minimax_capacity(size, shards)))
    return [int(start[e]) for e in ends if e < len(size)]


def shards_by_bytes(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """Assign every row of (doc_id, text) to a shard so that the largest shard is as small as contiguous whole groups allow.

    A row's size is the UTF-8 bytes of its text (null: none) plus `overhead`. Returns doc_id, size, text_crc32, law, shard, slot,
    grown_shard; slots count from 0 in each shard. Null ids are kept. Repeated rows are rows of their own. Null and empty texts
    are the same group. An empty table gives no rows. Shards at the end stay empty where there are too few groups.
    """
    spark = docs.sparkSession
    rows = written(
        texts(docs).select(
            "doc_id",
            (F.octet_length("text") + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
            F.conv(F.substring(F.sha2("text", 256), 1, BITS // 4), 16, 10).cast("long").alias("key"),
        ),
        "shard-rows",
    )
    n = rows.count()
    cuts = find_cuts(rows.groupBy("key").agg(F.sum("size").alias("size")), n, shards)
    after = [(F.col("key") >= c).cast("int") for c in cuts]
    # a slot is the rows of the shard in the blocks before, those of the block in the salts before, and the place within the salt
    bits, salts = int(np.clip(np.ceil(np.log2(max(n, 1) / 64)), 6, 16)), max(16, tasks(spark) // 4)
    rows = rows.select(
        "*",
        (sum(after[1:], after[0]) if after else F.lit(0)).alias("shard"),
        F.shiftright("key", BITS - bits).cast("int").alias("block"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    parts = rows.groupBy("shard", "block", "salt").agg(F.count("*").alias("rows"))
    blocks = parts.groupBy("shard", "block").agg(F.sum("rows").alias("rows"))
    before = blocks.select("shard", "block", (F.sum("rows").over(Window.partitionBy("shard").orderBy("block")) - F.col("rows")).alias("before"))
    within = parts.select("shard", "block", "salt", (F.sum("rows").over(Window.partitionBy("shard", "block").orderBy("salt")) - F.col("rows")).alias("within"))
    base = within.join(before, ["shard", "block"]).select("shard", "block", "salt", (F.col("before") + F.col("within")).alias("base"))
    local = F.row_number().over(Window.partitionBy("shard", "block", "salt").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")) - 1
    return (
        rows.withColumn("local", local)
        .join(base, ["shard", "block", "salt"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("local")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op10_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards_by_bytes(documents(spark, sf_dir))
