"""Token-ID files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A file is a series of blocks, each a row of a Parquet table, in ascending (bucket, block) order, which is ascending doc_id order. Each
bucket is a range of doc_id and a file of its own, and files are named in this order.
A block holds whole documents of up to BLOCK_IDS ids (a longer document has a block of its own) and is read without any other:

  docs      per document: doc_id, a flag that it is not null, number of ids (three little-endian 64-bit integers)
  ranks     the ids that occur in the block, most frequent first, ties by id (little-endian unsigned 32-bit)
  control   two bits for each id, four ids in a byte, lowest bits first: the number of bytes of its rank, less one
  data      the ranks themselves, each in 1 to 4 little-endian bytes
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, shared_dir, tasks, texts
from .wordtok import word_ids

BLOCK_IDS = 1 << 20
#: Documents of a bucket, about.
BUCKET_DOCS = 100_000
#: Blocks whose places in the stream are broadcast, at most: 2^18 rows of two ints and a long, 4 MB.
MOST_BROADCAST = 1 << 18
END_ID = 1
BLOCK_SCHEMA = "bucket int, block int, n_ids long, docs binary, ranks binary, control binary, data binary"
#: For each control byte, the lengths of its four ranks.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode_ids(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """ranks, control, data of a block."""
    count = np.bincount(ids)
    used = np.flatnonzero(count)
    used = used[np.argsort(-count[used], kind="stable")]
    rank_of = np.zeros(len(count), np.uint32)
    rank_of[used] = np.arange(len(used), dtype=np.uint32)
    rank = rank_of[ids]
    length = 1 + (rank > 0xFF) + (rank > 0xFFFF).astype(np.int8) + (rank > 0xFFFFFF)
    four = np.zeros(-(-len(rank) // 4) * 4, np.uint8)
    four[: len(rank)] = length - 1
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    spread = rank.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = spread[np.arange(4) < length[:, None]]
    return used.astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def decode_ids(ranks: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ids of a block, by table lookup: control byte -> lengths, lengths -> places, bytes -> rank, rank -> id."""
    table, raw = np.frombuffer(ranks, "<u4"), np.frombuffer(data + b"\0\0\0", np.uint8)
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(length) - length
    rank = raw[at].astype(np.int64)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        rank[more] |= raw[at[more] + k].astype(np.int64) << (8 * k)
    return table[rank]


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text, append end_id, and write all ids to `path` in ascending doc_id order.

    Null ids stand first. Repeated ids stand in the order of their texts' hash, then of their ids' bytes. An empty text has only
    end_id. An empty table gives a folder without blocks. Buckets are ranges of doc_id between quantiles, found from that column
    alone, of about BUCKET_DOCS documents; an id that fills several of them (or none) is dealt to these by ranges of the hash. Ids of
    documents are the only thing that is shuffled, compressed.
    """
    spark, docs = docs.sparkSession, texts(docs)
    rows, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    n = max(1, -(-rows // BUCKET_DOCS), min(tasks(spark), rows))
    found = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 10 * n)).alias("q")).first()["q"] if n > 1 else None
    bounds, often = np.unique(np.array(found or [], np.int64), return_counts=True)
    null_buckets = max(1, -(-nulls * n // max(1, rows)))
    # a bound that several quantiles share begins as many buckets
    first = null_buckets + np.concatenate([[0], np.cumsum(often)])
    buckets = int(first[-1]) + 1
    deal = F.xxhash64("text") if nulls or (often > 1).any() else F.lit(0).cast("long")

    def bucket_of(known: np.ndarray, ids: np.ndarray, deal: np.ndarray) -> np.ndarray:
        place = np.searchsorted(bounds, ids, side="right")
        own = first[place].copy()  # the bucket after the last bound that isn't larger
        at = np.maximum(place - 1, 0)
        share = (deal.astype(np.int64) >> 32) + (1 << 31)  # 0 to 2^32, in the order of deal
        if len(bounds):
            hot = (place > 0) & (bounds[at] == ids) & (often[at] > 1)
            own[hot] -= (often[at] - 1)[hot] - (share[hot] * often[at][hot] >> 32)
        return np.where(known, own, share * null_buckets >> 32).astype(np.int32)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        words, press = word_ids(tokenizer), zstandard.ZstdCompressor(1)
        width, end = ("<u2" if words.size <= 1 << 16 else "<u4"), end_id.to_bytes(4, "little")
        for f in frames:
            bucket = bucket_of(f["doc_id"].notna().to_numpy(), f["doc_id"].fillna(0).to_numpy(np.int64), f["deal"].to_numpy())
            yield pd.DataFrame({"bucket": bucket, "doc_id": f["doc_id"].astype("Int64"), "deal": f["deal"], "ids": [press.compress(np.frombuffer(words.encode(t) + end, "<u4").astype(width).tobytes()) for t in f["text"]]})

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        words_size = word_ids(tokenizer).size
        press, width = zstandard.ZstdDecompressor(), "<u2" if words_size <= 1 << 16 else "<u4"
        held: list[tuple] = []
        bucket, block, total = None, 0, 0

        def flush() -> pd.DataFrame:
            head = np.array([(0 if i is None else i, i is not None, len(x)) for i, x in held], "<i8")
            return pd.DataFrame([(bucket, block, total, head.tobytes(), *encode_ids(np.concatenate([x for _, x in held])))], columns=["bucket", "block", "n_ids", "docs", "ranks", "control", "data"])

        for f in frames:
            for b, i, blob in zip(f["bucket"], f["doc_id"], f["ids"], strict=True):
                ids = np.frombuffer(press.decompress(blob), width)
                if held and (b != bucket or total + len(ids) > block_ids):
                    yield flush()
                    held, total, block = [], 0, block + 1
                if b != bucket:
                    bucket, block = b, 0
                held.append((None if pd.isna(i) else int(i), ids))
                total += len(ids)
        if held:
            yield flush()

    (
        docs.withColumn("deal", deal)
        .mapInPandas(encode, "bucket int, doc_id long, deal long, ids binary")
        .repartitionById(buckets, "bucket")
        .sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "deal", "ids")
        .mapInPandas(blocks, BLOCK_SCHEMA)
        .write.option("compression", "zstd")
        .parquet(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (array of int) of every document in the files at `path`."""
    return _read(spark, path, "ids array<int>", lambda ids: ids.astype(np.int32))


def _read(spark: SparkSession, path: str, what: str, of) -> DataFrame:
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # one row for each block, of a million ids: small beside the ids
    sizes = blocks.select("bucket", "block", "n_ids")
    buckets = sizes.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
    ahead = buckets.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("ahead"))
    first = sizes.join(ahead, "bucket").select("bucket", "block", (F.col("ahead") + F.sum("n_ids").over(Window.partitionBy("bucket").orderBy("block")) - F.col("n_ids")).alias("first"))
    # broadcast within a size that is looked up; beyond it, the blocks are shuffled
    first = F.broadcast(first) if sizes.count() <= MOST_BROADCAST else first
    name = what.split()[0]

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for n, docs, ranks, control, data, start in zip(f["n_ids"], f["docs"], f["ranks"], f["control"], f["data"], f["first"], strict=True):
                ids, head = decode_ids(ranks, control, data, n), np.frombuffer(docs, "<i8").reshape(-1, 3)
                ends = np.cumsum(head[:, 2])
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(head[:, 0], "Int64").copy() if head[:, 1].all() else pd.Series(head[:, 0], dtype="Int64").where(head[:, 1] == 1),
                        "start": start + ends - head[:, 2],
                        "n_tokens": head[:, 2],
                        name: [of(ids[e - k : e]) for e, k in zip(ends, head[:, 2], strict=True)],
                    }
                )

    return blocks.join(first, ["bucket", "block"]).mapInPandas(decode, f"doc_id long, start long, n_tokens long, {what}")


def op4_ranked_varint_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), path)
    return _read(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))
