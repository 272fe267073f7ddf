"""Exact deduplication as a stateful stream: disk-backed state without expiry, full bytes checked on hits.

Two streams follow a folder of Parquet files, each from its own checkpoint, so that a later call reads only files that are new:

  fingerprints   every row's digest (SHA-256 of its normalised text), stable identifier and content locator (file, row of the file)
  state          in RocksDB, by digest: number of rows, and identifier and locator of the row that stays

No watermark is set, so that nothing ever leaves the state. A digest's rows are summed within tasks before they are shuffled. What
the state says of a row is a hit if another row has its digest; then the contents are read through the locators and compared byte by
byte, and texts that share a digest by chance are told apart.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_ROWS, shared_dir, written

#: Bytes of files that one micro-batch takes in.
BATCH = 256 << 30
SEEN = "doc_id long, digest binary, file string, row long"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a store is closed with its task: what runs at once is open, not every partition of the state
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Letters outside ASCII that lower() may change: capitals, and what Java's patterns know no class of.
OTHER_CAPITALS = r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^\x00-\x7F]]"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is: lower() where it does just this, which is faster than translate()."""
    return F.when(text.rlike(OTHER_CAPITALS), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def normalised(text_col: str) -> Column:
    return lowered(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _locator() -> list[Column]:
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]


def ingest(spark: SparkSession, source: str, store: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> None:
    """Take the files of source (a folder of Parquet, or a file) that the store doesn't know yet into its fingerprints and its state.

    Files may be added to the folder but not changed. A null text counts as empty; null and repeated ids stay.
    """
    schema = spark.read.parquet(source).schema
    # as a pattern, since a stream can follow a folder or a pattern but not a single file
    rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(BATCH)).parquet(f"{source[:-1]}[{source[-1]}]")
    seen = rows.select(F.col(id_col).cast("long").alias("doc_id"), digest(normalised(text_col)).alias("digest"), *_locator())
    with _settings(spark, SETTINGS):
        seen.writeStream.format("parquet").option("path", f"{store}/seen").option("checkpointLocation", f"{store}/seen-log").trigger(availableNow=True).start().awaitTermination()
        if spark.read.parquet(f"{store}/seen").isEmpty():
            return
        stay = F.max(F.struct("doc_id", "file", "row"))
        state = spark.readStream.schema(SEEN).parquet(f"{store}/seen").groupBy("digest").agg(F.count("*").alias("n"), stay.alias("stay"))
        state.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{store}/state").trigger(availableNow=True).start().awaitTermination()


def state_of(spark: SparkSession, store: str) -> DataFrame:
    """digest, n, stay (doc_id, file, row): what the state holds, read from its checkpoint."""
    with _settings(spark, SETTINGS):
        held = spark.read.format("statestore").load(f"{store}/state")
        value = held.schema["value"].dataType.names
        return written(held.select(F.col("key")[held.schema["key"].dataType.names[0]].alias("digest"), F.col("value")[value[0]].alias("n"), F.col("value")[value[1]].alias("stay")), "dedup-state")


def resolve(spark: SparkSession, source: str, store: str, text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest of every row that the store has taken in.

    Of equal texts the row with the largest doc_id stays (a null id is the smallest; of rows with one id, the one with the last
    locator), so that a group keeps exactly one row. group_size counts rows.
    """
    seen = spark.read.schema(SEEN).parquet(f"{store}/seen")
    if seen.isEmpty():
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, digest binary")
    state = state_of(spark, store)
    # a digest with more than a thousandth of all rows meets a broadcast of 1000 digests at most
    hot = F.col("n") > max(HOT_ROWS, state.agg(F.sum("n")).first()[0] / 1000)
    rare = seen.join(F.broadcast(state.filter(hot).select("digest")), "digest", "left_anti")
    found = seen.join(F.broadcast(state.filter(hot)), "digest").unionByName(rare.join(state.filter(~hot), "digest"))
    hits = found.filter("n > 1").select("digest", "file", "row", F.struct("doc_id", "file", "row").alias("own"))
    contents = spark.read.parquet(source).select(normalised(text_col).alias("content"), *_locator()).join(hits, ["file", "row"])
    # equal contents of a digest become one row within each task
    texts = contents.groupBy("digest", "content").agg(F.count("*").alias("own_n"), F.max("own").alias("own_stay"))
    shared = written(texts.groupBy("digest").agg(F.count("*").alias("contents")).filter("contents > 1").select("digest"), "dedup-shared")
    if not shared.isEmpty():
        own = contents.join(shared, "digest", "left_semi").join(texts.join(shared, "digest", "left_semi"), ["digest", "content"]).select("file", "row", "own_n", "own_stay")
        found = found.join(own, ["file", "row"], "left").withColumns({"n": F.coalesce("own_n", "n"), "stay": F.coalesce("own_stay", "stay")})
    kept = (F.col("file") == F.col("stay.file")) & (F.col("row") == F.col("stay.row"))
    return found.select("doc_id", F.col("stay.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "digest")


def op13_streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, store = f"{sf_dir}/documents.parquet", f"{shared_dir(spark)}/dedup-{uuid.uuid4().hex}"
    ingest(spark, source, store)
    return resolve(spark, source, store).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def oracle_sql() -> str:
    norm = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH t AS (SELECT doc_id, {norm} AS content FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(content) AS text_sha256
FROM t WINDOW w AS (PARTITION BY content)
"""
