"""Shared helpers: shared scratch tables and documents clean-up."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only where it is unset and Spark is local, a new temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's own number for shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long and text string only; a null text is empty. Other columns, whatever their names, go."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def pieces(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text parted at spaces, so that its words are never all held at once."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


#: A key with more rows than this, and than a thousandth of all rows, is hot: there are 1000 such keys at most.
HOT_ROWS = 10_000


def hot_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, on, how) for a right side with one row for each key, however many rows of the left one share a key.

    Rows of hot keys stay where they are and meet a broadcast of those keys' rows, 1000 at most; all others are shuffled. Both sides
    are read more than once: they should be stored. Null keys meet nothing.
    """
    total = left.count()
    if total <= HOT_ROWS:
        return left.join(right, on, how)
    counts = left.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > max(HOT_ROWS, total / 1000)).drop("_n")
    hot = F.broadcast(counts)
    some = left.join(hot, on, "left_semi").join(F.broadcast(right.join(hot, on, "left_semi")), on, how)
    return some.unionByName(left.join(hot, on, "left_anti").join(right, on, how))
