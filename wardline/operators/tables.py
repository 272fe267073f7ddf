"""Results kept in the session's shared folder between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """checkpoint() to the session's shared folder; without one (local tests) a cache."""
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return df.checkpoint() if sc._jsc.sc().getCheckpointDir().isDefined() else df.persist()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table of the session's shared folder, read back: unlike a checkpoint it has its real size, by which joins are planned."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
