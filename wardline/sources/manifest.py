"""Writers, manifests and incremental builds by partition."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], sort: Sequence[str] = (), rows_a_file: int = 5_000_000) -> None:
    """zstd Parquet, one folder for each partition; only the partitions in df are replaced. Rows of a partition are spread over tasks by size."""
    out = df.hint("rebalance", *by)
    if sort:
        out = out.sortWithinPartitions(*by, *sort)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).partitionBy(*by).parquet(path)


def fan_out(df: DataFrame, path: str, tables: dict[str, Sequence[str]], keys: Sequence[str]) -> dict[str, int]:
    """One table for each list of columns, all with the keys; every one must have as many rows as the input."""
    df = df.persist()
    try:
        n = df.count()
        for name, columns in tables.items():
            df.select(*keys, *columns).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    finally:
        df.unpersist()
    counts = {name: df.sparkSession.read.parquet(f"{path}/{name}").count() for name in tables}
    if any(c != n for c in counts.values()):
        raise ValueError(f"{n} rows became {counts}")
    return counts


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header; what it is computed from keeps its own tasks."""
    df.repartition(1).write.mode("overwrite").csv(path, header=True)


def manifest(df: DataFrame, by: Sequence[str], measures: dict[str, Column], passed: Column, fingerprint: str | None = None) -> DataFrame:
    """One row for each partition: rows, measures, whether it passed, and the fingerprint of the inputs it was built from."""
    out = df.groupBy(*by).agg(F.count("*").alias("rows"), *[c.alias(n) for n, c in measures.items()])
    return out.withColumn("passed", F.coalesce(passed, F.lit(False))).withColumn("fingerprint", F.lit(fingerprint).cast("string"))


def missing_partitions(required: DataFrame, done: DataFrame, by: Sequence[str]) -> DataFrame:
    """Partitions (with the fingerprint of their inputs) that have no valid manifest row for these inputs."""
    valid = done.filter("passed").select(*by, "fingerprint")
    return required.join(valid, [*by, "fingerprint"], "left_anti")


def build_missing(spark: SparkSession, required: DataFrame, done: DataFrame, by: Sequence[str], build: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Build what is missing, all partitions in one job, and return it."""
    todo = missing_partitions(required, done, by)
    write_partitioned(build(todo), path, by)
    return todo


def expected_periods(spark: SparkSession, first: int, last: int, without: Sequence[int] = ()) -> DataFrame:
    """visit_year, visit_quarter of every quarter, without excluded years."""
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("visit_year"))
    if without:
        years = years.filter(~F.col("visit_year").isin(*without))
    return years.select("visit_year", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("visit_quarter"))


def inventory(df: DataFrame, expected: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of each expected or found partition, and its status: ok, missing or unexpected."""
    found = df.groupBy(*by).agg(F.count("*").alias("rows"))
    both = found.withColumn("_f", F.lit(1)).join(expected.select(*by).distinct().withColumn("_e", F.lit(1)), list(by), "full_outer")
    status = F.when(F.col("_f").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").otherwise("ok")
    return both.select(*by, F.coalesce("rows", F.lit(0)).alias("rows"), status.alias("status"))
