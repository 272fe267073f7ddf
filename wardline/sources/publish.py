"""Builds by partition that readers see only when they are whole: staged, counted while they are written, verified, then recorded.

A root folder holds `builds/build=<id>/<partition folders>` and a table `manifest`, to which each build appends a row for each of its
partitions. What counts is the manifest: readers take, for each partition, the folder of its last row that passed. A build that
fails half-way has no rows there, so that the partitions it was to replace stay readable as they were.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Partitions that are built in one job: each has a few numbers in the observation.
PARTITIONS_TOGETHER = 200


def observed(df: DataFrame, by: Sequence[str], partitions: Sequence[tuple], measures: dict[str, Column], prefix: str) -> tuple[DataFrame, Observation]:
    """df, and an observation of the rows that pass here and of sums of measures, for each partition, taken while df is computed.

    measures: conditions, counted; their names must be different. Put it where no shuffle lies between it and the write, or where a
    recount after a lost executor doesn't matter: a task that is run again after its stage has ended counts again.
    """
    seen = Observation(f"{prefix}-{uuid.uuid4().hex}")
    metrics = []
    for k, p in enumerate(partitions):
        here = F.lit(True)
        for c, v in zip(by, p, strict=True):
            here = here & F.col(c).eqNullSafe(F.lit(v))
        metrics += [F.count_if(here).alias(f"rows{k}"), *[F.count_if(here & F.coalesce(m, F.lit(False))).alias(f"m{j}_{k}") for j, m in enumerate(measures.values())]]
    return df.observe(seen, *metrics), seen


def counts_of(seen: Observation, partitions: Sequence[tuple], measures: Sequence[str]) -> dict[tuple, dict[str, int]]:
    got = seen.get
    return {p: {"rows": int(got[f"rows{k}"])} | {m: int(got[f"m{j}_{k}"]) for j, m in enumerate(measures)} for k, p in enumerate(partitions)}


def manifest_of(spark: SparkSession, root: str, by: Sequence[str]) -> DataFrame | None:
    """All rows that builds have appended; None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{root}/manifest")


def current(spark: SparkSession, root: str, by: Sequence[str]) -> DataFrame | None:
    """The row that counts for each partition: the last that passed."""
    rows = manifest_of(spark, root, by)
    if rows is None:
        return None
    return rows.filter("passed").groupBy(*by).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in by]), "build").alias("r")).select(*by, "r.*")


def read_published(spark: SparkSession, root: str, by: Sequence[str], **wanted) -> DataFrame:
    """The rows of all published partitions, or of those wanted; nothing published is an error."""
    rows = current(spark, root, by)
    for c, v in wanted.items():
        rows = None if rows is None else rows.filter(F.col(c) == v)
    found = [] if rows is None else sorted(r["folder"] for r in rows.select("folder").collect())
    if not found:
        raise ValueError(f"nothing is published in {root}")
    return spark.read.option("basePath", f"{root}/builds").parquet(*[f"{root}/builds/{f}" for f in found]).drop("build")


def publish(spark: SparkSession, root: str, by: Sequence[str], required: DataFrame, source: Callable[[DataFrame], DataFrame], build: Callable[[DataFrame], DataFrame], source_measures: dict[str, Column], measures: dict[str, Column], must_match: tuple[str, str]) -> DataFrame:
    """Build, verify and publish the required partitions (by and fingerprint) that have no passed row with their fingerprint.

    source(todo) gives the source's rows of these partitions, build(rows) the output's. Rows and measures of both are counted while
    the output is written, in its one job: source_rows and source_measures, rows and measures. The written rows of each partition
    must be as many as were counted, and the two counts that must_match names must agree; only then the partition's row has passed.
    Returns the rows appended. An error leaves no row.
    """
    done = current(spark, root, by)
    todo = required if done is None else required.join(done.select(*by, "fingerprint"), [*by, "fingerprint"], "left_anti")
    prints = {tuple(r[c] for c in by): r["fingerprint"] for r in todo.select(*by, "fingerprint").distinct().collect()}
    out, keys = [], sorted(prints, key=repr)
    for first in range(0, len(keys), PARTITIONS_TOGETHER):
        some = keys[first : first + PARTITIONS_TOGETHER]
        build_id = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        folder = f"{root}/builds/build={build_id}"
        own = spark.createDataFrame([(*p, prints[p]) for p in some], todo.select(*by, "fingerprint").schema)
        read, seen_in = observed(source(own), by, some, source_measures, "source")
        made, seen_out = observed(build(read), by, some, measures, "output")
        made.write.option("compression", "zstd").partitionBy(*by).parquet(folder)
        before, after = counts_of(seen_in, some, list(source_measures)), counts_of(seen_out, some, list(measures))
        # counted from the files' footers: no column is read
        there = {tuple(r[c] for c in by): r["n"] for r in spark.read.parquet(folder).groupBy(*by).agg(F.count("*").alias("n")).collect()} if any(x["rows"] for x in after.values()) else {}
        rows = []
        for p in some:
            counts = {"source_rows": before[p]["rows"]} | {m: before[p][m] for m in source_measures} | after[p]
            passed = there.get(p, 0) == counts["rows"] > 0 and counts[must_match[0]] == counts[must_match[1]]
            path = "/".join([f"build={build_id}", *[f"{c}={v}" for c, v in zip(by, p, strict=True)]])
            rows.append((*p, build_id, path, prints[p], *counts.values(), passed))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.select(*by).schema)
        names = ["source_rows", *source_measures, "rows", *measures]
        added = spark.createDataFrame(rows, f"{schema}, build string, folder string, fingerprint string, {', '.join(f'`{n}` long' for n in names)}, passed boolean")
        added.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
        out.append(added)
    result = out[0] if out else spark.createDataFrame([], required.select(*by).schema.add("build", "string").add("folder", "string").add("fingerprint", "string").add("passed", "boolean"))
    for more in out[1:]:
        result = result.unionByName(more)
    return result
