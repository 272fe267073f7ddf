"""Readers of raw extracts, registries and reference files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions import clean

CORRUPT = "_corrupt_record"


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The column names of one file's first line."""
    return [c.strip().strip('"') for c in spark.read.text(path).first()["value"].split(sep)]


def classify_layout(columns: Sequence[str], layouts: dict[str, tuple[int, Sequence[str]]]) -> str:
    """The layout with this number of columns and all marker columns; anything else is an error, never a guess."""
    have = set(columns)
    found = [name for name, (n, markers) in layouts.items() if n == len(columns) and have.issuperset(markers)]
    if len(found) != 1:
        raise ValueError(f"{len(columns)} columns fit {found or 'no layout'}")
    return found[0]


def strings(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, path: str, names: Sequence[str], *, header: bool = True, sep: str = ",", tolerant: bool = False, key: str | None = None, key_pattern: str | None = None, line_column: str | None = None) -> DataFrame:
    """All columns as strings. Short rows are padded with nulls. A row with too many fields is an error, or dropped if `tolerant`.

    `key_pattern` keeps the rows whose key column matches it wholly. `line_column` names a supplied line number; without one there
    is no source order (Spark gives none).
    """
    schema = strings(names).add(CORRUPT, T.StringType())
    # a pruned read would not see that a row is too long
    df = spark.read.schema(schema).option("columnPruning", False).csv(path, header=header, sep=sep, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, quote='"', escape='"')
    # Spark flags short rows as well: only lines with more separators outside quotes than the layout has are over-long
    bare = F.regexp_replace(F.col(CORRUPT), '"[^"]*"', "")
    extra = F.coalesce(F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) >= len(names), F.lit(False))
    extra = extra & (F.length(F.concat_ws("", F.col(f"`{names[0]}`"))) >= 0)  # a query of the flag column alone is refused
    if tolerant:
        df = df.filter(~extra)
    else:
        df = df.withColumn(names[0], F.when(extra, F.raise_error(F.lit("a row has more fields than its layout"))).otherwise(F.col(f"`{names[0]}`")))
    df = df.drop(CORRUPT)
    if key and key_pattern:
        df = df.filter(clean.fits(F.col(key), key_pattern))
    return df.withColumn(line_column, F.col(line_column).cast("long")) if line_column else df


def read_piped(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Pipe-separated files (paths or patterns) with headers of their own, united by name, with the name of each row's file.

    Files are grouped by their headers, so that a scan is made for each layout and not for each file. No file at all is an error.
    """
    files = sorted(r["path"] for p in paths for r in spark.read.format("binaryFile").option("pathGlobFilter", "[!_]*").load(p).filter("length > 0").select("path").collect())
    by_header: dict[tuple[str, ...], list[str]] = {}
    for f in files:
        by_header.setdefault(tuple(header_of(spark, f, "|")), []).append(f)
    if not by_header:
        raise ValueError(f"no file in {list(paths)}")
    out = None
    for own in by_header.values():
        df = spark.read.csv(own, header=True, sep="|").withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_counts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV without a header and with declared columns."""
    return spark.read.schema(schema).csv(path, header=False)


def register(spark: SparkSession, tables: dict[str, str]) -> None:
    """Reference tables as named views; a missing file is an error at once."""
    for name, path in tables.items():
        spark.read.parquet(path).createOrReplaceTempView(name)


def read_partitions(spark: SparkSession, root: str, **wanted: int) -> DataFrame:
    """All partitions of a folder, united by name, only those wanted: the filters prune folders."""
    df = spark.read.option("mergeSchema", True).option("basePath", root).parquet(root)
    for name, value in wanted.items():
        df = df.filter(F.col(name) == value)
    return df


def read_rows_of_arrays(spark: SparkSession, path: str, fallback: DataFrame | None = None) -> DataFrame:
    """A JSON payload that is an array of arrays of strings, the first of them the header. Unreadable: the fallback.

    Such payloads list a few thousand places; one file is one row.
    """
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("rows"))
    head = raw.select(F.element_at("rows", 1).alias("names")).first()
    if head is None or head["names"] is None:
        if fallback is None:
            raise ValueError(f"{path} isn't an array of arrays")
        return fallback
    rows = raw.select(F.explode(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))).alias("r"))
    return rows.select(*[F.get("r", F.lit(k)).alias(n) for k, n in enumerate(head["names"])])


def inline(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes and SHA-256 of the files below a path (each under 2 GB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
