"""CSV rows with the numbers they have in their file, read in splits: lines are counted by split, and splits added up."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINES = "file string, block long, line long, value string, first0 boolean, last0 boolean, record0 long, record1 long"


def _lines(batches: Iterator) -> Iterator:
    """Lines of a task's splits, in order, with what can be said of a line from its split alone.

    first0, last0: the line begins or ends a record if the split begins outside quotes; if it begins inside, exactly the lines for
    which these are false begin or end one. record0, record1: records begun in the split up to the line, in either case.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    now, line, quotes, records = None, 0, 0, [0, 0]
    for b in batches:
        if not b.num_rows:
            continue
        file, block, value = b.column(0), b.column(1).to_numpy(zero_copy_only=False), b.column(2)
        count = pc.count_substring(value, '"').to_numpy(zero_copy_only=False).astype(np.int64)
        blank = pc.is_in(value, value_set=pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
        code = file.dictionary_encode()
        key = code.indices.to_numpy(zero_copy_only=False)
        change = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
        out = []
        for a, e in zip(change, [*change[1:], len(key)], strict=True):
            if (own := (code.dictionary[int(key[a])].as_py(), int(block[a]))) != now:
                now, line, quotes, records = own, 0, 0, [0, 0]
            after = quotes + np.cumsum(count[a:e])
            before = after - count[a:e]
            begun = [records[h] + np.cumsum(((before + h) % 2 == 0) & ~blank[a:e]) for h in (0, 1)]
            out.append((line + np.arange(e - a), before % 2 == 0, after % 2 == 0, *begun))
            line, quotes, records = line + int(e - a), int(after[-1]), [int(x[-1]) for x in begun]
        yield pa.RecordBatch.from_arrays([file, b.column(1), pa.array(np.concatenate([x[0] for x in out])), value, *[pa.array(np.concatenate([x[j] for x in out])) for j in range(1, 5)]], ["file", "block", "line", "value", "first0", "last0", "record0", "record1"])


def numbered_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """file, record (from 1 in each file), value: the records of text files in which a quoted field may hold line ends.

    Files are read twice, in splits, and nothing is sorted: the first pass counts each split's records, for a start inside and one
    outside quotes, and its quotes; sums over a file's splits say which of the two holds and what number its first record has. Only
    the lines of records of several lines meet. Blank lines between records don't count. A file with an unclosed quote is an error.
    """
    text = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = text.mapInArrow(_lines, LINES)
    last = F.max_by("last0", "line")
    splits = lines.groupBy("file", "block").agg(F.max("record0").alias("n0"), F.max("record1").alias("n1"), (~last).cast("long").alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    splits = splits.withColumn("start", F.coalesce(F.sum(F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0"))).over(before), F.lit(0)))
    open_ = splits.groupBy("file").agg((F.sum("odd") % 2).alias("odd")).filter("odd = 1").select("file").limit(1).collect()
    if open_:
        raise ValueError(f"{open_[0]['file']}: a quote isn't closed")
    placed = lines.join(splits.select("file", "block", "inside", "start"), ["file", "block"])
    first, ends = F.col("first0") != F.col("inside"), F.col("last0") != F.col("inside")
    record = F.col("start") + F.when(F.col("inside"), F.col("record1")).otherwise(F.col("record0"))
    placed = placed.select("file", "block", "line", "value", record.alias("record"), first.alias("first"), ends.alias("ends")).filter(~(F.col("first") & F.col("value").isin("", "\r")))
    whole = placed.filter("first AND ends").select("file", "record", "value")
    parts = placed.filter("NOT (first AND ends)").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("p"))
    joined = parts.select("file", "record", F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"))
    return whole.unionByName(joined).withColumn("value", F.regexp_replace("value", r"\r$", ""))


def field_count(value: Column, sep: str) -> Column:
    """Separators outside quotes, and one."""
    bare = F.regexp_replace(value, '"[^"]*"', "")
    return (F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))) / len(sep) + 1


def read_numbered_csv(spark: SparkSession, path: str | Sequence[str], names: Sequence[str], number: str = "source_row", *, header: bool = True, sep: str = ",", tolerant: bool = False, file: str | None = None) -> DataFrame:
    """All columns as strings, and each row's number in its file, from 1 after the header. Short rows are padded with nulls, empty
    fields are null. A row with too many fields is an error, or dropped if `tolerant` (its number stays its own). file: a column of
    the file's name."""
    records = numbered_records(spark, path)
    if header:
        records = records.filter("record > 1").withColumn("record", F.col("record") - 1)
    long_ = field_count(F.col("value"), sep) > len(names)
    if tolerant:
        records = records.filter(~long_)
    else:
        records = records.withColumn("value", F.when(long_, F.raise_error(F.lit("a row has more fields than its layout"))).otherwise(F.col("value")))
    fields = F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    name = [F.element_at(F.split("file", "/"), -1).alias(file)] if file else []
    return records.select(fields.alias("f"), F.col("record").alias(number), *name).select("f.*", number, *([file] if file else []))
