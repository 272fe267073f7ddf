"""Wide to long and back. Many columns are read in one scan, never by a union of scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_slots(df: DataFrame, keys: Sequence[str], slots: Sequence[tuple[str, str, int]], keep_nulls: bool = False, value: str = "raw") -> DataFrame:
    """One row for each known slot: keys, role, source_field, position, value. slots: (column, role, position)."""
    items = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(c).alias("source_field"), F.lit(pos).alias("position"), F.col(c).cast("string").alias(value)) for c, role, pos in slots])
    long_ = df.select(*keys, F.explode(items).alias("s")).select(*keys, "s.role", "s.source_field", "s.position", f"s.{value}")
    return long_ if keep_nulls else long_.filter(F.col(value).isNotNull())


def unpivot_groups(df: DataFrame, keys: Sequence[str], groups: dict[str, dict[str, str]], label: str = "role") -> DataFrame:
    """Several columns for each label (as a practitioner's fields for each role), nulls kept. groups: label -> {out: column}."""
    items = F.array(*[F.struct(F.lit(name).alias(label), *[F.col(c).alias(out) for out, c in fields.items()]) for name, fields in groups.items()])
    first = next(iter(groups.values()))
    return df.select(*keys, F.explode(items).alias("s")).select(*keys, f"s.{label}", *[f"s.{out}" for out in first])


def pivot_values(df: DataFrame, keys: Sequence[str], label: str, labels: Sequence, fields: Sequence[str], agg=F.max) -> DataFrame:
    """Back to wide: a column label_field for each label and field. The labels are given, so that no scan looks for them."""
    cells = [agg(F.when(F.col(label) == v, F.col(f))).alias(f"{str(v).lower()}_{f}") for v in labels for f in fields]
    return df.groupBy(*keys).agg(*cells)


def pivot_flags(hits: DataFrame, keys: Sequence[str], label: str, labels: Sequence[str], inactive: dict[str, Column] | None = None) -> DataFrame:
    """0/1 for each label; null where `inactive` says that the label didn't exist."""
    out = hits.groupBy(*keys).agg(*[F.max(F.when(F.col(label) == v, 1).otherwise(0)).alias(v) for v in labels])
    for v, where in (inactive or {}).items():
        out = out.withColumn(v, F.when(where, F.lit(None).cast("int")).otherwise(F.col(v)))
    return out


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "variable", value: str = "value", kind: str = "double", keep_nulls: bool = True) -> DataFrame:
    """keys, variable, value: one scan for measures of many columns."""
    items = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast(kind).alias(value)) for c in columns])
    out = df.select(*keys, F.explode(items).alias("m")).select(*keys, f"m.{name}", f"m.{value}")
    return out if keep_nulls else out.filter(F.col(value).isNotNull())


def melt_flags(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "condition") -> DataFrame:
    """(key, label) for each 1 of a wide 0/1 table."""
    return melt(df, keys, columns, name, "flag", "int").filter("flag = 1").drop("flag")


def explode_ranges(ranges: DataFrame, low: str, high: str, out: str, width: int) -> DataFrame:
    """A row for each code of a numeric range, both ends included, with leading zeros."""
    lo, hi = F.col(low).cast("int"), F.col(high).cast("int")
    return ranges.filter(lo <= hi).withColumn(out, F.explode(F.sequence(lo, hi))).withColumn(out, F.lpad(F.col(out).cast("string"), width, "0"))


def cell_basis(sides: tuple[dict[str, Column], dict[str, Column]], weight: Column | None = None) -> dict[str, Column]:
    """Products of the probabilities of one side and the indicators of the other: columns that sum to 1 where both sides do."""
    left, right = sides
    return {f"{a}_{b}": (x * y if weight is None else x * y * weight) for a, x in left.items() for b, y in right.items()}
