"""Joins to code tables, registries and facilities. Tables of codes are small and left to Spark's own size check for broadcasting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.functions import clean


def unique_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def lookup(df: DataFrame, codes: DataFrame, on: dict[str, str], fields: dict[str, str]) -> DataFrame:
    """Left join to a table with unique keys: columns `fields` {out: column} of the row whose columns equal those of `on` {ours: theirs}.

    A code system is part of the key, so that tables of several systems are one join.
    """
    right = codes.select(*[F.col(theirs).alias(f"_k{k}") for k, theirs in enumerate(on.values())], *[F.col(c).alias(out) for out, c in fields.items()])
    condition = [F.col(ours) == F.col(f"_k{k}") for k, ours in enumerate(on)]
    return df.join(right, condition, "left").drop(*[f"_k{k}" for k in range(len(on))])


def matches(df: DataFrame, codes: DataFrame, on: dict[str, str], fields: dict[str, str]) -> DataFrame:
    """Inner join to a table that may hold a key many times: one row for each match."""
    right = codes.select(*[F.col(theirs).alias(f"_k{k}") for k, theirs in enumerate(on.values())], *[F.col(c).alias(out) for out, c in fields.items()])
    return df.join(right, [F.col(ours) == F.col(f"_k{k}") for k, ours in enumerate(on)]).drop(*[f"_k{k}" for k in range(len(on))])


def unique_crosswalk(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that lead to exactly one value."""
    return pairs.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_m")).filter(F.col(value) == F.col("_m")).drop("_m")


def resolve_provider(df: DataFrame, crosswalk: DataFrame, npi: str, licence: str) -> DataFrame:
    """selected_npi and selection_method: a valid direct number, else the unique number of the licence, else why there is none."""
    number, key = clean.digits(F.col(npi)), clean.code(F.col(licence))
    valid = clean.npi_valid(number)
    # rows whose number is valid need no licence: their key is null and they don't gather in the join
    out = df.withColumn("_lk", F.when(~valid, key)).join(crosswalk.select(F.col("licence_key").alias("_lk"), F.col("npi").alias("_x")), "_lk", "left")
    method = (
        F.when(valid, "direct_validated_npi")
        .when(F.col("_x").isNotNull(), "unique_licence_crosswalk")
        .when(number == "9999999999", "source_npi_sentinel")
        .when(number.isNotNull(), "invalid_direct_npi_unresolved")
        .when(key.isNotNull(), "licence_unresolved")
        .otherwise("no_practitioner_identifier")
    )
    return out.withColumn("selected_npi", F.when(valid, number).otherwise(F.col("_x"))).withColumn("selection_method", method).drop("_lk", "_x")


def best_match(left: DataFrame, right: DataFrame, on: Sequence[str], key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Inner join, then the best candidate of each key."""
    return unique_on(left.join(right, list(on)), key, order)


def range_join(df: DataFrame, ranges: DataFrame, key: Column, low: str, high: str, prefix: int) -> DataFrame:
    """Rows whose key lies in a range of a small table, both ends included; a row for each range that holds it. Null keys are in none.

    Ranges are written out for each prefix (the first signs) that they touch, and joined on it: the more rows share a prefix, the
    fewer should be its ranges. A range within one prefix may hold any signs; one that crosses prefixes must have ends of digits.
    """
    first, last = F.substring(low, 1, prefix), F.substring(high, 1, prefix)
    steps = F.sequence(first.try_cast("int"), last.try_cast("int"))
    touched = F.when(first == last, F.array(first)).otherwise(F.transform(steps, lambda k: F.lpad(k.cast("string"), prefix, "0")))
    if ranges.filter((first != last) & steps.isNull()).take(1):
        raise ValueError(f"a range of other signs than digits crosses the first {prefix} signs")
    own = ranges.withColumn("_p", F.explode(touched))
    return df.withColumn("_p", F.substring(key, 1, prefix)).join(own, "_p").filter(key.between(F.col(low), F.col(high))).drop("_p")


def threshold_join(df: DataFrame, thresholds: Sequence[float], value: str) -> DataFrame:
    """A row for each threshold that the value reaches, without a join: the list is short."""
    return df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).filter(F.col(value) >= F.col("threshold"))


def universe(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """All distinct known keys."""
    out = None
    for s in sources:
        k = s.select(key).filter(F.col(key).isNotNull())
        out = k if out is None else out.union(k)
    return out.distinct()


def assemble(keys: DataFrame, parts: Sequence[DataFrame], key: str | Sequence[str]) -> DataFrame:
    """Left joins on one key, shuffled once; parts have one row for each key."""
    for p in parts:
        keys = keys.join(p, key, "left")
    return keys


def restrict(df: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Rows whose key was observed, before anything is aggregated."""
    return df.join(observed.select(key).distinct(), key, "left_semi")


def absent(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a partner; a null key has none."""
    return df.join(other.select(*on), list(on), "left_anti")


def compared(a: DataFrame, b: DataFrame, on: Sequence[str], fields: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Full outer comparison: keys, side (both, left, right), and for each field whether it agrees within the tolerance (nulls agree)."""
    x = a.select(*on, *[F.col(f).alias(f"_a_{f}") for f in fields], F.lit(1).alias("_a"))
    y = b.select(*on, *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(1).alias("_b"))
    numeric = {f.name for f in a.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")}

    def same(f: str) -> Column:
        p, q = F.col(f"_a_{f}"), F.col(f"_b_{f}")
        return p.eqNullSafe(q) | F.coalesce(F.abs(p - q) <= tolerance, F.lit(False)) if f in numeric else p.eqNullSafe(q)

    side = F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both")
    return x.join(y, list(on), "full_outer").select(*on, side.alias("side"), *[F.when(side == "both", same(f)).alias(f"{f}_agrees") for f in fields])


def disagreements(a: DataFrame, b: DataFrame, on: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """field, disagreements over the keys of both: one row for each field."""
    c = compared(a, b, on, fields).filter("side = 'both'")
    wide = c.agg(F.count("*").alias("compared"), *[F.count_if(~F.col(f"{f}_agrees")).alias(f) for f in fields])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col("compared").alias("compared"), F.col(f).alias("disagreements")) for f in fields])).alias("r")).select("r.*")
