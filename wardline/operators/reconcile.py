"""Checks that compare every output with its inputs. A check is a row (check, expected, observed, passed); nothing is repaired."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "check string, expected double, observed double, passed boolean"


def _check(df: DataFrame, name: str, expected: Column, observed: Column, passed: Column | None = None) -> DataFrame:
    e, o = expected.cast("double"), observed.cast("double")
    return df.select(F.lit(name).alias("check"), e.alias("expected"), o.alias("observed"), (e.eqNullSafe(o) if passed is None else F.coalesce(passed, F.lit(False))).alias("passed"))


def rows_equal(source: DataFrame, output: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, source_rows, output_rows, passed for each partition of either."""
    a = source.groupBy(*by).agg(F.count("*").alias("source_rows"))
    b = output.groupBy(*by).agg(F.count("*").alias("output_rows"))
    return a.join(b, list(by), "full_outer").fillna(0, ["source_rows", "output_rows"]).withColumn("passed", F.col("source_rows") == F.col("output_rows"))


def key_unique(df: DataFrame, keys: Sequence[str], name: str = "key_unique") -> DataFrame:
    g = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("_d"))
    return _check(g, name, F.lit(0), F.col("_d"))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def none_of(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """A check for each condition that no row may meet, all in one scan."""
    g = df.agg(*[F.count_if(c).alias(f"_{k}") for k, c in enumerate(tests.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.lit(0.0).alias("expected"), F.col(f"_{k}").cast("double").alias("observed"), (F.col(f"_{k}") == 0).alias("passed")) for k, name in enumerate(tests)])
    return g.select(F.explode(rows).alias("r")).select("r.*")


def all_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that a release can't fill must be null in every row."""
    return none_of(df, {f"{c}_is_null": F.col(c).isNotNull() for c in columns})


def sums_match(parts: DataFrame, whole: DataFrame, measures: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """The sums of partition aggregates against a global aggregate."""
    a = parts.agg(*[F.sum(m).cast("double").alias(f"_a{k}") for k, m in enumerate(measures)])
    b = whole.agg(*[F.sum(m).cast("double").alias(f"_b{k}") for k, m in enumerate(measures)])
    rows = F.array(*[F.struct(F.lit(m).alias("check"), F.col(f"_b{k}").alias("expected"), F.col(f"_a{k}").alias("observed"), (F.abs(F.col(f"_a{k}") - F.col(f"_b{k}")) <= tolerance * F.greatest(F.abs(F.col(f"_b{k}")), F.lit(1.0))).alias("passed")) for k, m in enumerate(measures)])
    return a.crossJoin(b).select(F.explode(rows).alias("r")).select("r.*")


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one side only, both ways."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    left = x.exceptAll(y).agg(F.count("*").alias("n"))
    right = y.exceptAll(x).agg(F.count("*").alias("n"))
    return _check(left, "only_left", F.lit(0), F.col("n")).unionByName(_check(right, "only_right", F.lit(0), F.col("n")))


def grid_complete(results: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected combinations that are missing, results that nobody expected, and combinations that stand twice."""
    have = results.groupBy(*keys).agg(F.count("*").alias("n"))
    both = expected.select(*keys).distinct().withColumn("_e", F.lit(1)).join(have, list(keys), "full_outer")
    return none_of(both, {"missing": F.col("n").isNull(), "unexpected": F.col("_e").isNull(), "repeated": F.coalesce(F.col("n") > 1, F.lit(False))})


def orphans(fact: DataFrame, relations: dict[str, tuple[str, DataFrame, str]]) -> DataFrame:
    """Rows of a fact table whose key isn't in a dimension, for each relation {name: (column, dimension, key)}; nulls aren't orphans."""
    out = None
    for name, (column, dimension, key) in relations.items():
        lost = fact.filter(F.col(column).isNotNull()).join(dimension.select(F.col(key).alias(column)), column, "left_anti").agg(F.count("*").alias("n"))
        row = _check(lost, name, F.lit(0), F.col("n"))
        out = row if out is None else out.unionByName(row)
    return out


def vocabulary(df: DataFrame, allowed: dict[str, Sequence[str]]) -> DataFrame:
    return none_of(df, {f"{c}_vocabulary": F.col(c).isNotNull() & ~F.col(c).isin(*values) for c, values in allowed.items()})


def sane_results(df: DataFrame, estimate: str, se: str, low: str, high: str, p: str) -> DataFrame:
    """Finite estimates, intervals that hold them, p-values in 0 to 1, errors not negative."""
    def finite(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    return none_of(
        df,
        {
            "estimate_finite": ~finite(estimate),
            "se_not_negative": F.coalesce(F.col(se) < 0, F.lit(False)),
            "interval_holds_estimate": F.coalesce((F.col(low) > F.col(estimate)) | (F.col(high) < F.col(estimate)), F.lit(False)),
            "p_in_0_1": F.coalesce((F.col(p) < 0) | (F.col(p) > 1), F.lit(False)),
        },
    )


def catalogue(checks: DataFrame, table: DataFrame) -> DataFrame:
    """A static list of fields (check, level, note) with the outcome of their checks; a field without one stays open."""
    return table.join(checks, "check", "left").withColumn("status", F.when(F.col("passed").isNull(), "not_run").when(F.col("passed"), "passed").otherwise("failed"))


def fingerprints_match(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """file and status of recorded and found fingerprints (file, sha256): same, changed, missing or new."""
    a, b = recorded.select("file", F.col("sha256").alias("_a")), found.select("file", F.col("sha256").alias("_b"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "new").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return a.join(b, "file", "full_outer").select("file", status.alias("status"))
