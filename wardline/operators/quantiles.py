"""Exact quantiles of groups of any size, interpolated between neighbouring values.

Each value is counted first. A group of few distinct values holds them in one aggregate. Where a group has more, approximate
quantiles, wrong by a known share of the ranks at most, bound a short stretch of values round each quantile; the counts below a
stretch, and a sorted running count of the values in it, which can spill, give the exact quantile. No buffer grows with a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import written

#: A stretch spans this share of the ranks on either side of its quantile; approximate quantiles are off by a fifth of it at most.
SLACK, ACCURACY = 0.0005, 10_000
#: Distinct values of a group that one aggregate holds.
HELD_VALUES = 100_000


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """by, and a column for each quantile {name: share}, interpolated linearly; null values don't count; a group without values has nulls.

    A group's null key is a group of its own. Ties need no rule: equal values are one. The values are counted in one pass and stored.
    """
    names = list(quantiles)
    keys = [f"_k{k}" for k in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    cells = written(df.select(*named, F.col(value).cast("double").alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_c")))
    full = cells.filter(F.col("_v").isNotNull())
    most = full.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= HELD_VALUES:
        shares = F.array(*[F.lit(float(q)) for q in quantiles.values()])
        found = cells.groupBy(*keys).agg(F.percentile("_v", shares, F.col("_c")).alias("_q"))
        return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], *[F.get("_q", F.lit(k)).alias(n) for k, n in enumerate(names)])
    edges = [float(q) for share in quantiles.values() for q in (max(0.0, share - SLACK), min(1.0, share + SLACK))]
    v = F.col(value).cast("double")
    bounds = written(df.groupBy(*named).agg(F.count(v).alias("_n"), F.percentile_approx(v, edges, ACCURACY).alias("_e")))
    rows = beside(full, bounds, keys, "inner")
    low, high = [F.get("_e", F.lit(2 * k)) for k in range(len(names))], [F.get("_e", F.lit(2 * k + 1)) for k in range(len(names))]
    v, c, ks = F.col("_v"), F.col("_c"), range(len(names))
    below = written(rows.groupBy(*keys).agg(*[x for k in ks for x in (F.sum(F.when(v < low[k], c).otherwise(0)).alias(f"_b{k}"), F.max(F.when(v < low[k], v)).alias(f"_p{k}"), F.min(F.when(v > high[k], v)).alias(f"_n{k}"))]))
    # a rank next to a quantile is in the stretch round it, or the value before or after it; within it values are numbered in order
    near = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.between(low[k], high[k]).alias("in")) for k in ks]), lambda x: x["in"])
    stretches = below.select(*keys, F.posexplode(F.array(*[F.struct(F.col(f"_b{k}").alias("b"), F.col(f"_p{k}").alias("p"), F.col(f"_n{k}").alias("n")) for k in ks])).alias("_k", "_s"))
    order = Window.partitionBy(*keys, "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("_k", F.explode(F.transform(near, lambda x: x["k"]))).select(*keys, "_k", "_v", "_c", F.sum("_c").over(order).alias("_until"))
    places = beside(stretches, bounds.select(*keys, "_n"), keys, "inner").withColumn("_place", (F.col("_n") - 1) * F.element_at(F.array(*[F.lit(float(q)) for q in quantiles.values()]), F.col("_k") + 1))
    ranked = beside(places, inside, [*keys, "_k"])

    def at(rank: Column) -> Column:
        """The value of a rank, from 0."""
        left = rank - F.col("_s.b")
        found = F.max(F.when((F.col("_until") > left) & (F.col("_until") - F.col("_c") <= left), v))
        return F.coalesce(found, F.max(F.when(left < 0, F.col("_s.p")).otherwise(F.col("_s.n"))))

    ends = ranked.groupBy(*keys, "_k").agg(at(F.floor("_place")).alias("_lo"), at(F.ceil("_place")).alias("_hi"), F.any_value("_place").alias("_place"))
    value_ = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_place") - F.floor("_place"))
    found = ends.groupBy(*keys).agg(*[F.max(F.when(F.col("_k") == k, value_)).alias(n) for k, n in enumerate(names)])
    out = beside(bounds.select(*keys), found, keys) if keys else found
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], *names)


def beside(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """left with the other columns of right, a table of groups; null keys meet null keys."""
    if not by:
        return left.join(right)
    renamed = right.select(*[F.col(c).alias(f"_r{k}") for k, c in enumerate(by)], *[c for c in right.columns if c not in by])
    return left.join(renamed, [F.col(c).eqNullSafe(F.col(f"_r{k}")) for k, c in enumerate(by)], how).drop(*[f"_r{k}" for k in range(len(by))])
