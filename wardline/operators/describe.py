"""Descriptive statistics: pairs, contrasts of means, standardised differences, support of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import reshape
from .quantiles import beside, exact_quantiles

Z95 = 1.95996398454


#: Chebyshev fit of the complementary error function, relative error under 1.2e-7 everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided_p(z: Column) -> Column:
    """Normal two-sided p-value."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + x / 2)
    power = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        power = power * t + c
    return t * F.exp(power - x * x)


def summary(df: DataFrame, by: Sequence[str], outcomes: Sequence[str], percentiles: Sequence[float] = (0.01, 0.25, 0.5, 0.75, 0.99)) -> DataFrame:
    """n, missing, mean, sd, percentiles, min and max of each outcome by group, in one scan."""
    long_ = reshape.melt(df, by, outcomes, "outcome")
    out = long_.groupBy(*by, "outcome").agg(
        F.count("*").alias("rows"), F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    names = {f"p{round(100 * p):02d}": p for p in percentiles}
    out = beside(out, exact_quantiles(long_, [*by, "outcome"], "value", names), [*by, "outcome"])
    return out.select(*by, "outcome", "rows", "n", (F.col("rows") - F.col("n")).alias("missing"), "mean", "sd", "min", "max", *names)


def four_cell_contrast(df: DataFrame, pair: str, cells: Sequence[str], outcomes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """m0 - m1 - m2 + m3 over four exclusive cells, its unclustered error, z, p, interval, and per cent of the mean; only where all cells have values."""
    signs = (1.0, -1.0, -1.0, 1.0)
    long_ = reshape.melt(df.filter(F.col(pair).isin(*cells)), [*by, pair], outcomes, "outcome", keep_nulls=False)
    m = long_.groupBy(*by, "outcome", pair).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.sum("value").alias("s"))
    def cell(c: str, f: str) -> Column:
        return F.max(F.when(F.col(pair) == c, F.col(f)))

    wide = m.groupBy(*by, "outcome").agg(
        sum((s * cell(c, "m") for s, c in zip(signs[1:], cells[1:], strict=True)), cell(cells[0], "m")).alias("estimate"),
        F.sqrt(sum((cell(c, "v") / cell(c, "n") for c in cells[1:]), cell(cells[0], "v") / cell(cells[0], "n"))).alias("se"),
        F.sum("n").alias("n"),
        (F.sum("s") / F.sum("n")).alias("mean"),
    ).filter("estimate is not null")
    z = F.try_divide(F.col("estimate"), F.col("se"))
    return wide.select(
        *by, "outcome", "estimate", "se", (F.col("estimate") - Z95 * F.col("se")).alias("ci_low"), (F.col("estimate") + Z95 * F.col("se")).alias("ci_high"), z.alias("z"), two_sided_p(z).alias("p"), "n", "mean",
        F.try_divide(100 * F.col("estimate"), F.col("mean")).alias("percent_of_mean"),
    )


def standardized_differences(df: DataFrame, group: str, comparisons: dict[str, tuple[str, str]], variables: Sequence[str], flag: float = 0.1) -> DataFrame:
    """(mean a - mean b) over the root of the mean of both variances, for each comparison and variable."""
    m = reshape.melt(df, [group], variables, keep_nulls=False).groupBy(group, "variable").agg(F.avg("value").alias("m"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v"), F.count("*").alias("n"))
    items = F.array(*[F.struct(F.lit(name).alias("comparison"), F.lit(a).alias("a"), F.lit(b).alias("b")) for name, (a, b) in comparisons.items()])
    sides = m.withColumn("c", F.explode(items)).filter((F.col(group) == F.col("c.a")) | (F.col(group) == F.col("c.b")))

    def side(which: str, f: str) -> Column:
        return F.max(F.when(F.col(group) == F.col(f"c.{which}"), F.col(f)))

    d = F.try_divide(side("a", "m") - side("b", "m"), F.sqrt((side("a", "v") + side("b", "v")) / 2))
    out = sides.groupBy(F.col("c.comparison").alias("comparison"), "variable").agg(side("a", "m").alias("mean_a"), side("b", "m").alias("mean_b"), d.alias("smd"))
    return out.withColumn("imbalanced", F.abs("smd") >= flag)


def cell_means(df: DataFrame, dimensions: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """n, mean and sd of each outcome in every combination of the dimensions that occurs; null dimensions are left out."""
    known = df.dropna(subset=list(dimensions))
    long_ = reshape.melt(known, dimensions, outcomes, "outcome", keep_nulls=False)
    return long_.groupBy(*dimensions, "outcome").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def composition(df: DataFrame, by: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """n and per cent of each value of each variable within its group."""
    from pyspark.sql.window import Window

    counts = reshape.melt(df, by, variables, kind="string").groupBy(*by, "variable", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(*by, "variable")))


def rates_by_stratum(df: DataFrame, variables: Sequence[str], linked: Column) -> DataFrame:
    """Rows, linked rows and their rate for each value of each variable."""
    long_ = reshape.melt(df.withColumn("_l", linked.cast("int")), ["_l"], variables, kind="string")
    return long_.groupBy("variable", "value").agg(F.count("*").alias("n"), F.sum("_l").alias("linked")).withColumn("rate", F.col("linked") / F.col("n"))


def profile(df: DataFrame, group: str, variables: Sequence[str]) -> DataFrame:
    """Mean, sd and median of variables by group, such as linked and unlinked rows."""
    long_ = reshape.melt(df, [group], variables, keep_nulls=False)
    out = long_.groupBy(group, "variable").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return beside(out, exact_quantiles(long_, [group, "variable"], "value", {"median": 0.5}), [group, "variable"])


def rate_distribution(df: DataFrame, units: Sequence[str], linked: Column) -> DataFrame:
    """The distribution over units of their rates."""
    rates = df.groupBy(*units).agg(F.avg(linked.cast("double")).alias("rate"))
    return rates.agg(F.count("*").alias("units"), F.avg("rate").alias("mean"), F.stddev_samp("rate").alias("sd"), F.min("rate").alias("min"), *[F.percentile("rate", F.lit(p)).alias(f"p{round(100 * p)}") for p in (0.25, 0.5, 0.75)], F.max("rate").alias("max"))


def kish(weight: Column) -> Column:
    """Effective number of rows under weights."""
    return F.try_divide(F.pow(F.sum(weight), 2), F.sum(weight * weight))


def support(df: DataFrame, by: Sequence[str], weight: str, physician: str, facility: str, least: float = 30, least_clusters: int = 10) -> DataFrame:
    """Visits, weights, effective visits and physicians, distinct clusters, whether a physician's weight is constant, and the status of each cell."""
    w = F.col(weight)
    visits = df.filter(w > 0).groupBy(*by).agg(F.count("*").alias("visits"), F.sum(w).alias("mass"), F.sum(w * w).alias("mass2"), kish(w).alias("effective"), F.count_distinct(physician).alias("physicians"), F.count_distinct(facility).alias("facilities"))
    each = df.filter(w > 0).groupBy(*by, physician).agg(F.max(w).alias("_w"), (F.max(w) - F.min(w) < 1e-12).alias("_c"))
    people = each.groupBy(*by).agg(kish(F.col("_w")).alias("effective_physicians"), F.coalesce(F.bool_and("_c"), F.lit(False)).alias("constant_weights"))
    status = F.when((F.col("effective") < least), "insufficient_visits").when(F.col("effective_physicians") < least_clusters, "insufficient_physicians").when(F.col("facilities") < 2, "insufficient_facilities").otherwise("supported")
    return visits.join(people, list(by)).withColumn("status", status)


def outcome_support(df: DataFrame, by: Sequence[str], weight: str, outcomes: Sequence[str], physician: str) -> DataFrame:
    """Weighted mean, variance, naive error on the effective number, by cell and outcome over its known values; and the physicians' mass."""
    long_ = reshape.melt(df, [*by, weight, physician], outcomes, "outcome", keep_nulls=False)
    w, y = F.col(weight), F.col("value")
    cells = long_.groupBy(*by, "outcome").agg(F.count("*").alias("n"), F.sum(w).alias("mass"), (F.sum(w * y) / F.sum(w)).alias("mean"), (F.sum(w * y * y) / F.sum(w)).alias("second"), kish(w).alias("effective"))
    people = long_.groupBy(*by, "outcome", physician).agg(F.max(w).alias("_w")).groupBy(*by, "outcome").agg(F.sum("_w").alias("physician_mass"), kish(F.col("_w")).alias("effective_physicians"))
    variance = F.greatest(F.col("second") - F.col("mean") * F.col("mean"), F.lit(0.0))
    return cells.join(people, [*by, "outcome"]).withColumn("variance", variance).withColumn("naive_se", F.sqrt(F.try_divide(variance, F.col("effective"))))
