"""Multiplicity, imputation draws, pooling, planned contrasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRIMARY = ("los_hours", "total_charge")


def adjust(df: DataFrame, family: Sequence[str], p: str, order: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Holm and Benjamini-Hochberg p-values within families; null p-values get none and don't count. `order` breaks ties and must leave none.

    A family is ordered in one task: it is a set of results, of thousands of rows, and not of data.
    """
    known = df.filter(F.col(p).isNotNull())
    w = Window.partitionBy(*family).orderBy(p, *order)
    m = F.count("*").over(Window.partitionBy(*family))
    ranked = known.withColumn("_m", m).withColumn("_r", F.row_number().over(w))
    up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a running minimum from the largest p-value down: rows from each one to the end, without summing each frame anew
    down = Window.partitionBy(*family).orderBy(F.desc(p), *[F.desc(o) for o in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumn("holm", F.least(F.lit(1.0), F.max((F.col("_m") - F.col("_r") + 1) * F.col(p)).over(up)))
    ranked = ranked.withColumn("bh", F.least(F.lit(1.0), F.min(F.col("_m") * F.col(p) / F.col("_r")).over(down))).drop("_m", "_r")
    rest = df.filter(F.col(p).isNull()).withColumn("holm", F.lit(None).cast("double")).withColumn("bh", F.lit(None).cast("double"))
    return ranked.unionByName(rest).withColumn("holm_rejects", F.coalesce(F.col("holm") <= alpha, F.lit(False))).withColumn("bh_rejects", F.coalesce(F.col("bh") <= alpha, F.lit(False)))


def family_of(cohort: Column, model: Column, outcome: Column, policy: Column, classes: dict[str, Sequence[str]], primary: Sequence[str] = PRIMARY) -> tuple[Column, Column]:
    """Family and method: the confirmatory family (primary outcomes of the second model on their own samples) is Holm's, all others are BH's."""
    own = policy.isin("los_outcome", "charge_outcome")
    head = F.concat(F.lit("secondary_"), cohort, F.lit("_"), model)
    confirmatory = (cohort == "race") & model.startswith("m2_") & outcome.isin(*primary) & own
    name = F.when(confirmatory, "confirmatory_race_primary").when(own, F.concat(head, F.lit("_outcome_specific_robustness"))).when(outcome.isin(*primary), F.concat(head, F.lit("_common_sample_primary_robustness")))
    for kind, outcomes in classes.items():
        name = name.when(outcome.isin(*outcomes), F.concat(head, F.lit(f"_{kind}")))
    return name.otherwise(F.concat(head, F.lit("_other"))), F.when(confirmatory, "holm").otherwise("fdr_bh")


def family_counts(df: DataFrame, family: Sequence[str], p: str) -> DataFrame:
    return df.groupBy(*family).agg(F.count("*").alias("rows"), F.count(p).alias("estimable"))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the SHA-256 of the parts joined by bars: equal keys draw equal numbers everywhere."""
    head = F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 16)
    return (F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") + 0.5) / 18446744073709551616.0


def whole_cluster_sample(df: DataFrame, cluster: str, share: float, seed: int) -> DataFrame:
    """All rows of the clusters that a hash of the cluster picks; which ones doesn't depend on any outcome."""
    return df.filter(uniform(F.lit(seed), F.col(cluster)) < share)


def bernoulli_draws(df: DataFrame, unit: str, probability: str, draws: int, seed: int) -> DataFrame:
    """A row for each unit and draw with value 0 or 1: one draw holds for all rows of a unit."""
    return df.select(unit, probability).distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("value", (uniform(F.lit(seed), F.col("draw"), F.col(unit)) < F.col(probability)).cast("int"))


def categorical_draws(df: DataFrame, unit: str, classes: Sequence[str], draws: int, seed: int) -> DataFrame:
    """A class for each unit and draw, by cumulated probabilities in the given order; the last class takes the rest."""
    d = df.select(unit, *classes).distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("u", uniform(F.lit(seed), F.col("draw"), F.col(unit)))
    total, out = F.lit(0.0), None
    for c in classes[:-1]:
        total = total + F.col(c)
        out = F.when(F.col("u") < total, c) if out is None else out.when(F.col("u") < total, c)
    return d.select(unit, "draw", out.otherwise(classes[-1]).alias("value"))


def rubin(estimates: DataFrame, by: Sequence[str], estimate: str, variance: str) -> DataFrame:
    """Pooled estimate, within, between and total variance, degrees of freedom and the share of missing information."""
    out = estimates.groupBy(*by).agg(F.count("*").alias("m"), F.avg(estimate).alias("estimate"), F.avg(variance).alias("within"), F.coalesce(F.var_samp(estimate), F.lit(0.0)).alias("between"))
    b = (1 + 1 / F.col("m")) * F.col("between")
    out = out.withColumn("total", F.col("within") + b).withColumn("se", F.sqrt("total"))
    return out.withColumn("df", (F.col("m") - 1) * F.pow(1 + F.try_divide(F.col("within"), b), 2)).withColumn("missing_information", F.try_divide(b, F.col("total")))


def contrasts(estimates: DataFrame, table: DataFrame, by: Sequence[str], cell: str = "cell", value: str = "estimate") -> DataFrame:
    """Planned contrasts: sums of coefficient times estimate over (contrast, cell, coefficient); null unless every cell is there."""
    joined = table.join(estimates, table[cell] == estimates[cell], "left").drop(estimates[cell])
    needed = table.groupBy("contrast").agg(F.count("*").alias("_n"))
    out = joined.groupBy(*by, "contrast").agg(F.sum(F.col("coefficient") * F.col(value)).alias("estimate"), F.count(value).alias("cells"))
    return out.join(needed, "contrast").select(*by, "contrast", F.when(F.col("cells") == F.col("_n"), F.col("estimate")).alias("estimate"), "cells")


def directed_contrasts(groups: Sequence[str], reference: str) -> list[tuple[str, str, float]]:
    """(contrast, cell, coefficient): difference in differences of every pair of groups against a reference on both sides."""
    out = []
    for a in groups:
        for b in groups:
            if a != reference and b != reference:
                out += [(f"{a}_{b}_vs_{reference}", f"{x}_{y}", s) for x, y, s in ((a, b, 1.0), (a, reference, -1.0), (reference, b, -1.0), (reference, reference, 1.0))]
    return out
