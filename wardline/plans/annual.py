"""The minimum slice: occurrences with their codes, metrics by visit, the high-count flag of each quarter, annual summary with shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import link, metrics


def visit_table(visits: DataFrame, occurrences: DataFrame, codes: DataFrame) -> DataFrame:
    """visits with n_codes, n_groups, principal group, and whether n_codes reaches the p90 of its quarter."""
    enriched = link.lookup(occurrences, codes, {"code": "code"}, {"category": "category"})
    per_visit = metrics.visit_metrics(enriched, "visit_id", "role", ["principal", "secondary", "external"], "category", "principal", {"principal_category": "category"})
    full = metrics.completed(visits, per_visit, "visit_id", ["n_codes", "n_principal", "n_secondary", "n_external", "n_groups"])
    return metrics.at_least_quantile(full, ["visit_year", "visit_quarter"], "n_codes", 0.9, positive=True)


def annual_summary(visits: DataFrame, occurrences: DataFrame, codes: DataFrame) -> DataFrame:
    """Visits of each year by principal category: number, share of the year, high-count visits, mean codes and charges."""
    t = visit_table(visits, occurrences, codes)
    out = t.groupBy("visit_year", "principal_category").agg(F.count("*").alias("visits"), F.count_if("high_flag").alias("high_visits"), F.avg("n_codes").alias("mean_codes"), F.sum("total").alias("charges"))
    years = out.groupBy("visit_year").agg(F.sum("visits").alias("_y"))
    return out.join(years, "visit_year").withColumn("share", F.col("visits") / F.col("_y")).drop("_y")
