"""Star schema: period dimension, partition status and measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def period_dimension(spark: SparkSession, first: int, last: int, without: Sequence[int] = ()) -> DataFrame:
    """period_key, year, quarter, label, and the code system of each quarter."""
    from wardline.functions.decode import code_systems
    from wardline.sources.manifest import expected_periods

    p = expected_periods(spark, first, last, without)
    y, q = F.col("visit_year"), F.col("visit_quarter")
    return p.select((y * 10 + q).alias("period_key"), "visit_year", "visit_quarter", F.concat(y.cast("string"), F.lit(" Q"), q.cast("string")).alias("label"), code_systems(y, q)[0].alias("code_system"))


def partition_status(periods: DataFrame, manifest: DataFrame) -> DataFrame:
    """A row for each period: built, failed or missing, with its rows."""
    m = manifest.select("visit_year", "visit_quarter", "rows", "passed")
    status = F.when(F.col("passed").isNull(), "missing").when(F.col("passed"), "built").otherwise("failed")
    return periods.join(m, ["visit_year", "visit_quarter"], "left").select("period_key", status.alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"))


def ratio(a: Column, b: Column) -> Column:
    """Null where the divisor is zero or null."""
    return F.try_divide(a, b)


def measures(fact: DataFrame, by: Sequence[str], visits: str, amount: str, flags: dict[str, Column], distinct: dict[str, str], latest: tuple[str, str] | None = None) -> DataFrame:
    """Sums, filtered counts and their ratios, distinct counts, and the value at the largest key."""
    aggs = [F.sum(visits).alias("visits"), F.sum(amount).alias("amount"), ratio(F.sum(amount), F.sum(visits)).alias("amount_per_visit")]
    for name, c in flags.items():
        aggs += [F.sum(F.when(c, F.col(visits)).otherwise(0)).alias(name), ratio(F.sum(F.when(c, F.col(visits)).otherwise(0)), F.sum(visits)).alias(f"{name}_rate")]
    aggs += [F.count_distinct(c).alias(name) for name, c in distinct.items()]
    if latest:
        value, key = latest
        aggs.append(F.max_by(value, F.struct(key, value)).alias(f"latest_{value}"))
    return fact.groupBy(*by).agg(*aggs) if by else fact.agg(*aggs)


# ---- the dashboard's measures ----

#: Fixed values. The largest value of a key: measure -> (table, key).
KEYED = {
    "Total Validated Encounters": ("coverage", "M001"),
    "Completed Quarterly Partitions": ("coverage", "M002"),
    "Standardized Encounter Fields": ("coverage", "M004"),
    "Schema Families": ("coverage", "M005"),
    "Expected In-Scope Quarters": ("coverage", "M014"),
    "Primary Cohort Rows": ("coverage", "M008"),
    "Historical Cohort Rows": ("coverage", "M010"),
    "Provider Master V2 NPIs": ("providers", "PM001"),
    "ED-Observed NPIs": ("providers", "PM002"),
    "Newly Added ED-Observed NPIs": ("providers", "PM004"),
    "ED-Observed MD/DO NPIs": ("providers", "PM007"),
    "Organizational NPIs Classified as Physicians": ("providers", "PM010"),
    "Facility Dimension Rows": ("coverage", "M006"),
}
#: Rows that pass a condition: measure -> (table, condition).
COUNTED = {
    "Reconciled Available Quarters": ("partitions", "available = 1 AND reconciliation = 'PASS'"),
    "Available Quarters": ("partitions", "available = 1"),
    "Excluded Quarter Count": ("partitions", "status = 'EXCLUDED'"),
    "Enhancement Count": ("enhancements", "TRUE"),
    "Implemented Enhancements": ("enhancements", "status IN ('IMPLEMENTED', 'IMPLEMENTED_PRIMARY_ONLY')"),
    "Proxy-Only Enhancements": ("enhancements", "status = 'PROXY_ONLY'"),
    "Structurally Unavailable Measures": ("enhancements", "status = 'STRUCTURALLY_UNAVAILABLE'"),
    "Validation Controls": ("validations", "TRUE"),
    "Passed Validation Controls": ("validations", "status = 'PASS'"),
    "Controls Not Paused": ("validations", "status <> 'PAUSED_VERIFIED'"),
    "Completed Components": ("components", "status = 'COMPLETE'"),
    "Pending Components": ("components", "status = 'PENDING'"),
    "Deferred Components": ("components", "status = 'DEFERRED'"),
}
#: Sums of a metric of a section: measure -> (table, section, metric).
SUMMED = {
    "Synthetic Input Rows": ("demonstration", "Schema reconciliation", "Input rows"),
    "Synthetic Output Rows": ("demonstration", "Schema reconciliation", "Output rows"),
}
RATIOS = {
    "Phase 1 Completion %": ("Completed Quarterly Partitions", "Expected In-Scope Quarters"),
    "Partition Reconciliation %": ("Reconciled Available Quarters", "Available Quarters"),
    "Provider Coverage Gain %": ("Newly Added ED-Observed NPIs", "ED-Observed NPIs"),
    "Validation Pass %": ("Passed Validation Controls", "Controls Not Paused"),
}
#: Divisors that are no measures of their own.
HELPERS = ("Available Quarters", "Controls Not Paused")
STATUS_ORDER = ("FAILED", "PENDING", "DEFERRED", "COMPLETE")


def dashboard(tables: dict[str, DataFrame], periods: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """measure, value, label: all measures, by one aggregate of each table.

    tables: coverage and providers (key, value), partitions (available, reconciliation, status), enhancements, validations and
    components (status), demonstration (section, metric, value). periods: year, available. years: those selected, none for all. The
    last two measures are labels: of the selected years, and of the least finished component. A ratio whose divisor is missing or
    zero is null.
    """
    parts = []
    for name, table in tables.items():
        own = {m: F.max(F.when(F.col("key") == k, F.col("value"))) for m, (t, k) in KEYED.items() if t == name}
        own |= {m: F.count_if(F.coalesce(F.expr(c), F.lit(False))) for m, (t, c) in COUNTED.items() if t == name}
        own |= {m: F.sum(F.when((F.col("section") == s) & (F.col("metric") == k), F.col("value"))) for m, (t, s, k) in SUMMED.items() if t == name}
        parts.append(table.agg(*[c.cast("double").alias(m) for m, c in own.items()]))
    selected = periods.filter(F.col("year").isin(*years)) if years else periods
    span = F.when(F.min("year") == F.max("year"), F.min("year").cast("string")).otherwise(F.concat(F.min("year").cast("string"), F.lit("-"), F.max("year").cast("string")))
    parts.append(selected.agg(F.count_distinct(F.when(F.col("available") == 1, F.col("year"))).cast("double").alias("Covered Years"), (span if years else F.lit("All project periods")).alias("Selected Period Label")))
    worst = F.coalesce(*[F.when(F.count_if(F.col("status") == s) > 0, s) for s in STATUS_ORDER], F.lit("EMPTY"))
    parts.append(tables["components"].agg(worst.alias("Dashboard Overall Status")))
    row = parts[0]
    for p in parts[1:]:
        row = row.join(p)  # one row each
    row = row.withColumns({m: ratio(F.col(f"`{a}`"), F.col(f"`{b}`")) for m, (a, b) in RATIOS.items()})
    labels = ("Selected Period Label", "Dashboard Overall Status")
    numbers = [c for c in row.columns if c not in HELPERS + labels]
    items = [F.struct(F.lit(m).alias("measure"), F.col(f"`{m}`").alias("value"), F.lit(None).cast("string").alias("label")) for m in numbers]
    items += [F.struct(F.lit(m).alias("measure"), F.lit(None).cast("double").alias("value"), F.col(f"`{m}`").alias("label")) for m in labels]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*")
