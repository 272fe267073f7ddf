"""Aggregates by visit, provider, facility and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.functions import decode

from . import reshape
from .quantiles import beside, exact_quantiles
from .tables import stored, written

__all__ = ["stored", "written"]


def default_category(df: DataFrame, code: str, category: str, is_default: str, sequence: str) -> DataFrame:
    """The flagged category of each code, else its first by sequence; and the number of categories."""
    return df.groupBy(code).agg(
        F.coalesce(F.max(F.when(F.col(is_default), F.col(category))), F.min_by(category, F.struct(sequence, category))).alias("default_category"),
        F.count_distinct(category).alias("n_categories"),
    )


def visit_metrics(occurrences: DataFrame, key: str, role: str, roles: Sequence[str], group: str, principal: str, fields: dict[str, str]) -> DataFrame:
    """Counts by role, distinct groups, and fields of the principal occurrence of each visit."""
    return occurrences.groupBy(key).agg(
        F.count("*").alias("n_codes"),
        *[F.count_if(F.col(role) == r).alias(f"n_{str(r).lower()}") for r in roles],
        F.count_distinct(group).alias("n_groups"),
        *[F.max(F.when(F.col(role) == principal, F.col(c))).alias(out) for out, c in fields.items()],
        F.bool_or(F.col(group).isNotNull()).alias("any_mapped"),
    )


def condition_hits(hits: DataFrame, key: str, condition: str, lists: dict[str, str], sep: str = "|") -> DataFrame:
    """For each visit and condition, the distinct values of columns, ordered and joined."""
    return hits.groupBy(key, condition).agg(F.count("*").alias("n_hits"), *[F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), sep).alias(out) for out, c in lists.items()])


def condition_count(hits: DataFrame, key: str, condition: str) -> DataFrame:
    """Distinct known conditions of each visit; visits without hits have no row."""
    return hits.groupBy(key).agg(F.count_distinct(condition).alias("n_conditions"))


def procedure_metrics(procedures: DataFrame, key: str, code: str, system: str, role: str, group: str) -> DataFrame:
    """Counts by system, distinct known groups, the highest evaluation level (null without one) and flags of special codes, by visit."""
    c, em = F.col(code), F.col(role) == "evaluation_management"

    def any_of(codes: Sequence[str]) -> Column:
        return F.coalesce(F.bool_or(em & c.isin(*codes)), F.lit(False))

    return procedures.groupBy(key).agg(
        F.count_if(F.col(system) == "CPT_HCPCS").alias("n_cpt"),
        F.count_if(em).alias("n_em"),
        F.count_if(F.col(system).isin("ICD-9-CM", "ICD-10-PCS")).alias("n_icd"),
        F.count_distinct(group).alias("n_groups"),
        F.max(decode.em_level(c)).alias("em_level"),
        any_of(decode.CRITICAL_CARE).alias("critical_care"),
        any_of(decode.SPECIAL_EMERGENCY).alias("special_emergency"),
        any_of(decode.EM_SENTINEL).alias("sentinel"),
    )


def completed(visits: DataFrame, metrics: DataFrame, key: str, zeros: Sequence[str]) -> DataFrame:
    """Every visit, with zero where it has no occurrences."""
    return visits.join(metrics, key, "left").fillna(0, list(zeros))


def at_least_quantile(df: DataFrame, by: Sequence[str], value: str, q: float = 0.9, positive: bool = False, source: DataFrame | None = None) -> DataFrame:
    """threshold (the exact quantile of the value in its partition) and high_flag. A small table of thresholds is joined back.

    source: the partitions and values of the same rows, if they can be had for less than df.
    """
    high = F.col(value) >= F.col("threshold")
    return beside(df, exact_quantiles(df if source is None else source, by, value, {"threshold": q}), by).withColumn("high_flag", (F.col(value) > 0) & high if positive else high)


def winsor_limits(df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact quantiles of each partition's known values; a partition without any has nulls."""
    return exact_quantiles(df, by, value, quantiles)


def collapse(df: DataFrame, key: str, modes: Sequence[str] = (), lists: Sequence[str] = (), counts: Sequence[str] = (), latest: dict[str, str] | None = None, flags: dict[str, Column] | None = None, sep: str = " | ") -> DataFrame:
    """One row for each key: most frequent values (ties to the smallest), distinct lists and counts, latest known values {column: date}, any-flags."""
    return df.groupBy(key).agg(
        F.count("*").alias("n_records"),
        *[F.mode(c, True).alias(f"{c}_mode") for c in modes],
        *[F.nullif(F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), sep), F.lit("")).alias(f"{c}_list") for c in lists],
        *[F.count_distinct(c).alias(f"{c}_count") for c in counts],
        *[F.max_by(c, F.struct(F.when(F.col(c).isNotNull(), F.col(by)).alias("d"), F.when(F.col(c).isNotNull(), F.col(c)).alias("v"))).alias(f"{c}_latest") for c, by in (latest or {}).items()],
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(name) for name, c in (flags or {}).items()],
    )


def history(df: DataFrame, by: Sequence[str], charge: str, provider: str, flags: dict[str, Column]) -> DataFrame:
    """Visits, distinct providers, shares of known flags, and mean, median, p90 and sum of charges."""
    out = df.groupBy(*by).agg(
        F.count("*").alias("visits"),
        F.count_distinct(provider).alias("providers"),
        *[F.avg(c.cast("double")).alias(f"{name}_share") for name, c in flags.items()],
        F.avg(charge).alias("charge_mean"),
        F.sum(charge).alias("charge_sum"),
    )
    return beside(out, exact_quantiles(df, by, charge, {"charge_median": 0.5, "charge_p90": 0.9}), by)


def span(df: DataFrame, by: Sequence[str], year: str, quarter: str, names: str | None = None) -> DataFrame:
    """First and last period, number of years, and the distinct names of each key."""
    period = F.struct(year, quarter)
    lists = [F.array_join(F.array_sort(F.collect_set(names)), " | ").alias("names")] if names else []
    first, last = F.min(period).alias("_f"), F.max(period).alias("_l")
    out = df.groupBy(*by).agg(first, last, F.count_distinct(year).alias("n_years"), *lists)
    return out.select(*by, F.col(f"_f.{year}").alias("first_year"), F.col(f"_f.{quarter}").alias("first_quarter"), F.col(f"_l.{year}").alias("last_year"), F.col(f"_l.{quarter}").alias("last_quarter"), "n_years", *(["names"] if names else []))


def top_k(df: DataFrame, by: Sequence[str], category: str, k: int) -> DataFrame:
    """The k most frequent categories of each group, ties by name, with counts, shares of the group and ranks."""
    counts = df.filter(F.col(category).isNotNull()).groupBy(*by, category).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_t"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), category))).filter(F.col("rank") <= k)
    return ranked.join(totals, list(by)).select(*by, category, "n", (F.col("n") / F.col("_t")).alias("share"), "rank")


def top_k_wide(df: DataFrame, by: Sequence[str], category: str, k: int = 3) -> DataFrame:
    top = top_k(df, by, category, k)
    return top.groupBy(*by).agg(*[F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"top{r}_{out}") for r in range(1, k + 1) for out, c in (("category", category), ("share", "share"))])


def shares(df: DataFrame, by: Sequence[str], category: str) -> DataFrame:
    """Counts and shares within each group; without groups, of all rows (a scalar join, no window over everything)."""
    counts = df.groupBy(*by, category).agg(F.count("*").alias("n"))
    if by:
        return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    return counts.crossJoin(counts.agg(F.sum("n").alias("_t"))).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def missingness(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows, missing ones and their share by group and variable, in one scan."""
    long_ = reshape.melt(df, by, columns, kind="string")
    return long_.groupBy(*by, "variable").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("missing")).withColumn("missing_share", F.col("missing") / F.col("n"))


def availability(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows, known ones and their share, distinct values, and the least and most of them as text, by group and variable, in one scan."""
    long_ = reshape.melt(df, by, columns, kind="string")
    value = F.col("value")
    return long_.groupBy(*by, "variable").agg(F.count("*").alias("rows"), F.count(value).alias("present"), (F.count(value) / F.count("*")).alias("present_share"), F.count_distinct(value).alias("n_values"), F.min(value).alias("least"), F.max(value).alias("most"))


def ordered(df: DataFrame, order: Sequence[Column], place: str = "place") -> DataFrame:
    """A small result table with each row's place in a stated order, from 1. The order should be of no ties."""
    return df.withColumn(place, F.row_number().over(Window.orderBy(*order)))


def coverage(df: DataFrame, by: Sequence[str], mapped: Column) -> DataFrame:
    """How many rows have a mapping."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(mapped).alias("mapped")).withColumn("coverage", F.col("mapped") / F.col("n"))


def attribute_coverage(df: DataFrame, key: str, conditions: dict[str, Column]) -> DataFrame:
    """One row: rows, distinct keys, and for each condition {name: condition} the share of the rows for which it is known that meet it."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("distinct_keys"), *[F.avg(c.cast("int")).alias(n) for n, c in conditions.items()])


def mapping_coverage(df: DataFrame, by: Sequence[str], code: str, mapped: dict[str, Column]) -> DataFrame:
    """Occurrences and distinct codes by group, and for each mapping {name: condition} the share of occurrences and the distinct codes
    that lack it. A code counts as mapped where all its occurrences in the group are."""
    codes = df.groupBy(*by, code).agg(F.count("*").alias("_n"), *[F.count_if(c).alias(f"_m{k}") for k, c in enumerate(mapped.values())])
    aggs = [F.sum("_n").alias("occurrences"), F.count(code).alias("distinct_codes")]
    for k, n in enumerate(mapped):
        aggs += [(F.sum(f"_m{k}") / F.sum("_n")).alias(f"{n}_share"), F.count_if((F.col(f"_m{k}") < F.col("_n")) & F.col(code).isNotNull()).alias(f"{n}_lacking")]
    return codes.groupBy(*by).agg(*aggs)


def linkage_by_role(df: DataFrame, by: Sequence[str], role: str, method: str, unit: str) -> DataFrame:
    """Records, distinct units and the share of the role's records, by group, role and method of linkage."""
    out = df.groupBy(*by, role, method).agg(F.count("*").alias("records"), F.count_distinct(unit).alias("units"))
    return out.withColumn("role_share", F.col("records") / F.sum("records").over(Window.partitionBy(*by, role)))


def unmapped_codes(df: DataFrame, by: Sequence[str], code: str, mapped: Column, k: int = 100) -> DataFrame:
    """The k most frequent codes without a mapping by group."""
    return top_k(df.filter(~F.coalesce(mapped, F.lit(False))), by, code, k)


def many_to_many(df: DataFrame, a: str, b: str) -> DataFrame:
    """Values of a that stand with several values of b."""
    return df.groupBy(a).agg(F.count_distinct(b).alias("n_other")).filter("n_other > 1")


def role_counts(df: DataFrame, period: Sequence[str], facility: str, roles: dict[str, str]) -> DataFrame:
    """provider, period, facility, role, visits from one column for each role."""
    long_ = reshape.unpivot_slots(df, [*period, facility], [(c, r, 0) for r, c in roles.items()], value="provider")
    return long_.groupBy("provider", *period, facility, "role").agg(F.count("*").alias("visits"))


def lifetime(counts: DataFrame, roles: Sequence[str], year: str, facility: str) -> DataFrame:
    """Visits by role, first and last year, distinct years and facilities of each provider, from role_counts."""
    return counts.groupBy("provider").agg(
        F.sum("visits").alias("visits"),
        *[F.sum(F.when(F.col("role") == r, F.col("visits")).otherwise(0)).alias(f"visits_{str(r).lower()}") for r in roles],
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.count_distinct(year).alias("n_years"),
        F.count_distinct(facility).alias("n_facilities"),
    )


def primary_unit(counts: DataFrame, by: Sequence[str], unit: str, n: str) -> DataFrame:
    """The unit with most of n in each group, ties to the smallest, with its share."""
    sums = counts.groupBy(*by, unit).agg(F.sum(n).alias("top"))
    w = Window.partitionBy(*by)
    ranked = sums.withColumn("total", F.sum("top").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.desc("top"), unit)))
    return ranked.filter("_rn = 1").select(*by, F.col(unit).alias(f"primary_{unit}"), "top", "total", (F.col("top") / F.col("total")).alias("primary_share"))


def volumes(df: DataFrame, provider: str, facility: str, year: str, quarter: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Provider-quarter and facility-quarter volumes; provider-year volumes are sums of the quarters'."""
    pq = df.filter(F.col(provider).isNotNull()).groupBy(provider, year, quarter).agg(F.count("*").alias("volume"))
    return pq, pq.groupBy(provider, year).agg(F.sum("volume").alias("volume")), df.groupBy(facility, year, quarter).agg(F.count("*").alias("volume"))


def any_listed(occurrences: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """0/1 for each flag: whether any of the visit's occurrences meets it; a null condition doesn't."""
    return occurrences.groupBy(key).agg(*[F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in flags.items()])


#: Rows of one key that are numbered in one task, at most.
NUMBERED_ROWS = 1_000_000


def duplicates(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Number of rows with this key and this row's number among them, in a stated order; null keys count together.

    Keys with more than NUMBERED_ROWS rows, such as null where many ids are missing, are numbered by ranges of the order: within each
    range first, then with the ranges before it added. Whether there are such keys is looked up at once.
    """
    w = Window.partitionBy(key)
    hot = df.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n")).filter(F.col("_n") > NUMBERED_ROWS)
    n = hot.count()  # no more than rows / NUMBERED_ROWS
    if not n:
        return df.withColumn("dup_count", F.count("*").over(w)).withColumn("dup_seq", F.row_number().over(w.orderBy(*order)))
    marked = df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left")
    rest = marked.filter("_n is null").drop("_hot", "_n")
    rest = rest.withColumn("dup_count", F.count("*").over(w)).withColumn("dup_seq", F.row_number().over(w.orderBy(*order)))
    # stored, so that ranges are the same whenever a task is run again
    ranges = stored(marked.filter("_n is not null").drop("_hot").repartitionByRange(key, *order).withColumn("_p", F.spark_partition_id()))
    inner = Window.partitionBy(key, "_p")
    sizes = ranges.groupBy(F.col(key).alias("_hot"), F.col("_p").alias("_q")).agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy("_hot").orderBy("_q")) - F.col("_size")).drop("_size")
    numbered = ranges.withColumn("_r", F.row_number().over(inner.orderBy(*order))).join(before, F.col(key).eqNullSafe(F.col("_hot")) & (F.col("_p") == F.col("_q")))
    numbered = numbered.select(*df.columns, F.col("_n").alias("dup_count"), (F.col("_before") + F.col("_r")).cast("int").alias("dup_seq"))
    return rest.unionByName(numbered)


def visit_key(year: Column, quarter: Column, record: Column, seq: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("Q"), quarter.cast("string"), F.lit("|"), F.coalesce(record.cast("string"), F.lit("MISSING")), F.lit("|"), seq.cast("string"))


def cpi_factors(monthly: DataFrame, value: str, reference_year: int) -> DataFrame:
    """Quarterly means, and the mean of the reference year's quarters over each."""
    q = monthly.groupBy("year", "quarter").agg(F.avg(value).alias("index"))
    ref = q.filter(F.col("year") == reference_year).agg(F.avg("index").alias("_r"))
    return q.crossJoin(ref).select("year", "quarter", "index", (F.col("_r") / F.col("index")).alias("factor"))


def feasibility(df: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float] = (0.5, 0.95, 0.99, 0.995), accuracy: int = 10_000) -> DataFrame:
    """Counts, negative ones and approximate quantiles by group."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.count_if(F.col(value) < 0).alias("negative"), *[F.percentile_approx(value, q, accuracy).alias(f"p{str(100 * q).replace('.0', '').replace('.', '_')}") for q in quantiles])


def funnel(df: DataFrame, by: Sequence[str], steps: dict[str, Column], distinct: dict[str, str]) -> DataFrame:
    """Rows that pass each step, and distinct values of columns among the rows that pass the last one."""
    last = list(steps.values())[-1]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in steps.items()], *[F.count_distinct(F.when(last, F.col(c))).alias(out) for out, c in distinct.items()])


def exposure_overlap(df: DataFrame, unit: str, group: str, a: str, b: str) -> DataFrame:
    """Units that see both groups, and the share of visits that are theirs."""
    u = df.filter(F.col(unit).isNotNull()).groupBy(unit).agg(F.count_if(F.col(group) == a).alias("_a"), F.count_if(F.col(group) == b).alias("_b"), F.count("*").alias("_n"))
    both = (F.col("_a") > 0) & (F.col("_b") > 0)
    return u.agg(F.count("*").alias("units"), F.count_if(both).alias("units_both"), F.sum(F.when(both, F.col("_n")).otherwise(0)).alias("visits_both"), F.sum("_n").alias("visits")).withColumn("visit_share", F.col("visits_both") / F.col("visits"))


def medians(df: DataFrame, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """Exact medians for imputation."""
    long_ = reshape.melt(df if where is None else df.filter(where), [], columns)
    found = exact_quantiles(long_, ["variable"], "value", {"median": 0.5})
    return found.agg(*[F.max(F.when(F.col("variable") == c, F.col("median"))).alias(c) for c in columns])
