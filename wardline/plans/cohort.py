"""The analysis cohort: encounters with provider measures, volumes, facility, price factors and flags; and its three tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import decode, labels
from wardline.operators import link, metrics

BLACK, WHITE = "Black or African American", "White"


def with_volumes(df: DataFrame, provider: str = "provider", facility: str = "facility", year: str = "visit_year", quarter: str = "visit_quarter") -> DataFrame:
    """provider_quarter_volume, provider_year_volume, facility_quarter_volume of each row; null providers have none."""
    pq, py, fq = metrics.volumes(df, provider, facility, year, quarter)
    out = df.join(pq.withColumnRenamed("volume", "provider_quarter_volume"), [provider, year, quarter], "left")
    out = out.join(py.withColumnRenamed("volume", "provider_year_volume"), [provider, year], "left")
    return out.join(fq.withColumnRenamed("volume", "facility_quarter_volume"), [facility, year, quarter], "left")


def enrich(visits: DataFrame, providers: DataFrame, flags: DataFrame, facilities: DataFrame, prices: DataFrame, series: Sequence[str], keep_all: bool = False) -> DataFrame:
    """Visits with provider attributes (rows without a provider go, unless keep_all), visit flags, facility, and a factor of each price series.

    providers: provider, ...; flags: visit_id, ...; facilities: facility, ...; prices: year, quarter, series, factor. The number of
    rows never grows: every right side has one row for each key.
    """
    out = visits.join(providers, "provider", "left" if keep_all else "inner").join(flags, "visit_id", "left").join(facilities, "facility", "left")
    wide = prices.groupBy(F.col("year").alias("visit_year"), F.col("quarter").alias("visit_quarter")).agg(*[F.max(F.when(F.col("series") == s, F.col("factor"))).alias(f"factor_{s}") for s in series])
    return out.join(wide, ["visit_year", "visit_quarter"], "left")


def pair_defined(race: Column, ethnicity: Column, physician: Column, last_match: Column, first_match: Column, without_ethnicity: bool = False, first_needed: Column | None = None) -> Column:
    """Both sides are measured as one of the two groups: the patient by code (and not Hispanic, unless race alone counts), the physician by label and matched names."""
    out = race.isin(BLACK, WHITE) & physician.isin("Black", "White") & last_match
    out = out & (first_match if first_needed is None else first_match | ~first_needed)
    if not without_ethnicity:
        out = out & (ethnicity == "Not Hispanic or Latino")
    return F.coalesce(out, F.lit(False))


def race_pair(race: Column, physician: Column, defined: Column) -> Column:
    """physician_patient, lower case."""
    patient = F.when(race == BLACK, "Black").when(race == WHITE, "White")
    return labels.pair_category(physician, patient, ("Black", "White"), defined)


def historical_group(race: Column, year: Column) -> Column:
    """In the years of combined codes, only 3 and 4 name a group without the other origin."""
    return F.when(year <= decode.OLD[1], F.when(race == "3", "Black").when(race == "4", "White"))


def historical_eligibility(method: Column, individual: Column, physician: Column, last: Column, first: Column, p: Column, p2: Column, gender: Column, thresholds: Sequence[float] = labels.THRESHOLDS) -> dict[str, Column]:
    """Stages: linked by licence, an individual, a physician, names matched, then probability thresholds under either prior, and a known gender."""
    linked = method == "unique_licence_crosswalk"
    person = linked & individual & physician
    named = person & last & first
    out = {"linked_by_licence": linked, "individual_physician": person, "names_matched": named, "gender_known": person & gender.isin("Female", "Male")}
    out |= {f"t{round(100 * t)}": named & (p >= t) for t in thresholds} | {f"t{round(100 * t)}_second": named & (p2 >= t) for t in thresholds}
    return {k: F.coalesce(c, F.lit(False)) for k, c in out.items()}


def directional_eligibility(patient: Column, probabilities: dict[str, Column], second: dict[str, Column], gender: Column, sex: Column, thresholds: Sequence[float] = (0.7, 0.9)) -> dict[str, Column]:
    """Flags of the directional samples: soft (probabilities that sum to 1), hard labels at thresholds, the second prior, gender, both together."""
    soft = patient.isNotNull() & labels.sums_to_one(list(probabilities.values()))
    known = gender.isin("Female", "Male") & sex.isin("Female", "Male")
    top = F.greatest(*probabilities.values())
    out = {"soft": soft, "second_prior": patient.isNotNull() & labels.sums_to_one(list(second.values())), "gender": known, "intersectional": soft & known}
    out |= {f"hard_t{round(100 * t)}": soft & (top >= t) for t in thresholds}
    return {k: F.coalesce(c, F.lit(False)) for k, c in out.items()}


def discretion_shares(procedures: DataFrame, mapping: DataFrame, visits: DataFrame) -> DataFrame:
    """Per visit, the number of procedures of each class (mapped by system and group), zero for visits without any."""
    mapped = procedures.join(mapping, ["system", "group"], "left")
    counts = mapped.groupBy("visit_id").agg(F.count("*").alias("n_procedures"), F.count_if(F.col("kind") == "higher_discretion_candidate").alias("n_higher"), F.count_if(F.col("kind") == "lower_discretion_candidate").alias("n_lower"))
    return visits.select("visit_id").join(counts, "visit_id", "left").fillna(0, ["n_procedures", "n_higher", "n_lower"])


def presentation_profile(df: DataFrame, by: Sequence[str], system: str, code: str, year: str, visit: str) -> DataFrame:
    """Visits, share of symptom codes, first and last year and the group of each category."""
    symptom = labels.symptom_group(F.col(system), F.col(code)) == "symptom_sign"
    out = df.groupBy(*by).agg(F.count_distinct(visit).alias("visits"), F.avg(symptom.cast("double")).alias("symptom_share"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    return out.withColumn("presentation_group", labels.presentation_group(F.col("symptom_share")))


def panel(counts: DataFrame, master: DataFrame, roles_year: str = "visit_year") -> DataFrame:
    """provider and year with visits, the primary facility and its share, and the provider's attributes."""
    total = counts.groupBy("provider", roles_year).agg(F.sum("visits").alias("visits"), F.count_distinct("facility").alias("n_facilities"))
    main = metrics.primary_unit(counts, ["provider", roles_year], "facility", "visits").select("provider", roles_year, "primary_facility", "primary_share")
    return total.join(main, ["provider", roles_year], "left").join(master, "provider", "inner")


def sidecar(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on the visit and its partition columns, so that partitions prune; every row must find its one partner."""
    return df.join(side, list(keys))


def definition_counts(df: DataFrame, by: Sequence[str], flags: Sequence[str], eligible: str, died: str) -> DataFrame:
    """Rows of each definition by group, those that are eligible, and deaths among these."""
    from wardline.operators.reshape import melt

    long_ = melt(df, [*by, eligible, died], flags, "definition", "hit", "int").filter("hit = 1")
    return long_.groupBy(*by, "definition").agg(F.count("*").alias("n"), F.count_if(eligible).alias("eligible"), F.count_if(F.col(eligible) & F.col(died)).alias("deaths"))


def agree(df: DataFrame, source: DataFrame, by: Sequence[str], count: str) -> DataFrame:
    """The counts of a table against those of its source, and their difference."""
    a = df.select(*by, F.col(count).alias("built"))
    b = source.select(*by, F.col(count).alias("source"))
    return a.join(b, list(by), "full_outer").fillna(0, ["built", "source"]).withColumn("difference", F.col("built") - F.col("source"))


def licence_candidates(df: DataFrame, registry: DataFrame, licence: str) -> DataFrame:
    """The best match of each row's licence key: active entries first, then physicians, then the order of slots, then the number.

    The order is the registry's own, so that each key's best entry is found before the join, and no row meets the others.
    """
    left, right = df.distinct().withColumn("key", labels.licence_key(F.col(licence))).filter("key is not null"), registry.withColumn("key", labels.licence_key(F.col("registry_licence"))).filter("key is not null")
    return left.join(link.unique_on(right, ["key"], [F.desc("active"), F.desc("physician"), F.col("slot"), F.col("npi")]), ["key"])
