"""Extracts of several layouts to one table, with provider and facility lookups and checks: the small end-to-end job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import clean, decode

FIELDS = ["record", "year", "quarter", "age", "sex", "race", "ethnicity", "diagnosis", "procedure", "provider", "facility", "charge", "los_days", "los_hours", "arrival_hour", "weekday"]
#: Column names of five layouts, in the order of FIELDS; None where a layout has no such column.
LAYOUTS = {
    "schema_1": ["SYS_RECID", "YEAR", "QTR", "AGE", "SEX", "RACE_ETH", None, "DX1", "PR1", "ATTENPHYID", "FACILITY", "TOTCHG", "LOS_DAYS", None, "ARR_HR", "DAY_OF_WEEK"],
    "schema_2": ["SYS_RECID", "VISIT_YEAR", "VISIT_QUARTER", "PAT_AGE", "PAT_SEX", "PAT_RACE", "ETHNICITY", "DIAGNOSIS_1", "PROCEDURE_1", "ATTENDING_NPI", "AHCA_ID", "TOTAL_CHARGE", None, "LOS_HOURS", "ARRIVAL_HOUR", "WEEKDAY"],
    "schema_3": ["RECORD_KEY", "YEAR", "QUARTER", "AGE_YEARS", "RECORDED_SEX", "RECORDED_RACE", "RECORDED_ETHNICITY", "PRINCIPAL_DX", "PRINCIPAL_PROC", "ATTENDING_PROVIDER", "FACILITY_KEY", "REPORTED_CHARGE", None, "CLOCK_LOS_HOURS", "ARRIVAL_CLOCK_HOUR", "DAY_NUMBER"],
    "schema_4": ["ENCOUNTER_ID", "CALENDAR_YEAR", "CALENDAR_QUARTER", "PATIENT_AGE", "PATIENT_SEX", "PATIENT_RACE", "PATIENT_ETHNICITY", "DX_PRIMARY", "PROC_PRIMARY", "PROVIDER_NPI", "FACILITY_ID", "CHARGE_TOTAL", None, "LENGTH_OF_STAY_HOURS", "HOUR_OF_ARRIVAL", "WEEKDAY_NUMBER"],
    "schema_5": ["synthetic_record_id", "visit_year", "visit_quarter", "age_years", "patient_sex", "patient_race", "patient_ethnicity", "principal_diagnosis", "principal_procedure", "attending_provider_id", "facility_id", "total_charge", None, "los_hours", "arrival_hour", "weekday"],
}


def standardize(raw: DataFrame, layout: str) -> DataFrame:
    """FIELDS as cleaned strings, typed nulls for what the layout lacks, and the layout's name."""
    return raw.select(*[(clean.text(F.col(f"`{c}`")) if c else F.lit(None).cast("string")).alias(f) for f, c in zip(FIELDS, LAYOUTS[layout], strict=True)], F.lit(layout).alias("layout"))


def united(frames: dict[str, DataFrame]) -> DataFrame:
    out = None
    for layout, df in frames.items():
        one = standardize(df, layout)
        out = one if out is None else out.unionByName(one)
    return out


def enriched(rows: DataFrame, providers: DataFrame, facilities: DataFrame) -> DataFrame:
    """Resolved provider (a licence in the first layout), facility fields, physician flag, code system, off-hours (7 to 18 are on) and weekend.

    providers: synthetic_provider_id, synthetic_license_id, entity_type, clinician_type; facilities: synthetic_facility_id, rurality. Both are small.
    """
    ids = providers.select(F.col("synthetic_provider_id").alias("_id"), "entity_type", "clinician_type")
    licences = providers.select(F.col("synthetic_license_id").alias("_l"), F.col("synthetic_provider_id").alias("_by_licence"))
    rows = rows.join(licences, (F.col("provider") == F.col("_l")) & (F.col("layout") == "schema_1"), "left")
    rows = rows.withColumn("resolved_provider", F.when(F.col("layout") == "schema_1", F.col("_by_licence")).otherwise(F.col("provider")))
    rows = rows.join(ids, F.col("resolved_provider") == F.col("_id"), "left").join(facilities.select(F.col("synthetic_facility_id").alias("_f"), "rurality"), F.col("facility") == F.col("_f"), "left")
    year, quarter = clean.whole(F.col("year")), clean.whole(F.col("quarter"))
    hours = F.coalesce(clean.number(F.col("los_hours")), clean.number(F.col("los_days")) * 24)
    return rows.select(
        *FIELDS, "layout", "resolved_provider", "entity_type", "rurality", hours.alias("los_hours_any"),
        F.coalesce((F.col("entity_type") == "Individual") & F.col("clinician_type").isin("MD", "DO", "MD/DO physician"), F.lit(False)).alias("physician_flag"),
        decode.code_systems(year, quarter)[0].alias("code_system"), decode.off_hours(F.col("arrival_hour"), 7, 18).alias("off_hours"), decode.weekend(F.col("weekday")).alias("weekend"),
    )


def reconciliation(frames: dict[str, DataFrame], rows: DataFrame) -> DataFrame:
    """layout, source_rows, output_rows, passed."""
    sources = None
    for layout, df in frames.items():
        one = df.agg(F.count("*").alias("source_rows")).select(F.lit(layout).alias("layout"), "source_rows")
        sources = one if sources is None else sources.unionByName(one)
    return sources.join(rows.groupBy("layout").agg(F.count("*").alias("output_rows")), "layout", "left").fillna(0).withColumn("passed", F.col("source_rows") == F.col("output_rows"))


def quality(rows: DataFrame) -> DataFrame:
    """Rows, repeated ids, unresolved providers, organisations marked as physicians, hours out of range."""
    repeated = rows.groupBy("layout", "record").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_ids"))
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(F.col("entity_type").isNull()).alias("unresolved_providers"),
        F.count_if(F.col("physician_flag") & (F.col("entity_type") != "Individual")).alias("organisation_physicians"), F.count_if(F.col("off_hours").isNull()).alias("bad_hours"),
    ).crossJoin(repeated)
