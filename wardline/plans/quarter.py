"""From raw extracts to the fact table and its bridges: keys, diagnoses, categories, comorbidities, procedures, practitioners, charges.

Frames may hold any number of quarters: year and quarter are columns, code systems follow from them, and nothing loops over
periods. A slot or a field that a layout lacks is a typed null.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import clean, decode
from wardline.operators import link, metrics, reshape
from wardline.operators.tables import written

#: Columns of the raw layout by group.
TEXTS = {
    "source_record_id": "SYS_RECID", "type_of_service_raw": "TYPE_SERV", "program_raw": "PRO_CODE", "facility": "FACLNBR", "facility_name_raw": "FAC_NAME", "county_name_raw": "FAC_COUNTY_NAME", "location_raw": "SERV_LOC",
    "origin_raw": "ETHNICITY", "race_raw": "RACE", "sex_raw": "SEX", "zip_raw": "ZIPCODE", "weekday_raw": "WEEKDAY", "admission_raw": "ADMSRC", "arrival_raw": "HR_ARRIVAL", "discharge_raw": "EDHR_DISCH", "status_raw": "PT_STATUS", "payer_raw": "PAYER",
}
DIAGNOSES = ["PRINDIAG", *[f"OTHDIAG{k}" for k in range(1, 10)], *[f"{p}{k}" for p in ("ECODE", "ECMORB") for k in (1, 2, 3)], "REASON_CDE"]
SERVICES = ["PRINCPT", *[f"EVALCODE{k}" for k in range(1, 6)], *[f"OTHCPT{k}" for k in range(1, 31)]]
PROCEDURES = ["PRINPROC", *[f"OTHPROC{k}" for k in range(1, 5)]]
CHARGES = [f"{k}CHGS" for k in ("PHARM", "MED", "LAB", "RAD", "CARDIO", "OPRM", "ANES", "RECOV", "ER", "TRAUMA", "OBSER", "GASTRO", "LITHO", "OTH")]
PRACTITIONERS = {"attending": ("ATTENPHYID", "ATTEN_PHYID", "ATTEN_PHYNPI"), "operating": ("OPERPHYID", "OPER_PHYID", "OPER_PHYNPI"), "other": ("OTHERPHYID", "OTHOPER_PHYID", "OTHOPER_PHYNPI")}
EMERGENCY = "2"


def _slot(column: str) -> tuple[str, int]:
    """Role and position of a raw slot, by its name."""
    number = int(re.sub(r"\D", "", column) or 0)
    for start, role in (("PRINDIAG", "principal"), ("OTHDIAG", "secondary"), ("ECODE", "external_cause"), ("ECMORB", "external_cause"), ("REASON", "reason_for_visit"), ("PRINCPT", "principal_service"), ("EVALCODE", "evaluation_management"), ("OTHCPT", "other_service"), ("PRINPROC", "principal_icd_procedure"), ("OTHPROC", "other_icd_procedure")):
        if column.startswith(start):
            return role, number
    raise ValueError(column)


def service_rows(raw: DataFrame, service: str = EMERGENCY) -> DataFrame:
    """Rows of one type of service; a null type is none."""
    return raw.filter(F.trim("TYPE_SERV") == service)


def core(raw: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Emergency rows with keys, duplicate numbers (in a stated order), code systems and cleaned texts and numbers.

    raw: strings, with visit_year and visit_quarter. Repeated ids are numbered; null ids count together as MISSING.
    """
    have = set(raw.columns)
    rows = service_rows(raw)
    keep = [c for c in (*DIAGNOSES, *SERVICES, *PROCEDURES) if c in have]
    numbers = {c.lower(): clean.number(F.col(c)) if c in have else F.lit(None).cast("double") for c in (*CHARGES, "TCHGS")}
    people = {f"{role}_licence": F.coalesce(clean.text_or_null(rows, modern), clean.text_or_null(rows, legacy)) for role, (legacy, modern, _) in PRACTITIONERS.items()} | {f"{role}_npi": clean.text_or_null(rows, npi) for role, (_, _, npi) in PRACTITIONERS.items()}
    rows = rows.withColumns({"_order": F.struct(*order)}).select(
        F.col("visit_year").cast("int").alias("visit_year"), F.col("visit_quarter").cast("int").alias("visit_quarter"), "_order", *[clean.text_or_null(rows, c).alias(out) for out, c in TEXTS.items()],
        clean.number(F.col("AGE")).alias("age"), clean.number(F.col("LOSDAYS")).alias("los_days"), *[clean.text(F.col(c)).alias(c) for c in keep], *[c.alias(n) for n, c in (numbers | people).items()],
    )
    y, q = F.col("visit_year"), F.col("visit_quarter")
    rows = metrics.duplicates(rows.withColumn("_key", F.struct(y, q, "source_record_id")), "_key", [F.col("_order")]).drop("_key", "_order")
    diagnosis, procedure = decode.code_systems(y, q)
    period = F.concat(y.cast("string"), F.lit("Q"), q.cast("string"))
    return rows.select(
        metrics.visit_key(y, q, F.col("source_record_id"), F.col("dup_seq")).alias("visit_key"), F.concat(period, F.lit("|"), F.coalesce("source_record_id", F.lit("MISSING"))).alias("source_encounter_key"),
        (F.col("dup_count") > 1).alias("duplicate_flag"), diagnosis.alias("diagnosis_system"), procedure.alias("procedure_system"), "*",
    )


KEYS = ["visit_key", "visit_year", "visit_quarter"]


def occurrences(rows: DataFrame, columns: Sequence[str], system: Column) -> DataFrame:
    """One row for each filled slot: keys, system, role, source_field, position, raw and the normalised code."""
    have = [c for c in columns if c in rows.columns]
    out = reshape.unpivot_slots(rows.withColumn("system", system), [*KEYS, "system"], [(c, *_slot(c)) for c in have])
    return out.withColumn("code", clean.code(F.col("raw")))


def diagnoses(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Diagnosis occurrences with description and default category of their system's table (system, key, description, category, mappings)."""
    found = link.lookup(occurrences(rows, DIAGNOSES, F.col("diagnosis_system")), codes, {"system": "system", "code": "key"}, {"description": "description", "category": "category", "_n": "mappings"})
    return found.withColumn("mapping_count", F.coalesce("_n", F.lit(0)).cast("int")).withColumn("mapped_flag", F.col("_n").isNotNull()).drop("_n")


def diagnosis_categories(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """A row for each diagnosis and each of its categories (system, key, category, sequence)."""
    return link.matches(occurrences(rows, DIAGNOSES, F.col("diagnosis_system")), categories, {"system": "system", "code": "key"}, {"category": "category", "sequence": "sequence"})


def comorbidities(rows: DataFrame, conditions: DataFrame) -> DataFrame:
    """Visit, condition, contributing codes and fields, from secondary diagnoses alone (system, key, condition)."""
    second = occurrences(rows, DIAGNOSES, F.col("diagnosis_system")).filter("role = 'secondary'")
    hits = link.matches(second, conditions, {"system": "system", "code": "key"}, {"condition": "condition"})
    return metrics.condition_hits(hits, "visit_key", "condition", {"codes": "code", "fields": "source_field"})


def procedures(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Service codes and, while they are reported, ICD procedures, with description and group of their system's table."""
    every = occurrences(rows, [*SERVICES, *PROCEDURES], F.col("procedure_system"))
    own = every.withColumn("system", F.when(F.col("source_field").isin(SERVICES), "CPT_HCPCS").otherwise(F.col("system"))).filter("system is not null")
    out = link.lookup(own, codes, {"system": "system", "code": "key"}, {"description": "description", "group": "group", "_k": "key"})
    return out.withColumn("mapped_flag", F.col("_k").isNotNull()).withColumn("group_mapped_flag", F.col("group").isNotNull()).drop("_k")


def practitioners(rows: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """visit_key, role, licence, npi and how the practitioner was identified, for each role with an identifier."""
    long_ = reshape.unpivot_groups(rows, KEYS, {role: {"licence": f"{role}_licence", "npi": f"{role}_npi"} for role in PRACTITIONERS})
    return link.resolve_provider(long_.filter("licence is not null or npi is not null"), crosswalk, "npi", "licence")


def fact(rows: DataFrame, diagnosis: DataFrame, hits: DataFrame, procedure: DataFrame, companion: DataFrame, ruca: DataFrame) -> DataFrame:
    """One row for each visit: decoded person, visit and place, charges, and metrics of its diagnoses, comorbidities and procedures.

    companion: facility, visit_year, visit_quarter, facility_name, county; ruca: zip5, primaryruca. A visit without occurrences has
    counts of zero. Procedure counts reach the quarter's 90th percentile or not; only counts above zero can. rows are read several
    times. Procedure metrics are written: the percentile needs no other columns.
    """
    c, y = F.col, F.col("visit_year")
    own = diagnosis.withColumn("_group", F.when(c("role").isin("principal", "secondary"), c("category")))
    dx = metrics.visit_metrics(own, "visit_key", "role", ["secondary", "external_cause"], "_group", "principal", {"principal_code": "code", "principal_description": "description", "principal_category": "category"})
    dx = dx.select("visit_key", c("n_codes").alias("diagnosis_count"), c("n_secondary").alias("secondary_count"), c("n_external_cause").alias("external_cause_count"), c("n_groups").alias("distinct_group_count"), "principal_code", "principal_description", "principal_category")
    px = metrics.procedure_metrics(procedure, "visit_key", "code", "system", "role", "group")
    px = written(px.select("visit_key", c("n_cpt").alias("cpt_count"), c("n_em").alias("em_count"), c("n_icd").alias("icd_count"), c("n_groups").alias("procedure_group_count"), (c("n_cpt") - c("n_em") + c("n_icd")).alias("procedure_count"), "em_level", "critical_care"))
    out = link.lookup(rows, companion, {k: k for k in ("facility", "visit_year", "visit_quarter")}, {"companion_name": "facility_name", "companion_county": "county"})
    out = link.lookup(out.withColumn("zip5", clean.zip5(c("zip_raw"))), ruca, {"zip5": "zip5"}, {"ruca": "primaryruca"})
    for part in (dx, metrics.condition_count(hits, "visit_key", "condition"), px):
        out = out.join(part, "visit_key", "left")
    zeros = ["diagnosis_count", "secondary_count", "external_cause_count", "distinct_group_count", "n_conditions", "cpt_count", "em_count", "icd_count", "procedure_group_count", "procedure_count"]
    counts = metrics.completed(rows.select(*KEYS), px.select("visit_key", "procedure_count"), "visit_key", ["procedure_count"])
    out = metrics.at_least_quantile(out.fillna(0, zeros), ["visit_year", "visit_quarter"], "procedure_count", 0.9, positive=True, source=counts)
    off_site, off_site_status = decode.off_site(c("location_raw"), y)
    hours = decode.clock_hours(c("los_days"), clean.number(c("discharge_raw")), decode.arrival_hour(c("arrival_raw")))
    return out.select(
        *KEYS, "source_encounter_key", "duplicate_flag", "diagnosis_system", "procedure_system", "facility", F.coalesce("facility_name_raw", "companion_name").alias("facility_name"),
        F.when(c("facility_name_raw").isNotNull(), "encounter file").when(c("companion_name").isNotNull(), "facility companion").alias("facility_name_source"),
        F.coalesce("county_name_raw", "companion_county").alias("county_name"), decode.program(c("program_raw")).alias("program"), off_site.alias("off_site"), off_site_status.alias("off_site_status"),
        decode.by_period(c("sex_raw"), y, decode.SEX).alias("sex"), decode.by_period(c("race_raw"), y, decode.RACE).alias("race"), decode.ethnicity(c("origin_raw"), c("race_raw"), y).alias("ethnicity"),
        decode.age_years(c("age"), y).alias("age_years"), decode.age_band(c("age"), y).alias("age_band"), *[f.alias(n) for n, f in decode.age_flags(c("age"), y).items()],
        decode.arrival_hour(c("arrival_raw")).alias("arrival_hour"), decode.arrival_band(c("arrival_raw")).alias("arrival_band"), decode.off_hours(c("arrival_raw")).alias("off_hours"), decode.weekend(c("weekday_raw")).alias("weekend"),
        *[h.alias(n) for n, h in hours.items()], "zip5", decode.rurality(c("ruca")).alias("rurality"), decode.by_period(c("admission_raw"), y, decode.ADMISSION, "Unmapped").alias("admission"),
        decode.by_period(c("status_raw"), y, decode.DISPOSITION, "Missing", "Unmapped/legacy").alias("disposition"), *[f.alias(n) for n, f in decode.disposition_flags(c("status_raw")).items()],
        decode.by_period(c("payer_raw"), y, decode.PAYER).alias("payer"), decode.by_period(c("payer_raw"), y, decode.PAYER_GROUP).alias("payer_group"), *zeros[:4], "principal_code", "principal_description", "principal_category",
        "n_conditions", *zeros[5:], c("threshold").alias("procedure_threshold"), c("high_flag").alias("high_procedure_flag"), decode.gated(c("em_level"), y).alias("em_level"), decode.gated(c("critical_care"), y).alias("critical_care"),
        *[v.alias(n) for n, v in decode.charges([c(k.lower()) for k in CHARGES], c("tchgs"), decode.charge_tolerance(y)).items()], *[f"{role}_licence" for role in PRACTITIONERS],
    )
