"""Queries of decoding, labels, eligibility and provider attributes; what the SQL expects is written out literally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import clean, decode, labels
from wardline.operators import describe, link, metrics, nameprob, reconcile, reshape
from wardline.plans import cohort
from wardline.plans.frames import ENCOUNTERS_SQL, OCCURRENCES_SQL, encounters, occurrences, table
from wardline.plans.registry import query

ENC, OCC = f"WITH {ENCOUNTERS_SQL}", f"WITH {OCCURRENCES_SQL}"


def made(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def made_sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


PLACE = {
    "visit_id": "visit_id", "visit_year": "visit_year", "status_raw": "status_raw",
    "program_raw": "CASE visit_id % 5 WHEN 0 THEN '14' WHEN 1 THEN '23' WHEN 2 THEN '64' WHEN 3 THEN '99' END",
    "ruca": "CASE WHEN visit_id % 13 = 12 THEN 'x' ELSE CAST(visit_id % 13 AS string) END",
    "graduated": "CASE WHEN visit_id % 11 = 0 THEN NULL ELSE 1920 + visit_id % 110 END",
    "code": "CASE visit_id % 9 WHEN 0 THEN '99281' WHEN 1 THEN 'G0381' WHEN 2 THEN '99283' WHEN 3 THEN 'G0383' WHEN 4 THEN '99285' WHEN 5 THEN '99291' WHEN 6 THEN '99999' WHEN 7 THEN NULL ELSE '12001' END",
}


@query(
    "decode_place",
    f"""{ENC}, d AS (SELECT {made_sql(PLACE)} FROM encounters)
SELECT visit_id, CASE program_raw WHEN '14' THEN 'Ambulatory Surgery Center' WHEN '23' THEN 'Hospital' WHEN '64' THEN 'Cardiac Catheterization Laboratory' ELSE 'Unmapped/other program code' END AS program,
CASE WHEN try_cast(ruca AS double) BETWEEN 1 AND 3 THEN 'Metropolitan' WHEN try_cast(ruca AS double) BETWEEN 4 AND 6 THEN 'Micropolitan' WHEN try_cast(ruca AS double) BETWEEN 7 AND 10 THEN 'Small town/rural' END AS rurality,
CASE WHEN visit_year - graduated BETWEEN 0 AND 80 THEN visit_year - graduated END AS experience, CAST(NULL AS double) AS acuity, 'not in the release' AS acuity_status,
CAST(CASE code WHEN '99281' THEN 1 WHEN 'G0381' THEN 2 WHEN '99283' THEN 3 WHEN 'G0383' THEN 4 WHEN '99285' THEN 5 END AS BIGINT) AS em_level,
CAST(CASE WHEN visit_year >= 2010 THEN CASE code WHEN '99281' THEN 1 WHEN 'G0381' THEN 2 WHEN '99283' THEN 3 WHEN 'G0383' THEN 4 WHEN '99285' THEN 5 END END AS BIGINT) AS em_gated,
status_raw = '01' AS routine_discharge_flag, status_raw IN ('02', '03', '04', '05', '62', '63', '64', '65', '66', '70') AS transfer_flag, status_raw IN ('50', '51') AS hospice_flag, status_raw = '20' AS mortality_flag,
status_raw = '21' AS court_law_enforcement_flag, status_raw = '07' AS left_discontinued_care_flag FROM d""",
)
def _place(spark, sf):
    d, c = made(encounters(spark, sf), PLACE), F.col
    acuity, why = decode.unavailable("double", "not in the release")
    return d.select(
        "visit_id", decode.program(c("program_raw")).alias("program"), decode.rurality(c("ruca")).alias("rurality"), decode.experience(c("visit_year"), c("graduated")).alias("experience"),
        acuity.alias("acuity"), why.alias("acuity_status"), decode.em_level(c("code")).alias("em_level"), decode.gated(decode.em_level(c("code")), c("visit_year")).alias("em_gated"),
        *[flag.alias(n) for n, flag in decode.disposition_flags(c("status_raw")).items()],
    )


@query(
    "decode_person_literal",
    f"""{ENC} SELECT visit_id, CASE WHEN sex_raw IS NULL THEN 'Missing' WHEN visit_year <= 2008 AND sex_raw = '1' OR visit_year >= 2010 AND sex_raw = 'M' THEN 'Male' WHEN visit_year <= 2008 AND sex_raw = '2' OR visit_year >= 2010 AND sex_raw = 'F' THEN 'Female'
WHEN visit_year <= 2008 AND sex_raw = '3' OR visit_year >= 2010 AND sex_raw = 'U' THEN 'Unknown' ELSE 'Unmapped' END AS sex,
CASE WHEN race_raw IS NULL THEN 'Missing' WHEN visit_year <= 2008 THEN CASE race_raw WHEN '1' THEN 'American Indian or Alaska Native' WHEN '2' THEN 'Asian' WHEN '3' THEN 'Black or African American' WHEN '4' THEN 'White' WHEN '5' THEN 'White' WHEN '6' THEN 'Black or African American'
 WHEN '7' THEN 'Other' WHEN '8' THEN 'No response' ELSE 'Unmapped' END WHEN visit_year >= 2010 THEN CASE race_raw WHEN '1' THEN 'American Indian or Alaska Native' WHEN '2' THEN 'Asian' WHEN '3' THEN 'Black or African American' WHEN '4' THEN 'Native Hawaiian or Other Pacific Islander'
 WHEN '5' THEN 'White' WHEN '6' THEN 'Other' WHEN '7' THEN 'Unknown' ELSE 'Unmapped' END ELSE 'Unmapped' END AS race,
CASE payer_raw WHEN 'A' THEN 'Medicare' WHEN 'B' THEN 'Medicare' WHEN 'C' THEN 'Medicaid' WHEN 'D' THEN 'Medicaid' WHEN 'E' THEN 'Commercial' WHEN 'F' THEN 'Commercial' WHEN 'G' THEN 'Commercial' WHEN 'L' THEN 'Self-pay' WHEN 'H' THEN 'Workers compensation' WHEN 'I' THEN 'Federal government'
 WHEN 'J' THEN 'Federal government' WHEN 'K' THEN 'Other government' WHEN 'O' THEN 'Other government' WHEN 'Q' THEN 'Liability' WHEN 'N' THEN 'Non-payment/charity' WHEN 'P' THEN 'Unknown' WHEN 'M' THEN 'Other' ELSE CASE WHEN payer_raw IS NULL THEN 'Missing' ELSE 'Unmapped' END END AS payer_group FROM encounters""",
)
def _person(spark, sf):
    y = F.col("visit_year")
    return encounters(spark, sf).select(
        "visit_id", decode.by_period(F.col("sex_raw"), y, decode.SEX).alias("sex"), decode.by_period(F.col("race_raw"), y, decode.RACE).alias("race"), decode.by_period(F.col("payer_raw"), y, decode.PAYER_GROUP).alias("payer_group")
    )


DIAGNOSIS = {
    "k": "l_orderkey * 8 + l_linenumber", "system": "CASE WHEN l_partkey % 2 = 0 THEN 'ICD-9-CM' ELSE 'ICD-10-CM' END",
    "code": "CASE l_suppkey % 12 WHEN 0 THEN '41001' WHEN 1 THEN '41010' WHEN 2 THEN '41012' WHEN 3 THEN 'I214' WHEN 4 THEN 'I219' WHEN 5 THEN 'I21A1' WHEN 6 THEN 'I21A9' WHEN 7 THEN 'I220' WHEN 8 THEN '4100' WHEN 9 THEN 'I20' WHEN 10 THEN 'R079' END",
}


@query(
    "infarction_flags",
    f"""WITH d AS (SELECT {made_sql(DIAGNOSIS)} FROM lineitem), f AS (SELECT k, coalesce(system = 'ICD-9-CM' AND code IN ('41001'), FALSE) AS icd9_strict, coalesce(system = 'ICD-9-CM' AND code IN ('41001', '41010'), FALSE) AS icd9_broad,
coalesce(system = 'ICD-10-CM' AND code IN ('I214', 'I219'), FALSE) AS icd10_primary, coalesce(system = 'ICD-10-CM' AND code IN ('I21A1', 'I21A9'), FALSE) AS icd10_type2_other, coalesce(system = 'ICD-10-CM' AND code = 'I220', FALSE) AS icd10_i22 FROM d)
SELECT *, FALSE AS second FROM f""",
)
def _infarction(spark, sf):
    d = made(table(spark, sf, "lineitem"), DIAGNOSIS)
    flags = labels.infarction_flags(F.col("system"), F.col("code"))
    return d.select("k", *[c.alias(n) for n, c in flags.items()], labels.second_infarction(flags).alias("second"))


@query(
    "treatment_classes",
    """WITH d AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'ct scan abdomen' WHEN 1 THEN 'Mechanical ventilation' WHEN 2 THEN 'Laboratory - chemistry' WHEN 3 THEN 'Suture of skin' WHEN 4 THEN 'Other diagnostic radiology, suture of skin' WHEN 5 THEN 'Hemodialysis' WHEN 6 THEN 'diagnostic ultrasound of heart' WHEN 7 THEN 'Nothing of these' END AS label FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 9 IN (0, 2, 4, 6) THEN 'higher_discretion_candidate' WHEN p_partkey % 9 IN (1, 3, 5) THEN 'lower_discretion_candidate' ELSE 'ambiguous_or_unclassified' END AS kind,
CASE WHEN p_partkey % 9 IN (0, 2, 4, 6) THEN 'moderate' WHEN p_partkey % 9 IN (1, 3, 5) THEN 'low_to_moderate' ELSE 'low' END AS confidence, p_partkey % 9 NOT IN (0, 2, 4, 6) AS review FROM d""",
)
def _treatments(spark, sf):
    label = F.expr("CASE p_partkey % 9 WHEN 0 THEN 'ct scan abdomen' WHEN 1 THEN 'Mechanical ventilation' WHEN 2 THEN 'Laboratory - chemistry' WHEN 3 THEN 'Suture of skin' WHEN 4 THEN 'Other diagnostic radiology, suture of skin' WHEN 5 THEN 'Hemodialysis' WHEN 6 THEN 'diagnostic ultrasound of heart' WHEN 7 THEN 'Nothing of these' END")
    kind, confidence, review = labels.discretion(label)
    return table(spark, sf, "part").select("p_partkey", kind.alias("kind"), confidence.alias("confidence"), review.alias("review"))


ELIGIBLE = {
    "visit_id": "visit_id", "method": "CASE WHEN provider % 4 = 0 THEN 'direct_validated_npi' WHEN provider % 4 = 1 THEN NULL ELSE 'unique_licence_crosswalk' END", "individual": "provider % 7 <> 3", "physician": "provider % 5 <> 2",
    "last_match": "provider % 6 <> 0", "first_match": "provider % 9 <> 0", "p": "((provider * 17) % 100) / 100.0", "p2": "((provider * 29) % 100) / 100.0", "gender": "CASE provider % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' END",
    "patient": "CASE visit_id % 6 WHEN 5 THEN NULL ELSE 'g' || CAST(visit_id % 6 AS string) END", "sex": "CASE visit_id % 4 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' WHEN 2 THEN 'Unknown' END",
    "a": "((provider * 17) % 100) / 100.0", "b": "1 - ((provider * 17) % 100) / 100.0", "a2": "((provider * 29) % 100) / 100.0", "b2": "CASE WHEN provider % 8 = 0 THEN 0.5 ELSE 1 - ((provider * 29) % 100) / 100.0 END",
}


def _eligible(spark, sf):
    d = made(encounters(spark, sf), ELIGIBLE)
    return d.withColumns({c: F.col(c).cast("double") for c in ("p", "p2", "a", "b", "a2", "b2")})


@query(
    "historical_eligibility",
    f"""{ENC}, d AS (SELECT {made_sql(ELIGIBLE)} FROM encounters), s AS (SELECT *, coalesce(method = 'unique_licence_crosswalk', FALSE) AS linked FROM d), n AS (SELECT *, linked AND individual AND physician AS person FROM s), m AS (SELECT *, person AND last_match AND first_match AS named FROM n)
SELECT visit_id, linked AS linked_by_licence, person AS individual_physician, named AS names_matched, person AND coalesce(gender IN ('Female', 'Male'), FALSE) AS gender_known, named AND p >= 0.5 AS t50, named AND p >= 0.7 AS t70, named AND p >= 0.8 AS t80, named AND p >= 0.9 AS t90,
named AND p2 >= 0.5 AS t50_second, named AND p2 >= 0.7 AS t70_second, named AND p2 >= 0.8 AS t80_second, named AND p2 >= 0.9 AS t90_second FROM m""",
)
def _historical(spark, sf):
    c = F.col
    flags = cohort.historical_eligibility(c("method"), c("individual"), c("physician"), c("last_match"), c("first_match"), c("p"), c("p2"), c("gender"))
    return _eligible(spark, sf).select("visit_id", *[f.alias(n) for n, f in flags.items()])


@query(
    "directional_eligibility",
    f"""{ENC}, d AS (SELECT {made_sql(ELIGIBLE)} FROM encounters), s AS (SELECT *, patient IS NOT NULL AND abs(a + b - 1) <= 1e-6 AS soft, coalesce(gender IN ('Female', 'Male') AND sex IN ('Female', 'Male'), FALSE) AS known, greatest(a, b) AS top FROM d)
SELECT visit_id, soft, patient IS NOT NULL AND abs(a2 + b2 - 1) <= 1e-6 AS second_prior, known AS gender, soft AND known AS intersectional, soft AND top >= 0.7 AS hard_t70, soft AND top >= 0.9 AS hard_t90, CASE WHEN a >= b THEN 'a' ELSE 'b' END AS label,
abs(a2 + b2 - 1) <= 1e-6 AS sums FROM s""",
)
def _directional(spark, sf):
    c = F.col
    flags = cohort.directional_eligibility(c("patient"), {"a": c("a"), "b": c("b")}, {"a": c("a2"), "b": c("b2")}, c("gender"), c("sex"))
    return _eligible(spark, sf).select("visit_id", *[f.alias(n) for n, f in flags.items()], labels.arg_max_label({"a": c("a"), "b": c("b")}).alias("label"), labels.sums_to_one([c("a2"), c("b2")]).alias("sums"))


PROVIDER = {
    "id": "c_custkey", "entity_raw": "CASE c_custkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '1' WHEN 2 THEN '2' END",
    "taxonomy": "CASE c_custkey % 11 WHEN 0 THEN '207P00000X' WHEN 1 THEN '208D00000X' WHEN 2 THEN '363LF0000X' WHEN 3 THEN '363AM0700X' WHEN 4 THEN '367500000X' WHEN 5 THEN '364SA2200X' WHEN 6 THEN '163W00000X' WHEN 7 THEN '183500000X' WHEN 8 THEN '103T00000X' WHEN 9 THEN '1041C0700X' END",
    "credentials": "CASE c_custkey % 7 WHEN 0 THEN 'M.D.' WHEN 1 THEN 'PA-C' WHEN 2 THEN 'Msn, Arnp' WHEN 3 THEN 'Mdiv' END",
    "slot1": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '207P00000X' END", "slot2": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '2083X0100X' END", "switch1": "CASE c_custkey % 2 WHEN 0 THEN 'N' ELSE 'Y' END", "switch2": "CASE c_custkey % 6 WHEN 0 THEN 'Y' ELSE 'X' END",
    "first_source": "nullif(c_custkey % 3, 0)", "second_source": "nullif(c_custkey % 4, 0)", "third_source": "nullif(c_custkey % 5, 0)",
    "deactivated": "CASE WHEN c_custkey % 3 = 0 THEN 20100101 + c_custkey % 50 END", "reactivated": "CASE WHEN c_custkey % 2 = 0 THEN 20100120 END",
    "male": "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_custkey % 21 END", "female": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 5 END", "licence": "CASE c_custkey % 4 WHEN 0 THEN 'me 00' || CAST(c_custkey AS string) WHEN 1 THEN 'OS' || CAST(1000 + c_custkey AS string) WHEN 2 THEN 'TOOLONG123' END",
}
CREDENTIAL = "coalesce(regexp_matches(upper(credentials), '(^|[^A-Z])({})([^A-Z]|$)'), FALSE)"


@query(
    "provider_attributes",
    f"""WITH d AS (SELECT {made_sql(PROVIDER)} FROM customer), e AS (SELECT *, CASE entity_raw WHEN '1' THEN 'Individual' WHEN '2' THEN 'Organization' ELSE 'Not found' END AS entity, coalesce(taxonomy LIKE '207%' OR taxonomy LIKE '208%', FALSE) OR {CREDENTIAL.format('MD|M[.]D[.]?|DO|D[.]O[.]?')} AS md FROM d)
SELECT id, entity, md, CASE WHEN entity = 'Organization' THEN 'Organization NPI' WHEN entity = 'Not found' THEN 'NPI absent from current individual snapshot' WHEN md THEN 'MD/DO physician' WHEN coalesce(taxonomy LIKE '363L%', FALSE) OR {CREDENTIAL.format('NP|APRN|ARNP|FNP|DNP')} THEN 'Nurse practitioner'
WHEN coalesce(taxonomy LIKE '363A%', FALSE) OR {CREDENTIAL.format('PA|PA-C|PAC')} THEN 'Physician assistant' WHEN taxonomy = '367500000X' THEN 'Certified registered nurse anesthetist' WHEN taxonomy LIKE '364S%' THEN 'Clinical nurse specialist' WHEN taxonomy LIKE '163W%' THEN 'Registered nurse'
WHEN taxonomy LIKE '1835%' THEN 'Pharmacist' WHEN taxonomy LIKE '103T%' THEN 'Psychologist' WHEN taxonomy LIKE '1041%' THEN 'Social worker' ELSE 'Other individual provider' END AS kind,
coalesce(CASE WHEN switch1 = 'Y' THEN slot1 END, CASE WHEN switch2 = 'Y' THEN slot2 END, slot1, slot2) AS primary_taxonomy,
coalesce(first_source, second_source, third_source) AS value, CASE WHEN first_source IS NOT NULL THEN 'first' WHEN second_source IS NOT NULL THEN 'second' WHEN third_source IS NOT NULL THEN 'third' END AS source,
coalesce(first_source <> second_source, FALSE) OR coalesce(first_source <> third_source, FALSE) OR coalesce(second_source <> third_source, FALSE) AS conflict, deactivated IS NULL OR coalesce(reactivated >= deactivated, FALSE) AS active,
CASE WHEN coalesce(male, 0) + coalesce(female, 0) > 0 THEN CASE WHEN coalesce(male, 0) >= 0.9 * (coalesce(male, 0) + coalesce(female, 0)) THEN 'Male' WHEN coalesce(female, 0) >= 0.9 * (coalesce(male, 0) + coalesce(female, 0)) THEN 'Female' END END AS gender,
coalesce(regexp_full_match(regexp_replace(upper(licence), '[^A-Z0-9]', '', 'g'), '[A-Z]{{1,4}}[0-9]{{3,}}'), FALSE) AS licence_valid,
CASE id % 4 WHEN 0 THEN 'ME:' || CAST(id AS string) WHEN 1 THEN 'OS:' || CAST(1000 + id AS string) END AS licence_key FROM e""",
)
def _attributes(spark, sf):
    d, c = made(table(spark, sf, "customer"), PROVIDER), F.col
    value, source = labels.first_of([("first", c("first_source")), ("second", c("second_source")), ("third", c("third_source"))])
    d = d.withColumn("entity", labels.entity_category(c("entity_raw")))
    return d.select(
        "id", "entity", labels.is_physician(c("taxonomy"), c("credentials")).alias("md"), labels.clinician_type(c("entity"), c("taxonomy"), c("credentials")).alias("kind"),
        labels.primary_of_slots([c("slot1"), c("slot2")], [c("switch1"), c("switch2")]).alias("primary_taxonomy"), value.alias("value"), source.alias("source"), labels.conflict(c("first_source"), c("second_source"), c("third_source")).alias("conflict"),
        labels.registry_active(c("deactivated"), c("reactivated")).alias("active"), labels.imputed_gender(c("male"), c("female")).alias("gender"), clean.licence_valid(clean.code(c("licence"))).alias("licence_valid"), labels.licence_key(c("licence")).alias("licence_key"),
    )


@query("facility_headers", "SELECT CAST(n_nationkey AS string) AS facility_id, nullif(trim(n_name), '') AS facility_name, CAST(NULL AS string) AS county FROM nation")
def _headers(spark, sf):
    return clean.renamed_by_alias(table(spark, sf, "nation"), {"facility_id": ["N NATION-KEY"], "facility_name": ["name", "n.name"], "county": ["county", "n_county"]})


@query(
    "county_lookup",
    """WITH d AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'St. Johns County' WHEN 1 THEN 'saint johns' WHEN 2 THEN ' Miami-Dade ' ELSE 'De Soto' END AS county FROM supplier), k(key, fips) AS (VALUES ('SAINTJOHNS', '109'), ('MIAMIDADE', '086'), ('DESOTO', '027'))
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'SAINTJOHNS' WHEN 1 THEN 'SAINTJOHNS' WHEN 2 THEN 'MIAMIDADE' ELSE 'DESOTO' END AS place, fips, s_suppkey * 7 AS zip, CASE WHEN s_suppkey * 7 > 50 THEN 'far' END AS zone FROM d JOIN k ON key = CASE s_suppkey % 4 WHEN 0 THEN 'SAINTJOHNS' WHEN 1 THEN 'SAINTJOHNS' WHEN 2 THEN 'MIAMIDADE' ELSE 'DESOTO' END""",
)
def _county(spark, sf):
    county = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'St. Johns County' WHEN 1 THEN 'saint johns' WHEN 2 THEN ' Miami-Dade ' ELSE 'De Soto' END")
    codes = spark.createDataFrame([("SAINT JOHNS", "109"), ("Miami Dade County", "086"), ("DESOTO", "027")], "name string, fips string").withColumn("key", clean.place_name(F.col("name")))
    zips = table(spark, sf, "supplier").select((F.col("s_suppkey") * 7).alias("z"), F.lit("far").alias("zone")).filter("z > 50")
    d = table(spark, sf, "supplier").select("s_suppkey", clean.place_name(county).alias("place"), (F.col("s_suppkey") * 7).alias("zip"))
    return link.lookup(link.lookup(d, codes, {"place": "key"}, {"fips": "fips"}), zips, {"zip": "z"}, {"zone": "zone"})


@query(
    "facility_companion",
    f"""{ENC}, f AS (SELECT facility, visit_year, visit_quarter, count(*) AS reported FROM encounters WHERE facility % 4 <> 0 GROUP BY 1, 2, 3) SELECT visit_id, n_name AS facility_name, reported FROM encounters e LEFT JOIN nation ON n_nationkey = e.facility LEFT JOIN f ON f.facility = e.facility AND f.visit_year = e.visit_year AND f.visit_quarter = e.visit_quarter""",
)
def _companion(spark, sf):
    e = encounters(spark, sf)
    reported = e.filter("facility % 4 <> 0").groupBy("facility", "visit_year", "visit_quarter").agg(F.count("*").alias("reported"))
    named = link.lookup(e, table(spark, sf, "nation"), {"facility": "n_nationkey"}, {"facility_name": "n_name"})
    return link.lookup(named, reported, {"facility": "facility", "visit_year": "visit_year", "visit_quarter": "visit_quarter"}, {"reported": "reported"}).select("visit_id", "facility_name", "reported")


PROCEDURES = {
    "visit_id": "l_orderkey", "role": "CASE WHEN l_linenumber <= 2 THEN 'evaluation_management' ELSE 'procedure' END", "system": "CASE l_linenumber % 3 WHEN 0 THEN 'ICD-9-CM' WHEN 1 THEN 'CPT_HCPCS' ELSE 'ICD-10-PCS' END",
    "code": "CASE l_partkey % 8 WHEN 0 THEN '99281' WHEN 1 THEN '99283' WHEN 2 THEN 'G0384' WHEN 3 THEN '99291' WHEN 4 THEN '99288' WHEN 5 THEN '99999' ELSE '10' || CAST(l_suppkey % 5 AS string) END",
}
GROUPS = [("ICD-9-CM", "100", "a"), ("ICD-9-CM", "101", "b"), ("CPT_HCPCS", "100", "c"), ("CPT_HCPCS", "102", "a"), ("ICD-10-PCS", "103", "d"), ("CPT_HCPCS", "99291", "critical")]
GROUPS_SQL = ", ".join(map(str, GROUPS))


@query(
    "procedure_metrics",
    f"""WITH p AS (SELECT {made_sql(PROCEDURES)} FROM lineitem), g(s, c, grp) AS (VALUES {GROUPS_SQL}), j AS (SELECT p.*, grp FROM p LEFT JOIN g ON s = system AND c = code)
SELECT visit_id, count(*) FILTER (system = 'CPT_HCPCS') AS n_cpt, count(*) FILTER (role = 'evaluation_management') AS n_em, count(*) FILTER (system IN ('ICD-9-CM', 'ICD-10-PCS')) AS n_icd, count(DISTINCT grp) AS n_groups,
CAST(max(CASE code WHEN '99281' THEN 1 WHEN '99283' THEN 3 WHEN 'G0384' THEN 5 END) AS BIGINT) AS em_level, bool_or(role = 'evaluation_management' AND code = '99291') AS critical_care, bool_or(role = 'evaluation_management' AND code = '99288') AS special_emergency, bool_or(role = 'evaluation_management' AND code = '99999') AS sentinel FROM j GROUP BY 1""",
)
def _procedures(spark, sf):
    groups = spark.createDataFrame(GROUPS, "s string, c string, grp string")
    p = link.lookup(made(table(spark, sf, "lineitem"), PROCEDURES), groups, {"system": "s", "code": "c"}, {"grp": "grp"})
    return metrics.procedure_metrics(p, "visit_id", "code", "system", "role", "grp")


@query(
    "procedure_slots",
    "SELECT o_orderkey, 'principal' AS role, 'slot_a' AS source_field, CAST(0 AS BIGINT) AS position, CAST(nullif(o_orderkey % 5, 0) AS string) AS raw FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 'other', 'slot_b', 1, CAST(o_custkey AS string) FROM orders UNION ALL SELECT o_orderkey, 'other', 'slot_c', 2, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'",
)
def _slots(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "nullif(o_orderkey % 5, 0) AS slot_a", "o_custkey AS slot_b", "nullif(o_orderstatus, 'O') AS slot_c")
    return reshape.unpivot_slots(o, ["o_orderkey"], [("slot_a", "principal", 0), ("slot_b", "other", 1), ("slot_c", "other", 2)])


@query("role_groups", "SELECT o_orderkey, 'attending' AS role, o_custkey AS number, o_orderstatus AS licence FROM orders UNION ALL SELECT o_orderkey, 'operating', CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 3 END, nullif(o_orderpriority, '1-URGENT') FROM orders")
def _role_groups(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey AS a_number", "o_orderstatus AS a_licence", "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 3 END AS b_number", "nullif(o_orderpriority, '1-URGENT') AS b_licence")
    return reshape.unpivot_groups(o, ["o_orderkey"], {"attending": {"number": "a_number", "licence": "a_licence"}, "operating": {"number": "b_number", "licence": "b_licence"}})


@query("crosswalk_melt", "SELECT p_partkey, 'economy' AS condition FROM part WHERE p_type = 'ECONOMY' UNION ALL SELECT p_partkey, 'large' FROM part WHERE p_size > 30")
def _crosswalk(spark, sf):
    wide = table(spark, sf, "part").selectExpr("p_partkey", "CAST(p_type = 'ECONOMY' AS int) AS economy", "CAST(p_size > 30 AS int) AS large")
    return reshape.melt_flags(wide, ["p_partkey"], ["economy", "large"])


@query("condition_counts", "SELECT l_orderkey AS visit_id, count(DISTINCT p_type) AS n_conditions FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def _condition_counts(spark, sf):
    hits = link.matches(occurrences(spark, sf), table(spark, sf, "part"), {"code": "p_partkey"}, {"condition": "p_type"})
    return metrics.condition_count(hits, "visit_id", "condition")


@query("condition_flags_by_system", f"{OCC}, h AS (SELECT visit_id, p_type, max(CASE WHEN system = 'F' THEN 1 ELSE 0 END) AS f FROM occurrences JOIN part ON code = p_partkey GROUP BY 1, 2), w AS (SELECT visit_id, max(f) AS any_f, CAST(max(CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END) AS BIGINT) AS small_ FROM h GROUP BY 1) SELECT visit_id, CASE WHEN visit_id % 3 = 0 THEN NULL ELSE small_ END AS SMALL FROM w")
def _flags_by_system(spark, sf):
    hits = link.matches(occurrences(spark, sf), table(spark, sf, "part"), {"code": "p_partkey"}, {"condition": "p_type"})
    return reshape.pivot_flags(hits, ["visit_id"], "condition", ["SMALL"], {"SMALL": F.col("visit_id") % 3 == 0})


@query(
    "linked_profile",
    f"""{ENC}, l AS (SELECT sex_raw IS NOT NULL AS linked, 'total' AS variable, total AS v FROM encounters UNION ALL SELECT sex_raw IS NOT NULL, 'age', age FROM encounters) SELECT linked, variable, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(quantile_cont(v, 0.5), 6) AS median FROM l WHERE v IS NOT NULL GROUP BY 1, 2""",
)
def _profile(spark, sf):
    return describe.profile(encounters(spark, sf).withColumn("linked", F.col("sex_raw").isNotNull()), "linked", ["total", "age"])


@query("imputation_medians", f"{ENC} SELECT round(quantile_cont(age, 0.5), 6) AS age, round(quantile_cont(total, 0.5), 6) AS total FROM encounters WHERE order_status = 'F'")
def _medians(spark, sf):
    return metrics.medians(encounters(spark, sf), ["age", "total"], F.col("order_status") == "F")


@query(
    "unmapped_top",
    f"""{OCC}, u AS (SELECT system, code, count(*) AS n FROM occurrences LEFT JOIN part ON code = p_partkey AND p_type = 'SMALL' WHERE p_partkey IS NULL GROUP BY 1, 2), r AS (SELECT *, n / sum(n) OVER (PARTITION BY system) AS share, row_number() OVER (PARTITION BY system ORDER BY n DESC, code) AS rank FROM u) SELECT system, code, n, round(share, 6) AS share, rank FROM r WHERE rank <= 100""",
)
def _unmapped(spark, sf):
    df = link.lookup(occurrences(spark, sf), table(spark, sf, "part").filter("p_type = 'SMALL'"), {"code": "p_partkey"}, {"kind": "p_type"})
    return metrics.unmapped_codes(df, ["system"], "code", F.col("kind").isNotNull())


@query(
    "release_profile",
    f"""{ENC} SELECT visit_year, variable, count(*) AS rows, count(v) AS present, round(count(v) / count(*), 6) AS present_share, count(DISTINCT v) AS n_values, min(v) AS least, max(v) AS most
FROM (SELECT visit_year, 'sex_raw' AS variable, sex_raw AS v FROM encounters UNION ALL SELECT visit_year, 'payer_raw', payer_raw FROM encounters UNION ALL SELECT visit_year, 'segment', segment FROM encounters) GROUP BY 1, 2""",
)
def _release(spark, sf):
    return metrics.availability(encounters(spark, sf), ["visit_year"], ["sex_raw", "payer_raw", "segment"])


@query("anti_rows", f"{ENC} SELECT visit_id FROM encounters e WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = e.provider AND s_acctbal > 0)")
def _anti(spark, sf):
    good = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("provider"))
    return link.absent(encounters(spark, sf), good, ["provider"]).select("visit_id")


@query(
    "disagreements",
    """WITH b AS (SELECT c_custkey, c_acctbal + CASE WHEN c_nationkey < 3 THEN 1 ELSE 0 END AS v, nullif(c_mktsegment, 'BUILDING') AS s FROM customer WHERE c_custkey % 10 <> 0) SELECT 'v' AS field, count(*) AS compared, count(*) FILTER (c_nationkey < 3) AS disagreements FROM customer JOIN b USING (c_custkey)
UNION ALL SELECT 's', count(*), count(*) FILTER (c_mktsegment = 'BUILDING') FROM customer JOIN b USING (c_custkey)""",
)
def _disagreements(spark, sf):
    a = table(spark, sf, "customer").selectExpr("c_custkey AS k", "c_acctbal AS v", "c_mktsegment AS s", "c_nationkey")
    b = a.filter("k % 10 <> 0").selectExpr("k", "v + CASE WHEN c_nationkey < 3 THEN 1 ELSE 0 END AS v", "nullif(s, 'BUILDING') AS s")
    return link.disagreements(a, b, ["k"], ["v", "s"])


@query(
    "dimension_checks",
    """WITH cells AS (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1), parts AS (SELECT o_orderstatus, sum(o_totalprice) AS total FROM orders GROUP BY 1), found AS (
SELECT 'unique' AS "check", 0.0 AS expected, CAST(count(*) AS double) AS observed FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'repeated', 0.0, CAST(count(*) AS double) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'acctbal_is_null', 0.0, CAST(count(*) AS double) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'c_mktsegment_vocabulary', 0.0, CAST(count(*) AS double) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT 'total', (SELECT round(sum(o_totalprice), 2) FROM orders), (SELECT round(sum(total), 2) FROM parts) UNION ALL SELECT 'missing', 0.0, CAST(count(*) AS double) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM cells)
UNION ALL SELECT 'unexpected', 0.0, CAST(count(*) AS double) FROM (SELECT c_nationkey FROM cells EXCEPT SELECT n_nationkey FROM nation) UNION ALL SELECT 'repeated_cells', 0.0, CAST(count(*) AS double) FROM (SELECT c_nationkey FROM cells GROUP BY 1 HAVING count(*) > 1))
SELECT "check", expected, observed, abs(expected - observed) < 0.005 AS passed FROM found""",
)
def _dimension(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    out = reconcile.key_unique(c, ["c_custkey"], "unique").unionByName(reconcile.key_unique(o, ["o_custkey"], "repeated"))
    out = out.unionByName(reconcile.all_null(c.select(F.when(F.col("c_acctbal") < 0, F.col("c_acctbal")).alias("acctbal")), ["acctbal"]))
    out = out.unionByName(reconcile.vocabulary(c, {"c_mktsegment": ["BUILDING", "MACHINERY"]}))
    cents = F.col("o_totalprice").cast("decimal(18,2)")  # summed exactly: sums of doubles depend on the order of rows
    parts = o.groupBy("o_orderstatus").agg(F.sum(cents).alias("total"))
    out = out.unionByName(reconcile.sums_match(parts, o.select(cents.alias("total")), ["total"], 1e-9))
    cells = c.filter("c_acctbal > 0").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    grid = reconcile.grid_complete(cells, table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey")), ["c_nationkey"])
    return out.unionByName(grid.withColumn("check", F.when(F.col("check") == "repeated", "repeated_cells").otherwise(F.col("check")))).withColumn("observed", F.round("observed", 2)).withColumn("expected", F.round("expected", 2))


@query(
    "repeated_keys",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1",
)
def _repeated(spark, sf):
    return reconcile.repeated_keys(table(spark, sf, "orders"), ["o_custkey"])


@query(
    "indicator_sums",
    f"""{ENC}, d AS (SELECT {made_sql(ELIGIBLE)} FROM encounters) SELECT patient, count(*) AS n, count(*) FILTER (abs(a + b - 1) <= 1e-6) AS good, count(*) FILTER (abs(a2 + b2 - 1) <= 1e-6) AS good2 FROM d GROUP BY 1""",
)
def _indicator(spark, sf):
    d = _eligible(spark, sf)
    return d.groupBy("patient").agg(F.count("*").alias("n"), F.count_if(labels.sums_to_one([F.col("a"), F.col("b")])).alias("good"), F.count_if(labels.sums_to_one([F.col("a2"), F.col("b2")])).alias("good2"))


@query(
    "comparability_catalogue",
    """SELECT * FROM (VALUES ('visit_unique', 'strict', 'keys', 0.0, 0.0, TRUE, 'passed'), ('no_open_orders', 'strict', 'status', 0.0, (SELECT CAST(count(*) AS double) FROM orders WHERE o_orderstatus = 'O'), (SELECT count(*) = 0 FROM orders WHERE o_orderstatus = 'O'),
  CASE WHEN (SELECT count(*) = 0 FROM orders WHERE o_orderstatus = 'O') THEN 'passed' ELSE 'failed' END), ('never', 'loose', 'n/a', NULL, NULL, NULL, 'not_run')) t("check", level, note, expected, observed, passed, status)""",
)
def _catalogue(spark, sf):
    o = table(spark, sf, "orders")
    checks = reconcile.key_unique(o, ["o_orderkey"], "visit_unique").unionByName(reconcile.none_of(o, {"no_open_orders": F.col("o_orderstatus") == "O"}))
    return reconcile.catalogue(checks, spark.createDataFrame([("visit_unique", "strict", "keys"), ("no_open_orders", "strict", "status"), ("never", "loose", "n/a")], "check string, level string, note string"))


@query(
    "result_sanity",
    """WITH r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_acctbal END AS b, CASE WHEN s_suppkey % 7 = 0 THEN -1.0 ELSE 2.0 END AS se, CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal + 1 ELSE s_acctbal - 1 END AS lo, s_acctbal + 2 AS hi, CASE WHEN s_suppkey % 3 = 0 THEN 1.5 ELSE 0.5 END AS p FROM supplier)
SELECT 'estimate_finite' AS "check", 0.0 AS expected, CAST(count(*) FILTER (b IS NULL) AS double) AS observed, count(*) FILTER (b IS NULL) = 0 AS passed FROM r UNION ALL SELECT 'se_not_negative', 0.0, CAST(count(*) FILTER (se < 0) AS double), count(*) FILTER (se < 0) = 0 FROM r
UNION ALL SELECT 'interval_holds_estimate', 0.0, CAST(count(*) FILTER (lo > b OR hi < b) AS double), count(*) FILTER (lo > b OR hi < b) = 0 FROM r UNION ALL SELECT 'p_in_0_1', 0.0, CAST(count(*) FILTER (p > 1) AS double), count(*) FILTER (p > 1) = 0 FROM r""",
)
def _sanity(spark, sf):
    r = table(spark, sf, "supplier").selectExpr("CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_acctbal END AS b", "CASE WHEN s_suppkey % 7 = 0 THEN -1.0D ELSE 2.0D END AS se", "CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal + 1 ELSE s_acctbal - 1 END AS lo", "s_acctbal + 2 AS hi", "CASE WHEN s_suppkey % 3 = 0 THEN 1.5D ELSE 0.5D END AS p")
    return reconcile.sane_results(r, "b", "se", "lo", "hi", "p")


@query(
    "fingerprint_changes",
    """WITH a AS (SELECT s_name AS file, sha256(s_name) AS h FROM supplier WHERE s_suppkey % 4 <> 0), b AS (SELECT s_name AS file, sha256(CASE WHEN s_suppkey % 5 = 0 THEN 'new' ELSE s_name END) AS h FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT coalesce(a.file, b.file) AS file, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'new' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.file = b.file""",
)
def _changes(spark, sf):
    s = table(spark, sf, "supplier")
    recorded = s.filter("s_suppkey % 4 <> 0").select(F.col("s_name").alias("file"), F.sha2("s_name", 256).alias("sha256"))
    found = s.filter("s_suppkey % 3 <> 0").select(F.col("s_name").alias("file"), F.sha2(F.expr("CASE WHEN s_suppkey % 5 = 0 THEN 'new' ELSE s_name END"), 256).alias("sha256"))
    return reconcile.fingerprints_match(found, recorded)


@query("ordered_results", f"{ENC}, c AS (SELECT segment, sum(CASE WHEN segment = 'BUILDING' THEN NULL ELSE total END) AS charges FROM encounters GROUP BY 1) SELECT segment, round(charges, 2) AS charges, row_number() OVER (ORDER BY charges DESC NULLS LAST, segment) AS place FROM c")
def _ordered(spark, sf):
    c = encounters(spark, sf).groupBy("segment").agg(F.sum(F.when(F.col("segment") != "BUILDING", F.col("total"))).alias("charges"))
    return metrics.ordered(c, [F.desc_nulls_last("charges"), F.col("segment")], "place").withColumn("charges", F.round("charges", 2))


# ---- summaries by year ----

MIX = {"payer": "payer_raw", "disposition": "status_raw", "physician": "CASE WHEN provider % 3 = 0 THEN 'MD' ELSE 'other' END", "facility": "CASE WHEN facility % 2 = 0 THEN 'rural' ELSE 'urban' END"}


@query(
    "annual_mix",
    f"""{ENC}, l AS ({' UNION ALL '.join(f"SELECT visit_year, '{n}' AS variable, {e} AS value FROM encounters" for n, e in MIX.items())}) SELECT visit_year, variable, value, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY visit_year, variable), 6) AS percent FROM l GROUP BY 1, 2, 3""",
)
def _mix(spark, sf):
    return describe.composition(encounters(spark, sf).select("visit_year", *[F.expr(e).alias(n) for n, e in MIX.items()]), ["visit_year"], list(MIX))


@query(
    "annual_top_codes",
    f"""WITH o AS (SELECT year(l_shipdate) AS y, CASE WHEN l_linenumber <= 3 THEN 'clinical' ELSE 'procedure' END AS kind, l_partkey AS code FROM lineitem), c AS (SELECT y, kind, code, count(*) AS n FROM o GROUP BY 1, 2, 3),
r AS (SELECT *, n / sum(n) OVER (PARTITION BY y, kind) AS share, row_number() OVER (PARTITION BY y, kind ORDER BY n DESC, code) AS rank FROM c) SELECT CAST(y AS BIGINT) AS y, kind, code, n, round(share, 6) AS share, rank FROM r WHERE rank <= 25""",
)
def _annual_top(spark, sf):
    o = table(spark, sf, "lineitem").selectExpr("year(l_shipdate) AS y", "CASE WHEN l_linenumber <= 3 THEN 'clinical' ELSE 'procedure' END AS kind", "l_partkey AS code")
    return metrics.top_k(o, ["y", "kind"], "code", 25)


@query(
    "pair_trends",
    f"""{ENC}, l AS (SELECT order_status, visit_year, 'total' AS outcome, total AS value FROM encounters UNION ALL SELECT order_status, visit_year, 'age', age FROM encounters) SELECT order_status, visit_year, outcome, count(*) AS rows, count(value) AS n, count(*) - count(value) AS missing, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.5), 6) AS p50 FROM l GROUP BY 1, 2, 3""",
)
def _trends(spark, sf):
    return describe.summary(encounters(spark, sf), ["order_status", "visit_year"], ["total", "age"], (0.5,))


@query(
    "intersection_means",
    f"""{ENC}, d AS (SELECT CASE WHEN order_status = 'F' THEN 'f' ELSE 'n' END AS a, CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN 'x' ELSE 'y' END AS b, CASE sex_raw WHEN '1' THEN 'm' WHEN 'M' THEN 'm' WHEN '2' THEN 'w' WHEN 'F' THEN 'w' END AS c, CASE WHEN provider % 2 = 0 THEN 'p' ELSE 'q' END AS d, total, age FROM encounters),
l AS (SELECT a, b, c, d, 'total' AS outcome, total AS v FROM d UNION ALL SELECT a, b, c, d, 'age', age FROM d) SELECT a, b, c, d, outcome, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM l WHERE c IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2, 3, 4, 5""",
)
def _intersections(spark, sf):
    d = encounters(spark, sf).selectExpr("CASE WHEN order_status = 'F' THEN 'f' ELSE 'n' END AS a", "CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN 'x' ELSE 'y' END AS b", "CASE sex_raw WHEN '1' THEN 'm' WHEN 'M' THEN 'm' WHEN '2' THEN 'w' WHEN 'F' THEN 'w' END AS c", "CASE WHEN provider % 2 = 0 THEN 'p' ELSE 'q' END AS d", "total", "age")
    return describe.cell_means(d, ["a", "b", "c", "d"], ["total", "age"])


@query(
    "provider_coverage",
    f"""{ENC}, l AS (SELECT 'visit_year' AS variable, CAST(visit_year AS string) AS value, provider % 4 <> 0 AS k FROM encounters UNION ALL SELECT 'role', CASE WHEN provider % 2 = 0 THEN 'attending' ELSE 'operating' END, provider % 4 <> 0 FROM encounters UNION ALL SELECT 'method', CASE provider % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'licence' END, provider % 4 <> 0 FROM encounters)
SELECT variable, value, count(*) AS n, count(*) FILTER (k) AS linked, round(count(*) FILTER (k) / count(*), 6) AS rate FROM l GROUP BY 1, 2""",
)
def _provider_coverage(spark, sf):
    d = encounters(spark, sf).selectExpr("visit_year", "CASE WHEN provider % 2 = 0 THEN 'attending' ELSE 'operating' END AS role", "CASE provider % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'licence' END AS method", "provider % 4 <> 0 AS k")
    return describe.rates_by_stratum(d, ["visit_year", "role", "method"], F.col("k"))


# ---- names ----

SHARES = {"white": 5, "black": 3, "hispanic": 2, "asian": 4, "other": 1}


def _posterior_sql(prior: dict[str, float]) -> str:
    logs = {c: f"ln({p!r}) + ln((c_custkey * {SHARES[c]} + 3) % 7 / 8.0 + 0.05) + ln((c_custkey * {SHARES[c]} + 1) % 5 / 6.0 + 0.05)" for c, p in prior.items()}
    return ", ".join(f"exp({e}) AS e_{c}" for c, e in logs.items())


POPULATION = {"white": 0.5783619, "black": 0.1205021, "hispanic": 0.1872988, "asian": 0.06106737, "other": 0.05276981}
PHYSICIANS = {"white": 29395 / 52638, "black": 3451 / 52638, "hispanic": 9309 / 52638, "asian": 8524 / 52638, "other": 1959 / 52638}
BOTH_PRIORS = f"""WITH x AS (SELECT c_custkey AS id, {_posterior_sql(POPULATION)} FROM customer), y AS (SELECT c_custkey AS id, {_posterior_sql(PHYSICIANS)} FROM customer),
a AS (SELECT id, {', '.join(f'e_{c} / ({" + ".join("e_" + k for k in SHARES)}) AS {c}' for c in SHARES)} FROM x), b AS (SELECT id, {', '.join(f'e_{c} / ({" + ".join("e_" + k for k in SHARES)}) AS {c}' for c in SHARES)} FROM y)"""
LABEL_SQL = "CASE " + " ".join(f"WHEN {{0}}.{c} = greatest({', '.join('{0}.' + k for k in SHARES)}) THEN '{c}'" for c in SHARES) + " END"


def _posteriors(spark, sf):
    df = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    df = df.withColumns({f"last_{c}": (F.col("id") * k + 3) % 7 / 8.0 + 0.05 for c, k in SHARES.items()} | {f"first_{c}": (F.col("id") * k + 1) % 5 / 6.0 + 0.05 for c, k in SHARES.items()})
    df = df.withColumns({"last_match": F.lit(True), "first_match": F.lit(True)})
    for prefix, prior in (("population", nameprob.POPULATION_PRIOR), ("physician", nameprob.PHYSICIAN_PRIOR)):
        df = nameprob.posterior(df, prior, prefix, F.col("last_match"), ("last", "first"))
        df = df.withColumns(nameprob.derived(prefix))
    return df


@query(
    "posterior_derived",
    f"""{BOTH_PRIORS} SELECT id, {LABEL_SQL.format('a')} AS label, round(greatest({', '.join('a.' + c for c in SHARES)}), 6) AS largest, round(a.black + a.white, 6) AS mass, round(a.black / (a.black + a.white), 6) AS conditional,
round(-({' + '.join(f'a.{c} * ln(a.{c})' for c in SHARES)}) / ln(5), 6) AS entropy FROM a""",
)
def _derived(spark, sf):
    return _posteriors(spark, sf).select("id", *[F.col(f"population_{c}").alias(n) for c, n in (("label", "label"), ("max", "largest"), ("mass", "mass"), ("conditional", "conditional"), ("entropy", "entropy"))])


@query(
    "prior_agreement",
    f"""{BOTH_PRIORS} SELECT count(*) AS n, count(*) FILTER ({LABEL_SQL.format('a')} = {LABEL_SQL.format('b')}) AS same_label, round(max(greatest({', '.join(f'abs(a.{c} - b.{c})' for c in SHARES)})), 6) AS max_gap, round(avg(greatest({', '.join(f'abs(a.{c} - b.{c})' for c in SHARES)})), 6) AS mean_gap, CAST(0 AS BIGINT) AS bad_sums FROM a JOIN b USING (id)""",
)
def _agreement(spark, sf):
    return nameprob.prior_sensitivity(_posteriors(spark, sf), "population", "physician")


@query(
    "surname_shares",
    """SELECT s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE round(s_suppkey % 100 / 100.0, 6) END AS white, round((100 - s_suppkey % 100) / 100.0, 6) AS black FROM supplier""",
)
def _surname(spark, sf):
    census = table(spark, sf, "supplier").selectExpr("s_name AS name", "CASE WHEN s_suppkey % 4 = 0 THEN '(S)' ELSE CAST(s_suppkey % 100 AS string) END AS pctwhite", "CAST(100 - s_suppkey % 100 AS string) AS pctblack", "1 AS total")
    return nameprob.surname_model(census, {"white": "pctwhite", "black": "pctblack"})


@query(
    "dictionary_bounds",
    """SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'last' ELSE 'first' END AS name_type, count(*) AS n, count(*) FILTER (s_acctbal > 5000) AS bad, round(min(least(s_acctbal / 5000, 0.5)), 6) AS least, round(max(greatest(s_acctbal / 5000, 0.5)), 6) AS most FROM supplier WHERE s_acctbal >= 0 GROUP BY 1""",
)
def _bounds(spark, sf):
    s = table(spark, sf, "supplier").filter("s_acctbal >= 0").select("s_suppkey", F.col("s_name").alias("name"), *[(F.col("s_acctbal") / 5000 if c == "white" else F.lit(0.5)).alias(c) for c in SHARES])
    return nameprob.out_of_bounds(nameprob.dictionary({"last": s.filter("s_suppkey % 2 = 0"), "first": s.filter("s_suppkey % 2 = 1")}))


@query(
    "dictionary_agreement",
    """WITH a AS (SELECT s_name AS name, s_acctbal AS v FROM supplier WHERE s_suppkey % 5 <> 0), b AS (SELECT s_name AS name, s_acctbal + CASE WHEN s_suppkey % 3 = 0 THEN 1e-3 ELSE 1e-9 END AS v FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT CASE WHEN a.name IS NULL THEN 'right' WHEN b.name IS NULL THEN 'left' ELSE 'both' END AS side, CASE WHEN a.name IS NOT NULL AND b.name IS NOT NULL THEN abs(a.v - b.v) <= 1e-6 END AS v_agrees, count(*) AS n FROM a FULL JOIN b ON a.name = b.name GROUP BY 1, 2""",
)
def _dictionaries(spark, sf):
    s = table(spark, sf, "supplier")
    a = s.filter("s_suppkey % 5 <> 0").selectExpr("s_name AS name", "s_acctbal AS v")
    b = s.filter("s_suppkey % 7 <> 0").selectExpr("s_name AS name", "s_acctbal + CASE WHEN s_suppkey % 3 = 0 THEN 1e-3D ELSE 1e-9D END AS v")
    return link.compared(a, b, ["name"], ["v"], 1e-6).groupBy("side", "v_agrees").agg(F.count("*").alias("n"))
