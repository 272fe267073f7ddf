"""Labels and flags from decoded columns: pairs, eligibility, provider attributes, clinical classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import clean

#: Keywords of treatment groups.
HIGHER_DISCRETION = [
    "CT SCAN", "COMPUTERIZED AXIAL TOMOGRAPHY", "MAGNETIC RESONANCE", "DIAGNOSTIC ULTRASOUND", "X-RAY", "LABORATORY", "MICROSCOPIC EXAMINATION", "PATHOLOGY",
    "CONSULTATION", "EVALUATION", "CARDIAC STRESS", "RADIOISOTOPE SCAN", "ELECTROENCEPHALOGRAM", "OTHER DIAGNOSTIC RADIOLOGY",
]
LOWER_DISCRETION = [
    "RESPIRATORY INTUBATION", "MECHANICAL VENTILATION", "BLOOD AND BLOOD PRODUCT TRANSFUSION", "CORONARY THROMBOLYSIS", "PERCUTANEOUS TRANSLUMINAL CORONARY ANGIOPLASTY", "APPENDECTOMY",
    "CHOLECYSTECTOMY", "HEMODIALYSIS", "CONTROL OF EPISTAXIS", "SUTURE OF SKIN", "INCISION AND DRAINAGE", "TREATMENT, FRACTURE", "REMOVAL OF ECTOPIC PREGNANCY",
]
#: Patterns of principal diagnoses by code system.
INFARCTION = {
    "icd9_strict": ("ICD-9-CM", r"\A410[0-9]1\z"),
    "icd9_broad": ("ICD-9-CM", r"\A410[0-9][01]\z"),
    "icd10_primary": ("ICD-10-CM", r"\AI21([0-4]|9)"),
    "icd10_type2_other": ("ICD-10-CM", r"\A(I21A1|I21A9)\z"),
    "icd10_i22": ("ICD-10-CM", r"\AI22"),
}
#: Fixed values: (taxonomy prefix, credential words, class) in the order of precedence.
CLINICIANS = [
    ("363L", "NP|APRN|ARNP|FNP|DNP", "Nurse practitioner"), ("363A", "PA|PA-C|PAC", "Physician assistant"), ("367500000X", None, "Certified registered nurse anesthetist"),
    ("364S", None, "Clinical nurse specialist"), ("163W", None, "Registered nurse"), ("1835", None, "Pharmacist"), ("103T", None, "Psychologist"), ("1041", None, "Social worker"),
]
THRESHOLDS = (0.5, 0.7, 0.8, 0.9)


def contains_any(c: Column, words: Sequence[str]) -> Column:
    return F.coalesce(c.rlike("|".join(w.replace(".", r"\.") for w in words)), F.lit(False))


def discretion(label: Column, higher: Sequence[str] = HIGHER_DISCRETION, lower: Sequence[str] = LOWER_DISCRETION) -> tuple[Column, Column, Column]:
    """Class, confidence and need of review of a treatment group by its label; higher discretion comes first."""
    up = F.upper(F.coalesce(label, F.lit("")))
    high, low = contains_any(up, higher), contains_any(up, lower)
    kind = F.when(high, "higher_discretion_candidate").when(low, "lower_discretion_candidate").otherwise("ambiguous_or_unclassified")
    return kind, F.when(high, "moderate").when(low, "low_to_moderate").otherwise("low"), ~high


def presentation_group(share: Column, high: float = 0.8, low: float = 0.2) -> Column:
    """By the share of symptom codes; both limits belong to their groups, and a null share is mixed."""
    return F.when(share >= high, "higher_subjectivity").when(share <= low, "lower_subjectivity").otherwise("ambiguous_or_mixed")


def symptom_group(system: Column, code: Column) -> Column:
    """Symptoms and signs (ICD-9 780 to 799, ICD-10 chapter R), else disease; without a code ambiguous."""
    number = F.substring(code, 1, 3).try_cast("int")
    symptom = ((system == "ICD-9-CM") & number.between(780, 799)) | ((system == "ICD-10-CM") & code.startswith("R"))
    return F.when(code.isNull(), "ambiguous").when(symptom, "symptom_sign").otherwise("disease_condition_injury")


def infarction_flags(system: Column, code: Column) -> dict[str, Column]:
    return {name: F.coalesce((system == of) & code.rlike(p), F.lit(False)) for name, (of, p) in INFARCTION.items()}


def second_infarction(flags: dict[str, Column]) -> Column:
    """A subsequent infarction together with a first one."""
    return flags["icd10_i22"] & (flags["icd10_primary"] | flags["icd10_type2_other"])


def pair_category(left: Column, right: Column, values: Sequence[str], defined: Column | None = None) -> Column:
    """`left_right` for the two given values of both sides (the acting side first), null for any other pair."""
    a, b = values
    both = left.isin(a, b) & right.isin(a, b)
    if defined is not None:
        both = both & defined
    return F.when(both, F.concat(F.lower(left), F.lit("_"), F.lower(right)))


def pair_indicators(pair: Column, values: Sequence[str]) -> dict[str, Column]:
    """One 0/1 column for each of the four pairs, and the flag of equal sides; null without a pair."""
    a, b = (v.lower() for v in values)
    out = {f"{x}_{y}": (pair == f"{x}_{y}").cast("int") for x in (a, b) for y in (a, b)}
    return out | {"concordant": pair.isin(f"{a}_{a}", f"{b}_{b}").cast("int")}


def threshold_flags(probability: Column, base: Column, thresholds: Sequence[float] = THRESHOLDS) -> dict[str, Column]:
    return {f"t{round(100 * t)}": F.coalesce(base & (probability >= t), F.lit(False)) for t in thresholds}


def arg_max_label(columns: dict[str, Column]) -> Column:
    """The name of the largest column, ties to the one given first; null if all are."""
    top = F.greatest(*columns.values()) if len(columns) > 1 else next(iter(columns.values()))
    out = None
    for name, c in columns.items():
        out = F.when(c == top, name) if out is None else out.when(c == top, name)
    return out


def five_groups(race: Column, ethnicity: Column) -> Column:
    """Hispanic first, then race: white, black, asian, other; null where either is unknown."""
    return (
        F.when(ethnicity == "Hispanic or Latino", "hispanic")
        .when(ethnicity != "Not Hispanic or Latino", F.lit(None).cast("string"))
        .when(race == "White", "white")
        .when(race == "Black or African American", "black")
        .when(race == "Asian", "asian")
        .when(race.isin("American Indian or Alaska Native", "Native Hawaiian or Other Pacific Islander", "Other"), "other")
    )


def sums_to_one(columns: Sequence[Column], tolerance: float = 1e-6) -> Column:
    return F.coalesce(F.abs(sum(columns[1:], columns[0]) - 1) <= tolerance, F.lit(False))


def entity_category(code: Column) -> Column:
    return F.when(code == "1", "Individual").when(code == "2", "Organization").otherwise("Not found")


def credential(c: Column, words: str) -> Column:
    return F.coalesce(F.upper(c).rlike(f"(^|[^A-Z])({words})([^A-Z]|$)"), F.lit(False))


def is_physician(taxonomy: Column, credentials: Column) -> Column:
    return F.coalesce(taxonomy.rlike("^20[78]"), F.lit(False)) | credential(credentials, r"MD|M\.D\.?|DO|D\.O\.?")


def clinician_type(entity: Column, taxonomy: Column, credentials: Column) -> Column:
    out = F.when(entity == "Organization", "Organization NPI").when(entity != "Individual", "NPI absent from current individual snapshot").when(is_physician(taxonomy, credentials), "MD/DO physician")
    for prefix, words, label in CLINICIANS:
        hit = F.coalesce(taxonomy.startswith(prefix), F.lit(False))
        out = out.when(hit | credential(credentials, words) if words else hit, label)
    return out.otherwise("Other individual provider")


def first_of(sources: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first known value by precedence, and the name of its source."""
    label = None
    for name, c in sources:
        label = F.when(c.isNotNull(), name) if label is None else label.when(c.isNotNull(), name)
    return F.coalesce(*[c for _, c in sources]), label


def conflict(*values: Column) -> Column:
    """Two known values differ."""
    out = F.lit(False)
    for k, a in enumerate(values):
        for b in values[k + 1 :]:
            out = out | F.coalesce(a != b, F.lit(False))
    return out


def primary_of_slots(codes: Sequence[Column], switches: Sequence[Column], yes: str = "Y") -> Column:
    """The code whose switch is set, else the first known one."""
    return F.coalesce(*[F.when(s == yes, c) for c, s in zip(codes, switches, strict=True)], *codes)


def registry_active(deactivated: Column, reactivated: Column) -> Column:
    return deactivated.isNull() | F.coalesce(reactivated >= deactivated, F.lit(False))


def imputed_gender(male: Column, female: Column, share: float = 0.9) -> Column:
    """By counts of a first name: a class that holds at least `share` of them."""
    both = F.coalesce(male, F.lit(0)) + F.coalesce(female, F.lit(0))
    return F.when((both > 0) & (F.coalesce(male, F.lit(0)) >= share * both), "Male").when((both > 0) & (F.coalesce(female, F.lit(0)) >= share * both), "Female")


def suppressed(n: Column, value: Column, least: int = 11) -> Column:
    """Null where the cell is smaller than the publishing rule allows."""
    return F.when(n >= least, value)


def licence_key(c: Column) -> Column:
    """Letters and number of a licence without leading zeros, as PREFIX:number."""
    own = clean.code(c)
    return F.when(clean.licence_valid(own), F.concat(F.regexp_extract(own, "^([A-Z]+)", 1), F.lit(":"), F.regexp_replace(F.regexp_extract(own, "([0-9]+)$", 1), "^0+(?=.)", "")))
