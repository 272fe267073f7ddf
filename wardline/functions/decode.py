"""Decoding of coded fields. What a code means depends on the period, so a code book is a table of (first year, last year, code, label)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import clean

OPEN = 9999
OLD, NEW, ALL = (0, 2008), (2010, OPEN), (0, OPEN)

#: Fixed values: ((first year, last year), codes, label), first match counts.
SEX = [
    (OLD, ["1"], "Male"), (OLD, ["2"], "Female"), (OLD, ["3"], "Unknown"),
    (NEW, ["M"], "Male"), (NEW, ["F"], "Female"), (NEW, ["U"], "Unknown"),
]
NATIVE, ASIAN, BLACK, PACIFIC, WHITE = "American Indian or Alaska Native", "Asian", "Black or African American", "Native Hawaiian or Other Pacific Islander", "White"
RACE = [
    (OLD, ["1"], NATIVE), (OLD, ["2"], ASIAN), (OLD, ["3", "6"], BLACK), (OLD, ["4", "5"], WHITE), (OLD, ["7"], "Other"), (OLD, ["8"], "No response"),
    (NEW, ["1"], NATIVE), (NEW, ["2"], ASIAN), (NEW, ["3"], BLACK), (NEW, ["4"], PACIFIC), (NEW, ["5"], WHITE), (NEW, ["6"], "Other"), (NEW, ["7"], "Unknown"),
]
COMBINED = [(OLD, ["5"], "White Hispanic"), (OLD, ["6"], "Black Hispanic"), (OLD, ["4"], "White (historical combined code)"), (OLD, ["8"], "No response")]
ETHNICITY = [((2009, OPEN), ["E1"], "Hispanic or Latino"), ((2009, OPEN), ["E2"], "Not Hispanic or Latino"), ((2009, OPEN), ["E7"], "Unknown")]
PROGRAM = [(ALL, ["14"], "Ambulatory Surgery Center"), (ALL, ["23"], "Hospital"), (ALL, ["64"], "Cardiac Catheterization Laboratory")]
WEEKDAY = [(ALL, [str(k + 1)], d) for k, d in enumerate(["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"])]
ADMISSION = [
    (ALL, ["01"], "Non-health care facility/home/workplace"), (ALL, ["02"], "Clinic or physician office"), (ALL, ["04"], "Transfer from a different hospital"),
    (ALL, ["05"], "Transfer from SNF or ICF"), (ALL, ["06"], "Transfer from another health care facility"),
    ((2010, 2010), ["07"], "Emergency room (discontinued 2011-01-01)"), (ALL, ["07"], "Legacy code 07 outside documented validity"),
    (ALL, ["08"], "Court/law enforcement"), (ALL, ["09"], "Information not available"), (ALL, ["D"], "Transfer within same hospital distinct unit"),
    (ALL, ["E"], "Transfer from ambulatory surgery center"), (ALL, ["F"], "Transfer from hospice"), (ALL, ["00"], "Zero-filled/unmapped"),
]
TRANSFERS, HOSPICES = ["02", "03", "04", "05", "62", "63", "64", "65", "66", "70"], ["50", "51"]
DISPOSITION = [
    (ALL, ["01"], "Routine discharge/home"), (ALL, ["06"], "Home health"), (ALL, TRANSFERS, "Transfer"), (ALL, ["07"], "Left/discontinued care"),
    (ALL, ["20"], "Expired"), (ALL, ["21"], "Court/law enforcement"), (ALL, HOSPICES, "Hospice"),
]
PAYER = [
    (ALL, ["A"], "Medicare"), (OLD, ["B"], "Medicare HMO/PPO"), (ALL, ["B"], "Medicare Managed Care"), (ALL, ["C"], "Medicaid"), (OLD, ["D"], "Medicaid HMO"), (ALL, ["D"], "Medicaid Managed Care"),
    (OLD, ["E"], "Commercial insurance"), (OLD, ["F"], "Commercial HMO"), (OLD, ["G"], "Commercial PPO"), (ALL, ["E"], "Commercial health insurance"), (ALL, ["H"], "Workers Compensation"),
    (OLD, ["I"], "CHAMPUS"), (ALL, ["I"], "TRICARE/other federal government"), (ALL, ["J"], "VA"), (ALL, ["K"], "Other state/local government"), (OLD, ["L"], "Self pay/under-insured"),
    (ALL, ["L"], "Self pay"), (ALL, ["M"], "Other"), (OLD, ["N"], "Charity"), (ALL, ["N"], "Non-payment"), (ALL, ["O"], "KidCare"), (ALL, ["P"], "Unknown"), (ALL, ["Q"], "Commercial liability coverage"),
]
PAYER_GROUP = [
    (ALL, ["A", "B"], "Medicare"), (ALL, ["C", "D"], "Medicaid"), (ALL, ["E", "F", "G"], "Commercial"), (ALL, ["L"], "Self-pay"), (ALL, ["H"], "Workers compensation"), (ALL, ["I", "J"], "Federal government"),
    (ALL, ["K", "O"], "Other government"), (ALL, ["Q"], "Liability"), (ALL, ["N"], "Non-payment/charity"), (ALL, ["P"], "Unknown"), (ALL, ["M"], "Other"),
]
#: Fixed values from here to EM_SENTINEL. (first age, last age, label).
AGE_BANDS = [(0, 17, "0-17"), (18, 44, "18-44"), (45, 64, "45-64"), (65, 84, "65-84"), (85, 115, "85+")]
#: From 2018 on: sentinel ages and their bands.
AGE_SENTINELS = {0: "0-28 days", 777: "29-364 days", 888: "100 years and older", 999: "Unknown"}
SENTINELS_FROM = 2018
HOUR_BANDS = [(6, 11, "Morning"), (12, 17, "Afternoon"), (18, 23, "Evening"), (0, 5, "Night")]
RURALITY = [(1, 3, "Metropolitan"), (4, 6, "Micropolitan"), (7, 10, "Small town/rural")]
#: Evaluation codes by level; codes of critical care, of special services, and the sentinel.
EM_LEVELS = {1: ["99281", "G0380"], 2: ["99282", "G0381"], 3: ["99283", "G0382"], 4: ["99284", "G0383"], 5: ["99285", "G0384"]}
CRITICAL_CARE, SPECIAL_EMERGENCY, EM_SENTINEL = ["99291", "99292"], ["99288"], ["99999"]


def by_period(c: Column, year: Column, book: Sequence[tuple], missing: str | None = "Missing", other: str | None = "Unmapped") -> Column:
    """The label of a code in its year; `missing` for null, `other` for a code without one."""
    out = None
    for (first, last), codes, label in book:
        hit = c.isin(codes)
        if first > 0:
            hit = hit & (year >= first)
        if last < OPEN:
            hit = hit & (year <= last)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.when(c.isNull(), F.lit(missing).cast("string")).otherwise(F.lit(other).cast("string"))


def by_range(c: Column, bands: Sequence[tuple], missing: str | None = None, other: str | None = None) -> Column:
    """The label of the first range that holds a number."""
    out = F.when(c.between(bands[0][0], bands[0][1]), bands[0][2])
    for low, high, label in bands[1:]:
        out = out.when(c.between(low, high), label)
    return out.when(c.isNull(), F.lit(missing).cast("string")).otherwise(F.lit(other).cast("string"))


def program(c: Column) -> Column:
    return by_period(c, F.lit(0), PROGRAM, "Unmapped/other program code", "Unmapped/other program code")


def off_site(location: Column, year: Column) -> tuple[Column, Column]:
    """Flag and status of an off-site location: unknown before 2010, false without a code, true for a single letter."""
    letter = clean.fits(location, "[A-Z]")
    flag = F.when(year < 2010, F.lit(None).cast("boolean")).when(location.isNull(), False).when(letter, True)
    status = (
        F.when(year < 2010, "Structurally unavailable before 2010")
        .when(location.isNull(), "Main hospital/no off-site code reported")
        .when(letter, "AHCA-assigned off-site ED location code")
        .otherwise("Invalid/unmapped service-location value")
    )
    return flag, status


def historical_label(race: Column, year: Column) -> Column:
    """The combined race and origin codes of the years to 2008; null after them."""
    named = by_period(race, year, COMBINED, None, None)
    return F.when(year <= OLD[1], F.coalesce(named, F.concat(F.lit("Historical race/ethnicity code: "), F.coalesce(race, F.lit("missing")))))


def ethnicity(origin: Column, race: Column, year: Column) -> Column:
    """From the combined race code to 2008, from its own code after."""
    old = F.when(race.isin("5", "6"), "Hispanic or Latino (from historical combined code)").otherwise("Not separately reported/not derivable")
    return F.when(year <= OLD[1], old).otherwise(by_period(origin, year, ETHNICITY))


def age_years(age: Column, year: Column) -> Column:
    sentinel = (year >= SENTINELS_FROM) & age.isin(*[s for s in AGE_SENTINELS if s])
    return F.when(~F.coalesce(sentinel, F.lit(False)) & age.between(0, 115), age)


def age_band(age: Column, year: Column) -> Column:
    out = None
    for value, label in AGE_SENTINELS.items():
        hit = (year >= SENTINELS_FROM) & (age == value)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(by_range(age, AGE_BANDS, "Missing", "Invalid/unmapped"))


def age_flag(age: Column, year: Column, low: int, high: int, true_sentinels: Sequence[int] = (), unknown_sentinels: Sequence[int] = ()) -> Column:
    """Three-valued: true in the range or at a sentinel known to lie in it, null where the age is unknown, else false."""
    late = year >= SENTINELS_FROM
    out = F.when(age.between(low, high), True)
    if true_sentinels:
        out = out.when(late & age.isin(*true_sentinels), True)
    unknown = age.isNull()
    if unknown_sentinels:
        unknown = unknown | (late & age.isin(*unknown_sentinels))
    return out.when(unknown, F.lit(None).cast("boolean")).otherwise(False)


def age_flags(age: Column, year: Column) -> dict[str, Column]:
    return {
        "age_0_12_flag": age_flag(age, year, 0, 12, (0, 777), (888, 999)),
        "age_13_17_flag": age_flag(age, year, 13, 17, (), (777, 888, 999)),
        "pediatric_flag": age_flag(age, year, 0, 17, (0, 777), (888, 999)),
        "adult_18_64_flag": age_flag(age, year, 18, 64, (), (777, 888, 999)),
        "older_adult_65plus_flag": age_flag(age, year, 65, 115, (888,), (777, 999)),
    }


def weekend(weekday: Column) -> Column:
    return F.when(weekday.isin("6", "7"), True).when(weekday.between("1", "5"), False)


def arrival_hour(c: Column) -> Column:
    hour = clean.whole(c)
    return F.when(hour.between(0, 23), hour)


def arrival_band(c: Column) -> Column:
    return by_range(clean.whole(c), HOUR_BANDS, "Unknown", "Unknown")


def off_hours(c: Column, first: int = 7, last: int = 17) -> Column:
    """False from `first` to `last`, true for the other hours of the day, null otherwise."""
    hour = arrival_hour(c)
    return F.when(hour.between(first, last), False).when(hour.isNotNull(), True)


def rurality(ruca: Column) -> Column:
    return by_range(clean.number(ruca), RURALITY)


def disposition_flags(status: Column) -> dict[str, Column]:
    return {
        "routine_discharge_flag": status == "01",
        "transfer_flag": status.isin(*TRANSFERS),
        "hospice_flag": status.isin(*HOSPICES),
        "mortality_flag": status == "20",
        "court_law_enforcement_flag": status == "21",
        "left_discontinued_care_flag": status == "07",
    }


def unavailable(kind: str, reason: str) -> tuple[Column, Column]:
    """A typed null for a measure that the release can't give, and why."""
    return F.lit(None).cast(kind), F.lit(reason)


def code_systems(year: Column, quarter: Column) -> tuple[Column, Column]:
    """Diagnosis and procedure systems: the change came with the fourth quarter of 2015; procedures end with 2017."""
    new = (year > 2015) | ((year == 2015) & (quarter >= 4))
    diagnosis = F.when(new, "ICD-10-CM").otherwise("ICD-9-CM")
    return diagnosis, F.when(year > 2017, F.lit(None).cast("string")).when(new, "ICD-10-PCS").otherwise("ICD-9-CM")


def em_level(c: Column) -> Column:
    out = None
    for level, codes in EM_LEVELS.items():
        out = F.when(c.isin(*codes), level) if out is None else out.when(c.isin(*codes), level)
    return out


def gated(c: Column, year: Column, first: int = 2010) -> Column:
    """Null before the first year in which the field exists."""
    return F.when(year >= first, c)


def charges(parts: Sequence[Column], total: Column, tolerance: Column) -> dict[str, Column]:
    """Sum of components (null if all are), canonical total (the reported one if not negative), difference and exception flag."""
    known = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    added = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    component = F.when(known > 0, added)
    return {
        "component_charge_sum": component,
        "total_charge": F.when(total >= 0, total).otherwise(component),
        "charge_difference": total - component,
        "charge_exception_flag": F.abs(total - component) > tolerance,
    }


def charge_tolerance(year: Column) -> Column:
    return F.when(year <= 2008, 10).otherwise(13)


def log1p_charge(c: Column) -> Column:
    return F.when(c >= 0, F.log1p(c))


def experience(year: Column, graduated: Column) -> Column:
    years = year - graduated
    return F.when(years.between(0, 80), years)


def clock_hours(days: Column, discharge: Column, arrival: Column) -> dict[str, Column]:
    """Hours from arrival to discharge; not negative; valid up to a week."""
    raw = F.when(arrival.between(0, 23) & discharge.between(0, 23), 24.0 * days + discharge - arrival)
    return {"los_raw": raw, "los_nonnegative": F.when(raw >= 0, raw), "los_valid": F.when(raw.between(0, 168), raw)}


def real_dollars(charge: Column, factor: Column) -> Column:
    return F.when(charge >= 0, charge * factor)
