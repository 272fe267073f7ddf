"""Boundaries of cleaning and decoding, on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from wardline.functions import clean, decode, labels


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c().alias(n) for n, c in columns.items()]).collect()]


def test_cleaning(spark):
    got = values(spark, [("  a ",), ("",), (None,), (" 1.5",), ("x",)], "c string", t=lambda: clean.text(F.col("c")), n=lambda: clean.number(F.col("c")))
    assert got == [("a", None), (None, None), (None, None), ("1.5", 1.5), ("x", None)]
    assert values(spark, [(" i21.3 ",), ("--",), (None,)], "c string", c=lambda: clean.code(F.col("c"))) == [("I213",), (None,), (None,)]
    assert values(spark, [("32801",), ("32801\n",), ("3280",)], "c string", z=lambda: clean.zip5(F.col("c"))) == [("32801",), (None,), (None,)]
    assert values(spark, [("St. Johns County",), ("SAINT JOHNS",)], "c string", p=lambda: clean.place_name(F.col("c"))) == [("SAINTJOHNS",), ("SAINTJOHNS",)]


def test_npi(spark):
    rows = [("1234567893",), ("1234567890",), ("9999999999",), ("123456789",), (None,), ("12345678x3",)]
    assert [v for (v,) in values(spark, rows, "c string", v=lambda: clean.npi_valid(F.col("c")))] == [True, False, False, False, False, False]


@pytest.mark.parametrize(
    ("age", "year", "years", "band", "child", "old"),
    [
        (0, 2017, 0, "0-17", True, False), (0, 2018, 0, "0-28 days", True, False), (17, 2020, 17, "0-17", True, False), (18, 2020, 18, "18-44", False, False), (64, 2020, 64, "45-64", False, False),
        (65, 2020, 65, "65-84", False, True), (115, 2020, 115, "85+", False, True), (116, 2020, None, "Invalid/unmapped", False, False), (777, 2020, None, "29-364 days", True, None),
        (777, 2010, None, "Invalid/unmapped", False, False), (888, 2020, None, "100 years and older", None, True), (999, 2020, None, "Unknown", None, None), (None, 2020, None, "Missing", None, None),
    ],
)
def test_ages(spark, age, year, years, band, child, old):
    a, y = F.col("a"), F.col("y")
    got = values(spark, [(age, year)], "a int, y int", n=lambda: decode.age_years(a, y), b=lambda: decode.age_band(a, y), c=lambda: decode.age_flags(a, y)["pediatric_flag"], o=lambda: decode.age_flags(a, y)["older_adult_65plus_flag"])
    assert got == [(years, band, child, old)]


def test_hours(spark):
    rows = [("0",), ("6",), ("7",), ("17",), ("18",), ("23",), ("99",), ("",), (None,)]
    h = F.col
    got = values(spark, rows, "h string", o=lambda: decode.off_hours(h("h")), b=lambda: decode.arrival_band(h("h")), d=lambda: decode.off_hours(h("h"), 7, 18))
    assert got == [(True, "Night", True), (True, "Morning", True), (False, "Morning", False), (False, "Afternoon", False), (True, "Evening", False), (True, "Evening", True), (None, "Unknown", None), (None, "Unknown", None), (None, "Unknown", None)]


def test_code_systems_change_in_the_fourth_quarter_of_2015(spark):
    got = values(spark, [(2015, 3), (2015, 4), (2017, 4), (2018, 1)], "y int, q int", d=lambda: decode.code_systems(F.col("y"), F.col("q"))[0], p=lambda: decode.code_systems(F.col("y"), F.col("q"))[1])
    assert got == [("ICD-9-CM", "ICD-9-CM"), ("ICD-10-CM", "ICD-10-PCS"), ("ICD-10-CM", "ICD-10-PCS"), ("ICD-10-CM", None)]


def test_codes_by_era(spark):
    rows = [("4", 2008), ("4", 2010), ("6", 2008), ("6", 2010), ("8", 2008), ("8", 2010), (None, 2010), ("4", 2009)]
    got = [v for (v,) in values(spark, rows, "c string, y int", r=lambda: decode.by_period(F.col("c"), F.col("y"), decode.RACE))]
    assert got == ["White", "Native Hawaiian or Other Pacific Islander", "Black or African American", "Other", "No response", "Unmapped", "Missing", "Unmapped"]


def test_charges(spark):
    parts = [F.col("a"), F.col("b")]
    rows = [(None, None, 5.0), (None, None, None), (1.0, None, -1.0), (10.0, 3.0, 0.0), (10.0, 3.1, 0.0)]
    got = values(spark, [(*r, 13) for r in rows], "a double, b double, t double, k int", **{n: (lambda n=n: decode.charges(parts, F.col("t"), F.col("k"))[n]) for n in ("component_charge_sum", "total_charge", "charge_exception_flag")})
    assert got == [(None, 5.0, None), (None, None, None), (1.0, 1.0, False), (13.0, 0.0, False), (13.1, 0.0, True)]


def test_clock_hours(spark):
    got = values(spark, [(0.0, 5, 7), (1.0, 5, 7), (8.0, 0, 0), (0.0, 24, 3), (None, 5, 3)], "d double, x int, a int", **{n: (lambda n=n: decode.clock_hours(F.col("d"), F.col("x"), F.col("a"))[n]) for n in ("los_raw", "los_nonnegative", "los_valid")})
    assert got == [(-2.0, None, None), (22.0, 22.0, 22.0), (192.0, 192.0, None), (None, None, None), (None, None, None)]


def test_infarction_codes(spark):
    rows = [("ICD-9-CM", "41001"), ("ICD-9-CM", "41000"), ("ICD-9-CM", "41002"), ("ICD-10-CM", "I2101"), ("ICD-10-CM", "I21A1"), ("ICD-10-CM", "I220"), ("ICD-9-CM", "I2101"), ("ICD-10-CM", None)]
    got = values(spark, rows, "s string, c string", **{n: (lambda n=n: labels.infarction_flags(F.col("s"), F.col("c"))[n]) for n in labels.INFARCTION})
    assert [[k for k, v in zip(labels.INFARCTION, r, strict=True) if v] for r in got] == [["icd9_strict", "icd9_broad"], ["icd9_broad"], [], ["icd10_primary"], ["icd10_type2_other"], ["icd10_i22"], [], []]


def test_clinicians(spark):
    rows = [("Organization", "207P00000X", "MD"), ("Individual", "207P00000X", None), ("Individual", None, "Jane Doe, M.D."), ("Individual", "363LF0000X", "MDX"), ("Individual", None, "FNP-C"), ("Individual", None, None), ("Not found", None, "MD")]
    got = [v for (v,) in values(spark, rows, "e string, t string, c string", k=lambda: labels.clinician_type(F.col("e"), F.col("t"), F.col("c")))]
    assert got == ["Organization NPI", "MD/DO physician", "MD/DO physician", "Nurse practitioner", "Nurse practitioner", "Other individual provider", "NPI absent from current individual snapshot"]


def test_labels(spark):
    got = values(spark, [(0.2, 0.5, 0.5), (None, None, None)], "a double, b double, c double", m=lambda: labels.arg_max_label({k: F.col(k) for k in "abc"}))
    assert got == [("b",), (None,)]
    assert values(spark, [("x", 0.9)], "n string, p double", s=lambda: labels.presentation_group(F.col("p")), f=lambda: labels.threshold_flags(F.col("p"), F.lit(True))["t90"]) == [("higher_subjectivity", True)]
    assert values(spark, [("fl0012",), ("ME123456",), ("12",)], "c string", k=lambda: labels.licence_key(F.col("c"))) == [("FL:12",), ("ME:123456",), (None,)]
    pair = labels.pair_category(F.col("a"), F.col("b"), ("Black", "White"))
    assert values(spark, [("Black", "White"), ("Black", "Asian"), (None, "White")], "a string, b string", p=lambda: pair) == [("black_white",), (None,), (None,)]
