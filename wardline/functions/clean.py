"""Cleaning of raw text columns. All functions take and give Columns and are null for null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text(c: Column) -> Column:
    """Trimmed; empty becomes null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def text_or_null(df: DataFrame, name: str) -> Column:
    """text() of a column, or a typed null where the layout has no such column."""
    return text(F.col(name)) if name in df.columns else F.lit(None).cast("string")


def number(c: Column) -> Column:
    """Trimmed and parsed as double; what isn't a number becomes null."""
    return F.trim(c.cast("string")).try_cast("double")


def whole(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("int")


def code(c: Column) -> Column:
    """Upper-case letters and digits only; empty becomes null."""
    return F.nullif(F.regexp_replace(F.upper(F.trim(c.cast("string"))), "[^A-Z0-9]", ""), F.lit(""))


def digits(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(c.cast("string")), "[^0-9]", ""), F.lit(""))


def fits(c: Column, pattern: str) -> Column:
    """The whole string matches; a trailing newline doesn't count as the end."""
    return c.rlike(rf"\A(?:{pattern})\z")


def npi_valid(c: Column) -> Column:
    """Ten digits, not the sentinel of nines, and Luhn over them behind the issuer prefix. Null is not valid."""
    return F.coalesce(fits(c, "[0-9]{10}") & (c != "9999999999") & F.call_function("luhn_check", F.concat(F.lit("80840"), c)), F.lit(False))


def licence_valid(c: Column) -> Column:
    return F.coalesce(fits(c, "[A-Z]{1,4}[0-9]{3,}"), F.lit(False))


def zip5(c: Column) -> Column:
    return F.when(fits(c, "[0-9]{5}"), c)


def padded(c: Column, width: int) -> Column:
    """Digits with leading zeros, as a key."""
    d = digits(c)
    return F.when(F.length(d) >= width, d).otherwise(F.lpad(d, width, "0"))


def place_name(c: Column) -> Column:
    """A key for names of places: letters only, SAINT for ST, without COUNTY."""
    words = F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), "[^A-Z ]", ""), r"\bCOUNTY\b", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(words, r"\bST\b", "SAINT"), " ", ""), F.lit(""))


def matching_column(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """The first column whose name, letters and digits only, is that of an alias."""
    def plain(s: str) -> str:
        return "".join(ch for ch in s.upper() if ch.isalnum())

    names = {plain(a) for a in aliases}
    return next((c for c in columns if plain(c) in names), None)


def renamed_by_alias(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Canonical names for columns found by their aliases; a column not found is a typed null."""
    found = {name: matching_column(df.columns, [name, *other]) for name, other in aliases.items()}
    return df.select(*[(text(F.col(f"`{c}`")) if c else F.lit(None).cast("string")).alias(name) for name, c in found.items()])
