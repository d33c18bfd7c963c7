"""Scalar rules of records with optional fields: falsy chains, lenient numbers, addresses, zoning, project text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SQFT_PER_ACRE = 43_560
#: Fixed values, in the order in which whole words are shortened.
ABBREVIATIONS = (("STREET", "ST"), ("AVENUE", "AVE"), ("DRIVE", "DR"), ("ROAD", "RD"), ("BOULEVARD", "BLVD"), ("NORTH", "N"), ("SOUTH", "S"), ("EAST", "E"), ("WEST", "W"))
#: Words that a project description is searched for, in order.
PROJECTS = (("adu", ("adu", "accessory dwelling")), ("addition", ("addition", "expand")), ("deck", ("deck",)), ("garage", ("garage",)), ("remodel", ("remodel",)))
FEATURES = ("kitchen", "bathroom")


def text_or(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the last."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns[:-1]), columns[-1])


def number_or(*columns: Column) -> Column:
    """The first that is not null, zero or NaN, else the last."""
    return F.coalesce(*(F.when((c != 0) & ~F.isnan(c), c) for c in columns[:-1]), columns[-1])


def to_number(c: Column | None, fallback: Column | float | None = 0.0) -> Column:
    """A lenient number: null and blank texts are 0, what is no finite number is the fallback, a column that is absent too."""
    other = fallback if isinstance(fallback, Column) else F.lit(fallback).cast("double")
    if c is None:
        return other
    s = F.trim(c.cast("string"))
    n = s.try_cast("double")
    return F.when(c.isNull() | (s == ""), F.lit(0.0)).otherwise(F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), other).otherwise(n))


def round_half_up(c: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c + 0.5)


def normalize_address(c: Column, city: str = "SEATTLE", state: str = "WA", anchored: bool = False) -> Column:
    """Upper case, condensed, cut at the first comma, city, state and five digits; street words shortened.

    The cuts are not anchored to words (so ``BROADWAY`` becomes ``BROAD``), as
    records are compared in this form; ``anchored`` asks for whole words.
    """
    edge = r"\b" if anchored else ""
    out = F.regexp_replace(F.upper(F.regexp_replace(c, r"^\s+|\s+$", "")), r"\s+", " ")
    for cut in (",", f"{edge}{city}{edge}", f"{edge}{state}{edge}", rf"{edge}\d{{5}}{edge}"):
        out = F.regexp_replace(out, f"(?s){cut}.*$", "")
    for word, short in ABBREVIATIONS:
        out = F.regexp_replace(out, rf"\b{word}\b", short)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def house_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(\d+)\s+(.+)$", 1), F.lit(""))


def street(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^(\d+)\s+(.+)$", 2), F.lit("")), c)


def token(c: Column) -> Column:
    """Upper-case letters and digits only."""
    return F.regexp_replace(F.upper(F.coalesce(c.cast("string"), F.lit(""))), "[^A-Z0-9]", "")


def tokens(*columns: Column) -> Column:
    """Tokens of several columns, empty ones left out."""
    return F.filter(F.array(*(token(c) for c in columns)), lambda x: x != "")


def street_tokens(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), " "), token), lambda x: x != "")


def zoning(prop_class: Column, kind: Column) -> Column:
    """The zone of a property class, else of its described kind, else the default."""
    first, kind = F.substring(prop_class.cast("string"), 1, 1), F.coalesce(kind, F.lit(""))
    return F.when(first == "1", "SF 5000").when(first == "2", "LR1").when(first == "3", "NC2-40").when(kind.contains("SINGLE"), "SF 5000").when(kind.contains("MULTI"), "LR1").otherwise("SF 5000")


def project_types(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, (low.contains(w) for w in words)), F.lit(name)) for name, words in PROJECTS)))


def project_features(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.array_compact(F.array(*(F.when(low.contains(w), F.lit(w)) for w in FEATURES)))


def square_feet(c: Column) -> Column:
    """The digits before the first unit of area; ``1,200 sq ft`` gives 200."""
    return F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), r"(\d+)\s*(?:sq(?:uare)?\.?\s*f(?:ee)?t?|sf)", 1).try_cast("int")
