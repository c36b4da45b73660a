"""Cleaning of attribute text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(value: Column) -> Column:
    """Text without white space at either end; null if nothing is left."""
    return F.nullif(F.regexp_replace(value.cast("string"), r"^\s+|\s+$", ""), F.lit(""))


def positive_number(value: Column) -> Column:
    """The number that the text is, if above zero; otherwise null. A trailing type letter, which a cast would accept, makes it no number."""
    number = F.regexp_extract(value.cast("string"), r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|\+?(inf|Infinity))\s*$", 1).try_cast("double")
    return F.when(number > 0, number)


def positive_integer(value: Column, most: int = 200) -> Column:
    """The whole number that the text is, if above zero and at most `most`."""
    number = positive_number(value)
    return F.when((number == F.floor(number)) & (number <= most), number.cast("int"))


def slug(value: Column) -> Column:
    """Letters and digits in lower case, with a hyphen for all that is between."""
    folded = F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))
    return F.btrim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", "-"), F.lit("-"))


def format_distance(metres: Column) -> Column:
    """Whole metres below a kilometre, else kilometres to one place; halves go up."""
    tenths = F.floor((metres + 50) / 100)
    return F.when(metres < 1000, F.concat(F.floor(metres).cast("string"), F.lit(" m"))).otherwise(F.format_string("%d.%d km", F.floor(tenths / 10), tenths % 10))


def half_up(value: Column) -> Column:
    """Rounds halves up, as clients do."""
    return F.floor(value + 0.5).cast("long")


def format_duration(seconds: Column) -> Column:
    """Whole minutes, at least one."""
    return F.concat(F.greatest(F.lit(1).cast("long"), half_up(seconds / 60)).cast("string"), F.lit(" min"))
