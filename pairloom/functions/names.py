"""Columns over names, addresses and numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beginnings and whole names that say nothing about a function.
UNPORTABLE_PREFIXES = ("sub_", "nullsub", "j_", "unknown_libname_")
UNPORTABLE_NAMES = ("", "...", "DllEntryPoint", "start")


def is_auto(name: Column) -> Column:
    """Whether a name was made from an address."""
    return name.startswith("sub_")


def is_portable(name: Column) -> Column:
    """Whether a name is worth carrying to another catalog."""
    bad = name.isin(*UNPORTABLE_NAMES)
    for prefix in UNPORTABLE_PREFIXES:
        bad = bad | name.startswith(prefix)
    return F.coalesce(~bad, F.lit(False))


def md_value(text: Column) -> Column:
    """A decimal text as a double; null if it is none."""
    return text.try_cast("double")


def hex8(address: Column) -> Column:
    """An address in hex, with eight digits at least."""
    return F.format_string("%08x", address.cast("long"))


def from_hex(text: Column) -> Column:
    return F.conv(text, 16, 10)


def common_share(a: Column, b: Column) -> Column:
    """How many distinct elements two JSON lists share, over the larger's distinct count; null if both are empty."""
    left, right = (F.array_distinct(F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))) for x in (a, b))
    most = F.greatest(F.size(left), F.size(right))
    return F.when(most > 0, F.size(F.array_intersect(left, right)) / most)


def numeric_prefix_is_zero(text: Column) -> Column:
    """Whether the number a text begins with is zero, a text without one counting as zero."""
    prefix = F.regexp_extract(text, r"^[ \t\n\x0b\f\r]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(prefix.try_cast("double"), F.lit(0.0)) == 0


def glob_matches(name: str, globs: str) -> bool:
    """Whether one of some patterns, | between them, is the name; * stands for any characters, ? for one."""
    wild = {"*": ".*", "?": "."}
    return any(re.fullmatch("".join(wild.get(c, re.escape(c)) for c in glob), name, re.S) for glob in globs.split("|"))
