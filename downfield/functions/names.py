"""Player names as keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_tags(name: Column) -> Column:
    """Without tags in parentheses; spaces squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\([^)]*\)", ""), r"\s+", " "))


def normalized(name: Column) -> Column:
    """Key of a name: no tags, marks or letters beyond ASCII; lower case; no closing dots; one space after a comma."""
    plain = F.regexp_replace(F.translate(strip_tags(name), "™®©", ""), r"[^\x00-\x7F]", "")
    tight = F.regexp_replace(F.regexp_replace(F.lower(F.trim(plain)), r"\.+$", ""), r"\s*,\s*", ", ")
    return F.trim(F.regexp_replace(tight, r"\s+", " "))


def last_first(name: Column) -> Column:
    """'First Rest' to 'rest, f'; null with a comma or a single word."""
    words = F.split(normalized(name), " ")
    return F.when(~name.contains(",") & (F.size(words) >= 2), F.concat(F.array_join(F.slice(words, F.lit(2), F.size(words)), " "), F.lit(", "), F.substring(F.get(words, F.lit(0)), 1, 1)))


def initial_last(name: Column) -> Column:
    """'First … Last' of three words or more to 'last, f'; null otherwise."""
    words = F.split(normalized(name), " ")
    return F.when(~name.contains(",") & (F.size(words) >= 3), F.concat(F.element_at(words, -1), F.lit(", "), F.substring(F.get(words, F.lit(0)), 1, 1)))


def roster_key(name: Column, relaxed: bool) -> Column:
    """'last|f' from 'Last, F.' or 'First Last'; null without a last name.

    Relaxed drops suffixes (jr, sr, ii to v) and, in the second form, all but the last word.
    """
    plain = F.regexp_replace(F.lower(F.regexp_replace(F.translate(strip_tags(name), "™®©", ""), r"[^\x00-\x7F]", "")), r"\.+$", "")
    clean = lambda c: F.trim(F.regexp_replace(c, r"( (jr|sr|ii|iii|iv|v)\.?)+$", "")) if relaxed else F.trim(F.regexp_replace(c, r"\.+$", ""))
    comma = F.split(plain, ",", 2)
    words = F.split(F.trim(clean(plain) if relaxed else plain), r"\s+")
    rest = F.element_at(words, -1) if relaxed else F.array_join(F.when(F.size(words) > 1, F.slice(words, F.lit(2), F.size(words))).otherwise(words), " ")
    last = F.when(plain.contains(","), clean(F.trim(F.get(comma, F.lit(0))))).otherwise(clean(rest))
    initial = F.when(plain.contains(","), F.substring(F.trim(F.get(comma, F.lit(1))), 1, 1)).otherwise(F.substring(F.get(words, F.lit(0)), 1, 1))
    return F.when(last != "", F.concat(last, F.lit("|"), initial))
