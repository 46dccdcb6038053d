"""Column expressions over names: normalising, validity rules, keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions import fixed


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_name(c: Column) -> Column:
    """White space collapsed, accents removed, lower case."""
    return F.lower(F.translate(squeeze(c), fixed.ACCENTED, fixed.PLAIN))


@F.pandas_udf(T.StringType())
def _without_marks(names: pd.Series) -> pd.Series:
    """Canonical decomposition without the non-spacing marks."""
    bare = lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn")
    return names.map(bare, na_action="ignore")


def normalize_name_exact(c: Column) -> Column:
    """As normalize_name(), for any accent: names that hold only ASCII or listed letters stay native."""
    known = squeeze(c).rlike(f"^[\\x00-\\x7F{fixed.ACCENTED}]*$")
    odd = F.when(~known, squeeze(c))
    return F.coalesce(F.when(known, normalize_name(c)), F.lower(_without_marks(odd)))


def _verdict(*rules: tuple[str, Column]) -> Column:
    """struct(valid, reason) of the first rule that holds."""
    reason = None
    for name, rule in rules:
        reason = F.when(rule, name) if reason is None else reason.when(rule, name)
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"))


def person_validity(name: Column, mentions: Column) -> Column:
    """struct(valid, reason): ordered rules, the first that holds rejects the name."""
    n = F.trim(F.coalesce(name, F.lit("")), F.lit(" \n\t\r"))
    norm = normalize_name(n)
    words = F.split(norm, " ")
    few = F.size(words) <= 3
    return _verdict(
        ("empty", n == ""),
        ("broken_line", F.contains(n, F.lit("\n")) & (F.length(F.trim(F.replace(n, F.lit("\n"), F.lit("")))) < 15)),
        ("one_word", F.size(words) < 2),
        ("number", n.rlike(r"^\s*\d+\s*$")),
        ("ordinal", n.rlike(fixed.ORDINAL)),
        ("fragment", n.rlike(fixed.FRAGMENT) & few),
        ("noise", F.exists(F.array(*map(F.lit, fixed.PERSON_NOISE)), lambda s: F.contains(norm, s))),
        ("role", F.lower(n).isin(fixed.ROLES)),
        ("role_word", F.arrays_overlap(words, F.array(*map(F.lit, fixed.ROLES))) & few),
        ("rare_short", (mentions <= 2) & (F.size(words) <= 2)),
    )


def vehicle_validity(name: Column) -> Column:
    """struct(valid, reason) of a vehicle's name."""
    n = F.trim(F.coalesce(name, F.lit("")), F.lit(" \n\t\r"))
    low, norm = F.lower(n), normalize_name(n)
    digit = n.rlike(r"\d")
    letters = n.rlike(r"\p{L}")
    return _verdict(
        ("empty", n == ""),
        ("phrase", F.exists(F.array(*map(F.lit, fixed.VEHICLE_NOISE)), lambda s: F.contains(low, s))),
        ("colour", norm.isin(fixed.COLOURS)),
        ("make_model", norm.isin(fixed.MAKES)),
        ("hash", n.rlike(r"(?i)^[a-f0-9]{8,}$") | low.rlike(r"^(sha|sha1|sha256|sha512|md5|hash)[\d_-]?")),
        ("generic", norm.isin(fixed.GENERIC_VEHICLES)),
        ("short_no_digit", (F.length(norm) <= 4) & ~digit),
        ("short", (F.length(norm) <= 3) & ~n.rlike(r"^[A-Z]{3}[-\s]?\d{3,4}$")),
        ("fragment", low.rlike(r"^(de|del|la|el|los|las)\s") & (F.size(F.split(norm, " ")) <= 3)),
        ("generic_word", (n == low) & letters & (F.length(n) > 4) & ~digit & low.rlike("camion|pick|vagon")),
        ("short_make", (n == F.upper(n)) & letters & (F.length(n) <= 6) & ~digit & norm.isin(fixed.MAKES)),
    )


def weak_finding(c: Column, *, loose: bool = False) -> Column:
    """A finding that says nothing: null, shorter than 25 characters or worded as a placeholder."""
    if loose:
        return c.isNull() | (c == "") | F.exists(F.array(*map(F.lit, fixed.WEAK_FINDING_LOOSE)), lambda s: F.contains(F.lower(c), s))
    return c.isNull() | (F.length(F.trim(c)) < 25) | c.rlike(fixed.WEAK_FINDING)


def slug(c: Column) -> Column:
    """White space to `_`, other characters dropped, at most 80, `anon` if empty."""
    kept = F.regexp_replace(F.regexp_replace(F.trim(c), r"\s+", "_"), r"[^\p{L}\p{N}_-]", "")
    return F.coalesce(F.nullif(F.substring(kept, 1, 80), F.lit("")), F.lit("anon"))


def finding_key(c: Column) -> Column:
    return F.substring(F.lower(squeeze(c)), 1, 80)


def jaccard(a: Column, b: Column) -> Column:
    """Of the token sets of two normalised names."""
    x, y = F.split(a, " "), F.split(b, " ")
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
