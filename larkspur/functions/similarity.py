"""Similarities of names, token sets and code lists, as column expressions over arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """How many different tokens both have."""
    return F.size(F.array_intersect(a, b))


def half_credit(a: Column, b: Column) -> Column:
    """Token similarity of names: 1 for each shared token, one half for each token of a that only shares an initial, over the union, at most 1."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    rest = F.array_except(b, a)
    half = F.size(F.filter(F.array_except(a, b), lambda x: F.exists(rest, lambda y: ((F.length(x) == 1) | (F.length(y) == 1)) & (F.substring(x, 1, 1) == F.substring(y, 1, 1)))))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.least(F.lit(1.0), (overlap(a, b) + half * 0.5) / union))


def first_score(a: Column, b: Column) -> Column:
    """1 for a shared first name, 0.8 if an initial of one side begins a name of the other, else 0."""
    by_initial = F.exists(a, lambda x: F.exists(b, lambda y: ((F.length(x) == 1) & y.startswith(x)) | ((F.length(y) == 1) & x.startswith(y))))
    return F.when(F.arrays_overlap(a, b), 1.0).when(by_initial, 0.8).otherwise(0.0)


def first_names_compatible(a: Column, b: Column) -> Column:
    """Some token of a equals one of b, or is the initial of one, either way."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (x == y) | ((F.length(x) == 1) & y.startswith(x)) | ((F.length(y) == 1) & x.startswith(y))))


def first_name_strings_compatible(a: Column, b: Column) -> Column:
    """The same for two strings of names; one without a name goes with any."""
    x, y = (F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit("[a-z]+"), F.lit(0)) for s in (a, b))
    return (F.size(x) == 0) | (F.size(y) == 0) | first_names_compatible(x, y)


def prefix_compatible(a: Column, b: Column, size: int = 3) -> Column:
    """Some tokens share their first letters, or one is an initial of the other."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (F.substring(x, 1, size) == F.substring(y, 1, size)) | ((F.length(x) == 1) & y.startswith(x)) | ((F.length(y) == 1) & x.startswith(y))))


def name_consistent(a: Column, b: Column) -> Column:
    """One name begins the other, as Ben does Benjamin; null or empty names are consistent with any."""
    a, b = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    return a.startswith(b) | b.startswith(a)


def single_first_name(names: Column) -> Column:
    """At most one different first token over all forms of a name."""
    return F.size(F.array_distinct(F.transform(names, lambda n: F.element_at(F.split(F.trim(F.lower(n)), r"\s+"), 1)))) <= 1
