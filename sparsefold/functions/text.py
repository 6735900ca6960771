"""Scalar functions on names, ids, paths and JSON, all as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ontology_id(x: Column, old: str = "_", new: str = ":") -> Column:
    """An ontology id with another separator; null unless it has exactly one of the old."""
    return F.when(F.length(x) - F.length(F.replace(x, F.lit(old), F.lit(""))) == len(old), F.replace(x, F.lit(old), F.lit(new)))


def joined_set(x: Column, separator: str = ", ") -> Column:
    """Aggregate: the distinct values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(x)), separator)


def path_segment(url: Column, number: int) -> Column:
    """A segment of a URL's path, counted from 1; null where there is none."""
    return F.get(F.split(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/"), F.lit(number))


def join_path(base: Column, relative: Column) -> Column:
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(relative, F.lit("/")))


def is_count(x: Column) -> Column:
    """Whether a number is whole and not negative."""
    return (x >= 0) & (x % 1 == 0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
