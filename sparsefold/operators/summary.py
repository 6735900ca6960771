"""Counts over the observation axis, the corpus's summary and the difference of two corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per combination of values, most first."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns)


def unique_and_total(df: DataFrame, *columns: str) -> DataFrame:
    """Primary rows and all rows, per combination of values."""
    return df.groupBy(*columns).agg(F.count_if("is_primary_data").alias("unique_cell_count"), F.count(F.lit(1)).alias("total_cell_count"))


def summary_counts(obs: DataFrame, categories: list[str]) -> DataFrame:
    """category, label, unique and total counts: one row per value of each category, and one named all.

    One pass with grouping sets; labels are grouped on, so values of one category never fall together.
    """
    sets = F.array(F.struct(F.lit("all").alias("category"), F.lit("na").alias("label")), *[F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("label")) for c in categories])
    spread = obs.select("is_primary_data", F.explode(sets).alias("s")).select("is_primary_data", "s.category", "s.label")
    return unique_and_total(spread, "category", "label")


def corpus_summary(obs: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Distinct values of some columns per group, exact."""
    return obs.groupBy(by).agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns], F.count(F.lit(1)).alias("n_obs"))


def changed_counts(previous: DataFrame, current: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Keys of either side whose count differs, with previous, current and delta (0 where a side lacks a key)."""
    p = previous.select(*keys, F.col(count).alias("previous"))
    c = current.select(*keys, F.col(count).alias("current"))
    both = p.join(c, keys, "full_outer")
    before, after = F.coalesce("previous", F.lit(0)), F.coalesce("current", F.lit(0))
    return both.filter(before != after).select(*keys, before.alias("previous"), after.alias("current"), (after - before).alias("delta"))


def added_and_removed(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """key and change ("added" or "removed") for the keys of one side only."""
    gone = previous.select(key).join(current.select(key), key, "left_anti").withColumn("change", F.lit("removed"))
    new = current.select(key).join(previous.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    return gone.unionByName(new)


def explode_labels(df: DataFrame, column: str) -> DataFrame:
    """One row per value of a column that holds several, joined by ||."""
    return df.withColumn(column, F.explode(F.transform(F.split(column, r"\|\|"), lambda x: F.trim(x))))
