"""Which dataset measured which feature. presence: dataset_id, var_joinid; a row says that it did."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(features: DataFrame) -> DataFrame:
    """From (dataset_id, var_joinid) lists with repeats."""
    return features.select("dataset_id", "var_joinid").distinct()


def features_per_dataset(presence: DataFrame) -> DataFrame:
    return presence.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_measured_vars"))


def measured_obs(presence: DataFrame, obs: DataFrame) -> DataFrame:
    """Per feature the number of observations of all datasets that measured it."""
    sizes = obs.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    return presence.join(sizes, "dataset_id").groupBy("var_joinid").agg(F.sum("n").alias("n_measured_obs"))


def measured_everywhere(presence: DataFrame, datasets: DataFrame) -> DataFrame:
    """Features that all of some datasets measured (relational division)."""
    wanted = datasets.agg(F.count(F.lit(1)).alias("wanted"))
    found = presence.join(datasets, "dataset_id", "left_semi").groupBy("var_joinid").agg(F.count(F.lit(1)).alias("n"))
    return found.join(F.broadcast(wanted)).filter("n = wanted").select("var_joinid")


def obs_with_measured(obs: DataFrame, presence: DataFrame) -> DataFrame:
    """obs with n_measured_vars, 0 where its dataset measured nothing."""
    return obs.join(features_per_dataset(presence), "dataset_id", "left").withColumn("n_measured_vars", F.coalesce("n_measured_vars", F.lit(0)))
