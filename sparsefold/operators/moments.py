"""Mergeable statistics as a table: per dataset and feature the count, mean and summed squares of its stored values.

A corpus grows by datasets. append() computes and writes the moments of new ones alone, each in a partition of its own
that a repeated run replaces; merged() combines all of them by the rule for parallel variances, in two sums that are free of
cancellation: the mean first, then the summed squares around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparsefold.operators.stats import batch_moments, corrected


def of_datasets(x: DataFrame, obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moments, sizes). moments: dataset_id, soma_dim_1, n, u, m2; sizes: dataset_id, n_obs. obs: soma_joinid, dataset_id."""
    names = obs.select(F.col("soma_joinid").alias("soma_dim_0"), F.col("dataset_id").alias("batch"))
    found = batch_moments(x.join(names, "soma_dim_0")).withColumnRenamed("batch", "dataset_id")
    return found, obs.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_obs"))


def append(x: DataFrame, obs: DataFrame, path: str) -> None:
    """Write moments and sizes of the datasets in obs below path; those that it has already are replaced, others stay unread."""
    for table, name in zip(of_datasets(x, obs), ("moments", "sizes"), strict=True):
        table.repartition("dataset_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/moments"), spark.read.parquet(f"{path}/sizes")


def merged(moments: DataFrame, by: str = "soma_dim_1") -> DataFrame:
    """by, n, u and m2 over all datasets."""
    whole = Window.partitionBy(by)
    centre = moments.withColumn("_u", F.sum(F.col("n") * F.col("u")).over(whole) / F.sum("n").over(whole))
    around = F.col("m2") + F.col("n") * (F.col("u") - F.col("_u")) * (F.col("u") - F.col("_u"))
    return centre.groupBy(by).agg(F.sum("n").alias("n"), F.first("_u").alias("u"), F.sum(around).alias("m2"))


def mean_variance(moments: DataFrame, sizes: DataFrame, ddof: int = 1) -> DataFrame:
    """soma_joinid, mean, variance of every feature with a stored value over all observations, zeros included."""
    total = sizes.agg(F.sum("n_obs").cast("double").alias("total"))
    mean, variance = corrected(F.col("n"), F.col("u"), F.col("m2"), F.col("total"), ddof)
    return merged(moments).crossJoin(F.broadcast(total)).select(F.col("soma_dim_1").alias("soma_joinid"), mean.alias("mean"), variance.alias("variance"))  # one row
