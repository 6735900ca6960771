"""The mean and variance of a stream of values per key, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def online_mean_variance(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Per key n, mean and variance (null below two values); write it in complete or update mode."""
    v = F.col(value).cast("double")
    return stream.groupBy(key).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"))
