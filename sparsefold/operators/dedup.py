"""Equal rows of the matrix, by a digest of their (feature, value) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_digests(x: DataFrame) -> DataFrame:
    """soma_dim_0, digest: equal exactly for rows with the same values at the same features.

    A sum of 64-bit hashes of the pairs and their number, with a second sum under another seed: no order, no array.
    """
    pair = [F.col("soma_dim_1"), F.col("soma_data").cast("double")]
    lane = lambda seed: F.sum(F.xxhash64(*pair, F.lit(seed)).cast("decimal(38,0)"))
    return x.groupBy("soma_dim_0").agg(F.sha2(F.concat_ws("/", lane(1), lane(2), F.count(F.lit(1))), 256).alias("digest"))


def text_digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.sha2(F.col(text_col).cast("binary"), 256).alias("digest"))


def primaries(digests: DataFrame) -> DataFrame:
    """digest, copies and primaries for digests (digest, is_primary_data)."""
    return digests.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.count_if("is_primary_data").alias("primaries"))


def missing_primary(digests: DataFrame) -> DataFrame:
    """The rows whose digest has no primary copy."""
    return digests.join(primaries(digests).filter("primaries = 0").select("digest"), "digest", "left_semi")


def duplicate_primary(digests: DataFrame) -> DataFrame:
    """The rows whose digest has several primary copies."""
    return digests.join(primaries(digests).filter("primaries > 1").select("digest"), "digest", "left_semi")


def overlaps(digests: DataFrame, group: str) -> DataFrame:
    """The distinct sets of groups that share a digest, and how many digests each set shares."""
    sets = digests.select("digest", group).distinct().groupBy("digest").agg(F.array_sort(F.collect_set(group)).alias("groups")).filter(F.size("groups") > 1)
    return sets.groupBy("groups").agg(F.count(F.lit(1)).alias("n"))


def keep_first(df: DataFrame, digest: str, id_col: str) -> DataFrame:
    """The row with the smallest id of each digest."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(digest).orderBy(id_col))).filter("_place = 1").drop("_place")
