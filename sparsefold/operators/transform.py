"""Transforms of the matrix: normalisation, scaling, collapsing and re-keying. Coordinates in, coordinates out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparsefold.functions.rounding import rounded


def sum_duplicates(x: DataFrame) -> DataFrame:
    """One value per coordinate: the sum of those given."""
    return x.groupBy("soma_dim_0", "soma_dim_1").agg(F.sum("soma_data").alias("soma_data"))


def eliminate_zeros(x: DataFrame) -> DataFrame:
    return x.filter(F.col("soma_data") != 0)


def row_total(value: Column) -> Column:
    return F.sum(value.cast("double")).over(Window.partitionBy("soma_dim_0"))


def normalise_rows(x: DataFrame, full_length: Column | None = None, length: Column | None = None) -> DataFrame:
    """Each value as its share of the row. Where full_length holds, values are divided by length first; both are Columns of x."""
    value = F.col("soma_data").cast("double")
    if full_length is not None:
        value = F.when(full_length, value / length).otherwise(value)
    return x.withColumn("_v", value).withColumn("_share", F.col("_v") / row_total(F.col("_v"))).select("soma_dim_0", "soma_dim_1", F.col("_share").alias("soma_data"))


def quantised(x: DataFrame, keep_bits: int = 15) -> DataFrame:
    """Values with fewer mantissa bits; stored values stay above 0."""
    return x.withColumn("soma_data", rounded(F.col("soma_data"), keep_bits, keep_positive=True))


def log_normalised(x: DataFrame, target: float = 1e4) -> DataFrame:
    """log(1 + share * target)."""
    return x.withColumn("soma_data", F.log1p(F.col("soma_data") / row_total(F.col("soma_data")) * target)).select("soma_dim_0", "soma_dim_1", "soma_data")


def collapse(x: DataFrame, mapping: DataFrame) -> DataFrame:
    """Features summed into those that mapping (soma_dim_1, model_feature) names; others fall away."""
    return x.join(mapping, "soma_dim_1").groupBy("soma_dim_0", "model_feature").agg(F.sum("soma_data").alias("soma_data"))


def median_scaled(x: DataFrame, medians: DataFrame, target: float = 1e4) -> DataFrame:
    """value * target / median of its feature / total of the full row, for the features of medians (soma_dim_1, median)."""
    totals = x.groupBy("soma_dim_0").agg(F.sum("soma_data").alias("total"))
    return x.join(medians, "soma_dim_1").join(totals, "soma_dim_0").select("soma_dim_0", "soma_dim_1", (F.col("soma_data") * target / F.col("median") / F.col("total")).alias("soma_data"))


def rekey(x: DataFrame, ids: DataFrame) -> DataFrame:
    """Local feature keys replaced by corpus-wide ids; ids: feature_id, soma_joinid. x: soma_dim_0, feature_id, soma_data."""
    return x.join(ids, "feature_id").select("soma_dim_0", F.col("soma_joinid").alias("soma_dim_1"), "soma_data")


def missing_features(x: DataFrame, ids: DataFrame) -> DataFrame:
    """Keys of x that ids lacks; re-keying is whole where this is empty."""
    return x.select("feature_id").distinct().join(ids, "feature_id", "left_anti")


def tokens(x: DataFrame, limit: int = 4096, start: int | None = None, end: int | None = None) -> DataFrame:
    """Per row its features by falling value, limit with the marks at most. x: soma_dim_0, soma_dim_1, soma_data.

    Ties go by feature id. A row's values come together in one array; a row is an observation, not a group that grows.
    """
    room = limit - (start is not None) - (end is not None)
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("soma_data")).alias("v"), F.col("soma_dim_1").alias("f"))))
    ids = F.transform(F.slice(pairs, 1, room), lambda p: p["f"])
    marks = [F.array(F.lit(m).cast("bigint")) if m is not None else F.array().cast("array<bigint>") for m in (start, end)]
    return x.groupBy("soma_dim_0").agg(ids.alias("ids")).select("soma_dim_0", F.concat(marks[0], "ids", marks[1]).alias("input_ids")).withColumn("length", F.size("input_ids"))


def stacked(parts: list[DataFrame], how: str) -> DataFrame:
    """Matrices (soma_dim_0, feature_id, soma_data) one after the other, over the features of all ("outer") or those that each
    of them has ("inner"). Observations must not repeat across parts."""
    if how not in ("inner", "outer"):
        raise ValueError("matrices are stacked inner or outer")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if how == "outer":
        return out
    shared = parts[0].select("feature_id").distinct()
    for p in parts[1:]:
        shared = shared.join(p.select("feature_id").distinct(), "feature_id", "left_semi")
    return out.join(shared, "feature_id", "left_semi").select("soma_dim_0", "feature_id", "soma_data")
