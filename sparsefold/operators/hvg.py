"""Highly variable features by variance after a fit of the mean-variance trend, per batch.

Two passes over the matrix are native aggregates; only the trend fit runs in Python, on one row per batch and feature with a
stored value. The second pass carries the fit's rows along, so the fit runs once, and the statistics over all batches are
merged from those of each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparsefold.functions.loess import loess
from sparsefold.operators.axis import AxisQuery
from sparsefold.operators.stats import batch_moments, corrected


def batch_label(*columns: str, separator: str = "\x1f"):
    """A batch from several columns. The separator keeps ("a", "bc") and ("ab", "c") apart; "" joins them plainly."""
    return F.concat_ws(separator, *[F.col(c).cast("string") for c in columns])


def trend(stats: DataFrame, span: float, max_jitter: float = 1e-6) -> DataFrame:
    """batch, soma_dim_1, n_obs, mean, reg_std and clip from batch statistics with every selected feature."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("soma_dim_1", ignore_index=True)
        u, v, n = pdf["mean"].to_numpy(), pdf["variance"].fillna(0).to_numpy(), pdf["n_obs"].iloc[0]
        varies = v > 0
        if n <= 1 or not varies.any():
            pdf["reg_std"], pdf["clip"] = 1.0, u
            return pdf
        x, y = np.log10(u[varies]), np.log10(v[varies])
        jitter = 0.0
        while True:
            try:
                noise = np.random.default_rng(0).uniform(-jitter, jitter, len(x)) if jitter else 0
                fitted = loess(x + noise, y, span)
                break
            except np.linalg.LinAlgError:
                jitter = jitter * 10 or 1e-18
                if jitter > max_jitter:
                    raise
        estimate = np.zeros(len(u))
        estimate[varies] = fitted
        pdf["reg_std"] = np.sqrt(10.0**estimate)
        pdf["clip"] = pdf["reg_std"] * np.sqrt(n) + u
        return pdf

    kept = stats.select("batch", "soma_dim_1", "n_obs", "mean", "variance")
    return kept.groupBy("batch").applyInPandas(fit, "batch string, soma_dim_1 bigint, n_obs double, mean double, variance double, reg_std double, clip double")


def ranked(scores: DataFrame, n_top: int) -> DataFrame:
    """From batch, soma_joinid, variances_norm: ranks per batch, their median below n_top, the order and the flag.

    Ties go by id: equal scores have no order of their own.
    """
    place = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("variances_norm"), "soma_joinid")) - 1
    top = F.col("rank") < n_top
    per_feature = scores.withColumn("rank", place).groupBy("soma_joinid").agg(F.count_if(top).alias("highly_variable_nbatches"), F.percentile(F.when(top, F.col("rank")), F.lit(0.5)).alias("highly_variable_rank"), F.avg("variances_norm").alias("variances_norm"))
    first = per_feature.orderBy(F.col("highly_variable_rank").asc_nulls_last(), F.desc("highly_variable_nbatches"), "soma_joinid").limit(n_top).select("soma_joinid", F.lit(True).alias("_first"))
    return per_feature.join(F.broadcast(first), "soma_joinid", "left").withColumn("highly_variable", F.col("_first").isNotNull()).drop("_first")


def highly_variable(q: AxisQuery, batch: list[str] | Column | None = None, n_top: int = 1000, span: float = 0.3) -> DataFrame:
    """Per feature: soma_joinid, means, variances, highly_variable_rank, variances_norm, highly_variable[, nbatches].

    batch: columns of obs, or an expression over them. Statistics of a batch count every selected observation, stored
    values or not; a feature without a stored value in a batch has variances_norm 0 there.
    """
    label = F.lit("") if batch is None else batch.cast("string") if isinstance(batch, Column) else batch_label(*batch)
    batches = q.obs.select(F.col("soma_joinid").alias("soma_dim_0"), label.alias("batch"))
    x = q.X.join(batches, "soma_dim_0")
    sizes = batches.groupBy("batch").agg(F.count(F.lit(1)).cast("double").alias("n_obs"))
    found = batch_moments(x)
    mean, variance = corrected(F.col("n"), F.col("u"), F.col("m2"), F.col("n_obs"))
    fitted = trend(found.join(sizes, "batch").select("batch", "soma_dim_1", "n_obs", mean.alias("mean"), variance.alias("variance")), span)
    capped = F.least(F.col("soma_data").cast("double"), F.col("clip"))
    sums = x.join(fitted, ["batch", "soma_dim_1"]).groupBy("batch", "soma_dim_1", "n_obs", "mean", "reg_std").agg(F.sum(capped).alias("s"), F.sum(capped * capped).alias("ss"))
    n, u = F.col("n_obs"), F.col("mean")
    spread = n * u * u + F.col("ss") - 2 * u * F.col("s")
    norm = F.when(n > 1, spread / ((n - 1) * F.col("reg_std") * F.col("reg_std"))).otherwise(0.0)
    scores = sums.select("batch", "soma_dim_1", norm.alias("score"))
    grid = sizes.select("batch").join(F.broadcast(q.var_ids))  # batches by features, both of them axes of the slice
    scores = grid.join(scores, ["batch", "soma_dim_1"], "left").select("batch", F.col("soma_dim_1").alias("soma_joinid"), F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)).alias("variances_norm"))
    # moments of all batches together, merged from those of each
    merged = found.groupBy("soma_dim_1").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("u")) / F.sum("n")).alias("u"), F.sum("m2").alias("within"), F.collect_list(F.struct("n", "u")).alias("each"))
    between = F.aggregate("each", F.lit(0.0), lambda t, b: t + b["n"] * (b["u"] - F.col("u")) * (b["u"] - F.col("u")))
    merged = merged.select("soma_dim_1", "n", "u", (F.col("within") + between).alias("m2"))
    total = sizes.agg(F.sum("n_obs").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    means, variances = corrected(zero("n"), zero("u"), zero("m2"), F.col("total"))
    whole = q.var_ids.join(merged, "soma_dim_1", "left").join(F.broadcast(total)).select(F.col("soma_dim_1").alias("soma_joinid"), means.alias("means"), variances.alias("variances"))
    out = whole.join(ranked(scores, n_top), "soma_joinid").select("soma_joinid", "means", "variances", "highly_variable_rank", "variances_norm", "highly_variable", "highly_variable_nbatches")
    return out if batch is not None else out.drop("highly_variable_nbatches")
