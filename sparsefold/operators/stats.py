"""Sparse-aware statistics: zeros that aren't stored count, and every selected id has a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparsefold.operators.axis import AxisQuery

DIMS = ("soma_dim_0", "soma_dim_1")


def corrected(n: Column, mean: Column, m2: Column, total: Column, ddof: int = 1) -> tuple[Column, Column]:
    """Mean and variance over total cells, from count, mean and summed squares of the n stored ones.

    The zeros are merged in as a second sample of mean 0. The variance is null where total <= ddof.
    """
    mean_all = n * mean / total
    m2_all = m2 + mean * mean * n * (total - n) / total
    return mean_all, F.when(total - ddof > 0, m2_all / (total - ddof))


def mean_variance(q: AxisQuery, axis: int = 0, ddof: int = 1, nnz_only: bool = False, variance: bool = True) -> DataFrame:
    """Per feature over observations (axis 0) or per observation over features (axis 1): soma_joinid, mean[, variance].

    Without nnz_only the cells that aren't stored are zeros. With it, ids without a stored value have nulls. One
    aggregation over the matrix, then a left join from the ids; the other axis only lends its size.
    """
    kept, ids, others = (DIMS[1], q.var_ids, q.obs) if axis == 0 else (DIMS[0], q.obs_ids, q.var)
    x = F.col("soma_data").cast("double")
    found = q.X.groupBy(kept).agg(F.count(x).alias("n"), F.avg(x).alias("u"), (F.var_pop(x) * F.count(x)).alias("m2"))
    joined = ids.join(found, kept, "left")
    if nnz_only:
        out = joined.select(F.col(kept).alias("soma_joinid"), F.col("u").alias("mean"), F.when(F.col("n") - ddof > 0, F.col("m2") / (F.col("n") - ddof)).alias("variance"))
    else:
        size = others.agg(F.count(F.lit(1)).cast("double").alias("total"))
        n, u, m2 = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("n", "u", "m2"))
        mean, var = corrected(n, u, m2, F.col("total"), ddof)
        out = joined.join(F.broadcast(size)).select(F.col(kept).alias("soma_joinid"), mean.alias("mean"), var.alias("variance"))
    return out if variance else out.drop("variance")


def batch_mean_variance(x: DataFrame, batches: DataFrame, var_ids: DataFrame, ddof: int = 1) -> DataFrame:
    """Per batch and feature with a stored value: mean and variance over all cells of the batch.

    batches: soma_dim_0, batch. Features without a value in a batch have mean and variance 0 there and no row.
    """
    sizes = batches.groupBy("batch").agg(F.count(F.lit(1)).cast("double").alias("total"))
    found = batch_moments(x.join(batches, "soma_dim_0").join(var_ids, "soma_dim_1", "left_semi"))
    mean, var = corrected(F.col("n"), F.col("u"), F.col("m2"), F.col("total"), ddof)
    return found.join(sizes, "batch").select("batch", "soma_dim_1", F.col("total").alias("n_obs"), mean.alias("mean"), var.alias("variance"))


def batch_moments(x: DataFrame) -> DataFrame:
    """Per batch and feature: n, u and m2 (count, mean and summed squares) of the stored values. x has a column batch."""
    v = F.col("soma_data").cast("double")
    return x.groupBy("batch", "soma_dim_1").agg(F.count(v).cast("double").alias("n"), F.avg(v).alias("u"), (F.var_pop(v) * F.count(v)).alias("m2"))


def clipped_sums(x: DataFrame, batches: DataFrame, clips: DataFrame) -> DataFrame:
    """Per batch and feature: sum and sum of squares of min(value, clip). clips: batch, soma_dim_1, clip."""
    capped = F.least(F.col("soma_data").cast("double"), F.col("clip"))
    return x.join(batches, "soma_dim_0").join(clips, ["batch", "soma_dim_1"]).groupBy("batch", "soma_dim_1").agg(F.sum(capped).alias("clipped_sum"), F.sum(capped * capped).alias("clipped_sum_sq"))


def obs_stats(x: DataFrame, obs_ids: DataFrame) -> DataFrame:
    """Per observation: raw_sum, nnz, raw_mean_nnz and raw_variance_nnz (0 below two values)."""
    v = F.col("soma_data").cast("double")
    found = x.groupBy("soma_dim_0").agg(F.sum(v).alias("s"), F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("v"))
    zero = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    return obs_ids.join(found, "soma_dim_0", "left").select(F.col("soma_dim_0").alias("soma_joinid"), zero("s").alias("raw_sum"), F.coalesce("n", F.lit(0)).cast("bigint").alias("nnz"), zero("m").alias("raw_mean_nnz"), zero("v").alias("raw_variance_nnz"))


def var_stats(x: DataFrame, var_ids: DataFrame) -> DataFrame:
    """Per feature: nnz."""
    found = x.groupBy("soma_dim_1").agg(F.count("soma_data").alias("n"))
    return var_ids.join(found, "soma_dim_1", "left").select(F.col("soma_dim_1").alias("soma_joinid"), F.coalesce("n", F.lit(0)).cast("bigint").alias("nnz"))


def highest_expressed(x: DataFrame, obs_ids: DataFrame, k: int = 20) -> DataFrame:
    """The k features with the largest mean share of an observation's total, over all observations."""
    totals = x.groupBy("soma_dim_0").agg(F.sum(F.col("soma_data").cast("double")).alias("total"))
    n = obs_ids.agg(F.count(F.lit(1)).cast("double").alias("n"))
    shares = x.join(totals, "soma_dim_0").groupBy("soma_dim_1").agg(F.sum(F.col("soma_data") / F.col("total")).alias("s"))
    return shares.join(F.broadcast(n)).select(F.col("soma_dim_1").alias("soma_joinid"), (F.col("s") / F.col("n")).alias("mean_share")).orderBy(F.desc(F.round("mean_share", 9)), "soma_joinid").limit(k)


def with_enough(x: DataFrame, min_features: int, min_obs: int) -> DataFrame:
    """The matrix of observations with min_features values, then of features found in min_obs of those."""
    cells = x.groupBy("soma_dim_0").agg(F.count("soma_data").alias("n")).filter(F.col("n") >= min_features).select("soma_dim_0")
    kept = x.join(cells, "soma_dim_0", "left_semi")
    genes = kept.groupBy("soma_dim_1").agg(F.count("soma_data").alias("n")).filter(F.col("n") >= min_obs).select("soma_dim_1")
    return kept.join(genes, "soma_dim_1", "left_semi")
