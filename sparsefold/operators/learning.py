"""What feeds or applies models: per-observation records, splits, scaling, principal components, label transfer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsefold.operators.ranking import lot


def per_observation(x: DataFrame, items: Callable, schema: str) -> DataFrame:
    """items(pandas rows of whole observations, one after the other) -> pandas rows; schema is that of its result.

    A call gets as many observations as a batch holds, since a call for each costs far more than its few values. The rows of
    an observation stay together: those of a batch's last one wait for the next batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            if rows.empty:
                continue
            ids = rows["soma_dim_0"].to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))
            if cut:
                yield items(pd.concat([*held, rows.iloc[:cut]], ignore_index=True))
                held = []
            held.append(rows.iloc[cut:])
        if held:
            yield items(pd.concat(held, ignore_index=True))

    return x.repartition("soma_dim_0").sortWithinPartitions("soma_dim_0").mapInPandas(run, schema)


def split(df: DataFrame, test_share: float, id_col: str = "soma_joinid", seed: int = 0) -> DataFrame:
    """df with is_test, drawn by id: a row keeps its side whatever the partitioning or the rows around it."""
    draw = F.conv(F.substring(lot(id_col, seed), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("is_test", draw < int(test_share * (1 << 32)))


def scaled(x: DataFrame, n_obs: DataFrame, limit: float = 10.0) -> DataFrame:
    """z-scores of stored values over all observations, zeros included, cut off at limit. n_obs: one row, total."""
    v = F.col("soma_data").cast("double")
    sums = x.groupBy("soma_dim_1").agg(F.count(v).alias("n"), F.avg(v).alias("u"), (F.var_pop(v) * F.count(v)).alias("m2"))
    n, u, total = F.col("n"), F.col("u"), F.col("total")
    spread = sums.join(F.broadcast(n_obs)).select("soma_dim_1", (n * u / total).alias("mean"), F.sqrt((F.col("m2") + u * u * n * (total - n) / total) / (total - 1)).alias("sd"))
    z = F.when(F.col("sd") > 0, (v - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return x.join(spread, "soma_dim_1").select("soma_dim_0", "soma_dim_1", F.least(z, F.lit(limit)).alias("soma_data"))


def components(embeddings: DataFrame, k: int) -> DataFrame:
    """id and the first k principal components of a dense vector column."""
    from pyspark.ml.feature import PCA

    rows = embeddings.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="pc").fit(rows).transform(rows).select("id", vector_to_array("pc").alias("pc"))


def transferred(train: DataFrame, queries: DataFrame, trees: int = 20, seed: int = 0) -> DataFrame:
    """id, label, probability: labels that a random forest over train (id, vector, label) gives the queries (id, vector)."""
    from pyspark.ml.classification import RandomForestClassifier

    vectors = lambda df, *more: df.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"), *more)
    model = RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed, labelCol="label").fit(vectors(train, F.col("label").cast("double").alias("label")))
    out = model.transform(vectors(queries))
    return out.select("id", F.col("prediction").cast("int").alias("label"), F.array_max(vector_to_array("probability")).alias("probability"))
