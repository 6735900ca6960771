"""Checks of a built corpus, each a one-row table of counts of what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsefold.operators.places import parts


def global_ids(axis: DataFrame) -> DataFrame:
    """Rows, repeated ids, and whether the ids are 0..n-1."""
    ids = axis.groupBy("soma_joinid").agg(F.count(F.lit(1)).alias("n"))
    low, high, distinct = F.min("soma_joinid"), F.max("soma_joinid"), F.count(F.lit(1))
    return ids.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated"), ((low == 0) & (high == distinct - 1)).alias("dense"))


def unique_coords(x: DataFrame) -> DataFrame:
    return x.groupBy("soma_dim_0", "soma_dim_1").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"), F.sum("n").alias("nnz"))


def normalised(raw: DataFrame, norm: DataFrame, tolerance: float = 1e-4, rows: int | None = None) -> DataFrame:
    """Coordinates of one side only, values that aren't positive, rows that don't sum to 1, values off the raw share.

    rows, if known, says how many raw values there are; it sets the tasks.
    """
    keys = ["soma_dim_0", "soma_dim_1"]
    dealt = lambda df, *by: df if rows is None else df.repartition(parts(rows), *by)
    both = dealt(raw.select(*keys, F.col("soma_data").alias("r")), *keys).join(dealt(norm.select(*keys, F.col("soma_data").alias("n")), *keys), keys, "full_outer")
    both = dealt(both, "soma_dim_0")
    totals = both.groupBy("soma_dim_0").agg(F.sum("r").alias("rs"), F.sum("n").alias("ns"))
    sums = totals.agg(F.count_if(F.abs(F.col("ns") - 1) > tolerance).alias("bad_rows"))
    values = both.join(totals, "soma_dim_0").agg(F.count_if(F.col("r").isNull() | F.col("n").isNull()).alias("unmatched"), F.count_if(F.col("n") <= 0).alias("not_positive"), F.count_if(F.abs(F.col("n") - F.col("r") / F.col("rs")) > tolerance).alias("off"))
    return values.join(sums)


def contents(built: DataFrame, source: DataFrame) -> DataFrame:
    """Coordinates that only one side has or where values differ."""
    both = built.select("soma_dim_0", "soma_dim_1", F.col("soma_data").alias("a")).join(source.select("soma_dim_0", "soma_dim_1", F.col("soma_data").alias("b")), ["soma_dim_0", "soma_dim_1"], "full_outer")
    return both.agg(F.count_if(F.col("b").isNull()).alias("only_built"), F.count_if(F.col("a").isNull()).alias("only_source"), F.count_if(F.col("a") != F.col("b")).alias("differ"))


def consistent(obs_stats: DataFrame, var_stats: DataFrame, raw: DataFrame, norm: DataFrame) -> DataFrame:
    """The four counts of stored values, which must agree."""
    return obs_stats.agg(F.sum("nnz").alias("by_obs")).join(var_stats.agg(F.sum("nnz").alias("by_var"))).join(raw.agg(F.count(F.lit(1)).alias("in_raw"))).join(norm.agg(F.count(F.lit(1)).alias("in_norm")))


def presence_matches(presence: DataFrame, source: DataFrame) -> DataFrame:
    """Presence rows without a source feature and the other way round."""
    keys = ["dataset_id", "var_joinid"]
    a, b = presence.select(*keys), source.select(*keys).distinct()
    return a.join(b, keys, "left_anti").agg(F.count(F.lit(1)).alias("unfounded")).join(b.join(a, keys, "left_anti").agg(F.count(F.lit(1)).alias("missing")))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of each side that the other lacks, repeats counted."""
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_first")).join(b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_second")))


def measured(obs: DataFrame, var: DataFrame, presence: DataFrame) -> DataFrame:
    """Observations whose n_measured_vars and features whose n_measured_obs differ from what presence says."""
    per_set = presence.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_n"))
    sizes = obs.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_n"))
    per_feature = presence.join(sizes, "dataset_id").groupBy(F.col("var_joinid").alias("soma_joinid")).agg(F.sum("_n").alias("_n"))
    wrong = lambda df, by, key, column, name: df.join(by, key, "left").agg(F.count_if(~F.col(column).eqNullSafe(F.coalesce("_n", F.lit(0)))).alias(name))
    return wrong(obs, per_set, "dataset_id", "n_measured_vars", "bad_obs").join(wrong(var, per_feature, "soma_joinid", "n_measured_obs", "bad_var"))


def schema_faults(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """column_name, fault (missing, extra or type), wanted and found, for a table whose columns and types are wanted."""
    found = dict(df.dtypes)
    rows = [(c, "missing" if c not in found else "type", t, found.get(c)) for c, t in wanted.items() if found.get(c) != t]
    rows += [(c, "extra", None, t) for c, t in found.items() if c not in wanted]
    return df.sparkSession.createDataFrame(rows, "column_name string, fault string, wanted string, found string")


def layer(x: DataFrame, obs: DataFrame, var: DataFrame) -> DataFrame:
    """Stored values that are null, not above 0 or not finite, and coordinates that an axis doesn't have."""
    v = F.col("soma_data").cast("double")
    finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
    values = x.agg(F.count_if(v.isNull()).alias("null_values"), F.count_if(v <= 0).alias("not_positive"), F.count_if(~finite).alias("not_finite"))
    rows = obs.select(F.col("soma_joinid").alias("soma_dim_0"), F.lit(1).alias("_o"))
    columns = var.select(F.col("soma_joinid").alias("soma_dim_1"), F.lit(1).alias("_v"))
    off = x.join(rows, "soma_dim_0", "left").join(columns, "soma_dim_1", "left").agg(F.count_if(F.col("_o").isNull() | F.col("_v").isNull()).alias("off_axis"))
    return values.join(off)


def not_single(df: DataFrame, key: str, item: str) -> DataFrame:
    """Keys that don't have exactly one item, with n, how many they have."""
    return df.groupBy(key).agg(F.count(item).alias("n")).filter("n <> 1")


def missing_objects(spark: SparkSession, base: str, wanted: list[str]) -> list[str]:
    """The paths below base that aren't there or hold no file; asks the store itself, so any that Spark reaches will do."""
    out = []
    for name in wanted:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}")
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(path) or store.getFileStatus(path).isDirectory() and not len(store.listStatus(path)):
            out.append(name)
    return out


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many distinct keys both sides have (none: disjoint) and how many of a's b lacks (none: a subset)."""
    both = a.select(key).distinct().join(b.select(key).distinct().withColumn("_in", F.lit(1)), key, "left")
    return both.agg(F.count("_in").alias("shared"), F.count_if(F.col("_in").isNull()).alias("only_first"))


def obs_domains(obs: DataFrame, statistics: list[str], domains: dict[str, list[str]]) -> DataFrame:
    """column and faults: statistics that are null, negative or not finite, and values outside a column's domain; all columns have a row."""
    odd = lambda c: c.isNull() | F.isnan(c.cast("double")) | (c < 0) | (F.abs(c.cast("double")) == float("inf"))
    counts = [F.struct(F.lit(name).alias("column"), F.count_if(odd(F.col(name))).alias("faults")) for name in statistics]
    counts += [F.struct(F.lit(name).alias("column"), F.count_if(~F.coalesce(F.col(name).isin(*known), F.lit(False))).alias("faults")) for name, known in domains.items()]
    return obs.agg(F.array(*counts).alias("c")).select(F.inline("c"))
