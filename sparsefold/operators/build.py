"""Building a corpus: filters on both axes, unions of datasets, the sources that are used, spatial tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsefold.operators.places import placed


def conform(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The named columns with their types, in order; missing ones are null. Raises for a column that can't be cast."""
    have = set(df.columns)
    return df.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields.items()])


def cell_filter(obs: DataFrame, assays: list[str], tissue_types=("tissue", "organoid"), primary_only: bool = False) -> DataFrame:
    """Observations of allowed assays on tissues and organoids."""
    kept = obs.filter(F.col("tissue_type").isin(*tissue_types) & F.col("assay").isin(*assays))
    return kept.filter("is_primary_data") if primary_only else kept


def gene_filter(var: DataFrame, reference: str) -> DataFrame:
    return var.filter((F.col("feature_biotype") == "gene") & (F.col("feature_reference") == reference))


def both_or_none(obs: DataFrame, var: DataFrame) -> DataFrame:
    """obs, or no rows where var has none."""
    return obs.join(var.limit(1).select(F.lit(1).alias("_any")).distinct()).drop("_any")


def union_obs(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def union_var(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    """The distinct features; one id under two names stays two rows."""
    return union_obs([p.select(*columns) for p in parts]).distinct()


def without_blocked(datasets: DataFrame, blocked: DataFrame) -> DataFrame:
    return datasets.join(blocked, "dataset_id", "left_anti")


def with_organism(datasets: DataFrame, allowed: list[str]) -> DataFrame:
    """Datasets any of whose organisms (an array of structs) is allowed."""
    return datasets.filter(F.exists("organism", lambda o: o["ontology_term_id"].isin(*allowed)))


def first_by_size(datasets: DataFrame, n: int) -> DataFrame:
    """The n smallest datasets, or the -n largest."""
    return datasets.orderBy(F.col("size").asc() if n > 0 else F.col("size").desc(), "dataset_id").limit(abs(n))


def prune_unused(datasets: DataFrame, obs: DataFrame) -> DataFrame:
    return datasets.join(obs.select("dataset_id").distinct(), "dataset_id", "left_semi")


def updated(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """old with the values of new where those aren't null."""
    fresh = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = old.join(fresh, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def mapped(df: DataFrame, column: str, table: DataFrame, default: str = "unknown") -> DataFrame:
    """A column's values replaced through table (key, value)."""
    return df.join(table.withColumnRenamed("key", column), column, "left").withColumn(column, F.coalesce("value", F.lit(default))).drop("value")


def spans(obs: DataFrame) -> DataFrame:
    """Per dataset its first id, its rows and whether its ids are one block."""
    found = obs.groupBy("dataset_id").agg(F.min("soma_joinid").alias("first"), F.max("soma_joinid").alias("last"), F.count(F.lit(1)).alias("n"))
    return found.select("dataset_id", "first", "n", (F.col("last") - F.col("first") + 1 == F.col("n")).alias("is_block"))


def scene_points(locations: DataFrame, obs: DataFrame) -> DataFrame:
    """scene_id, soma_joinid, y, x, radius from locations (dataset_id, row, y, x, spot_diameter), matched by row in the dataset.

    A row is its place among all observations less that of its dataset's first one, so no task numbers a whole dataset. Both
    sides are as long as the corpus, which Spark can't tell of locations that a few rows were exploded into: neither is broadcast.
    """
    ordered = placed(obs.select("dataset_id", "soma_joinid"), ["dataset_id", "soma_joinid"])
    first = ordered.groupBy("dataset_id").agg(F.min("place").alias("_first"))
    numbered = ordered.join(first, "dataset_id").select("dataset_id", (F.col("place") - F.col("_first")).alias("row"), "soma_joinid")
    radius = F.coalesce(F.col("spot_diameter") / 2, F.lit(2.0))
    return locations.hint("merge").join(numbered.hint("merge"), ["dataset_id", "row"]).select(F.col("dataset_id").alias("scene_id"), "soma_joinid", "y", "x", radius.alias("radius"))


def spatial_presence(obs: DataFrame) -> DataFrame:
    return obs.select("soma_joinid", F.col("dataset_id").alias("scene_id"), F.lit(True).alias("data"))
