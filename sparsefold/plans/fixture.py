"""The driver's tables read as a corpus, for Spark and, with the same meaning, for SQL.

Orders are observations, parts features, line items the matrix (values of one coordinate summed), order years datasets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsefold.operators import presence as presence_ops
from sparsefold.operators.axis import AxisQuery, scan
from sparsefold.operators.places import parts
from sparsefold.operators.transform import sum_duplicates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("o_orderkey").alias("soma_joinid"), F.year("o_orderdate").cast("bigint").alias("dataset_id"), F.col("c_mktsegment").alias("cell_type"), F.col("o_orderpriority").alias("assay"), F.col("n_name").alias("tissue"), F.col("r_name").alias("tissue_general"),
        (F.col("o_orderstatus") != "P").alias("is_primary_data"), F.col("o_totalprice").alias("price"),
    )


def var(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("soma_joinid"), F.col("p_name").alias("feature_name"), F.col("p_type").alias("feature_type"), F.col("p_size").cast("bigint").alias("feature_length"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix as it comes: coordinates may repeat."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("soma_dim_0"), F.col("l_partkey").alias("soma_dim_1"), F.col("l_quantity").alias("soma_data"))


def x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sum_duplicates(entries(spark, sf_dir))


def x_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x dealt by rows of the matrix to tasks of a bounded size; sums by row need no further shuffle."""
    found = entries(spark, sf_dir)
    return sum_duplicates(found.repartition(parts(found.count()), "soma_dim_0"))


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("soma_dim_0"), F.year("o_orderdate").cast("bigint").alias("dataset_id"))
    return presence_ops.build(entries(spark, sf_dir).join(years, "soma_dim_0").select("dataset_id", F.col("soma_dim_1").alias("var_joinid")))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def slice_(spark: SparkSession, sf_dir: str, obs_filter=None, var_filter=None) -> AxisQuery:
    return AxisQuery(scan(obs(spark, sf_dir), obs_filter), scan(var(spark, sf_dir), var_filter), x(spark, sf_dir))


#: The same tables for DuckDB.
SQL = """WITH obs AS (
  SELECT o_orderkey AS soma_joinid, CAST(year(o_orderdate) AS BIGINT) AS dataset_id, c_mktsegment AS cell_type, o_orderpriority AS assay,
         n_name AS tissue, r_name AS tissue_general, o_orderstatus <> 'P' AS is_primary_data, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
var AS (SELECT p_partkey AS soma_joinid, p_name AS feature_name, p_type AS feature_type, CAST(p_size AS BIGINT) AS feature_length FROM part),
x AS (SELECT l_orderkey AS soma_dim_0, l_partkey AS soma_dim_1, sum(l_quantity) AS soma_data FROM lineitem GROUP BY ALL),
presence AS (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS dataset_id, l_partkey AS var_joinid FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""
