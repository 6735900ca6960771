"""Aggregations, windows, transforms and highly variable features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparsefold.operators import hvg, presence, ranking, stats, summary, transform
from sparsefold.operators.build import spans
from sparsefold.plans import fixture as fx
from sparsefold.plans.registry import query

_SLICE = "tissue_general = 'EUROPE' and is_primary_data"
_PICK = """, o AS (SELECT soma_joinid FROM obs WHERE tissue_general = 'EUROPE' AND is_primary_data), v AS (SELECT soma_joinid FROM var WHERE feature_type <> 'PROMO'),
s AS (SELECT * FROM x WHERE soma_dim_0 IN (SELECT soma_joinid FROM o) AND soma_dim_1 IN (SELECT soma_joinid FROM v))"""


def _slice(spark, d):
    return fx.slice_(spark, d, _SLICE, "feature_type <> 'PROMO'")


def _r(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query(f"{_PICK}, g AS (SELECT soma_dim_1, sum(soma_data) AS a, sum(soma_data * soma_data) AS b FROM s GROUP BY 1), n AS (SELECT count(*) AS n FROM o) SELECT soma_joinid, round(coalesce(a, 0) / n, 6) AS mean, round((coalesce(b, 0) - coalesce(a, 0) * coalesce(a, 0) / n) / (n - 1), 6) AS variance FROM v CROSS JOIN n LEFT JOIN g ON soma_dim_1 = soma_joinid")
def variance_axis(spark, d):
    return _r(stats.mean_variance(_slice(spark, d)), "mean", "variance")


@query(f"{_PICK}, g AS (SELECT soma_dim_0, sum(soma_data) AS a, sum(soma_data * soma_data) AS b FROM s GROUP BY 1), n AS (SELECT count(*) AS n FROM v) SELECT soma_joinid, round(coalesce(a, 0) / n, 6) AS mean, round((coalesce(b, 0) - coalesce(a, 0) * coalesce(a, 0) / n) / n, 6) AS variance FROM o CROSS JOIN n LEFT JOIN g ON soma_dim_0 = soma_joinid")
def variance_axis_1(spark, d):
    return _r(stats.mean_variance(_slice(spark, d), axis=1, ddof=0), "mean", "variance")


@query(f"{_PICK}, g AS (SELECT soma_dim_1, sum(soma_data) AS a FROM s GROUP BY 1), n AS (SELECT count(*) AS n FROM o) SELECT soma_joinid, round(coalesce(a, 0) / n, 6) AS mean FROM v CROSS JOIN n LEFT JOIN g ON soma_dim_1 = soma_joinid")
def mean_axis(spark, d):
    return _r(stats.mean_variance(_slice(spark, d), variance=False), "mean")


@query(f"{_PICK} SELECT soma_joinid, round(avg(soma_data), 6) AS mean, round(var_samp(soma_data), 6) AS variance FROM v LEFT JOIN s ON soma_dim_1 = soma_joinid GROUP BY 1")
def mean_variance_nnz(spark, d):
    return _r(stats.mean_variance(_slice(spark, d), nnz_only=True), "mean", "variance")


@query(", n AS (SELECT dataset_id AS batch, count(*) AS n FROM obs GROUP BY 1) SELECT batch, soma_dim_1, round(sum(soma_data) / any_value(n), 6) AS mean, round((sum(soma_data * soma_data) - sum(soma_data) * sum(soma_data) / any_value(n)) / (any_value(n) - 1), 6) AS variance FROM x JOIN obs ON soma_dim_0 = soma_joinid JOIN n ON batch = dataset_id GROUP BY ALL")
def batch_meanvar(spark, d):
    batches = fx.obs(spark, d).select(F.col("soma_joinid").alias("soma_dim_0"), F.col("dataset_id").alias("batch"))
    ids = fx.var(spark, d).select(F.col("soma_joinid").alias("soma_dim_1"))
    return _r(stats.batch_mean_variance(fx.x(spark, d), batches, ids), "mean", "variance").select("batch", "soma_dim_1", "mean", "variance")


@query("SELECT dataset_id AS batch, soma_dim_1, sum(least(soma_data, 20.0 + soma_dim_1 % 7)) AS clipped_sum, sum(least(soma_data, 20.0 + soma_dim_1 % 7) ** 2) AS clipped_sum_sq FROM x JOIN obs ON soma_dim_0 = soma_joinid GROUP BY ALL")
def clipped_sums(spark, d):
    obs = fx.obs(spark, d)
    batches = obs.select(F.col("soma_joinid").alias("soma_dim_0"), F.col("dataset_id").alias("batch"))
    clips = obs.select(F.col("dataset_id").alias("batch")).distinct().join(F.broadcast(fx.var(spark, d).select(F.col("soma_joinid").alias("soma_dim_1")))).withColumn("clip", 20.0 + F.col("soma_dim_1") % 7)
    return stats.clipped_sums(fx.x(spark, d), batches, clips)


@query("SELECT soma_joinid, coalesce(sum(soma_data), 0) AS raw_sum, count(soma_data) AS nnz, round(coalesce(avg(soma_data), 0), 6) AS raw_mean_nnz, round(coalesce(var_samp(soma_data), 0), 6) AS raw_variance_nnz FROM obs LEFT JOIN x ON soma_dim_0 = soma_joinid GROUP BY 1")
def obs_stats(spark, d):
    ids = fx.obs(spark, d).select(F.col("soma_joinid").alias("soma_dim_0"))
    return _r(stats.obs_stats(fx.x(spark, d), ids), "raw_mean_nnz", "raw_variance_nnz")


@query("SELECT soma_joinid, count(soma_data) AS nnz FROM var LEFT JOIN x ON soma_dim_1 = soma_joinid GROUP BY 1")
def var_stats(spark, d):
    return stats.var_stats(fx.x(spark, d), fx.var(spark, d).select(F.col("soma_joinid").alias("soma_dim_1")))


@query(", n AS (SELECT dataset_id, count(*) AS n FROM presence GROUP BY 1) SELECT soma_joinid, coalesce(n, 0) AS n_measured_vars FROM obs LEFT JOIN n USING (dataset_id)")
def n_measured_vars(spark, d):
    return presence.obs_with_measured(fx.obs(spark, d), fx.presence(spark, d)).select("soma_joinid", "n_measured_vars")


@query(", n AS (SELECT dataset_id, count(*) AS n FROM obs GROUP BY 1) SELECT var_joinid, CAST(sum(n) AS BIGINT) AS n_measured_obs FROM presence JOIN n USING (dataset_id) GROUP BY 1")
def n_measured_obs(spark, d):
    return presence.measured_obs(fx.presence(spark, d), fx.obs(spark, d))


@query("SELECT dataset_id, count(*) AS n_measured_vars FROM presence GROUP BY 1")
def presence_row_sum(spark, d):
    return presence.features_per_dataset(fx.presence(spark, d))


@query("SELECT var_joinid FROM presence WHERE dataset_id IN (1996, 1998, 2000) GROUP BY 1 HAVING count(*) = 3")
def presence_col_all(spark, d):
    wanted = fx.obs(spark, d).filter(F.col("dataset_id").isin(1996, 1998, 2000)).select("dataset_id").distinct()
    return presence.measured_everywhere(fx.presence(spark, d), wanted)


@query("SELECT dataset_id, count(*) AS n FROM obs GROUP BY 1")
def dataset_counts(spark, d):
    return summary.value_counts(fx.obs(spark, d), "dataset_id")


@query("SELECT dataset_id, min(soma_joinid) AS first, count(*) AS n, max(soma_joinid) - min(soma_joinid) + 1 = count(*) AS is_block FROM obs GROUP BY 1")
def dataset_span(spark, d):
    return spans(fx.obs(spark, d))


@query("SELECT tissue, count(*) FILTER (is_primary_data) AS unique_cell_count, count(*) AS total_cell_count FROM obs GROUP BY 1")
def unique_vs_total(spark, d):
    return summary.unique_and_total(fx.obs(spark, d), "tissue")


_COUNTS = "count(*) FILTER (is_primary_data) AS unique_cell_count, count(*) AS total_cell_count FROM obs GROUP BY ALL"


@query(f"SELECT 'all' AS category, 'na' AS label, {_COUNTS} UNION ALL SELECT 'cell_type', cell_type, {_COUNTS} UNION ALL SELECT 'assay', assay, {_COUNTS} UNION ALL SELECT 'tissue_general', tissue_general, {_COUNTS}")
def summary_counts(spark, d):
    return summary.summary_counts(fx.obs(spark, d), ["cell_type", "assay", "tissue_general"])


@query("SELECT cell_type, tissue_general, count(*) AS n FROM obs GROUP BY ALL")
def value_counts(spark, d):
    return summary.value_counts(fx.obs(spark, d), "cell_type", "tissue_general")


@query("SELECT assay, dataset_id, count(*) AS n FROM obs GROUP BY ALL")
def group_size(spark, d):
    return fx.obs(spark, d).groupBy("assay", "dataset_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT tissue_general, count(DISTINCT tissue) AS n_tissue, count(DISTINCT cell_type) AS n_cell_type, count(DISTINCT dataset_id) AS n_dataset_id, count(*) AS n_obs FROM obs GROUP BY 1")
def corpus_summary(spark, d):
    return summary.corpus_summary(fx.obs(spark, d), "tissue_general", ["tissue", "cell_type", "dataset_id"])


@query("SELECT cell_type, count(DISTINCT tissue) FILTER (tissue_general = 'ASIA') AS asia, count(DISTINCT tissue) FILTER (tissue_general = 'EUROPE') AS europe FROM obs GROUP BY 1")
def nunique_pivot(spark, d):
    p = fx.obs(spark, d).groupBy("cell_type").pivot("tissue_general", ["ASIA", "EUROPE"]).agg(F.countDistinct("tissue"))
    return p.select("cell_type", F.coalesce("ASIA", F.lit(0)).alias("asia"), F.coalesce("EUROPE", F.lit(0)).alias("europe"))


@query("SELECT DISTINCT tissue_general, tissue FROM obs")
def distinct_values(spark, d):
    return fx.obs(spark, d).select("tissue_general", "tissue").distinct()


@query("SELECT tissue_general, min(tissue) AS tissue FROM obs GROUP BY 1")
def first_agg(spark, d):
    return fx.obs(spark, d).groupBy("tissue_general").agg(F.min("tissue").alias("tissue"))


@query("SELECT tissue_general, array_to_string(list_sort(list(DISTINCT CAST(dataset_id AS VARCHAR))), ',') AS datasets FROM obs GROUP BY 1")
def list_agg(spark, d):
    return fx.obs(spark, d).groupBy("tissue_general").agg(F.array_join(F.array_sort(F.collect_set(F.col("dataset_id").cast("string"))), ",").alias("datasets"))


@query("SELECT count(DISTINCT var_joinid) AS n_vars, count(DISTINCT dataset_id) AS n_datasets FROM presence")
def set_union_agg(spark, d):
    return fx.presence(spark, d).agg(F.countDistinct("var_joinid").alias("n_vars"), F.countDistinct("dataset_id").alias("n_datasets"))


@query("SELECT min(soma_dim_0) AS low_0, max(soma_dim_0) AS high_0, min(soma_dim_1) AS low_1, max(soma_dim_1) AS high_1, min(soma_data) AS low, max(soma_data) AS high FROM x")
def min_max_domain(spark, d):
    return fx.x(spark, d).agg(F.min("soma_dim_0").alias("low_0"), F.max("soma_dim_0").alias("high_0"), F.min("soma_dim_1").alias("low_1"), F.max("soma_dim_1").alias("high_1"), F.min("soma_data").alias("low"), F.max("soma_data").alias("high"))


@query("SELECT soma_dim_0, count(*) AS n_genes_by_counts, sum(soma_data) AS total_counts FROM x GROUP BY 1")
def qc_metrics(spark, d):
    return fx.x(spark, d).groupBy("soma_dim_0").agg(F.count(F.lit(1)).alias("n_genes_by_counts"), F.sum("soma_data").alias("total_counts"))


@query(", c AS (SELECT * FROM x WHERE soma_dim_0 IN (SELECT soma_dim_0 FROM x GROUP BY 1 HAVING count(*) >= 5)) SELECT * FROM c WHERE soma_dim_1 IN (SELECT soma_dim_1 FROM c GROUP BY 1 HAVING count(*) >= 10)")
def filter_cells_and_genes(spark, d):
    return stats.with_enough(fx.x(spark, d), 5, 10).select("soma_dim_0", "soma_dim_1", "soma_data")


@query(", t AS (SELECT soma_dim_0, sum(soma_data) AS t FROM x GROUP BY 1) SELECT soma_dim_1 AS soma_joinid, round(sum(soma_data / t) / (SELECT count(*) FROM obs), 9) AS mean_share FROM x JOIN t USING (soma_dim_0) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def highest_expr_genes(spark, d):
    ids = fx.obs(spark, d).select("soma_joinid")
    return _r(stats.highest_expressed(fx.x(spark, d), ids), "mean_share", places=9)


@query("SELECT cell_type, count(*) FILTER (assay = '1-URGENT') AS urgent, count(*) FILTER (assay = '5-LOW') AS low FROM obs GROUP BY 1")
def crosstab(spark, d):
    p = fx.obs(spark, d).groupBy("cell_type").pivot("assay", ["1-URGENT", "5-LOW"]).count()
    return p.select("cell_type", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low"))


@query("SELECT bool_and(soma_data > 0 AND soma_data = floor(soma_data)) AS all_counts FROM x")
def all_reduce(spark, d):
    return fx.x(spark, d).agg(F.bool_and((F.col("soma_data") > 0) & (F.col("soma_data") % 1 == 0)).alias("all_counts"))


@query("SELECT * FROM x WHERE soma_data % 3 <> 0")
def eliminate_zeros(spark, d):
    """A matrix in which each value divisible by 3 is stored as 0."""
    x = fx.x(spark, d)
    return transform.eliminate_zeros(x.withColumn("soma_data", F.when(F.col("soma_data") % 3 == 0, 0.0).otherwise(F.col("soma_data"))))


_LONG = "assay IN ('1-URGENT', '2-HIGH')"


@query(f", n AS (SELECT soma_dim_0, soma_dim_1, CASE WHEN {_LONG} THEN soma_data / feature_length ELSE soma_data END AS v FROM x JOIN obs o ON soma_dim_0 = o.soma_joinid JOIN var w ON soma_dim_1 = w.soma_joinid) SELECT soma_dim_0, soma_dim_1, round(v / sum(v) OVER (PARTITION BY soma_dim_0), 6) AS soma_data FROM n")
def normalize_rows(spark, d):
    obs = fx.obs(spark, d).select(F.col("soma_joinid").alias("soma_dim_0"), F.col("assay").isin("1-URGENT", "2-HIGH").alias("long"))
    var = fx.var(spark, d).select(F.col("soma_joinid").alias("soma_dim_1"), "feature_length")
    joined = fx.x(spark, d).join(var, "soma_dim_1").join(obs, "soma_dim_0")
    return _r(transform.normalise_rows(joined, F.col("long"), F.col("feature_length")), "soma_data")


@query(", s AS (SELECT soma_dim_0, soma_dim_1, CAST(CAST(soma_data / sum(soma_data) OVER (PARTITION BY soma_dim_0) AS FLOAT) AS DOUBLE) AS v FROM x), e AS (SELECT *, pow(2.0, floor(log2(v)) - 15) AS unit FROM s) SELECT soma_dim_0, soma_dim_1, CAST(round_even(v / unit, 0) * unit AS FLOAT) AS soma_data FROM e")
def quantise(spark, d):
    return transform.quantised(transform.normalise_rows(fx.x(spark, d)))


@query("SELECT soma_dim_0, soma_dim_1, round(ln(1 + soma_data / sum(soma_data) OVER (PARTITION BY soma_dim_0) * 10000), 6) AS soma_data FROM x")
def log_normalise(spark, d):
    return _r(transform.log_normalised(fx.x(spark, d)), "soma_data")


@query("SELECT soma_dim_0, feature_name AS model_feature, sum(soma_data) AS soma_data FROM x JOIN var ON soma_dim_1 = soma_joinid WHERE feature_length > 5 GROUP BY ALL")
def gene_collapse(spark, d):
    mapping = fx.var(spark, d).filter("feature_length > 5").select(F.col("soma_joinid").alias("soma_dim_1"), F.col("feature_name").alias("model_feature"))
    return transform.collapse(fx.x_by_row(spark, d), mapping)


@query(", t AS (SELECT soma_dim_0, sum(soma_data) AS t FROM x GROUP BY 1) SELECT soma_dim_0, soma_dim_1, round(soma_data * 10000 / feature_length / t, 6) AS soma_data FROM x JOIN t USING (soma_dim_0) JOIN var ON soma_dim_1 = soma_joinid WHERE feature_type = 'PROMO'")
def median_scale(spark, d):
    medians = fx.var(spark, d).filter("feature_type = 'PROMO'").select(F.col("soma_joinid").alias("soma_dim_1"), F.col("feature_length").alias("median"))
    return _r(transform.median_scaled(fx.x(spark, d), medians), "soma_data")


@query(", r AS (SELECT soma_dim_0, soma_dim_1, row_number() OVER (PARTITION BY soma_dim_0 ORDER BY soma_data DESC, soma_dim_1) AS p FROM x) SELECT soma_dim_0, '9001,' || string_agg(CAST(soma_dim_1 AS VARCHAR), ',' ORDER BY p) || ',9002' AS input_ids, CAST(count(*) + 2 AS INT) AS length FROM r WHERE p <= 4 GROUP BY 1")
def token_rank(spark, d):
    found = transform.tokens(fx.x(spark, d), 6, 9001, 9002)
    return found.select("soma_dim_0", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"), "length")


def _scores(spark, d):
    """batch, soma_joinid, variances_norm: whole numbers that stand in for scores, with ties."""
    batches = fx.obs(spark, d).select(F.col("soma_joinid").alias("soma_dim_0"), F.col("dataset_id").alias("batch"))
    return fx.x(spark, d).join(batches, "soma_dim_0").groupBy("batch", F.col("soma_dim_1").alias("soma_joinid")).agg(F.sum("soma_data").alias("variances_norm"))


_SCORES = ", sc AS (SELECT dataset_id AS batch, soma_dim_1 AS soma_joinid, sum(soma_data) AS variances_norm FROM x JOIN obs ON soma_dim_0 = obs.soma_joinid GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY variances_norm DESC, soma_joinid) - 1 AS r FROM sc)"


@query(f"{_SCORES} SELECT batch, soma_joinid, r AS rank FROM rk")
def rank_per_batch(spark, d):
    w = Window.partitionBy("batch").orderBy(F.desc("variances_norm"), "soma_joinid")
    return _scores(spark, d).select("batch", "soma_joinid", (F.row_number().over(w) - 1).cast("bigint").alias("rank"))


@query(f"{_SCORES}, f AS (SELECT soma_joinid, count(*) FILTER (r < 100) AS highly_variable_nbatches, median(r) FILTER (r < 100) AS highly_variable_rank, avg(variances_norm) AS variances_norm FROM rk GROUP BY 1) SELECT soma_joinid, highly_variable_nbatches, highly_variable_rank, round(variances_norm, 6) AS variances_norm, row_number() OVER (ORDER BY highly_variable_rank ASC NULLS LAST, highly_variable_nbatches DESC, soma_joinid) <= 100 AS highly_variable FROM f")
def topn_flag(spark, d):
    return _r(hvg.ranked(_scores(spark, d), 100), "variances_norm")


@query()
def highly_variable_genes(spark, d):
    return hvg.highly_variable(fx.slice_(spark, d), ["dataset_id"], 100)


@query()
def highly_variable_genes_unbatched(spark, d):
    return hvg.highly_variable(fx.slice_(spark, d, "is_primary_data"), None, 100)


@query("SELECT soma_joinid FROM obs ORDER BY md5(CAST(soma_joinid AS VARCHAR) || '/7'), soma_joinid LIMIT 200")
def sample_n(spark, d):
    return ranking.sample_n(fx.obs(spark, d).select("soma_joinid"), 200, seed=7)


@query("SELECT soma_joinid, tissue FROM obs QUALIFY row_number() OVER (PARTITION BY tissue ORDER BY md5(CAST(soma_joinid AS VARCHAR) || '/0'), soma_joinid) <= 5")
def per_group_sample(spark, d):
    return ranking.sample_per_group(fx.obs(spark, d).select("soma_joinid", "tissue"), "tissue", 5)


@query("SELECT soma_joinid, CAST(ntile(7) OVER (ORDER BY soma_joinid) - 1 AS BIGINT) AS shard FROM obs")
def shard_assign(spark, d):
    ids = fx.obs(spark, d).select("soma_joinid")
    return ranking.shards(ids, 7, ids.count())


@query("SELECT soma_joinid AS old_id, row_number() OVER (ORDER BY dataset_id, soma_joinid) - 1 AS soma_joinid FROM obs")
def assign_joinid(spark, d):
    old = fx.obs(spark, d).select("dataset_id", F.col("soma_joinid").alias("old_id"))
    return ranking.dense_ids(old, ["old_id"], "dataset_id").select("old_id", "soma_joinid")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1", plain=True)
def latest_version(spark, d):
    orders = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return ranking.latest(orders, ["c_custkey"], "o_orderdate", "o_orderkey").select("c_custkey", "o_orderkey")


@query("SELECT tissue, count(*) AS n FROM obs GROUP BY 1 ORDER BY n DESC, tissue LIMIT 10")
def top10_counts(spark, d):
    return summary.value_counts(fx.obs(spark, d), "tissue").limit(10)


@query("SELECT tissue, cell_type, n FROM (SELECT tissue, cell_type, count(*) AS n FROM obs GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY tissue ORDER BY n DESC, cell_type) = 1")
def mode_per_cluster(spark, d):
    return ranking.mode_per_group(fx.obs(spark, d), "tissue", "cell_type")
