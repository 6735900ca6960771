"""Queries over joins of several tables, embeddings' metadata, learning and look-ups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sparsefold.operators import axis, ingest, learning, presence, ranking, summary, transform
from sparsefold.plans import fixture as fx
from sparsefold.plans.registry import query


@query(", c AS (SELECT dataset_id, count(*) AS n FROM obs GROUP BY 1), s AS (SELECT dataset_id, count(*) AS n_vars FROM presence GROUP BY 1) SELECT dataset_id, n, n_vars FROM c LEFT JOIN s USING (dataset_id)")
def join_counts_datasets(spark, d):
    counts = summary.value_counts(fx.obs(spark, d), "dataset_id")
    return counts.join(presence.features_per_dataset(fx.presence(spark, d)).withColumnRenamed("n_measured_vars", "n_vars"), "dataset_id", "left")


@query(", a AS (SELECT dataset_id, tissue, count(*) AS n FROM obs WHERE is_primary_data GROUP BY ALL), b AS (SELECT dataset_id, tissue, count(*) AS m FROM obs GROUP BY ALL) SELECT b.dataset_id, b.tissue, coalesce(n, 0) AS previous, m AS current, m - coalesce(n, 0) AS delta FROM b LEFT JOIN a USING (dataset_id, tissue) WHERE coalesce(n, 0) <> m")
def multi_key_join(spark, d):
    obs = fx.obs(spark, d)
    one = summary.value_counts(obs.filter("is_primary_data"), "dataset_id", "tissue")
    return summary.changed_counts(one, summary.value_counts(obs, "dataset_id", "tissue"), ["dataset_id", "tissue"], "n")


@query(", a AS (SELECT dataset_id, count(*) AS p FROM obs WHERE price < 150000 GROUP BY 1), b AS (SELECT dataset_id, count(*) AS c FROM obs WHERE price > 50000 GROUP BY 1) SELECT dataset_id, p AS previous, c AS current FROM a JOIN b USING (dataset_id) WHERE p <> c")
def self_version_join(spark, d):
    obs = fx.obs(spark, d)
    one, two = (summary.value_counts(obs.filter(p), "dataset_id") for p in ("price < 150000", "price > 50000"))
    return one.withColumnRenamed("n", "previous").join(two.withColumnRenamed("n", "current"), "dataset_id").filter("previous <> current")


@query(", s AS (SELECT dataset_id, count(*) AS n FROM presence GROUP BY 1) SELECT tissue, CAST(sum(n) AS BIGINT) AS measured FROM obs JOIN s USING (dataset_id) GROUP BY 1")
def presence_obs_join(spark, d):
    joined = presence.obs_with_measured(fx.obs(spark, d), fx.presence(spark, d))
    return joined.groupBy("tissue").agg(F.sum("n_measured_vars").alias("measured"))


@query(", g AS (SELECT DISTINCT dataset_id FROM obs), f AS (SELECT soma_joinid AS soma_dim_1 FROM var), c AS (SELECT dataset_id, soma_dim_1, count(*) AS n FROM x JOIN obs ON soma_dim_0 = soma_joinid GROUP BY ALL) SELECT g.dataset_id, f.soma_dim_1, coalesce(n, 0) AS n FROM g CROSS JOIN f LEFT JOIN c ON c.dataset_id = g.dataset_id AND c.soma_dim_1 = f.soma_dim_1")
def complete_grid(spark, d):
    """Every dataset with every feature. The datasets are few and are the side that is repeated."""
    obs = fx.obs(spark, d).select(F.col("soma_joinid").alias("soma_dim_0"), "dataset_id")
    chosen = fx.var(spark, d).select(F.col("soma_joinid").alias("soma_dim_1"))
    grid = chosen.crossJoin(obs.select("dataset_id").distinct())
    counts = fx.x(spark, d).join(chosen, "soma_dim_1", "left_semi").join(obs, "soma_dim_0").groupBy("dataset_id", "soma_dim_1").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["dataset_id", "soma_dim_1"], "left").select("dataset_id", "soma_dim_1", F.coalesce("n", F.lit(0)).alias("n"))


@query(", t AS (SELECT count(*) AS t FROM obs), s AS (SELECT soma_dim_1, sum(soma_data) / any_value(t) AS m, sqrt((sum(soma_data ** 2) - sum(soma_data) ** 2 / any_value(t)) / (any_value(t) - 1)) AS sd FROM x CROSS JOIN t GROUP BY 1) SELECT soma_dim_0, soma_dim_1, round(least((soma_data - m) / sd, 10), 5) AS soma_data FROM x JOIN s USING (soma_dim_1)")
def scale(spark, d):
    n = fx.obs(spark, d).agg(F.count(F.lit(1)).cast("double").alias("total"))
    return learning.scaled(fx.x(spark, d), n).withColumn("soma_data", F.round("soma_data", 5))


#: Records of submitted embeddings, made of the orders.
_META = "(SELECT o_orderpriority AS embedding_name, o_orderstatus AS organism, CAST(year(o_orderdate) AS VARCHAR) AS version, o_orderdate AS submission_date, o_orderkey AS id FROM orders) m"


def _metadata(spark, d):
    return fx.table(spark, d, "orders").select(F.col("o_orderpriority").alias("embedding_name"), F.col("o_orderstatus").alias("organism"), F.year("o_orderdate").cast("string").alias("version"), F.col("o_orderdate").alias("submission_date"), F.col("o_orderkey").alias("id"))


@query(f"SELECT embedding_name, organism, version, id FROM {_META} QUALIFY row_number() OVER (PARTITION BY embedding_name, organism, version ORDER BY submission_date DESC, id DESC) = 1", plain=True)
def embedding_metadata_latest(spark, d):
    keys = ["embedding_name", "organism", "version"]
    return ranking.latest(_metadata(spark, d), keys, "submission_date", "id").select(*keys, "id")


@query(f"SELECT id FROM {_META} WHERE version = '1998' AND organism = 'F'", plain=True)
def embedding_metadata_version(spark, d):
    return ingest.of_version(_metadata(spark, d), "1998", organism="F").select("id")


@query(f"SELECT DISTINCT version FROM {_META} WHERE embedding_name = '1-URGENT' AND organism = 'F'", plain=True)
def embedding_versions(spark, d):
    return ingest.versions(_metadata(spark, d), "1-URGENT", "F")


@query(
    "SELECT vec_id AS id, CAST(i AS INT) AS place, CAST(CASE WHEN v = 0 THEN 0 ELSE sign(v) * round_even(abs(v) / unit, 0) * unit END AS FLOAT) AS value "
    "FROM (SELECT *, pow(2.0, floor(log2(abs(v))) - 7) AS unit "
    "FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))",
    plain=True,
)
def embedding_quantise(spark, d):
    """Every element of the embeddings at 7 mantissa bits."""
    found = ingest.quantised(fx.embeddings(spark, d).select("id", "vector"), 7)
    return found.select("id", F.posexplode("vector").alias("place", "value"))


@query("SELECT soma_joinid, tissue, vec_id IS NOT NULL AS found, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM obs LEFT JOIN embeddings ON vec_id = soma_joinid WHERE tissue_general IN ('ASIA', 'EUROPE') AND is_primary_data")
def slice_with_embeddings(spark, d):
    """The observations of a slice, given in the surveyed grammar, with a named embedding; the matrix stays apart."""
    e = fx.embeddings(spark, d).select("id", "vector")
    found = axis.export(fx.slice_(spark, d, "tissue_general in ['ASIA', 'EUROPE'] and is_primary_data == True"), {"scvi": (e, 64)})
    v = F.col("scvi")[0].cast("double")
    return found["obs"].select("soma_joinid", "tissue", (~F.isnan(v)).alias("found"), F.when(~F.isnan(v), F.round(v, 6)).alias("first"))


_GENES = ", a AS (SELECT soma_dim_0, feature_name || '/' || feature_length AS feature_name, sum(soma_data) AS s FROM x JOIN var ON soma_dim_1 = soma_joinid JOIN obs o ON soma_dim_0 = o.soma_joinid WHERE o.tissue = 'NATION_1' AND feature_length < 30 GROUP BY ALL), b AS (SELECT soma_dim_0, feature_name || '/' || feature_length AS feature_name, sum(soma_data) AS s FROM x JOIN var ON soma_dim_1 = soma_joinid JOIN obs o ON soma_dim_0 = o.soma_joinid WHERE o.tissue = 'NATION_2' AND feature_length > 20 GROUP BY ALL)"


def _two_matrices(spark, d):
    obs, var, x = fx.obs(spark, d), fx.var(spark, d), fx.x(spark, d)
    out = []
    for tissue, length in (("NATION_1", "feature_length < 30"), ("NATION_2", "feature_length > 20")):
        names = var.filter(length).select(F.col("soma_joinid").alias("soma_dim_1"), F.concat_ws("/", "feature_name", "feature_length").alias("feature_name"))
        ids = obs.filter(F.col("tissue") == tissue).select(F.col("soma_joinid").alias("soma_dim_0"))
        out.append(x.join(names, "soma_dim_1").join(ids, "soma_dim_0", "left_semi").groupBy("soma_dim_0", F.col("feature_name").alias("feature_id")).agg(F.sum("soma_data").alias("soma_data")))
    return out


@query(f"{_GENES}, common AS (SELECT feature_name FROM a INTERSECT SELECT feature_name FROM b) SELECT soma_dim_0, feature_name AS feature_id, s AS soma_data FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE feature_name IN (SELECT feature_name FROM common)")
def concat_inner(spark, d):
    return transform.stacked(_two_matrices(spark, d), "inner")


@query(f"{_GENES} SELECT soma_dim_0, feature_name AS feature_id, s AS soma_data FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def concat_outer(spark, d):
    return transform.stacked(_two_matrices(spark, d), "outer")


@query(f"{_GENES} SELECT (SELECT count(*) FROM (SELECT feature_name FROM a INTERSECT SELECT feature_name FROM b)) AS shared, (SELECT count(*) FROM (SELECT feature_name FROM a EXCEPT SELECT feature_name FROM b)) AS only_first")
def disjoint_features(spark, d):
    from sparsefold.operators import validate

    return validate.disjoint(*_two_matrices(spark, d), "feature_id")


@query("SELECT soma_joinid FROM obs ORDER BY md5(CAST(soma_joinid AS VARCHAR) || '/3'), soma_joinid LIMIT (SELECT CAST(ceil(count(*) * 0.025) AS BIGINT) FROM obs)")
def sample_pct(spark, d):
    return ranking.sample_pct(fx.obs(spark, d).select("soma_joinid"), 2.5, seed=3)


@query("SELECT o_orderkey AS soma_joinid FROM orders WHERE o_orderkey IN (SELECT vec_id FROM embeddings)", plain=True)
def embedded_mask(spark, d):
    ids = fx.embeddings(spark, d).select(F.col("id").alias("soma_joinid"))
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("soma_joinid")).join(ids, "soma_joinid", "left_semi")


@query()
def embedding_components(spark, d):
    return learning.components(fx.embeddings(spark, d), 4)


@query()
def classifier_transfer(spark, d):
    e = learning.split(fx.embeddings(spark, d), 0.2, "id")
    return learning.transferred(e.filter("not is_test"), e.filter("is_test"))


@query("SELECT soma_joinid, CAST('0x' || substr(md5(CAST(soma_joinid AS VARCHAR) || '/0'), 1, 8) AS BIGINT) < 858993459 AS is_test FROM obs")
def train_test_split(spark, d):
    return learning.split(fx.obs(spark, d).select("soma_joinid"), 0.2)


@query("SELECT soma_dim_0, count(*) AS n, max(soma_data) AS top FROM x GROUP BY 1")
def dataset_builder(spark, d):
    def items(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.groupby("soma_dim_0", sort=False, as_index=False).agg(n=("soma_data", "size"), top=("soma_data", "max"))

    return learning.per_observation(fx.x(spark, d), items, "soma_dim_0 bigint, n bigint, top double")


@query("SELECT dataset_id, 's3://corpus/h5ads/' || CAST(dataset_id AS VARCHAR) || '.h5ad' AS uri FROM obs GROUP BY 1")
def source_uris(spark, d):
    from sparsefold.functions.text import join_path

    sets = fx.obs(spark, d).select("dataset_id").distinct()
    return sets.select("dataset_id", join_path(F.lit("s3://corpus/h5ads/"), F.concat(F.lit("/"), F.col("dataset_id").cast("string"), F.lit(".h5ad"))).alias("uri"))


@query("SELECT soma_joinid, soma_joinid % 2 = 0 AS even FROM obs WHERE soma_joinid BETWEEN 1000 AND 1500 AND price > 1000 AND tissue_general <> 'ASIA'")
def index_view(spark, d):
    """Nested views: a slice of a filtered slice composes into one scan."""
    from sparsefold.operators.axis import scan

    inner = scan(fx.obs(spark, d), "price > 1000", slice(1000, None))
    return scan(inner, "tissue_general <> 'ASIA'", slice(None, 1500)).select("soma_joinid", (F.col("soma_joinid") % 2 == 0).alias("even"))
