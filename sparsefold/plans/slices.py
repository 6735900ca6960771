"""Scans, filters, joins and sets over the axes and the matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparsefold.functions import text
from sparsefold.operators import axis, build, ranking, summary, transform
from sparsefold.plans import fixture as fx
from sparsefold.plans.registry import query


@query("SELECT soma_joinid, cell_type, price FROM obs WHERE tissue_general = 'EUROPE' AND soma_joinid BETWEEN 10 AND 5000")
def scan_obs(spark, d):
    return axis.scan(fx.obs(spark, d), "tissue_general = 'EUROPE'", slice(10, 5000), ["soma_joinid", "cell_type", "price"])


@query("SELECT soma_joinid, feature_name FROM var WHERE feature_length >= 25 AND soma_joinid IN (1, 5, 7, 11, 300)")
def scan_var(spark, d):
    return axis.scan(fx.var(spark, d), F.col("feature_length") >= 25, [1, 5, 7, 11, 300], ["soma_joinid", "feature_name"])


@query("SELECT * FROM x")
def scan_x(spark, d):
    return fx.x(spark, d)


@query("SELECT CAST(soma_dim_0 // 500 AS BIGINT) AS block, count(*) AS nnz, sum(soma_data) AS total FROM x GROUP BY ALL")
def scan_x_blockwise(spark, d):
    return axis.blockwise(fx.x(spark, d), 500).groupBy("block").agg(F.count(F.lit(1)).alias("nnz"), F.sum("soma_data").alias("total"))


@query("SELECT * FROM presence")
def scan_presence(spark, d):
    return fx.presence(spark, d)


@query("SELECT l_orderkey AS soma_dim_0, l_partkey AS soma_dim_1, sum(l_quantity) AS soma_data FROM lineitem GROUP BY ALL", plain=True)
def read_source_matrix(spark, d):
    return transform.sum_duplicates(fx.entries(spark, d))


@query("SELECT (SELECT count(*) FROM obs) AS n_obs, (SELECT count(*) FROM var) AS n_vars, (SELECT count(*) FROM x) AS nnz")
def introspect(spark, d):
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(fx.obs(spark, d), "n_obs").join(count(fx.var(spark, d), "n_vars")).join(count(fx.x(spark, d), "nnz"))


@query("SELECT vec_id AS soma_dim_0, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS soma_dim_1, round(CAST(unnest(embedding) AS DOUBLE), 6) AS soma_data FROM embeddings", plain=True)
def read_embedding_coo(spark, d):
    return fx.embeddings(spark, d).select(F.col("id").alias("soma_dim_0"), F.posexplode("vector").alias("soma_dim_1", "v")).select("soma_dim_0", "soma_dim_1", F.round(F.col("v").cast("double"), 6).alias("soma_data"))


@query("SELECT soma_joinid FROM obs WHERE (cell_type IN ('BUILDING', 'MACHINERY') AND price > 100000) OR tissue = 'NATION_3'")
def value_filter(spark, d):
    return axis.scan(fx.obs(spark, d), "(cell_type in ['BUILDING', 'MACHINERY'] and price > 100000) or tissue == 'NATION_3'", columns=["soma_joinid"])


@query("SELECT soma_joinid, tissue_general FROM obs WHERE tissue_general IN ('ASIA', 'AFRICA')")
def filter_eq_in(spark, d):
    return axis.scan(fx.obs(spark, d), F.col("tissue_general").isin("ASIA", "AFRICA"), columns=["soma_joinid", "tissue_general"])


@query("SELECT soma_joinid FROM obs WHERE cell_type IN ('BUILDING', 'HOUSEHOLD') AND assay <> '5-LOW'")
def filter_ne_and_in(spark, d):
    return axis.scan(fx.obs(spark, d), "cell_type in ('BUILDING', 'HOUSEHOLD') and assay != '5-LOW'", columns=["soma_joinid"])


@query("SELECT soma_dim_0 AS soma_joinid FROM x GROUP BY 1 HAVING count(*) >= 5")
def filter_numeric(spark, d):
    return fx.x(spark, d).groupBy(F.col("soma_dim_0").alias("soma_joinid")).agg(F.count(F.lit(1)).alias("nnz")).filter("nnz >= 5").select("soma_joinid")


@query("SELECT soma_joinid FROM obs WHERE is_primary_data")
def filter_bool(spark, d):
    return axis.scan(fx.obs(spark, d), "is_primary_data == true", columns=["soma_joinid"])


@query("SELECT soma_joinid FROM obs WHERE is_primary_data OR NOT is_primary_data")
def filter_or(spark, d):
    return axis.scan(fx.obs(spark, d), "is_primary_data == true or is_primary_data == false", columns=["soma_joinid"])


@query("SELECT soma_joinid FROM obs WHERE soma_joinid BETWEEN 100 AND 300")
def coord_filter(spark, d):
    return axis.scan(fx.obs(spark, d), coords=slice(100, 300), columns=["soma_joinid"])


@query("SELECT soma_joinid, price FROM obs WHERE soma_joinid % 3 = 0 AND soma_joinid < 9000")
def coord_list_join(spark, d):
    return axis.scan(fx.obs(spark, d), coords=list(range(0, 9000, 3)), columns=["soma_joinid", "price"])


@query("SELECT cell_type, tissue FROM obs")
def column_select(spark, d):
    return axis.scan(fx.obs(spark, d), columns=["cell_type", "tissue"])


@query("SELECT soma_joinid FROM obs WHERE assay IN ('1-URGENT', '2-HIGH') AND tissue_general IN ('ASIA', 'EUROPE') AND is_primary_data")
def cell_filter(spark, d):
    return build.cell_filter(fx.obs(spark, d).withColumn("tissue_type", F.col("tissue_general")), ["1-URGENT", "2-HIGH"], ("ASIA", "EUROPE"), primary_only=True).select("soma_joinid")


@query("SELECT soma_joinid FROM var WHERE feature_type = 'ECONOMY' AND feature_length = 10")
def gene_filter(spark, d):
    return build.gene_filter(fx.var(spark, d).withColumn("feature_biotype", F.when(F.col("feature_type") == "ECONOMY", "gene")).withColumn("feature_reference", F.col("feature_length").cast("string")), "10").select("soma_joinid")


@query("SELECT soma_joinid FROM obs WHERE EXISTS (SELECT 1 FROM var WHERE feature_length > 49)")
def empty_collapse(spark, d):
    return build.both_or_none(fx.obs(spark, d), fx.var(spark, d).filter("feature_length > 49")).select("soma_joinid")


@query("SELECT soma_joinid, concat_ws('|', cell_type, CAST(dataset_id AS VARCHAR)) AS batch FROM obs")
def derived_column(spark, d):
    from sparsefold.operators.hvg import batch_label

    return fx.obs(spark, d).select("soma_joinid", batch_label("cell_type", "dataset_id", separator="|").alias("batch"))


@query("SELECT soma_joinid FROM obs WHERE soma_joinid % 10 = 0")
def modulo_sample(spark, d):
    return ranking.modulo_sample(fx.obs(spark, d), 10).select("soma_joinid")


@query("SELECT DISTINCT dataset_id FROM obs WHERE tissue = 'NATION_1'")
def isin_subset(spark, d):
    obs = fx.obs(spark, d)
    return obs.select("dataset_id").distinct().join(obs.filter("tissue = 'NATION_1'").select("dataset_id"), "dataset_id", "left_semi")


@query("SELECT x.* FROM x WHERE soma_dim_0 IN (SELECT soma_joinid FROM obs WHERE tissue_general = 'ASIA' AND is_primary_data) AND soma_dim_1 IN (SELECT soma_joinid FROM var WHERE feature_type = 'PROMO')")
def axis_query(spark, d):
    return fx.slice_(spark, d, "tissue_general = 'ASIA' and is_primary_data", "feature_type = 'PROMO'").X


@query("SELECT (SELECT count(*) FROM obs WHERE tissue_general = 'ASIA') AS n_obs, (SELECT count(*) FROM var WHERE feature_length < 10) AS n_vars")
def axis_sizes(spark, d):
    return fx.slice_(spark, d, "tissue_general = 'ASIA'", "feature_length < 10").sizes()


@query("SELECT 'obs' AS part, count(*) AS n FROM obs WHERE cell_type = 'BUILDING' UNION ALL SELECT 'var', count(*) FROM var WHERE feature_length = 7 UNION ALL SELECT 'X', count(*) FROM x WHERE soma_dim_0 IN (SELECT soma_joinid FROM obs WHERE cell_type = 'BUILDING') AND soma_dim_1 IN (SELECT soma_joinid FROM var WHERE feature_length = 7)")
def export_slice(spark, d):
    q = fx.slice_(spark, d, "cell_type = 'BUILDING'", "feature_length = 7")
    n = lambda df, part: df.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n")).select("part", "n")
    return n(q.obs, "obs").union(n(q.var, "var")).union(n(q.X, "X"))


@query("SELECT dataset_id, soma_dim_1, count(*) AS n FROM x JOIN obs ON soma_dim_0 = soma_joinid GROUP BY ALL")
def cells_per_gene_by_dataset(spark, d):
    obs = fx.obs(spark, d).select(F.col("soma_joinid").alias("soma_dim_0"), "dataset_id")
    return fx.x(spark, d).join(obs, "soma_dim_0").groupBy("dataset_id", "soma_dim_1").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT soma_dim_0, soma_dim_1, soma_data, cell_type FROM x JOIN obs ON soma_dim_0 = soma_joinid WHERE is_primary_data")
def join_x_obs(spark, d):
    obs = fx.obs(spark, d).filter("is_primary_data").select(F.col("soma_joinid").alias("soma_dim_0"), "cell_type")
    return fx.x(spark, d).join(obs, "soma_dim_0").select("soma_dim_0", "soma_dim_1", "soma_data", "cell_type")


@query("SELECT soma_joinid, feature_name, n FROM var JOIN (SELECT soma_dim_1, count(*) AS n FROM x GROUP BY 1) ON soma_dim_1 = soma_joinid")
def join_stats_var(spark, d):
    stats = fx.x(spark, d).groupBy(F.col("soma_dim_1").alias("soma_joinid")).agg(F.count(F.lit(1)).alias("n"))
    return fx.var(spark, d).join(stats, "soma_joinid").select("soma_joinid", "feature_name", "n")


@query("SELECT l_orderkey AS soma_dim_0, p_partkey AS soma_dim_1, sum(l_quantity) AS soma_data FROM lineitem JOIN part ON 'F' || l_partkey = 'F' || p_partkey GROUP BY ALL", plain=True)
def rekey_var(spark, d):
    local = fx.x(spark, d).select("soma_dim_0", F.concat(F.lit("F"), F.col("soma_dim_1")).alias("feature_id"), "soma_data")
    ids = fx.var(spark, d).select(F.concat(F.lit("F"), F.col("soma_joinid")).alias("feature_id"), "soma_joinid")
    return transform.rekey(local, ids)


@query("SELECT soma_joinid, CASE WHEN soma_joinid % 2 = 0 THEN price + 1 ELSE price END AS price FROM obs")
def update_join(spark, d):
    old = fx.obs(spark, d).select("soma_joinid", "price")
    new = old.filter("soma_joinid % 2 = 0").withColumn("price", F.col("price") + 1)
    return build.updated(old, new, "soma_joinid", ["price"])


@query("SELECT o_orderkey AS soma_joinid FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", plain=True)
def anti_missing(spark, d):
    filled = fx.entries(spark, d).select(F.col("soma_dim_0").alias("soma_joinid"))
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("soma_joinid")).join(filled, "soma_joinid", "left_anti")


@query("SELECT 'B' || CAST(soma_joinid AS VARCHAR) AS id, 'a' AS part FROM var WHERE feature_length < 5 UNION ALL SELECT 'B' || CAST(soma_joinid AS VARCHAR), NULL FROM var WHERE feature_length > 47")
def union_obs(spark, d):
    var = fx.var(spark, d)
    one = lambda p: var.filter(p).select(F.concat(F.lit("B"), "soma_joinid").alias("id"))
    return build.union_obs([one("feature_length < 5").withColumn("part", F.lit("a")), one("feature_length > 47")])


@query("SELECT DISTINCT feature_name, feature_type FROM var WHERE feature_length < 30 UNION SELECT feature_name, feature_type FROM var WHERE feature_length > 20")
def union_var(spark, d):
    var = fx.var(spark, d)
    return build.union_var([var.filter("feature_length < 30"), var.filter("feature_length > 20")], ["feature_name", "feature_type"])


@query("SELECT feature_name FROM var WHERE feature_length < 10 INTERSECT SELECT feature_name FROM var WHERE feature_length > 40")
def intersect_genes(spark, d):
    var = fx.var(spark, d)
    return var.filter("feature_length < 10").select("feature_name").intersect(var.filter("feature_length > 40").select("feature_name"))


@query("SELECT name AS feature_name, change FROM (SELECT DISTINCT feature_name AS name, 'removed' AS change FROM var WHERE feature_length < 10 AND feature_name NOT IN (SELECT feature_name FROM var WHERE feature_length > 46) UNION ALL SELECT DISTINCT feature_name, 'added' FROM var WHERE feature_length > 46 AND feature_name NOT IN (SELECT feature_name FROM var WHERE feature_length < 10))")
def except_genes(spark, d):
    var = fx.var(spark, d)
    return summary.added_and_removed(var.filter("feature_length < 10").select("feature_name").distinct(), var.filter("feature_length > 46").select("feature_name").distinct(), "feature_name")


@query("SELECT lower(replace(feature_type, ' ', '_')) AS key, 'T:' || CAST(soma_joinid AS VARCHAR) AS term, split_part(feature_name, ' ', 1) AS first_word FROM var")
def string_functions(spark, d):
    from sparsefold.sources.corpus import organism_column

    return fx.var(spark, d).select(organism_column(F.col("feature_type")).alias("key"), text.ontology_id(F.concat(F.lit("T_"), "soma_joinid")).alias("term"), F.split_part("feature_name", F.lit(" "), F.lit(1)).alias("first_word"))


@query("SELECT soma_joinid, unnest(string_split(feature_name, ' ')) AS label FROM var")
def explode_labels(spark, d):
    named = fx.var(spark, d).select("soma_joinid", F.replace("feature_name", F.lit(" "), F.lit(" || ")).alias("label"))
    return summary.explode_labels(named, "label")


@query("SELECT dataset_id, string_agg(DISTINCT tissue_general, ', ' ORDER BY tissue_general) AS tissues FROM obs GROUP BY 1")
def sorted_join(spark, d):
    return fx.obs(spark, d).groupBy("dataset_id").agg(text.joined_set(F.col("tissue_general")).alias("tissues"))


@query("SELECT page_id, nullif(split_part(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/', 2), '') AS segment FROM pages", plain=True)
def uri_segment(spark, d):
    return fx.table(spark, d, "pages").select("page_id", F.nullif(text.path_segment(F.col("url"), 1), F.lit("")).alias("segment"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", plain=True)
def json_decode(spark, d):
    return fx.table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT soma_joinid, round(log10(price), 6) AS log10, round(sqrt(price), 6) AS root, round(ln(1 + price), 6) AS log1p, least(greatest(price, 1000.0), 100000.0) AS clamped, price = floor(price) AS whole FROM obs")
def math_functions(spark, d):
    p = F.col("price")
    return fx.obs(spark, d).select("soma_joinid", F.round(F.log10(p), 6).alias("log10"), F.round(F.sqrt(p), 6).alias("root"), F.round(F.log1p(p), 6).alias("log1p"), text.clamp(p, 1000.0, 100000.0).alias("clamped"), text.is_count(p).alias("whole"))


@query("SELECT soma_joinid, coalesce(CASE cell_type WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' END, 'unknown') AS cell_type FROM obs")
def map_lookup(spark, d):
    names = spark.createDataFrame([("BUILDING", "b"), ("MACHINERY", "m")], "key string, value string")
    return build.mapped(fx.obs(spark, d).select("soma_joinid", "cell_type"), "cell_type", names).select("soma_joinid", "cell_type")


@query("SELECT o_orderkey AS soma_joinid, o_orderdate < CAST('2000-01-01' AS DATE) - INTERVAL 30 DAY AS old FROM orders", plain=True)
def date_filter(spark, d):
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("soma_joinid"), (F.col("o_orderdate") < F.date_sub(F.to_date(F.lit("2000-01-01")), 30)).alias("old"))
