"""Embeddings, duplicates, ontology, versions, differences, validators and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparsefold.operators import build, dedup, embedding, ontology, ranking, release, summary, transform, validate
from sparsefold.plans import fixture as fx
from sparsefold.plans.registry import query


@query("SELECT CAST(i AS BIGINT) AS pos, 3 * i - 20 AS id, embedding IS NOT NULL AS found, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM range(400) r(i) LEFT JOIN embeddings ON vec_id = 3 * i - 20", plain=True)
def get_embedding(spark, d):
    wanted = spark.range(400).select(F.col("id").alias("pos"), (3 * F.col("id") - 20).alias("id"))
    found = embedding.lookup(wanted, fx.embeddings(spark, d).select("id", "vector"), 64)
    v = F.col("vector")[0].cast("double")
    return found.select("pos", "id", (~F.isnan(v)).alias("found"), F.when(~F.isnan(v), F.round(v, 6)).alias("first"))


_NEAREST = """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0),
e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS w, label FROM embeddings),
n AS (SELECT query_id, id, label, sqrt(list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance FROM q CROSS JOIN e
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 10)
"""


def _neighbours(spark, d):
    e = fx.embeddings(spark, d)
    return embedding.nearest(e.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), e, 10)


@query(f"{_NEAREST} SELECT query_id, id, round(distance, 5) AS distance FROM n", plain=True)
def find_nearest_obs(spark, d):
    return _neighbours(spark, d).select("query_id", "id", F.round("distance", 5).alias("distance"))


@query(f"{_NEAREST}, c AS (SELECT query_id, label, count(*) AS n FROM n GROUP BY ALL) SELECT query_id, label, n / 10 AS confidence FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1", plain=True)
def predict_obs_metadata(spark, d):
    return embedding.predict(_neighbours(spark, d), fx.embeddings(spark, d).select("id", "label"))


@query(f"{_NEAREST} SELECT query_id, label, count(*) AS n FROM n GROUP BY ALL", plain=True)
def neighbour_categories(spark, d):
    return _neighbours(spark, d).join(fx.embeddings(spark, d).select("id", "label"), "id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query()
def find_nearest_ivf(spark, d):
    e = fx.embeddings(spark, d).select("id", "vector")
    queries, centroids = e.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), embedding.train_ivf(e)
    return embedding.nearest_ivf(queries, e, centroids, 10, embedding.calibrated_probes(queries, e, centroids, 10))


_DIRTY_EMBEDDINGS = """WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 11 = 0 THEN embedding[1:63] WHEN vec_id % 13 = 0 THEN list_prepend(CAST('nan' AS FLOAT), embedding[2:]) ELSE embedding END AS v FROM embeddings
UNION ALL SELECT vec_id, embedding FROM embeddings WHERE vec_id % 7 = 0)
"""


@query(f"""{_DIRTY_EMBEDDINGS} SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT id FROM e GROUP BY 1 HAVING count(*) > 1)) AS repeated,
count(*) FILTER (id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 1)) AS off_axis, count(*) FILTER (len(v) <> 64) AS wrong_length, count(*) FILTER (len(list_filter(v, lambda x: isnan(x) OR isinf(x))) > 0) AS not_finite FROM e""", plain=True)
def embedding_validate(spark, d):
    """Faults of many kinds put into the embeddings."""
    e = fx.embeddings(spark, d).select("id", "vector")
    short, nan = F.slice("vector", 1, 63), F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice("vector", 2, 63))
    dirty = e.withColumn("vector", F.when(F.col("id") % 11 == 0, short).when(F.col("id") % 13 == 0, nan).otherwise(F.col("vector")))
    return embedding.violations(dirty.unionByName(e.filter("id % 7 = 0")), fx.obs(spark, d).filter("soma_joinid % 3 <> 1"), 64)


_REACH = """, RECURSIVE_UP AS (SELECT DISTINCT tissue AS term, tissue AS ancestor, 0 AS distance FROM obs UNION SELECT DISTINCT tissue_general, tissue_general, 0 FROM obs
UNION SELECT 'WORLD', 'WORLD', 0 UNION SELECT DISTINCT tissue, tissue_general, 1 FROM obs UNION SELECT DISTINCT tissue_general, 'WORLD', 1 FROM obs UNION SELECT DISTINCT tissue, 'WORLD', 2 FROM obs)
"""


def _parents(spark, d):
    obs = fx.obs(spark, d)
    up = obs.select(F.col("tissue").alias("term"), F.col("tissue_general").alias("parent")).distinct()
    return up.union(up.select(F.col("parent").alias("term"), F.lit("WORLD").alias("parent")).distinct())


@query(f"{_REACH} SELECT term, ancestor, distance FROM RECURSIVE_UP")
def ancestors_closure(spark, d):
    return ontology.closure(_parents(spark, d))


@query("SELECT DISTINCT tissue AS term, CASE WHEN tissue_general IN ('ASIA', 'EUROPE') THEN tissue_general ELSE tissue END AS general FROM obs")
def tissue_general(spark, d):
    curated = spark.createDataFrame([("ASIA", 1), ("EUROPE", 2)], "ancestor string, priority int")
    return ontology.roll_up(fx.obs(spark, d).select(F.col("tissue").alias("term")).distinct(), ontology.closure(_parents(spark, d)), curated)


@query("SELECT soma_joinid FROM obs WHERE tissue_general = 'ASIA'")
def descendants_filter(spark, d):
    below = ontology.descendants(ontology.closure(_parents(spark, d)), "ASIA")
    obs = fx.obs(spark, d)
    return obs.join(F.broadcast(below), obs["tissue"] == below["term"], "left_semi").select("soma_joinid")


@query("SELECT text, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1", plain=True)
def duplicate_texts(spark, d):
    docs = fx.table(spark, d, "documents")
    same = dedup.text_digests(docs, "doc_id", "text").groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("doc_id")).filter("copies > 1")
    return same.join(docs.select("doc_id", "text"), "doc_id").select("text", "copies")


_ROWS = ", h AS (SELECT soma_dim_0, string_agg(soma_dim_1 % 5 || ':' || soma_data, ',' ORDER BY soma_dim_1 % 5) AS k FROM (SELECT soma_dim_0, soma_dim_1 % 5 AS soma_dim_1, CAST(sum(soma_data) % 4 AS INT) AS soma_data FROM x GROUP BY ALL) GROUP BY 1), p AS (SELECT h.*, is_primary_data, dataset_id FROM h JOIN obs ON soma_dim_0 = soma_joinid), c AS (SELECT k, CAST(count_if(is_primary_data) AS BIGINT) AS n FROM p GROUP BY 1)"


def _digests(spark, d):
    """A coarse matrix (five features, values mod 4), so that equal rows exist."""
    coarse = transform.sum_duplicates(fx.x(spark, d).withColumn("soma_dim_1", F.col("soma_dim_1") % 5)).withColumn("soma_data", F.col("soma_data") % 4)
    obs = fx.obs(spark, d).select(F.col("soma_joinid").alias("soma_dim_0"), "is_primary_data", "dataset_id")
    return dedup.row_digests(coarse).join(obs, "soma_dim_0")


@query(f"{_ROWS} SELECT soma_dim_0, n AS primaries FROM p JOIN c USING (k)")
def cell_hash(spark, d):
    rows = _digests(spark, d)
    return rows.join(dedup.primaries(rows), "digest").select("soma_dim_0", "primaries")


@query(f"{_ROWS} SELECT dataset_id, count(*) AS n FROM p JOIN c USING (k) WHERE n = 0 GROUP BY 1")
def missing_primary(spark, d):
    return dedup.missing_primary(_digests(spark, d)).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_ROWS} SELECT soma_dim_0 FROM p JOIN c USING (k) WHERE n > 1")
def duplicate_primary(spark, d):
    return dedup.duplicate_primary(_digests(spark, d)).select("soma_dim_0")


@query(f"{_ROWS}, s AS (SELECT k, array_to_string(list_sort(list(DISTINCT dataset_id)), ',') AS datasets FROM p GROUP BY 1 HAVING count(DISTINCT dataset_id) > 1) SELECT datasets, count(*) AS n FROM s GROUP BY 1")
def overlap_sets(spark, d):
    return dedup.overlaps(_digests(spark, d), "dataset_id").select(F.array_join(F.col("groups").cast("array<string>"), ",").alias("datasets"), "n")


#: A directory of versions made of the suppliers: every third one is an alias of another, some of which dangle or go in circles.
_VERSIONS = """WITH RECURSIVE v AS (SELECT 'v' || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'v' || ((s_suppkey * 7 + 3) % 97) END AS target,
  DATE '2020-01-01' + s_nationkey * 50 AS release_date, CASE WHEN s_nationkey % 4 > 0 THEN s_acctbal > 4000 END AS lts, CASE WHEN s_nationkey % 3 > 0 THEN s_suppkey % 5 = 1 END AS retracted, s_suppkey % 7 = 1 AS do_not_delete FROM supplier),
chase(name, reached, steps) AS (SELECT name, target, 1 FROM v WHERE target IS NOT NULL UNION ALL SELECT chase.name, v.target, steps + 1 FROM chase JOIN v ON chase.reached = v.name WHERE v.target IS NOT NULL AND steps <= (SELECT count(*) FROM v)),
resolved AS (SELECT name, name AS concrete, false AS is_alias FROM v WHERE target IS NULL UNION ALL SELECT DISTINCT chase.name, chase.reached, true FROM chase JOIN v ON chase.reached = v.name WHERE v.target IS NULL),
directory AS (SELECT resolved.*, release_date, lts, retracted FROM resolved JOIN v ON concrete = v.name)
"""


def _versions(spark, d):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    name = lambda k: F.concat(F.lit("v"), k.cast("string"))
    return fx.table(spark, d, "supplier").select(
        name(key).alias("name"), F.when(key % 3 == 0, name((key * 7 + 3) % 97)).alias("target"), F.date_add(F.lit("2020-01-01").cast("date"), nation * 50).alias("release_date"),
        F.when(nation % 4 > 0, F.col("s_acctbal") > 4000).alias("lts"), F.when(nation % 3 > 0, key % 5 == 1).alias("retracted"), (key % 7 == 1).alias("do_not_delete"),
    )


@query(f"{_VERSIONS} SELECT name, concrete, is_alias, row_number() OVER (ORDER BY is_alias DESC, name DESC) AS place FROM directory WHERE NOT coalesce(retracted, false)", plain=True)
def version_directory(spark, d):
    """The directory in its order; place numbers its few rows."""
    from pyspark.sql import Window

    found = release.directory(_versions(spark, d)).select("name", "concrete", "is_alias")
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("is_alias"), F.desc("name"))))


@query(f"{_VERSIONS} SELECT name FROM directory WHERE coalesce(lts, false) AND NOT coalesce(retracted, false)", plain=True)
def flag_filter(spark, d):
    return release.directory(_versions(spark, d), lts=True).select("name")


@query(f"{_VERSIONS} SELECT name, concrete, CAST(release_date AS VARCHAR) AS release_date, coalesce(lts, false) AS lts, coalesce(retracted, false) AS retracted FROM directory WHERE name = 'v4' OR name = 'v6'", plain=True)
def version_description(spark, d):
    both = release.description(_versions(spark, d), "v4").unionByName(release.description(_versions(spark, d), "v6"))
    return both.select("name", "concrete", F.col("release_date").cast("string").alias("release_date"), "lts", "retracted")


@query("SELECT n_name AS mirror, 's3://' || lower(r_name) || '/' || n_name || '/' AS base_uri, n_nationkey = 3 AS is_default FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'", plain=True)
def mirror_directory(spark, d):
    """Mirrors made of the nations; those of one provider are not supported."""
    places = fx.table(spark, d, "nation").join(fx.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    uri = F.concat(F.lit("s3://"), F.lower("r_name"), F.lit("/"), F.col("n_name"), F.lit("/"))
    mirrors = places.select(F.col("n_name").alias("mirror"), F.when(F.col("r_name") == "ASIA", "other").otherwise("S3").alias("provider"), uri.alias("base_uri"))
    default = fx.table(spark, d, "nation").filter("n_nationkey = 3").select(F.col("n_name").alias("mirror"))
    return release.mirrors(mirrors, default)


@query(f"{_VERSIONS} SELECT name FROM v WHERE target IS NULL AND release_date < DATE '2022-06-15' - 180 AND NOT do_not_delete AND name NOT IN (SELECT concrete FROM resolved WHERE is_alias)", plain=True)
def release_cleanup(spark, d):
    return release.removable(_versions(spark, d), "2022-06-15", 180)


@query(f"{_VERSIONS} SELECT name, CASE WHEN target IS NOT NULL AND name NOT IN (SELECT name FROM resolved) THEN 'dangling alias' ELSE 'alias of a retracted release' END AS fault FROM v WHERE target IS NOT NULL AND (name NOT IN (SELECT name FROM resolved) OR name IN (SELECT name FROM directory WHERE is_alias AND retracted))", plain=True)
def release_validate(spark, d):
    return release.faults(_versions(spark, d))


@query(", a AS (SELECT tissue, count(*) AS p FROM obs WHERE dataset_id < 2000 GROUP BY 1), b AS (SELECT tissue, count(*) AS c FROM obs WHERE dataset_id > 1996 AND tissue <> 'NATION_4' GROUP BY 1) SELECT tissue, coalesce(p, 0) AS previous, coalesce(c, 0) AS current, coalesce(c, 0) - coalesce(p, 0) AS delta FROM a FULL JOIN b USING (tissue) WHERE coalesce(p, 0) <> coalesce(c, 0)")
def corpus_diff(spark, d):
    obs = fx.obs(spark, d)
    one = summary.value_counts(obs.filter("dataset_id < 2000"), "tissue")
    two = summary.value_counts(obs.filter("dataset_id > 1996 and tissue <> 'NATION_4'"), "tissue")
    return summary.changed_counts(one, two, ["tissue"], "n")


@query("SELECT dataset_id, change FROM (SELECT DISTINCT dataset_id, 'removed' AS change FROM obs WHERE dataset_id < 1997 UNION SELECT DISTINCT dataset_id, 'added' FROM obs WHERE dataset_id > 1999)")
def added_removed_datasets(spark, d):
    ids = fx.obs(spark, d).select("dataset_id").distinct()
    return summary.added_and_removed(ids.filter("dataset_id < 2000"), ids.filter("dataset_id > 1996"), "dataset_id")


@query(", a AS (SELECT soma_joinid FROM obs WHERE soma_joinid % 50 <> 7 UNION ALL SELECT soma_joinid FROM obs WHERE soma_joinid % 20 = 0), g AS (SELECT soma_joinid, count(*) AS n FROM a GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n > 1) AS repeated, min(soma_joinid) = 0 AND max(soma_joinid) = count(*) - 1 AS dense FROM g")
def validate_global_ids(spark, d):
    """An axis with gaps and repeats."""
    obs = fx.obs(spark, d).select("soma_joinid")
    return validate.global_ids(obs.filter("soma_joinid % 50 <> 7").unionByName(obs.filter("soma_joinid % 20 = 0")))


@query("SELECT count(*) AS rows, 0 AS repeated, min(soma_joinid) = 0 AND max(soma_joinid) = count(*) - 1 AS dense FROM obs")
def validate_global_ids_clean(spark, d):
    return validate.global_ids(fx.obs(spark, d)).withColumn("repeated", F.col("repeated").cast("int"))


@query("SELECT count(*) FILTER (n > 1) AS repeated, CAST(sum(n) AS BIGINT) AS nnz FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey)", plain=True)
def validate_unique_coords(spark, d):
    return validate.unique_coords(fx.entries(spark, d))


_FAULT = "(soma_dim_0 * 31 + soma_dim_1) % 101"


@query(f""", s AS (SELECT soma_dim_0, soma_dim_1, {_FAULT} AS f, soma_data / sum(soma_data) OVER (PARTITION BY soma_dim_0) AS share FROM x),
n AS (SELECT soma_dim_0, soma_dim_1, CASE f WHEN 1 THEN share * 2 WHEN 2 THEN -share ELSE share END AS n FROM s WHERE f <> 0 UNION ALL SELECT soma_dim_0, soma_dim_1 + 10000000, 0.5 FROM s WHERE f = 3),
b AS (SELECT soma_dim_0, soma_dim_1, soma_data AS r, n FROM x FULL JOIN n USING (soma_dim_0, soma_dim_1)), t AS (SELECT soma_dim_0, sum(r) AS rs, sum(n) AS ns FROM b GROUP BY 1)
SELECT count(*) FILTER (r IS NULL OR n IS NULL) AS unmatched, count(*) FILTER (n <= 0) AS not_positive, count(*) FILTER (abs(n - r / rs) > 1e-4) AS off, (SELECT count(*) FROM t WHERE abs(ns - 1) > 1e-4) AS bad_rows FROM b JOIN t USING (soma_dim_0)""")
def validate_normalized(spark, d):
    """Shares that are doubled, negative, lost or too many."""
    raw, f = fx.x_by_row(spark, d), F.expr(_FAULT)
    norm = transform.normalise_rows(raw)
    v = F.col("soma_data")
    dirty = norm.filter(f != 0).withColumn("soma_data", F.when(f == 1, v * 2).when(f == 2, -v).otherwise(v))
    extra = norm.filter(f == 3).select("soma_dim_0", (F.col("soma_dim_1") + 10_000_000).alias("soma_dim_1"), F.lit(0.5).alias("soma_data"))
    return validate.normalised(raw, dirty.unionByName(extra), rows=fx.entries(spark, d).count())


@query(f""", b AS (SELECT soma_dim_0, soma_dim_1, CASE WHEN {_FAULT} = 1 THEN soma_data + 1 ELSE soma_data END AS a FROM x WHERE {_FAULT} <> 0 UNION ALL SELECT soma_dim_0, soma_dim_1 + 10000000, soma_data FROM x WHERE {_FAULT} = 2)
SELECT count(*) FILTER (soma_data IS NULL) AS only_built, count(*) FILTER (a IS NULL) AS only_source, count(*) FILTER (a <> soma_data) AS differ FROM b FULL JOIN x USING (soma_dim_0, soma_dim_1)""")
def validate_contents(spark, d):
    """A built matrix with values that are changed, lost or too many."""
    x, f = fx.x(spark, d), F.expr(_FAULT)
    built = x.filter(f != 0).withColumn("soma_data", F.when(f == 1, F.col("soma_data") + 1).otherwise(F.col("soma_data")))
    return validate.contents(built.unionByName(x.filter(f == 2).withColumn("soma_dim_1", F.col("soma_dim_1") + 10_000_000)), x)


@query(f"SELECT count(*) AS by_obs, count(*) FILTER (soma_dim_1 % 9 <> 0) AS by_var, count(*) AS in_raw, count(*) FILTER ({_FAULT} <> 0) AS in_norm FROM x")
def validate_consistency(spark, d):
    """Counts of stored values that do not agree: features and normalised values are missing."""
    from sparsefold.operators import stats

    raw = fx.x(spark, d)
    by_obs = stats.obs_stats(raw, fx.obs(spark, d).select(F.col("soma_joinid").alias("soma_dim_0")))
    by_var = stats.var_stats(raw, fx.var(spark, d).filter("soma_joinid % 9 <> 0").select(F.col("soma_joinid").alias("soma_dim_1")))
    return validate.consistent(by_obs, by_var, raw, transform.normalise_rows(raw).filter(F.expr(_FAULT) != 0))


@query(", m AS (SELECT dataset_id, count(*) AS n FROM presence GROUP BY 1), o AS (SELECT var_joinid, count(*) AS n FROM presence JOIN obs USING (dataset_id) GROUP BY 1) SELECT (SELECT count(*) FROM obs LEFT JOIN m USING (dataset_id) WHERE coalesce(n, 0) <> CASE WHEN soma_joinid % 10 = 0 THEN 0 ELSE coalesce(n, 0) END) AS bad_obs, (SELECT count(*) FROM var LEFT JOIN o ON soma_joinid = var_joinid WHERE coalesce(n, 0) <> CASE WHEN soma_joinid % 10 = 0 THEN coalesce(n, 0) + 1 ELSE coalesce(n, 0) END) AS bad_var")
def validate_measured(spark, d):
    """n_measured_vars and n_measured_obs of the axes against the presence matrix; a tenth of both is wrong."""
    from sparsefold.operators import presence as presence_ops

    tenth, full = F.col("soma_joinid") % 10 == 0, fx.presence(spark, d)
    obs = presence_ops.obs_with_measured(fx.obs(spark, d), full).withColumn("n_measured_vars", F.when(tenth, 0).otherwise(F.col("n_measured_vars")))
    n = presence_ops.measured_obs(full, fx.obs(spark, d)).withColumnRenamed("var_joinid", "soma_joinid")
    var = fx.var(spark, d).join(n, "soma_joinid", "left").fillna(0, ["n_measured_obs"]).withColumn("n_measured_obs", F.when(tenth, F.col("n_measured_obs") + 1).otherwise(F.col("n_measured_obs")))
    return validate.measured(obs, var, full)


@query(
    """WITH wanted(t, c, wanted) AS (VALUES ('orders', 'o_orderkey', 'bigint'), ('orders', 'o_custkey', 'string'), ('orders', 'o_orderdate', 'timestamp_ntz'), ('orders', 'ghost', 'string'),
      ('part', 'p_partkey', 'bigint'), ('part', 'p_name', 'string'), ('part', 'p_size', 'double'), ('part', 'p_retailprice', 'double')),
    kinds(name, kind) AS (VALUES ('BIGINT', 'bigint'), ('INTEGER', 'int'), ('VARCHAR', 'string'), ('DOUBLE', 'double'), ('TIMESTAMP', 'timestamp_ntz')),
    found AS (SELECT table_name AS t, column_name AS c, kind AS found FROM information_schema.columns JOIN kinds ON data_type = name WHERE table_name IN ('orders', 'part')),
    sizes AS (SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part)
    SELECT t AS table_name, c AS column_name, CASE WHEN wanted IS NULL THEN 'extra' WHEN found IS NULL THEN 'missing' ELSE 'type' END AS fault, wanted, found, n AS rows
    FROM wanted FULL JOIN found USING (t, c) JOIN sizes USING (t) WHERE wanted IS DISTINCT FROM found""",
    plain=True,
)
def validate_schema(spark, d):
    """Two tables' schemas against the wanted ones: a row per fault, with the number of rows that have it."""
    wanted = {
        "orders": {"o_orderkey": "bigint", "o_custkey": "string", "o_orderdate": "timestamp_ntz", "ghost": "string"},
        "part": {"p_partkey": "bigint", "p_name": "string", "p_size": "double", "p_retailprice": "double"},
    }
    out = None
    for name, columns in wanted.items():
        table = fx.table(spark, d, name)
        faults = validate.schema_faults(table, columns).select(F.lit(name).alias("table_name"), "*").crossJoin(F.broadcast(table.agg(F.count(F.lit(1)).alias("rows"))))  # one row
        out = faults if out is None else out.unionByName(faults)
    return out


@query("SELECT count(*) FILTER (l_orderkey % 97 = 0) AS null_values, count(*) FILTER (l_partkey % 17 = 0 AND l_quantity <= 49 AND l_orderkey % 97 <> 0) AS not_positive, count(*) FILTER (l_quantity > 49 AND l_orderkey % 97 <> 0) AS not_finite, count(*) FILTER (l_partkey % 13 = 0) AS off_axis FROM (SELECT l_orderkey, l_partkey, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)", plain=True)
def validate_x(spark, d):
    """Stored values that are null, negative or not finite, coordinates off an axis."""
    x, v = fx.x(spark, d), F.col("soma_data")
    dirty = x.withColumn("soma_data", F.when(F.col("soma_dim_0") % 97 == 0, F.lit(None)).when(v > 49, F.lit(float("inf"))).when(F.col("soma_dim_1") % 17 == 0, -v).otherwise(v))
    return validate.layer(dirty, fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("soma_joinid")), fx.var(spark, d).filter("soma_joinid % 13 <> 0"))


@query("SELECT count(*) FILTER (var_joinid % 7 = 0) AS unfounded, count(*) FILTER (var_joinid % 5 = 0) AS missing FROM presence")
def validate_presence(spark, d):
    full = fx.presence(spark, d)
    extra = full.filter("var_joinid % 7 = 0").select("dataset_id", (F.col("var_joinid") + 10_000_000).alias("var_joinid"))
    return validate.presence_matches(full.filter("var_joinid % 5 <> 0").unionByName(extra), full)


@query("SELECT count(*) FILTER (tissue = 'NATION_3') AS only_first, count(*) FILTER (tissue IN ('NATION_2', 'NATION_3')) AS only_second FROM obs")
def validate_axis(spark, d):
    """An axis with rows that are lost and rows that are changed."""
    obs = fx.obs(spark, d)
    changed = obs.filter("tissue <> 'NATION_2'").withColumn("price", F.when(F.col("tissue") == "NATION_3", F.col("price") + 1).otherwise(F.col("price")))
    return validate.same_rows(changed, obs)


@query("SELECT o_custkey AS dataset_id, max_by(o_orderstatus, o_orderkey) AS status, min(o_orderkey) AS pos FROM orders GROUP BY 1", plain=True)
def manifest_dedup(spark, d):
    records = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("dataset_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("pos"))
    return ranking.last_record(records, "dataset_id").select("dataset_id", "status", "pos")


@query("SELECT c_custkey AS dataset_id FROM customer WHERE c_nationkey NOT IN (3, 4)", plain=True)
def blocklist(spark, d):
    sets = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("dataset_id"), "c_nationkey")
    return build.without_blocked(sets, sets.filter("c_nationkey in (3, 4)").select("dataset_id")).select("dataset_id")


@query("SELECT o_custkey AS dataset_id FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'F')", plain=True)
def organism_array_filter(spark, d):
    sets = fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("dataset_id")).agg(F.collect_set(F.struct(F.col("o_orderstatus").alias("ontology_term_id"))).alias("organism"))
    return build.with_organism(sets, ["F"]).select("dataset_id")


@query("SELECT c_custkey AS dataset_id FROM customer ORDER BY c_acctbal DESC, 1 LIMIT 25", plain=True)
def test_first_n(spark, d):
    return build.first_by_size(fx.table(spark, d, "customer").select(F.col("c_custkey").alias("dataset_id"), F.col("c_acctbal").alias("size")), -25).select("dataset_id")


@query("SELECT DISTINCT o_custkey AS dataset_id FROM orders", plain=True)
def prune_unused(spark, d):
    sets = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("dataset_id"))
    return build.prune_unused(sets, fx.table(spark, d, "orders").select(F.col("o_custkey").alias("dataset_id")))


#: Places that are made from one row.
_PLACES = 1 << 16


@query("SELECT dataset_id AS scene_id, soma_joinid, CAST(n AS DOUBLE) AS y, CAST(n * 2 AS DOUBLE) AS x, CASE WHEN n % 2 = 0 THEN n / 2 ELSE 2.0 END AS radius FROM (SELECT dataset_id, soma_joinid, row_number() OVER (PARTITION BY dataset_id ORDER BY soma_joinid) - 1 AS n FROM obs)")
def scene_locations(spark, d):
    """A made-up place for each observation of a dataset."""
    n = F.col("row")
    sizes = fx.obs(spark, d).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    blocks = sizes.select("dataset_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {_PLACES}"))).alias("b")).repartition("dataset_id", "b")
    places = blocks.select("dataset_id", F.explode(F.sequence(F.col("b") * _PLACES, F.least(F.col("n"), (F.col("b") + 1) * _PLACES) - 1)).alias("row"))
    places = places.withColumns({"y": n.cast("double"), "x": (n * 2).cast("double"), "spot_diameter": F.when(n % 2 == 0, n.cast("double"))})
    return build.scene_points(places, fx.obs(spark, d))


@query("SELECT o_custkey AS dataset_id, count(*) AS slides FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1 HAVING count(*) <> 1", plain=True)
def single_slide(spark, d):
    """Spatial datasets that don't have exactly one slide."""
    slides = fx.table(spark, d, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("slide_id"))
    return validate.not_single(slides, "dataset_id", "slide_id").withColumnRenamed("n", "slides")


@query("SELECT soma_joinid, dataset_id AS scene_id, true AS data FROM obs")
def obs_spatial_presence(spark, d):
    return build.spatial_presence(fx.obs(spark, d))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance FROM events GROUP BY 1", plain=True)
def event_mean_variance(spark, d):
    from sparsefold.streaming.online import online_mean_variance

    found = online_mean_variance(fx.table(spark, d, "events"), "event_type", "value")
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "variance")})
