"""Queries over source matrices, manifests, typed terms, places, stored moments and principal components."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparsefold.operators import axis, ingest, ivf, moments, ontology, pca, places, release, transform, validate
from sparsefold.plans import fixture as fx
from sparsefold.plans.registry import query
from sparsefold.sources import generated, matrices, records
from sparsefold.sources.scratch import scratch_path

_SUMMED = "SELECT soma_dim_0, soma_dim_1, soma_data FROM x"


def _lines(spark, d, table: str, key: str) -> int:
    return fx.table(spark, d, table).agg(F.max(key)).first()[0] + 1


@query(f"{_SUMMED}")
def read_csr(spark, d):
    """Line items packed by rows, with their repeated coordinates, and read again."""
    offsets, entries = matrices.to_compressed(fx.entries(spark, d), _lines(spark, d, "orders", "o_orderkey"))
    return matrices.canonical(matrices.from_compressed(offsets, entries), entries.count()).drop("source")


@query(f"{_SUMMED}")
def read_csc(spark, d):
    """The same by columns."""
    offsets, entries = matrices.to_compressed(fx.entries(spark, d), _lines(spark, d, "part", "p_partkey"), "column")
    return matrices.canonical(matrices.from_compressed(offsets, entries, "column"), entries.count()).drop("source")


@query("SELECT soma_dim_0, soma_dim_1 % 50 AS soma_dim_1, sum(soma_data) AS soma_data FROM x GROUP BY ALL HAVING sum(soma_data) <> 0")
def read_dense(spark, d):
    """Fifty groups of features as dense rows."""
    few = fx.entries(spark, d).withColumn("soma_dim_1", F.col("soma_dim_1") % 50)
    return matrices.from_dense(matrices.to_dense(few, 50)).drop("source")


@query(
    """SELECT year(o_orderdate) || '' AS source, l_orderkey AS soma_dim_0, l_partkey AS soma_dim_1,
      sum(CASE WHEN year(o_orderdate) % 3 = 0 THEN l_quantity ELSE l_extendedprice END) AS soma_data
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) % 7 > 0 GROUP BY ALL""",
    plain=True,
)
def preferred_layer(spark, d):
    """Order years as sources: one in three has raw values, one in seven neither those nor others, the rest has X alone."""
    lines = fx.table(spark, d, "lineitem")
    n = places.parts(lines.count())
    years = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("soma_dim_0"), F.year("o_orderdate").alias("y")).repartition(n, "soma_dim_0")
    rows = lines.select(F.col("l_orderkey").alias("soma_dim_0"), F.col("l_partkey").alias("soma_dim_1"), "l_quantity", "l_extendedprice").repartition(n, "soma_dim_0").join(years, "soma_dim_0")
    source = F.col("y").cast("string").alias("source")
    other = rows.filter("y % 7 > 0").select(source, F.lit("X").alias("layer"), "soma_dim_0", "soma_dim_1", F.col("l_extendedprice").alias("soma_data"))
    raw = rows.filter("y % 7 > 0 and y % 3 = 0").select(source, F.lit("raw/X").alias("layer"), "soma_dim_0", "soma_dim_1", F.col("l_quantity").alias("soma_data"))
    model = rows.filter("y % 7 = 0").select(source, F.lit("scaled").alias("layer"), "soma_dim_0", "soma_dim_1", F.lit(1.0).alias("soma_data"))
    return matrices.canonical(matrices.preferred(other.unionByName(raw).unionByName(model)), lines.count()).withColumn("soma_data", F.round("soma_data", 4))


_JSON = """WITH o AS (SELECT o_orderkey AS pos, 'd' || (o_orderkey % 4000) AS id, o_orderkey % 11 AS a, o_orderkey % 13 AS b, o_orderkey % 17 AS c, o_custkey, o_orderpriority, o_totalprice FROM orders),
f AS (SELECT *, CASE WHEN c = 3 THEN 'not a record' WHEN c = 5 THEN 'no dataset id' WHEN b = 4 THEN 'another schema version'
  WHEN a = 2 THEN 'no asset of the kind' WHEN a = 6 THEN 'several assets of the kind' END AS fault FROM o)
"""


def _json_records(spark, d):
    """Manifest lines made of the orders, with faults of all kinds: torn lines, missing ids, other versions, none or two assets."""
    o = fx.table(spark, d, "orders")
    key = F.col("o_orderkey")
    url = F.concat(F.lit("https://corpus/"), key.cast("string"))
    one = lambda kind, end: F.struct(F.lit(kind).alias("filetype"), F.concat(url, F.lit(end)).alias("url"), (F.col("o_custkey") * 3).alias("filesize"))
    rds, h5ad = one("RDS", ".rds"), one("H5AD", ".h5ad")
    assets = F.when(key % 11 == 2, F.array(rds)).when(key % 11 == 6, F.array(h5ad, rds, h5ad)).otherwise(F.array(rds, h5ad))
    record = {
        "dataset_id": F.when(key % 17 != 5, F.concat(F.lit("d"), (key % 4000).cast("string"))),
        "schema_version": F.when(key % 13 == 4, "6.9.9").otherwise("7.0.0"),
        "title": F.when(key % 2 == 0, F.col("o_orderpriority")),
        "cell_count": F.col("o_totalprice").cast("bigint"),
        "assets": assets,
        "organism": F.array(F.struct(F.concat(F.lit("NCBITaxon:"), (F.col("o_custkey") % 5).cast("string")).alias("ontology_term_id"))),
    }
    line = records.as_json(record)
    torn = F.when(key % 17 == 3, F.substring(line, F.lit(1), F.length(line) - 7)).otherwise(line)
    return records.parsed(o.select(key.alias("pos"), torn.alias("value")), "7.0.0")


@query(f"{_JSON} SELECT fault, count(*) AS n, min(pos) AS first FROM f WHERE fault IS NOT NULL GROUP BY 1", plain=True)
def manifest_faults(spark, d):
    return records.faults(_json_records(spark, d)).groupBy("fault").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


@query(
    f"""{_JSON} SELECT id AS dataset_id, min(pos) AS pos, arg_max('https://corpus/' || pos || '.h5ad', pos) AS uri, arg_max(o_custkey * 3, pos) AS filesize,
      arg_max(CASE WHEN pos % 2 = 0 THEN o_orderpriority ELSE '' END, pos) AS title
    FROM f WHERE fault IS NULL AND o_custkey % 5 IN (1, 3) GROUP BY 1""",
    plain=True,
)
def manifest_json(spark, d):
    found = records.datasets(_json_records(spark, d), ["NCBITaxon:1", "NCBITaxon:3"])
    return found.select("dataset_id", "pos", F.col("dataset_asset_h5ad_uri").alias("uri"), F.col("asset_h5ad_filesize").alias("filesize"), "title")


@query(
    """, o AS (SELECT soma_joinid, row_number() OVER (ORDER BY soma_joinid) - 1 AS place FROM obs WHERE tissue_general = 'ASIA' AND soma_joinid % 3 > 0),
    v AS (SELECT soma_joinid, row_number() OVER (ORDER BY soma_joinid) - 1 AS place FROM var WHERE feature_length > 20)
    SELECT o.place AS soma_dim_0, v.place AS soma_dim_1, soma_data FROM x JOIN o ON soma_dim_0 = o.soma_joinid JOIN v ON soma_dim_1 = v.soma_joinid"""
)
def axis_reindex(spark, d):
    """A slice in dense places of its own on both axes."""
    return axis.reindexed_slice(fx.slice_(spark, d, "tissue_general = 'ASIA' and soma_joinid % 3 > 0", "feature_length > 20"))


@query("SELECT soma_joinid, sum(nnz) OVER (ORDER BY soma_joinid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT soma_joinid, count(soma_data) AS nnz FROM obs LEFT JOIN x ON soma_dim_0 = soma_joinid GROUP BY 1)")
def running_nnz(spark, d):
    """How many values are stored before each observation: where a reader that takes equal steps would cut."""
    from sparsefold.operators import stats

    sizes = stats.obs_stats(fx.x(spark, d), fx.obs(spark, d).select(F.col("soma_joinid").alias("soma_dim_0"))).select("soma_joinid", "nnz")
    before = places.summed_before(sizes, ["soma_joinid"], "nnz", "before")
    return before.select("soma_joinid", F.when(F.col("soma_joinid") > 0, F.col("before")).alias("before"))


@query(
    """, t AS (SELECT count(*) AS t FROM obs), s AS (SELECT soma_dim_1, sum(soma_data) AS s, sum(soma_data ** 2) AS q FROM x GROUP BY 1)
    SELECT soma_dim_1 AS soma_joinid, round(s / t, 6) AS mean, round((q - s * s / t) / (t - 1), 6) AS variance FROM s, t"""
)
def moments_merged(spark, d):
    """Moments of all years but two in one run, those of these two in others, one of which is repeated; then merged."""
    x, obs, path = fx.x(spark, d), fx.obs(spark, d), scratch_path(spark, "moments")
    for years in ("dataset_id not in (1995, 1998)", "dataset_id = 1998", "dataset_id = 1995", "dataset_id = 1998"):
        moments.append(x, obs.filter(years), path)
    found = moments.mean_variance(*moments.read(spark, path))
    return found.select("soma_joinid", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


#: Terms made of the parts: t(k) is a t(k div 2), and some are part of t(k div 3); above t(1) stands the root, beside them another tree.
_TERMS = """WITH RECURSIVE edges AS (
  SELECT 't' || p_partkey AS term, 't' || (p_partkey // 2) AS parent, 'is_a' AS kind FROM part WHERE p_partkey > 1
  UNION ALL SELECT 't' || p_partkey, 't' || (p_partkey // 3), 'part_of' FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 2
  UNION ALL SELECT 't' || p_partkey, 't' || (p_partkey // 5), 'develops_from' FROM part WHERE p_partkey % 5 = 0 AND p_partkey > 4
  UNION ALL SELECT 't1', 'root', 'is_a' UNION ALL SELECT 'u' || s_suppkey, 'u' || (s_suppkey // 2), 'is_a' FROM supplier WHERE s_suppkey > 1),
up(term, ancestor) AS (SELECT term, term FROM (SELECT term FROM edges UNION SELECT parent FROM edges)
  UNION SELECT up.term, e.parent FROM up JOIN edges e ON up.ancestor = e.term WHERE e.kind IN ('is_a', 'part_of') AND e.parent <> 't7' AND e.term <> 't7'),
curated(ancestor, priority) AS (VALUES ('t9', 1), ('t4', 2), ('t15', 3), ('u3', 4), ('t21', 5)),
"""


def _edges(spark, d):
    p, s = fx.table(spark, d, "part").select(F.col("p_partkey").alias("k")), fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    name = lambda letter, k: F.concat(F.lit(letter), k.cast("string"))
    k = F.col("k")

    def edge(df, letter, by, kind, where):
        return df.filter(where).select(name(letter, k).alias("term"), name(letter, F.expr(f"k div {by}")).alias("parent"), F.lit(kind).alias("kind"))

    some = [edge(p, "t", 2, "is_a", k > 1), edge(p, "t", 3, "part_of", (k % 3 == 0) & (k > 2)), edge(p, "t", 5, "develops_from", (k % 5 == 0) & (k > 4)), edge(s, "u", 2, "is_a", k > 1)]
    out = spark.createDataFrame([("t1", "root", "is_a")], "term string, parent string, kind string")
    for more in some:
        out = out.unionByName(more)
    return out


@query(
    f"""{_TERMS} below AS (SELECT DISTINCT term FROM up WHERE ancestor = 'root' AND term <> 'root'),
    hits AS (SELECT DISTINCT term, ancestor, priority FROM up JOIN curated USING (ancestor) WHERE term IN (SELECT term FROM below) OR term = ancestor)
    SELECT t.term, coalesce(string_agg(ancestor, ',' ORDER BY priority), '') AS general, arg_min(ancestor, priority) AS top
    FROM (SELECT term FROM edges UNION SELECT parent FROM edges) t LEFT JOIN hits USING (term) GROUP BY 1""",
    plain=True,
)
def high_level_terms(spark, d):
    """Terms with several parents under a root, one of them blocked, and a tree that the root isn't above."""
    edges = _edges(spark, d)
    curated = spark.createDataFrame([("t9", 1), ("t4", 2), ("t15", 3), ("u3", 4), ("t21", 5)], "ancestor string, priority int")
    terms = edges.select("term").union(edges.select("parent")).distinct()
    found = ontology.high_level_terms(terms, edges, curated, "root", ("is_a", "part_of"), ("t7",))
    return found.select("term", F.array_join("general", ",").alias("general"), "top")


#: Chains of up to 44 aliases, some of which end in a circle or nowhere.
_CHAINS = """WITH RECURSIVE v AS (SELECT 'v' || s_suppkey AS name, CASE WHEN s_suppkey % 45 > 0 THEN 'v' || (CASE WHEN s_suppkey % 45 = 40 AND s_suppkey > 45 THEN s_suppkey + 3 ELSE s_suppkey - 1 END) END AS target FROM supplier),
chase(name, reached, steps) AS (SELECT name, target, 1 FROM v WHERE target IS NOT NULL
  UNION ALL SELECT chase.name, v.target, steps + 1 FROM chase JOIN v ON chase.reached = v.name WHERE v.target IS NOT NULL AND steps <= (SELECT count(*) FROM v))
SELECT DISTINCT chase.name, chase.reached AS concrete FROM chase JOIN v ON chase.reached = v.name WHERE v.target IS NULL"""


@query(_CHAINS, plain=True)
def version_chains(spark, d):
    k = F.col("s_suppkey")
    to = F.when((k % 45 == 40) & (k > 45), k + 3).otherwise(k - 1)
    rows = fx.table(spark, d, "supplier").select(F.concat(F.lit("v"), k.cast("string")).alias("name"), F.when(k % 45 > 0, F.concat(F.lit("v"), to.cast("string"))).alias("target"))
    return release.resolved(rows).filter("is_alias").select("name", "concrete")


def _by_length(spark, d):
    """The matrix summed by length of the features, dealt by its rows to tasks of a bounded size: nothing is summed before, as coordinates hardly repeat."""
    entries = fx.entries(spark, d)
    lengths = fx.var(spark, d).select(F.col("soma_joinid").alias("soma_dim_1"), "feature_length")
    found = entries.join(lengths, "soma_dim_1").select("soma_dim_0", F.col("feature_length").alias("soma_dim_1"), "soma_data")
    return transform.sum_duplicates(found.repartition(places.parts(entries.count()), "soma_dim_0"))


@query(
    """, c AS (SELECT soma_dim_0, feature_length AS f, sum(soma_data) AS v FROM x JOIN var ON soma_dim_1 = soma_joinid GROUP BY ALL), t AS (SELECT count(*) AS t FROM obs),
    s AS (SELECT f, sum(v) AS s FROM c GROUP BY 1), p AS (SELECT a.f AS f, b.f AS g, sum(a.v * b.v) AS p FROM c a JOIN c b USING (soma_dim_0) GROUP BY ALL),
    k AS (SELECT a.f AS f, b.f AS g, (coalesce(p, 0) - a.s * b.s / t) / (t - 1) AS k FROM s a CROSS JOIN s b CROSS JOIN t LEFT JOIN p ON p.f = a.f AND p.g = b.f)
    SELECT count(DISTINCT f) AS components, round(sum(k) FILTER (f = g), 5) AS trace, round(sum(k * k), 3) AS squares FROM k"""
)
def pca_moments(spark, d):
    """All components over features summed by length: the sums of their variances and of the squares are those of the covariance."""
    obs = fx.obs(spark, d)
    x = pca.dealt(_by_length(spark, d), 56, whole=True)
    found = pca.principal_components(x, obs.count(), k=50)
    rows = spark.createDataFrame([(v,) for v in found.variances], "v double")
    return rows.agg(F.count("v").alias("components"), F.round(F.sum("v"), 5).alias("trace"), F.round(F.sum(F.col("v") * F.col("v")), 3).alias("squares"))


@query()
def pca_scores(spark, d):
    """Scores of all observations on the first four components of the whole matrix."""
    obs = fx.obs(spark, d)
    x = pca.dealt(fx.x_by_row(spark, d), 10)
    found = pca.principal_components(x, obs.count(), k=4, max_basis=40)
    return pca.scores(x, obs.select("soma_joinid"), found)


@query()
def search_ivf_index(spark, d):
    """The ten nearest rows by an index on disk: built over nine tenths of the rows, the rest appended, then asked by list."""
    e = fx.embeddings(spark, d).select("id", "vector")
    index = ivf.build(e.filter("id % 10 <> 5"), scratch_path(spark, "ivf"))
    ivf.append(index, e.filter("id % 10 = 5"))
    return ivf.search(index, e.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), 10)


@query(
    "SELECT CAST(floor(count(*) * 0.4) AS BIGINT) AS n, 16 AS dimensions, CAST(floor(count(*) * 0.4) AS BIGINT) AS on_axis, true AS inside, 0.9 AS mean, 0.33 AS variance FROM orders", plain=True
)
def generated_embedding(spark, d):
    """Made-up vectors for two fifths of the observations: their number, range and moments."""
    obs = fx.obs(spark, d).select("soma_joinid")
    found = generated.test_embedding(obs, int(obs.count() * 0.4), 16, seed=5)
    v = found.select("id", F.size("vector").alias("d"), F.explode("vector").alias("v"))
    rows = v.join(obs, v.id == obs.soma_joinid, "left_semi").agg(F.count_distinct("id").alias("on_axis"))
    inside = ((F.min("v") >= -0.1) & (F.max("v") < 1.9)).alias("inside")
    moments_ = v.agg(F.count_distinct("id").alias("n"), F.max("d").alias("dimensions"), inside, F.round(F.avg("v"), 1).alias("mean"), F.round(F.var_samp("v"), 2).alias("variance"))
    return moments_.crossJoin(rows)  # one row each


_RECORDS = """WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS embedding_name, o_orderstatus AS organism, '1998' AS version, o_orderdate AS submission_date,
  o_custkey - 3 AS n_embeddings, o_orderkey % 5 AS n_features, CASE WHEN o_orderkey % 3 = 0 THEN 'obs_embedding' WHEN o_orderkey % 3 = 1 THEN 'var_embedding' ELSE 'cells' END AS data_type,
  repeat('x', 120 + o_orderkey % 12) AS title, CASE WHEN o_orderkey % 11 = 0 THEN '10.' || o_orderkey || '/ab' WHEN o_orderkey % 11 = 1 THEN 'doi:' || o_orderkey ELSE '' END AS doi,
  CASE WHEN o_orderkey % 13 = 0 THEN 'https://x.org/' || o_orderkey WHEN o_orderkey % 13 = 1 THEN 'ftp://x.org' END AS link FROM orders)
"""


@query(
    f"""{_RECORDS} SELECT id, 'embedding_name is missing' AS fault FROM r WHERE embedding_name IS NULL
    UNION ALL SELECT id, 'n_embeddings must be a whole number above 0' FROM r WHERE n_embeddings <= 0 UNION ALL SELECT id, 'n_features must be a whole number above 0' FROM r WHERE n_features <= 0
    UNION ALL SELECT id, 'data_type must be obs_embedding or var_embedding' FROM r WHERE data_type = 'cells' UNION ALL SELECT id, 'title has more than 128 characters' FROM r WHERE length(title) > 128
    UNION ALL SELECT id, 'DOI is not a DOI' FROM r WHERE doi <> '' AND NOT regexp_full_match(doi, '10[.][0-9]{{4,9}}/[^ ]+') UNION ALL SELECT id, 'model_link is not a link' FROM r WHERE link LIKE 'ftp%'
    UNION ALL SELECT id, 'n_embeddings exceeds the observations' FROM r WHERE n_embeddings > 900""",
    plain=True,
)
def metadata_validate(spark, d):
    """Records of submissions made of the orders, with faults against every rule."""
    key = F.col("o_orderkey")
    kind = F.when(key % 3 == 0, "obs_embedding").when(key % 3 == 1, "var_embedding").otherwise("cells")
    doi = F.when(key % 11 == 0, F.concat(F.lit("10."), key.cast("string"), F.lit("/ab"))).when(key % 11 == 1, F.concat(F.lit("doi:"), key.cast("string"))).otherwise("")
    link = F.when(key % 13 == 0, F.concat(F.lit("https://x.org/"), key.cast("string"))).when(key % 13 == 1, "ftp://x.org")
    rows = fx.table(spark, d, "orders").select(
        key.alias("id"), F.when(key % 7 > 0, F.col("o_orderpriority")).alias("embedding_name"), F.col("o_orderstatus").alias("organism"), F.lit("1998").alias("version"), F.col("o_orderdate").alias("submission_date"),
        (F.col("o_custkey") - 3).alias("n_embeddings"), (key % 5).alias("n_features"), kind.alias("data_type"), F.expr("repeat('x', cast(120 + o_orderkey % 12 as int))").alias("title"), doi.alias("DOI"), link.alias("model_link"),
    )
    return ingest.record_faults(rows, 900)


@query(
    """WITH c AS (SELECT CASE WHEN vec_id % 17 = 0 THEN -vec_id - 1 ELSE vec_id END AS i, g - 1 + CASE WHEN vec_id % 19 = 0 THEN 3 ELSE 0 END AS j,
      CASE WHEN vec_id % 23 = 0 AND g = 5 THEN CAST('inf' AS FLOAT) ELSE embedding[g] END AS v FROM embeddings, range(1, 65) r(g)
      UNION ALL SELECT vec_id, 7, 1 FROM embeddings WHERE vec_id % 29 = 1),
    k AS (SELECT i, j, count(*) AS n, count(*) FILTER (isinf(v)) AS odd FROM c GROUP BY ALL)
    SELECT CAST(sum(n) AS BIGINT) AS cells, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (j < 0 OR j > 63) AS outside, CAST(sum(odd) AS BIGINT) AS not_finite,
      count(DISTINCT i) FILTER (i NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 31 <> 2)) AS off_axis, count(DISTINCT i) FILTER (i < 0) AS negative, abs(count(DISTINCT i) - 450) AS miscounted FROM k""",
    plain=True,
)
def embedding_coordinates_validate(spark, d):
    """Embeddings as coordinates with faults of all kinds."""
    e = fx.embeddings(spark, d).select("id", F.posexplode("vector").alias("p", "v"))
    i = F.when(F.col("id") % 17 == 0, -F.col("id") - 1).otherwise(F.col("id")).alias("soma_dim_0")
    j = (F.col("p") + F.when(F.col("id") % 19 == 0, 3).otherwise(0)).cast("bigint").alias("soma_dim_1")
    v = F.when((F.col("id") % 23 == 0) & (F.col("p") == 4), F.lit(float("inf")).cast("float")).otherwise(F.col("v")).alias("soma_data")
    again = e.filter("id % 29 = 1 and p = 0").select(F.col("id").alias("soma_dim_0"), F.lit(7).cast("bigint").alias("soma_dim_1"), F.lit(1.0).cast("float").alias("soma_data"))
    return ingest.coordinate_faults(e.select(i, j, v).unionByName(again), fx.obs(spark, d).filter("soma_joinid % 31 <> 2"), 64, 450)


@query(
    """SELECT 'price' AS column, count(*) FILTER (soma_joinid % 19 = 0 OR price < 2000 AND soma_joinid % 23 > 0 OR soma_joinid % 23 = 0) AS faults FROM obs
    UNION ALL SELECT 'dataset_id', count(*) FILTER (dataset_id < 0) FROM obs UNION ALL SELECT 'assay', count(*) FILTER (assay IN ('1-URGENT', '5-LOW') OR soma_joinid % 7 = 0) FROM obs"""
)
def validate_obs_domains(spark, d):
    """Statistics that are null, negative or infinite, and labels outside their domain."""
    key, price = F.col("soma_joinid"), F.col("price")
    dirty = F.when(key % 19 == 0, None).when(key % 23 == 0, float("inf")).otherwise(price - 2000)
    obs = fx.obs(spark, d).withColumn("price", dirty).withColumn("assay", F.when(key % 7 > 0, F.col("assay")))
    kinds = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    return validate.obs_domains(obs, ["price", "dataset_id"], {"assay": kinds})


@query(
    """WITH v AS (SELECT 's' || s_suppkey AS name, CASE WHEN s_suppkey % 4 = 1 THEN 's' || (s_suppkey - 1) END AS target, s_acctbal > 4000 AS lts FROM supplier)
    SELECT name, target, lts FROM v WHERE name NOT IN ('s1', 's5') UNION ALL SELECT * FROM (VALUES ('new', NULL, true), ('s1', 'new', NULL), ('s5', 'new', NULL), ('latest', 'new', NULL))""",
    plain=True,
)
def release_make(spark, d):
    """A release more, to which two aliases move and a new one comes."""
    k = F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    rows = fx.table(spark, d, "supplier").select(name(k).alias("name"), F.when(k % 4 == 1, name(k - 1)).alias("target"), (F.col("s_acctbal") > 4000).alias("lts"), F.lit(False).alias("retracted"))
    return release.made(rows, "new", {"lts": True, "retracted": False}, ("s1", "s5", "latest")).select("name", "target", "lts")
