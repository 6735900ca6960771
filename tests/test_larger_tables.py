"""What failed on larger tables, on fixtures that show it when small."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsefold.operators import build, embedding, learning, ontology, pca
from sparsefold.sources import generated


def test_observations_come_many_to_a_call(spark):
    cells = [(i, j, float(i + j)) for i in range(3000) for j in range(1 + i % 5)] + [(5000, j, 1.0) for j in range(900)]
    x = spark.createDataFrame(cells, "soma_dim_0 long, soma_dim_1 long, soma_data double").repartition(3)

    def items(rows):
        out = rows.groupby("soma_dim_0", as_index=False).agg(n=("soma_data", "size"))
        return out.assign(calls=[1] + [0] * (len(out) - 1))

    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "250")  # the last one covers several batches
    try:
        found = learning.per_observation(x, items, "soma_dim_0 bigint, n bigint, calls bigint").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {r["soma_dim_0"]: r["n"] for r in found} == {i: 1 + i % 5 for i in range(3000)} | {5000: 900} and len(found) == 3001
    assert sum(r["calls"] for r in found) < 100


def test_terms_beyond_the_rows_of_a_recursive_query(spark):
    edge = lambda df, term, parent: df.select(F.concat(F.lit("t"), term).alias("term"), F.concat(F.lit("t"), parent).alias("parent"), F.lit("is_a").alias("kind"))
    chain = edge(spark.range(1, 10), F.col("id"), F.col("id") - 1)
    edges = chain.unionByName(edge(spark.range(10, 110_000), F.col("id"), F.lit(9)))  # 1.1 million pairs
    curated = spark.createDataFrame([("t3", 1), ("t7", 2)], "ancestor string, priority int")
    found = ontology.high_level_terms(edges.select("term"), edges, curated, "t0").groupBy("general", "top").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted((r["general"], r["top"], r["n"]) for r in found) == sorted([([], None, 2), (["t3"], "t3", 4), (["t3", "t7"], "t3", 109_993)], key=lambda x: x[0])
    assert {r["ancestor"]: r["distance"] for r in ontology.typed_ancestors(chain).filter("term = 't9'").collect()} == {f"t{i}": 9 - i for i in range(10)}


def test_scenes_are_neither_broadcast_nor_numbered_whole(spark):
    obs = spark.range(1000).select((F.col("id") * 3).alias("soma_joinid"), (F.col("id") % 2).alias("dataset_id"))
    sizes = obs.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    rows = sizes.select("dataset_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("row"))
    places = rows.select("*", F.col("row").cast("double").alias("y"), F.lit(0.0).alias("x"), F.lit(None).cast("double").alias("spot_diameter"))
    found = build.scene_points(places, obs)
    assert sorted((r["scene_id"], r["soma_joinid"], r["y"]) for r in found.collect()) == sorted((i % 2, i * 3, float(i // 2)) for i in range(1000))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.split("SortMergeJoin", 1)[1] and "BroadcastHashJoin" not in plan.split("SortMergeJoin", 1)[0]


def test_generated_numbers_are_inside_their_range():
    values = generated.block(5, 6, 8192)  # eight million draws, one of which is 0
    assert float(values.min()) >= generated.LOW and float(values.max()) < generated.LOW + generated.WIDTH


@pytest.mark.parametrize("probes", [1, 3, 9, 20])
def test_rows_of_probed_lists_by_products_of_matrices(spark, probes):
    r = np.random.default_rng(4)
    v, centroids = r.normal(size=(700, 8)).astype(np.float32), r.normal(size=(20, 8))
    v[300:400] = v[299]  # copies, of which the smallest ids count
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<float>")
    asked = rows.filter("id % 7 = 0").withColumnRenamed("id", "query_id")
    out = embedding.nearest_ivf(asked, rows, centroids, 10, probes)
    v = v.astype(float)
    near = ((v[:, None] - centroids[None]) ** 2).sum(axis=2)
    found = {}
    for x in out.orderBy("query_id", "place").collect():
        found.setdefault(x["query_id"], []).append(x["id"])
    for q in range(0, 700, 7):
        ids = np.flatnonzero(np.isin(near.argmin(axis=1), np.argsort(near[q])[:probes]))
        assert found[q] == ids[np.lexsort((ids, ((v[ids] - v[q]) ** 2).sum(axis=1)))][:10].tolist()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_tasks_grow_in_number_and_not_in_size(spark, sf_dir, monkeypatch):
    from sparsefold.operators import places
    from sparsefold.plans.catalogue import QUERIES

    monkeypatch.setattr(places, "ROWS", 500)
    n = places.parts(spark.read.parquet(f"{sf_dir}/lineitem.parquet").count())
    assert n > 10
    for name in ("gene_collapse", "read_csr", "read_csc", "preferred_layer"):
        assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == n, name
    plan = QUERIES["validate_normalized"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert f"hashpartitioning(soma_dim_0#" in plan and f", {n}), REPARTITION_BY_NUM" in plan


def _shuffled(spark, run):
    """Bytes that the stages of a call write for shuffles."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = max(stages(), default=-1)
    run()
    return sum(v for k, v in stages().items() if k > before)


def test_images_move_features_and_not_values(spark):
    x = spark.range(120_000).select(F.expr("id div 40 as soma_dim_0"), F.expr("id % 40 as soma_dim_1"), F.rand(3).alias("soma_data"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one, three = (_shuffled(spark, lambda n=n: pca.principal_components(x, 3000, 2, block=5, max_basis=5 * n, tolerance=0.0)) for n in (1, 3))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert 0 < three - one < 2 * 120_000  # two images more move less than two bytes a stored value


def test_components_over_many_blocks(spark, monkeypatch):
    r = np.random.default_rng(8)
    x = (r.normal(size=(500, 3)) * [9, 6, 4]) @ r.normal(size=(3, 30)) + r.normal(size=(500, 30))
    x[r.random(x.shape) < 0.3] = 0
    x[40:60], x[:, 4] = 0, 0
    cells = [(int(i) - 250, int(j) * 3, float(v)) for (i, j), v in np.ndenumerate(x) if v]
    layer = spark.createDataFrame(cells, "soma_dim_0 long, soma_dim_1 long, soma_data double")
    monkeypatch.setattr(pca, "NUMBERS", 8 * 500)
    dealt = pca.dealt(layer, 8)
    blocks = dealt.groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(blocks) > 15 and max(b["n"] for b in blocks) < 530 and sum(b["n"] for b in blocks) == len(cells)
    assert dealt.groupBy("soma_dim_0").agg(F.count_distinct("at").alias("n")).filter("n > 1").count() == 0
    found = pca.principal_components(dealt, 500, 2)
    centred = x - x.mean(axis=0)
    assert np.allclose(found.variances, np.linalg.eigvalsh(centred.T @ centred / 499)[::-1][:2], rtol=1e-6)
    loading = np.zeros((30, 2))
    for row in found.loadings.collect():
        loading[row["soma_dim_1"] // 3] = row["loading"]
    obs = spark.range(-250, 250).withColumnRenamed("id", "soma_joinid")
    for given in (dealt, layer):
        score = {row["soma_joinid"]: row["pc"] for row in pca.scores(given, obs, found).collect()}
        assert np.allclose([score[i - 250] for i in range(500)], centred @ loading, atol=1e-8)
    part = pca.scores(layer.filter("soma_dim_1 < 9 or soma_dim_0 > 0"), obs, found).count()  # blocks without some of the features
    assert part == 500


def test_all_components_of_few_features_make_the_matrix_once(spark, sf_dir):
    from sparsefold.plans import ingestion
    from sparsefold.plans.catalogue import QUERIES

    once = _shuffled(spark, lambda: ingestion._by_length(spark, sf_dir).write.format("noop").mode("overwrite").save())
    assert _shuffled(spark, lambda: QUERIES["pca_moments"](spark, sf_dir).collect()) < 4 * once


def test_features_by_length_take_one_shuffle_in_bounded_tasks(spark, sf_dir, monkeypatch):
    from sparsefold.operators import places
    from sparsefold.plans import fixture, ingestion

    entries, drained = fixture.entries(spark, sf_dir), lambda df: df.write.format("noop").mode("overwrite").save()
    once = _shuffled(spark, lambda: drained(entries.repartition(1, "soma_dim_0")))
    assert _shuffled(spark, lambda: drained(ingestion._by_length(spark, sf_dir))) < 1.5 * once
    assert _shuffled(spark, lambda: pca.dealt(ingestion._by_length(spark, sf_dir), 56, whole=True)) < 1.5 * once
    monkeypatch.setattr(places, "ROWS", 500)
    assert ingestion._by_length(spark, sf_dir).rdd.getNumPartitions() == places.parts(entries.count()) > 10


def test_observations_whole_in_partitions_are_dealt_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(pca, "NUMBERS", 8 * 500)
    x = spark.range(6000).select(F.expr("id % 300 - 150 as soma_dim_0"), F.expr("id div 300 as soma_dim_1"), F.rand(5).alias("soma_data"))
    there = pca.dealt(x.repartition(5, "soma_dim_0"), 8, whole=True)
    blocks = [b["n"] for b in there.groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(blocks) == 6000 and len(blocks) > 10 and max(blocks) < 520
    assert there.groupBy("soma_dim_0").agg(F.count_distinct("at").alias("n")).filter("n > 1").count() == 0
    assert np.allclose(*(pca.principal_components(c, 300, 3).variances for c in (there, x)), rtol=1e-6)
