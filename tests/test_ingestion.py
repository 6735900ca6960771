"""Places, layouts, manifests, typed terms, stored moments, components and the index on disk, on fixtures of their own."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsefold.operators import axis, ivf, moments, ontology, pca, places, ranking, release
from sparsefold.sources import corpus, matrices, records


def test_places_and_running_sums(spark):
    r = random.Random(1)
    ids = r.sample(range(-10_000, 10_000), 700)
    df = spark.createDataFrame([(i, r.randint(0, 5)) for i in ids], "id long, n long").repartition(7)
    found = {x["id"]: x["place"] for x in places.placed(df, ["id"]).collect()}
    assert found == {i: at for at, i in enumerate(sorted(ids))}
    values = {x["id"]: x["n"] for x in df.collect()}
    total, want = 0, {}
    for i in sorted(ids):
        want[i], total = total, total + values[i]
    assert {x["id"]: x["b"] for x in places.summed_before(df, ["id"], "n", "b").collect()} == want
    assert places.placed(df.limit(0), ["id"]).count() == 0
    plan = places.placed(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
@pytest.mark.parametrize("by", ["row", "column"])
def test_compressed_layouts(spark, by, block):
    """Empty lines in front, in between and at the end, a line over many blocks, repeated coordinates, two sources."""
    r = random.Random(block)
    sources, offsets, entries, want = ("a", "b"), [], [], []
    for s in sources:
        sizes, at = [0, 0, 5, 1, 0, 40, 0, 2, 0, 0], 0
        for line, size in enumerate([*sizes, 0]):
            offsets.append((s, line, at))
            for _ in range(size if line < len(sizes) else 0):
                index, value = r.randint(0, 6), float(r.randint(1, 9))
                entries.append((s, at, index, value))
                want.append((s, *((line, index) if by == "row" else (index, line)), value))
                at += 1
    found = matrices.from_compressed(spark.createDataFrame(offsets, "source string, at long, offset long"), spark.createDataFrame(entries, "source string, at long, index long, value double"), by, block)
    assert sorted(tuple(x) for x in found.collect()) == sorted(want)


def test_dense_layout_and_preference(spark):
    rows = spark.createDataFrame([("a", 0, [0.0, 2.0, None]), ("a", 3, [0.0, 0.0, 0.0]), ("b", 1, [1.0, 0.0, -1.0])], "source string, at long, values array<double>")
    assert sorted(tuple(x) for x in matrices.from_dense(rows).collect()) == [("a", 0, 1, 2.0), ("b", 1, 0, 1.0), ("b", 1, 2, -1.0)]
    x = spark.createDataFrame([("a", "X", 1.0), ("a", "raw/X", 2.0), ("b", "X", 3.0), ("c", "scaled", 4.0)], "source string, layer string, v double")
    assert sorted((r["source"], r["v"]) for r in matrices.preferred(x).collect()) == [("a", 2.0), ("b", 3.0)]
    with pytest.raises(ValueError, match="rows or columns"):
        matrices.from_compressed(rows, rows, "diagonal")


def test_json_manifest(spark, tmp_path):
    asset = {"filetype": "H5AD", "url": "u", "filesize": 3}
    good = {"dataset_id": "d1", "schema_version": "7.0.0", "title": None, "assets": [asset, {"filetype": "RDS", "url": "r", "filesize": 1}], "organism": [{"ontology_term_id": "T:1"}]}
    lines = [json.dumps(x) for x in (good, good | {"dataset_id": None}, good | {"dataset_id": "d2", "schema_version": "7.0.1"}, good | {"dataset_id": "d3", "assets": []}, good | {"dataset_id": "d4", "assets": [asset, asset]}, good | {"dataset_id": "d5", "assets": None}, good | {"title": "again", "cell_count": 9}, good | {"dataset_id": "d6", "organism": None})]
    path = tmp_path / "manifest.json"
    path.write_text("\n".join([*lines, "", '{"dataset_id": "torn', '"text"', '{"dataset_id": 7, "cell_count": "many"}']) + "\n")
    found = records.read_json_manifest(spark, str(path), "7.0.0")
    faults = [(r["dataset_id"], r["fault"]) for r in records.faults(found).orderBy("pos").collect()]
    assert [f for _, f in faults] == [records.FAULTS[i] for i in (1, 2, 3, 4, 3, 0, 0, 0)]
    (one,) = records.datasets(found, ["T:1"]).collect()
    assert (one["dataset_id"], one["title"], one["cell_count"], one["asset_h5ad_filesize"]) == ("d1", "again", 9, 3)
    assert {r["dataset_id"] for r in records.datasets(found).collect()} == {"d1", "d6"}
    with pytest.raises(ValueError, match="another schema version"):
        records.require_sound(found)


def test_typed_terms(spark):
    edges = spark.createDataFrame([("lung", "organ", "is_a"), ("organ", "root", "is_a"), ("alveolus", "lung", "part_of"), ("alveolus", "sac", "is_a"), ("sac", "root", "is_a"), ("bud", "lung", "develops_from"), ("other", "alone", "is_a"), ("x", "blocked", "is_a"), ("blocked", "organ", "is_a")], "term string, parent string, kind string")
    curated = spark.createDataFrame([("organ", 2), ("lung", 1), ("alone", 3), ("bud", 4)], "ancestor string, priority int")
    terms = spark.createDataFrame([(t,) for t in ("alveolus", "lung", "bud", "other", "alone", "x", "root", "ghost")], "term string")
    found = {r["term"]: (r["general"], r["top"]) for r in ontology.high_level_terms(terms, edges, curated, "root", ("is_a", "part_of"), ("blocked",)).collect()}
    assert found == {"alveolus": (["lung", "organ"], "lung"), "lung": (["lung", "organ"], "lung"), "bud": (["bud"], "bud"), "other": ([], None), "alone": (["alone"], "alone"), "x": ([], None), "root": ([], None), "ghost": ([], None)}
    circle = spark.createDataFrame([("a", "b", "is_a"), ("b", "a", "is_a")], "term string, parent string, kind string")
    with pytest.raises(Exception, match="(?i)recursion"):
        ontology.typed_ancestors(circle).collect()


def test_long_chains_of_aliases(spark):
    rows = [("r", None)] + [(f"a{i}", f"a{i - 1}" if i else "r") for i in range(40)] + [("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("into", "c1"), ("lost", "nowhere"), ("self", "self")]
    out = release.resolved(spark.createDataFrame(rows, "name string, target string")).collect()
    assert {r["name"]: r["concrete"] for r in out if r["is_alias"]} == {f"a{i}": "r" for i in range(40)}


def test_moments_of_appended_datasets(spark, tmp_path):
    r = np.random.default_rng(3)
    x = 1e6 + r.normal(size=(90, 7))  # a mean far above the spread
    x[r.random(x.shape) < 0.4] = 0
    cells = [(i, j, float(v)) for (i, j), v in np.ndenumerate(x) if v]
    obs = spark.createDataFrame([(i, i % 4) for i in range(90)], "soma_joinid long, dataset_id long")
    layer = spark.createDataFrame(cells, "soma_dim_0 long, soma_dim_1 long, soma_data double")
    path = str(tmp_path / "m")
    for some in ("dataset_id < 3", "dataset_id = 3", "dataset_id = 3"):
        before = {f: f.stat().st_mtime_ns for f in (tmp_path / "m").rglob("*.parquet") if "dataset_id=3" not in str(f)}
        moments.append(layer, obs.filter(some), path)
        assert before == {f: f.stat().st_mtime_ns for f in before}
    table, sizes = moments.read(spark, path)
    for row in moments.merged(table).collect():
        column = x[:, row["soma_dim_1"]]
        column = column[column != 0]
        assert row["n"] == len(column) and abs(row["m2"] / ((column - column.mean()) ** 2).sum() - 1) < 1e-9
    found = {q["soma_joinid"]: (q["mean"], q["variance"]) for q in moments.mean_variance(table, sizes).collect()}
    for j, (mean, variance) in found.items():
        assert np.isclose(mean, x[:, j].mean(), rtol=1e-9) and np.isclose(variance, x[:, j].var(ddof=1), rtol=1e-9)


def _components(spark, x, k, **more):
    cells = [(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(x) if v]
    layer = spark.createDataFrame(cells, "soma_dim_0 long, soma_dim_1 long, soma_data double")
    obs = spark.createDataFrame([(i,) for i in range(len(x))], "soma_joinid long")
    found = pca.principal_components(layer, len(x), k, **more)
    loading = np.zeros((x.shape[1], len(found.variances)))
    for r in found.loadings.collect():
        loading[r["soma_dim_1"]] = r["loading"]
    score = np.zeros((len(x), len(found.variances)))
    for r in pca.scores(layer, obs, found).collect():
        score[r["soma_joinid"]] = r["pc"]
    return found, loading, score


def test_components_against_numpy(spark):
    r = np.random.default_rng(5)
    x = (r.normal(size=(300, 6)) * [9, 7, 5, 4, 3, 2]) @ r.normal(size=(6, 60)) + r.normal(size=(300, 60)) + 3
    x[r.random(x.shape) < 0.5] = 0
    x[7], x[:, 11] = 0, 0
    found, loading, score = _components(spark, x, 4)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / 299)
    assert np.allclose(found.variances, values[::-1][:4], rtol=1e-6) and np.isclose(found.total, values.sum())
    assert np.linalg.svd(vectors[:, ::-1][:, :4].T @ loading)[1].min() > 1 - 1e-8 and max(found.residuals) < 1e-6
    assert np.allclose(score, centred @ loading, atol=1e-8)


def test_components_of_low_rank(spark):
    x = np.outer(np.arange(1.0, 9), [1.0, 0, 2])
    found, loading, _ = _components(spark, x, 3)
    assert np.isclose(found.variances[0], found.total) and abs(found.variances[1:][0]) < 1e-9 and len(found.variances) == 2  # two features have values
    assert np.allclose(np.abs(loading[:, 0]), [1 / 5**0.5, 0, 2 / 5**0.5])
    assert pca.principal_components(spark.createDataFrame([], "soma_dim_0 long, soma_dim_1 long, soma_data double"), 5).variances == []


def test_index_on_disk(spark, tmp_path):
    r = np.random.default_rng(2)
    v = (r.normal(size=(40, 16)) * 4)[r.integers(0, 40, 3000)] + r.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<float>")
    index = ivf.build(df.filter("id < 2500"), str(tmp_path / "i"))
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "i").rglob("*.parquet")}
    ivf.append(index, df.filter("id >= 2500"))
    assert files == {f: f.stat().st_mtime_ns for f in files}
    asked = np.array([w for w in v[r.integers(0, 3000, 150)] + r.normal(size=(150, 16)) * 0.3])  # rows that were never seen
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "query_id long, vector array<float>")
    index = ivf.load(spark, str(tmp_path / "i"))
    found = {}
    for x in ivf.search(index, queries).collect():
        found.setdefault(x["query_id"], set()).add(x["id"])
    v32 = v.astype(np.float32).astype(float)
    true = [set(np.argsort(((v32 - q.astype(np.float32)) ** 2).sum(axis=1))[:10].tolist()) for q in asked]
    assert np.mean([len(found[i] & t) / 10 for i, t in enumerate(true)]) >= 0.92
    assert ivf.share_read(index, queries) < 0.25 and index.lists().count() == 3000
    one = ivf.search(index, queries.filter("query_id = 0"), probes=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_sample_border(spark, monkeypatch):
    df = spark.range(3000).withColumnRenamed("id", "soma_joinid")
    want = [r[0] for r in df.orderBy(ranking.lot("soma_joinid", 4), "soma_joinid").collect()]
    monkeypatch.setattr(ranking, "BORDER", 0)
    for n in (0, 1, 1234, 3000, 4000):
        assert sorted(r[0] for r in ranking.sample_n(df, n, seed=4).collect()) == sorted(want[:n])


def test_subscripts_in_predicates(spark):
    df = spark.createDataFrame([(["x", "y"], "a"), (["z", "x"], "b")], "tags array<string>, k string")
    assert axis.scan(df, "tags[0] == 'x' and k in ['a', 'b']").count() == 1
    assert axis.in_parentheses("f(t[1]) IN [g[0], 2] and m['in [q]'][0] = 1") == "f(t[1]) IN (g[0], 2) and m['in [q]'][0] = 1"


def test_steps_of_like_cost(spark):
    r = random.Random(9)
    ids = sorted(r.sample(range(10**6), 200))
    cells = [(i, j, 1.0) for i in ids[20:] for j in range(r.randint(0, 6))] + [(ids[50], 100 + j, 1.0) for j in range(500)]
    obs = spark.createDataFrame([(i,) for i in ids], "soma_joinid long")
    var = spark.range(700).withColumnRenamed("id", "soma_joinid")
    x = spark.createDataFrame(cells, "soma_dim_0 long, soma_dim_1 long, soma_data double")
    steps = list(axis.incremental(axis.axis_query(obs, var, x), values=100))
    sizes = [s.X.count() for s in steps]
    assert sum(sizes) == len(cells) and sum(s.obs.count() for s in steps) == 200 and all(sizes)
    assert sorted(sizes)[-1] < 700 and all(n <= 106 for n in sorted(sizes)[:-1])
    with pytest.raises(ValueError, match="number of"):
        next(axis.incremental(axis.axis_query(obs, var, x)))
    dense = axis.reindexed_slice(axis.axis_query(obs, var, x)).collect()
    at = {i: n for n, i in enumerate(ids)}
    assert sorted((d[0], d[1]) for d in dense) == sorted((at[i], j) for i, j, _ in cells)


def test_corpus_names_are_kept():
    assert corpus.organism_key("Homo sapiens") == "homo_sapiens"


def test_generated_rows_depend_on_seed_and_place_only(spark):
    from sparsefold.sources import generated

    def rows(n, parts, seed=3):
        return [(r["place"], tuple(r["vector"])) for r in generated.generated(spark, n, 5, seed, parts).orderBy("place").collect()]

    one = rows(5000, 1)
    assert one == rows(5000, 16) and one[:1500] == rows(1500, 2) and one != rows(5000, 1, 4) and len(one) == 5000
    values = np.array([v for _, v in one])
    assert values.min() >= np.float32(generated.LOW) and values.max() < generated.LOW + generated.WIDTH and abs(values.mean() - 0.9) < 0.02
    assert generated.generated(spark, 0, 5).count() == 0
    axis_ = spark.createDataFrame([(7 * i,) for i in range(100)], "soma_joinid long")
    found = generated.test_embedding(axis_, 30, 4).collect()
    assert len({r["id"] for r in found}) == 30 and all(r["id"] % 7 == 0 and len(r["vector"]) == 4 for r in found)


def test_consolidation(spark, tmp_path):
    x = spark.createDataFrame([(i, j, float(i + j)) for i in range(60) for j in range(5)], "soma_dim_0 long, soma_dim_1 long, soma_data double")
    paths = [str(tmp_path / n) for n in ("raw", "normalized", "keep")]
    for p in paths:
        for part in range(6):
            corpus.write_sparse(x.filter(f"soma_dim_0 % 6 = {part}"), p)
    before = corpus.layer_files(spark, paths[0])
    assert before.files >= 6
    assert corpus.consolidate(spark, paths, include=[".*/(raw|keep)"], exclude=[".*keep"]) == [paths[0]]
    assert corpus.layer_files(spark, paths[0]).files == 1 and corpus.layer_files(spark, paths[1]).files == before.files
    assert sorted(tuple(r) for r in spark.read.parquet(paths[0]).collect()) == sorted(tuple(r) for r in x.collect())
    assert corpus.consolidate(spark, paths[:1]) == []
    for cut_off in ("old", "both", "new"):  # where a run may have been stopped
        (tmp_path / "raw").rename(tmp_path / f"raw.{'new' if cut_off == 'both' else cut_off}")
        if cut_off == "both":
            (tmp_path / "keep").rename(tmp_path / "raw.old")
        if cut_off == "new":
            (tmp_path / "raw.new").rename(tmp_path / "raw")
            (tmp_path / "raw.new").mkdir()
        corpus.recover(spark, paths[0])
        assert spark.read.parquet(paths[0]).count() == 300 and not list(tmp_path.glob("raw.*"))


def test_records_and_injection(spark):
    from sparsefold.operators import ingest

    good = {"id": "e", "embedding_name": "n", "organism": "h", "version": "stable", "submission_date": "2024-01-01", "n_embeddings": 2, "n_features": 2, "data_type": "obs_embedding", "title": "t", "description": "d", "DOI": "10.1234/x", "model_link": "https://x.org/m"}
    bad = good | {"embedding_name": "n" * 129, "title": "", "DOI": "x10.1234/x", "model_link": "https://", "n_features": 0, "data_type": "cells"}
    table = spark.createDataFrame([good, bad | {"id": "f"}])
    assert ingest.metadata_faults(good) == [] and len(ingest.metadata_faults(bad)) == 6
    assert sorted(r["fault"] for r in ingest.record_faults(table).collect()) == sorted(ingest.metadata_faults(bad))
    assert {r["id"] for r in ingest.record_faults(table, 1).collect()} == {"e", "f"}
    names = {"stable": "2024", "2024": "2024", "old": "2022", "2022": "2022"}
    record = good | {"experiment_name": "h", "measurement_name": "RNA"}
    ingest.require_version(record, "2024", names, {"h": ["RNA"]})
    for version, where, match in (("old", {"h": ["RNA"]}, "version"), ("2024", {"m": ["RNA"]}, "experiment"), ("2024", {"h": ["ATAC"]}, "measurement")):
        with pytest.raises(ValueError, match=match):
            ingest.require_version(record, version, names, where)
    m = corpus.Measurement(spark.range(1), {})
    ids = spark.range(5).withColumnRenamed("id", "soma_joinid")
    fine = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<float>")
    assert "a" in corpus.inject_embedding(m, "a", fine, ids, 2).embeddings
    for wrong in (fine.withColumn("id", F.lit(9)), fine.limit(0), fine.withColumn("vector", F.array(F.lit(1.0)).cast("array<float>"))):
        with pytest.raises(ValueError, match="faults"):
            corpus.inject_embedding(m, "a", wrong, ids, 2)


def test_labels_of_held_out_rows(spark):
    from sparsefold.operators import learning

    r = np.random.default_rng(8)
    label = r.integers(0, 4, 400)
    v = r.normal(size=(400, 12)) + 2.5 * r.normal(size=(4, 12))[label]
    df = spark.createDataFrame([(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, label, strict=True))], "id long, vector array<float>, label int")
    both = learning.split(df, 0.25, "id")
    found = learning.transferred(both.filter("not is_test"), both.filter("is_test"), trees=10).collect()
    assert len(found) > 60 and np.mean([r["label"] == label[r["id"]] for r in found]) > 0.9
    pc = {r["id"]: r["pc"] for r in learning.components(df.select("id", "vector"), 3).collect()}
    x = v.astype(np.float32).astype(float)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1][:3]
    assert np.allclose(np.var([pc[i] for i in range(400)], axis=0, ddof=1), values, rtol=1e-5)


def test_a_release_more(spark):
    rows = spark.createDataFrame([("r", None, False), ("old", None, True), ("stable", "r", None)], "name string, target string, retracted boolean")
    out = {r["name"]: r["target"] for r in release.made(rows, "n", {"retracted": False}, ("stable", "latest")).collect()}
    assert out == {"r": None, "old": None, "n": None, "stable": "n", "latest": "n"}
    for name, record, aliases in (("r", {}, ()), ("n", {}, ("old",)), ("n", {"retracted": True}, ("stable",))):
        with pytest.raises(ValueError, match="already|would leave"):
            release.made(rows, name, record, aliases)
