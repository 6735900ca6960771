"""Operators on small literal tables, where results are known by hand or by brute force."""

import numpy as np
import pytest

from sparsefold.functions.loess import loess
from sparsefold.functions.rounding import round_mantissa, rounded
from sparsefold.operators import axis, dedup, embedding, hvg, ranking, release, stats, summary, transform
from sparsefold.sources import corpus


def matrix(spark):
    """Three observations by four features: a zero, a repeated coordinate, an empty observation, an unused feature."""
    x = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 1, 3.0), (1, 0, 0.0), (1, 2, 4.0)], "soma_dim_0 long, soma_dim_1 long, soma_data double")
    obs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "soma_joinid long, kind string")
    var = spark.createDataFrame([(i, f"g{i}") for i in range(4)], "soma_joinid long, name string")
    return obs, var, transform.eliminate_zeros(transform.sum_duplicates(x))


def by_id(df, *columns):
    return {r["soma_joinid"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_mean_variance_counts_zeros(spark):
    q = axis.axis_query(*matrix(spark))
    dense = np.array([[1, 5, 0, 0], [0, 0, 4, 0], [0, 0, 0, 0]], float)
    for ax, ids in ((0, 4), (1, 3)):
        for ddof in (0, 1, 100):
            found = by_id(stats.mean_variance(q, ax, ddof), "mean", "variance")
            n = dense.shape[ax]
            for i in range(ids):
                cells = dense[:, i] if ax == 0 else dense[i]
                assert found[i][0] == pytest.approx(cells.mean())
                assert found[i][1] == (pytest.approx(((cells - cells.mean()) ** 2).sum() / (n - ddof)) if n > ddof else None)


def test_stored_values_only_has_nulls(spark):
    found = by_id(stats.mean_variance(axis.axis_query(*matrix(spark)), nnz_only=True), "mean", "variance")
    assert found[3] == (None, None) and found[1] == (5.0, None)


@pytest.mark.parametrize("ddof", [0, 1])
def test_random_matrices(spark, ddof):
    r = np.random.default_rng(5)
    dense = np.where(r.random((120, 51)) < 0.1, r.random((120, 51)) * 100, 0).astype(np.float32)
    i, j = np.nonzero(dense)
    x = spark.createDataFrame([(int(a), int(b), float(dense[a, b])) for a, b in zip(i, j, strict=True)], "soma_dim_0 long, soma_dim_1 long, soma_data float")
    ids = lambda n: spark.range(n).withColumnRenamed("id", "soma_joinid")
    found = by_id(stats.mean_variance(axis.axis_query(ids(120), ids(51), x), 0, ddof), "mean", "variance")
    for k in range(51):
        assert found[k] == pytest.approx((dense[:, k].mean(dtype=float), dense[:, k].astype(float).var(ddof=ddof)), rel=1e-6)


def test_coords(spark):
    obs = spark.range(50).withColumnRenamed("id", "soma_joinid")
    ids = lambda c: sorted(r[0] for r in axis.at_coords(obs, c).collect())
    assert ids(slice(3, 5)) == [3, 4, 5] and ids(7) == [7] and ids([1, 99]) == [1] and len(ids(None)) == 50
    assert ids(slice(None, 2)) == [0, 1, 2] and ids(slice(48, None)) == [48, 49]
    assert len(ids(list(range(0, 5000, 2)))) == 25
    with pytest.raises(ValueError):
        axis.at_coords(obs, slice(0, 9, 2))


def test_empty_slice(spark):
    obs, var, x = matrix(spark)
    q = axis.axis_query(obs, var, x, "kind = 'none'")
    assert q.X.count() == 0 and q.sizes().first()["n_obs"] == 0


def test_rounding():
    x = (np.arange(-9999, 10000) / 9999.999).astype(np.float32)
    for bits in range(8, 23):
        out = round_mantissa(x, bits)
        assert np.all(np.abs(out - x) <= np.abs(x) * 2.0 ** -(bits + 1) * 1.0001)
        assert np.all(out.view(np.uint32) & np.uint32((1 << (23 - bits)) - 1) == 0)
    assert np.isnan(round_mantissa(np.array([np.nan], np.float32), 8)[0])


def test_rounded_column(spark):
    df = spark.createDataFrame([(1.2345678,), (None,), (0.0,)], "v float")
    got = [r[0] for r in df.select(rounded(df.v, 7, keep_positive=True)).collect()]
    assert got[0] == pytest.approx(1.2345678, rel=2**-8) and got[1] is None and got[2] > 0


def test_loess_follows_a_parabola():
    x = np.linspace(0, 10, 200)
    assert np.abs(loess(x, 3 * x * x - x + 2, 0.3) - (3 * x * x - x + 2)).max() < 1e-6


def test_loess_between_knots(monkeypatch):
    from sparsefold.functions import loess as module

    r = np.random.default_rng(3)
    x = r.normal(size=3000)
    y = np.sin(x) + r.normal(size=3000) * 0.05
    coarse = loess(x, y, 0.2)
    monkeypatch.setattr(module, "KNOTS", 10_000)
    assert np.abs(coarse - loess(x, y, 0.2)).max() < 1e-3


def test_hvg_finds_the_varying_features(spark):
    r = np.random.default_rng(1)
    dense = r.poisson(np.linspace(1, 10, 40), (200, 40)).astype(float)
    for k in (10, 20, 30):  # the mean of its neighbours, but far more spread
        dense[:, k] = r.poisson(dense[:, k].mean() * 4, 200) * (r.random(200) < 0.25)
    i, j = np.nonzero(dense)
    x = spark.createDataFrame([(int(a), int(b), float(dense[a, b])) for a, b in zip(i, j, strict=True)], "soma_dim_0 long, soma_dim_1 long, soma_data double")
    ids = lambda n: spark.range(n).withColumnRenamed("id", "soma_joinid")
    out = hvg.highly_variable(axis.axis_query(ids(200), ids(40), x), None, 3, span=0.6).collect()
    assert {r["soma_joinid"] for r in out if r["highly_variable"]} == {10, 20, 30}


def test_loess_error_of_interpolation():
    r = np.random.default_rng(4)
    x = np.sort(r.normal(size=3000))
    y = np.cos(x) + r.normal(size=3000) * 0.1
    at = np.arange(0, 3000, 37)
    k = int(np.ceil(0.3 * 3000))
    for i, value in zip(at, loess(x, y, 0.3)[at], strict=True):  # a weighted quadratic at the point itself
        near = np.argsort(np.abs(x - x[i]), kind="stable")[:k]
        d = np.abs(x[near] - x[i])
        w = (1 - (d / d.max()) ** 3) ** 3
        assert value == pytest.approx(np.polyval(np.polyfit(x[near] - x[i], y[near], 2, w=np.sqrt(w)), 0), abs=1e-4)


def _hvg_by_hand(dense, batches, n_top, span):
    """Ranks and normalised variances of a dense matrix, batch by batch, with the trend fitted point by point."""
    norms = []
    for b in sorted(set(batches)):
        m = dense[batches == b]
        n, mean, variance = len(m), m.mean(axis=0), m.var(axis=0, ddof=1)
        varies = variance > 0
        x, y = np.log10(mean[varies]), np.log10(variance[varies])
        k = min(len(x), max(3, int(np.ceil(span * len(x)))))
        fitted = np.empty(len(x))
        for i in range(len(x)):
            near = np.argsort(np.abs(x - x[i]), kind="stable")[:k]
            d = np.abs(x[near] - x[i])
            w = np.sqrt(np.maximum((1 - (d / d.max()) ** 3) ** 3, 0))
            design = np.stack([np.ones(k), x[near] - x[i], (x[near] - x[i]) ** 2], axis=1)
            fitted[i] = np.linalg.lstsq(design * w[:, None], y[near] * w, rcond=None)[0][0]
        std = np.ones(len(mean))
        std[varies] = np.sqrt(10**fitted)
        clipped = np.minimum(m, std * np.sqrt(n) + mean)
        norms.append((n * mean**2 + (clipped**2).sum(axis=0) - 2 * mean * clipped.sum(axis=0)) / ((n - 1) * std**2))
    norms = np.stack(norms)
    ranks = np.argsort(np.argsort(-norms, axis=1, kind="stable"), axis=1, kind="stable").astype(float)
    below = np.where(ranks < n_top, ranks, np.nan)
    return norms.mean(axis=0), below, (ranks < n_top).sum(axis=0)


@pytest.mark.parametrize("by", ["columns", "expression", None])
def test_hvg_against_numpy(spark, by):
    from pyspark.sql import functions as F

    r = np.random.default_rng(8)
    dense = r.poisson(r.gamma(1.0, 2.0, 120), (150, 120)).astype(float)
    dense[:, 5] = 0
    dense[:60, 9] = 0
    i, j = np.nonzero(dense)
    x = spark.createDataFrame([(int(a), int(b), float(dense[a, b])) for a, b in zip(i, j, strict=True)], "soma_dim_0 long, soma_dim_1 long, soma_data double")
    obs = spark.createDataFrame([(k, "a" if k < 60 else "b", k % 2) for k in range(150)], "soma_joinid long, site string, run long")
    var = spark.range(120).withColumnRenamed("id", "soma_joinid")
    batch = {"columns": ["site"], "expression": F.concat("site", F.lit("!"), F.col("run").cast("string")), None: None}[by]
    labels = np.array([{"columns": "a" if k < 60 else "b", "expression": f"{'a' if k < 60 else 'b'}{k % 2}", None: ""}[by] for k in range(150)])
    out = {x["soma_joinid"]: x for x in hvg.highly_variable(axis.axis_query(obs, var, x), batch, 15).collect()}
    norm, below, times = _hvg_by_hand(dense, labels, 15, 0.3)
    median = [np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else np.inf for c in below.T]
    first = sorted(range(120), key=lambda g: (median[g], -times[g], g))[:15]
    for g in range(120):
        assert out[g]["means"] == pytest.approx(dense[:, g].mean()) and out[g]["variances"] == pytest.approx(dense[:, g].var(ddof=1))
        assert out[g]["variances_norm"] == pytest.approx(norm[g], rel=1e-6, abs=1e-9)
        assert out[g]["highly_variable"] == (g in first)
        assert out[g]["highly_variable_rank"] == (None if median[g] == np.inf else median[g])


def test_tokens_keep_their_marks(spark):
    _, _, x = matrix(spark)
    rows = {r[0]: list(r[1]) for r in transform.tokens(x, 3, 90, 91).collect()}
    assert rows == {0: [90, 1, 91], 1: [90, 2, 91]}


def test_row_digests(spark):
    x = spark.createDataFrame([(0, 1, 2.0), (0, 2, 3.0), (1, 2, 3.0), (1, 1, 2.0), (2, 1, 3.0), (2, 2, 2.0)], "soma_dim_0 long, soma_dim_1 long, soma_data double")
    d = {r[0]: r[1] for r in dedup.row_digests(x).collect()}
    assert d[0] == d[1] != d[2]


def test_lookup_marks_missing(spark):
    e = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<float>")
    out = embedding.lookup(spark.createDataFrame([(0, 5), (1, 1)], "pos long, id long"), e, 2).orderBy("pos").collect()
    assert all(np.isnan(out[0]["vector"])) and list(out[1]["vector"]) == [1.0, 2.0]


def test_nearest_and_ivf_recall(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(600, 8)).astype(np.float32)
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<float>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:20] + 0.01)], "query_id long, vector array<float>")
    exact = {}
    for row in embedding.nearest(q, e, 5).collect():
        exact.setdefault(row["query_id"], set()).add(row["id"])
    for i in range(20):
        d = np.sqrt(((v.astype(float) - (v[i] + np.float32(0.01)).astype(float)) ** 2).sum(axis=1))
        assert exact[i] == set(np.argsort(d, kind="stable")[:5].tolist())
    near = {}
    for row in embedding.nearest_ivf(q, e, embedding.train_ivf(e), 5, 12).collect():
        near.setdefault(row["query_id"], set()).add(row["id"])
    assert sum(len(exact[i] & near[i]) for i in range(20)) >= 0.9 * 100


def test_nearest_is_exact_where_many_rows_tie(spark):
    r = np.random.default_rng(5)
    equal = [(i, [1.0, 2.0, 3.0]) for i in range(400)]
    far = [(400 + i, (np.array([1e7, 1e7, 1e7]) + x).astype(np.float32).tolist()) for i, x in enumerate(r.integers(0, 40, (300, 3)))]
    rows = [(i, v) for i, v in equal + far]
    e = spark.createDataFrame([rows[i] for i in r.permutation(len(rows))], "id long, vector array<float>").coalesce(1)
    asked = [(0, [1.0, 2.0, 3.5]), (1, far[0][1]), (2, far[7][1])]
    out = embedding.nearest(spark.createDataFrame(asked, "query_id long, vector array<float>"), e, 5).orderBy("query_id", "place").collect()
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    for q, x in asked:
        d = np.sqrt(((v - np.array(x)) ** 2).sum(axis=1))
        assert [r["id"] for r in out if r["query_id"] == q] == ids[np.lexsort((ids, d))[:5]].tolist()


def test_ivf_query_reaches_its_recall(spark, tmp_path):
    from sparsefold.plans.catalogue import QUERIES

    v = np.random.default_rng(6).normal(size=(2000, 16)).astype(np.float32)
    rows = [(i, x.tolist(), "a") for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    exact, near = ({(r["query_id"], r["id"]) for r in QUERIES[q](spark, str(tmp_path)).collect()} for q in ("find_nearest_obs", "find_nearest_ivf"))
    assert len(exact & near) >= 0.93 * len(exact) == 930


def test_shards_are_even(spark):
    for n, k in ((10, 3), (3, 5), (12, 4)):
        rows = ranking.shards(spark.range(n).withColumnRenamed("id", "soma_joinid"), k, n).collect()
        sizes = [sum(r["shard"] == s for r in rows) for s in range(k)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n


def test_last_record_wins_at_the_first_place(spark):
    df = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("a", 3, 2)], "k string, v long, pos long")
    assert sorted(tuple(r) for r in ranking.last_record(df, "k").collect()) == [("a", 3, 0), ("b", 2, 1)]


def test_multi_value_labels(spark):
    df = spark.createDataFrame([(1, "x || y z"), (2, "q")], "id long, disease string")
    assert sorted(tuple(r) for r in summary.explode_labels(df, "disease").collect()) == [(1, "x"), (1, "y z"), (2, "q")]


def test_slower_runs(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 12.0), ("b", 1, 10.0), ("b", 2, 11.0)], "benchmark string, ts long, seconds double")
    assert [r["benchmark"] for r in release.slower_than_first(df).collect()] == ["a"]


def test_open_corpus(spark):
    directory = {"stable": "V1", "V1": "2023", "2023": {"soma": {"uri": "s3://x/2023", "relative_uri": "2023/"}}, "loop": "loop2", "loop2": "loop"}
    assert corpus.open_corpus(spark, directory=directory).base == "s3://x/2023"
    mirrors = {"default": "m", "m": {"provider": "S3", "base_uri": "s3://m/"}, "n": {"provider": "other", "base_uri": "z://n/"}}
    assert corpus.open_corpus(spark, directory=directory, mirrors=mirrors).base == "s3://m/2023"
    assert corpus.open_corpus(spark, uri="file:///c/").base == "file:///c"
    for bad in ({"version": None}, {"version": "none"}, {"version": "loop"}, {"mirror": "no", "mirrors": mirrors}, {"mirror": "n", "mirrors": mirrors}):
        with pytest.raises(ValueError):
            corpus.open_corpus(spark, **{"directory": directory} | bad)


def test_organisms():
    assert corpus.organism_key(" Homo  sapiens ") == "homo_sapiens"
    with pytest.raises(ValueError):
        corpus.organism_key("Felis", ["homo_sapiens"])
    with pytest.raises(TypeError):
        corpus.organism_key(3)


def test_round_trip(spark, tmp_path):
    obs, var, x = matrix(spark)
    base = str(tmp_path / "c")
    root = f"{base}/homo_sapiens"
    assert tuple(corpus.write_frame(obs, f"{root}/obs").first()) == (0, 2, 3)
    corpus.write_frame(var, f"{root}/ms/RNA/var")
    corpus.write_sparse(x, f"{root}/ms/RNA/X/raw")
    spark.createDataFrame([(1, 1)], "dataset_id long, var_joinid long").write.parquet(f"{root}/ms/RNA/presence")
    e = corpus.open_corpus(spark, uri=base).experiment("Homo sapiens")
    q = axis.axis_query(e.obs, e.ms["RNA"].var, e.ms["RNA"].layers["raw"], "kind = 'a'")
    assert sorted(tuple(r) for r in q.X.collect()) == [(0, 0, 1.0), (0, 1, 5.0)]
    corpus.compact(spark, f"{root}/ms/RNA/X/raw", str(tmp_path / "small"), 1)
    assert spark.read.parquet(str(tmp_path / "small")).count() == 3


def test_manifest_and_blocklist(spark, tmp_path):
    (tmp_path / "m.csv").write_text("dataset_id,dataset_asset_h5ad_uri\na,u1\nb,u2\na,u3\n")
    (tmp_path / "b.txt").write_text("# all of it\n\nb # old\n")
    manifest = ranking.last_record(corpus.read_manifest(spark, str(tmp_path / "m.csv")), "dataset_id")
    blocked = corpus.read_blocklist(spark, str(tmp_path / "b.txt"))
    from sparsefold.operators.build import without_blocked

    assert [(r["dataset_id"], r["dataset_asset_h5ad_uri"]) for r in without_blocked(manifest, blocked).collect()] == [("a", "u3")]


def test_stream(spark, tmp_path):
    from sparsefold.streaming.online import online_mean_variance

    spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("k string, v double").parquet(str(tmp_path / "s"))
    q = online_mean_variance(stream, "k", "v").writeStream.outputMode("complete").format("memory").queryName("online").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("online").collect()) == [("a", 2, 2.0, 2.0), ("b", 1, 5.0, None)]


def test_lists_in_brackets():
    f = axis.in_parentheses
    assert f("a in ['x', \"y[1]\"] and b == 'it\\'s [z]'") == "a in ('x', \"y[1]\") and b == 'it\\'s [z]'"
    assert f("`c[1]` > 2 or d not in [1, 2]") == "`c[1]` > 2 or d not in (1, 2)"


def test_incremental_slices(spark):
    obs, var, x = matrix(spark)
    q = axis.axis_query(obs, var, x)
    parts = list(axis.incremental(q, 2))
    assert [sorted(r[0] for r in p.obs.select("soma_joinid").collect()) for p in parts] == [[0, 1], [2]]
    assert sorted(tuple(r) for p in parts for r in p.X.collect()) == sorted(tuple(r) for r in x.collect())
    assert list(axis.incremental(axis.axis_query(obs, var, x, "kind = 'none'"), 2)) == []


def test_export_and_reindex(spark):
    obs, var, x = matrix(spark)
    e = spark.createDataFrame([(0, [1.0, 2.0])], "id long, vector array<float>")
    out = axis.export(axis.axis_query(obs, var, x, "kind in ['a']"), {"scvi": (e, 2)}, {"twice": x.withColumn("soma_data", x.soma_data * 2)})
    found = {r["soma_joinid"]: list(r["scvi"]) for r in out["obs"].collect()}
    assert found[0] == [1.0, 2.0] and all(np.isnan(found[2])) and set(found) == {0, 2}
    assert sorted(tuple(r) for r in out["twice"].collect()) == [(0, 0, 2.0), (0, 1, 10.0)] and out["var"].count() == 4
    places = spark.createDataFrame([(1, 0), (0, 5)], "soma_joinid long, place long")
    assert sorted(tuple(r) for r in axis.reindexed(x, places).collect()) == [(0, 2, 4.0), (5, 0, 1.0), (5, 1, 5.0)]


def test_embedding_round_trip(spark, tmp_path):
    from sparsefold.operators import ingest

    array = np.random.default_rng(2).normal(size=(25, 3)).astype(np.float32)
    np.save(tmp_path / "e.npy", array)
    ids = spark.createDataFrame([(i, 100 - i) for i in range(20)], "place long, id long")
    ingest.write_embedding(ingest.read_npy(spark, str(tmp_path / "e.npy"), ids, rows_per_task=7), str(tmp_path / "e"))
    got = {r["id"]: list(r["vector"]) for r in spark.read.parquet(str(tmp_path / "e")).collect()}
    assert got == {100 - i: array[i].tolist() for i in range(20)}
    coarse = ingest.quantised(spark.createDataFrame([(1, [1.0, 1.0000001]), (2, None), (3, [])], "id long, vector array<float>"), 8)
    assert {r["id"]: r["vector"] for r in coarse.collect()} == {1: [1.0, 1.0], 2: None, 3: []}


def test_embedding_records():
    from sparsefold.operators import ingest

    good = {"id": "a", "embedding_name": "e", "organism": "o", "version": "V1", "submission_date": "2024-01-01", "n_embeddings": 3, "n_features": 2, "data_type": "obs_embedding"}
    assert ingest.metadata_faults(good) == [] and ingest.require_version(good, "V1") is None
    assert len(ingest.metadata_faults(good | {"organism": "", "n_features": 0, "data_type": "cells"})) == 3
    with pytest.raises(ValueError, match="V2"):
        ingest.require_version(good, "V2")


def test_injected_embeddings(spark):
    m = corpus.Measurement(spark.range(1), {})
    both = corpus.inject_embedding(corpus.inject_embedding(m, "a", spark.range(2)), "b", spark.range(3))
    assert set(both.embeddings) == {"a", "b"} and not m.embeddings
    with pytest.raises(ValueError):
        corpus.inject_embedding(both, "a", spark.range(1))


def test_storage_context(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "c" / "info" / "t" / "part=1"))
    context = corpus.StorageContext({"recursiveFileLookup": "false"})
    changed = context.replace(recursiveFileLookup=True)
    assert context.options == {"recursiveFileLookup": "false"} and changed.options == {"recursiveFileLookup": "True"}
    opened = [corpus.open_corpus(spark, uri=str(tmp_path / "c"), context=c).info("t").columns for c in (context, changed)]
    assert opened == [["id", "part"], ["id"]]


def test_missing_objects(spark, tmp_path):
    from sparsefold.operators import validate

    spark.range(3).write.parquet(str(tmp_path / "obs"))
    (tmp_path / "empty").mkdir()
    assert validate.missing_objects(spark, str(tmp_path), ["obs", "empty", "none"]) == ["empty", "none"]
