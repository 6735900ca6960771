"""Embeddings: lookup, nearest neighbours, label transfer and checks. embeddings: id, vector ARRAY<FLOAT>."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the queries and of the rows that a task compares, as doubles: what is copied falls as both grow.
SIDE_BYTES = 64 << 20
#: Pairs of a block and a part that keep a small cluster busy, at least.
PAIRS = 48
#: Distances that are held at a time: 16 MB.
CELLS = 1 << 21
#: Parts over which the rows of one list are dealt.
SPREAD = 16


def lookup(requested: DataFrame, embeddings: DataFrame, dimensions: int) -> DataFrame:
    """pos, id, vector for requested (pos, id), in request order by pos; NaN in every place where an id has none."""
    nothing = F.array_repeat(F.lit(float("nan")).cast("float"), dimensions)
    return requested.join(embeddings, "id", "left").select("pos", "id", F.coalesce("vector", nothing).alias("vector"))


def _some_of_equals(ids: np.ndarray, vectors: np.ndarray, lists: np.ndarray, k: int):
    """Rows by id, as doubles, with their lists; of equal vectors of a list only the k smallest ids, as no others can be among the nearest."""
    order = np.argsort(ids, kind="stable")
    ids, vectors, lists = ids[order], vectors[order], lists[order]
    _, group = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
    group = group.ravel() * (int(lists.max(initial=0)) + 1) + lists
    by_group = np.argsort(group, kind="stable")
    first = np.searchsorted(group[by_group], group[by_group])
    keep = np.sort(by_group[np.arange(len(ids)) - first < k])
    return ids[keep], vectors[keep].astype(float), lists[keep]


def _closest(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, allowed: np.ndarray | None = None):
    """The k nearest rows (by ascending id) of every query by (exact distance, id): query_ids, ids and distances.

    Products of matrices give each distance with a bound of its rounding error. Every row that may be among the k nearest
    within those bounds is measured exactly, however many there are. allowed (queries x rows) leaves out the others.
    """
    sizes, bound = (vectors**2).sum(axis=1), 8 * (vectors.shape[1] + 8) * np.finfo(float).eps
    m, step = min(k, len(ids)), max(1, CELLS // len(ids))
    out = []
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, len(queries), step):
            some = queries[at : at + step]
            both = (some**2).sum(axis=1)[:, None] + sizes[None]
            near, error = both - 2 * some @ vectors.T, bound * both
            high = near + error if allowed is None else np.where(allowed[at : at + step], near + error, np.inf)
            limit = np.partition(high, m - 1, axis=1)[:, m - 1 : m]
            possible = ~(near - error > limit)  # what isn't a number is measured as well
            if allowed is not None:
                possible &= allowed[at : at + step]
            for query_id, q, row in zip(query_ids[at : at + step], some, possible, strict=True):
                found = np.flatnonzero(row)
                exact = np.sqrt(((vectors[found] - q) ** 2).sum(axis=1))
                best = np.lexsort((ids[found], exact))[:m]
                out.append((np.repeat(query_id, len(best)), ids[found[best]], exact[best]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def probed(queries: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """Queries x lists: whether a list is among a query's probes nearest."""
    d = (queries**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1)[None] - 2 * queries @ centroids.T
    out = np.zeros(d.shape, bool)
    np.put_along_axis(out, np.argsort(d, axis=1, kind="stable")[:, :probes], True, axis=1)
    return out


def _closest_probed(ids: np.ndarray, vectors: np.ndarray, lists: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, centroids: np.ndarray, probes: int):
    """_closest() among the rows of each query's lists. Queries of one nearest list come together, so that few rows are compared in vain."""
    step = max(1, min(256, CELLS // len(centroids)))
    home = [((c**2).sum(axis=1)[:, None] - 2 * c @ centroids.T + (centroids**2).sum(axis=1)[None]).argmin(axis=1) for c in (queries[i : i + step] for i in range(0, len(queries), step))]
    order = np.argsort(np.concatenate(home), kind="stable")
    out = [(query_ids[:0], ids[:0], np.zeros(0))]
    for at in range(0, len(order), step):
        some = order[at : at + step]
        mask = probed(queries[some], centroids, probes)
        used = np.flatnonzero(mask.any(axis=0)[lists])
        if len(used):
            rows = slice(None) if len(used) == len(ids) else used
            out.append(_closest(ids[rows], vectors[rows], query_ids[some], queries[some], k, None if mask.all() else mask[:, lists[rows]]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def nearest(queries: DataFrame, embeddings: DataFrame, k: int = 10, centroids: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """query_id, id, distance, place: the k nearest rows of each query by Euclidean distance, exact; ties go by id.

    With centroids only rows of the query's probes nearest lists count; embeddings then have a column list.

    Rows are dealt to parts and queries to blocks by hashes of their ids (rows of one list to SPREAD parts at most); each task
    compares one block with one part and returns k a query at most. A row is copied once a block and a query once a part, so
    both are as large as memory allows. Nothing passes through the driver but two counts and a length.
    """
    rows, asked = embeddings.select("id", "vector", F.lit(0).alias("list") if centroids is None else "list"), queries.select("query_id", "vector")
    count = F.count(F.lit(1)).alias("n")
    n_asked, (n_rows, length) = asked.agg(count).first()["n"], rows.agg(count, F.max(F.size("vector"))).first()
    most = max(1000, SIDE_BYTES // (8 * max(1, length or 1)))
    blocks = max(1, math.ceil(n_asked / most))
    parts = max(math.ceil(n_rows / most), math.ceil(PAIRS / blocks))

    def grid(df, key, own, n, other, m):
        dealt = df.withColumns({own: F.pmod(key, F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
        return dealt.groupBy("_part", "_block")

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            found = [[], [], []]
        else:
            (ids, vectors), (query_ids, wanted) = ((t.column(0).to_numpy(), np.stack(t.column(1).to_numpy())) for t in (left, right))
            ids, vectors, lists = _some_of_equals(ids, vectors, left.column(2).to_numpy(), k)
            wanted = wanted.astype(float)
            found = _closest(ids, vectors, query_ids, wanted, k) if centroids is None else _closest_probed(ids, vectors, lists, query_ids, wanted, k, centroids, probes)
        return pa.table([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "id", "distance"])

    row_key = F.xxhash64("id") if centroids is None else F.xxhash64("list", F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
    pairs = grid(rows, row_key, "_part", parts, "_block", blocks).cogroup(grid(asked, F.xxhash64("query_id"), "_block", blocks, "_part", parts))
    found = pairs.applyInArrow(run, "query_id bigint, id bigint, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def train_ivf(embeddings: DataFrame, sample_rows: int = 100_000, seed: int = 0) -> np.ndarray:
    """ceil(sqrt(n)) centroids by k-means on a sample of sample_rows rows at most; every row is indexed later."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = embeddings.count()
    share = min(1.0, sample_rows / max(1, n))
    rows = embeddings.sample(fraction=share, seed=seed) if share < 1 else embeddings
    model = KMeans(k=max(2, math.ceil(math.sqrt(n))), seed=seed, maxIter=10).fit(rows.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features")))
    return np.array(model.clusterCenters())


def assign(embeddings: DataFrame, centroids: np.ndarray, probes: int = 1) -> DataFrame:
    """The rows with list, the numbers of their probes nearest centroids (one row for each)."""
    names = embeddings.columns
    fields = ", ".join(f"`{c}` {t}" for c, t in embeddings.dtypes)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.stack(batch.column(names.index("vector")).to_numpy(zero_copy_only=False)).astype(float)
            d = (v**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1)[None] - 2 * v @ centroids.T
            at = d.argmin(axis=1)[:, None] if probes == 1 else np.argsort(d, axis=1, kind="stable")[:, :probes]
            again = pa.array(np.repeat(np.arange(batch.num_rows), at.shape[1]))
            yield pa.RecordBatch.from_arrays([*[c.take(again) for c in batch.columns], pa.array(at.ravel().astype(np.int32))], [*names, "list"])

    return embeddings.mapInArrow(run, f"{fields}, list int")


def calibrated_probes(queries: DataFrame, embeddings: DataFrame, centroids: np.ndarray, k: int = 10, recall: float = 0.95, sample_rows: int = 200) -> int:
    """The fewest probes that reach the share recall of the true k nearest rows, by brute force on sample_rows queries."""
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample_rows)
    asked = {r["query_id"]: np.array(r["vector"], float) for r in some.select("query_id", "vector").collect()}
    true = nearest(some, embeddings, k).select("query_id", "id")
    found = assign(true.join(embeddings.select("id", "vector"), "id"), centroids).select("query_id", "list").collect()
    if not found:
        return len(centroids)
    ranks = {i: np.argsort(np.argsort((v**2).sum() + (centroids**2).sum(axis=1) - 2 * v @ centroids.T, kind="stable")) for i, v in asked.items()}
    reached = sorted(int(ranks[r["query_id"]][r["list"]]) + 1 for r in found)
    return reached[math.ceil(recall * len(reached)) - 1]


def nearest_ivf(queries: DataFrame, embeddings: DataFrame, centroids: np.ndarray, k: int = 10, probes: int = 8) -> DataFrame:
    """nearest() among the rows of each query's probes nearest lists."""
    return nearest(queries, assign(embeddings.select("id", "vector"), centroids), k, centroids, probes)


def predict(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, label, confidence: the neighbours' most frequent label and its share; ties go to the smallest label."""
    counts = neighbours.join(labels, "id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "label"))
    return counts.withColumn("confidence", share).withColumn("_place", place).filter("_place = 1").select("query_id", "label", "confidence")


def violations(embeddings: DataFrame, axis: DataFrame, dimensions: int) -> DataFrame:
    """One row of counts: rows, repeated ids, ids off the axis, vectors of another length, values that aren't finite."""
    ids = embeddings.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated"))
    off = embeddings.join(axis.select(F.col("soma_joinid").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("off_axis"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    shape = embeddings.agg(F.count_if(F.size("vector") != dimensions).alias("wrong_length"), F.count_if(odd).alias("not_finite"))
    return ids.join(off).join(shape)
