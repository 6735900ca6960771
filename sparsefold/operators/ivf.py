"""An inverted file index of embeddings on disk: two levels of centroids, lists in partitions, appended to without a rebuild.

Centroids are trained on a sample of a documented bound: cells by k-means on Spark, then the lists of each cell by k-means of its
own rows of the sample, cell by cell in parallel. Every row is indexed: it goes to the nearest list of its SEARCHED nearest
cells. Rows are written in partitions by list, ranges of (list, hash of the id) to a task, so a large list has many files
and no task holds one. The number of lists to probe is found once, when the index is built, by brute force on a bounded sample of
rows asked against all rows, and stored. A search ranks the lists for each query, reads the partitions of those lists that
any query probes, and compares blocks of queries with parts of the rows by products of matrices, a query with its own lists
alone; k rows a query and part are all that moves on.

Layout below a path: lists/list=<n>/ (id, vector), centroids (list, cell, centroid) and meta (one row). Recall is what the
calibration reached on its sample; without structure in the vectors, high recall needs a large share of the lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsefold.operators.embedding import nearest, probed

#: Rows of the sample per list, and cells in which a row looks for its list.
PER_LIST, SEARCHED = 60, 4
#: Rows asked to find the number of probes.
ASKED = 200
#: Distances held at a time.
CELLS = 1 << 21


@dataclass(frozen=True)
class Index:
    """An index as it lies on disk; centroids are lists x dimensions, cells the cell of each list, tops the cells' centroids."""

    path: str
    centroids: np.ndarray
    cells: np.ndarray
    tops: np.ndarray
    probes: int
    spark: SparkSession

    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T


def lloyd(rows: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k centroids of a few rows (or the rows themselves, where they are no more than k)."""
    rows = np.unique(rows, axis=0)
    if len(rows) <= k:
        return rows
    draw = np.random.default_rng(seed)
    centres = rows[draw.choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        at = np.concatenate([_distances(rows[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(rows), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, at, rows)
        counts = np.bincount(at, minlength=k)
        full = counts > 0
        centres[full] = sums[full] / counts[full][:, None]
        if not full.all():
            centres[~full] = rows[draw.choice(len(rows), int((~full).sum()), replace=False)]
    return centres


def train(embeddings: DataFrame, lists: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """centroids, cells and tops, from a sample of about PER_LIST rows a list."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = embeddings.count()
    share = min(1.0, PER_LIST * lists / max(1, n))
    sample = embeddings.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(F.col("vector").cast("array<double>").alias("v"))
    cells = max(1, math.ceil(math.sqrt(lists)))
    model = KMeans(k=max(2, cells), seed=seed, maxIter=10).fit(sample.select(array_to_vector("v").alias("features")))
    tops = np.array(model.clusterCenters())
    each = max(1, math.ceil(lists / len(tops)))

    def run(table: pa.Table) -> pa.Table:
        rows = np.stack(table.column("v").to_numpy())
        cell = table.column("list")[0].as_py()
        found = lloyd(rows, each, seed + cell)
        return pa.table([pa.array([cell] * len(found), pa.int32()), pa.array([c.tolist() for c in found], pa.list_(pa.float64()))], ["cell", "centroid"])

    # PER_LIST * each rows a cell on average: the sample is bounded, whatever its cells
    found = nearest_lists(sample, tops, column="v").groupBy("list").applyInArrow(run, "cell int, centroid array<double>").collect()
    found = sorted((r["cell"], r["centroid"]) for r in found)
    return np.array([c for _, c in found]), np.array([c for c, _ in found]), tops


def nearest_lists(df: DataFrame, centroids: np.ndarray, probes: int = 1, column: str = "vector") -> DataFrame:
    """df with list, the numbers of a vector's nearest centroids (a row for each)."""
    names = df.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", list int"
    step = max(1, CELLS // len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                d = _distances(np.stack(batch.column(names.index(column)).to_numpy(zero_copy_only=False)).astype(float), centroids)
                at = d.argmin(axis=1)[:, None] if probes == 1 else np.argsort(d, axis=1, kind="stable")[:, :probes]
                again = pa.array(np.repeat(np.arange(batch.num_rows), at.shape[1]))
                yield pa.RecordBatch.from_arrays([*[c.take(again) for c in batch.columns], pa.array(at.ravel().astype(np.int32))], [*names, "list"])

    return df.mapInArrow(run, schema)


def assigned(embeddings: DataFrame, index: Index) -> DataFrame:
    """id, vector and list: the nearest list of the SEARCHED nearest cells."""
    centroids, cells, tops = index.centroids, index.cells, index.tops
    members = [np.flatnonzero(cells == c) for c in range(len(tops))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // (len(tops) + max(map(len, members))))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                v = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
                near = np.argsort(_distances(v, tops), axis=1, kind="stable")[:, :SEARCHED]
                best, where = np.full(len(v), np.inf), np.zeros(len(v), np.int32)
                for cell in np.unique(near):
                    rows = np.flatnonzero((near == cell).any(axis=1))
                    if len(members[cell]):
                        d = _distances(v[rows], centroids[members[cell]])
                        at, low = d.argmin(axis=1), d.min(axis=1)
                        closer = low < best[rows]
                        best[rows[closer]], where[rows[closer]] = low[closer], members[cell][at[closer]]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where)], ["id", "vector", "list"])

    return embeddings.select("id", F.col("vector").cast("array<float>").alias("vector")).mapInArrow(run, "id bigint, vector array<float>, list int")


def append(index: Index, embeddings: DataFrame) -> None:
    """Add rows to the index. Centroids and probes stay; what is there isn't read."""
    spread = assigned(embeddings, index).withColumn("_h", F.xxhash64("id"))
    spread.repartitionByRange("list", "_h").sortWithinPartitions("list").drop("_h").write.mode("append").partitionBy("list").parquet(f"{index.path}/lists")


def build(embeddings: DataFrame, path: str, lists: int | None = None, k: int = 10, recall: float = 0.95, seed: int = 0) -> Index:
    """Train, index every row, and find the number of probes for a recall of the k nearest rows."""
    spark = embeddings.sparkSession
    n = embeddings.count()
    centroids, cells, tops = train(embeddings, lists or max(2, math.ceil(2 * math.sqrt(n))), seed)
    index = Index(path, centroids, cells, tops, len(centroids), spark)
    append(index, embeddings)
    rows = [(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(cells, centroids, strict=True))]
    spark.createDataFrame(rows, "list int, cell int, centroid array<double>").write.parquet(f"{path}/centroids")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(tops)], "cell int, centroid array<double>").write.parquet(f"{path}/tops")
    probes = calibrated(index, k, recall)
    spark.createDataFrame([(probes, k, recall)], "probes int, k int, recall double").write.parquet(f"{path}/meta")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    found = sorted((r["list"], r["cell"], r["centroid"]) for r in read("centroids").collect())
    tops = sorted((r["cell"], r["centroid"]) for r in read("tops").collect())
    return Index(path, np.array([v for *_, v in found]), np.array([c for _, c, _ in found]), np.array([v for _, v in tops]), read("meta").first()["probes"], spark)


def calibrated(index: Index, k: int, recall: float) -> int:
    """The fewest probes that reach a recall among ASKED rows, which are asked exactly against all rows."""
    rows = index.lists()
    some = rows.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(ASKED).select(F.col("id").alias("query_id"), "vector")
    asked = {r["query_id"]: np.array(r["vector"], float) for r in some.collect()}
    true = nearest(some, rows.select("id", "vector"), k).select("query_id", "id").join(rows.select("id", "list"), "id").collect()
    if not true:
        return len(index.centroids)
    ranks = {i: np.argsort(np.argsort(_distances(v[None], index.centroids)[0], kind="stable")) for i, v in asked.items()}
    reached = sorted(int(ranks[r["query_id"]][r["list"]]) + 1 for r in true)
    return reached[math.ceil(recall * len(reached)) - 1]


def _wanted(queries: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """list: those that any query probes."""
    step = max(1, CELLS // len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(centroids), bool)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                found |= probed(np.stack(batch.slice(start, step).column(0).to_numpy(zero_copy_only=False)).astype(float), centroids, probes).any(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found).astype(np.int32))], ["list"])

    return queries.select("vector").mapInArrow(run, "list int").distinct()


def search(index: Index, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """query_id, id, distance, place: the k nearest rows of each query among its probed lists."""
    probes = min(probes or index.probes, len(index.centroids))
    wanted = sorted(r["list"] for r in _wanted(queries, index.centroids, probes).collect())  # numbers of lists, which prune the partitions
    return nearest(queries, index.lists().filter(F.col("list").isin(wanted)), k, index.centroids, probes)


def share_read(index: Index, queries: DataFrame, probes: int | None = None) -> float:
    """Rows compared per query, as a share of all rows."""
    sizes = index.lists().groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    asked = nearest_lists(queries.select("query_id", "vector"), index.centroids, min(probes or index.probes, len(index.centroids)))
    read = asked.groupBy("list").agg(F.count(F.lit(1)).alias("times")).join(sizes, "list").agg(F.sum(F.col("times") * F.col("n"))).first()[0] or 0
    total, n = sizes.agg(F.sum("n")).first()[0] or 1, queries.count() or 1
    return read / total / n
