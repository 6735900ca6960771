"""Principal components of the sparse matrix by block Krylov iteration; the centred matrix is never formed.

The basis lives on the feature axis: a random block, drawn per feature by hashes, and its images under the covariance, each
freed of all blocks before it and orthogonalised by a tree of QR factors. The stored values lie in blocks of whole observations
that are neighbours on their axis. A block gets the numbers of its features once, however many values it has of them, and gives
back one sum a feature, so an image moves features times blocks they occur in, and never numbers for each stored value; values
scattered over all features (a feature once a block) are the worst case. Since the columns of the centred matrix sum to 0,
centring subtracts n times mean x (mean B) from it and nothing else. The projected covariance of the basis is a matrix of basis x basis on the
driver, which its eigenvectors turn into components; the last block's image gives each one's residual, by which the iteration stops.

The driver and each task's state hold matrices of at most max_basis columns squared, a task also NUMBERS of a block and an
observation's values; features x basis is a table. Missing values are zeros, values without both ids are left out, features without a stored value have no row, repeated coordinates must be
summed before. An empty matrix has no components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparsefold.operators.places import parts
from sparsefold.sources.scratch import written

#: Partitions whose QR factors meet in one task.
FAN_IN = 32
#: Stored values of a block times the columns that they are multiplied by.
NUMBERS = 1 << 23


@dataclass(frozen=True)
class Components:
    """loadings: soma_dim_1, mean, loading (an array of k); variances and their residuals, relative to the largest; the total
    variance; the number of observations."""

    loadings: DataFrame
    variances: list[float]
    residuals: list[float]
    total: float
    n_obs: int


def _normal(id_col: Column, i: int, seed: int) -> Column:
    """A standard normal number for an id, the same whatever the partitioning."""
    unit = lambda salt: (F.pmod(F.xxhash64(id_col, F.lit(seed), F.lit(i), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * math.pi * unit(2))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _arrays(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def qr_factor(df: DataFrame, column: str, width: int) -> np.ndarray:
    """The triangular factor of an array column's rows: factors per partition, then of FAN_IN partitions' factors, and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                r = np.linalg.qr(np.vstack([r, _matrix(batch, "v")]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([row.tolist() for row in r], pa.list_(pa.float64()))], ["v"])

    factors = written(df.select(F.col(column).alias("v")).mapInArrow(run, "v array<double>"), "pca-factors")
    tasks = -(-factors.count() // width)
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        factors = factors.repartition(tasks).mapInArrow(run, "v array<double>")
    found = [r["v"] for r in factors.collect()]  # FAN_IN factors at most
    return np.linalg.qr(np.array(found).reshape(-1, width), mode="r") if found else np.zeros((0, width))


def independent(r: np.ndarray, least: float) -> np.ndarray:
    """What turns columns with the triangular factor r into an orthonormal basis of their span, without directions below least."""
    _, sizes, rows = np.linalg.svd(r)
    kept = sizes > least
    return rows[: len(sizes)][kept].T / sizes[kept]


def gram(df: DataFrame, left: str, right: str, shape: tuple[int, int]) -> np.ndarray:
    """left' right for two array columns: partial products per partition, summed cell by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                out += _matrix(batch, "a").T @ _matrix(batch, "b")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], ["at", "v"])

    sums = df.select(F.col(left).alias("a"), F.col(right).alias("b")).mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(shape[0] * shape[1])
    for r in sums.collect():  # a row per cell
        out[r["at"]] = r["v"]
    return out.reshape(shape)


def _combined(df: DataFrame, parts: dict[str, np.ndarray], into: str) -> DataFrame:
    """df with the sum of its array columns times matrices."""
    names = df.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{into}` array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = sum(_matrix(batch, c) @ m for c, m in parts.items())
            yield pa.RecordBatch.from_arrays([*batch.columns, _arrays(out)], [*names, into])

    return df.mapInArrow(run, schema)


def _freed(base: DataFrame, steps: list[tuple[np.ndarray, np.ndarray]], *kept: str) -> DataFrame:
    """Columns of base and block: the newest image after all steps, each of which multiplies it and subtracts the basis times a matrix."""
    schema = ", ".join([*(f"`{c}` {t}" for c, t in base.select(*kept).dtypes), "block array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            basis, out = _matrix(batch, "basis"), _matrix(batch, "image")
            for turn, off in steps:
                out = out @ turn - basis @ off
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _arrays(out)], [*kept, "block"])

    return base.select(*dict.fromkeys([*kept, "basis", "image"])).mapInArrow(run, schema)


def dealt(x: DataFrame, width: int, whole: bool = False) -> DataFrame:
    """at, soma_dim_0, soma_dim_1 and v: the stored values in blocks of whole observations, numbered by at, written once.

    A block ends with the observation that reaches its size, NUMBERS by width columns. whole: a partition of x has all values
    of its observations. Blocks are then made where these are, which saves a shuffle, but neighbours needn't share a block.
    """
    size = max(1, NUMBERS // max(1, width))
    ids = [F.col(c).cast("bigint").alias(c) for c in ("soma_dim_0", "soma_dim_1")]
    rows = x.select(*ids, F.coalesce(F.col("soma_data").cast("double"), F.lit(0.0)).alias("v")).dropna(subset=["soma_dim_0", "soma_dim_1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, begun, last, done = TaskContext.get().partitionId() << 32, 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            obs = batch.column("soma_dim_0").to_numpy()
            fresh = np.concatenate([[obs[0] != last], obs[1:] != obs[:-1]])
            starts = np.maximum.accumulate(np.where(fresh, np.arange(done, done + len(obs)), begun))  # of each value's observation
            begun, last, done = starts[-1], obs[-1], done + len(obs)
            yield pa.RecordBatch.from_arrays([pa.array(first + starts // size), *batch.columns], ["at", *batch.schema.names])

    sorted_rows = (rows if whole else rows.repartitionByRange("soma_dim_0")).sortWithinPartitions("soma_dim_0")
    return written(sorted_rows.mapInArrow(run, "at bigint, soma_dim_0 bigint, soma_dim_1 bigint, v double"), "pca-values")


def _held(cells: DataFrame) -> DataFrame:
    """Dealt values, a block to a task, on the executors' disks: products with them move the other side alone."""
    held = cells.repartition(max(2, parts(cells.count())), "at").persist(StorageLevel.DISK_ONLY)  # one task would be dealt again
    held.count()  # how they are dealt is known to a plan once they are there
    return held


def products(cells: DataFrame, numbers: DataFrame, width: int, back: bool) -> DataFrame:
    """X times numbers (at, soma_dim_1, block: a row per block of cells and feature) as soma_dim_0 and p; with back, X' times
    that, as soma_dim_1 and p, a row per block and feature to be summed."""
    key = "soma_dim_1" if back else "soma_dim_0"

    def run(values: pa.Table, given: pa.Table) -> pa.Table:
        ids, feature = given["soma_dim_1"].to_numpy(), values["soma_dim_1"].to_numpy()
        order = np.argsort(ids)
        ids, b = ids[order], given["block"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(order), width)[order]
        place = np.minimum(np.searchsorted(ids, feature), max(0, len(ids) - 1))
        known = ids[place] == feature if len(ids) else np.zeros(len(feature), dtype=bool)
        place, v = place[known], values["v"].to_numpy()[known]
        obs, row = np.unique(values["soma_dim_0"].to_numpy()[known], return_inverse=True)
        out = np.empty((len(ids if back else obs), width))
        for i in range(width):
            p = np.bincount(row, v * b[place, i], len(obs))
            out[:, i] = np.bincount(place, v * p[row], len(ids)) if back else p
        return pa.Table.from_arrays([pa.array(ids if back else obs), _arrays(out)], [key, "p"])

    return cells.groupBy("at").cogroup(numbers.select("at", "soma_dim_1", "block").groupBy("at")).applyInArrow(run, f"{key} bigint, p array<double>")


def _image(cells: DataFrame, features: DataFrame, width: int, n_obs: int) -> DataFrame:
    """features with image: the covariance times block, and with block at the end of basis."""
    shift = features.agg(*[F.sum(F.col("mean") * F.col("block")[i]) for i in range(width)]).first()
    sent = features.select(F.explode("blocks").alias("at"), "soma_dim_1", "block")
    sums = products(cells, sent, width, back=True).groupBy("soma_dim_1").agg(*[F.sum(F.col("p")[i]).alias(f"w{i}") for i in range(width)])
    image = F.array(*[(F.col(f"w{i}") - n_obs * F.col("mean") * shift[i]) / (n_obs - 1) for i in range(width)])
    grown = features.select("soma_dim_1", "mean", "blocks", F.concat("basis", "block").alias("basis"))
    return grown.join(sums, "soma_dim_1").select(*grown.columns, image.alias("image"))


def principal_components(x: DataFrame, n_obs: int, k: int = 10, block: int | None = None, max_basis: int = 128, tolerance: float = 1e-6, seed: int = 0) -> Components:
    """The k components of largest variance, over n_obs observations, zeros included.

    x: the matrix, or what dealt made of it. The basis grows by block columns (k + 6) until every residual is below tolerance or the basis is full; residuals are
    given either way.
    """
    cells = x if "at" in x.columns else dealt(x, block or k + 6)
    v = F.col("v")
    sums = cells.groupBy("soma_dim_1", "at").agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    sums = sums.groupBy("soma_dim_1").agg((F.sum("s") / n_obs).alias("mean"), F.sum("q").alias("q"), F.collect_list("at").alias("blocks"))
    features = written(sums, "pca-features")
    size = features.agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("q") - n_obs * F.col("mean") * F.col("mean")).alias("t")).first()
    m, total = size["m"], (size["t"] or 0.0) / max(1, n_obs - 1)
    k = min(k, m)
    width = min(block or k + 6, m)
    if not width or n_obs < 2:
        return Components(features.select("soma_dim_1", "mean", F.array().cast("array<double>").alias("loading")), [], [], total, n_obs)
    start = features.drop("q").withColumns({"basis": F.array().cast("array<double>"), "image": F.array(*[_normal(F.col("soma_dim_1"), i, seed) for i in range(width)])})
    base, inside, covariance = written(start, "pca-start"), np.zeros((0, width)), np.zeros((0, 0))
    values, vectors, residuals, largest = np.zeros(0), np.zeros((0, 0)), [], 0.0
    held = _held(cells)
    try:
        while True:
            # the newest image, made orthogonal to the basis and in itself, is the next block; twice, for rounding
            steps = [(np.eye(inside.shape[1]), inside)]
            r = qr_factor(_freed(base, steps), "block", inside.shape[1])
            turn = independent(r, 1e-9 * (largest or np.abs(r).max(initial=0.0)))
            if not turn.shape[1]:
                residuals = [0.0] * len(values)  # the basis holds all that the covariance reaches
                break
            steps.append((turn, np.zeros((len(covariance), turn.shape[1]))))
            again = gram(_freed(base, steps, "basis"), "basis", "block", (len(covariance), turn.shape[1]))
            steps[-1] = (turn, again)
            turn = independent(qr_factor(_freed(base, steps), "block", turn.shape[1]), 0.1)
            if not turn.shape[1]:
                residuals = [0.0] * len(values)
                break
            new, old = turn.shape[1], len(covariance)
            steps.append((turn, np.zeros((old, new))))
            # what is cheap to make again from the basis and the image isn't written
            base = written(_image(held, _freed(base, steps, "soma_dim_1", "mean", "blocks", "basis"), new, n_obs), "pca-image")
            inside = gram(base, "basis", "image", (old + new, new))
            grown = np.zeros((old + new, old + new))
            grown[:old, :old], grown[:, old:], grown[old:, :] = covariance, inside, inside.T
            covariance = (grown + grown.T) / 2
            values, vectors = np.linalg.eigh(covariance)
            order = np.argsort(-values)[:k]
            values, vectors = values[order], vectors[:, order]
            # a component lacks what the newest block's image has outside the basis; the images of older blocks are inside
            outside = gram(base, "image", "image", (new, new)) - inside.T @ inside
            newest, largest = vectors[old:], max(float(values[0]), 0.0)
            lack = np.sqrt(np.maximum(0.0, np.einsum("ik,ij,jk->k", newest, outside, newest)))
            residuals = (lack / (largest or 1.0)).tolist()
            if len(values) == k and max(residuals) <= tolerance or old + 2 * new > max_basis:
                break
    finally:
        held.unpersist()
    loadings = _combined(base, {"basis": vectors}, "loading").select("soma_dim_1", "mean", "loading")
    return Components(written(loadings, "pca-loadings"), values.tolist(), residuals, total, n_obs)


def scores(x: DataFrame, obs_ids: DataFrame, found: Components) -> DataFrame:
    """soma_joinid and pc, an array of k, for all observations: those without a stored value, too. x as for principal_components."""
    k = len(found.variances)
    shift = found.loadings.agg(*[F.coalesce(F.sum(F.col("mean") * F.col("loading")[i]), F.lit(0.0)) for i in range(k)]).first() if k else []
    cells = x if "at" in x.columns else dealt(x, k)
    asked = cells.select(F.col("at").alias("at"), F.col("soma_dim_1").alias("soma_dim_1")).distinct().join(found.loadings.select("soma_dim_1", F.col("loading").alias("block")), "soma_dim_1")
    onto = products(cells, asked, k, back=False)
    centred = F.array(*[F.coalesce(F.col("p")[i], F.lit(0.0)) - shift[i] for i in range(k)])
    return obs_ids.select(F.col("soma_joinid").alias("soma_dim_0")).join(onto, "soma_dim_0", "left").select(F.col("soma_dim_0").alias("soma_joinid"), centred.alias("pc"))
