"""Windows, samples and numbering with reproducible ties."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lot(id_col: str, seed: int) -> Column:
    """A reproducible draw: the digest of an id and a seed."""
    return F.md5(F.concat_ws("/", F.col(id_col).cast("string"), F.lit(str(seed))))


#: Rows among which a sample's border is drawn in one task.
BORDER = 100_000


def sample_n(df: DataFrame, n: int, id_col: str = "soma_joinid", seed: int = 0) -> DataFrame:
    """n rows, the same ones whatever the partitioning: those of the smallest draws.

    Counts by the draws' first four digits find the group that holds the border; all groups before it are taken whole, and
    the border's group is looked at by four more digits until it has at most BORDER rows, which are put in order.
    """
    draw, prefix = lot(id_col, seed), ""
    while True:
        at = len(prefix)
        group = F.substring(draw, at + 1, 4)
        inside = df.filter(F.startswith(draw, F.lit(prefix))) if prefix else df
        sizes = sorted(tuple(r) for r in inside.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect())  # 65,536 at most
        before = 0
        for border, size in sizes:
            if before + size >= n:
                break
            before += size
        else:
            return df if not prefix else df.filter(F.substring(draw, 1, at) <= prefix)
        left, prefix = n - before, prefix + border
        if size <= BORDER or len(prefix) == 32:
            break
        n = left
    whole = df.filter(F.substring(draw, 1, len(prefix)) < prefix)
    return whole.unionByName(df.filter(F.startswith(draw, F.lit(prefix))).orderBy(draw, id_col).limit(left))


def sample_pct(df: DataFrame, percent: float, id_col: str = "soma_joinid", seed: int = 0) -> DataFrame:
    """That many per cent of the rows, rounded up: the same ones whatever the partitioning."""
    return sample_n(df, math.ceil(df.count() * percent / 100), id_col, seed)


def sample_per_group(df: DataFrame, group: str, n: int, id_col: str = "soma_joinid", seed: int = 0) -> DataFrame:
    """At most n rows of each group."""
    w = Window.partitionBy(group).orderBy(lot(id_col, seed), id_col)
    return df.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= n).drop("_place")


def modulo_sample(df: DataFrame, modulus: int, id_col: str = "soma_joinid") -> DataFrame:
    return df.filter(F.pmod(F.col(id_col), F.lit(modulus)) == 0)


def shards(df: DataFrame, n: int, rows: int, id_col: str = "soma_joinid") -> DataFrame:
    """Contiguous shards of dense ids 0..rows-1, the first rows % n of them one longer; arithmetic, no window."""
    base, more = divmod(rows, n)
    edge = more * (base + 1)
    x = F.col(id_col)
    shard = F.when(x < edge, F.floor(x / (base + 1))).otherwise(more + F.floor((x - edge) / max(1, base)))
    return df.withColumn("shard", shard.cast("bigint"))


def dense_ids(df: DataFrame, order: list[str], offset_by: str) -> DataFrame:
    """Ids 0..n-1 in the order (offset_by, *order): numbers inside each offset_by group, shifted by the sizes before it.

    Only the group sizes are numbered in one place; rows are numbered group by group.
    """
    sizes = df.groupBy(offset_by).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(offset_by, (F.sum("n").over(Window.orderBy(offset_by)) - F.col("n")).alias("_start"))
    local = F.row_number().over(Window.partitionBy(offset_by).orderBy(*order)) - 1
    return df.withColumn("_local", local).join(F.broadcast(starts), offset_by).withColumn("soma_joinid", (F.col("_start") + F.col("_local")).cast("bigint")).drop("_local", "_start")


def latest(df: DataFrame, keys: list[str], by: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by), F.desc(tie))
    return df.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def last_record(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Repeated records: the last one's values at the first one's place."""
    everything = F.max_by(F.struct("*"), pos).alias("r")
    return df.groupBy(key).agg(everything, F.min(pos).alias("_first")).select("r.*", "_first").drop(pos).withColumnRenamed("_first", pos)


def mode_per_group(df: DataFrame, group: str, label: str) -> DataFrame:
    """The most frequent label of each group; ties go to the smallest."""
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), label)
    return counts.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")
