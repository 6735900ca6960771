"""What several operators share: reading, scratch tables and a total order in bounded buckets."""

from __future__ import annotations

import math
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words in the contracts.
SPACE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a fresh local one only where it is unset.

    Only a local master may use a folder of this machine: elsewhere executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparsefold-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def is_local(master: str) -> bool:
    """Whether driver and executors are one process (local, local[n], local[n,f]); local-cluster[...] is not."""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/sparsefold/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cut the lineage of df with a table in the shared folder, which outlives any executor.

    compression: a codec of Parquet files, for whole texts; the session's otherwise.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_stash(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing will read again, each read by itself and not through a plan over several."""
    for df in tables:
        files = df.inputFiles()
        if files and "/sparsefold/" in files[0]:
            _delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this application: for a caller whose results have been written."""
    _delete(spark, f"{scratch_dir(spark)}/sparsefold/{spark.sparkContext.applicationId}")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column (names compare as Spark does, without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@dataclass(frozen=True)
class RangeBuckets:
    """Buckets that hold contiguous runs of a total order over non-null BIGINT keys.

    bounds[i] is the first key of bucket i; a key before bounds[0] belongs to bucket 0.
    """

    bounds: tuple[tuple[int, ...], ...]

    def __len__(self) -> int:
        return len(self.bounds)

    def _literal(self) -> Column:
        return F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(f"k{j}") for j, v in enumerate(b)]) for b in self.bounds])

    def bucket(self, keys: list[Column]) -> Column:
        """The number of a row's bucket, by binary search in a constant array."""
        if len(self.bounds) < 2:
            return F.lit(0)
        key = F.struct(*[k.alias(f"k{j}") for j, k in enumerate(keys)])
        bounds, size = self._literal(), len(self.bounds)
        steps = F.array(*[F.lit(1 << s) for s in reversed(range(size.bit_length()))])

        def step(at, width):
            return F.when((at + width < size) & (F.element_at(bounds, F.least(at + width, F.lit(size - 1)) + 1) <= key), at + width).otherwise(at)

        return F.aggregate(steps, F.lit(0), step)

    def is_first(self, keys: list[Column]) -> Column:
        """Whether a row has the first key of a bucket."""
        key = F.struct(*[k.alias(f"k{j}") for j, k in enumerate(keys)])
        return F.element_at(self._literal(), self.bucket(keys) + 1) == key


def order_keys(id_col: str, text_col: str | None = None, descending: bool = False) -> list[Column]:
    """Non-null BIGINT keys that order rows by id (null last) and then by a hash of the text.

    The negation is done as -1 - x, which cannot overflow.
    """
    value = F.coalesce(F.col(id_col).cast("bigint"), F.lit(0))
    keys = [F.col(id_col).isNull().cast("bigint"), (F.lit(-1) - value) if descending else value]
    return keys if text_col is None else [*keys, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))]


def range_buckets(df: DataFrame, keys: list[Column], rows_per_bucket: int, per_bucket: int = 32, max_buckets: int = 20_000) -> RangeBuckets:
    """Choose bucket bounds from a hashed sample of about per_bucket keys per bucket.

    The sample only balances the buckets; membership and order are exact for whatever bounds come out. The driver
    sees max_buckets * per_bucket keys of a few BIGINTs at most, and the plan holds max_buckets bounds; for more rows
    than max_buckets * rows_per_bucket the buckets grow instead, and their sorts spill. The first bound is the exact minimum.
    """
    named = df.select(*[k.alias(f"k{j}") for j, k in enumerate(keys)])
    cols = [F.col(c) for c in named.columns]
    low = named.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*cols)).alias("low")).first()
    n = low["n"]
    if not n:
        return RangeBuckets(())
    buckets = min(max_buckets, max(1, math.ceil(n / rows_per_bucket)))
    if buckets == 1:
        return RangeBuckets((tuple(low["low"]),))
    keep = min(1.0, buckets * per_bucket / n)
    sample = named.filter(F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) < int(keep * (1 << 30)) + 1).distinct()
    found = sorted(tuple(r) for r in sample.collect())
    picked = {found[i * len(found) // buckets] for i in range(1, buckets)} if found else set()
    first = tuple(low["low"])
    return RangeBuckets((first, *sorted(b for b in picked if b > first)))


def bucket_target(spark: SparkSession, rows: int, rows_per_bucket: int) -> int:
    """Rows per bucket: the given bound, or fewer where that leaves shuffle partitions idle."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, min(rows_per_bucket, math.ceil(rows / (4 * parts))))


def byte_of_char() -> dict[str, int]:
    """The bytes that characters of a byte-level vocabulary stand for: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}
