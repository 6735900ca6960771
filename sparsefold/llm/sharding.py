"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row has a global number r in [0, n): its place in the order (id, text hash). A keyed Feistel network permutes
Z_a x Z_b with a = ceil(sqrt(n)) and b = ceil(n / a), the smallest such grid that holds n; a number that leaves [0, n)
walks on along its cycle until it is inside again, which makes the whole a permutation of [0, n). The new place p gives
shard p mod shards and slot p div shards: shard sizes differ by one row at most (law "rows"), and slots have no gaps.
place() computes a row's shard and slot from its number alone and source_row() inverts it, without any data.

Everything is a DataFrame expression; the rows that move are narrow (id, size, checksum), never texts.

Edge cases: null ids sort last, and rows with one id are ordered by text hash; rows that agree in both are
interchangeable and take neighbouring numbers. A null text has no bytes (size 1, checksum 0). An empty table gives no
rows. Columns of the input other than id and text are not carried, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparsefold.llm.common import bucket_target, order_keys, range_buckets, read, stash

NAME = "op3_feistel_sharding"

PRIME = 2147483647
ROUNDS = 6


def _div(x: Column, d: int) -> Column:
    """Whole division of non-negative BIGINTs, exact where a DOUBLE quotient would not be."""
    return F.call_function("div", x, F.lit(d).cast("bigint"))


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of [0, n); n up to 2^60, as each half must stay below PRIME."""

    n: int
    key: int

    @property
    def sides(self) -> tuple[int, int]:
        a = max(1, math.isqrt(max(0, self.n - 1)) + 1)
        return a, max(1, -(-self.n // a))

    def round_keys(self) -> list[tuple[int, int]]:
        digest = hashlib.sha256(f"{self.key}".encode()).digest() + hashlib.sha256(f"{self.key}/2".encode()).digest()
        words = [int.from_bytes(digest[i : i + 4], "big") % (PRIME - 1) + 1 for i in range(0, 8 * ROUNDS, 4)]
        return list(zip(words[::2], words[1::2], strict=True))

    def _mix(self, x, keys: tuple[int, int]):
        """A round function of plain BIGINT arithmetic: each product stays below 2^62."""
        t = (x * keys[0] + keys[1]) % PRIME
        t = (t * t + x) % PRIME
        return (t * 48271 + keys[1]) % PRIME

    def once(self, x: int) -> int:
        """One pass of the network over Z_a x Z_b: each round adds a mix of one half to the other and swaps them."""
        a, b = self.sides
        here, there = divmod(x, b)
        for i, keys in enumerate(self.round_keys()):
            here, there = there, (here + self._mix(there, keys)) % (b if i % 2 else a)
        return here * b + there

    def _once_column(self, x: Column) -> Column:
        """once() as an expression; the fold over the rounds keeps it small, as no half is written out twice."""
        a, b = self.sides
        named = [F.struct(F.lit(k0).cast("bigint").alias("k0"), F.lit(k1).cast("bigint").alias("k1"), F.lit(b if i % 2 else a).cast("bigint").alias("m")) for i, (k0, k1) in enumerate(self.round_keys())]
        halves = F.struct(_div(x, b).alias("here"), (x % b).alias("there"))

        def turn(s, k):
            return F.struct(s["there"].alias("here"), ((s["here"] + self._mix(s["there"], (k["k0"], k["k1"]))) % k["m"]).alias("there"))

        return F.aggregate(F.array(*named), halves, turn, lambda s: s["here"] * b + s["there"])

    def place(self, row: int) -> int:
        """The new place of a row, in plain Python."""
        at = self.once(row)
        while at >= self.n:
            at = self.once(at)
        return at

    def source_row(self, place: int) -> int:
        """The row that place() sends here: the inverse network, walked until it is inside."""
        a, b = self.sides
        at = place
        while True:
            left, right = divmod(at, b)
            for i, keys in reversed(list(enumerate(self.round_keys()))):
                left, right = (right - self._mix(left, keys)) % (b if i % 2 else a), left
            at = left * b + right
            if at < self.n:
                return at

    def longest_walk(self) -> int:
        """Passes that the longest walk needs: only the a * b - n < a numbers outside [0, n) can prolong one."""
        a, b = self.sides
        most = 1
        for start in range(self.n, a * b):
            at, steps = start, 1
            while at >= self.n and steps <= a * b:
                at, steps = self.once(at), steps + 1
            most = max(most, steps)
        return most

    def column(self, row: Column) -> Column:
        """The new place of a row as one expression; the walk's length is a proven bound, not a cap."""
        walk = F.array(*[F.lit(i) for i in range(self.longest_walk())])
        start = F.struct(row.alias("at"), F.lit(False).alias("moved"))

        def step(state, _):
            return F.when(state["moved"] & (state["at"] < self.n), state).otherwise(F.struct(self._once_column(state["at"]).alias("at"), F.lit(True).alias("moved")))

        return F.aggregate(walk, start, step, lambda s: s["at"])


def number_rows(df: DataFrame, keys: list[str], rows_per_bucket: int = 200_000) -> tuple[DataFrame, int]:
    """df with row BIGINT, its place in the order of the BIGINT columns keys, and the number of rows.

    Rows are dealt into buckets of contiguous keys, numbered inside each and shifted by the sizes of the buckets
    before; the driver holds one count per bucket. No task sees more than a bucket.
    """
    cols = [F.col(k) for k in keys]
    n = df.count()
    buckets = range_buckets(df, cols, bucket_target(df.sparkSession, n, rows_per_bucket))
    placed = df.withColumn("_bucket", buckets.bucket(cols))
    sizes = dict(placed.groupBy("_bucket").count().collect())
    starts, at = [], 0
    for b in range(max(1, len(buckets))):
        starts.append(at)
        at += sizes.get(b, 0)
    offset = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col("_bucket") + 1)
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*cols)).cast("bigint") - 1
    return placed.withColumn("row", offset + inside).drop("_bucket"), n


def feistel_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, key: int = 20240229) -> DataFrame:
    """Per row: id_col, size, text_crc32, row, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    k0, k1, k2 = order_keys(id_col, text_col)
    narrow = df.select(F.col(id_col), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), k0.alias("_k0"), k1.alias("_k1"), k2.alias("_k2"))
    numbered, n = number_rows(stash(narrow, "sharding"), ["_k0", "_k1", "_k2"])
    place = Feistel(max(1, n), key).column(F.col("row"))
    return numbered.withColumn("_place", place).select(id_col, "size", "text_crc32", "row", (F.col("_place") % shards).cast("int").alias("shard"), _div(F.col("_place"), shards).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law "rows"."""
    out = feistel_shards(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")
