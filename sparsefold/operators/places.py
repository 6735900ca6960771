"""Dense places and running sums along an axis, without a task that sees all of it.

Rows are dealt to ranges of the key, sorted and written with a number that holds the range and the place in it. The driver then
sees one count (or sum) a range, and a row's place is its range's start plus its place there.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparsefold.sources.scratch import written

#: monotonically_increasing_id() holds the partition above these bits.
BITS = 33
#: Rows of a task where their number is known: partitions grow with a table, not tasks.
ROWS = 1 << 18


def parts(rows: int) -> int:
    """How many partitions hold so many rows."""
    return max(1, -(-rows // ROWS))


def _ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    """df in ranges of the keys, each sorted, with _at: its range and place as written."""
    dealt = df.repartitionByRange(parts(df.count()), *[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return written(dealt.withColumn("_at", F.monotonically_increasing_id()), "places")


def _starts(ranged: DataFrame, value: Column) -> Column:
    """What lies before a row's range: a look-up in an array of one number a range."""
    sums = dict(ranged.groupBy(F.shiftright("_at", BITS).alias("part")).agg(value.alias("v")).collect())
    each = [sums.get(i) or 0 for i in range(max(sums, default=0) + 1)]
    before = [0, *accumulate(each)][: len(each)]
    return F.element_at(F.array(*map(F.lit, before)), F.shiftright("_at", BITS).cast("int") + 1)


def placed(df: DataFrame, keys: list[str], name: str = "place") -> DataFrame:
    """df with the place of each row in the order of the keys, from 0 without gaps; rows of equal keys in any order."""
    ranged = _ranged(df, keys)
    start = _starts(ranged, F.count(F.lit(1)))
    return ranged.withColumn(name, (start + F.col("_at").bitwiseAND((1 << BITS) - 1)).cast("bigint")).drop("_at")


def summed_before(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of a whole-number column over all rows before a row in the order of the keys."""
    ranged = _ranged(df, keys)
    start = _starts(ranged, F.sum(value))
    part = Window.partitionBy(F.shiftright("_at", BITS)).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn(name, (start + F.coalesce(F.sum(value).over(part), F.lit(0))).cast("bigint")).drop("_at")
