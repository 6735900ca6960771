"""Source matrices of the three usual layouts as coordinates, and back.

Compressed layouts (CSR by row, CSC by column) come as two tables per source: offsets (source, at, offset), one more than
there are lines, and entries (source, at, index, value). A line owns the entries from its offset to the next one's. Lines are
found by their differences to the next offset, an equi-join, and entries get their line in blocks of places: each block
holds its entries, the starts of lines inside it and a copy of the line that covers its first place, and the last start seen is
an entry's line. No block grows with a line, however long it is, nor with the number of empty lines at one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparsefold.operators.places import parts, placed, summed_before

#: Places of entries in a block.
BLOCK = 1 << 16


def lines(offsets: DataFrame) -> DataFrame:
    """source, line, start and end (exclusive) of the lines that own entries."""
    here = offsets.select("source", F.col("at").alias("line"), F.col("offset").alias("start"))
    after = offsets.select("source", (F.col("at") - 1).alias("line"), F.col("offset").alias("end"))
    return here.join(after, ["source", "line"]).filter(F.col("end") > F.col("start"))


def from_compressed(offsets: DataFrame, entries: DataFrame, by: str = "row", block: int = BLOCK) -> DataFrame:
    """source, soma_dim_0, soma_dim_1, soma_data; by says whether lines are rows (CSR) or columns (CSC)."""
    if by not in ("row", "column"):
        raise ValueError("lines are rows or columns")
    div = lambda c: F.expr(f"{c} div {block}")
    spans = lines(offsets).withColumn("_block", F.explode(F.sequence(div("start"), div("(end - 1)"))))
    marks = spans.select("source", "_block", F.greatest("start", F.col("_block") * block).alias("at"), "line")
    rows = entries.select("source", div("at").alias("_block"), "at", "index", "value").unionByName(marks, allowMissingColumns=True)
    rows = rows.repartition(parts(entries.count()), "source", "_block")
    so_far = Window.partitionBy("source", "_block").orderBy("at", F.col("line").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    owned = rows.withColumn("_line", F.last("line", ignorenulls=True).over(so_far)).filter(F.col("line").isNull() & F.col("_line").isNotNull())
    i, j = ("_line", "index") if by == "row" else ("index", "_line")
    return owned.select("source", F.col(i).alias("soma_dim_0"), F.col(j).alias("soma_dim_1"), F.col("value").alias("soma_data"))


def from_dense(rows: DataFrame) -> DataFrame:
    """source, soma_dim_0, soma_dim_1, soma_data of rows (source, at, values ARRAY): what is neither null nor zero."""
    cells = rows.select("source", F.col("at").alias("soma_dim_0"), F.posexplode("values").alias("soma_dim_1", "soma_data"))
    return cells.filter(F.col("soma_data") != 0).withColumn("soma_dim_1", F.col("soma_dim_1").cast("bigint"))


def preferred(x: DataFrame, order: tuple[str, ...] = ("raw/X", "X")) -> DataFrame:
    """Of each source's layers (column layer) the first one of the order that it has; other layers are not read.

    The choice is a small table of sources, and a source's other layers fall out of the scan where layer partitions it.
    """
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("layer"))
    chosen = x.select("source", "layer").filter(F.col("layer").isin(*order)).distinct().groupBy("source").agg(F.min_by("layer", rank).alias("layer"))
    return x.join(chosen, ["source", "layer"], "left_semi")


def canonical(x: DataFrame, rows: int | None = None) -> DataFrame:
    """One value a coordinate of a source: the sum of those given. rows, if known, says how many, at most; it sets the tasks."""
    x = x if rows is None else x.repartition(parts(rows), "source", "soma_dim_0", "soma_dim_1")
    return x.groupBy("source", "soma_dim_0", "soma_dim_1").agg(F.sum("soma_data").alias("soma_data"))


def to_compressed(x: DataFrame, n_lines: int, by: str = "row", source: str = "") -> tuple[DataFrame, DataFrame]:
    """(offsets, entries) of a matrix with n_lines rows (or columns): what from_compressed() reads. Repeated coordinates stay."""
    major, minor = ("soma_dim_0", "soma_dim_1") if by == "row" else ("soma_dim_1", "soma_dim_0")
    name = F.lit(source).alias("source")
    entries = placed(x.select(major, minor, "soma_data"), [major, minor], "at")
    sizes = entries.groupBy(major).agg(F.count(F.lit(1)).alias("n"))
    axis = x.sparkSession.range(n_lines + 1).join(sizes, F.col("id") == F.col(major), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    offsets = summed_before(axis, ["id"], "n", "offset")
    return offsets.select(name, F.col("id").alias("at"), "offset"), entries.select(name, "at", F.col(minor).alias("index"), F.col("soma_data").alias("value"))


def to_dense(x: DataFrame, n_columns: int, source: str = "") -> DataFrame:
    """Rows (source, at, values) with a value in each of n_columns places; a row is one array, so columns must be few."""
    found = F.map_from_entries(F.collect_list(F.struct("soma_dim_1", "soma_data")))
    rows = x.groupBy("soma_dim_0", "soma_dim_1").agg(F.sum("soma_data").alias("soma_data")).groupBy("soma_dim_0").agg(found.alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(n_columns - 1)), lambda j: F.coalesce(F.element_at("m", j.cast("bigint")), F.lit(0.0)))
    return rows.select(F.lit(source).alias("source"), F.col("soma_dim_0").alias("at"), values.alias("values"))
