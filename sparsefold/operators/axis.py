"""The axis query: two predicates pick ids on the axes, the matrix is restricted to both.

Predicates are Columns or text: Spark SQL, in which lists may be written in brackets, as in tissue in ['brain', 'lung'].
Coordinates are None, an id, a list of ids or a closed slice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparsefold.operators.places import placed, summed_before

#: Ids in a list beyond which a coordinate filter becomes a semi-join.
LONG_LIST = 1000
#: Rows of an axis up to which it is broadcast: ids of 8 bytes, so a megabyte.
SMALL_AXIS = 100_000


def as_predicate(value_filter: Column | str | None) -> Column:
    if value_filter is None:
        return F.lit(True)
    return F.expr(in_parentheses(value_filter)) if isinstance(value_filter, str) else value_filter


def in_parentheses(text: str) -> str:
    """Lists in brackets after in, as SQL writes them; subscripts, and what is quoted, stay as they are."""
    parts = re.split(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`)""", text)
    out, lists = [], []  # lists: of each open bracket whether it opens a list
    for i, part in enumerate(parts):
        if i % 2:
            out.append(part)
            continue
        for piece in re.split(r"([\[\]])", part):
            if piece == "[":
                lists.append(re.search(r"\bin\s*\Z", "".join(out), re.IGNORECASE) is not None)
                out.append("(" if lists[-1] else "[")
            elif piece == "]":
                out.append(")" if lists and lists.pop() else "]")
            else:
                out.append(piece)
    return "".join(out)


def at_coords(df: DataFrame, coords, id_col: str = "soma_joinid") -> DataFrame:
    """The rows at some coordinates; both ends of a slice belong to it."""
    if coords is None:
        return df
    if isinstance(coords, slice):
        if coords.step not in (None, 1):
            raise ValueError("a slice of coordinates has no step")
        low = F.lit(True) if coords.start is None else F.col(id_col) >= coords.start
        high = F.lit(True) if coords.stop is None else F.col(id_col) <= coords.stop
        return df.filter(low & high)
    ids = [coords] if isinstance(coords, int) else list(coords)
    if len(ids) <= LONG_LIST:
        return df.filter(F.col(id_col).isin(ids))
    wanted = df.sparkSession.createDataFrame([(int(i),) for i in ids], "_wanted bigint")
    return df.join(wanted, F.col(id_col) == F.col("_wanted"), "left_semi")


def scan(df: DataFrame, value_filter: Column | str | None = None, coords=None, columns: list[str] | None = None, id_col: str = "soma_joinid") -> DataFrame:
    """An axis table under a predicate, coordinates and a choice of columns; all reach the scan."""
    found = at_coords(df.filter(as_predicate(value_filter)), coords, id_col)
    return found if columns is None else found.select(*columns)


@dataclass(frozen=True)
class AxisQuery:
    """A slice: selected rows of both axes and the matrix between them, all lazy.

    The axes stay apart from the matrix since denominators count selected ids, stored values or not. small_obs and
    small_var say that an axis is known to have at most SMALL_AXIS rows; otherwise Spark chooses the join by its sizes.
    """

    obs: DataFrame
    var: DataFrame
    layer: DataFrame
    small_obs: bool = False
    small_var: bool = False

    @property
    def obs_ids(self) -> DataFrame:
        return self.obs.select(F.col("soma_joinid").alias("soma_dim_0"))

    @property
    def var_ids(self) -> DataFrame:
        return self.var.select(F.col("soma_joinid").alias("soma_dim_1"))

    @property
    def X(self) -> DataFrame:  # noqa: N802  the matrix's customary name
        hint = lambda df, small: F.broadcast(df) if small else df
        return self.layer.join(hint(self.var_ids, self.small_var), "soma_dim_1", "left_semi").join(hint(self.obs_ids, self.small_obs), "soma_dim_0", "left_semi").select("soma_dim_0", "soma_dim_1", "soma_data")

    def sizes(self) -> DataFrame:
        """n_obs and n_vars, the numbers of selected rows."""
        return self.obs.agg(F.count(F.lit(1)).alias("n_obs")).join(self.var.agg(F.count(F.lit(1)).alias("n_vars")))


def axis_query(obs: DataFrame, var: DataFrame, layer: DataFrame, obs_filter=None, var_filter=None, obs_coords=None, var_coords=None) -> AxisQuery:
    return AxisQuery(scan(obs, obs_filter, obs_coords), scan(var, var_filter, var_coords), layer)


def blockwise(x: DataFrame, size: int) -> DataFrame:
    """The matrix with the number of each row's block of size rows."""
    return x.withColumn("block", F.floor(F.col("soma_dim_0") / size).cast("bigint"))


def reindexed(x: DataFrame, ids: DataFrame, dim: str = "soma_dim_0") -> DataFrame:
    """The matrix with the coordinates of one axis replaced by their places among ids (soma_joinid, and place if it is known).

    Places are those of the ids in ascending order, from 0 without gaps.
    """
    if "place" not in ids.columns:
        ids = placed(ids.select("soma_joinid"), ["soma_joinid"])
    places = ids.select(F.col("soma_joinid").alias(dim), F.col("place").alias("_place"))
    return x.join(places, dim).withColumn(dim, F.col("_place")).select(*x.columns)


def reindexed_slice(q: AxisQuery) -> DataFrame:
    """A slice's matrix with dense coordinates on both axes."""
    return reindexed(reindexed(q.X, q.obs), q.var, "soma_dim_1")


def export(q: AxisQuery, embeddings: dict[str, tuple[DataFrame, int]] | None = None, layers: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """A slice as its tables: obs, var, X and each further layer. embeddings (name: table of id and vector, dimensions) come
    as columns of obs, NaN in every place where an observation has none."""
    obs = q.obs
    for name, (table, dimensions) in (embeddings or {}).items():
        nothing = F.array_repeat(F.lit(float("nan")).cast("float"), dimensions)
        found = table.select(F.col("id").alias("soma_joinid"), F.col("vector").alias(name))
        obs = obs.join(found, "soma_joinid", "left").withColumn(name, F.coalesce(name, nothing))
    more = {name: AxisQuery(q.obs, q.var, x, q.small_obs, q.small_var).X for name, x in (layers or {}).items()}
    return {"obs": obs, "var": q.var, "X": q.X} | more


def incremental(q: AxisQuery, size: int | None = None, values: int | None = None) -> Iterator[AxisQuery]:
    """The slice in consecutive ranges of observations, one after the other, for a reader that takes it in steps.

    size: ids in a range, of which many may not be selected. values: stored values in a range, some: it ends with the
    observation that reaches the next multiple, so an observation with more is a step of its own, and no step is empty
    but that of a slice without values. Each step is a query of its own, whose range reaches the scan; the driver sees the
    lowest and the highest id, or those of each step.
    """
    if (size is None) == (values is None):
        raise ValueError("a step has a number of ids or of values")
    if size is not None:
        low, high = q.obs.agg(F.min("soma_joinid"), F.max("soma_joinid")).first()
        ranges = [] if low is None else [(at, at + size - 1) for at in range(low, high + 1, size)]
    else:
        stored = q.X.groupBy("soma_dim_0").agg(F.count(F.lit(1)).alias("n"))
        costs = q.obs.select("soma_joinid").join(stored, F.col("soma_joinid") == F.col("soma_dim_0"), "left").select("soma_joinid", F.coalesce("n", F.lit(0)).alias("n"))
        steps = summed_before(costs, ["soma_joinid"], "n", "before").groupBy(F.expr(f"before div {values}").alias("step"))
        ranges = sorted((r["low"], r["high"]) for r in steps.agg(F.min("soma_joinid").alias("low"), F.max("soma_joinid").alias("high")).collect())
    for low, high in ranges:
        obs = q.obs.filter(F.col("soma_joinid").between(low, high))
        layer = q.layer.filter(F.col("soma_dim_0").between(low, high))
        yield AxisQuery(obs, q.var, layer, q.small_obs, q.small_var)
