"""Taking embeddings in: records of submissions, arrays from files, checks against a corpus, a sink."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsefold.functions.rounding import round_mantissa

#: The fields that a record of a submission must have.
REQUIRED = ("id", "embedding_name", "organism", "version", "submission_date", "n_embeddings", "n_features", "data_type")


def of_version(records: DataFrame, version: str, **wanted: str) -> DataFrame:
    """The records of a corpus version, and of other fields as wanted."""
    out = records.filter(F.col("version") == version)
    for name, value in wanted.items():
        out = out.filter(F.col(name) == value)
    return out


def versions(records: DataFrame, name: str, organism: str) -> DataFrame:
    """The corpus versions that an embedding was submitted for, in order."""
    return records.filter((F.col("embedding_name") == name) & (F.col("organism") == organism)).select("version").distinct().orderBy("version")


def require_version(record: dict, version: str, names: dict[str, str] | None = None, experiments: dict[str, list[str]] | None = None) -> None:
    """Raise unless an embedding was made for this version: ids of another one name other observations.

    names: what the directory's names, aliases too, come to; a version that it lacks is taken as it is. experiments: the
    corpus' experiments with their measurements, among which those of the record must be.
    """
    concrete = lambda v: (names or {}).get(v, v)
    if concrete(record.get("version")) != concrete(version):
        raise ValueError(f"the embedding {record.get('embedding_name')!r} is of version {record.get('version')!r}, not {version!r}")
    if experiments is not None:
        experiment, measurement = record.get("experiment_name"), record.get("measurement_name")
        if experiment not in experiments:
            raise ValueError(f"the corpus has no experiment {experiment!r}")
        if measurement not in experiments[experiment]:
            raise ValueError(f"the experiment {experiment!r} has no measurement {measurement!r}")


#: The longest texts of a record, its kinds, and what DOIs and links look like.
LONGEST = {"embedding_name": 128, "title": 128, "description": 2048}
KINDS = ("obs_embedding", "var_embedding")
DOI, LINK = r"10\.[0-9]{4,9}/\S+", r"https://[^\s/]+(/\S*)?"


def metadata_faults(record: dict) -> list[str]:
    """What is wrong with a submission's record; nothing if it is valid. Fields beyond the required ones may be missing."""
    out = [f"{name} is missing" for name in REQUIRED if record.get(name) in (None, "")]
    out += [f"{name} must be a whole number above 0" for name in ("n_embeddings", "n_features") if name in record and not (isinstance(record[name], int) and record[name] > 0)]
    if record.get("data_type") not in (None, "", *KINDS):
        out.append("data_type must be obs_embedding or var_embedding")
    out += [f"{name} has more than {most} characters" for name, most in LONGEST.items() if len(record.get(name) or "") > most]
    out += [f"{name} is empty" for name in ("title", "description") if record.get(name) == ""]
    if record.get("DOI") and not re.fullmatch(DOI, record["DOI"]):
        out.append("DOI is not a DOI")
    if record.get("model_link") and not re.fullmatch(LINK, record["model_link"]):
        out.append("model_link is not a link")
    return out


def record_faults(records: DataFrame, n_obs: int | None = None) -> DataFrame:
    """id and fault of a table of records, a row for each fault. n_obs: observations of the corpus, which embeddings can't exceed."""
    c = F.col
    text = lambda name: F.coalesce(c(name), F.lit(""))
    rules = [(f"{name} is missing", F.coalesce(c(name).cast("string"), F.lit("")) == "") for name in REQUIRED]
    rules += [(f"{name} must be a whole number above 0", c(name) <= 0) for name in ("n_embeddings", "n_features")]
    rules += [("data_type must be obs_embedding or var_embedding", (text("data_type") != "") & ~c("data_type").isin(*KINDS))]
    rules += [(f"{name} has more than {most} characters", F.char_length(text(name)) > most) for name, most in LONGEST.items() if name in records.columns]
    rules += [(f"{name} is empty", c(name) == "") for name in ("title", "description") if name in records.columns]
    rules += [(f"{name} is not a {what}", (text(name) != "") & ~text(name).rlike(f"^{pattern}$")) for name, what, pattern in (("DOI", "DOI", DOI), ("model_link", "link", LINK)) if name in records.columns]
    if n_obs is not None:
        rules.append(("n_embeddings exceeds the observations", c("n_embeddings") > n_obs))
    found = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(fault)) for fault, rule in rules]))
    return records.select("id", F.explode(found).alias("fault"))


def coordinate_faults(cells: DataFrame, axis: DataFrame, n_features: int, n_embeddings: int | None = None) -> DataFrame:
    """One row of counts for an embedding as coordinates (soma_dim_0, soma_dim_1, soma_data): cells, repeated coordinates, rows
    off the axis, negative rows, columns outside 0..n_features-1, values that aren't finite, and rows too few or too many."""
    v = F.col("soma_data")
    odd = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    column, row = F.col("soma_dim_1"), F.col("soma_dim_0")
    cell = cells.groupBy("soma_dim_0", "soma_dim_1").agg(F.count(F.lit(1)).alias("n"), F.count_if(odd).alias("odd"))
    rows = cell.groupBy("soma_dim_0").agg(F.sum("n").alias("cells"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if((column < 0) | (column >= n_features)).alias("outside"), F.sum("odd").alias("not_finite"))
    known = axis.select(F.col("soma_joinid").alias("soma_dim_0"), F.lit(True).alias("_known"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cells", "repeated", "outside", "not_finite")]
    wrong = F.lit(0) if n_embeddings is None else F.abs(F.count(F.lit(1)) - n_embeddings)
    return rows.join(known, "soma_dim_0", "left").agg(*sums, F.count_if(F.col("_known").isNull()).alias("off_axis"), F.count_if(row < 0).alias("negative"), wrong.cast("bigint").alias("miscounted"))


def read_npy(spark: SparkSession, path: str, ids: DataFrame, rows_per_task: int = 100_000) -> DataFrame:
    """id and vector of an array file (rows by dimensions) on a file system that all executors mount.

    ids: place (a row of the array) and id. Each task maps its own rows of the file, so no one reads all of it.
    """
    rows, dimensions = np.load(path, mmap_mode="r").shape

    def run(batches):
        array = np.load(path, mmap_mode="r")
        for batch in batches:
            for start in batch.column(0).to_pylist():
                part = np.asarray(array[start : start + rows_per_task], np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * dimensions), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(part))), vectors], ["place", "vector"])

    starts = spark.range(0, rows, rows_per_task, max(1, -(-rows // rows_per_task)))
    return starts.mapInArrow(run, "place bigint, vector array<float>").join(ids, "place").select("id", "vector")


def quantised(embeddings: DataFrame, keep_bits: int) -> DataFrame:
    """Embeddings with fewer mantissa bits, which compress better."""

    @F.arrow_udf("array<float>")
    def run(v: pa.Array) -> pa.Array:
        flat = round_mantissa(v.values.to_numpy(zero_copy_only=False), keep_bits)
        return pa.ListArray.from_arrays(v.offsets, pa.array(flat, pa.float32()), mask=pa.array(np.array(v.is_null())) if v.null_count else None)

    return embeddings.withColumn("vector", run("vector"))


def write_embedding(embeddings: DataFrame, path: str) -> None:
    """Write id and vector in ranges of ids, which a look-up by id then prunes."""
    embeddings.select("id", "vector").repartitionByRange("id").sortWithinPartitions("id").write.mode("errorifexists").option("compression", "zstd").parquet(path)
