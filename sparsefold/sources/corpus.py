"""A corpus on Parquet: named tables under a base path, opened lazily.

Layout: <base>/<organism>/obs, <base>/<organism>/ms/<measurement>/{var,X/<layer>,presence} and <base>/info/<table>.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def organism_key(name: str, known: list[str] | None = None) -> str:
    """An organism's table name: lower case with underscores. Raises where the name isn't text or isn't known."""
    if not isinstance(name, str):
        raise TypeError(f"an organism is named by text, not {type(name).__name__}")
    key = re.sub(" +", "_", name.strip().lower())
    if known is not None and key not in known:
        raise ValueError(f"unknown organism {name!r}; known: {', '.join(sorted(known))}")
    return key


def organism_column(name: Column) -> Column:
    """organism_key() for a column of names."""
    return F.regexp_replace(F.lower(F.trim(name)), " +", "_")


def resolve(locator: dict, mirrors: dict | None = None, mirror: str | None = None) -> str:
    """The base path of a locator {"uri"} or {"relative_uri"} below a mirror's base_uri."""
    mirrors = mirrors or {}
    if mirror is not None and mirror not in mirrors:
        raise ValueError(f"unknown mirror {mirror!r}; known: {', '.join(sorted(mirrors))}")
    if "relative_uri" in locator and (mirror or "default" in mirrors):
        chosen = mirrors[mirror or mirrors["default"]]
        if chosen.get("provider", "S3") not in ("S3", "file", "unknown"):
            raise ValueError(f"unknown provider {chosen['provider']!r}")
        return chosen["base_uri"].rstrip("/") + "/" + locator["relative_uri"].lstrip("/")
    return locator["uri"]


@dataclass(frozen=True)
class Measurement:
    """A feature axis and the coordinate matrices over it."""

    var: DataFrame
    layers: dict[str, DataFrame]
    presence: DataFrame | None = None
    embeddings: dict[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class Experiment:
    """An observation axis and its measurements; every table is a lazy DataFrame."""

    obs: DataFrame
    ms: dict[str, Measurement]


@dataclass(frozen=True)
class StorageContext:
    """Options of the reader, by name; replace() overrides some of them and leaves the rest as they are."""

    options: dict[str, str] = field(default_factory=dict)

    def replace(self, **options: object) -> StorageContext:
        return StorageContext(self.options | {k: str(v) for k, v in options.items()})

    def parquet(self, spark: SparkSession, path: str) -> DataFrame:
        return spark.read.options(**self.options).parquet(path)


@dataclass(frozen=True)
class Corpus:
    spark: SparkSession
    base: str
    context: StorageContext = field(default_factory=StorageContext)

    def info(self, table: str) -> DataFrame:
        """A table of the corpus's description: summary, datasets, summary_cell_counts or organisms."""
        return self.context.parquet(self.spark, f"{self.base}/info/{table}")

    def experiment(self, organism: str, measurement: str = "RNA", layers: tuple[str, ...] = ("raw",)) -> Experiment:
        root = f"{self.base}/{organism_key(organism)}"
        read = lambda path: self.context.parquet(self.spark, path)
        ms = f"{root}/ms/{measurement}"
        return Experiment(read(f"{root}/obs"), {measurement: Measurement(read(f"{ms}/var"), {layer: read(f"{ms}/X/{layer}") for layer in layers}, read(f"{ms}/presence"))})


def open_corpus(spark: SparkSession, version: str | None = "stable", *, uri: str | None = None, directory: dict | None = None, mirrors: dict | None = None, mirror: str | None = None, context: StorageContext | None = None) -> Corpus:
    """Open a corpus by path, which wins, or by version through a directory of versions (aliases may chain)."""
    if uri is not None:
        return Corpus(spark, uri.rstrip("/"), context or StorageContext())
    if version is None:
        raise ValueError("either a version or a path must be given")
    entry, seen = (directory or {}).get(version), {version}
    while isinstance(entry, str):
        if entry in seen:
            raise ValueError(f"the aliases of {version!r} go round in a circle")
        seen.add(entry)
        entry = (directory or {}).get(entry)
    if entry is None:
        raise ValueError(f"unknown version {version!r}")
    return Corpus(spark, resolve(entry["soma"], mirrors, mirror).rstrip("/"), context or StorageContext())


def introspect(df: DataFrame) -> DataFrame:
    """column, type and nullable of a table, one row per column."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, type string, nullable boolean")


def source_uri(datasets: DataFrame, dataset_id: str, base: str) -> str:
    """Where a dataset's source file lies; KeyError if it isn't in the corpus."""
    found = datasets.filter(F.col("dataset_id") == dataset_id).select("dataset_h5ad_path").limit(1).collect()
    if not found:
        raise KeyError(f"unknown dataset {dataset_id!r}")
    return f"{base.rstrip('/')}/{found[0][0]}"


def write_frame(df: DataFrame, path: str, id_col: str = "soma_joinid") -> DataFrame:
    """Write an axis table, range-partitioned by id; returns its domain (lowest and highest id, rows)."""
    df.repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path).agg(F.min(id_col).alias("low"), F.max(id_col).alias("high"), F.count(F.lit(1)).alias("n"))


def write_sparse(x: DataFrame, path: str) -> None:
    """Append coordinates to a layer, row-major: row groups then prune by soma_dim_0."""
    x.repartitionByRange("soma_dim_0", "soma_dim_1").sortWithinPartitions("soma_dim_0", "soma_dim_1").write.mode("append").option("compression", "zstd").parquet(path)


def compact(spark: SparkSession, path: str, to: str, files: int) -> None:
    """Rewrite a layer's fragments as few row-major files at another place."""
    spark.read.parquet(path).repartitionByRange(files, "soma_dim_0", "soma_dim_1").sortWithinPartitions("soma_dim_0", "soma_dim_1").write.mode("overwrite").parquet(to)


@dataclass(frozen=True)
class Layer:
    """What a folder of Parquet files holds: their number, their bytes and those of the smallest."""

    path: str
    files: int
    bytes: int
    smallest: int


def layer_files(spark: SparkSession, path: str) -> Layer:
    """The files of a layer by their metadata columns; no value is read."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size").distinct()
    found = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("file_size"), F.lit(0)), F.coalesce(F.min("file_size"), F.lit(0))).first()
    return Layer(path, *found)


def needs_consolidation(layer: Layer, target_bytes: int) -> bool:
    """Whether fewer files would do by more than half: a layer that was consolidated stays as it is."""
    wanted = max(1, -(-layer.bytes // target_bytes))
    return layer.files > 2 * wanted


def consolidate(spark: SparkSession, paths: list[str], target_bytes: int = 128 << 20, include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """Rewrite the layers whose files are too many and too small, row-major; returns their paths.

    include and exclude are patterns that the whole path must match (all, and none, by default). A layer is written beside
    its old folder, which goes only when the new one has taken its place; a run that was cut off in between is put
    right by the next. A second run finds nothing to do.
    """
    done = []
    for path in paths:
        recover(spark, path)
        if not any(re.fullmatch(p, path) for p in (include or [".*"])) or any(re.fullmatch(p, path) for p in exclude or []):
            continue
        layer = layer_files(spark, path)
        if needs_consolidation(layer, target_bytes):
            compact(spark, path, f"{path}.new", max(1, -(-layer.bytes // target_bytes)))
            _rename(spark, path, f"{path}.old")
            _rename(spark, f"{path}.new", path)
            recover(spark, path)
            done.append(path)
    return done


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a consolidation that was cut off: an old folder without its successor comes back, leftovers go."""
    if _exists(spark, f"{path}.old"):
        if not _exists(spark, path):
            whole = _exists(spark, f"{path}.new/_SUCCESS")
            _rename(spark, f"{path}.new" if whole else f"{path}.old", path)
        _remove(spark, f"{path}.old")
    _remove(spark, f"{path}.new")


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    fs, place = _file_system(spark, path)
    return fs.exists(place)


def _rename(spark: SparkSession, path: str, to: str) -> None:
    fs, place = _file_system(spark, path)
    if not fs.rename(place, _file_system(spark, to)[1]):
        raise OSError(f"{path} can't be renamed to {to}")


def _remove(spark: SparkSession, path: str) -> None:
    fs, place = _file_system(spark, path)
    fs.delete(place, True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """dataset_id, dataset_asset_h5ad_uri and pos (the record's place) of a CSV manifest."""
    lines = spark.read.csv(path, header=True, schema="dataset_id string, dataset_asset_h5ad_uri string")
    return lines.withColumn("pos", F.monotonically_increasing_id())


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """dataset_id of a text file; blank lines and what follows # are skipped. A missing file is an error."""
    named = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("dataset_id"))
    return named.filter(F.col("dataset_id") != "")


def inject_embedding(measurement: Measurement, name: str, embeddings: DataFrame, axis: DataFrame | None = None, dimensions: int | None = None) -> Measurement:
    """The measurement with one more embedding; a name that it has already is an error.

    With an axis and a number of dimensions the embedding is checked first: every fault that is counted is an error.
    """
    if name in measurement.embeddings:
        raise ValueError(f"the measurement has an embedding {name!r} already")
    if axis is not None and dimensions is not None:
        from sparsefold.operators.embedding import violations

        found = violations(embeddings, axis, dimensions).first().asDict()
        wrong = {k: v for k, v in found.items() if k != "rows" and v} | ({} if found["rows"] else {"rows": 0})
        if wrong:
            raise ValueError(f"the embedding {name!r} has faults: {wrong}")
    return replace(measurement, embeddings=measurement.embeddings | {name: embeddings})
