"""Manifests of nested JSON records, with every fault captured beside the records that are sound.

A record is a dataset with its schema version, assets and organisms. It counts if it can be parsed, has an id, is of the one
schema version that is asked for and has exactly one asset of the kind that is asked for. One pass over the lines: bad
records are rows with a fault and not exceptions, so one of them cannot stop a run over millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "dataset_id string, schema_version string, title string, collection_id string, collection_name string, cell_count bigint, "
    "assets array<struct<filetype:string,url:string,filesize:bigint>>, organism array<struct<ontology_term_id:string,label:string>>, _corrupt string"
)
#: Faults in the order in which they are looked for.
FAULTS = ("not a record", "no dataset id", "another schema version", "no asset of the kind", "several assets of the kind")


def parsed(lines: DataFrame, schema_version: str, kind: str = "H5AD") -> DataFrame:
    """Per line (value, and pos, its place): the record's fields, asset (its one asset of the kind) and fault, null if sound."""
    record = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")
    rows = lines.select("pos", "value", record)
    assets = F.filter(F.coalesce("r.assets", F.array().cast("array<struct<filetype:string,url:string,filesize:bigint>>")), lambda a: a["filetype"] == kind)
    rows = rows.withColumn("_assets", assets)
    fault = (
        F.when(F.col("r").isNull() | F.col("r._corrupt").isNotNull() | F.col("value").isNull(), FAULTS[0])
        .when(F.coalesce("r.dataset_id", F.lit("")) == "", FAULTS[1])
        .when(~F.col("r.schema_version").eqNullSafe(F.lit(schema_version)), FAULTS[2])
        .when(F.size("_assets") == 0, FAULTS[3])
        .when(F.size("_assets") > 1, FAULTS[4])
    )
    return rows.withColumn("fault", fault).withColumn("asset", F.when(F.col("fault").isNull(), F.col("_assets")[0]))


def datasets(records: DataFrame, organisms: list[str] | None = None) -> DataFrame:
    """The sound records as datasets, the last one of an id at the place of the first; organisms restricts them to some."""
    sound = records.filter(F.col("fault").isNull())
    if organisms:
        sound = sound.filter(F.coalesce(F.exists("r.organism", lambda o: o["ontology_term_id"].isin(organisms)), F.lit(False)))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c.split(".")[-1])
    rows = sound.select("pos", "r.dataset_id", text("r.title"), text("r.collection_id"), text("r.collection_name"), "r.cell_count", F.col("asset.url").alias("dataset_asset_h5ad_uri"), F.col("asset.filesize").alias("asset_h5ad_filesize"))
    last = F.max_by(F.struct(*[c for c in rows.columns if c != "dataset_id"]), "pos").alias("r")
    return rows.groupBy("dataset_id").agg(last, F.min("pos").alias("first")).select("dataset_id", F.col("first").alias("pos"), *[f"r.{c}" for c in rows.columns if c not in ("dataset_id", "pos")])


def faults(records: DataFrame) -> DataFrame:
    """pos, dataset_id and fault of the records that don't count."""
    return records.filter(F.col("fault").isNotNull()).select("pos", F.col("r.dataset_id").alias("dataset_id"), "fault")


def require_sound(records: DataFrame) -> None:
    """Raise if any record has a fault; the message names the first few."""
    found = faults(records).orderBy("pos").limit(5).collect()
    if found:
        raise ValueError("; ".join(f"record {r['pos']} ({r['dataset_id']}): {r['fault']}" for r in found))


def read_json_manifest(spark: SparkSession, path: str, schema_version: str, kind: str = "H5AD") -> DataFrame:
    """parsed() over the lines of a file of JSON records."""
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    return parsed(lines, schema_version, kind)


def as_json(record: dict[str, Column]) -> Column:
    """A record's line, as a manifest has it."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in record.items()]))
