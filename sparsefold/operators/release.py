"""Versions of a corpus: aliases, flags, validity and clean-up. versions: name, target (of an alias), and release columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsefold.sources.scratch import written


def resolved(versions: DataFrame) -> DataFrame:
    """name, is_alias, concrete: aliases followed to the release that they come to; dangling and circular ones are gone.

    Each round doubles the number of links that every name has followed, so chains of any length end in as many rounds as
    their length has binary digits. Names in a circle never come to a release. Rounds are written tables of a row an alias.
    """
    links = written(versions.select("name", "target"), "aliases")
    releases = links.filter(F.col("target").isNull()).select(F.col("name").alias("concrete"))
    at = links.filter(F.col("target").isNotNull()).select("name", F.col("target").alias("at"))
    for _ in range(max(1, at.count()).bit_length()):
        hop = at.select(F.col("name").alias("_n"), F.col("at").alias("_t"))
        at = written(at.join(hop, F.col("at") == F.col("_n"), "left").select("name", F.coalesce("_t", "at").alias("at")), "aliases")
    aliases = at.join(releases, F.col("at") == F.col("concrete")).select("name", F.lit(True).alias("is_alias"), "concrete")
    return aliases.unionByName(releases.select(F.col("concrete").alias("name"), F.lit(False).alias("is_alias"), "concrete"))


def directory(versions: DataFrame, lts: bool | None = None, retracted: bool | None = False) -> DataFrame:
    """All names with their release's columns; flags filter unless None, and a missing flag counts as false.

    Aliases come first, then releases, each by falling name.
    """
    out = resolved(versions).join(versions.drop("target").withColumnRenamed("name", "concrete"), "concrete")
    for flag, wanted in (("lts", lts), ("retracted", retracted)):
        if wanted is not None:
            out = out.filter(F.coalesce(F.col(flag), F.lit(False)) == wanted)
    return out.orderBy(F.desc("is_alias"), F.desc("name"))


def removable(versions: DataFrame, today: str, days: int) -> DataFrame:
    """Releases older than so many days that no alias comes to and that aren't marked to stay."""
    named = resolved(versions).filter("is_alias").select(F.col("concrete").alias("name"))
    old = F.col("release_date").cast("date") < F.date_sub(F.to_date(F.lit(today)), days)
    return versions.filter(F.col("target").isNull() & old & ~F.coalesce(F.col("do_not_delete"), F.lit(False))).join(named, "name", "left_anti").select("name")


def slower_than_first(runs: DataFrame, factor: float = 1.15) -> DataFrame:
    """Benchmarks whose latest time exceeds the first by more than a factor. runs: benchmark, ts, seconds."""
    return runs.groupBy("benchmark").agg(F.min_by("seconds", "ts").alias("first"), F.max_by("seconds", "ts").alias("latest")).filter(F.col("latest") > factor * F.col("first"))


def description(versions: DataFrame, name: str) -> DataFrame:
    """One name of the directory, retracted or not, with its release's columns; unset flags are false. No row if unknown."""
    found = directory(versions, retracted=None).filter(F.col("name") == name)
    return found.withColumns({flag: F.coalesce(F.col(flag), F.lit(False)) for flag in ("lts", "retracted")})


def mirrors(known: DataFrame, default: DataFrame, providers: tuple[str, ...] = ("S3", "file")) -> DataFrame:
    """mirror, base_uri and is_default of the mirrors whose provider can be read. default: one row, mirror."""
    readable = known.filter(F.col("provider").isin(*providers))
    return readable.join(F.broadcast(default.limit(1).withColumn("_d", F.lit(True))), "mirror", "left").select("mirror", "base_uri", F.col("_d").isNotNull().alias("is_default"))


def faults(versions: DataFrame) -> DataFrame:
    """name and fault: aliases that come to no release, and aliases that come to a retracted one."""
    found = resolved(versions).filter("is_alias")
    dangling = versions.filter(F.col("target").isNotNull()).join(found, "name", "left_anti").select("name", F.lit("dangling alias").alias("fault"))
    gone = versions.filter(F.coalesce(F.col("retracted"), F.lit(False))).select(F.col("name").alias("concrete"))
    return dangling.unionByName(found.join(gone, "concrete", "left_semi").select("name", F.lit("alias of a retracted release").alias("fault")))


def made(versions: DataFrame, name: str, record: dict[str, object], aliases: tuple[str, ...] = ()) -> DataFrame:
    """The directory with one more release, to which aliases (new ones or moved ones) come. record: the release's columns.

    Raises if the name is taken, an alias is the name of a release, or the directory would have faults that it lacks now.
    """
    taken = {r["name"]: r["target"] for r in versions.filter(F.col("name").isin(name, *aliases)).select("name", "target").collect()}
    if name in taken or any(taken.get(a, "") is None for a in aliases):
        raise ValueError(f"{name!r} or an alias of it is the name of a release already")
    kinds = dict(versions.dtypes)
    new = versions.sparkSession.createDataFrame([(name,), *[(a,) for a in aliases]], "name string").withColumn("target", F.when(F.col("name") != name, F.lit(name)))
    for column in versions.columns:
        if column not in ("name", "target"):
            new = new.withColumn(column, F.when(F.col("name") == name, F.lit(record.get(column))).cast(kinds[column]))
    out = versions.filter(~F.col("name").isin(list(aliases))).unionByName(new)
    before = {tuple(r) for r in faults(versions).collect()}
    more = [tuple(r) for r in faults(out).collect() if tuple(r) not in before]
    if more:
        raise ValueError(f"the release would leave {more[:5]}")
    return out
