"""Roll-up of terms. parents: term, parent; labels: term, label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsefold.sources.scratch import written


def closure(parents: DataFrame) -> DataFrame:
    """term, ancestor, distance (the shortest): every term with itself at 0. Doubles the reach in each round."""
    terms = parents.select("term").union(parents.select("parent")).distinct()
    reach = terms.select("term", F.col("term").alias("ancestor"), F.lit(0).alias("distance")).union(parents.select("term", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    reach = reach.groupBy("term", "ancestor").agg(F.min("distance").alias("distance"))
    size = -1
    while True:
        reach = reach.checkpoint() if reach.sparkSession.sparkContext.getCheckpointDir() else reach.cache()
        n = reach.count()
        if n == size:
            return reach
        size = n
        far = reach.select(F.col("term").alias("ancestor"), F.col("ancestor").alias("further"), F.col("distance").alias("more"))
        reach = reach.join(far, "ancestor").select("term", F.col("further").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance")).groupBy("term", "ancestor").agg(F.min("distance").alias("distance"))


def roll_up(terms: DataFrame, reach: DataFrame, curated: DataFrame) -> DataFrame:
    """term, general: the first curated ancestor by priority, else the term itself. curated: ancestor, priority."""
    hits = terms.join(reach, "term").join(F.broadcast(curated), "ancestor").groupBy("term").agg(F.min_by("ancestor", "priority").alias("found"))
    return terms.join(hits, "term", "left").select("term", F.coalesce("found", "term").alias("general"))


def descendants(reach: DataFrame, term: str) -> DataFrame:
    return reach.filter(F.col("ancestor") == term).select("term")


#: Levels after which those found are written as one table.
MERGED = 16


def typed_ancestors(edges: DataFrame, kinds: tuple[str, ...] = ("is_a",), blocked: tuple[str, ...] = (), wanted: DataFrame | None = None) -> DataFrame:
    """term, ancestor and distance (the shortest) along edges (term, parent, kind) of some kinds, every term its own first;
    blocked ones end a path. wanted (ancestor) restricts the ancestors, from which the walk then starts downwards.

    Level by level: each one holds the pairs that no level before it has, written to the shared folder, so neither the
    number of pairs nor that of levels has a bound. Raises where an ancestor is below itself; circles of terms that aren't
    wanted as ancestors end a walk without harm.
    """
    kept = edges.filter(F.col("kind").isin(*kinds) & ~F.col("term").isin(*blocked) & ~F.col("parent").isin(*blocked)).select("term", "parent").distinct()
    terms = edges.select("term").union(edges.select("parent")).distinct()
    kept = written(kept, "ontology-edges")
    start = terms.select("term", F.col("term").alias("ancestor"))
    if wanted is not None:
        start = start.join(wanted.select("ancestor").distinct(), "ancestor", "left_semi").select("term", "ancestor")
    found = newest = written(start.withColumn("distance", F.lit(0)), "ontology-level")
    level = 0
    steps = kept.select("term", F.col("parent").alias("_at"))
    while True:
        # from an ancestor's terms down to theirs: only the pairs of the newest level are extended
        below = newest.select(F.col("term").alias("_at"), "ancestor", F.col("distance") + 1).toDF("_at", "ancestor", "distance")
        reached = steps.join(below, "_at").select("term", "ancestor", "distance").distinct()
        fresh = reached.join(found.filter(F.col("distance") > 0).select("term", "ancestor"), ["term", "ancestor"], "left_anti")
        newest = written(fresh, "ontology-level")
        size = newest.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("term") == F.col("ancestor")).alias("circles")).first()
        if size["circles"]:
            raise ValueError(f"{size['circles']} terms are their own ancestors: the recursion has no end")
        if not size["n"]:
            return found
        level += 1
        found = found.unionByName(newest)
        if level % MERGED == 0:
            found = written(found, "ontology-found")


def high_level_terms(terms: DataFrame, edges: DataFrame, curated: DataFrame, root: str, kinds: tuple[str, ...] = ("is_a",), blocked: tuple[str, ...] = ()) -> DataFrame:
    """term, general (all of its curated terms by priority) and top (the first one; null where it has none).

    curated: ancestor, priority. Ancestors count only for terms below the root; a curated term always has itself.
    """
    wanted = curated.select("ancestor").union(curated.sparkSession.createDataFrame([(root,)], "ancestor string"))
    up = typed_ancestors(edges, kinds, blocked, wanted)
    below = up.filter((F.col("ancestor") == root) & (F.col("term") != root)).select("term", F.lit(True).alias("_below"))
    hits = terms.select("term").distinct().join(up, "term").join(curated, "ancestor").join(below, "term", "left")
    hits = hits.filter(F.col("_below").isNotNull() | (F.col("term") == F.col("ancestor")))
    each = hits.groupBy("term").agg(F.array_sort(F.collect_set(F.struct("priority", "ancestor"))).alias("h"))
    listed = each.select("term", F.transform("h", lambda h: h["ancestor"]).alias("general"))
    out = terms.join(listed, "term", "left")
    return out.withColumn("general", F.coalesce("general", F.array().cast("array<string>"))).withColumn("top", F.get("general", F.lit(0)))
