"""Mixing sources to target weights by temperature.

Source token shares are raised to an exponent in [0, 1] and normalised; 1 keeps the natural mix, 0 makes all sources
equal. The exponent is bisected until the mix reaches a target entropy, or as far as a limit on repetition allows. Weights
are then realised: with a token budget b, source s gets a quota of w_s * b tokens, which are whole passes over the source,
each in a permutation of its own, and the start of one more. Quotas are cut into blocks of about `block_tokens`, each of
which holds every source's share, and each block is permuted. Without a budget the smallest one is taken at which every
document comes at least once, so no document is lost.

A document's size is its words and one more. Permutations are orders of a hash of (id, text, pass, seed). A pass's running
token sums come from hash buckets: sums per bucket are added up per source, and only inside a bucket are rows put in
order, so a source that holds a third of all rows is no single task. Per-source figures stay in a table; the driver sees
aggregates of it.

Edge cases: a null source is a source of its own; a null text counts as empty (size 1); null ids are carried along; rows
that agree in id and text come or stay out together at the end of a quota; an empty table gives no rows. Other columns
pass through mix() unchanged, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparsefold.llm.common import free_name, read, stash

NAME = "op7_temperature_mixing"

REPETITION_LIMIT = 1.5
BLOCK_TOKENS = 1 << 18
ROWS_PER_BUCKET = 2000
#: Bisections that one job decides: it looks at all 2^LEVELS - 1 exponents that they could come to.
LEVELS, JOBS = 4, 8


@dataclass(frozen=True)
class Mix:
    """What was decided: quotas has source, tokens, quota, passes (whole ones), and cut, the last hash of the last pass."""

    exponent: float
    entropy: float
    budget: float
    quotas: DataFrame


def size_of(text_col: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint") + 1


def order_of(id_col: str, text_col: str, number: Column, seed: int) -> Column:
    """A row's place in the permutation of a pass."""
    return F.xxhash64(F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))), number.cast("int"), F.lit(seed))


def _probe(totals: DataFrame, tokens: float, exponents: list[float]) -> tuple[list[tuple[float, float]], float, float]:
    """(sum of powers, sum of power times log share) for each exponent, and the smallest and largest share."""
    share = F.col("tokens") / F.lit(float(tokens))
    sums = [x for a in exponents for x in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share)))]
    row = totals.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)], F.min(share).alias("low"), F.max(share).alias("high")).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(exponents))], row["low"], row["high"]


def _entropy(a: float, z: float, e: float) -> float:
    return math.log(z) - a * e / z


def _repetition(a: float, z: float, low: float, high: float, passes: float | None) -> float:
    """The most passes over a source; passes: the budget over the corpus's tokens, None for the covering budget."""
    most = max(low ** (a - 1), high ** (a - 1))
    return most * (passes / z if passes is not None else max(low ** (1 - a), high ** (1 - a)))


def solve(totals: DataFrame, target_entropy: float | None, repetition_limit: float | None, budget: float | None) -> tuple[float, float, float]:
    """exponent, entropy and budget. The exponent is the smallest in [0, 1] that keeps the limit and is not above the
    target entropy; 1 if none does, 0 if neither is given. Both fall as the exponent grows, which is what bisection needs.
    """
    tokens = totals.agg(F.sum("tokens")).first()[0]
    if not tokens:
        return 1.0, 0.0, 0.0
    passes = None if budget is None else budget / tokens

    def fits(a, sums, low, high):
        return (target_entropy is None or _entropy(a, *sums) <= target_entropy) and (repetition_limit is None or _repetition(a, sums[0], low, high, passes) <= repetition_limit)

    a, b = 0.0, 1.0
    (sums,), low, high = _probe(totals, tokens, [0.0])
    if fits(0.0, sums, low, high):
        b = 0.0
    while b - a > 2.0 ** -(LEVELS * JOBS):
        steps = 1 << LEVELS
        points = [a + (b - a) * k / steps for k in range(1, steps)]
        sums, low, high = _probe(totals, tokens, points)
        good = next((k for k, (p, s) in enumerate(zip(points, sums, strict=True)) if fits(p, s, low, high)), len(points))
        a, b = ([a, *points][good], [*points, b][good])
    ((z, e),), low, high = _probe(totals, tokens, [b])
    cover = tokens * z * max(low ** (1 - b), high ** (1 - b))
    return b, _entropy(b, z, e), cover if budget is None else float(budget)


def _bucket(order: Column, docs: Column) -> Column:
    """A hash's bucket in a source of so many documents: its highest bits, which keep the order."""
    bits = F.least(F.greatest(F.ceil(F.log2(docs / F.lit(float(ROWS_PER_BUCKET)))), F.lit(1)), F.lit(40)).cast("int")
    return F.call_function("shiftright", order, F.lit(64) - bits)


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = None, repetition_limit: float | None = REPETITION_LIMIT, budget: float | None = None, seed: int = 5) -> Mix:
    """Decide the weights and where each source's last pass ends."""
    sized = df.select(F.col(source_col).alias("source"), size_of(text_col).alias("size"), F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("_key"))
    sized = stash(sized, "mixing-sizes")
    totals = stash(sized.groupBy("source").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mixing-totals")
    exponent, entropy, whole = solve(totals, target_entropy, repetition_limit, budget)
    norm = totals.agg(F.sum(F.pow("tokens", F.lit(exponent)))).first()[0] or 1.0
    quota = F.pow("tokens", F.lit(exponent)) / F.lit(float(norm)) * F.lit(float(whole))
    # the covering budget makes some quota a whole pass but for rounding
    passes = F.floor(quota / F.col("tokens") + 1e-9).cast("int")
    quotas = totals.withColumn("quota", quota).withColumn("passes", passes).withColumn("left", F.greatest(F.col("quota") - F.col("passes") * F.col("tokens"), F.lit(0.0)))
    quotas = stash(quotas, "mixing-quotas")
    q = quotas.select(F.col("source").alias("_s"), "docs", "passes", "left")
    placed = sized.join(q, F.col("source").eqNullSafe(F.col("_s"))).withColumn("order", F.xxhash64("_key", "passes", F.lit(seed))).withColumn("bucket", _bucket(F.col("order"), F.col("docs")))
    placed = placed.groupBy("source", "bucket", "order", "left").agg(F.sum("size").alias("size"))
    sums = placed.groupBy("source", "bucket", "left").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("size")
    ends = sums.withColumn("before", before).filter((F.col("before") <= F.col("left")) & (F.col("before") + F.col("size") > F.col("left")))
    ends = stash(ends.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "before"), "mixing-ends")
    inside = placed.join(ends, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("order"))
    last = inside.withColumn("upto", upto).groupBy("source", "bucket", "left").agg(F.max(F.when(F.col("upto") <= F.col("left"), F.col("order"))).alias("order"), F.min("order").alias("least"))
    # none of the last bucket fits: all buckets before it do
    cut = last.select(F.col("source").alias("_s"), F.coalesce("order", F.col("least") - 1).alias("cut"))
    found = quotas.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "tokens", "docs", "quota", "passes", F.when(F.col("left") > 0, F.col("cut")).alias("cut"))
    return Mix(exponent, entropy, whole, stash(found, "mixing-plan"))


def _copies(df: DataFrame, mixed: Mix, id_col: str, text_col: str, source_col: str, seed: int) -> tuple[DataFrame, str, str]:
    """df with a row for each pass that takes the row; the names of the pass's column and of the source's figures."""
    number, figures, source = (free_name(df, n) for n in ("__pass", "__figures", "__source"))
    q = mixed.quotas.select(F.struct("*").alias(figures), F.col("source").alias(source))
    whole = F.col(figures)["passes"]
    last = order_of(id_col, text_col, whole, seed)
    passes = whole + F.when(last <= F.col(figures)["cut"], 1).otherwise(0)
    joined = df.join(q, F.col(source_col).eqNullSafe(F.col(source))).drop(source)
    return joined.withColumn(number, F.explode(F.sequence(F.lit(0), passes))).filter(F.col(number) < passes), number, figures


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5, **limits) -> DataFrame:
    """The rows of df, each as often as its passes take it."""
    mixed = plan(df, id_col, text_col, source_col, seed=seed, **limits)
    copies, number, figures = _copies(df, mixed, id_col, text_col, source_col, seed)
    return copies.drop(number, figures)


def schedule(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5, block_tokens: int = BLOCK_TOKENS, **limits) -> DataFrame:
    """Per copy: id, source, n_tokens, pass, block and slot (its place in the block, gapless from 0)."""
    mixed = plan(df, id_col, text_col, source_col, seed=seed, **limits)
    blocks = max(1, math.ceil(mixed.budget / block_tokens))
    narrow = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), size_of(text_col).alias("size"))
    copies, number, figures = _copies(narrow, mixed, "id", "text", "source", seed)
    q, order = F.col(figures), order_of("id", "text", F.col(number), seed)
    copies = copies.select("id", "source", "size", F.col(number).alias("pass"), order.alias("order"), _bucket(order, q["docs"]).alias("bucket"), q["tokens"].alias("tokens"), q["quota"].alias("quota"))
    copies = stash(copies, "mixing-copies")
    sums = copies.groupBy("source", "pass", "bucket").agg(F.sum("size").alias("total"))
    before = F.sum("total").over(Window.partitionBy("source", "pass").orderBy("bucket")) - F.col("total")
    sums = stash(sums.select(F.col("source").alias("_s"), F.col("pass").alias("_p"), F.col("bucket").alias("_b"), before.alias("before")), "mixing-buckets")
    joined = copies.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("pass") == F.col("_p")) & (F.col("bucket") == F.col("_b")))
    inside = F.sum("size").over(Window.partitionBy("source", "pass", "bucket").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    at = (F.col("pass") * F.col("tokens") + F.col("before") + inside) / F.col("quota")
    block = F.least(F.floor(at * blocks), F.lit(blocks - 1)).cast("bigint")
    slot = F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64("order", F.lit(seed)), "id")) - 1
    return joined.withColumn("block", block).withColumn("slot", slot.cast("bigint")).select("id", "source", F.col("size").alias("n_tokens"), "pass", "block", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed under the limit of 1.5 passes over a source."""
    out = schedule(read(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id")
