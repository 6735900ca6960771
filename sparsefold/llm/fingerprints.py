"""Threshold-scaled document fingerprints: every shingle hash below a fixed fraction of the hash range is kept.

Because the threshold does not depend on the text, sketches merge by union (merge()), and |A and B| / |A| estimates how
much of A is contained in B even if B is a thousand times longer. Shingles are five lower-cased words (the whole sequence
for fewer). A sketch has two fields: low, the hashes below the threshold, and least, the smallest hash of a text that has
shingles but none below. least lies outside the fixed fraction, so it tells texts without a low hash apart and nothing
more: a containment is undefined (null) where the first sketch has no low hash, and merge() drops least as soon as any
merged sketch has a low one.

Everything is a DataFrame expression. The next document in descending order of id is found with one shuffle of the texts:
rows go to buckets of contiguous ids, each bucket gets a copy of the first row of the bucket that follows, and a window
inside the bucket looks one row ahead.

Edge cases: a null text counts as empty; null ids come after all others, and rows with one id follow a hash of the text;
repeated rows are each other's neighbours (rows that agree in id and text stay in one bucket, which sorts on disk if it
must); one row alone is its own next document; an empty table gives no rows. Two wordless texts have likeness and
containment 1, a wordless and another one 0; two texts without a low hash have likeness 1 if their least ones are equal,
else 0. Columns other than id and text are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparsefold.llm.common import bucket_target, order_keys, range_buckets, read

NAME = "op4_scaled_fingerprints"

WORDS = 5
FRACTION = 0.25


def sketch(text: Column, words: int = WORDS, fraction: float = FRACTION) -> Column:
    """low, the distinct shingle hashes below the threshold, sorted; and least, the smallest of all where none is below."""
    found = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1)))
    one = lambda w, i: F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(words)])
    nothing = F.array().cast("array<bigint>")
    hashes = F.aggregate(F.array(found), nothing, lambda _, w: F.when(F.size(w) > 0, F.transform(starts(w), lambda i: one(w, i))).otherwise(nothing))
    below = -(1 << 63) + int(fraction * (1 << 64))

    def kept(h: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(h, lambda x: x < F.lit(below))))
        return F.aggregate(F.array(low), _sketch(nothing, F.lit(None)), lambda _, k: _sketch(k, F.when(F.size(k) == 0, F.array_min(h))))

    return F.aggregate(F.array(hashes), _sketch(nothing, F.lit(None)), lambda _, h: kept(h))


def _sketch(low: Column, least: Column) -> Column:
    return F.struct(low.alias("low"), least.cast("bigint").alias("least"))


def merge(sketches: Column) -> Column:
    """Aggregate: the sketch of several texts read as one collection (shingles across their borders aside)."""
    low = F.array_sort(F.array_distinct(F.flatten(F.collect_list(sketches["low"]))))
    return _sketch(low, F.when(F.max(F.size(sketches["low"])) == 0, F.min(sketches["least"])))


def containment(a: Column, b: Column) -> Column:
    """The share of a's shingles that b has, by their sketches; null where a has shingles but none below the threshold."""
    shared = F.size(F.array_intersect(a["low"], b["low"])) / F.size(a["low"])
    return F.when(F.size(a["low"]) > 0, shared).when(a["least"].isNull(), F.when(_wordless(b), 1.0).otherwise(0.0))


def _wordless(a: Column) -> Column:
    return (F.size(a["low"]) == 0) & a["least"].isNull()


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard likeness of two texts, by their sketches."""
    both, total = F.size(F.array_intersect(a["low"], b["low"])), F.size(a["low"]) + F.size(b["low"])
    return F.when(total == 0, F.when(a["least"].eqNullSafe(b["least"]), 1.0).otherwise(0.0)).otherwise(both / (total - both))


def fingerprint_text(sketched: Column) -> Column:
    """A sketch as text: 16 hex digits a hash; the least hash of a sketch without a low one follows a sign of its own, ~."""
    digits = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    least = sketched["least"]
    return F.when(least.isNull(), F.array_join(F.transform(sketched["low"], digits), "")).otherwise(F.concat(F.lit("~"), digits(least)))


#: Bytes of texts in a bucket, some.
BUCKET_BYTES = 1 << 26


def with_next(df: DataFrame, id_col: str, text_col: str, fraction: float = FRACTION, rows_per_bucket: int = 20_000) -> DataFrame:
    """_id, _text, _own (its sketch), _next and _after: text and sketch of the next row in descending order of id.

    The row that follows the last is the first. Each text is sketched once, where the window finds it. A bucket has
    rows_per_bucket rows or BUCKET_BYTES of text, whichever is less.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    keys = order_keys("_id", "_text", descending=True)
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("_text"))).first()
    if not n:
        own = sketch(F.col("_text"), fraction=fraction)
        return rows.select("_id", "_text", own.alias("_own"), F.col("_text").alias("_next"), own.alias("_after"))
    buckets = range_buckets(rows, keys, bucket_target(df.sparkSession, n, max(1, min(rows_per_bucket, BUCKET_BYTES * n // max(1, size)))))
    named = [k.alias(f"_k{j}") for j, k in enumerate(keys)]
    cols = [F.col(f"_k{j}") for j in range(len(keys))]
    b = buckets.bucket(cols)
    own = F.struct(b.alias("bucket"), F.lit(False).alias("guest"))
    ahead = F.struct(F.pmod(b - 1, F.lit(len(buckets))).alias("bucket"), F.lit(True).alias("guest"))
    places = F.when(buckets.is_first(cols), F.array(own, ahead)).otherwise(F.array(own))
    dealt = rows.select("*", *named).withColumn("_at", F.explode(places)).select("_id", "_text", *cols, F.col("_at.bucket").alias("_bucket"), F.col("_at.guest").alias("_guest"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = dealt.repartition(parts, "_bucket").withColumn("_own", sketch(F.col("_text"), fraction=fraction))
    order = Window.partitionBy("_bucket").orderBy("_guest", *cols)
    ahead = [F.lead("_text").over(order).alias("_next"), F.lead("_own").over(order).alias("_after")]
    return dealt.select("_id", "_text", "_own", "_guest", *ahead).filter(~F.col("_guest")).drop("_guest")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Per row: id, _text, _edited, _next and their sketches."""
    half = F.floor(F.char_length("_text") / 2).cast("int")
    pairs = with_next(df, id_col, text_col, fraction).withColumn("_edited", F.concat(F.substring("_text", F.lit(1), F.char_length("_text") - half), F.substring("_next", F.lit(1), half)))
    return pairs.withColumn("_changed", sketch(F.col("_edited"), fraction=fraction))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their edited texts and their neighbours."""
    found = fingerprints(read(spark, sf_dir, "documents"))
    own, changed, after = F.col("_own"), F.col("_changed"), F.col("_after")
    return found.select(
        F.col("_id").alias("doc_id"),
        F.char_length("_text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text(own).alias("fingerprint"),
        fingerprint_text(changed).alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"),
        likeness(own, after).alias("near_next"),
        containment(own, changed).alias("contained_in_edited"),
        containment(own, after).alias("contained_in_next"),
    )
