"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is 64 bits: the majority of the XXH64 values (seed 42) of a text's 3-word shingles. Two fingerprints link
at `max_bits` (2 at most) or fewer differing bits. Two differing bits touch two of the eight byte positions at most, so a
linked pair agrees in at least three of the four bytes of one half.

The index is built over distinct fingerprints, not documents, so copies never multiply. Its postings are the three-byte
parts of both halves, eight a fingerprint. A list of more than LONG_LIST fingerprints is indexed further, exactly: of any
three other positions a linked pair agrees in one, so its members move to three lists of four bytes each, those of long
lists to lists of six, and at last to lists of six bytes and a third of the other bits, which hold 2^11 distinct
fingerprints at most whatever the corpus. The pairs of the short lists are tallied: the positional bytes at which a pair
met are counted over all of its lists, pairs that reach the guaranteed minimum are retained, and these are verified on
their bits. In the last lists, whose pairs have six bytes in common, only verified pairs leave the list. Nothing is capped.

Links become components by label propagation with pointer jumping over distinct fingerprints; a vertex has at most 2,080
neighbours, so its edges cannot become a hot key, and each round is cut off by a table in the shared folder.

near_dedup(similarity=...) asks for a likeness of texts instead, which 64 bits cannot decide: near copies at a Jaccard
likeness of 0.8 differ in some 10 bits. similar.py then verifies exactly, on candidates of this index and of its own.

Edge cases: a null text counts as empty; texts without a word have fingerprint zero and link as any other; repeated rows
share their fingerprint. A row whose id is null takes part, but a component's id is the smallest non-null id (null if it
has none). An empty table gives no rows. Other columns pass through near_dedup() unchanged, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsefold.llm import similar
from sparsefold.llm.common import drop_stash, free_name, read, stash

NAME = "op5_simhash_near_dedup"

BYTES = 8
SHINGLE = 3
#: Shingles whose bits are unpacked at a time: 4 MB of memory however long a text is.
BLOCK = 1 << 16
WEIGHTS = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    """Word shingles of a text with A-Z lowered, repeats included; the whole sequence if it has fewer words."""
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    starts = np.cumsum([0, *map(len, words[:-1])]) + np.arange(len(words))
    ends = starts + np.fromiter(map(len, words), np.int64, len(words))
    return [joined[a:b] for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number: a bit is 1 if set in over half the shingle hashes."""
    found = shingles(text, size)
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), BLOCK):
        hashes = np.array([digest(s, 42) for s in found[at : at + BLOCK]], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, BYTES), axis=1).sum(axis=0, dtype=np.int64)
    return int(WEIGHTS[counts * 2 > len(found)].sum(dtype=np.uint64))


def _fingerprints(batches):
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["_row", "_id", "_print"])


def with_fingerprints(df: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """_row (row_col, or else the row's number in this evaluation of df), _id and _print (the fingerprint's bits as BIGINT)."""
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    rows = df.select(row.alias("_row"), F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_fingerprints, "_row bigint, _id bigint, _print bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bytes_mask(positions) -> int:
    return _signed(sum(0xFF << (8 * p) for p in positions))


def _finer(level: int) -> dict[int, list[int]]:
    """The masks of postings at a level, by the mask of the long list that they divide (0: all fingerprints)."""
    halves = (range(4), range(4, 8))
    triples = [c for half in halves for c in combinations(half, 3)]
    if level == 0:
        return {0: [_bytes_mask(c) for c in triples]}
    fours = {c: [tuple(sorted((*c, p))) for p in (halves[1] if c[0] < 4 else halves[0])[:3]] for c in triples}
    if level == 1:
        return {_bytes_mask(c): [_bytes_mask(f) for f in found] for c, found in fours.items()}
    sixes = {f: [tuple(sorted((*f, *two))) for two in combinations([p for p in range(BYTES) if p not in f], 2)] for found in fours.values() for f in found}
    if level == 2:
        return {_bytes_mask(f): [_bytes_mask(s) for s in found] for f, found in sixes.items()}
    thirds = {}
    for six in {s for found in sixes.values() for s in found}:
        bits = [8 * p + b for p in range(BYTES) if p not in six for b in range(8)]
        whole = sum(0xFF << (8 * p) for p in six)
        thirds[_bytes_mask(six)] = [_signed(whole | sum(1 << b for b in part)) for part in (bits[:5], bits[5:10], bits[10:])]
    return thirds


#: Lists up to this length are paired; longer ones are indexed further.
LONG_LIST = 16
LEVELS = 4
#: Positional bytes at which a pair with so many differing bits meets in the index at least: a whole half of four, if both
#: differing bytes are in the other half; seven if there is one.
LEAST_SHARED = {0: 8, 1: 7, 2: 4}


def tally(masks: Column) -> Column:
    """At how many byte positions a pair met, from the masks of the lists that it was found in."""
    met = F.bit_or(masks)
    return sum((F.when(met.bitwiseAND(F.lit(_bytes_mask([p])).cast("bigint")) != 0, 1).otherwise(0) for p in range(BYTES)), F.lit(0))


def _pairs(lists: DataFrame, also: Column | None = None) -> DataFrame:
    """a < b and the mask of their list, for the pairs of each list of which also (of the lambdas' x and y) holds."""
    low = lambda x: F.filter("list", lambda y: (y > x) if also is None else (y > x) & also(x, y))
    both = F.flatten(F.transform("list", lambda x: F.transform(low(x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return lists.select("mask", F.explode(both).alias("pair")).select("pair.a", "pair.b", "mask")


def candidates(prints: DataFrame, max_bits: int = 2, long_list: int = LONG_LIST) -> tuple[DataFrame, DataFrame | None]:
    """Pairs a < b of distinct fingerprints (column _print) that reach the guaranteed minimum, with shared, their tally;
    and the verified pairs of the last lists, if lists were divided that far."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the index guarantees pairs at two differing bits or fewer")
    todo, met, dense = prints.select("_print", F.lit(0).cast("bigint").alias("mask")), [], None
    for level in range(LEVELS):
        finer = F.create_map(*[x for m, found in _finer(level).items() for x in (F.lit(m).cast("bigint"), F.array(*[F.lit(f).cast("bigint") for f in found]))])
        postings = todo.select("_print", F.explode(F.element_at(finer, F.col("mask"))).alias("mask"))
        if level > 1:
            postings = postings.distinct()  # lists of different parents have some parts in common
        postings = postings.withColumn("value", F.col("_print").bitwiseAND(F.col("mask")))
        sizes = postings.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = stash(postings.join(sizes, ["mask", "value"]), "simhash-postings")
        last = level == LEVELS - 1
        lists = (shared if last else shared.filter(F.col("n") <= long_list)).groupBy("mask", "value").agg(F.collect_list("_print").alias("list"))
        if last:
            dense = _pairs(lists, lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= max_bits).select("a", "b")
            break
        met.append(_pairs(lists))
        todo = shared.filter(F.col("n") > long_list).select("_print", "mask")
        if todo.isEmpty():
            break
    pairs = met[0]
    for more in met[1:]:
        pairs = pairs.union(more)
    tallied = pairs.groupBy("a", "b").agg(tally(F.col("mask")).alias("shared"))
    return tallied.filter(F.col("shared") >= LEAST_SHARED[max_bits]), dense


def links(prints: DataFrame, max_bits: int = 2, long_list: int = LONG_LIST) -> DataFrame:
    """a < b: the pairs of distinct fingerprints (column _print) at max_bits or fewer differing bits."""
    retained, dense = candidates(prints, max_bits, long_list)
    found = retained.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")
    return found if dense is None else found.union(dense).distinct()


def components(edges: DataFrame) -> DataFrame:
    """vertex, root: the smallest vertex reachable over the edges (a, b), for each vertex that has an edge."""
    both = stash(edges.select("a", "b").union(edges.select("b", "a")), "simhash-edges")
    labels = stash(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("vertex"), F.least("a", "low").alias("root")), "simhash-labels")
    while True:
        heard = both.join(labels, both["b"] == labels["vertex"]).groupBy("a").agg(F.min("root").alias("low"))
        near = labels.join(heard, labels["vertex"] == heard["a"]).select("vertex", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        near = stash(near, "simhash-near")
        jump = near.select(F.col("vertex").alias("at"), F.col("root").alias("far"))
        found = stash(near.join(jump, near["root"] == jump["at"]).select("vertex", F.least("root", "far").alias("root"), "was"), "simhash-labels")
        drop_stash(labels, near)
        labels = found
        if labels.filter(F.col("root") != F.col("was")).isEmpty():
            drop_stash(both)
            return labels.select("vertex", "root")
        labels = labels.select("vertex", "root")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, row_col: str | None = None) -> DataFrame:
    """Per row of df: _row, _id, _print and _root, the smallest fingerprint of its component."""
    rows = stash(with_fingerprints(df, id_col, text_col, row_col), "simhash-prints")
    # dealt anew: the distinct fingerprints are few bytes, which would otherwise end up in a task or two before they multiply
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    roots = components(links(rows.select("_print").distinct().repartition(parts), max_bits))
    return rows.join(roots, rows["_print"] == roots["vertex"], "left").select("_row", "_id", "_print", F.coalesce("root", "_print").alias("_root"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, similarity: float | None = None, words: int = 5) -> DataFrame:
    """df with one row of each component: that of the smallest id (null ids last, then the first row).

    Rows link by their fingerprints of 3-word shingles at max_bits, or, where similarity is given, at that Jaccard likeness
    of their distinct shingles of so many words. Rows are numbered once, in a table of their own: a second evaluation of
    df may number them in another way.
    """
    row, gone_row = free_name(df, "__row"), free_name(df, "__gone")
    numbered = stash(df.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    if similarity is None:
        rows = near_duplicates(numbered, id_col, text_col, max_bits, row)
    else:
        rows = similar.classes(numbered, row, id_col, text_col, words, similarity, lambda prints: components(links(prints, max_bits)))
    place = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row"))
    first = rows.groupBy("_root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("_root").alias("_of"), "first._row")
    # the rows that go: a narrow table of known size, so that whole texts are dealt only where it is large
    gone = rows.join(first.withColumnRenamed("_row", "_kept"), F.col("_root") == F.col("_of")).filter("_row <> _kept")
    gone = stash(gone.select(F.col("_row").alias(gone_row)), "simhash-gone")
    return numbered.join(gone, F.col(row) == F.col(gone_row), "left_anti").drop(row)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    rows = stash(near_duplicates(read(spark, sf_dir, "documents")), "simhash-rooted")
    # a table of its own, so that the join below has nothing but exchanges under it and large groups can be split
    smallest = stash(rows.groupBy("_root").agg(F.min("_id").alias("component_id")).withColumnRenamed("_root", "_of"), "simhash-smallest")
    out = rows.join(smallest, rows["_root"] == smallest["_of"])
    return out.select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), "component_id")
