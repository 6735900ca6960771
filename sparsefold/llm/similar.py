"""Classes of similar texts by exact Jaccard likeness of word shingles, on candidates from an index of positional minima.

SimHash's 64 bits cannot find near copies at a likeness of 0.8 (they differ in some 10 bits, and within two bits there are
few), so candidates come from two indexes: the fingerprints' byte-position index, and the same kind of index over a sketch
of BANDS * WIDTH positions, each the least shingle hash under a permutation of its own, which two texts share with a
probability equal to their likeness. A posting is WIDTH adjoining positions. At a likeness of 0.8 a pair shares one of the
BANDS postings with probability 0.9996, above it with more.

Texts with equal shingle sets are one vertex, so copies never multiply, and lists with the same members are compared once.
Every pair of a list is then compared on its whole shingle sets (64-bit hashes), whatever the list's length: lists with
more than BLOCK_SHINGLES shingles are dealt to blocks, and tasks compare block with block. A task returns a spanning
forest of the links that it found, never all of them, which leaves the components as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsefold.llm.common import drop_stash, stash

BANDS, WIDTH = 20, 5
#: Shingles of a block of a list, some: 8 MB.
BLOCK_SHINGLES = 1 << 20
#: Words that a task remembers at most, some 15 MB.
MEMO = 100_000
#: Bytes of shingle sets that leave a task at a time, some.
SET_BYTES = 1 << 23
#: Shingles that are permuted at a time.
STEP = 4096
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all (the finaliser of MurmurHash3)."""
    for m in MIX:
        x = (x ^ (x >> np.uint64(33))) * m
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: int, memo: dict[bytes, int]) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; the whole sequence is one shingle if it has fewer words.

    memo remembers words' hashes.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(memo) > MEMO:
        memo.clear()
    for w in set(found).difference(memo):
        memo[w] = xxhash.xxh64_intdigest(w, 42)
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    size = min(words, len(h))
    total = np.zeros(len(h) - size + 1, np.uint64)
    for j in range(size):
        total = _mixed(total + h[j : len(h) - size + 1 + j] + np.uint64(j + 1))
    return np.unique(total)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(1, 1 << 63, BANDS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, BANDS * WIDTH, dtype=np.uint64)


def postings(hashes: np.ndarray) -> np.ndarray:
    """One number for each band: its place and its WIDTH minima."""
    a, b = _permutations()
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), STEP):
        x = hashes[at : at + STEP, None] * a + b
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, WIDTH).T:
        out = _mixed(out + column)
    return out


def simhash(hashes: np.ndarray) -> int:
    """The majority of the bits of distinct shingle hashes, as a signed number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        counts += np.unpackbits(hashes[at : at + STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes)).view(">i8")
    return int(bits[0])


def _sketches(words: int):
    names, types = ["_row", "_id", "_set", "_n", "_print", "_keys"], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches):
        memo: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for text in batch.column(2):
                h = shingle_set(text.as_py(), words, memo)
                out.append((xxhash.xxh3_128_digest(h.tobytes()), len(h), simhash(h), postings(h).view(np.int64).tolist() if len(h) else []))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, types[2:], strict=True)]], names)

    return run


def _sets(words: int):
    """_vertex, text and _places in; _vertex, _hashes (the shingle set) and _places out."""

    def run(batches):
        memo: dict[bytes, int] = {}
        for batch in batches:
            held, size, start = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                held.append(shingle_set(text.as_py(), words, memo).tobytes())
                size += len(held[-1])
                if size > SET_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(start, len(held))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held, pa.binary()), part.column(2)], ["_vertex", "_hashes", "_places"])
                    held, size, start = [], 0, i + 1

    return run


def forest(ids: np.ndarray, sets: list[np.ndarray], similarity: float, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect whatever the pairs at a likeness of similarity or more connect; sides: only pairs across them."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(-sizes, kind="stable")
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    root, out = np.arange(len(ids)), []
    seen = np.zeros(int(number.max()) + 1 if len(number) else 1, bool)
    for i in order:
        if (root == root[0]).all():
            break
        mine = number[starts[i] : starts[i + 1]]
        others = np.flatnonzero((root != root[i]) & (sizes >= similarity * sizes[i]) & (sizes <= sizes[i] / similarity) & (True if sides is None else sides != sides[i]))
        if not len(others):
            continue
        seen[mine] = True
        at = np.concatenate([np.arange(starts[j], starts[j + 1]) for j in others])
        both = np.add.reduceat(seen[number[at]].astype(np.int64), np.concatenate(([0], np.cumsum(sizes[others])[:-1])))
        seen[mine] = False
        for j in others[both >= similarity * (sizes[i] + sizes[others] - both)]:
            if root[j] != root[i]:
                out.append((int(ids[i]), int(ids[j])))
                root[root == root[j]] = root[i]
    return out


def classes(numbered: DataFrame, row: str, id_col: str, text_col: str, words: int, similarity: float, print_roots: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Per row: _row, _id and _root, the same for all rows that links connect. print_roots gives vertex and root of each
    fingerprint (_print) that has a link."""
    from sparsefold.llm.simhash import components

    narrow = numbered.select(F.col(row).alias("_row"), F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    rows = stash(narrow.mapInArrow(_sketches(words), "_row bigint, _id bigint, _set binary, _n bigint, _print bigint, _keys array<bigint>"), "similar-rows")
    sets = stash(rows.groupBy("_set").agg(F.min("_row").alias("_vertex"), F.first("_n").alias("_n"), F.first("_print").alias("_print"), F.first("_keys").alias("_keys")), "similar-sets")
    parts = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    roots = print_roots(sets.filter("_n > 0").select("_print").distinct().repartition(parts))
    by_print = sets.filter("_n > 0").join(roots, F.col("_print") == F.col("vertex"), "left").select("_vertex", "_n", F.xxhash64(F.coalesce("root", "_print"), F.lit("print")).alias("key"))
    members = sets.select("_vertex", "_n", F.explode("_keys").alias("key")).union(by_print)
    # equal figures mean equal members: two independent 64-bit sums of their hashes are among them
    marks = [F.bit_xor(F.xxhash64("_vertex", F.lit(i))).alias(f"mark{i}") for i in range(2)]
    lists = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("_n").alias("shingles"), *marks).filter("n > 1")
    lists = lists.groupBy("n", "shingles", "mark0", "mark1").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("_vertex"), F.col("blocks")).cast("int")
    listed = members.join(lists.hint("merge"), "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # each vertex with its places in lists; texts are dealt to it by one plan at every size, as the table grows with the corpus
    place = F.struct("key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    placed = stash(listed.groupBy("_vertex").agg(F.collect_list(place).alias("_places")), "similar-places")
    asked = numbered.select(F.col(row), F.col(text_col).alias("_text")).join(placed.hint("merge"), F.col(row) == F.col("_vertex")).select("_vertex", "_text", "_places")
    kind = "array<struct<key:bigint,own:int,i:int,j:int>>"
    hashes = asked.mapInArrow(_sets(words), f"_vertex bigint, _hashes binary, _places {kind}")
    dealt = hashes.select("_vertex", "_hashes", F.explode("_places").alias("_place")).select("_vertex", "_hashes", "_place.*")

    def compare(table):
        ids = table.column("_vertex").to_numpy()
        order = np.argsort(ids, kind="stable")
        found = [np.frombuffer(h.as_py(), np.uint64) for h in table.column("_hashes").take(pa.array(order))]
        across = table.column("i")[0] != table.column("j")[0]
        links = forest(ids[order], found, similarity, table.column("own").to_numpy()[order] if across else None)
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    edges = dealt.groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()
    linked = components(edges)
    of_set = sets.join(linked, F.col("_vertex") == F.col("vertex"), "left").select("_set", F.coalesce("root", "_vertex").alias("_root"))
    found = stash(rows.select("_row", "_id", "_set").join(of_set, "_set").select("_row", "_id", "_root"), "similar-classes")
    drop_stash(rows, sets, placed)
    return found
