"""Alignment of two tokenizers' tokens over a corpus by a group dictionary.

The tokens of both tokenizers cover the same bytes. Offsets where a token of either ends cut them into groups; two tokens
are linked if their bytes overlap, which happens within a group only. A group is the same wherever it comes again, so
groups are interned, each distinct one is expanded into links once, and everything else is multiplication: by how often a
document has a group, and by how many documents have it.

Encoding cuts a text after a character that is no white space and before a space or line feed. Neither tokenizer merges
across such a place (align() checks it on the vocabularies, as token_counts.prove does), so a unit between two cuts is encoded
once and remembered; new units are encoded and cut into groups many at a time. A task gathers its documents in blocks and writes, for each distinct group of a block, the list of documents that
have it and how often: an inverted index of blocks. From there on Spark joins and sums:

1. the dictionary: distinct groups with the number of their documents, each expanded into links;
2. per id pair, the documents that hold it: the documents of its group if only one group holds the pair, which is the rule;
   for the others the distinct documents in the union of the groups' lists, block by block;
3. per group, the sums over its links, joined back to the blocks' lists by group key and summed per document.

A frequent group has one row a block and not one a document; joins that such a key makes skewed have a side of few rows a
key, which adaptive execution splits. Texts are read once; lists move, texts never.

Edge cases: a text that is null or empty, or whose tokens don't give its bytes back (after a space, such as texts with the
space mark of the piece vocabulary), has no tokens: zeros and an empty groups_sha256; a null id is carried along; repeated
rows are documents of their own; a text of any length is one document of one block; counts that tie are all highest; an
empty table gives no rows. Columns other than id and text are not carried.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsefold.llm.common import byte_of_char, read, stash
from sparsefold.llm.token_counts import MARK, prove

NAME = "op13_group_alignment"

MODEL_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Units of a text without white space other than spaces and line feeds, and the cuts of any text.
UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
CUT = re.compile(r"(?<=\S)(?=[ \n])")
OTHER_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
#: Fixed value: the pre-tokens of the byte-level vocabulary. Beyond the letters below, libraries may know different letters.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_BELOW = "\u0250"
#: Units (occurrences) and documents in a block, some; units that a worker remembers between blocks.
BLOCK_UNITS, BLOCK_DOCS, MEMO = 600_000, 20_000, 250_000


def load_a(path: str):
    """A byte-level tokenizer and the bytes of its tokens (none for special ones)."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    chars, vocabulary = byte_of_char(), lib.get_vocab(with_added_tokens=False)
    entries = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        entries[i] = bytes(chars[c] for c in piece)
    return lib, entries


def load_b(path: str):
    """A piece tokenizer and the bytes of its tokens."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
    return lib, [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]


def split_key(key: bytes) -> tuple[list[int], list[int]]:
    """The ids of A and of B of a group's key: how many of A (32 bits), these and those of B (16 bits each)."""
    n, ids = int.from_bytes(key[:4], "little"), np.frombuffer(key, "<u2", offset=4).tolist()
    return ids[:n], ids[n:]


def links(a: list[int], b: list[int], size_a, size_b) -> list[tuple[int, int]]:
    """The pairs of a group's tokens whose bytes overlap."""
    out, i, j = [], 0, 0
    end_a, end_b = size_a[a[0]], size_b[b[0]]
    while True:
        out.append((a[i], b[j]))
        here = min(end_a, end_b)
        if end_a == here:
            i += 1
        if end_b == here:
            j += 1
        if i == len(a) or j == len(b):
            return out
        if end_a == here:
            end_a += size_a[a[i]]
        if end_b == here:
            end_b += size_b[b[j]]


def cut_text(text: str) -> list[str]:
    return CUT.split(text) if any(c in text for c in OTHER_SPACE) else UNIT.findall(text)


class Aligner:
    """Units, groups and their numbers, as a worker has met them.

    texts has a unit's groups as text, count_a and count_b its tokens; refused are units whose tokens don't give their bytes back;
    flat[starts[u]:starts[u + 1]] the numbers of its groups.
    """

    def __init__(self, path_a: str, path_b: str):
        import tiktoken

        self.a, self.bytes_a = load_a(path_a)
        self.b, self.bytes_b = load_b(path_b)
        self.size_a, self.size_b = np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))
        # the same merges in another library, which takes a tenth of the time; ids stand in the order of merges there
        ranks = {entry: i for i, entry in enumerate(self.bytes_a) if entry}
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_merge_order(path_a) else None
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.count_a, self.count_b, self.flat, self.starts = array("q"), array("q"), array("q"), array("q", [0])
        self.group_number: dict[bytes, int] = {}
        self.group_text: list[str] = []
        self.refused: set[int] = set()

    def encode_a(self, units: list[str]) -> np.ndarray:
        joined = "".join(units)
        if self.fast and max(joined) < PLAIN_BELOW:
            return np.array(self.fast.encode_ordinary(joined), np.int64)
        return np.fromiter(chain.from_iterable(x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)), np.int64)

    def encode_b(self, units: list[str]) -> np.ndarray:
        """A line feed in front keeps the library's own mark away; the two are the first two tokens."""
        return np.fromiter(chain.from_iterable(x[2:] for x in self.b.encode(["\n" + u for u in units], num_threads=1)), np.int64)

    def add(self, units: list[str]) -> bool:
        """Number units; False, and nothing done, if their tokens don't give their bytes back, each unit's its own."""
        data = [u.encode() for u in units]
        ids_a, ids_b, ends = self.encode_a(units), self.encode_b(units), np.cumsum([len(d) for d in data])
        joined = b"".join(data)
        if b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) != joined or b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())) != joined:
            return False
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last = np.searchsorted(cuts, ends)
        if last[-1] >= len(cuts) or (cuts[last] != ends).any():
            return False
        to_a, to_b = 2 * np.searchsorted(ends_a, cuts) + 2, 2 * np.searchsorted(ends_b, cuts) + 2
        packed_a, packed_b = ids_a.astype("<u2").tobytes(), ids_b.astype("<u2").tobytes()
        groups, numbers, at_a, at_b = [], self.group_number, 0, 0
        for end_a, end_b in zip(to_a.tolist(), to_b.tolist(), strict=True):
            key = ((end_a - at_a) >> 1).to_bytes(4, "little") + packed_a[at_a:end_a] + packed_b[at_b:end_b]
            found = numbers.get(key)
            if found is None:
                found = numbers[key] = len(numbers)
                self.group_text.append("|".join(",".join(map(str, x)) for x in split_key(key)))
            groups.append(found)
            at_a, at_b = end_a, end_b
        self.flat.extend(groups)
        edges, base = (last + 1).tolist(), self.starts[-1]
        self.starts.extend(base + e for e in edges)
        self.count_a.extend(np.diff(np.searchsorted(ends_a, ends) + 1, prepend=0).tolist())
        self.count_b.extend(np.diff(np.searchsorted(ends_b, ends) + 1, prepend=0).tolist())
        named = list(map(self.group_text.__getitem__, groups))
        self.texts += [";".join(named[i:j]) for i, j in zip([0, *edges], edges, strict=False)]
        return True

    def refuse(self) -> None:
        """Number a unit whose tokens don't give its bytes back."""
        self.refused.add(len(self.texts))
        self.texts.append("")
        self.count_a.append(0)
        self.count_b.append(0)
        self.starts.append(self.starts[-1])

    def learn(self, units: list[str]) -> None:
        for at in range(0, len(units), 2000):
            self._learn(units[at : at + 2000])

    def _learn(self, units: list[str]) -> None:
        """Number new units; where some are odd, halve them until these stand alone."""
        first = len(self.texts)
        if not self.add(units):
            if len(units) > 1:
                self._learn(units[: len(units) // 2])
                self._learn(units[len(units) // 2 :])
                return
            self.refuse()
        self.number.update(zip(units, range(first, first + len(units)), strict=True))

    def whole(self, text: str) -> int | None:
        """A whole text (after a space) as a unit of its own, which is not remembered; None if it has no tokens."""
        if not self.add([text]):
            return None
        return len(self.texts) - 1

    def units(self, texts: list[str | None]) -> list[list[int]]:
        """The unit numbers of each text; none for a text without tokens."""
        split = [cut_text(" " + t) if t else [] for t in texts]
        found = [list(map(self.number.get, units)) for units in split]
        gaps = [[at for at, u in enumerate(numbers) if u is None] if None in numbers else [] for numbers in found]
        self.learn(list({units[at] for units, places in zip(split, gaps, strict=True) for at in places}))
        for text, units, numbers, places in zip(texts, split, found, gaps, strict=True):
            for at in places:
                numbers[at] = self.number[units[at]]
            if self.refused and not self.refused.isdisjoint(numbers):
                one = self.whole(" " + text)
                numbers[:] = [] if one is None else [one]
        return found


def in_merge_order(path: str) -> bool:
    """Whether a byte-level vocabulary numbers its tokens in the order of its merges, after the bytes."""
    model = json.loads(Path(path).read_text())["model"]
    chars, vocabulary = byte_of_char(), model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return all(vocabulary.get(c, 256) < 256 for c in chars) and all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))


@lru_cache(maxsize=1)
def aligner_of(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


DOC_COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")


BLOCK_TYPES = (
    *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups")],
    ("groups_sha256", pa.string()),
    ("key", pa.binary()),
    *[(c, pa.list_(pa.int32())) for c in ("docs", "times")],
)


class Block:
    """Documents of one task, until their lists are written."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.ids, self.digests, self.lengths, self.numbers = aligner, [], [], [], []

    def add(self, ids: list, units: list[list[int]]) -> None:
        texts = self.aligner.texts
        self.ids += ids
        self.lengths += map(len, units)
        self.numbers.append(np.fromiter(chain.from_iterable(units), np.int64))
        self.digests += [hashlib.sha256(";".join([texts[u] for u in some]).encode()).hexdigest() if some else "" for some in units]

    def size(self) -> int:
        return sum(map(len, self.numbers))

    def batches(self, number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The documents' rows, then the rows of the block's groups."""
        n, known = len(self.ids), self.aligner
        units, docs = np.concatenate([np.zeros(0, np.int64), *self.numbers]), np.repeat(np.arange(n), self.lengths)
        starts = np.array(known.starts)
        sizes = np.diff(starts)[units]
        count_a, count_b = np.array(known.count_a)[units], np.array(known.count_b)[units]
        each = [np.bincount(docs, x, n).astype(np.int64) for x in (count_a, count_b, sizes)]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat = np.array(known.flat)[np.repeat(starts[units], sizes) + inside]
        pairs = np.sort(flat * max(n, 1) + np.repeat(docs, sizes))  # by group, then by document
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        total, (held, owners) = np.diff(first, append=len(pairs)), np.divmod(pairs[first], max(n, 1))
        names = schema.names
        nothing = {c: pa.nulls(n, schema.field(c).type) for c in names}
        rows = {"block": pa.array([number] * n, pa.int64()), "doc": pa.array(range(n), pa.int32()), "doc_id": pa.array(self.ids, schema.field("doc_id").type), "groups_sha256": pa.array(self.digests)}
        rows |= dict(zip(("n_a", "n_b", "n_groups"), map(pa.array, each), strict=True))
        yield pa.RecordBatch.from_arrays([(nothing | rows)[c] for c in names], names)
        new = np.flatnonzero(np.diff(held, prepend=-1))
        keys = list(known.group_number)  # in the order of their numbers
        edges = np.append(new, len(held)).astype(np.int32)
        for at in range(0, len(new), 20_000):
            some, cut = held[new[at : at + 20_000]].tolist(), edges[at : at + 20_001]
            inside, offsets = slice(cut[0], cut[-1]), pa.array(cut - cut[0])
            nothing = {c: pa.nulls(len(some), schema.field(c).type) for c in names}
            rows = {"block": pa.array([number] * len(some), pa.int64()), "key": pa.array([keys[g] for g in some], pa.binary())}
            rows |= {"docs": pa.ListArray.from_arrays(offsets, pa.array(owners[inside].astype(np.int32))), "times": pa.ListArray.from_arrays(offsets, pa.array(total[inside].astype(np.int32)))}
            yield pa.RecordBatch.from_arrays([(nothing | rows)[c] for c in names], names)


def blocks(df: DataFrame, id_col: str, text_col: str, path_a: str, path_b: str, block_units: int = BLOCK_UNITS) -> DataFrame:
    """Rows of two kinds: documents (block, doc and DOC_COLUMNS) and groups (block, key, docs, times)."""
    kind = df.select(F.col(id_col)).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number, block = aligner_of(path_a, path_b), TaskContext.get().partitionId() << 32, None
        schema = None
        for batch in batches:
            schema = schema or pa.schema([("block", pa.int64()), ("doc", pa.int32()), ("doc_id", batch.schema.field(0).type), *BLOCK_TYPES])
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                if len(aligner.texts) > MEMO and block is None:
                    aligner.forget()
                block = block or Block(aligner)
                block.add(some.column(0).to_pylist(), aligner.units(some.column(1).to_pylist()))
                if block.size() > block_units or len(block.ids) >= BLOCK_DOCS:
                    yield from block.batches(number, schema)
                    number, block = number + 1, None
        if block:
            yield from block.batches(number, schema)

    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"block bigint, doc int, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, key binary, docs array<int>, times array<int>")


def dictionary(lists: DataFrame, size_a: list[int], size_b: list[int]) -> DataFrame:
    """key, df, a, b, m: each distinct group's links, m how often it has one, and the number of documents with the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: dict[tuple[int, int], int] = {}
                for pair in links(*split_key(key), size_a, size_b):
                    found[pair] = found.get(pair, 0) + 1
                for (a, b), m in found.items():
                    for column, value in zip(out, (key, df, a, b, m), strict=True):
                        column.append(value)
            types = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["key", "df", "a", "b", "m"])

    distinct = lists.groupBy("key").agg(F.sum(F.size("docs")).alias("df"))
    return distinct.mapInArrow(run, "key binary, df bigint, a int, b int, m bigint")


def pair_counts(lists: DataFrame, found: DataFrame) -> DataFrame:
    """a, b, count: how many documents hold a pair. found: dictionary()."""
    pairs = found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("homes"), F.sum("df").alias("df"))
    single = pairs.filter("homes = 1").select("a", "b", F.col("df").alias("count"))
    several = found.select("key", "a", "b").join(pairs.filter("homes > 1").select("a", "b"), ["a", "b"])
    held = lists.select("block", "key", "docs").join(several, "key").groupBy("block", "a", "b").agg(F.collect_list("docs").alias("docs"))
    size = F.when(F.size("docs") == 1, F.size(F.col("docs")[0])).otherwise(F.size(F.array_distinct(F.flatten("docs"))))
    return single.unionByName(held.groupBy("a", "b").agg(F.sum(size).alias("count")))


def group_values(found: DataFrame, counts: DataFrame) -> DataFrame:
    """key, n_links, n_best, count_sum: sums over a group's links."""
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    stats = counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).cast("bigint").alias("best"))
    joined = found.select("key", "a", "b", "m").join(stats, ["a", "b"])
    m = F.col("m")
    return joined.groupBy("key").agg(F.sum(m).alias("n_links"), F.sum(m * F.col("best")).alias("n_best"), F.sum(m * F.col("count")).alias("count_sum"))


SUMS = ("n_links", "n_best", "count_sum")


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_a: str | None = None, model_b: str | None = None, block_units: int = BLOCK_UNITS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): per row DOC_COLUMNS and SUMS; per linked id pair the number of documents that hold it."""
    if model_a is None or model_b is None:
        import public_tokenizers

        model_a, model_b = model_a or public_tokenizers.path(MODEL_A), model_b or public_tokenizers.path(MODEL_B)
    prove(model_b)  # raises where pieces cross cuts
    bytes_a, bytes_b = load_a(model_a)[1], load_b(model_b)[1]
    if max(len(bytes_a), len(bytes_b)) >= 0xFFFF:
        raise ValueError("token numbers must fit into 16 bits")
    encoded = stash(blocks(df, id_col, text_col, model_a, model_b, block_units), "alignment-blocks", "zstd")
    lists = encoded.filter(F.col("key").isNotNull()).select("block", "key", "docs", "times")
    found = stash(dictionary(lists, list(map(len, bytes_a)), list(map(len, bytes_b))), "alignment-links")
    counts = stash(pair_counts(lists, found), "alignment-pairs")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = lists.join(group_values(found, counts), "key").drop("key").repartition(parts, "block")
    each = dealt.select("block", *SUMS, F.explode(F.arrays_zip("docs", "times")).alias("_at"))
    summed = each.groupBy("block", F.col("_at.docs").alias("doc")).agg(*[F.sum(F.col(c) * F.col("_at.times")).alias(c) for c in SUMS])
    documents = encoded.filter(F.col("key").isNull()).select("block", "doc", *DOC_COLUMNS)
    out = documents.join(summed, ["block", "doc"], "left").select(F.col("doc_id").alias(id_col), *DOC_COLUMNS[1:], *[F.coalesce(c, F.lit(0)).alias(c) for c in SUMS])
    return out, counts


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under a byte-level and a piece vocabulary."""
    return align(read(spark, sf_dir, "documents"))[0].select("doc_id", "n_a", "n_b", "n_groups", *SUMS, "groups_sha256")
