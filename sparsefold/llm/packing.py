"""Lexical retrieval packing: windows of at most `window` tokens, filled with lexically near documents.

A document's tokens are cut into full windows, which are sequences of their own, and a rest. The rests are put in order of
content and cut into shards of `shard_pieces`, each with its own BM25 inverted index over token numbers; document
frequencies and the mean length are those of all rests of the corpus. In a shard, a seed asks the index for its nearest
unused neighbours, which fill the seed's window in that order; the one that overflows is cut and what is left of it seeds
the next window, so only a shard's last window is padded.

The order of content is that of signatures: three tokens of a rest, each the least by a weighted hash of its own, in which
rarer tokens (later in the vocabulary, which is in order of frequency) weigh more. Two rests share a signature's token with
a probability equal to the weighted likeness of their tokens, so like rests lie side by side. Range buckets deal this order
to tasks, and a task cuts its sorted buckets into shards as they stream by; equal signatures follow a hash of the row, so
that neither a hot text nor a growing table makes a shard grow. A task has one bucket.

Tokens of a text are those of its runs between ASCII white space, joined: the tokenizer drops white space, never merges
across it, and its special strings hold none. Plain text is encoded by a second library with the same merges, which
fast_ranks() shows to be the same; what isn't plain goes to the tokenizer itself, run by run.

A shard is bounded (pieces have fewer than `window` tokens), and the vocabulary bounds the table of frequencies; the driver
holds that table, the buckets' bounds and three counts.

Edge cases: a null or empty text is the end token alone; null ids and repeated rows are packed like others; texts of any
length are cut into windows as they stream by; an empty table gives no rows. Columns other than id and text are not
carried.
"""

from __future__ import annotations

import json
import math
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsefold.llm.common import byte_of_char, range_buckets, read, stash

NAME = "op6_bm25_packing"

TOKENIZER = "word_bpe_49k.json"
WINDOW = 4096
END = 2
SHARD_PIECES = 2000
#: Shards that a bucket of the order of content is cut into, some.
SHARDS_PER_BUCKET = 4
#: Fixed values of BM25.
K1, B = 1.2, 0.75
#: Texts that are encoded at a time, and characters of a text.
BLOCK, CHUNK = 256, 1 << 20
#: Characters below this one are composed and lower alike in all libraries.
PLAIN_BELOW = "\u0300"
#: A character that stands for a word's end, and what a special string starts with.
END_MARK, SPECIAL = "\x01", "<|"


def _class(kind: str) -> str:
    """A character class of the plain characters of a Unicode category."""
    return "".join(re.escape(c) for c in map(chr, range(ord(PLAIN_BELOW))) if unicodedata.category(c)[0] == kind)


#: Fixed value: the tokenizer's pre-tokens, for plain text in lower case, and the same for ASCII.
LETTERS, NUMBERS, BLANKS = _class("L"), _class("N"), r"\t-\r \x85\xa0"
PRE_TOKEN = re.compile(rf"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")
FURTHER = re.compile(f"[^\\x00-{chr(ord(PLAIN_BELOW) - 1)}]")
CUT_AFTER = re.compile(r"[\t-\r ]")
ASCII_PRE_TOKEN = re.compile(r"[a-z]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\t-\r a-z0-9]+")


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str, ranks: dict[bytes, int]) -> Encoder:
    """A worker's encoder, which outlives its tasks."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path, ranks)
    return _encoders[path]


def fast_ranks(path: str) -> dict[bytes, int]:
    """Numbers of the vocabulary's tokens for a library that takes a tenth of the time, with END_MARK for the end of a word.

    That library merges any two neighbours that make up a token, the first token in the order of numbers first. This comes to
    the same as the vocabulary's list of pairs if numbers are in the order of that list and every token, encoded
    alone, gives itself: two neighbours that cover just a token's text are then a state on the only way to it, so its last
    step is the pair of the list. Tokens that don't give themselves never arise, and are left out.
    """
    from tokenizers import Tokenizer, models

    model = json.loads(Path(path).read_text())["model"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
    first = 2 * 256
    if suffix != "</w>" or any(vocabulary.get(a + b) != first + i for i, (a, b) in enumerate(pairs)):
        raise ValueError("the vocabulary's numbers are not in the order of its merges")
    if max(vocabulary.values()) >= 1 << 16:
        raise ValueError("token numbers must fit into 16 bits")
    whole, inner = Tokenizer(models.BPE(vocabulary, pairs, end_of_word_suffix=suffix)), Tokenizer(models.BPE(vocabulary, pairs))
    chars = byte_of_char()
    ranks, last = {}, [p for p in vocabulary if p.endswith(suffix)]
    for lib, pieces, texts in ((whole, last, [p.removesuffix(suffix) for p in last]), (inner, rest := [p for p in vocabulary if not p.endswith(suffix)], rest)):
        for piece, text, found in zip(pieces, texts, lib.encode_batch(texts), strict=True):
            if found.ids == [vocabulary[piece]] and all(c in chars for c in text):
                ranks[bytes(chars[c] for c in text) + (END_MARK.encode() if lib is whole else b"")] = vocabulary[piece]
    return ranks


def packed(ids: list[int]) -> bytes:
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Token numbers of texts, packed as little-endian 16-bit numbers.

    A text of plain characters is lowered, which the tokenizer does itself, cut into pre-tokens, and encoded in one call. Runs
    between ASCII white space of other texts are judged one by one: those with special strings or further characters go to
    the library. Nothing is remembered: encoding a word again costs no more than looking it up among all others.
    """

    def __init__(self, path: str, ranks: dict[bytes, int] | None = None):
        """ranks: fast_ranks(path), which the driver has found for all workers."""
        import tiktoken

        self.path = path
        self.merges = tiktoken.Encoding("words", pat_str=f"[^{END_MARK}]+{END_MARK}", mergeable_ranks=ranks or fast_ranks(path), special_tokens={})

    @cached_property
    def library(self):
        """The tokenizer itself, loaded when a text first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def plain(self, text: str) -> bytes | None:
        """The tokens of a text of plain characters; None if it isn't one."""
        low = text.lower()
        if END_MARK in low or SPECIAL in low:
            return None
        if low.isascii():
            words = ASCII_PRE_TOKEN.findall(low)
        elif not FURTHER.search(low):
            words = PRE_TOKEN.findall(low)
        else:
            return None
        words.append("")  # for the mark at the end
        return packed(self.merges.encode_ordinary(END_MARK.join(words)))

    def mixed(self, text: str) -> Iterator[bytes]:
        """The tokens of a text with other characters, in pieces: neighbouring plain runs together."""
        held: list[str] = []
        for run in re.split(r"[\t-\r ]+", text):
            if not run or self.is_plain(run):
                held.append(run)
            else:
                yield self.plain(" ".join(held)) or b""
                held = []
                yield packed(self.library.encode(run, add_special_tokens=False).ids)
        yield self.plain(" ".join(held)) or b""

    @staticmethod
    def is_plain(run: str) -> bool:
        return not FURTHER.search(run.lower()) and END_MARK not in run and SPECIAL not in run

    def encode(self, text: str | None) -> bytes:
        out, at = [], 0
        text = text or ""
        while at < len(text):
            cut = CUT_AFTER.search(text, at + CHUNK)
            end = cut.end() if cut else len(text)
            part = text[at:end]
            found = self.plain(part)
            out += self.mixed(part) if found is None else [found]
            at = end
        return b"".join(out)

    def encode_all(self, texts: list[bytes | None]) -> list[bytes]:
        return [self.encode(t.decode()) if t else b"" for t in texts]


def checksum(ids: np.ndarray) -> int:
    """CRC-32 of token numbers as little-endian 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of a short list and how often each comes, as 16-bit numbers."""
    ordered = np.sort(ids)
    ends = np.append(np.flatnonzero(ordered[1:] != ordered[:-1]), len(ids) - 1)
    return ordered[ends], np.diff(ends, prepend=-1).astype("<u2")


#: Tokens of a signature.
SIGNATURE = 3


@lru_cache(maxsize=1)
def _ranks() -> np.ndarray:
    """Per hash of a signature the places of all token numbers: exponential races, in which rarer tokens run faster."""
    weights = np.log1p(np.arange(1 << 16)) + 1e-9
    times = -np.log(np.random.default_rng(20240229).random((SIGNATURE, 1 << 16))) / weights
    return times.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable").astype(np.uint16)


def signature(terms: np.ndarray) -> int:
    """The first of a rest's tokens in each of the races, as one number of 48 bits."""
    first = _ranks()[:, terms].min(axis=1).tolist()
    return first[0] << 32 | first[1] << 16 | first[2]


PIECE_SCHEMA = "doc_id bigint, row bigint, start bigint, length bigint, doc_tokens bigint, crc bigint, place bigint, ids binary, terms binary, times binary"
PIECE_TYPES = [pa.int64()] * 7 + [pa.binary()] * 3


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """The windows and the rest of each document.

    ids holds the tokens of a rest, terms its distinct ones and times how often each comes (16 bits each); all three are
    null for a full window. place is a rest's signature; full windows have their checksums instead, which spread them.
    """
    ranks = fast_ranks(tokenizer)

    def run(batches):
        encoder, tail = encoder_of(tokenizer, ranks), np.array([end], "<u2").tobytes()
        for batch in batches:
            out, held = [], 0
            documents = (d for at in range(0, batch.num_rows, BLOCK) for d in _encoded(batch.slice(at, BLOCK), encoder))
            for doc, row, packed in documents:
                ids = np.frombuffer(packed + tail, "<u2")
                n = len(ids)
                for start in range(0, n, window):
                    part = ids[start : start + window]
                    if len(part) == window:
                        crc = checksum(part)
                        out.append((doc, row, start, window, n, crc, crc << 16, None, None, None))
                        continue
                    terms, times = distinct(part)
                    out.append((doc, row, start, len(part), n, checksum(part), signature(terms), part.tobytes(), terms.tobytes(), times.tobytes()))
                    held += 4 * len(part)
                if held > 1 << 24:
                    yield _batch(out, PIECE_TYPES, PIECE_SCHEMA)
                    out, held = [], 0
            yield _batch(out, PIECE_TYPES, PIECE_SCHEMA)

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, PIECE_SCHEMA)


def _encoded(batch: pa.RecordBatch, encoder: Encoder) -> Iterator[tuple]:
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoder.encode_all(batch.column(2).cast(pa.binary()).to_pylist()), strict=True)


def _batch(rows: list[tuple], types: list[pa.DataType], schema: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in schema.split(", ")])


def frequencies(rests: DataFrame) -> DataFrame:
    """term, df: in how many rests a token number is found."""

    def run(batches):
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            packed = b"".join(batch.column(0).to_pylist())
            counts += np.bincount(np.frombuffer(packed, "<u2"), minlength=1 << 16)
        terms = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts[terms])], ["term", "df"])

    return rests.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


@dataclass
class Index:
    """A shard's inverted index: per term the pieces that have it, with their BM25 weights."""

    starts: np.ndarray
    owners: np.ndarray
    weights: np.ndarray
    terms: list[np.ndarray]

    @cached_property
    def postings(self) -> np.ndarray:
        """Owners and weights as one array of pairs, so that a list is one slice."""
        return self.owners + 1j * self.weights

    @classmethod
    def build(cls, sizes: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, mean: float) -> Index:
        """sizes: the pieces' lengths; found: their distinct terms and how often each comes."""
        terms = np.concatenate([t for t, _ in found]).astype(np.int64)
        owners = np.repeat(np.arange(len(found)), [len(t) for t, _ in found])
        tf = np.concatenate([c for _, c in found]).astype(float)
        size = sizes.astype(float)[owners]
        weights = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
        useful = idf[terms] > 0
        terms, owners, weights = terms[useful], owners[useful], weights[useful]
        order = np.argsort(terms, kind="stable")
        starts = np.searchsorted(terms[order], np.arange(len(idf) + 1))
        return cls(starts, owners[order], weights[order], [t[idf[t] > 0].astype(np.int64) for t, _ in found])

    def without_used(self, unused: np.ndarray) -> Index:
        """The index of the unused pieces alone."""
        kept = unused[self.owners]
        before = np.concatenate(([0], np.cumsum(kept)))
        return Index(before[self.starts], self.owners[kept], self.weights[kept], self.terms)

    def scores(self, seed: int, pieces: int) -> np.ndarray:
        """The BM25 scores of all pieces for the seed's terms."""
        terms = self.terms[seed]
        if not len(terms):
            return np.zeros(pieces)
        found = np.concatenate([self.postings[a:b] for a, b in zip(self.starts[terms].tolist(), self.starts[terms + 1].tolist(), strict=True)])
        return np.bincount(found.real.astype(np.int64), found.imag, pieces)

    def neighbours(self, seed: int, unused: np.ndarray, first: int | None = None) -> np.ndarray:
        """The unused pieces by BM25 score for the seed's terms, best first; the first ones and those that tie with them."""
        scores, among = self.scores(seed, len(unused)), np.flatnonzero(unused)
        found = scores[among]
        if first is not None and first < len(found):
            kept = found >= np.partition(found, len(found) - first)[len(found) - first]
            among, found = among[kept], found[kept]
        return among[np.argsort(-found, kind="stable")]


#: Neighbours that a window is filled from before all others are put in order.
FIRST = 48


def _in_turn(index: Index, seed: int, unused: np.ndarray) -> Iterator[int]:
    """neighbours() one by one; what comes first is used up by then."""
    yield from index.neighbours(seed, unused, FIRST).tolist()
    yield from index.neighbours(seed, unused).tolist()


def fill(sizes: np.ndarray, index: Index, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(sequence, piece, from, length, offset) for each part of each piece: windows filled greedily around seeds.

    A seed is what is left of the piece that was cut last, else the longest unused piece.
    """
    unused = np.ones(len(sizes), bool)
    by_size = np.argsort(-sizes, kind="stable").tolist()
    sequence, next_seed, rest, left = 0, 0, None, len(sizes)
    while True:
        if 2 * np.count_nonzero(unused) < left:  # lists shrink as pieces are used up
            index, left = index.without_used(unused), np.count_nonzero(unused)
        if rest is None:
            while next_seed < len(by_size) and not unused[by_size[next_seed]]:
                next_seed += 1
            if next_seed == len(by_size):
                return
            rest = (by_size[next_seed], 0)
        seed, done = rest
        unused[seed], rest = False, None
        offset = int(sizes[seed]) - done
        yield sequence, seed, done, offset, 0
        for piece in _in_turn(index, seed, unused) if offset < window else ():
            take = min(int(sizes[piece]), window - offset)
            yield sequence, piece, 0, take, offset
            unused[piece], offset = False, offset + take
            if take < sizes[piece]:
                rest = (piece, take)
            if offset == window:
                break
        sequence += 1


OUT_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
OUT_TYPES = [pa.int64()] * 7


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, end: int = END, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Shards have 2^15 pieces at most."""
    if not 0 < shard_pieces <= 1 << 15:
        raise ValueError("a shard has 1 to 32768 pieces")
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    cut = stash(pieces(df, id_col, text_col, tokenizer, window, end), "packing-pieces")
    rests = cut.filter(F.col("ids").isNotNull())
    total = cut.agg(F.count("ids").alias("n"), F.sum(F.when(F.col("ids").isNotNull(), F.col("length"))).alias("tokens")).first()
    n, mean = total["n"], (total["tokens"] or 1) / max(1, total["n"])
    idf = np.zeros(1 << 16)
    for term, df_ in frequencies(rests).collect():  # a row per token number of the vocabulary at most
        idf[term] = max(0.0, math.log((n - df_ + 0.5) / (df_ + 0.5)))

    def shard(rows: list[dict], base: int) -> pa.RecordBatch:
        out, whole, open_ = [], [r for r in rows if r["ids"] is None], [r for r in rows if r["ids"] is not None]
        for number, r in enumerate(whole):
            out.append((r["doc_id"], r["start"], r["length"], r["crc"], r["doc_tokens"], base + (1 << 15) + number, 0))
        if open_:
            ids = [np.frombuffer(r["ids"], "<u2") for r in open_]
            sizes = np.array([len(x) for x in ids])
            index = Index.build(sizes, [(np.frombuffer(r["terms"], "<u2"), np.frombuffer(r["times"], "<u2")) for r in open_], idf, mean)
            for number, piece, at, length, offset in fill(sizes, index, window):
                r = open_[piece]
                crc = r["crc"] if length == r["length"] else checksum(ids[piece][at : at + length])
                out.append((r["doc_id"], r["start"] + at, length, crc, r["doc_tokens"], base + number, offset))
        return _batch(out, OUT_TYPES, OUT_SCHEMA)

    def run(batches):
        """Shards of a partition's buckets, which come one after the other, each in order."""
        held, bucket, number = [], None, 0
        for batch in batches:
            columns = batch.schema.names
            for r in (dict(zip(columns, values, strict=True)) for values in zip(*map(pa.Array.to_pylist, batch.columns), strict=True)):
                if r["bucket"] != bucket or len(held) == shard_pieces:
                    if held:
                        yield shard(held, bucket << 40 | number << 16)
                    held, bucket, number = [], r["bucket"], number + 1 if r["bucket"] == bucket else 0
                held.append(r)
        if held:
            yield shard(held, bucket << 40 | number << 16)

    keys = [F.col("place"), F.xxhash64("row", "start")]
    buckets = range_buckets(cut, keys, SHARDS_PER_BUCKET * shard_pieces)
    dealt = cut.withColumn("bucket", buckets.bucket(keys).cast("bigint")).withColumn("tie", keys[1])
    ordered = dealt.repartitionById(max(1, len(buckets)), F.col("bucket").cast("int")).sortWithinPartitions("bucket", "place", "tie", "row", "start")
    return ordered.drop("place", "tie", "row").mapInArrow(run, OUT_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack(read(spark, sf_dir, "documents"))
