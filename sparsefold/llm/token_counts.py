"""Token counts with the whole-token shortcut.

A vocabulary of pieces with byte fallback merges symbols only into strings that are pieces. prove() shows offline, from
the vocabulary alone, (1) that no piece crosses from a character into a following space mark and none holds a line feed, so
a text falls into pre-tokens (a run of spaces with the characters up to the next space or line feed) whose counts add
up to the text's, and (2) which vocabulary strings encode alone as one token. Counting looks each pre-token up among the
proven whole tokens and runs the library's merges for the rest only; merged counts are remembered in a memo of bounded
size, which can only cost time when it is emptied. A vocabulary for which (1) fails is refused, not approximated.

Edge cases: a null text counts as empty: 0 bytes, 0 tokens; special strings inside texts are ordinary text, as in the
library's default; texts of any length are counted whole, line by line; a null id is carried along; repeated rows count
alike; an empty table gives no rows. Columns other than id and text are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsefold.llm.common import read

NAME = "op8_token_counts"

MODEL = "piece_bpe_32k.model"
MARK = "▁"
LIMIT = 4096
#: Merged pre-tokens that a worker remembers at most (beside the vocabulary).
MEMO = 200_000


@dataclass(frozen=True)
class Proof:
    """What holds for a vocabulary: the words (without their space mark) that encode alone as one token."""

    model: str
    whole: frozenset[str]


def _load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def prove(model: str) -> Proof:
    """Check the vocabulary and find its whole tokens; about a tenth of a second, once per query on the driver."""
    lib = _load(model)
    pieces = [(i, lib.id_to_piece(i)) for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
    for _, piece in pieces:
        body = piece.lstrip(MARK)
        if MARK in body or "\n" in piece:
            raise ValueError(f"piece {piece!r} crosses a pre-token boundary; this vocabulary can't be counted by pre-tokens")
    if lib.encode("a b") != lib.encode("a") + lib.encode("b") or len(lib.encode("\n")) != 2:
        raise ValueError("the model's normalizer isn't the plain one that is assumed here")
    return Proof(model, frozenset(p[1:] for i, p in pieces if p[:1] == MARK and len(p) > 1 and p[1] != MARK and lib.encode(p[1:]) == [i]))


class Counter(dict):
    """Tokens of a word that follows one space mark: 1 for the proven ones, merged by the library otherwise."""

    def __init__(self, proof: Proof):
        super().__init__(dict.fromkeys(proof.whole, 1))
        self.lib, self.proven = _load(proof.model), len(proof.whole)
        self[""] = 1  # the mark alone
        self.whole = proof.whole
        self.rest: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        n = len(self.lib.encode(word))
        if len(self) >= self.proven + MEMO:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
            self[""] = 1
        self[word] = n
        return n

    def unit(self, unit: str) -> int:
        """Tokens of a pre-token of another shape: no space mark in front, or several."""
        n = self.rest.get(unit)
        if n is None:
            if unit[0] != " ":  # the line feed keeps the library's own mark away from it
                n = len(self.lib.encode("\n" + unit)) - 2
            else:
                n = len(self.lib.encode(unit[1:])) if unit.strip(" ") else self.spaces(len(unit))
            if len(self.rest) >= MEMO:
                self.rest.clear()
            self.rest[unit] = n
        return n

    def spaces(self, k: int) -> int:
        """Tokens of a run of k space marks before a line feed or the end."""
        return len(self.lib.encode(" " * (k - 1) + "\n")) - 1

    def line(self, line: str, first: bool) -> int:
        """Tokens of a line without its line feed; the text's first line has the library's mark in front."""
        parts = line.split(" ")
        if first:
            if "" not in parts:
                return sum(map(self.__getitem__, parts))
            parts.insert(0, "")
        elif "" not in parts:
            return self.unit(parts[0]) + sum(map(self.__getitem__, parts[1:]))
        n, run = (self.unit(parts[0]) if parts[0] else 0), 0
        for part in parts[1:]:
            run += 1
            if part:
                n += self[part] if run == 1 else self.unit(" " * run + part)
                run = 0
        return n + (self.spaces(run) if run else 0)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if MARK in text:  # the library itself cannot tell its mark from a space
            text = text.replace(MARK, " ")
        lines = text.split("\n")
        return len(lines) - 1 + self.line(lines[0], True) + sum(self.line(x, False) for x in lines[1:] if x)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Per row: id, n_bytes, n_tokens. model is the file of a piece vocabulary."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(MODEL)
    proof = prove(model)
    kind = df.select(F.col(id_col)).dtypes[0][1]

    def run(batches):
        counter = Counter(proof)
        for batch in batches:
            texts = batch.column(1)
            counts = pa.array([counter.count(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], [id_col, "n_bytes", "n_tokens"])

    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("_bytes"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents."""
    return token_counts(read(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
