"""Quality rules as a short-circuit cascade, ordered by rejections per cost.

Each rule looks at one text and rejects it or not. On a hashed sample the cascade measures every rule's own cost (seconds),
the cost of the pieces that rules share (words, word numbers, lines), and which rules reject which texts together.
cascade() then picks rule after rule: the one with the most rejections per second among the texts that the rules before it
keep, at the cost of what they have not computed already; ties go to the cheaper rule and then by name. Rules run in that
order, each only on the texts that all rules before it kept. A text is rejected if any rule rejects it, so the order changes
the cost and never the verdict. The sample bounds what is measured, not what is judged: every text is judged whole.

Words are runs of bytes other than ASCII white space, which is how bytes.split() cuts. Repeated 8-word windows are
found exactly: word numbers are ranked by pairs of pairs of pairs, so equal ranks mean equal windows.

Edge cases: a null text has no words and fails the base rules, as does an empty one; a null id is carried along; repeated
rows are judged alike; an empty table gives no rows. Very long texts cost memory in proportion to their words. Other
columns pass through quality_filter() unchanged, whatever their names.
"""

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsefold.llm.common import read

NAME = "op2_quality_cascade"

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Fixed values of the base conditions.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
LETTERS = re.compile(rb"[A-Za-z\x80-\xff]")


class Text:
    """One text; what several rules use is computed once, when first asked for."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words: bytes that start one."""
        joined = b"".join(self.words)
        return len(joined) - int(np.count_nonzero(np.frombuffer(joined, np.uint8) & 0xC0 == 0x80))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.raw.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def numbers(self) -> np.ndarray:
        """Each word's number among the distinct words."""
        seen: dict[bytes, int] = {}
        return np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, len(self.words))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of 8 that are found twice or more, the first find included."""
        ranks, n = self.numbers, len(self.words)
        if n <= WINDOW:
            return 0
        for width in (1, 2, 4):
            pairs = ranks[:-width] * n + ranks[width:]
            order = np.argsort(pairs, kind="stable")
            new = np.empty(len(pairs), bool)
            new[:1], new[1:] = False, np.diff(pairs[order]) != 0
            if new.sum() == len(pairs) - 1:
                return 0  # no two are equal, so no two longer windows are
            ranks = np.empty(len(pairs), np.int64)
            ranks[order] = np.cumsum(new)
        hit = np.bincount(ranks)[ranks] > 1
        edge = np.zeros(n + 1, np.int64)
        starts = np.flatnonzero(hit)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + WINDOW, -1)
        return int(np.count_nonzero(np.cumsum(edge)[:n]))

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


#: Pieces of a text that rules share, each with the pieces that it is made of.
PIECES = {"words": (), "numbers": ("words",), "lines": ()}


@dataclass(frozen=True)
class Rule:
    """rejects(text) is True for a text that must go; needs names the shared pieces that it looks at."""

    name: str
    rejects: Callable[[Text], bool]
    needs: tuple[str, ...] = ("words",)


def _shouts(t: Text) -> bool:
    """Most words of two characters or more have letters, but none in lower case."""
    long = [w for w in t.words if len(w) > 1 and LETTERS.search(w)]
    return bool(long) and 2 * sum(1 for w in long if (s := w.decode()).upper() == s and s.lower() != s) > len(long)


def _stutters(t: Text) -> bool:
    """Over three tenths of the words equal the word before."""
    return t.n_words > 1 and 10 * int(np.count_nonzero(np.diff(t.numbers) == 0)) > 3 * t.n_words


def _wordless(t: Text) -> bool:
    """Over half the words have no letter."""
    return t.n_words > 0 and 2 * sum(1 for w in t.words if not LETTERS.search(w)) > t.n_words


RULES = (
    Rule("few_words", lambda t: t.n_words < MIN_WORDS),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("long_words", lambda t: t.word_chars > 200 * max(1, t.n_words)),
    Rule("repeated_lines", lambda t: len(t.lines) >= 4 and 2 * t.n_dup_lines > len(t.lines), ("lines",)),
    Rule("shouting", _shouts),
    Rule("stutter", _stutters, ("words", "numbers")),
    Rule("wordless", _wordless),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words, ("words", "numbers")),
)
#: Rules that are the base conditions themselves.
BASE_RULES = frozenset({"few_words", "repeated_windows"})


@dataclass(frozen=True)
class Sample:
    """Seconds per text of each rule, its pieces given, and of each piece; and how many texts each set of rules rejects."""

    rules: dict[str, float]
    pieces: dict[str, float]
    rejected: dict[frozenset[str], int]


def measure(df: DataFrame, text_col: str = "text", rules=RULES, sample_rows: int = 2000) -> Sample:
    """Costs and rejections on a hashed sample of about sample_rows rows.

    Executors return a row of sums per batch for each piece, rule and set of rules that reject a text together.
    """
    n = df.count()
    share = min(1.0, sample_rows / max(1, n))
    sample = df.select(F.col(text_col).alias("t"), F.monotonically_increasing_id().alias("i")).filter(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("t")

    def run(batches):
        for batch in batches:
            texts = [Text(t) for t in batch.column(0).to_pylist()]
            out, by_text = [], [[] for _ in texts]
            for piece in PIECES:
                began = time.perf_counter()
                for t in texts:
                    getattr(t, piece)
                out.append(("piece", piece, time.perf_counter() - began, len(texts)))
            for rule in rules:
                began = time.perf_counter()
                found = [rule.rejects(t) for t in texts]
                out.append(("rule", rule.name, time.perf_counter() - began, len(texts)))
                for names, hit in zip(by_text, found, strict=True):
                    if hit:
                        names.append(rule.name)
            sets = Counter("\n".join(names) for names in by_text)
            out += [("set", names, 0.0, times) for names, times in sets.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["kind", "name", "seconds", "n"])

    sums = sample.mapInArrow(run, "kind string, name string, seconds double, n bigint").groupBy("kind", "name").agg(F.sum("seconds").alias("s"), F.sum("n").alias("n")).collect() if n else []
    cost = lambda kind: {x["name"]: x["s"] / max(1, x["n"]) for x in sums if x["kind"] == kind}
    rejected = {frozenset(filter(None, x["name"].split("\n"))): x["n"] for x in sums if x["kind"] == "set"}
    return Sample({r.name: 0.0 for r in rules} | cost("rule"), dict.fromkeys(PIECES, 0.0) | cost("piece"), rejected)


def cascade(rules, sample: Sample):
    """The rules in the order in which they run: greedily by rejections among survivors per marginal cost."""
    left, done, ready = list(rules), [], set()
    survivors = dict(sample.rejected)
    while left:
        total = max(1, sum(survivors.values()))
        needed = {r.name: {q for p in r.needs for q in (p, *PIECES[p])} for r in left}
        marginal = {r.name: (sample.rules[r.name] + sum(sample.pieces[p] for p in needed[r.name] - ready), sum(n for names, n in survivors.items() if r.name in names) / total) for r in left}
        best = order(left, marginal)[0]
        left.remove(best)
        done.append(best)
        ready |= needed[best.name]
        survivors = {names: n for names, n in survivors.items() if best.name not in names}
    return tuple(done)


def order(rules, measured: dict[str, tuple[float, float]]):
    """The rules by rejections per second, most first; a rule that rejected nothing comes last, the cheapest first."""

    def rank(rule):
        cost, share = measured[rule.name]
        return (-share / max(cost, 1e-9), cost, rule.name)

    return tuple(sorted(rules, key=rank))


def verdict(text: Text, rules) -> str | None:
    """The name of the first rule that rejects the text; the rules after it do not run."""
    return next((r.name for r in rules if r.rejects(text)), None)


def quality_filter(df: DataFrame, text_col: str = "text", rules=RULES, sample_rows: int = 2000) -> DataFrame:
    """The rows of df that no rule rejects."""
    ordered = cascade(rules, measure(df, text_col, rules, sample_rows))

    @F.arrow_udf("boolean")
    def keep(texts: pa.Array) -> pa.Array:
        return pa.array([verdict(Text(t.as_py()), ordered) is None for t in texts], pa.bool_())

    return df.filter(keep(F.col(text_col)))


def quality_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, sample_rows: int = 2000) -> DataFrame:
    """Per row: id, the counts of the base conditions, base_failed and kept.

    The counts are owed for every row, so the base conditions are known before the cascade, which runs the other rules.
    """
    others = tuple(r for r in rules if r.name not in BASE_RULES)
    ordered = cascade(others, measure(df, text_col, others, sample_rows))
    kind = df.select(F.col(id_col).alias("doc_id"))
    schema = f"doc_id {kind.dtypes[0][1]}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64()] * 5 + [pa.bool_()] * 2

    def run(batches):
        for batch in batches:
            out = [[] for _ in types]
            for value in batch.column(1):
                t = Text(value.as_py())
                failed = t.base_failed
                row = (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, not failed and verdict(t, ordered) is None)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, types, strict=True)]], names)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over all documents."""
    return quality_report(read(spark, sf_dir, "documents"))


#: The report in SQL: each rule is a condition, and a text is kept if none holds.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
n AS (SELECT rid, doc_id, words, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM w),
k AS (SELECT rid, i, list_slice(words, i, i + 7) AS win FROM n, unnest(range(1, n_words - 6)) AS r(i) WHERE n_words > 8),
twice AS (SELECT rid, win FROM k GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT rid, count(*) AS n_repeat_words FROM (SELECT DISTINCT rid, unnest(range(i, i + 8)) AS p FROM k JOIN twice USING (rid, win)) GROUP BY 1),
s AS (SELECT n.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
        list_filter(words, lambda x: strlen(x) > 1 AND regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')) AS long,
        len(list_filter(words, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS no_letter,
        len(list_filter(list_zip(words[1:-2], words[2:]), lambda p: p[1] = p[2])) AS stutter FROM n LEFT JOIN rep USING (rid)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        10 * n_symbols > n_words OR word_chars > 200 * greatest(1, n_words) OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)
        OR 2 * len(list_filter(long, lambda x: upper(x) = x AND lower(x) <> x)) > len(long) OR 10 * stutter > 3 * n_words OR 2 * no_letter > n_words AS rejected FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM v
"""
