"""Secret scan with multipart credential linking.

Some strings are reported wherever they stand: assignments to telling names, access keys and long hexadecimal runs (the base
kinds). Others say little alone, such as a user name, a mixed string or a host, but make a credential together. Those weak
candidates are parts with a role: identifier, secret or endpoint; base spans are parts too (access keys identify, the
others are secrets). A scope is what lies within REACH code points of a part in its paragraph, which ends at a blank line.
The interval join of parts with scopes decides which candidates are reported:

* an identifier with a secret in its scope,
* a secret with an identifier or an endpoint in its scope,
* an endpoint with an identifier and a secret in its scope.

The join needs no pairs: in the order of positions within a paragraph, a running maximum of ends and, backwards, a running
minimum of starts give the nearest part of each role on both sides. Candidates overlap no other part (base spans go first,
then the leftmost, then the longest), so the nearest part is one that stands beside the candidate. Texts are read once and
stay where they are; only parts move, keyed by row and paragraph, so that hot sources or copies share no key.

Edge cases: a null or empty text has no spans; texts of any length are scanned whole, and paragraphs of any length are joined
in sorted runs that spill; a null id is carried along; repeated rows have results of their own; parts of equal start are
ordered by kind; an empty table gives no rows. Columns other than id and text are not carried.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparsefold.llm.common import read, stash

NAME = "op12_credential_links"

#: Kinds in their order; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ASSIGN, ACCESS, HEX, IDENTIFIER, SECRET, ENDPOINT = range(6)
#: The role of each kind.
ROLES = (SECRET, IDENTIFIER, SECRET, IDENTIFIER, SECRET, ENDPOINT)
#: Code points between two parts of one credential at most.
REACH = 400

#: The patterns of the base kinds and their least lengths.
BASE_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
BASE_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
BASE_HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
#: What a text must hold, in lower case, for the first of them to match.
ASSIGN_WORDS = ("passw", "secret", "token", "api")

#: Weak candidates. Long runs hold all hexadecimal runs of the base kind, too.
LONG_RUN = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
MIXED_LENGTH, MIXED_BITS = 32, 3.5
#: Names before a colon or an equals sign, which give what follows a role; looked for within LOOK_BACK code points.
NAMES = re.compile(
    r"""(?<![a-z])(?:((?:pass(?:phrase)?|pwd|(?:secret|private|account|shared)?_?key|auth|credentials?|signature))"""
    r"""|(user(?:_?(?:name|id))?|login|account(?:_?(?:name|id))?|client_?id|access_?key(?:_?id)?|app_?id|tenant(?:_?id)?)"""
    r"""|(host(?:_?name)?|server|endpoint|(?:base_?)?url|database|bucket))["']?\x20*\Z""",
    re.I | re.A,
)
NAMED_KINDS, LOOK_BACK = (SECRET, IDENTIFIER, ENDPOINT), 40
NAMED_VALUE = re.compile(r"""\x20*["']?([^\s"',;]{3,})""")
NAMED_LENGTH = {SECRET: 6, IDENTIFIER: 3, ENDPOINT: 4}
TEMPORARY_KEY = re.compile(r"(?<![A-Z0-9])(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}")
URL = re.compile(r"""[a-z][a-z0-9+.-]{1,15}://(?:([^\s:/@"'<>]+):([^\s/@"'<>]+)@)?([^\s"'<>]+)""")
HOST = re.compile(r"(?<![\w.@-])(?:[a-z0-9-]+\.){1,8}(?:com|net|org|io|dev|cloud|internal|local)(?::\d{2,5})?(?![\w-])", re.A)
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str, runs: list[re.Match]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in that order. runs: the text's long runs."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), ASSIGN, m.end()) for m in BASE_ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), ACCESS, m.end()) for m in BASE_ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    for run in runs:
        found += [(m.start(), HEX, m.end()) for m in BASE_HEX.finditer(text, *run.span())]
    return sorted(found)


def named(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of values that are assigned to names which give them a role."""
    found = []
    for sign in ":=":
        at = text.find(sign)
        while at >= 0:
            name = NAMES.search(text[max(0, at - LOOK_BACK) : at])
            value = NAMED_VALUE.match(text, at + 1) if name else None
            if value:
                kind = NAMED_KINDS[name.lastindex - 1]
                if value.end(1) - value.start(1) >= NAMED_LENGTH[kind]:
                    found.append((value.start(1), kind, value.end(1)))
            at = text.find(sign, at + 1)
    return found


def is_mixed(run: str) -> bool:
    """Whether a run looks drawn at random: three classes of characters and some entropy."""
    if len(run) < MIXED_LENGTH or not (any(map(str.isdigit, run)) and any(map(str.isupper, run)) and any(map(str.islower, run))):
        return False
    return -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values()) >= MIXED_BITS


def candidates(text: str, runs: list[re.Match], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of weak candidates that overlap neither base spans nor each other; none without any secret."""
    weak = [(m.start(), SECRET, m.end()) for m in runs if is_mixed(m[0])] + named(text)
    for m in URL.finditer(text) if "://" in text else ():
        weak += [(m.start(1), IDENTIFIER, m.end(1)), (m.start(2), SECRET, m.end(2)), (m.start(3), ENDPOINT, m.end(3))] if m[1] else [(m.start(), ENDPOINT, m.end())]
    if not any(ROLES[kind] == SECRET for _, kind, _ in base + weak):
        return []  # every report needs one
    weak += [(m.start(), IDENTIFIER, m.end()) for m in TEMPORARY_KEY.finditer(text)] + [(m.start(), ENDPOINT, m.end()) for m in HOST.finditer(text)]
    out, last, ahead = [], 0, 0
    covered = []  # base spans, merged
    for start, _, end in base:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    for start, kind, end in sorted(weak, key=lambda x: (x[0], -x[2], x[1])):
        while ahead < len(covered) and covered[ahead][1] <= start:
            ahead += 1
        if start >= last and not (ahead < len(covered) and covered[ahead][0] < end):
            out.append((start, kind, end))
            last = end
    return out


def parts(text: str | None) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, paragraph) of all parts, in order."""
    if not text:
        return []
    runs = list(LONG_RUN.finditer(text))
    base = base_spans(text, runs)
    found = sorted(base + candidates(text, runs, base))
    out, paragraph = [], 0
    breaks = [m.start() for m in BLANK_LINE.finditer(text)] if found else []
    for start, kind, end in found:
        while paragraph < len(breaks) and breaks[paragraph] < start:
            paragraph += 1
        out.append((start, kind, end, paragraph))
    return out


PART = "start int, kind int, end int, paragraph int"


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id_col, row (its own number) and parts."""
    kind = df.select(F.col(id_col)).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PART.split(", ")]
        for batch in batches:
            found = [parts(t.as_py()) for t in batch.column(2)]
            offsets = [0]
            for x in found:
                offsets.append(offsets[-1] + len(x))
            columns = list(zip(*[p for x in found for p in x], strict=True)) or [[]] * 4
            entries = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)], [id_col, "row", "parts"])

    rows = df.select(F.col(id_col), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, row bigint, parts array<struct<{PART.replace(' ', ':').replace(',:', ',')}>>")


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """row, start, kind, end of the weak candidates that have complementary parts in their scopes.

    found: row, start, kind, end, paragraph of all parts.
    """
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("kind") + 1)
    here = Window.partitionBy("row", "paragraph")
    ahead = here.orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    behind = here.orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    near = {}
    for r in (IDENTIFIER, SECRET, ENDPOINT):
        left = F.max(F.when(F.col("role") == r, F.col("end"))).over(ahead)
        right = F.min(F.when(F.col("role") == r, F.col("start"))).over(behind)
        near[r] = F.coalesce(left >= F.col("start") - reach, F.lit(False)) | F.coalesce(right <= F.col("end") + reach, F.lit(False))
    kept = (
        F.when(F.col("kind") == IDENTIFIER, near[SECRET])
        .when(F.col("kind") == SECRET, near[IDENTIFIER] | near[ENDPOINT])
        .when(F.col("kind") == ENDPOINT, near[IDENTIFIER] & near[SECRET])
    )
    return found.withColumn("role", role).withColumn("_kept", kept).filter("_kept").select("row", "start", "kind", "end")


def span_text(spans: Column) -> Column:
    """kind:start:end by start, then kind; comma-joined. spans: an array of structs of start, kind, end."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def credential_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Per row: id_col, base and added, which are arrays of (start, kind, end)."""
    scanned = stash(scan(df, id_col, text_col), "credentials-parts")
    weak = F.exists("parts", lambda p: p["kind"] > HEX)
    found = scanned.filter(weak).select("row", F.inline("parts"))
    added = linked(found, reach).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    base = F.transform(F.filter("parts", lambda p: p["kind"] <= HEX), lambda p: F.struct(p["start"], p["kind"], p["end"]))
    base = base.cast("array<struct<start:int,kind:int,end:int>>")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return scanned.join(added, "row", "left").select(F.col(id_col), base.alias("base"), F.coalesce("added", none).alias("added"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents."""
    found = credential_links(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        count(ASSIGN).alias("n_assign"),
        count(ACCESS).alias("n_access"),
        count(HEX).alias("n_hex"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.concat("base", "added")).alias("spans"),
    )
