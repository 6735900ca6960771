"""Chat formatting with the cheapest repair of roles.

Legal conversations are an optional system message and then user and assistant messages in turn. Each turn either opens
a message under its own role or another (relabel), joins the message before it (merge), or is preceded by an empty message
that the automaton misses (insert). Dynamic programming over the automaton finds the cheapest way through a conversation,
and the repaired sequence is rendered.

The states' cost matrices of consecutive turns combine by min-plus products, which is associative. Turns are dealt to
buckets of contiguous (conversation, turn) order and numbered there, so a conversation of any length is cut into chunks of
chunk_turns at most: chunks are summed up into 4 x 4 matrices, the matrices of a conversation decide the state at each cut, and every chunk is then repaired
on its own between its fixed states. No task holds a conversation, only a chunk.

A row comes out for each turn. rendered holds the turn's part of the conversation's text: the parts in the order of seq,
joined, are the whole text, end markers included.

Edge cases: role names are trimmed, lowered and looked up in ALIASES; a null or unknown role costs UNKNOWN whichever way it
is read; a null text is empty; markers inside texts are broken up by a space; null turns come last; turns of one number are
ordered by a hash of role and text; repeated rows are turns of their own; rows without a conversation id form one
conversation; an empty table gives no rows. Columns other than the four named ones are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparsefold.llm.common import bucket_target, range_buckets, read, stash

NAME = "op9_role_repair"

#: Roles, other names for them, and the template.
ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"
#: Costs of the repairs.
RELABEL, UNKNOWN, MERGE, INSERT = 3, 1, 1, 2

START = 3
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
ENDS = (1, 2)
FAR = 1 << 40


def role_number(role: str | None) -> int:
    """0 to 2, or 3 for a role that isn't known."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else 3


@lru_cache(maxsize=8)
def steps(role: int) -> tuple[tuple[tuple[int, str, int | None], ...], ...]:
    """steps(role)[s][t]: cost, action and inserted role of the cheapest step from state s to t for a turn of this role.

    Ties go to keep, merge, relabel and then an insertion, in this order.
    """

    def named(t: int) -> int:
        return UNKNOWN if role == 3 else 0 if role == t else RELABEL

    table = []
    for s in range(4):
        row = []
        for t in range(4):
            options: list[tuple[int, int, str, int | None]] = []
            if t != START:
                kind = "keep" if named(t) == 0 else "relabel"
                if t in NEXT[s]:
                    options.append((named(t), 0 if kind == "keep" else 2, kind, None))
                options += [(named(t) + INSERT, 3, kind, y) for y in NEXT[s] if t in NEXT[y]]
                if s == t:
                    options.append((MERGE + named(t), 1, "merge", None))
            best = min(options, default=(FAR, 9, "", None), key=lambda o: o[:2])
            row.append((best[0], best[2], best[3]))
        table.append(tuple(row))
    return tuple(table)


def advance(costs: list[int], role: int) -> list[int]:
    table = steps(role)
    return [min(costs[s] + table[s][t][0] for s in range(4)) for t in range(4)]


def matrix(roles: list[int]) -> list[int]:
    """The 16 costs to get from each state to each other over some turns."""
    rows = [[0 if s == t else FAR for t in range(4)] for s in range(4)]
    for role in roles:
        rows = [advance(r, role) for r in rows]
    return [min(c, FAR) for r in rows for c in r]


def path(roles: list[int], entry: int, leave: int) -> list[int]:
    """The states after each turn on the cheapest way from entry to leave; ties go to the smaller state before."""
    costs, back = [0 if s == entry else FAR for s in range(4)], []
    for role in roles:
        table = steps(role)
        back.append([min(range(4), key=lambda s: (costs[s] + table[s][t][0], s)) for t in range(4)])  # noqa: B023
        costs = advance(costs, role)
    states = [leave]
    for row in reversed(back[1:]):
        states.append(row[states[-1]])
    return states[::-1]


def cuts(matrices: list[list[int]]) -> list[int]:
    """The states after each chunk of a conversation, from the chunks' matrices."""
    costs, back = [0 if s == START else FAR for s in range(4)], []
    for m in matrices:
        back.append([min(range(4), key=lambda s: (costs[s] + m[4 * s + t], s)) for t in range(4)])  # noqa: B023
        costs = [min(costs[s] + m[4 * s + t] for s in range(4)) for t in range(4)]
    states = [min(ENDS, key=lambda t: (costs[t], t))]
    for row in reversed(back[1:]):
        states.append(row[states[-1]])
    return states[::-1]


def render(texts: list[str | None], roles: list[int], entry: int, leave: int, closes: bool) -> Iterator[tuple[str, str, str | None, int, str]]:
    """(role, action, inserted role, cost, rendered part) of each turn of a chunk."""
    before = entry
    states = path(roles, entry, leave)
    for i, (text, role, state) in enumerate(zip(texts, roles, states, strict=True)):
        cost, action, inserted = steps(role)[before][state]
        body = (text or "").replace("<|", "< |")
        if action == "merge":
            out = "\n\n" + body
        else:
            out = (CLOSE if before != START else "") + (OPEN.format(ROLES[inserted]) + CLOSE if inserted is not None else "") + OPEN.format(ROLES[state]) + body
        if closes and i == len(texts) - 1:
            out += CLOSE
        yield ROLES[state], action, None if inserted is None else ROLES[inserted], cost, out
        before = state


def _groups(batches, keys: int) -> Iterator[list[tuple]]:
    """The rows of each run of equal values in the first keys columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch():
        columns = list(zip(*held, strict=True)) or [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held.clear()
    yield batch()


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rows_per_bucket: int = 20_000, chunk_turns: int = 5000) -> DataFrame:
    """Per turn: conv_id, seq, turn, role, new_role, action, inserted, cost, rendered."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = df.select(
        F.col(conv_col).isNull().cast("int").alias("_none"), F.coalesce(F.col(conv_col).cast("bigint"), F.lit(0)).alias("_conv"), F.col(turn_col).isNull().cast("bigint").alias("_k2"), F.coalesce(F.col(turn_col).cast("bigint"), F.lit(0)).alias("_k3"),
        F.xxhash64(F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))).alias("_k4"), F.monotonically_increasing_id().alias("_k5"), F.col(turn_col).cast("bigint").alias("_turn"), F.col(role_col).alias("_role"), F.col(text_col).alias("_text"),
    )
    rows = stash(rows, "chat-rows")  # numbered once: both passes read this table
    keys = [F.col("_none").cast("bigint"), *[F.col(c) for c in ("_conv", "_k2", "_k3", "_k4", "_k5")]]
    buckets = range_buckets(rows, keys, bucket_target(spark, max(1, rows.count()), rows_per_bucket))
    order = ["_none", "_conv", "_k2", "_k3", "_k4", "_k5"]
    group = ["_bucket", "_part", "_none", "_conv"]

    def dealt(df: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
        return df.withColumn("_bucket", buckets.bucket(keys)).withColumn("_part", F.floor(place / chunk_turns).cast("int"))

    def summed(batches):
        found = ((*g[0][:4], len(g), matrix([role_number(r[4]) for r in g])) for g in _groups(batches, 4))
        yield from _batches(found, [*group, "_n", "_matrix"], [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())])

    ordered = dealt(rows.select(*order, "_role")).repartition(parts, *group).sortWithinPartitions(*group, *order).select(*group, "_role")
    chunks = ordered.mapInArrow(summed, "_bucket int, _part int, _none int, _conv bigint, _n bigint, _matrix array<bigint>")

    def decided(batches):
        def found():
            for g in _groups(batches, 2):
                entry, seq = START, 0
                for i, ((none, conv, bucket, part, n, _), leave) in enumerate(zip(g, cuts([r[5] for r in g]), strict=True)):
                    yield bucket, part, none, conv, entry, leave, seq, i == len(g) - 1
                    entry, seq = leave, seq + n

        yield from _batches(found(), ["_b", "_p", "_nn", "_c", "_entry", "_leave", "_seq", "_last"], [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()])

    along = ["_none", "_conv", "_bucket", "_part"]
    by_conversation = chunks.repartition(parts, "_none", "_conv").sortWithinPartitions(*along).select(*along, "_n", "_matrix")
    fixed = stash(by_conversation.mapInArrow(decided, "_b int, _p int, _nn int, _c bigint, _entry int, _leave int, _seq bigint, _last boolean"), "chat-cuts")

    def repaired(batches):
        def found():
            for g in _groups(batches, 4):
                _, _, none, conv, entry, leave, seq, last = g[0][:8]
                parts_ = render([r[10] for r in g], [role_number(r[9]) for r in g], entry, leave, last)
                for i, (row, part) in enumerate(zip(g, parts_, strict=True)):
                    yield None if none else conv, seq + i, row[8], row[9], *part

        yield from _batches(found(), OUT_NAMES, OUT_TYPES, 500)

    same = [F.col(a) == F.col(b) for a, b in zip(group, ("_b", "_p", "_nn", "_c"), strict=True)]
    joined = dealt(rows).join(fixed, same)
    ready = joined.repartition(parts, *group).sortWithinPartitions(*group, *order).select(*group, "_entry", "_leave", "_seq", "_last", "_turn", "_role", "_text")
    return ready.mapInArrow(repaired, OUT_SCHEMA)


OUT_SCHEMA = "conv_id bigint, seq bigint, turn bigint, role string, new_role string, action string, inserted string, cost int, rendered string"
OUT_NAMES = [f.split()[0] for f in OUT_SCHEMA.split(", ")]
OUT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, turn by turn."""
    return repair(read(spark, sf_dir, "conversations"))
