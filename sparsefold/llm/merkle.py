"""Merkle manifest of a dataset: mountain-range stacks per indexed partition, merged where their edges are not aligned.

A leaf is the hash of a row's fields, each with its length in front (a dash for a null). The leaves of a group (a
language) stand in the order of their keys; every `fanout` consecutive nodes of a level become the hash of their joined
digests, a last run may be shorter and is not padded, until one node is left, the group's root. The groups' roots, in the
order of the groups' names, are the leaves of one more tree, whose root stands for the dataset.

Rows are dealt to buckets of contiguous keys, of any sizes, so a bucket's first leaf may have any index in its group. A
bucket pushes its leaves on a stack with a list of open nodes per level. A node that ends its run carries: if the whole run
is on the stack, the parent is hashed and pushed one level up, as in counting with base `fanout`. A run that began before
the bucket stays open, as do the peaks at its right end; both are some fanout * log(n) nodes a bucket. Merging pushes the open nodes
of MERGE neighbouring buckets on one stack of the same kind, and so on until a single stack has seen all buckets. The node
records that the stacks emit are the manifest. A path needs nodes outside its bucket only along the bucket's two edges, and
those are all open or merged nodes, so paths are one join of a few records a bucket and one pass over the leaves.

Edge cases: null fields are hashed as a dash; rows with a null group form a group, which comes first; null keys come last in
their group; rows of one key are ordered by their leaves, and equal rows are leaves of their own; a table of one row has
a path without siblings; an empty table has no root and gives no rows. Columns that are not fields are neither hashed nor
carried, so their names cannot clash. Texts are hashed where they are read and are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparsefold.llm.common import bucket_target, range_buckets, read, stash

NAME = "op11_merkle_manifest"

FANOUT = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves in a bucket, which a task holds with their nodes while it writes their paths.
BUCKET_LEAVES = 50_000
#: Buckets whose open nodes meet on one stack in a round of merging.
MERGE = 64


def row_hash(values: list[Column]) -> Column:
    """The leaf of a row: SHA-256 of its fields, each as byte count, colon and value, or a dash for a null."""

    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, values)), 256)


def joined_hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def level_sizes(n: int, fanout: int) -> list[int]:
    """Nodes per level over n leaves, down to one."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // fanout))
    return sizes


class Stack:
    """The mountain range over some consecutive leaves of a group of n.

    Nodes are pushed in the order of the leaves below them. open has, per level, the nodes whose run isn't complete here as
    (index, digest, own); own ones were hashed here. closed gets (level, index, digest) of own nodes that have a parent here.
    """

    def __init__(self, n: int, fanout: int = FANOUT):
        self.sizes, self.fanout = level_sizes(n, fanout), fanout
        self.open: list[list[tuple[int, str, bool]]] = [[] for _ in self.sizes]
        self.closed: list[tuple[int, int, str]] = []

    def push(self, level: int, index: int, digest: str) -> None:
        own = False
        while True:
            nodes = self.open[level]
            nodes.append((index, digest, own))
            first = index - index % self.fanout
            ends_run = index + 1 == min(first + self.fanout, self.sizes[level])
            if level + 1 == len(self.sizes) or not ends_run or len(nodes) <= index - first:
                return
            run = nodes[first - index - 1 :]
            if run[0][0] != first:
                return
            del nodes[first - index - 1 :]
            self.closed += [(level, i, d) for i, d, mine in run if mine]
            level, index, digest, own = level + 1, index // self.fanout, joined_hash([d for _, d, _ in run]), True

    def take_closed(self) -> list[tuple[int, int, str]]:
        done, self.closed = self.closed, []
        return done


NODE_SCHEMA = "bucket bigint, grp string, n bigint, level int, idx bigint, digest string, open boolean, own boolean, top boolean"
NODE_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(NODE_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, NODE_TYPES, strict=True)], [f.split()[0] for f in NODE_SCHEMA.split(", ")])


def _records(stack: Stack, bucket: int, grp: str | None, ended: bool) -> list[tuple]:
    """Records of what a stack has closed, and, at its end, of what it leaves open."""
    n, top = stack.sizes[0], len(stack.sizes) - 1
    out = [(bucket, grp, n, level, i, d, False, True, False) for level, i, d in stack.take_closed()]
    if ended:
        out += [(bucket, grp, n, level, i, d, True, mine, level == top) for level, nodes in enumerate(stack.open) for i, d, mine in nodes]
    return out


def _stacked(fanout: int):
    """mapInArrow over rows in order of (bucket, grp, leaf): the records of a stack for each bucket and group.

    A row without a level starts a stack whose leaves are numbered from idx; other rows are pushed, with an index of their
    own or the next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, stack, key, at = [], None, None, 0
        for batch in batches:
            for bucket, grp, n, level, idx, digest in zip(*(batch.column(c).to_pylist() for c in ("bucket", "grp", "n", "level", "idx", "digest")), strict=True):
                if key != (bucket, grp):
                    out += _records(stack, *key, True) if stack else []
                    stack, key = Stack(n, fanout), (bucket, grp)
                if level is None:
                    at = idx
                elif idx is None:
                    stack.push(0, at, digest)
                    at += 1
                else:
                    stack.push(level, idx, digest)
            out += _records(stack, *key, False) if stack else []
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        yield _batch(out + (_records(stack, *key, True) if stack else []))

    return run


@dataclass(frozen=True)
class Tree:
    """leaves: the given columns, bucket and the order's columns; runs: bucket, grp, start, n, size; nodes: all node records
    above the leaves, and open leaves; roots: grp, n, digest."""

    leaves: DataFrame
    order: tuple[str, ...]
    runs: DataFrame
    nodes: DataFrame
    roots: DataFrame
    fanout: int


def _dealt(df: DataFrame, sort: list[str]) -> DataFrame:
    """Whole buckets in partitions of like numbers of them, sorted."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions(*sort)


def build(leaves: DataFrame, keys: list[Column], exact: tuple[str, ...], fanout: int = FANOUT, bucket_leaves: int = BUCKET_LEAVES, merge: int = MERGE) -> Tree:
    """The trees over leaves, which has grp and digest.

    keys are non-null BIGINTs that deal leaves to buckets; exact names the columns by which a group's leaves are ordered in a
    bucket, where keys are equal too. keys follow grp, in any order of the groups, and then that order.
    """
    spark = leaves.sparkSession
    leaves = stash(leaves.withColumn("_rid", F.monotonically_increasing_id()), "merkle-leaves")
    keys, exact = [*keys, F.col("_rid")], (*exact, "_rid")
    n = leaves.count()
    buckets = range_buckets(leaves, keys, bucket_target(spark, n, bucket_leaves))
    leaves = leaves.withColumn("bucket", buckets.bucket(keys).cast("bigint"))
    by_group = Window.partitionBy("grp")
    ahead = by_group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = leaves.groupBy("bucket", "grp").agg(F.count(F.lit(1)).alias("size"))
    runs = stash(sizes.select("bucket", "grp", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("start"), F.sum("size").over(by_group).alias("n"), "size"), "merkle-runs")
    heads = runs.select("bucket", "grp", "n", F.col("start").alias("idx"))
    rows = heads.unionByName(leaves.select(*dict.fromkeys(["bucket", "grp", "digest", *exact]), F.lit(0).alias("level")), allowMissingColumns=True)
    nodes = stash(_dealt(rows, ["bucket", "grp", F.col("level").asc_nulls_first(), *exact]).mapInArrow(_stacked(fanout), NODE_SCHEMA), "merkle-nodes")
    kept, left = [nodes], len(buckets)
    while left > 1:
        left = -(-left // merge)
        below = F.col("idx") * F.pow(F.lit(float(fanout)), F.col("level")).cast("bigint")
        rows = nodes.filter("open and not top").withColumn("bucket", F.expr(f"bucket div {merge}")).withColumn("_from", below)
        nodes = stash(_dealt(rows, ["bucket", "grp", "_from", "level"]).mapInArrow(_stacked(fanout), NODE_SCHEMA), "merkle-merged")
        kept.append(nodes)
    # what a stack leaves open comes again, closed or open, from no other stack: own records are distinct
    outer = kept[0]
    for merged in kept[1:]:
        outer = outer.unionByName(merged.filter("own"))
    roots = outer.filter("top").select("grp", "n", "digest")
    return Tree(leaves, exact, runs, outer, roots, fanout)


def edge_records(tree: Tree) -> DataFrame:
    """Per bucket and group: the records outside a bucket that paths from its leaves may need, some fanout * 2 log(n)."""
    f, p = tree.fanout, F.col("width")
    widths = F.array(*[F.lit(f**k).cast("bigint") for k in range(63) if f**k < 1 << 62])
    levels = tree.runs.select("bucket", "grp", "start", "n", "size", F.posexplode(F.filter(widths, lambda w: w < F.col("n"))).alias("level", "width"))
    over = lambda x: F.call_function("div", x, p)
    last = over(F.col("n") - 1)

    def run_of(leaf: Column) -> Column:
        first = over(leaf) - over(leaf) % f
        return F.sequence(first, F.least(first + (f - 1), last))

    wanted = levels.select("bucket", F.col("grp").alias("_g"), F.col("level").alias("_l"), F.explode(F.array_union(run_of(F.col("start")), run_of(F.col("start") + F.col("size") - 1))).alias("_i"))
    known = tree.nodes.filter("open or own").select("grp", "level", "idx", "digest")
    found = wanted.join(known, known.grp.eqNullSafe(wanted._g) & (known.level == wanted._l) & (known.idx == wanted._i))
    return found.groupBy("bucket", "grp").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("outer"))


HEAD = ("grp", "start", "n", "outer", "above", "subroot")
PATH_TYPE = "array<struct<before:string,after:string>>"


class Paths:
    """The paths of consecutive leaves: what stands before and after a node in its run, level by level."""

    def __init__(self, n: int, fanout: int, nodes: dict[tuple[int, int], str]):
        self.sizes, self.fanout, self.nodes = level_sizes(n, fanout)[:-1], fanout, nodes
        self.at = [-1] * len(self.sizes)
        self.before, self.after = [""] * len(self.sizes), [""] * len(self.sizes)

    def move(self, leaf: int) -> None:
        index = leaf
        for level, size in enumerate(self.sizes):
            if self.at[level] == index:
                return  # so are all the levels above
            first = index - index % self.fanout
            self.at[level] = index
            self.before[level] = "".join(self.nodes[level, i] for i in range(first, index))
            self.after[level] = "".join(self.nodes[level, i] for i in range(index + 1, min(first + self.fanout, size)))
            index //= self.fanout


def paths(tree: Tree, carry: list[str], above: DataFrame | None = None) -> DataFrame:
    """Per leaf: the columns carry, grp, digest, idx, and path, which above (grp, path, subroot) continues; and subroot.

    Each path has an entry per level with the joined digests that stand before and after the leaf's own node in its run.
    """
    spark, fanout = tree.leaves.sparkSession, tree.fanout
    edges = edge_records(tree).select(F.col("bucket").alias("_b"), F.col("grp").alias("_g"), "outer")
    heads = tree.runs.join(edges, (F.col("bucket") == F.col("_b")) & F.col("grp").eqNullSafe(F.col("_g")), "left").drop("_b", "_g")
    if above is not None:
        heads = heads.join(above.select(F.col("grp").alias("_g"), F.col("path").alias("above"), "subroot"), F.col("grp").eqNullSafe(F.col("_g"))).drop("_g")
    rows = heads.withColumn("head", F.lit(True)).unionByName(tree.leaves.select(*dict.fromkeys(["bucket", "grp", "digest", *tree.order, *carry]), F.lit(False).alias("head")), allowMissingColumns=True)
    kinds = dict(rows.select(*carry).dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in carry) + f"grp string, digest string, idx bigint, path {PATH_TYPE}, subroot string"
    carried = list(carry)

    def emit(head: dict, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        start, stack = head["start"], Stack(head["n"], fanout)
        nodes = {(x["level"], x["idx"]): x["digest"] for x in head["outer"] or ()}
        for i, row in enumerate(held):
            stack.push(0, start + i, row[0])
            nodes[0, start + i] = row[0]
        nodes |= {(level, i): d for level, i, d in stack.take_closed()} | {(level, i): d for level, some in enumerate(stack.open) for i, d, _ in some}
        walk, above_path = Paths(head["n"], fanout, nodes), head.get("above") or []
        tail_before, tail_after = [p["before"] for p in above_path], [p["after"] for p in above_path]
        for at in range(0, len(held), 2000):
            some = held[at : at + 2000]
            before, after, depth = [], [], len(walk.sizes) + len(above_path)
            for i in range(len(some)):
                walk.move(start + at + i)
                before += walk.before
                before += tail_before
                after += walk.after
                after += tail_after
            entries = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
            path = pa.ListArray.from_arrays(pa.array(range(0, depth * len(some) + 1, depth) if depth else [0] * (len(some) + 1), pa.int32()), entries)
            columns = list(zip(*some, strict=True))
            own = [pa.array(c) if len(c) and any(x is not None for x in c) else None for c in columns[1:]]
            yield columns[0], own, pa.array(range(start + at, start + at + len(some)), pa.int64()), path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held, types = None, [], None

        def finished():
            for digests, own, idx, path in emit(head, held) if head else ():
                size = len(digests)
                grp, subroot = (pa.array([head[c]] * size, pa.string()) for c in ("grp", "subroot"))
                columns = [pa.nulls(size, t) if c is None else c.cast(t) for c, t in zip(own, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, grp, pa.array(digests, pa.string()), idx, path, subroot], [*carried, "grp", "digest", "idx", "path", "subroot"])

        for batch in batches:
            types = [batch.schema.field(c).type for c in carried]
            heads = [batch.column(c).to_pylist() if c in batch.schema.names else [None] * batch.num_rows for c in HEAD]
            kept = [batch.column(c).to_pylist() for c in ("digest", *carried)]
            for i, is_head in enumerate(batch.column("head").to_pylist()):
                if is_head:
                    yield from finished()
                    head, held = dict(zip(HEAD, (h[i] for h in heads), strict=True)), []
                else:
                    held.append(tuple(k[i] for k in kept))
        yield from finished()

    return _dealt(rows, ["bucket", "grp", F.col("head").desc(), *tree.order]).mapInArrow(run, schema)


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level and left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda d, p: F.sha2(F.concat(p["before"], d, p["after"]), 256))


def grouped(leaves: DataFrame, id_col: str, fanout: int = FANOUT, bucket_leaves: int = BUCKET_LEAVES, merge: int = MERGE) -> Tree:
    """The tree of each group: leaves has grp, digest and a BIGINT column id_col, by which a group's leaves ascend."""
    value = F.col(id_col).cast("bigint")
    digits = F.conv(F.substring("digest", 1, 15), 16, 10).cast("bigint")
    keys = [F.xxhash64("grp"), value.isNull().cast("bigint"), F.coalesce(value, F.lit(0)), digits]
    ordered = leaves.withColumn("_null", value.isNull())
    return build(ordered, keys, ("_null", id_col, "digest"), fanout, bucket_leaves, merge)


def rooted(roots: DataFrame, fanout: int = FANOUT, bucket_leaves: int = BUCKET_LEAVES, merge: int = MERGE) -> Tree:
    """The tree over the groups' roots, in bytewise order of the groups' names (null first)."""
    name = F.coalesce(F.col("name"), F.lit(""))
    prefix = [F.coalesce(F.conv(F.hex(F.rpad(F.substring(name.cast("binary"), at, 7), F.lit(7), F.lit(b"\x00"))), 16, 10), F.lit("0")).cast("bigint") for at in (1, 8)]
    leaves = roots.select(F.col("grp").alias("name"), F.col("grp").isNotNull().alias("_named"), F.lit("").alias("grp"), "digest")
    return build(leaves, [F.col("_named").cast("bigint"), *prefix], ("_named", "name"), fanout, bucket_leaves, merge)


def manifest(
    df: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group_col: str = "lang",
    id_col: str = "doc_id",
    claimed: dict[str, Column] | None = None,
    fanout: int = FANOUT,
    bucket_leaves: int = BUCKET_LEAVES,
    merge: int = MERGE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, nodes, roots). leaves: id_col, claim, leaf, grp, idx, path, subroot and root, where claim is the leaf of the
    row with the values of claimed in place of its own. nodes: the node records of all groups. roots: of the groups."""
    changed = {c: (claimed or {}).get(c, F.col(c)) for c in fields}
    own = row_hash([F.col(c) for c in fields])
    claim = F.when(~_same([F.col(c) for c in claimed], list(claimed.values())), row_hash(list(changed.values()))) if claimed else F.lit(None).cast("string")
    leaves = df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(group_col).cast("string").alias("grp"), own.alias("digest"), claim.alias("claim"))
    tree = grouped(leaves, "_id", fanout, bucket_leaves, merge)
    top = rooted(tree.roots, fanout, bucket_leaves, merge)
    root = top.roots.first()  # one row, or none over an empty table
    above = stash(paths(top, ["name"]).select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "path"), "merkle-above")
    found = paths(tree, ["_id", "claim"], above).withColumn("root", F.lit(root["digest"] if root else None).cast("string"))
    return found.withColumnsRenamed({"_id": id_col, "digest": "leaf"}), tree.nodes, tree.roots


def _same(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & x.eqNullSafe(y)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents by language, with every leaf verified; where 7 divides the id's checksum, against a changed row."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claimed = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found, _, _ = manifest(read(spark, sf_dir, "documents"), claimed=claimed)
    folded = fold(F.coalesce("claim", "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = """
WITH RECURSIVE
fields AS (
  SELECT doc_id, lang, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
      lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, v: xor(xor(c, v) >> 1, 3988292384::UBIGINT * (xor(c, v) & 1::UBIGINT))) AS state
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN xor(state, 4294967295::UBIGINT) % 7 = 0
      THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS claim
  FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, n, idx, leaf AS d FROM placed
  UNION ALL
  SELECT lang, level + 1, (n + 1) // 2, idx // 2, sha256(string_agg(d, '' ORDER BY idx)) FROM nodes WHERE n > 1
  GROUP BY lang, level, n, idx // 2),
subroots AS (
  SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, n, idx, subroot AS d FROM subroots
  UNION ALL
  SELECT level + 1, (n + 1) // 2, idx // 2, sha256(string_agg(d, '' ORDER BY idx)) FROM tops WHERE n > 1
  GROUP BY level, n, idx // 2),
up AS (
  SELECT doc_id, lang, leaf, 0 AS level, n, idx, '' AS proof, coalesce(claim, leaf) AS fold FROM placed
  UNION ALL
  SELECT u.doc_id, u.lang, u.leaf, u.level + 1, (u.n + 1) // 2, u.idx // 2, u.proof || coalesce(s.d, ''),
    sha256(CASE WHEN u.idx % 2 = 0 THEN u.fold || coalesce(s.d, '') ELSE s.d || u.fold END)
  FROM up u LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM u.lang AND s.level = u.level AND s.idx = xor(u.idx, 1)
  WHERE u.n > 1),
over AS (
  SELECT u.doc_id, u.leaf, r.subroot, 0 AS level, r.n, r.idx, u.proof, u.fold
  FROM up u JOIN subroots r ON r.lang IS NOT DISTINCT FROM u.lang WHERE u.n = 1
  UNION ALL
  SELECT u.doc_id, u.leaf, u.subroot, u.level + 1, (u.n + 1) // 2, u.idx // 2, u.proof || coalesce(s.d, ''),
    sha256(CASE WHEN u.idx % 2 = 0 THEN u.fold || coalesce(s.d, '') ELSE s.d || u.fold END)
  FROM over u LEFT JOIN tops s ON s.level = u.level AND s.idx = xor(u.idx, 1)
  WHERE u.n > 1)
SELECT o.doc_id, o.leaf, o.subroot, t.d AS root, sha256(o.proof) AS proof_sha256, o.fold AS folded_root, o.fold = t.d AS verified
FROM over o, (SELECT d FROM tops WHERE n = 1) t WHERE o.n = 1
"""
