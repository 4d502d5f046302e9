"""Prefix trie of conversations, built as a Patricia tree over their sorted sequences.

Each conversation is rebuilt from its own turns and the first turns of another one (`rebuild`), and becomes a key:
the chained 16-byte digests of its prefixes, one after the other. Sorted as bytes, keys that begin alike lie side by side, and
two neighbours share as many turns as leading digests. Equal keys are one sequence with a number of copies.

`build` range-sorts the distinct keys and runs over each partition once with a stack that holds branch, end and leaf points only.
A point whose members all lie inside the partition is closed there: its members, smallest member, children, leaves and saved
tokens are final. What may go on in a neighbouring partition, the points on the paths of a partition's first and last key, is handed on
as a short list of steps, and one task replays the steps of all partitions on a stack of the same kind (at most as many steps a
partition as its two border keys have points). The compressed edges are then expanded into their unary nodes: those share all numbers of
the point below but for the saved tokens, which grow by the edge's suffix sums.

A conversation's turns are in order of turn, nulls first; equal turns by a digest of role and text, so the order is defined, and a
repeated row is a turn of its own. A null role or text is the empty text. Rows without a conv_id belong to no conversation and make
no node. The remainder of a negative conv_id has its sign, as in SQL. A conversation with no turn left after it is rebuilt is a member of the root. An empty
table has no node, not even a root. Extra columns are not carried. Texts are reduced to digests and lengths where they lie,
before anything is shuffled; one task holds one conversation's digests (24 bytes a turn), however long its texts are.
Prefixes are told apart by 128 bits of SHA-256: two different ones among 10**12 are taken for one with a probability below 10**-14.
Members of one sequence are hashed in one task, as a hash over all of them must be, but streamed in order of conv_id and never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, join_unique, materialise, ship_package, slices

#: Bytes of one prefix's digest.
WIDTH = 16
ROOT = bytes(WIDTH)
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Conversations of one family, whose first one lends its turns; and the number of different loans.
FAMILY, LOANS = 100, 6


def rebuild(turns: DataFrame, family: int = FAMILY, loans: int = LOANS) -> DataFrame:
    """conv_id and seq, an array of (digest, n_chars) for each turn of the rebuilt conversation.

    Conversation c takes the first h turns of conversation c - c % family (all if fewer, none if absent), and goes on with its own
    turns after its first h; h = crc32 of the decimal c, modulo loans.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, WIDTH)
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("n_chars")).alias("t"))
    plain = F.transform(F.sort_array(F.collect_list("t")), lambda x: F.struct(x.digest.alias("digest"), x.n_chars.alias("n_chars")))
    own = rows.groupBy("conv_id").agg(plain.alias("own"))
    lent = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, max(1, loans - 1)).alias("lent"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % loans).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(lent, "base", "left").withColumn("h", h)
    begin = F.when(F.col("lent").isNull() | (F.col("h") == 0), F.slice("own", 1, 0)).otherwise(F.slice("lent", F.lit(1), F.col("h")))
    return both.select("conv_id", F.concat(begin, F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))).alias("seq"))


_KEYS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("sums", T.ArrayType(T.LongType()))])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chained digests of each conversation's prefixes, and the running sums of its code points."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_KEYS)
    for batch in batches:
        keys, sums = [], []
        for seq in batch.column("seq").to_pylist():
            at, out, total, run = ROOT, [], 0, []
            for turn in seq:
                at = hashlib.sha256(at + turn["digest"]).digest()[:WIDTH]
                out.append(at)
                total += turn["n_chars"]
                run.append(total)
            keys.append(b"".join(out))
            sums.append(run)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id").cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(sums, schema.field("sums").type)], schema=schema)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (last, conv_id) in that order become one row for each last: its smallest conv_id, number, and the hash of all."""
    schema = pa.schema([("last", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends_sha256", pa.string())])
    now, first, n, h = None, None, 0, None
    for batch in batches:
        done = []
        for last, c in zip(batch.column("last").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if last != now:
                if n:
                    done.append((now, first, n, h.hexdigest()))
                now, first, n, h = last, c, 0, hashlib.sha256()
            h.update(b",%d" % c if n else b"%d" % c)
            n += 1
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema, strict=True)], schema=schema)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((now, first, n, h.hexdigest()), schema, strict=True)], schema=schema)


def sequences(rebuilt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sequences (key, sums, conv_id of the smallest member, n members, ends_sha256), and the written table they come from."""
    ship_package(rebuilt.sparkSession)
    keyed = materialise(rebuilt.mapInArrow(_keys, _KEYS))
    last = F.when(F.length("key") == 0, F.lit(ROOT)).otherwise(F.expr(f"substring(key, length(key) - {WIDTH - 1}, {WIDTH})"))
    order = keyed.select(last.alias("last"), "conv_id").repartition("last").sortWithinPartitions("last", "conv_id")
    ends = order.mapInArrow(_ends, "last binary, conv_id long, n long, ends_sha256 string")
    return keyed.join(ends.drop("last"), "conv_id"), keyed


class Point:
    """A branch, end or leaf of the tree that is still open; path: the key and running sums of one member."""

    __slots__ = ("below", "children", "depth", "ends", "leaves", "least", "n", "path")

    def __init__(self, depth, path, n=0, least=None, ends=None, children=0, leaves=0, below=0):
        self.depth, self.path, self.n, self.least, self.ends, self.children, self.leaves, self.below = depth, path, n, least, ends, children, leaves, below

    def name(self) -> bytes:
        return self.path[0][(self.depth - 1) * WIDTH : self.depth * WIDTH] if self.depth else ROOT

    def meet(self, n, least, children, leaves, below) -> None:
        self.n += n
        self.least = least if self.least is None else self.least if least is None else min(self.least, least)
        self.children += children
        self.leaves += leaves
        self.below += below


def _sum(path, depth: int) -> int:
    return path[1][depth - 1] if depth else 0


class Tree:
    """A stack of open points along the last key's path; closed points are rows of `closed`.

    `floor`: None while the tree's bottom is the root. Else the bottom may go on to the left of what has been seen: "first" (the point of the first
    key) or "part" (a branch on its path, of which only what lies to the right is counted).
    """

    def __init__(self, bottom: Point, floor: str | None):
        self.stack, self.floor, self.closed, self.steps = [bottom], floor, [], []

    def _close(self, v: Point, parent_depth: int | None) -> int:
        """Record v and return the tokens saved in it, its edge and all below."""
        e = parent_depth or 0
        leaves = v.leaves or 1
        edge = [_sum(v.path, x) for x in range(e, v.depth + 1)]
        up = None if parent_depth is None else Point(e, v.path).name()
        self.closed.append((v.name(), up, v.least, e if parent_depth is not None else -1, v.depth, v.n, v.children, leaves, v.below, v.ends, edge))
        return v.below + (v.n - 1) * (edge[-1] - edge[0])

    def rise(self, depth: int, path) -> None:
        """Close what is deeper than `depth`, the number of turns that the next key shares; afterwards a point stands there."""
        while self.stack[-1].depth > depth:
            v = self.stack.pop()
            if not self.stack:
                self.steps.append((self.floor, v))
                self.stack.append(Point(depth, path))
                self.floor = "part"
                return
            e = max(depth, self.stack[-1].depth)
            saved = self._close(v, e)
            if self.stack[-1].depth < depth:
                self.stack.append(Point(depth, path))
            self.stack[-1].meet(v.n, v.least, 1, v.leaves or 1, saved)

    def push(self, v: Point) -> None:
        self.stack.append(v)

    def replay(self, kind: str, v: Point, depth: int | None, path) -> None:
        """A step of another tree: a point that branches off at `depth`, or ("part") what is counted of a point on the way."""
        self.rise(v.depth if kind == "part" else depth, path)
        if v.depth > self.stack[-1].depth:
            self.push(v)
        else:  # the part of a branch, or the root as a turnless conversation's end
            self.stack[-1].meet(v.n, v.least, v.children, v.leaves, v.below)
            self.stack[-1].ends = v.ends or self.stack[-1].ends

    def finish_part(self) -> list:
        """What is left open: the bottom, then each point that stands on the one before."""
        steps = [*self.steps, (self.floor, self.stack[0])]
        return steps + [("child", self.stack[i], self.stack[i - 1].depth) for i in range(1, len(self.stack))]

    def finish(self) -> None:
        while len(self.stack) > 1:
            v = self.stack.pop()
            self.stack[-1].meet(v.n, v.least, 1, v.leaves or 1, self._close(v, self.stack[-1].depth))
        self._close(self.stack[0], None)


def shared(a: bytes, b: bytes) -> int:
    """Leading digests that two keys have in common."""
    lo, hi = 0, min(len(a), len(b)) // WIDTH
    while lo < hi:  # a chained digest is equal only if all before it are
        mid = (lo + hi + 1) // 2
        if a[(mid - 1) * WIDTH : mid * WIDTH] == b[(mid - 1) * WIDTH : mid * WIDTH]:
            lo = mid
        else:
            hi = mid - 1
    return lo


_LONGS = T.ArrayType(T.LongType())
#: What both passes yield: closed points (kind "point"), and the steps of a partition's borders.
_OUT = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("step", T.IntegerType())]
    + [T.StructField(n, T.BinaryType()) for n in ("name", "up")]
    + [T.StructField(n, T.LongType()) for n in ("least", "from_depth", "depth", "n", "children", "leaves", "below")]
    + [T.StructField("ends_sha256", T.StringType()), T.StructField("edge", _LONGS), T.StructField("key", T.BinaryType()), T.StructField("sums", _LONGS)]
)


def _batches(rows: Iterator[tuple], at_once: int = 2000, cells: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_OUT)
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema, strict=True)], schema=schema)

    for r in rows:
        held.append(r)
        size += len(r[13] or ()) + len(r[15] or ())
        if len(held) >= at_once or size >= cells:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _points(tree: Tree) -> Iterator[tuple]:
    for name, up, least, e, d, n, children, leaves, below, ends, edge in tree.closed:
        yield ("point", None, None, name, up, least, e, d, n, children, leaves, below, ends, edge, None, None)
    tree.closed.clear()


def _partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def rows():
        tree, before = None, b""
        for batch in batches:
            for piece in slices([batch], "key"):
                for key, sums, conv, n, sha in zip(*(piece.column(c).to_pylist() for c in ("key", "sums", "conv_id", "n", "ends_sha256")), strict=True):
                    path = (key, sums)
                    point = Point(len(key) // WIDTH, path, n, conv, sha)
                    if tree is None:
                        tree, first = Tree(point, "first"), path
                    else:
                        tree.rise(shared(before, key), path)
                        tree.push(point)
                        if len(tree.closed) >= 2000:
                            yield from _points(tree)
                    before = key
        if tree is None:
            return
        yield from _points(tree)
        last = path
        steps = tree.finish_part()
        for i, (kind, v, *under) in enumerate(steps):
            carried = first if i == 0 else last if i == len(steps) - 1 else (None, None)
            yield (kind, part, i, v.name(), None, v.least, under[0] if under else None, v.depth, v.n, v.children, v.leaves, v.below, v.ends, None, *carried)

    yield from _batches(rows())


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replays the steps of all partitions, in their order."""

    def parts():
        held = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["part"] != r["part"]:
                    yield held
                    held = []
                held.append(r)
        if held:
            yield held

    def rows():
        tree, before = Tree(Point(0, (b"", [])), None), b""
        for steps in parts():
            first = (steps[0]["key"], steps[0]["sums"])
            last = (steps[-1]["key"], steps[-1]["sums"]) if len(steps) > 1 else first
            for r in steps:
                # Points up to the bottom of the partition's stack lie on its first key's path, those above it on its last key's.
                path = last if r["kind"] == "child" else first
                v = Point(r["depth"], path, r["n"], r["least"], r["ends_sha256"], r["children"], r["leaves"], r["below"])
                tree.replay(r["kind"], v, shared(before, first[0]) if r["kind"] == "first" else r["from_depth"], path)
            before = last[0]
            yield from _points(tree)
        tree.finish()
        yield from _points(tree)

    yield from _batches(rows())


def build(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The compressed tree's points, and the written table they are in.

    name: digest of the point's prefix; up: its parent point's; least: smallest member; from_depth and depth: where its edge begins
    (-1: the root) and ends; n members; children; leaves; below: tokens saved under it; ends_sha256 (null: none); edge: running sums of code
    points from from_depth to depth.
    """
    ship_package(distinct.sparkSession)
    first = distinct.select("key", "sums", "conv_id", "n", "ends_sha256").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_partition, _OUT)
    written = materialise(first)
    steps = written.where("kind <> 'point'").repartition(1).sortWithinPartitions("part", "step")
    top = steps.mapInArrow(_borders, _OUT)
    fields = [f.name for f in _OUT.fields[3:14]]
    points = written.where("kind = 'point'").select(*fields)
    if written.where("kind <> 'point'").isEmpty():  # an empty table has no root
        return points, written
    return points.unionByName(top.select(*fields)), written


def expand(points: DataFrame) -> DataFrame:
    """One row for each node: a point and the unary nodes of the edge above it."""
    above = points.select(F.col("name").alias("up"), F.col("least").alias("up_least"), F.col("children").alias("n_below"))
    joined = join_unique(points.where("up IS NOT NULL"), above.where("n_below > 0"), "up", "n_below")
    root = points.where("up IS NULL").withColumn("up_least", F.lit(None).cast("long"))
    rows = joined.unionByName(root)
    bottom = F.greatest(F.col("from_depth") + 1, F.lit(0))
    nodes = rows.select("*", F.explode(F.sequence(bottom, F.col("depth"))).alias("d"))
    at, end = F.col("d") == F.col("depth"), F.element_at("edge", -1)
    start = F.when(F.col("d") == 0, end).otherwise(F.get("edge", (F.col("d") - 1 - F.col("from_depth")).cast("int")))
    return nodes.select(
        F.col("least").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(F.col("d") == bottom, F.col("up_least")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(at, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (end - start)).alias("saved_tokens"),
        F.when(at & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, family: int = FAMILY, loans: int = LOANS) -> DataFrame:
    """All nodes of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    distinct, keyed = sequences(rebuild(turns, family, loans))
    points, written = build(distinct)
    points = materialise(points)
    discard(keyed, written)
    return expand(points)


ORACLE = f"""
WITH RECURSIVE t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
     c AS (SELECT c, c - c % {FAMILY} AS b, c % {FAMILY} = 0 AS base,
                  xor(list_reduce(flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
                                  lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), 4294967295), 4294967295) % {LOANS} AS h
           FROM (SELECT DISTINCT c FROM t)),
     lent AS (SELECT c.c, t.i, t.role, t.text FROM c JOIN t ON t.c = c.b AND t.i <= c.h),
     r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d, role, text
           FROM (SELECT c, i, role, text, 0 AS own FROM lent UNION ALL SELECT t.c, t.i, t.role, t.text, 1 FROM t JOIN c ON t.c = c.c WHERE t.i > c.h)),
     p AS (SELECT c, 0::BIGINT AS d, '' AS k, 0::BIGINT AS len FROM c
           UNION ALL SELECT r.c, r.d, sha256(p.k || length(r.role) || ':' || r.role || r.text), length(r.text) FROM p JOIN r ON r.c = p.c AND r.d = p.d + 1),
     m AS (SELECT c, max(d) AS n FROM p GROUP BY c),
     node AS (SELECT k, d, min(p.c) AS conv_id, count(*) AS n_convs, any_value(len) AS len,
                     sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (WHERE p.d = m.n), '')) AS ends_sha256
              FROM p JOIN m ON m.c = p.c GROUP BY k, d),
     up AS (SELECT DISTINCT a.k, a.d, b.k AS parent FROM p a JOIN p b ON a.c = b.c AND b.d = a.d - 1),
     kids AS (SELECT parent AS k, count(*) AS n_children FROM up GROUP BY parent),
     under AS (SELECT a.k, a.d, sum((n.n_convs - 1) * n.len) AS saved, count(*) FILTER (WHERE kids.k IS NULL) AS leaves
               FROM (SELECT DISTINCT a.k, a.d, b.k AS bk, b.d AS bd FROM p a JOIN p b ON a.c = b.c AND b.d >= a.d) a
               JOIN node n ON n.k = bk AND n.d = bd LEFT JOIN kids ON kids.k = bk GROUP BY a.k, a.d)
SELECT node.conv_id, node.d AS depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n_children, 0)::BIGINT AS n_children,
       under.leaves::BIGINT AS n_leaves, under.saved::BIGINT AS saved_tokens, node.ends_sha256
FROM node JOIN under ON under.k = node.k AND under.d = node.d LEFT JOIN kids ON kids.k = node.k
LEFT JOIN up ON up.k = node.k AND up.d = node.d LEFT JOIN node parent ON parent.k = up.parent AND parent.d = node.d - 1
"""
