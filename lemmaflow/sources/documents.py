"""JSON documents of any size: read by many tasks, written by many tasks.

A document is `{"examples": [{...}, ...], ...}` or a bare array of objects, in one file or in files that follow one another in order of name.
Spark's text reader cuts files into splits at closing braces. Where a split stands in the document is not known to its task, so a first
pass tells for each split how it changes the state (inside a string or not, and depth), for both states in which it may begin;
composed in order of the splits, that gives each one's own state, with which the objects of the array are cut out. An object that spans splits is put
together from its pieces. Splits are a few numbers each and go through the driver; text does not.

A key that is missing, or of another type than an array, gives no rows. A document that is no JSON gives whatever objects its braces make: it is
not validated, but each object is parsed by itself, and a broken one gives nulls.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EXAMPLE_DDL
from ..shipping import ship

#: Characters that are looked at together.
BUFFER = 4 << 20
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|["{}\[\]]', re.S)


def _splits(batches: Iterator[pa.RecordBatch]):
    """(file, start, iterator of buffers) of each split; a split ends with a closing brace or with its file."""
    columns = ("file", "start", "last", "value")
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True))
    row = next(rows, None)

    def buffers(file, start):
        nonlocal row
        held, size = [], 0
        while row is not None and row[:2] == (file, start):
            *_, last, value = row
            row = next(rows, None)
            ended = row is None or row[:2] != (file, start)
            held.append(value if ended and last and not value.strip() else value + "}")  # white space behind a file's last brace
            size += len(value) + 1
            if size >= BUFFER:
                yield "".join(held)
                held, size = [], 0
        if held:
            yield "".join(held)

    while row is not None:
        file, start = row[:2]
        parts = buffers(file, start)
        yield file, start, parts
        for _ in parts:
            pass


class _Run:
    """State over the buffers of a split: whether a string is open, and how far the depth has changed."""

    def __init__(self, inside: bool):
        self.kept, self.depth = '"' if inside else "", 0

    def take(self, text: str) -> None:
        pieces = _STRING.split(self.kept + text)
        last, quote, rest = pieces[-1].partition('"')
        self.kept = quote + rest
        plain = "".join([*pieces[:-1], last])
        self.depth += plain.count("{") + plain.count("[") - plain.count("}") - plain.count("]")


_STATES = "file string, start long, opens string, inside0 boolean, depth0 long, inside1 boolean, depth1 long"


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, start, parts in _splits(batches):
        runs, opens = (_Run(False), _Run(True)), ""
        for text in parts:
            opens = opens or text.lstrip()[:1]
            for r in runs:
                r.take(text)
        names = ("file", "start", "opens", "inside0", "depth0", "inside1", "depth1")
        values = (file, start, opens, bool(runs[0].kept), runs[0].depth, bool(runs[1].kept), runs[1].depth)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in values], names=list(names))


def _pieces(parts: Iterator[str], inside: bool, depth: int, level: int, text_too: bool):
    """(number, key, begun here, ended here, text) of a split's objects at depth `level`; at last (None, the last name seen, ...).

    number counts the objects that begin in the split, -1 for one that has begun before; key is the last name seen at depth 1, None if none was.
    """
    number, begun, key, kept, held = -1, 0, None, "", []
    open_, here = depth > level, False
    for text in parts:
        if inside:  # a string goes on
            m = _REST.match(text)
            inside, stop = m is None, len(text) if m is None else m.end()
            if open_ and text_too:
                held.append(text[:stop])
            text = text[stop:]
        text, kept = kept + text, ""
        at, stop = (0 if open_ else None), len(text)
        for m in _TOKEN.finditer(text):
            t, end = m[0], m.end()
            if t == '"':  # a string that goes on behind this buffer
                stop = m.start()
                break
            if t[0] == '"':
                if depth == 1 < level and text[end : end + 64].lstrip()[:1] == ":":
                    key = t[1:-1]
            elif t in "{[":
                if depth == level and t == "{":
                    number, open_, here, at, held = begun, True, True, m.start(), []
                    begun += 1
                depth += 1
            else:
                depth -= 1
                if depth == level and open_:
                    if text_too:
                        held.append(text[at:end])
                    yield number, key, here, True, "".join(held)
                    open_, at, held = False, None, []
        kept = text[stop:]
        if open_ and text_too:
            held.append(text[at:stop])
    if open_:
        yield number, key, here, False, "".join([*held, kept]) if text_too else ""
    yield None, key, False, False, ""


_COUNTS = "file string, start long, key string, n long, first long"


def _counted(batches: Iterator[pa.RecordBatch], states: dict) -> Iterator[pa.RecordBatch]:
    """For each split and key how many objects begin and the first one's number; n = -1 for the last name of the split."""
    for file, start, parts in _splits(batches):
        found: dict = {}
        rows = []
        for number, key, here, *_ in _pieces(parts, *states[file, start], False):
            if number is None:
                rows.append((file, start, key, -1, 0))
            elif here:
                n, first = found.get(key, (0, number))
                found[key] = (n + 1, first)
        rows += [(file, start, key, n, first) for key, (n, first) in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "start", "key", "n", "first"])


_FOUND = pa.schema([("document", pa.int64()), ("pos", pa.int64()), ("split", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])


def _found(batches: Iterator[pa.RecordBatch], states: dict, places: dict) -> Iterator[pa.RecordBatch]:
    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _FOUND, strict=True)], schema=_FOUND)

    for file, start, parts in _splits(batches):
        document, split, base, offsets = places[file, start]
        rows, size = [], 0
        for number, key, here, ended, text in _pieces(parts, *states[file, start], True):
            if number is None or (key if here else None) not in offsets:
                continue
            rows.append((document, base + number - offsets[key] if here else base - 1, split, here and ended, text))
            size += len(text) + 32
            if size >= BUFFER:
                yield out(rows)
                rows, size = [], 0
        if rows:
            yield out(rows)


def objects(spark: SparkSession, path: str, key: str = "examples", joined: bool = True) -> DataFrame:
    """document (0 if joined, else the file's number in order of name), pos (from 0) and text of each object of the array.

    joined: the files at path are one document; else each is one.
    """
    ship(spark)
    raw = spark.read.option("lineSep", "}").text(path)
    last = F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), last.alias("last"), "value")
    table = sorted(tuple(r) for r in rows.mapInArrow(_states, _STATES).collect())  # a row a split
    files = {f: i for i, f in enumerate(sorted({r[0] for r in table}))}
    states, inside, depth, level, now = {}, False, 0, 1, None
    for file, start, opens, inside0, depth0, inside1, depth1 in table:
        if now is None or (file != now and not joined):
            inside, depth, level = False, 0, 2 if opens == "{" else 1
        now = file
        states[file, start] = (inside, depth, level)
        depth += depth1 if inside else depth0
        inside = inside1 if inside else inside0
    counts: dict = {}
    for r in rows.mapInArrow(partial(_counted, states=states), _COUNTS).collect():  # a row a split and name
        counts.setdefault((r["file"], r["start"]), {})[r["key"], r["n"] < 0] = (r["n"], r["first"])
    places, base, name, now = {}, 0, None, None
    for split, (file, start, *_) in enumerate(table):
        if now is None or (file != now and not joined):
            base, name = 0, None
        now = file
        own = counts.get((file, start), {})
        bare = states[file, start][2] == 1
        offsets = {k: first for (k, end), (_, first) in own.items() if not end and (bare or k == key or (k is None and name == key))}
        if bare or name == key:
            offsets.setdefault(None, 0)  # one that has begun before
        places[file, start] = (0 if joined else files[file], split, base, offsets)
        base += sum(n for (k, end), (n, _) in own.items() if not end and k in offsets)
        name = next((k for k, end in own if end and k is not None), name)
    found = rows.mapInArrow(partial(_found, states=states, places=places), "document long, pos long, split long, whole boolean, text string")
    pieces = found.where("not whole").groupBy("document", "pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "text"))), lambda x: x.text), "").alias("text"))
    return found.where("whole").select("document", "pos", "text").unionByName(pieces)


def read_document(spark: SparkSession, path: str, key: str = "examples", joined: bool = True, kind: str = EXAMPLE_DDL) -> DataFrame:
    """One row per object, with its place `pos`; over several documents pos counts on, the document's number times 2^40 first."""
    o = objects(spark, path, key, joined)
    return o.select((F.col("document") * (1 << 40) + F.col("pos")).alias("pos"), F.from_json("text", kind).alias("e")).select("pos", "e.*")


def write_document(df: DataFrame, stats: DataFrame, path: str, order: str, key: str = "examples", stats_key: str = "stats") -> None:
    """One JSON document `{key: [...], stats_key: {...}}` as files that follow one another in order of name, one a task.

    `order` is a column of df without repeated values, by which objects stand; it isn't written. stats: a table of one row.
    """
    fields = [c for c in df.columns if c != order]
    json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    least = df.agg(F.min(order).alias("_least"), F.count_if(F.col(order).isNull()).alias("_nulls"))  # one row
    first = F.when(F.col("_nulls") > 0, F.col(order).isNull()).otherwise(F.col(order) == F.col("_least"))
    open_ = F.lit(f'{{"{key}": [')
    rows = df.crossJoin(F.broadcast(least)).select(F.lit(0).alias("_end"), F.col(order).alias("_o"), F.concat(F.when(first, open_).otherwise(", "), json(F.struct(*fields))).alias("value"))
    # With no object the beginning stands in the last row.
    tail = stats.limit(1).crossJoin(F.broadcast(least)).select(
        F.lit(1).alias("_end"), F.lit(None).cast(df.schema[order].dataType).alias("_o"),
        F.concat(F.when((F.col("_least").isNull()) & (F.col("_nulls") == 0), open_).otherwise(""), F.lit(f'], "{stats_key}": '), json(F.struct(*stats.columns)), F.lit("}")).alias("value"),
    )
    rows.unionByName(tail).repartitionByRange("_end", "_o").sortWithinPartitions("_end", F.col("_o").asc_nulls_first()).select("value").write.mode("overwrite").text(path)
