"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two 32-bit segments. Two fingerprints within k = 2 bits agree on a segment
up to its radius, as the radii 1 and 0 satisfy (1 + 1) + (0 + 1) > 2: so each fingerprint probes the
low segment's table with the 33 values of its Hamming ball of radius 1, and the high segment's table
with its own value; the complete distance of each match is verified inside the join.

Edge cases: null text and text without words have fingerprint zero and link like any other; equal
fingerprints are one node, whatever their number; a null doc_id is carried but never names a
component that has another id. Repeated rows give repeated rows, an empty table an empty result; very long texts are read
whole. Extra columns are not carried by near_duplicates and all carried, whatever their names, by keep_one.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, free_name, join_unique, map_text, materialise

RADII = (1, 0)  # low, high segment
MAX_DISTANCE = 2

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = 255


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    h64 = xxhash.xxh64_intdigest
    hashes = np.fromiter((h64(s, 42) for s in shingles), np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK * 16):
        bits = np.unpackbits(hashes[i : i + _BLOCK * 16].view(np.uint8), bitorder="little").reshape(-1, 64)
        for j in range(0, len(bits), _BLOCK):
            total += np.add.reduce(bits[j : j + _BLOCK], axis=0, dtype=np.uint8)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(texts, state, name="fp"):
    return {name: np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_text(plain, "text", _fingerprints, "fp long").select("doc_id", "fp")


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints within max_distance bits; fps has one row a value."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    ball = F.concat(F.array(low), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: low.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    table = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("s"), low.alias("v")), F.struct(F.lit(1).alias("s"), high.alias("v")))).alias("k")).select("k.s", "k.v", F.col("fp").alias("b"))
    probes = fps.select("fp", F.explode(F.concat(F.transform(ball, lambda v: F.struct(F.lit(0).alias("s"), v.alias("v"))), F.array(F.struct(F.lit(1).alias("s"), high.alias("v"))))).alias("k")).select("k.s", "k.v", F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    return probes.join(table, ["s", "v"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row."""
    fps = materialise(fingerprints(docs, id_col, text_col))
    reps = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    groups = materialise(components(links(reps.select("fp"))))
    named = groups.join(reps.select("fp", "rep"), groups.node == reps.fp).select("node", "component", "rep")
    smallest = named.groupBy("component").agg(F.min("rep").alias("least"))
    of_group = named.join(smallest, "component").select("node", "least")
    of_fp = reps.join(of_group, reps.fp == of_group.node, "left").select("fp", "n", F.coalesce("least", "rep").alias("component_id"))
    of_fp = materialise(of_fp)
    return join_unique(fps, of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs of each component: that with the smallest doc_id, null ids last; of rows that repeat it, one.

    Rows are told apart by their place in a table written with the fingerprints.
    """
    fp, row = free_name(docs, "_fp"), free_name(docs, "_row")
    fps = materialise(map_text(docs, "text", partial(_fingerprints, name=fp), f"`{fp}` long").withColumn(row, F.monotonically_increasing_id()))
    reps = materialise(fps.groupBy(F.col(fp).alias("fp")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))).alias("first")))
    groups = materialise(components(links(reps.select("fp"))))
    named = reps.join(groups, reps.fp == groups.node, "left").select("first", F.coalesce("component", "fp").alias("component"))
    first = named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    others = materialise(fps.select(row).join(first, row, "left_anti"))
    return fps.join(others, row, "left_anti").select(*docs.columns)
