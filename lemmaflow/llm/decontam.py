"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations alone.

An item's shingles are its distinct runs of five words; it leaks into a document that contains at
least 0.8 of them. Items are partitioned by size (powers of two). The partition fixes how many of an
item's smallest shingle hashes make its sketch: size - ceil(0.8 * size) + 1 at the partition's upper
end, so a document without any of them can't contain 0.8 of the item, and no leak is missed. A
document's shingle hashes look the sketches up; what hits is verified by the exact containment of
the item's shingles, as words, in the document's.

Sketches are broadcast only after their rows have been counted (at most BROADCAST_ROWS); a larger
benchmark is joined by a shuffle on the hash, and its candidates' texts on the document's id.

Words are runs of letters and digits of the lower-cased text. An item of fewer than five words has
one shingle, the whole item; one without words leaks nowhere. Null and empty texts have no words. Rows
that repeat a doc_id or item_id count as one (the largest containment, and all the id's shingles,
stand); null item_ids are ignored. Rows with a null doc_id are told apart by their texts: leaks names
them with a null doc_id, the largest containment standing, and keep_clean drops those into which an item leaks. Very long
texts are read whole. Empty tables give an empty result; extra columns are not carried by leaks and all carried, whatever
their names, by keep_clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 5
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _runs(w: Column, width: int, make) -> Column:
    """make() of each run of `width` words of w; none if w is shorter."""
    return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: make([F.get(w, i + k) for k in range(width)]))).otherwise(F.array())


def hashes(w: Column, widths) -> Column:
    return F.array_distinct(F.concat(*[_runs(w, n, lambda x: F.xxhash64(*x)).cast("array<bigint>") for n in widths]))


def shingles(w: Column, widths) -> Column:
    return F.array_distinct(F.concat(*[_runs(w, n, lambda x: F.concat_ws(" ", *x)).cast("array<string>") for n in widths]))


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, width and its distinct shingles."""
    w = items.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    width = F.least(F.lit(WIDTH), F.size("w"))
    cases = F.when(width == 1, shingles(F.col("w"), [1]))
    for n in range(2, WIDTH + 1):
        cases = cases.when(width == n, shingles(F.col("w"), [n]))
    return w.select("item_id", width.alias("width"), F.explode(cases).alias("shingle")).distinct()


def sketches(parts: DataFrame) -> DataFrame:
    """h, item_id: the smallest hashes of each item, as many as its size partition asks for."""
    from pyspark.sql import Window

    hashed = parts.select("item_id", F.xxhash64("shingle").alias("o"), "shingle", "width")
    n = F.count("*").over(Window.partitionBy("item_id"))
    upper = (F.pow(F.lit(2.0), F.length(F.bin("n"))) - 1).cast("long")  # the last size of n's partition
    size = upper - F.ceil(upper * 4 / 5) + 1
    ranked = hashed.withColumn("n", n).withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("o")))
    split = F.split("shingle", " ")
    h = F.when(F.col("width") == 1, F.xxhash64(F.get(split, F.lit(0))))
    for k in range(2, WIDTH + 1):
        h = h.when(F.col("width") == k, F.xxhash64(*[F.get(split, F.lit(i)) for i in range(k)]))
    return ranked.where(F.col("r") <= size).select(h.alias("h"), "item_id")


def _own(doc_id: Column, text: Column) -> Column:
    """What tells rows without a doc_id apart."""
    return F.when(doc_id.isNull(), F.md5(text.cast("string").cast("binary")))


def _leaks(docs: DataFrame, items: DataFrame, broadcast_rows: int) -> DataFrame:
    """doc_id, own (of rows without a doc_id), item_id, n and found of every pair at 0.8 or more."""
    parts = item_shingles(items)
    tally = parts.groupBy("width").count().collect()  # at most five rows
    widths = sorted(r["width"] for r in tally) or [WIDTH]
    small = sum(r["count"] for r in tally) <= broadcast_rows
    mark = F.broadcast if small else (lambda d: d)
    whole = parts.groupBy("item_id").agg(F.collect_list("shingle").alias("own_shingles"))
    sketch = sketches(parts)
    text = F.col("text").cast("string")
    w = docs.select("doc_id", _own(F.col("doc_id"), text).alias("own"), F.xxhash64(text).alias("t"), words_of(text).alias("w"))
    if small:
        hit = w.select("doc_id", "own", "t", "w", F.explode(hashes(F.col("w"), widths)).alias("h")).join(mark(sketch), "h")
    else:
        pairs = w.select("doc_id", "own", F.explode(hashes(F.col("w"), widths)).alias("h")).join(sketch, "h").select(F.col("doc_id").alias("_id"), F.col("own").alias("_own"), "item_id").distinct()
        hit = w.join(pairs, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("own").eqNullSafe(F.col("_own")))
    # A text's shingles are made once, however many items and hashes it meets.
    met = hit.groupBy("doc_id", "own", "t").agg(F.first("w").alias("w"), F.collect_set("item_id").alias("items"))
    found = met.select("doc_id", "own", shingles(F.col("w"), widths).alias("has"), F.explode("items").alias("item_id"))
    both = found.join(mark(whole), "item_id").select("doc_id", "own", "item_id", F.size("own_shingles").alias("n"), F.size(F.array_intersect("own_shingles", "has")).alias("found"))
    return both.where("5 * found >= 4 * n")


def leaks(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, n_shingles (the item's), n_found and containment of every pair at 0.8 or more."""
    top = _leaks(docs, items, broadcast_rows).groupBy("doc_id", "item_id").agg(F.max("n").cast("long").alias("n_shingles"), F.max("found").cast("long").alias("n_found"))
    return top.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def keep_clean(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs into which no item leaks, with all their columns."""
    bad = _leaks(docs, items, broadcast_rows).select(F.col("doc_id").alias("leak_id"), F.col("own").alias("leak_own")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["leak_id"]) & _own(docs["doc_id"], docs["text"]).eqNullSafe(bad["leak_own"])
    return docs.join(bad, same, "left_anti")


ORACLE = r"""
WITH i AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
     s AS (SELECT DISTINCT item_id, least(5, len(w)) AS width, unnest([array_to_string(w[j : j + least(5, len(w)) - 1], ' ') FOR j IN range(1, len(w) - least(5, len(w)) + 2)]) AS shingle FROM i WHERE len(w) > 0),
     n AS (SELECT item_id, count(*) AS n FROM s GROUP BY 1),
     d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
     k AS (SELECT DISTINCT doc_id, width, unnest([array_to_string(w[j : j + width - 1], ' ') FOR j IN range(1, len(w) - width + 2)]) AS shingle
           FROM d, (SELECT DISTINCT width FROM s) WHERE len(w) >= width),
     f AS (SELECT doc_id, item_id, count(DISTINCT shingle) AS found FROM k JOIN s USING (width, shingle) GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_shingles, found AS n_found, found / n AS containment FROM f JOIN n USING (item_id) WHERE 5 * found >= 4 * n
"""
