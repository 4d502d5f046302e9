"""Next-fit packing of a whole table in one order, without one task.

A bin closes when the next sequence does not fit, so where a bin ends depends on where it begins, and so on from the first row to the last. Yet a bin
that begins at a given row always ends at the same place: the row after it is a successor pointer. Rows are laid out on a line of tokens,
the line is cut into ranges, and a range gets a table of pointers: for every row at which its first bin may begin (there are few: a bin that
comes in from the range before leaves at most `most` tokens over) the row at which the next range's first bin then begins. Tables of `FAN` consecutive
ranges are composed into one, level by level, until one range is left, whose first bin begins at the first row. Then the levels are walked back down:
each range learns where its own first bin begins, and all ranges are packed side by side. Every task holds a range of about `TOKENS` tokens or `FAN` tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.files import work_folder

#: Tokens of a range, and tables of pointers that are composed at once. Results don't depend on them.
TOKENS, FAN = 1 << 20, 256


def _count_on(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition with their place and the tokens before them in it."""
    from pyspark import TaskContext

    part, i, s = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n = b.column("_n").to_numpy(zero_copy_only=False)
        at = s + np.cumsum(n) - n
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(i, i + len(n))), pa.array(at)], names=[*names, "_part", "_i", "_s"])
        i, s = i + len(n), s + int(n.sum())


def laid_out(df: DataFrame, order: list[str], length, folder: str) -> DataFrame:
    """The order's columns, _n (length), _rank (from 0) and _s (tokens in all rows before), from a table written once."""
    from pyspark.sql import types as T

    spark = df.sparkSession
    ship(spark)
    narrow = df.select(*order, length.cast("long").alias("_n")).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*narrow.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_i", T.LongType()), T.StructField("_s", T.LongType())])
    narrow.mapInArrow(partial(_count_on, names=narrow.columns), schema).write.parquet(f"{folder}/rows")
    rows = spark.read.schema(schema).parquet(f"{folder}/rows")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sums = rows.groupBy("_part").agg(F.count("*").alias("c"), F.sum("_n").alias("t"))
    offsets = sums.select("_part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    return rows.join(offsets, "_part").select(*order, "_n", (F.col("_i") + F.col("c0")).alias("_rank"), (F.col("_s") + F.col("t0")).alias("_s"))


def _successors(s: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """For a bin that begins at each row, the row at which the next one does (len(s): none of these)."""
    return np.searchsorted(s + n, s + most, side="right")


def _pointers(pdf: pd.DataFrame, most: int, tokens: int) -> pd.DataFrame:
    """A range's table: entry and exit, as tokens on the line (exit -1: the last bin ends the table)."""
    pdf = pdf.sort_values("_s")
    s, n, q = pdf["_s"].to_numpy(), pdf["_n"].to_numpy(), int(pdf["q"].iloc[0])
    end = (q + 1) * tokens
    to = np.append(_successors(s, n, most), len(s))
    inside = np.append(s < end, False)
    while inside[to[:-1]][inside[:-1]].any():  # pointers of pointers
        to = np.where(inside & inside[to], to[to], to)
    first = (s < min(q * tokens + most, end)) if q else (s == 0)
    at = np.append(s, -1)[to[:-1]]
    return pd.DataFrame({"q": q, "entry": s[first], "exit": at[first]})


def _compose(pdf: pd.DataFrame, fan: int) -> pd.DataFrame:
    """One table of consecutive ones."""
    pdf = pdf.sort_values(["q", "entry"])
    tables = [(t["entry"].to_numpy(), t["exit"].to_numpy()) for _, t in pdf.groupby("q")]
    entry, at = tables[0][0], tables[0][1]
    for e, x in tables[1:]:
        at = np.where(at < 0, at, x[np.minimum(np.searchsorted(e, at), len(e) - 1)])
    return pd.DataFrame({"q": int(pdf["q"].iloc[0]) // fan, "entry": entry, "exit": at})


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where each of consecutive ranges' first bin begins; `begin` is that of all of them."""
    pdf = pdf.sort_values(["q", "entry"])
    at, out = int(pdf["begin"].iloc[0]), []
    for q, t in pdf.groupby("q"):
        if at < 0:
            break
        out.append((q, at))
        at = int(t["exit"].to_numpy()[np.searchsorted(t["entry"].to_numpy(), at)])
    return pd.DataFrame(out, columns=["q", "begin"]).astype("int64")


def _fill(pdf: pd.DataFrame, most: int, tokens: int, rows: int, order: list[str]) -> pd.DataFrame:
    """The rows of the bins that begin in a range: number of the bin in the range, the rank of its first row, and of the next bin's."""
    pdf = pdf.sort_values("_s")
    s, n, rank, q = pdf["_s"].to_numpy(), pdf["_n"].to_numpy(), pdf["_rank"].to_numpy(), int(pdf["q"].iloc[0])
    to = _successors(s, n, most)
    i, starts = int(np.searchsorted(s, pdf["begin"].iloc[0])), []
    while i < len(s) and s[i] < (q + 1) * tokens:
        starts.append(i)
        i = int(to[i])
    if not starts:
        return pdf.assign(local=0, first=0, after=0)[[*order, "_rank", "q", "local", "first", "after"]].head(0)
    bounds = np.array([*starts, i])
    local = np.searchsorted(bounds, np.arange(bounds[0], i), side="right") - 1
    first = np.where(s[bounds[:-1]] == 0, 0, rank[bounds[:-1]])  # empty rows at the very beginning are in the first bin
    after = np.append(first[1:], rank[i] if i < len(s) else rows)
    return pdf.iloc[bounds[0] : i].assign(q=q, local=local, first=first[local], after=after[local])[[*order, "_rank", "q", "local", "first", "after"]]


def _bound(fn, **given):
    """fn with its parameters, as a function of a group."""
    return lambda pdf: fn(pdf, **given)


def next_fit_bins(df: DataFrame, order: list[str], length, most: int, tokens: int | None = None, fan: int | None = None, folder: str | None = None) -> DataFrame:
    """The order's columns of all rows of one token or more, with _rank, bin (from 0), first (its first row's rank) and after (the next bin's).

    The order's columns must tell rows apart; lengths must be from 0 to `most`. Empty rows belong to the bin of the row before and need no row here: their ranks
    lie between first and after.
    """
    spark = df.sparkSession
    folder, tokens, fan = folder or work_folder(spark), max(tokens or TOKENS, 2 * most), fan or FAN
    rows = laid_out(df, order, length, folder)
    full = rows.where("_n > 0").withColumn("q", F.floor(F.col("_s") / tokens).cast("long"))
    home = F.when((F.col("q") > 0) & (F.col("_s") - F.col("q") * tokens < most), F.array(F.col("q"), F.col("q") - 1)).otherwise(F.array("q"))
    halo = full.withColumn("q", F.explode(home))  # a range also has the rows to which its last bin may reach
    ddl = "q long, entry long, exit long"
    halo.select("q", "_s", "_n").groupBy("q").applyInPandas(_bound(_pointers, most=most, tokens=tokens), ddl).write.parquet(f"{folder}/level0")
    total = rows.agg(F.count("*").alias("n"), F.max(F.when(F.col("_n") > 0, F.floor(F.col("_s") / tokens))).alias("q")).first()
    level, last = 0, total["q"] or 0
    while last:
        below = spark.read.schema(ddl).parquet(f"{folder}/level{level}")
        below.groupBy(F.floor(F.col("q") / fan).alias("_g")).applyInPandas(_bound(_compose, fan=fan), ddl).write.parquet(f"{folder}/level{level + 1}")
        level, last = level + 1, last // fan
    begins = spark.createDataFrame([(0, 0)], "q long, begin long")
    for k in range(level - 1, -1, -1):
        tables = spark.read.schema(ddl).parquet(f"{folder}/level{k}").withColumn("_g", F.floor(F.col("q") / fan).cast("long"))
        known = tables.join(begins.select(F.col("q").alias("_g"), "begin"), "_g")
        known.groupBy("_g").applyInPandas(_walk, "q long, begin long").write.parquet(f"{folder}/begin{k}")
        begins = spark.read.schema("q long, begin long").parquet(f"{folder}/begin{k}")
    kinds = ", ".join(f"`{c}` {t}" for c, t in full.select(*order).dtypes)
    filled = halo.join(begins, "q").groupBy("q").applyInPandas(_bound(_fill, most=most, tokens=tokens, rows=total["n"], order=order), f"{kinds}, _rank long, q long, local long, first long, after long")
    filled.write.parquet(f"{folder}/filled")
    placed = spark.read.schema(filled.schema).parquet(f"{folder}/filled")
    # A coarse range's bins are counted first, so no window has a row for every range.
    coarse = placed.groupBy(F.floor(F.col("q") / fan).alias("g"), "q").agg((F.max("local") + 1).alias("k"))
    wide = coarse.groupBy("g").agg(F.sum("k").alias("k"))
    before = wide.select("g", F.coalesce(F.sum("k").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("k0"))
    inner = Window.partitionBy("g").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    numbered = coarse.withColumn("in", F.coalesce(F.sum("k").over(inner), F.lit(0))).join(before, "g").select("q", (F.col("in") + F.col("k0")).alias("base"))
    return placed.join(numbered, "q").select(*order, "_rank", (F.col("base") + F.col("local")).alias("bin"), "first", "after")


def pack_all(df: DataFrame, order: list[str], ids: str, most: int, pad: int = 0, tokens: int | None = None, fan: int | None = None) -> DataFrame:
    """Pack all sequences in one order: bin, input_ids and doc_ids of `most` places, n_docs, n_real_tokens.

    Longer sequences are cut to `most`, null ones are empty; pad places have doc_id -1. Empty sequences count as documents of the bin that is open where
    they stand, and take no place. A table without a token has no bin.
    """
    cut = F.slice(F.coalesce(F.col(ids), F.array().cast("array<int>")), 1, most)
    bins = next_fit_bins(df, order, F.size(cut), most, tokens, fan)
    named = bins.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(order)], "_rank", "bin", "first", "after")
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(order)]
    whole = df.select(*order, cut.alias("_ids")).join(named, on).select("bin", "first", "after", F.struct((F.col("_rank") - F.col("first")).cast("int").alias("i"), F.col("_ids").alias("ids")).alias("d"))
    g = whole.groupBy("bin", "first", "after").agg(F.sort_array(F.collect_list("d")).alias("d"))
    real = F.flatten(F.transform("d", lambda x: x.ids))
    docs = F.flatten(F.transform("d", lambda x: F.array_repeat(x.i, F.size(x.ids))))
    fill = F.lit(most) - F.size(real)
    return g.select("bin", F.concat(real, F.array_repeat(F.lit(pad).cast("int"), fill)).alias("input_ids"), F.concat(docs, F.array_repeat(F.lit(-1), fill)).alias("doc_ids"), (F.col("after") - F.col("first")).cast("long").alias("n_docs"), F.size(real).alias("n_real_tokens"))
