"""From token ids to training batches: lengths, buckets, packing, masks, padding and targets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_order, rank_of
from ..schema import IGNORED_TARGET
from .packing import pack_all
from .ranking import ranked


def tokenised(df: DataFrame, ids: str = "input_ids", complexity: str = "complexity", max_complexity: int | None = None, max_len: int | None = None) -> DataFrame:
    """input_ids cut to max_len, their length and the class's level; rows above max_complexity go first."""
    level = rank_of(F.col(complexity), 0)
    d = df if max_complexity is None else df.where(level <= max_complexity)
    cut = F.col(ids) if max_len is None else F.slice(F.col(ids), 1, max_len)
    return d.withColumns({ids: cut, "length": F.size(cut), "level": level})


def length_stats(df: DataFrame, length: str = "length") -> DataFrame:
    """count, min, max, mean and the upper median and percentiles by index int(n * q) of the sorted lengths.

    Works on the histogram of lengths: no list of all lengths is gathered. An empty table has nulls.
    """
    h = df.groupBy(F.col(length).alias("len")).agg(F.count("*").alias("c"))
    w = Window.partitionBy().orderBy("len")  # one row a distinct length
    c = h.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda q: F.min(F.when(F.col("upto") > q, F.col("len")))
    n = F.col("n")
    return c.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.min("len").alias("min"), F.max("len").alias("max"), (F.sum(F.col("len") * F.col("c")) / F.sum("c")).alias("mean"),
        at(F.floor(n / 2)).alias("median"), at(F.floor(n * 0.95)).alias("p95"), at(F.floor(n * 0.99)).alias("p99"),
    )


def length_buckets(df: DataFrame, length: str, key: str, batch: int, span: int = 10, drop_last: bool = False) -> DataFrame:
    """df with `bucket` and `batch`: neighbours in length, in random order inside a bucket of span * batch rows.

    Rows of one length are in order of a hash of their key, whose first digits cut a length that most rows have (that
    of truncated texts) into many parts.
    """
    tie = hash_order("length", F.col(key))
    d = ranked(df, [F.col(length), tie, F.col(key)], F.struct(F.col(length).alias("n"), F.substring(tie, 1, 3).alias("h")), name="_rank").withColumn("bucket", F.floor((F.col("_rank") - 1) / (batch * span)))
    w = Window.partitionBy("bucket").orderBy(hash_order("bucket", F.col(key)), key)
    out = d.withColumn("batch", F.floor((F.row_number().over(w) - 1) / batch)).drop("_rank")
    if drop_last:
        full = Window.partitionBy("bucket", "batch")
        out = out.withColumn("_c", F.count("*").over(full)).where(F.col("_c") == batch).drop("_c")
    return out


def _keys(seed: int, epoch: int) -> list[int]:
    return [(seed * 1_000_003 + epoch * 7919 + k * 104_729 + 12_345) % 2_147_483_647 for k in range(8)]


def permuted(numbers, n: int, seed: int, epoch: int) -> np.ndarray:
    """A bijection of 0 .. n - 1, without a table of them: eight rounds of a Feistel network over a rectangle of n places or a few more.

    A number that comes out beyond n - 1 goes through again until it does not, which ends because the rounds can be undone.
    """
    width = math.isqrt(max(n - 1, 0)) + 1
    height = -(-n // width)
    mix = lambda v, key: (((v + key) * 2_654_435_761) % 4_294_967_296) >> 9

    def rounds(x):
        a, b = x // width, x % width
        for k, key in enumerate(_keys(seed, epoch)):
            if k % 2 == 0:
                a = (a + mix(b, key)) % height
            else:
                b = (b + mix(a, key)) % width
        return a * width + b

    out = rounds(np.asarray(numbers, np.int64))
    while (out >= n).any():
        out = np.where(out >= n, rounds(out), out)
    return out


def epoch_order(df: DataFrame, seed: int, epoch: int, span: int = 10, step: str = "step") -> DataFrame:
    """Rows of length_buckets with `step`, the place of their batch in the order of an epoch; nothing is shuffled for it."""
    last = df.agg(F.max(F.struct("bucket", "batch"))).first()[0]
    n = 0 if last is None else last["bucket"] * span + last["batch"] + 1

    @F.pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(permuted(number.to_numpy(), n, seed, epoch))

    return df.withColumn(step, place((F.col("bucket") * span + F.col("batch")).cast("long")))


def next_fit(lengths: Column, most: int) -> Column:
    """Bin of each length in order: a bin closes when the next length does not fit."""
    start = F.struct(F.array().cast("array<int>").alias("bins"), F.lit(0).alias("bin"), F.lit(0).alias("used"))

    def step(s, n):
        over = (s.used > 0) & (s.used + n > most)
        bin_ = F.when(over, s.bin + 1).otherwise(s.bin)
        return F.struct(F.concat(s.bins, F.array(bin_)).alias("bins"), bin_.alias("bin"), F.when(over, n).otherwise(s.used + n).alias("used"))

    return F.aggregate(lengths, start, step, lambda s: s.bins)


def pack(df: DataFrame, shard: Column, order: str, ids: str, most: int, pad: int = 0) -> DataFrame:
    """Pack each shard's sequences in order: shard, bin, input_ids and doc_ids of `most` places, n_docs, n_real_tokens.

    A shard is packed by one task, so it should be bounded (a block of consecutive ranks, a
    conversation). Longer sequences are cut to `most`; pad places have doc_id -1.
    """
    cut = df.select(shard.alias("shard"), F.col(order).alias("_o"), F.slice(F.col(ids), 1, most).alias("_ids"))
    g = cut.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("_o", "_ids"))).alias("s"))
    bins = g.withColumn("bins", next_fit(F.transform("s", lambda x: F.size(x._ids)), most))
    flat = bins.select("shard", F.posexplode(F.arrays_zip("s", "bins")).alias("i", "x")).select("shard", "i", F.col("x.bins").alias("bin"), F.col("x.s._ids").alias("ids"))
    b = flat.groupBy("shard", "bin").agg(F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("d"))
    real = F.flatten(F.transform("d", lambda x: x.ids))
    docs = F.flatten(F.transform("d", lambda x, i: F.array_repeat(i, F.size(x.ids))))
    fill = F.lit(most) - F.size(real)
    return b.select("shard", "bin", F.concat(real, F.array_repeat(F.lit(pad).cast("int"), fill)).alias("input_ids"), F.concat(docs, F.array_repeat(F.lit(-1), fill)).alias("doc_ids"), F.size("d").alias("n_docs"), F.size(real).alias("n_real_tokens"))


def mask_pairs(df: DataFrame, seq: str, pos: str, doc: str) -> DataFrame:
    """(seq, i, j) of all places j that place i may look at: same document, not later; pad places none."""
    a = df.where(F.col(doc) != -1).select(F.col(seq).alias("seq"), F.col(doc).alias("doc"), F.col(pos).alias("i"))
    b = a.select("seq", "doc", F.col("i").alias("j"))
    return a.join(b, ["seq", "doc"]).where("j <= i").select("seq", "i", "j")


def padded(df: DataFrame, batch: list[str], ids: str, pad: int = 0) -> DataFrame:
    """df with input_ids padded to the batch's longest, targets shifted left (-100 from the last place on) and attention."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(*batch))
    n = F.size(ids)
    d = df.withColumn("_m", longest)
    return d.withColumns({
        "padded": F.concat(F.col(ids), F.array_repeat(F.lit(pad).cast("int"), F.col("_m") - n)),
        "targets": F.concat(F.slice(F.col(ids), F.lit(2), F.greatest(n - 1, F.lit(0))), F.array_repeat(F.lit(IGNORED_TARGET), F.col("_m") - n + F.least(n, F.lit(1)))),
        "attention": F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.col("_m") - n)),
    }).drop("_m")


def packed_targets(ids: Column, docs: Column, pad: int = 0, strict: bool = False) -> Column:
    """Targets of a packed sequence: the next token of the same document, else -100.

    The last place of a completely full sequence gets the pad id; strict gives it -100.
    """
    last = F.lit(IGNORED_TARGET) if strict else F.lit(pad)

    def at(x, i):
        follows = F.get(docs, i + 1)
        return F.when(F.get(docs, i) == -1, IGNORED_TARGET).when(i == F.size(ids) - 1, last).when(follows == F.get(docs, i), F.get(ids, i + 1)).otherwise(IGNORED_TARGET)

    return F.transform(ids, at)


def causal_mask(spark, n: int) -> DataFrame:
    """(i, j) with j <= i < n."""
    return spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id"))).alias("j"))


def rope_table(spark, places: int, width: int, base: float = 10000.0) -> DataFrame:
    """pos, k, cos and sin of rotary embeddings of an even width."""
    angle = F.col("pos") / F.pow(F.lit(base), 2 * F.col("k") / width)
    return spark.range(places).select(F.col("id").alias("pos"), F.explode(F.sequence(F.lit(0), F.lit(width // 2 - 1))).alias("k")).select("pos", "k", F.cos(angle).alias("cos"), F.sin(angle).alias("sin"))


def batches(df: DataFrame, key: str, ids: str, batch: int, most: int, packing: bool = False, shard_rows: int | None = 4096) -> DataFrame:
    """Rows ready for a trainer: packed sequences, or padded ones by bucket.

    Packing begins anew every shard_rows sequences, or never (None): then bins are those of one pass over all sequences.
    """
    d = tokenised(df, ids, max_len=most)
    if packing and shard_rows is None:
        out = pack_all(d.withColumn("_h", hash_order("pack", F.col(key))), ["_h", key], ids, most)
        return out.withColumn("targets", packed_targets(F.col("input_ids"), F.col("doc_ids")))
    if packing:
        s = ranked(d, [hash_order("pack", F.col(key)), F.col(key)], F.substring(hash_order("pack", F.col(key)), 1, 3))
        out = pack(s, F.floor((F.col("rank") - 1) / shard_rows), "rank", ids, most)
        return out.withColumn("targets", packed_targets(F.col("input_ids"), F.col("doc_ids")))
    return padded(length_buckets(d, "length", key, batch), ["bucket", "batch"], ids)
