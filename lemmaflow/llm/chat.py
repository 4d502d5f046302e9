"""Chat formatting with collapse of cumulative snapshots.

A logged conversation is often the beginning of a longer one. Each turn's hash depends on its place,
role and text, and the running sums of two such hashes are the rolling hashes of the conversation's
prefixes. A conversation whose whole hash is a strict prefix's hash of another one is dropped by an
anti-join, and of equal conversations the one with the smallest conv_id stays. The maximal ones are
rendered. Prefixes of one length are told apart by both sums, 128 bits of two hashes of independent beginnings: of 10**12 prefixes two are taken for one with a
probability below 10**-14.

Turns are in order of turn; ties are broken by role and text, so a repeated row is a turn of its own.
A null role or text is the empty text; null turns come first; rows with a null conv_id are one
conversation. A very long conversation or text is rendered whole, by one task. An empty table gives an empty result;
extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, i (from 1), n (turns in all), role, text and the two rolling hashes h1 and h2 of the first i turns."""
    rows = turns.select(F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.withColumn("i", F.row_number().over(order))
    own = [F.xxhash64(F.lit(k), "i", "role", "text").cast("decimal(20,0)").alias(f"t{k}") for k in (1, 2)]  # k is hashed first, so that the two don't collide together
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = placed.select("*", *own)
    return hashed.select("conv_id", "turn", "i", "role", "text", F.sum("t1").over(running).alias("h1"), F.sum("t2").over(running).alias("h2"), F.count("*").over(Window.partitionBy("conv_id")).alias("n"))


def maximal(pre: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that stay."""
    whole = pre.where("i = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    begun = pre.where("i < n").select(F.col("i").alias("n"), "h1", "h2").distinct()
    return whole.join(begun, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and rendered: `<|role|>`, a line break, the text, `<|end|>` and a line break for each turn."""
    hashes = materialise(prefixes(turns).select("conv_id", "i", "n", "h1", "h2"))  # no texts; read twice
    stay = maximal(hashes).withColumnRenamed("conv_id", "k_id")
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(turns["conv_id"], turns["turn"], role.alias("role"), text.alias("text"))
    kept = rows.join(stay, rows["conv_id"].eqNullSafe(F.col("k_id"))).groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    line = lambda x: F.concat(F.lit("<|"), x.role, F.lit("|>\n"), x.text, F.lit("<|end|>\n"))
    return kept.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", F.array_join(F.transform("all", line), "").alias("rendered"))


ORACLE = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
                  count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
     p AS (SELECT a.conv_id, a.i, a.n, string_agg('<|' || b.role || '|>' || chr(10) || b.text || '<|end|>' || chr(10), '' ORDER BY b.i) AS rendered
           FROM t a JOIN t b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i <= a.i GROUP BY 1, 2, 3),
     w AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies, rendered FROM p WHERE i = n GROUP BY n, rendered)
SELECT conv_id, n_turns, n_copies, rendered FROM w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.i < p.n AND p.i = w.n_turns AND p.rendered = w.rendered)
"""
