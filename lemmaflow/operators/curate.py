"""Cleaning, verification, balancing, splitting, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import logic
from ..functions.text import balanced_parens, formula_pattern, hash_order, normalize_formula, pair_key, rank_of, strip
from ..schema import VERDICT_DDL
from ..sources.files import work_folder
from .ranking import ranked, running_sum, shuffled

#: Most buckets that a class is cut into by the range of its positions.
RANGES = 4096
REASONS = ("invalid_syntax", "unbalanced_parens", "inconsistent_atoms")


def valid_example(nl: Column, thought: Column, output: Column, formula: Column, min_chars: int = 0) -> Column:
    """Required fields are there and the sentence has at least min_chars characters."""
    there = nl.isNotNull() & thought.isNotNull() & output.isNotNull() & formula.isNotNull()
    return F.coalesce(there & (F.length(nl) >= min_chars), F.lit(False))


def fix_complexity(complexity: Column, requested: Column) -> Column:
    return F.when(complexity.isin("simple", "intermediate", "advanced"), complexity).otherwise(requested)


def tag_reasons(df: DataFrame, formula: str = "formula", formula_ascii: str = "formula_ascii", declared: str = "declared_atoms", strict: bool = False) -> DataFrame:
    """df with `reason`: the first check that fails, null if none does, and `atoms` (of grammar A).

    A formula passes the syntax check in either notation. The parenthesis check can't fail after it
    unless strict, which makes it the first check and takes an empty ASCII form as absent. Atoms must be declared; more may be.
    """
    f, a = F.coalesce(F.col(formula), F.lit("")), F.coalesce(F.col(formula_ascii), F.lit(""))
    d = df.withColumn("_u", logic.checked(f)).withColumn("_a", logic.checked(a))
    valid = F.col("_u.valid") | F.col("_a.valid")
    atoms = F.when(F.size("_u.atoms") > 0, F.col("_u.atoms")).otherwise(F.col("_a.atoms"))
    said = F.coalesce(F.col(declared), F.array().cast("array<string>"))
    other = balanced_parens(a) & (F.length(a) > 0) if strict else balanced_parens(a)
    unbalanced = ~(balanced_parens(f) | other)
    inconsistent = (F.size(atoms) == 0) | (F.size(said) == 0) | (F.size(F.array_except(atoms, said)) > 0)
    first, second = ((unbalanced, REASONS[1]), (~valid, REASONS[0])) if strict else ((~valid, REASONS[0]), (unbalanced, REASONS[1]))
    reason = F.when(first[0], first[1]).when(second[0], second[1]).when(inconsistent, REASONS[2])
    return d.withColumn("reason", reason).withColumn("atoms", F.col("_u.atoms")).drop("_u", "_a")


def keep_first(df: DataFrame, key: Column, pos: str) -> DataFrame:
    """The first row (by pos) of each key; the key is hashed before the shuffle, and each task sends one row a key."""
    cols = df.columns
    first = df.groupBy(F.md5(key.cast("binary")).alias("_k")).agg(F.min_by(F.struct(*cols), pos).alias("_r"))
    return first.select(*[F.col(f"_r.{c}").alias(c) for c in cols])


def cap_trivial(df: DataFrame, trivial: Column, key: str, ratio: float = 0.4) -> DataFrame:
    """At most int(total * ratio) rows that are trivial, drawn at random; the others all stay."""
    total = df.groupBy().agg(F.count("*").alias("_n"))  # one row
    d = df.withColumn("_t", F.coalesce(trivial, F.lit(False)))
    r = shuffled(d.where("_t"), "trivial", key).crossJoin(F.broadcast(total)).where(F.col("rank") <= F.floor(F.col("_n") * ratio)).drop("rank", "_n")
    return d.where("not _t").unionByName(r).drop("_t")


def clean(df: DataFrame, pos: str = "pos", max_trivial: float = 0.4, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Clean rows and a one-row funnel of counts. df: pos, nl, formula, formula_ascii, declared_atoms and any more."""
    tagged = tag_reasons(df, strict=strict)
    good = tagged.where("reason is null").withColumn("formula", normalize_formula(F.col("formula"), strict))
    unique = keep_first(good, pair_key(F.col("nl"), F.col("formula")), pos)
    kept = cap_trivial(unique, F.size("atoms") <= 2, pos, max_trivial)
    return kept.drop("reason", "atoms"), funnel(tagged, pos, max_trivial, strict)


def funnel(tagged: DataFrame, pos: str = "pos", max_trivial: float = 0.4, strict: bool = False) -> DataFrame:
    """One row of counts of what clean() removes at each step; only keys and flags are shuffled, no texts."""
    key = F.md5(pair_key(F.col("nl"), normalize_formula(F.col("formula"), strict)).cast("binary"))
    slim = tagged.select("reason", F.when(F.col("reason").isNull(), key).alias("k"), F.col(pos).alias("p"), (F.size("atoms") <= 2).alias("t"))
    one = slim.groupBy("reason", "k").agg(F.count("*").alias("n"), F.min_by("t", "p").alias("t"))
    ok = F.col("reason").isNull()
    sums = one.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_input"), *[F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("n"))), F.lit(0)).alias(r) for r in REASONS],
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("_good"), F.count_if(ok).alias("_unique"), F.count_if(ok & F.col("t")).alias("_trivial"),
    )
    over = F.greatest(F.lit(0), F.col("_trivial") - F.floor(F.col("_unique") * max_trivial))
    out = sums.select("total_input", *REASONS, (F.col("_good") - F.col("_unique")).alias("duplicates_removed"), over.alias("trivial_filtered"), (F.col("_unique") - over).alias("total_output"))
    return out.withColumn("retention_pct", F.round(100 * F.try_divide("total_output", "total_input"), 1))


def share_by_group(df: DataFrame, by: str) -> DataFrame:
    """by, n and share of all rows, largest first."""
    from pyspark.sql import Window

    g = df.groupBy(by).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), by)  # one row a group


def balance(df: DataFrame, by: str, key: str, ratios: dict[str, float]) -> DataFrame:
    """Of each class named in ratios at most int(total * ratio) rows, drawn at random; other classes stay whole."""
    total = df.groupBy().agg(F.count("*").alias("_n"))
    ratio = F.when(F.lit(False), F.lit(1.0))
    for k, r in ratios.items():
        ratio = ratio.when(F.col(by) == k, F.lit(r))
    r = shuffled(df, "balance", key, [by]).crossJoin(F.broadcast(total))
    return r.where(ratio.isNull() | (F.col("rank") <= F.floor(F.col("_n") * ratio))).drop("rank", "_n")


def cap_groups(df: DataFrame, by: str, key: str, ratio: float = 0.25) -> DataFrame:
    """Of each group at most int(total * ratio) rows, drawn at random."""
    total = df.groupBy().agg(F.count("*").alias("_n"))
    return shuffled(df, "cap", key, [by]).crossJoin(F.broadcast(total)).where(F.col("rank") <= F.floor(F.col("_n") * ratio)).drop("rank", "_n")


def group_split(df: DataFrame, group: Column, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """df with `split`: groups in random order fill train, then val, then test; a group is never divided.

    Groups are counted once, into a table of their own. Those with more than a thousandth of all rows (at most a thousand) are told by broadcast where
    their rows lie; in the join of the others such a row's key is its number, so no task gets a large group.
    """
    d = df.withColumn("_g", group.cast("string"))
    path = work_folder(df.sparkSession)
    d.groupBy("_g").agg(F.count("*").alias("_n")).withColumn("_o", hash_order("split", F.coalesce(F.col("_g"), F.lit("")))).write.parquet(path)
    sizes = df.sparkSession.read.schema("_g string, _n long, _o string").parquet(path)
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    placed = running_sum(sizes, [F.col("_o"), F.col("_g")], F.substring("_o", 1, 3), F.col("_n"), "before")
    in_train = F.col("before") < int(total * train)
    size = placed.agg(F.coalesce(F.sum(F.when(in_train, F.col("_n"))), F.lit(0)).alias("_t"))
    part = F.when(in_train, "train").when(F.col("before") - F.col("_t") < int(total * val), "val").otherwise("test")
    key = F.coalesce(F.concat(F.lit("="), F.col("_g")), F.lit("null"))
    named = placed.crossJoin(F.broadcast(size)).select(key.alias("_k"), "_n", part.alias("split"))
    large = F.broadcast(named.where(F.col("_n") > total // 1000).select("_k", F.col("split").alias("_large")))
    told = d.withColumn("_k", key).join(large, "_k", "left")
    spread = told.withColumn("_k", F.when(F.col("_large").isNull(), F.col("_k")).otherwise(F.monotonically_increasing_id().cast("string")))
    out = spread.join(named.where(F.col("_n") <= total // 1000).select("_k", "split"), "_k", "left")
    return out.withColumn("split", F.coalesce("_large", "split")).select(*df.columns, "split")


def pattern_split(df: DataFrame, formula: str = "formula") -> DataFrame:
    return group_split(df, formula_pattern(F.col(formula)))


def curriculum_sort(df: DataFrame, complexity: str, pos: str) -> DataFrame:
    """Stable sort by class; unknown classes come last."""
    return df.orderBy(rank_of(F.col(complexity)), pos)


def curriculum_rank(df: DataFrame, complexity: str, pos: str, name: str = "place") -> DataFrame:
    """df with each row's place (from 1) in the order of curriculum_sort; pos is a number.

    Buckets of the order are equal ranges of pos inside a class, at most RANGES a class, so what is accumulated
    over buckets has a fixed size whatever the number of rows.
    """
    ends = df.agg(F.min(pos).cast("double").alias("_lo"), F.max(pos).cast("double").alias("_hi"))
    d = df.withColumn("_c", rank_of(F.col(complexity))).crossJoin(F.broadcast(ends))  # one row
    part = F.coalesce(F.call_function("width_bucket", F.col(pos).cast("double"), F.col("_lo"), F.col("_hi") + 1, F.lit(RANGES).cast("long")), F.lit(0).cast("long"))
    return ranked(d, [F.col("_c"), F.col(pos)], F.struct("_c", part.alias("p")), name=name).drop("_c", "_lo", "_hi")


def curriculum_level(epoch: Column, schedule: list[tuple[int, int]]) -> Column:
    """Level of the largest threshold at or below the epoch; null before the first."""
    out = F.when(F.lit(False), F.lit(0))
    for threshold, level in sorted(schedule, reverse=True):
        out = out.when(epoch >= threshold, F.lit(level))
    return out


def parse_schedule(text: str) -> list[tuple[int, int]]:
    """`0:0,5:1,15:2` as pairs of threshold and level."""
    return sorted((int(a), int(b)) for a, b in (x.split(":") for x in text.split(",") if x.strip()))


def pending(df: DataFrame, done: DataFrame, key: Column, done_key: Column) -> DataFrame:
    """Rows of df whose key is not among done's; hashed keys keep the shuffle small."""
    d = done.select(F.md5(done_key.cast("binary")).alias("_d")).distinct()
    return df.join(d, F.md5(key.cast("binary")) == F.col("_d"), "left_anti")


def route_verdicts(df: DataFrame, verdict: Column, formula: str = "formula", min_confidence: float = 0.7, auto_correct: bool = True) -> DataFrame:
    """df with `outcome` (api_error, verified, corrected or rejected), `confidence` and the formula that holds.

    verdict: struct<is_correct, confidence, issues, corrected_formula>, null if the call failed.
    """
    sure = F.coalesce(verdict.confidence, F.when(verdict.is_correct, F.lit(1.0)).otherwise(F.lit(0.0)))
    right = F.coalesce(verdict.is_correct, F.lit(False))
    fixed = F.lit(auto_correct) & (F.length(F.coalesce(verdict.corrected_formula, F.lit(""))) > 0) & (sure >= min_confidence)
    outcome = F.when(verdict.isNull(), "api_error").when(right, "verified").when(fixed, "corrected").otherwise("rejected")
    d = df.withColumn("outcome", outcome).withColumn("confidence", F.when(verdict.isNotNull(), sure))
    return d.withColumn(formula, F.when(F.col("outcome") == "corrected", verdict.corrected_formula).otherwise(F.col(formula)))


def parse_verdicts(reply: Column) -> Column:
    """A model's reply as a verdict struct; null if it has no JSON (the fence is stripped, nothing else is tried)."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(reply), r"(?U)^```(?:json)?\s*", ""), r"(?U)\s*```$", ""))
    return F.when(F.try_parse_json(bare).isNotNull(), F.from_json(bare, VERDICT_DDL))


def block_of(index: Column, size: int = 500, blocks: int = 5) -> Column:
    return F.least(F.floor(index / size), F.lit(blocks - 1)).cast("int")
