"""The corpus's three routes as single lazy plans: generation requests, curation, evaluation, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.text import extract_formula, extract_json, format_plain, format_with_thought, hash_order, rank_of
from ..operators import augment, batching, curate, evaluate
from ..schema import COMPLEXITY, EXAMPLE_DDL

# Shares of the classes and of a block, parts of the split, classes that the last block draws from.
CLASS_SHARES = {"simple": 0.33, "intermediate": 0.34, "advanced": 0.33}
BLOCK_SHARE = 0.25
LAST_BLOCK = ("intermediate", "advanced", "advanced")


def _pick(values: Column, key: Column, tag: str) -> Column:
    return F.get(values, F.pmod(augment.draw_of(key, tag), F.size(values)).cast("int"))


def generation_requests(spark: SparkSession, n: int, topics: list[list[str]], per_block: int = 500) -> DataFrame:
    """index, block, topic and complexity of n requests; a block's topics are one list of `topics`."""
    block = curate.block_of(F.col("id"), per_block, len(topics))
    kinds = F.when(F.col("block") == len(topics) - 1, F.array(*map(F.lit, LAST_BLOCK))).otherwise(F.array(*map(F.lit, COMPLEXITY)))
    d = spark.range(n).withColumn("block", block).withColumn("_t", F.get(F.array(*[F.array(*map(F.lit, t)) for t in topics]), F.col("block")))
    return d.select(F.col("id").alias("index"), "block", _pick(F.col("_t"), F.col("id"), "topic").alias("topic"), _pick(kinds, F.col("id"), "complexity").alias("complexity"))


def parse_replies(replies: DataFrame, reply: str = "reply", requested: str = "complexity", min_chars: int = 20) -> DataFrame:
    """Valid examples of generated replies: the reply's JSON, its required fields, and a known complexity."""
    e = replies.withColumn("_e", extract_json(F.col(reply), EXAMPLE_DDL))
    good = e.where(curate.valid_example(F.col("_e.natural_language_input"), F.col("_e.thought"), F.col("_e.output"), F.col("_e.output.formula"), min_chars))
    others = [c for c in replies.columns if c not in (reply, requested)]
    return good.select(*others, "_e.natural_language_input", curate.fix_complexity(F.col("_e.complexity"), F.col(requested)).alias("complexity"), "_e.thought", "_e.output")


def flat(examples: DataFrame) -> DataFrame:
    """pos, nl, formula, formula_ascii, declared_atoms, steps, complexity and block of nested examples."""
    return examples.select(
        "pos", F.col("natural_language_input").alias("nl"), "output.formula", "output.formula_ascii", F.col("thought.identified_atoms.atom").alias("declared_atoms"),
        F.col("thought.reasoning_steps.explanation").alias("steps"), "complexity", "block",
    )


def curation(examples: DataFrame, verdicts: DataFrame | None = None, verified: bool = False, with_thought: bool = True) -> DataFrame:
    """Clean, verify, augment, balance, split, sort and format: sequence, nl, formula, complexity, block and split.

    examples: rows of flat(). verdicts: pos and a verdict struct, made beforehand by whatever judges.
    """
    kept, _ = curate.clean(examples)
    if verdicts is not None:
        kept = curate.route_verdicts(kept.join(verdicts, "pos", "left"), F.col("verdict")).where("outcome <> 'rejected'").select(*kept.columns)
    more = augment.augment(kept, "pos", verified=verified)
    keyed = more.withColumn("key", F.sha2(F.concat_ws("|", F.col("pos").cast("string"), F.col("augmentation_type"), F.col("nl"), F.col("formula")), 256))
    classed = keyed.withColumn("complexity", F.coalesce("complexity", F.lit("unknown"))).withColumn("block", F.coalesce("block", F.lit("unknown")))
    even = curate.cap_groups(curate.balance(classed, "complexity", "key", CLASS_SHARES), "block", "key", BLOCK_SHARE)
    split = curate.pattern_split(even)
    seq = format_with_thought(F.col("nl"), F.col("steps"), F.col("formula")) if with_thought else format_plain(F.col("nl"), F.col("formula"))
    order = F.when(F.col("split") == "train", rank_of(F.col("complexity"))).otherwise(F.lit(0))
    return split.withColumn("sequence", seq).withColumn("_o", order).orderBy("split", "_o", hash_order("order", F.col("key"))).select("sequence", "nl", "formula", "complexity", "block", "split")


def evaluation(pairs: DataFrame, generated: bool = False, strict: bool = False) -> dict[str, DataFrame]:
    """metrics, breakdown, confusion and diagnosis of (prediction, reference, complexity, block); `generated` predictions are whole sequences."""
    d = pairs.withColumn("prediction", extract_formula(F.col("prediction"))) if generated else pairs
    scored = metrics.evaluate_pairs(d, strict=strict)
    parts = evaluate.breakdown(scored)
    return {"pairs": scored, "metrics": evaluate.diagnose_batch(evaluate.batch_metrics(scored)), "breakdown": parts, "confusion": evaluate.confusion(scored), "diagnosis": evaluate.diagnose(parts, scored, strict)}


def training_batches(tokens: DataFrame, key: str, epoch: int, schedule: str = "0:0,5:1,15:2", batch: int = 32, most: int = 1024, packing: bool = False) -> DataFrame:
    """Batches of an epoch: its curriculum level's rows, bucketed and padded or packed."""
    level = max((lv for at, lv in curate.parse_schedule(schedule) if at <= epoch), default=0)
    return batching.batches(batching.tokenised(tokens, max_complexity=level), key, "input_ids", batch, most, packing)
