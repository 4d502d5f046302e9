"""Aggregates over evaluated pairs: batch metrics, breakdowns, confusions, diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import capitalize, length_bucket
from ..schema import CONNECTORS

MEANS = ("atom_f1", "connector_accuracy", "partial_credit", "comp_atoms", "comp_subformulas", "comp_connector", "comp_full")


def _rate(c: Column) -> Column:
    return F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0.0))


def batch_metrics(pairs: DataFrame) -> DataFrame:
    """One row: rates and means over all pairs; semantic_accuracy over those that can be judged,
    semantic_accuracy_total over all."""
    comp = [F.coalesce(F.avg(c), F.lit(0.0)) for c in MEANS[3:]]
    return pairs.agg(
        F.count("*").alias("n_total"), F.count_if(F.col("valid_syntax")).alias("n_valid"), F.count_if(F.col("semantic_match").isNotNull()).alias("n_evaluable"),
        _rate(F.col("exact_match")).alias("exact_match"), F.coalesce(F.avg(F.col("semantic_match").cast("int")), F.lit(0.0)).alias("semantic_accuracy"),
        _rate(F.col("semantic_match")).alias("semantic_accuracy_total"), _rate(F.col("normalized_match")).alias("normalized_match"), _rate(F.col("valid_syntax")).alias("valid_syntax_rate"),
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in MEANS], ((comp[0] + comp[1] + comp[2] + comp[3]) / 4).alias("compositional"),
    )


def breakdown(pairs: DataFrame, complexity: str = "complexity", block: str = "block") -> DataFrame:
    """dimension, category and metrics: the whole and five dimensions in one pass by grouping sets.

    Rows with an empty complexity or block, or without a main connector, are in no category of that
    dimension. semantic_accuracy is over all rows of the category. Figures are rounded to 4 places.
    """
    d = pairs.withColumns({
        "k_complexity": F.nullif(F.lower(F.col(complexity)), F.lit("")), "k_block": F.nullif(F.lower(F.col(block)), F.lit("")), "k_connector": F.col("ref_main"),
        "k_length": length_bucket(F.col("ref_connectors")), "k_atoms": F.concat(F.col("ref_atoms").cast("string"), F.lit(" átomos")),
    })
    keys = ["k_complexity", "k_block", "k_connector", "k_length", "k_atoms"]
    g = d.groupingSets([[], *[[k] for k in keys]], *keys).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("total"), F.round(_rate(F.col("exact_match")), 4).alias("exact_match"), F.round(_rate(F.col("semantic_match")), 4).alias("semantic_accuracy"),
        F.round(_rate(F.col("normalized_match")), 4).alias("normalized_match"), F.round(_rate(F.col("valid_syntax")), 4).alias("valid_syntax"),
        *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c) for c in (*MEANS[:3], "compositional")],
    )
    bit = {k: (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i)) for i, k in enumerate(keys)}
    dim = F.when(F.col("gid") == (1 << len(keys)) - 1, "global")
    for k in keys:
        dim = dim.when(F.col("gid") == bit[k], k[2:])
    value = F.when(F.col("gid") == (1 << len(keys)) - 1, "all").otherwise(F.coalesce(*keys))
    return g.withColumn("dimension", dim).withColumn("category", value).where("category is not null").drop("gid", *keys)


def confusion(pairs: DataFrame, real: str = "ref_main", predicted: str = "pred_main") -> DataFrame:
    """real and one column a predicted connector; pairs without both main connectors are left out."""
    d = pairs.where(F.col(real).isin(*CONNECTORS) & F.col(predicted).isin(*CONNECTORS))
    return d.groupBy(F.col(real).alias("real")).pivot(predicted, list(CONNECTORS)).count().na.fill(0)


def top_confusions(pairs: DataFrame, limit: int = 5, real: str = "ref_main", predicted: str = "pred_main") -> DataFrame:
    d = pairs.where(F.col(real).isin(*CONNECTORS) & F.col(predicted).isin(*CONNECTORS) & (F.col(real) != F.col(predicted)))
    g = d.groupBy(F.col(real).alias("real"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), F.desc("real"), F.desc("predicted")).limit(limit)


def error_class(valid: Column, semantic: Column, partial: Column) -> Column:
    """syntax, near_miss (partial credit above 0.7), semantic, or null for a match."""
    return F.when(~valid, "syntax").when(~F.coalesce(semantic, F.lit(True)) & (partial > 0.7), "near_miss").when(~F.coalesce(semantic, F.lit(True)), "semantic")


def error_examples(pairs: DataFrame, order: str, limit: int = 5) -> DataFrame:
    """The first `limit` errors of each class: a report."""
    d = pairs.withColumn("error_class", error_class(F.col("valid_syntax"), F.col("semantic_match"), F.col("partial_credit"))).where("error_class is not null")
    w = Window.partitionBy("error_class").orderBy(order)
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def first_of_groups(df: DataFrame, by: str, order: str, limit: int = 3) -> DataFrame:
    """The first row (by `order`, which tells rows apart) of each of the first `limit` distinct groups, with `shown` from 1: a report. A null group is the empty one."""
    d = df.withColumn(by, F.coalesce(F.col(by), F.lit("")))
    first = d.groupBy(by).agg(F.min_by(F.struct(*d.columns), order).alias("_r")).select("_r.*").orderBy(order).limit(limit)
    return first.withColumn("shown", F.row_number().over(Window.partitionBy().orderBy(order)))  # at most `limit` rows


def diagnose_batch(metrics: DataFrame) -> DataFrame:
    """The first of syntax, atoms, connectors and semantics that is below 0.8."""
    c = F.when(F.col("valid_syntax_rate") < 0.8, "syntax").when(F.col("atom_f1") < 0.8, "atoms").when(F.col("connector_accuracy") < 0.8, "connectors").when(F.col("semantic_accuracy") < 0.8, "semantics").otherwise("good")
    return metrics.withColumn("diagnosis", c)


def diagnose(parts: DataFrame, pairs: DataFrame, strict: bool = False) -> DataFrame:
    """rule and detail: weak advanced class, weak connectors, loss from few to many atoms, a common confusion.

    Atom categories are in order of their text, where 10 stands before 2; strict orders by number.
    """
    s = F.col("semantic_accuracy")
    advanced = parts.where((F.col("dimension") == "complexity") & (F.col("category") == "advanced") & (s < 0.5)).select(F.lit("advanced").alias("rule"), F.col("category").alias("detail"))
    weak = parts.where((F.col("dimension") == "connector") & (s < 0.7) & (F.col("total") >= 5)).select(F.lit("connector").alias("rule"), F.col("category").alias("detail"))
    key = F.regexp_extract("category", r"^(\d+)", 1).cast("int") if strict else F.col("category")
    ends = parts.where("dimension = 'atoms'").agg(F.min_by(s, key).alias("a"), F.max_by(s, key).alias("b"))
    drop = ends.where("a - b > 0.3").select(F.lit("atoms").alias("rule"), F.format_string("%.4f", F.col("a") - F.col("b")).alias("detail"))
    mixed = top_confusions(pairs, 1).where("n >= 3").select(F.lit("confusion").alias("rule"), F.concat_ws(" as ", "real", "predicted").alias("detail"))
    return advanced.union(weak).union(drop).union(mixed)


# Dimensions in the order of a report, with their names in its document, and categories with an order of their own.
DIMENSIONS = {"global": "global", "complexity": "by_complexity", "connector": "by_connector", "block": "by_block", "length": "by_length", "atoms": "by_n_atoms"}
CATEGORY_ORDER = ("all", "simple", "intermediate", "advanced", "1-2 conectores", "3-4 conectores", "5+ conectores")


def report_rows(parts: DataFrame) -> DataFrame:
    """dimension, category, label, metrics and place of each category of breakdown(), in the order of a printed report.

    Complexities and lengths are in their own order, connectors and blocks by falling accuracy, numbers of atoms by their text.
    """
    dim = F.array_position(F.array(*map(F.lit, DIMENSIONS)), F.col("dimension"))
    own = F.array_position(F.array(*map(F.lit, CATEGORY_ORDER)), F.col("category"))
    by_score = F.when(F.col("dimension").isin("connector", "block"), -F.col("semantic_accuracy")).otherwise(F.lit(0.0))
    fixed = F.when(F.col("dimension").isin("complexity", "length"), own).otherwise(F.lit(0))
    label = F.when(F.col("dimension") == "global", "Global").when(F.col("dimension").isin("complexity", "block"), capitalize(F.col("category"))).otherwise(F.col("category"))
    placed = parts.withColumn("label", label).withColumn("place", F.row_number().over(Window.partitionBy().orderBy(dim, fixed, by_score, "category")))  # one row a category
    return placed.orderBy("place")


def report_document(parts: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row `report`: the whole report as one JSON document: total, global, five dimensions and the confusion matrix."""
    names = ("total", "exact_match", "semantic_accuracy", "valid_syntax", "partial_credit", "atom_f1", "connector_accuracy", "compositional")
    shown = {"valid_syntax": "syntax_valid_rate", "compositional": "compositional_avg"}
    entry = F.struct(F.col("label").alias("name"), *[F.col(c).alias(shown.get(c, c)) for c in names])
    rows = report_rows(parts).select("dimension", "category", "place", entry.alias("e"))
    listed = lambda dim: F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.when(F.col("dimension") == dim, F.struct("place", "category", "e")))), lambda x: F.struct(x.category, x.e)))
    whole = F.max(F.when(F.col("dimension") == "global", F.col("e")))
    doc = rows.agg(F.coalesce(whole["total"], F.lit(0)).alias("total"), whole.alias("global"), *[listed(d).alias(n) for d, n in DIMENSIONS.items() if d != "global"])
    seen = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").alias("v")) for c in CONNECTORS]), lambda x: x.v > 0)
    matrix = confusion(pairs).select(F.struct("real", F.map_from_entries(seen).alias("row")).alias("x"))
    mixed = matrix.agg(F.map_from_entries(F.collect_list("x")).alias("confusion_matrix"))
    return doc.crossJoin(F.broadcast(mixed)).select(F.to_json(F.struct("total", "global", *[n for d, n in DIMENSIONS.items() if d != "global"], "confusion_matrix")).alias("report"))
