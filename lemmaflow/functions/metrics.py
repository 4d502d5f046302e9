"""Metrics of a predicted formula against its reference, from one comparison of each pair."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import logic
from .text import squeeze


PAIR = T.StructType(
    [T.StructField(n, T.BooleanType()) for n in ("p_valid", "r_valid", "same_meaning", "same_form")]
    + [T.StructField(n, T.IntegerType()) for n in ("p_atoms", "r_atoms", "common_atoms", "p_connectors", "r_connectors", "common_connectors", "p_subs", "r_subs", "common_subs")]
    + [T.StructField(n, T.StringType()) for n in ("p_main", "r_main")]
    + [T.StructField("credit", T.DoubleType())]
)


@logic.remembered(4_000_000)
def compare(prediction: str | None, reference: str | None, strict: bool = False) -> tuple:
    """The fields of PAIR: what two formulas are and have in common. Each distinct formula is parsed once."""
    p, r = logic.analyse(prediction, strict), logic.analyse(reference, strict)
    both = p[0] and r[0]
    means = None
    if both:
        means = p[7] == r[7] if p[7] is not None and r[7] is not None else logic.meaning(prediction, reference)
    size = lambda x: len(x or ())
    atoms = len(set(p[3]) & set(r[3])) if both else 0
    signs = logic.common_length(p[4], r[4]) if both else 0
    subs = sum((Counter(p[9]) & Counter(r[9])).values()) if both else 0
    return (p[0], r[0], means, p[6] is not None and p[6] == r[6], size(p[3]), size(r[3]), atoms, size(p[4]), size(r[4]), signs, size(p[9]), size(r[9]), subs, p[5], r[5], logic.credit(prediction, reference))


def _comparer(strict: bool):
    @F.pandas_udf(PAIR)
    def compared(predictions: pd.Series, references: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compare(p, r, strict) for p, r in zip(predictions, references)], columns=PAIR.names).astype(object)

    return compared


compared, compared_strict = _comparer(False), _comparer(True)


def evaluate_pairs(df: DataFrame, prediction: str = "prediction", reference: str = "reference", strict: bool = False) -> DataFrame:
    """df with one column a metric. A pair goes through Python once; what it gives are numbers, from which the metrics follow."""
    d = df.withColumn("_m", (compared_strict if strict else compared)(F.col(prediction), F.col(reference))).select(*df.columns, "_m.*")
    both, c = F.col("p_valid") & F.col("r_valid"), F.col
    share = lambda hit, of: F.when(both, F.when(c(of) > 0, c(hit) / c(of)).otherwise(0.0)).otherwise(0.0)
    none = lambda own: F.when(c(own) == 0, 1.0).otherwise(0.0)
    d = d.withColumns({"atom_precision": share("common_atoms", "p_atoms"), "atom_recall": share("common_atoms", "r_atoms")})
    total = F.col("atom_precision") + F.col("atom_recall")
    f1 = F.when(total > 0, 2 * F.col("atom_precision") * F.col("atom_recall") / total).otherwise(0.0)
    out = d.withColumns({
        "exact_match": F.coalesce(squeeze(F.col(prediction)) == squeeze(F.col(reference)), F.lit(False)),
        "semantic_match": c("same_meaning"),
        "normalized_match": c("same_form"),
        "valid_syntax": c("p_valid"),
        "atom_f1": f1,
        "connector_accuracy": F.when(both, F.when(c("r_connectors") == 0, none("p_connectors")).otherwise(c("common_connectors") / c("r_connectors"))).otherwise(0.0),
        "partial_credit": c("credit"),
        "comp_atoms": f1,
        "comp_subformulas": F.when(both, F.when(c("r_subs") == 0, none("p_subs")).otherwise(c("common_subs") / c("r_subs"))).otherwise(0.0),
        "comp_connector": F.when(both & c("p_main").eqNullSafe(c("r_main")), 1.0).otherwise(0.0),
        "comp_full": F.when(c("same_meaning"), 1.0).otherwise(0.0),
        "ref_main": c("r_main"), "ref_connectors": c("r_connectors"), "ref_atoms": c("r_atoms"), "pred_main": c("p_main"),
    })
    out = out.withColumn("compositional", (F.col("comp_atoms") + F.col("comp_subformulas") + F.col("comp_connector") + F.col("comp_full")) / 4)
    return out.drop(*[n for n in PAIR.names if n not in df.columns])
