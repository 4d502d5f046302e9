"""Array arithmetic of the model's small numeric functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def rmsnorm(v: Column, eps: float = 1e-6) -> Column:
    scale = F.sqrt(total(F.transform(v, lambda x: x * x)) / F.size(v) + eps)
    return F.transform(v, lambda x: x / scale)


def soft_cap(v: Column, cap: float) -> Column:
    return F.transform(v, lambda x: cap * F.tanh(x / cap))


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / total(e))


def logsumexp(v: Column) -> Column:
    top = F.array_max(v)
    return top + F.log(total(F.transform(v, lambda x: F.exp(x - top))))


def z_loss(v: Column) -> Column:
    return F.pow(logsumexp(v), F.lit(2.0))


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def top_k(v: Column, k: int) -> Column:
    """The k largest entries as structs of value and index (from 0), largest first; ties in order of index."""
    marked = F.transform(v, lambda x, i: F.struct((-x).alias("m"), i.alias("index")))
    return F.transform(F.slice(F.array_sort(marked), 1, k), lambda s: F.struct((-s.m).alias("value"), s["index"].alias("index")))
