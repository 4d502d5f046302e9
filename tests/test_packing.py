"""Next-fit packing in one order against a sequential pass."""

import random

import pytest

from lemmaflow.operators import packing


def sequential(lengths, most):
    """(bin, first rank, number of rows) of each bin that a loop over all rows makes."""
    bins, used = [], 0
    for i, n in enumerate(lengths):
        if bins and used + n <= most:
            used += n
            bins[-1][1] += 1
        elif not bins:
            bins.append([i, 1])
            used = n
        else:
            bins.append([i, 1])
            used = n
    return [(b, first, n) for b, (first, n) in enumerate(bins)]


@pytest.mark.parametrize(("most", "tokens", "fan"), [(10, 20, 2), (10, 64, 3), (7, 1000, 256), (1, 2, 2)])
def test_bins_equal_one_pass(spark, most, tokens, fan):
    rng = random.Random(most * tokens)
    lengths = [0, 0] + [rng.choice([0, 0, 1, 2, 3, most, max(1, most // 2), rng.randrange(most + 1)]) if most > 1 else rng.randrange(2) for _ in range(700)] + [0, 0]
    lengths = [min(n, most) for n in lengths]
    rows = [(i // 9, i % 9, list(range(1, n + 1))) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "a long, b long, ids array<int>").repartition(6)
    out = {r.bin: r for r in packing.pack_all(df, ["a", "b"], "ids", most, 9, tokens, fan).collect()}
    expected = sequential(lengths, most)
    assert sorted(out) == [b for b, _, _ in expected]
    for b, first, n in expected:
        ids = [x for i in range(first, first + n) for x in range(1, lengths[i] + 1)]
        docs = [i - first for i in range(first, first + n) for _ in range(lengths[i])]
        r = out[b]
        assert (r.n_docs, r.n_real_tokens) == (n, len(ids))
        assert r.input_ids == ids + [9] * (most - len(ids)) and r.doc_ids == docs + [-1] * (most - len(ids))


def test_packing_of_nothing(spark):
    ddl = "a long, ids array<int>"
    assert packing.pack_all(spark.createDataFrame([], ddl), ["a"], "ids", 8).count() == 0
    assert packing.pack_all(spark.createDataFrame([(1, []), (2, None)], ddl), ["a"], "ids", 8).count() == 0
    one = packing.pack_all(spark.createDataFrame([(1, []), (2, list(range(30))), (3, None)], ddl), ["a"], "ids", 8).first()
    assert (one.bin, one.input_ids, one.n_docs, one.doc_ids) == (0, list(range(8)), 3, [1] * 8)
