"""License scans of very many mentions; rolling hashes that don't collide together."""

import random
import time

from pyspark.sql import functions as F

from lemmaflow.llm import chat, licenses


def test_outermost_against_all_pairs():
    rng = random.Random(4)
    for _ in range(300):
        found = [(rng.randrange(3), a, a + 1 + rng.randrange(12), rng.choice("xyz")) for a in (rng.randrange(40) for _ in range(rng.randrange(40)))]
        found.sort(key=lambda d: (d[0], d[1] - d[2], d[1], -len(d[3]), d[3]))
        kept = []
        for d in found:
            if not any(k[1] <= d[1] and d[2] <= k[2] for k in kept):
                kept.append(d)
        assert licenses.outermost(found) == kept


def test_many_mentions():
    some = "licensed under the apache license version 2.0 and the mit license or the gnu general public license . "
    text = some * 3000
    began = time.process_time()
    n_words, n_base, first, last, *_, spans = licenses.scan_text(text)
    assert time.process_time() - began < 60 and len(spans) >= 3000
    one = licenses.scan_text(some * 30)
    assert n_base == 100 * one[1] and len(spans) == len({(s["first_word"], s["last_word"], s["label"], s["priority"]) for s in spans})
    assert [(s["label"], s["first_word"], s["last_word"]) for s in spans[: len(one[-1]) - 9]] == [(s["label"], s["first_word"], s["last_word"]) for s in one[-1][: len(one[-1]) - 9]]
    assert n_words == 100 * one[0] and first == one[2] and last > n_words - 20


def test_rolling_hashes_begin_apart(spark):
    rows = [(c, t, "u", f"text {c} {t}") for c in range(20) for t in range(5)]
    pre = chat.prefixes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert pre.where("h1 = h2").count() == 0
    one = pre.where("i = 1").select(F.xxhash64(F.lit(1), "i", "role", "text").cast("decimal(20,0)").alias("a"), "h1").first()
    assert one.a == one.h1
