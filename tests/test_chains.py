"""The routes from end to end."""

import json

from pyspark.sql import functions as F

from lemmaflow.plans import chains


def test_requests_and_replies(spark):
    r = chains.generation_requests(spark, 60, [["a", "b"], ["c"], ["d", "e", "f"]], 20).collect()
    assert [x.block for x in r] == [0] * 20 + [1] * 20 + [2] * 20 and {x.topic for x in r if x.block == 1} == {"c"} and {x.complexity for x in r if x.block == 2} <= {"intermediate", "advanced"}
    good = {"natural_language_input": "una frase con veinte letras", "complexity": "odd", "thought": {}, "output": {"formula": "p"}}
    short = dict(good, natural_language_input="corta")
    df = spark.createDataFrame([(0, "simple", "```json\n" + json.dumps(good) + "\n```"), (1, "simple", json.dumps(short)), (2, "simple", "no")], "i int, complexity string, reply string")
    out = chains.parse_replies(df).collect()
    assert [(x.i, x.complexity) for x in out] == [(0, "simple")]


def test_curation(spark):
    shapes = ["a → b", "a ∧ b ∧ c", "(a ∨ b) → ¬c", "¬(a ∧ b) ∨ c", "a ↔ (b ∨ c)"]
    rows = [(i, f"Frase numero {i}", shapes[i % 5], "", list("abc"), ["paso"], ("simple", "intermediate", "advanced")[i % 3], f"b{i % 6}") for i in range(150)]
    df = spark.createDataFrame(rows, "pos long, nl string, formula string, formula_ascii string, declared_atoms array<string>, steps array<string>, complexity string, block string")
    verdicts = df.select("pos", F.when(F.col("pos") < 10, F.struct(F.lit(False).alias("is_correct"), F.lit(0.1).alias("confidence"), F.lit("").alias("corrected_formula"))).otherwise(F.struct(F.lit(True).alias("is_correct"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("corrected_formula"))).alias("verdict"))
    out = chains.curation(df, verdicts).toPandas()
    assert set(out.split) <= {"train", "val", "test"} and len(out) > 50 and out.sequence.str.startswith("<|bos|><|input|> ").all()
    assert not any(f"Frase numero {i} " in s for s in out.sequence for i in range(10) if " numero" in s and s.count("Frase") == 1)
    assert chains.curation(df.where("false")).count() == 0


def test_evaluation_and_batches(spark):
    df = spark.createDataFrame([("<|formula|> p → q <|eos|>", "¬p ∨ q", "simple", "x"), ("nothing", "p", "simple", "x")], "prediction string, reference string, complexity string, block string")
    e = chains.evaluation(df, generated=True)
    m = e["metrics"].first()
    assert (m.n_total, m.n_valid, m.semantic_accuracy, m.semantic_accuracy_total) == (2, 1, 1.0, 0.5)
    assert e["breakdown"].count() == 7 and e["confusion"].count() == 1 and e["diagnosis"].count() == 0
    t = spark.createDataFrame([(i, list(range(i % 9 + 1)), ("simple", "advanced")[i % 2]) for i in range(40)], "k int, input_ids array<int>, complexity string")
    assert chains.training_batches(t, "k", 0, batch=4).count() == 20 and chains.training_batches(t, "k", 20, batch=4).count() == 40
    assert chains.training_batches(t, "k", 0, most=64, packing=True).agg(F.sum("n_docs")).first()[0] == 20
