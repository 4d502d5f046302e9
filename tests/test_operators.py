"""Curation, ranking, batching, vocabulary, files and streaming."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lemmaflow.functions import vectors
from lemmaflow.operators import batching, curate, evaluate, ranking, vocabulary
from lemmaflow.schema import SPECIAL_TOKENS
from lemmaflow.sources import files
from lemmaflow.streaming import resume


def test_ranks_and_sums_match_a_plain_window(spark):
    rows = [(i, "ab"[i % 2] if i % 5 else None, i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, g string, v int")
    got = ranking.shuffled(df, "t", "i", ["g"]).collect()
    import hashlib

    h = lambda i: hashlib.md5(f"42|t|{i}".encode()).hexdigest()  # noqa: E731, S324
    for g in ("a", "b", None):
        mine = sorted((r.i for r in got if r.g == g), key=h)
        assert {r.i: r["rank"] for r in got if r.g == g} == {i: k for k, i in enumerate(mine, 1)}
    s = ranking.running_sum(df, [F.col("i")], F.floor(F.col("i") / 7), F.col("v")).orderBy("i").collect()
    assert [r.before for r in s] == [sum(v for _, _, v in rows[:k]) for k in range(200)]
    assert ranking.shuffled(df.where("false"), "t", "i").count() == 0


def test_clean(spark):
    rows = [
        (0, "Uno", "p → q", "", ["p", "q"]), (1, " uno ", "p→q", "", ["p", "q"]), (2, "dos", "p → → q", "p -> q", ["p", "q"]), (3, "tres", "p → →", "", ["p"]),
        (4, "cuatro", "p ∧ q", "", ["p"]), (5, "cinco", "p ∧ q ∧ r", "", ["p", "q", "r", "s"]), (6, "seis", "(p", "", ["p"]), (7, "siete", "p", "", []),
    ]
    df = spark.createDataFrame(rows, "pos long, nl string, formula string, formula_ascii string, declared_atoms array<string>")
    kept, stats = curate.clean(df, max_trivial=1.0)
    assert {r.pos for r in kept.collect()} == {0, 2, 5}
    s = stats.first()
    assert (s.total_input, s.invalid_syntax, s.unbalanced_parens, s.inconsistent_atoms, s.duplicates_removed, s.trivial_filtered, s.total_output) == (8, 2, 0, 2, 1, 0, 3)
    assert curate.clean(df, strict=True)[1].first().unbalanced_parens == 1
    assert curate.clean(df.where("false"))[1].first().total_output == 0


def test_verdicts(spark):
    v = [None, {"is_correct": True}, {"is_correct": False, "confidence": 0.7, "corrected_formula": "p ∨ q"}, {"is_correct": False, "confidence": 0.69, "corrected_formula": "p ∨ q"}, {"is_correct": False, "confidence": 0.9, "corrected_formula": ""}]
    df = spark.createDataFrame([(i, "p", json.dumps(x) if x else "error") for i, x in enumerate(v)], "i int, formula string, reply string").withColumn("v", curate.parse_verdicts(F.col("reply")))
    out = curate.route_verdicts(df, F.col("v")).orderBy("i").collect()
    assert [r.outcome for r in out] == ["api_error", "verified", "corrected", "rejected", "rejected"] and out[2].formula == "p ∨ q" and out[1].confidence == 1.0


def test_split_is_a_partition(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 37)
    out = curate.group_split(df, F.col("g"))
    assert out.count() == 500 and out.groupBy("g").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0] == 1
    n = dict(out.groupBy("split").count().collect())
    assert 400 <= n["train"] < 420 and set(n) == {"train", "val", "test"}


def test_schedule_and_blocks(spark):
    s = curate.parse_schedule("0:0,5:1,15:2")
    df = spark.createDataFrame([(e,) for e in (0, 4, 5, 14, 15, 99)], "e int")
    assert [r[0] for r in df.select(curate.curriculum_level(F.col("e"), s)).collect()] == [0, 0, 1, 1, 2, 2]
    df = spark.createDataFrame([(i,) for i in (0, 499, 500, 2499, 9999)], "i int")
    assert [r[0] for r in df.select(curate.block_of(F.col("i"))).collect()] == [0, 0, 1, 4, 4]


def test_packing_and_masks(spark):
    lens = spark.createDataFrame([([30, 25, 40, 50, 90],)], "n array<int>")
    assert lens.select(batching.next_fit(F.col("n"), 128)).first()[0] == [0, 0, 0, 1, 2]
    df = spark.createDataFrame([(0, [1, 7, 2]), (1, [1, 2])], "o int, ids array<int>")
    p = batching.pack(df, F.lit(0), "o", "ids", 6).withColumn("t", batching.packed_targets(F.col("input_ids"), F.col("doc_ids"))).first()
    assert p.input_ids == [1, 7, 2, 1, 2, 0] and p.doc_ids == [0, 0, 0, 1, 1, -1] and p.t == [7, 2, -100, 2, -100, -100] and (p.n_docs, p.n_real_tokens) == (2, 5)
    full = batching.pack(df.where("o = 0"), F.lit(0), "o", "ids", 3)
    assert full.select(batching.packed_targets(F.col("input_ids"), F.col("doc_ids"))).first()[0] == [7, 2, 0]
    assert full.select(batching.packed_targets(F.col("input_ids"), F.col("doc_ids"), strict=True)).first()[0] == [7, 2, -100]
    d = batching.padded(df.withColumn("b", F.lit(0)), ["b"], "ids").orderBy("o").collect()
    assert [(r.padded, r.targets, r.attention) for r in d] == [([1, 7, 2], [7, 2, -100], [1, 1, 1]), ([1, 2, 0], [2, -100, -100], [1, 1, 0])]
    places = spark.createDataFrame([(0, i, x) for i, x in enumerate([0, 0, 0, 1, 1, 2, 2, -1])], "s int, i int, d int")
    assert batching.mask_pairs(places, "s", "i", "d").count() == 12


def test_lengths(spark):
    s = batching.length_stats(spark.range(100).withColumnRenamed("id", "length")).first()
    assert (s.n, s.min, s.max, s["median"], s.p95, s.p99) == (100, 0, 99, 50, 95, 99)
    assert batching.length_stats(spark.range(0).withColumnRenamed("id", "length")).first()["min"] is None
    b = batching.length_buckets(spark.range(95).withColumn("n", F.col("id") % 9), "n", "id", 4, 5, True)
    assert {r["count"] for r in b.groupBy("bucket", "batch").count().collect()} == {4}
    rows = spark.createDataFrame([(i, list(range(1 + i % 7))) for i in range(40)], "k int, ids array<int>").withColumn("complexity", F.lit("simple"))
    packed = batching.batches(rows, "k", "ids", 4, 16, packing=True, shard_rows=8)
    assert packed.agg(F.sum("n_real_tokens")).first()[0] == sum(1 + i % 7 for i in range(40))
    assert batching.batches(rows, "k", "ids", 4, 16).count() == 40


def test_vocabulary(spark, tmp_path):
    df = spark.createDataFrame([("el gato y el gato negro",), ("la gata el año",), (None,)], "t string")
    merges = vocabulary.train(df, "t", 30)
    v = vocabulary.Vocabulary(merges)
    assert vocabulary.train(df, "t", 30, segments=2) == merges
    assert len(merges) >= 5 and len(v) == len(SPECIAL_TOKENS) + 256 + len(merges) and v.broken_specials() == []
    t = "<|bos|> el gato ñandú 12 <|eos|>"
    ids = v.encode(t)
    assert v.decode(ids, skip_special=False) == t and v.decode(ids) == " el gato ñandú 12 " and v.token_of(v.id_of("<|pad|>")) == "<|pad|>" and v.token_of(10**6) is None
    out = vocabulary.decode_column(vocabulary.encode_column(df, v, "t"), v, "input_ids").collect()
    assert [r.decoded for r in out] == [r.t or "" for r in out]
    files.write_vocabulary(spark, merges, f"{tmp_path}/v")
    assert files.read_vocabulary(spark, f"{tmp_path}/v") == merges


def slow_merges(texts, merges, min_frequency=2):
    """Merges by counting all pairs anew each time."""
    import unicodedata
    from collections import Counter

    import regex

    n = Counter(w for t in texts for w in regex.findall(vocabulary.SPLIT, unicodedata.normalize("NFC", t)))
    table = {w: [f"{b:02X}" for b in w.encode()] for w in n}
    out = []
    while len(out) < merges:
        pairs = Counter()
        for w, p in table.items():
            for x in zip(p, p[1:]):
                pairs[x] += n[w]
        if not pairs:
            break
        best = min(pairs, key=lambda x: (-pairs[x], x))
        if pairs[best] < min_frequency:
            break
        out.append(best)
        for w, p in table.items():
            q = []
            while p:
                q.append("".join(p[:2]) if tuple(p[:2]) == best else p[0])
                p = p[2 if tuple(p[:2]) == best else 1 :]
            table[w] = q
    return out


def test_rounds_of_equal_counts():
    """Many pairs of one count, of which a round takes only the first: same merges as all at once, whatever is cut."""
    rng = random.Random(2)
    for _ in range(300):
        words = [([rng.choice("abcd") for _ in range(rng.randrange(2, 7))], rng.choice([1, 1, 2])) for _ in range(rng.randrange(2, 9))]
        whole = vocabulary.merge_symbols((([*p], n) for p, n in words), 10**6)
        parts, got = [([*p], n) for p, n in words], []
        while True:
            counts: dict = {}
            for p, n in parts:
                for x in zip(p, p[1:], strict=False):
                    counts[x] = counts.get(x, 0) + n
            take = rng.randrange(1, 5)
            top = sorted(((p, n) for p, n in counts.items() if n >= 2), key=lambda x: (-x[1], x[0]))[: take + 1]
            if not top:
                break
            hot, least, tied = vocabulary._hot(top, take, 2)
            pieces = []
            for p, n in parts:
                run = [p[0]]
                for x, y in zip(p, p[1:], strict=False):
                    if (x, y) not in hot:
                        pieces.append((run, n))
                        run = []
                    run.append(y)
                pieces.append((run, n))
            new = vocabulary.merge_symbols(pieces, 10**6, least, max(hot) if tied else None)
            assert new
            got += new
            rank = {p: i for i, p in enumerate(new)}
            parts = [(vocabulary.merged(p, rank), n) for p, n in parts]
        assert got == whole


def test_training_against_plain_counts(spark):
    texts = ["It's the  cat's hat\n\n that we've   seen, isn't it? 12 345 aaaa aaaaa", "  the cat sat\tthere  ", "ño niño; año", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert vocabulary.train(df, "t", 60) == slow_merges(texts, 60)
    import regex

    rng = random.Random(9)
    many = [" ".join("".join(rng.choice("abcab") for _ in range(rng.randrange(1, 9))) for _ in range(40)) for _ in range(12)]
    log: list = []
    assert vocabulary.train(spark.createDataFrame([(t,) for t in many], "t string"), "t", 90, segments=25, log=log) == slow_merges(many, 90)
    assert len(log) > 3 and all(n <= 25 for _, n, _ in log) and sum(m for *_, m in log) == 90
    words = df.select(F.explode(vocabulary.words(F.col("t"))).alias("w")).collect()
    assert sorted(r.w for r in words) == sorted(w for t in texts for w in regex.findall(vocabulary.SPLIT, t))


def test_examples_over_files(spark, tmp_path):
    ex = {"natural_language_input": "a", "complexity": "simple", "output": {"formula": "p"}, "block": "b"}
    for name, k in (("b.json", 2), ("a.json", 3)):
        (tmp_path / name).write_text(json.dumps({"examples": [ex] * k} if k == 2 else [ex] * k))
    assert sorted(r.pos for r in files.read_examples(spark, str(tmp_path)).collect()) == [0, 1, 2, 1 << 40, (1 << 40) + 1]


def test_report(spark):
    from lemmaflow.functions import metrics

    rows = [(i, "p ∧ q", "p ∨ q" if i % 2 else "p ∧ q", ("advanced", "simple")[i % 2], "x") for i in range(8)]
    p = metrics.evaluate_pairs(spark.createDataFrame(rows, "i int, prediction string, reference string, complexity string, block string"))
    parts = evaluate.breakdown(p)
    placed = [(r.dimension, r.label) for r in evaluate.report_rows(parts).collect()]
    assert placed == [("global", "Global"), ("complexity", "Simple"), ("complexity", "Advanced"), ("connector", "∧"), ("connector", "∨"), ("block", "X"), ("length", "1-2 conectores"), ("atoms", "2 átomos")]
    doc = json.loads(evaluate.report_document(parts, p).first().report)
    assert list(doc) == ["total", "global", "by_complexity", "by_connector", "by_block", "by_length", "by_n_atoms", "confusion_matrix"]
    assert doc["total"] == 8 and doc["global"]["semantic_accuracy"] == 0.5 and list(doc["by_complexity"]) == ["simple", "advanced"]
    assert doc["confusion_matrix"] == {"∧": {"∧": 4}, "∨": {"∧": 4}} and doc["by_connector"]["∧"]["exact_match"] == 1.0 and "compositional_avg" in doc["global"]
    assert json.loads(evaluate.report_document(evaluate.breakdown(p.where("false")), p.where("false")).first().report)["total"] == 0


def test_composed_thoughts(spark):
    from lemmaflow.operators import augment

    ex = [(i, f"Frase {i}", f"p{i} ∧ q", "simple", {"reasoning_steps": [{"step": 1, "explanation": "x"}], "identified_atoms": [{"atom": f"p{i}", "definition": "d"}], "identified_connectors": [{"connector": "∧", "natural_language_cue": "y"}]}) for i in range(4)]
    from lemmaflow.schema import EXAMPLE_DDL, schema

    thought = schema(EXAMPLE_DDL)["thought"].dataType.simpleString()
    df = spark.createDataFrame(ex, f"i int, nl string, formula string, complexity string, thought {thought}")
    out = augment.compose(df, "i").collect()
    assert len(out) == 2
    for r in out:
        assert [s.explanation for s in r.thought.reasoning_steps] == ["Composición de dos proposiciones"] and len(r.thought.identified_atoms) == 2
        middle = r.thought.identified_connectors[1]
        assert len(r.thought.identified_connectors) == 3 and middle.connector == r.connector and middle.natural_language_cue in augment.CUES[r.connector]


def test_files(spark, tmp_path):
    ex = {"natural_language_input": "a", "complexity": "simple", "thought": {"reasoning_steps": [{"step": 1, "explanation": "x"}]}, "output": {"formula": "p ∧ q"}, "block": "b"}
    (tmp_path / "d.json").write_text(json.dumps({"examples": [ex, ex]}, ensure_ascii=False))
    (tmp_path / "l.json").write_text(json.dumps([ex]))
    assert [r.pos for r in files.read_examples(spark, f"{tmp_path}/d.json").collect()] == [0, 1]
    assert files.read_examples(spark, f"{tmp_path}/l.json").first().output.formula == "p ∧ q"
    (tmp_path / "x.jsonl").write_text('{"sequence": "s"}\n\n  \n{"sequence": "t"}\n')
    assert files.read_corpus(spark, f"{tmp_path}/x.jsonl").where("sequence is not null").count() == 2 and files.count_examples(spark, f"{tmp_path}/x.jsonl").first().n == 2
    assert files.read_progress(spark, f"{tmp_path}/none", "a int").count() == 0
    df = spark.createDataFrame([("train", "ñ"), ("val", None)], "split string, s string")
    files.write_splits(df, f"{tmp_path}/splits")
    assert {x for x in os.listdir(f"{tmp_path}/splits") if x.startswith("split")} == {"split=train", "split=val"}
    files.write_examples(df, df.groupBy().count(), f"{tmp_path}/out")
    assert files.read_progress(spark, f"{tmp_path}/out/stats", "count long").first()["count"] == 2
    got = files.generate(spark.createDataFrame([("a",), ("b",)], "topic string"), lambda r: r["topic"] * 2).collect()
    assert {(r.topic, r.reply) for r in got} == {("a", "aa"), ("b", "bb")}
    assert files.packable("src/a.py", {"data"}, (".pyc",)) and not files.packable("data/a.py", {"data"}, (".pyc",))


def test_ingest_repeats_nothing(spark, tmp_path):
    src, out, chk = (f"{tmp_path}/{x}" for x in ("in", "out", "chk"))
    os.makedirs(src)
    run = lambda: resume.ingest(spark, src, "id int, f string", out, chk, lambda d: d["id"].cast("string"), lambda d: d.withColumn("ok", F.col("id") % 2 == 0)).awaitTermination()
    with open(f"{src}/a.json", "w") as f:
        f.write('{"id": 1, "f": "p"}\n{"id": 2, "f": "q"}\n')
    run()
    with open(f"{src}/b.json", "w") as f:
        f.write('{"id": 2, "f": "q"}\n{"id": 3, "f": "r"}\n')
    run()
    run()
    assert sorted(r.id for r in spark.read.json(out).collect()) == [1, 2, 3]
    assert [files.backoff(i, OSError()) for i in range(3)] == [1, 2, 4] and files.backoff(1, OSError("HTTP 429")) == 20


def test_reports(spark):
    from lemmaflow.functions import metrics

    rows = [(i, "p ∧ q", "p ∨ q" if i % 2 else "p ∧ q", "Advanced", "" if i else "x") for i in range(8)]
    p = metrics.evaluate_pairs(spark.createDataFrame(rows, "i int, prediction string, reference string, complexity string, block string"))
    m = evaluate.diagnose_batch(evaluate.batch_metrics(p)).first()
    assert m.n_total == 8 and m.semantic_accuracy == 0.5 and m.diagnosis == "connectors"
    parts = evaluate.breakdown(p)
    assert {(r.dimension, r.category): r.total for r in parts.collect()} == {("global", "all"): 8, ("complexity", "advanced"): 8, ("block", "x"): 1, ("connector", "∧"): 4, ("connector", "∨"): 4, ("length", "1-2 conectores"): 8, ("atoms", "2 átomos"): 8}
    assert {(r.rule, r.detail) for r in evaluate.diagnose(parts, p).collect()} == {("confusion", "∨ as ∧")}
    assert evaluate.error_examples(p, "i", 2).count() == 2 and evaluate.report_rows(parts).count() == 7
    none = evaluate.batch_metrics(p.where("false")).first()
    assert none.n_total == 0 and none.exact_match == 0


def test_vectors(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    v = F.array(*[F.lit(float(x)) for x in (3, -1, 3)])
    assert [(t["index"], t.value) for t in one(vectors.top_k(v, 2))] == [(0, 3.0), (2, 3.0)]
    assert sum(one(vectors.softmax(v))) == pytest.approx(1) and one(vectors.silu(F.lit(0.0))) == 0 and one(vectors.perplexity(F.lit(0.0))) == 1


def test_calls_that_fail(spark):
    """Tries, waits and failures of each row; no more calls at once than asked for."""
    ddl = "i long, j long"
    rows = [(i, i % 5) for i in range(60)]

    def call(row, attempt):
        if attempt < row["j"]:
            raise OSError(f"no {row['i']} {attempt}" + (" HTTP 429" if row["i"] % 2 else ""))
        return f"r{row['i']}"

    out = files.generate(spark.createDataFrame(rows, ddl).repartition(3), call, tries=3, in_flight=2, wait=lambda s: None).orderBy("i").collect()
    for r, (i, j) in zip(out, rows, strict=True):
        waits = [10 * (k + 1) if i % 2 else 2**k for k in range(min(j, 2))]
        assert (r.reply, r.tries, r.waited) == (f"r{i}" if j < 3 else None, min(j + 1, 3), float(sum(waits)))
        assert r.failure == (None if j < 3 else f"no {i} 2" + (" HTTP 429" if i % 2 else ""))
    assert files.generate(spark.createDataFrame([], ddl), call).count() == 0


def test_epoch_order_is_a_permutation():
    for n in (1, 2, 3, 10, 97, 1000, 4097):
        for epoch in (0, 1):
            got = batching.permuted(range(n), n, 7, epoch)
            assert sorted(got.tolist()) == list(range(n))
    assert batching.permuted(range(500), 500, 7, 0).tolist() != batching.permuted(range(500), 500, 7, 1).tolist()
