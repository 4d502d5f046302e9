"""Formula goldens, parser properties, native folds against the parser's own evaluation."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from lemmaflow.functions import logic, metrics, text
from lemmaflow.operators import augment

VALID_B = ["p → q", "p implies q", "p iff q", "p1 ∧ var_2", "p ∧ Q", "notify", "simplies"]
INVALID_B = ["", "p → → q", "p ∧ (q → r", "order", "android", "iffy", "NOT p", "p v q", "p'", "p < -> q", "p q", ")", "¬"]


def test_validity():
    assert all(logic.analyse(f)[0] for f in VALID_B) and not any(logic.analyse(f)[0] for f in INVALID_B)
    assert logic.analyse("p ∧ Q")[3] == ["p", "q"] and logic.analyse(None)[0] is False
    got = {f: logic.check_a(f) for f in ("p'", "p implies q", "p ∧ Q", "p < -> q", "pq", "ñ ∨ p2")}
    assert {f: v for f, (v, _) in got.items()} == {"p'": True, "p implies q": False, "p ∧ Q": False, "p < -> q": True, "pq": False, "ñ ∨ p2": True}


def same(a, b):
    return logic.analyse(a)[7] == logic.analyse(b)[7]


def test_equivalence():
    for a, b in [("p ∧ q", "q ∧ p"), ("¬(p ∧ q)", "¬p ∨ ¬q"), ("p → q", "¬p ∨ q"), ("p ∨ ¬p", "q ∨ ¬q"), ("P", "p")]:
        assert same(a, b)
    for a, b in [("p ∧ q", "p ∨ q"), ("(p → q) → r", "p → (q → r)"), ("p", "q")]:
        assert not same(a, b)


@pytest.mark.parametrize(("raw", "want"), [("q ∧ p", "p ∧ q"), ("¬¬p", "p"), ("¬¬¬p", "¬p"), ("(q ∨ p) ∧ r", "(p ∨ q) ∧ r"), ("¬(q ∨ p) ↔ p", "p ↔ ¬(p ∨ q)"), ("(p → q) → r", "p → q → r"), ("p → (q → r)", "p → q → r"), (" ?? ", "??")])
def test_canonical(raw, want):
    assert logic.analyse(raw)[6] == want


def test_strict_printing_keeps_grouping():
    assert logic.analyse("(p → q) → r", True)[6] == "(p → q) → r" and logic.analyse("p → (q → r)", True)[6] == "p → q → r"


def test_lists_and_credit():
    assert logic.analyse("(p ∧ q) → ¬r")[4] == ["∧", "→", "¬"]
    assert logic.subformulas(logic.parse_b("(p ∧ q) → (r ∨ ¬s)")) == ["p ∧ q", "¬s", "r ∨ ¬s", "p ∧ q → r ∨ ¬s"]
    for a, b, want in [("p ∧ q → r", "p ∧ q → s", 0.8), ("q ∧ p", "p ∧ q", 1.0), ("p → q", "q → p", 1 / 3), ("¬p", "p", 0.0), ("p", "(p ∧ q) → (r ∨ s)", 0.0), ("p (", "p", 0.0)]:
        assert logic.credit(a, b) == pytest.approx(want)


def random_tree(rng, depth, atoms="pqrstu"):
    if depth == 0 or rng.random() < 0.2:
        return ("atom", rng.choice(atoms))
    op = rng.choice("¬∧∨→↔")
    return (op, random_tree(rng, depth - 1, atoms)) if op == "¬" else (op, random_tree(rng, depth - 1, atoms), random_tree(rng, depth - 1, atoms))


def value(t, a):
    if t[0] == "atom":
        return a[t[1]]
    x = [value(s, a) for s in t[1:]]
    return {"¬": lambda: not x[0], "∧": lambda: x[0] and x[1], "∨": lambda: x[0] or x[1], "→": lambda: not x[0] or x[1], "↔": lambda: x[0] == x[1]}[t[0]]()


def test_random_formulas(spark):
    rng = random.Random(1)
    trees = [random_tree(rng, 4) for _ in range(120)]
    for t in trees:
        again = logic.parse_b(logic.show(t, True))
        assert logic.signature(again) == logic.signature(t)
        n = logic.show(logic.canonical(t, True), True)
        assert logic.signature(logic.parse_b(n)) == logic.signature(t)
        atoms = sorted(logic.names(t))
        rows = [value(t, dict(zip(atoms, bits))) for bits in product([False, True], repeat=len(atoms))]
        assert logic.truth_bits(t, atoms) == sum(bool(v) << i for i, v in enumerate(rows))
    for a, b in zip(trees, trees[1:]):
        atoms = sorted(logic.names(a) | logic.names(b))
        equal = all(value(a, dict(zip(atoms, bits))) == value(b, dict(zip(atoms, bits))) for bits in product([False, True], repeat=len(atoms)))
        assert (logic.signature(a) == logic.signature(b)) == equal
    df = spark.createDataFrame([(i, logic.show(t, True)) for i, t in enumerate(trees[:40])], "i int, formula string")
    table = logic.truth_table(df).collect()
    assert all(r.value == value(trees[r.i], r.assignment) for r in table)
    assert len(table) == sum(2 ** len(logic.names(t)) for t in trees[:40])
    p = df.withColumn("p", logic.parsed("formula"))
    masks = {r.i: r.m for r in p.select("i", logic.truth_words(F.col("p.rpn"), F.array(*map(F.lit, "pqrstu"))).alias("m")).collect()}
    for i in range(39):
        assert len(masks[i]) == 1 and (masks[i] == masks[i + 1]) == (logic.signature(trees[i]) == logic.signature(trees[i + 1]))


def test_long_formulas_by_signature():
    ring = " ∧ ".join(f"(x{i} ∨ y{i})" for i in range(5))
    assert same(ring, " ∧ ".join(f"(y{i} ∨ x{i})" for i in reversed(range(5))))
    many = [f"a{i}" for i in range(20)]
    ok, _, _, atoms, signs, main, *_ = logic.analyse(" ∧ ".join(many))
    assert ok and atoms == sorted(many) and signs == ["∧"] * 19 and main == "∧"
    assert same(" ∧ ".join(many), " ∧ ".join(reversed(many))) and not same(" ∧ ".join(many), " ∧ ".join(many[1:]))
    assert same(" → ".join(many), " → ".join(many) + " ∨ ¬(z → z)") and not same(" ↔ ".join(many), " ↔ ".join(many[:-1]) + " ↔ ¬a19")
    assert same(f"({' ∨ '.join(many)}) ∧ (z ∨ ¬z)", " ∨ ".join(many))


def test_words_of_many_atoms(spark):
    rng = random.Random(2)
    atoms = [f"x{i}" for i in range(9)]
    trees = [random_tree(rng, 5, atoms) for _ in range(30)]
    df = spark.createDataFrame([(i, logic.show(t, True)) for i, t in enumerate(trees)], "i int, formula string").withColumn("p", logic.parsed("formula"))
    for r in df.select("i", logic.truth_words(F.col("p.rpn"), F.array(*map(F.lit, atoms))).alias("m")).collect():
        assert len(r.m) == 8 and sum((w % (1 << 64)) << 64 * k for k, w in enumerate(r.m)) == logic.truth_bits(trees[r.i], atoms)


def test_messages(spark):
    df = spark.createDataFrame([("p → q",), ("  ",), (None,), ("p → → q",)], "f string").withColumn("p", logic.parsed("f"))
    got = [r.m for r in df.select(logic.validity(F.col("f"), F.col("p")).alias("m")).collect()]
    assert [(m.valid, m.message) for m in got[:3]] == [(True, "OK"), (False, "Formula vacia"), (False, "Formula vacia")] and not got[3].valid and got[3].message not in ("OK", "Formula vacia", "")


def slow_matches(p, r):
    """Pairs of equivalent subformulas, each used once, by truth tables."""
    left = list(p)
    hit = 0
    for x in r:
        for y in left:
            a, b = logic.parse_b(x), logic.parse_b(y)
            atoms = sorted(logic.names(a) | logic.names(b))
            if all(value(a, dict(zip(atoms, bits))) == value(b, dict(zip(atoms, bits))) for bits in product([False, True], repeat=len(atoms))):
                left.remove(y)
                hit += 1
                break
    return hit


def test_subformula_scores_and_verified_rewrites(spark):
    """The two queries without SQL: subformulas against a naive matcher, rewrites against truth tables."""
    rng = random.Random(3)
    trees = [(random_tree(rng, 3), random_tree(rng, 3)) for _ in range(60)]
    rows = [(i, logic.show(a, True), logic.show(b if i % 3 else a, True)) for i, (a, b) in enumerate(trees)]
    for r in metrics.evaluate_pairs(spark.createDataFrame(rows, "i int, prediction string, reference string")).collect():
        p, q = (sorted(set(logic.subformulas(logic.parse_b(x)))) for x in (r.prediction, r.reference))
        want = (slow_matches(p, q) / len(q)) if q else float(not p)
        assert r.comp_subformulas == pytest.approx(want), (r.prediction, r.reference)
        assert r.compositional == pytest.approx((r.comp_atoms + r.comp_subformulas + r.comp_connector + r.comp_full) / 4)
    df = spark.createDataFrame([(i, b) for i, _, b in rows], "i int, formula string")
    made = augment.variants(df, "i", limit=2, verified=True).collect()
    origin = {i: logic.parse_b(b) for i, _, b in rows}
    assert len(made) > 20
    for r in made:
        a, b = origin[r.i], logic.parse_b(r.formula)
        atoms = sorted(logic.names(a) | logic.names(b))
        assert all(value(a, dict(zip(atoms, bits))) == value(b, dict(zip(atoms, bits))) for bits in product([False, True], repeat=len(atoms)))


def test_printed_table(spark):
    df = spark.createDataFrame([("p → q",)], "formula string")
    assert logic.format_truth_table(df).first().table.split("\n") == ["p | q | p → q", "-|-".join(["-", "-", "-----"]), "F | F |   T", "F | T |   T", "T | F |   F", "T | T |   T"]


PAIRS = [("p ∧ q", "q ∧ p"), ("q → p", "p → q"), ("p ∨ q", "p ∨ q"), ("(p ∧ q) → r", "(p ∧ q) → (r ∨ s)"), ("p ∧ q → s", "p ∧ q → r"), ("p ∧ q → r", "p ∨ q → r"), ("p →", "p"), (None, "p")]


def test_pair_metrics(spark):
    out = {r.i: r for r in metrics.evaluate_pairs(spark.createDataFrame([(i, *x) for i, x in enumerate(PAIRS)], "i int, prediction string, reference string")).collect()}
    assert [(out[i].exact_match, out[i].semantic_match, out[i].normalized_match) for i in range(3)] == [(False, True, True), (False, False, False), (True, True, True)]
    c = out[3]
    assert (c.comp_atoms, c.comp_subformulas, c.comp_connector, c.comp_full) == (pytest.approx(6 / 7), pytest.approx(1 / 3), 1.0, 0.0)
    assert out[4].atom_f1 == pytest.approx(2 / 3) and out[5].connector_accuracy == 0.5
    for i in (6, 7):
        assert out[i].semantic_match is None and not out[i].valid_syntax and out[i].partial_credit == 0 and out[i].compositional == 0


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    for raw, want in [("(p∧q)→r", "(p ∧ q) → r"), ("( p ∨  q )", "(p ∨ q)"), ("p<->q", "p < -> q")]:
        assert one(text.normalize_formula(lit(raw))) == want
    assert one(text.normalize_formula(lit("p<->q->r"), True)) == "p <-> q -> r"
    assert one(text.connector_profile(lit("p <-> q"))) == ["→", "↔"] and one(text.atom_count(lit("¬p ∧ q"))) == 1
    assert one(text.formula_pattern(lit("(p1 ∧  ¬q) → r"))) == "(X ∧ ¬X) → X"
    assert [one(text.balanced_parens(lit(x))) for x in ("", "()", ")(", "(()", "a(b)c")] == [True, True, False, False, True]
    assert one(text.extract_formula(lit("x <|formula|> p\n→ q <|eos|> y"))) == "p\n→ q" and one(text.extract_formula(lit("p"))) is None
    for raw, want in [('{"k": 1}', 1), ('```json\n{"k": 2}\n```', 2), ('so: {"k": 3} ok', 3), ("none", None), ("", None)]:
        got = one(text.extract_json(lit(raw), "k int"))
        assert (got.k if got else None) == want
    assert one(text.format_with_thought(lit("s"), F.array(lit("a"), lit(None)), lit("p"))) == "<|bos|><|input|> s <|thought|> a  <|formula|> p<|eos|>"
    assert one(text.capitalize(lit("hELLO"))) == "Hello" and [one(text.length_bucket(lit(n))) for n in (0, 2, 3, 4, 5)] == [f"{x} conectores" for x in ("1-2", "1-2", "3-4", "3-4", "5+")]


def test_capitalize_by_characters(spark):
    """Against DuckDB over every letter of its Unicode version, first and second in a text."""
    import duckdb

    duck = duckdb.connect()
    cases = ["ßheit ΟΔΟΣ", "ΣΑΣ ΣΑΣ.", "ŉA", "ﬁX", "ǆǅ", "ᾳᾼ", "aİI", "İİ", "éÉ", "e\u0301É", "😀A", "", "A", " aB", None, "a\x00ẞ"]
    known = [c for c in map(chr, [*range(1, 0xA7CB), *range(0xF900, 0x10D50)]) if (c.upper() != c or c.lower() != c) and c not in "ƛɤ\u1c89\u1c8a"]  # those have had their pair since Unicode 16
    texts = cases + [c + "b" + c for c in known]
    want = duck.execute("SELECT list_transform(?::VARCHAR[], lambda t: upper(t[1]) || lower(t[2:]))", [texts]).fetchone()[0]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.capitalize(F.col("t")).alias("c")).orderBy("i").collect()
    assert len(known) > 2000 and [r.c for r in got] == want
    assert want[:3] == ["ẞheit οδοσ", "Σασ σασ.", "ŉa"]


REWRITES = [
    ("p → q", "implication→disjunction", "¬(p) ∨ (q)", True), ("(p → q) ∧ r", "implication→disjunction", "¬((p) ∨ (q) ∧ r)", False), ("p → q ↔ r", "implication→disjunction", "¬(p) ∨ (q ↔ r)", False),
    ("¬(p ∧ q)", "de_morgan_and", "(¬p ∨ ¬q)", True), ("¬(p ∧ q ∧ r)", "de_morgan_and", "(¬p ∨ ¬q ∧ r)", False), ("x ∨ ¬(p ∨ q)", "de_morgan_or", "x ∨ (¬p ∧ ¬q)", True),
    ("(p ∧ q) → r", "commutativity", "(q ∧ p) → r", True), ("(p ∨ q ∧ r)", "commutativity", "(r ∧ p ∨ q)", False), ("¬¬p ∨ q", "double_negation_remove", "p ∨ q", True),
]


def test_rewrites(spark):
    df = spark.createDataFrame([(i, f) for i, (f, *_) in enumerate(REWRITES)], "i int, formula string")
    made = {(r.i, r.augmentation_type): r.formula for r in augment.variants(df, "i", limit=None).collect()}
    true = {(r.i, r.augmentation_type): r.formula for r in augment.variants(df, "i", limit=None, verified=True).collect()}
    for i, (_, kind, want, kept) in enumerate(REWRITES):
        assert made[i, kind] == want and ((i, kind) in true) == kept
    assert all(same(REWRITES[i][0], f) for (i, _), f in true.items())
    assert augment.variants(df, "i", limit=2).groupBy("i").count().agg(F.max("count")).first()[0] <= 2
    assert made[0, "double_negation_add"] in ("¬¬p → q", "p → ¬¬q")


def test_composition(spark):
    assert augment.remap("p ∧ q", "p → r") == "r → r" and augment.remap("p ∧ q", "¬p → s") == "¬p → s"
    assert augment.remap("p ∧ q", "p → r", True) == "s → r" and augment.remap("p ∧ q", "¬p → s", True) == "¬r → s" and augment.remap("z", "z") is None
    rows = [(i, f"Frase {i}", f"p{i} ∧ q", "simple") for i in range(5)]
    out = augment.compose(spark.createDataFrame(rows, "i int, nl string, formula string, complexity string"), "i").collect()
    assert len(out) == 2 and all(r.complexity == "advanced" and r.formula.startswith("(") and ". " in r.nl for r in out)
    assert augment.compose(spark.createDataFrame(rows, "i int, nl string, formula string, complexity string").where("false"), "i").count() == 0


def test_long_formulas():
    """No number of operands, parentheses or negations is too many; folds over them don't recurse."""
    n = 100_000
    chain = " ∧ ".join("pqr"[i % 3] for i in range(n))
    a = logic.analyse(chain, False, len(logic.PARSED))
    assert a[0] and len(a[2]) == 2 * n - 1 and a[3] == ["p", "q", "r"] and len(a[4]) == n - 1 and len(a[6]) == 4 * n - 3 and a[7] == logic.analyse("r ∧ (q ∧ p)")[7]
    assert logic.credit(chain, chain) == 1.0 and logic.check_a(chain) == (True, ["p", "q", "r"])
    assert logic.analyse("(" * n + "p" + ")" * n, False, 6)[0] and not logic.analyse("(" * n + "p" + ")" * (n - 1), False, 6)[0]
    right = logic.analyse("→".join(["p"] * 30_000), False, len(logic.PARSED))
    assert right[2][-3:] == ["→"] * 3 and right[7] == "T"
    assert logic.analyse("¬" * 50_001 + "p", False, len(logic.PARSED))[6] == "¬p"


def test_long_formulas_do_not_pile_up():
    """A worker holds no more for many long formulas than for a few."""
    import tracemalloc

    def work(first, last):
        for i in range(first, last):
            a = f"x{i} → " + " ∧ ".join("pqr"[j % 3] for j in range(4000))
            assert logic.analyse(a, False, len(logic.SYNTAX))[0] and logic.meaning(a, f"¬¬({a})")
        return tracemalloc.get_traced_memory()[0] / 1e6

    tracemalloc.start()
    try:
        assert work(0, 150) < 80
        assert work(150, 450) < 80
    finally:
        tracemalloc.stop()


def test_equivalence_of_many_atoms():
    """Diagrams in order of name blow up on these; the search does not."""
    n = 30
    pairs = " ∨ ".join(f"(x{i} ∧ y{i})" for i in range(n))
    denied = "¬(" + " ∧ ".join(f"(y{i} → ¬x{i})" for i in reversed(range(n))) + ")"
    assert logic.signature(logic.parse_b(pairs)) is None
    assert logic.meaning(pairs, denied) is True and logic.meaning(pairs, denied.replace("y7 ", "y8 ")) is False
    many = " ∨ ".join(f"z{i}" for i in range(1500))
    assert logic.meaning(many, " ∨ ".join(f"z{i}" for i in reversed(range(1500)))) is True
    assert logic.meaning("p ∧", "p") is None and logic.meaning(None, "p") is None


def test_solver_against_tables():
    from lemmaflow.functions.solver import Clauses

    rng = random.Random(6)
    for _ in range(400):
        a, b = random_tree(rng, 5), random_tree(rng, 5)
        if rng.random() < 0.5:
            b = logic.canonical(logic.parse_b(logic.show(a, True)))
        c = Clauses()
        x, y = c.formula(logic.nodes(a)), c.formula(logic.nodes(b))
        c.add([x, y])
        c.add([-x, -y])
        atoms = sorted(logic.names(a) | logic.names(b))
        assert c.solve(10**6) == (logic.truth_bits(a, atoms) != logic.truth_bits(b, atoms))


def test_common_length():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("∧∨→") for _ in range(rng.randrange(90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        assert logic.common_length(a, b) == row[-1]
