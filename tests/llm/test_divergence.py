"""Source divergence against exact arithmetic over all terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lemmaflow.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(rows, min_docs, k):
    groups, langs, df = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = words(text)
        groups[lang or "", source or ""].update(found)
        langs[lang or ""].update(found)
        df[lang or ""].update(set(found))
    out = []
    kept = {x: [t for t, n in df[x].items() if n >= min_docs] for x in langs}
    prob = lambda c, n, v: 1 + 10**9 * (c + 5) // (n + 5 * v)
    p, q = {}, {}
    for (lang, source), c in groups.items():
        v = len(kept[lang])
        n, m = sum(c[t] for t in kept[lang]), sum(langs[lang][t] for t in kept[lang])
        p[lang, source] = {t: prob(c[t], n, v) for t in kept[lang]}
        q[lang] = {t: prob(langs[lang][t], m, v) for t in kept[lang]}
    for (lang, source), own in p.items():
        pairs = [(sum(abs(own[t] - other[t]) for t in own), name) for (x, name), other in p.items() if x == lang and name != source]
        for r, (v, name) in enumerate(sorted(pairs, key=lambda x: (-x[0], x[1].encode())), 1):
            out.append((lang, source, "pair", name, v, r))
        terms = [(own[t] - q[lang][t], t) for t in own if groups[lang, source][t] and own[t] > q[lang][t]]
        for r, (v, t) in enumerate(sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:k], 1):
            out.append((lang, source, "term", t, v, r))
    return Counter(out)


def run(spark, rows, min_docs, k):
    df = spark.createDataFrame([(i, t, x, s, 1) for i, (t, x, s) in enumerate(rows)], DOCS).selectExpr("*", "'x' AS term", "1 AS g", "2 AS c", "3 AS p").repartition(5)
    out = divergence.audit(df, min_docs, k)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return Counter(tuple(r) for r in out.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out = []
    for i in range(500):
        lang = rng.choice(["en", "en", "de", None])
        source = "big" if rng.random() < 0.4 else f"s{rng.randrange(6)}"
        pool = [f"{a}{b}" for a in "abcdefgh" for b in ("x", "Y", "é", "日")]
        text = " ".join(rng.choice(pool[: 8 + len(source) * 8]) for _ in range(rng.randrange(25)))
        out.append((text.replace(" ", rng.choice([" ", "\n", "1", "|", "\x00"])), lang, source))
    out += [(None, "en", "s0"), ("", "en", "no terms"), ("!! 12", "zz", "alone"), ("rare words only", "yy", "a"), ("Rare WORDS", "yy", "b"), ("ax " * 40_000, "en", "s1"), ("ax ay", "en", None)]
    return out + [("same same", "en", "s2")] * 40


def test_divergence(spark, rows):
    for min_docs, k in ((8, 5), (1, 3), (500, 4)):
        assert run(spark, rows, min_docs, k) == plain(rows, min_docs, k)


def test_divergence_of_nothing(spark):
    assert not run(spark, [], 2, 3)


def test_search_stops_early_and_keeps_ties(spark):
    """One source's own words tie with each other at the k-th place; buckets below are not asked for."""
    rows = [(f"tie{i:02d} " * 3 + "common", "en", "a") for i in range(30)] + [("common other more", "en", "b")] * 50
    assert run(spark, rows, 1, 7) == plain(rows, 1, 7)


def test_small_tables_and_blocks(rows, monkeypatch):
    """Counts don't depend on when tables are emptied, pair sums not on blocks."""
    import pyarrow as pa

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("text", pa.string())])
    batch = pa.RecordBatch.from_arrays([pa.array([x or "" for x in col]) for col in ([r[1] for r in rows], [r[2] for r in rows], [r[0] for r in rows])], schema=schema)

    def counted():
        total = defaultdict(lambda: [0, 0])
        for b in divergence._count(iter([batch])):
            for r in b.to_pylist():
                total[r["lang"], r["source"], r["term"]][0] += r["c"]
                total[r["lang"], r["source"], r["term"]][1] += r["d"]
        return dict(total)

    whole = counted()
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    assert counted() == whole
    rng = np.random.default_rng(1)
    sizes = [1, 2, 2, 5, 5, 9, 1, 40]
    g = np.concatenate([np.sort(rng.choice(60, n, replace=False)) for n in sizes])
    p0 = np.arange(60)[g] * 7 + 3
    p = p0 + rng.integers(1, 99, len(g))
    first = np.concatenate([np.arange(n) == 0 for n in sizes])
    batches = lambda step: iter([pa.RecordBatch.from_arrays([pa.array(x[i : i + step]) for x in (g, p, p0, first)], names=["g", "p", "p0", "first"]) for i in range(0, len(g), step)])

    def summed(step):
        total = Counter()
        for b in divergence._both(batches(step)):
            for r in b.to_pylist():
                total[r["g"], r["other"]] += r["value"]
        return {k: v for k, v in total.items()}

    expected, at = Counter(), 0
    for n in sizes:
        for i in range(at, at + n):
            for j in range(at, at + n):
                if i != j:
                    expected[g[i], g[j]] += abs(p[i] - p[j]) - abs(p[i] - p0[j]) - abs(p0[i] - p[j]) + abs(p0[i] - p0[j])
        at += n
    expected = {(int(a), int(b)): int(v) for (a, b), v in expected.items()}
    for pairs in (1 << 20, 7):
        monkeypatch.setattr(divergence, "PAIRS", pairs)
        for step in (1000, 11):
            assert summed(step) == expected
