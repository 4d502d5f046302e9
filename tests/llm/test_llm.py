"""Operators against brute force, libraries, round trips and planted cases."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import types as T

from lemmaflow.llm import bpe, chat, common, decontam, langid, licenses, quality, simhash, substring, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=None):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in extra:
            df = df.withColumn(name, F.lit("x"))
    return df


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", " ", "\n\n", "a", "a b", "word " * 3000, "x" * 50_000, "é日𝔘 \x00 z", "same", "same", "- | !! 7"]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD, ["score", "fp", "kept", "key", "h", "w", "ids", "rep"])


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


# 1 language identification


def two_tongues():
    rng = random.Random(5)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "eit", "zer"], "cc": ["жи", "до", "на", "пер"]}
    word = lambda k: "".join(rng.choice(parts[k]) for _ in range(rng.randrange(2, 4)))
    return {k: [" ".join(word(k) for _ in range(60)) for _ in range(30)] for k in parts}


def test_language(spark, odd, empty):
    rows, i = [], 0
    for lang, texts in two_tongues().items():
        for t in texts:
            rows.append((i, t, lang))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = df.where(common.crc_bucket(df.doc_id, 3) != 1)
    model = langid.fit(train)
    out = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert all(out[d].lang_pred == lang and 0 <= out[d].score <= 1 for d, _, lang in rows)
    a, b = rows[0][1], rows[40][1]
    mixed = langid.identify(docs_of(spark, [a + " " + b]), model).first()
    assert [(s.lang, s.first_word, s.last_word) for s in mixed.spans] == [("aa", 0, 59), ("bb", 60, 119)]
    got = [r.lang_pred for r in langid.identify(odd, model).orderBy("doc_id").collect()]
    assert [g == "und" for g in got] == [not any(c.isalpha() for c in t or "") for t in ODD]
    assert langid.identify(empty, model).count() == 0
    assert langid.fit(empty) is None and {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_many_languages():
    rng = np.random.default_rng(2)
    emit = rng.normal(size=(40, 200)).astype(np.float32)
    label = langid.viterbi(emit, np.array([0, 25]), np.array([25, 15]), 0.0)
    assert (label == emit.argmax(1)).all()


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 5, 6, 3, 0, 7, 6, 2, 4, 6])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    emit = rng.normal(size=(sizes.sum(), 3)).astype(np.float32)
    label = langid.viterbi(emit, starts, sizes, 0.7)
    from itertools import product

    for s, n in zip(starts, sizes):
        value = lambda p: sum(emit[s + i, x] for i, x in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, E731
        assert n == 0 or value(label[s : s + n]) == pytest.approx(max(map(value, product(range(3), repeat=int(n)))), abs=1e-4)


# 2 byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def wild(n, seed):
    rng = random.Random(seed)
    pool = ["a", "b", "'s", "'ll", " ", "  ", "\n", "\t", "Zé", "日本", "𝔘", "0123", "THE!!", "***", "\x00", "ing", "the", "▁", "<s>"]
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(n)] + ["a" * 500, " " * 300 + "x", "!" * 99]


def test_bpe(spark, odd, empty, tiktoken_encoding):
    codec = bpe.Codec()
    for t in wild(300, 2):
        assert codec.encode(t) == tiktoken_encoding.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()
    out = {r.doc_id: r for r in bpe.digests(odd).collect()}
    for i, t in enumerate(ODD):
        ids = tiktoken_encoding.encode_ordinary(t or "")
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(empty).count() == 0


def test_bpe_decode(spark, odd):
    from pyspark.sql import functions as F

    back = bpe.decode(bpe.encode(odd)).collect()
    assert {r.doc_id: bytes(r.decoded) for r in back} == {i: (t or "").encode() for i, t in enumerate(ODD)}
    edge = spark.createDataFrame([(1, None), (2, []), (3, [10**7]), (4, [-1])], "k int, ids array<long>")
    assert {r.k: r.decoded for r in bpe.decode(edge).select("k", F.col("decoded").cast("string").alias("decoded")).collect()} == {1: None, 2: "", 3: None, 4: None}


def test_bpe_append_and_splice(tiktoken_encoding):
    ranks, rng = bpe.load(bpe.default_path()), random.Random(3)
    for _ in range(200):
        a, b = (bytes(rng.choice(b"thein anrt") for _ in range(rng.randrange(12))) for _ in range(2))
        t = bpe.PrefixTable(ranks, a)
        t.append(b)
        assert t.tokens() == bpe.PrefixTable(ranks, a + b).tokens()
        i, j = sorted((rng.randrange(len(a + b) + 1), rng.randrange(len(a + b) + 1)))
        t.splice(i, j, b"the")
        assert t.tokens() == bpe.PrefixTable(ranks, (a + b)[:i] + b"the" + (a + b)[j:]).tokens()


# 3 toxicity


def test_toxicity(spark, odd, empty):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        words = prose(rng, 30).split()
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(30), rng.choice(["moron", f"krax{rng.choice('abc')}"]))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.drop("text"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert all((got[d] >= 0.3) == bool(y) for d, _, y in rows)
    assert {r.score for r in toxicity.score(odd, model).collect()} == {got[1]}
    assert toxicity.score(empty, model).count() == 0
    base = toxicity.fit(empty, df.drop("text"))
    assert toxicity.score(docs_of(spark, ["you stupid worthless moron", "fine day"]), base).orderBy("doc_id").collect()[0].score > 0.3


def slow_arcs(symbols):
    """Labels of a clause's arcs, read off the definitions word by word; symbols: (symbol, weight)."""
    words = [(i, s, w) for i, (s, w) in enumerate(symbols) if s not in ("open", "close")]
    out, used, harm_open, self_or_modal, addressed = [], set(), False, "", False
    for n, (i, s, w) in enumerate(words):
        before = words[:n]
        negated = any(t == "negation" for _, t, _ in before[-toxicity.NEGATION_SCOPE :]) and s != "negation"
        quoted = False
        for t, _ in symbols[:i]:
            quoted = t == "open" or (quoted and t != "close")
        reported = quoted or any(t == "saying" for _, t, _ in before)
        label = None
        near = lambda kinds: [k for k in range(max(0, n - toxicity.TARGET_SCOPE), n) if words[k][1] in kinds]  # noqa: B023, E731
        if s in ("addressed", "pointed"):
            if harm_open:
                label, harm_open = "threat", False
            else:
                addressed = addressed or s == "addressed"
                open_ = [k for k in near(("insult",)) if k not in used and not any(t in ("addressed", "pointed") for _, t, _ in words[k + 1 : n])]
                if open_ and not (negated or reported):
                    label = "target behind insult"
        elif s == "insult":
            aimed = bool(near(("addressed", "pointed")))
            if aimed:
                used.add(n)
                used |= set(near(("insult",)))
            label = "reported insult" if reported else "negated insult" if negated else "aimed insult" if aimed else "plain insult"
        elif s in ("self", "modal"):
            self_or_modal = "self" if s == "self" or self_or_modal == "self" else "modal"
        elif s == "harm" and self_or_modal:
            if addressed and self_or_modal == "self":
                label, harm_open = "threat", False
            else:
                harm_open = True
        if label == "threat" and (negated or reported):
            label = "negated or reported threat"
        if label:
            out.append(label)
    return out


def test_grammar_is_its_transducers():
    """The composed automaton against a plain reading of the definitions, over random clauses."""
    rng = random.Random(41)
    after, label = toxicity.automaton()
    for _ in range(4000):
        symbols = [(rng.choice([*toxicity.SYMBOLS, "other", "other", "insult", "addressed"]), 1.0) for _ in range(rng.randrange(12))]
        state, got = 0, []
        for s, _ in symbols:
            k = toxicity.SYMBOLS.index(s)
            if label[state][k] >= 0:
                got.append(toxicity.LABELS[label[state][k]])
            state = after[state][k]
        assert got == slow_arcs(symbols), symbols


def test_every_transducer_changes_a_score():
    model, g = toxicity.Model({}), toxicity.Grammar({})
    score = lambda t: float(model.score([g.features(t)])[0][0])
    assert score("a fine day") == score("") < score("what a moron here")  # insult
    assert score("you are a moron") > score("what a moron here")  # target
    assert score("moron that you are") > score("moron that books are")
    assert score("he is not a moron") < score("he is a moron")  # negation
    assert score("she said moron") < score("she and moron") and score("\"moron\" it was") < score("moron it was")  # reported speech
    assert score("I will kill you") > score("they kill time") == score("")  # threat
    assert score("you, I will kill") == score("I will kill you") and score("you will kill time") == score("")
    assert score("I will not kill you") < score("I will kill you")
    assert score("moron. moron.") > score("moron.")  # clauses add up


# 4 token counts


def test_token_counts(spark, odd, empty):
    texts = wild(400, 6) + [" " * i + "x" + " " * (i % 37) for i in range(60)]
    sp = token_counts.load(token_counts.default_path()).sp
    assert token_counts.count_texts(texts, token_counts.default_path()) == [len(sp.encode(t)) for t in texts]
    out = {r.doc_id: r for r in token_counts.token_counts(odd).collect()}
    for i, t in enumerate(ODD):
        n = len(sp.encode(t or ""))
        assert (out[i].n_bytes, out[i].n_tokens, out[i].over_limit) == (len((t or "").encode()), n, n > 4096)
    assert token_counts.token_counts(empty).count() == 0


def test_long_pretokens():
    rng = random.Random(42)
    p = token_counts.load(token_counts.default_path())
    words = ["".join(rng.choice(k) for _ in range(n)) for k in ("etaoinshr", "abcdefghijklmnopqrstuvwxyz", "ab", "aé日0-") for n in (401, 1500, 6000)] + [" " * 700, " " * 5000 + "x", "=" * 900]
    for w in words:
        assert token_counts.count_texts([w], token_counts.default_path()) == [len(p.sp.encode(w))], w[:20]
    pieces = ["".join(rng.choice("etaoinshr▁") for _ in range(rng.randrange(1, 60))).lstrip("▁") or "e" for _ in range(300)]
    assert p.count(pieces).tolist() == [p._count_long(w) for w in pieces]
    import time

    began = time.perf_counter()
    token_counts.count_texts(["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))], token_counts.default_path())
    assert time.perf_counter() - began < 20  # in proportion to the length


# 5 SimHash


def slow_fingerprint(text):
    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(n)]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > n)


def slow_components(nodes, linked):
    least = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def test_simhash(spark, odd, empty):
    rng = random.Random(8)
    texts = list(ODD)
    for _ in range(12):
        base = prose(rng, 200).split()
        for _ in range(4):
            texts.append(" ".join(base))
            base = list(base)
            base[rng.randrange(200)] = "NEW"
    fp = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    least = slow_components(fp, [(a, b) for a, b in combinations(fp, 2) if bin(fp[a] ^ fp[b]).count("1") <= 2])
    out = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts, ["fp", "rep"])).collect()}
    assert {i: (r.fingerprint, r.component_id) for i, r in out.items()} == {i: (f"{fp[i]:016x}", least[i]) for i in fp}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs_of(spark, texts))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in kept.collect()} == set(least.values())


def test_keep_one_of_repeated_rows_and_null_ids(spark):
    rng = random.Random(23)
    a, b, c, d = (prose(rng, 200, 5000) for _ in range(4))
    near = " ".join([*c.split()[:-1], "NEW"])
    assert bin(slow_fingerprint(c) ^ slow_fingerprint(near)).count("1") <= 2
    rows = [*[(7, a)] * 50, (9, a), *[(None, b)] * 20, (3, c), (None, c), (None, near), (5, d), *[(None, "")] * 3]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], DOCS)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert got == sorted([(7, a), (0, b), (3, c), (5, d), (0, "")])


def test_clashing_names(spark):
    """Operators that carry extra columns carry any."""
    from pyspark.sql import functions as F

    rng = random.Random(43)
    a, b, item = (prose(rng, 90, 5000) for _ in range(3))
    docs = docs_of(spark, [a, a, b, f"{b} {item}"])
    for name in ("_fp", "_row", "_dup_id", "_leak_id", "leak_id", "own", "_cut_id", "_cut_spans", "_cut_d", "_cut_mark", "d", "mark", "kept", "__keep__", "component", "n"):
        docs = docs.withColumn(name, F.lit("z"))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows, df = labelled(spark)
    model = quality.fit(df.drop("quality"), df.drop("text"))
    for out, ids in ((simhash.keep_one(docs), {0, 2, 3}), (decontam.keep_clean(docs, bench), {0, 1, 2}), (substring.remove_repeats(docs), {0, 2, 3}), (quality.keep_good(docs, model), None)):
        assert out.columns == docs.columns
        got = out.collect()
        assert (ids is None or {r.doc_id for r in got} == ids) and all(r["_row"] == r["d"] == "z" for r in got)


def test_links_lose_nothing(spark):
    rng = random.Random(9)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(5):
            fps.add(x)
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {(r.a, r.b) for r in simhash.links(df).collect()}
    assert got == {tuple(sorted((signed(a), signed(b)))) for a, b in combinations(fps, 2) if bin(a ^ b).count("1") <= 2}


def test_components(spark):
    rng = random.Random(10)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == slow_components(nodes, [e for e in edges if e[0] != e[1]])


# 6 quality


def slow_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def labelled(spark, n=400):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        t = prose(rng, 80).replace(" w1 ", ". W1 ").replace(" w2 ", "\n")
        good = i % 5 != 0
        if not good:
            t = rng.choice([lambda x: x.replace(" ", "*** "), lambda x: x.replace(" ", " | "), lambda x: x.upper().replace(" ", "!! ")])(t)
        rows.append((i, t, int(good)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_quality(spark, empty):
    rng = random.Random(12)
    for t in [*(x for x in ODD if len(x or "") < 500), *wild(100, 13), *("\n".join(rng.choice(["a b c", "a b", "c a b c a", " "]) for _ in range(9)) for _ in range(60))]:
        assert quality.rule_statistics(t)[:5] == slow_statistics(t)
    rows, df = labelled(spark)
    model = quality.fit(df.drop("quality"), df.drop("text"))
    out = {r.doc_id: r for r in quality.judge(df, model).collect()}
    assert sum(out[d].kept == bool(q) for d, _, q in rows) >= 0.97 * len(rows)
    odd = docs_of(spark, ODD, ["kept", "f"])
    assert {r.doc_id for r in quality.judge(odd, model).where("not base_failed").collect()} == set()
    again = quality.keep_good(docs_of(spark, [t for _, t, _ in rows]), model)
    assert {r.doc_id for r in again.collect()} == {d for d in out if out[d].kept}
    assert quality.judge(empty, quality.fit(empty, df.drop("text"))).count() == 0


def test_quality_is_calibrated_on_all_labelled_rows(spark, monkeypatch):
    rows = [(i, t, q if i % 11 else 1 - q) for i, t, q in labelled(spark, 9000)[0]]  # wrong labels: no threshold parts the rows
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df.drop("quality"), df.drop("text"))
    facts = [(quality.rule_statistics(t), q) for _, t, q in rows]
    use = [(r[5], q) for r, q in facts if not quality.base_fails(r[0], r[4])]
    scores, good = model.forest.score(np.array([f for f, _ in use])), np.array([q for _, q in use]) == 1
    assert good.sum() > 6000
    cuts = [(int(good[scores <= s].sum()), int((~good)[scores <= s].sum()), s) for s in np.unique(scores)]
    kept = [(g * int((~good).sum()) - b * int(good.sum()), -s) for g, b, s in cuts if g >= quality.MIN_KEEP * good.sum()]
    best = -max(kept)[1]
    above = scores[scores > best]
    assert model.threshold == pytest.approx((best + above.min()) / 2 if len(above) else best, abs=1e-12)
    monkeypatch.setattr(quality, "FEW", 10)  # too many ids for a broadcast
    assert quality.fit(df.drop("quality"), df.drop("text")).threshold == model.threshold


def test_forest_is_its_trees():
    """Scores against a walk of each tree, row by row."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 4))
    forest = quality.Forest(rows, rows.min(0), rows.max(0), trees=20, tree_rows=64)
    x = rng.normal(scale=2, size=(50, 4))

    def path(t, row):
        node, depth = 1, 0
        while forest.feature[t, node] >= 0:
            node, depth = 2 * node + int(row[forest.feature[t, node]] > forest.cut[t, node]), depth + 1
        assert forest.path[t, node] >= depth
        return forest.path[t, node]

    want = [2.0 ** (-np.mean([path(t, r) for t in range(20)]) / forest.norm) for r in x]
    assert np.allclose(forest.score(x), want) and forest.score(x[:1] * 0).item() < forest.score(np.full((1, 4), 9.0)).item()


# 7 substring dedup


def jaccard(a, b, n=5):
    s, t = ({tuple(x[i : i + n]) for i in range(len(x) - n + 1)} for x in (a.lower().split(), b.lower().split()))
    return len(s & t) / len(s | t)


def test_substring_lines(spark, odd, empty):
    rng = random.Random(14)
    lines = []
    for _ in range(15):
        base = prose(rng, 60, 5000).split()
        for _ in range(4):
            lines.append(" ".join(base))
            base = list(base)
            base[rng.randrange(60)] = "changed"
    rng.shuffle(lines)
    out = substring.repeats(docs_of(spark, lines, ["key", "bands"])).where("kind = 'line'").collect()
    least = slow_components(range(len(lines)), [(a, b) for a, b in combinations(range(len(lines)), 2) if jaccard(lines[a], lines[b]) >= 0.8])
    size = {c: list(least.values()).count(c) for c in least.values()}
    assert {(r.doc_id, r.keeper_doc_id, r.kept) for r in out} == {(i, c, i == c) for i, c in least.items() if size[c] > 1}
    assert substring.repeats(empty).count() == 0
    assert substring.repeats(odd).count() == 0


def test_substring_passages(spark):
    rng = random.Random(15)
    passage = prose(rng, 60, 10_000)
    texts = [prose(rng, 30 + 7 * i, 10_000) + (f" {passage} " if i % 2 else " ") + prose(rng, 25, 10_000) for i in range(8)]
    out = substring.repeats(docs_of(spark, texts)).where("kind = 'passage'").collect()
    assert {(r.doc_id, r.keeper_doc_id) for r in out} == {(i, 1) for i in (1, 3, 5, 7)}
    for r in out:
        inside = " ".join(texts[r.doc_id].split()[r.first_word : r.last_word + 1])
        assert inside == passage or r.kept and inside in passage
    clean = [t for i, t in enumerate(texts) if i % 2 == 0]
    assert substring.repeats(docs_of(spark, clean)).count() == 0
    left = {r.doc_id: r.text for r in substring.remove_repeats(docs_of(spark, texts)).collect()}
    assert left[1] == texts[1] and left[0] == texts[0] and left[3].split() == texts[3].replace(passage, "").split()


def test_substring_passages_within_a_text(spark):
    """A second copy in a text is a repeat, after a part of the passage and where no other text has it too."""
    rng = random.Random(21)
    fill = iter(prose(rng, 40, 1_000_000) for _ in range(12))
    p, own = prose(rng, 80, 1_000_000), prose(rng, 70, 1_000_000)
    part = " ".join(p.split()[15:70])
    texts = [
        f"{next(fill)} {p} {next(fill)}",
        f"{next(fill)} {p} {next(fill)} {p} {next(fill)}",
        f"{next(fill)} {part} {next(fill)} {p} {next(fill)}",
        f"{next(fill)} {own} {next(fill)} {own} {next(fill)}",
    ]
    out = substring.repeats(docs_of(spark, texts)).where("kind = 'passage'").collect()
    cut = sorted((r.doc_id, r.keeper_doc_id, " ".join(texts[r.doc_id].split()[r.first_word : r.last_word + 1])) for r in out if not r.kept)
    assert cut == sorted([(1, 0, p), (1, 0, p), (2, 0, part), (2, 0, p), (3, 3, own)])
    left = {r.doc_id: r.text for r in substring.remove_repeats(docs_of(spark, texts)).collect()}
    assert left[0] == texts[0] and p not in left[1] and part not in left[2] and left[3].count(own) == 1


def test_substring_pivots_lose_no_link(spark):
    """Chains of similar lines in shared buckets: no partner is lost behind a pivot."""
    rng = random.Random(16)
    base = prose(rng, 50, 5000).split()
    lines = [" ".join(base)]
    for k in range(14):
        base = list(base)
        base[3 * k + 2] = f"new{k}"
        lines.append(" ".join(base))
    out = substring.repeats(docs_of(spark, lines)).where("kind = 'line'").collect()
    assert {(r.doc_id, r.keeper_doc_id) for r in out} == {(i, 0) for i in range(15)}


def test_repeated_and_null_ids(spark):
    """Rows that share a doc_id are told apart by their texts, and rows without one by theirs alone."""
    rng = random.Random(44)
    a, p, b, c = prose(rng, 120, 1_000_000), prose(rng, 60, 1_000_000), prose(rng, 40, 1_000_000), prose(rng, 120, 1_000_000)
    rows = [(1, f"{a} {p}"), (2, f"{b} {p}"), (2, c), (2, c), (None, f"{c} {b}"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCS)
    left = sorted((r.doc_id or 0, r.text or "") for r in substring.remove_repeats(docs).collect())
    assert left == sorted([(1, f"{a} {p}"), (2, b), (2, c), (2, c), (0, ""), (0, "")])
    assert docs.count() == 7


def test_near_passages(spark):
    """Passages with changed words in short distances are one repeat, and unrelated texts are left alone."""
    rng = random.Random(45)
    base = prose(rng, 140, 1_000_000).split()
    near = list(base)
    near[40], near[90] = "new1", "new2"
    del near[115]
    assert jaccard(" ".join(base), " ".join(near)) >= 0.8
    texts = [f"{prose(rng, 50, 1_000_000)} {' '.join(base)} {prose(rng, 30, 1_000_000)}", f"{prose(rng, 35, 1_000_000)} {' '.join(near)} {prose(rng, 60, 1_000_000)}", prose(rng, 150, 1_000_000)]
    out = [r for r in substring.repeats(docs_of(spark, texts)).collect() if not r.kept]
    assert [(r.doc_id, r.keeper_doc_id, r.kind, r.first_word, r.last_word) for r in out] == [(1, 0, "passage", 35, 35 + len(near) - 1)]
    assert substring.chain([(0, 30, 0, 30), (31, 60, 31, 60)]) == [(0, 60, 0, 60)] and substring.chain([(0, 30, 0, 30), (60, 90, 60, 90)]) == [(0, 30, 0, 30), (60, 90, 60, 90)]
    assert substring.chain([(0, 20, 0, 20)]) == []


def test_near_passages_are_found(spark):
    """At least nine of ten passages of 50 words or more that differ in some words, at 0.8 or more, are covered; nothing else is."""
    rng = random.Random(47)
    rows, spans = [], {}
    while len(spans) < 60:
        base = prose(rng, rng.choice([50, 70, 100, 160]), 50_000).split()
        near = list(base)
        for _ in range(rng.randrange(1, max(2, len(base) // 45 + 1))):
            k = rng.randrange(len(near))
            near[k : k + rng.randrange(2)] = [f"x{rng.randrange(10**6)}"] * rng.randrange(2)
        if not 0.8 <= jaccard(" ".join(base), " ".join(near)) < 1:
            continue
        a = prose(rng, rng.randrange(5, 60), 1_000_000).split()
        rows += [" ".join([prose(rng, 20, 1_000_000), *base, prose(rng, 20, 1_000_000)]), " ".join([*a, *near, prose(rng, 20, 1_000_000)])]
        spans[len(rows) - 1] = (len(a), len(a) + len(near))
    got: dict = {}
    for r in substring.repeats(docs_of(spark, rows)).collect():
        if not r.kept:
            got.setdefault(r.doc_id, set()).update(range(r.first_word, r.last_word + 1))
    assert set(got) <= set(spans)
    share = [len(got.get(d, set()) & set(range(a, e))) / (e - a) for d, (a, e) in spans.items()]
    assert sum(x >= 0.8 for x in share) >= 0.9 * len(share)


def slow_covered(texts, least=50):
    """(text, word) of all words in a run of `least` words that stands at an earlier place too."""
    first, out = {}, set()
    for d, t in enumerate(texts):
        w = t.lower().split()
        for i in range(len(w) - least + 1):
            run = tuple(w[i : i + least])
            if run in first and not (first[run][0] == d and i - first[run][1] < least):
                out |= {(d, k) for k in range(i, i + least)}
            else:
                first.setdefault(run, (d, i))
    return out


def test_passages_against_brute_force(spark):
    """Every word of a run of 50 that an earlier place has is in a repeat; no word of other texts is."""
    rng = random.Random(46)
    pool = [prose(rng, rng.randrange(50, 120), 1_000_000) for _ in range(12)]
    texts = [" ".join([prose(rng, rng.randrange(5, 60), 1_000_000)] + [x for _ in range(rng.randrange(4)) for x in (rng.choice(pool), prose(rng, rng.randrange(3, 40), 1_000_000))]) for _ in range(60)]
    got = {(r.doc_id, k) for r in substring.repeats(docs_of(spark, texts)).collect() if not r.kept for k in range(r.first_word, r.last_word + 1)}
    want = slow_covered(texts)
    assert len(want) > 3000 and want <= got
    assert len(got - want) <= 0.002 * len(got)  # a neighbour's word that happens to be the same


def test_short_lines(spark):
    line, other = "one two three four five six seven eight nine ten eleven", "too short a line"
    out = substring.repeats(docs_of(spark, [f"{line}\nx y", f"a b\n{line}\n{other}", f"{other}\n{line} twelve"])).collect()
    assert {(r.doc_id, r.kind, r.first_word, r.last_word, r.kept) for r in out} == {(0, "line", 0, 10, True), (1, "line", 2, 12, False)}


def test_cut_text():
    assert substring.cut_text("a  b\n\nc d e\nf", [(2, 2), (4, 5)]) == "a  b\n\nd"
    assert substring.cut_text("a b c d", [(1, 2), (2, 2), (9, 12)]) == "a d" and substring.cut_text("a b", [(0, 1)]) == "" and substring.cut_text(" a\nb ", []) == " a\nb "


def test_tune():
    b = substring.tune()
    assert 1 - (1 - 0.8**substring.ROWS) ** b >= 0.999


# 8 licenses


def slow_base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for phrase, label in licenses.BASE for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licenses(spark, odd, empty):
    assert len(licenses.rules()) > 200
    rng = random.Random(17)
    pool = ["MIT", "License", "license.", "Apache", "cc", "BY", "by,", "gnu", "General", "public", "é", "x-y", "\x7f"]
    for t in [*(x for x in ODD), *(" ".join(rng.choice(pool) for _ in range(40)) for _ in range(200))]:
        assert licenses.scan_text(t)[:5] == slow_base(t)
    labels = lambda t: licenses.scan_text(t)[5]
    assert labels("Licensed under CC BY-NC 4.0.") == "cc-by,cc-by-nc"
    assert labels("SPDX-License-Identifier: BSD-3-Clause") == "bsd-3-clause"
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy of this software") == "mit"
    assert labels("licensed under the GNU General Public License, version 3.") == "gpl,gpl-3.0"
    assert labels("a mit of isc and boost in ruby") == ""
    assert [r.n_words for r in licenses.scan(odd).orderBy("doc_id").collect()] == [slow_base(t)[0] for t in ODD]
    assert licenses.scan(empty).count() == 0


def test_license_texts():
    """Full texts and headers by their own sentences, and no label for prose."""
    labels = lambda t: set(licenses.scan_text(t)[5].split(","))
    assert labels("THE SOFTWARE IS PROVIDED \"AS IS\" ... to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies") == {"mit"}
    assert labels("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS") == {"apache-2.0"}
    assert labels("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.") == {"mpl-2.0"}
    assert labels("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.") == {"bsd-2-clause"}
    assert labels("published by apache") == {"apache"} and labels("shared with the BSD 3-Clause") == {"bsd-3-clause"} and labels("distributed with ISC") == {"isc"} and labels("lizenz mit") == {"mit"}
    assert labels("We walked along the river and talked about the weather for a while.") == {""}
    assert sum(r[0] == 0 for r in licenses.rules()) > 180


def a_match(rng, tree):
    """A random string that a parsed pattern matches."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            out += rng.choice([{"LITERAL": lambda: chr(c), "RANGE": lambda: chr(rng.randint(*c))}.get(str(o), lambda: "x")() for o, c in arg])
        elif name == "SUBPATTERN":
            out += a_match(rng, arg[3])
        elif name == "BRANCH":
            out += a_match(rng, rng.choice(arg[1]))
        else:
            assert name in ("MAX_REPEAT", "MIN_REPEAT"), name
            out += "".join(a_match(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 3))))
    return out


def test_license_gates_lose_nothing():
    """Gated and ungated detection agree on matches of every rule."""
    from re import _parser

    rng = random.Random(22)
    for rank, label, sets, pattern in licenses.rules():
        assert sets, pattern.pattern
        inner = pattern.pattern.removeprefix("(?<![^ ])").removesuffix("(?![^ ])")
        for _ in range(40):
            t = a_match(rng, _parser.parse(inner))
            assert pattern.fullmatch(t), (pattern.pattern, t)
            assert licenses.detect(t) == licenses.detect(t, gated=False) != [], t
    labels = lambda t: licenses.scan_text(t)[5]
    assert labels("unter der Apache Lizenz") == "apache" and labels("Lizenz: BSD 3 Clause") == "bsd-3-clause"
    assert labels("released with CC BY-SA 4.0") == "cc-by,cc-by-sa" and labels("mit no attribution") == "mit-0"
    assert labels("Berkeley Software Distribution License") == "bsd" and labels("Open Database License") == "odbl" and labels("Expat license") == "mit"


def slow_scan(text):
    """Labels and score by all rules one after the other, and suppression read off its definition."""
    from re import _parser  # noqa: F401

    normal = " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
    found = [(rank, m.start(), m.end(), label) for rank, label, _, pattern in licenses.rules() for m in pattern.finditer(normal)]
    better = lambda d, k: (k[0], k[1] - k[2], k[1], -len(k[3]), k[3]) < (d[0], d[1] - d[2], d[1], -len(d[3]), d[3])
    kept = {d for d in found if not any(better(d, k) and k[1] <= d[1] and d[2] <= k[2] for k in found)}
    base = {label for phrase, label in licenses.BASE if f" {phrase} " in f" {normal} "}
    score = 1.0
    for rank, *_ in kept:
        score *= {0: 0.05, 1: 0.05, 2: 0.15, 3: 0.4, 4: 0.4}[rank]
    return ",".join(sorted(base | {d[3] for d in kept})), 1 - score * 0.3 ** len(base)


def test_license_labels_against_brute_force():
    from re import _parser

    rng = random.Random(51)
    rules = licenses.rules()
    inner = lambda r: r[3].pattern.removeprefix("(?<![^ ])").removesuffix("(?![^ ])")
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += [prose(rng, rng.randrange(4)), a_match(rng, _parser.parse(inner(rng.choice(rules))))]
        t = " ".join(parts)
        labels, score = slow_scan(t)
        got = licenses.scan_text(t)
        assert got[5] == labels and got[6] == pytest.approx(score), t


# 9 chat


def test_chat(spark):
    talk = [("user", "hi"), ("assistant", "ho"), ("user", "and"), ("assistant", "so")]
    logs = {1: talk[:2], 2: talk[:4], 3: talk[:4], 4: [("user", "other")], 5: [("user", "other"), ("assistant", None)], 6: [("user", "hi"), ("assistant", "no")], 7: talk[1:3]}
    rows = [(c, i, r, t, "x") for c, turns in logs.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, i string")
    out = {r.conv_id: r for r in chat.render(df).collect()}
    assert set(out) == {2, 5, 6, 7} and out[2].n_copies == 2 and out[2].n_turns == 4
    assert out[5].rendered == "<|user|>\nother<|end|>\n<|assistant|>\n<|end|>\n"
    assert chat.render(df.where("false")).count() == 0
    repeated = chat.render(df.where("conv_id = 4").unionAll(df.where("conv_id = 4"))).collect()
    assert [r.n_turns for r in repeated] == [2]


# 10 decontamination


def slow_leaks(texts, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for i, item in items.items():
        w = words(item)
        if not w:
            continue
        n = min(5, len(w))
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, t in enumerate(texts):
            v = words(t)
            has = own & {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            if 5 * len(has) >= 4 * len(own):
                out[d, i] = (len(own), len(has))
    return out


@pytest.mark.parametrize("rows", [decontam.BROADCAST_ROWS, 0])
def test_decontamination(spark, empty, rows):
    rng = random.Random(18)
    items = {i: prose(rng, n, 3000) for i, n in enumerate([1, 3, 5, 9, 15, 16, 40, 80])} | {20: "", 21: None, 22: "Ünï cöde Täst über alles"}
    texts = [prose(rng, 100, 3000) for _ in range(20)]
    for d, i in enumerate([2, 3, 4, 5, 6, 7, 6, 22, 1]):
        w = items[i].split()
        if d == 6:
            w[20] = "changed"
        texts[d] = f"{texts[d]} {', '.join(w).upper() if d % 2 else ' '.join(w)}. {texts[d + 9]}"
    texts += ODD
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in decontam.leaks(docs_of(spark, texts, ["h", "w"]), bench, rows).collect()}
    assert got == slow_leaks(texts, items) and len(got) >= 9
    assert decontam.leaks(empty, bench, rows).count() == 0 and decontam.leaks(docs_of(spark, texts), bench.where("false"), rows).count() == 0
    clean = decontam.keep_clean(docs_of(spark, texts), bench)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in got}


@pytest.mark.parametrize("rows", [decontam.BROADCAST_ROWS, 0])
def test_decontamination_of_null_ids(spark, rows):
    """Rows without a doc_id leak and go by their own texts, however large the benchmark."""
    rng = random.Random(24)
    item = prose(rng, 30, 3000)
    dirty, clean = f"{prose(rng, 50, 3000)} {item}", prose(rng, 60, 3000)
    docs = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in [(None, dirty), (None, clean), (None, None), (1, dirty), (2, clean), (None, dirty)]], DOCS)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in decontam.leaks(docs, bench, rows).collect()}
    assert got == {(None, 1, 26, 26), (1, 1, 26, 26)}
    kept = decontam.keep_clean(docs, bench, rows)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(0, clean), (0, ""), (2, clean)])


# the pipeline


def slow_pipeline(docs, judged, items):
    """(doc_id, text) of what the first four stages leave, by plain loops; docs: distinct (doc_id, text), judged: those that the forest keeps."""
    kept = [(i, t) for i, t in docs if (i, t) in judged]
    fp = {k: slow_fingerprint(t) for k, (_, t) in enumerate(kept)}
    order = sorted(fp, key=lambda k: (kept[k][0] is None, kept[k][0] or 0))
    rank = {k: n for n, k in enumerate(order)}
    least = slow_components(range(len(kept)), [(rank[a], rank[b]) for a, b in combinations(fp, 2) if bin(fp[a] ^ fp[b]).count("1") <= 2])
    one = [kept[k] for k in order if least[rank[k]] == rank[k]]
    seen, left = set(), []
    for i, t in one:
        lines = []
        for line in t.split("\n"):
            if len(line.split()) >= substring.SHORT and line.lower() in seen:
                continue
            lines.append(line)
            seen.add(line.lower())
        if lines:
            left.append((i, "\n".join(lines)))
    dirty = {d for d, _ in slow_leaks([t for _, t in left], items)}
    return [x for k, x in enumerate(left) if k not in dirty]


def test_pipeline(spark, tmp_path, tiktoken_encoding):
    """All stages against brute force: ids, texts after the cut, token counts and digests."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, df = labelled(spark, 300)
    rng = random.Random(19)
    lines = [prose(rng, 40, 9000) for _ in range(6)]
    texts = [(i, t) for i, t, _ in rows]
    texts += [(300, rows[1][1]), (301, rows[1][1] + " tail"), (302, f"{prose(rng, 60, 9000)}\n{lines[0]}"), (303, f"{lines[0]}\n{prose(rng, 80, 9000)}\n{lines[1]}"), (304, f"{lines[1]}\n{lines[0]}"), (None, f"{prose(rng, 70, 9000)}\n{lines[1]}")]
    item = prose(rng, 30, 9000)
    texts += [(305, prose(rng, 70, 9000) + " " + item), (306, None), (307, ""), (None, None)]
    repeated = [texts[5], texts[5], (308, prose(rng, 90, 9000)), (308, prose(rng, 95, 9000))]
    every = [*texts, *repeated]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "x") for i, t in every], DOCS + ", extra string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df.drop("text").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
    judged = {(r.doc_id, r.text) for r in quality.keep_good(docs, quality.fit(docs, df.drop("text"))).collect()}
    left = slow_pipeline(list(dict.fromkeys(every)), judged, {1: item})
    want = []
    for i, t in left:
        ids = tiktoken_encoding.encode_ordinary(t)
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want) and len(got) > 200 and {304, 305} & {x[0] for x in got} == set()


def test_pipeline_of_nothing(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_splits_are_crc32(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.b for r in df.select("doc_id", common.crc_bucket(df.doc_id, 3).alias("b")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 for i in range(50)}


@pytest.mark.parametrize("little", [common.LITTLE, 0])
def test_join_unique(spark, monkeypatch, little):
    monkeypatch.setattr(common, "LITTLE", little)
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0 if i % 2 else i, i) for i in range(6000)], "k long, i long")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    out = common.join_unique(rows, table, "k")
    assert out.columns == ["k", "i", "v"] and out.count() == 6000 and out.where("v <> 2 * k").count() == 0
    assert common.join_unique(rows.where("false"), table.where("false"), "k").count() == 0


def row_wise(spark):
    """Every operator that gives one row a document, as name: function of documents."""
    rng = random.Random(48)
    teach = spark.createDataFrame([(i, prose(rng, 60), ("aa", "bb")[i % 2], i % 2, i % 3 > 0) for i in range(40)], "doc_id long, text string, lang string, toxic int, good boolean").selectExpr("*", "int(good) as quality")
    language, toxic, good = langid.fit(teach), toxicity.fit(teach.select("doc_id", "text"), teach.select("doc_id", "toxic")), quality.fit(teach.select("doc_id", "text"), teach.select("doc_id", "quality"))
    return {
        "op1": lambda d: langid.identify(d, language), "op2": bpe.digests, "op3": lambda d: toxicity.score(d, toxic), "op4": token_counts.token_counts,
        "op5": simhash.near_duplicates, "op6": lambda d: quality.judge(d, good), "op8": licenses.scan,
    }


def test_null_and_repeated_ids(spark):
    """Rows are independent of their ids: each keeps its place, equal texts fare alike, nothing is lost."""
    rng = random.Random(49)
    a, b = prose(rng, 60), prose(rng, 80) + " you moron. MIT License"
    rows = [(None, a), (1, a), (1, a), (1, b), (None, b), (None, None), (2, None), (2, "")]
    docs = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in rows], DOCS)
    for name, run in row_wise(spark).items():
        out = [r.asDict(True) for r in run(docs).collect()]
        assert sorted((r["doc_id"] or 0 for r in out)) == sorted(i or 0 for i, _ in rows), name
        own = lambda r: repr([v for k, v in sorted(r.items()) if k not in ("doc_id", "component_id")])
        # Three rows have the first text, two the second, three none; op3 tells the first from none no more than it should.
        sizes = sorted(list(map(own, out)).count(x) for x in {own(r) for r in out})
        assert sizes == ([2, 6] if name == "op3" else [2, 3, 3]), name
    item = " ".join(a.split()[:30])
    found = decontam.leaks(docs, spark.createDataFrame([(7, item), (7, item), (None, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == [(0, 7), (1, 7)]


def test_very_long_texts(spark):
    """One text of 200,000 words among short ones: read whole, in time in proportion to its length."""
    rng = random.Random(50)
    words = prose(rng, 200_000, 50_000).split()
    long, passage = " ".join(words), " ".join(words[150_000:150_080])
    docs = docs_of(spark, [long, prose(rng, 60), f"{prose(rng, 40, 1_000_000)} {passage}", None])
    for name, run in row_wise(spark).items():
        out = {r.doc_id: r for r in run(docs).collect()}
        assert set(out) == {0, 1, 2, 3}, name
        if name in ("op6", "op8"):
            assert out[0].n_words == 200_000
        if name == "op2":
            assert out[0].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()
        if name == "op5":
            assert out[0].fingerprint == f"{slow_fingerprint(long):016x}"
    found = decontam.leaks(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in found) == [0, 2]
    gone = [r for r in substring.repeats(docs).collect() if not r.kept]
    assert [(r.doc_id, r.keeper_doc_id, r.first_word, r.last_word) for r in gone] == [(2, 0, 40, 119)]


def test_long_conversation(spark):
    rows = [(1, i, "user", f"t{i}") for i in range(3000)] + [(2, i, "user", f"t{i}") for i in range(2999)] + [(None, 0, None, None), (3, None, "user", "x")]
    out = {r.conv_id: r for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {1, None, 3} and out[1].n_turns == 3000 and out[1].rendered.endswith("t2999<|end|>\n")
