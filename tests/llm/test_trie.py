"""Conversation trie against a plain construction, with many partitions and odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

from lemmaflow.llm import trie

TURNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Every node from all prefixes of all rebuilt conversations."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, trie_digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
        ends[built[c]].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
    digest = lambda k: hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()
    return Counter((m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(kids[k]), leaves[k], saved[k], digest(k)) for k, m in members.items())


def trie_digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[: trie.WIDTH]


def nodes(spark, rows):
    out = trie.prefix_trie(spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' AS key", "1 AS depth", "2 AS seq", "text AS name"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert out.columns == names
    return Counter(tuple(r) for r in out.collect())


def test_trie_across_partitions(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(420), *range(-30, 0)]:
        n = rng.choice([0, 1, 2, 3, 5, 8, 9])
        rows += [(c, i, rng.choice("ua"), rng.choice(["", "a", "bb", "ccc"]) if rng.random() < 0.3 else "hello") for i in range(n)]
    rows += [(900 + i, t, "u", "snapshot") for i in range(60) for t in range(i)]  # each one continues the one before
    rows += [(5000 + i, t, "u", "the same") for i in range(150) for t in range(12)]
    rows += [(9001, t, "u", f"turn {t % 3}") for t in range(700)]
    rows += [(9100, None, None, None), (9100, None, None, None), (9100, 1, "u", None), (None, 1, "u", "lost"), (9101, 1, "u", "x" * 300_000), (9101, 1, "a", "tie"), (9101, 1, "a", "tie")]
    expected = plain(rows)
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert nodes(spark, rows) == expected
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_trie_small(spark):
    assert not nodes(spark, [])
    assert nodes(spark, [(None, 1, "u", "x")]) == Counter()
    one = nodes(spark, [(1, 1, "u", "x")])  # crc32 of "1" leaves a loan of at least one turn or none
    assert one == plain([(1, 1, "u", "x")])
    same = [(c, 0, "u", "hi") for c in (0, 100, 200)]
    assert nodes(spark, same) == plain(same)


def test_trie_of_any_cut():
    """Any cut of sorted keys into partitions gives the tree of the whole."""
    rng = random.Random(8)
    for _ in range(150):
        seqs = sorted({tuple(rng.randrange(3) for _ in range(rng.randrange(7))) for _ in range(rng.randrange(1, 25))})
        items = []
        for i, s in enumerate(seqs):
            at, key = trie.ROOT, b""
            for x in s:
                at = hashlib.sha256(at + bytes([x])).digest()[: trie.WIDTH]
                key += at
            items.append((key, [sum(v + 1 for v in s[: d + 1]) for d in range(len(s))], rng.randrange(10**6), rng.randrange(1, 4), f"e{i}"))
        items.sort()
        whole = closed(items, [])
        for _ in range(4):
            assert closed(items, sorted(rng.sample(range(1, len(items)), min(len(items) - 1, rng.randrange(4))))) == whole


def closed(items, cuts):
    top, before, out = trie.Tree(trie.Point(0, (b"", [])), None), b"", []
    for a, b in zip([0, *cuts], [*cuts, len(items)], strict=True):
        part = items[a:b]
        points = [trie.Point(len(k) // trie.WIDTH, (k, s), n, c, e) for k, s, c, n, e in part]
        tree = trie.Tree(points[0], "first")
        for x, y, p in zip(part, part[1:], points[1:], strict=False):
            tree.rise(trie.shared(x[0], y[0]), p.path)
            tree.push(p)
        out += tree.closed
        for kind, v, *under in tree.finish_part():
            top.replay(kind, v, under[0] if under else trie.shared(before, part[0][0]), v.path)
        before = part[-1][0]
    top.finish()
    return Counter((*x[:10], tuple(x[10])) for x in out + top.closed)
