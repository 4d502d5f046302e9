"""Source divergence audit: how the sources of a language differ in the words they use.

Terms are runs of ASCII letters (lower-cased) and other characters beyond ASCII. A language keeps the terms that are in at least MIN_DOCS of its documents (V of
them). A group is a (lang, source) that occurs; its p of a kept term with count c is 1 + floor(10**9 * (c + 5) / (N + 5 * V)), N being the sum of its
counts of kept terms, and q is the same of the whole language. All arithmetic is on integers.

* `postings` counts terms in tasks, in bounded tables that are emptied into rows, and adds the rows up by (lang, term), so the documents are read once and
  a row is shuffled for each group, term and emptied table.
* `top_terms` is a best-first search. All terms of a group with the same count share p, so a bucket of them is bounded by p less the smallest q in it. Buckets are
  evaluated in order of their bounds, some at first and more in each round, until no unseen bound reaches the value that is k-th so far; bounds
  that equal it are evaluated, so ties are whole. Terms outside the evaluated buckets are never looked at.
* `pair_distances` sums abs(p - p') over all kept terms for two sources of a language. Postings give the terms that both have; what one alone has
  follows from its count buckets and the other's p of an absent term, by prefix sums over the sorted buckets; the rest is a product. So a term's list of
  sources is paired, never the vocabulary.

Edge cases: null text, lang and source are the empty text. A group without terms has pairs (all terms are absent in it) and no term rows; a language that keeps no
term has pairs of value 0. Repeated rows count each; doc_id isn't read. A very long text is counted whole by one task. An empty table gives an empty result; extra
columns are not carried. Ties are in order of the item's UTF-8 bytes. One source may hold any share of the rows: its documents are counted where they lie.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_unique, materialise, settle, ship_package, slices

MIN_DOCS = 30
TOP = 50
#: Added to each count, and the scale of a probability.
PRIOR, SCALE = 5, 1_000_000_000
#: Entries of a task's tables of counts, after which they are emptied into rows. Results don't depend on it.
ENTRIES = 400_000
#: Pairs of postings handled at once.
PAIRS = 1 << 20
#: By how much the next round of the search looks further.
FURTHER = 8

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("c", pa.int64()), ("d", pa.int64())])


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_FOLD).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts: occurrences c and documents d of each term in each group, and a row without a term for each group."""
    settle(__name__)
    tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    groups: set[tuple[str, str]] = set()

    def rows():
        for (lang, source), (c, d) in tables.items():
            names = list(c)
            for i in range(0, len(names), 50_000):
                some = names[i : i + 50_000]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([source] * n), pa.array(some, pa.binary()).cast(pa.string()), pa.array([c[t] for t in some]), pa.array([d[t] for t in some])], schema=_COUNTS)
        tables.clear()

    held = 0
    for batch in batches:
        for piece in slices([batch], "text", 1 << 20):
            texts = piece.column("text").cast(pa.binary()).to_pylist()
            for lang, source, text in zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist(), texts, strict=True):
                group = (lang, source)
                groups.add(group)
                if group not in tables:
                    tables[group] = (Counter(), Counter())
                c, d = tables[group]
                found = terms(text)
                held -= len(c)
                c.update(found)
                d.update(set(found))
                held += len(c)
                if held >= ENTRIES:
                    yield from rows()
                    held = 0
    yield from rows()
    if groups:
        lang, source = zip(*sorted(groups))  # noqa: B905
        n = len(groups)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(source), pa.nulls(n, pa.string()), pa.array([0] * n), pa.array([0] * n)], schema=_COUNTS)


def _probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), exact for any count."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide(count + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + PRIOR * kept))


def postings(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, posts), both written tables.

    groups: g (a number), lang, source, n (N), kept (V) and p0, the p of an absent term. posts: g, lang, source, term, c, p, q and p0 for each kept term that a
    group has.
    """
    ship_package(docs.sparkSession)
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = plain.mapInArrow(_count, "lang string, source string, term string, c long, d long").repartition("lang", "term")
    same = Window.partitionBy("lang", "term")
    summed = parts.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    whole = summed.select("lang", "source", "term", "c", F.sum("c").over(same).alias("all"), F.sum("d").over(same).alias("docs"), F.row_number().over(same.orderBy("source")).alias("i"))
    counts = materialise(whole.where(F.col("term").isNull() | (F.col("docs") >= min_docs)).drop("docs"))
    kept = counts.where("term IS NOT NULL")
    of_lang = kept.where("i = 1").groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_n"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count("*").alias("rows"))
    zero = {"n": 0, "rows": 0, "kept": 0, "lang_n": 0}
    every = counts.where("term IS NULL").select("lang", "source").join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(zero)
    p0 = F.when(F.col("kept") > 0, _probability(F.lit(0), F.col("n"), F.col("kept"))).otherwise(F.lit(0).cast("long"))
    groups = materialise(every.select(F.monotonically_increasing_id().alias("g"), "lang", "source", "n", "kept", "lang_n", "rows", p0.alias("p0")))
    name = F.struct("lang", "source")
    table = groups.select(name.alias("name"), "g", F.col("n").alias("group_n"), "kept", "lang_n", "p0", F.col("rows").alias("n"))
    joined = join_unique(kept.withColumn("name", name).drop("i"), table, "name")
    p, q = _probability(F.col("c"), F.col("group_n"), F.col("kept")), _probability(F.col("all"), F.col("lang_n"), F.col("kept"))
    posts = materialise(joined.select("g", "lang", "source", "term", "c", p.alias("p"), q.alias("q"), "p0"))
    discard(counts)
    return groups, posts


def top_terms(posts: DataFrame, k: int = TOP) -> DataFrame:
    """g, lang, source, term, value (p - q) and rank of each group's k terms with the largest positive p - q; ties by term. The result is a written table."""
    by_bound = Window.partitionBy("g").orderBy(F.col("bound").desc(), F.col("c").desc())
    held = posts.groupBy("g", "c").agg(F.count("*").alias("n"), (F.max("p") - F.min("q")).alias("bound")).where("bound > 0")
    before = F.coalesce(F.sum("n").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = materialise(held.withColumn("before", before).withColumn("key", F.struct("g", "c")))
    best = Window.partitionBy("g").orderBy(F.col("value").desc(), F.col("term").asc())
    rows = posts.where("p > q").select(F.struct("g", "c").alias("key"), "g", "lang", "source", "term", (F.col("p") - F.col("q")).alias("value"))
    chosen, limit, found = buckets.where(F.col("before") < k), k, None
    while True:
        new = join_unique(rows, chosen.select("key", "n"), "key").drop("key")
        pool = new if found is None else new.unionByName(found.drop("rank"))
        was, found = found, materialise(pool.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        if was is not None:
            discard(was)
        kth = found.where(F.col("rank") == k).select("g", F.col("value").alias("kth"))
        unseen = buckets.where(F.col("before") >= limit).join(kth, "g", "left").where(F.col("bound") >= F.coalesce("kth", F.lit(1)))
        limit *= FURTHER
        if unseen.isEmpty():
            discard(buckets)
            return found
        chosen = unseen.where(F.col("before") < limit)


_SUMS = pa.schema([("g", pa.int64()), ("other", pa.int64()), ("value", pa.int64())])


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For two groups, over the terms that both have: abs(p - p') less what `_alone` counts of the term for either."""
    total: dict[tuple[int, int], int] = {}

    def rows():
        (g, other), value = zip(*total), list(total.values())  # noqa: B905
        total.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (g + other, other + g, value + value)], schema=_SUMS)

    def add(g, p, p0, left, right) -> None:
        """Pairs of the places left and right, which may be blocks of places (each row of left with that of right)."""
        a, b = p[left], p[right]
        a0, b0 = p0[left], p0[right]
        value = (np.abs(a - b) - np.abs(a - b0) - np.abs(a0 - b) + np.abs(a0 - b0)).ravel()
        names, place = np.unique(np.concatenate([g[left].ravel(), g[right].ravel()]), return_inverse=True)
        half = len(value)
        key = place[:half] * len(names) + place[half:]
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        sums = np.add.reduceat(value[order], starts)
        for k, v in zip(key[starts].tolist(), sums.tolist(), strict=True):
            pair = (int(names[k // len(names)]), int(names[k % len(names)]))
            total[pair] = total.get(pair, 0) + v

    def runs(g, p, p0, starts):
        sizes = np.diff(starts)
        for d in np.unique(sizes[sizes > 1]):
            at = starts[:-1][sizes == d]
            if d * (d - 1) // 2 <= PAIRS:
                i, j = np.triu_indices(int(d), 1)
                step = max(1, PAIRS // len(i))
                for x in range(0, len(at), step):
                    add(g, p, p0, at[x : x + step, None] + i, at[x : x + step, None] + j)
            else:  # a term of very many groups, some of them at a time
                for a in at.tolist():
                    for i in range(int(d) - 1):
                        for x in range(i + 1, int(d), PAIRS):
                            right = np.arange(a + x, a + min(x + PAIRS, int(d)))
                            add(g, p, p0, np.full(len(right), a + i), right)
            if len(total) > PAIRS:
                yield rows()

    rest = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        own = [np.concatenate([r, batch.column(c).to_numpy(zero_copy_only=False)]) for r, c in zip(rest, ("g", "p", "p0"), strict=True)]
        flags = np.concatenate([np.zeros(len(rest[0]), bool), batch.column("first").to_numpy(zero_copy_only=False)])
        flags[:1] = True
        starts = np.flatnonzero(flags)  # the last term may go on in the next batch
        yield from runs(*own, starts)
        rest = [x[starts[-1] :] for x in own]
    if len(rest[0]):
        yield from runs(*rest, np.array([0, len(rest[0])]))
    if total:
        yield rows()


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a group and each other one: the sum over the group's terms of abs(p - p0') - abs(p0 - p0'), and once what all terms give if both lack them."""
    for batch in batches:
        for r in batch.to_pylist():
            g, p0, kept = r["g"], r["p0"], r["kept"]
            held = sorted((x["p"], x["n"]) for x in r["buckets"] or ())
            p, n = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
            others = sorted((x["p0"], x["g"]) for x in r["others"] if x["g"] != g)
            if not others:
                continue
            q0, names = np.array([x[0] for x in others], np.int64), np.array([x[1] for x in others], np.int64)
            count, mass = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(p * n)])
            below = np.searchsorted(p, q0)  # terms with a smaller p than the other's p0
            value = q0 * count[below] - mass[below] + mass[-1] - mass[below] - q0 * (count[-1] - count[below]) - count[-1] * np.abs(p0 - q0)
            half = np.where(names > g, kept * np.abs(p0 - q0), 0)
            for x in range(0, len(names), 100_000):
                own, other, v = np.full(len(names[x : x + 100_000]), g), names[x : x + 100_000], (value + half)[x : x + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in ((own, other), (other, own), (v, v))], schema=_SUMS)


def pair_distances(groups: DataFrame, posts: DataFrame) -> DataFrame:
    """g, other and value, the sum of abs(p - p') over all kept terms, for each two groups of a language, both ways."""
    ship_package(posts.sparkSession)
    turn = Window.partitionBy("lang", "term").orderBy("g")
    runs = posts.select("lang", "term", "g", "p", "p0").withColumn("first", F.row_number().over(turn) == 1).select("g", "p", "p0", "first")
    both = runs.mapInArrow(_both, "g long, other long, value long")
    buckets = posts.groupBy("g", "p").agg(F.count("*").alias("n")).groupBy("g").agg(F.collect_list(F.struct("p", "n")).alias("buckets"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("g", "p0")).alias("others"))
    alone = groups.join(buckets, "g", "left").join(others, "lang").select("g", "p0", "kept", "buckets", "others").mapInArrow(_alone, "g long, other long, value long")
    return both.unionByName(alone).groupBy("g", "other").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, k: int = TOP) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value and rank: every pair of a language's sources, and each group's k terms that stand out most."""
    groups, posts = postings(docs, min_docs)
    best = top_terms(posts, k).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    size = groups.groupBy("lang").agg(F.count("*").alias("n"))
    names = groups.select("g", "lang", "source").join(size, "lang")  # n: a group's rows of pairs
    first = join_unique(pair_distances(groups, posts), names, "g").withColumnRenamed("g", "own")
    both = join_unique(first, names.select(F.col("g").alias("other"), F.col("source").alias("item"), "n"), "other")
    order = Window.partitionBy("own").orderBy(F.col("value").desc(), F.col("item").asc())
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return pairs.unionByName(best)


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
     w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
     k AS (SELECT lang, term, count(*) AS all_c FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= {MIN_DOCS}),
     l AS (SELECT lang, count(*) AS v, sum(all_c)::HUGEINT AS m FROM k GROUP BY lang),
     c AS (SELECT w.lang, source, w.term, count(*) AS c FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, source, w.term),
     g AS (SELECT d.lang, d.source, coalesce(any_value(s.n), 0)::HUGEINT AS n FROM d LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source) s
           ON s.lang = d.lang AND s.source = d.source GROUP BY d.lang, d.source),
     f AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + ({SCALE}::HUGEINT * (coalesce(c.c, 0) + {PRIOR})) // (g.n + {PRIOR} * l.v) AS p,
                  1 + ({SCALE}::HUGEINT * (k.all_c + {PRIOR})) // (l.m + {PRIOR} * l.v) AS q
           FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
     pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(x.value), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN (SELECT u.lang, u.source, o.source AS other, sum(abs(u.p - o.p)) AS value FROM f u JOIN f o ON u.lang = o.lang AND u.term = o.term AND u.source <> o.source
                         GROUP BY 1, 2, 3) x ON x.lang = a.lang AND x.source = a.source AND x.other = b.source GROUP BY 1, 2, 3, 4),
     term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM f WHERE c > 0 AND p > q),
     both_parts AS (SELECT * FROM pair UNION ALL SELECT * FROM term)
SELECT lang, source, part, item, value::BIGINT AS value, r::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM both_parts) WHERE part = 'pair' OR r <= {TOP}
"""
