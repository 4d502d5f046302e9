"""Quality rules judged by an isolation forest.

Rule statistics of a whole text (words, lines, symbols, repeats) are the features of a forest of
random trees. A text's mean path length over the trees gives its anomaly score 2 ** (-path / c).
Each tree grows on its own draw of TREE_ROWS of the well-rated rows, as isolation forests do, within the span of all
labelled rows of both labels; the threshold is the one that best separates the two labels over all labelled rows (balanced
accuracy, at least MIN_KEEP of the well-rated rows stay). Texts that fail the base rules are rejected before that.
Labelled rows stay on the cluster: the driver gets the rows that trees may draw (about TREES * TREE_ROWS, taken by a
hash of the id), counts of rounded feature values, and the threshold.

Ties: rows of equal score are kept or rejected together; of thresholds that separate the labels equally well the lowest is taken.

Edge cases: null or empty text has no words and fails the base rule on length. Without labelled rows
of both kinds nothing is calibrated and the base rules decide alone. Rows are independent: repeated
rows repeat, null doc_ids are carried (and calibrate nothing), an empty table stays empty; extra columns are carried by
`keep_good`, whatever their names, and not by `judge`. Very long texts are read whole.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import running_sum
from .common import FEW, discard, map_text, materialise

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
TREES = 200
TREE_ROWS = 256
MIN_KEEP = 0.98

_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
FEATURES = ("symbol_share", "dup_line_share", "repeat_share", "word_length", "upper_share", "digit_share", "mark_share", "word_variety", "pipe_share", "exclaim_share")


def rule_statistics(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the features."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, len(raw) - len(raw.translate(None, _SYMBOLS)), 0, 0, (0.0,) * len(FEATURES)
    blank = sum(map(text.count, " \t\n\x0b\x0c\r"))
    chars = len(text) - blank
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = raw.split(b"\n")
    full = [x for x in lines if x and x.translate(None, _SPACES)]
    dup = len(full) - len(set(full))
    repeat = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        seen: set = set()
        twice: set = set()
        if len(set(windows)) < len(windows):
            for w in windows:
                if w in seen:
                    twice.add(w)
                else:
                    seen.add(w)
            until = 0
            for i, w in enumerate(windows):
                if w in twice:
                    repeat += i + 3 - max(until, i)
                    until = i + 3
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digit = len(raw) - len(raw.translate(None, b"0123456789"))
    mark = len(raw) - len(raw.translate(None, b".,;:?!'\"()-"))
    f = (symbols / chars, dup / max(1, len(full)), repeat / n, chars / n, upper / chars, digit / chars, mark / chars, len(set(words)) / n**0.8, raw.count(b"|") / n, raw.count(b"!") / n)
    return n, chars, symbols, dup, repeat, f


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED * n_words


def _expected(n):
    """Mean path of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as arrays, read level by level for many rows at once.

    A cut is drawn from the whole span that a feature has left in a node's box, not only from that of
    the node's own rows, so that a box without any well-rated row is reached by a short path.
    """

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        m = min(tree_rows, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(2, m)))))
        self.norm = float(max(_expected(m), 1e-9))
        size = 2 ** (self.depth + 1)
        self.feature = np.full((trees, size), -1, np.int16)
        self.cut = np.zeros((trees, size))
        self.path = np.zeros((trees, size))
        for t in range(trees):
            todo = [(1, 0, rows[rng.choice(len(rows), m, replace=False)], low, high)]
            while todo:
                node, level, part, a, b = todo.pop()
                open_ = np.flatnonzero(b > a)
                if level == self.depth or len(part) < 2 or not len(open_):
                    self.path[t, node] = level + _expected(len(part))
                    continue
                f = int(rng.choice(open_))
                cut = rng.uniform(a[f], b[f])
                left = part[:, f] <= cut
                self.feature[t, node], self.cut[t, node] = f, cut
                a2, b2 = a.copy(), b.copy()
                b2[f] = a2[f] = cut
                todo += [(2 * node, level + 1, part[left], a, b2), (2 * node + 1, level + 1, part[~left], a2, b)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / c) of each row."""
        total = np.zeros(len(x))
        at = np.arange(len(x))
        for feature, cut, path in zip(self.feature, self.cut, self.path):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                go = f >= 0
                right = x[at, np.maximum(f, 0)] > cut[node]
                node = np.where(go, 2 * node + right, node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


class Model:
    def __init__(self, forest: Forest | None, threshold: float):
        self.forest, self.threshold = forest, threshold


def calibrate(scored: DataFrame, n_good: int, n_bad: int, min_keep: float = MIN_KEEP) -> float:
    """The highest score kept, from rows (score, good): best balanced accuracy among thresholds that keep min_keep of the good rows."""
    counts = materialise(scored.groupBy("score").agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b")))
    d = counts
    for c in ("g", "b"):
        d = running_sum(d, [F.col("score")], F.floor(F.col("score") * 4096), F.col(c), f"{c}_before")
    big = lambda c: c.cast("decimal(18,0)")
    good, bad = F.col("g") + F.col("g_before"), F.col("b") + F.col("b_before")
    best = d.where(good >= min_keep * n_good).orderBy((big(good) * big(F.lit(n_bad)) - big(bad) * big(F.lit(n_good))).desc(), "score").select("score").first().score
    after = counts.where(F.col("score") > best).agg(F.min("score")).first()[0]
    discard(counts)
    return best if after is None else (best + after) / 2


def _train(texts, state):
    rows = [rule_statistics(t) for t in texts]
    return {"f": [list(r[5]) for r in rows], "failed": [base_fails(r[0], r[4]) for r in rows]}


def _score(features, state, forest: Forest):
    return {"score": forest.score(np.array(features, float).reshape(-1, len(FEATURES)))}


def spans(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The quantiles 0.005 and 0.995 of each feature over all rows, of values rounded down to nine binary digits."""
    step = F.pow(F.lit(2.0), F.floor(F.log2("v")) - 8)
    values = rows.select(F.posexplode("f").alias("k", "v")).select("k", F.when(F.col("v") > 0, F.floor(F.col("v") / step) * step).otherwise(0.0).alias("v"))
    got = sorted(tuple(r) for r in values.groupBy("k", "v").agg(F.count("*").alias("n")).collect())
    low, high = np.zeros(len(FEATURES)), np.zeros(len(FEATURES))
    for k in range(len(FEATURES)):
        own = np.array([(v, c) for i, v, c in got if i == k])
        at = np.searchsorted(own[:, 1].cumsum(), (0.005 * n, 0.995 * n))
        low[k], high[k] = own[np.minimum(at, len(own) - 1), 0]
    return low, high


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """d_id, f (features) and good of all labelled ids whose text passes the base rules: one text each, and an id of both labels is bad."""
    lab = labels.select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("quality")).where("l_id is not null and quality in (0, 1)")
    ids = materialise(lab.groupBy("l_id").agg((F.min("quality") == 1).alias("good")))
    texts = docs.select(F.col("doc_id").alias("d_id"), F.col("text").cast("string").alias("text"))
    features = lambda d: map_text(d, "text", _train, "f array<double>, failed boolean").drop("text")
    on = F.col("d_id") == F.col("l_id")
    rows = features(texts.join(F.broadcast(ids), on)) if ids.count() <= FEW else features(texts.where("d_id is not null")).join(ids, on)  # no texts are shuffled
    one = rows.groupBy("d_id", "good").agg(F.min(F.struct("f", "failed")).alias("x"))
    return one.where("not x.failed").select("d_id", "x.f", "good")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Forest and threshold from all labelled ids."""
    rows = materialise(labelled(docs, labels))
    n_good, n_bad = rows.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    if not n_good or not n_bad:
        return Model(None, 1.0)
    part = min(1.0, TREES * TREE_ROWS / n_good)
    drawn = rows.where("good").where(F.pmod(F.xxhash64("d_id"), F.lit(1 << 31)) < int(part * (1 << 31))).select("d_id", "f").toArrow()
    f = np.array(drawn["f"].to_pylist(), float).reshape(-1, len(FEATURES))
    f = f[np.lexsort([*f.T, drawn["d_id"].to_numpy()])]  # rows arrive in any order; the forest must not depend on it
    forest = Forest(f, *spans(rows, n_good + n_bad))
    threshold = calibrate(map_text(rows, "f", partial(_score, forest=forest), "score double").select("score", "good"), n_good, n_bad)
    discard(rows)
    return Model(forest, threshold)


def _judge(texts, state, model: Model, only_kept: bool):
    rows = [rule_statistics(t) for t in texts]
    failed = np.array([base_fails(r[0], r[4]) for r in rows], bool)
    score = np.ones(len(rows))
    if model.forest is not None and (~failed).any():
        score[~failed] = model.forest.score(np.array([r[5] for r in rows], float)[~failed])
    kept = ~failed & ((score <= model.threshold) if model.forest is not None else True)
    if only_kept:
        return {"__keep__": kept.tolist()}
    out = {k: [r[i] for r in rows] for i, k in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}
    return out | {"base_failed": failed, "anomaly": score, "kept": kept}


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the rule statistics, base_failed, anomaly and kept of every row; extra columns are not carried."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    added = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, anomaly double, kept boolean"
    return map_text(plain, "text", partial(_judge, model=model, only_kept=False), added).drop("text")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    return map_text(docs, "text", partial(_judge, model=model, only_kept=True), "")
