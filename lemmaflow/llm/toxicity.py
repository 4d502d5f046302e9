"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read a clause as a row of symbols (classes of words, and quotation marks). Each has
arcs (state, symbol) -> (next state, mark); `compose` runs them side by side and makes one automaton of
their reachable product, whose arcs carry a label that follows from all five marks together:

* insult: marks words and word beginnings of the lexicon (seeds, and what labelled rows teach);
* target: marks an insult near a word that addresses or points at someone, before or behind it;
* threat: marks a modal or a first person, then a verb of harm, then a target, also where the one
  addressed comes first ("you, I will ...");
* negation: marks what stands within NEGATION_SCOPE words behind a negation;
* reported speech: marks the rest of a clause behind a verb of saying, and what stands in quotation marks.

Arcs of a label have one weight; a clause weighs the sum, over the arcs that it takes, of the arc's
weight times the word's. Each matched clause is toxic with a logistic probability of its weight, and a
text is toxic unless none of its clauses is: score = 1 - (1 - p0) * product of (1 - p). Clauses without a
match don't count, and a text without any has the score p0.

Arc weights are learned with the lexicon from labelled rows alone, around PRIOR weights: where labels say
nothing about an arc (no threat among them, say) its prior holds. They are fitted out of fold: the
sample is dealt into FOLDS by a hash of the text, and a fold's clauses are read with the lexicon that the
other folds teach. The final lexicon comes from all of the sample.

The lexicon and the fit use at most `limit` labelled ids of each label (those with the smallest hash of
their id), one text each, distinct by text. A learned word stands in a share MIN_SHARE of the
sample's toxic texts, so there are at most 1 / MIN_SHARE times as many as an average text of them has. Every scored text is
read whole, however long.

Edge cases: null or empty text has the score p0. Rows are independent: repeated rows
repeat, null doc_ids are carried (and teach nothing), an empty table stays empty, extra columns are not carried. Without labels of both kinds only
the seed lexicon and the prior weights count.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, map_text

LIMIT = 8000
THRESHOLD = 0.3
FOLDS = 4
NEGATION_SCOPE = 3
TARGET_SCOPE = 4
#: Lengths of the learned word beginnings; 0 is the whole word.
BEGINNINGS = (4, 5, 6, 7, 8, 0)
#: A learned word or beginning stands in at least so many toxic texts of the sample, and in this share of them.
MIN_TEXTS = 3
MIN_SHARE = 0.005
#: Least log odds of a learned word.
MIN_ODDS = 3.0
CACHE_ENTRIES = 400_000

INSULTS = {w: 2.0 for w in "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown clowns imbecile dumb fool fools filth vermin scumbag bastard jerk dimwit idioten dummkopf abschaum versager connard abruti imbécile crétin idiota estúpido imbécil basura".split()}
VERBS_OF_HARM = {w: 1.0 for w in "kill hurt destroy beat shoot stab hang crush burn smash töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir".split()}
SELF = set("i i'll i'm we we'll ich wir je j'ai nous yo nosotros".split())
MODAL = set("will gonna shall should must werde werden wird vais allons va voy vamos va".split())
ADDRESSED = set("you your you're yours du dich dir ihr euch dein euer tu te toi vous tú ti vosotros usted ustedes".split())
POINTED = set("u he she they him them his her those these people everyone sie er ihn ihm ils elles il elle eux lui ellos ellas él ella".split())
NEGATIONS = set("not no never isn't aren't wasn't don't doesn't nobody none without nicht kein keine nie niemals pas jamais aucun aucune nunca jamás tampoco".split())
SAYING = set("said says say saying wrote writes called calls reported reports quoted quotes claimed allegedly sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split())

_CLAUSE = re.compile(r"[.!?;:\n]+")
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'") + "«»“”„…—–¿¡"
_QUOTES = "\"“”«»„"

WORD_SYMBOLS = ("other", "insult", "harm", "self", "modal", "addressed", "pointed", "negation", "saying")
SYMBOLS = (*WORD_SYMBOLS, "open", "close")
LABELS = ("plain insult", "aimed insult", "target behind insult", "negated insult", "reported insult", "threat", "negated or reported threat")
PRIOR = np.array([1.0, 1.4, 0.4, 0.2, 0.3, 1.5, 0.3])
PRIOR_BIAS, PRIOR_NONE = -3.0, -3.5
RIDGE = 0.002


# The transducers: start state and arcs {(state, symbol): (next state, mark or None)}.


def insult_transducer():
    return 0, {(0, s): (0, "insult" if s == "insult" else None) for s in SYMBOLS}


def target_transducer(scope: int = TARGET_SCOPE):
    """State: words for which a target before and an insult without one still count."""
    arcs = {}
    for t in range(scope + 1):
        for i in range(scope + 1):
            for s in WORD_SYMBOLS:
                nxt, mark = (max(0, t - 1), max(0, i - 1)), None
                if s in ("addressed", "pointed"):
                    nxt, mark = (scope, 0), "target behind" if i else None
                elif s == "insult":
                    nxt, mark = (nxt[0], 0 if t else scope), "aimed" if t else None
                arcs[(t, i), s] = nxt, mark
            for s in ("open", "close"):
                arcs[(t, i), s] = (t, i), None
    return (0, 0), arcs


def threat_transducer():
    """State: whether a first person or modal, a verb of harm behind it, and a person addressed have been read."""
    arcs = {}
    for who in ("", "modal", "self"):
        for harm in (False, True):
            for you in (False, True):
                for s in SYMBOLS:
                    nxt, mark = (who, harm, you), None
                    if s == "self" or (s == "modal" and who != "self"):
                        nxt = (s, harm, you)
                    elif s == "harm" and who:
                        nxt, mark = ((who, False, you), "threat") if you and who == "self" else ((who, True, you), None)
                    elif s in ("addressed", "pointed"):
                        nxt, mark = ((who, False, you), "threat") if harm else ((who, harm, you or s == "addressed"), None)
                    arcs[(who, harm, you), s] = nxt, mark
    return ("", False, False), arcs


def negation_transducer(scope: int = NEGATION_SCOPE):
    """State: words left in a negation's scope."""
    arcs = {}
    for k in range(scope + 1):
        for s in WORD_SYMBOLS:
            arcs[k, s] = (scope, None) if s == "negation" else (max(0, k - 1), "negated" if k else None)
        for s in ("open", "close"):
            arcs[k, s] = k, None
    return 0, arcs


def reported_transducer():
    """State: whether a verb of saying has been read, and whether quotation marks are open."""
    arcs = {}
    for said in (False, True):
        for quoted in (False, True):
            for s in SYMBOLS:
                arcs[(said, quoted), s] = (said or s == "saying", s == "open" or (quoted and s != "close")), "reported" if said or quoted else None
    return (False, False), arcs


def _label(marks: set) -> int:
    """Index of the label that a set of marks makes; -1: none."""
    held = marks & {"negated", "reported"}
    if "threat" in marks:
        return LABELS.index("negated or reported threat" if held else "threat")
    if "insult" in marks:
        return LABELS.index("reported insult" if "reported" in marks else "negated insult" if held else "aimed insult" if "aimed" in marks else "plain insult")
    return LABELS.index("target behind insult") if "target behind" in marks and not held else -1


def compose(*parts) -> tuple[list[list[int]], list[list[int]]]:
    """Next state and label by state and symbol of the reachable product of transducers; state 0 is the start."""
    start = tuple(first for first, _ in parts)
    index, todo, after, label = {start: 0}, [start], [], []
    while todo:
        state = todo.pop(0)
        after.append([])
        label.append([])
        for s in SYMBOLS:
            steps = [arcs[own, s] for own, (_, arcs) in zip(state, parts)]
            nxt = tuple(n for n, _ in steps)
            if nxt not in index:
                index[nxt] = len(index)
                todo.append(nxt)
            after[-1].append(index[nxt])
            label[-1].append(_label({m for _, m in steps if m}))
    return after, label


@lru_cache(maxsize=1)
def automaton():
    return compose(insult_transducer(), target_transducer(), threat_transducer(), negation_transducer(), reported_transducer())


_KINDS = (("harm", VERBS_OF_HARM), ("negation", NEGATIONS), ("addressed", ADDRESSED), ("pointed", POINTED), ("saying", SAYING), ("self", SELF), ("modal", MODAL))


class Grammar:
    """The automaton with a lexicon: reads texts clause by clause."""

    def __init__(self, learned: dict[str, float]):
        self.learned = learned  # "word" or "word*"
        self.after, self.label = automaton()
        self.kept: dict[str, tuple] = {}
        self.hot: set[str] = set()  # tokens of kept in which a match may end or begin

    def word(self, raw: str) -> tuple[str, float]:
        """Symbol and weight of a raw token's word."""
        w = raw.strip(_STRIP)
        if not w:
            return "other", 0.0
        best, learned = INSULTS.get(w, 0.0), self.learned
        for n in BEGINNINGS:
            x = learned.get(w if n == 0 else w[:n] + "*") if n == 0 or len(w) >= n else None
            if x is not None and x > best:
                best = x
        if best:
            return "insult", best
        return next(((kind, 1.0) for kind, words in _KINDS if w in words), ("other", 0.0))

    def read(self, raw: str) -> tuple:
        """Symbols (index, weight) of a raw token, with its quotation marks."""
        got = self.kept.get(raw)
        if got is None:
            kind, weight = self.word(raw)
            symbols = [(SYMBOLS.index(kind), weight)]
            if raw[0] in _QUOTES:
                symbols.insert(0, (SYMBOLS.index("open"), 0.0))
            if len(raw) > 1 and raw[-1] in _QUOTES:
                symbols.append((SYMBOLS.index("close"), 0.0))
            got = self.kept[raw] = tuple(symbols)
            if kind in ("insult", "harm"):
                self.hot.add(raw)
        return got

    def clause(self, words: list[str]) -> list[tuple[int, float]]:
        """Labels and word weights of the arcs that a clause takes."""
        state, out, last = 0, [], 0.0
        after, label, read = self.after, self.label, self.read
        for raw in words:
            for symbol, weight in read(raw):
                if symbol in (1, 2):
                    last = weight
                k = label[state][symbol]
                if k >= 0:
                    out.append((k, last))
                state = after[state][symbol]
        return out

    def clauses(self, text: str | None) -> list[list[tuple[int, float]]]:
        """The matched clauses of a text."""
        if len(self.kept) > CACHE_ENTRIES:
            self.kept.clear()
            self.hot.clear()
        low, hot = (text or "").lower(), self.hot
        tokens = set(low.split())
        for t in tokens.difference(self.kept):
            self.read(t)
        if hot.isdisjoint(tokens):
            return []
        out = []
        for words in map(str.split, _CLAUSE.split(low)):
            for t in words:
                self.read(t)  # a clause's end can cut a token
            if not hot.isdisjoint(words):
                out.append(self.clause(words))
        return [x for x in out if x]

    def features(self, text: str | None) -> list[list[float]]:
        """Word weights by label of each matched clause."""
        out = []
        for arcs in self.clauses(text):
            out.append([0.0] * len(LABELS))
            for k, weight in arcs:
                out[-1][k] += weight
        return out


def _softplus(x):
    return np.logaddexp(0, x)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Lexicon, arc weights, biases of a matched clause and of a text, and the shift of log odds from the sample to all labels."""

    def __init__(self, learned: dict[str, float], weights=PRIOR, bias: float = PRIOR_BIAS, none: float = PRIOR_NONE, shift: float = 0.0):
        self.learned, self.weights, self.bias, self.none, self.shift = learned, np.asarray(weights, float), float(bias), float(none), float(shift)

    def score(self, texts: list[list[list[float]]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of texts given by their clauses' features, and the weight of each one's heaviest clause."""
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        flat = np.array([c for t in texts for c in t], float).reshape(-1, len(LABELS))
        weight = flat @ self.weights
        clean = -_softplus(self.none) - np.bincount(owner, _softplus(weight + self.bias), len(texts))  # log of the probability of not toxic
        odds = np.log(np.maximum(-np.expm1(clean), 1e-300)) - clean
        top = np.zeros(len(texts))
        np.maximum.at(top, owner, weight)
        return _sigmoid(odds + self.shift), top


def fit_weights(texts: list[list[list[float]]], toxic: np.ndarray, steps: int = 600) -> tuple[np.ndarray, float, float]:
    """Arc weights (not below zero) and both biases of least loss: mean log loss of the texts, and RIDGE times the squared distance from PRIOR."""
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    x = np.c_[np.array([c for t in texts for c in t], float).reshape(-1, len(LABELS)), np.ones(len(owner))]
    n, yes = len(texts), toxic.astype(bool)
    theta = np.r_[PRIOR, PRIOR_BIAS, PRIOR_NONE]
    prior, first, second = theta.copy(), np.zeros(len(theta)), np.zeros(len(theta))
    for k in range(1, steps + 1):  # Adam
        z = x @ theta[:-1]
        clean = -_softplus(theta[-1]) - np.bincount(owner, _softplus(z), n)
        g = np.where(yes, np.exp(clean) / np.maximum(-np.expm1(clean), 1e-12), -1.0) / n
        grad = np.r_[-(x.T @ (g[owner] * _sigmoid(z))), -g.sum() * _sigmoid(theta[-1])] + RIDGE * (theta - prior) * np.r_[np.ones(len(LABELS)), 0, 0]
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta - 0.05 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        theta[: len(LABELS)] = np.maximum(theta[: len(LABELS)], 0)
    return theta[: len(LABELS)], float(theta[-2]), float(theta[-1])


def _score(texts, state, model: Model, matches: bool):
    g = state.get("g")
    if g is None:
        g = state["g"] = Grammar(model.learned)
    score, top = model.score([g.features(t) for t in texts])
    out = {"score": score, "clause_weight": top}
    if matches:
        out["matches"] = [[{"clause": i, "label": LABELS[k], "weight": float(model.weights[k] * w)} for i, arcs in enumerate(g.clauses(t)) for k, w in arcs] for t in texts]
    return out


def _fold(text: str | None) -> int:
    return zlib.crc32((text or "").encode()) % FOLDS


def _count_beginnings(batches):
    import pyarrow as pa

    total: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            fold, seen = _fold(text), set()
            for w in {t.strip(_STRIP) for t in set((text or "").lower().split())}:
                for n in BEGINNINGS:
                    if n == 0 and w:
                        seen.add(w)
                    elif n and len(w) >= n:
                        seen.add(w[:n] + "*")
            for x in seen:
                total.setdefault((x, fold), [0, 0])[toxic] += 1
    # All counts go on: only sums over tasks are compared with MIN_TEXTS.
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
    cols = ([k[0] for k in total], [k[1] for k in total], [v[0] for v in total.values()], [v[1] for v in total.values()])
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["x", "fold", "clean", "toxic"])


def _features(texts, state, lexicons):
    if "g" not in state:
        state["g"] = [Grammar(x) for x in lexicons]
    return {"f": [state["g"][_fold(t)].features(t) for t in texts]}


def sample(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(text, toxic) of at most `limit` labelled ids of each label, one text an id, distinct by text; a text of both labels counts as toxic."""
    lab = labels.select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).where("l_id is not null and toxic in (0, 1)")
    order = F.xxhash64("l_id")
    ids = lab.groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    drawn = ids.where("toxic = 1").orderBy(order, "l_id").limit(limit).unionAll(ids.where("toxic = 0").orderBy(order, "l_id").limit(limit))
    rows = docs.select(F.col("doc_id").alias("d_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), F.col("d_id") == F.col("l_id"))  # at most 2 * limit ids
    one = rows.groupBy("d_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return one.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _lexicon(counts: list, use: list[int], n: np.ndarray) -> dict[str, float]:
    """Words and beginnings that the folds `use` teach; n[fold] has their clean and toxic texts."""
    clean, toxic = n[use].sum(0)
    if not clean or not toxic:
        return {}
    least = max(MIN_TEXTS * len(use) / FOLDS, MIN_SHARE * toxic)
    out = {}
    for x, c, t in counts:
        a, b = sum(c[k] for k in use), sum(t[k] for k in use)
        odds = np.log((b + 0.5) / (toxic + 1)) - np.log((a + 0.5) / (clean + 1))
        if b >= least and odds > MIN_ODDS:
            out[x] = float(min(4.0, odds / 2))
    return out


def fit(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> Model:
    """Lexicon and weights from labelled rows of docs (doc_id, text) and labels (doc_id, toxic)."""
    from .common import discard, materialise, ship_package

    ship_package(docs.sparkSession)
    rows = materialise(sample(docs, labels, limit))
    n = np.zeros((FOLDS, 2), int)
    folds = F.pmod(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.lit(FOLDS))
    for r in rows.groupBy(folds.alias("fold"), "toxic").count().collect():
        n[r["fold"], r["toxic"]] = r["count"]
    if not n[:, 0].sum() or not n[:, 1].sum():
        return Model({})
    by_fold = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("fold") == k, F.col(c))), F.lit(0)) for k in range(FOLDS)])
    counts = rows.mapInArrow(_count_beginnings, "x string, fold int, clean long, toxic long").groupBy("x").agg(by_fold("clean").alias("clean"), by_fold("toxic").alias("toxic"), F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    # Candidates: seen often enough for some set of folds, and likelier in toxic texts of the whole sample.
    yes, no = int(n[:, 1].sum()), int(n[:, 0].sum())
    often = counts.where((F.col("t") >= max(MIN_TEXTS * (FOLDS - 1) / FOLDS, MIN_SHARE * yes / 2)) & (F.col("c") * yes <= F.col("t") * no))
    strong = [(r["x"], r["clean"], r["toxic"]) for r in often.select("x", "clean", "toxic").collect()]
    strong.sort()
    lexicons = [_lexicon(strong, [k for k in range(FOLDS) if k != fold], n) for fold in range(FOLDS)]
    got = map_text(rows, "text", partial(_features, lexicons=lexicons), "f array<array<double>>").select(F.xxhash64("text").alias("h"), "f", "toxic").toArrow().to_pylist()
    got.sort(key=lambda r: r["h"])  # rows arrive in any order; the fit must not depend on it
    weights, bias, none = fit_weights([r["f"] for r in got], np.array([r["toxic"] for r in got]))
    discard(rows)
    # The sample has another share of toxic texts than the labels: move the log odds to theirs.
    whole = dict(labels.where("toxic in (0, 1)").groupBy(F.col("toxic").cast("int").alias("toxic")).count().collect())
    return Model(_lexicon(strong, list(range(FOLDS)), n), weights, bias, none, np.log(whole[1] / whole[0]) - np.log(yes / no))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", matches: bool = True) -> DataFrame:
    """doc_id, score (0 to 1), clause_weight (the heaviest clause's) and matches array<struct<clause, label, weight>>
    (the arcs that matched clauses took; clauses counted among those matched) of every row."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    added = "score double, clause_weight double" + ", matches array<struct<clause:int,label:string,weight:double>>" * matches
    return map_text(plain, "text", partial(_score, model=model, matches=matches), added).drop("text")


def held_out(docs: DataFrame):
    return crc_bucket(docs["doc_id"], 4) == 2
