"""Language identification: script ranges, per-word scores, Viterbi over the words.

Each language has a character-trigram model of its words. A word's script leaves only the languages
whose training text uses that script; among them the word's log-likelihoods are the emission scores,
and a switch of language between neighbouring words costs SWITCH. The best path labels every word;
runs of one label are the spans of a mixed text. The prediction is the language that labels the most
letters (ties: the likelier one, then the first by name), its score the share of letters so labelled
times the language's posterior over those words.

The models are fitted on a sample of at most about `limit` training rows a language, drawn by a hash
of the row's id; every other step sees every row and whole texts.

Very long texts are read whole; their words take turns of their own in the Viterbi pass, in time in proportion to
their number. `fit` refuses more than LANGS different values of lang.

Edge cases: null text, or text without a letter, is `und` with score 0 and no spans. Words in a
script that no language has score alike for all. Rows are independent: repeated rows repeat, an empty
table stays empty, null doc_ids are carried, extra columns are not. Without a training row nothing can be learned and
all rows are `und`.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, map_text

UND = "und"
SWITCH = 8.0
LIMIT = 3000
#: Most languages; a model's tables hold 1 MB for each.
LANGS = 500
CACHE_ENTRIES = 300_000
BUCKETS = 1 << 16

#: First code points of script blocks, and their scripts. Fixed values of Unicode.
SCRIPT_STARTS = [
    (0x0000, "common"), (0x0041, "latin"), (0x0250, "latin"), (0x02B0, "common"), (0x0370, "greek"), (0x0400, "cyrillic"),
    (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "common"), (0x2C60, "latin"),
    (0x2C80, "coptic"), (0x2E00, "common"), (0x3040, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"), (0x3400, "han"),
    (0xA000, "yi"), (0xA640, "cyrillic"), (0xA720, "latin"), (0xAC00, "hangul"), (0xD800, "common"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "common"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0xFFE0, "common"), (0x20000, "han"), (0x30000, "han"),
]
_STARTS = np.array([a for a, _ in SCRIPT_STARTS])
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})
_SCRIPT_OF = np.array([SCRIPTS.index(s) for _, s in SCRIPT_STARTS])

_BEGIN, _END = "\x02", "\x03"


def letters_of(token: str) -> str:
    low = token.lower()
    return low if low.isalpha() else "".join(c for c in low if c.isalpha())


def _grams(words: list[str]):
    """Code points, trigram and context buckets of each scored place, and the first place of each word."""
    text = "".join([f"{_BEGIN}{_BEGIN}{w}{_END}" for w in words])
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    a, b, x = c[:-2], c[1:-1], c[2:]
    context = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    tri = context * np.uint64(31) + x * np.uint64(0x165667B19E3779F9)
    tri ^= tri >> np.uint64(29)
    tri *= np.uint64(0xBF58476D1CE4E5B9)
    context ^= context >> np.uint64(29)
    context *= np.uint64(0xBF58476D1CE4E5B9)
    at = np.flatnonzero(x != 2)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    return x[at], (tri[at] >> np.uint64(48)).astype(np.int64), (context[at] >> np.uint64(48)).astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]]


def _count_grams(batches, langs):
    """Trigram, context and script counts of a task's training rows."""
    import pyarrow as pa

    index = {x: i for i, x in enumerate(langs)}
    total = np.zeros((len(langs), 2 * BUCKETS + len(SCRIPTS)), np.int64)
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            words = [w for w in map(letters_of, text.split()) if w]
            if not words:
                continue
            x, tri, context, _ = _grams(words)
            row = total[index[lang]]
            row[:BUCKETS] += np.bincount(tri, minlength=BUCKETS)
            row[BUCKETS : 2 * BUCKETS] += np.bincount(context, minlength=BUCKETS)
            script = _SCRIPT_OF[np.searchsorted(_STARTS, x[x != 3].astype(np.int64), "right") - 1]
            row[2 * BUCKETS :] += np.bincount(script, minlength=len(SCRIPTS))
    who, what = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int32)), pa.array(what.astype(np.int32)), pa.array(total[who, what])], ["l", "k", "n"])


class Model:
    """Log-probabilities by language; rows of the tables are languages in order of name."""

    def __init__(self, langs: list[str], counts: np.ndarray, switch: float = SWITCH):
        self.langs, self.switch = langs, switch
        tri, context = counts[:, :BUCKETS].astype(float), counts[:, BUCKETS : 2 * BUCKETS].astype(float)
        scripts = counts[:, 2 * BUCKETS :]
        share = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
        self.uses = share > 0.01
        alpha, alphabet = 0.05, 64
        self.tri = np.log(tri + alpha).T.astype(np.float32).copy()
        self.context = np.log(context + alpha * alphabet).T.astype(np.float32).copy()

    def score(self, words: list[str]) -> np.ndarray:
        """Emission scores (words x languages) of words of letters; a word without letters scores 0."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        at = [i for i, w in enumerate(words) if w]
        if not at:
            return out
        full = [words[i] for i in at]
        x, tri, context, first = _grams(full)
        out[at] = np.add.reduceat(self.tri[tri] - self.context[context], first, axis=0)
        script = _SCRIPT_OF[np.searchsorted(_STARTS, x[first].astype(np.int64), "right") - 1]
        allowed = self.uses[:, script].T
        none = ~allowed.any(1)
        out[at] = np.where(none[:, None], 0, np.where(allowed, out[at], out[at].min(1, keepdims=True) - 50))
        return out


def viterbi(emit: np.ndarray, starts: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """Labels of the best paths of many texts at once: text d has rows starts[d] to starts[d] + sizes[d] of emit."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    n_lang = emit.shape[1]
    kind = np.min_scalar_type(-max(1, n_lang))
    label = np.zeros(len(emit), kind)
    back = np.zeros((len(emit), n_lang), kind)
    own = np.arange(n_lang, dtype=kind)
    v = np.zeros((len(sizes), n_lang), np.float32)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts longer than t
    few = 6
    t = 0
    while t < longest and active[t] > few:
        a = active[t]
        at = starts[:a] + t
        head = v[:a]
        if t:
            arg = head.argmax(1)
            best = head[np.arange(a), arg][:, None] - switch
            stay = head >= best
            back[at] = np.where(stay, own, arg[:, None])
            head = np.where(stay, head, best)
        v[:a] = head + emit[at]
        t += 1
    for d in range(int(np.searchsorted(-sizes, -t, "left"))):  # the few long ones go on alone
        s, n = int(starts[d]), int(sizes[d])
        x = v[d].tolist()
        rows, ptrs = emit[s + t : s + n].tolist(), []
        for k, row in enumerate(rows):
            if t + k:
                top = max(x)
                arg, lim = x.index(top), top - switch
                ptrs.append([j if y >= lim else arg for j, y in enumerate(x)])
                x = [(y if y >= lim else lim) + e for y, e in zip(x, row)]
            else:
                ptrs.append([0] * n_lang)
                x = row
        back[s + t : s + n] = ptrs
        v[d] = x
    cur = v.argmax(1).astype(kind)
    cut = t
    for d in range(int(np.searchsorted(-sizes, -cut, "left"))):
        s, n, c = int(starts[d]), int(sizes[d]), int(cur[d])
        ptrs, path = back[s + cut : s + n].tolist(), []
        for p in reversed(ptrs):
            path.append(c)
            c = p[c]
        label[s + cut : s + n] = path[::-1]
        cur[d] = c
    for t in range(cut - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        label[at] = cur[:a]
        if t:
            cur[:a] = back[at, cur[:a]]
    return label


def _predict(texts, state, model: Model, spans: bool):
    kept = state.setdefault("kept", {})
    if len(kept) > CACHE_ENTRIES or "table" not in state:
        kept.clear()
        state["table"], state["length"] = np.zeros((0, len(model.langs)), np.float32), np.zeros(0, np.int64)
    tokens = [t.split() if t else [] for t in texts]
    fresh = list({w for ws in tokens for w in ws if w not in kept})
    if fresh:
        words = [letters_of(w) for w in fresh]
        base = len(state["table"])
        state["table"] = np.concatenate([state["table"], *(model.score(words[i : i + 100_000]) for i in range(0, len(words), 100_000))])
        state["length"] = np.r_[state["length"], np.fromiter(map(len, words), np.int64, len(words))]
        kept.update(zip(fresh, range(base, base + len(fresh))))
    get = kept.__getitem__
    ids = [np.fromiter(map(get, ws), np.int64, len(ws)) for ws in tokens]
    sizes = np.array([len(x) for x in ids], np.int64)
    starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    emit, length = state["table"][flat], state["length"][flat]
    label = viterbi(emit, starts, sizes, model.switch)
    n_lang, owner = len(model.langs), np.repeat(np.arange(len(texts)), sizes)
    key = owner * n_lang + label.astype(np.int64)
    share = np.bincount(key, length, len(texts) * n_lang).reshape(-1, n_lang)
    whole = np.stack([np.bincount(owner, emit[:, j], len(texts)) for j in range(n_lang)], 1)
    total = share.sum(1)
    top = share.max(1, keepdims=True)
    pick = np.where(share == top, whole, -np.inf).argmax(1)
    own = label == pick[owner]
    inside = np.stack([np.bincount(owner[own], emit[own, j], len(texts)) for j in range(n_lang)], 1)
    margin = np.clip(inside - inside[np.arange(len(texts)), pick][:, None], -700, 700)
    score = share[np.arange(len(texts)), pick] / np.maximum(total, 1) / np.exp(margin).sum(1)
    out = {"lang_pred": [model.langs[p] if n else UND for p, n in zip(pick, total)], "score": np.where(total > 0, np.clip(score, 0, 1), 0.0)}
    if spans:
        found = []
        for s, n in zip(starts.tolist(), sizes.tolist()):
            lab = label[s : s + n]
            cuts = np.flatnonzero(np.diff(lab)) + 1
            edges = [0, *cuts.tolist(), n] if n and length[s : s + n].any() else []
            found.append([{"first_word": a, "last_word": b - 1, "lang": model.langs[lab[a]]} for a, b in zip(edges, edges[1:])])
        out["spans"] = found
    return out


def _undefined(texts, state, spans):
    return {"lang_pred": [UND] * len(texts), "score": [0.0] * len(texts)} | ({"spans": [[] for _ in texts]} if spans else {})


def fit(train: DataFrame, limit: int = LIMIT, switch: float = SWITCH) -> Model | None:
    """A model of train's (doc_id, text, lang); rows with a null text or lang teach nothing."""
    from .common import ship_package

    ship_package(train.sparkSession)
    rows = train.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGS + 1).collect()}
    if len(sizes) > LANGS:
        raise ValueError(f"more than {LANGS} languages: a model of so many does not fit a worker")
    if not sizes:
        return None
    langs = sorted(sizes)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, limit / sizes[k]))])
    draw = F.crc32(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("langid")).cast("binary")) / F.lit(float(1 << 32))
    counts = rows.where(draw < F.try_element_at(share, F.col("lang"))).select("text", "lang").mapInArrow(partial(_count_grams, langs=langs), "l int, k int, n long")
    table = np.zeros((len(langs), 2 * BUCKETS + len(SCRIPTS)), np.int64)
    got = counts.groupBy("l", "k").agg(F.sum("n").alias("n")).toArrow()
    table[got["l"].to_numpy(), got["k"].to_numpy()] = got["n"].to_numpy()
    return Model(langs, table, switch)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and spans array<struct<first_word, last_word, lang>> (words split at white space)."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fn = partial(_undefined, spans=spans) if model is None else partial(_predict, model=model, spans=spans)
    added = "lang_pred string, score double" + ", spans array<struct<first_word:long,last_word:long,lang:string>>" * spans
    return map_text(plain, "text", fn, added, 16 << 20).drop("text")


def held_out(docs: DataFrame):
    return crc_bucket(docs["doc_id"], 3) == 1
