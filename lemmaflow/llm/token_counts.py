"""Token counts of a piece vocabulary by rank-synchronous array merging.

A text is normalised as the vocabulary asks (a space before it, spaces as U+2581) and cut into
pre-tokens at each border that no piece crosses: before a U+2581 that follows another character.
Distinct pre-tokens are held as ragged numpy arrays. In each round every sequence finds the lowest
rank of its adjacent pairs and all sequences apply theirs at the same time; what survives is
counted, where a character outside the vocabulary counts its UTF-8 bytes.

A rank that one piece alone has is applied at all its places at once, from left to right without
overlap, if no piece that it is part of ranks before it: then no better pair can arise between
those places. Of the other ranks (pieces made late, runs of spaces) only the leftmost place is applied.

A round passes over all that is left of the sequences, so a sequence of more than LONG symbols would be passed over once
for each of its merges: these few are merged from a queue of their pairs in order of rank and place, which are the
same merges, in time in proportion to length. Very long texts are counted whole.

Edge cases: null text is the empty text and has no tokens. Rows are independent: repeated rows
repeat, null doc_ids are carried, an empty table stays empty, extra columns are not carried.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps, map_text

SPACE = "▁"
LIMIT = 4096
#: Entries of a worker's table of counted pre-tokens, after which it starts anew; results don't depend on it.
CACHE_ENTRIES = 400_000
LONG = 400
_NONE = np.int64(1 << 40)
_PRETOKEN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces, their ranks, and the sorted pairs that make them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalise = sp.normalize
        usable = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        names = {sp.id_to_piece(i): i for i in usable}
        scores = {i: sp.get_score(i) for i in usable}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = {i: order[s] for i, s in scores.items()}
        holders = np.bincount([rank[i] for i in usable], minlength=len(order))
        assert not any(SPACE in p.lstrip(SPACE) for p in names), "a piece crosses a word's border"
        self.chars = {p: i for p, i in names.items() if len(p) == 1}
        self.base = sp.vocab_size()
        keys, made = [], []
        for p, i in names.items():
            for cut in range(1, len(p)):
                a, b = names.get(p[:cut]), names.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.base + b)
                    made.append(i)
                    for x, part in ((a, p[:cut]), (b, p[cut:])):
                        if len(part) > 1 and rank[x] >= rank[i]:
                            holders[rank[x]] = max(2, holders[rank[x]])  # its making may give a better pair: one place at a time
        at = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[at]
        self.made = np.array(made, np.int64)[at]
        self.rank = np.full(self.base + 1, _NONE)
        for i, r in rank.items():
            self.rank[i] = r
        self.alone = np.append(holders < 2, False)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or base."""
        key = np.where((left < self.base) & (right < self.base), left * self.base + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], self.base)

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token (not empty)."""
        few = [i for i, w in enumerate(words) if len(w) > LONG]
        if few:
            out = np.zeros(len(words), np.int64)
            rest = [i for i, w in enumerate(words) if len(w) <= LONG]
            out[rest] = self.count([words[i] for i in rest])
            out[few] = [self._count_long(words[i]) for i in few]
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        joined = "".join(words)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        distinct, where = np.unique(points, return_inverse=True)
        ids = np.array([self.chars.get(chr(c), self.base) for c in distinct], np.int64)
        width = np.array([1 if self.chars.get(chr(c)) is not None else len(chr(c).encode()) for c in distinct], np.int64)
        sym, owner = ids[where], np.repeat(np.arange(len(words)), sizes)
        total = np.bincount(owner, width[where], len(words)).astype(np.int64)
        while len(sym) > 1:
            inside = owner[1:] == owner[:-1]
            piece = np.where(inside, self._pair(sym[:-1], sym[1:]), self.base)
            rank = self.rank[piece]
            starts = np.flatnonzero(np.r_[True, ~inside])
            best = np.minimum.reduceat(np.r_[rank, _NONE], starts)
            best = np.repeat(best, np.diff(np.r_[starts, len(sym)]))[:-1]
            hit = np.flatnonzero((rank == best) & (rank < _NONE))
            if not len(hit):
                break
            # In a chain of overlapping places every second one counts, from the left.
            fresh = np.r_[True, np.diff(hit) > 1]
            chain = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            take = (np.arange(len(hit)) - chain) % 2 == 0
            shared = ~self.alone[np.minimum(rank[hit], len(self.alone) - 1)]
            first = np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]
            hit = hit[take & (~shared | first)]
            total -= np.bincount(owner[hit], minlength=len(words))
            sym[hit] = piece[hit]
            live = np.ones(len(sym), bool)
            live[hit + 1] = False
            # Sequences without a merge are finished and leave the arrays.
            active = np.zeros(len(words), bool)
            active[owner[hit]] = True
            live &= active[owner]
            sym, owner = sym[live], owner[live]
        return total


    def _count_long(self, word: str) -> int:
        """Tokens of one long pre-token, from a queue of rank * 2^32 + place."""
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        distinct, where = np.unique(points, return_inverse=True)
        sym = np.array([self.chars.get(chr(c), self.base) for c in distinct], np.int64)[where]
        total = int(np.array([1 if chr(c) in self.chars else len(chr(c).encode()) for c in distinct])[where].sum())
        piece = self._pair(sym[:-1], sym[1:])
        at = np.flatnonzero(self.rank[piece] < _NONE)
        queue = ((self.rank[piece[at]] << 32) + at).tolist()
        heapq.heapify(queue)
        n, sym, known = len(sym), sym.tolist(), {}
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def rank_of(i: int, j: int) -> tuple[int, int]:
            key = (sym[i], sym[j])
            if key not in known:
                made = int(self._pair(np.array([key[0]]), np.array([key[1]]))[0])
                known[key] = (made, int(self.rank[made]))
            return known[key]

        while queue:
            x = heapq.heappop(queue)
            i, rank = x & 0xFFFFFFFF, x >> 32
            j = after[i]
            if sym[i] < 0 or j >= n:
                continue
            made, now = rank_of(i, j)
            if now != rank:
                continue  # one of the two has changed
            sym[i], sym[j] = made, -1
            total -= 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                r = rank_of(i, after[i])[1]
                if r < _NONE:
                    heapq.heappush(queue, (r << 32) + i)
            k = before[i]
            if k >= 0:
                r = rank_of(k, i)[1]
                if r < _NONE:
                    heapq.heappush(queue, (r << 32) + k)
        return total


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    return Pieces(path)


_COUNTED: dict = {}
keeps(_COUNTED.clear)


def count_texts(texts: list, path: str) -> list[int]:
    """Tokens of each text; None is the empty text."""
    p = load(path)
    kept = _COUNTED.setdefault(path, {})
    if len(kept) > CACHE_ENTRIES:
        kept.clear()
    cut = [_PRETOKEN.findall(p.normalise(t)) if t else () for t in texts]
    fresh = list({w for ws in cut for w in ws if w not in kept})
    if fresh:
        for i in range(0, len(fresh), 100_000):
            part = fresh[i : i + 100_000]
            kept.update(zip(part, p.count(part).tolist()))
    get = kept.__getitem__
    out = [sum(map(get, ws)) for ws in cut]
    for w in fresh:
        if len(w) > 64:
            del kept[w]
    return out


def _count(texts, state, path, limit):
    n = count_texts(texts, path or default_path())
    return {"n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = map_text(plain, "text", partial(_count, path=path, limit=limit), "n_bytes long, n_tokens long, over_limit boolean", 2 << 20)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")
