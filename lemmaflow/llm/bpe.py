"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Every byte prefix of a pre-token has exactly one valid last token: the token that ends the prefix's
encoding. The table of last tokens is filled from left to right: of the vocabulary's tokens that end
at a position, the valid one is that which may stand beside the last token of the prefix it leaves
over (`Ranks.stable`). Following the table back from the end gives the encoding. Appending bytes
only adds entries, and an edit recomputes them from the edit on, so both are exact
(`PrefixTable.append`, `PrefixTable.splice`).

Very long texts are encoded whole, pre-token by pre-token; a pre-token's time is in proportion to its length.

Edge cases: null text is the empty text (0 tokens; the digests of no bytes). Rows are independent:
repeated rows repeat, null doc_ids are carried, an empty table stays empty, extra columns are not carried (decode carries
them).
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache, partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps, map_text

#: Entries of each of a worker's two tables of encoded pre-tokens; when the young one is full it becomes the old
#: one, and what is used again moves back. Results don't depend on it.
CACHE_ENTRIES = 300_000


#: Pairs of neighbours whose stability a worker remembers; results don't depend on it.
KNOWN_PAIRS = 500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Ranks:
    """A rank file: bytes of each token, and each token's last merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = [b""] * (max(self.ids.values()) + 1)
        for raw, i in self.ids.items():
            self.bytes_of[i] = raw
        #: Length of the longest token by its last three bytes.
        self.reach: dict[bytes, int] = {}
        for raw in self.ids:
            if len(raw) > 2:
                self.reach[raw[-3:]] = max(len(raw), self.reach.get(raw[-3:], 0))
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int] | None] = [None] * len(self.bytes_of)
        self.known: dict[tuple[int, int], bool] = {}
        for raw, i in sorted(self.ids.items(), key=lambda x: x[1]):
            for cut in range(1, len(raw)):
                left, right = self.ids.get(raw[:cut]), self.ids.get(raw[cut:])
                if left is not None and right is not None and left < i and right < i and self._stable(left, right):
                    self.parts[i] = (left, right)
                    self.merged[left, right] = i
                    break

    def _stable(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between two tokens, at any time of the two tokens' making.

        Walks both tokens back through their merges, always undoing the younger one; `bound` is the
        rank from which a merge across the border would have come too late.
        """
        bound = len(self.bytes_of)
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                return False
            a, b = self.parts[left], self.parts[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]

    def stable(self, left: int, right: int) -> bool:
        got = self.known.get((left, right))
        if got is None:
            if len(self.known) > KNOWN_PAIRS:
                self.known.clear()
            got = self.known[left, right] = self._stable(left, right)
        return got


class PrefixTable:
    """The last token of every prefix of one pre-token."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """The pre-token goes on with these bytes; what was stored stays valid."""
        r = self.ranks
        get, stable, seen, reach = r.ids.get, r.stable, r.known.get, r.reach.get
        start = len(self.data)
        data = self.data = self.data + more
        last = self.last
        for end in range(start + 1, len(data) + 1):
            for cut in range(max(0, end - reach(data[end - 3 : end], 2)) if end > 2 else 0, end):
                token = get(data[cut:end])
                if token is None:
                    continue
                if cut:
                    ok = seen((last[cut], token))
                    if ok is None:
                        ok = stable(last[cut], token)
                    if not ok:
                        continue
                last.append(token)
                break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def splice(self, start: int, stop: int, new: bytes) -> None:
        """Bytes start to stop become `new`; prefixes before the edit are kept."""
        tail = self.data[stop:]
        self.data = self.data[:start]
        del self.last[start + 1 :]
        self.append(new + tail)

    def tokens(self) -> list[int]:
        out, end, last, sizes = [], len(self.data), self.last, self.ranks.bytes_of
        while end:
            out.append(last[end])
            end -= len(sizes[last[end]])
        return out[::-1]


@lru_cache(maxsize=4)
def load(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(maxsize=4)
def _pattern(text: str):
    import regex

    return regex.compile(text)


class Codec:
    """encode() and decode() of whole texts; keeps what it has encoded, up to a bound."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        import public_tokenizers

        self.ranks = load(path or default_path())
        self.findall = _pattern(pattern or public_tokenizers.PATTERN).findall
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def packed(self, piece: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        if len(self.kept) >= CACHE_ENTRIES:
            self.old, self.kept = self.kept, {}
        out = self.kept.get(piece) or self.old.get(piece)
        if out is not None:
            self.kept[piece] = out
            return out
        raw = piece.encode()
        whole = self.ranks.ids.get(raw)
        ids = array("I", [whole] if whole is not None else PrefixTable(self.ranks, raw).tokens())
        out = ids.tobytes()
        if len(piece) <= 64:
            self.kept[piece] = out
        return out

    def encode_packed(self, text: str) -> bytes:
        packed = self.packed
        out = []
        pieces = self.findall(text)
        for i in range(0, len(pieces), 100_000):
            get = self.kept.get  # the table may have been replaced
            out += [get(p) or packed(p) for p in pieces[i : i + 100_000]]
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_packed(text)).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, ids))


_CODECS: dict = {}


def _clear() -> None:
    _CODECS.clear()
    load.cache_clear()


keeps(_clear)


def _codec(path, pattern) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _encode(texts, state, path, pattern):
    c = _codec(path, pattern)
    return {"ids": [array("I", c.encode_packed(t or "")).tolist() for t in texts]}


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """doc_id and ids array<long>."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_text(plain, "text", partial(_encode, path=path, pattern=pattern), "ids array<long>").select("doc_id", "ids")


def _decode(rows, state, path):
    c = _codec(path, None)
    known = range(len(c.ranks.bytes_of))
    return {"decoded": [None if r is None or any(i not in known for i in r) else c.decode(r) for r in rows]}


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """encoded with `decoded`, the bytes of its ids; null ids, and ids that the vocabulary does not have, give null."""
    return map_text(encoded, ids_col, partial(_decode, path=path), "decoded binary")


def _digest(texts, state, path, pattern):
    c = _codec(path, pattern)
    n, ids_sha, decoded_sha = [], [], []
    for t in texts:
        packed = c.encode_packed(t or "")
        n.append(len(packed) // 4)
        ids_sha.append(hashlib.sha256(packed).hexdigest())
        decoded_sha.append(hashlib.sha256(c.decode(array("I", packed))).hexdigest())
    return {"n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the bytes decoded from them, without keeping either."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = map_text(plain, "text", partial(_digest, path=path, pattern=pattern), "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
