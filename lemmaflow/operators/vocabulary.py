"""Byte-pair vocabularies: pair counts, training, encoding and decoding of the corpus's own tokenizer.

Training runs over distinct words with their frequencies, not over the corpus: words are counted once
and only that table is rewritten.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.logic import nfc
from ..schema import SPECIAL_TOKENS
from ..shipping import ship
from ..sources.files import work_folder

#: Fixed value: the public byte-level split: contractions, then letters, digits or signs with one space before them; white space
#: in front of a word leaves its last character to it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD = "(?U)" + SPLIT
#: Most distinct segments of words, and most pairs, that a round of training brings to the driver. Merges don't depend on them.
SEGMENTS, MOST_PAIRS = 50_000, 100_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """word and n over all texts in NFC."""
    return df.select(F.explode(words(nfc(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def symbols(word: Column) -> Column:
    """The UTF-8 bytes of a word as two-digit hexadecimal symbols."""
    return F.regexp_extract_all(F.hex(F.encode(word, "UTF-8")), F.lit("(..)"), F.lit(1))


def pair_counts(table: DataFrame, parts: str = "parts", n: str = "n") -> DataFrame:
    """left, right and how often they stand side by side, weighted by n."""
    size = F.size(parts)
    both = F.when(size > 1, F.transform(F.sequence(F.lit(0), size - 2), lambda i: F.struct(F.get(parts, i).alias("left"), F.get(parts, i + 1).alias("right"))))
    return table.select(F.explode(both).alias("p"), n).groupBy("p.left", "p.right").agg(F.sum(n).alias("n"))


def train(df: DataFrame, text: str, merges: int, min_frequency: int = 2, segments: int | None = None, log: list | None = None) -> list[tuple[str, str]]:
    """Merges in order, as hexadecimal symbols: at most `merges`, each of a pair seen min_frequency times or more; ties go to the smaller pair.

    Runs in rounds over a table of distinct words that stays on the cluster. A round takes the most frequent pairs, those with more than some count, and cuts each
    word where two neighbours are not such a pair. No later merge across a cut can be as frequent (each of its occurrences is one of
    the pair that was cut), so the distinct segments with their frequencies decide all merges down to that count, in their exact order. There are far fewer
    segments than words; how many pairs a round takes follows from a bound on segments, which alone reach the driver. The words are then
    rewritten with the round's merges, and those of one symbol are left out. If even the pairs of one count are too many, the first of them by name are taken, and
    the round ends where a merge across a cut could come first.

    log gets, for each round, the numbers of its pairs, segments and merges.
    """
    spark = df.sparkSession
    ship(spark)
    most = segments or SEGMENTS
    table = _table(word_counts(df, text).where("length(word) > 0").select(symbols(F.col("word")).alias("parts"), "n"))
    out: list[tuple[str, str]] = []
    take = 256
    while len(out) < merges:
        ranked = pair_counts(table).where(F.col("n") >= min_frequency).orderBy(F.desc("n"), "left", "right")
        top = [((r["left"], r["right"]), r["n"]) for r in ranked.limit(take + 1).collect()]
        if not top:
            break
        while True:
            hot, least, tied = _hot(top, take, min_frequency)
            found = _segments(table, hot)
            found = (found.limit(most + 1) if len(hot) > 1 else found).toArrow()  # of one pair there are runs of it only
            if found.num_rows <= most or len(hot) == 1:
                break
            take = max(1, len(hot) // 2)
        words = zip((x.split(" ") for x in found["segment"].to_pylist()), found["n"].to_pylist())  # noqa: B905
        new = merge_symbols(words, merges - len(out), least, max(hot) if tied else None)
        if log is not None:
            log.append((len(hot), found.num_rows, len(new)))
        out += new
        take = min(4 * take, MOST_PAIRS) if found.num_rows < most // 4 else take
        if len(out) < merges:
            done, table = table, _table(_rewritten(table, new))
            _drop(done)
    return out


def _table(words: DataFrame) -> DataFrame:
    """Words of two symbols or more, written and read again."""
    path = work_folder(words.sparkSession)
    words.where(F.size("parts") > 1).write.parquet(path)
    out = words.sparkSession.read.schema("parts array<string>, n long").parquet(path)
    out._lemmaflow_path = path
    return out


def _drop(table: DataFrame) -> None:
    sc = table.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(table._lemmaflow_path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def _hot(top: list, take: int, min_frequency: int) -> tuple[set, int, bool]:
    """Of the most frequent pairs in order: those of a round, the least count it decides, and whether pairs of the same count are left."""
    if len(top) <= take:
        return {p for p, _ in top}, min_frequency, False
    beyond = top[take][1]
    if top[0][1] > beyond:
        return {p for p, n in top if n > beyond}, beyond + 1, False
    return {p for p, _ in top[:take]}, beyond, True


def _segments(table: DataFrame, hot: set) -> DataFrame:
    """segment (symbols with a space between) and n: runs of symbols in which each two neighbours are a hot pair."""

    def run(batches):
        found: dict = {}
        for b in batches:
            for parts, n in zip(b.column("parts").to_pylist(), b.column("n").to_pylist(), strict=True):
                start = 0
                for i in range(1, len(parts) + 1):
                    if i == len(parts) or (parts[i - 1], parts[i]) not in hot:
                        if i - start > 1:
                            key = " ".join(parts[start:i])
                            found[key] = found.get(key, 0) + n
                        start = i
            if len(found) > 200_000:
                yield _rows(found)
                found = {}
        if found:
            yield _rows(found)

    return table.mapInArrow(run, "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))


def _rows(found: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["segment", "n"])


def merged(parts: list[str], rank: dict) -> list[str]:
    """parts after all merges of `rank`, one after the other."""
    while len(parts) > 1:
        best = min(((rank[p], p) for p in zip(parts, parts[1:]) if p in rank), default=None)
        if best is None:
            break
        parts = joined(parts, *best[1])
    return parts


def joined(parts: list[str], left: str, right: str) -> list[str]:
    """Each occurrence of a pair joined, from the left, without overlap."""
    out, i = [], 0
    while i < len(parts):
        both = i + 1 < len(parts) and parts[i] == left and parts[i + 1] == right
        out.append(left + right if both else parts[i])
        i += 1 + both
    return out


def _rewritten(table: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    rank = {p: i for i, p in enumerate(merges)}

    def run(batches):
        for b in batches:
            parts = [merged(p, rank) for p in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.list_(pa.string())), b.column("n")], names=["parts", "n"])

    return table.mapInArrow(run, "parts array<string>, n long")


def merge_words(words, merges: int, min_frequency: int = 2) -> list[tuple[str, str]]:
    """train() over (word, n) pairs in one process."""
    return merge_symbols((([f"{b:02X}" for b in word.encode()], n) for word, n in words), merges, min_frequency)


def merge_symbols(words, merges: int, min_frequency: int = 2, border: tuple[str, str] | None = None) -> list[tuple[str, str]]:
    """Merges over (symbols, n): a heap of pair counts, and the words in which each pair stands.

    border: pairs of min_frequency after this one may stand where the symbols were cut. After a merge of (a, b) such a pair (b, y) may have
    become (a + b, y), of the same count; the merges end before one that it could come before. A pair (x, a) becomes (x, a + b), which is still after the border.
    """
    parts, n, counts, where = [], [], {}, {}
    for p, k in words:
        if len(p) > 1:
            for pair in zip(p, p[1:]):
                counts[pair] = counts.get(pair, 0) + k
                where.setdefault(pair, set()).add(len(parts))
            parts.append(p)
            n.append(k)
    heap = [(-c, pair) for pair, c in counts.items()]
    heapq.heapify(heap)
    out: list[tuple[str, str]] = []
    unseen = None  # the smallest left symbol that a pair across a cut may have got
    while heap and len(out) < merges:
        c, pair = heapq.heappop(heap)
        if counts.get(pair, 0) != -c:
            continue  # an older count
        if -c < min_frequency or (unseen is not None and pair[0] >= unseen) or (border is not None and pair > border):
            break
        out.append(pair)
        left, right = pair
        if border is not None and right >= min(border[0], unseen or border[0]):
            unseen = min(left + right, unseen or left + right)
        changed = set()
        for w in where.pop(pair):
            old, new = parts[w], joined(parts[w], left, right)
            for p in zip(old, old[1:]):
                counts[p] -= n[w]
                changed.add(p)
            for p in zip(new, new[1:]):
                counts[p] = counts.get(p, 0) + n[w]
                where.setdefault(p, set()).add(w)
                changed.add(p)
            parts[w] = new
        for p in changed:
            if counts[p] > 0:
                heapq.heappush(heap, (-counts[p], p))
            else:
                del counts[p]
    return out


class Vocabulary:
    """Special tokens first, then the 256 bytes, then one token a merge."""

    def __init__(self, merges: list[tuple[str, str]]):
        self.merges = [tuple(m) for m in merges]
        self.tokens = [*SPECIAL_TOKENS, *(f"{b:02X}" for b in range(256)), *(a + b for a, b in self.merges)]
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.rank = {m: i for i, m in enumerate(self.merges)}

    def __len__(self) -> int:
        return len(self.tokens)

    def id_of(self, token: str) -> int | None:
        return self.ids.get(token)

    def token_of(self, i: int) -> str | None:
        return self.tokens[i] if 0 <= i < len(self.tokens) else None

    def word_ids(self, word: str) -> list[int]:
        parts = [f"{b:02X}" for b in word.encode()]
        while len(parts) > 1:
            rank, i = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == len(self.rank):
                break
            parts[i : i + 2] = ["".join(parts[i : i + 2])]
        return [self.ids[p] for p in parts]

    def encode(self, text: str) -> list[int]:
        """Special tokens stand for themselves; the text between is cut into words."""
        import unicodedata

        import regex

        out: list[int] = []
        special = "|".join(map(regex.escape, SPECIAL_TOKENS))
        for part in regex.split(f"({special})", unicodedata.normalize("NFC", text)):
            if part in SPECIAL_TOKENS:
                out.append(self.ids[part])
            elif part:
                for w in regex.findall(SPLIT, part):
                    out += self._cached(w)
        return out

    @lru_cache(maxsize=100_000)  # noqa: B019
    def _cached(self, w: str) -> list[int]:
        return self.word_ids(w)

    def decode(self, ids, skip_special: bool = True) -> str:
        out = b""
        for i in ids:
            t = self.tokens[i]
            out += (b"" if skip_special else t.encode()) if i < len(SPECIAL_TOKENS) else bytes.fromhex(t)
        return out.decode("utf-8", "replace")

    def broken_specials(self) -> list[str]:
        """Special tokens that do not encode to one id: should be none."""
        return [t for t in SPECIAL_TOKENS if len(self.encode(t)) != 1]


def encode_column(df: DataFrame, vocabulary: Vocabulary, text: str, out: str = "input_ids") -> DataFrame:
    """df with token ids; the vocabulary goes to executors as a broadcast of its merges (its size is its own bound)."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.merges)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = Vocabulary(shared.value)
        for s in parts:
            yield s.map(lambda t: v.encode(t or ""))

    return df.withColumn(out, run(F.col(text)))


def decode_column(df: DataFrame, vocabulary: Vocabulary, ids: str, out: str = "decoded", skip_special: bool = True) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.merges)

    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = Vocabulary(shared.value)
        for s in parts:
            yield s.map(lambda x: v.decode(x, skip_special))

    return df.withColumn(out, run(F.col(ids)))
