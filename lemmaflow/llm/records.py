"""Token ids as length-delimited binary records, with a separate index of their offsets.

A folder holds shards in ascending order of doc_id, an index beside each shard, and a manifest (Parquet).
All numbers are little-endian.

* A record: the payload's length (8 bytes), the masked checksum of these 8 bytes (4), the payload, the masked checksum of the payload (4).
* A payload: one byte (1: null doc_id, 2: ids have four bytes instead of two), doc_id (8 bytes), the ids.
* An index: for each record its offset, its number of bytes with the frame, and its number of ids (8 bytes each), and after the last one the
  masked checksum of all that.
* A checksum is the CRC-32 of zlib, rotated right by 15 bits plus a constant: a CRC of bytes that hold CRCs themselves is weak, masking mends that.
* A row of the manifest: a block of about BLOCK_BYTES of a shard, its place, and its numbers of records and ids. Readers take blocks, so a shard of
  any size is read by many tasks, each of which seeks to its own part.

Shards are written by tasks straight into the folder, each try under a name of its own; the manifest has those of the tries that Spark
kept, so lost executors, repeated and speculative tries leave at worst a file that nothing names. Rows are dealt by ranges of (doc_id, hash of the
text, row number), so no id or text, however often repeated, has to fit a task. Where a document's ids begin follows from its
block's running sums.

Texts are encoded by the tokenizers library. A byte-level pattern never puts a visible ASCII character or a letter and a space or line break after it in one
pre-token, so texts are cut there, and each distinct piece goes through the library once a worker (`Pieces`, bounded tables).

Edge cases: a null text is the empty text: one record with the end id alone. Null doc_ids come first; equal ones are in the order of
xxhash64 of their text, and each row is a record of its own. A very long text is one record, held whole by one task. An empty table gives a folder with
an empty manifest. Extra columns are not carried. A damaged record or index raises ValueError.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import running_sum
from .common import keeps, new_folder, settle, ship_package, slices

BLOCK_BYTES = 16 << 20
END_ID = 2
#: What is added to a rotated checksum, as in the record files of public training frameworks.
MASK = 0xA282EAD8
#: Entries of each of a worker's two tables of encoded pieces; results don't depend on it.
CACHE_ENTRIES = 700_000
#: Most tasks that read a folder.
READERS = 20_000
_INDEX = struct.Struct("<QQQ")
#: Where no pre-token goes on.
_CUT = re.compile(r"(?<=[!-~]|[^\W\d_])(?=[ \n])")
_VISIBLE = frozenset(map(chr, range(0x21, 0x7F)))


def _closed(word: str) -> bool:
    """Whether the word is not empty and no pre-token goes on from it to a space: it ends with a visible ASCII character or a letter."""
    return word[-1:] in _VISIBLE or word[-1:].isalpha()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data, at: int = 0) -> tuple[memoryview, int]:
    """The payload of the record at a place, and the place after it."""
    view = memoryview(data)
    if len(view) < at + 12:
        raise ValueError("a record is cut short")
    (n,), (crc,) = struct.unpack_from("<Q", view, at), struct.unpack_from("<I", view, at + 8)
    if masked(view[at : at + 8]) != crc or len(view) < at + 16 + n:
        raise ValueError("a record's length is damaged")
    payload = view[at + 12 : at + 12 + n]
    if masked(payload) != struct.unpack_from("<I", view, at + 12 + n)[0]:
        raise ValueError("a record is damaged")
    return payload, at + 16 + n


def pack(doc_id: int | None, ids: bytes) -> bytes:
    """A payload; ids: as unsigned integers of 32 bits."""
    wide = np.frombuffer(ids, "<u4")
    four = len(wide) and int(wide.max()) > 0xFFFF
    return struct.pack("<Bq", (doc_id is None) + 2 * bool(four), doc_id or 0) + (ids if four else wide.astype("<u2").tobytes())


def unpack(payload: memoryview) -> tuple[int | None, bytes]:
    """doc_id, and ids as unsigned integers of 32 bits."""
    flags, doc_id = struct.unpack_from("<Bq", payload)
    body = payload[9:]
    return None if flags & 1 else doc_id, bytes(body) if flags & 2 else np.frombuffer(body, "<u2").astype("<u4").tobytes()


class Pieces:
    """Encodes texts with the library, each distinct piece once."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.model._resize_cache(0)  # what comes here is new to it
        #: Ids of a punctuation mark that ends a word of Latin letters, and so is a pre-token of its own.
        self.marks = {c: array("I", self.tokenizer.encode(c, add_special_tokens=False).ids).tobytes() for c in _VISIBLE if not c.isalnum()}
        self.words: dict[str, bytes] = {}  # by what follows a space
        self.old: dict[str, bytes] = {}
        self.line_break = self.tokenizer.token_to_id("Ċ")  # as a byte-level vocabulary spells it
        self.pieces: dict[str, bytes] = {}

    def _ask(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, a space before each; 4,000 are one call, with a line break after each."""
        out = {}
        for i in range(0, len(words), 4000):
            some = words[i : i + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + "\n ".join(some) + "\n"], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.line_break)
            assert len(ends) == len(some), "the library cuts words otherwise than expected"
            raw, at = ids.tobytes(), (ends * 4).tolist()
            out.update((w, raw[x:y]) for w, x, y in zip(some, [0, *[x + 4 for x in at]], at))  # noqa: B905
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned integers of 32 bits."""
        if len(self.words) >= CACHE_ENTRIES:
            self.old, self.words = self.words, {}
        if len(self.pieces) >= CACHE_ENTRIES:
            self.pieces = {}
        get, old, out, todo, new, odd = self.words.get, self.old.get, [], [], {}, []
        for text in texts:
            parts = text.split(" ")
            got = list(map(get, parts))
            first, got[0] = parts[0], b""
            if first or None in got:
                self._misses(parts, got, todo, new, odd)
            out.append(got)
        uncommon = [_CUT.split(p) for _, _, p in odd]
        rest, local = [], {}
        for p in dict.fromkeys(p for pieces in uncommon for p in pieces):
            word = p[1:] if p[:1] == " " and _closed(p) and "\n" not in p else ""
            ids = (get(word) or old(word)) if word else self.pieces.get(p)
            if ids is not None:
                local[p] = ids
            elif word:
                new[word] = b""
            else:
                rest.append(p)
        new = self._ask(list(new))
        for p, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            local[p] = array("I", e.ids).tobytes()
            if len(p) <= 64:
                self.pieces[p] = local[p]
        known = lambda p: local.get(p) or new.get(p[1:], b"")
        for got, i, word, stem, tail in todo:
            got[i] = new[stem] + tail
            if tail and len(word) <= 64:
                self.words[word] = got[i]
        for (got, i, _), pieces in zip(odd, uncommon, strict=True):
            got[i] = b"".join(map(known, pieces))
        self.words.update((w, ids) for w, ids in new.items() if len(w) <= 64)
        return list(map(b"".join, out))

    def _misses(self, parts: list[str], got: list, todo: list, new: dict, odd: list) -> None:
        """Words that aren't known; one after which no cut is safe is encoded together with what follows."""
        n, done, get, old, marks = len(parts), 0, self.words.get, self.old.get, self.marks.get
        for i in ([0] if parts[0] else []) + [i for i, g in enumerate(got) if g is None]:
            if i < done:
                continue
            word = parts[i]
            if i and _closed(word) and "\n" not in word:
                ids = old(word)
                if ids is None:
                    tail, stem = marks(word[-1], b""), word[:-1]
                    if not (tail and stem.isalpha() and (stem.isascii() or max(stem) < "ɐ")):
                        tail, stem = b"", word
                    ids = (get(stem) or old(stem)) if tail else None
                    if ids is None:
                        todo.append((got, i, word, stem, tail))
                        new[stem] = b""
                        continue
                    ids += tail
                got[i] = self.words[word] = ids
                continue
            j = i + 1
            while j < n and not _closed(parts[j - 1]):
                got[j] = b""
                j += 1
            odd.append((got, i, (" " if i else "") + " ".join(parts[i:j])))
            done = j


_KNOWN: dict = {}
keeps(_KNOWN.clear)


def _pieces(path: str | None) -> Pieces:
    if path not in _KNOWN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        _KNOWN[path] = Pieces(path)
    return _KNOWN[path]


def _place(uri: str):
    """File system and path of a URI, as tasks open it without Spark."""
    uri = re.sub("^s3[an]:", "s3:", uri)
    return pa.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri) if ":" in uri.split("/")[0] else "file://" + uri)


_BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("shard", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), ("records", pa.int64()), ("ids", pa.int64())])
_BLOCKS_DDL = "part int, block int, shard string, offset long, bytes long, records long, ids long"


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str | None, end_id: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    import uuid

    from pyspark import TaskContext

    settle(__name__)
    part = TaskContext.get().partitionId()
    name = f"part-{part:06d}-{uuid.uuid4().hex}"
    fs, root = _place(folder)
    end, encoder = struct.pack("<I", end_id), _pieces(path)
    shard, index, at, blocks, crc = None, [], 0, [], 0
    begun, records, ids = 0, 0, 0
    for batch in batches:
        for piece in slices([batch], "text", 1 << 20):
            packed = encoder.encode([t or "" for t in piece.column("text").to_pylist()])
            if shard is None:
                shard, listed = fs.open_output_stream(f"{root}/{name}.rec"), fs.open_output_stream(f"{root}/{name}.idx")
            for doc_id, own in zip(piece.column("doc_id").to_pylist(), packed, strict=True):
                data = frame(pack(doc_id, own + end))
                shard.write(data)
                index.append(_INDEX.pack(at, len(data), len(own) // 4 + 1))
                at, records, ids = at + len(data), records + 1, ids + len(own) // 4 + 1
                if at - begun >= block_bytes:
                    blocks.append((part, len(blocks), name, begun, at - begun, records, ids))
                    begun, records, ids = at, 0, 0
            rows = b"".join(index)
            crc = zlib.crc32(rows, crc)
            listed.write(rows)
            index = []
    if shard is None:
        return
    if records:
        blocks.append((part, len(blocks), name, begun, at - begun, records, ids))
    listed.write(struct.pack("<I", ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF))
    listed.close()
    shard.close()
    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*blocks), _BLOCKS, strict=True)], schema=_BLOCKS)


def write(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the ids of all documents, each with the end id after it, as shards in order of doc_id. Returns the folder (default: one in the shared folder)."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = folder or new_folder(spark)
    fs, root = _place(folder)
    fs.create_dir(root, recursive=True)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = plain.select("*", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("row")]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    placed.mapInArrow(partial(_write, folder=folder, path=path, end_id=end_id, block_bytes=block_bytes), _BLOCKS_DDL).write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The folder's blocks, with the numbers of ids (start) and records (first) of all before."""
    blocks = spark.read.schema(_BLOCKS_DDL).parquet(f"{folder}/manifest")
    order = [F.col("part"), F.col("block")]
    summed = running_sum(blocks, order, F.col("part"), F.col("ids"), "start")
    return running_sum(summed, order, F.col("part"), F.col("records"), "first")


def _spread(blocks: DataFrame) -> DataFrame:
    """A task for each block, up to READERS."""
    return blocks.repartition(max(1, min(READERS, blocks.count())))


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema, strict=True)], schema=schema)


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64()))])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch], folder: str, digest: bool) -> Iterator[pa.RecordBatch]:
    fs, root = _place(folder)
    schema = _DIGEST if digest else _READ
    for batch in batches:
        for b in batch.to_pylist():
            with fs.open_input_file(f"{root}/{b['shard']}.rec") as f:
                f.seek(b["offset"])
                data = f.read(b["bytes"])
            at, start, rows, held = 0, b["start"], [], 0
            for _ in range(b["records"]):
                payload, at = unframe(data, at)
                doc_id, ids = unpack(payload)
                n = len(ids) // 4
                rows.append((doc_id, start, n, zlib.crc32(ids) if digest else np.frombuffer(ids, "<u4")))
                start, held = start + n, held + (1 if digest else n + 1)
                if held >= 500_000:
                    yield _out(rows, schema)
                    rows, held = [], 0
            if at != len(data):
                raise ValueError("a block is longer than its records")
            if rows:
                yield _out(rows, schema)


def read(spark: SparkSession, folder: str, blocks: DataFrame | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of all records, or of some blocks of manifest()."""
    ship_package(spark)
    return _spread(manifest(spark, folder) if blocks is None else blocks).mapInArrow(partial(_read, folder=folder, digest=False), "doc_id long, start long, n_tokens long, ids array<long>")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as unsigned integers of 32 bits), from the files."""
    ship_package(spark)
    return _spread(manifest(spark, folder)).mapInArrow(partial(_read, folder=folder, digest=True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _index(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = _place(folder)
    schema = pa.schema([("record", pa.int64()), ("shard", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64())])
    for batch in batches:
        for b in batch.to_pylist():
            with fs.open_input_stream(f"{root}/{b['shard']}.idx") as f:
                crc, first = 0, b["first"]
                left = b["records"]
                while left:
                    rows = f.read(min(left, 100_000) * _INDEX.size)
                    crc = zlib.crc32(rows, crc)
                    table = np.frombuffer(rows, "<u8").reshape(-1, 3)
                    left -= len(table)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(table))), pa.array([b["shard"]] * len(table), pa.string()), pa.array(table[:, 0].astype(np.int64)), pa.array(table[:, 1].astype(np.int64))], schema=schema)
                    first += len(table)
                if struct.pack("<I", ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF) != f.read(4):
                    raise ValueError("an index is damaged")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """record (number in order), shard, offset and bytes of every record, from the index files."""
    ship_package(spark)
    shards = manifest(spark, folder).groupBy("shard").agg(F.min("first").alias("first"), F.sum("records").alias("records"))
    return _spread(shards).mapInArrow(partial(_index, folder=folder), "record long, shard string, offset long, bytes long")


def _fetch(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = _place(folder)
    schema = pa.schema([("record", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
    files: dict = {}
    for batch in batches:
        rows, held = [], 0
        for b in batch.to_pylist():
            if b["shard"] not in files:
                if len(files) >= 64:
                    files.pop(next(iter(files))).close()
                files[b["shard"]] = fs.open_input_file(f"{root}/{b['shard']}.rec")
            f = files[b["shard"]]
            f.seek(b["offset"])
            doc_id, ids = unpack(unframe(f.read(b["bytes"]))[0])
            rows.append((b["record"], doc_id, np.frombuffer(ids, "<u4")))
            held += len(ids) // 4 + 1
            if held >= 500_000:
                yield _out(rows, schema)
                rows, held = [], 0
        if rows:
            yield _out(rows, schema)
    for f in files.values():
        f.close()


def shuffled(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """record, doc_id and ids of all records in a random order that depends on the seed alone: the index is shuffled, not the ids."""
    order = [F.xxhash64(F.lit(seed), F.col("record")), F.col("record")]
    return index(spark, folder).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(_fetch, folder=folder), "record long, doc_id long, ids array<long>")
