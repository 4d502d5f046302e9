"""Binary records: files against a plain construction, round trips, shuffled reads, damage."""

import os
import random
import struct
import zlib
from array import array
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lemmaflow.llm import records

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "  ", " a", "a  b", "a \n b", "a\x85 b", "\xa0 x", "é é é", "日本 語 x", "a<|endoftext|> b <|endoftext|>", "\n\nA b\n c ", "x" * 5000, "it's 'they're' 12 34", "end.\nStart  \n", "　 b", "\x00 z", "word, " * 30_000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(records.default_path())


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_encoder_is_the_library(library, monkeypatch):
    rng = random.Random(4)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(" \n\tabAé1.,'<|#\x85日") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [" ".join("".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 7))) + rng.choice(["", "", ",", ".\n"]) for _ in range(200)) for _ in range(30)]
    monkeypatch.setattr(records, "CACHE_ENTRIES", 300)  # tables are renewed all the time
    own = records.Pieces()
    for i in range(0, len(texts), 50):
        for t, got in zip(texts[i : i + 50], own.encode(texts[i : i + 50]), strict=True):
            assert list(array("I", got)) == ids_of(library, t)[:-1], t[:80]


def test_files(spark, library):
    rng = random.Random(6)
    rows = [(i * 7 % 900, t, "en", "s", 1) for i, t in enumerate(ODD)]
    rows += [(None, f"no id {i}", "en", "s", 1) for i in range(40)] + [(None, "no id", None, None, None)] * 30 + [(5000, f"one id {i}", "en", "s", 1) for i in range(60)]
    rows += [(1000 + i, " ".join(rng.choice(["the", "of", "zebra", "Quasi"]) for _ in range(rng.randrange(80))), "en", "s", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("x")).withColumn("part", F.lit(1)).withColumn("h", F.lit(2)).repartition(7)
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        folder = records.write(docs, block_bytes=3000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    hashed = {(r.doc_id, r.text): r.h2 for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h2")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[0], r[1]]))
    expected, at = [], 0
    for doc_id, text, *_ in ordered:
        ids = ids_of(library, text)
        expected.append((doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert [tuple(r) for r in records.digests(spark, folder).orderBy("start").collect()] == expected
    blocks = records.manifest(spark, folder)
    assert blocks.count() > blocks.select("part").distinct().count() > 1
    whole = records.read(spark, folder).orderBy("start").collect()
    assert [(r.doc_id, r.ids) for r in whole] == [(r[0], ids_of(library, r[1])) for r in ordered]
    index = records.index(spark, folder).orderBy("record").collect()
    assert [r.record for r in index] == list(range(len(rows)))
    one, two, again = (records.shuffled(spark, folder, s).collect() for s in (1, 2, 1))
    assert [r.record for r in one] == [r.record for r in again] != [r.record for r in two]
    assert sorted(r.record for r in one) == list(range(len(rows))) != [r.record for r in one]
    assert all((r.doc_id, r.ids) == (whole[r.record].doc_id, whole[r.record].ids) for r in one)
    assert sorted(os.path.splitext(f)[1] for f in os.listdir(folder.removeprefix("file://"))) == sorted([".idx", ".rec"] * blocks.select("part").distinct().count() + [""])
    shard = folder.removeprefix("file://") + f"/{blocks.first().shard}.rec"
    with open(shard, "r+b") as f:
        f.seek(30)
        b = f.read(1)
        f.seek(30)
        f.write(bytes([b[0] ^ 1]))
    with pytest.raises(Exception, match="damaged"):
        records.digests(spark, folder).collect()


def test_no_documents(spark):
    folder = records.write(spark.createDataFrame([], DOCS))
    assert records.digests(spark, folder).count() == records.index(spark, folder).count() == records.shuffled(spark, folder, 3).count() == 0


def test_frames():
    wide = records.pack(-5, struct.pack("<3I", 1, 70_000, 2))
    assert records.unpack(memoryview(wide)) == (-5, struct.pack("<3I", 1, 70_000, 2))
    assert records.unpack(memoryview(records.pack(None, b""))) == (None, b"")
    data = records.frame(b"one") + records.frame(b"")
    first, at = records.unframe(data)
    assert bytes(first) == b"one" and bytes(records.unframe(data, at)[0]) == b"" and records.unframe(data, at)[1] == len(data)
    for broken in (data[:10], data[: len(data) - 1], b"\x09" + data[1:]):
        with pytest.raises(ValueError):
            records.unframe(broken, records.unframe(broken)[1])


def test_counter_of_query_columns(spark):
    from lemmaflow.llm import queries

    assert Counter(queries.op13_token_records(spark, "/root/testdata/sf0.001").columns) == Counter(["doc_id", "start", "n_tokens", "ids_crc32"])


def test_words_end_at_letters_too(library):
    """A word that ends with a letter beyond ASCII is a piece of its own; with what follows, it would be a new piece nearly every time."""
    rng = random.Random(1)
    bits = ["é", "ß", "word", "größe", "naïve", " ", "  ", "\n", "\t", " ", "'s", "'", "1", "²", "½", "中文", "か", "́", "ǅ", "ɐ", "\U00010d70", "<|endoftext|>", ",", ".", "_", "\r\n", "\x00", "​", "😀", "ⅷ", "\x85"]
    pieces = records.Pieces()
    for _ in range(40):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(50)]
        assert [list(array("I", x)) for x in pieces.encode(texts)] == [ids_of(library, t)[:-1] for t in texts]
    pieces = records.Pieces()
    pieces.encode(["", " ".join(f"así{i} allí y{i}é fin größe, größe." for i in range(50))])
    assert {"allí", "y7é", "größe", "größe,"} <= set(pieces.words) and not any(" " in p.strip() for p in pieces.pieces)
