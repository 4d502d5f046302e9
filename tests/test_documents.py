"""JSON documents cut at any byte: same objects as a parser of the whole text gives."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lemmaflow.sources import documents


def made(rng, n):
    odd = ['"', "\\", "}", "{", "[", "]", "\\\\", '\\"', "é日 ", "\n", "}{", '": [', "x" * 300, ""]
    value = lambda d: rng.choice([rng.randrange(9), None, True, "".join(rng.choice(odd) for _ in range(rng.randrange(5)))]) if d == 0 or rng.random() < 0.5 else ({f"k{i}": value(d - 1) for i in range(rng.randrange(3))} if rng.random() < 0.6 else [value(d - 1) for _ in range(rng.randrange(3))])
    return [{"id": i, "v": value(3), "examples": value(2)} for i in range(n)]


@pytest.mark.parametrize(("indent", "ascii_only"), [(None, True), (2, False)])
def test_objects_of_documents(spark, tmp_path, monkeypatch, indent, ascii_only):
    rng = random.Random(4)
    whole = made(rng, 40)
    docs = {
        "first.json": {"examples": whole, "stats": {"a": {"b": {}}, "c": [{"id": -1}]}},
        "last.json": {"meta": [{"id": -2}], "more": {"x": [{"id": -3}]}, "examples": whole},
        "bare.json": whole,
        "none.json": {"examples": [], "other": [{"id": -4}]},
        "lacks.json": {"other": [{"id": -5}]},
    }
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=indent, ensure_ascii=ascii_only))
        expected = doc if isinstance(doc, list) else doc.get("examples", [])
        for size in ("150b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            if size == "150b" and name not in ("first.json", "bare.json"):
                continue
            got = documents.objects(spark, str(tmp_path / name)).orderBy("pos").collect()
            assert [r.pos for r in got] == list(range(len(expected))), (name, size)
            assert [json.loads(r.text) for r in got] == expected, (name, size)
    spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_parts_of_one_document(spark, tmp_path):
    rows = [(i, "x}" * (i % 7) + '"{[', None if i % 3 else "c", i * 2) for i in range(200)]
    df = spark.createDataFrame(rows, "pos long, t string, u string, n long").repartition(5)
    stats = spark.createDataFrame([(3, None)], "total long, missing string")
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        documents.write_document(df, stats, f"{tmp_path}/d", "pos")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    files = sorted((tmp_path / "d").glob("part-*"))
    assert len(files) > 2
    doc = json.loads("".join(f.read_text() for f in files))
    assert doc["stats"] == {"total": 3, "missing": None} and doc["examples"] == [{"t": t, "u": u, "n": n} for _, t, u, n in rows]
    back = documents.read_document(spark, f"{tmp_path}/d", kind="t string, u string, n long").orderBy("pos")
    assert [tuple(r) for r in back.collect()] == rows
    documents.write_document(df.where(F.lit(False)), stats, f"{tmp_path}/e", "pos")
    assert json.loads("".join(f.read_text() for f in sorted((tmp_path / "e").glob("part-*")))) == {"examples": [], "stats": {"total": 3, "missing": None}}
    assert documents.objects(spark, f"{tmp_path}/e").count() == 0


def test_several_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"examples": [{"n": 1}, {"n": 2}]}\n')
    (tmp_path / "b.json").write_text('[{"n": 3}]')
    got = documents.objects(spark, str(tmp_path), joined=False).orderBy("document", "pos").collect()
    assert [(r.document, r.pos, r.text) for r in got] == [(0, 0, '{"n": 1}'), (0, 1, '{"n": 2}'), (1, 0, '{"n": 3}')]
