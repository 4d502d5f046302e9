"""Every registered query of the corpus operators against its SQL in DuckDB."""

import os

import pytest

from lemmaflow.plans.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def cell(v):
    if v is None or v != v:
        return "NULL"
    if str(v) in ("True", "False"):
        return str(v)
    try:
        return f"{float(v):.4f}"
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in df.where(df.notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"bpe_train"}))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_compositions_hold_whole_texts(spark, tmp_path):
    texts = [f"Doc {i} starts. " + f"filler{i} " * 40 + f"ends {i}" for i in range(6)]
    spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    nl = [r.nl for r in QUERIES["compositions"](spark, str(tmp_path)).collect()]
    assert nl and all(any(x.startswith(t + ". ") for t in texts) and any(x.endswith(t[1:]) for t in texts) for x in nl)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "lang", "source"]
