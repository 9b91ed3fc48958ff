"""Every query with an SQL twin gives the twin's rows; the others run."""

import duckdb
import pandas as pd
import pytest

from quarrymill.operators import retrieval as R
from quarrymill.plans import building, more  # noqa: F401
from quarrymill.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df):
    cell = lambda v: "-" if v is None or v is pd.NA or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted("|".join(map(cell, r)) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, db, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship_returns_whole_texts(spark, monkeypatch):
    text = "word " * 500
    columns = "query_id long, rank int, url string, search_text string, title string, heading string, doc_type string, product string, distance double, rerank double"
    found = spark.createDataFrame([(1, 1, "https://docs.example.org/a", text, "t", "h", "d", "p", 0.5, 0.1)], columns)
    monkeypatch.setattr(R, "search", lambda *_: found)
    assert QUERIES["search_flagship"](spark, SF).first()["snippet"] == text
