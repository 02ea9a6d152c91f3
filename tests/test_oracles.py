"""Differential check of every registered query against its DuckDB oracle on the sf0.001 tables."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracles import TABLES, digest

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle_or_is_documented():
    """Every query of the library itself has its SQL; the training-data queries that have none name their tests."""
    def module(name):
        return QUERIES[name].__wrapped__.__module__

    own = {n for n in QUERIES if not module(n).startswith("tremor.llm") and module(n) != "corpus_pipeline"}
    assert not own - set(ORACLES)
    tests = "".join(p.read_text() for p in pathlib.Path(__file__).parent.glob("llm/test_*.py"))
    for name in set(QUERIES) - own - set(ORACLES):
        assert name in tests or name == "pipeline" and "corpus_pipeline" in tests, name


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_small, con, name):
    df = QUERIES[name](spark, sf_small)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLES[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(rows, df.columns)[0] == digest(orows, ocols)[0]


def test_score_ml_rows(spark, sf_small):
    out = QUERIES["score_ml"](spark, sf_small).collect()
    assert all(r.prediction in ("0", "1") and 0.5 <= r.score <= 1.0 for r in out)


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0
