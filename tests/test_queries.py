"""Every query that SQL can express against DuckDB, row by row; the others must run."""

import os

import duckdb
import pytest

from helixframe import catalog

ALL, SQL = catalog.all_queries(), catalog.all_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(map(repr, pdf[columns].astype(object).where(pdf[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    assert rows(ALL[name](spark, sf).toPandas()) == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, sf, name):
    got = ALL[name](spark, sf).toPandas()
    assert len(got) > 0
    for column in ("same", "r2_same", "r1_same", "r0_same", "tail_same", "exact", "decode_failed"):
        if column not in got or name == "block_fsm_roundtrip":
            continue
        assert got[column].all()


def test_block_code_finds_a_payload_as_near_as_the_one_sent(spark, sf):
    """A block's check has eight bits, so another payload can lie as near as the one that was sent, never one farther off."""
    got = ALL["block_fsm_roundtrip"](spark, sf).toPandas()
    assert (got["distance"] <= got["blocks"]).all()  # one base of each block was changed
    assert got["same"].mean() > 0.8
